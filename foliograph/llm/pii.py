"""Personal data by boosted trees over overlapping candidate spans.

Four base patterns with exact rules (Luhn's check, ranges, digit counts) give
spans that always stay.  Generators with high recall propose more spans, which
may overlap; boosted trees judge each by its format and its surroundings, and a
threshold calibrated for the kind decides.  Of accepted spans that overlap the
likelier one is kept, and none that overlaps a base span.

The trees are trained here, on generated examples (see pii_model.py), and
become SQL expressions: spans, features, trees and selection all run as
DataFrame functions inside the JVM.

No pattern matches across a line feed, and the quantifiers are possessive or
guarded, so matching takes linear time and no deep stack on very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm import pii_model

#: The base patterns.  ``\G`` lets a match begin where the last one ended; a run of
#: characters in which no match begins at its first one has none further on.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators: kind and pattern.
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{2,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?(?![0-9A-Za-z])", "[0-9]{3}"),
    ("secret", r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+(?![A-Za-z0-9_/+=-])", "[A-Za-z0-9_/+=-]{16}"),
    ("secret", r"(?<![A-Za-z0-9])(?:[Pp]assword|PASSWORD|passwd|pwd|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|access[_-]?key)\x20{0,3}[:=]\x20{0,3}[\"']?[^\s\"']{6,}+", "[:=]"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])", "[0-9]{3}[ -]"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2}"),
)
ALL_KINDS = (*KINDS, "secret", "ssn", "iban")
#: Code points before a span that count as its surroundings.
CONTEXT = 40
#: Code points after it, up to the next match.
AFTER = 12

#: Arrays are built in parts of this many elements, so that a text with many spans costs no square of them.
PART = 256

SPAN = "array<struct<k:int,s:int,e:int,v:string,b:string,a:string>>"
KEPT = "array<struct<o:double,s:int,x:int,k:int,e:int>>"


def _parts(kind: str, **state: Column) -> Column:
    """State of a fold that gathers an array<...> in parts."""
    empty = F.array().cast(kind)
    return F.struct(*[v.alias(k) for k, v in state.items()], empty.alias("part"), F.array().cast(f"array<{kind}>").alias("done"))


def _with(acc: Column, more: Column, **state: Column) -> Column:
    """The state with the elements of ``more`` added."""
    full = F.size(acc["part"]) >= PART
    part = F.when(full, more).otherwise(F.concat(acc["part"], more))
    done = F.when(full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"])
    return F.struct(*[v.alias(k) for k, v in state.items()], part.alias("part"), done.alias("done"))


def _whole(acc: Column) -> Column:
    return F.concat(F.flatten(acc["done"]), acc["part"])


def _found(text: Column, pattern: str, kind: int, needs: Column) -> Column:
    """All matches: array of (kind, start, end, value, text before), in code points; empty where ``needs`` is false."""
    # what stands between the matches says where they begin; after the last one there is a gap without a match
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"), F.transform(F.slice(gaps, F.lit(2), F.size(gaps)), lambda g: F.left(g, F.lit(AFTER))).alias("n"))

    def add(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        before = F.substring(F.concat(acc["tail"], x["g"]), -CONTEXT, CONTEXT)
        span = F.struct(F.lit(kind).alias("k"), s.alias("s"), e.alias("e"), x["m"].alias("v"), before.alias("b"), F.coalesce(x["n"], F.lit("")).alias("a"))
        return _with(acc, F.array(span), at=e, tail=F.substring(F.concat(acc["tail"], x["g"], x["m"]), -CONTEXT, CONTEXT))

    every = F.aggregate(F.filter(steps, lambda x: x["m"].isNotNull()), _parts(SPAN, at=F.lit(0), tail=F.lit("")), add, _whole)
    return F.when(needs, every).otherwise(F.array().cast(SPAN))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check over a string of 13 to 19 digits."""
    back = F.reverse(digits)

    def worth(i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(back)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _ip_holds(v: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.when(F.length(part(p)) <= 3, part(p)).otherwise("256").cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds that pass their rules, by kind and start."""
    email = _found(text, EMAIL, 0, text.contains("@"))
    ip = F.filter(_found(text, IP, 1, text.rlike(r"[0-9]\.[0-9]")), lambda x: _ip_holds(x["v"]))
    card = F.filter(_found(text, CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda x: F.when(F.length(_digits(x["v"])).between(13, 19), _luhn(_digits(x["v"]))).otherwise(False))
    phone = F.filter(_found(text, PHONE, 3, text.contains("+")), lambda x: F.length(_digits(x["v"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def features(value: Column, before: Column, generator: int, after: Column | None = None) -> dict[str, Column]:
    """Format and context features of a candidate; pii_model.measured() says the same in Python."""
    count = lambda p: F.length(value) - F.length(F.regexp_replace(value, p, ""))
    low, after = F.lower(before), F.lit("") if after is None else after
    out = {
        "chars": F.length(value),
        "digits": count("[0-9]"),
        "upper": count("[A-Z]"),
        "lower": count("[a-z]"),
        "separators": count("[ .()-]"),
        "switches": F.size(F.regexp_extract_all(value, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), F.lit(0))),
        "hex": value.rlike("^[0-9a-f]+$").cast("int"),
        "bracket": value.contains("(").cast("int"),
        "prefix": value.rlike(pii_model.PREFIX).cast("int"),
        "assigned": value.rlike("[:=]").cast("int"),
        "near_phone": low.rlike(pii_model.NEAR_PHONE).cast("int"),
        "near_secret": low.rlike(pii_model.NEAR_SECRET).cast("int"),
        "near_identity": low.rlike(pii_model.NEAR_IDENTITY).cast("int"),
        "after_slash": before.rlike(r"[/.#@]$").cast("int"),
        "near_hash": F.concat(low, F.lit(" "), F.lower(after)).rlike(pii_model.NEAR_HASH).cast("int"),
        "ssn": value.rlike(pii_model.SSN).cast("int"),
        "goes_on": after.rlike("^[/.@:%][A-Za-z0-9]").cast("int"),
        "generator": F.lit(generator),
    }
    return {k: v.cast("double") for k, v in out.items()}


def tree_sum(model: pii_model.Model, x: dict[str, Column]) -> Column:
    """The trees as nested conditions, summed."""

    def walk(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        name, at, low, high = node
        return F.when(x[name] <= F.lit(float(at)), walk(low)).otherwise(walk(high))

    total = F.lit(float(model.base))
    for tree in model.trees:
        total = total + walk(tree)
    return total


def _judged(text: Column, generator: int, model: pii_model.Model) -> Column:
    """What one generator proposes and its threshold accepts: array of (kind, start, end, probability)."""
    kind, pattern, hint = GENERATORS[generator]
    k = ALL_KINDS.index(kind)

    def described(c):
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), *[v.alias(name) for name, v in features(c["v"], c["b"], generator, c["a"]).items()])

    def judged(c):
        p = 1 / (1 + F.exp(-(F.lit(model.slope[kind]) * tree_sum(model, c) + F.lit(model.shift[kind]))))
        return F.struct(F.lit(k).alias("k"), c["s"].alias("s"), c["e"].alias("e"), F.round(p, 6).alias("p"))

    candidates = _found(text, pattern, k, text.rlike(hint))
    return F.filter(F.transform(F.transform(candidates, described), judged), lambda c: c["p"] >= F.lit(model.threshold[kind]))


def _apart(a: Column, b: Column) -> Column:
    return (a["e"] <= b["s"]) | (b["e"] <= a["s"])


def _ranges(spans: Column) -> Column:
    """The spans by start, cut into about as many parts as a part has spans: array of (first start, last end, spans)."""
    plain = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    step = lambda a: F.ceil(F.sqrt(F.size(a))).cast("int")
    cut = lambda a: F.transform(F.sequence(F.lit(1), F.size(a), step(a)), lambda at: F.slice(a, at, step(a)))
    # a fold of one step names the sorted array, so that it is made once
    parts = F.aggregate(F.array(plain), F.array().cast("array<array<struct<s:int,e:int>>>"), lambda acc, a: F.when(F.size(a) > 0, cut(a)).otherwise(acc))
    return F.transform(parts, lambda p: F.struct(p[0]["s"].alias("s"), F.array_max(F.transform(p, lambda x: x["e"])).alias("e"), p.alias("spans")))


def added_spans(text: Column, ranges: Column) -> Column:
    """Accepted candidates, in order of place and none overlapping: array of (-probability, start, -end, kind, end).

    ``ranges`` are the base spans by :func:`_ranges`.  Of candidates that
    overlap the likelier one stays; a chain of overlapping candidates is
    decided for itself.
    """
    model = pii_model.trained()
    scored = [_judged(text, n, model) for n in range(len(GENERATORS))]
    # the transform of one element names the ranges: left in the inner function they would be made anew for each candidate
    clear = lambda named: F.filter(F.concat(*scored), lambda c: ~F.exists(named, lambda r: ~_apart(r, c) & F.exists(r["spans"], lambda b: ~_apart(b, c))))
    free = F.flatten(F.transform(F.array(ranges), clear))
    placed = F.array_sort(F.transform(free, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.struct((-c["p"]).alias("o"), c["s"].alias("s"), (-c["e"]).alias("x"), c["k"].alias("k"), c["e"].alias("e")).alias("c"))))
    none = F.array().cast(KEPT)

    def best(chain):
        return F.aggregate(F.array_sort(chain), none, lambda acc, c: F.when(F.exists(acc, lambda b: ~_apart(b, c)), acc).otherwise(F.concat(acc, F.array(c))))

    def add(acc, x):
        breaks = x["s"] >= acc["end"]
        chain = F.when(breaks, F.array(x["c"])).otherwise(F.concat(acc["chain"], F.array(x["c"])))
        return _with(acc, F.when(breaks, best(acc["chain"])).otherwise(none), end=F.greatest(acc["end"], x["e"]), chain=chain)

    return F.aggregate(placed, _parts(KEPT, end=F.lit(0), chain=none), add, lambda acc: F.concat(_whole(acc), best(acc["chain"])))


def spelled(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, n_added, spans for every row of ``df``.

    Null counts as empty, and an empty text has no spans (base_sha256 is that
    of the empty string).  Every row is handled for itself; other columns are not read.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_base", base_spans(F.col("_text")))
    rows = rows.withColumn("_ranges", _ranges(F.col("_base")))
    rows = rows.withColumn("_added", added_spans(F.col("_text"), F.col("_ranges")))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(spelled(plain("_base")), 256).alias("base_sha256"), F.size("_added").cast("long").alias("n_added"), spelled(F.concat(plain("_base"), plain("_added"))).alias("spans"))


def redact(df: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """``df`` with every span of its text replaced by its kind; overlapping base spans are replaced as one.

    Null texts stay null, empty ones empty; rows are handled each for itself.
    """
    names = F.array(*[F.lit(mark.format(k)) for k in ALL_KINDS])
    t = F.col(text)
    base = base_spans(F.coalesce(t, F.lit("")))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    rows = df.withColumn("_base", base).withColumn("_ranges", _ranges(F.col("_base")))
    spans = F.array_sort(F.concat(plain(F.col("_base")), plain(added_spans(F.coalesce(t, F.lit("")), F.col("_ranges")))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        piece = F.substring(t, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], piece, F.element_at(names, x["k"] + 1))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return rows.withColumn(text, F.when(t.isNotNull(), done)).drop("_base", "_ranges")
