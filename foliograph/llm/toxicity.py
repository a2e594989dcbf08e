"""Toxicity by a learnt lexicon, misspellings of its terms, and their context.

Training reads a bounded sample of labelled rows.  Terms (whole words, or
beginnings of words) that mark toxic documents are chosen one after another,
each for the toxic documents that it adds.  Scoring runs every distinct word
of a text through a Levenshtein automaton intersected with the lexicon's trie:
one walk finds exact terms, beginnings, and terms with one wrong letter (two,
for long terms).  The words around a hit say whether it is quoted or meant; a
logistic model over the counts of hits gives the score.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import cut, held, lean

#: Bound of the sample that the classifier is fitted on; what it learns is bounded by it alone.
MAX_ROWS = 20_000
#: A term's counts must be likelier by this much with a toxic rate of its own.
LEAST_GAIN = 18
STEMS = (4, 5, 6, 7, 8)
#: Misspellings are matched of terms in at least this share of the sample's toxic rows: what is near a
#: seldom word is as likely another word.
SPELLED_SHARE = 0.01
THRESHOLD = 0.7
#: Words that report what others said, and marks that open a quotation; fixed values.
REPORTING = frozenset("said says wrote writes called calls quote quoted quoting cites cited word words term insult insults dit écrit appelle mot citation sagt sagte schrieb nannte wort zitat dijo escribió llamó palabra cita".split())
ADDRESSING = frozenset("you your you're youre u ur tu te toi vous du dich dir dein ihr usted ustedes vosotros eres".split())
#: Marks that open a quotation, and those that end it; it ends before a line does.  A single mark opens
#: after something else than a letter and closes before it; a line that begins with > is quoted as a whole.
CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’", "`": "`"}
OPENING = re.compile(r"[\"“„«‘`]|(?<!\w)'(?=\w)|^[ \t]*>[^\n]*", re.M)
SINGLE = re.compile(r"'(?!(?<=\w')\w)|\n")
STOPS = {mark: re.compile(f"[{ends}\n]") for mark, ends in CLOSING.items()}
QUOTES = frozenset("\"“”«»„‘`")

#: Rows whose texts are held as Python strings at a time.
SLICE = 512
#: Tokens without a term that a worker remembers in each of two generations; what is forgotten is matched again.
REMEMBERED = 50_000
#: States of an automaton that a worker keeps.
MOST_STATES = 6_000
#: Signs that commonly stand beside a word.
SIGNS = ".,;:!?()[]\"'“”„«»…"
WORD = re.compile(r"[^\W\d_]+")
#: Words with digits or signs between their letters; nothing is given back, so a long token is read once.
RUN = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:(?:[^\w\s]|[\d_])++[^\W\d_]++)+")
FEATURES = ("exact_kinds", "exact", "begun_kinds", "begun", "near_kinds", "near", "quoted", "addressed", "share")


class Automaton:
    """Levenshtein automata of all terms, intersected with the trie of the terms.

    A state is a set of (trie node, errors so far); states are made when a word
    first leads to them.  A word costs one step a letter and usually ends
    after two or three, where no term is within reach.
    """

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.begins: dict[int, str] = {}
        self.most = [0]
        self.allowed = {t: allowance(t) if share >= SPELLED_SHARE and not t.endswith("*") else 0 for t, share in terms.items()}
        for term in terms:
            stem = term.endswith("*")
            body = term.rstrip("*")
            allowed = self.allowed[term]
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for c in body:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], allowed)
            (self.begins if stem else self.ends)[node] = term
        #: children, each with the most errors that a term beyond it allows
        self.reach = [[(k, self.most[k]) for k in x.values() if self.most[k]] for x in self.children]
        self._forget()
        self._pieces(terms)

    def _forget(self) -> None:
        """Begin with the first state alone; states are made again when words lead to them."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[tuple[int, ...]] = []
        self.steps: list[dict[str, int]] = []
        #: letters that lead anywhere in the trie; all others take one and the same step
        self.labels: list[frozenset] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _pieces(self, terms: dict[str, float]) -> None:
        """Pieces of the terms, with the lengths of the words that may hold them, as tables by length and place.

        With k errors at most, one of k + 1 pieces of a term is untouched: the
        first begins the word, the last ends it, the middle one has moved by
        one letter at most.
        """
        self.pieces: dict[tuple[str, int, int], dict[str, tuple[int, float]]] = {}

        def put(place: str, at: int, piece: str, lo: int, hi: float) -> None:
            table = self.pieces.setdefault((place, len(piece), at), {})
            a, b = table.get(piece, (lo, hi))
            table[piece] = (min(a, lo), max(b, hi))

        for term in terms:
            body, n = term.rstrip("*"), len(term.rstrip("*"))
            k = self.allowed[term]
            at = [n * i // (k + 1) for i in range(k + 2)]
            put("head", 0, body[: at[1]], n - k, math.inf if term.endswith("*") else n + k)
            if k:
                put("tail", 0, body[at[k] :], n - k, n + k)
            if k == 2:
                for shift in (-1, 0, 1):
                    put("inside", at[1] + shift, body[at[1] : at[2]], n - k, n + k)
        self.tables = [(place, m, at, table) for (place, m, at), table in self.pieces.items()]

    def might(self, word: str) -> bool:
        """Whether a piece of a term stands in its place in the word; if not, no term is near."""
        n = len(word)
        for place, m, at, table in self.tables:
            r = table.get(word[-m:] if place == "tail" else word[at : at + m])
            if r is not None and r[0] <= n <= r[1]:
                return True
        return False

    def _closed(self, pairs: set) -> frozenset:
        """With the letters of terms that a word may lack."""
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e < self.most[node]:
                for child in self.children[node].values():
                    if e < self.most[child] and (child, e + 1) not in pairs:
                        pairs.add((child, e + 1))
                        todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in pairs:
            if e < best.get(node, 9):
                best[node] = e
        return frozenset(node << 2 | e for node, e in best.items())

    def _state(self, s: frozenset) -> int:
        if not s:
            return -1
        k = self.ids.get(s)
        if k is None:
            k = self.ids[s] = len(self.sets)
            self.sets.append(tuple(s))
            self.steps.append({})
            self.labels.append(frozenset().union(*[self.children[x >> 2] for x in s]))
        return k

    def _step(self, state: int, c: str) -> int:
        if c not in self.labels[state]:
            nxt = self.steps[state].get("")
            if nxt is not None:
                self.steps[state][c] = nxt
                return nxt
        best: dict[int, int] = {}
        most, children, reach = self.most, self.children, self.reach
        for x in self.sets[state]:
            node, e = x >> 2, x & 3
            spare = e < most[node]
            if spare and e + 1 < best.get(node, 9):
                best[node] = e + 1  # a letter too many
            child = children[node].get(c)
            if child is not None and e < best.get(child, 9):
                best[child] = e
            if spare:
                for child, allowed in reach[node]:
                    if e < allowed and e + 1 < best.get(child, 9):
                        best[child] = e + 1  # another letter
        # with the letters of terms that a word may lack
        todo = list(best.items())
        for node, e in todo:
            if e < most[node] and best[node] == e:
                for child, allowed in reach[node]:
                    if e < allowed and e + 1 < best.get(child, 9):
                        best[child] = e + 1
                        todo.append((child, e + 1))
        nxt = self._state(frozenset([node << 2 | e for node, e in best.items()]))
        self.steps[state][c] = nxt
        if c not in self.labels[state]:
            self.steps[state][""] = nxt
        return nxt

    def match(self, word: str) -> tuple[str, str] | None:
        """(kind, term) of the nearest term: exact, begun or near."""
        if not self.might(word):
            return None
        if len(self.sets) > MOST_STATES:
            self._forget()
        state, begun = self.start, None
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return begun
            for x in self.sets[state] if self.begins else ():
                if x & 3 == 0 and x >> 2 in self.begins:
                    begun = ("begun", self.begins[x >> 2])
        near = None
        for x in self.sets[state]:
            node, e = x >> 2, x & 3
            term = self.ends.get(node)
            if term is not None and e <= self.allowed[term]:
                if e == 0:
                    return "exact", term
                if begun is None and (near is None or (e, term) < near):
                    near = (e, term)
        return begun or (near and ("near", near[1]))

    def inside(self, run: str) -> list[tuple[str, str]]:
        """Parts of a run that are terms with digits or signs for letters, or between them: (part, term), none overlapping."""
        pieces = [m.span() for m in WORD.finditer(run)]
        ends, free, out = {e for _, e in pieces}, 0, []
        for begin, end in pieces:
            if begin < free:
                continue
            state, best = self.start, None
            for at in range(begin, len(run)):
                nxt = self.steps[state].get(run[at])
                state = self._step(state, run[at]) if nxt is None else nxt
                if state < 0:
                    break
                if at >= end and at + 1 in ends:
                    for x in self.sets[state]:
                        node, e = x >> 2, x & 3
                        term = self.ends.get(node)
                        if term is not None and e <= self.allowed[term] and (best is None or (e, term) < best[:2]):
                            best = (e, term, at + 1)
            if best is not None:
                free = best[2]
                out.append((run[begin:free], best[1]))
        return out


def allowance(term: str) -> int:
    """Wrong letters that a misspelling of the term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Scorer:
    """Features of a text; words already met are not matched anew.

    What is remembered depends on the terms alone, not on the words that are
    no misspellings (``proper``), so passes over one lexicon share it.
    """

    def __init__(self, terms: dict[str, float], proper: frozenset[str] = frozenset()):
        self.terms, self.proper, self.automaton = terms, proper, Automaton(terms)
        self.plain: set[str] = set()
        self.older: set[str] = set()
        self.rich: dict[str, tuple] = {}

    def hits(self, low: str) -> dict[str, tuple[str, str]]:
        """(kind, term) of the words of a text in lower case that have one, and of runs with digits or signs in them.

        Neither reaches over white space, so a text's distinct tokens say it
        all, and those known to hold nothing are left out at once.
        """
        hits, parts = {}, []
        for token in set(low.split()) - self.plain - self.older:
            found = self.rich.get(token)
            if found is None:
                found = self._found(token)
                if not found[0] and not found[1]:
                    if len(self.plain) >= REMEMBERED:
                        self.plain, self.older = set(), self.plain
                    self.plain.add(token)
                    continue
                if len(self.rich) > 20_000:
                    self.rich.clear()
                self.rich[token] = found
            for w, k in found[0].items():
                if k[0] != "near" or w not in self.proper:  # a word that clean documents use is no misspelling
                    hits[w] = k
            parts += found[1]
        for part, term in parts:
            if part not in self.proper and not any(w in hits for w in WORD.findall(part)):
                hits[part] = ("near", term)
        return hits

    def _found(self, token: str) -> tuple[dict[str, tuple[str, str]], list[tuple[str, str]]]:
        """Words of a token that have a term, and parts of its runs that are misspelt ones."""
        core = token.strip(SIGNS)
        if core.isalpha():  # one word
            k = None if core in self.plain else self.automaton.match(core)
            return ({} if k is None else {core: k}), []
        words = {}
        for w in WORD.findall(token):
            k = self.automaton.match(w)
            if k is not None:
                words[w] = k
        return words, [x for run in RUN.findall(token) for x in self.automaton.inside(run)]

    def features(self, text: str | None) -> list[float]:
        if not text or not self.terms:
            return [0.0] * len(FEATURES)
        low = text.lower()
        hits = self.hits(low)
        if not hits:
            return [0.0] * len(FEATURES)
        words = WORD.findall(low)
        count, kinds = Counter(), Counter()
        quoted = addressed = 0
        terms_met = set()
        found = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, sorted(hits, key=len, reverse=True))) + r")(?![^\W\d_])")
        spans = quotations(low)
        opened = [a for a, _ in spans]
        for m in found.finditer(low):
            kind, term = hits[m[0]]
            if (kind, term) not in terms_met:
                terms_met.add((kind, term))
                kinds[kind] += 1
            before, after = low[max(0, m.start() - 60) : m.start()], low[m.end() : m.end() + 60]
            k = bisect.bisect_right(opened, m.start()) - 1
            inside = k >= 0 and m.end() <= spans[k][1]
            if inside or _reported(before):
                quoted += 1
            else:
                count[kind] += 1
                if ADDRESSING.intersection(WORD.findall(before)[-5:]) or ADDRESSING.intersection(WORD.findall(after)[:5]):
                    addressed += 1
        log = math.log1p
        total = count["exact"] + count["begun"] + count["near"]
        return [log(kinds["exact"]), log(count["exact"]), log(kinds["begun"]), log(count["begun"]), log(kinds["near"]), log(count["near"]), log(quoted), log(addressed), min(1.0, 20 * total / max(1, len(words)))]


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations stand, from left to right, none overlapping.

    For each kind of mark the next place that ends it is found once and kept,
    so unclosed marks, however many, cost one scan of their line.
    """
    out, at, stops, n = [], 0, {}, len(text)
    while True:
        opened = OPENING.search(text, at)
        if opened is None:
            return out
        begin, mark = opened.start(), text[opened.start()]
        at = begin + 1
        if opened.end() > begin + 1 or mark == ">":  # a quoted line
            at = opened.end()
            out.append((begin, at))
            continue
        if stops.get(mark, -1) <= begin:
            stop = (SINGLE if mark == "'" else STOPS[mark]).search(text, begin + 1)
            stops[mark] = n if stop is None else stop.start()
        stop = stops[mark]
        if stop >= n or text[stop] == "\n" or (mark != "'" and stop == begin + 1):
            continue
        if mark in "‘'" and stop + 1 < n and (text[stop + 1].isalnum() or text[stop + 1] == "_"):
            continue
        at = stop + 1
        out.append((begin, at))


def _reported(before: str) -> bool:
    """Whether one of the last words names what follows as someone's words, with no quotation or sentence closed since."""
    words = list(WORD.finditer(before))[-5:]
    last = [m.end() for m in words if m[0] in REPORTING]
    return bool(last) and not any(c in QUOTES or c in ".!?\n" for c in before[last[-1] :])


def scorer_of(terms: dict[str, float], proper: frozenset[str] = frozenset()) -> Scorer:
    """The scorer of a lexicon; it outlives a task in its worker, and with it the states of its automaton."""
    key, scorers = hash(frozenset(terms.items())), held("toxicity")
    if key not in scorers:
        scorers.clear()  # one lexicon at a time
        scorers[key] = Scorer(terms)
    found = scorers[key]
    found.proper = proper
    return found


class Model:
    def __init__(self, terms: dict[str, float], weights: list[float], bias: float, prior: float, proper: frozenset[str] = frozenset()):
        self.terms, self.weights, self.bias, self.prior, self.proper = terms, weights, bias, prior, proper

    def score(self, features: list[float]) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(int(doc_id)).encode()) % 3 == 1


def held_out(doc_id: str = "doc_id"):
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3) == 1


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """At most MAX_ROWS labelled rows outside the held-out third: doc_id, text, toxic.

    Which ones is decided by a hash of the id.  Of several labels of one
    document the largest counts, of several texts of one id the smallest; null
    ids and labels take no part, a null text counts as empty.
    """
    label = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = label.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _words_of(text: str) -> set[str]:
    return {w for w in WORD.findall(text.lower()) if len(w) >= 3}


def _terms(word: str) -> set[str]:
    return {word} | {word[:n] + "*" for n in STEMS if len(word) > n}


def _terms_of(text: str) -> set[str]:
    words = _words_of(text)
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Fit lexicon and weights on the sample.

    Without labelled rows, or with one kind of label only, the lexicon is empty
    and every score is the same.  Other columns of both tables are not read.
    """
    rows = cut(training_rows(docs, labels, text).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism), "toxic-sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                (yes if y else no).update(_terms_of(t or ""))
            if len(no) + len(yes) > 200_000:
                yield _counted(yes, no)
                yes, no = Counter(), Counter()
        yield _counted(yes, no)

    totals = {bool(r["toxic"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_yes, n_no = totals.get(True, 0), totals.get(False, 0)
    if not n_yes or not n_no:
        return Model({}, [0.0] * len(FEATURES), -30.0 if not n_yes else 30.0, float(bool(n_yes)))
    per = rows.mapInArrow(lean(counts), "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # how much likelier the term's counts are with a toxic rate of its own than with the common rate
    base = n_yes / (n_yes + n_no)
    both = F.col("yes") + F.col("no")
    gain = 2 * (F.col("yes") * F.log(F.col("yes") / both / base) + F.when(F.col("no") > 0, F.col("no") * F.log(F.col("no") / both / (1 - base))).otherwise(0.0))
    per = per.where((F.col("yes") >= 3) & (F.col("yes") / n_yes > 8 * (F.col("no") + 0.5) / n_no)).withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
    found = {r["term"]: (r["yes"], r["no"]) for r in per.collect()}  # as many as the sample has terms that pass

    # which of the found terms cover the words of each toxic document of the sample
    held = rows.sparkSession.sparkContext.broadcast(set(found))

    def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "terms": [[sorted(x) for w in sorted(_words_of(t or "")) if (x := held.value & _terms(w))] for t in b["text"]]})

    holds = [r["terms"] for r in rows.where("toxic > 0").mapInPandas(lean(holding), "doc_id long, terms array<array<string>>").orderBy("doc_id").select("terms").collect()]
    terms = choose(holds, found, n_yes, n_no)

    # words near a term that clean documents of the sample use too much for a term
    def nearby(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(terms)
        for b in batches:
            low = [(t or "").lower() for t in b["text"]]
            near = [[w for w, k in scorer.hits(t).items() if k[0] == "near"] for t in low]
            yield pd.DataFrame({"toxic": b["toxic"], "word": near}).explode("word").dropna().astype({"toxic": "int32", "word": "str"})

    seen = rows.mapInPandas(lean(nearby), "toxic int, word string").groupBy("word").agg(F.sum((F.col("toxic") > 0).cast("long")).alias("yes"), F.sum((F.col("toxic") <= 0).cast("long")).alias("no"))
    proper = frozenset(r["word"] for r in seen.where((F.col("no") > 0) & (F.col("yes") / n_yes <= 8 * F.col("no") / n_no)).collect())

    # weights, on the counts that the scorer itself makes

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(terms, proper)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "x": [scorer.features(t) for t in b["text"]]})

    measured_rows = rows.mapInPandas(lean(measured), "doc_id long, toxic int, x array<double>").orderBy("doc_id").collect()
    return fit(terms, proper, [list(r["x"]) for r in measured_rows], [int(r["toxic"] > 0) for r in measured_rows])


def _counted(yes: Counter, no: Counter) -> pa.RecordBatch:
    terms = list(yes.keys() | no.keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([yes[t] for t in terms], pa.int64()), pa.array([no[t] for t in terms], pa.int64())], ["term", "yes", "no"])


def _gain(yes: float, no: float, n_yes: int, n_no: int) -> float:
    """How much likelier the counts are with a toxic rate of their own than with the common rate; 0 for too few or too mixed."""
    if yes < 3 or yes / n_yes <= 8 * (no + 0.5) / n_no:
        return 0.0
    base = n_yes / (n_yes + n_no)
    return 2 * (yes * math.log(yes / (yes + no) / base) + (no * math.log(no / (yes + no) / (1 - base)) if no else 0.0))


def choose(holds: list[list[list[str]]], found: dict[str, tuple[int, int]], n_yes: int, n_no: int) -> dict[str, float]:
    """The whole words found, so that each keeps its misspellings, and the beginnings that add to them: term to share of toxic rows.

    ``holds`` names, for each toxic document, the found terms of each of its
    words.  A beginning is judged by the documents in which it covers a word
    that no chosen term covers: a word's own beginning adds nothing to it.
    """
    least = max(2, round(0.001 * n_yes))
    by_term: dict[str, set[tuple[int, int]]] = {}
    for k, words in enumerate(holds):
        for n, terms in enumerate(words):
            for t in terms:
                by_term.setdefault(t, set()).add((k, n))
    whole = sorted((t for t in by_term if not t.endswith("*")), key=lambda t: (-_gain(*found[t], n_yes, n_no), t))
    chosen = {t: found[t][0] / n_yes for t in whole if found[t][0] - 3 * found[t][1] >= least}
    covered = set().union(*(by_term[t] for t in chosen))
    import heapq

    heap = [(-float("inf"), t) for t in sorted(by_term) if t.endswith("*")]
    while heap:
        top, t = heapq.heappop(heap)
        adds = len({k for k, n in by_term[t] - covered})
        # of beginnings that add as much, the longer is more exact
        key = -(adds - 3 * found[t][1] + 0.01 * len(t))
        if adds - 3 * found[t][1] < least or _gain(adds, found[t][1], n_yes, n_no) < LEAST_GAIN:
            continue
        if heap and key > heap[0][0] and key != top:
            heapq.heappush(heap, (key, t))
            continue
        chosen[t] = adds / n_yes
        covered |= by_term[t]
    return chosen


def fit(terms: dict[str, float], proper: frozenset[str], x: list[list[float]], y: list[int]) -> Model:
    """Logistic regression by Newton's method, with a small penalty; few distinct rows are counted once.

    Misspelt terms are drawn to the weight of exact ones, so that they count
    like these where the sample holds too few of them to say.
    """
    import numpy as np

    rows = Counter((tuple(round(v, 4) for v in a), b) for a, b in zip(x, y, strict=True))
    a = np.array([[*k[0], 1.0] for k in rows])
    t, n = np.array([k[1] for k in rows], float), np.array(list(rows.values()), float)
    w, penalty = np.zeros(a.shape[1]), np.diag([0.05] * (a.shape[1] - 1) + [1e-3])
    for near, exact in (("near_kinds", "exact_kinds"), ("near", "exact")):
        i, j = FEATURES.index(near), FEATURES.index(exact)
        penalty[j, j] += penalty[i, i]
        penalty[i, j] = penalty[j, i] = -penalty[i, i]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (n * (p - t)) + penalty @ w
        step = np.linalg.solve((a.T * (n * np.maximum(p * (1 - p), 1e-6))) @ a + penalty, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return Model(terms, w[:-1].tolist(), float(w[-1]), float((t * n).sum() / n.sum()), proper)


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``df``.

    Null and empty texts have no hits and get the score of such texts.  A null
    doc_id stays null and is not held out.  Rows are scored each for itself.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(model.terms, model.proper)
        for b in batches:
            s = [model.score(scorer.features(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": s})

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInPandas(lean(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text scores below the threshold, with all their columns.

    Null and empty texts have no hits and stay (unless all that was learnt from
    is toxic); repeated rows are judged each for itself; columns may have any
    name.  An empty table gives an empty result.
    """
    columns = df.columns

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model.terms, model.proper)
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            keep = [model.score(scorer.features(t)) < threshold for t in b.column(columns.index("text")).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(lean(arrow), df.schema)
