"""Positional postings, and query trees evaluated on them.

A posting says how often a token is on a page and, packed, where.  Places are
differences, each in as many bytes of seven bits as it takes.  A page's tokens
are ordered and counted in one pass of array operations over its code points.

A tree is evaluated page by page: the postings of the query's tokens (a filter
on the sorted column) meet by page, each leaf gets its frequency, phrases by
merging places, and built-in expressions make hits and scores of them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.operators import grammar as G

K1, B = 1.2, 0.75
#: Characters that are turned into pairs at a time, unless one text has more.
SLICE_CHARS = 2_000_000


def pack(values) -> tuple[bytes, object]:
    """Numbers below 2^32 in groups of seven bits, the lowest first, and the bytes that each takes."""
    import numpy as np

    values = np.asarray(values, "u8")
    size = 1 + sum((values >= 1 << 7 * k).astype("i8") for k in range(1, 5))
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), "u1")
    for k in range(5):
        some = size > k
        if not some.any():
            break
        out[starts[some] + k] = (values[some] >> np.uint64(7 * k) & np.uint64(127)).astype("u1") | np.where(size[some] > k + 1, 128, 0).astype("u1")
    return out.tobytes(), size


def unpack(data: bytes):
    import numpy as np

    raw = np.frombuffer(data, "u1")
    last = raw < 128
    group = np.cumsum(last) - last
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.array([], "i8")
    shift = (np.arange(len(raw)) - starts[group]) * 7 if len(raw) else starts
    return np.add.reduceat((raw & 127).astype("u8") << shift.astype("u8"), starts).astype("i8") if len(raw) else starts


def places(data: bytes):
    """The places of a posting, rising."""
    import numpy as np

    return np.cumsum(unpack(data))


def places_of(packed: pa.Array) -> tuple:
    """The places of many postings at once, one after the other, and where each posting's begin."""
    import numpy as np

    data = packed.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], "<i8")[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", "u1")[ends[0] : ends[-1]] if len(data) else np.zeros(0, "u1")
    steps = unpack(raw.tobytes())
    count = np.concatenate([[0], np.cumsum(raw < 128)])  # numbers that end before a byte
    starts = count[ends[:-1] - ends[0]] if len(data) else np.zeros(0, "i8")
    total = np.cumsum(steps)
    before = np.where(starts > 0, total[starts - 1], 0) if len(starts) else starts
    return total - np.repeat(before, np.diff(np.append(starts, len(steps)))), starts


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > SLICE_CHARS:
            yield at, k
            at, held = k, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)


def _pairs(texts: list[str], wanted: list[int] | None, first: list[int]):
    """Of every (text, pair): text, pair, number of places and the packed places; pairs as two code points in one number."""
    import numpy as np

    lens = np.array([len(t) for t in texts], "i8")
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
    doc = np.repeat(np.arange(len(texts)), lens)
    inside = doc[1:] == doc[:-1]
    pair = chars[:-1] << 21 | chars[1:]
    if wanted is not None:
        inside &= np.isin(pair, wanted) | np.isin(chars[:-1], first)
    at = np.flatnonzero(inside)
    doc, pair, place = doc[at], pair[at], at - (np.cumsum(lens) - lens)[doc[at]]
    kinds = np.flatnonzero(np.bincount(chars)) if len(chars) else chars  # the code points that occur, rising
    bits, room = max(len(kinds) - 1, 1).bit_length(), int(lens.max(initial=1)).bit_length()
    if len(texts).bit_length() + 2 * bits + room < 64:  # text, pair and place in one number, which sorts several times as fast
        rank = np.zeros(int(chars.max(initial=0)) + 1, "i8")
        rank[kinds] = np.arange(len(kinds))
        whole = ((doc << bits | rank[chars[at]]) << bits | rank[chars[at + 1]]) << room | place
        whole.sort()
        one = (1 << bits) - 1
        doc, place = whole >> (2 * bits + room), whole & (1 << room) - 1
        pair = kinds[whole >> (bits + room) & one] << 21 | kinds[whole >> room & one]
    else:
        order = np.lexsort((pair, doc))  # stable: places stay in order
        doc, pair, place = doc[order], pair[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    starts = np.flatnonzero(new)
    steps = place.copy()
    steps[1:] -= place[:-1]
    steps[starts] = place[starts]
    data, size = pack(steps)
    ends = np.concatenate([np.cumsum(size), [0]])[np.concatenate([starts[1:], [len(size)]]) - 1] if len(starts) else np.array([], "i8")
    return doc[starts], pair[starts], np.diff(np.append(starts, len(doc))), data, np.concatenate([[0], ends])


def _token(pair: int) -> str:
    return chr(pair >> 21) + chr(pair & (1 << 21) - 1)


def postings(docs: DataFrame, key: str = "page_id", body: str = "body", tokens: list[str] | None = None, beginnings: list[str] | None = None, positions: bool = True) -> DataFrame:
    """(token, key, tf, positions): the character pairs of the lower-cased text, counted where the page is; nothing moves.

    ``tokens`` and ``beginnings`` keep only these pairs and those that begin
    with one of these characters.  Null and short texts have none.
    """
    wanted = None if tokens is None and beginnings is None else [ord(t[0]) << 21 | ord(t[1]) for t in tokens or []]
    first = [ord(c) for c in beginnings or []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            texts = [t or "" for t in batch.column("low").to_pylist()]
            for a, b in _slices(texts):
                doc, pair, tf, data, offsets = _pairs(texts[a:b], wanted, first)
                kinds, at = np.unique(pair, return_inverse=True)
                names = pa.array([_token(int(p)) for p in kinds], pa.string())
                columns = [names.take(pa.array(at)), batch.column("key").take(pa.array(doc + a)), pa.array(tf, pa.int64())]
                if positions:
                    columns.append(pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(data)]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["token", key, "tf", "positions"][: len(columns)])

    rows = docs.select(F.col(key).alias("key"), F.lower(body).alias("low"))
    return rows.mapInArrow(run, f"token string, `{key}` {dict(rows.dtypes)['key']}, tf long" + (", positions binary" if positions else ""))


def grams(text: str) -> list[str]:
    low = text.lower()
    return [low[k : k + 2] for k in range(len(low) - 1)]


def needed(tree: object) -> tuple[list[str], list[str]]:
    """The tokens that a tree asks for, and the characters whose pairs it asks for."""
    found = G.leaves(tree)
    tokens = sorted({g for x in found if isinstance(x, G.Word | G.Phrase) for g in grams(x.text)})
    return tokens, sorted({x.text.lower() for x in found if isinstance(x, G.Beginning)})


def own_tokens(post: DataFrame, tree: object) -> DataFrame:
    """The postings a tree needs: a filter that reaches the scan."""
    tokens, beginnings = needed(tree)
    keep = F.col("token").isin(*tokens) if tokens else F.lit(False)
    for c in beginnings:
        keep = keep | F.col("token").startswith(c)
    return post.where(keep)


def _frequencies(found: list):
    """How often each leaf is on a page, from the page's postings."""
    wanted = [(type(x), grams(x.text) if not isinstance(x, G.Beginning) else [x.text.lower()]) for x in found]
    kept = {g for kind, own in wanted if kind is G.Phrase for g in own}

    def in_row(own: list[str], at: dict) -> int:
        """Places at which all pairs follow each other; the rarest pair's places are thinned out by the others'."""
        import numpy as np

        order = sorted(range(len(own)), key=lambda k: at[own[k]][0])
        left = None
        for k in order:
            here = places(at[own[k]][1]) - k
            left = here if left is None else left[np.isin(left, here, assume_unique=True)]
            if not len(left):
                return 0
        return len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("own").to_pylist():
                at = {r["token"]: (r["tf"], r["positions"] if r["token"] in kept else None) for r in row}
                tfs = []
                for kind, own in wanted:
                    if kind is G.Beginning:
                        tfs.append(sum(tf for t, (tf, _) in at.items() if t.startswith(own[0])))
                    elif not own or any(g not in at for g in own):
                        tfs.append(0)
                    elif kind is G.Word:
                        tfs.append(min(at[g][0] for g in own))
                    else:
                        tfs.append(in_row(own, at))
                out.append(tfs)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int64()))], ["key", "tfs"])

    return run


def _field_hit(x: object) -> Column:
    return F.coalesce(_field_test(x), F.lit(False))


def _field_test(x: object) -> Column:
    """Null where the field is; as a condition for rows, it reaches the scan."""
    c = F.col(x.field)
    if isinstance(x, G.Exact):
        hit = c == x.value
    elif isinstance(x, G.Starts):
        hit = c.startswith(x.value)
    elif isinstance(x, G.OneOf):
        hit = c.isin(*x.values) if x.values else F.lit(False)
    else:
        hit = c.isNotNull()
        if x.low is not None:
            hit = hit & (c >= x.low if x.with_low else c > x.low)
        if x.high is not None:
            hit = hit & (c <= x.high if x.with_high else c < x.high)
    return hit


def _at_all(tree: object, text: bool) -> bool:
    """Whether a page without any of the tree's pairs can match it."""
    if isinstance(tree, G.Boost):
        return _at_all(tree.node, text)
    if isinstance(tree, G.Clauses):
        return all(_at_all(x, text) for x in tree.must) if tree.must else any(_at_all(x, text) for x in tree.should)
    return not isinstance(tree, G.Word | G.Phrase | G.Beginning)


def _only_fields(tree: object) -> Column | None:
    """A condition on exact fields that every hit fulfils, if there is one: it prunes the scan of pages."""
    if isinstance(tree, G.Boost):
        return _only_fields(tree.node)
    if isinstance(tree, G.Exact | G.Starts | G.OneOf | G.Range):
        return _field_test(tree)
    if isinstance(tree, G.Clauses):
        own = [c for c in map(_only_fields, tree.must) if c is not None]
        if not tree.must and len(tree.should) and all(_only_fields(x) is not None for x in tree.should):
            own = [_any([_only_fields(x) for x in tree.should])]
        return None if not own else _all(own)
    return None


def _any(parts: list[Column]) -> Column:
    return functools.reduce(Column.__or__, parts) if parts else F.lit(False)


def _all(parts: list[Column]) -> Column:
    return functools.reduce(Column.__and__, parts) if parts else F.lit(True)


def statistics(post: DataFrame, pages: DataFrame, tree: object, counted: DataFrame | None = None) -> DataFrame:
    """One row: n, average and, of each pair and exact leaf, the pages that hold it.

    ``counted`` (token, df) is what an index keeps of its tokens; without it
    the postings are counted.
    """
    found = G.leaves(tree)
    exact = [x for x in found if isinstance(x, G.Exact)]
    corpus = pages.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"), *[F.count_if(_field_hit(x)).alias(f"e{k}") for k, x in enumerate(exact)])
    tokens, _ = needed(tree)
    if not tokens:
        return corpus
    dfs = (counted.where(F.col("token").isin(*tokens)) if counted is not None else own_tokens(post, tree).where(F.col("token").isin(*tokens)).groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    held = dfs.agg(*[F.coalesce(F.max(F.when(F.col("token") == t, F.col("df"))), F.lit(0)).alias(f"d{k}") for k, t in enumerate(tokens)])
    return corpus.crossJoin(held)  # two single rows


def rank(post: DataFrame, pages: DataFrame, tree: object, key: str = "page_id", counted: DataFrame | None = None) -> DataFrame:
    """(key, score) of every page that a tree matches.

    ``pages`` has the key, the length in pairs and the exact fields that the
    query names.  Words count as :func:`foliograph.operators.search.rank` says;
    a phrase counts its occurrences, overlapping ones too, and weighs as its
    pairs together; an exact value weighs by its rarity; beginnings, ranges,
    sets and ``*`` weigh 1.
    """
    found = G.leaves(tree)
    text = [x for x in found if isinstance(x, G.Word | G.Phrase | G.Beginning)]
    tokens, _ = needed(tree)
    exact = [x for x in found if isinstance(x, G.Exact)]
    stats = statistics(post, pages, tree, counted)
    limit = _only_fields(tree)
    base = pages if limit is None else pages.where(limit)
    if text:
        own = own_tokens(post, tree).groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("token", "tf", "positions")).alias("own"))
        per = own.mapInArrow(_frequencies(text), f"key {dict(post.dtypes)[key]}, tfs array<long>")
        base = base.join(per, base[key] == per["key"], "left" if _at_all(tree, True) else "inner")
    rows = base.crossJoin(F.broadcast(stats))  # one row
    rarity = lambda df: F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / F.greatest(F.col("average"), F.lit(1e-9)))
    hits, scores = {}, {}
    for k, x in enumerate(text):
        tf = F.coalesce(F.get("tfs", F.lit(k)), F.lit(0))
        weight = F.lit(0.0)
        for g in grams(x.text):
            weight = weight + rarity(F.col(f"d{tokens.index(g)}"))
        hits[x] = tf > 0
        scores[x] = F.lit(1.0) if isinstance(x, G.Beginning) else weight * tf * (K1 + 1) / (tf + norm)
    for x in found:
        if isinstance(x, G.Every):
            hits[x], scores[x] = F.lit(True), F.lit(1.0)
        elif x not in hits:
            hits[x] = _field_hit(x)
            scores[x] = rarity(F.col(f"e{exact.index(x)}")) if isinstance(x, G.Exact) else F.lit(1.0)

    def both(node: object) -> tuple[Column, Column]:
        """Whether a page matches, and its score if it does (0 if not)."""
        if isinstance(node, G.Boost):
            hit, score = both(node.node)
            return hit, score * node.by
        if not isinstance(node, G.Clauses):
            return hits[node], F.when(hits[node], scores[node]).otherwise(0.0)
        must, should, never = ([both(x) for x in part] for part in (node.must, node.should, node.never))
        hit = _all([h for h, _ in must]) if must else _any([h for h, _ in should])
        hit = hit & ~_any([h for h, _ in never])
        total = F.lit(0.0)
        for _, score in (*must, *should):
            total = total + score
        return hit, F.when(hit, total).otherwise(0.0)

    hit, score = both(tree)
    return rows.where(hit).select(key, F.round(score, 6).alias("score"))
