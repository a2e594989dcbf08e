"""The query grammar on positional postings, against brute force."""

import math
import random

import pytest

from foliograph.operators import grammar as G
from foliograph.operators import lifecycle, positions, search

R = random.Random(7)
LETTERS = ["a", "b", "aa", "ab", "ba", " ", " ", "É", "采", "购", "𝒳", "C"]
PAGES = "page_id string, document_id string, original_filename string, image_path string, page_number long, body string"


def pages(n=60):
    rows = [(f"p{k:02}", f"d{k % 7}", f"file-{k % 5}.pdf", None if k % 3 else f"pages/{k}.png", k, "".join(R.choice(LETTERS) for _ in range(R.randint(0, 40)))) for k in range(n)]
    return [*rows, ("px", None, None, None, None, None), ("py", "d1", "file-1.pdf", None, 1, "a"), ("pz", "d1", "file-1.pdf", None, 1, "采购合同 " * 30)]


@pytest.fixture(scope="module")
def rows():
    return pages()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    directory = str(tmp_path_factory.mktemp("index"))
    lifecycle.build(spark.createDataFrame(rows, PAGES).repartition(3), directory)
    return lifecycle.open_index(spark, directory)


def by_hand(rows, tree):
    low = {r[0]: (r[5] or "").lower() for r in rows}
    length = {p: max(len(t) - 1, 0) for p, t in low.items()}
    n, average = len(rows), sum(length.values()) / len(rows)
    field = {r[0]: dict(zip(("page_id", "document_id", "original_filename", "image_path"), r, strict=False)) for r in rows}
    rare = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    times = lambda t, g: sum(t.startswith(g, k) for k in range(len(t) - len(g) + 1))

    def both(x, p):
        t = low[p]
        if isinstance(x, G.Boost):
            hit, score = both(x.node, p)
            return hit, score * x.by
        if isinstance(x, G.Clauses):
            must, should, never = ([both(y, p) for y in part] for part in (x.must, x.should, x.never))
            hit = (all(h for h, _ in must) if must else any(h for h, _ in should)) and not any(h for h, _ in never)
            return hit, sum(s for h, s in must + should if h) if hit else 0.0
        if isinstance(x, G.Every):
            return True, 1.0
        if isinstance(x, G.Beginning):
            return x.text.lower() in t[:-1], 1.0
        if isinstance(x, G.Word | G.Phrase):
            own = positions.grams(x.text)
            tf = 0 if not own else min(times(t, g) for g in own) if isinstance(x, G.Word) else times(t, x.text.lower())
            norm = 1.2 * (0.25 + 0.75 * length[p] / average)
            return tf > 0, sum(rare(sum(g in u for u in low.values())) for g in own) * tf * 2.2 / (tf + norm)
        v = field[p][x.field]
        if isinstance(x, G.Exact):
            return v == x.value, rare(sum(f[x.field] == x.value for f in field.values()))
        if v is None:
            return False, 0.0
        if isinstance(x, G.Starts):
            return v.startswith(x.value), 1.0
        if isinstance(x, G.OneOf):
            return v in x.values, 1.0
        low_ok = x.low is None or v > x.low or (x.with_low and v == x.low)
        return low_ok and (x.high is None or v < x.high or (x.with_high and v == x.high)), 1.0

    return {p: round(s, 6) for p in low for h, s in [both(tree, p)] if h}


QUERIES = [
    "ab", "ab ba", '"ab a"', '"aa"', '"aaa"', '"采购合同"', "采购", "+ab -ba", "ab AND ba", "ab AND NOT ba", "(ab OR 采购) AND NOT (ba AND aa)", "ab^2.5 ba", "(ab ba)^0.5 É*", "a*", "*", "* -ab", "+* ab",
    "document_id:d1", "document_id:d1 ab", "+document_id:d1 ab", "original_filename:file-1*", "page_id:[p10 TO p20]", "page_id:{p10 TO *} AND ab", "page_id: IN [p01 p05 pz] -aa", '+"ab" +(document_id:d2 OR document_id:d3)',
    "É𝒳 OR C", "x", '"a"', "ab NOT ba", "NOT ba ab", "-(ab ba) aa", "(+ab +(ba aa)) OR 采", 'image_path:"pages/3.png"', "abab*", "ab AND ba OR aa",
]


@pytest.mark.parametrize("query", QUERIES)
def test_same_hits_and_scores(index, rows, query):
    got = {r.page_id: r.score for r in index.rank(G.parse(query)).collect()}
    want = by_hand(rows, G.parse(query))
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 2e-6 for p in want)


@pytest.mark.parametrize("query", ["", "-ab", "NOT ab", "(ab", "ab)", "ab AND", "OR ab", "ab OR", "AND ab", "nofield:x", "ab^", '"ab', "(-a) OR b", "[a TO b]", "body:[a TO b]", "a AND NOT", "document_id:"])
def test_refused(query):
    with pytest.raises(G.QueryInvalid):
        G.parse(query)


def test_tree():
    assert G.parse("a b AND c") == G.Clauses((), (G.Word("a"), G.Clauses((G.Word("b"), G.Word("c")), (), ())), ())
    assert G.parse(r"a\:b") == G.Word("a:b")
    assert G.parse("document_id:x^2") == G.Boost(G.Exact("document_id", "x"), 2.0)
    assert G.parse("a-b") == G.Word("a-b")


def test_packed_places():
    values = [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**32 - 1]
    data, size = positions.pack(values)
    assert positions.unpack(data).tolist() == values and size.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 5, 5]
    assert positions.unpack(b"").tolist() == [] and positions.pack([])[0] == b""


def test_places_of_many_postings():
    import pyarrow as pa

    lists = [[0], [3, 400, 70_000], [1, 2], [5]]
    data = pa.array([positions.pack([x[0], *(b - a for a, b in zip(x, x[1:], strict=False))])[0] for x in lists], pa.binary())
    flat, starts = positions.places_of(data.slice(1))
    assert flat.tolist() == [y for x in lists[1:] for y in x] and starts.tolist() == [0, 3, 5]
    assert positions.places_of(data.slice(0, 0))[0].tolist() == []


def test_postings(spark, rows):
    df = spark.createDataFrame(rows, PAGES)
    want = {}
    for r in rows:
        low = (r[5] or "").lower()
        for k in range(len(low) - 1):
            want.setdefault((low[k : k + 2], r[0]), []).append(k)
    got = {(r.token, r.page_id): (r.tf, positions.places(bytes(r.positions)).tolist()) for r in positions.postings(df).collect()}
    assert got == {k: (len(v), v) for k, v in want.items()}
    some = {(r.token, r.page_id) for r in positions.postings(df, tokens=["ab", "采购"], beginnings=["é"]).collect()}
    assert some == {k for k in want if k[0] in ("ab", "采购") or k[0][0] == "é"}
    assert positions.postings(df.limit(0)).count() == 0
    kept, positions.SLICE_CHARS = positions.SLICE_CHARS, 1
    try:
        assert len(list(positions._slices(["a", "", "bcd", "e"]))) == 3
    finally:
        positions.SLICE_CHARS = kept


def test_scans_are_pruned(index):
    plan = index.rank(G.parse("ab AND page_id:p01"))._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [ab])" in plan or "EqualTo(token,ab)" in plan
    assert "EqualTo(page_id,p01)" in plan


def test_texts_without_an_index(spark, rows):
    df = spark.createDataFrame(rows, PAGES)
    for text in ("ab ba", "+ab -ba", "aa", "采购"):
        got = {r.page_id: r.score for r in search.rank_texts(df, search.parse(text)).collect()}
        want = by_hand(rows, G.parse(text))
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)
