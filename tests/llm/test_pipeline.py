"""The pipeline's stages against brute force over their own inputs."""

import hashlib

import corpus_pipeline
from foliograph.llm import near_dup
from foliograph.llm.common import cut, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, DIR), "test")
        before, rows = docs.collect(), after.collect()
        seen[name] = (before, rows)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert after.columns == columns
        docs = after
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    before, rows = seen["exact dedup"]
    last = {}
    for r in before:
        last[low(r.text)] = max(last.get(low(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in rows) == sorted(last.values())
    before, rows = seen["n-gram Jaccard join"]
    sets = {}
    for r in before:
        w = near_dup.normal(r.text).split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {r.doc_id}
    kept = {r.doc_id for r in rows}
    ids = sorted(sets)
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i in ids:
        others = [j for j in ids if j != i and alike(i, j)]
        assert (i in kept) or others
        assert not (i in kept and any(j in kept for j in others))
    before, rows = seen["mixing sources to target weights"]
    assert {r.doc_id for r in rows} <= {r.doc_id for r in before}
    before, rows = seen["byte-level BPE"]
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in before)
