"""Fill-in-the-middle, SentencePiece and the prefix trie on awkward rows, against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from foliograph.llm import fim, pieces, registry, trie, vocab

DOCS = "text string, doc_id long, form string, n long, marked string"
TURNS = "conv_id long, turn long, role string, text string, key string, words long"
NASTY = "a\x1eb\x1bc\x1bab \x1e\x1e中𝒳 <P x>$0\\ end\n\x1b"
SMALL = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def texts():
    rows = [(NASTY * (k % 5) + "Word one, two. " * (k % 7), k, "x", 1, "m") for k in range(150)]
    rows += [(None, 200, None, None, None), ("", 201, None, None, None), ("no id", None, "x", 1, "m"), (None, None, None, None, None), ("hold <S> it", 202, "x", 1, "m"), (" \n\t ", 203, "x", 1, "m")]
    return rows + [("x" * 60_000 + "1 " * 5_000, 204, "x", 1, "m"), *rows[3:5], ("other text, same id", 3, "x", 1, "m")]


def cut_by_hand(text, doc_id):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, h = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, sha(text)
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", sha(text)
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", sha(text)


def test_fill_in_middle(spark):
    rows = texts()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = sorted((cut_by_hand(r[0], r[1]) for r in rows), key=str)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, sha(r.text)) for r in fim.transform(df).collect()), key=str) == want
    assert sorted((tuple(r) for r in fim.digests(df).collect()), key=str) == sorted(((*w[:5], sha(w[5]), w[6]) for w in want), key=str)
    assert fim.digests(df.limit(0)).count() == 0
    assert {r.form for r in fim.transform(df, plain_share=0, spm_share=100).where("n > 0 AND doc_id <> 202").collect()} == {"spm"}
    assert {r.form for r in fim.transform(df, plain_share=100).collect()} == {"plain"}


def test_fill_in_middle_is_one_projection(spark):
    plan = fim.digests(spark.createDataFrame(texts(), DOCS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "Exchange" not in plan and "Python" not in plan


def test_sentencepiece(spark):
    rows = texts()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    sp = pieces.library(vocab.vocabulary_path("piece_bpe_32k.model"))
    want = []
    for text, doc_id, *_ in rows:
        ids = sp.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else "")))
    assert sorted((tuple(r) for r in pieces.encode(df).collect()), key=str) == sorted(want, key=str)
    shown = pieces.encode(df, with_ids=True, check=False).where("doc_id = 6").first()
    assert shown.ids == sp.encode(rows[6][0]) and shown.decoded == sp.decode(shown.ids)
    assert pieces.encode(df.limit(0)).count() == 0


def test_agenda_against_library():
    path = vocab.vocabulary_path("piece_bpe_32k.model")
    own, sp, r = pieces.Merger(path), pieces.library(path), random.Random(1)
    signs = [*"abcdefghiettaao   \n\t\r.,;'0123é中文字▁▁\x00\x1b𝒳😀　\xa0ﬁ�", "the", "ing", "    ", "<s>", "</s>", "<unk>", "<0x0A>", " th"]
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 60)))
        assert own.encode(text) == sp.encode(text), text
    for text in (" " * 5000, "ab" * 10_000, " a" * 1000, "▁" * 99, "\n" * 1000):
        assert own.encode(text) == sp.encode(text)
    kept, pieces.MOST_KEPT = pieces.MOST_KEPT, 3  # what is forgotten is encoded again
    try:
        assert own.encode("one two three one four two five") == sp.encode("one two three one four two five")
    finally:
        pieces.MOST_KEPT = kept


def test_a_difference_is_an_error(spark):
    class Wrong(pieces.Merger):
        def ids(self, part):
            return [5]

    path, batch = vocab.vocabulary_path("piece_bpe_32k.model"), spark.createDataFrame([("some text", 1)], "text string, doc_id long")
    wrong = Wrong(path)
    with pytest.raises(ValueError, match="doc_id 1"):
        list(pieces.encoded_batches(batch.select("doc_id", "text").toArrow().to_batches(), wrong, pieces.library(path)))


def by_hand(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append((t is not None, t or 0, r, sha(f"{len(r)}:{r}:{x}"), x))
    by = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in by.items()}
    made = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(by.get(c - int(abs(c) % 20 * (1 if c >= 0 else -1)), [])[:h] + own[h:])
    nodes, kids = {}, {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        own = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in own) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in own)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(made[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(own), leaves[p], saved[p], sha(ends)))
    return sorted(out, key=str)


def turns():
    r = random.Random(3)
    rows = [(c, t, r.choice("ua"), r.choice(["a b", "c", "", "d e f"]), "k", 1) for c in range(-30, 120) for t in range(r.choice([1, 1, 2, 3, 4, 8, 12]))]
    rows += [(None, 1, "u", "x", "k", 1), (500, None, None, None, None, None), (500, None, "u", "q", "k", 1), (500, 0, "u", "q", "k", 1), (500, 0, "u", "q", "k", 1)]
    rows += [(1000 + k, t, "u", "same words", "k", 1) for k in range(40) for t in range(5)]  # copies
    rows += [(2000 + k, t, "u", f"t{t}", "k", 1) for k in range(25) for t in range(k)]  # each goes on from the one before
    rows += [(3000 + k, t, "u", f"t{t}", "k", 1) for k in range(2) for t in range(200 - 9 * k)]
    return rows


@pytest.mark.parametrize("block", [1, 7, 512])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "LEAST_BLOCK", block)
    rows = turns()
    got = trie.nodes(spark.createDataFrame(rows, TURNS).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "u", "x", "", 0)], [(1, 0, "u", "x", "", 0)], [(7, 0, "u", "x", "", 0), (8, 0, "u", "x", "", 0)], [(0, t, "u", str(t), "", 0) for t in range(3)]])
def test_trie_of_few(spark, rows):
    assert sorted((tuple(r) for r in trie.nodes(spark.createDataFrame(rows, TURNS)).collect()), key=str) == by_hand(rows)


def test_shared_turns():
    a = bytes(range(256)) * 16
    assert trie._shared(a, a[:160]) == 10 and trie._shared(b"", a) == 0
    for k in (0, 5, 200):
        assert trie._shared(a, a[: 16 * k + 3] + b"\xff" * 13 + a[16 * k + 16 :]) == k


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_conversation_trie"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.queries()[name](spark, SMALL)
    want = con.execute(registry.oracle_sql()[name])
    assert [c[0] for c in want.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)
