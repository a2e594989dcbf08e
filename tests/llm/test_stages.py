"""Stages and operators on repeated ids, null ids, names that clash, empty tables, hot groups and clashing keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliograph.llm import bpe, exact_dedup, mixing, near_dup, tokenfile, toxicity
from foliograph.llm.common import join_counted, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long, _id long, _digest string, _row string, _text string, _place string, key string, component long, k long"
R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]


def text(n=60):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def near(t):
    w = t.split()
    w[len(w) // 2] = "changed"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    a, b, c, d = text(), text(), text(), text()
    plain = [(1, a), (1, a), (1, a.upper()), (2, near(a)), (7, near(b)), (7, c), (8, b), (None, near(d)), (None, d), (None, None), (None, ""), (9, None), (10, "two words"), (11, "two words"), (12, text(3000)), (13, "x"), (13, "x")]
    return [(i, t, "en", f"s{k % 3}" if k % 5 else None, 0, 9, 9, "g", "r", "t", "p", "k", 1, 1) for k, (i, t) in enumerate(plain)]


@pytest.fixture(scope="module", params=["files", "computed"])
def docs(request, spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if request.param == "computed":
        return df
    path = str(tmp_path_factory.mktemp("stage") / "documents.parquet")
    df.write.parquet(path)
    return spark.read.parquet(path)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_keep_one(docs, rows):
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    best = {}
    for r in rows:
        best[low(r[1])] = max(best.get(low(r[1]), -1), -1 if r[0] is None else r[0])
    assert Counter((low(r.text), -1 if r.doc_id is None else r.doc_id) for r in got.collect()) == Counter(best.items())
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0


def test_exact_with_clashing_digests(docs, rows):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    groups = {}
    for r in rows:
        groups.setdefault(low(r[1]), []).append(r[0])
    want = Counter()
    for ids in groups.values():
        top = max((i for i in ids if i is not None), default=None)
        want.update((i, top, len(ids), k == ids.index(top)) for k, i in enumerate(ids))
    got = exact_dedup.deduplicate(docs, digest=weak).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_exact_state_goes_on(spark, tmp_path):
    home, a, b = str(tmp_path / "home"), text(), text()
    first = spark.createDataFrame([(1, a), (2, b), (3, None)], "doc_id long, text string")
    second = spark.createDataFrame([(4, a.upper()), (0, b), (5, text()), (None, "")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.extend(first, home).collect()} == {(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True)}
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.extend(second, home).collect()}
    assert got == {(4, 4, 2, True), (0, 2, 2, False), (5, 5, 1, True), (None, 3, 2, False)}


def test_near_keep_one(docs, rows):
    got = near_dup.keep_one(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    sets = []
    for r in rows:
        w = near_dup.normal(r[1]).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    alike = lambda x, y: x is not None and y is not None and len(x & y) >= 0.8 * len(x | y)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = {}
    for k, g in enumerate(group):
        i = rows[k][0]
        want[g] = min(want.get(g, 10**9), 10**9 if i is None else i)
    assert sorted(10**9 if i is None else i for i, _ in kept.elements()) == sorted(want.values())
    assert near_dup.keep_one(docs.limit(0)).count() == 0


def test_near_with_clashing_keys(docs):
    plain = Counter(map(tuple, near_dup.join(docs).drop("kept").collect()))
    assert Counter(map(tuple, near_dup.join(docs, bits=2).drop("kept").collect())) == plain
    assert near_dup.join(docs).where("kept").count() == near_dup.keep_one(docs).count()


def test_near_prefixes_are_shortened(spark):
    base = [text(200) for _ in range(12)]
    rows = []
    for t in base:
        for _ in range(3):  # similarity a little above the threshold
            w = t.split()
            for at in R.sample(range(len(w)), 3):
                w[at] = R.choice(VOCABULARY)
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many, none = {}, {}, {}
    got = near_dup.verdicts(near_dup.located(df, False, _id=F.col("doc_id"), _text=F.col("text")), trees=6, report=few)
    near_dup.verdicts(near_dup.located(df, False, _id=F.col("doc_id"), _text=F.col("text")), report=many)
    assert few["depth"] < many["depth"] <= near_dup.DEPTH and few["recall"] >= near_dup.TARGET_RECALL
    assert got.where("kept").count() < len(rows)
    # no link found: the depth is the first that promises the target at the threshold
    near_dup.verdicts(near_dup.located(df.where("doc_id % 3 = 0"), False, _id=F.col("doc_id"), _text=F.col("text")), report=none)
    assert near_dup.expected_recall(0.8, none["depth"]) >= near_dup.TARGET_RECALL > near_dup.expected_recall(0.8, none["depth"] + 1)


def test_near_chain_of_common_passages_is_no_group(spark):
    """Texts that share a passage, but not enough of it, meet in trie nodes and stay apart."""
    common = text(40)
    rows = [(k, common + " " + text(30)) for k in range(300)]
    got = near_dup.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 300 and got.agg(F.sum("n_links")).first()[0] == 0


def test_take_as_often_as_mix_says(docs, rows):
    said, taken = mixing.mix(docs), mixing.take(docs)
    assert taken.columns == docs.columns
    say = Counter()
    for r in said.collect():
        say[(r.doc_id, r.source)] += r.copies
    assert Counter((r.doc_id, r.source) for r in taken.collect()) == +say
    assert Counter(map(str, mixing.take(docs).collect())) == Counter(map(str, taken.collect()))
    assert mixing.take(docs.limit(0)).count() == 0


def test_mix_of_rows_that_repeat(spark):
    """Each of many equal rows has its own draw, so the target is met; inclusions add up to what is drawn."""
    rows = [(None, "one two three", "a", k) for k in range(3000)] + [(k, text(R.randint(1, 400)), "b", k) for k in range(800)] + [(k, "w " * 20, "c", k) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    for source, target, taken, largest in mixing.mix(df).groupBy("source").agg(F.first("target"), F.sum("taken"), F.max("size")).collect():
        assert abs(taken - target) <= largest, source
    units, cuts = mixing.decide(df)
    sizes = mixing._sizes(df, "text", "source", "doc_id").withColumn("k", F.lit(0).cast("long")).drop("source").join(cuts.drop("source"), "key")
    drawn = mixing._drawn(sizes, "s").groupBy("key").agg(F.sum(F.col("size") * F.col("part")).alias("drawn"), F.first("rest").alias("rest"))
    for r in drawn.collect():
        assert r.drawn == pytest.approx(r.rest, rel=1e-3, abs=1)
    taken = Counter(mixing.take(df).groupBy("source", "doc_id").count().where("source = 'a'").select("count").first())
    assert taken == Counter([mixing.mix(df).where("source = 'a'").agg(F.sum("copies")).first()[0]])


def test_encoders_bear_any_columns(docs, rows):
    assert bpe.encode(docs).count() == tokenfile.write_and_read(docs).count() == len(rows)
    odd = docs.withColumn("row_id", F.lit("x")).withColumn("block", F.lit(1)).withColumn("h", F.lit(1)).withColumn("nil", F.lit(1))
    assert bpe.encode(odd).count() == tokenfile.write_and_read(odd).count() == len(rows)


def test_ids_at_the_ends_of_the_range(spark):
    least, most = -(2**63), 2**63 - 1
    df = spark.createDataFrame([(least, "a b"), (None, "c"), (most, "d")], "doc_id long, text string").coalesce(1)
    want = {least, None, most}
    assert {r.doc_id for r in bpe.encode(df).collect()} == {r.doc_id for r in tokenfile.write_and_read(df).collect()} == {r.doc_id for r in near_dup.join(df).collect()} == want


def test_keep_clean(docs, rows):
    model = toxicity.Model({"changed": 1.0}, [9.0] * len(toxicity.FEATURES), -4.0, 0.1)
    got = toxicity.keep_clean(docs, model)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], r[1]) for r in rows if "changed" not in (r[1] or ""))
    assert toxicity.keep_clean(docs.limit(0), model).count() == 0


def test_hot_keys_are_broadcast(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    small = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_counted(df, small, ["k"], "n", 1000)
    assert got.count() == 1000 and got.where("k = 1 AND n = 700").count() == 700


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class None_:
                            @staticmethod
                            def isDefined():
                                return False

                        return None_

                return S

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, other=None):
                return other

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
