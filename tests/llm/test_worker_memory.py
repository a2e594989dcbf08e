"""What a Python worker holds beside the JVM: during a block, and when its task is done."""

import os
import subprocess
import sys

import pyarrow as pa

from foliograph.llm import bpe, common, near_dup, toxicity

PROBE = """
import random, re, sys
import numpy, pyarrow as pa
from foliograph.llm import bpe, common

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

r = random.Random(1)
words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(150_000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([" ".join(r.choices(words, k=2_000)) for _ in range(500)])], ["row_id", "text"])
del words
common.give_back()
before = mb()
for _ in common.lean(lambda b: bpe._blocks(b, 24, True))(iter([batch])):
    pass
print(mb() - before)
"""


def test_memory_is_given_back():
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    done = subprocess.run([sys.executable, "-c", PROBE], env=env, capture_output=True, text=True, check=True, timeout=120)
    assert float(done.stdout) < 30  # the words alone are as much, and stayed before


def test_one_operator_at_a_time():
    toxicity.scorer_of({"idiot": 1.0})
    assert common.held("toxicity")
    near_dup.shingles(["a b c d e f"])
    assert set(common._held) == {"near-copies"}
    list(bpe._blocks(iter([]), 4, True))
    assert set(common._held) == {"bpe"}


def test_results_leave_in_batches(monkeypatch):
    path = bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken")
    texts = ["one two three", None, "", "four  héé 中文\n", "one one"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 2, None, 5], pa.int64()), pa.array(texts)], ["row_id", "text"])
    block = pa.Table.from_batches(bpe._blocks(iter([batch]), 4, False))
    words = pa.Table.from_batches(bpe._encoded(path)(bpe._blocks(iter([batch]), 4, True)))
    monkeypatch.setattr(bpe, "BATCH_IDS", 3)
    cut = bpe._assembled(path, True)(block, words)
    monkeypatch.setattr(bpe, "BATCH_IDS", 1_000_000)
    assert len(cut.to_batches()) > 1
    assert cut.to_pylist() == bpe._assembled(path, True)(block, words).to_pylist()
    one = bpe.piece_encoder(path)
    assert [r["ids"] for r in cut.to_pylist()] == [[i for w in bpe.pieces(t or "") for i in one(w)] for t in texts]
