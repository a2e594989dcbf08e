"""Token-id files: independent zstandard frames with a trailing seek table.

A shard is a sequence of zstandard frames, each of which holds whole documents
and can be decompressed on its own, then two skippable frames that any
zstandard reader passes over:

- the index: for every frame its first doc_id and the number of documents and
  of ids before it in the shard (three int64);
- the seek table (the public "seekable format"): for every frame compressed
  size, decompressed size and the low 32 bits of the xxh64 of its content,
  then the footer: number of frames, descriptor 0x80, 0x8F92EAB1.

A frame's content: uint32 number of documents, their int64 ids, a byte for each
that is 1 where the id is null, their uint32 numbers of ids, then all ids as
little-endian uint32.  Null ids come first; the index has the smallest long for
them.
"""

from __future__ import annotations

import bisect
import functools
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import new_path
from foliograph.llm.vocab import added_tokens, pieces, tokenizer, vocabulary_path, word_encoder

#: Fixed values of the zstandard formats.
SKIP_INDEX, SKIP_SEEK, SEEK_FOOT = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: A frame is closed at this many bytes of content (a longer document is a frame of its own).
FRAME_BYTES = 1 << 20
#: Stands for a null id beside its flag.
NULL = -(2**63)
#: Words whose ids a worker remembers at most in each of two generations.
REMEMBERED = 550_000


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes one shard under another name and moves it to its own when it is whole."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.frame_bytes = frame_bytes
        self.uri, self.zstd = uri, zstandard.ZstdCompressor(level=1)
        self.fs, self.path = _store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []
        self.n_docs = self.n_ids = 0
        self._new()

    def _new(self) -> None:
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian uint32."""
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._frame()
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.parts.append(ids)
        self.size += len(ids) + 12

    def _frame(self) -> None:
        import xxhash

        n = len(self.ids)
        plain = [NULL if i is None else i for i in self.ids]
        content = struct.pack(f"<I{n}q{n}B{n}I", n, *plain, *[i is None for i in self.ids], *self.counts) + b"".join(self.parts)
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.index.append((plain[0], self.n_docs, self.n_ids))
        self.n_docs += n
        self.n_ids += sum(self.counts)
        self._new()

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        if self.ids:
            self._frame()
        index = b"".join(struct.pack("<3q", *x) for x in self.index)
        table = b"".join(struct.pack("<3I", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOT)
        self.out.write(struct.pack("<2I", SKIP_INDEX, len(index)) + index + struct.pack("<2I", SKIP_SEEK, len(table)) + table)
        self.out.close()
        if self.fs.get_file_info(self.path).type.name != "NotFound":
            self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)
        return self.n_docs, self.n_ids


class ShardReader:
    """Reads a shard's seek table, and then only the frames that are asked for."""

    def __init__(self, uri: str):
        fs, path = _store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOT:
            raise ValueError(f"{uri} has no seek table")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.frames = list(struct.iter_unpack("<3I", table))
        end = size - 9 - 12 * n - 8 - 24 * n
        self.index = list(struct.iter_unpack("<3q", self._at(end, 24 * n)))
        self.starts, at = [], 0
        for packed, _, _ in self.frames:
            self.starts.append(at)
            at += packed

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, number of ids before it in the shard, its ids."""
        import xxhash
        import zstandard

        packed, full, check = self.frames[k]
        content = zstandard.ZstdDecompressor().decompress(self._at(self.starts[k], packed), max_output_size=full)
        if len(content) != full or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum differs")
        (n,) = struct.unpack_from("<I", content)
        ids, nil, counts = struct.unpack_from(f"<{n}q", content, 4), content[4 + 8 * n : 4 + 9 * n], struct.unpack_from(f"<{n}I", content, 4 + 9 * n)
        at, before = 4 + 13 * n, self.index[k][2]
        for doc_id, none, m in zip(ids, nil, counts, strict=True):
            yield None if none else doc_id, before, content[at : at + 4 * m]
            at += 4 * m
            before += m

    def documents(self, doc_ids: Iterable[int]) -> dict[int, bytes]:
        """The ids of these documents (the first of each); touches only the frames that may hold them."""
        firsts, wanted, found = [x[0] for x in self.index], set(doc_ids), {}
        spans = {k for d in wanted for k in range(max(0, bisect.bisect_left(firsts, d) - 1), bisect.bisect_right(firsts, d))}
        for k in sorted(spans):
            for doc_id, _, ids in self.frame(k):
                if doc_id in wanted:
                    found.setdefault(doc_id, ids)
        return found


class Words:
    """Ids of the words met lately: two generations of dictionaries, which outlive a task in its worker.

    A word that is in neither is encoded again; what is remembered only saves
    time.  A text that names an added token is left to the library as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.added, self.one, self.young, self.old = tokenizer(path), added_tokens(path), word_encoder(path), {}, {}

    def encode(self, text: str) -> bytes:
        if self.added is not None and self.added.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words = pieces(text)
        parts = list(map(self.young.get, words))
        if None in parts:
            new = [w for w in dict.fromkeys(w for w, x in zip(words, parts, strict=True) if x is None) if not self._back(w)]
            for w in new if self.one else []:
                ids = self.one(w)
                self.young[w] = struct.pack(f"<{len(ids)}I", *ids)
            for k in range(0, 0 if self.one else len(new), 10_000):
                some = new[k : k + 10_000]
                for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    self.young[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
            parts = list(map(self.young.get, words))
            if len(self.young) > REMEMBERED:
                self.young, self.old = {}, self.young
        return b"".join(parts)

    def _back(self, word: str) -> bool:
        ids = self.old.get(word)
        if ids is not None:
            self.young[word] = ids
        return ids is not None


@functools.cache
def _words(path: str) -> Words:
    return Words(path)


def _encoder(path: str, end: int):
    """Encodes one text and adds the end id."""
    words, end_bytes = _words(path), struct.pack("<I", end)
    return lambda text: words.encode(text) + end_bytes if text else end_bytes


def write(df: DataFrame, uri: str, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, end: int = 2, text: str = "text", doc_id: str = "doc_id", frame_bytes: int = FRAME_BYTES) -> list[tuple[str, int, int, int]]:
    """Encode every text, append the end id and write shards in ascending doc_id order.

    Returns one row a shard, in order: path, ids before it, documents, ids.
    Null and empty texts hold the end id only; null doc_ids come first; rows of
    one doc_id follow each other by a hash of their text, and may be in several
    shards.  Other columns are not read.  An empty table writes no shard.
    """
    path = vocabulary_path(vocabulary, folder)
    rows = df.select(F.col(doc_id).cast("long").alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, encode, to = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if to is None and batch.num_rows:
                encode, to = _encoder(path, end), ShardWriter(f"{uri}/shard-{k:06d}.zst", frame_bytes)
            for row_id, one in zip(batch.column("row_id").to_pylist(), batch.column("text"), strict=True):
                to.add(row_id, encode(one.as_py()))
        if to is not None:
            docs, ids = to.close()
            yield pa.RecordBatch.from_pylist([{"shard": k, "uri": to.uri, "docs": docs, "ids": ids}], schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    # by id, then by hash and number, so that the rows of one id are split like others
    dealt = rows.repartitionByRange(n, F.asc_nulls_first("row_id"), "h", "n").sortWithinPartitions(F.asc_nulls_first("row_id"), "h", "n")
    made = dealt.select("row_id", "text").mapInArrow(shard, "shard int, uri string, docs long, ids long")
    out, before = [], 0
    for r in sorted(made.collect()):  # one row a shard
        out.append((r["uri"], before, r["docs"], r["ids"]))
        before += r["ids"]
    return out


def read(spark, shards: list[tuple[str, int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], out)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, before in zip(batch["uri"], batch["before"], strict=True):
                reader = ShardReader(uri)
                for k in range(len(reader.frames)):
                    yield pd.DataFrame([(d, int(before) + at, len(ids) // 4, zlib.crc32(ids)) for d, at, ids in reader.frame(k)], columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    listed = spark.createDataFrame([(u, b) for u, b, _, _ in shards], "uri string, before long").repartition(len(shards))
    return listed.mapInPandas(rows, out)


def write_and_read(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to shards in the shared folder and return what they hold."""
    return read(df.sparkSession, write(df, new_path(df.sparkSession, "token-shards"), **options))


