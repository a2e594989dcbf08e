"""Byte-level BPE encoding and decoding with one encoding for each distinct word.

Texts are cut into pre-tokens.  A task gathers its documents into blocks; a
block holds its distinct words once and, for every document, the positions as
indices into them.  The words of all blocks are dealt out by their hash, packed
into parcels; a partition takes one parcel after the other, and a distinct word
is in one parcel only, so it is encoded once and a task remembers the words of
one parcel at a time; its ids go back to every block that holds it, and the block puts
its documents together by position.  Decoding looks the ids up in the token-byte table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import cut, held, lean
from foliograph.llm.vocab import piece_encoder, pieces, token_bytes, vocabulary_path

#: A block is closed at this many pre-tokens (a longer document is a block of its own).
BLOCK_TOKENS = 2_000_000

#: Ids after which a batch of results ends.
BATCH_IDS = 250_000

#: A block's words travel in so many parcels for each shuffle partition; a word's parcel is decided by its hash.
PARCELS = 2

#: Steps of a plan, by the names at the beginnings of its lines, after which rows might come in another order the second
#: time.  (A scan of files names its InMemoryFileIndex further on in its line.)
MOVING = re.compile(r"^[\s:+*()\d-]*\w*(Exchange|Python|MapIn|FlatMap|Sample|InMemory|Coalesce)", re.MULTILINE)

BLOCKS = "block long, row_ids array<long>, lens array<int>, places binary, parcels binary"
WORDS = "block long, parcel int, words binary"


def _pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(data)


def _unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _packed_strings(parts: list[bytes]) -> bytes:
    import numpy as np

    return _pack(np.array([len(parts)], "<u4").tobytes() + _planes(np.array([len(x) for x in parts], "<u4")) + b"".join(parts))


def _strings(data: bytes) -> list[bytes]:
    import numpy as np

    raw = _unpack(data)
    (n,) = np.frombuffer(raw, "<u4", 1).tolist()
    ends = np.cumsum(_unplaned(raw[4 : 4 + 4 * n])).tolist()
    body = raw[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if n else []


def _blocks(batches: Iterator[pa.RecordBatch], n_parcels: int, want_words: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of one partition: their positions, or their words in parcels."""
    import numpy as np

    held("bpe")
    seen: dict[str, int] = {}
    ids: list[int] = []
    lens: list[int] = []
    places = bytearray()  # positions are not needed where words are wanted
    total = 0

    def block() -> pa.RecordBatch:
        nonlocal seen
        mark = hashlib.blake2b(repr([i for i in ids if i is None]).encode() + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array(lens, "<i8").tobytes(), digest_size=8)
        check, n, parcel = 0, len(seen), np.empty(len(seen), "<u4")
        dealt: dict[int, list[bytes]] = {}
        for k, w in enumerate(seen):
            raw = w.encode()
            check = zlib.crc32(raw + b"\0", check)
            parcel[k] = p = zlib.crc32(raw) % n_parcels
            if want_words:
                dealt.setdefault(p, []).append(raw)
        seen = {}
        mark.update(np.array([n, check], "<i8").tobytes())
        key = int.from_bytes(mark.digest(), "little", signed=True)
        if not want_words:
            packed = _pack(_planes(np.frombuffer(places, "<u4")))
            values = ([key], [ids], [lens], [packed], [_pack(_planes(parcel))])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], ["block", "row_ids", "lens", "places", "parcels"])
        values = ([key] * len(dealt), list(dealt), [_packed_strings(x) for x in dealt.values()])
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["block", "parcel", "words"])

    for batch in batches:
        for doc_id, text in zip(batch.column("row_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            found = pieces(text) if text else []
            if total and total + len(found) > BLOCK_TOKENS:
                yield block()
                ids, lens, places, total = [], [], bytearray(), 0
            put = seen.setdefault
            ids.append(doc_id)
            lens.append(len(found))
            if want_words:
                for w in found:
                    put(w, 0)
            else:
                places += np.fromiter((put(w, len(seen)) for w in found), "<u4", len(found)).tobytes()
            total += len(found)
    if ids:
        yield block()


def _planes(a) -> bytes:
    """The bytes of 32-bit numbers by significance, which compresses better."""
    import numpy as np

    return np.ascontiguousarray(a.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _unplaned(b: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(b, "u1").reshape(4, -1).T).view("<u4").ravel()


def _encoded(path: str):
    """Encodes each distinct word of a partition once, whichever blocks hold it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        one = piece_encoder(path)
        known: dict[bytes, bytes] = {}
        now = None
        for batch in batches:
            out = []
            for parcel, packed in zip(batch.column("parcel").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if parcel != now:  # parcels come sorted, and share no words
                    now, known = parcel, {}
                words = _strings(packed)
                for w in words:
                    if w not in known:
                        known[w] = np.array(one(w.decode()), "<u4").tobytes()
                ids = [known[w] for w in words]
                flat = np.frombuffer(b"".join(ids), "<u4")
                out.append(_pack(np.array([len(ids)], "<u4").tobytes() + _planes(np.array([len(x) // 4 for x in ids], "<u4")) + _planes(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("parcel"), pa.array(out, pa.binary())], ["block", "parcel", "ids"])

    return encode


def _ids(data: bytes) -> tuple:
    """Numbers of ids of a parcel's words, and their ids one after the other."""
    import numpy as np

    raw = _unpack(data)
    (n,) = np.frombuffer(raw, "<u4", 1).tolist()
    return _unplaned(raw[4 : 4 + 4 * n]), _unplaned(raw[4 + 4 * n :])


def _assembled(path: str, full: bool):
    names = ["row_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if full else 4]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def assemble(blocks: pa.Table, words: pa.Table) -> pa.Table:
        import numpy as np

        held("bpe")
        table = token_bytes(path)
        differ = ValueError("a block and its words differ: the input's rows changed between two reads")
        if not blocks.num_rows:
            raise differ
        order = _unplaned(_unpack(blocks.column("parcels")[0].as_py()))
        parcels = {}
        for parcel, packed in zip(words.column("parcel").to_pylist(), words.column("ids"), strict=True):
            if parcel not in parcels:  # a block twice over (equal rows in two partitions) brings its words twice
                parcels[parcel] = _ids(packed.as_py())
        met, each = np.unique(order, return_counts=True)
        if met.tolist() != sorted(parcels) or [len(parcels[p][0]) for p in sorted(parcels)] != each.tolist():
            raise differ
        # a parcel has its words in the block's order, so the words sorted by parcel are its parcels in a row
        by = np.argsort(order, kind="stable")
        counts, starts = np.zeros(len(order), "i8"), np.zeros(len(order), "i8")
        none = np.zeros(0, "<u4")
        listed = np.concatenate([none, *(parcels[p][0] for p in sorted(parcels))]).astype("i8")
        flat = np.concatenate([none, *(parcels[p][1] for p in sorted(parcels))])
        parcels.clear()
        counts[by], starts[by] = listed, np.cumsum(listed) - listed
        del by, listed, order
        decimals, raw = [], []
        for at, n in zip(starts.tolist(), counts.tolist(), strict=True):
            ids = flat[at : at + n].tolist()
            decimals.append(",".join(map(str, ids)))
            raw.append(b"".join([table[i] for i in ids]))

        rows: list[tuple] = []
        own_ids: list = []
        made: list[pa.RecordBatch] = []
        held_ids = 0

        def close() -> None:
            nonlocal rows, own_ids, held_ids
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=False)]
            if full:
                ends = np.cumsum([0, *map(len, own_ids)]).astype("i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *own_ids]).astype("i4"))))
            made.append(pa.RecordBatch.from_arrays(columns, names))
            rows, own_ids, held_ids = [], [], 0

        for row_ids, lens, packed in zip(blocks.column("row_ids").to_pylist(), blocks.column("lens").to_pylist(), blocks.column("places"), strict=True):
            places = _unplaned(_unpack(packed.as_py()))
            at = 0
            for row_id, n in zip(row_ids, lens, strict=True):
                own = places[at : at + n]
                at += n
                each, sizes = own.tolist(), counts[own]
                size = int(sizes.sum())
                text = ",".join([decimals[k] for k in each])
                rows.append((row_id, size, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"".join([raw[k] for k in each])).hexdigest()))
                if full:
                    own_ids.append(flat[np.repeat(starts[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(size)])
                held_ids += size
                if held_ids >= BATCH_IDS:
                    close()
        if rows or not made:
            close()
        return pa.Table.from_batches(made)

    return assemble


def encode(df: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row for each row of ``df``: doc_id, n_tokens, ids_sha256,
    decoded_sha256 and, if asked for, the ids themselves (array<int>).  Null
    and empty texts have no tokens; a null doc_id stays null; repeated rows
    are encoded each for itself; other columns are not read; an empty table
    gives an empty result.

    The input is read twice, once for the words and once for the positions.
    What is not a plain scan of files, and might come in another order the
    second time, is written first; a difference is an error and never a wrong
    result.
    """
    path = vocabulary_path(vocabulary, folder)
    docs = df.select(F.col(doc_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    if MOVING.search(docs._jdf.queryExecution().executedPlan().toString()):
        docs = cut(docs, "bpe-input")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.mapInArrow(lean(lambda b: _blocks(b, PARCELS * n, False)), BLOCKS)
    words = docs.mapInArrow(lean(lambda b: _blocks(b, PARCELS * n, True)), WORDS)
    encoded = words.repartition(n, "parcel").sortWithinPartitions("parcel").mapInArrow(lean(_encoded(path)), "block long, parcel int, ids binary")
    schema = "row_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    back = whole.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_assembled(path, with_ids), schema)
    return back.select(F.col("row_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))
