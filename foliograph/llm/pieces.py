"""SentencePiece encoding and decoding of merge-type vocabularies.

Score-ordered agenda of adjacent symbol pairs: a text's characters are symbols
in a chain; every adjacent pair that forms a piece waits in an agenda, best
score first and leftmost among equals; the best is merged and its symbol's new
neighbours are put in; what no piece holds falls back to bytes.

Where two neighbouring characters stand side by side in no piece, no merge
crosses the border between them, so the parts between such borders are merged
each for itself.  A worker remembers the ids of the parts it has met, within a
fixed bound; the agenda runs once for each new one, and those of many short
parts run together: each round merges every part's best pair.  Each Arrow
batch's ids are compared with those of the sentencepiece library for the whole
texts, and the library decodes them; a difference is an error and never a wrong
result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import bound_batches
from foliograph.llm.vocab import vocabulary_path

#: The sign that stands for a space inside pieces (a fixed value of the format).
SPACE = "▁"
#: Parts longer than this are not remembered, and a worker remembers twice so many at most.
LONGEST_KEPT, MOST_KEPT = 64, 300_000
#: New parts of up to so many characters are merged side by side, so many at a time; fewer than FEW each for itself.
SHORT, TOGETHER, FEW = 32, 4096, 64
#: Stands in the agenda for a pair that forms no piece.
NEVER = np.iinfo(np.int32).max
#: Characters of texts that are held as ids at a time; a longer text is held alone.
SLICE_CHARS = 1_000_000


@functools.cache
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Parts:
    """Numbered parts and their ids, which lie one part after the other."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look(self, parts: list[str]) -> np.ndarray:
        """Numbers of ``parts``; -1 for what is not here."""
        return np.fromiter(map(self.numbers.get, parts, itertools.repeat(-1)), np.int64, len(parts))

    def add(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.numbers.update(zip(parts, itertools.count(len(self.numbers))))
        self.ids, self.ends = np.concatenate([self.ids, ids]), _ends(counts, self.ends)


def _ends(counts: np.ndarray, before=np.zeros(1, np.int64)) -> np.ndarray:  # noqa: B008
    return np.concatenate([before, before[-1] + np.cumsum(counts, dtype=np.int64)])


def _taken(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the parts numbered ``which``, one after the other, and how many each has."""
    starts = ends[which]
    counts = ends[which + 1] - starts
    own = _ends(counts)
    return ids[np.arange(own[-1]) + np.repeat(starts - own[:-1], counts)], counts


class Vocabulary:
    """A vocabulary as the agenda needs it."""

    def __init__(self, path: str):
        sp = library(path)
        size = sp.get_piece_size()
        kinds = [(sp.is_unknown(i), sp.is_control(i), sp.is_byte(i)) for i in range(size)]
        self.pieces = {sp.id_to_piece(i): i for i in range(size) if not any(kinds[i])}
        #: the agenda's order: the best score comes first
        self.costs = {p: -sp.get_score(i) for p, i in self.pieces.items()}
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if kinds[i][2]}
        if any(sp.is_unused(i) for i in range(size)) or sp.normalize("a  ﬁ  ") != f"{SPACE}a {SPACE}ﬁ{SPACE * 2}":
            raise ValueError("vocabularies with unused pieces or a normaliser of their own are not understood")
        self.decimals = pa.array([str(i) for i in range(size)], pa.large_string())
        self._number(size)

    def _number(self, size: int) -> None:
        """The same vocabulary as arrays; symbols are numbers there: ids of pieces, and from ``size`` on other characters."""
        numbers = dict(self.pieces)
        for char in sorted(set("".join(self.pieces))):
            numbers.setdefault(char, size + len(numbers) - len(self.pieces))
        self.size, self.none = size, size + len(numbers) - len(self.pieces)  # none: no symbol, it pairs with nothing
        places = np.unique(list(self.costs.values()), return_inverse=True)[1].tolist()
        rank = dict(zip(self.costs, places, strict=True))  # equal costs share their rank
        pairs = {}
        for piece, made in self.pieces.items():
            for k in range(1, len(piece)):
                first, second = numbers.get(piece[:k]), numbers.get(piece[k:])
                if first is not None and second is not None:
                    pairs[first * (self.none + 1) + second] = made, rank[piece]
        end = (self.none + 1) ** 2  # above every pair
        self.pairs = np.array([*sorted(pairs), end])
        self.made, self.ranks = np.array([*(pairs[p] for p in sorted(pairs)), (self.none, NEVER)], np.int32).T.copy()
        # characters that stand side by side in a piece; those in no such place are all one, the last
        sides = {two for piece in self.pieces for two in zip(piece, piece[1:])}
        chars = sorted({c for two in sides for c in two})
        order = {c: k for k, c in enumerate(chars)}
        width = len(chars) + 1
        tied = np.zeros((width, width), bool)
        for first, second in sides:
            tied[order[first], order[second]] = True
        rows, before = np.unique(tied, axis=0, return_inverse=True)
        table, after = np.unique(rows, axis=1, return_inverse=True)
        self.tied, self.columns = table.ravel(), table.shape[1]
        last = max(map(ord, [*chars, " "])) + 1
        self.before, self.after = np.full(last + 1, before.ravel()[-1] * self.columns, np.int32), np.full(last + 1, after.ravel()[-1], np.int32)
        self.symbols = np.full(last + 1, self.none, np.int32)
        for char, k in order.items():
            self.before[ord(char)], self.after[ord(char)] = before.ravel()[k] * self.columns, after.ravel()[k]
            self.symbols[ord(char)] = numbers[char]
        for table in (self.before, self.after, self.symbols):  # a text's spaces stand for the sign
            table[ord(" ")] = table[min(ord(SPACE), last)]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Merger:
    """Encodes by a vocabulary, and remembers parts."""

    def __init__(self, path: str):
        vars(self).update(vars(vocabulary(path)))
        #: ids of parts, in two generations: what is met again is kept
        self.known, self.older = Parts(), Parts()

    def merged(self, part: str) -> list[str]:
        """The symbols that are left of ``part``, merged in the order of their pairs' scores."""
        symbols: list = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        costs, push, pop = self.costs, heapq.heappush, heapq.heappop
        agenda = [(costs[x], k, k + 1, x) for k, x in enumerate(map("".join, zip(symbols, symbols[1:]))) if x in costs]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = pop(agenda)
            first, second = symbols[left], symbols[right]
            if not first or not second or len(first) + len(second) != len(piece):
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = piece, ""
            behind, ahead = before[left], after[right]
            after[left] = ahead
            if ahead >= 0:
                before[ahead] = left
                made = piece + symbols[ahead]
                if made in costs:
                    push(agenda, (costs[made], left, ahead, made))
            if behind >= 0:
                made = symbols[behind] + piece
                if made in costs:
                    push(agenda, (costs[made], behind, left, made))
        return [s for s in symbols if s]

    def _paired(self, first: np.ndarray, second: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What adjacent symbols would make, and their entries in the agenda: smaller is better, and further left among equals."""
        wanted = first.astype(np.int64) * (self.none + 1) + second
        k = np.searchsorted(self.pairs, wanted)
        k[self.pairs[k] != wanted] = -1
        rank = self.ranks[k]
        return self.made[k], np.where(rank == NEVER, NEVER, rank * (SHORT + 1) + place)

    def _side_by_side(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short parts of two and more characters, and their counts: each round merges the best pair of every part.

        Column k holds part k, row p what begins at its place p; the last row is
        no symbol, for whoever looks beyond either end (before row 0 is row -1).
        """
        n, longest = len(parts), len(max(parts, key=len))
        points = np.frombuffer("".join([p.ljust(longest + 1) for p in parts]).encode("utf-32-le"), np.uint32).reshape(n, -1).T
        place = np.arange(longest + 1, dtype=np.int32)[:, None]
        length = np.fromiter(map(len, parts), np.int32, n)
        symbols = np.where(place < length, self.symbols[np.minimum(points, self.symbols.size - 1)], self.none)
        made, agenda = np.full_like(symbols, self.none), np.full_like(symbols, NEVER)
        made[:-1], agenda[:-1] = self._paired(symbols[:-1], symbols[1:], place[:-1])
        before, after = (np.repeat(place + k, n, axis=1).ravel() for k in (-1, 1))
        flat, made, waiting = symbols.ravel(), made.ravel(), agenda.ravel()
        while True:
            best = agenda.min(axis=0)
            column = np.flatnonzero(best != NEVER)
            if not column.size:
                break
            left = best[column] % (SHORT + 1)
            here = left * n + column
            right = after[here]
            gone = right * n + column
            ahead, behind = after[gone], before[here]
            piece = flat[here] = made[here]
            flat[gone], waiting[gone], after[here] = self.none, NEVER, ahead
            then = ahead * n + column
            before[then] = left
            made[here], waiting[here] = self._paired(piece, flat[then], left)
            then = behind * n + column
            made[then], waiting[then] = self._paired(flat[then], piece, behind)
        rows = symbols.T
        kept = rows != self.none
        ids, counts = rows[kept], kept.sum(axis=1)
        odd = np.flatnonzero(((rows >= self.size) & kept).any(axis=1))  # these hold characters that are no pieces
        if odd.size:
            by_part = np.split(ids, np.cumsum(counts)[:-1])
            for k in odd.tolist():
                by_part[k] = np.array(self.ids(parts[k]), np.int32)
            ids, counts = np.concatenate(by_part), np.array([len(x) for x in by_part])
        return ids, counts

    def ids(self, part: str) -> list[int]:
        symbols = self.merged(part.replace(" ", SPACE))
        out = list(map(self.pieces.get, symbols))
        if None not in out:
            return out
        out = []
        for symbol in symbols:
            own = self.pieces.get(symbol)
            if own is not None:
                out.append(own)
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # a run of unknown symbols is one
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin and end; new parts of any are merged together."""
        whole = "".join([" " + t if t else "" for t in texts])
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        at = _ends(np.array([len(t) + 1 if t else 0 for t in texts]))
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.minimum(points, self.symbols.size - 1)
        border = np.ones(len(whole) + 1, bool)
        border[1:-1] = ~self.tied[self.before[points[:-1]] + self.after[points[1:]]]
        border[at] = True
        borders = np.flatnonzero(border)
        parts = [whole[a:b] for a, b in itertools.pairwise(borders.tolist())]
        ids, ends, found = self.known.ids, self.known.ends, self.known.look(parts)
        missing = np.flatnonzero(found < 0)
        if missing.size:
            new: dict[str, int] = {}
            found[missing] = [len(ends) - 1 + new.setdefault(parts[k], len(new)) for k in missing.tolist()]
            own, counts = self._met(list(new))
            ids, ends = np.concatenate([ids, own]), _ends(counts, ends)
            self._keep(list(new), own, counts)
        ids, counts = _taken(ids, ends, found)
        ends = _ends(counts)[np.searchsorted(borders, at)]
        if not self.bytes:  # a run of unknown symbols is one, across parts as well
            again = (ids == self.unknown) & np.concatenate([[False], ids[:-1] == self.unknown])
            again[ends[:-1][ends[:-1] < len(ids)]] = False
            ids, ends = ids[~again], ends - _ends(again)[ends]
        return ids, ends

    def _met(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that the younger generation does not hold, and their counts."""
        old = self.older.look(parts)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        which = [np.flatnonzero(old >= 0)]
        made = [_taken(self.older.ids, self.older.ends, old[which[0]])]
        short = np.flatnonzero((old < 0) & (length > 1) & (length <= SHORT))
        short = short[np.argsort(length[short], kind="stable")]
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            if len(some) >= FEW:
                which.append(some)
                made.append(self._side_by_side([parts[k] for k in some.tolist()]))
                old[some] = 0
        alone = np.flatnonzero(old < 0)
        lists = [self.ids(parts[k]) for k in alone.tolist()]
        which.append(alone)
        made.append((np.array([*itertools.chain.from_iterable(lists)], np.int32), np.array([len(x) for x in lists], np.int64)))
        ids, counts = (np.concatenate(x) for x in zip(*made, strict=True))
        return _taken(ids, _ends(counts), np.argsort(np.concatenate(which)))

    def _keep(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        kept = np.flatnonzero(np.fromiter(map(len, parts), np.int64, len(parts)) <= LONGEST_KEPT)[:MOST_KEPT]
        if len(kept) < len(parts):
            parts, (ids, counts) = [parts[k] for k in kept.tolist()], _taken(ids, _ends(counts), kept)
        if len(self.known.numbers) + len(parts) > MOST_KEPT:
            self.older, self.known = self.known, Parts()
        self.known.add(parts, ids, counts)


@functools.cache
def merger(path: str) -> Merger:
    return Merger(path)


def _slices(texts: list) -> Iterator[tuple[int, list[str]]]:
    at, own, held = 0, [], 0
    for k, text in enumerate(texts):
        if own and held + len(text) > SLICE_CHARS:
            yield at, own
            at, own, held = k, [], 0
        own.append(text)
        held += len(text)
    if own:
        yield at, own


def encoded_batches(batches: Iterator[pa.RecordBatch], own: Merger, sp, with_ids: bool = False, check: bool = True) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for batch in batches:
        row_ids = batch.column("doc_id").to_pylist()
        for at, texts in _slices([t or "" for t in batch.column("text").to_pylist()]):
            ids, ends = own.encode_all(texts)
            made = [ids[a:b] for a, b in itertools.pairwise(ends.tolist())]
            if check:
                for k, want in enumerate(sp.encode_as_numpy(texts, num_threads=1)):
                    if not np.array_equal(made[k], want):
                        raise ValueError(f"doc_id {row_ids[at + k]}: the agenda and the library differ")
            decoded = [sp.decode(x) if len(x) else "" for x in made]
            listed = pc.binary_join(pa.LargeListArray.from_arrays(ends, own.decimals.take(pa.array(ids))), pa.scalar(",", pa.large_string())).to_pylist()
            columns = [row_ids[at : at + len(texts)], np.diff(ends), [digest(x) for x in listed], [digest(d) for d in decoded]]
            if with_ids:
                columns += [made, decoded]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)


def encode(df: DataFrame, vocabulary: str = "piece_bpe_32k.model", folder: str | None = None, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False, check: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row for each row of ``df``: doc_id, n_tokens, ids_sha256,
    decoded_sha256 and, if asked for, the ids themselves and the decoded text.
    Null and empty texts have no tokens; a null doc_id stays null; repeated
    rows are encoded each for itself; other columns are not read; an empty
    table gives an empty result.  A text's cost does not depend on where it
    stands: rows are encoded where they are, and nothing is shuffled.
    """
    path = vocabulary_path(vocabulary, folder)
    bound_batches(df.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(lambda batches: encoded_batches(batches, merger(path), library(path), with_ids, check), schema)
