"""Benchmark decontamination: documents that hold a passage within edit distance of an item.

Texts are sequences of words (A-Z in lower case, ASCII punctuation dropped). A
random walk embeds a window of words (the CGK embedding: at each step the walk puts
out the word under it, and a random bit of that word decides whether it moves on),
so that a small edit distance becomes a small Hamming distance. Windows have the
size of the items: items are sorted into classes by size (powers of two), and a walk
takes one and a half times as many steps as the class has words, so it crosses most
of the window. Sampling three steps of the output (the first, one of the next few,
and any further one) gives a hash that near windows share. An item is walked from
each of its words, so a window is found from whichever part of it is unharmed, and a
document from each of its words; the walks are drawn anew in several repetitions.
Besides, an item is looked up by its pieces, one more than it may have edits, of
which one is always unharmed: so no item within the limit is missed by chance.
Every candidate is then verified by the exact edit distance of the item to the best
window of the document: at most ``PERCENT_EDITS`` of its words.

The items are a stated query set, taken in blocks of a bounded size; every
document is compared with every block in one pass over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, saved, small_batches

PERCENT_EDITS = 25
#: Items with fewer words are no evidence and never match.
LEAST_WORDS = 5
#: Words of items in a block.
BLOCK_WORDS = 200_000
REPETITIONS = 6
#: Steps of a walk by the words of a window.
SPAN = 1.5
#: The second sample is at one of these steps, by repetition: near, so that few places go on.
EARLY = (2, 3, 4)
#: Words of an item from which the three samples must be at different words (two, if it has fewer).
APART = 16
#: Words of documents that are walked at once.
_AT_ONCE = 500_000

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
#: Words at which a piece of an item is looked up, at most.
_PIECE_WORDS = 4


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


def word_hashes(text: str | None, hashes: _Hashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def size_class(words: int) -> int:
    """The largest power of two that is not above the number of words."""
    return 1 << (words.bit_length() - 1)


def last_step(cls: int, repetition: int, seed: int = 11) -> int:
    """The step of the third sample in windows of a class: any after the second, up to the end of the walk."""
    early = EARLY[repetition % len(EARLY)]
    return int(np.random.default_rng([seed, cls, repetition]).integers(early + 1, max(early + 1, int(SPAN * cls)) + 1))


def _moves(words: np.ndarray, repetition: int, step: int) -> np.ndarray:
    """The random bit of each word at a step: whether the walk moves on."""
    odd = np.uint64((xxhash.xxh3_64_intdigest(b"%d:%d" % (repetition, step)) | 1) & (2**64 - 1))
    return ((words * odd) >> np.uint64(63)).astype(np.int64)


_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class ItemIndex:
    """The hashes of a block of items: of walks by repetition and class of size, of pieces by their words."""

    def __init__(self, items: list[tuple[int, str]], percent: int = PERCENT_EDITS) -> None:
        hashes = _Hashes()
        self.items = [(i, w) for i, text in items if len(w := word_hashes(text, hashes)) >= LEAST_WORDS]
        self.lists = [w.tolist() for _, w in self.items]
        self.sizes = np.array([len(w) for w in self.lists], np.int64)
        classes = sorted({size_class(n) for n in self.sizes.tolist()})
        #: For each repetition the last steps of the walks, in order, with the class that each is for.
        self.steps = [sorted((last_step(c, r), c) for c in classes) for r in range(REPETITIONS)]
        self.pad = 1 + max([EARLY[-1], *(step for steps in self.steps for step, _ in steps)])
        words = np.concatenate([*(w for _, w in self.items), np.zeros(self.pad, np.uint64)])
        ends = np.cumsum(self.sizes)
        item = np.repeat(np.arange(len(self.items)), self.sizes)
        start = np.arange(len(item))
        end, offset, cls = ends[item], start - (ends - self.sizes)[item], np.array([size_class(n) for n in self.sizes.tolist()], np.int64)[item]
        self.first = self._table(words[: len(item)])
        self.early: list[np.ndarray] = []
        self.found: list[dict[int, tuple[np.ndarray, _Found]]] = []
        for r, steps in enumerate(self.steps):
            second, key = self._second(words, start, r)
            at, done, kept, of = second, EARLY[r % len(EARLY)], [], {}
            for step, c in steps:
                at = self._walked(words, at, r, done, step)
                done = step
                # a walk stays in its item, and its samples are at different words
                keep = np.flatnonzero((cls == c) & (at < end) & (second != start) & ((at != second) | (self.sizes[item] < APART)))
                whole = key[keep] * _TIMES + words[at[keep]]
                kept.append(key[keep])
                of[c] = (self._table(whole), self._grouped(whole, np.column_stack([item[keep], offset[keep]])))
            self.early.append(self._table(np.concatenate(kept) if kept else np.empty(0, np.uint64)))
            self.found.append(of)
        pieces: list[list[tuple[int, int, int]]] = [[] for _ in range(_PIECE_WORDS)]
        for k, (_, w) in enumerate(self.items):
            # of one piece more than there may be edits, one is unharmed
            n = min(len(w) * percent // 100 + 1, len(w))
            for o, stop in ((len(w) * i // n, len(w) * (i + 1) // n) for i in range(n)):
                size = min(stop - o, _PIECE_WORDS)
                pieces[size - 1].append((self._piece(w[o : o + size]), k, o))
        self.pieces = []
        for rows in pieces:
            keys = np.array([x[0] for x in rows], np.uint64)
            self.pieces.append((self._table(keys), self._grouped(keys, np.array([x[1:] for x in rows], np.int64).reshape(-1, 2))))

    @staticmethod
    def _walked(words: np.ndarray, at: np.ndarray, r: int, done: int, step: int) -> np.ndarray:
        """Where walks that are at ``at`` before step ``done`` are at ``step``."""
        for j in range(done, step):
            at = at + _moves(words[at], r, j)
        return at

    def _second(self, words: np.ndarray, start: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the second sample, and the hash of the first two."""
        at = self._walked(words, start, r, 0, EARLY[r % len(EARLY)])
        return at, words[start] * _TIMES + words[at]

    @staticmethod
    def _piece(words: np.ndarray) -> int:
        key = 0
        for w in words.tolist():
            key = (key * int(_TIMES) + w) % 2**64
        return key

    @staticmethod
    def _table(keys: np.ndarray) -> np.ndarray:
        t = np.zeros(1 << _TABLE_BITS, bool)
        t[keys >> np.uint64(64 - _TABLE_BITS)] = True
        return t

    @staticmethod
    def _grouped(keys: np.ndarray, of: np.ndarray) -> _Found:
        """Different keys in order, where each one's rows end, and the rows (item, offset)."""
        order = np.argsort(keys, kind="stable")
        different, counts = np.unique(keys, return_counts=True)
        return different, np.cumsum(counts), of[order]

    @staticmethod
    def _matches(place: np.ndarray, key: np.ndarray, found: _Found) -> np.ndarray:
        """(place, item, offset) for each place and each item offset with the place's key."""
        keys, ends, of = found
        if not len(keys):
            return np.empty((0, 3), np.int64)
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[i] == key)
        n = ends[i[hit]] - np.where(i[hit] > 0, ends[i[hit] - 1], 0)
        which = np.repeat(ends[i[hit]], n) - 1 - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.column_stack([np.repeat(place[hit], n), of[which]])

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``h`` (which ends in ``pad`` words of padding) with items and the items' offsets, some more than once."""
        shift = np.uint64(64 - _TABLE_BITS)
        start = np.flatnonzero(self.first[h[: -self.pad] >> shift])
        out = [np.empty((0, 3), np.int64)]
        for r, steps in enumerate(self.steps):
            at, key = self._second(h, start, r)
            keep = np.flatnonzero(self.early[r][key >> shift] & (at != start))
            place, at, key, done = start[keep], at[keep], key[keep], EARLY[r % len(EARLY)]
            for step, c in steps:
                at = self._walked(h, at, r, done, step)
                done = step
                table, found = self.found[r][c]
                whole = key * _TIMES + h[at]
                hit = np.flatnonzero(table[whole >> shift])
                out.append(self._matches(place[hit], whole[hit], found))
        key = np.zeros(len(h), np.uint64)
        for size, (table, found) in enumerate(self.pieces, 1):
            key = key[: len(h) - size + 1] * _TIMES + h[size - 1 :]
            place = np.flatnonzero(table[key[: len(h) - self.pad] >> shift]) if len(found[0]) else start[:0]
            out.append(self._matches(place, key[place], found))
        return tuple(np.concatenate(out).T)


def best_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any window of the text, and where the first such window ends."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != w))
        new[0] = i + 1
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


def _verified(index: ItemIndex, doc: np.ndarray, items: np.ndarray, cells: np.ndarray, percent: int) -> list[tuple[int, int, int, int]]:
    """(item id, item words, edits, end word) of the items that the document holds, the best window of each."""
    best: dict[int, tuple[int, int]] = {}
    words = doc.tolist()
    for k, cell in zip(items.tolist(), cells.tolist(), strict=True):
        if best.get(k, (1,))[0] == 0:  # cells are in order: a later window is no better
            continue
        item = index.items[k][1]
        most = len(item) * percent // 100
        low = max(0, cell * (most + 1) - most)
        high = cell * (most + 1) + most + len(item) + most + 1
        near = set(words[low:high])
        if sum(map(near.__contains__, index.lists[k])) < len(item) - most:  # each word that is missing costs an edit
            continue
        edits, end = best_window(item, doc[low:high])
        if edits <= most and (k not in best or (edits, low + end) < best[k]):
            best[k] = (edits, low + end)
    return [(index.items[k][0], len(index.items[k][1]), edits, end) for k, (edits, end) in sorted(best.items())]


def _searched(texts: pa.Array, index: ItemIndex, hashes: _Hashes, percent: int) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """(row, match) over the texts of a batch."""
    row, n = 0, len(texts)
    while row < n:
        first, docs, size = row, [], 0
        while row < n and size < _AT_ONCE:
            docs.append(word_hashes(texts[row].as_py(), hashes))
            size += len(docs[-1])
            row += 1
        h = np.concatenate([*docs, np.zeros(max(index.pad, _PIECE_WORDS), np.uint64)])
        ends = np.cumsum([len(d) for d in docs])
        places, items, offsets = index.candidates(h)
        of = np.searchsorted(ends, places, side="right")
        places, items, offsets, of = (x[of < len(docs)] for x in (places, items, offsets, of))
        if not len(of):
            continue
        starts = places - offsets - (ends - [len(d) for d in docs])[of]
        # any alignment with a place lies within ``most`` words of its start; near starts share a wider window
        cells = starts // (index.sizes[items] * percent // 100 + 1)
        least, span = cells.min(), cells.max() - cells.min() + 1
        rest, cells = np.divmod(np.unique((of * len(index.items) + items) * span + cells - least), span)
        of, items = np.divmod(rest, len(index.items))
        for d in np.unique(of).tolist():
            mine = slice(*np.searchsorted(of, [d, d + 1]))
            for match in _verified(index, docs[d], items[mine], cells[mine] + least, percent):
                yield first + d, match


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, percent: int = PERCENT_EDITS) -> Iterator[ItemIndex]:
    """The items in blocks of about ``block_words`` words; the driver holds one block's texts at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(text.split())
        if size >= block_words:
            yield ItemIndex(block, percent)
            block, size = [], 0
    if block:
        yield ItemIndex(block, percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT_EDITS) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, item_words, edits and end_word.

    ``edits`` is the exact edit distance, in words, of the item to the best window
    found, ``end_word`` the number of the document's word after that window. Items
    match within ``percent`` of their words; null items and those under five words
    never do. Null and empty texts hold nothing. Repeated rows give their matches
    each; a null doc_id or item_id is a value like any. Empty tables give an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    python_ready(spark)
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, item_id long, item_words int, edits int, end_word int"
    parts: list[DataFrame] = []
    for index in item_blocks(benchmark, percent=percent):
        shipped = spark.sparkContext.broadcast(index)  # a block: its size is bounded

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            hashes = _Hashes()
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], *m) for i, m in _searched(batch.column(1), shipped.value, hashes, percent)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "item_words", "edits", "end_word"])

        found = docs.mapInArrow(run, schema)
        if parts:  # more than one block: each is searched and written before the next is held
            parts[-1] = saved(parts[-1], "matches")
            before.destroy()
        parts.append(found)
        before = shipped
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT_EDITS) -> DataFrame:
    """The rows of ``docs`` that hold no item, in one pass for each block of items, without a join."""
    spark = docs.sparkSession
    python_ready(spark)
    small_batches(spark)
    rows, shipped = docs.select(F.struct("*").alias("row")), None
    for index in item_blocks(benchmark, percent=percent):
        if shipped is not None:  # more than one block: each is searched and written before the next is held
            rows = saved(rows, "clean")
            shipped.destroy()
        shipped = spark.sparkContext.broadcast(index)  # a block: its size is bounded

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            hashes = _Hashes()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _ in _searched(batch.column(0).field("text"), shipped.value, hashes, percent):
                    clean[i] = False
                yield batch.filter(pa.array(clean))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("row.*")
