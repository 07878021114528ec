"""Token counts of a BPE tokenizer, by counting pieces once per distinct pre-token.

Texts are read once and cut to pre-tokens. A block of documents keeps one list
of its distinct pre-tokens and, by document, how often each occurs. The lists
are dealt out by a hash of the pre-token, so that equal pre-tokens of all blocks
meet, are encoded once, and send back only their numbers of pieces; the sums
are then taken block by block. Token ids are never kept: encoding gives the
places where pre-tokens end, and their distances are the counts.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, saved

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of text that make a block full.
BLOCK_CHARS = 24_000_000
#: Distinct pre-tokens whose counts a task remembers.
REMEMBERED = 1_000_000

# Fixed values of the tokenizer: what it cuts a text into, and its special strings.
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_SPACE = regex.compile(r"\p{White_Space}+")
#: The same cut for texts whose characters are all below U+0250, which the quicker engine can do.
_LOW = re.compile("[^\x00-ɏ]|İ")
_LOW_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_LOW_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LOW_SPACES = "\t-\r \x85\xa0"
_LOW_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW_LETTERS}]+|[{_LOW_NUMBERS}]|[^{_LOW_SPACES}{_LOW_LETTERS}{_LOW_NUMBERS}]+")
_SPECIALS = re.compile("|".join(map(re.escape, _SPECIAL)))


def pre_tokens(text: str, normalizer=None) -> list[str]:
    """The pre-tokens of a text in order; special strings are pre-tokens of their own."""
    if "<|" in text:
        out, at = [], 0
        for m in _SPECIALS.finditer(text):
            out += _plain(text[at : m.start()], normalizer)
            out.append(m.group())
            at = m.end()
        return out + _plain(text[at:], normalizer)
    return _plain(text, normalizer)


def _plain(text: str, normalizer) -> list[str]:
    if not _LOW.search(text):
        return _LOW_CUT.findall(text.lower())
    if normalizer is not None:
        return _CUT.findall(normalizer.normalize_str(text))
    return _CUT.findall("".join(c.lower() for c in unicodedata.normalize("NFC", text)))


class PieceCounter:
    """Numbers of pieces of pre-tokens, remembered up to a bound."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer = self.tokenizer.normalizer
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")
        self.known = dict.fromkeys(_SPECIAL, 1)

    def count(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict.fromkeys(_SPECIAL, 1)
            new = [w for w in dict.fromkeys(words) if w not in self.known]
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            ids = np.array(self.tokenizer.encode("\n".join(some), add_special_tokens=False).ids, np.int64)
            n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(n) != len(some):  # a pre-token that does not stand alone: one by one
                n = [len(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in some]
            self.known.update(zip(some, map(int, n), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def _packed(a: np.ndarray) -> bytes:
    """Compressed bytes of an array of integers, byte planes apart."""
    a = a.astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


_BLOCKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("postings", pa.list_(pa.binary()))])
_BLOCKS_DDL = "block long, bucket int, words binary, ids array<long>, n_bytes array<long>, postings array<binary>"


class _Block:
    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.n_bytes, self.docs, self.at, self.times, self.chars = [], [], [], [], [], 0

    def add(self, doc_id: int | None, text: str, normalizer) -> None:
        index = self.index
        held = np.array([index.setdefault(w, len(index)) for w in pre_tokens(text, normalizer)], np.int64)
        at, times = np.unique(held, return_counts=True)
        self.ids.append(doc_id)
        self.n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
        self.docs.append(len(at))
        self.at.append(np.diff(at, prepend=0))
        self.times.append(times)
        self.chars += len(text) + 100

    def rows(self, number: int, buckets: int) -> pa.RecordBatch:
        words = list(self.index)
        bucket = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words], np.int64)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        postings = [_packed(np.array(self.docs)), _packed(join(self.at)), _packed(join(self.times)), _packed(bucket)]
        rows = {k: [v] for k, v in zip(_BLOCKS.names, (number, -1, None, self.ids, self.n_bytes, postings), strict=True)}
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in range(buckets):
            mine = order[starts[b] : starts[b + 1]]
            if len(mine):
                text = "\n".join([words[i] for i in mine]).encode("utf-8", "surrogatepass")
                for k, v in zip(_BLOCKS.names, (number, b, squeeze.compress(text), None, None, None), strict=True):
                    rows[k].append(v)
        return pa.RecordBatch.from_pydict(rows, schema=_BLOCKS)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    A null text counts as an empty one: no bytes, no tokens. Repeated rows and
    null ids are counted each. An empty table gives an empty result. A text of
    any length is one document of its block. Other columns are not read.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    python_ready(spark)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalizer = PieceCounter(path).normalizer
        first, n, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in zip(ids, batch.column(1), strict=True):
                block.add(i, text.as_py() or "", normalizer)
                if block.chars >= block_chars:
                    yield block.rows(first + n, buckets)
                    n, block = n + 1, _Block()
        if block.ids:
            yield block.rows(first + n, buckets)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, open_up = PieceCounter(path), zstandard.ZstdDecompressor()
        for batch in batches:
            counts = [_packed(counter.count(open_up.decompress(w.as_py()).decode("utf-8", "surrogatepass").split("\n"))) for w in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary())], ["block", "bucket", "counts"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[bytes] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is None:
                    got.append(row["counts"])
                    continue
                sizes, at, times, bucket = map(_unpacked, row["postings"])
                n = np.zeros(len(bucket), np.int64)
                if got:
                    n[np.argsort(bucket, kind="stable")] = np.concatenate([_unpacked(x) for x in got])
                got = []
                ends = np.cumsum(sizes)
                starts = ends - sizes
                # indices were kept as steps within each document
                run = np.cumsum(at)
                before = np.repeat(np.where(starts > 0, run[np.maximum(starts, 1) - 1], 0) if len(run) else np.zeros(len(sizes), np.int64), sizes)
                total = np.concatenate([[0], np.cumsum(n[run - before] * times)]) if len(run) else np.zeros(1, np.int64)
                tokens = total[ends] - total[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(tokens.astype(np.int64))], ["doc_id", "n_bytes", "n_tokens"]
                )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(blocks, _BLOCKS_DDL)
    made = saved(made, "blocks")
    chunks = made.where("bucket >= 0").select("block", "bucket", "words").repartition(buckets, "bucket")
    counted = chunks.mapInArrow(pieces, "block long, bucket int, counts binary")
    vectors = made.where("bucket < 0").select("block", F.lit(2**31 - 1).alias("bucket"), F.lit(None).cast("binary").alias("counts"), "ids", "n_bytes", "postings")
    nothing = counted.select("block", "bucket", "counts", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("n_bytes"), F.lit(None).cast("array<binary>").alias("postings"))
    together = nothing.unionByName(vectors).repartition("block").sortWithinPartitions("block", "bucket")
    out = together.mapInArrow(sums, "doc_id long, n_bytes long, n_tokens long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
