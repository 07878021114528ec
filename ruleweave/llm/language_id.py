"""Language identification by unigram pieces, summed over every segmentation.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces, by a
forward algorithm; pieces do not cross white space, so a text's log-probability
is the sum over its words, and each distinct word of a batch is summed up once.
The distributions are fitted by expectation-maximisation over the same sums.

The forward algorithm runs over many words at a time, along a trie of the pieces'
bytes; it keeps as many columns as the longest piece has bytes, so words of any
length are summed over all their segmentations. Words are taken in lower case, with
a mark for their start. Single bytes are pieces too (the vocabulary's byte
fallback), so every word has a probability in every language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, saved, small_batches

VOCABULARY = "piece_bpe_32k.model"
#: About so many training documents a language are drawn (by a hash of doc_id) to fit the distributions.
TRAINING_DOCUMENTS = 2000
ROUNDS = 3
SMOOTHING = 0.05
#: Words up to this length are summed with those of the same length, longer ones with those of up to twice their length.
ALIKE = 64
#: Bytes of words that are held at once, and steps between two scalings, which keep products above the least double.
CELLS = 2_000_000
SCALED = 24
#: Bytes of the distributions (pieces by languages) that are shipped to executors at most.
SHIPPED = 1 << 30
#: Documents whose distinct words are held and scored at once.
AT_ONCE = 1500
UNKNOWN = "und"
_START = 0xFF  # stands for the word-start mark; no UTF-8 text holds this byte
_LETTER = re.compile(r"[^\W\d_]+")


class Pieces:
    """The vocabulary as a trie over bytes. Ids 0 to 255 are the single bytes, the others follow."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = set()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in piece[1:]:
                continue
            found.add((bytes([_START]) if piece[0] == "▁" else b"") + piece.lstrip("▁").lower().encode())
        pieces = sorted(x for x in found if len(x) > 1)
        children: list[dict[int, int]] = [{}]
        at = []
        for piece in pieces:
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            at.append(node)
        self.next = np.zeros((len(children), 256), np.uint16 if len(children) < 2**16 else np.int32)
        for node, below in enumerate(children):
            for b, to in below.items():
                self.next[node, b] = to
        self.piece = np.full(len(children), -1, np.int32)
        self.piece[at] = np.arange(256, 256 + len(pieces), dtype=np.int32)
        self.count = 256 + len(pieces)
        self.longest = max(map(len, pieces), default=1)


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numbers that are no digits, such as a half, are none."""
    return any(any(map(str.isalpha, run.group())) for run in _LETTER.finditer(text))


def _lengths(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of like length: their bytes (filled up with a byte that is in no text), their lengths, and their places."""
    by: dict[int, tuple[list[bytes], list[int]]] = {}
    for k, word in enumerate(words):
        b = b"\xff" + word.lower().encode("utf-8", "surrogatepass")
        parts, of = by.setdefault(len(b) if len(b) <= ALIKE else -(len(b) - 1).bit_length(), ([], []))
        parts.append(b)
        of.append(k)
    for parts, of in by.values():
        most = max(1, CELLS // max(map(len, parts)))
        for i in range(0, len(parts), min(20_000, most)):
            some = parts[i : i + min(20_000, most)]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            n = int(lengths.max())
            yield np.frombuffer(b"".join(x.ljust(n, b"\xfe") for x in some), np.uint8).reshape(len(some), n), lengths, np.array(of[i : i + len(some)])


def _edges(symbols: np.ndarray, trie: Pieces) -> Iterator[tuple[int, int, np.ndarray | slice, np.ndarray]]:
    """Pieces in the words by start: start, end, rows, piece ids."""
    rows, n = symbols.shape
    for j in range(n):
        yield j, j + 1, slice(None), symbols[:, j].astype(np.int32)
        live = np.arange(rows)
        state = np.zeros(rows, np.int32)
        for k in range(j, min(n, j + trie.longest)):
            state = trie.next[state, symbols[live, k]]
            keep = np.flatnonzero(state)
            live, state = live[keep], state[keep]
            if not len(live):
                break
            ids = trie.piece[state]
            if len(hit := np.flatnonzero(ids >= 0)):
                yield j, k + 1, live[hit], ids[hit]


def word_scores(words: list[str], p: np.ndarray, trie: Pieces) -> np.ndarray:
    """log p(word) in each language, the columns of ``p`` (probability by piece and language)."""
    out = np.zeros((len(words), p.shape[1]))
    for symbols, lengths, of in _lengths(words):
        rows, n = symbols.shape
        ring = min(trie.longest, n) + 1  # a piece ends so many columns ahead at most
        a = np.zeros((ring, rows, p.shape[1]))
        a[0] = 1
        scale, at = np.zeros(rows), 0

        def ended(j: int, a=a, lengths=lengths, scale=scale, of=of, ring=ring) -> None:
            if len(done := np.flatnonzero(lengths == j)):
                out[of[done]] = np.log(a[j % ring, done]) + scale[done, None]

        for j, end, some, ids in _edges(symbols, trie):
            if j != at:
                ended(j)
                a[at % ring] = 0
                at = j
                if j % SCALED == 0:
                    top = a[j % ring].max(axis=1)
                    a /= top[None, :, None]
                    scale += np.log(top)
            a[end % ring, some] += a[j % ring, some] * p[ids]
        ended(n)
    return out


def expected_counts(words: dict[str, int], p: np.ndarray, trie: Pieces) -> np.ndarray:
    """Expected uses of each piece (one language) in words with their counts, by forward and backward sums."""
    out = np.zeros(trie.count)
    names, times = list(words), np.fromiter(words.values(), float, len(words))
    for symbols, lengths, of in _lengths(names):
        rows, n = symbols.shape
        a, b = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
        a[0] = 1
        edges = list(_edges(symbols, trie))
        scale, scales, at = np.zeros(rows), np.zeros((n // SCALED + 1, rows)), 0
        for j, end, some, ids in edges:
            if j != at:
                at = j
                if j % SCALED == 0:  # all columns from here on are scaled alike
                    top = a[j]
                    scale += np.log(top)
                    a[j + 1 : j + trie.longest + 1] /= top
                    a[j] = 1
                    scales[j // SCALED] = scale
            a[end, some] += a[j, some] * p[ids]
        z = np.log(a[lengths, np.arange(rows)]) + scales[np.minimum(lengths, n - 1) // SCALED, np.arange(rows)]
        behind, at = np.zeros(rows), n + 1
        for j, end, some, ids in reversed(edges):
            if j != at:
                at = j
                b[lengths[lengths == j + 1][:1], lengths == j + 1] = 1
                if (j + 1) % SCALED == 0:
                    top = np.where(b[j + 1] > 0, b[j + 1], 1)
                    behind += np.log(top)
                    b[j + 1 : j + trie.longest + 1] /= top
                share = times[of] * np.exp(scales[j // SCALED] + behind - z)
            use = p[ids] * b[end, some]
            b[j, some] += use
            np.add.at(out, ids, a[j, some] * use * share[some])
    return out


def is_held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def _shipped(docs: DataFrame, p: np.ndarray):
    """The distributions as a broadcast, its size checked."""
    if p.nbytes > SHIPPED:
        raise ValueError(f"{p.shape[1]} languages need {p.nbytes} bytes on each executor; {SHIPPED} is the limit")
    return docs.sparkSession.sparkContext.broadcast(p)


def fit(docs: DataFrame, vocabulary: str | None = None, documents: int = TRAINING_DOCUMENTS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the probability of each piece in each, from (doc_id, text, lang) of training rows."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    trie = pieces_of(path)
    known = docs.where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()  # a row a language
    langs = [r["lang"] for r in counts]
    if not langs:
        return [], np.zeros((trie.count, 0))
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, documents / r["n"]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000.0
    sample = saved(known.where(draw < F.element_at(rates, F.col("lang"))).select("lang", "text"), "training")
    p = np.full((trie.count, len(langs)), 1 / trie.count)
    for _ in range(rounds):
        shipped = _shipped(docs, p)

        def expect(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            trie, p = pieces_of(path), shipped.value
            total = np.zeros_like(p)
            for batch in batches:
                seen = [Counter() for _ in langs]
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen[langs.index(lang)].update(text.split())
                for k, words in enumerate(seen):
                    total[:, k] += expected_counts(words, p[:, k], trie)
            ids, ks = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(ks.astype(np.int32)), pa.array(total[ids, ks])], ["piece", "lang", "n"])

        found = sample.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        e = np.full_like(p, SMOOTHING)
        for r in found.collect():  # at most a row for each piece and language
            e[r["piece"], r["lang"]] += r["n"]
        p = e / e.sum(axis=0)
        shipped.destroy()
    return langs, p


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str | None = None) -> DataFrame:
    """The columns of ``docs`` but ``text`` with lang_pred and score: see :func:`identify`.

    The text is the column ``text``, or that field of a column ``row``.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    python_ready(docs.sparkSession)
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    shipped = _shipped(docs, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, p = pieces_of(path), shipped.value
        for whole in batches:
            for first in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(first, AT_ONCE)
                at = batch.schema.get_field_index("text")
                texts = batch.column(at) if at >= 0 else batch.column(batch.schema.get_field_index("row")).field("text")
                index: dict[str, int] = {}
                vectors: list[tuple[np.ndarray, np.ndarray] | None] = []
                for text in texts:
                    text = text.as_py()
                    if not langs or text is None or not has_letter(text):
                        vectors.append(None)
                        continue
                    ids = [index.setdefault(w, len(index)) for w in text.split()]
                    vectors.append(np.unique(np.array(ids, np.int32), return_counts=True))
                scores = word_scores(list(index), p, trie) if index else None
                pred, score = [], []
                for v in vectors:
                    if v is None:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    s = v[1] @ scores[v[0]]
                    best = int(np.argmax(s))
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(s - s[best]).sum()))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*rest, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, documents: int = TRAINING_DOCUMENTS, rounds: int = ROUNDS) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred and score (the posterior of lang_pred, equal priors).

    The distributions are fitted on rows that are not held out and have a text
    and a lang. A text that is null or has no letter, and any text if nothing
    could be learnt, is ``und`` with score 0. A null doc_id is not held out.
    Equal scores go to the first language by code point. Repeated rows are
    scored each; an empty table gives an empty result; other columns are not read.
    """
    held = docs.select("doc_id", "text", "lang", is_held_out(F.col("doc_id")).alias("held_out"))
    langs, p = fit(held.where("not held_out").select("doc_id", "text", "lang"), documents=documents, rounds=rounds)
    return predict(held.select("doc_id", "held_out", "text"), langs, p)


def known_language(docs: DataFrame, documents: int = TRAINING_DOCUMENTS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` that have a language by :func:`identify`: texts that are null or without a letter go.

    A text in a language that was not learnt has the nearest learnt one, and stays.
    """
    held = docs.select("doc_id", "text", "lang", is_held_out(F.col("doc_id")).alias("held_out"))
    langs, p = fit(held.where("not held_out").select("doc_id", "text", "lang"), documents=documents, rounds=rounds)
    rows = docs.select(F.struct("*").alias("row"))
    return predict(rows, langs, p).where(F.col("lang_pred") != UNKNOWN).select("row.*")
