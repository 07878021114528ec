"""A quality classifier learnt from positives and unlabelled text.

Trusted positives are labelled rows of quality 1, unlabelled text is any document.
Labelled negatives are not used. The share of positives (the class prior) is
estimated from both: a scorer of positives against unlabelled text is learnt on one
half, and on the other half the prior is the least ratio, over thresholds, of the
unlabelled share above to the positives' share above, where the ratio is sure (the
best bin). With the prior, the risk over negatives is that over unlabelled text
less that over positives; as it can't be below zero, training minimises the
non-negative unbiased risk: a step that would push it below zero climbs back
instead. All documents take part: they are dealt by hash into groups of a bounded
size, the prior and then the weights are fitted in each group against the same
positives, and both are averaged. The model adds up one weight for each interval of
each of some thirty measures of a text (shares of kinds of characters, words, lines
and repeats), which one pass over the whole texts takes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, saved
from .language_id import is_held_out

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: At most about so many positives are drawn by a hash of doc_id to fit the weights; unlabelled documents are dealt into groups of about so many.
SAMPLE = 20_000
INTERVALS = 10
STEPS = 600
DECAY = 2e-4
#: Confidence and slack of the best bin (fixed values of the published estimator).
DELTA, SLACK = 0.1, 0.01

# Kinds of bytes: control, space, new line, digit, upper, lower, symbols of markup, sentence marks, other marks, other bytes.
_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (
        9 if _b >= 128 else 2 if _c == "\n" else 1 if _c in " \t\r\v\f" else 3 if _c.isdigit() else 4 if _c.isupper() else 5 if _c.islower()
        else 6 if _c in "#*$%&|<>" else 7 if _c in ".,;:!?" else 8 if 33 <= _b < 127 else 0
    )
N_MEASURES = 28


def measures(text: str | None) -> np.ndarray:
    """The measures of a whole text; those of an empty text are zero."""
    out = np.zeros(N_MEASURES, np.float32)
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    if not words:
        return out
    kinds = np.bincount(_KIND[np.frombuffer(b, np.uint8)], minlength=10) / len(b)
    n, once = len(words), Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in b.split(b"\n") if x.strip()]
    seen = Counter(lines)
    pairs = Counter(zip(words, words[1:], strict=False))
    out[:10] = kinds
    out[10:] = (
        np.log1p(n), len(once) / n, lengths.mean(), lengths.std(), lengths.max(), (lengths > 20).mean(),
        sum(w.isupper() for w in words) / n, sum(w.istitle() for w in words) / n, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        sum(w.isdigit() for w in words) / n, len(lines) / n, 1 - len(seen) / len(lines), sum(len(x) * (k - 1) for x, k in seen.items()) / len(b),
        max(once.values()) / n, 1 - len(pairs) / max(1, n - 1), max(pairs.values(), default=0) / n, sum(k for k in once.values() if k == 1) / n,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    )
    return out


_MEASURED = "measures array<float>"


def measured(docs: DataFrame) -> DataFrame:
    """The rows of (doc_id, text) with the measures of their texts in place of these."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.concatenate([measures(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.empty(0, np.float32)
            lists = pa.ListArray.from_arrays(np.arange(0, len(m) + 1, N_MEASURES, dtype=np.int32), m)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "measures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, f"doc_id long, {_MEASURED}")


class Model:
    """Weights of intervals. The edges are quantiles of the unlabelled sample."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.edges, self.weights, self.bias = edges, weights, bias

    def places(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], x[:, k], side="left") + k * INTERVALS for k in range(x.shape[1])], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[self.places(x)].sum(axis=1) + self.bias)))


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled rows, from scores of both that were not fitted on them."""
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)
    above_p = np.arange(1, len(p) + 1) / len(p)
    above_u = 1 - np.searchsorted(u, p, side="left") / len(u)
    slack = (1 + SLACK) * (np.sqrt(np.log(4 / DELTA) / (2 * len(p))) + np.sqrt(np.log(4 / DELTA) / (2 * len(u))))
    at = int(np.argmin((above_u + slack) / above_p))
    return float(above_u[at] / above_p[at])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior by the best bin; the scorer is fitted on one half of the rows and read on the other."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    draw = np.random.default_rng(5)
    positive, unlabelled = draw.permutation(positive), draw.permutation(unlabelled)
    model = fit(positive[::2], unlabelled[::2], 0.5, steps=200, against=True)
    return min(0.98, max(0.02, best_bin(model.scores(positive[1::2]), model.scores(unlabelled[1::2]))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = DECAY, against: bool = False, edges: np.ndarray | None = None) -> Model:
    """Minimise the non-negative unbiased risk of the logistic loss by full gradient steps (Adam).

    ``against`` takes the unlabelled rows as negatives: a scorer of one against the other.
    """
    if edges is None:
        edges = np.quantile(unlabelled, np.linspace(0, 1, INTERVALS + 1)[1:-1], axis=0).T
    model = Model(edges, np.zeros(unlabelled.shape[1] * INTERVALS), float(np.log(prior / (1 - prior))))
    p, u = model.places(positive), model.places(unlabelled)
    size = len(model.weights)

    def gradient(places: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(places.ravel(), np.repeat(slope, places.shape[1]), size)
        return np.append(g, slope.sum()) / len(slope)

    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        zp, zu = (model.weights[x].sum(axis=1) + model.bias for x in (p, u))
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        minus = gradient(u, su) - prior * gradient(p, sp)
        if against:
            negative, minus = 0, gradient(u, su) * (1 - prior)
        g = prior * gradient(p, sp - 1) + minus if negative >= 0 else -minus
        g[:-1] += decay * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.weights -= step[:-1]
        model.bias -= float(step[-1])
    return model


def _edges(rows: DataFrame) -> np.ndarray:
    """The bounds of the intervals: quantiles of each measure over all rows."""
    at = F.array(*[F.lit(float(x)) for x in np.linspace(0, 1, INTERVALS + 1)[1:-1]])
    found = rows.agg(*[F.percentile_approx(F.col("measures")[k], at, F.lit(10_000)).alias(f"q{k}") for k in range(N_MEASURES)]).first()
    return np.array([list(x) for x in found], np.float64)


def fit_all(rows: DataFrame, positive: np.ndarray, count: int, sample: int = SAMPLE, steps: int = STEPS) -> tuple[float, Model]:
    """The prior and the model: in groups of about ``sample`` rows, the first averaged before the second is fitted."""
    context, edges = rows.sparkSession.sparkContext, _edges(rows)
    groups = max(1, -(-count // sample))
    dealt = saved(rows.select("measures", F.pmod(F.xxhash64("doc_id", "measures"), F.lit(groups)).alias("group")).repartition(groups, "group"), "dealt")
    shipped = context.broadcast(positive)  # bounded by ``sample``

    def of(table: pa.Table) -> np.ndarray:
        # in an order that is the same in each run
        x = table.column("measures").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_MEASURES)
        return x[np.lexsort(x.T)]

    def priors(table: pa.Table) -> pa.Table:
        x = of(table)
        return pa.table({"n": [len(x)], "prior": [estimated_prior(shipped.value, x)]})

    n, total = dealt.groupBy("group").applyInArrow(priors, "n long, prior double").agg(F.sum("n"), F.sum(F.col("n") * F.col("prior"))).first()
    prior = total / n

    def weights(table: pa.Table) -> pa.Table:
        x = of(table)
        m = fit(shipped.value, x, prior, steps, edges=edges)
        return pa.table({"n": [len(x)], "weights": [np.append(m.weights, m.bias)]})

    fitted = dealt.groupBy("group").applyInArrow(weights, "n long, weights array<double>")
    sums = fitted.select("n", F.posexplode("weights").alias("at", "w")).groupBy("at").agg(F.sum(F.col("n") * F.col("w")).alias("w")).collect()  # a row a weight
    mean = np.zeros(N_MEASURES * INTERVALS + 1)
    for r in sums:
        mean[r["at"]] = r["w"] / n
    shipped.destroy()
    return prior, Model(edges, mean[:-1], float(mean[-1]))


def _drawn(rows: DataFrame, count: int, sample: int) -> np.ndarray:
    """The measures of about ``sample`` rows, drawn by a hash of doc_id."""
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) < int(min(1.0, sample / max(1, count)) * 1_000_000)
    got = rows.where(part).select("measures").collect()  # about ``sample`` rows of fixed size
    return np.array([r[0] for r in got], np.float64).reshape(-1, N_MEASURES)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score and predicted.

    Labels of quality 1 are used of rows that are not held out, and no others; the
    class prior is estimated. A document labelled more than once is positive if all
    its labels are 1; null labels count as none. Without a positive or a document the score is 0.5. Null and empty texts are scored by their measures, which
    are zero. A null doc_id is not held out and has no label. Repeated rows are
    scored each; an empty table gives an empty result; other columns are not read.
    """
    rows = saved(measured(docs), "measures")
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("quality")).where("id is not null and quality is not null")
    known = known.where(~is_held_out(F.col("id"), FOLDS, HELD_OUT)).groupBy("id").agg(F.min("quality").alias("quality"))
    known = saved(known.where("quality = 1").select("id"), "positives")
    known_rows = saved(rows.join(known, rows.doc_id == known.id, "left_semi"), "positive")
    positive, count, model = _drawn(known_rows, known_rows.count(), sample), rows.count(), None
    if len(positive) and count:
        _, model = fit_all(rows, positive, count, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_MEASURES)
            score = model.scores(x) if model is not None and len(x) else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
