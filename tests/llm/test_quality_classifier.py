import random

import numpy as np

from ruleweave.llm.quality_classifier import N_MEASURES, estimated_prior, fit, measures, quality

from .conftest import prose


def test_positive_unlabelled_fit_separates():
    rng = np.random.default_rng(1)
    positive = rng.normal(1, 1, (500, 3))
    unlabelled = np.concatenate([rng.normal(1, 1, (1200, 3)), rng.normal(-2, 1, (800, 3))])
    model = fit(positive, unlabelled, 0.6, steps=300)
    assert (model.scores(rng.normal(1, 1, (500, 3))) >= 0.5).mean() > 0.85
    assert (model.scores(rng.normal(-2, 1, (500, 3))) < 0.5).mean() > 0.85


def junk(rng):
    return " ".join(f"{w}###" for w in prose(rng, 60).split()).upper()


def test_held_out_accuracy_without_their_labels(spark):
    rng = random.Random(3)
    rows = [(i, junk(rng) if i % 4 == 0 else prose(rng, 60)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(600) if i % 3], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert 80 < len(held) < 160
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    # labels of held-out rows are not read
    import zlib

    turned = [(i, (1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in [(r["doc_id"], r["quality"]) for r in labels.collect()]]
    again = quality(docs, spark.createDataFrame(turned, "doc_id long, quality int")).collect()
    assert sorted((r["doc_id"], r["score"]) for r in again) == sorted((r["doc_id"], r["score"]) for r in got)


def test_edges(spark, edge, edge_rows, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (6, 1), (8, 1), (9, 0), (None, 1), (12, None)], "doc_id long, quality int")
    for known in (labels, labels.where("false")):
        got = quality(edge, known).collect()
        assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        assert quality(nothing, known).count() == 0
    assert measures(None).tolist() == [0] * N_MEASURES and np.isfinite(measures("a" * 100_000)).all()


def test_the_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8):
        n = 4000
        positive = rng.normal(1.5, 1, (1500, 4))
        unlabelled = np.where(rng.random(n)[:, None] < share, rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (n, 4)))
        assert abs(estimated_prior(positive, unlabelled) - share) < 0.06


def test_labelled_negatives_are_not_read(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, junk(rng) if i % 4 == 0 else prose(rng, 60)) for i in range(200)], "doc_id long, text string")
    ones = [(i, 1) for i in range(200) if i % 4]
    got, again = (
        sorted((r["doc_id"], r["score"]) for r in quality(docs, spark.createDataFrame(ones + more, "doc_id long, quality int")).collect())
        for more in ([], [(i, 0) for i in range(0, 200, 4)])
    )
    assert np.allclose([s for _, s in got], [s for _, s in again])


def test_groups_cover_all_rows(spark):
    rng = random.Random(5)
    rows = [(i, junk(rng) if i % 4 == 0 else prose(rng, 60)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(600) if i % 4], "doc_id long, quality int")
    got = quality(docs, labels, sample=200).collect()  # three groups
    assert len(got) == 600 and np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in got]) > 0.95
