import random
from collections import defaultdict

from pyspark.sql import functions as F

from ruleweave.llm.mixing import mix, with_copies

from .conftest import prose


def waterfill(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = goal - sum(2 * sizes[s] for s in stopped)
        by = sum(weight[s] for s in sizes if s not in stopped)
        target = {s: 2 * sizes[s] if s in stopped else (weight[s] * rest / by if by else 0) for s in sizes}
        more = {s for s in sizes if s not in stopped and target[s] > 2 * sizes[s]}
        if not more:
            return target
        stopped |= more


def test_targets_and_words_taken(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, int(rng.paretovariate(1.1) * 20) % 3000), rng.choice(["a", "b", "c", "hot", "hot", "hot", "é", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = with_copies(df, carry=["doc_id", "source"]).select("row.*", "size", "source_size", "target", "copies").collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = waterfill(sizes)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[r["source"]] for r in got)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] for s in want)
    again = with_copies(df.repartition(7), carry=["doc_id", "source"]).select("row.*", "copies").collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_edges(edge, edge_rows, nothing):
    out = mix(edge)
    assert out.columns == edge.columns and out.dtypes == edge.dtypes
    decided = with_copies(edge)
    assert decided.count() == len(edge_rows)
    assert out.count() == decided.agg(F.sum("copies")).first()[0]
    assert mix(nothing).count() == 0 and with_copies(nothing).count() == 0
    assert with_copies(edge.where("text is null")).agg(F.sum("copies")).first()[0] == 0
