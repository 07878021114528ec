import random

import numpy as np
import pyarrow as pa

from ruleweave.llm.decontaminate import ItemIndex, _Hashes, _searched, best_window, contaminated, decontaminate, word_hashes

from .conftest import prose


def edit_distance(a, b):
    """The least edit distance of ``a`` to any run of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_best_window_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        assert best_window(np.array(a, np.uint64), np.array(b, np.uint64))[0] == edit_distance(a, b)


def planted(seed, rate, items=40):
    rng = random.Random(seed)
    bench = [(i, prose(rng, rng.randint(8, 60))) for i in range(items)]
    docs, want = [], set()
    for d in range(300):
        w = prose(rng, rng.randint(20, 400)).split()
        if d % 2:
            i, text = rng.choice(bench)
            x = text.split()
            for k in rng.sample(range(len(x)), int(rate * len(x))):
                x[k] = {"s": f"sub{k}", "d": "", "i": f"{x[k]} ins{k}"}[rng.choice("sdi")]
            at = rng.randrange(len(w))
            w[at:at] = x
        docs.append((d, " ".join(w)))
    h = _Hashes()
    for d, t in docs:
        doc = word_hashes(t, h)
        for i, text in bench:
            item = word_hashes(text, h)
            if best_window(item, doc)[0] <= len(item) * 25 // 100:
                want.add((d, i))
    return docs, bench, want


def test_recall_against_brute_force(spark):
    for rate in (0.0, 0.1, 0.2):
        docs, bench, want = planted(7, rate)
        got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
        found = {(r["doc_id"], r["item_id"]) for r in got}
        assert found <= want and len(found & want) >= 0.97 * len(want)
        clean = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
        assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in found}


def test_blocks_of_items_find_the_same(spark):
    docs, bench, _ = planted(9, 0.1)
    h, texts = _Hashes(), pa.array([t for _, t in docs])
    whole = {(r, m) for r, m in _searched(texts, ItemIndex(bench), h, 25)}
    parts = {(r, m) for k in range(0, 40, 10) for r, m in _searched(texts, ItemIndex(bench[k : k + 10]), h, 25)}
    assert {(r, m[0]) for r, m in whole} == {(r, m[0]) for r, m in parts}


def test_edges(spark, edge, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "same words here twice over same words here"), (4, "line " * 12), (4, "line " * 12)], "item_id long, text string")
    got = contaminated(edge, bench).collect()
    assert sorted((r["doc_id"], str(r["item_id"]), r["edits"]) for r in got) == [(-3, "4", 0), (9, "None", 0), (9, "None", 0)]
    clean = decontaminate(edge, bench)
    assert clean.dtypes == edge.dtypes and clean.count() == edge.count() - 3
    assert contaminated(nothing, bench).count() == 0 and contaminated(edge, bench.where("false")).count() == 0
    assert decontaminate(edge, bench.where("false")).count() == edge.count() and decontaminate(nothing, bench).count() == 0


def test_no_item_within_the_limit_is_missed():
    rng, new = random.Random(3), lambda: f"n{rng.randrange(10**9)}"
    for n in (5, 6, 8, 12, 16, 20, 40):
        items, docs = [], []
        for i in range(60):
            x = [new() for _ in range(n)]
            y = list(x)
            if i % 3 == 0:  # each fourth word
                y[3::4] = [new() for _ in y[3::4]]
            elif i % 3 == 1:  # one, in the middle
                y[n // 2] = new()
            else:  # at random places, with words added and lost
                for k in sorted(rng.sample(range(n), n * 25 // 100), reverse=True):
                    y[k : k + 1] = rng.choice([[], [new()], [y[k], new()]])
            items.append((i, " ".join(x)))
            docs.append(" ".join([*(new() for _ in range(20)), *y, *(new() for _ in range(20))]))
        found = {(r, m[0]) for r, m in _searched(pa.array(docs), ItemIndex(items), _Hashes(), 25)}
        assert found == {(i, i) for i in range(60)}, n


def test_walks_alone_reach_the_target_recall(monkeypatch):
    rng, new = random.Random(4), lambda: f"n{rng.randrange(10**9)}"
    for n in (5, 7, 8, 16, 40, 100):
        items, docs = [], []
        for i in range(60):
            x = [new() for _ in range(n)]
            y = list(x)
            for k in rng.sample(range(n), n * 25 // 100):
                y[k] = new()
            items.append((i, " ".join(x)))
            docs.append(" ".join([*(new() for _ in range(20)), *y, *(new() for _ in range(20))]))
        index = ItemIndex(items)
        index.pieces = []
        found = {(r, m[0]) for r, m in _searched(pa.array(docs), index, _Hashes(), 25)}
        assert found <= {(i, i) for i in range(60)} and len(found) >= 0.93 * 60, n


def test_several_blocks_on_a_cluster_path(spark, monkeypatch):
    from ruleweave.llm import decontaminate as module

    docs, bench, _ = planted(11, 0.1)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    whole, clean = sorted(map(tuple, contaminated(d, b).collect())), sorted(map(tuple, decontaminate(d, b).collect()))
    monkeypatch.setattr(module, "item_blocks", lambda benchmark, percent: (ItemIndex(bench[k : k + 15], percent) for k in range(0, 40, 15)))
    assert sorted(map(tuple, contaminated(d, b).collect())) == whole and sorted(map(tuple, decontaminate(d, b).collect())) == clean
