import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ruleweave.llm.near_dedup import COORDINATES, _WordHashes, near_dedup, near_duplicates, shingle_set, signature

from .conftest import prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(n_shingles, component) by doc_id, for ids that are not null."""
    parent, inv, sets = {i: i for i, _ in rows if i is not None}, defaultdict(list), []

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, text in rows:
        if i is None:
            continue
        s, c = shingles(text), Counter()
        for g in s:
            c.update(inv[g])
        for j, n in c.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            inv[g].append(len(sets))
        sets.append((i, s))
    return {i: find(i) for i in parent}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, groups=12, hot=60):
    rng = random.Random(seed)
    rows = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    passage = prose(rng, 60)
    rows += [prose(rng, 60) + " " + passage for _ in range(40)]
    for _ in range(groups):
        base = prose(rng, rng.randint(20, 200))
        rows += [edited(rng, base, rng.randint(0, 8)) for _ in range(rng.randint(2, 6))] + [base]
    base = prose(rng, 140)
    rows += [edited(rng, base, rng.randint(0, 12)) for _ in range(hot)]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)


def test_edges(edge, edge_rows, nothing):
    want = brute([(i, t) for i, t, *_ in edge_rows])
    got = near_duplicates(edge).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert (r["component_id"], r["kept"]) == ((None, True) if r["doc_id"] is None else (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]))
    assert near_duplicates(nothing).count() == 0 and near_dedup(nothing).count() == 0
    kept = near_dedup(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in want if want[i] == i) and ids.count(None) == 2


def test_signatures_agree_as_often_as_sets():
    rng, h = random.Random(3), _WordHashes()
    a = prose(rng, 400)
    b = edited(rng, a, 12)
    x, y = shingle_set(a, h), shingle_set(b, h)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    agree = (signature(x) == signature(y)).sum() / COORDINATES
    assert abs(true - agree) < 0.2
    assert len(shingle_set("A b  C\nd", h)) == 1 and len(shingle_set("", h)) == 0


def test_small_blocks_find_the_same(spark, monkeypatch):
    from ruleweave.llm import near_dedup as nd

    for name, value in {"BLOCK": 7, "TILE": 5, "CHUNK": 3, "AT_ONCE": 11, "FEW": 0}.items():
        monkeypatch.setattr(nd, name, value)
    rows = corpus(3, hot=120)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)
