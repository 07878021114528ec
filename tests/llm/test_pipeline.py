"""The stages hold against brute force, each on its own input."""

import random
from collections import Counter

import corpus_pipeline
from ruleweave.llm.decontaminate import _Hashes, best_window, word_hashes

from .conftest import prose
from .test_near_dedup import brute, edited


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    bench = [(i, prose(rng, 30)) for i in range(5)]
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(150)]
    texts += [edited(rng, t, 1) for t in texts[:30]] + texts[:20] + [prose(rng, 20) + " " + b + " " + prose(rng, 20) for _, b in bench] + ["12 34", "", None]
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", "c"]), len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mixing", "sharding"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        if name != "sharding":
            assert docs.dtypes == before.dtypes
    a, b = seen["language_id"]
    assert {r["doc_id"] for r in b} == {r["doc_id"] for r in a if any(c.isalpha() for c in r["text"] or "")}
    a, b = seen["near_dedup"]
    want = brute([(r["doc_id"], r["text"]) for r in a])
    assert sorted(r["doc_id"] for r in b) == sorted(i for i in want if want[i] == i)
    a, b = seen["decontaminate"]
    h = _Hashes()
    items = [word_hashes(t, h) for _, t in bench]
    clean = [r["doc_id"] for r in a if all(best_window(x, word_hashes(r["text"], h))[0] > len(x) // 4 for x in items)]
    assert sorted(r["doc_id"] for r in b) == sorted(clean) and len(b) < len(a)
    a, b = seen["mixing"]
    copies = Counter(r["doc_id"] for r in b)
    assert set(copies) <= {r["doc_id"] for r in a} and max(copies.values()) <= 2 and abs(sum(len(r["text"].split()) for r in b) - 1.5 * sum(len(r["text"].split()) for r in a)) < 0.05 * sum(len(r["text"].split()) for r in b)
    a, b = seen["sharding"]
    assert Counter(r["doc_id"] for r in a) == Counter(r["doc_id"] for r in b) and {r["shard"] for r in b} <= set(range(24))
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["size"]) for r in whole) == sorted((r["doc_id"], r["size"]) for r in b)
