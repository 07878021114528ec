import random
import re
from collections import Counter

from ruleweave.llm.quality_rules import quality_rules, without_frequent_lines

from .conftest import prose


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, cover = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] > 1:
            cover |= {i, i + 1, i + 2}
    n, r = len(w), len(cover)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_edges(edge, edge_rows, nothing):
    got = sorted((str(r["doc_id"]), *[r[n] for n in NAMES]) for r in quality_rules(edge).collect())
    assert got == sorted((str(i), *brute(t)) for i, t, *_ in edge_rows)
    assert quality_rules(nothing).count() == 0


def test_fuzzed_counts(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a ", "b ", "ccc ", "\n", "#", "é ", "\t", "\x1c", "  "]) for _ in range(rng.randint(0, 200))), "s") for i in range(60)]
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


def test_frequent_lines_deplete(spark):
    rng = random.Random(4)
    menu = "\n".join(f"Menu item {k} of 12 pages here" for k in range(12))
    rows = [(i, menu.replace("12", str(i)) + "\n" + prose(rng, 30, stem=f"d{i}x"), "hot") for i in range(30)]
    rows += [(100 + i, menu + "\n" + prose(rng, 300, stem=f"d{i}y"), "hot") for i in range(30)]
    rows += [(200, menu + "\n" + prose(rng, 300), "other")]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # digits are all 0, so 60 documents of the host hold each line of the menu
    assert all(got[i]["removed_words"] == 84 and not got[i]["kept"] for i in range(30))
    assert all(got[100 + i]["removed_words"] == 84 and got[100 + i]["kept"] for i in range(30))
    assert got[200]["removed_words"] == 0 and got[200]["kept"]


def test_texts_without_frequent_lines(spark, edge, nothing):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        mine = chr(97 + i // 26) + chr(97 + i % 26)  # digits are all 0 in lines that are compared
        own = [" ".join(mine + "".join(rng.choices("pqrstuv", k=5)) for _ in range(60)), "", f"  Own\tLine {mine}  "]
        rows.append((i, "\n".join([f"Page {i}  of 12", own[0], "Share this\tPAGE ", own[1], own[2], "share this page"]), "hot", "\n".join(own)))
    rows.append((99, "Share this page\nand more", "cold", "Share this page\nand more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, want string")
    got = without_frequent_lines(docs).collect()
    assert len(got) == 61 and all(r["text"] == r["want"] for r in got)
    digest = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in quality_rules(docs).collect()}
    assert digest == {r["doc_id"]: (r["removed_words"], r["kept"]) for r in got}
    before = {i: len(t.split()) for i, t, *_ in rows}
    assert all(before[r["doc_id"]] - len(r["text"].split()) == r["removed_words"] for r in got)
    same = without_frequent_lines(edge)
    assert sorted(map(str, same.select(edge.columns).collect())) == sorted(map(str, edge.collect()))
    assert without_frequent_lines(nothing).count() == 0


def test_a_null_source_is_a_host_of_its_own(spark):
    rows = [(i, "the same line for all\n" + "own%s " % chr(97 + i % 26) * 60, s) for k, s in enumerate([None, "null", "null source", "snull", "s", ""]) for i in range(k * 30, k * 30 + 30)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["removed_words"] == 0 for r in got)
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), limit=29).collect()
    assert all(r["removed_words"] == 5 for r in got)
