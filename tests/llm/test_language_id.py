import random

import numpy as np
import public_tokenizers
import pytest

from ruleweave.llm.language_id import VOCABULARY, expected_counts, has_letter, identify, known_language, pieces_of, word_scores


@pytest.fixture(scope="module")
def trie():
    return pieces_of(public_tokenizers.path(VOCABULARY))


def pieces_in(trie, b, i):
    yield i + 1, b[i]
    node = 0
    for j in range(i, len(b)):
        node = trie.next[node, b[j]]
        if not node:
            return
        if trie.piece[node] >= 0:
            yield j + 1, trie.piece[node]


def all_cuts(trie, b, p, i=0):
    """The probability of a word by listing every segmentation."""
    return 1.0 if i == len(b) else sum(p[k] * all_cuts(trie, b, p, j) for j, k in pieces_in(trie, b, i))


def test_forward_sums_equal_listed_segmentations(trie):
    rng = np.random.default_rng(1)
    p = rng.random((trie.count, 2)) ** 4
    p /= p.sum(axis=0)
    words = ["the", "nation", "été", "x", "Straße", "zzz9"]
    got = word_scores(words, p, trie)
    for w, row in zip(words, got, strict=True):
        b = b"\xff" + w.lower().encode()
        assert np.allclose(row, [np.log(all_cuts(trie, b, p[:, k])) for k in range(2)])


def forward(trie, b, p):
    """log p(word) in extended steps, one word: the sum over all segmentations."""
    a = np.full(len(b) + 1, -np.inf)
    a[0] = 0
    for i in range(len(b)):
        for j, k in pieces_in(trie, b, i):
            a[j] = np.logaddexp(a[j], a[i] + np.log(p[k]))
    return a


def test_words_of_any_length_are_summed_over_all_segmentations(trie):
    rng = np.random.default_rng(3)
    p = rng.random((trie.count, 2)) ** 4
    p /= p.sum(axis=0)
    words = ["é" * 300, "nation" * 11, "nationalité" * 40, "über" * 33 + "x", "ab", "a" * 63, "a" * 64, "a" * 65]
    got = word_scores(words, p, trie)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [forward(trie, b"\xff" + w.encode(), p[:, k])[-1] for k in range(2)])
    # and so are their expected counts: by forward sums from both ends
    q = p[:, 0]
    want = np.zeros(trie.count)
    for w, n in (("nationalité" * 9, 2), ("é" * 90, 1), ("a" * 70, 3), ("the", 5)):
        b = b"\xff" + w.encode()
        a, c = forward(trie, b, q), np.full(len(b) + 1, -np.inf)
        c[len(b)] = 0
        for i in reversed(range(len(b))):
            for j, k in pieces_in(trie, b, i):
                c[i] = np.logaddexp(c[i], c[j] + np.log(q[k]))
        for i in range(len(b)):
            for j, k in pieces_in(trie, b, i):
                want[k] += n * np.exp(a[i] + np.log(q[k]) + c[j] - a[-1])
    assert np.allclose(expected_counts({"nationalité" * 9: 2, "é" * 90: 1, "a" * 70: 3, "the": 5}, q, trie), want)


def test_numbers_are_no_letters(spark):
    assert not any(map(has_letter, ("½ ²", "①", "12_3", "", "Ⅷ"))) and all(map(has_letter, ("½a", "é", "中", "ª")))
    rows = [(i, "the nation of the people", "en") for i in range(20)] + [(100, "½ ² ①", "en"), (101, "½ nation", "en")]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == "und" and got[101] == "en"


def test_expected_counts_equal_listed_segmentations(trie):
    p = np.random.default_rng(2).random(trie.count) ** 4
    p /= p.sum()

    def listed(b, i=0):
        if i == len(b):
            yield 1.0, []
        else:
            for j, k in pieces_in(trie, b, i):
                for q, rest in listed(b, j):
                    yield p[k] * q, [k, *rest]

    want = np.zeros(trie.count)
    for w, n in (("nation", 3), ("the", 2)):
        cuts = list(listed(b"\xff" + w.encode()))
        z = sum(q for q, _ in cuts)
        for q, used in cuts:
            for k in used:
                want[k] += n * q / z
    assert np.allclose(expected_counts({"nation": 3, "the": 2}, p, trie), want)


def test_learns_from_open_rows_only(spark):
    rng = random.Random(1)
    parts = {"aa": ["shi", "tok", "mur", "ka"], "bb": ["lle", "éau", "ien", "ou"]}
    rows = [(i, " ".join("".join(rng.choices(parts[g], k=3)) for _ in range(30)), g) for i in range(300) for g in [rng.choice(["aa", "bb"])]]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    true = {i: g for i, _, g in rows}
    held = [r for r in got if r["held_out"]]
    assert 60 < len(held) < 140 and all(r["lang_pred"] == true[r["doc_id"]] for r in held)
    # wrong labels of held-out rows change nothing
    fake = [(i, t, "zz" if any(r["doc_id"] == i for r in held) else g) for i, t, g in rows]
    again = identify(spark.createDataFrame(fake, "doc_id long, text string, lang string")).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in again} == {(r["doc_id"], r["lang_pred"]) for r in got}


def test_edges(edge, edge_rows, nothing):
    got = identify(edge).collect()
    assert len(got) == len(edge_rows)
    none = [i for i, t, *_ in edge_rows if t is None or not any(c.isalpha() for c in t)]
    assert sorted(map(str, (r["doc_id"] for r in got if r["lang_pred"] == "und"))) == sorted(map(str, none))
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und") for r in got)
    assert identify(nothing).count() == 0
    kept = known_language(edge)
    assert kept.dtypes == edge.dtypes and kept.count() == len(edge_rows) - len(none) and known_language(nothing).count() == 0
