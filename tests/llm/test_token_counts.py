import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ruleweave.llm.token_counts import TOKENIZER, PieceCounter, pre_tokens, token_counts


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def test_pieces_of_any_text(tokenizer):
    rng, counter = random.Random(1), PieceCounter(public_tokenizers.path(TOKENIZER))
    letters = list("aàéI'İßſ sSt́̂\x1c\x1d\x85 Ⅷ²½٣漢字한ΣςΑ.!<|>\n\t_-ﬁ​ǅ'sre ")
    for i in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) + ("<|endoftext|>'s" if i % 7 == 0 else "")
        assert counter.count(pre_tokens(text, counter.normalizer)).sum() == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_edges_and_small_blocks(edge, edge_rows, nothing, tokenizer):
    want = sorted((str(i), len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in edge_rows)
    for chars in (24_000_000, 500):
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(edge, block_chars=chars).collect())
        assert got == want
    assert token_counts(nothing).count() == 0
