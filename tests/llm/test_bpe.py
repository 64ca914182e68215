import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from keelvault.llm import bpe
from keelvault.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def own():
    return bpe.WordBPE(open(vocabulary_path(), "rb").read())


def texts():
    r = random.Random(8)
    letters = "abcdeinghtrsou'’ÉéèßİΣσς!?.<|>0129  \n\t́\x1c\x85 日本語😀"
    found = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(4000)]
    return [*found, "<|endoftext|>It's<|startoftext|> we'll<|endoftext|", "a" * 3000, "ab" * 500, "!?" * 400, "", " ", "ΑΣ ΑΣΑ", "don't DON'T can't've"]


def test_against_the_library(library, own):
    for run in bpe.runs(texts()):
        for text, want, ids in zip(run, library.encode_batch(run, add_special_tokens=False), own.encode_texts(run), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
            assert own.decode(np.frombuffer(ids, "<u4")).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_verified_words_equal_exact_merging(own):
    r = random.Random(5)
    words = ["".join(r.choice("eathinorsldu") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for word, ids in zip(words, own.encode_words(words), strict=True):
        assert ids.tolist() == own.merge_word(word)


def test_encode(make_docs, odd_rows, library):
    docs = make_docs(odd_rows)
    found = bpe.encode(docs, vocabulary_path()).collect()
    assert len(found) == len(odd_rows) and "source" in found[0].__fields__ and "text" not in found[0].__fields__
    assert sorted(str(r["ids"]) for r in found) == sorted(str(library.encode(t[1] or "", add_special_tokens=False).ids) for t in odd_rows)
    back = bpe.decode(bpe.encode(docs, vocabulary_path()).drop("decoded"), vocabulary_path()).collect()
    assert sorted((r["n_tokens"], r["text"]) for r in back) == sorted((r["n_tokens"], r["decoded"]) for r in found)
    clash = bpe.encode(docs.selectExpr("*", "'mine' AS ids", "7 AS n_tokens"), vocabulary_path())
    assert {"ids_", "n_tokens_"} < set(clash.columns) and {(r["ids"], r["n_tokens"]) for r in clash.collect()} == {("mine", 7)}
    assert bpe.encode(docs.limit(0), vocabulary_path(), digests=True).count() == 0
