"""Token ids and counts against the tokenizers library, over texts made to break the cuts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plumbline.llm.bpe import TokenCounter
from plumbline.llm.packing import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "é", " ", "\n", "\t", ".", ",", "'", "s", "1", "２", " ", "　", "—", "<|endoftext|>", "🙂", "T", "  ", "'t", "\x85", "the", " the", "!!!!"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(20_000)]
    return [None, "", " ", "a" * 5000, "ab" * 3000, "x\n\ny", "word " * 3000, *made, *made[:50]]


@pytest.fixture(scope="module")
def expected(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts(texts, expected):
    assert TokenCounter(PATH).counts(pa.array(texts)).tolist() == [len(x) for x in expected]


def test_ids(texts, expected):
    values, first = encoder(PATH).gather(pa.array(texts))
    assert [x.tolist() for x in np.split(values, first[1:-1])] == expected


def test_emptied_memo_changes_nothing(texts, expected):
    counter = TokenCounter(PATH)
    counter.memo.most = 500
    found = [counter.counts(pa.array(texts[i : i + 1000])) for i in range(0, len(texts), 1000)]
    assert np.concatenate(found).tolist() == [len(x) for x in expected]
