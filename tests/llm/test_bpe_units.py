"""The table of units: what is encoded anew, in how many calls, and that the ids stay those of the library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from marketloom.llm import bpe
from marketloom.llm.common import slices
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def coded(codec, texts):
    out = []
    for _, _, raw, off in slices(pa.array(texts, pa.string())):
        ids, at = codec.encode_slice(raw, off)
        out += [x.tolist() for x in np.split(ids, at[1:-1])]
    return out


@pytest.fixture
def codec():
    return bpe.Codec(PATH)


def test_a_full_table_keeps_its_units(codec, monkeypatch):
    """Before, a full table was thrown away, and frequent units were encoded again."""
    monkeypatch.setattr(bpe, "MEMO_UNITS", 50)
    asked, add = [], codec._keep
    monkeypatch.setattr(codec, "_keep", lambda ids, counts, keys, sizes: (asked.append(len(sizes)), add(ids, counts, keys, sizes))[1])
    frequent = "at " + " ".join(f"common{k}x" for k in range(60))
    coded(codec, [frequent])
    first, held = sum(asked), codec.size.n
    for k in range(3):
        rare = "at " + " ".join(f"rare{k}y{j}" for j in range(30))
        assert coded(codec, [rare + " " + frequent]) == [codec.tokenizer.encode(rare + " " + frequent, add_special_tokens=False).ids]
    assert sum(asked) - first == 3 * 31 and codec.size.n == held + 31  # rare ones and " at"; those of the last text stay no longer
    for k in range(12):
        coded(codec, [" ".join(f"more{k}z{j}" for j in range(30))])
    assert codec.size.n < held + 30 and coded(codec, [frequent]) == [codec.tokenizer.encode(frequent, add_special_tokens=False).ids]


def test_units_of_any_letters_are_encoded_in_one_call(codec, monkeypatch):
    """Before, those without a space before them or with a letter beyond ASCII at an end went one by one."""
    alone, one = [], codec._alone
    monkeypatch.setattr(codec, "_alone", lambda texts: (alone.extend(texts), one(texts))[1])
    texts = ["Über die straße café élan, naïve 日本 語です", "première\nligne Ω", "Ende", "'s <|endoftext|> a<|endoftext|>b.c"]
    assert coded(codec, texts) == [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(alone) <= {b"\n"}


def test_odd_texts_have_the_ids_of_the_library(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_UNITS", 300)
    library, rng = Tokenizer.from_file(PATH), random.Random(8)
    parts = ['a', 'Word', '\xe9', '\xdf', '\u65e5\u672c', 'e\u0301', '\u0301', '\U0001f600', '\u200d', '12', '\u0663', "'s", "'LL", '\u2019t', '.', ',x', '!?', '-', '"', '<|endoftext|>', '\n', '\n\n', '\r\n', '\t', ' ', '  ', '\xa0', '\x85', '\u1680', '\u2003', '\u2028', '\u202f', '\u205f', '\u3000', '\u3001', '\u180e', '\ufeff', '\x00', '\x1c', '\x7f', 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxx']
    for _ in range(40):
        texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(50)]
        assert coded(codec, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
