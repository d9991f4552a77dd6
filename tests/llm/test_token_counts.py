"""Token counts against the library itself."""

from __future__ import annotations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runlens.llm import common as C
from runlens.llm import token_counts as T

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "\n", " \n", "a", " a", "  a", "\ta", "\n\n a", "a\n", "it's", "it 's", "'s", "''s", "!'s", "we'll've", "'street", "they're'd", "'LL", "don't 'tis", "'l", "'",
    "x1y22 33", "a--b... 'x", "é'é ö's 中文 字。漢", "😀😀 😀", "a b 　 c　d", "<|endoftext|>", "a <|endoftext|>b", "<|endoftext|><|endoftext|> x", "<|endoftext|", "'<|endoftext|>s", "'s<|endoftext|>'s",
    "͸ unassigned", "a࢏", "tail   ", "\r\n\r\n x\r\n", " x  ", "x" * 5000, "ab " * 3000, "\x00\x1f\x7f \x85x", "é 'é", "\U00011de0 1",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        file = f.read()
    return T.Counter(file, T.whole_strings(file), T.classes())


def counts(counter, texts):
    parts = [counter.count(d, o) for _, d, o in C.slices(pa.array(texts, pa.string()))]
    return np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)


def expected(library, texts):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_are_the_library_s(counter, library):
    got = counts(counter, TEXTS)
    assert got[2].tolist() == expected(library, TEXTS)
    assert (got[1] <= got[0]).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'srtvelmd  \n\t1!é中 　<|>") | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=6))
def test_any_text(counter, library, texts):
    assert counts(counter, texts)[2].tolist() == expected(library, texts)


def test_pieces_are_the_library_s(counter, library):
    for t in filter(None, TEXTS):
        if "endoftext" in t or "͸" in t or "࢏" in t or "\U00011de0" in t:
            continue
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[0] = True
        heads = np.flatnonzero(T._heads(points, counter.kinds[points], first))
        assert heads.tolist() == [a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(t)], t


def test_classes_of_all_assigned_code_points(library, counter):
    for lead, kind in (("a", T.LETTER), ("1", T.NUMBER), ("!", T.OTHER)):
        for start in (0, 0x8000, 0x10000, 0x1E000):  # the planes' other parts hold ideographs and private use
            points = [p for p in range(start, start + (0x8000 if start < 0x10000 else 0x2000)) if not 0xD800 <= p < 0xE000 and counter.kinds[p] != T.UNSURE]
            joined = {points[a // 4] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str("".join(f"{lead}{chr(p)}\n\r" for p in points)) if a % 4 == 0 and b == a + 2}
            assert joined == {p for p in points if counter.kinds[p] == kind}


def test_long_texts_in_parts(counter, library, monkeypatch):
    texts = ["word it's 12  <|endoftext|>\n\n x " * 40, "y" * 900, "中 文" * 200, "a  b" * 100]
    monkeypatch.setattr(C, "SLICE_BYTES", 50)
    got = np.concatenate([counter.count(d, o) for _, d, o in C.slices(pa.array(texts), 50)], axis=1)
    assert got[2].tolist() == expected(library, texts)


def test_forgetting(counter, library, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 10)
    texts = [f"qzx{i}w kjh{i % 7}" for i in range(60)]
    assert counts(counter, texts)[2].tolist() == expected(library, texts)
    assert counts(counter, texts)[2].tolist() == expected(library, texts)


def test_table(spark, library):
    rows = [(None if i % 9 == 0 else i % 30, t, "extra", 7) for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string, k0 int").repartition(3)
    got = T.token_counts(df, PATH).collect()
    want = [(r[0], len((r[1] or "").encode()), n) for r, n in zip(rows, expected(library, [r[1] for r in rows]), strict=True)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=key) == sorted(want, key=key)
    assert T.token_counts(spark.createDataFrame([], df.schema), PATH).count() == 0
    with pytest.raises(ValueError, match="named like results"):
        T.token_counts(df, PATH, keep=("n_tokens",))


def test_other_kinds_are_refused():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="byte-level"):
        T.vocabulary(f.read())
