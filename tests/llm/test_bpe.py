import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import bpe
from marlstone.llm.queries import tokenizer_path

TEXTS = [
    None, "", " ", "  \n\n ", "Hello world", "don't we'll I'M", "naïve Größe señor çà", "日本語 テキスト", "🙂🙃 emoji‍",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 5000, " " * 3000 + "a", "\t\r\n\x0b\x0c\x85 ", "1234567 ٣٤٥ ²",
    "tab\tand  two  spaces   three", "\x00\x01\x1c", "thethethe ingingtion onlyhe",
]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


@pytest.fixture(scope="module")
def lib(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder(path):
    with open(path, "rb") as f:
        return bpe.Encoder(f.read())


def test_rows_equal_the_library(spark, path, lib):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "c"), (0, "twice", "c"), (0, "twice", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids, r.decoded) for r in bpe.roundtrip(df, path).collect())
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, ids, lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.digests(df.limit(0), path).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, lib, text):
    ids = encoder.encode([text])[0]
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["th", "e", "in", "g", "on", "tion", "a", "an", "d", "é", "ß"]), min_size=1, max_size=12))
def test_words_that_need_exact_merging(encoder, lib, parts):
    word = "".join(parts)
    assert encoder.encode([word])[0].tolist() == lib.encode(word, add_special_tokens=False).ids


def test_long_text_is_cut_into_the_same_words(encoder, lib, monkeypatch):
    text = "the théy  don't\n\n run 42 " * 300
    want = lib.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "LONG_TEXT", 64)
    assert encoder.encode([text])[0].tolist() == want


def test_the_heap_and_the_scan_merge_alike(encoder, monkeypatch):
    words = [b"onethetioninging", b"aaaaaaaa", "öäüßß".encode(), b"zzzxyxyxy"]
    scan = [encoder.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT_WORD", 0)
    assert [encoder.merge(w) for w in words] == scan


def test_other_kinds_of_file_are_refused(path):
    spec = json.loads(open(path, "rb").read())
    spec["normalizer"] = {"type": "Lowercase"}
    with pytest.raises(ValueError):
        bpe.Encoder(json.dumps(spec).encode())
