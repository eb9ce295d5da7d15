import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(DATA)
    return langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()


def test_held_out_accuracy(predicted):
    held = [r for r in predicted if r.held_out]
    assert len(held) > 100
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in predicted)


def test_scores_are_calibrated_and_clean_documents_stay(predicted):
    assert all(0 <= r.score <= 1 for r in predicted)
    # Sure where there is much text, less so with a word or two; as often right as the mean score says.
    assert min(r.score for r in predicted) < 0.97 < sorted(r.score for r in predicted)[len(predicted) // 2]
    assert abs(sum(r.score for r in predicted) / len(predicted) - sum(r.lang_pred == r.lang for r in predicted) / len(predicted)) < 0.02
    clean = [r for r in predicted if len(r.text.split()) > 5]
    assert sum(r.rejected for r in clean) / len(clean) < 0.01


def test_nulls_no_letters_repeats_and_extra_columns(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text", "lang", F.lit("x").alias("score"), F.lit(1).alias("rejected"))
    odd = spark.createDataFrame(
        [(-1, None, "en", "", 0), (-2, "", "en", "", 0), (-3, "12 ++ 3", None, "", 0), (None, "the and of", "en", "", 0),
         (-4, "İı", None, "", 0), (-5, "the of and that " * 40_000, None, "", 0), (-5, "the of and that " * 40_000, None, "", 0)],
        docs.schema,
    )
    got = [r for r in langid.identify(docs.unionByName(odd)).collect() if r.doc_id is None or r.doc_id < 0]
    by = {r.doc_id: r for r in got}
    assert len(got) == 7
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (-1, -2, -3))
    assert by[None].lang_pred == "en" and not by[None].held_out
    assert by[-4].lang_pred != "und" and by[-5].lang_pred == "en"


def test_nothing_to_learn_from_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).collect() == []


def test_blocks_do_not_change_logits(monkeypatch):
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, langid.WIDTH)), rng.normal(size=(langid.WIDTH, 2)), np.zeros(2))
    table = model.embedding @ model.output
    texts = [langid.plain(t) for t in (b"one two three", b"x", "é ü".encode(), b"long " * 50)]
    whole = model.logits(table, texts)
    monkeypatch.setattr(langid, "CELLS", 20)
    assert np.allclose(model.logits(table, texts), whole)
    at, many = langid.bag(texts[0])
    assert np.allclose(langid.shares(many) @ table[at], whole[0], atol=1e-5)


def plain_predict(model, text):
    """Label and score of one text, n-gram by n-gram in plain Python."""

    words, word = [], []
    for c in (text or "").encode():
        if 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80:
            word.append(c | 0x20 if c < 0x80 else c)
        elif word:
            words.append(word)
            word = []
    words += [word] if word else []
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    own = [32]
    for w in words:
        own += [*w, 32]
    total, many = np.zeros(langid.WIDTH), 0
    for n in langid.GRAMS:
        for i in range(len(own) - n + 1):
            h = n
            for c in own[i : i + n]:
                h = h * 0x01000193 % (1 << 32) ^ c
            h ^= h >> 15
            h = h * 0x9E3779B1 % (1 << 32)
            total += model.embedding[h >> (32 - 15)]
            many += 1
    z = (total / many @ model.output + model.bias) / model.temperature
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(e)), key=lambda k: e[k])
    return model.labels[best], e[best] / sum(e)


@pytest.mark.parametrize("labels", [2, langid.WIDTH + 9])
def test_predictions_against_a_plain_version(spark, labels):
    rng = np.random.default_rng(labels)
    model = langid.Model([f"l{k:02}" for k in range(labels)], rng.normal(size=(langid.BUCKETS, langid.WIDTH)).astype(np.float32), rng.normal(size=(langid.WIDTH, labels)).astype(np.float32), rng.normal(size=labels).astype(np.float32), 0.7)
    texts = ["One Two, three", "x", "é ü—ß 12", "", None, "12 ++", "a" * 3000, "日本語 text", "İ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict(df, model).collect():
        label, score = plain_predict(model, texts[r.doc_id])
        assert r.lang_pred == label and r.score == pytest.approx(score, rel=1e-3, abs=1e-6)


def test_rare_labels_among_very_many_are_learned(spark):
    rng = np.random.default_rng(0)
    words = {k: ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(12)] for k in range(300)}
    rows = [(len(words) * j + k, " ".join(rng.choice(words[k], 30)), f"lang{k}") for j in range(6) for k in words]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len({r.lang_pred for r in got}) > 256
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.5  # five documents of 30 words a label
