import re

import numpy as np

from marlstone.llm import decontaminate as op
from marlstone.llm.fmindex import FMIndex, WaveletMatrix, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    out = []
    for i, text in docs:
        own, hit, names = plain_words(text), set(), set()
        for name, it in items:
            w = plain_words(it)
            for k in range(max(0, len(w) - window) + 1 if w else 0):
                p = w[k : k + window]
                for at in range(len(own) - len(p) + 1):
                    if own[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        names.add(str(name))
        out.append((i, len(own), len(hit), len(names), op.items_digest(list(names)), bool(hit)))
    return out


def case():
    rng = np.random.default_rng(0)
    vocab = ["the", "of", "é", "x1", "Blé", "and", "w%d"] + ["v%d" % i for i in range(30)]
    items = [(k, " ".join(rng.choice(vocab, rng.integers(1, 30)))) for k in range(12)]
    items += [(50, ""), (51, None), (52, "!!"), (53, "the the the the the the the the the the the"), (2, items[3][1]), (54, "lone")]
    docs = [(0, None), (1, ""), (2, "...")]
    for i in range(3, 60):
        own = list(rng.choice(vocab + ["out%d" % j for j in range(20)], rng.integers(0, 60)))
        for _ in range(rng.integers(0, 3)):
            w = (items[rng.integers(len(items))][1] or "").split()
            a = rng.integers(0, max(1, len(w) - 8))
            at = rng.integers(0, len(own) + 1)
            own[at:at] = w[a : a + rng.integers(5, 20)]
        docs.append((i, ("-" if i % 3 else " ,\n").join(own).upper() if i % 4 == 0 else " ".join(own)))
    docs += [(60, "the " * 500), (61, " ".join(rng.choice(vocab, 40_000))), (3, docs[3][1]), (3, docs[3][1])]
    return docs, items


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_report_against_brute_force(spark, monkeypatch):
    docs, items = case()
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, spans string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain(docs, items))
    assert rows(op.report(d, b)) == want
    monkeypatch.setattr(op, "BLOCK_BYTES", 300)
    assert len(op._blocks(b, "item_id", "text")) > 2
    assert rows(op.report(d, b)) == want


def test_removed_spans_leave_nothing_to_find(spark):
    docs, items = case()
    d = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    b = spark.createDataFrame([x for x in items if x[1] and len(x[1].split()) >= 10], "item_id long, text string")
    left = op.remove(d, b)
    assert left.columns == ["doc_id", "text", "lang"]
    was = {r.doc_id: r.n_hit for r in op.report(d, b).collect()}
    kept = {r.doc_id: r.text for r in left.collect()}
    for i, t in docs:
        if was[i] == 0:
            assert kept[i] == t
        elif i in kept:
            assert len(plain_words(kept[i])) == len(plain_words(t)) - was[i]
        else:
            assert was[i] == len(plain_words(t))


def test_empty_tables(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert op.report(d.limit(0), b).collect() == []
    assert all(not r.contaminated for r in op.report(d, b.limit(0)).collect())


def test_index_searches_and_locates_like_a_scan():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(0, 4, 600), 0)
    text[200:230] = text[100:130]
    order = suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    index = FMIndex(text, 3)
    for m in (1, 2, 5, 12):
        pats = np.zeros((40, 12), dtype=np.int64)
        for k in range(40):
            pats[k, 12 - m :] = rng.integers(1, 4, m) if k % 2 else text[(a := rng.integers(0, 580)) : a + m]
        low, high = index.search(pats)
        for k in range(40):
            p = pats[k, 12 - m :].tolist()
            want = [] if 0 in p else [i for i in range(len(text) - m + 1) if text[i : i + m].tolist() == p]
            if 0 not in p:
                assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_wavelet_matrix():
    rng = np.random.default_rng(6)
    s = rng.integers(0, 13, 200)
    w = WaveletMatrix(s, 4)
    at = rng.integers(0, 201, 50)
    c = rng.integers(0, 13, 50)
    assert w.rank(c, at).tolist() == [int((s[:a] == x).sum()) for x, a in zip(c, at, strict=True)]
    assert w.symbol(np.arange(200)).tolist() == s.tolist()
