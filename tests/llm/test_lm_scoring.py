import math
import random

import numpy as np
import pytest

from marlstone.llm import lm_scoring as lm

DOCS = "doc_id long, text string, logprob string"


def plain_log_p(network, ids, i):
    """log P of one position, written out."""
    p = network.p
    x = np.concatenate([p["e"][ids[i + d]] for d in (-2, -1, 1, 2)]).astype(float)
    h = np.tanh(x @ p["w"] + p["b"])
    c, s = divmod(int(ids[i]), lm.SIZE)
    zc, zo = h @ p["wc"] + p["bc"], h @ p["wo"][c] + p["bo"][c]
    return zc[c] - math.log(np.exp(zc).sum()) + zo[s] - math.log(np.exp(zo).sum())


def corpus(n, seed=0):
    """Two invented languages with words in a fixed order, so that both sides tell a word."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"{'ab'[i % 2]}{k % 7}" for k in range(rng.randrange(7), rng.randrange(20, 90))]
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    return lm.fit(spark.createDataFrame(list(enumerate(corpus(1500))), "doc_id long, text string").repartition(3), rounds=3)


def test_scores_are_the_sums_of_plain_conditionals(spark, fitted):
    network, words = fitted
    texts = ["", None, "a1", "A1 a2 unknown a4 b5 é", "a0 a1 a2 " * 400]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a1 a2", "c"), (3, texts[3], "c")]
    got = lm.score_rows(spark.createDataFrame(rows, DOCS), network, words).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        ids, at, _, _ = lm.ids_of([t.encode() if t else None], words.numbers())
        want = sum(plain_log_p(network, ids, k) for k in at) + sum(float(words.slots[words.slot(w)]) for w in lm.words_of(t.encode() if t else None) if w not in words.names)
        assert r.n_tokens == len(at) and r.logprob == pytest.approx(want, rel=1e-3, abs=1e-3)
        assert (r.mean_logprob is None) == (len(at) == 0)


def test_training_prefers_the_corpus_to_shuffled_words(spark, fitted):
    network, words = fitted
    rng = random.Random(9)
    clean = corpus(200, seed=3)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in clean]
    n, a = lm.score(network, words.numbers(), [t.encode() for t in clean])
    _, b = lm.score(network, words.numbers(), [t.encode() for t in mixed])
    assert (a.sum() - b.sum()) / n.sum() > 0.3
    assert a.sum() / n.sum() > -math.log(14)  # better than the 14 words being equally likely


def test_vocabulary_counts_all_texts(spark, monkeypatch):
    texts = ["b b b a", "A a c", None, "x" * 100 + " c", "b"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert lm.vocabulary(df).names == {b"b": 0, b"a": 1, b"c": 2}
    monkeypatch.setattr(lm, "COUNTED", 1)
    assert lm.vocabulary(df).names == {b"b": 0, b"a": 1, b"c": 2}


def test_other_words_have_their_share_of_their_output(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 3)
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(200)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    words = lm.vocabulary(df)
    counts = {}
    for t in texts:
        for w in lm.words_of(t.encode()):
            counts[w] = counts.get(w, 0) + 1
    assert sorted(counts, key=lambda w: (-counts[w], w))[:3] == list(words.names)
    others = {w: n for w, n in counts.items() if w not in words.names}
    assert 2 * len(others) <= len(words.slots) <= 8 * len(counts)
    by_slot = {}
    for w, n in others.items():
        by_slot[words.slot(w)] = by_slot.get(words.slot(w), 0) + n
    for w in [*list(others)[:200], b"not in the corpus"]:
        same = [n for k, n in by_slot.items() if k % lm.BUCKETS == words.slot(w) % lm.BUCKETS]
        total = sum(same) + lm.UNSEEN * len(words.slots) / lm.BUCKETS
        assert float(words.slots[words.slot(w)]) == pytest.approx(math.log((by_slot.get(words.slot(w), 0) + lm.UNSEEN) / total), rel=2e-3)
    assert np.exp(words.slots.astype(float)).reshape(-1, lm.BUCKETS).sum(axis=0) == pytest.approx(1, rel=1e-2)


def test_every_position_is_learned_from_once(spark, monkeypatch):
    assert all(sorted(x for turn in range(r) for x in lm.share(np.arange(n), turn, r)) == list(range(n)) for r in (1, 2, 3) for n in (0, 1, 2, 101))
    # In a round, all of the share: the weights by which parameters are averaged count the positions.
    docs = spark.createDataFrame(list(enumerate(corpus(60))), "doc_id long, text string").repartition(3)
    words, seen = lm.vocabulary(docs), []
    monkeypatch.setattr(lm, "GROUPS", 1)
    frame = type(docs)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: [seen.append(r.weight) or r for r in rows] if "weight" in (rows := collect(self))[0] else rows)
    for turn in range(2):
        lm._round(docs, "text", lm.Network.fresh(), words, turn, 2)
    assert sum(seen) == sum(len(t.split()) for t in corpus(60))


def test_gradients(fitted):
    rng = np.random.default_rng(1)
    net = lm.Network({k: v.astype(np.float64) for k, v in lm.Network.fresh(2).p.items()})
    ctx, tgt = rng.integers(0, lm.VOCABULARY, (5, 4)), rng.integers(0, lm.VOCABULARY, 5)
    steps = {k: np.zeros_like(v) for k, v in net.p.items()}
    moved = lm.Network({k: v.copy() for k, v in net.p.items()})
    moved.learn(ctx, tgt, steps)  # the summed squares are the squared gradients
    for k, at in (("w", (3, 2)), ("bc", (int(tgt[0]) // lm.SIZE,)), ("e", (int(ctx[0, 1]), 3)), ("wo", (int(tgt[1]) // lm.SIZE, 4, int(tgt[1]) % lm.SIZE))):
        loss = []
        for d in (1e-5, -1e-5):
            p = {n: v.copy() for n, v in net.p.items()}
            p[k][at] += d
            loss.append(-lm.Network(p).log_p(ctx, tgt).mean())
        assert steps[k][at] == pytest.approx(((loss[0] - loss[1]) / 2e-5) ** 2, rel=1e-3, abs=1e-12)


def test_empty_table(spark):
    assert lm.scores(spark.createDataFrame([], DOCS)).collect() == []
    assert [r.logprob for r in lm.scores(spark.createDataFrame([(1, None, "")], DOCS)).collect()] == [0.0]


@pytest.mark.parametrize("named", [0, 40, 200_000])
def test_every_word_has_its_own_count_however_few_the_slots(spark, monkeypatch, named):
    monkeypatch.setattr(lm, "MOST_SLOTS", 512)
    monkeypatch.setattr(lm, "LEAST_SLOTS", 512)
    monkeypatch.setattr(lm, "NAMED", named)
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.2))}" for _ in range(60)) for _ in range(200)]
    texts += ["y" * 90 + " w1 w2", "w1 " + "Y" * 90, "z" * 70 + " w3"]
    words = lm.vocabulary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    counts = {}
    for t in texts:
        for w in lm.words_of(t.encode()):
            counts[w] = counts.get(w, 0) + 1
    others = {w: n for w, n in counts.items() if w not in words.names}
    assert len(others) > 1000 and len(words.slots) == 512 and len(words.known) <= named
    empty = [sum(k % lm.BUCKETS == b for k in set(range(512)) - {words.slot(w) for w in others}) for b in range(lm.BUCKETS)]
    total = [lm.UNSEEN * n for n in empty]
    for w, n in others.items():
        total[words.slot(w) % lm.BUCKETS] += n + lm.UNSEEN
    network = lm.Network.fresh()
    asked = [*texts[-20:], None, "", "never seen " + "q" * 80 + " w1", texts[0]]
    rows = lm.score_rows(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(asked)], DOCS), network, words).collect()
    assert len(rows) == len(asked)
    for r in rows:
        raw = asked[r.doc_id].encode() if asked[r.doc_id] else None
        ids, at, _, _ = lm.ids_of([raw], words.numbers())
        own = [w for w in lm.words_of(raw) if w not in words.names]
        want = sum(plain_log_p(network, ids, k) for k in at) + sum(math.log((others.get(w, 0) + lm.UNSEEN) / max(total[words.slot(w) % lm.BUCKETS], lm.UNSEEN)) for w in own)
        assert r.n_tokens == len(at) and r.logprob == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_each_different_word_of_a_batch_is_looked_up_once():
    texts = [b"a B b\x0bc", None, b" \n", b"\xff\xfe a  c\x1cd " + b"x" * 100, b"c " * 500 + "É é".encode()]
    asked = []

    class Numbers(dict):
        def __missing__(self, word):
            asked.append(word)
            return len(word)

    said = []
    ids, at, sizes, slots = lm.ids_of(texts, Numbers(), said)
    every = [lm.words_of(t) for t in texts]
    words = [w for own in every for w in own]
    assert sorted(asked) == sorted(set(words))
    assert sizes.tolist() == [len(own) for own in every] and said[0].to_pylist() == words
    assert slots[at].tolist() == [len(w) for w in words] and at.tolist() == np.flatnonzero(ids != lm.PAD).tolist()
    keys = lm.keys_of(said[0]).to_pylist()
    assert keys == [lm.key_of(w) for w in words] and any(len(w) > lm.LONGEST for w in words)


def test_scores_far_apart_have_probabilities():
    z = np.array([[300.0, -300], [0, 0], [299, 1]], dtype=np.float32)
    p, log_p = lm._softmax(z.copy(), np.array([2, 0]), np.arange(2))
    assert np.allclose(p.sum(axis=0), 1) and np.allclose(log_p, [-1 - np.log1p(np.exp(-1)), -301 - np.log1p(np.exp(-1))])
    network = lm.Network.fresh()
    network.p["bo"][0, 0] = 1000
    assert np.allclose(network.log_p(np.full((1, 2 * lm.REACH), lm.PAD), np.array([1])), -1000, atol=20)
