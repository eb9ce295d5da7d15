import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from marlstone.llm import bktree, simhash
from marlstone.llm import components as component
from marlstone.llm.components import components

DOCS = "doc_id long, text string, fp string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, words=4):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    made = [" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in made]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def shingles(text, words=5):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def jaccard_components(sets, similarity):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = sets[i] | sets[j]
            if not both or len(sets[i] & sets[j]) / len(both) >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(rng, base, vocab, share):
    own = list(base)
    for k in rng.choice(len(own), round(share * len(own)), replace=False):
        own[k] = str(rng.choice(vocab))
    return " ".join(own)


def texts():
    rng = np.random.default_rng(3)
    vocab = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(vocab, 120)) for _ in range(25)]
    out = [None, "", " \t\n", "One", "one TWO three", "É É\x0b\x1c a b c d e f"]
    for t in base:
        out += [t, t, t.upper(), t + " tail"]
        own = t.split()
        for _ in range(4):
            own[rng.integers(len(own))] = str(rng.choice(vocab))
            out.append(" ".join(own))
    out.append(" ".join(rng.choice(vocab, 30_000)))
    return out


def test_fingerprint_is_the_plain_one():
    t = texts()
    made = simhash.fingerprint_of([x if x is None else x.encode() for x in t], 4)
    assert made.tolist() == [plain_fingerprint(x) for x in t]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    t = texts()
    rows = [(i * 3, x, "clash") for i, x in enumerate(t)]
    fps = [plain_fingerprint(x) for x in t]
    want = {i * 3: (f"{fps[i]:016x}", r * 3) for i, r in enumerate(plain_components(fps, 4))}
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len(got) == len(rows)


@pytest.mark.parametrize("shard", [4096, 8])
def test_dense_cluster_in_few_or_many_shards(spark, shard):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 150:
        x = centre if rng.random() < 0.6 else int(rng.integers(1 << 63))
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, shard)
    root = {r.node: r.root for r in components(links).collect()}
    groups = {}
    for x, want in zip(signed, plain_components(fps, 4), strict=True):
        groups.setdefault(want, set()).add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set.union(*groups.values())) == len(groups)


def test_masks_leave_no_pair_out():
    rng = np.random.default_rng(1)
    for blocks in (5, 6, 7, 8):
        chosen = simhash.masks(4, blocks)
        for _ in range(100):
            d = sum(1 << int(b) for b in set(rng.integers(0, 64, 4)))
            assert any(d & (m % (1 << 64)) == 0 for m in chosen)


def test_forest_finds_what_brute_force_finds():
    rng = np.random.default_rng(2)
    value = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    group = (value % 3).astype(np.int64)
    forest = bktree.Forest(group, value)
    found = {(int(a), int(b)) for q, t in forest.near(group, value, 2) for a, b in zip(q, t, strict=True)}
    want = {(i, j) for i in range(len(value)) for j in range(len(value)) if group[i] == group[j] and int(value[i] ^ value[j]).bit_count() <= 2}
    assert found == want


def test_empty_table_nulls_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e", None), (None, None, None), (7, "a b c d e", "x"), (7, "a b c d e", "x"), (9, "", None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(-1, 7), (-1, 9), (7, 7), (7, 7), (9, 9)]


@pytest.mark.parametrize("small", [0, 60, 200_000])
def test_components_of_chains_stars_and_repeats(spark, monkeypatch, small):
    monkeypatch.setattr(component, "SMALL", small)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_similar_documents_are_found_and_others_left_alone(spark):
    rng = np.random.default_rng(8)
    vocab = ["w%d" % i for i in range(5000)]
    rows, sets = [], []
    for _ in range(60):
        base = list(rng.choice(vocab, 300))
        for share in (0, 0.005, 0.01, 0.015, 0.02, 0.2):
            rows.append(edited(rng, base, vocab, share))
    rows += [rows[0], rows[0].upper(), "short one", "short one", "another short text of seven words", None, ""]
    sets = [shingles(t) for t in rows]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], DOCS).repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (u := sets[i] | sets[j]) and len(sets[i] & sets[j]) / len(u) >= 0.8]
    assert sum(got[i] == got[j] for i, j in pairs) / len(pairs) >= 0.97
    loose = jaccard_components(sets, 0.6)
    assert all(loose[i] == loose[c] for i, c in got.items())


def test_a_large_group_of_similar_documents_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = np.random.default_rng(9)
    vocab = ["w%d" % i for i in range(5000)]
    base = list(rng.choice(vocab, 400))
    rows = [edited(rng, base, vocab, 0.008) for _ in range(150)] + [" ".join(rng.choice(vocab, 200)) for _ in range(50)]
    got = simhash.similar(spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)], DOCS)).collect()
    assert sorted(r.component_id for r in got) == [0] * 150 + list(range(150, 200))


def test_representatives_of_repeated_and_nameless_rows(spark):
    rows = [(3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (4, "A b c d e f", "y"), (None, "a b c d e f", "z"), (9, None, None), (8, "", None)]
    got = simhash.representatives(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.fp or "") for r in got) == [(3, "x"), (8, "")]
    assert simhash.representatives(spark.createDataFrame([], DOCS)).collect() == []


def test_an_id_with_several_texts_names_several_documents(spark):
    one, other, third = "a b c d e f g h", "one two three four five six seven", "x y z u v w x y z"
    run = lambda rows: sorted(((r.doc_id, r.text) for r in simhash.representatives(spark.createDataFrame([(i, t, None) for i, t in rows], DOCS)).collect()), key=str)
    assert run([(5, one), (5, other)]) == sorted([(5, one), (5, other)], key=str)
    assert run([(2, one), (5, one), (5, other)]) == sorted([(2, one), (5, other)], key=str)
    assert run([(None, one), (None, other), (None, one)]) == sorted([(None, one), (None, other)], key=str)
    assert run([(None, one), (7, one), (None, third)]) == sorted([(7, one), (None, third)], key=str)
    assert len(run([(5, one), (5, one.upper())])) == 1


def test_similar_is_exact_at_the_similarity(spark):
    rng = np.random.default_rng(12)
    vocab = ["w%d" % i for i in range(3000)]
    rows = []
    for n in (12, 40, 100, 300):
        for _ in range(25):
            base = list(rng.choice(vocab, n))
            rows += [" ".join(base), *(edited(rng, base, vocab, share) for share in (0.01, 0.022, 0.03, 0.045, 0.07))]
    for _ in range(5):
        menu = list(rng.choice(vocab, 5))
        rows += [" ".join([*menu * 60, *rng.choice(vocab, 200)]) for _ in range(2)]
        own = list(rng.choice(vocab, 100))
        rows += [" ".join(own), " ".join([*own, *menu * 30])]
    sets = [shingles(t) for t in rows]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)], DOCS).repartition(3)).collect()}
    want = jaccard_components(sets, 0.8)
    assert [got[i] for i in range(len(rows))] == want
    assert 50 < len(rows) - len(set(want))


def test_similar_is_exact_in_long_lists_whatever_the_order(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "COMMON", 5)
    rng = np.random.default_rng(13)
    vocab = ["w%d" % i for i in range(3000)]
    base = list(rng.choice(vocab, 200))
    rows = [edited(rng, base, vocab, share) for share in (0.01, 0.02, 0.03, 0.04) for _ in range(40)]
    sets = [shingles(t) for t in rows]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)], DOCS)).collect()}
    assert [got[i] for i in range(len(rows))] == jaccard_components(sets, 0.8)


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(14)
    for n in (0, 1, 5, 400, 520, 3000):
        for share in (0, 0.02, 0.1, 0.3):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[round(share * n) :], rng.integers(0, 1 << 63, round(share * n / 2)).astype(np.uint64)]))
            assert simhash.apart(simhash.sketch(a), simhash.sketch(b)) <= len(np.setxor1d(a, b))


def test_lists_in_batches_are_lists_at_once():
    rng = np.random.default_rng(4)
    key = np.sort(np.concatenate([rng.integers(0, 60, 150), np.full(80, 61), np.arange(62, 90)]))
    table = pa.table({"key": key, "node": np.arange(len(key)), "size": np.full(len(key), 100, np.int32), "pos": np.zeros(len(key), np.int32)})
    want_pairs, want_crowd = set(), []
    for k in np.unique(key):
        own = np.flatnonzero(key == k).tolist()
        want_pairs |= {(own[0], x) for x in own[1:]}
        want_crowd += [(int(k), x) for x in own] if len(own) > 2 else []
    for size in (1, 2, 3, 40, 1000):
        out = [r for x in simhash._met(iter(table.to_batches(max_chunksize=size)), 0.8) for r in x.to_pylist()]
        assert {(r["a"], r["b"]) for r in out if r["key"] is None} == want_pairs
        assert sorted((r["key"], r["a"]) for r in out if r["key"] is not None) == sorted(want_crowd)


def test_lightest_spanning_forests():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        group = rng.integers(0, n, n)
        a, b, weight = rng.integers(0, n, 120), rng.integers(0, n, 120), rng.integers(0, 9, 120)
        own = simhash.spanning(group, a, b, weight)
        root = list(range(n))
        find = lambda x, root=root: x if root[x] == x else find(root[x], root)
        total = taken = 0
        for k in np.argsort(weight, kind="stable"):
            x, y = find(group[a[k]]), find(group[b[k]])
            if x != y:
                root[x], total, taken = y, total + weight[k], taken + 1
        assert len(own) == taken and weight[own].sum() == total


def test_similar_links_by_trees_and_compares_the_sets(spark, monkeypatch):
    """Without lists of shingles, what the trees link within their bits is linked, if the sets are similar."""
    rng = np.random.default_rng(21)
    vocab = ["w%d" % i for i in range(3000)]
    rows = []
    for _ in range(30):
        base = list(rng.choice(vocab, 400))
        rows += [" ".join(base), *(" ".join([*base[:k], "new", *base[k + 1 :]]) for k in (0, 399))]
    rows += [" ".join(rng.choice(vocab, 300)) for _ in range(30)]
    sets = [shingles(t) for t in rows]
    fps = [int(simhash.fingerprint(np.unique(simhash.hashes_of(t.encode(), 5)))) for t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.NEAR]
    similar = [(i, j) for i, j in near if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert len(similar) > 60

    def none(batches, similarity):
        return (b for b in () for b in batches)

    monkeypatch.setattr(simhash, "_met", none)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)], DOCS).repartition(3)).collect()}
    assert all(got[i] == got[j] for i, j in similar)
    assert all(got[i] == i for i in range(90, 120))


def test_trees_connect_fingerprints_within_their_bits(spark):
    rng = np.random.default_rng(22)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    for x in fps[:60]:
        y = x
        for b in rng.choice(62, int(rng.integers(0, 9)), replace=False):
            y ^= 1 << int(b)
        fps.append(y)
    made = {r.node: r.root for r in components(simhash._by_trees(spark.createDataFrame(list(enumerate(fps)), "node long, fp long"))).collect()}
    want = plain_components(fps, simhash.NEAR)
    assert [made.get(i, i) for i in range(len(fps))] == want and 10 < len(fps) - len(set(want)) < 60
