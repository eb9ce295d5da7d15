import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import media as m

MEDIA = "id long, media binary, class_id string"


def picture(rng, side=96):
    coarse = rng.normal(size=(side // 4 + 3, side // 4 + 3))
    return m.decode(m.rendered(coarse.ravel(), side))


def edits(g, rng):
    """Cropped, brighter, dimmer, turned, noisy and smaller copies."""
    yield g[10:86, 6:90]
    yield np.clip(g * 1.1 + 8, 0, 255)
    yield g * 0.6
    yield np.rot90(g)
    yield np.clip(g + rng.normal(0, 1.5, g.shape), 0, 255)
    yield g[5:70, 20:]


def case(n=25):
    rng = np.random.default_rng(7)
    rows, group = [], {}
    for _ in range(n):
        g = picture(rng)
        first = len(rows)
        for x in (g, *edits(g, rng)):
            group[len(rows)] = first
            rows.append((len(rows), m.encode(np.rint(x)), "clash"))
    return rows, group


@pytest.fixture(scope="module")
def found(spark):
    rows, group = case()
    df = spark.createDataFrame(rows, MEDIA).repartition(3)
    return {r.id: r for r in m.copies(df, F.col("media")).collect()}, rows, group


def test_edited_copies_are_grouped_and_others_left_alone(found):
    got, rows, group = found
    together = sum(got[i].group_id == got[g].group_id for i, g in group.items()) / len(group)
    assert together >= 0.9
    assert all(group[got[i].group_id] == g for i, g in group.items())


def brute_links(images):
    """Pairs with enough agreeing corners, from comparing all descriptors of all images; motions and votes written out."""
    parts = [m.describe([g]) for g in images]
    bits = [np.unpackbits(p[5].view(np.uint8), axis=1).astype(np.float32) for p in parts]
    out = set()
    for j in range(len(images)):
        for i in range(j):
            apart = bits[i].sum(axis=1)[:, None] + bits[j].sum(axis=1)[None] - 2 * bits[i] @ bits[j].T
            votes = {}
            for p, q in zip(*np.nonzero(apart <= m.RADIUS), strict=True):
                (_, y, x, scale, turn, _), (_, v, u, zoom, spin, _) = ([c[k] for c in part] for part, k in ((parts[i], p), (parts[j], q)))
                t, z = int(spin - turn) % m.TURNS, int(zoom - scale)
                c, s = np.cos(2 * np.pi * t / m.TURNS) * 2.0**z, np.sin(2 * np.pi * t / m.TURNS) * 2.0**z
                dx, dy = (int(np.floor(2 * d / m.SHIFT)) for d in (u - (x * c - y * s), v - (x * s + y * c)))
                for k in range(4):
                    votes.setdefault((t, z, k, dx + (k & 1) >> 1, dy + (k >> 1) >> 1), set()).add(p)
            if any(len(v) >= m.VOTES for v in votes.values()):
                out.add((i, j))
    return out


def grouped(n, pairs):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(x) for x in range(n)]


def linked(spark, images):
    df = spark.createDataFrame([(k, m.encode(np.rint(np.clip(g, 0, 255)))) for k, g in enumerate(images)], "image long, media binary").repartition(3)
    return {(r.a, r.b) for r in m.links(m.corners(df)).collect()}


def test_groups_against_all_descriptors_of_all_images(spark, found):
    _, rows, _ = found
    images = [m.decode(r[1]) for r in rows]
    brute, got = brute_links(images), linked(spark, images)
    want, made = grouped(len(images), brute), grouped(len(images), got)
    assert len(got - brute) <= 0.02 * len(got)
    assert sum(made[a] == made[b] for a, b in brute) / len(brute) >= 0.9
    assert sum(want[a] == want[b] for a, b in got) / len(got) >= 0.98


def test_groups_over_a_common_background(spark):
    """Groups of 16 near copies over one background: its corners are in every picture, so buckets hold unrelated images too."""
    rng = np.random.default_rng(3)
    back = picture(rng, 128)
    images, group = [], []
    for k in range(4):
        own = picture(rng, 64)
        for _ in range(16):
            g = np.roll(back, int(rng.integers(0, 40)), axis=1) if k % 2 else back.copy()
            y, x = rng.integers(0, 64, 2)
            g[y : y + 64, x : x + 64] = own
            images.append(np.rint(np.clip(g + rng.normal(0, 0.5, g.shape), 0, 255)))
            group.append(k)
    order = rng.permutation(len(images))
    images = [images[k] for k in order]
    brute, got = brute_links(images), linked(spark, images)
    want, made = grouped(len(images), brute), grouped(len(images), got)
    assert len(brute) > 16 * 15 * 2
    assert sum(made[a] == made[b] for a, b in brute) / len(brute) >= 0.9
    assert sum(want[a] == want[b] for a, b in got) / len(got) >= 0.98


def test_meeting_in_batches_is_meeting_at_once():
    rng = np.random.default_rng(0)
    n = 400
    key = np.sort(rng.integers(0, 12, n)) * (np.arange(n) > 100)
    d1 = rng.integers(0, 4, n)
    col = {"table": np.zeros(n, dtype=np.int32), "image": np.arange(n), "corner": np.zeros(n, dtype=np.int32), "place": np.zeros(n, dtype=np.int64), "d0": key, "d1": d1}
    order = np.lexsort((col["image"], d1, key))
    table = pa.table({k: c[order] for k, c in col.items()})
    want = set()
    for k in np.unique(key):
        own = [int(x) for x in order if key[x] == k]
        for j, y in enumerate(own):
            first = next(x for x in own if d1[x] == d1[y])
            met = own[:j] if j < m.MEET else [*own[j - m.NEAR : j], first]
            want |= {(min(x, y), max(x, y)) for x in met if x != y}
    for size in (1, 7, 50, 400):
        assert {(a, b) for x in m._meet(iter(table.to_batches(max_chunksize=size))) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)} == want


def test_odd_media(spark):
    rows = [(1, None, "x"), (2, None, "x"), (3, b"", "x"), (4, b"", "x"), (5, b"P5 9 9 255\nshort", "x"), (6, b"P5 2 2 255\n\x00\x01\x02\x03", "x")]
    rows += [(None, b"P5 2 2 255\n\x00\x01\x02\x03", "x"), (6, b"P5 2 2 255\n\x00\x01\x02\x03", "x"), (7, m.encode(np.full((80, 80), 9)), "x")]
    got = m.copies(spark.createDataFrame(rows, MEDIA), F.col("media")).collect()
    assert sorted((r.id or 0, r.class_id, r.group_id, r.n_classes) for r in got) == [
        (0, 6, 6, 1), (1, 1, 1, 1), (2, 2, 2, 1), (3, 3, 3, 1), (4, 3, 3, 1), (5, 5, 5, 1), (6, 6, 6, 1), (6, 6, 6, 1), (7, 7, 7, 1),
    ]
    assert m.copies(spark.createDataFrame([], MEDIA), F.col("media")).collect() == []


def test_large_group_of_copies_holds_together(spark):
    rng = np.random.default_rng(1)
    g = picture(rng)
    rows = [(i, m.encode(np.rint(np.clip(g + rng.normal(0, 0.7, g.shape), 0, 255))), "x") for i in range(60)]
    got = m.copies(spark.createDataFrame(rows, MEDIA), F.col("media")).collect()
    assert {r.group_id for r in got} == {0}


def test_pixmaps_and_vectors():
    rgb = b"P6 # note\n2 1 255\n" + bytes([255, 255, 255, 0, 0, 0])
    assert np.allclose(m.decode(rgb), [[255, 0]], atol=0.1)
    assert m.rendered(None) is None and m.decode(m.rendered([0.0, float("nan"), 1.0])).shape == (64, 64)
    assert m.decode(m.rendered([1.0])).shape == (64, 64)


def test_no_link_of_a_large_bucket_is_left_out(spark, monkeypatch):
    """Four corners that all images have in buckets of 240 rows, most of which aren't next to their own copies' in any order."""
    monkeypatch.setattr(m, "PART", 700)
    monkeypatch.setattr(m, "TREE", 200)
    monkeypatch.setattr(m, "MEETINGS", 500)
    rng = np.random.default_rng(11)
    rows = []
    plain = rng.integers(0, 1 << 62, (4, 2))
    for i in range(240):
        place = np.random.default_rng(1000 + i % 120).integers(0, 4000, (4, 2)) / 4
        for k in range(4):
            d = plain[k].copy()
            for bit in rng.integers(0, 24, 3):
                d[0] ^= 1 << int(bit)
            d[1] ^= 1 << int(rng.integers(0, 24))
            at = m.packed(y=place[k : k + 1, 0], x=place[k : k + 1, 1], scale=np.zeros(1, int), turn=np.zeros(1, int))
            rows.append((i, k, int(at[0]), int(d[0]), int(d[1])))
    found = spark.createDataFrame(rows, m._CORNERS).repartition(3)
    made = grouped(240, {(r.a, r.b) for r in m.links(found).collect()})
    assert all(made[i] == made[i + 120] for i in range(120)) and len(set(made)) > 100


def test_cells_of_any_size_tell_what_all_corners_tell(spark, monkeypatch):
    images = [m.decode(r[1]) for r in case(6)[0]]
    found = m.corners(spark.createDataFrame([(k, m.encode(np.rint(g))) for k, g in enumerate(images)], "image long, media binary")).toArrow()
    col = {n: np.asarray(found.column(n)).astype(np.int64) for n in found.column_names}
    order = np.lexsort((col["corner"], col["image"]))
    col = {n: c[order] for n, c in col.items()} | {"label": col["image"][order], "own": col["image"][order] % 2}
    every = [(a, b) for a in range(len(col["image"])) for b in range(a) if col["image"][a] != col["image"][b] and m._apart(col, a, b) <= m.RADIUS and any(m.key_of(np.int64(t), col["d0"][a], col["d1"][a]) == m.key_of(np.int64(t), col["d0"][b], col["d1"][b]) for t in range(m.TABLES))]
    a, b, vote = m._motions(col, *np.array(every).T)
    order = np.lexsort((vote, b, a))
    want = set(zip(*(x.tolist() for x in m._voted(a[order], b[order], vote[order], m.VOTES)[:2]), strict=True))
    assert len(want) > 20
    for tree, meetings in ((1 << 16, 1 << 20), (60, 30)):
        monkeypatch.setattr(m, "TREE", tree)
        monkeypatch.setattr(m, "MEETINGS", meetings)
        got = []
        for part, other in ((0, 0), (0, 1), (1, 1)):
            own = {n: c[(col["own"] == part) | (col["own"] == other)] for n, c in col.items()}
            own["nth"] = np.cumsum(m._new(own["image"]))
            for x in m._cell(own, own["own"] == other, own["own"] == part, part == other, m.VOTES):
                got += zip(*(c.tolist() for c in x), strict=True)
        assert set(got) <= want and grouped(len(images), got) == grouped(len(images), want)


def test_few_meetings_of_plain_patterns_are_compared(monkeypatch):
    """Unrelated images with corners of the same few patterns, and one copy: meetings are counted, those of likely pairs are compared."""
    rng = np.random.default_rng(11)
    images, each = 120, 30
    n = images * each
    pattern = rng.integers(0, 60, n)
    d0, d1 = (rng.integers(0, 1 << 30, n) << 32) + pattern, rng.integers(0, 1 << 62, n)
    turn, y, x = rng.integers(0, m.TURNS, n), rng.integers(8, 56, n), rng.integers(8, 56, n)
    for c in (pattern, d0, d1, turn, y, x):
        c[-each:] = c[:each]
    image = np.repeat(np.arange(images), each)
    col = {"image": image, "label": image, "corner": np.tile(np.arange(each), images), "place": m.packed(y=y, x=x, scale=np.zeros(n), turn=turn), "d0": d0, "d1": d1, "nth": image + 1}
    compared = []
    count = np.bitwise_count
    monkeypatch.setattr(m.np, "bitwise_count", lambda v: compared.append(len(v)) or count(v))
    every = np.ones(n, dtype=bool)
    got = [p for a, b in m._cell(col, every, every, True, m.AGREED, m.SHARE) for p in zip(a.tolist(), b.tolist(), strict=True)]
    meetings = sum(k * (k - 1) // 2 for k in np.bincount(pattern).tolist())
    assert got == [(0, images - 1)]
    assert 0 < sum(compared) < 0.1 * meetings
