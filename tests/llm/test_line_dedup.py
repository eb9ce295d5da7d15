import random

import pytest
import xxhash

from marlstone.llm import line_dedup as op

DOCS = "doc_id long, text string, spans string"


def ordered(rows):
    """The distinct documents in the operator's order: id (none last), then hash of the text."""
    signed = lambda t: (h - (1 << 64) if h >> 63 else h) if (h := xxhash.xxh64_intdigest(t.encode(), 42)) is not None and t is not None else 0
    return sorted({(i, t) for i, t in rows}, key=lambda d: (d[0] is None, d[0] or 0, signed(d[1]) if d[1] is not None else 0))


def plain(rows, least=30):
    """For each document the lines in a common block with any earlier document: all pairs, all places, by the definition."""
    docs = ordered(rows)
    lines = [[x.strip() for x in (t or "").split("\n") if x.strip()] for _, t in docs]
    words = [[len(x.split()) for x in own] for own in lines]
    gone = [set() for _ in docs]
    partners = [set() for _ in docs]
    for d in range(len(docs)):
        at = {}
        for i, x in enumerate(lines[d]):
            at.setdefault(x, []).append(i)
        for e in range(d):
            ends = {}  # lines of the common block that ends at (i, j)
            for j, x in enumerate(lines[e]):
                now = {}
                for i in at.get(x, ()):
                    now[i] = ends.get(i - 1, 0) + 1
                last = lines[e][j + 1] if j + 1 < len(lines[e]) else None
                for i, n in now.items():
                    longest = i + 1 == len(lines[d]) or lines[d][i + 1] != last
                    if longest and sum(words[d][i - n + 1 : i + 1]) >= least:
                        gone[d].update(range(i - n + 1, i + 1))
                        partners[d].add(docs[e][0])
                ends = now
    return {doc: (own, g, p) for doc, own, g, p in zip(docs, lines, gone, partners, strict=True)}


def left_over(text, gone):
    out, n = [], 0
    for line in text.split("\n"):
        if not line.strip():
            out.append(line)
            continue
        if n not in gone:
            out.append(line)
        n += 1
    return "\n".join(out)


def case():
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(3000)
    line = lambda n: " ".join(word() for _ in range(n))
    boiler = [line(5) for _ in range(3)] + ["-", "é"]
    passages = [[line(rng.randrange(4, 40)) for _ in range(rng.randrange(2, 6))] for _ in range(8)]
    rows = [(None, "one\ntwo"), (0, None), (1, ""), (2, " \n\t\n"), (3, line(60))]
    for i in range(4, 120):
        own = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            own += rng.choice(passages) if kind < 0.4 else [rng.choice(boiler)] if kind < 0.7 else [line(rng.randrange(1, 50))]
            if rng.random() < 0.2:
                own.append("")
        rows.append((i, "\n".join(own)))
    rows += [(i + 500, rows[20][1]) for i in range(60)]  # copies
    rows += [(600 + i, rows[30][1] + f"\nown {i}") for i in range(40)]  # near copies
    rows += [(30, rows[30][1]), (30, rows[30][1]), (30, rows[31][1] + "\nmore"), (None, rows[40][1]), (None, rows[41][1])]
    rows += [(700, "\n".join(["same line again and again of ten words it is"] * 200)), (701, "\n".join(["same line again and again of ten words it is"] * 150))]
    rows += [(702, "\n".join(line(3) for _ in range(1000))), (703, line(20_000) + "\n  " + rows[20][1].replace("\n", " \r\n\n "))]
    for i in range(800, 860):  # few different lines in every order: moved, repeated and crossing passages
        rows.append((i, "\n".join(rng.choice(passages[0] + passages[1] + boiler) for _ in range(rng.randrange(1, 30)))))
    return rows


def numbered(n, words=12, tag="l"):
    return [" ".join(f"{tag}{k}x{w}" for w in range(words)) for k in range(n)]


def removed(spark, rows):
    return {r.doc_id: r for r in op.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_report_against_all_pairs(spark):
    rows = case()
    want = plain(rows)
    assert sum(1 for _, g, _ in want.values() if g) > 150
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS).repartition(4)
    got = op.report(df).collect()
    assert len(got) == len(rows)
    shape = lambda i, n, gone, words, text: (str(i), n, gone, words, text)
    found = sorted((shape(r.doc_id, r.n_lines, tuple(x for s in r.spans for x in range(*s)), r.words_removed, r.kept_text) for r in got), key=str)
    told = []
    for i, t in rows:
        own, gone, _ = want[i, t]
        told.append(shape(i, len(own), tuple(sorted(gone)), sum(len(own[x].split()) for x in gone), left_over(t, gone) if gone else t))
    assert found == sorted(told, key=str)
    # Every block lies in the partner that it names, has enough words, and comes from an earlier document.
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([x.strip() for x in (t or "").split("\n") if x.strip()])
    for r in got:
        for b in r.blocks:
            assert any(any(own[b.start : b.end] == e[b.partner_start : b.partner_start + b.end - b.start] for e in texts[b.partner]) for own in texts[r.doc_id])
            assert r.doc_id is None or b.partner is not None and b.partner <= r.doc_id
        assert set(r.partners) == {b.partner for b in r.blocks}


def test_exact_copies_go_though_an_earlier_document_has_the_lines_in_another_order(spark):
    lines = numbered(8, 14)
    got = removed(spark, [(1, "\n".join(lines[::-1])), (2, "\n".join(lines)), (3, "\n".join(lines))])
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 0, 8]
    apart = [x for k, y in enumerate(numbered(6)[::-1]) for x in (y, f"between {k}")]
    got = removed(spark, [(1, "\n".join(apart)), (2, "\n".join(numbered(6))), (3, "\n".join(numbered(6)))])
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 0, 6]


def test_blocks_are_those_of_one_pair(spark):
    a, b, c, d = numbered(4, 9)
    got = removed(spark, [(1, f"{a}\n{b}"), (2, f"{c}\n{d}"), (3, f"{a}\n{b}\n{c}\n{d}")])
    assert got[3].n_removed == 0
    got = removed(spark, [(1, f"{a}\n{b}\n{c}"), (2, f"{b}\n{c}\n{d}"), (3, f"{a}\n{b}\n{c}\n{d}")])  # 27 words each
    assert got[3].n_removed == 0


def test_repeated_and_moved_passages(spark):
    a, b, c = numbered(3, 20)
    got = removed(spark, [(1, f"{a}\n{b}\n{c}"), (2, f"{b}\nown words\n{a}\n{b}\n{c}")])
    assert [tuple(s) for s in got[2].spans] == [(2, 5)]
    p, q = numbered(3, 20, "p"), numbered(4, 18, "q")
    got = removed(spark, [(1, "\n".join([*p, "x", *q])), (2, "\n".join([*q, "y", *p]))])
    assert [tuple(s) for s in got[2].spans] == [(0, 4), (5, 8)]


@pytest.mark.parametrize("n", [99, 100, 101, 150])
def test_how_many_documents_hold_a_passage_changes_nothing(spark, n):
    passage = "\n".join(numbered(4, 10))
    got = removed(spark, [(i, f"own {i}\n{passage}\nend {i}") for i in range(n)])
    assert [got[i].n_removed for i in range(n)] == [0] + [4] * (n - 1)


def test_remove_keeps_columns_and_drops_emptied_rows(spark):
    rows = case()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)
    want = plain(rows)
    out = op.remove(df)
    assert out.schema == df.schema
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    told = [(i, left_over(t, g) if (g := want[i, t][1]) else t) for i, t in rows]
    assert left == sorted(((i, t) for (i, t), row in zip(told, rows, strict=True) if not want[row][1] or t.strip()), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert op.report(df).collect() == [] and op.remove(df).collect() == []


def test_patience_orders_by_anchors():
    assert op.increasing([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    moved = [(0, 10, True), (1, 11, True), (2, 0, True), (3, 11, False), (4, 12, True)]
    assert op.patience(moved) == [(0, 10), (1, 11), (4, 12)]
    assert op.patience([(0, 3, False), (1, 4, False)]) == [(0, 3), (1, 4)]
    assert op.patience([]) == []


def test_runs_cover_every_block():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.randrange(1, rng.choice((3, 12, 40))) for _ in range(rng.randrange(0, 25))]
        runs = op.runs_of(words)
        assert all(sum(words[i:j]) >= op.MIN_WORDS for i, j in runs)
        for x in range(len(words)):
            for y in range(x + 1, len(words) + 1):
                if sum(words[x:y]) >= op.MIN_WORDS:
                    assert {k for i, j in runs if x <= i and j <= y for k in range(i, j)} == set(range(x, y))
