import hashlib
import random

from marlstone.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    by = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            by[b] = max(by.get(b, i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        first = by.get(b)
        again = first is not None and i != first
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def case():
    rng = random.Random(1)
    big = ["é" * 500, "x" * 999, "y" * 1000, "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 60, "z" * 200_000]
    rows = [(i, f"http://H{rng.randrange(4)}.Example.com:80/p{rng.randrange(3)}?b=2&a=1", rng.choice([*big, None, "", "small", f"own {i} " * 300])) for i in range(300)]
    rows += [(None, None, big[0]), (None, "http://a/\r\nb", "n"), (5000, "http://[bad", big[2]), (5000, "not a url", big[2]), (-7, "", "q" * 2000), (-7, "", "q" * 2000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


def test_round_trip_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200_000)
    rows = case()
    path = f"file://{tmp_path}/w"
    out = warc.captures(frame(spark, rows).repartition(3), path).collect()
    key = lambda r: tuple(x if x is not None else -99 for x in r)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert [warc.order_of(tuple(r)) for r in out] == sorted(warc.order_of(tuple(r)) for r in out)
    archives = {r.archive for r in out}
    assert len(archives) > 3
    # Each capture lies where the index says.
    import gzip
    from urllib.parse import urlparse

    for r in out[:40]:
        with gzip.open(urlparse(r.archive).path) as f:
            f.seek(r.offset)
            assert f.read(r.length).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())


def test_all_null_ids_and_empty_table(spark, tmp_path):
    rows = [(None, None, "p" * 1500), (None, "u", "p" * 1500)]
    out = warc.captures(frame(spark, rows)).collect()
    assert [(r.record_type, r.refers_to) for r in out] == [("response", None)] * 2
    assert warc.captures(frame(spark, []).limit(0)).collect() == []


def test_loser_tree_merges_any_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_plain_archives_and_members():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n"
    assert [r["offset"] for r in warc.parse(one * 3)] == [0, len(one), 2 * len(one)]
    assert len(list(warc.parse(gzip.compress(one) + gzip.compress(one)))) == 2
    assert list(warc.parse(b"")) == []


def test_url_keys():
    assert warc.url_key("HTTP://B.a.Org:80/X?q=2&p=1#f") == "org,a,b)/x?p=1&q=2"
    assert warc.url_key("https://a.org:8443") == "org,a:8443)/"
    assert warc.url_key(None) == ""
