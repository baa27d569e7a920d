import hashlib
import zlib

import pytest

from topicwright.llm import ogg, warc


def plain_crc(data):
    """Bit by bit."""
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.checksum(data) == plain_crc(data)


def test_packets_across_pages_and_streams():
    big = bytes(range(256)) * 300
    lacing = ogg.lace(len(big))
    a1 = ogg.page(7, 0, -1, ogg.FIRST, lacing[:255], big[: 255 * 255])
    b = ogg.page(9, 0, 5, ogg.FIRST | ogg.LAST, ogg.lace(3) + ogg.lace(0) + ogg.lace(255), b"xyz" + b"q" * 255)
    a2 = ogg.page(7, 1, 900, ogg.CONTINUED | ogg.LAST, lacing[255:] + ogg.lace(2), big[255 * 255 :] + b"hi")
    found = ogg.read(a1 + b + b"junk OggS junk" + a2)
    assert found.streams[7].packets == [big, b"hi"] and found.streams[9].packets == [b"xyz", b"", b"q" * 255]
    assert found.streams[7].ends(lambda p: 100) == [800, 900] and found.streams[7].ended and found.damaged == 1
    broken = bytearray(a1 + b + a2)
    broken[100] ^= 1
    found = ogg.read(bytes(broken))
    assert found.damaged >= 1 and found.streams[7].packets == [b"hi"] and found.streams[9].packets[0] == b"xyz"
    assert ogg.read(a2 + a1).streams[7].packets == [b"hi"]


def test_samples_round_trip_and_damage():
    for n in (1, 85, 86, 400):
        payload = bytes(k * 7 % 256 for k in range(ogg.FRAME * n))
        media = ogg.store(payload)
        assert ogg.samples(ogg.read(media)) == (payload, len(payload) / ogg.RATE)
        assert media == ogg.store(payload)
    damaged = bytearray(media)
    damaged[len(media) // 2] ^= 4
    with pytest.raises(ValueError):
        ogg.samples(ogg.read(bytes(damaged)))


def test_media_columns(spark):
    texts = ["", None, "é" * 288, "a" * 576, "b" * 577, "long " * 40000, "\x00", "x", "x"]
    df = spark.createDataFrame([(k, t, b"clash", 1) for k, t in enumerate(texts)] + [(None, "x", b"", 1)], "doc_id long, text string, media binary, id int")
    rows = {r.doc_id: r for r in ogg.media_features(ogg.store_texts(df)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw) % 576) or (576 if not raw else 0))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(ogg.store(payload)).hexdigest() and r.media_bytes == len(ogg.store(payload))
    assert rows[7][1:] == rows[8][1:] == rows[None][1:] and rows[0][1:] == rows[1][1:]
    assert ogg.media_features(ogg.store_texts(df.limit(0))).count() == 0


def test_loser_tree():
    import random

    r = random.Random(1)
    for n in (0, 1, 2, 3, 7, 16):
        streams = [sorted((r.randrange(20), k, i) for i in range(r.randrange(6))) for k in range(n)]
        assert [x[0] for x in warc.LoserTree([iter(s) for s in streams])] == sorted(x[0] for s in streams for x in s)


def test_url_keys():
    assert warc.url_key("http://www.A.b:80/X?b=2&a=1#f") == "b,a)/X?a=1&b=2"
    assert warc.url_key("https://a.b:8443") == "b,a:8443)/" and warc.url_key(None) == "" and warc.url_key("no url") == "no%20url"


BIG = "x" * 1200
PAGES = [(1, "http://a.b/x", BIG), (2, "http://a.b/x", BIG), (5, None, BIG), (None, "http://c.d", BIG), (3, "http://[bad", None), (4, "u v", ""), (5, None, BIG), (-7, "https://a.b/q", "é" * 600), (8, "http://z.z/", "short"), (9, "http://z.z/", "short")]


def test_archives(spark):
    df = spark.createDataFrame([(*p, 1, "clash") for p in PAGES], "page_id long, url string, html string, digest int, file string").repartition(3)
    rows = warc.archive_round_trip(df).collect()
    assert len(rows) == len(PAGES)
    got = sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        revisit = len(data) >= 1000 and page is not None and page < max(same)
        want.append((repr(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=lambda x: x[:1]) or got == sorted(want)
    ordered = sorted(rows, key=lambda r: r.index_place)
    keys = [(r.url_key, r.captured) for r in ordered]
    assert keys == sorted(keys) and [r.index_place for r in ordered] == list(range(len(PAGES)))
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_merge_over_ranges(spark):
    df = spark.range(900).selectExpr("id as page_id", "concat('http://h', id % 7, '.org/', id * 37 % 900) as url", "concat('p', id) as html").repartition(5)
    folder = warc.new_folder(spark, "warc")
    runs = warc.write_archives(df, folder)
    rows = warc.merge_index(runs, folder, lines_per_range=100).collect()
    assert len(rows) == 900 and len({r.range_id for r in rows}) > 1
    ordered = sorted(rows, key=lambda r: (r.range_id, r.position))
    keys = [(r.url_key, r.captured, r.id) for r in ordered]
    assert keys == sorted(keys)


def test_many_runs_with_a_bounded_fan_in(spark, monkeypatch):
    """2,000 runs, 16 at a time: no merge reads more streams, and the order is that of one sort."""
    import random

    r = random.Random(1)
    folder = warc.new_folder(spark, "runs")
    files, blocks, everything = warc.SharedFiles(folder), [], []
    for k in range(2000):
        lines = sorted(([f"key{r.randrange(300):04d}", f"{r.randrange(50):014d}", 5 * k + j, f"f{k}", j, 1, "response", "d"] for j in range(5)), key=warc._sort_key)
        blocks += warc.write_run(files, f"r{k:05d}.run", f"r{k:05d}.run", f"f{k}", lines)
        everything += lines
    runs = spark.createDataFrame(blocks, warc.BLOCKS)
    made = warc.longer_runs(runs, folder, 16)
    assert made.select("run").distinct().count() == 125 and made.agg({"n_lines": "sum"}).first()[0] == 10_000
    monkeypatch.setattr(warc, "LoserTree", counted(warc.LoserTree, 16))
    monkeypatch.setattr(warc, "RANGE_LINES", 30)
    rows = warc.merge_index(runs, folder, lines_per_range=500, fan_in=16).collect()
    ordered = [(x.url_key, x.captured, x.id) for x in sorted(rows, key=lambda x: (x.range_id, x.position))]
    assert ordered == sorted((a, b, c) for a, b, c, *_ in everything) and len({x.range_id for x in rows}) > 5


def counted(tree, most):
    def make(streams):
        assert len(streams) <= most
        return tree(streams)

    return make


def test_damaged_archive():
    data = warc.record("response", 1, "u", b"body", "d", None) + warc.record("revisit", 2, "u\r\nX: y", b"", "d", 1)
    found = list(warc.records(data))
    assert [f[2]["WARC-Type"] for f in found] == ["response", "revisit"] and found[1][0] == found[0][1] and found[1][2]["WARC-Target-URI"] == "u X: y"
    with pytest.raises(ValueError):
        list(warc.records(data[:-5]))
