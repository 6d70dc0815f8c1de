import gzip
import hashlib
import random

import pytest

from weekcast.llm import warc


def test_chunked_framing_round_trip():
    for body in (b"", b"x", b"0\r\n\r\n", b"ab" * 5000):
        assert warc.dechunked(warc.chunked(body, 7)) == body
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_cut_finds_records_whatever_the_payload_holds():
    rng = random.Random(3)
    bodies = [b"\r\n\r\n", b"x\r\n\r\nWARC/1.1\r\n\r\n", b"", b"end\r\n"] + [bytes(rng.choice(b"\r\na") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    raw = b"".join(x + warc.END for n, b in enumerate(bodies) for x in warc.records(f"urn:{n}", n, "u", "d", None, b, 50))
    for size in (None, 1):
        pieces = raw.split(warc.END) if size is None else raw.split(warc.END)
        found = list(warc.cut(iter(pieces[:-1])))
        whole = {}
        for r in found:
            whole.setdefault(r["origin"] or r["record_id"], []).append((r["segment"] or 1, r["block"]))
        assert [warc.payload_of(b"".join(b for _, b in sorted(whole[f"urn:{n}"]))) for n in range(len(bodies))] == bodies


def expected(rows):
    newest, out = {}, []
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= warc.REVISIT_BYTES and page is not None:
            newest[body] = max(newest.get(body, page), page)
    for page, url, html in rows:
        body = (html or "").encode()
        of = newest.get(body)
        revisit = of is not None and of != page
        out.append((page, url, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", of if revisit else None))
    return sorted(map(str, out))


def test_round_trip_of_edge_rows(spark):
    long = "é漢\r\n\r\n" * 20_000
    rows = [
        (1, "u1", "short"), (2, "u2", "short"), (3, None, None), (4, " u\n4%20 ", ""), (5, "u5", "a" * 1000), (6, "u6", "a" * 1000), (7, "u7", "b" * 999), (8, "u8", "b" * 999),
        (9, "u9", long), (10, "u10", long), (None, "u", "a" * 1000), (None, "v", "c" * 2000), (6, "u6", "a" * 1000), (11, "é ü", "\r\n0\r\n\r\n" * 300),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive(df).collect()
    assert sorted(str((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == expected(rows)
    assert warc.archive(df.limit(0)).count() == 0


def test_archives_are_warc_and_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "x" * 9000), (2, "http://b/", "y")], "page_id long, url string, html string")
    warc.write(df.coalesce(1), str(tmp_path / "w"), segment_bytes=2000)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(warc.END) and raw.count(b"WARC-Type: continuation") >= 4
    whole = {r.page_id: r.payload for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert whole == {"1": bytearray(b"x" * 9000), "2": bytearray(b"y")}
    # without its third segment the record has no payload
    at = raw.index(b"WARC-Segment-Number: 3")
    start, end = raw.rindex(b"WARC/1.1", 0, at), raw.index(b"WARC/1.1", at)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part.txt.gz").write_bytes(gzip.compress(raw[:start] + raw[end:]))
    whole = {r.page_id: r.payload for r in warc.read(spark, str(tmp_path / "d")).collect()}
    assert whole == {"1": None, "2": bytearray(b"y")}
    # without its first one it is still there, named by the origin of the others
    at = raw.index(b"WARC-Segment-Number: 1")
    start, end = raw.rindex(b"WARC/1.1", 0, at), raw.index(b"WARC/1.1", at)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "part.txt.gz").write_bytes(gzip.compress(raw[:start] + raw[end:]))
    rows = {r.page_id: r for r in warc.read(spark, str(tmp_path / "f")).collect()}
    assert set(rows) == {None, "2"} and rows[None].payload is None and rows[None].kind == "response" and rows[None].record_id
