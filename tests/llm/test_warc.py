import base64
import hashlib
import zlib

import pytest

from larkspur.llm import warc as W

SF = "/root/testdata/sf0.01"


def brute(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        leader = best.get(h or "")
        again = leader is not None and leader != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                    "revisit" if again else "response", leader if again else None))
    return sorted(out, key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, W.query(spark, SF).collect()), key=repr) == brute(rows)


def test_round_trip_and_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 4)
    rows = [(k, f"http://h{k % 7}.example.org/p{k % 11}", f"<p>é {k % 13}</p>") for k in range(60)]
    rows += [(100, None, None), (101, "https://x.test/", ""), (None, "http://n.test/", "lonely"),
             (None, "http://h1.example.org/p1", "<p>é 1</p>"), (7, "http://dup.test/", "twice"), (7, "http://dup.test/", "twice"),
             (200, "http://bad[host/", "odd\r\nurl"), (201, "http://big.test/", "x" * 17_000_000)]
    df = spark.createDataFrame([(*r, "r") for r in rows], "page_id long, url string, html string, record_type string")
    W.archive(df, str(tmp_path))
    caps = W.all_captures(spark, f"{tmp_path}/index").collect()
    got = [(c.page_id, c.payload_bytes, c.payload_digest, c.record_type, c.refers_to) for c in caps]
    assert sorted(got, key=repr) == brute(rows)
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    some = [c.asDict() for c in caps if c.record_type == "response" and c.page_id is not None]
    assert W.fetch(spark, some) == [payload[c["page_id"]] for c in some]
    for url in ("http://h3.example.org/p5", "https://x.test/", "http://none.test/"):
        want = sorted((c.page_id, c.start) for c in caps if c.key == W.sort_key(url))
        assert sorted((c["page_id"], c["start"]) for c in W.lookup(spark, f"{tmp_path}/index", [url])) == want
        joined = W.lookup_join(spark, f"{tmp_path}/index", spark.createDataFrame([(url,)], "url string"))
        assert sorted((c.page_id, c.start) for c in joined.collect()) == want
    files = list((tmp_path / "archive").glob("part-*"))
    text = b"".join(zlib_all(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(rows)


def zlib_all(data):
    out = b""
    while data:
        z = zlib.decompressobj(31)
        out += z.decompress(data)
        data = z.unused_data
    return out


@pytest.mark.parametrize("url, key", [("http://m.site.org/a?b=1#x", "org,site,m)/a?b=1"), (None, ""),
                                      ("HTTPS://Site.ORG", "org,site)/"), ("http://s.org:8080/", "org,s:8080)/")])
def test_sort_key(url, key):
    assert W.sort_key(url) == key


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    W.archive(df, str(tmp_path))
    assert W.all_captures(spark, f"{tmp_path}/index").count() == 0
    assert W.lookup(spark, f"{tmp_path}/index", ["http://a.b/"]) == []
