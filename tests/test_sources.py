import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quillsieve.operators import telemetry
from quillsieve.sources import cdxj, download, text

LINES = [
    'com,example)/ 20240222000000 {"url":"http://example.com/","status":"200","mime":"text/html"}',
    'com,example)/a 20240222000001 {"status":"404"}',
    'com,example)/b 20240222000002 {"url":""}',
    "com,example)/c 20240222000003 {bad json",
    "onlytwo parts",
    "",
    'com,example)/d 20240222000004 [1,2]',
    'com,example)/e 20240222000005 {"url":"u"} trailing',
]


def parsed(spark):
    return cdxj.parse(spark.createDataFrame([(k, x) for k, x in enumerate([*LINES, None])], "id int, value string"))


def test_cdxj(spark):
    rows = {r.id: r for r in parsed(spark).collect()}
    assert [rows[k].is_valid for k in range(9)] == [True, True, True, False, False, False, False, False, False]
    assert rows[0].url == "http://example.com/" and rows[1].status == "404" and rows[1].mime is None
    assert [r.url for r in cdxj.urls(parsed(spark)).collect()] == ["http://example.com/"]
    assert {r.status: r.n for r in cdxj.top_values(parsed(spark), "status").collect()} == {"200": 1, "404": 1, "Unknown": 1}


def test_quality(spark):
    q = cdxj.quality(parsed(spark)).first()
    assert (q.valid, q.corrupted) == (3, 6)
    assert cdxj.quality(parsed(spark), sample_size=100).first().valid_pct == 3.0
    assert cdxj.quality(parsed(spark).limit(0)).first().valid_pct == 0.0
    assert spark.range(1).select(cdxj.outcome(F.lit(6), F.lit(9))).first()[0] == "WARNING"
    assert spark.range(1).select(cdxj.size_warning(F.lit(5))).first()[0]


def test_url_files(spark, tmp_path):
    cdxj.write_urls(parsed(spark), str(tmp_path / "u"), limit=5)
    assert [r.value for r in spark.read.text(str(tmp_path / "u")).collect()] == ["http://example.com/"]


def test_lines(spark, tmp_path):
    with gzip.open(tmp_path / "x.txt.gz", "wt") as f:
        f.write(" a\t\n\n\t \nb\nc\n")
    assert sorted(r.value for r in text.scan_lines(spark, str(tmp_path / "x.txt.gz")).collect()) == ["a", "b", "c"]
    assert text.scan_lines(spark, str(tmp_path / "x.txt.gz"), 2).count() == 2
    split = text.read_split(spark, str(tmp_path / "x.txt.gz"), 2, 2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.value, r.is_present) for r in split] == [(0, "a", True), (1, "", True), (2, "", False), (3, "b", False)]


def test_checksum(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    row = text.file_checksums(spark, str(tmp_path / "f"))
    assert row.first().sha256 == digest
    assert row.select(text.checksum_matches(F.col("sha256"), digest.upper())).first()[0]
    assert not row.select(text.checksum_matches(F.col("sha256"), digest.upper(), exact_case=True)).first()[0]


def test_telemetry(spark, tmp_path):
    missing = telemetry.read_runs(spark, str(tmp_path / "none"))
    assert missing.count() == 0
    runs = spark.createDataFrame([("a", "insert", "wall", 1, 10, 0, 1.0), ("b", "insert", "wall", 1, 10, 0, 2.0)], telemetry.RUNS)
    telemetry.write_runs(runs, str(tmp_path / "r"))
    newer = spark.createDataFrame([("b", "insert", "wall", 1, 10, 0, 3.0)], telemetry.RUNS)
    merged = telemetry.merge_runs(telemetry.read_runs(spark, str(tmp_path / "r")), newer)
    assert {r.architecture: r.seconds for r in merged.collect()} == {"a": 1.0, "b": 3.0}


def test_fetch(spark, tmp_path):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    (tmp_path / "from").mkdir()
    raw = gzip.compress(("\n".join(LINES) + "\n").encode() * 1000)
    (tmp_path / "from/lines.gz").write_bytes(raw)
    handler = type("Quiet", (SimpleHTTPRequestHandler,), {"log_message": lambda *a: None})
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(handler, directory=str(tmp_path / "from")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, right = f"http://127.0.0.1:{server.server_port}/lines.gz", hashlib.sha256(raw).hexdigest()
    try:
        with pytest.raises(ValueError, match="SHA-256"):
            download.fetch(spark, url, f"{tmp_path}/to/lines.gz", "0" * 64)
        assert not list((tmp_path / "to").glob("[!.]*"))
        assert download.fetch(spark, url, f"{tmp_path}/to/lines.gz", right.upper())
        assert not download.fetch(spark, url, f"{tmp_path}/to/lines.gz", right)
        assert (tmp_path / "to/lines.gz").read_bytes() == raw
        assert text.scan_lines(spark, f"{tmp_path}/to/lines.gz").count() == 7 * 1000
        with pytest.raises(Exception, match="FileNotFound|404"):
            download.fetch(spark, url + "x", f"{tmp_path}/to/none")
    finally:
        server.shutdown()
