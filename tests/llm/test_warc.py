import base64
import gzip
import hashlib

from vigil.llm import warc
from vigil.llm._shared import scratch_path

SCHEMA = "page_id long, url string, html string, payload string, first_id string, n string"
ROWS = [(3, "http://a/", "<p>x\r\n\r\ny"), (1, "http://b/\r\nX: y", "<p>x\r\n\r\ny"), (2, None, None), (7, "u", ""),
        (5, "u", "\u00e9" * 70_000), (6, "u", "WARC/1.1\r\n"), (None, "u", "n"), (9, "u", "n"), (8, "u", "<p>x\r\n\r\ny"),
        (10, "u", "t"), (10, "u", "t")]


def brute(rows, least=0):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for p, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        for i in ids:
            again = i != first and first is not None and len(p) >= least
            out.append((i, len(p), d, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def run(spark, rows, least=0, **k):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    path = scratch_path(spark, "test-warc")
    warc.write_archives(df, path, least, **k)
    return path, sorted(map(tuple, warc.resolve(warc.read_archives(spark, path)).collect()), key=str)


def test_against_brute_force(spark):
    assert run(spark, ROWS)[1] == brute(ROWS)
    assert run(spark, ROWS, 5, compression="none")[1] == brute(ROWS, 5)


def test_empty_table(spark):
    assert run(spark, [])[1] == []


def test_payloads_come_back(spark):
    path, _ = run(spark, ROWS)
    got = warc.read_archives(spark, path, with_payload=True).where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in got} == {h or "" for _, _, h in ROWS}


def test_multi_member_gzip():
    rec = (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n")
    got = list(warc.parse_records(gzip.compress(rec) + gzip.compress(rec)))
    assert [b for _, b in got] == [b"abcd", b"abcd"]
    assert [b for _, b in warc.parse_records(rec * 3)] == [b"abcd"] * 3


def test_whole_table(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op8_warc_revisits(spark, sf001).collect()), key=str) == brute(rows)
