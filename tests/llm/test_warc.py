from __future__ import annotations

import gzip
import hashlib
import uuid

import pytest

from echotide.llm import warc

PAGES = "page_id bigint, url string, html string, digest string, payload int"


@pytest.fixture(scope="module")
def rows():
    big, other = "<p>é</p>\r\n\r\n" * 200, "x" * 1000
    out = [(k, f"http://a/{k}\r\nX: 1", big) for k in range(5)] + [(9, "u", other), (3, "v", other), (7, None, "y" * 999), (8, "", "y" * 999)]
    return out + [(20, "n", None), (21, "n", ""), (None, "q", other), (4, "http://a/4\r\nX: 1", big), (30, "z", "\x00퟿" * 40000)]


def brute(rows):
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        to = best.get(h) if len(data) >= 1000 else None
        to = None if to == i else to
        out.append((str(i), u or "", len(data), hashlib.sha1(data).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll_bytes", [64 << 20, 300])
def test_round_trip(spark, tmp_path, rows, roll_bytes):
    table = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES).repartition(3)
    names = []
    for _ in range(2):  # equal files each time
        root = f"file://{tmp_path}/{uuid.uuid4().hex}"
        held = warc.write(table, root, roll_bytes=roll_bytes, range_rows=8).collect()
        names.append(sorted((r.file, r.bytes, r.sha256, r.records) for r in held))
    assert names[0] == names[1] and sum(r.records for r in held) == len(rows)
    got = warc.read(spark, root).collect()
    assert sorted(((str(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    by = {(str(i), u or "", h or "") for i, u, h in rows}
    assert all((str(r.page_id), r.url, bytes(r.payload).decode()) in by for r in got if r.record_type == "response")
    for r in held:
        data = gzip.open(f"{root.removeprefix('file://')}/{r.file}").read()
        assert data.count(b"WARC/1.1\r\n") == r.records


def test_damage_is_found(spark, tmp_path):
    data = warc.record(1, "u", b"abc", hashlib.sha1(b"other").hexdigest(), None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc._row(data, True)


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_equal_files_whatever_the_partitions(spark, tmp_path):
    """100,000 rows, twice, with other partitions of input and of shuffles: the same files, byte for byte."""
    table = spark.range(100_000).selectExpr("id * 7919 % 100003 AS page_id", "concat('u', id) AS url", "concat('p', id % 30000) AS html")
    held = []
    for parts in ("3", "11"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            root = f"file://{tmp_path}/{uuid.uuid4().hex}"
            rows = warc.write(table.repartition(int(parts)), root, revisit_from=0, range_rows=9000, roll_bytes=300_000).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        held.append([(r.file, r.first, r.last, r.records, r.bytes, r.sha256) for r in rows])
    assert held[0] == held[1] and sum(r[3] for r in held[0]) == 100_000 and len(held[0]) > 12
    assert sum(r[3] for r in held[0] if "part-000000" in r[0]) == 9000


def test_generations_and_damage(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    rows = lambda t: spark.createDataFrame([("a", "u", t), ("b", None, t), (None, "w", None)], "page_id string, url string, html string")
    warc.write(rows("one"), root)
    held = warc.write(rows("other"), root).collect()
    assert {r.file for r in held} == {"000001/part-000000-00000.warc.gz"}
    got = warc.read(spark, root, id_type="string")
    assert {(r.page_id, bytes(r.payload).decode()) for r in got.collect()} == {("a", "other"), ("b", "other"), (None, "")}
    path = f"{root.removeprefix('file://')}/{held[0].file}"
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data + gzip.compress(warc.record("c", "u", b"", hashlib.sha1(b"").hexdigest(), None, "2024-01-01T00:00:00Z")))
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, root, id_type="string").collect()


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "date"])
def test_ids_of_other_types(spark, kind):
    table = spark.range(1, 40).selectExpr(f"CAST({'date_add(DATE 2020-01-01, int(id))' if kind == 'date' else 'id'} AS {kind}) AS page_id".replace("DATE 2020-01-01", "DATE'2020-01-01'"), "'u' AS url", "repeat('x', 1000) AS html")
    got = warc.archive(table, range_rows=7)
    assert got.schema["page_id"].dataType == table.schema["page_id"].dataType and got.count() == 39
    top = table.selectExpr("max(page_id) AS m").first().m
    assert {r.refers_to for r in got.collect()} == {None, top}
