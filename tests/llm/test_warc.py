import hashlib

from pyspark.sql import functions as F

from cinderlake.llm import warc

LONG = "<p>é " + "x" * 200
ROWS = [(5, "http://a/ b\r\nX-Evil: 1", LONG), (2, None, LONG), (9, "http://c", LONG), (2, "http://z", LONG), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", LONG), (8, "u", "WARC-Type: revisit\r\n\r\n" * 9)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, n int").repartition(3)


def test_contract(spark):
    got = warc.op2_warc(pages(spark)).collect()
    assert len(got) == len(ROWS) and all(r["verified"] for r in got)
    digest = hashlib.sha256(LONG.encode()).hexdigest()
    same = [r for r in got if r["payload_digest"] == digest]
    assert len(same) == 5 and all(r["payload_bytes"] == len(LONG.encode()) for r in same)
    assert [r["page_id"] for r in same if r["record_type"] == "response"] == [2]
    assert all(r["refers_to"] == 2 for r in same if r["record_type"] == "revisit")
    assert {r["page_id"]: r["record_type"] for r in got if r["page_id"] in (3, 4, 6, 7, 8)} == dict.fromkeys((3, 4, 6, 7, 8), "response")


def test_round_trip(spark):
    archive = warc.write_archive(pages(spark))
    assert spark.read.parquet(archive.payloads).count() == 4
    records = warc.record_bytes(warc.read_records(spark, archive)).collect()
    assert len(records) == len(ROWS)
    for r in records:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert head.startswith(b"WARC/1.1\r\n") and rest[len(block) :] == b"\r\n\r\n" and b"X-Evil" not in fields
        if fields[b"WARC-Type"] == b"response":
            assert hashlib.sha256(block).hexdigest().encode() == fields[b"WARC-Payload-Digest"][7:]
        else:
            assert block == b"" and b"WARC-Refers-To" in fields
    ids = [bytes(r["record"]).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for r in records]
    assert len(set(ids)) == len(ids)


def test_damage_is_seen(spark):
    records = warc.read_records(spark, warc.write_archive(pages(spark)))
    damaged = records.withColumn("block", F.when(F.col("header").contains("X-Page-ID: 3\r"), F.lit("shorx").cast("binary")).otherwise(F.col("block")))
    assert [r["page_id"] for r in warc.parse_records(damaged).where("not verified").collect()] == [3]


def test_empty(spark):
    assert warc.op2_warc(pages(spark).where("false")).count() == 0


def test_damaged_response_of_revisits(spark, monkeypatch):
    """Revisits are verified by the record that they refer to."""
    read = warc.read_records
    damage = lambda s, a: read(s, a).withColumn("block", F.when(F.length("block") > 100, F.concat("block", F.lit("x").cast("binary"))).otherwise(F.col("block")))
    monkeypatch.setattr(warc, "read_records", damage)
    bad = warc.op2_warc(pages(spark)).where("not verified").collect()
    assert {r["record_type"] for r in bad} == {"response", "revisit"} and len(bad) == 6
