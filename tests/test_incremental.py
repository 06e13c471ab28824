"""Runs that are repeated, that find new files, and that break off between their steps."""

import random

import pytest
from test_filings import instance

from quillon.sources.xbrl import parse_instances
from quillon.streaming import incremental


def put(folder, cik, accession, seed, name=None):
    (folder / (name or f"{cik}_{accession}.xml")).write_bytes(instance(random.Random(seed), 3))


def run(spark, source, out, **more):
    incremental.ingest(spark, str(source), str(out), **more).awaitTermination()


def filings(spark, out):
    return sorted((r.cik, r.accession, r.status) for r in incremental.ledger(spark, str(out)).collect())


def test_files_are_read_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(3):
        put(source, i, f"00{i}", i)
    run(spark, source, out, files_a_batch=2)
    first = incremental.records(spark, str(out)).count()
    assert filings(spark, out) == [(str(i), f"00{i}", "ok") for i in range(3)] and first > 30
    run(spark, source, out)
    assert incremental.records(spark, str(out)).count() == first
    put(source, 9, "009", 9)
    put(source, 0, "000", 0, name="0_000_.xml")  # the same filing under another name
    (source / "5_005.xml").write_bytes(b"<broken")
    run(spark, source, out)
    assert filings(spark, out)[-2:] == [("5", "005", "corrupt_xml"), ("9", "009", "ok")] and len(filings(spark, out)) == 5
    put(source, 5, "005", 5, name="5_005_again.xml")
    run(spark, source, out)
    again = incremental.latest(incremental.records(spark, str(out))).where("cik = '5'")
    assert {r.detail for r in again.where("kind = 'end'").collect()} == {"ok"} and again.where("kind = 'fact'").count() > 0


@pytest.mark.parametrize("fails_after", ["parsing", "records"])
def test_a_run_that_breaks_off(spark, tmp_path, fails_after, monkeypatch):
    """The batch runs again under its number and replaces what it had left."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(3):
        put(source, i, f"00{i}", i)

    def broken(df):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if fails_after == "records":
            m.setattr("pyspark.sql.readwriter.DataFrameWriter.mode", lambda self, how, mode=__import__("pyspark").sql.DataFrameWriter.mode: _fail_on_ledger(mode(self, how)))
        with pytest.raises(Exception, match="lost"):
            run(spark, source, out, **({"parse": broken} if fails_after == "parsing" else {}))
    assert filings(spark, out) == []
    run(spark, source, out)
    assert [f[2] for f in filings(spark, out)] == ["ok"] * 3
    want = parse_instances(spark.createDataFrame([(str(i), f"00{i}", bytearray((source / f"{i}_00{i}.xml").read_bytes())) for i in range(3)], "cik string, accession string, content binary"))
    assert incremental.records(spark, str(out)).count() == want.count()


def _fail_on_ledger(writer):
    write = writer.parquet

    def parquet(path):
        if "/ledger/" in path:
            raise RuntimeError("lost")
        return write(path)

    writer.parquet = parquet
    return writer
