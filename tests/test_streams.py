"""Streams over tables that come as one file or as a folder, and sessions that are still open."""

from datetime import datetime

import pytest

from weblode import catalog


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Pages as a folder of two files and as a single file."""
    top = tmp_path_factory.mktemp("stored")
    rows = [(i, f"https://a.example.com/{i}", f"<html><title>Page {i}</title></html>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.repartition(2).write.parquet(f"{top}/folder/pages.parquet")
    df.coalesce(1).write.parquet(f"{top}/parts")
    (top / "file").mkdir()
    next((top / "parts").glob("part-*.parquet")).rename(top / "file" / "pages.parquet")
    return top


@pytest.mark.parametrize("layout", ["folder", "file"])
def test_intake_reads_a_folder_and_a_file(spark, stored, layout):
    got = catalog.load()["stream_intake"].plan(spark, str(stored / layout))
    assert sorted((r.page_id, r.title) for r in got.collect()) == [(i, f"Page {i}") for i in range(6)]


def test_sessions_still_open_are_in_the_result(spark, tmp_path):
    """Refusals of one host: two sessions long over, one that ends with the table."""
    day = lambda d, h: datetime(2024, 1, d, h)
    at = [(0, day(1, 0)), (68, day(1, 1)), (136, day(1, 6)), (204, day(9, 12)), (272, day(9, 13))]
    rows = [(n, ts, 4, "error", 1.0) for n, ts in at]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(map(tuple, catalog.load()["block_bursts"].plan(spark, str(tmp_path)).collect()))
    got = sorted(map(tuple, catalog.load()["stream_bursts"].plan(spark, str(tmp_path)).collect()))
    assert [r[3] for r in want] == [2, 1, 2] and got == want


def test_open_bursts_follow_a_run(spark, tmp_path):
    """A session that one run leaves open is closed by a later one and then no longer among the open ones."""
    from pyspark.sql import functions as F

    from weblode.streaming import jobs, runs

    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(*hours):
        spark.createDataFrame([("h", datetime(2024, 1, 1, h)) for h in hours], "host string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        s = jobs.bursts(spark.readStream.schema("host string, ts timestamp").parquet(src), "ts", "2 hours", "1 hour", ["host"])
        runs.run_available(s.select("host", F.hour("w.start").alias("from"), "refused"), out, lambda df, n: runs.write_batch(df, out, n))
        closed = sorted((r["from"], r.refused) for r in runs.read_rows(spark, out).collect())
        still = sorted((r["from"], r.refused) for r in jobs.open_bursts(spark, out, ["host"]).select(F.hour("w.start").alias("from"), "refused").collect())
        return closed, still

    assert run(0, 1, 8) == ([(0, 2)], [(8, 1)])
    assert run(9, 20) == ([(0, 2), (8, 2)], [(20, 1)])
