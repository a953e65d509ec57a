"""Work on made pages is dealt over the cores, and parts of a document are worked out once."""

import re

from pyspark.sql import functions as F

from weblode.functions.records import assembled
from weblode.sources import fixtures


def _tables(spark, top):
    part = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame([(i, f"n{i}", "b", "t", i % 50) for i in range(1, 201)], part).coalesce(1).write.parquet(f"{top}/part.parquet")
    spark.createDataFrame([(i, f"s{i}", i % 25) for i in range(1, 101)], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{top}/supplier.parquet")
    return str(top)


def test_pages_made_of_one_small_file_are_dealt_over_the_cores(spark, tmp_path):
    root = _tables(spark, tmp_path)
    most = 4 * spark.sparkContext.defaultParallelism
    for made, rows in ((fixtures.product_pages, 200), (fixtures.embedded_pages, 200)):
        df = made(spark, root)
        assert df.rdd.getNumPartitions() >= most and df.count() == rows
    cards = fixtures.card_pages(spark, root)
    plan = cards._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(block#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(dealt) == 2 and min(dealt) >= most and "ENSURE_REQUIREMENTS" not in plan
    assert sorted(r.url for r in cards.collect()) == sorted(f"https://{k}.example.com/list/{i}" for k, n in (("jobs", 3), ("shop", 5)) for i in range(n))


def test_a_part_of_a_document_is_worked_out_once(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    out = df.select(assembled(k=F.concat(F.lit('"'), F.upper("x"), F.lit('"')), empty=F.lit("[]")).alias("doc"))
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("upper(") == 1
    assert [r.doc for r in out.collect()] == ['{"k":"A"}', "{}"]
