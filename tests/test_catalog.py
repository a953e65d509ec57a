"""Registered queries next to their SQL twins, and the shape of their plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from weblode import catalog

ROOT = "/root/testdata/sf0.001"
ALL = [name for name, q in catalog.load().items() if q.twin]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ALL)
def test_twin(spark, duck, name):
    q = catalog.load()[name]
    df = q.plan(spark, ROOT)
    got = rows_of(df.columns, df.collect())
    rel = duck.execute(q.twin)
    assert got == rows_of([d[0] for d in rel.description], rel.fetchall())
    assert sum(got[1].values()) > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "url", "status", "title", "focus", "markdown"] and df.count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["page_titles", "page_links", "page_meta", "page_focus", "page_markdown", "page_text", "row_rules_nav", "find_similar"])
def test_page_work_needs_no_shuffle(spark, name):
    """Only the spreading of a too small table moves rows."""
    exchanges = re.findall(r"Exchange (\w+)", plan_of(catalog.load()[name].plan(spark, ROOT)))
    assert exchanges in ([], ["RoundRobinPartitioning"])


def test_filters_reach_the_scan_and_pages_are_lexed_once(spark):
    from pyspark.sql import functions as F

    from weblode.operators import extract

    df = catalog.load()["page_markdown"].plan(spark, ROOT).filter((F.col("page_id") > 3) & (F.col("focus") == "article"))
    text = plan_of(df)
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,3)]" in text
    assert text.count("ArrowEvalPython") == 1
    assert extract.FOCUS_MIN_TEXT == 400


def test_columns_are_pruned(spark):
    text = plan_of(catalog.load()["url_parts"].plan(spark, ROOT))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text


def jobs_of(spark, build):
    """Jobs that run while a query is built."""
    group = f"build-{id(build)}"
    spark.sparkContext.setJobGroup(group, "")
    df = build()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return df, n


@pytest.mark.parametrize("name", ["thread_comments", "listing_cards", "nth_child_cells", "embedded_jsonld", "embedded_state", "page_titles"])
def test_nothing_runs_while_planning_and_pages_are_lexed_once(spark, name):
    """Only the reading of schemas runs jobs; a page table is lexed in one step for each rule set."""
    df, n = jobs_of(spark, lambda: catalog.load()[name].plan(spark, ROOT))
    assert n <= 3
    assert plan_of(df).count("ArrowEvalPython") == (2 if name == "listing_cards" else 1)


def test_cross_joins_add_one_row(spark):
    """Joins without a key stand only beside global aggregates."""
    for name in ("corpus_search", "batch_summary", "captured_calls"):
        assert plan_of(catalog.load()[name].plan(spark, ROOT)).count("NestedLoopJoin") <= 1


def test_five_rule_sets_take_one_pass(spark):
    """One scan, one lexing step and no shuffle, however many rule sets there are."""
    from pyspark.sql import functions as F

    from weblode.catalog.jobs import KINDS
    from weblode.plans import jobs
    from weblode.sources.responses import table

    answers = table(spark, ROOT, "pages").withColumns({
        "final_url": F.col("url"), "problem": F.lit(None).cast("struct<kind:string,reason:string>"),
        "kind": F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("page_id") % 5 + 1).cast("int"))})
    df = jobs.extract_table(answers, F.col("kind"), KINDS)
    text = plan_of(df)
    assert text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1 and "Exchange" not in text
    assert df.columns[:3] == ["_url", "_row", "position"] and dict(df.dtypes)["bullets"] == "array<string>"
    assert df.filter("heading is not null").count() > 0


def test_a_field_has_one_shape(spark):
    from pyspark.sql import functions as F

    from weblode.operators.select import Field, Pick, Step
    from weblode.plans import jobs
    from weblode.sources import responses

    h1 = Pick(((Step(tag="h1"),),))
    rules = {"a": jobs.RuleSet(fields=(Field("x", h1),)), "b": jobs.RuleSet(fields=(Field("x", h1, many=True),))}
    answers = responses.pages(spark, ROOT).withColumn("final_url", F.col("url")).withColumn("problem", F.lit(None).cast("struct<kind:string,reason:string>"))
    with pytest.raises(ValueError):
        jobs.extract_table(answers, F.lit("a"), rules)
