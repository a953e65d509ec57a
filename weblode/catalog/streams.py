"""Streaming runs over the given tables, each compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.catalog import REGISTRY, query
from weblode.catalog.attempts import ATTEMPTS
from weblode.operators import dom
from weblode.operators.waves import fresh_path
from weblode.sources import fixtures
from weblode.sources.responses import lift, spread, table
from weblode.streaming import jobs, runs


def _attempt_stream(spark, root):
    return fixtures.attempts_of(runs.table_stream(spark, root, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_intake", REGISTRY["page_titles"].twin)
def stream_intake(spark, root):
    """Stored pages arrive as a stream and leave as (page_id, url, title)."""
    folder = fresh_path(spark, "intake")
    jobs.intake(
        runs.table_stream(spark, root, "pages"), folder,
        lambda df: dom.with_nodes(lift(spread(df))).select("page_id", "url", dom.page_title().alias("title")),
    )
    return runs.read_rows(spark, folder).drop("batch")


@query("stream_watch", REGISTRY["watch_changes"].twin)
def stream_watch(spark, root):
    folder = fresh_path(spark, "watch")
    stream = runs.table_stream(spark, root, "events").select("user_id", "event_id", "ts", "event_type")
    jobs.watch(stream, folder, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "event_type")
    return runs.read_rows(spark, folder).select("user_id", "event_id", "old", "new")


@query("stream_novelty", "select distinct 'https://f' || (user_id % 100) || '.example.com/' || event_type || '/' || (value::int) as link from events")
def stream_novelty(spark, root):
    """Feed items read again and again: each link is new once."""
    folder = fresh_path(spark, "novelty")
    e = runs.table_stream(spark, root, "events")
    link = F.concat(F.lit("https://f"), (F.col("user_id") % 100).cast("string"), F.lit(".example.com/"), "event_type", F.lit("/"), F.expr("cast(bround(value, 0) as int)").cast("string"))
    items = e.select(link.alias("link"), F.col("ts").cast("timestamp").alias("ts"))
    runs.run_available(jobs.novelty(items, ["link"], "ts", "60 days"), folder, lambda df, n: runs.write_batch(df.select("link"), folder, n))
    return runs.read_rows(spark, folder).drop("batch")


@query(
    "stream_rates",
    f"""with {ATTEMPTS} select host, strftime(time_bucket(interval '6 hours', ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as requests,
    count(*) filter (status = 403) as refused from att group by all""",
)
def stream_rates(spark, root):
    folder = fresh_path(spark, "rates")
    r = jobs.rates(_attempt_stream(spark, root), "ts", "6 hours", None, "1 day", ["host"], F.col("status") == 403)
    rows = r.select("host", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "requests", "refused")
    runs.run_available(rows, folder, lambda df, n: runs.write_batch(df, folder, n), mode="update")
    return runs.latest(runs.read_rows(spark, folder), ["host", "started"])


@query(
    "sliding_rates",
    f"""with {ATTEMPTS}, w as (select host, status, time_bucket(interval '6 hours', ts) - to_hours(6) * k as started from att, unnest([0, 1]) as u(k))
    select host, strftime(started, '%Y-%m-%d %H:%M:%S') as started, count(*) as requests, count(*) filter (status = 403) as refused from w group by all""",
)
def sliding_rates(spark, root):
    """Overlapping windows of twelve hours every six, in batch."""
    r = jobs.rates(fixtures.attempts(spark, root).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "12 hours", "6 hours", "1 day", ["host"], F.col("status") == 403)
    return r.select("host", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "requests", "refused")


@query("stream_bursts", REGISTRY["block_bursts"].twin)
def stream_bursts(spark, root):
    """Sessions of refusals as a stream: each once, as soon as no more row can belong to it, and those still open when all is read."""
    folder = fresh_path(spark, "bursts")
    refused = _attempt_stream(spark, root).filter(F.col("status") == 403)
    s = jobs.bursts(refused, "ts", "2 hours", "1 day", ["host"])
    rows = s.select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "refused")
    runs.run_available(rows, folder, lambda df, n: runs.write_batch(df, folder, n))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    closed = runs.read_rows(spark, folder, "host string, start timestamp, end timestamp, refused long").drop("batch")
    done = closed.unionByName(jobs.open_bursts(spark, folder, ["host"]).select("host", "w.start", "w.end", "refused"))
    return done.select("host", stamp("start").alias("started"), stamp(F.col("end") - F.expr("interval 2 hours")).alias("ended"), F.col("refused").alias("blocked"))


_PARTS = """first_part as (select * from events where ts < timestamp '2024-01-20'), second_part as (select * from events where ts >= timestamp '2024-01-20' and ts < timestamp '2024-01-25'),
third_part as (select * from events where ts >= timestamp '2024-01-25' or event_id % 5 = 0)"""


def _three_parts(spark, root):
    """The events in three files, two by time and then the rest with every fifth row again; and a stream that takes one at a time."""
    folder = fresh_path(spark, "parts")
    e = table(spark, root, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp")
    for n, part in enumerate((F.col("ts") < day(20), (F.col("ts") >= day(20)) & (F.col("ts") < day(25)), (F.col("ts") >= day(25)) | (F.col("event_id") % 5 == 0))):
        e.filter(part).coalesce(1).write.parquet(f"{folder}/{n}")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@query(
    "stream_late_items",
    f"""with {_PARTS}, mark as (select max(ts) - interval '5 days' as t from first_part),
    good as (select event_id from first_part union all select event_id from second_part union all select event_id from third_part where ts >= (select t from mark))
    select 'new' as kind, count(distinct event_id) as rows from good union all
    select 'late', count(*) from third_part where ts < (select t from mark)""",
)
def stream_late_items(spark, root):
    """Items read again across batches: each is new once, and rows too late for the horizon (by the watermark of the batch before) are counted."""
    folder = fresh_path(spark, "late")
    items = jobs.novelty(_three_parts(spark, root), ["event_id"], "ts", "5 days")
    runs.run_available(items, folder, lambda df, n: runs.write_batch(df.select("event_id"), folder, n))
    new = runs.read_rows(spark, folder).agg(F.lit("new").alias("kind"), F.count(F.lit(1)).alias("rows"))
    return new.unionByName(runs.late_rows(spark, folder).agg(F.lit("late").alias("kind"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")))


@query(
    "stream_watch_late",
    f"""with {_PARTS}, old_parts as (from first_part union all from second_part), seen as (select user_id, max((ts, event_id)) as at from old_parts group by user_id),
    kept as (select user_id, ts, event_id, event_type from old_parts union all
      select s.user_id, s.ts, s.event_id, s.event_type from third_part s left join seen using (user_id) where seen.at is null or (s.ts, s.event_id) > seen.at)
    select kind, count(*) as rows, sum(event_id) as ids from (
      select 'change' as kind, event_id from (select *, lag(event_type) over w as old, row_number() over w as n from kept window w as (partition by user_id order by ts, event_id))
        where n = 1 or old is distinct from event_type
      union all select 'late', event_id from third_part s join seen using (user_id) where (s.ts, s.event_id) <= seen.at) group by kind""",
)
def stream_watch_late(spark, root):
    """A watched value over three batches, the last with old rows: changes, and the rows set aside."""
    folder = fresh_path(spark, "watch")
    jobs.watch(_three_parts(spark, root), folder, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "event_type")
    both = runs.read_rows(spark, folder).select(F.lit("change").alias("kind"), "event_id").unionByName(
        spark.read.parquet(f"{folder}/late").select(F.lit("late").alias("kind"), "event_id"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))
