"""Streams over files of ``events``."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators.lineage import scratch
from ..streaming import funnel as S, parts as P
from .registry import query, table

_SCHEMA = "event_id long, user_id long, event_type string, value double"


def _steps():
    return [("type", F.col("event_type") != "error"), ("low", F.col("value") >= 10), ("high", F.col("value") <= 100)]


def _files(spark, d, n: int = 4) -> str:
    path = scratch(spark, "arriving")
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").repartition(n).write.parquet(path)
    return path


@query("select event_id, value from events where event_type <> 'error' and value between 10 and 100")
def str1_incremental_funnel(spark, d):
    target = scratch(spark, "survivors")
    S.run_to_sink(S.arriving(spark, _files(spark, d), _SCHEMA), _steps(), target, scratch(spark, "cp"))
    return spark.read.schema(_SCHEMA).parquet(target).select("event_id", "value")


@query("select count(*) as raw, count(*) filter (event_type = 'error') as fail_type, count(*) filter (event_type <> 'error' and value < 10) as fail_low, count(*) filter (event_type <> 'error' and value > 100) as fail_high, count(*) filter (event_type <> 'error' and value between 10 and 100) as out from events")
def str2_progress_counters(spark, d):
    progress = S.run_to_sink(S.arriving(spark, _files(spark, d), _SCHEMA, 1), _steps(), scratch(spark, "survivors"), scratch(spark, "cp"))
    names = ["raw", "fail_type", "fail_low", "fail_high", "out"]
    return spark.createDataFrame([[int(sum(p[n] for p in progress)) for n in names]], ", ".join(f"{n} long" for n in names))


@query("select count(*) as n, count(distinct event_id) as n_distinct from events where event_type <> 'error' and value between 10 and 100")
def str3_resume(spark, d):
    """Half of the files arrive, a run ends, the others arrive, a second run goes on: nothing is lost or repeated."""
    path, target, checkpoint = scratch(spark, "arriving"), scratch(spark, "survivors"), scratch(spark, "cp")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(path)
        S.run_to_sink(S.arriving(spark, path, _SCHEMA), _steps(), target, checkpoint)
    return spark.read.schema(_SCHEMA).parquet(target).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("event_id")).alias("n_distinct"))


@query("select count(*) as n from events")
def str4_bounded_batches(spark, d):
    """One file a micro-batch, each written under its number (SNK4)."""
    target = scratch(spark, "rollup")
    S.run_idempotent(S.arriving(spark, _files(spark, d), _SCHEMA, 1), S.rollup_writer(target), scratch(spark, "cp"))
    return spark.read.schema(f"{_SCHEMA}, batch int").parquet(target).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, count(distinct event_id) as n_distinct from events")
def snk4_resume_after_failure(spark, d):
    """The second micro-batch fails after it has written; the next run repeats it under the same number."""
    path, target, checkpoint = _files(spark, d), scratch(spark, "rollup"), scratch(spark, "cp")
    write = S.rollup_writer(target)

    def failing(batch, number):
        write(batch, number)
        if number == 1:
            raise RuntimeError("stopped on purpose")

    try:
        S.run_idempotent(S.arriving(spark, path, _SCHEMA, 1), failing, checkpoint)
    except StreamingQueryException:
        S.run_idempotent(S.arriving(spark, path, _SCHEMA, 1), write, checkpoint)
    return spark.read.schema(f"{_SCHEMA}, batch int").parquet(target).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("event_id")).alias("n_distinct"))


_FILES = 10


def _in_turn(spark, d) -> str:
    """Files in the order of their times: file n has the events whose id is n modulo ten."""
    path, events = scratch(spark, "arriving"), table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for n in range(_FILES):
        events.where(F.col("event_id") % _FILES == n).coalesce(1).write.mode("append").parquet(path)
    return path


@query(f"select (event_id % {_FILES})::int as batch, count(*) as raw, count(*) filter (event_type <> 'error' and value between 10 and 100) as out, true as timed, true as fits from events group by 1")
def str2_batch_rates(spark, d):
    """Counters of each micro-batch, with the seconds it took and the rows a second."""
    progress = S.run_to_sink(S.arriving(spark, _in_turn(spark, d), _SCHEMA, 1), _steps(), scratch(spark, "survivors"), scratch(spark, "cp"))
    rows = [(p["batch"], p["raw"], p["out"], p["seconds"] > 0, abs(p["rate"] * p["seconds"] - p["raw"]) < 1e-6 * p["raw"]) for p in progress]
    return spark.createDataFrame(rows, "batch int, raw long, out long, timed boolean, fits boolean")


_BATCHES = (
    f"b as (select (event_id % {_FILES})::int as i, count(*) as raw, count(*) filter (event_type <> 'error' and value between 10 and 100) as rows from events group by 1), "
    "t as (select count(*) // 4 as every from events), "
    "w(i, rollup, have, raw, rows) as (select i, 0, raw, raw, rows from b where i = 0 union all "
    "select b.i, case when w.have >= every then w.rollup + 1 else w.rollup end, case when w.have >= every then 0 else w.have end + b.raw, b.raw, b.rows from w join b on b.i = w.i + 1, t)"
)


@query(f"with recursive {_BATCHES} select rollup::int as rollup, count(*) as shards, sum(raw)::bigint as raw, sum(rows)::bigint as rows, sum(rows)::bigint as written, max(have) >= max(every) or rollup = (select max(rollup) from w) as full from w, t group by rollup")
def snk3_stream_roll_ups(spark, d):
    """Roll-ups of at least a quarter of the rows read, made while files arrive; each one's rows as the manifest and as its files have them."""
    path, target, checkpoint = _in_turn(spark, d), scratch(spark, "parts"), scratch(spark, "cp")
    every = table(spark, d, "events").count() // 4
    state = P.run_to_parts(S.arriving(spark, path, _SCHEMA, 1), _steps(), target, checkpoint, every)
    parts = P.Parts(spark, target)
    parts.roll_up(state)
    parts.commit(state)
    log = [(n, x["shards"], x["raw"], x["rows"], parts.read([x], _SCHEMA).count(), x["raw"] >= every or n == len(state.rollups) - 1) for n, x in enumerate(state.rollups)]
    return spark.createDataFrame(log, "rollup int, shards long, raw long, rows long, written long, full boolean")


@query("select event_id, value from events where event_type <> 'error' and value between 10 and 100")
def snk3_final_table(spark, d):
    """The roll-ups of a stream as one table of two files, after a clean end: nothing else is left."""
    path, target, checkpoint = _in_turn(spark, d), scratch(spark, "parts"), scratch(spark, "cp")
    P.run_to_parts(S.arriving(spark, path, _SCHEMA, 2), _steps(), target, checkpoint, table(spark, d, "events").count() // 4)
    parts = P.Parts(spark, target)
    parts.finish(2, checkpoint)
    return parts.rows(_SCHEMA).select("event_id", "value")


@query(
    "select stage, n, n_distinct, stale, raw from (values ('stopped', 2, 2), ('resumed', 10, 0), ('finished', 10, 0), ('afresh', 10, 0)) v(stage, files, stale), "
    "lateral (select count(*) filter (event_type <> 'error' and value between 10 and 100) as n, count(distinct event_id) filter (event_type <> 'error' and value between 10 and 100) as n_distinct, count(*) as raw from events where event_id % 10 < files)"
)
def snk4_manifest(spark, d):
    """A stop before the commit of the third shard and the roll-up that it fills, the next run, a clean end, and a fresh start: rows that count, and folders that don't."""
    path, target, checkpoint = _in_turn(spark, d), scratch(spark, "parts"), scratch(spark, "cp")
    every, parts, rows = table(spark, d, "events").count() // 4, P.Parts(spark, target), []

    def stop(number):
        if number == 2:
            raise RuntimeError("stopped on purpose")

    def note(stage):
        one = parts.rows(_SCHEMA).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("event_id")).alias("n_distinct")).first()
        rows.append((stage, one.n, one.n_distinct, len(parts.stale()), parts.state().counters["raw"]))

    try:
        P.run_to_parts(S.arriving(spark, path, _SCHEMA, 1), _steps(), target, checkpoint, every, before_commit=stop)
    except StreamingQueryException:
        note("stopped")
    P.run_to_parts(S.arriving(spark, path, _SCHEMA, 1), _steps(), target, checkpoint, every)
    note("resumed")
    parts.finish(1, checkpoint)
    note("finished")
    P.run_to_parts(S.arriving(spark, path, _SCHEMA, 5), _steps(), target, checkpoint, every, fresh=True)
    note("afresh")
    return spark.createDataFrame(rows, "stage string, n long, n_distinct long, stale int, raw long")


@query("select user_id, round(max(value), 6) as best, count(*) as n from events group by 1")
def udf3_per_group_function(spark, d):
    """A user's function per group (UDF3)."""

    def best(pdf):
        return pdf.groupby("user_id", as_index=False).agg(best=("value", "max"), n=("value", "size"))

    return table(spark, d, "events").select("user_id", "value").groupBy("user_id").applyInPandas(best, "user_id long, best double, n long")


@query("select event_id, round(value * 2 + 1, 6) as a, round(value / 4, 6) as b from events")
def udf1_user_properties(spark, d):
    """A user's scalar function that gives several properties a row (UDF1)."""
    @F.pandas_udf("a double, b double")
    def properties(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"a": v * 2 + 1, "b": v / 4})

    out = table(spark, d, "events").select("event_id", properties("value").alias("p"))
    return out.select("event_id", F.round("p.a", 6).alias("a"), F.round("p.b", 6).alias("b"))


@query("select doc_id, regexp_matches(coalesce(text, ''), 'th[aeiou]') as hit from documents")
def udf2_partition_worker(spark, d):
    """A worker with set-up once a partition (UDF2)."""

    def work(batches):
        import re

        pattern = re.compile("th[aeiou]")  # the set-up
        for pdf in batches:
            yield pdf.assign(hit=[bool(pattern.search(t or "")) for t in pdf["text"]])[["doc_id", "hit"]]

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(work, "doc_id long, hit boolean")
