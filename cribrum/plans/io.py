"""Sources and sinks, over files that are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lineage import scratch
from ..sources import readers as R, writers as W
from .registry import query, table


@query("select count(*) as n, count(distinct user_id) as n_ids from events")
def src1_validated_load(spark, d):
    return R.load(spark, f"{d}/events.parquet", ["event_id", "user_id", "value"]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("user_id")).alias("n_ids"))


@query("select count(*) as n_rows, count(*) filter (v is null) as n_null from (select case when o_orderkey % 9 = 0 then null else o_custkey end as v from orders)")
def src2_format_dispatch(spark, d):
    path = scratch(spark, "orders") + ".tsv"
    W.write_any(table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("v")), path)
    return R.null_count(R.read_any(spark, path, "o_orderkey long, v long"), "v")


@query("select 'p_name' as text, 'p_partkey' as id, 'p_size,p_retailprice' as properties, count(*) as n from part")
def src3_detect_columns(spark, d):
    path = scratch(spark, "part") + ".csv"
    W.write_any(table(spark, d, "part"), path)
    df = R.read_any(spark, path)
    found = R.key_columns(df, ["name"], ["id", "p_partkey"], ["p_size", "p_retailprice", "p_weight"])
    return df.agg(F.lit(found["text"]).alias("text"), F.lit(found["id"]).alias("id"), F.lit(",".join(found["properties"])).alias("properties"), F.count(F.lit(1)).alias("n"))


@query("select name, n_rows, valid_rate from (select unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']) as name), (select count(*) as n_rows, round(avg((s_acctbal >= 1000)::int), 6) as valid_rate from supplier)")
def src4_profile(spark, d):
    return R.profile(table(spark, d, "supplier"), F.col("s_acctbal") >= 1000).select("name", "n_rows", F.round("valid_rate", 6).alias("valid_rate"))


@query("select s_suppkey, s_name from supplier order by s_suppkey limit 5")
def src4_first_rows(spark, d):
    return R.first_rows(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


def _batches(spark, d, exclude=()):
    """One folder of CSV files a day; every seventh value is left out."""
    path = scratch(spark, "batches")
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.date_format("ts", "yyyyMMdd").alias("b"))
    rows.repartition("b").write.partitionBy("b").option("header", True).csv(path)
    return R.read_batches(spark, path, "event_id long, value double", exclude)


@query("select strftime(ts, '%Y%m%d') as batch, count(*) as n, round(sum(value) filter (event_id % 7 <> 0), 4) as total from events where strftime(ts, '%Y%m%d') <> '20240103' group by 1")
def src5_batch_files(spark, d):
    return _batches(spark, d, ["20240103"]).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select strftime(ts, '%Y%m%d') as batch, count(*) as n_rows, count(value) filter (event_id % 7 <> 0) as n_values, case when strftime(ts, '%Y%m%d') = '20240103' then 'excluded' else 'ok' end as status from events group by all")
def src5_batch_log(spark, d):
    return R.batch_log(_batches(spark, d), "value", ["20240103"])


@query("select c_custkey::varchar as id, c_acctbal as value from customer")
def src6_header_search(spark, d):
    """The header is the third line of the file."""
    path = scratch(spark, "sheet")
    lines = table(spark, d, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string")).alias("value"), F.lit(1).alias("o"))
    head = spark.createDataFrame([("exported by someone", 0), (",", 0), ("Sample , KD value", 0)], "value string, o int").coalesce(1)
    head.unionByName(lines).coalesce(1).select("value").write.text(path)
    return R.resolve_headers(R.read_below_header(spark, path, ["compound id", "sample"]), ["compound id", "sample"], "kd value", ["error"])


@query(
    "select 'orders' as sheet, o_custkey::varchar as id, o_totalprice as value from orders union all select 'customer', c_custkey::varchar, c_acctbal from customer union all select 'supplier', s_suppkey::varchar, s_acctbal from supplier "
    "union all select 'supplier', 'exported', null"
)
def src6_sheets(spark, d):
    """Three files in one read, each with other headers at another line; a line of the data that says the same as one above the header stays."""
    folder = scratch(spark, "sheets")

    def sheet(name, above, head, *cells):
        lines = table(spark, d, name).select(F.concat_ws(";", *[c.cast("string") for c in cells]).alias("value"))
        tops = spark.createDataFrame([(x,) for x in [*above, head]], "value string").coalesce(1)
        more = spark.createDataFrame([("exported;",)] if name == "supplier" else [], "value string")
        tops.unionByName(lines).unionByName(more).coalesce(1).write.text(f"{folder}/{name}")

    sheet("orders", [], "KD value (M);Compound ID;KD value error", F.col("o_totalprice"), F.col("o_custkey"), F.lit("x"))
    sheet("customer", ["exported by someone", ";"], '"Sample" ; "kd  value"', F.col("c_custkey"), F.col("c_acctbal"))
    sheet("supplier", ["exported;"], "sample;note;KD Value", F.col("s_suppkey"), F.lit(""), F.col("s_acctbal"))
    out = R.read_sheets(spark, folder, ["compound id", "sample"], "kd value", ["error"], sep=";")
    return out.select(F.regexp_extract("file", "/(\\w+)/[^/]*$", 1).alias("sheet"), "id", "value")


@query("select o_custkey::varchar as id, o_totalprice as value from orders where o_orderkey % 2 = 0 union all select c_custkey::varchar, c_acctbal from customer")
def src6_resolve_headers(spark, d):
    a = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("Compound ID"), F.col("o_totalprice").cast("string").alias("KD value (M)"), F.lit("x").alias("KD value error"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("kd value"))
    return R.resolve_headers(a, ["compound id", "sample"], "kd value", ["error"]).unionByName(R.resolve_headers(b, ["compound id", "sample"], "kd value", ["error"]))


@query("select count(*) as n, count(c_acctbal) as n_balance, count(c_mktsegment) as n_segment from (select c_custkey, c_acctbal, null as c_mktsegment from customer union all select c_custkey, null, c_mktsegment from customer)")
def src7_drifting_parts(spark, d):
    path, customer = scratch(spark, "parts"), table(spark, d, "customer")
    customer.select("c_custkey", "c_acctbal").write.parquet(f"{path}/part=0")
    customer.select("c_custkey", "c_mktsegment").write.parquet(f"{path}/part=1")
    return R.read_drifting(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("n_balance"), F.count("c_mktsegment").alias("n_segment"))


@query("select count(*) as n, count(distinct p_name) as n_names, max(p_partkey) as last from part")
def src8_records(spark, d):
    path = scratch(spark, "records")
    record = F.concat(F.lit("\n> <Name>\n"), F.col("p_name"), F.lit("\n> <Key>\n"), F.col("p_partkey").cast("string"), F.lit("\n"))
    table(spark, d, "part").select(record.alias("value")).write.option("lineSep", "$$$$").text(path)
    df = R.read_records(spark, path, "$$$$", "Name")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("name")).alias("n_names"), F.max(F.regexp_extract("body", r"<Key>\n(\d+)", 1).cast("long")).alias("last"))


@query("select n_nationkey::bigint as key, n_name as name from nation where n_nationkey % 5 <> 0")
def src9_fixed_width(spark, d):
    path = scratch(spark, "fixed")
    kind = F.when(F.col("n_nationkey") % 5 == 0, F.rpad(F.lit("OTHER"), 6, " ")).otherwise(F.rpad(F.lit("ATOM"), 6, " "))
    line = F.concat(kind, F.lpad(F.col("n_nationkey").cast("string"), 5, " "), F.lit(" "), F.rpad("n_name", 20, " "))
    table(spark, d, "nation").select(line.alias("value")).write.text(path)
    return R.read_fixed_width(spark, path, {"key": (7, 5, "bigint"), "name": (13, 20, "string")}, ["ATOM", "HETATM"], "name", ["WATER"])


@query("select s_suppkey as key, s_name as name, s_nationkey as nation from supplier where s_nationkey not in (3, 7)")
def src9_excluded_names(spark, d):
    """Lines whose field is on the list of excluded names go."""
    path = scratch(spark, "fixed")
    line = F.concat(F.lit("HETATM"), F.lpad(F.col("s_suppkey").cast("string"), 8, " "), F.rpad("s_name", 20, " "), F.lpad(F.col("s_nationkey").cast("string"), 4, " "))
    table(spark, d, "supplier").select(line.alias("value")).write.text(path)
    return R.read_fixed_width(spark, path, {"key": (7, 8, "bigint"), "name": (15, 20, "string"), "nation": (35, 4, "int")}, ["ATOM", "HETATM"], "nation", [3, 7])


@query("select conv_id, turn, role, length(text) as n from conversations")
def src10_flatten(spark, d):
    path = scratch(spark, "nested")
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("results"))
    nested.write.json(path)
    df = spark.read.schema("conv_id long, results array<struct<turn: long, role: string, text: string>>").json(path)
    return R.flatten_results(df, ["conv_id"], "results").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("select 'r' || (item_id % 10)::varchar as ref_id, string_agg(distinct chr(65 + (item_id % 4)::int), '|' order by chr(65 + (item_id % 4)::int)) as site from benchmark group by 1")
def src11_load_references(spark, d):
    one = table(spark, d, "benchmark").select(F.concat(F.lit("r"), (F.col("item_id") % 10).cast("string")).alias("ref_id"), F.char((F.lit(65) + F.col("item_id") % 4).cast("int")).alias("site"), F.concat(F.lit("p"), (F.col("item_id") % 10).cast("string")).alias("pattern"))
    return R.load_references(one).select("ref_id", "site")


@query("select c_custkey, lpad((row_number() over (order by c_acctbal desc, c_custkey) - 1)::varchar, 8, '0') as row_id from customer")
def src12_row_ids(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("b"))
    return R.with_row_id(rows, ["b", "c_custkey"]).select("c_custkey", "row_id")


@query("select s_suppkey, s_name, s_acctbal from supplier")
def snk1_write_by_extension(spark, d):
    path = scratch(spark, "supplier") + ".csv"
    W.write_any(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return R.read_any(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("select count(*) as rows, ceil(count(*) / 100000)::bigint as files, true as sized, true as grouped from orders")
def snk2_convert(spark, d):
    source = scratch(spark, "orders") + ".csv"
    W.write_any(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), source)
    return W.convert(spark, source, scratch(spark, "orders"), "o_orderkey long, o_totalprice double", rows_per_file=100_000, files=1).select(
        "rows", "files", (F.col("bytes") > 1000).alias("sized"), (F.col("row_groups") >= F.col("files")).alias("grouped")
    )


@query("select count(*) as part_rows, count(*) as final_rows, true as equal from events")
def snk3_compact(spark, d):
    source = scratch(spark, "shards")
    table(spark, d, "events").repartition(24).write.parquet(source)
    return W.compact(spark, source, scratch(spark, "final"), 2)


@query("select count(*) as rows, true as full, true as equal from events")
def snk3_roll_up(spark, d):
    """All rollups but the last have the number of rows asked for at least."""
    source, target = scratch(spark, "shards"), scratch(spark, "rollups")
    table(spark, d, "events").repartition(24).write.parquet(source)
    every = max(1, table(spark, d, "events").count() // 4)
    log = W.roll_up(spark, source, target, every)
    last = log.agg(F.max("rollup").alias("last"))
    written = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("written"))
    checked = log.crossJoin(last).agg(F.sum("rows").alias("rows"), F.bool_and((F.col("rows") > 0) & ((F.col("rollup") == F.col("last")) | (F.col("rows") >= every))).alias("full"))
    return checked.crossJoin(written).select("rows", "full", (F.col("rows") == F.col("written")).alias("equal"))  # one row each


@query("select o_orderpriority, count(*) as n from orders group by 1")
def snk5_group_outputs(spark, d):
    path = scratch(spark, "groups")
    W.write_groups(table(spark, d, "orders"), "o_orderpriority", path)
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, count(*) as n, o_orderstatus = 'P' as written_second from orders group by 1")
def snk6_finish_groups(spark, d):
    """Two groups are there already; the second run writes the third alone."""
    path, orders = scratch(spark, "resume"), table(spark, d, "orders")
    W.write_missing_groups(orders.where("o_orderstatus <> 'P'"), "o_orderstatus", path)
    second = W.write_missing_groups(orders, "o_orderstatus", path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("written_second", F.col("o_orderstatus").isin(second))


@query("select count(*) as n_rows, count(*) filter (value > 100) as n_high, 5 as n_types from events")
def snk7_run_summary(spark, d):
    out = W.run_summary(table(spark, d, "events"), {"n_rows": F.count(F.lit(1)), "n_high": F.count_if(F.col("value") > 100)}, ["event_type"], scratch(spark, "summary"))
    return out.select("counts.n_rows", "counts.n_high", F.size("by_event_type").alias("n_types"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def snk8_export(spark, d):
    return W.export(table(spark, d, "orders"), ["o_orderkey", "missing", "o_totalprice"], 50, "o_totalprice", "o_orderkey")


@query("select count(*) as n from (select * from lineitem limit 500)")
def snk9_raw_limit(spark, d):
    """A smoke run on 500 raw rows: the limit is the feature."""
    return table(spark, d, "lineitem").limit(500).agg(F.count(F.lit(1)).alias("n"))
