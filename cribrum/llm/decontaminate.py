"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import documents, few, hidden, stage

#: Fixed masks: 1 is a token that must agree, 0 one that is ignored.  With 30 of 100 tokens changed they find 97 of 100
#: overlaps with items of 16 tokens, and more of longer ones.
MASKS = ("11101", "1010011", "100001011")
#: An item is found from this many agreeing tokens and this share of it, over alignments whose shifts are at most NEAR
#: tokens apart; or from LOCAL_MATCHED agreeing ones of LOCAL in a row.
MIN_MATCHED, MIN_SHARE, NEAR = 8, 0.5, 8
LOCAL, LOCAL_MATCHED = 13, 11
#: Items below MIN_MATCHED tokens must agree whole; below this many they must be the whole document.
LEAST_SHORT = 5
#: Rows of benchmark seeds, and tokens that these bring along, up to which they are broadcast; beyond, seeds are shuffled.
BROADCAST_ROWS, BROADCAST_TOKENS = 1_000_000, 10_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits of a text."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")), " ")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def seed_rows(table: DataFrame, keep: list[str]) -> DataFrame:
    """One row per position and mask: keep, at, seed; table has the token hashes as h."""
    shortest = min(map(len, MASKS))
    spots = table.where(F.size("h") >= shortest).select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - shortest)).alias("at"))
    seeds = [
        F.when(
            F.col("at") + len(mask) <= F.size("h"),
            F.xxhash64(F.lit(m), *[F.get("h", F.col("at") + i) for i, bit in enumerate(mask) if bit == "1"]),
        )
        for m, mask in enumerate(MASKS)
    ]
    return spots.select(*keep, "h", "at", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _agreement(doc: Column, item: Column, shift: Column) -> Column:
    """The item's tokens, by place, that agree when item token 0 lies at doc token ``shift``."""
    first, last = F.greatest(-shift, F.lit(0)), F.least(F.size(item), F.size(doc) - shift) - 1
    return F.filter(F.sequence(first, last), lambda i: F.get(doc, i + shift) == F.get(item, i))


def _short_seeds(table: DataFrame, keep: list[str], sizes: list[int], whole: bool = False) -> DataFrame:
    """As ``seed_rows``, for runs of as many tokens as the short items have; if ``whole``, only runs that are all of the row."""
    parts = []
    for n in sizes:
        spots = table.where(F.size("h") == n if whole else F.size("h") >= n).select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - n)).alias("at"))
        parts.append(spots.select(*keep, "h", "at", F.xxhash64(F.lit(-n), *[F.get("h", F.col("at") + i) for i in range(n)]).alias("seed")))
    return reduce(DataFrame.unionByName, parts)


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows row, doc_id, entry, item_id, n_tokens, shift, ats, size: the alignments that seeds propose; some may repeat.

    ``row`` and ``entry`` tell documents and items apart by id and text, so that repeated and null ids go with their own tokens.
    """

    def named(column: str, text: str) -> Column:
        return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")), F.col(column).isNull(), text)

    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("item")).distinct().withColumn("entry", named("item_id", "item"))
    # At most MIN_MATCHED - 1 rows.
    sizes = sorted(r[0] for r in items.where((F.size("item") > 0) & (F.size("item") < MIN_MATCHED)).select(F.size("item")).distinct().collect())
    of_items = items.select("entry", F.col("item").alias("h"))
    of_docs = docs.select("doc_id", token_hashes(F.col("text")).alias("h")).withColumn("row", named("doc_id", "h"))

    def seeds(table: DataFrame, keep: list[str]) -> DataFrame:
        long = seed_rows(table, keep)
        return long.unionByName(_short_seeds(table, keep, sizes)) if sizes else long

    known = seed_rows(of_items.where(F.size("h") >= MIN_MATCHED), ["entry"])
    if sizes:
        known = known.unionByName(_short_seeds(of_items, ["entry"], sizes, whole=True))
    known = stage(known.select("seed", "entry", F.col("at").alias("item_at")).distinct(), "seeds")
    shift = F.col("at") - F.col("item_at")
    spots = seeds(of_docs, ["row"]).select("row", "at", "seed")
    # A document's tokens don't go with its places and alignments: Spark holds all that come from one document at a time.
    hits = spots.join(F.broadcast(known) if few(known, BROADCAST_ROWS) else known.hint("merge"), "seed")
    hits = stage(hits.select("row", "entry", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    rows = hits.select("row").distinct()
    asked = of_docs.join(F.broadcast(rows) if few(rows, BROADCAST_ROWS) else rows.hint("merge"), "row", "left_semi")
    # Rows and tokens of items are counted before they are broadcast.
    small = few(items, BROADCAST_ROWS) and (items.agg(F.sum(F.size("item") + 2)).first()[0] or 0) <= BROADCAST_TOKENS
    shifts = hits.groupBy("row", "entry").agg(F.collect_list("shift").alias("shifts")).join(F.broadcast(items) if small else items.hint("merge"), "entry")
    found = shifts.join(asked.dropDuplicates(["row"]).hint("merge"), "row").select(
        "row", "doc_id", "entry", "item_id", F.size("item").alias("n_tokens"), F.size("h").alias("size"),
        F.transform("shifts", lambda x: F.struct(x.alias("shift"), _agreement(F.col("h"), F.col("item"), x).alias("ats"))).alias("found"),
    )
    return found.select("row", "doc_id", "entry", "item_id", "n_tokens", "size", F.inline("found"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows doc_id, item_id, n_matched, n_tokens: items found in documents.

    An alignment that a seed hit proposes has the item's tokens that agree in place.
    n_matched is how many of its n_tokens tokens agree in an alignment or in one
    whose shift is at most NEAR tokens away (words put in or left out), at best.  An
    item is found with MIN_MATCHED of them that are MIN_SHARE of it, or where
    LOCAL_MATCHED of LOCAL tokens in a row agree in one alignment.  Items of fewer
    than MIN_MATCHED tokens must agree in all of them; those of fewer than
    LEAST_SHORT tokens are only found where they are the whole document.  Null and
    empty texts match nothing; rows that repeat a doc_id, or have none, count as one
    document, of which any text may match; the same for items.  Texts of any
    length are read whole; other columns are not read, and an empty table on either
    side gives no rows.
    """
    n, own = F.col("n_tokens"), F.size("ats")
    near = Window.partitionBy("row", "entry").orderBy("shift").rangeBetween(-NEAR, NEAR)
    hits = _hits(docs, benchmark).distinct().withColumn("matched", F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(near)))))
    ends = F.sequence(F.lit(LOCAL_MATCHED - 1), own - 1)
    local = (own >= LOCAL_MATCHED) & F.exists(ends, lambda k: F.get("ats", k) - F.get("ats", k - (LOCAL_MATCHED - 1)) < LOCAL)
    long = (n >= MIN_MATCHED) & (local | (F.col("matched") >= MIN_MATCHED) & (F.col("matched") >= MIN_SHARE * n))
    short = (n < MIN_MATCHED) & (own == n) & ((n >= LEAST_SHORT) | (F.col("size") == n))
    return hits.where(long | short).groupBy("doc_id", "item_id", "n_tokens").agg(F.max("matched").alias("n_matched")).select("doc_id", "item_id", "n_matched", "n_tokens")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which ``overlaps`` finds no benchmark item; rows without doc_id stay.

    All rows of a doc_id go with one of them.  Null and empty texts stay, and an empty
    table on either side takes nothing away.  Columns stay, whatever their names.
    """
    table, _ = hidden(docs, ["doc_id", "text"])
    found = stage(overlaps(table.where("doc_id is not null"), benchmark).select("doc_id").distinct(), "found")
    # A few ids go to the documents; many meet them in a shuffle.
    gone = F.broadcast(found) if few(found, BROADCAST_ROWS) else found
    return table.join(gone, "doc_id", "left_anti").select(*table.columns).toDF(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``overlaps`` of documents with benchmark; edge cases as there."""
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_OFFSETS = [[i for i, bit in enumerate(mask) if bit == "1"] for mask in MASKS]
_SEEDED = " or ".join(f"len(list_filter(ats, lambda x: list_has_all(ats, list_transform({o}, lambda d: x + d)))) > 0" for o in _OFFSETS)

_LONG = f"n_tokens >= {MIN_MATCHED} and (matched >= greatest({MIN_MATCHED}, {MIN_SHARE} * n_tokens) or len(list_filter(ats, lambda x: list_contains(list_transform(ats, lambda y, k: y - x < {LOCAL} and k >= {LOCAL_MATCHED} + list_position(ats, x) - 1), true))) > 0)"
_SHORT = f"n_tokens < {MIN_MATCHED} and len(ats) = n_tokens and (n_tokens >= {LEAST_SHORT} or size = n_tokens)"


def oracle(seeded: str) -> str:
    """The SQL of ``overlaps``; ``seeded`` tells which alignments are looked at, by the places ``ats`` that agree."""
    return f"""
with d as (select doc_id, size, unnest(w) as t, generate_subscripts(w, 1) as at from (select doc_id, w, len(w) as size from (select doc_id, {_TOKENS} as w from documents))),
i as (select item_id, len(w) as n_tokens, unnest(w) as t, generate_subscripts(w, 1) as at from (select item_id, {_TOKENS} as w from benchmark)),
m as materialized (
  select * from (select doc_id, size, item_id, n_tokens, d.at - i.at as shift, list(i.at order by i.at) as ats from d join i using (t) group by all having count(*) >= 4 or count(*) = n_tokens)
  where ({seeded}) or n_tokens < {MIN_MATCHED} and len(ats) = n_tokens
),
u as (select m.*, len(list_distinct(flatten(list(o.ats)))) as matched from m join m o on o.doc_id = m.doc_id and o.item_id = m.item_id and abs(o.shift - m.shift) <= {NEAR} group by all)
select doc_id, item_id, max(matched)::int as n_matched, n_tokens::int as n_tokens from u where {_LONG} or {_SHORT} group by all
"""


ORACLE = oracle(_SEEDED)
