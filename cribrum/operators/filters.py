"""Filters that account for what they drop: funnels, patterns, labels, gates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import known_runs, let
from .lineage import cut, few, spread
from .replicates import nearest_quantile

#: Rows up to which one side of a join is broadcast; texts and patterns among them are a few hundred bytes each.
BROADCAST_ROWS = 100_000
#: Different heads of references up to which they go to the tasks, which look for them in the texts.
KNOWN_HEADS = 100_000
#: Bytes of patterns that go to the tasks at a time; an automaton takes some hundred times that.
PATTERN_BYTES = 2 << 20
#: Blocks of patterns up to which a task has an automaton for each.
MOST_BLOCKS = 8


def literals(patterns: list[str], least: int = 4) -> list[str]:
    """Distinct patterns of ``least`` characters at least, in their order."""
    return list(dict.fromkeys(p for p in patterns if len(p) >= least))


def any_literal(text: Column, patterns: list[str], least: int = 4) -> Column:
    """Whether the text contains one of the patterns; null does not."""
    parts = [re.escape(p) for p in literals(patterns, least)]
    return F.coalesce(text.rlike("|".join(parts)), F.lit(False)) if parts else F.lit(False)


_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, patterns: list[str]) -> ahocorasick.Automaton:
    """The automaton of a block of patterns; a worker keeps the last."""
    if name not in _automata:
        _automata.clear()
        machine = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            machine.add_word(p, i)
        machine.make_automaton()
        _automata[name] = machine
    return _automata[name]


def _seeded_hits(df: DataFrame, text: str, known: DataFrame, name: str, least: int) -> DataFrame:
    """Adds ``name``, the number of the different patterns p in ``known``, of ``least`` characters or more, that the text contains."""
    rows = cut(df.withColumn("_id", F.monotonically_increasing_id()))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column("_id").to_pylist(), batch.column(text).to_pylist()):
                runs = list({t[j : j + least] for j in range(len(t) - least + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(runs), pa.int64()), pa.array(runs, pa.string())], names=["_id", "run"])

    runs = rows.select("_id", text).where(F.length(text) >= least).mapInArrow(starts, "_id long, run string").select("_id", F.xxhash64("run").alias("_s"))
    patterns = known.select("p", F.xxhash64(F.substring("p", 1, least)).alias("_s"))
    # A file of a few MB may hold half a million patterns, so Spark may not broadcast by the size of files.
    near = runs.join(F.broadcast(patterns) if few(patterns, BROADCAST_ROWS) else patterns.hint("merge"), "_s").select("_id", "p")
    hits = near.join(rows.select("_id", text).hint("merge"), "_id").where(F.contains(F.col(text), F.col("p")))
    counts = hits.groupBy("_id").agg(F.count(F.lit(1)).alias(name))
    return rows.join(counts.hint("merge"), "_id", "left").drop("_id").withColumn(name, F.coalesce(name, F.lit(0)))


def literal_hits(df: DataFrame, text: str, patterns: DataFrame, name: str, least: int = 4, block: int = PATTERN_BYTES) -> DataFrame:
    """Adds ``name``, the number of different patterns of ``least`` characters at least that the text contains; null contains none.

    For sets of many thousands: the patterns (the first column of ``patterns``) are
    taken in blocks of about ``block`` bytes, by a hash; each block goes to the tasks
    as an automaton, which reads a text once for all of its patterns.  Automata of more
    than ``MOST_BLOCKS`` blocks would fill a task, so then nothing goes to the tasks:
    the first ``least`` characters of patterns are looked up among all runs of as many
    in the texts, and what is found so is compared in full.
    """
    known = cut(patterns.select(F.col(patterns.columns[0]).alias("p")).where(F.length("p") >= least).distinct())
    blocks = -(-(known.agg(F.sum(F.octet_length("p"))).first()[0] or 0) // block)
    if blocks > MOST_BLOCKS:
        return _seeded_hits(df, text, known, name, least)
    out = df.withColumn(name, F.lit(0).cast("long"))
    fields = out.schema
    for i in range(blocks):
        own = sorted(r.p for r in known.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == i).collect())
        digest = hashlib.md5("\0".join(own).encode()).hexdigest()

        def count(batches: Iterator[pa.RecordBatch], own=own, digest=digest) -> Iterator[pa.RecordBatch]:
            machine = _automaton(digest, own)
            for batch in batches:
                if not own:
                    yield batch
                    continue
                hits = [len({k for _, k in machine.iter(t)}) if t else 0 for t in batch.column(text).to_pylist()]
                sums = pc.add(batch.column(name), pa.array(hits, pa.int64()))
                yield batch.set_column(batch.schema.get_field_index(name), name, sums)

        out = out.mapInArrow(count, fields)
    return out


def property_filter(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]], sums: list[tuple[list[str], float]] = ()) -> DataFrame:
    """Rows whose columns are all within [low, high] and whose sums of columns are at most their cutoffs."""
    return df.where(within(ranges, sums))


def within(ranges: dict[str, tuple[float | None, float | None]], sums: list[tuple[list[str], float]] = ()) -> Column:
    ok = F.lit(True)
    for name, (low, high) in ranges.items():
        ok = ok & (F.col(name) >= low if low is not None else F.lit(True)) & (F.col(name) <= high if high is not None else F.lit(True))
    for names, most in sums:
        ok = ok & (sum((F.col(n) for n in names), F.lit(0)) <= most)
    return ok


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Per step, in order: rows that fail it having passed those before, and rows left.  One pass; null fails."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("_n")]
    for i, (_, ok) in enumerate(steps):
        good = F.coalesce(ok, F.lit(False))
        counts.append(F.count_if(passed & ~good).alias(f"_f{i}"))
        passed = passed & good
    one = df.agg(*counts)
    rows, left = [], F.col("_n")
    for i, (name, _) in enumerate(steps):
        left = left - F.col(f"_f{i}")
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.col(f"_f{i}").alias("failed"), left.alias("remaining")))
    return one.select(F.inline(F.array(*rows)))


def first_failure(steps: list[tuple[str, Column]], passed: str = "out") -> Column:
    """The name of the first step that a row fails, or ``passed``."""
    out = F.lit(passed)
    for name, ok in reversed(steps):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def matched_names(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that match, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def contained_references(df: DataFrame, key: str, text: str, references: DataFrame, piece: Column | None = None) -> DataFrame:
    """Rows (key, ref_id, sites): references whose pattern occurs in the text as a run of whole words.

    ``references``: ref_id, site (labels joined by ``|``), pattern (words, lower
    case).  The first words of a pattern, up to three, are looked up among the texts'
    runs of words, in one pass over each text if there are few such heads, else by
    hashes of all runs; only texts that hold them are compared in full.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    refs = references.select("ref_id", "site", clean(F.col("pattern")).alias("pattern")).where("pattern <> ''")
    refs = cut(refs.withColumn("_t", F.array_join(F.slice(F.split("pattern", " "), 1, 3), " ")))
    texts = spread(df.select(key, F.col(text).alias("_text")))
    starts = refs.select("_t").distinct()
    if few(starts, KNOWN_HEADS):
        found = texts.select(key, F.explode(known_runs(F.col("_text"), {r[0] for r in starts.collect()})).alias("_t"))
    else:
        starts = cut(starts.withColumn("_w", F.split("_t", " ")).select("_t", F.size("_w").alias("_n"), F.xxhash64("_w").alias("_h")))
        sizes = sorted(r[0] for r in starts.select("_n").distinct().collect())  # 1, 2 and 3 at most

        def of_size(words: Column, n: int) -> Column:
            every = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))
            return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<long>"))

        hashes = let(F.split(clean(F.col("_text")), " "), lambda words: F.array_distinct(F.concat(*[of_size(words, n) for n in sizes])))
        found = texts.select(key, F.explode(hashes).alias("_h")).join(starts, "_h").select(key, "_t")
    heads = refs.select("ref_id", "_t")
    heads = F.broadcast(heads) if few(heads, BROADCAST_ROWS) else heads
    near = cut(found.join(heads, "_t").select(key, "ref_id").distinct())
    # Texts stay where they are if few of them are asked for, and only those are cleaned.
    asked = near.select(key).distinct()
    asked = F.broadcast(asked) if few(asked, BROADCAST_ROWS) else asked
    texts = texts.join(asked, key, "left_semi").select(key, clean(F.col("_text")).alias("_text"))
    near = near.join(refs.select("ref_id", "site", "pattern"), "ref_id")
    near = F.broadcast(near) if few(near, BROADCAST_ROWS) else near
    hits = texts.join(near, key).where(F.concat(F.lit(" "), F.col("_text"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("pattern"), F.lit(" "))))
    return hits.select(key, "ref_id", F.split("site", r"\|").alias("sites")).distinct()


def reference_flags(df: DataFrame, key: str, text: str, references: DataFrame) -> DataFrame:
    """Rows (key, ref_id, hit): one boolean a reference for every row with any hit."""
    hits = contained_references(df, key, text, references).select(key, "ref_id", F.lit(True).alias("hit"))
    ids = references.select("ref_id").distinct()
    if not few(ids, BROADCAST_ROWS):
        raise ValueError(f"flags of more than {BROADCAST_ROWS} references")
    every = hits.select(key).distinct().crossJoin(F.broadcast(ids))  # a flag for each is the result asked for
    return every.join(hits, [key, "ref_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def final_gate(df: DataFrame, group: str, score: str, margin: float, others: list[Column]) -> DataFrame:
    """Rows whose score is within ``margin`` of the best of their group and that meet all other criteria; null fails."""
    best = df.groupBy(F.col(group).alias("_group")).agg(F.max(score).alias("_best"))
    best = F.broadcast(best) if few(best, BROADCAST_ROWS) else best
    ok = F.col(score) >= F.col("_best") - margin
    for other in others:
        ok = ok & other
    return df.join(best, F.col(group).eqNullSafe(F.col("_group"))).where(ok).drop("_group", "_best")


def containment_gate(df: DataFrame, key: str, text: str, references: DataFrame) -> DataFrame:
    """Rows with a reference: number of hits, sorted references, sorted distinct labels."""
    hits = contained_references(df, key, text, references)
    return hits.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_hits"), F.array_join(F.array_sort(F.collect_set(F.col("ref_id").cast("string"))), ",").alias("refs"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sites")))), "|").alias("matched_sites"),
    )


def gray_zone(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows outside [low, high] labelled value > high; the bounds go along."""
    return df.where(~F.col(value).between(low, high)).withColumns({"label": F.col(value) > high, "filter_lo": F.lit(low), "filter_hi": F.lit(high)})


def two_thresholds(df: DataFrame, value: str, low: float, high: float, source: str) -> DataFrame:
    """1 from ``high`` on, 0 up to ``low``; rows between go."""
    label = F.when(F.col(value) >= high, 1).when(F.col(value) <= low, 0)
    return df.withColumns({"label": label, "label_source": F.lit(source)}).where("label is not null")


def quantile_labels(df: DataFrame, value: str, q: float) -> DataFrame:
    """Adds label (value >= its nearest q-quantile) and threshold; 0 < q < 1, and no null may be among the values."""
    if not 0 < q < 1:
        raise ValueError("q must lie between 0 and 1")
    threshold = nearest_quantile(df, value, q).withColumnRenamed("quantile", "threshold")
    solid = F.coalesce(F.col(value), F.raise_error(F.lit(f"{value} has nulls")).cast("double"))
    return df.crossJoin(F.broadcast(threshold)).withColumn("label", solid >= F.col("threshold"))  # one row


def holdout_override(df: DataFrame, fold: str, holdout: int) -> DataFrame:
    """Adds holdout_fold and is_holdout; the fold must exist."""
    if df.where(F.col(fold) == holdout).isEmpty():
        raise ValueError(f"there is no fold {holdout}")
    return df.withColumns({"holdout_fold": F.lit(holdout), "is_holdout": F.col(fold) == holdout})


def drop_invalid(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all rules, and how many each rule turned away first."""
    tagged = df.withColumn("_why", first_failure(rules, "kept"))
    return tagged.where("_why = 'kept'").drop("_why"), tagged.groupBy(F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def not_annotation(text: Column, patterns: list[str]) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike("|".join(f"(?:{p})" for p in patterns))


def require_key(df: DataFrame, group: str, key: str, required: str, second: str | None = None) -> DataFrame:
    """Rows of groups that contain the required key (and the second, if given)."""
    out = df
    for value in [required] + ([second] if second is not None else []):
        out = out.join(df.where(F.col(key) == value).select(group).distinct(), group, "left_semi")
    return out


def suppress_small(df: DataFrame, columns: list[str], n: str, least: int = 5) -> DataFrame:
    return df.withColumns({c: F.when(F.col(n) >= least, F.col(c)) for c in columns})
