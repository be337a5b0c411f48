"""What round 4 found: what grew faster than it should, and rows that were left out."""

import random
import time
from statistics import median

import pytest
from pyspark.sql import functions as F

from cribrum.functions import scalars
from cribrum.llm import decontaminate
from cribrum.operators import filters, lineage, similarity
from cribrum.plans import similarity as plans


def test_many_literals_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé") for _ in range(60)) for _ in range(20)] + ["", None]
    patterns = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(3, 8))) for _ in range(300)})
    monkeypatch.setattr(filters, "BROADCAST_ROWS", 100)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    out = filters.literal_hits(df, "text", spark.createDataFrame([(p,) for p in patterns], "p string"), "n", 3, 64)
    assert {r.k: r.n for r in out.collect()} == {k: sum(p in (t or "") for p in patterns) for k, t in enumerate(texts)}
    assert "Broadcast" not in out._jdf.queryExecution().toString()


def _docs(seed, n=90):
    """Documents of three languages that share passages and words, with copies, and ids of which none is divisible by 20."""
    rng, rows = random.Random(seed), []
    passages = [" ".join(f"p{i}x{j}" for j in range(9)) for i in range(4)]
    for i in range(n):
        words = [rng.choice(["one", "two", "three", f"own{i}"]) for _ in range(rng.randrange(4, 25))]
        rows.append((20 * i + 1 + i % 19, " ".join([*words, *rng.sample(passages, rng.randrange(3))]), ["de", "en", "fr", None][rng.randrange(4)], len(words)))
    return rows + [(20 * n + 1 + i, rows[i][1], "de", 5) for i in range(5)]


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def test_fold_similarity_is_that_of_all_rows(spark, tmp_path):
    """Ids are not divisible by 20: such rows alone took part before."""
    rows = _docs(1)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sets, means = {k: (_shingles(t), lang) for k, t, lang, _ in rows}, {}
    for k, (a, lang) in sets.items():
        if lang:
            sims = sorted((len(a & b) / len(a | b) for b, other in sets.values() if other and other != lang and a & b), reverse=True)[:5]
            if sims:
                means.setdefault(lang, []).append(sum(sims) / len(sims))
    order = sorted(means, key=lambda f: (median(means[f]), f))
    want = {f: (len(v), pytest.approx(median(v), abs=1e-6), order.index(f) + 1, order.index(f) == 0) for f, v in means.items()}
    got = {r.fold: (r.n, r.median_top5, r.distinctness, r.is_holdout) for r in plans.met15_fold_similarity(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 3


def test_nearest_across_in_many_blocks(spark, monkeypatch):
    """Blocks that meet, in tasks of their own, and pieces of a meeting, give what one block gives."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(_docs(2), "k long, text string, fold string, n long").withColumn("items", scalars.shingle_hashes(F.col("text"))).localCheckpoint()
    for per_fold in (False, True):
        out = []
        for size in (1 << 20, 50, 3):
            monkeypatch.setattr(similarity, "MEETING", size)
            rows = similarity.nearest_across(df, "k", "items", "fold", F.lit(True), 5, per_fold).collect()
            out.append(sorted((r.fold, r.other if per_fold else "", round(r.m, 12), r.times) for r in rows))
        assert out[0] == out[1] == out[2] and sum(x[-1] for x in out[0]) > 50
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sets_are_not_written_nor_joined(spark, tmp_path, monkeypatch):
    """What is written of a set is its size and names; the documents' other columns come with it, not by a join."""
    rows = _docs(3)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    written, asked, cut, pairs = [], [], similarity.cut, similarity.weighted_pairs
    monkeypatch.setattr(similarity, "cut", lambda df: (written.append(df.schema), cut(df))[1])
    monkeypatch.setattr(similarity, "weighted_pairs", lambda df, *a: (asked.append(df), pairs(df, *a))[1])
    n, want = 0, [_shingles(t) for _, t, _, _ in rows]
    for r in plans._diffs(spark, str(tmp_path)).collect():
        n += r.n
    assert n == sum(10 * len(a & b) >= 3 * len(a | b) for i, a in enumerate(want) for b in want[:i])
    assert written and not [f.name for s in written for f in s if f.dataType.typeName() == "array"]
    assert "Join" not in asked[0]._jdf.queryExecution().optimizedPlan().toString()


def test_shingle_hashes_are_the_shingles(spark):
    texts = ["", None, " ", "One", "one  TWO", "a b", "ab", "a b c a b c a", "a\tb\x0bc\nd", "a\xa0b c d\x1ce f", "\u0130X Y z ÄÖ", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    rows = df.select("k", scalars.shingles(F.col("text")).alias("s"), F.array_distinct(scalars.shingle_hashes(F.col("text"))).alias("h")).collect()
    assert all(len(r.s) == len(r.h) for r in rows)
    names = {}
    for r in rows:
        assert sorted(names.setdefault(h, s) for s, h in zip(r.s, r.h)) == sorted(r.s)
    assert len(names) == len(set(names.values()))


def test_shuffles_go_when_a_table_is_written(spark):
    def files():
        return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()

    df = spark.range(1000).groupBy((F.col("id") % 100).alias("g")).count()
    before, held = files(), spark.conf.get(lineage.SHUFFLE_CLEANUP, None)
    out = lineage.cut(df)
    assert spark.conf.get(lineage.SHUFFLE_CLEANUP, None) == held
    ends = time.time() + 20
    while files() > before and time.time() < ends:
        time.sleep(0.2)
    assert files() <= before
    assert out.count() == 100


def test_a_document_that_repeats_an_item_fits_in_memory(spark):
    """The places of an item in 40,000 tokens were 100,000 rows with all of these tokens, held at a time: 30 GB."""
    words = [f"w{i}" for i in range(36)]
    docs = spark.createDataFrame([(1, " ".join([*words, "x"] * 1100)), (2, "none of it"), (3, " ".join(words[:20])), (1, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[5:])), (9, "nothing to be found here at all now")], "item_id long, text string")
    found = sorted(tuple(r) for r in decontaminate.overlaps(docs, items).collect())
    assert found == [(1, 7, 36, 36), (1, 8, 31, 31), (3, 7, 20, 36), (3, 8, 15, 31)]
