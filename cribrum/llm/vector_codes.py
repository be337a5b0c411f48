"""Vector code compression: product quantisation in whole numbers, by exact matrix products over limbs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import few, stage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bits that float64 holds exactly, and that int64 has for a squared distance.
EXACT, WHOLE = 53, 62
#: Labels up to which their errors are broadcast.
FEW_LABELS = 100_000


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole numbers as float64 limbs below 2**bits in size, low ones first: x = sum of limb[i] * 2**(bits * i)."""
    size, sign = np.abs(x), np.sign(x)
    out = []
    while True:
        out.append((sign * (size & (1 << bits) - 1)).astype(np.float64))
        size = size >> bits
        if not size.any():
            return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact: BLAS over limbs so short that no sum reaches 2**53, put together in int64."""
    bits = (EXACT - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    low = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(low):
            out += (x @ y.T).astype(np.int64) << bits * (i + j)
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries of each point, and its squared distance."""
    distance = (points * points).sum(1)[:, None] - 2 * products(points, entries) + (entries * entries).sum(1)
    code = distance.argmin(1)
    return code, distance[np.arange(len(points)), code]


def _parts(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """(rows, PARTS, width of a part)"""
    return batch.column("q").flatten().to_numpy().reshape(batch.num_rows, PARTS, width // PARTS)


def whole_vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """Rows vec_id, label, q (long components, all of one length, a multiple of PARTS) of the vectors kept, and that length."""
    x = F.col("embedding")
    kept = table.select("vec_id", "label", x).where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))))
    found = kept.agg(F.max(F.size(x)), F.max(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))))).first()
    width = -(-(found[0] or 0) // PARTS) * PARTS
    most = SCALE * (found[1] or 0.0) + 1
    if max(1, width // PARTS) * (2 * most) ** 2 >= 2.0**WHOLE:
        raise ValueError(f"components up to {found[1]} are too large for distances in 64 bits")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))
    return stage(kept.select("vec_id", "label", padded.alias("q")), "vectors"), width


def codebooks(vectors: DataFrame, width: int) -> np.ndarray | None:
    """(PARTS, entries, width of a part): the entries after ROUNDS rounds; None without vectors.

    The driver holds 16 entries a part; what each task sums up is added by Spark.
    """
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).collect()
    if not seeds:
        return None
    books = np.array([r["q"] for r in seeds], np.int64).reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2)

    def sums(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                points = _parts(batch, width)
                for part, entries in enumerate(books):
                    code, _ = nearest(points[:, part], entries)
                    np.add.at(total[part], code, points[:, part])
                    count[part] += np.bincount(code, minlength=len(entries))
            part, entry, at = (x.ravel() for x in np.indices(books.shape))
            used = count[part, entry] > 0
            columns = [part[used], entry[used], at[used], total.ravel()[used], count[part, entry][used]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "at", "s", "n"])

        return run

    for _ in range(ROUNDS):
        found = vectors.select("q").mapInArrow(sums(books), "part long, entry long, at long, s long, n long").groupBy("part", "entry", "at").agg(F.sum("s"), F.sum("n"))
        new = books.copy()
        for part, entry, at, s, n in found.collect():
            new[part, entry, at] = s // n
        books = new
    return books


def compress(table: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null, or hold a null or a component that is not finite, are
    dropped.  Components become floor(4096 * x), vectors are cut into 8 parts,
    each with a codebook of 16 entries that 6 rounds of exact k-means move; ties go
    to the lower entry.  Vectors shorter than the longest, or than the next
    multiple of 8, count as followed by zeros.  Codebooks start from the 16 least
    vec_ids, null ones last and ties by vector; with fewer rows they have fewer
    entries.  Rows that repeat stay; null labels are one label.  Components too
    large for distances in 64 bits (beyond about 2**15.5 for parts of 8) raise
    ValueError.  Other columns are not read; an empty table gives no rows.
    """
    vectors, width = whole_vectors(table)
    books = codebooks(vectors, width)
    fields = f"vec_id {table.schema['vec_id'].dataType.simpleString()}, label {table.schema['label'].dataType.simpleString()}, code string, error long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _parts(batch, width)
            pairs = [nearest(points[:, part], entries) for part, entries in enumerate(books)]
            code = np.stack([c for c, _ in pairs], 1).astype(np.uint8)
            error = sum(e for _, e in pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    coded = stage(vectors.mapInArrow(assign, fields), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    totals = F.broadcast(totals) if few(totals, FEW_LABELS) else totals
    name = hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``compress`` of embeddings; edge cases as there."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ROUND = """
a{r} as materialized (select vec_id, part, arg_min(entry, d * 16 + entry) as entry, min(d) as d from (
  select vec_id, v.part, entry, sum((x - c) * (x - c))::bigint as d from v join b{r} using (part, pos) group by all) group by all)"""
_MOVE = """,
b{s} as materialized (select part, entry, pos, coalesce((total - ((total % n) + n) % n) // n, c) as c from b{r} left join (
  select part, entry, pos, sum(x)::bigint as total, count(*) as n from a{r} join v using (vec_id, part) group by all) using (part, entry, pos)),"""
ORACLE = f"""
with k as materialized (select vec_id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select vec_id, (i - 1) // (n // {PARTS}) as part, (i - 1) % (n // {PARTS}) as pos, floor({SCALE} * x)::bigint as x from (
  select vec_id, len(embedding) as n, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from k)),
b0 as materialized (select part, dense_rank() over (order by vec_id) - 1 as entry, pos, x as c from v where vec_id in (select vec_id from k order by vec_id limit {ENTRIES})),
{"".join(_ROUND.format(r=r) + (_MOVE.format(r=r, s=r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))},
c as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(c::varchar, ',' order by part, entry, pos)) from b{ROUNDS}) as codebooks_sha256
from c join k using (vec_id)
"""
