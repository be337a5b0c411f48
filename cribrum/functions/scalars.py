"""Column functions: cleaning, classification, bit sets, features, geometry."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(raw: Column, prefixes: dict[str, str], contains: dict[str, str]) -> Column:
    """A trimmed id: a known prefix or content gives the canonical id, else a leading ``Reference`` and a trailing ``*`` go."""
    text = F.trim(raw)
    out = F.regexp_replace(F.regexp_replace(text, r"^Reference\s*", ""), r"\*$", "")
    for part, canonical in contains.items():
        out = F.when(text.contains(part), F.lit(canonical)).otherwise(out)
    for start, canonical in reversed(prefixes.items()):
        out = F.when(text.startswith(start), F.lit(canonical)).otherwise(out)
    return out


def prefix_class(raw: Column, classes: dict[str, str], digit: str = "numeric", empty: str = "empty", other: str = "other") -> Column:
    """The class of the first matching prefix; ids that start with a digit and empty ids have classes of their own."""
    out = F.when(raw.isNull() | (F.trim(raw) == ""), F.lit(empty))
    for start, name in classes.items():
        out = out.when(raw.startswith(start), F.lit(name))
    return out.when(raw.rlike("^[0-9]"), F.lit(digit)).otherwise(F.lit(other))


def first_number(*columns: Column) -> Column:
    """The first value that is a number, among columns of any type."""
    return F.coalesce(*[c.cast("string").try_cast("double") for c in columns])


def neg_log10(value: Column) -> Column:
    """-log10 of positive values, null for all others."""
    return F.when(value > 0, -F.log10(value))


def compliant(cutoffs: Sequence[tuple[Column, float]]) -> Column:
    """Whether every column is at most its cutoff; null counts as not."""
    out = F.lit(True)
    for column, most in cutoffs:
        out = out & F.coalesce(column <= most, F.lit(False))
    return out


def let(value: Column, body) -> Column:
    """``body(value)``, where the value is computed once a row and not once for each use inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, kind: str = "word", size: int = 3) -> Column:
    """Distinct n-grams of a text as strings: ``word`` or ``char``; a shorter text is one shingle, an empty one has none."""
    if kind not in ("word", "char"):
        raise ValueError(f"no fingerprint of kind {kind!r}")
    low = F.lower(F.coalesce(text, F.lit("")))
    units = F.array_remove(F.split(low, r"\s+"), "") if kind == "word" else F.filter(F.split(low, ""), lambda c: c != "")
    glue = " " if kind == "word" else ""
    grams = let(
        units,
        lambda u: F.when(F.size(u) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(u) - size + 1)), lambda i: F.array_join(F.slice(u, i, size), glue))
        ),
    )
    return F.array_distinct(grams)


def shingle_hashes(text: Column, size: int = 3) -> Column:
    """64-bit hashes of the word n-grams of which ``shingles`` gives the distinct ones, from hashes of words: the n-grams are never strings, which takes most of the time."""
    words = F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), ""), lambda w: F.xxhash64(w))
    return let(
        words,
        lambda u: F.when(F.size(u) == 0, F.array().cast("array<long>"))
        .when(F.size(u) < size, F.array(F.xxhash64(u)))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(u) - size), lambda i: F.xxhash64(*[F.get(u, i + j) for j in range(size)]))),
    )


def count_char_shingles(text: Column, size: int) -> Column:
    """How many distinct character n-grams ``shingles`` would give: the n-grams are never columns, which takes most of the time."""

    @F.pandas_udf("long")
    def distinct(low: pd.Series) -> pd.Series:
        return low.map(lambda t: len({t[i : i + size] for i in range(max(1, len(t) - size + 1))}) if t else 0).astype("int64")

    return distinct(F.lower(F.coalesce(text, F.lit(""))))


def known_shingles(text: Column, known: set[str], size: int = 3) -> Column:
    """n, how many distinct word n-grams ``shingles`` gives, and held, those of them in ``known``: the others are never columns, which takes most of the time."""
    wanted = {tuple(k.encode().split(b" ")) for k in known}

    @F.pandas_udf("n long, held array<string>")
    def look(low: pd.Series) -> pd.DataFrame:
        n, held = [], []
        for text in low:
            words = text.split()  # of bytes: at the same white space as \s
            grams = {*zip(*(words[i:] for i in range(size)))} if len(words) >= size else {tuple(words)} - {()}
            n.append(len(grams))
            held.append([b" ".join(g).decode() for g in grams & wanted])
        return pd.DataFrame({"n": n, "held": held})

    return look(F.lower(F.coalesce(text, F.lit(""))).cast("binary"))


def known_runs(text: Column, known: set[str]) -> Column:
    """Those of ``known`` (words in lower case, joined by spaces) that occur in a text as runs of whole words."""
    wanted = {tuple(k.encode().split(b" ")) for k in known}
    firsts, sizes = {k[0] for k in wanted}, sorted({len(k) for k in wanted})

    @F.pandas_udf("array<string>")
    def look(low: pd.Series) -> pd.Series:
        out = []
        for text in low:
            words = text.split()
            at = [i for i, w in enumerate(words) if w in firsts]
            held = {tuple(words[i : i + n]) for i in at for n in sizes} & wanted
            out.append([b" ".join(g).decode() for g in held])
        return pd.Series(out, dtype=object)

    return look(F.lower(F.coalesce(text, F.lit(""))).cast("binary"))


def fingerprint(text: Column, kind: str = "word", size: int = 3, n_bits: int = 2048, vocabulary: Sequence[str] | None = None) -> Column:
    """Sorted on-bits of a text: hashed shingles, or with ``vocabulary`` one bit for each pattern it contains."""
    if vocabulary is not None:
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.array_compact(F.array(*[F.when(low.contains(p.lower()), F.lit(i)) for i, p in enumerate(vocabulary)]))
    if n_bits < 1:
        raise ValueError("n_bits must be positive")
    return F.sort_array(F.array_distinct(F.transform(shingles(text, kind, size), lambda s: F.pmod(F.xxhash64(s), F.lit(n_bits)).cast("int"))))


def pack_bits(bits: Column, n_bits: int) -> Column:
    """On-bits as ``n_bits / 64`` long words."""
    words = -(-n_bits // 64)
    one = F.lit(1).cast("long")
    word = lambda on, w: F.aggregate(
        F.filter(on, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, (b % 64).cast("int")))
    )
    return let(bits, lambda on: F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: word(on, w)))


def unpack_bits(words: Column) -> Column:
    """The sorted on-bits of packed words."""
    one = F.lit(1).cast("long")
    is_on = lambda ws, b: F.call_function("shiftrightunsigned", F.get(ws, F.floor(b / 64).cast("int")), (b % 64).cast("int")).bitwiseAND(one) == 1
    return let(words, lambda ws: F.filter(F.sequence(F.lit(0), F.size(ws) * 64 - 1), lambda b: is_on(ws, b)))


def fold_bits(bits: Column, m: int) -> Column:
    """On-bits folded to ``m`` bits."""
    return F.array_sort(F.array_distinct(F.transform(bits, lambda b: b % m)))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def tanimoto_packed(a: Column, b: Column) -> Column:
    """The same of packed words."""
    add = lambda pairs: F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    shared = add(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))))
    union = add(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))))
    return F.when(union > 0, shared / union).otherwise(0.0)


def landscape_index(difference: Column, similarity: Column) -> Column:
    """Difference over distance, the distance at least 0.001."""
    return F.abs(difference) / F.greatest(1 - similarity, F.lit(1e-3))


def squared_error(p: Column, y: Column) -> Column:
    return F.pow(p - y, F.lit(2.0))


def efficiency(score: Column, size: Column, digits: int = 3) -> Column:
    """-score / size, 0 for size 0, rounded."""
    return F.round(F.when(size > 0, -score / size).otherwise(0.0), digits)


def finite(value: Column) -> Column:
    """NaN and infinite values (and nulls) as 0."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def differences(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def equal_width_bin(value: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Index of the bin; the ends take what lies beyond them."""
    return F.greatest(F.lit(0), F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1))).cast("int")


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def normal_angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Degrees in [0, 90] between two unit normals of either sign."""
    dot = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.abs(dot), F.lit(1.0))))


def stacking_class(angle: Column, face_below: float = 30.0, edge_from: float = 60.0) -> Column:
    return F.when(angle <= face_below, "face").when(angle >= edge_from, "edge").otherwise("none")
