"""SimHash components, vector codes and lexical search against brute force, on small hostile tables."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
import xxhash

from cribrum.llm import lexical_search, simhash_dedup, vector_codes


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and blank texts, repeated rows and ids, ties, copies with edits, one long text, letters beyond ASCII."""
    rng = np.random.default_rng(5)
    words = ["Ka", "lo", "MI9", "été", "x_y", "re-sa", "Ñu", "né.", "tu", "dil"]

    def text(n):
        return " ".join(rng.choice(words, n))

    base = [text(300) for _ in range(4)]
    out = [(i, text(int(rng.integers(1, 60)))) for i in range(30)]
    out += [(100 + 10 * k + i, b.replace(words[i], "edit", i)) for k, b in enumerate(base) for i in range(6)]
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, text(20_000)), (207, "-- !"), (208, "é" * 300)]
    out += [(None, base[0]), (None, None), (100, base[0]), (5, "another text under a known id"), (209, "a\x0bb\x1cc a b"), (210, "Ka Ka Ka lo")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Columns beyond doc_id and text have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, value long, comp string, df double").repartition(3)


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, near):
    """Least place of the component of each value."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(values)), 2):
        if near(values[a], values[b]):
            parent[find(b)] = find(a)
    return [find(x) for x in range(len(values))]


@pytest.mark.parametrize("shard", [simhash_dedup.SHARD, 1])
def test_simhash_equals_brute_force(docs, rows, monkeypatch, shard):
    monkeypatch.setattr(simhash_dedup.linked, "__defaults__", (shard, simhash_dedup.CUTS))
    prints = [fingerprint(t) for _, t in rows]
    comp = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    heads = collections.defaultdict(list)
    for c, (i, _) in zip(comp, rows):
        heads[c] += [i] if i is not None else []
    want = [(i, f"{p:016x}", min(heads[c], default=None)) for (i, _), p, c in zip(rows, prints, comp)]
    assert sorted(map(tuple, simhash_dedup.simhash_components(docs).collect()), key=str) == sorted(want, key=str)
    assert 1 < len(set(comp)) < len(set(prints))


def test_simhash_of_an_empty_table(docs):
    assert simhash_dedup.simhash_components(docs.limit(0)).collect() == []


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_shingles_over_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash_dedup.word_lists, "__defaults__", (piece,))
    monkeypatch.setattr(simhash_dedup, "SHINGLES", 5)
    texts = ["Ab c  d\te f g h", "", "  ", "a", "a b", "a b c", " ".join("word%d" % i for i in range(50))]
    assert simhash_dedup.fingerprints([t.encode() for t in texts]).tolist() == [fingerprint(t) for t in texts]


def flips(rng, value, n):
    return value ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))


def test_bk_trees_find_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "QUERIES", 50)
    rng = np.random.default_rng(1)
    groups = []
    for size in (1, 2, 40, 90):
        seeds = [int(x) for x in rng.integers(0, 1 << 63, 5)]
        groups.append(sorted({flips(rng, seeds[int(rng.integers(5))], int(rng.integers(0, 4))) for _ in range(size)}))
    values = np.array([v for g in groups for v in g], np.uint64)
    forest = simhash_dedup.Forest(np.repeat(np.arange(len(groups)), [len(g) for g in groups]), values)
    found = [(int(a), int(b)) for x, y in forest.links() for a, b in zip(x, y)]
    ends = np.cumsum([len(g) for g in groups])
    want = {(a, b) for lo, hi in zip([0, *ends], ends) for a, b in itertools.combinations(range(lo, hi), 2) if (int(values[a]) ^ int(values[b])).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 20


def test_shards_hold_all_links(spark):
    """Values crowded in few bits, so that shards are cut again and again."""
    rng = np.random.default_rng(2)
    values = sorted({flips(rng, flips(rng, 0xF0F0F0F0, int(rng.integers(0, 3))), int(rng.integers(0, 3))) for _ in range(400)})
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "value long")
    want = {(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2}
    for shard in (3, 4096):
        found = {tuple(sorted(x & (1 << 64) - 1 for x in r)) for r in simhash_dedup.linked(table, shard).collect()}
        assert found == want


def test_cuts_bound_the_shards():
    masks = {0}
    for _ in range(simhash_dedup.CUTS):
        masks = {c & (1 << 64) - 1 for m in masks for c in simhash_dedup.cuts(m)}
    assert max(64 - m.bit_count() for m in masks) == 14


def quantised(table):
    """Product quantisation in Python's whole numbers."""
    kept = [(i, v, lab) for i, v, lab in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    d = width // 8
    rows = [(i, [math.floor(4096 * x) for x in v] + [0] * (width - len(v)), lab) for i, v, lab in kept]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[r[1][p * d : p * d + d] for r in order] for p in range(8)]

    def code(v, p):
        cost = [sum((x - c) ** 2 for x, c in zip(v[p * d : p * d + d], e)) for e in books[p]]
        return cost.index(min(cost)), min(cost)

    for _ in range(6):
        new = []
        for p in range(8):
            members = [[r[1][p * d : p * d + d] for r in rows if code(r[1], p)[0] == e] for e in range(len(books[p]))]
            new.append([[sum(x) // len(m) for x in zip(*m)] if m else books[p][e] for e, m in enumerate(members)])
        books = new
    out = [(i, [code(v, p) for p in range(8)], lab) for i, v, lab in rows]
    errors = collections.Counter()
    for _, c, lab in out:
        errors[lab] += sum(e for _, e in c)
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for k, _ in c), sum(e for _, e in c), errors[lab], name) for i, c, lab in out]


def vectors(n, scale=0.3):
    rng = np.random.default_rng(9)
    out = [(int(i), [float(np.float32(x)) for x in rng.normal(0, scale, 16)], int(i) % 3 if i % 5 else None) for i in rng.permutation(n)]
    out += [(out[0][0], *out[0][1:])] * 3  # repeated rows, and so ties
    return out + [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [math.nan] * 16, 1), (903, [math.inf] * 16, 1), (904, [0.0] * 16, None), (905, [1.0] * 3, 2), (None, [0.5] * 16, 2)]


@pytest.mark.parametrize("n, scale", [(80, 0.3), (5, 0.3), (60, 3000.0)])
def test_vector_codes_equal_brute_force(spark, n, scale):
    table = vectors(n, scale)
    given = spark.createDataFrame([(i, v, lab, 7, "q") for i, v, lab in table], "vec_id long, embedding array<float>, label int, error long, q string").repartition(3)
    got = vector_codes.compress(given)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(quantised(table), key=str)


def test_vector_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for table in ([], [(1, None, 2)]):
        assert vector_codes.compress(spark.createDataFrame(table, schema)).collect() == []
    assert [r.code for r in vector_codes.compress(spark.createDataFrame([(1, [], 2)], schema)).collect()] == ["00" * 8]
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [3e9] * 8, 2)], schema))


@pytest.mark.parametrize("size", [1 << 12, 1 << 28, 1 << 30])
def test_limb_products_are_exact(size):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-size, size, (20, 6)), rng.integers(-size, size, (9, 6))
    a[0], b[0] = size - 1, -size
    assert (vector_codes.products(a, b) == (a.astype(object) @ b.T.astype(object))).all()


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k=20):
    split = [(i, terms(t)) for i, t in docs]
    some, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = collections.Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for i, w in split:
            tf, score = collections.Counter(w), 0
            m = 75 + 25 * len(w) * some // total if total else 0
            for t in terms(text):
                score += math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) if tf[t] else 0
            found += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


ITEMS = [(1, "Ka lo MI9 ka"), (2, "été Ñu, x_y! unknownword"), (3, None), (4, ""), (5, "zzz qqq"), (1, "Ka lo MI9 ka"), (1, "re-sa sa sa"), (None, "tu dil one"), (6, "é" * 300)]


@pytest.mark.parametrize("shard_terms, beam, piece", [(lexical_search.SHARD_TERMS, lexical_search.BEAM, 1 << 20), (150, 2, 9)])
def test_search_equals_brute_force(spark, docs, rows, monkeypatch, shard_terms, beam, piece):
    monkeypatch.setattr(lexical_search, "BEAM", beam)
    monkeypatch.setattr(lexical_search.term_lists, "__defaults__", (piece,))
    items = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id long, text string, rank int")
    some, total = lexical_search.term_counts(docs)
    index = lexical_search.build_index(docs, some, total, shard_terms=shard_terms)
    assert index.selectExpr("sum(size(doc_ids))").first()[0] == some
    for k in (20, 3):
        got = lexical_search.search(index, items, some, k)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(ranking(rows, ITEMS, k), key=str)


def test_search_in_blocks_of_items(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 20)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, lexical_search.rank_documents(docs, items).collect()), key=str) == sorted(ranking(rows, ITEMS), key=str)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.rank_documents(docs.limit(0), items).collect() == []
    assert lexical_search.rank_documents(docs, items.limit(0)).collect() == []
    assert lexical_search.rank_documents(docs, items.where("item_id = 5")).collect() == []


def test_treap_keeps_the_grid():
    """Greatest values at every node, after packing and unpacking, and the best columns of random rows."""
    rng = np.random.default_rng(4)
    cells = np.unique(rng.integers(0, 50, (300, 2)), axis=0)
    value = rng.integers(0, 1000, len(cells))
    depth, masks, drops = lexical_search.Treap.build(cells[:, 0], cells[:, 1], value)
    assert (drops >= 0).all()
    treap = lexical_search.Treap.unpack(depth, lexical_search.Treap.pack(masks, drops))
    grid = np.zeros((64, 64), np.int64)
    grid[cells[:, 0], cells[:, 1]] = value
    assert treap.greatest[0] == grid.max()
    for rows in ([3], [1, 7, 30], list(range(50))):
        weights = rng.integers(1, 9, len(rows))
        sums = weights @ grid[rows]
        column, score = treap.best(np.array(rows), weights, 5, 0)
        assert (sums[column] == score).all()
        cut = max(1, int(np.sort(sums)[-5]))
        assert sorted(column) == sorted(np.flatnonzero(sums >= cut))
