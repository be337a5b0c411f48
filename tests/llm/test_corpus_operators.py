"""The corpus operators against brute force, round trips and held-out accuracy, on small hostile tables."""

import collections
import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from cribrum.llm import anchors, decontaminate, html_text, language_id, media, near_dup, packing, quality, registry, substring_dedup, suffix_array_dedup, token_store
from cribrum.llm.tables import new_path

SF = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "sa", "né") for b in ("x", "ra", "von", "dil", "p", "st")]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and blank texts, repeated rows, repeated ids, exact and near copies, shared passages, one very long text."""
    rng = np.random.default_rng(3)
    base, passage, long = text(rng, 120), text(rng, 60), text(rng, 30_000)
    out = [(i, text(rng, int(rng.integers(1, 150)))) for i in range(25)]
    out += [(100 + i, base) for i in range(12)]
    out += [(120 + i, base.replace(WORDS[i], "edit", 1)) for i in range(8)]
    out += [(140 + i, f"{text(rng, 40)} {passage} {text(rng, 40)}") for i in range(6)]
    out += [(160, None), (161, ""), (162, " \t\n"), (163, "é" * 700), (164, long), (165, "ab" * 400), (None, base), (None, None), (100, base), (5, "another text under a known id"), (166, "x " * 90)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The table has columns whose names the operators use themselves."""
    full = [(i, t, "en", "src", None if t is None else len(t), 1, 2.0, "z") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, k int, score double, node string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def covered(sequences, width):
    count = collections.Counter(s[i : i + width] for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - width + 1):
            if count[s[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("crowd", [4096, 2])
def test_suffix_array_equals_brute_force(docs, rows, monkeypatch, crowd):
    monkeypatch.setattr(suffix_array_dedup, "CROWD", crowd)  # groups of more stretches than this are sorted window by window
    raws = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), raw, gone in zip(rows, raws, covered(raws, 200)):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [tuple(r) for r in suffix_array_dedup.digest_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_array_text(docs, rows):
    raws = [(t or "").encode() for _, t in rows]
    want = sorted((str(i), np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")) for (i, _), raw, gone in zip(rows, raws, covered(raws, 200)))
    out = suffix_array_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == want
    assert out.where("n_chars <> length(text) or k <> 1 or node <> 'z'").count() == 0


def test_substring_equals_brute_force(docs, rows):
    split = [tuple((t or "").encode().split()) for _, t in rows]
    want = sorted(
        ((i, len(w), int(g.sum()), hashlib.sha256(b" ".join(x for x, gone in zip(w, g) if not gone)).hexdigest()) for (i, _), w, g in zip(rows, split, covered(split, 35))), key=str
    )
    assert sorted((tuple(r) for r in substring_dedup.digest_windows(docs).collect()), key=str) == want


def test_repeats_of_thue_morse_words(spark):
    """Words for which a polynomial hash modulo a power of two has one value, whatever its base."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    assert anchors.word_symbols(np.frombuffer(one.encode(), np.uint8)) != anchors.word_symbols(np.frombuffer(other.encode(), np.uint8))
    fill = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([*fill[:17], one, *fill[17:]])), (2, " ".join([*fill[:17], other, *fill[17:]]))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.digest_windows(docs).collect()] == [0, 0]


@pytest.mark.parametrize("dedup", [suffix_array_dedup.digest_repeats, substring_dedup.digest_windows])
def test_repeats_of_empty_and_unique_tables(spark, empty, dedup):
    assert dedup(empty).count() == 0
    lone = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup(lone).collect()} == {1: 0, 2: 0, 3: 0}


def test_near_classes_equal_brute_force(docs, rows):
    sets = [(i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set()) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a][1] and sets[b][1] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1]):
            parent[find(b)] = find(a)
    members = collections.defaultdict(list)
    for x in range(len(sets)):
        members[find(x)].append(sets[x][0])
    want = []
    for x, (i, s) in enumerate(sets):
        ids = [m for m in members[find(x)] if m is not None]
        want.append((i, min(ids) if ids else None, len(members[find(x)])))
    got = [(r.doc_id, r.class_id, r.class_size) for r in near_dup.near_classes(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_inside_a_crowded_bucket(spark):
    """Pairs of near copies that share much of their text with all other pairs, in one bucket for all."""
    rng = np.random.default_rng(12)
    base = text(rng, 200)
    table = []
    for k in range(45):
        own = " ".join(f"w{k}x{j}" for j in range(60))
        table += [(2 * k, f"{base} {own}"), (2 * k + 1, f"{base} {own} and more words here")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in table)]
    near = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near == {(2 * k, 2 * k + 1) for k in range(45)}
    # A single register a band: nearly all texts share each bucket.
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dup.near_classes(docs, bands=12, rows=1).collect()}
    assert got == {i: (i - i % 2, 2) for i in got} and len(got) == 90


def test_prefix_filter_loses_no_pair(spark):
    rng = np.random.default_rng(21)
    seeds = [text(rng, 60).split() for _ in range(4)]
    table = []
    for i in range(60):
        words = list(seeds[i % 4])
        for j in rng.integers(0, len(words), int(rng.integers(0, 4))):
            words[j] = f"edit{rng.integers(0, 6)}"
        table.append((i, i, " ".join(words[: int(rng.integers(50, 61))])))
    rows = spark.createDataFrame(table, "node long, comp long, text string")
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for *_, t in table)]
    near = {(a, b) for a, b in itertools.combinations(range(60), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {tuple(sorted(r)) for r in near_dup.prefix_pairs(rows, 0.8).collect()}
    assert near and near <= got


def test_near_copies_that_differ_in_repeat_counts(spark):
    rng = np.random.default_rng(31)
    table = []
    for k in range(20):
        own = " ".join(f"w{k}x{j}" for j in range(100))
        line = " ".join(f"l{k}x{j}" for j in range(10))
        table += [(2 * k, f"{line} {line} {own}"), (2 * k + 1, f"{line} {' '.join([line] * 100)} {own}")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dup.near_classes(docs).collect()}
    assert got == {i: (i - i % 2, 2) for i in range(40)}


def test_keep_one_leaves_one_of_each_class(docs):
    kept = near_dup.keep_one(docs)
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert kept.columns == docs.columns and sum(100 <= i < 140 for i in ids) == 1
    assert {160, 161, 162} <= set(ids)
    # Two different texts under one id are two documents; rows alike in both are one.
    assert sorted(i for i in ids if ids.count(i) > 1) == [5, 5]


def test_keep_one_of_texts_under_one_id(spark):
    """Whatever the partitions: of near copies under one id one stays, always the same; other texts stay too."""
    rng = np.random.default_rng(13)
    base, other = text(rng, 120), text(rng, 80)
    near = base.replace(base.split()[5], "edit", 1)
    table = [(5, base), (5, near), (5, other), (6, near), (5, other), (7, None), (7, None), (8, "")]
    kept = [sorted(map(str, near_dup.keep_one(spark.createDataFrame(t, "doc_id long, text string").repartition(n)).collect())) for n, t in ((1, table), (3, table[::-1]))]
    assert kept[0] == kept[1] and len(kept[0]) == 4
    assert sum(f"text='{other}'" in r for r in kept[0]) == 1 and sum("doc_id=5" in r for r in kept[0]) == 2


def test_prob_min_hash_estimates_probability_jaccard():
    element = np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = np.array([1, 2, 3, 4.0, 0, 0]), np.array([2, 2, 1, 0, 3, 1.0])
    owner = np.array([0] * 4 + [1] * 5)
    both = np.concatenate([element[x > 0], element[y > 0]])
    m = 4096
    s = near_dup.prob_min_hash(owner, both, np.concatenate([x[x > 0], y[y > 0]]), 2, m)
    exact = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(6)) for i in range(6) if x[i] and y[i])
    assert abs((s[0] == s[1]).mean() - exact) < 4 * np.sqrt(exact / m)


def test_decontamination(spark):
    rng = np.random.default_rng(8)
    item, other = text(rng, 24), text(rng, 18)
    words = item.split()
    some = " ".join(w if i % 9 else "changed" for i, w in enumerate(words))
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "too short")], "item_id long, text string")
    table = [(1, f"a {item.upper()}! b"), (2, f"{text(rng, 30)} {some} c"), (3, text(rng, 200)), (4, None), (5, ""), (6, "too short"), (7, "far too short"), (1, "again"), (None, other)]
    docs = spark.createDataFrame([(*r, 1, 1) for r in table], "doc_id long, text string, h int, item_id int")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.overlaps(docs, bench).collect()}
    # "too short" has two tokens: only a document of just these holds it.
    assert set(got) == {(1, 1), (2, 1), (None, 2), (6, 4)} and got[(1, 1)] == 24 and got[(2, 1)] == 21
    kept = [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([3, 4, 5, 7, None], key=str)
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_partial_items_are_dropped(spark):
    rng = np.random.default_rng(9)
    item = [f"i{j}" for j in range(59)]
    short = [f"s{j}" for j in range(17)]
    table = [(1, item[20:45]), (2, short[:8] + short[9:]), (3, item[20:28]), (4, [])]
    docs = spark.createDataFrame([(i, f"{text(rng, 30)} {' '.join(w)} {text(rng, 30)}") for i, w in table], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [3, 4]


def test_items_with_a_word_put_in_or_left_out(spark):
    """Both halves count together, in the query as in the pipeline; chance agreement of a token counts once."""
    rng = np.random.default_rng(10)
    item = [f"i{j}" for j in range(20)]
    table = [(1, [*item[:10], "more", *item[10:]]), (2, item[:7] + item[8:14]), (3, item[:5] + ["x"] * 12 + item[5:8]), (4, item[:6] + item[:6] + item[:6])]
    docs = spark.createDataFrame([(i, f"{text(rng, 9)} {' '.join(w)} {text(rng, 9)}") for i, w in table], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {(r.doc_id, r.n_matched) for r in decontaminate.overlaps(docs, bench).collect()} == {(1, 20), (2, 13)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [3, 4]


def test_decontamination_recall(spark):
    """Against SQL that looks at every alignment: nine in ten of the finds at least, for items of each length, with 30 of 100 tokens changed."""
    import duckdb

    rng = np.random.default_rng(11)
    items, docs = [], []
    for n in range(16, 60):
        for k in range(20):
            own = [f"t{n}x{k}x{j}" for j in range(n)]
            items.append((100 * n + k, " ".join(own)))
            docs.append((100 * n + k, " ".join(["before", *(w if rng.random() >= 0.3 else "changed" for w in own), "after"])))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    whole = {r[0] for r in con.execute(decontaminate.oracle("true")).fetchall()}
    found = {r.doc_id for r in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= whole
    for n in range(16, 60, 4):
        of = {i for i in whole if n <= i // 100 < n + 4}
        assert len(of & found) >= 0.9 * len(of) and len(of) > 40


def test_decontamination_of_a_very_long_text(spark):
    rng = np.random.default_rng(12)
    item = [f"i{j}" for j in range(30)]
    docs = spark.createDataFrame([(1, f"{text(rng, 100_000)} {' '.join(item)} {text(rng, 100_000)}"), (2, text(rng, 200_000)), (3, " ".join(item * 300))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.overlaps(docs, bench).orderBy("doc_id").collect()] == [(1, 7, 30, 30), (3, 7, 30, 30)]


def test_decontamination_by_shuffle_is_the_same(spark, monkeypatch):
    """With null and repeated ids of different texts, on both sides, and short items."""
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r.text for r in b.orderBy("item_id").limit(4).collect()]
    odd = [(None, items[0]), (None, "nothing here"), (1, items[1]), (1, "x " * 30 + items[2]), (-2, "one two three four five six"), (-3, "one two three four")]
    d = d.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    b = b.select("item_id", "text").union(spark.createDataFrame([(-1, "One, two; three four five."), (-1, "another text"), (-4, "Four")], "item_id long, text string"))
    want = sorted(map(str, decontaminate.overlaps(d, b).collect()))
    kept = sorted(map(str, decontaminate.drop_contaminated(d, b).collect()))
    assert any("item_id=-1" in r and "doc_id=-2" in r for r in want) and not any("doc_id=-3" in r for r in want) and any("doc_id=None" in r for r in want)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontaminate.overlaps(d, b).collect())) == want
    assert sorted(map(str, decontaminate.drop_contaminated(d, b).collect())) == kept


def test_token_store_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(200, "a  b\n\n c"), (201, "it's <|endoftext|> x"), (202, "tab\tand space, 12,5. (x)"), (203, "日本語 テキスト"), (204, " lead and trail ")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    path = token_store.write_store(table, new_path(spark, "test"), public_tokenizers.path("byte_bpe_50k.json"))
    got = token_store.read_store(spark, path).collect()
    ordered = sorted(rows + extra, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in ordered:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got), key=lambda r: r[1]) == want
    assert token_store.read_document(spark, path, 204).tolist() == tokenizer.encode(" lead and trail ", add_special_tokens=False).ids + [0]
    assert token_store.read_document(spark, path, 999) is None
    plan = spark.read.parquet(f"{path}/shards").where("least <= 204 and most >= 204").select("payload")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(least,204)" in plan


def test_token_store_forgets_beyond_its_bound(monkeypatch):
    """The ids are the same however few chunks are remembered."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(17)
    texts = [text(rng, 200) for _ in range(5)]
    want = [a.tolist() for a in token_store.Encoder(path).encode(texts)]
    monkeypatch.setattr(token_store, "REMEMBERED", 0)
    encoder = token_store.Encoder(path)
    encoder.size = 1
    assert [a.tolist() for t in texts for a in encoder.encode([t])] == want and len(encoder.rest) == 0


def test_token_store_of_an_empty_table(spark, empty):
    path = token_store.write_store(empty, new_path(spark, "test"), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_store(spark, path).count() == 0


def test_media_round_trip(docs, rows):
    got = media.media_features(media.with_media(docs)).collect()
    want = collections.Counter()
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_payload = collections.defaultdict(set)
    for r in got:
        by_payload[(r.n_bytes, r.payload_sha256)].add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(v) == 1 for v in by_payload.values())


def test_general_and_uniform_scans_agree(monkeypatch):
    payload = np.random.default_rng(5).integers(0, 256, 192 * 3, dtype=np.uint8)
    image = media.encode_image(payload)
    fast = media.decode_images(image)[0]
    monkeypatch.setattr(media, "_uniform", lambda *a: 0)
    slow = media.decode_images(image)[0]
    assert (fast.width, fast.height) == (1536, 24)
    assert fast.thumbnail.tobytes() == slow.thumbnail.tobytes() == payload.tobytes()


def test_payload_of_several_images(monkeypatch):
    monkeypatch.setattr(media, "DOWN", 2)
    payload = np.arange(192 * 5, dtype=np.uint64).astype(np.uint8)
    images = media.decode_images(media.encode_payload(payload))
    assert len(images) == 3 and b"".join(i.thumbnail.tobytes() for i in images) == payload.tobytes()


def test_html(spark):
    page = (
        '<html><head><title>no</title><script>var a = "</p>";</script></head><body><nav><a>menu</a></nav><header>site</header><div class="ad">buy, now.</div>'
        "<article><header><h1>Head &amp; line</h1></header><p>One  two,<br>three.<p><b>Bold</b>face<div class='cookie-notice'>ok</div><section id='comments'><p>reader, said.</p></section></article>"
        "<aside>side</aside><form><p>field</p></form><footer>&copy; f</footer></body></html>"
    )
    pages = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (1, "u", page, 1)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_text.main_text(pages).where("url is not null").collect())
    main = "Head & line One two, three. Boldface"
    assert got == [(1, "u", main, len(main)), (1, "u", main, len(main)), (3, "v", "", 0)]
    assert [tuple(r) for r in html_text.main_text(pages).where("url is null").collect()] == [(2, None, "", 0)]
    assert html_text.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(var i=0;i<n;i++){f(i)}</script>",
        "<script>if(a<b){} // don't</script>",
        "<SCRIPT>var t = \"<b title='\";</Script >",
        "<style>a:before{content:'<x'}</style>",
        "<title>a <b isn't</title>",
        "<svg><style>a<b{}</style><script>x<y</script></svg>",
    ],
)
def test_html_after_raw_text(raw):
    assert html_text.extract(f"<html><head>{raw}</head><body>{raw}<article><p>It's one.</p>{raw}<p>It's two.</p></article></body></html>") == "It's one. It's two."


def test_html_scores_decide_with_an_article():
    story = "".join(f"<p>This is sentence {i} of the story, told at length; it has words, commas, and an end.</p>" for i in range(9))
    teaser = f"<body><div class='story'>{story}</div><section><article><p>Read more</p></article></section></body>"
    assert "sentence 8 of the story" in html_text.extract(teaser)
    links = "<div><div><span>Share</span></div><ul><li>Like</li><li>Post</li></ul><ol><li>Mail</li></ol></div>"
    got = html_text.extract(f"<body><article><h1>Title</h1>{story}{links}</article></body>")
    assert got.startswith("Title This is sentence 0") and "sentence 8" in got and "Mail" not in got


def test_html_of_unbalanced_quotes_and_marked_pages():
    assert html_text.extract('<p>He said <b title="x>bold more.</p>') == "He said bold more."
    assert html_text.extract("<p>It <i don't>is</i> so <b <i>here</i>.</p>") == "It is so here."
    assert html_text.extract('<div class="comment-free notice-board"><p>The only text, of the article.</p></div>') == "The only text, of the article."
    assert html_text.extract("a < b, and 5 > 3. <") == "a < b, and 5 > 3. <"


def test_html_threshold_decides(monkeypatch):
    story = "".join(f"<p>This is sentence {i} of the story, told at length; it has words, commas, and an end.</p>" for i in range(3))
    page = f"<body><nav><ul><li>one</li><li>two</li></ul></nav><article><h1>Title</h1>{story}</article><footer>Foot, note. And so on.</footer></body>"
    assert html_text.extract(page).startswith("Title This is") and "Foot" not in html_text.extract(page)
    monkeypatch.setattr(html_text, "CUT", 0.0)
    assert "one two" in html_text.extract(page) and "Foot" in html_text.extract(page)
    monkeypatch.setattr(html_text, "CUT", 100.0)
    assert html_text.extract(page) == ""


@pytest.mark.parametrize("page", ["<div>a" * 40_000, '<p>x <b title="x>y\' ' * 20_000, "<p a='b\" " * 40_000, "<ul>" + "<div>" * 20_000 + "<li>x" * 20_000, "< " * 100_000, "<!-- a" * 40_000])
def test_html_takes_linear_time(page):
    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 3


@pytest.mark.parametrize(
    "old, new, more",
    [
        ("</article>", '<p class="note">See also it.</p><ul class="k"><li>one</li><li>two</li></ul></article>', "See also it. one two"),
        ("</h1>", '</h1><p class="by">By Ann</p>', "By Ann"),
        ("</h1>", '</h1><div><span>By</span> <b>Ann</b></div>', "By Ann"),
        ("</article>", "<h2>Part</h2><p>x</p><table><caption>T</caption><tr><td>Q1</td><td>Q2</td></tr></table></article>", "Part x T Q1 Q2"),
        ("</article>", "<div class='w'><div><table><tr><td>Q1</td><td>Q2</td></tr></table></div></div></article>", "Q1 Q2"),
        ("</article>", "<figure><img src='x'><figcaption>Fig. 1</figcaption></figure><blockquote>Q3</blockquote><pre>Q4 x</pre></article>", "Fig. 1 Q3 Q4 x"),
        ("</article>", "<section><section><dl><dt>Q5</dt><dd>v</dd></dl></section><ol><li>i</li></ol></section></article>", "Q5 v i"),
    ],
)
@pytest.mark.parametrize("element", ["article", "main", "div class='text'"])
def test_html_keeps_short_blocks_of_the_article(spark, old, new, more, element):
    """Lists, tables, bylines, captions and nested containers stay, on every page, whatever element holds the article."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(40).collect():

        def body(page):
            return page.replace("<article>", f"<{element}>").replace("</article>", f"</{element.split()[0]}>")

        plain, longer = html_text.extract(body(r.html)), html_text.extract(body(r.html.replace(old, new)))
        at = longer.find(more)
        assert at >= 0 and " ".join((longer[:at] + longer[at + len(more) :]).split()) == plain


def test_html_containers_by_their_ratios(spark):
    """Pages whose tags and class words say nothing: no text of the article is lost, and most of the rest is left out."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    bare = [re.sub("<(/?)(nav|footer|article)>", r"<\1div>", p).replace(' class="ad"', "") for p in pages]
    texts = [(html_text.extract(a), html_text.extract(b)) for a, b in zip(pages, bare)]
    assert all(a in b for a, b in texts)
    assert sum(a == b for a, b in texts) >= 0.65 * len(pages)


def test_html_teasers_and_menus_by_their_ratios():
    story = "".join(f"<p>This is sentence {i} of the story, told at length; it has words, commas, and an end.</p>" for i in range(9))
    menu = "<div><ul><li>Home</li><li>News</li><li>Shop</li></ul></div>"
    assert html_text.extract(f"<body>{menu}<div>{story}</div></body>") == html_text.extract(f"<body><div>{story}</div>{menu}</body>")
    assert "Shop" not in html_text.extract(f"<body>{menu}<div>{story}</div></body>")
    assert "Read more" not in html_text.extract(f"<body><div>{story}</div><section><article><p>Read more</p></article></section></body>")


def test_html_without_article_elements(spark):
    """The ratios find the article by its text; only what tags and class words say of the rest is left."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    bare = [p.replace("<article>", "").replace("</article>", "") for p in pages]
    assert sum(html_text.extract(a) == html_text.extract(b) for a, b in zip(pages, bare)) >= 0.99 * len(pages)


def test_html_of_all_pages(spark):
    """Every generated page: the blocks of its article element."""
    import html as entities
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert html_text.extract(r.html) == " ".join(p for p in parts if p)


def brute_cost(lengths, counts, buckets):
    best = float("inf")
    for k in range(min(buckets, len(lengths))):
        for cut in itertools.combinations(range(len(lengths) - 1), k):
            edges = [*cut, len(lengths) - 1]
            at, cost = 0, 0
            for e in edges:
                cost += lengths[e] * sum(counts[at : e + 1])
                at = e + 1
            best = min(best, cost)
    return best


def test_bucket_boundaries_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, 8, replace=False)) + 1
        counts = rng.integers(1, 20, 8)
        bounds = packing.boundaries(lengths, counts, 3)
        cost = sum(c * next(b for b in bounds if b >= n) for n, c in zip(lengths, counts))
        assert cost == brute_cost(lengths.tolist(), counts.tolist(), 3)


def quadratic_cost(lengths, counts, buckets):
    seen = np.concatenate([[0], np.cumsum(counts)])
    best, least = np.concatenate([[0.0], np.full(len(lengths), np.inf)]), np.inf
    for _ in range(min(buckets, len(lengths))):
        cost = best[:, None] + lengths[None, :] * (seen[None, 1:] - seen[:, None])
        cost[np.arange(len(lengths) + 1)[:, None] > np.arange(len(lengths))[None, :]] = np.inf
        best = np.concatenate([[np.inf], cost.min(axis=0)])
        least = min(least, best[-1])
    return least


def test_bucket_boundaries_of_long_documents_are_optimal():
    rng = np.random.default_rng(14)
    for n in (1, 2, 37, 300):
        lengths = np.sort(rng.choice(60_000, n, replace=False)) + 1
        counts = rng.integers(1, 1000, n)
        bounds = packing.boundaries(lengths, counts, 16)
        assert len(bounds) <= 16 and set(bounds) <= set(lengths.tolist())
        assert sum(int(c) * next(b for b in bounds if b >= x) for x, c in zip(lengths, counts)) == quadratic_cost(lengths, counts, 16)


def test_packing_of_equal_and_no_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, " \n")], "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert {(r.n_tokens, r.bucket, r.bucket_len, r.batch) for r in got} == {(0, 0, 1, 0)} and sorted(r.slot for r in got) == [0, 1, 2, 3]


def test_packing(docs, rows, empty):
    got = packing.pack(docs, buckets=4, budget=300).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert all(max(1, r.n_tokens) <= r.bucket_len for r in got)
    batches = collections.defaultdict(list)
    for r in got:
        batches[(r.bucket, r.batch)].append(r)
    for members in batches.values():
        assert len(members) <= max(1, 300 // members[0].bucket_len)
        assert sorted(m.slot for m in members) == list(range(len(members)))
    assert packing.pack(empty).count() == 0


def test_language(spark, docs, empty):
    out = registry.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    model = language_id.train(docs)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).where("doc_id >= 160").collect()}
    assert odd[160] == odd[161] == odd[162] == ("und", 0.0) and odd[163][0] == "en"
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_language_of_many_languages(spark):
    """More than 512 languages, one of few documents each, are all learned."""
    rng = np.random.default_rng(6)
    letters = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 4000))
    table, langs = [], 600
    for k in range(langs):
        words = ["".join(rng.choice(list(letters[6 * k : 6 * k + 6]), 3)) for _ in range(8)]
        table += [(4 * (langs * j + k), " ".join(rng.choice(words, 12)), f"l{k:03}") for j in range(3)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(4)
    out = language_id.identify(docs, language_id.train(docs)).join(docs, "doc_id")
    learned = {r[0] for r in docs.where(~language_id.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert len(learned) > 512 and {r[0] for r in out.where("not held_out").select("lang_pred").distinct().collect()} == learned
    assert out.where("not held_out and lang <> lang_pred").count() == 0


def test_language_by_brute_force():
    """Kernel, Nystroem features and ridge solution against plain sets and the dual form."""
    texts = ["the cat sat", "der Hund lief", "the dog ran", "die Katze sass", "le chat noir", "le chien court", "The END.", "das Ende!"]
    langs = ["en", "de", "en", "de", "fr", "fr", "en", "de"]
    bits = language_id.presence(texts)
    for t, row in zip(texts, bits):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        grams = {s[i : i + n] for n in language_id.GRAMS for i in range(len(s) - n + 1)}
        assert len(grams) - 2 <= row.sum() <= len(grams)  # a few share a bit
    model = language_id.fit(bits, langs)
    assert len(model.landmarks) == len(texts)
    k = model.kernel(bits).astype(float)
    cos = (bits @ model.landmarks.T) / np.sqrt(bits.sum(1)[:, None] * model.landmarks.sum(1)[None, :])
    assert np.allclose(k, cos, atol=1e-6)
    # With every text a landmark the features are exact, and the primal solution is the dual one.
    order = [int(np.flatnonzero((bits == x).all(1))[0]) for x in model.landmarks]
    full = k[:, np.argsort(order)]
    target = np.where(np.array(langs)[:, None] == np.array(sorted(set(langs))), 1.0, -1.0)
    w = np.diag([1 / 3 / langs.count(x) for x in langs])
    ridge = language_id.RIDGE * np.trace(full @ w) / len(texts)
    dual = full @ np.linalg.solve(w @ full + ridge * np.eye(len(texts)), w @ target)
    assert np.allclose(k @ model.weights, dual, atol=1e-3)


def test_quality(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    out = registry.QUERIES["op9_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (100, 1, 0), (4, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels)
    assert quality.score(docs, net, ["doc_id"]).where("score between 0 and 1").count() == docs.count()
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.train(docs, labels.limit(0)) is None and quality.score(empty, None, ["doc_id"]).count() == 0


def test_quality_forward_pass_by_brute_force():
    rng = np.random.default_rng(2)
    net = quality.ByteNet.new(3)
    net.bias[:] = rng.normal(0, 0.1, len(net.bias))
    for n in (0, 5, 1024, 1025, 3000):
        raw = np.frombuffer(text(rng, n)[:n].encode(), np.uint8)
        half, sums = quality.CHUNK // 2, []
        for at in range(0, max(1, len(raw) - half), half):
            piece = raw[at : at + quality.CHUNK]
            chunk = np.concatenate([piece, np.zeros(quality.CHUNK - len(piece), np.uint8)])
            again = np.zeros(len(chunk))
            for end in range(quality.GRAM, len(chunk)):
                gram = chunk[end - quality.GRAM + 1 : end + 1]
                again[end] = any(end - lag >= quality.GRAM - 1 and (gram == chunk[end - lag - quality.GRAM + 1 : end - lag + 1]).all() and (gram != 0).all() for lag in quality.LAGS)
            best = np.full(quality.FILTERS, -np.inf)
            for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                under = slice(p, p + quality.WIDTH)
                best = np.maximum(best, net.embed[chunk[under]].ravel() @ net.filters + again[under] @ net.again)
            sums.append(np.maximum(best + net.bias, 0))
        want = 1 / (1 + np.exp(-(np.mean(sums, axis=0) @ net.out + net.shift[0])))
        assert abs(net.scores([raw])[0] - want) < 1e-4


def test_quality_gradients_by_differences():
    rng = np.random.default_rng(5)
    raws = [np.frombuffer(text(rng, int(n)).encode(), np.uint8) for n in (40, 300, 3)]
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    net = quality.ByteNet.new(9)
    for name in ("embed", "filters", "again", "bias", "out", "shift"):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        p = net.scores(raws)
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / weight.sum()

    for name, gradient in zip(("embed", "filters", "again", "bias", "out", "shift"), net.gradients(raws, target, weight)):
        values = getattr(net, name)
        for at in [np.unravel_index(i, gradient.shape) for i in np.argsort(-np.abs(gradient), axis=None)[:3]]:
            was, step = values[at], 1e-5
            values[at] = was + step
            up = loss()
            values[at] = was - step
            down = loss()
            values[at] = was
            assert abs((up - down) / (2 * step) - gradient[at]) < 1e-3 * max(1.0, abs(gradient[at])), name


def test_pipeline_keeps_clean_documents(spark):
    """Stage by stage on the smallest tables: what each drops it has a reason to drop."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "bucket", "batch", "slot"} <= set(out.columns)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in d.select("doc_id").collect()} and len(ids) > 100
    leaked = {r.doc_id for r in decontaminate.overlaps(d, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not leaked & set(ids)


def test_stages_keep_columns_of_any_name(spark, rows, empty):
    """Names with dots and back-quotes, and those of columns that the operators make; each stage against brute force or its operator."""
    extra = ["a.b", "_likely", "back`quote", "hit", "_c0", "marks", "n_chars", "lang"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in extra)])
    some = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    docs = spark.createDataFrame([(i, t, *range(len(extra))) for i, t in some], schema)
    bench = spark.createDataFrame([(1, some[0][1])], "item_id long, text string")
    item = some[0][1].split()
    labels = spark.createDataFrame([(1, 1), (2, 0), (100, 1), (4, 0)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(some)
    one = near_dup.keep_one(docs)
    assert one.columns == docs.columns and one.where("`a.b` <> 0 or `back``quote` <> 2").count() == 0
    short = suffix_array_dedup.drop_repeats(docs)
    raws = [(t or "").encode() for _, t in some]
    want = sorted((str(i), np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")) for (i, _), raw, gone in zip(some, raws, covered(raws, 200)))
    assert short.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in short.collect()) == want
    clean = decontaminate.drop_contaminated(docs, bench)
    if len(item) >= 8:
        gone = {i for i, t in some if i is not None and " ".join(item) in " ".join((t or "").split())}
        left = {r.doc_id for r in clean.collect()}
        assert clean.columns == docs.columns and gone and not gone & left and {160, 161, 162, None} <= left
    none = docs.limit(0)
    assert near_dup.keep_one(none).count() == 0 and suffix_array_dedup.drop_repeats(none).count() == 0
    assert decontaminate.drop_contaminated(none, bench).count() == 0 and near_dup.near_classes(empty).count() == 0
    assert media.media_features(media.with_media(empty)).count() == 0 and packing.pack(docs).count() == len(some)


def found_by_brute_force(text, items):
    """Whether an item is in the text, by every alignment, as ``decontaminate.overlaps`` says."""
    tokens = re.findall(r"[^\W_]+", (text or "").lower())
    for item in items:
        own = re.findall(r"[^\W_]+", (item or "").lower())
        n, at = len(own), collections.defaultdict(set)
        for i, t in enumerate(tokens):
            for j, u in enumerate(own):
                if t == u:
                    at[i - j].add(j)
        for shift, places in at.items():
            near = set().union(*(p for s, p in at.items() if abs(s - shift) <= decontaminate.NEAR))
            if n >= 8 and (len(near) >= max(8, n / 2) or any(len([y for y in places if x <= y < x + 13]) >= 11 for x in places)):
                return True
            if 0 < n < 8 and len(places) == n and (n >= 5 or len(tokens) == n):
                return True
    return False


def test_pipeline_by_brute_force(spark, rows, tmp_path):
    """The whole chain over nulls, repeats, hostile texts and columns of any name, stage after stage as loops have it."""
    rng = np.random.default_rng(14)
    # Words of its own: chance agreement over many alignments is for the seeds to leave out.
    item = " ".join(f"i{j}" for j in range(30))
    some = [r for r in rows if r[1] is None or len(r[1]) < 5000] + [(300, f"{text(rng, 20)} {item} {text(rng, 20)}"), (301, f"{text(rng, 60)}"), (302, item)]
    extra = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("a.b", "_key", "n_chars", "score", "back`quote"))])
    docs = spark.createDataFrame([(i, t, 0, 1, 2, 3, 4) for i, t in some], extra)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(1, 20)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, "w1 w2 w3")], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    good = [(r.doc_id, r.text) for r in quality.keep_good(docs, labels).select("doc_id", "text").collect()]
    # Near duplicates: of each class one of least doc_id stays, and every row without doc_id or words.
    sets = {t: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for _, t in good}
    pairs = sorted({(i, t) for i, t in good if i is not None}, key=str)
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(pairs)), 2):
        x, y = sets[pairs[a][1]], sets[pairs[b][1]]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            parent[find(b)] = find(a)
    classes = collections.defaultdict(list)
    for x, p in enumerate(pairs):
        classes[find(x)].append(p)
    unique = [min(c, key=lambda p: (p[0], hashlib.md5((p[1] or "").encode()).digest())) for c in classes.values()] + [p for p in good if p[0] is None]
    raws = [(t or "").encode() for _, t in unique]
    short = [(i, np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")) for (i, _), raw, gone in zip(unique, raws, covered(raws, 200))]
    gone = {i for i, t in short if i is not None and found_by_brute_force(t, [item, "w1 w2 w3"])}
    left = [(i, len(t.split())) for i, t in short if i not in gone]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.n_tokens) for r in out.collect()), key=str) == sorted(left, key=str)
    assert {300, 302} & {i for i, _ in short} == {300, 302} & gone and len(left) > 25


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
