"""Each operator against its oracle or a brute-force version, and on the awkward cases that its docstring defines."""

import gzip
import io
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import TINY, same_rows
from pyspark.sql import functions as F

from palisade.llm import blobs, common, extraction, hashing, jaccard, mixing, pieces, quality, queries, shards, substring, topk, urlfilter, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
    if extra:
        for name in ("row", "words", "n", "e", "keep", "copies", "rate", "l", "f", "d", "t", "block", "shard", "longest", "th", "action"):
            df = df.withColumn(name, F.lit(1))
    return df


AWKWARD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (None, "one"), (5, "one"), (5, "one"), (6, LONG), (7, LONG + " end"), (8, "x" * 50_000)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(name, spark, duck):
    same_rows(queries.queries()[name](spark, TINY), duck, queries.oracle_sql()[name])


# 1 SentencePiece


def test_pieces_equal_the_library():
    import sentencepiece

    model = open(queries.MODEL, "rb").read()
    ours, library = pieces.Encoder(model, cached_words=50, cached_chars=400), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    alphabet = "ab ▁ \n\té日🙂x.,thein<s>0́ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(20_000)), "日本語 の テキスト。word日word" * 50, "the" * 5000, "a" * 9999, "  lead", "trail  ", "<s>abc</s> <0x0A>"]
    for text in texts:
        ids = ours.encode(text)
        assert ids == library.encode(text) and ours.decode(ids) == library.decode(ids)
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(8)]
        assert ours.decode(ids) == library.decode(ids)


def test_pieces_backtrack_equals_merging():
    e = pieces.Encoder(open(queries.MODEL, "rb").read())
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("▁ntheaiosr") for _ in range(rng.randint(1, 25)))
        assert e.backtrack(text) == e.merge(text)


def merge_model(pieces_, bytes_=False):
    """A model file of merge type with these pieces and scores."""
    import struct

    def field(number, data):
        assert len(data) < 128
        return bytes([number << 3 | 2, len(data)]) + data

    out = field(1, field(1, b"<unk>") + bytes([3 << 3, pieces.UNKNOWN]))
    for b in range(256 if bytes_ else 0):
        out += field(1, field(1, b"<0x%02X>" % b) + bytes([3 << 3, pieces.BYTE]))
    for piece, score in pieces_.items():
        out += field(1, field(1, piece.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score))
    return out + field(2, bytes([3 << 3, 2]) + (bytes([0x98, 0x02, 1]) if bytes_ else b""))


@pytest.mark.parametrize("seed", range(40))
def test_pieces_merged_together_equal_merging(seed):
    """Random models: ties, scores in any order, characters that are no pieces, pieces across words, no pieces at all."""
    rng = random.Random(seed)
    alphabet = "ab🙂▁"
    pieces_ = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))): float(-rng.randint(0, 6)) for _ in range(rng.choice([0, 3, 30, 60]))}
    e = pieces.Encoder(merge_model(pieces_, seed % 2 == 0), cached_words=200, cached_chars=3000)
    for _ in range(20):
        texts = ["".join(rng.choice("ab🙂 z日") for _ in range(rng.randint(0, rng.choice([9, 63, 64, 150])))) for _ in range(30)]
        ids, counts = e.expand(np.concatenate([e.codes(t) for t in texts]))
        want = [[i for p in e.merge(e.normal(t)) for i in e.ids_of(p)] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and [e.encode(t) for t in texts] == want


def test_pieces_short_words_are_not_encoded_one_by_one(monkeypatch):
    import sentencepiece

    e = pieces.Encoder(open(queries.MODEL, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    rng = random.Random(8)
    text = " ".join("".join(rng.choice(["th", "ea", "tion", "é", "ß", "i"]) for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    calls = []
    monkeypatch.setattr(e, "backtrack", lambda word: calls.append(word))
    assert e.encode(text) == library.encode(text) and not calls


def test_pieces_query(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    rows = queries.op1_sentencepiece(spark, TINY).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]]
    out = {(r["doc_id"], r["decoded"]): r["ids"] for r in pieces.encode(docs(spark, AWKWARD, True), queries.MODEL).collect()}
    assert out[1, None] is None and out[2, ""] == [] and out[6, LONG] == library.encode(LONG)
    assert pieces.encode(docs(spark, []), queries.MODEL).count() == 0


# 2 mixing


def dense_rates(rows, source_alpha=0.8, lang_alpha=0.9, epochs=1.5):
    """The dual solved over single documents, by plain gradient and curvature."""
    rows = [r for r in rows if r[2] > 0]
    n = np.array([r[2] for r in rows], float)
    total = n.sum()
    z = np.log(n)
    center = (n * z).sum() / total
    scale = math.sqrt((n * (z - center) ** 2).sum() / total) or 1.0
    z = (z - center) / scale
    keys_s, keys_l = sorted({r[0] for r in rows}, key=str), sorted({r[1] for r in rows}, key=str)
    x = np.zeros((len(rows), len(keys_s) + len(keys_l) + 1))
    for i, (s, lang, _) in enumerate(rows):
        x[i, keys_s.index(s)] = x[i, len(keys_s) + keys_l.index(lang)] = 1
    x[:, -1] = z
    have = (n[:, None] * x).sum(0)[:-1]
    shares = np.concatenate([have[: len(keys_s)] ** source_alpha, have[len(keys_s) :] ** lang_alpha])
    shares[: len(keys_s)] /= shares[: len(keys_s)].sum()
    shares[len(keys_s) :] /= shares[len(keys_s) :].sum()
    target = np.append(shares * epochs, 0.0)
    theta = np.zeros(x.shape[1])
    for _ in range(200):
        w = n / total * np.exp(x @ theta)
        gradient = target - x.T @ w - 1e-10 * theta
        theta += 0.7 * np.linalg.lstsq(x.T @ (w[:, None] * x) + 1e-10 * np.eye(len(theta)), gradient, rcond=1e-14)[0]
    return dict(zip([tuple(r) for r in rows], np.exp(x @ theta), strict=True)), (x, n, target * total)


def test_mixing_meets_targets(spark):
    out = queries.op2_source_mixing(spark, TINY).collect()
    expected, _ = dense_rates([(r["source"], r["lang"], r["n_tokens"]) for r in out])
    for r in out:
        if r["n_tokens"]:
            assert r["rate"] == pytest.approx(expected[r["source"], r["lang"], r["n_tokens"]], rel=1e-5)
        assert r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)
    total = sum(r["n_tokens"] for r in out)
    have = Counter()
    got = Counter()
    for r in out:
        have[r["source"]] += r["n_tokens"]
        got[r["source"]] += r["n_tokens"] * r["rate"]
    norm = sum(v**0.8 for v in have.values())
    for s, v in have.items():
        assert got[s] / total == pytest.approx(1.5 * v**0.8 / norm, rel=1e-5)
    assert sum(r["n_tokens"] * r["copies"] for r in out) == pytest.approx(1.5 * total, rel=0.15)


def test_mixing_awkward(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y z", None, None), (4, "x y", "en", "a"), (4, "x y", "en", "a"), (5, LONG, "fr", "b")]
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], DOC)
    out = mixing.rates(df).collect()
    assert len(out) == 6 and all(math.isfinite(r["rate"]) for r in out)
    assert [r["copies"] for r in out if not r["n_tokens"]] == [1, 1]
    assert len({r["copies"] for r in out if r["doc_id"] == 4}) == 1
    assert mixing.mix(df).count() == sum(r["copies"] for r in out) and mixing.mix(df).columns == df.columns
    only = {r["doc_id"]: r["copies"] for r in mixing.rates(df, source_weights={"b": 1.0, "absent": 2.0}).collect()}
    assert only[4] == 0 and only[5] >= 1 and only[1] == 1
    assert mixing.rates(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, AWKWARD, True)).columns == docs(spark, AWKWARD, True).columns


# 3 extraction


def test_extraction_finds_articles(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{TINY}/pages.parquet").collect()}
    scores = []
    for r in queries.op3_html_extraction(spark, TINY).collect():
        truth = Counter(html.unescape(re.sub(r"<[^>]+>", " ", re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1])).split())
        got = Counter(r["text"].split())
        both = sum((truth & got).values())
        scores.append(2 * both / (sum(truth.values()) + sum(got.values())))
    assert len(scores) == len(pages) and sum(scores) / len(scores) > 0.92


def plain_content(page):
    """Lines, ratios, smoothing and threshold of a well-formed page by string operations alone."""
    import html
    import re

    page = re.sub(r"(?s)<!DOCTYPE[^>]*>|<!--.*?-->", "", page)
    lines, tags, held, count, hidden = [], [], "", 0, 0

    def close():
        nonlocal held, count
        text = " ".join(html.unescape(held).split())
        held = ""
        if text:
            lines.append(text)
            tags.append(count)
            count = 0

    raw = None
    for token in re.findall(r"(?s)<[^>]+>|[^<]+|<", page):
        m = re.fullmatch(r"(?s)<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", token)
        if m and (raw is None or m[1] and m[2].lower() == raw):
            end, tag = bool(m[1]), m[2].lower()
            if tag in ("script", "style"):
                raw = None if end else tag
            if end and tag in extraction.HIDDEN:
                hidden -= 1
            if end:
                count += 1
            if tag in extraction.BLOCKS:
                close()
            if not end:
                count += 1
                hidden += tag in extraction.HIDDEN
        elif not hidden:
            first, *rest = token.split("\n")
            held += first
            for part in rest:
                close()
                held += part
    close()
    x = [len(t) / max(c, 1) for t, c in zip(lines, tags)]
    k = {d: math.exp(-(d**2) / 2) for d in (-1, 0, 1)}
    near = [[j for j in (i - 1, i, i + 1) if 0 <= j < len(x)] for i in range(len(x))]
    smoothed = [sum(k[j - i] * x[j] for j in js) / sum(k[j - i] for j in js) for i, js in enumerate(near)]
    mean = sum(smoothed) / max(len(smoothed), 1)
    least = 0.5 * math.sqrt(sum((v - mean) ** 2 for v in smoothed) / max(len(smoothed), 1))
    chosen = [v >= least for v in smoothed]
    if not any(chosen):
        chosen = [True] * len(chosen)
    return "\n".join(t for t, c in zip(lines, chosen) if c), len(lines), sum(chosen)


def test_extraction_query_equals_brute_force(spark):
    for sf in (TINY, "/root/testdata/sf0.01"):
        pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
        rows = queries.op3_html_extraction(spark, sf).collect()
        assert len(rows) == len(pages)
        for r in rows:
            assert (r["text"], r["n_lines"], r["n_content"]) == plain_content(pages[r["page_id"]]), r["page_id"]


def test_extraction_smoothing_and_awkward(spark):
    x = np.array([1.0, 5.0, 2.0, 0.0])
    k = {d: math.exp(-(d**2) / 2) for d in (-1, 0, 1)}
    plain = [sum(k[j - i] * x[j] for j in range(4) if abs(i - j) <= 1) / sum(k[j - i] for j in range(4) if abs(i - j) <= 1) for i in range(4)]
    assert np.allclose(extraction.smooth(x, 1), plain)
    assert extraction.content("") == ("", 0, 0) and extraction.content("plain") == ("plain", 1, 1)
    assert extraction.content("<p>a<script>no</script>b &amp; c</p>")[0] == "ab & c"
    assert extraction.content("<![if x]><p>text <![endif")[1] <= 1
    assert "deep" in extraction.content("<div>" * 5000 + "deep " * 100)[0]
    df = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>t"), (2, "u", "<p>t")], "page_id long, url string, html string").withColumn("text", F.lit(0))
    out = extraction.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["text"] or "") for r in out) == [(0, ""), (1, ""), (2, "t"), (2, "t")]
    assert [r["text"] for r in out if r["page_id"] == 1] == [None] and extraction.extract(df.limit(0)).count() == 0


def test_extraction_goes_on_after_odd_declarations():
    for odd in ("<![x]>", "<![ b>", "<![0]>", "<![>", "<![endif-->", "<![if !IE]>", "<![CDATA[x]]>", "<!ELEMENT [>", "<!DOCTYPE html [<x>"):
        text = extraction.content(f"<p>one</p>{odd}<p>two</p><p>three ]></p>")[0].split()
        assert text[0] == "one" and text[-3:] == ["two", "three", "]>"], odd
    assert extraction.content("<p>if a <![ b then <b>c</b> d</p><p>two</p>")[0].split()[-3:] == ["c", "d", "two"]
    assert extraction.content("<p>one</p><![x two")[0].split()[-1] == "two"


def test_extraction_ends_unclosed_hidden_elements():
    def words(html):
        return extraction.content(html)[0].split()

    assert words("<html><head><title>T</title><main><p>real text</p></main>") == ["real", "text"]
    assert words("<head><meta charset=utf-8><title>T<main><p>real text</p></main>") == ["real", "text"]
    assert words("<head><title>T</title><style>s</style><script>x</script>real <b>text</b>") == ["real", "text"]
    assert words("<head><noscript><img></noscript><title>A <i>T</i></title><link></head><p>real text") == ["real", "text"]
    for tag in ("object", "svg", "noscript", "iframe", "template"):
        assert words(f"<body><{tag}><p>real text</p><p>more</p></body>") == ["real", "text", "more"], tag
        # An end tag further on belongs to another element; the enclosing block's end comes first.
        assert words(f"<div><{tag}></div><p>real text</p><{tag}><div>no</div></{tag}><p>more</p>") == ["real", "text", "more"], tag
        assert words(f"<p>real<div><{tag}><div>no</div><p>no</p>no</{tag}>text</div>") == ["real", "text"], tag
    assert words("<p>real<script>no</p>no") == ["real"]


# 4 sharding


def test_shard_plan():
    def shard(i, size):
        return shards.Shard(f"s{i}", size, 1)

    assert shards.plan([shard(i, 10) for i in range(3)], 100) == []
    merges = shards.plan([shard(i, 10) for i in range(25)], 100)
    assert [sum(s.bytes for s in m) for m in merges] == [100, 100, 50] and [s.name for s in merges[0]] == [f"s{i}" for i in range(10)]
    assert shards.plan([shard(0, 1), shard(1, 10), shard(2, 100), shard(3, 40)], 1000) == []
    for sizes in ([7, 9, 8, 30, 31, 29, 33, 400], [1] * 50 + [45] * 5):
        listed = [shard(i, s) for i, s in enumerate(sizes)]
        merged = [s for m in shards.plan(listed, 90) for s in m]
        assert len({s.name for s in merged}) == len(merged) and all(sum(s.bytes for s in m) <= 90 for m in shards.plan(listed, 90))


def test_shard_store(spark):
    store = shards.ShardStore(spark, common.fresh_path(spark, "store"))
    with pytest.raises(ValueError):
        store.read()
    df = docs(spark, [(i, f"text {i}") for i in range(100)])
    for k in range(6):
        store.append(df.where(F.col("doc_id") % 6 == k).coalesce(1))
    assert store.version() == 6 and len(store.shards()) == 6
    with pytest.raises(shards.Conflict):
        store.commit(3, [], None)
    store.compact()
    assert store.version() == 7 and len(store.shards()) == 1 and store.shards()[0].rows == 100
    assert store.read(6).count() == 100  # older versions stay readable until vacuum
    assert store.vacuum() == 0 and store.vacuum(least_age=0) == 6 and store.read().drop("shard").exceptAll(df).count() == 0 and store.read().count() == 100
    assert store.compact() == 7


def test_shards_awkward(spark):
    df = docs(spark, AWKWARD, True)
    out = shards.compacted(df)
    assert out.drop("shard").exceptAll(df.drop("shard")).count() == 0 and out.count() == len(AWKWARD)
    assert shards.compacted(docs(spark, [])).count() == 0
    rows = queries.op4_sharding(spark, TINY)
    assert rows.count() == rows.select("doc_id").distinct().count() == spark.read.parquet(f"{TINY}/documents.parquet").count()


def test_sharding_query_merges_whole_rows(spark, monkeypatch):
    seen, compact = [], shards.ShardStore.compact

    def watched(store, *args, **kwargs):
        before = len(store.shards())
        version = compact(store, *args, **kwargs)
        seen.append((before, store.shards()))
        return version

    monkeypatch.setattr(shards.ShardStore, "compact", watched)
    given = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = queries.op4_sharding(spark, TINY)
    assert rows.columns == given.columns
    assert rows.exceptAll(given).count() == 0 and rows.count() == given.count()
    ((before, after),) = seen
    assert before >= 8 > len(after) and any(s.level for s in after)


def test_shards_of_times_and_nested_columns(spark):
    store = shards.ShardStore(spark, common.fresh_path(spark, "times"))
    df = spark.sql("""SELECT id, timestamp'2024-01-02 03:04:05.678901' + make_interval(0, 0, 0, cast(id AS int)) AS at, timestamp_ntz'2024-01-02 03:04:05.678901' AS local, date'2024-01-02' AS day,
        cast(id AS decimal(20, 3)) AS price, array(named_struct('t', timestamp'2024-01-02 03:04:05', 'x', id)) AS list, map('k', id) AS pairs, cast('é' AS binary) AS raw, if(id % 2 = 0, NULL, 'x') AS s FROM range(40)""")
    for k in range(5):
        store.append(df.where(F.col("id") % 5 == k).coalesce(1))
    before = sorted(map(repr, store.read().drop("shard").collect()))
    store.compact()
    assert len(store.shards()) == 1 and sorted(map(repr, store.read().drop("shard").collect())) == before == sorted(map(repr, df.collect()))
    events = spark.read.parquet(f"{TINY}/events.parquet")
    assert shards.compacted(events).drop("shard").exceptAll(events).count() == 0


def test_shards_of_changing_columns(spark):
    store = shards.ShardStore(spark, common.fresh_path(spark, "columns"))
    for k in range(4):
        store.append(spark.createDataFrame([(k, f"t{k}")], "id long, text string").coalesce(1))
    store.append(spark.createDataFrame([("o",)], "other string").coalesce(1))
    with pytest.raises(ValueError, match="column id"):
        store.append(spark.createDataFrame([("x",)], "id string"))
    expected = sorted([(k, f"t{k}", None) for k in range(4)] + [(None, None, "o")], key=repr)
    assert sorted((tuple(r)[:3] for r in store.read().collect()), key=repr) == expected
    store.compact()
    assert len(store.shards()) < 5 and sorted((tuple(r)[:3] for r in store.read().collect()), key=repr) == expected


def plain_plan(sizes, target, low, high, least):
    """The tiers and merges by plain enumeration over (size, place)."""
    tiers = []
    for size, place in sorted((s, i) for i, s in enumerate(sizes) if s < target * low):
        mean = sum(s for s, _ in tiers[-1]) / len(tiers[-1]) if tiers else 0
        if tiers and low * mean <= size <= high * mean:
            tiers[-1].append((size, place))
        else:
            tiers.append([(size, place)])
    merges = []
    for tier in tiers:
        if len(tier) >= least:
            runs = [[]]
            for place, size in sorted((p, s) for s, p in tier):
                if sum(sizes[p] for p in runs[-1]) + size > target:
                    runs.append([])
                runs[-1].append(place)
            merges += [r for r in runs if len(r) > 1]
    return merges


def test_shard_plan_equals_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        sizes = [rng.choice([rng.randint(1, 20), rng.randint(1, 400), 7]) for _ in range(rng.randint(0, 40))]
        target = rng.choice([50, 100, 1000])
        listed = [shards.Shard(f"s{i}", s, 1) for i, s in enumerate(sizes)]
        assert [[int(s.name[1:]) for s in m] for m in shards.plan(listed, target)] == plain_plan(sizes, target, 0.5, 1.5, 4)


# 5 substring


def test_windows_hash_alike():
    words = hashing.mix(np.arange(200, dtype=np.uint64) % np.uint64(7))
    found = hashing.window_hashes(words, 14, 0x9E3779B97F4A7C15)
    assert len(set(found.tolist())) == 7 and found[0] == found[7]


def test_substring_passages(spark):
    texts = [(1, f"start {PASSAGE} one two"), (2, f"other {PASSAGE} rest"), (3, "clean " + LONG[:2000]), (4, PASSAGE), (5, " ".join(PASSAGE.split()[:49]))]
    out = {r["doc_id"]: r for r in substring.report(docs(spark, texts)).collect()}
    assert set(out) == {1, 2, 4} and out[1]["spans"] == "" and out[2]["text"] == "other rest" and out[4]["text"] == ""
    kept = {r["doc_id"]: r for r in substring.remove(docs(spark, texts)).collect()}
    assert set(kept) == {1, 2, 3, 5} and kept[2]["text"] == "other rest" and kept[2]["n_chars"] == 10 and kept[1]["text"] == texts[0][1]


def test_substring_equals_brute_force(spark, monkeypatch):
    from test_pipeline import deduplicated

    rng = random.Random(9)
    passages = [" ".join(f"p{k}x{i}" for i in range(rng.randint(8, 30))) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, passages[0] + " same everywhere") for i in range(30)] + [rows[3], rows[3]]
    for words in (500_000, 150):
        monkeypatch.setattr(blobs, "FLUSH_WORDS", words)
        got = Counter((r["doc_id"], r["text"]) for r in substring.remove(docs(spark, rows), 8).collect())
        expected = Counter(deduplicated(rows[:-2], 8))
        expected[next(x for x in expected if x[0] == 3)] += 2
        assert got == expected, words
        levels = {r["doc_id"]: r["longest"] for r in substring.report(docs(spark, rows), 8).collect()}
        places = Counter()
        for length in (8, 16, 32, 64):
            for i, text in dict(rows).items():
                w = text.split()
                places.update((length, *w[p : p + length]) for p in range(len(w) - length + 1))
        for i, text in dict(rows).items():
            w = text.split()
            best = max((n for n in (8, 16, 32, 64) for p in range(len(w) - n + 1) if places[n, *w[p : p + n]] > 1), default=None)
            assert levels.get(i) == best


def test_substring_awkward(spark):
    df = docs(spark, AWKWARD, True)
    out = substring.remove(df)
    assert out.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert Counter(rows) == Counter([x for x in AWKWARD if x[0] != 7] + [(7, " end")])
    found = substring.report(df).collect()
    assert {r["doc_id"]: r["longest"] for r in found} == {6: 50 * 512, 7: 50 * 512}
    assert substring.report(docs(spark, [])).count() == 0 and substring.remove(docs(spark, [])).count() == 0
    twice = docs(spark, [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)])
    assert [(r["doc_id"], r["text"]) for r in substring.remove(twice).collect()] == [(None, PASSAGE)]
    assert substring.report(docs(spark, [(1, PASSAGE), (1, PASSAGE)])).count() == 0
    inside = substring.report(docs(spark, [(1, f"{PASSAGE} gap {PASSAGE}")])).collect()
    assert inside[0]["spans"] == "61-121"


# 6 URL filters


def test_urls_awkward(spark):
    entries = [
        ("domain", "bad.org", "add", "block", "2024-01-10"), ("domain", "bad.org", "remove", "block", "2024-02-10"), ("host", "ok.bad.org", "add", "allow", "2024-01-01"),
        ("prefix", "ok.bad.org/ads", "add", "block", "2024-01-01"), ("host", "tie.org", "add", "allow", "2024-01-01"), ("host", "tie.org", "add", "block", "2024-01-01"),
        ("host", None, "add", "block", "2024-01-01"), ("host", "tie.org", "add", "block", "2024-01-01"), (None, "x", "add", "block", None),
    ]
    e = spark.createDataFrame(entries, "kind string, key string, event string, action string, day string").withColumn("day", F.to_date("day"))
    urls = [("http://a.bad.org/x", "2024-01-09"), ("http://a.bad.org/x", "2024-01-10"), ("http://a.BAD.org:80", "2024-02-09"), ("http://bad.org", "2024-02-10"), ("https://u@ok.bad.org/ads/1?q", "2024-01-20"),
        ("http://ok.bad.org/adserver", "2024-01-20"), ("http://tie.org", "2024-03-01"), (None, "2024-03-01"), ("nonsense", "2024-03-01"), ("http://tie.org", None), ("http://tie.org", "2024-03-01"), ("http://" + "a" * 5000 + ".org/" + "b/" * 50, "2024-03-01")]
    c = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(urls)], "row int, url string, day string").withColumn("day", F.to_date("day")).withColumn("kind", F.lit(1)).withColumn("blocked", F.lit(0))
    out = urlfilter.judge(c, e)
    got = {r["row"]: (r["blocked"], r["matched"]) for r in out.collect()}
    assert [got[i][0] for i in range(12)] == [False, True, True, False, True, False, True, False, False, False, True, False]
    assert got[4][1] == "prefix:ok.bad.org/ads" and got[5][1] == "host:ok.bad.org" and out.columns == ["row", "url", "day", "kind", "action", "matched", "blocked"]
    assert urlfilter.judge(c.limit(0), e).count() == 0 and urlfilter.judge(c, e.limit(0)).where("blocked").count() == 0


def test_urls_short_keys(spark):
    entries = [("domain", "zip", "add", "block"), ("prefix", "a.org", "add", "block"), ("prefix", "b.org/", "add", "block"), ("prefix", "c.org/ads/", "add", "block"), ("host", "ok.zip", "add", "allow")]
    e = spark.createDataFrame([(*x, "2024-01-01") for x in entries], "kind string, key string, event string, action string, day string").withColumn("day", F.to_date("day"))
    urls = ["http://x.y.zip/p", "http://zip", "http://ok.zip/p", "http://notzip/", "http://a.org", "http://a.org/p/q", "http://b.org/", "http://c.org/ads/1", "http://c.org/adserver", "http://a.organ/", "http://zip.org"]
    c = spark.createDataFrame([(u, "2024-02-01") for u in urls], "url string, day string").withColumn("day", F.to_date("day"))
    got = {r["url"]: r["matched"] for r in urlfilter.judge(c, e).collect()}
    assert [got[u] for u in urls] == ["domain:zip", "domain:zip", "host:ok.zip", None, "prefix:a.org", "prefix:a.org", "prefix:b.org", "prefix:c.org/ads", None, None, None]


def test_urls_odd_entries_and_hot_hosts(spark):
    entries = [("host", "UPPER.org"), ("prefix", "h.org/"), ("host", "[::1]"), ("domain", ".dot.org"), ("domain", "*.star.org."), ("prefix", "Case.org/Path/"), ("domain", "bad.org")]
    e = spark.createDataFrame([(*x, "add", "block", "2024-01-01") for x in entries], "kind string, key string, event string, action string, day string").withColumn("day", F.to_date("day"))
    urls = ["http://upper.org/x", "http://h.org/x", "http://[::1]:8080/x", "http://a.dot.org", "http://b.star.org/", "http://case.org/Path/x", "http://case.org/path/x", "http://bad.org./x", "http://notbad.org"]
    c = spark.createDataFrame([(u, "2024-02-01") for u in urls * 30], "url string, day string").withColumn("day", F.to_date("day"))
    out = urlfilter.judge(c, e)
    assert {r["url"]: r["blocked"] for r in out.collect()} == {u: u not in ("http://case.org/path/x", "http://notbad.org") for u in urls} and out.count() == 270
    # A hot host with an event every day: as many captures as rows, whatever the number of its intervals.
    e = spark.sql("SELECT 'host' AS kind, 'hot.org' AS key, if(id % 3 = 0, 'remove', 'add') AS event, if(id % 2 = 0, 'allow', 'block') AS action, date_add(date'2024-01-01', cast(id AS int)) AS day FROM range(300)")
    c = spark.sql("SELECT id, concat('http://hot.org/', id % 7) AS url, date_add(date'2023-12-30', cast(id % 310 AS int)) AS day FROM range(3000)")
    for r in urlfilter.judge(c, e).collect():
        k = min(r["id"] % 310 - 2, 299)
        assert r["action"] == (None if k < 0 or k % 3 == 0 else "allow" if k % 2 == 0 else "block")


# 7 WARC


def test_warc_ranges_cover_every_member_once():
    rng = random.Random(1)
    members = [gzip.compress(warc.record(i, f"http://h/{i}", rng.randbytes(rng.randrange(400)).hex()), 6, mtime=0) for i in range(60)]
    data = b"".join(members)
    for step in (1, 7, 64, 500, 10**6):
        seen = []
        for start in range(0, len(data), step):
            seen += [h["x-page-id"] for _, h, _ in warc.records(io.BytesIO(data), start, min(start + step, len(data)), len(data))]
        assert seen == [str(i) for i in range(60)]
    broken = data[: len(members[0]) + 20] + b"\xff" * 8 + data[len(members[0]) + 28 :]
    assert [h["x-page-id"] for _, h, _ in warc.records(io.BytesIO(broken), 0, len(broken), len(broken))] == ["0", *(str(i) for i in range(2, 60))]
    fake = gzip.compress(b"no record") + warc.MAGIC * 3 + members[5]
    assert [h["x-page-id"] for _, h, _ in warc.records(io.BytesIO(fake), 0, len(fake), len(fake))] == ["5"]
    double = gzip.compress(warc.record(1, "a", "x") + warc.record(2, "b", ""))
    assert [(h["x-page-id"], b[-1:]) for _, h, b in warc.records(io.BytesIO(double), 0, len(double), len(double))] == [("1", b"x"), ("2", b"\n")]
    assert list(warc.records(io.BytesIO(members[3][:-9]), 0, 99, len(members[3]) - 9)) == []


def test_warc_nested_files_at_every_split_size(spark, tmp_path):
    inner = b"".join(gzip.compress(warc.record(900 + i, "inner", f"page {i}"), 6, mtime=0) for i in range(3))
    outer = warc.record(2, "outer", None).replace(b"Content-Length: 0", b"Content-Length: %d" % len(inner))[:-4] + inner + b"\r\n\r\n"
    parts = [gzip.compress(warc.record(1, "a", "one"), 6, mtime=0), gzip.compress(outer, 0, mtime=0), gzip.compress(warc.record(3, "b", "three"), 6, mtime=0)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", sum(map(len, parts)))], "path string, bytes long")
    for step in (60, 200, 10**6):
        assert sorted(r["page_id"] for r in warc.read(spark, files, step).collect()) == [1, 2, 3], step
    twice = files.unionByName(files)
    assert warc.read(spark, twice, 100).count() == 6


def test_warc_awkward(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "http://é", "a\r\n\r\nb"), (2, "http://é", "a\r\n\r\nb"), (3, "x", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = [tuple(r) for r in warc.round_trip(df.withColumn("bytes", F.lit(1)), split_bytes=300).collect()]
    assert Counter(out) == Counter(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


# 8 quality


def test_quality_keeps_the_good(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = queries.op8_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in out}
    assert n.get((1, False), 0) == 0 and n[0, False] > 0.9 * (n[0, False] + n.get((0, True), 0))


def test_quality_order_and_awkward(spark):
    rules = [quality.Rule("none", "false"), quality.Rule("all", "true"), quality.Rule("half", "length(text) > 1")]
    ordered = quality.order_rules([quality.Estimate(rules[0], 1.0, 0.0), quality.Estimate(rules[1], 4.0, 1.0), quality.Estimate(rules[2], 1.0, 0.5)])
    assert [r.name for r in ordered] == ["half", "all", "none"]
    shared = [quality.Estimate(quality.Rule(n, "size(w) > 1"), s, x, 2.0) for n, s, x in (("a", 0.1, 0.9), ("b", 0.1, 0.1))] + [quality.Estimate(rules[2], 1.0, 0.5)]
    assert [r.name for r in quality.order_rules(shared)] == ["half", "a", "b"]  # 0.9 rejections in 2.1 s, then 0.1 in 0.1 s
    df = docs(spark, AWKWARD, True)
    out = quality.judge(df)
    assert out.columns.count("keep") == 1 and set(out.columns) == set(df.columns)
    assert [(r["doc_id"], r["keep"]) for r in out.orderBy(F.col("doc_id").asc_nulls_first(), "keep").collect()] == [(None, True), (1, False), (2, False), (3, False), (4, True), (5, True), (5, True), (6, True), (7, True), (8, False)]
    assert quality.filter_documents(df).count() == 6 and quality.filter_documents(df).columns == df.columns
    assert quality.judge(docs(spark, [])).count() == 0 and quality.judge(docs(spark, [(1, "a")]), []).first()["keep"]


def test_quality_knows_scripts_without_spaces(spark):
    rng = random.Random(2)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(3000))
    sentences = "。\n".join(chinese[i : i + 60] for i in range(0, 3000, 60))
    thai = " ".join("".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(50)) for _ in range(40))
    mixed = "ordinary words in a line of plain prose with " * 3 + "x" * 1001
    long_words = " ".join("y" * 30 + str(i) for i in range(20))
    greek = " ".join("ΑΒΓΔΕΖΗΘ" for _ in range(10))
    rows = [(1, chinese), (2, sentences), (3, thai), (4, mixed), (5, long_words), (6, greek), (7, "plain words")]
    out = {r["doc_id"]: r["keep"] for r in quality.judge(docs(spark, rows)).collect()}
    assert out == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True}


def test_quality_keeps_long_clean_documents(spark):
    rng = np.random.RandomState(8)
    # Words by Zipf's law: of 150,000 words 13 % are distinct, of 20,000 words 38 %.
    ranks = np.arange(1, 60_001)
    drawn = rng.choice(ranks, 150_000, p=1 / ranks / (1 / ranks).sum())
    letters = np.array(list("abcdefghij"))
    words = ["w" + "".join(letters[list(map(int, str(r)))]) for r in drawn.tolist()]
    share = lambda w: len(set(w)) / len(w)
    assert share(words) < 0.3 < min(share(words[i : i + 20_000]) for i in range(0, 150_000, 20_000))
    clean, looped = " ".join(words), " ".join(words[:1000] * 150)
    half = " ".join(words[:75_000] + words[:100] * 750)
    out = {r["doc_id"]: r["keep"] for r in quality.judge(docs(spark, [(1, clean), (2, looped), (3, half), (4, " ".join(words[:20_000]))])).collect()}
    assert out == {1: True, 2: False, 3: False, 4: True}


# 9 Jaccard


def brute_pairs(rows, threshold=0.5):
    sets = []
    for i, text in rows:
        w = (text or "").split()
        if w:
            sets.append((i, frozenset(" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2)))))
    pairs = Counter()
    for x in range(len(sets)):
        for y in range(x + 1, len(sets)):
            a, b = sets[x][1], sets[y][1]
            if Fraction(len(a & b), len(a | b)) >= Fraction(threshold):
                pairs[tuple(sorted((sets[x][0], sets[y][0]), key=lambda v: (v is not None, v)))] += 1
    return pairs


def family(seed, count=40, vocabulary=30):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(vocabulary)}" for _ in range(60)]
    rows = []
    for i in range(count):
        words = list(base) if rng.random() < 0.7 else [f"c{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    return rows + rows[:5]


def brute_classes(rows, threshold):
    """Every row's id, class and number of links, by comparing all pairs of rows."""
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append(frozenset(" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else None)
    links, root = [0] * len(rows), list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            a, b = sets[x], sets[y]
            if a and b and Fraction(len(a & b), len(a | b)) >= Fraction(threshold):
                links[x] += 1
                links[y] += 1
                low, high = sorted((root[x], root[y]))
                root = [low if v == high else v for v in root]
    ids = {}
    for (i, _), v in zip(rows, root, strict=True):
        ids[v] = i if ids.get(v) is None else ids[v] if i is None else min(i, ids[v])
    return Counter((i, ids[v], n) for (i, _), v, n in zip(rows, root, links, strict=True))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("tile,words", [(2048, 500_000), (3, 300)])
def test_jaccard_equals_brute_force(spark, monkeypatch, threshold, tile, words):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(blobs, "FLUSH_WORDS", words)
    rows = family(int(threshold * 10)) + [(None, "b c d"), (90, "b c d"), (91, "b"), (92, "b"), (93, ""), (94, None), (None, "q"), (None, "q")]
    assert Counter(tuple(r) for r in jaccard.join(docs(spark, rows, True), threshold=threshold).collect()) == brute_classes(rows, threshold)


def test_jaccard_hot_grams_and_groups(spark, monkeypatch):
    """Documents that share all grams but their own: every gram is hot, and one group holds them all."""
    monkeypatch.setattr(jaccard, "TILE", 3)
    shared, other = " ".join(f"t{i}" for i in range(20)), " ".join(f"s{i}" for i in range(9))
    rows = [(i, f"{shared} own{i}") for i in range(23)] + [(100 + i, f"{other} {shared} mine{i}") for i in range(7)] + [(200 + i, f"{other} at{i} {other}") for i in range(6)]
    for words in (500_000, 60):
        monkeypatch.setattr(blobs, "FLUSH_WORDS", words)
        for threshold in (0.5, 0.8):
            assert Counter(tuple(r) for r in jaccard.join(docs(spark, rows), threshold=threshold).collect()) == brute_classes(rows, threshold)


def test_jaccard_keep_one(spark):
    rows = [(i + 1000, t) for i, t in family(4)] + AWKWARD
    df = docs(spark, rows, True)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    edges = brute_pairs(rows)
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(b)] = root(a)
    groups = {}
    for i, t in rows:
        if (t or "").split():
            groups.setdefault(root(i), []).append((i, t))
    expected = Counter([r for r in rows if not (r[1] or "").split()])
    for g in groups.values():
        low = min(i if i is not None else -1 for i, _ in g)
        expected[low if low >= 0 else None] += 1
    got = Counter()
    for r in kept.collect():
        got[(r["doc_id"], r["text"]) if not (r["text"] or "").split() else r["doc_id"]] += 1
    assert got == expected
    assert jaccard.keep_one(docs(spark, [])).count() == 0 and jaccard.join(docs(spark, [])).count() == 0
    assert jaccard.keep_one(docs(spark, [(1, "a b c d"), (2, "x y z")])).count() == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 3)]
    out = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(chain, "fa long, fb long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 10 top-k


@pytest.mark.parametrize("dims", [64, 6, 1])
def test_topk_equals_brute_force(spark, dims):
    rng = np.random.RandomState(dims)
    data = np.float32(rng.randint(-3, 4, (150, dims)) if dims == 6 else rng.randn(150, dims) + rng.randint(0, 3, (150, 1)) * 5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dims", F.lit(0))
    out = {}
    for r in topk.search(df, 4, block_rows=20).collect():
        out[r["vec_id"], r["rank"]] = (r["neighbor_id"], r["distance"])
    exact = np.float64(data)
    for i in range(150):
        d = ((exact - exact[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(150), d)) if j != i][:4]
        assert [out[i, k + 1] for k in range(4)] == [(j, round(math.sqrt(d[j]), 6)) for j in order]


def test_topk_awkward(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [9.0] * 5), (7, [4.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(((r["vec_id"] or 0, r["rank"], r["neighbor_id"], r["distance"]) for r in topk.search(df, 2).collect()), key=repr)
    assert out == sorted([(1, 1, None, 0.0), (1, 2, 1, 0.0), (1, 1, None, 0.0), (1, 2, 1, 0.0), (0, 1, 1, 0.0), (0, 2, 1, 0.0), (7, 1, None, 5.0), (7, 2, 1, 5.0)], key=repr)
    assert topk.search(df.limit(0)).count() == 0


def test_topk_queries_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(topk, "FILE_BLOCKS", 2)
    monkeypatch.setattr(topk, "TASK_QUERIES", 10)
    rng = np.random.RandomState(4)
    centers = rng.randn(6, 16) * 20
    # A third of all rows are one vector; the others lie in clusters far apart.
    data = np.float32([centers[0] if i % 3 == 0 else centers[i % 6] + rng.randn(16) for i in range(400)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(None, [0.0] * 16)], "vec_id long, embedding array<float>")
    out = {}
    for r in topk.search(df, 5, F.col("vec_id") % 20 == 0, block_rows=8).collect():
        out.setdefault(r["vec_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    exact = np.concatenate([np.float64(data), np.zeros((1, 16))])
    assert sorted(out) == list(range(0, 400, 20))
    for i, found in out.items():
        d = ((exact - exact[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.append(np.arange(400), -1), d)) if j != i][:5]
        assert sorted(found) == [(k + 1, None if j == 400 else j, round(math.sqrt(d[j]), 6)) for k, j in enumerate(order)]


def test_bounds_never_exceed_distances():
    rng = np.random.RandomState(0)
    a, b = rng.randn(50, 64), rng.randn(50, 64)
    exact = ((a - b) ** 2).sum(1)
    last = np.zeros(50)
    for count in topk.segments(64):
        bound = ((topk.statistics(a, count) - topk.statistics(b, count)) ** 2).sum(1)
        assert (bound <= exact + 1e-9).all() and (bound >= last - 1e-9).all()
        last = bound
