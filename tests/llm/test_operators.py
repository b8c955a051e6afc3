"""Each operator against brute force, a round trip or held-out accuracy, with nulls, empty, long, tied and repeated rows."""

import hashlib
import importlib
import itertools
import json
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import common, components, gif, language, media, mixing, neardup, packing, quality, queries, sharding, substrings, urls, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(text):
    return (text or "").encode().split()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empties, a long text, ties, repeated rows and an extra column."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(60)]
    passage = prose(rng, 55)
    for i in range(12):
        texts.append(f"{prose(rng, 20)} {passage} {prose(rng, 5)}")
    for i in range(10):
        t = texts[i * 3].split()
        t[len(t) // 2] = "changed"
        texts += [texts[i], " ".join(t)]
    texts += [None, None, "", "   \n\t ", "one", "one", "One", "a b", "the cat\nthe cat\n\nthe cat sat", "x " * 30, prose(rng, 9000, 3000), "été là 中文字 a|b #*$"]
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], ("s1", "s0", "s1", None, "s2")[i % 5], None, "e") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[-2]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def counts(text):
    w = [x.decode() for x in words(text)]
    t = text or ""
    lines = [x for x in t.split("\n") if x.encode().split()]
    seen = Counter(zip(w, w[1:], w[2:]))
    at = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at)


def test_quality_counts(docs, corpus, empty):
    found = quality.apply_rules(docs)
    got = sorted((r["doc_id"], *[r["q"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r["base_failed"]) for r in found.collect())
    want = sorted((r[0], *counts(r[1]), (c := counts(r[1]))[0] < 50 or 100 * c[4] > 50 * c[0]) for r in corpus)
    assert got == want
    assert found.filter("kept AND base_failed").isEmpty() and quality.apply_rules(empty).isEmpty()
    assert "extra" in found.columns


def test_quality_verdicts(spark):
    clean = " ".join(f"the word{i} of a sentence{i}" for i in range(30))
    rows = {1: clean, 2: " ".join(f"a{i}$$$ b{i}***" for i in range(60)), 3: " ".join(f"WORD{i}!!" for i in range(60)), 4: clean + " #", 5: None}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("q", F.lit(1))
    out = {r["doc_id"]: r for r in quality.apply_rules(df).filter("kept OR NOT kept").collect()}
    assert [out[i]["kept"] for i in range(1, 6)] == [True, False, False, True, False]
    assert "symbols" in out[2]["failed_rules"] and "bangs" in out[3]["failed_rules"]


# 2


def linked(rows, k, percent):
    sets, root = {}, {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, corpus, empty, k):
    want = linked({(r[0], r[1]) for r in corpus}, k, 80)
    got = neardup.near_duplicates(docs, k).collect()
    assert len(got) == len(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert neardup.near_duplicates(empty, k).isEmpty()
    kept = neardup.keep_one(docs, k)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_duplicates_chain_and_nulls(spark):
    base = [f"v{i}" for i in range(60)]
    texts = []
    for step in range(12):  # neighbours are near, the ends are not
        texts.append(" ".join(f"c{step}x{i}" if i < 3 * step else w for i, w in enumerate(base)))
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (7, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    want = linked([r for r in rows if r[0]], 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]} == {i: c for i, (_, c) in want.items()}
    assert sum(r["doc_id"] is None for r in got) == 2


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share an id but not a text are documents of their own, and keep_one loses none that links with nothing."""
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60, 10**6) for _ in range(4))
    near = lambda t: t.rsplit(" ", 1)[0] + " z"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, near(b), "x"), (3, near(c), "x"), (7, c, "x"), (7, d, "x"), (7, d, "w"), (9, near(d), "x"), (9, None, "x"), (9, "", "x"), (None, a, "x"), (None, a, "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("tag", F.lit("clash"))
    got = Counter(tuple(r) for r in neardup.near_duplicates(df).select("doc_id", "n_shingles", "class_id", "component_id").collect())
    want = [(1, 56, 1, 1), (5, 56, 1, 1), (5, 56, 5, 5), (5, 56, 5, 5), (3, 56, 3, 3), (7, 56, 7, 3), (7, 56, 7, 7), (7, 56, 7, 7), (9, 56, 9, 7), (9, 0, 9, 9), (9, 0, 9, 9), (None, 56, None, None), (None, 56, None, None), (4, 0, 4, 4)]
    assert got == Counter(want)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    out = Counter((r["doc_id"], r["text"], r["row"]) for r in kept.collect())
    one = (5, b, "x") if (5, b, "x") in out else (5, near(b), "x")
    assert out == Counter([(1, a, "x"), one, (3, near(c), "x"), (7, d, "w"), (9, None, "x"), (9, "", "x"), (None, a, "x"), (None, a, "x"), (4, None, "x")])


def test_near_duplicates_of_a_boilerplate(spark):
    """Many texts of one long passage that isn't enough for a link: buckets too large for pairs go by rare shingles, and lose no link."""
    rng = random.Random(13)
    frame = prose(rng, 120, 10**6).split()
    rows = []
    for i in range(120):
        own = prose(rng, rng.choice([12, 16, 40]), 10**6).split()
        rows.append((2 * i, " ".join(frame + own)))
        if i % 6 == 0:
            rows.append((2 * i + 1, " ".join(frame[:118] + own + ["q"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = linked(rows, 2, 88)
    assert 60 < len({c for _, c in want.values()}) < 130
    for bucket in (3, neardup.BUCKET, 10**6):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 2, 88, bucket).collect()} == want
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, 2, 79)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 1.0):
        common_, n = int(600 * share), 600
        x = common.mix(rng.integers(0, 1 << 63, 2 * n - common_).astype(np.uint64))
        m = neardup.minhash([np.unique(x[:n]), np.unique(np.concatenate([x[:common_], x[n:]]))])
        a, b = neardup.odd_sketch(m).view(np.uint64)
        bits = sum(int(v).bit_count() for v in a ^ b)
        assert abs(neardup.estimate(bits) - common_ / (2 * n - common_)) < 0.12 and bits <= neardup.MOST_BITS


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4200)] + [(1, 1)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


# 3


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "y" * 300_000), (2, None, "<p>x</p>"), (None, "http://f", "<p>x</p>"), (None, None, "alone"), (None, None, "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(1))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["error"]) for r in warc.round_trip(df).collect()), key=str)
    top = {"<p>x</p>": 2, "": 4, "y" * 300_000: 5, "alone": None}
    want = []
    for page, _, html in rows:
        last = top[html or ""]
        again = last is not None and (page is None or page < last)
        want.append((page, len((html or "").encode()), warc.digest_of((html or "").encode()), "revisit" if again else "response", last if again else None, None))
    assert got == sorted(want, key=str)
    urls_ = ["http://a.com/x y", " http://b ", "http://c/%20 %zz\t", "http://d/%41", "é\n", "", None]
    back = warc.round_trip(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls_)], "page_id long, url string, html string"))
    assert [r["url"] for r in sorted(back.collect())] == urls_
    assert warc.round_trip(df.limit(0)).isEmpty()
    big = {r["page_id"]: r["record_type"] for r in warc.round_trip(df.filter("page_id IS NOT NULL"), least_bytes=100).collect()}
    assert set(big.values()) == {"response"}


def test_warc_reader_finds_damage(tmp_path):
    a, b = warc.record("1", "http://x", b"hello"), warc.record("2", "http://y", b"world" * 1000)
    for chunk in (1, 7, 1 << 16):
        (tmp_path / "f").write_bytes(a + b)
        with (tmp_path / "f").open("rb") as f:
            assert [r.http[1] for r in warc.read_records(f, chunk)] == [b"hello", b"world" * 1000]
    (tmp_path / "f").write_bytes(a + b[:-20])
    with (tmp_path / "f").open("rb") as f:
        assert [r.error for r in warc.read_records(f)] == [None, "truncated"]
    import gzip

    (tmp_path / "f").write_bytes(gzip.compress(gzip.decompress(a).replace(b"hello", b"hullo")) + gzip.compress(gzip.decompress(a)[:-1]) + b"junk")
    with (tmp_path / "f").open("rb") as f:
        assert [r.error for r in warc.read_records(f)] == ["digest", "framing", "compression"]


# 4


def test_language_accuracy(spark):
    rows = queries.op4_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, docs, empty):
    model = language.fit_identifier([("en", "the cat and the dog with that thing")] * 9 + [("de", "der hund und die katze mit dem ding über")] * 9)
    texts = [None, "", "123 !?", "the dog and the thing", "über der katze", "the " * 50_000, "the dog and the thing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("_0", F.lit("mine"))
    out = language.identify(df, model, ["doc_id", "score", "_0"])
    assert out.columns == ["doc_id", "_0", *language.ADDED] and out.filter("_0 = 'mine'").count() == 7
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["und", "und", "und", "en", "de", "en", "en"]
    assert got[0]["score"] == 0 and got[3]["score"] == got[6]["score"] > 0.5
    nothing = language.train(empty, F.lit(True), F.col("doc_id"))
    assert {r["lang_pred"] for r in language.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.identify(empty, model, ["doc_id"]).isEmpty()


def test_kneser_ney_sums_to_one():
    model = language.fit(Counter({"abc": 5, "abd": 3, "ba": 2, "c": 1}), 6)
    # a distribution: all continuations of a start, over the alphabet of four letters, the end mark and one unseen character
    total = 0.0
    for ch in "abcd\x03z":
        w = "ab" + ch
        _, pos, h = language._grams([w])
        marked = "\x02ab" + ch
        p = _char_logp(model, marked, 3)
        total += np.exp(p)
    assert abs(total - 1) < 1e-3


def kneser_ney(counts, alphabet):
    """Log probability of a word by plain dictionaries of strings: the recursion of interpolated Kneser-Ney itself."""
    marked = {f"\x02{w}\x03": n for w, n in counts.items()}
    raw = Counter()
    for w, n in marked.items():
        for i in range(4, len(w)):
            raw[w[i - 4 : i + 1]] += n
    tables = {5: raw}
    for n in (4, 3, 2, 1):
        table = Counter({g: c for g, c in Counter(g[1:] for g in tables[n + 1]).items()})
        for w, c in marked.items():  # at a word's start nothing stands to the left
            if len(w) >= n and n > 1:
                table[w[:n]] += c
        tables[n] = table
    discount, sums, types = {}, defaultdict(lambda: defaultdict(float)), defaultdict(Counter)
    for n, table in tables.items():
        n1, n2 = (sum(c == k for c in table.values()) for k in (1, 2))
        discount[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        for g, c in table.items():
            sums[n][g[:-1]] += c
            types[n][g[:-1]] += 1

    def p(context, ch, n):
        if n == 0:
            return 1 / alphabet
        context = context[-(n - 1) :] if n > 1 else ""
        low = p(context, ch, n - 1)
        if not sums[n][context]:
            return low
        return max(tables[n][context + ch] - discount[n], 0) / sums[n][context] + discount[n] * types[n][context] / sums[n][context] * low

    def word(w):
        w = f"\x02{w}\x03"
        return sum(np.log(p(w[:i], w[i], min(5, i + 1))) for i in range(1, len(w)))

    return word


def test_kneser_ney_against_plain_recursion():
    rng = random.Random(17)
    counts = Counter("".join(rng.choice("aabbcde") for _ in range(rng.randrange(1, 9))) for _ in range(400))
    asked = [*counts, *("".join(rng.choice("abcdez") for _ in range(rng.randrange(1, 11))) for _ in range(200))]
    want = kneser_ney(counts, 8)
    assert language.fit(counts, 8).word_scores(asked) == pytest.approx([want(w) for w in asked], abs=1e-4)


def test_language_query_against_brute_force(spark):
    """The registered query: its languages are those of the least cross-entropy under plainly computed models of the same rows."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64(F.lit(3), "doc_id").alias("o")).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["o"], r["doc_id"])):
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"] is not None:
            assert len(r["text"]) <= language.TRAIN_CHARS
            by[r["lang"]].append(r["text"])
    find = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = {x: Counter(w for t in texts[: max(1, round(0.8 * len(texts)))] for w in find(t)) for x, texts in by.items()}
    alphabet = len({ch for c in counts.values() for w in c for ch in w}) + 2
    models = {x: kneser_ney(c, alphabet) for x, c in sorted(counts.items())}
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, DATA).collect()}
    assert len(got) == len(rows)
    memo = {}
    for r in sorted(rows, key=lambda r: len(r["text"] or ""))[:90]:
        ws = find(r["text"] or "")
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not ws:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        for w in ws:
            memo.setdefault(w, {x: m(w) for x, m in models.items()})
        bits = sorted((-sum(memo[w][x] for w in ws) / sum(len(w) + 1 for w in ws), x) for x in models)
        assert got[r["doc_id"]]["lang_pred"] == bits[0][1] or bits[1][0] - bits[0][0] < 1e-4


def test_language_learns_long_texts(spark):
    """A language whose texts are all long is learned from slices; of many languages each has its part of the sample."""
    rng = random.Random(18)
    word = lambda a: "".join(rng.choice(a) for _ in range(5))
    rows = [(i, " ".join(word("abc") for _ in range(400)), "aa") for i in range(20)] + [(100 + i, " ".join(word("xyz") for _ in range(5000)), "zz") for i in range(9)] + [(100, "abc " * 99, None), (None, "cab", "aa")]
    df = spark.createDataFrame(rows + rows[:2] * 3, "doc_id long, text string, lang string")
    model = language.train(df, F.lit(True), F.col("doc_id"), chars=900)
    assert model.languages == ["aa", "zz"]
    assert [r["lang_pred"] for r in language.identify(spark.createDataFrame([("xyzzy zxy",), ("abcab",)], "text string"), model, []).collect()] == ["zz", "aa"]
    assert language.train(df, F.lit(True), F.col("doc_id"), most=4).languages == ["aa", "zz"]
    with pytest.raises(ValueError):
        language.train(df, F.lit(True), F.col("doc_id"), most=1)


def _char_logp(model, marked, at):
    """Log probability of one character by plain recursion over the stored arrays."""
    codes = np.array([ord(c) for c in marked], np.uint64)
    one = common.mix(codes + np.uint64(0x51ED27))

    def h(i, n):
        x = one[i : i + 1]
        for k in range(1, n):
            x = common.mix(x * np.uint64(0x9E3779B97F4A7C15) + one[i - k : i - k + 1])
        return x[0]

    out = 0.0
    for n in range(min(language.ORDER, at + 1), 0, -1):
        keys, logp = model.grams[n - 1]
        i = np.searchsorted(keys, h(at, n))
        if i < len(keys) and keys[i] == h(at, n):
            return out + logp[i]
        if n == 1:
            return out + model.unseen
        keys, back = model.backs[n - 1]
        i = np.searchsorted(keys, h(at - 1, n - 1))
        if i < len(keys) and keys[i] == h(at - 1, n - 1):
            out += back[i]


# 5


def test_sharding(spark, docs, corpus, empty):
    key, tie = [F.col("doc_id")], [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    rows = sharding.assign_shards(docs.withColumn("slot", F.lit("clash")), 24, key, tie).collect()
    assert len(rows) == len(corpus)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.assign_shards(empty, 24, key, tie).isEmpty()
    hot = sharding.assign_shards(spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text")), 7, key, tie)
    assert sorted(r["count"] for r in hot.groupBy("shard").count().collect()) == [71, 71, 71, 71, 72, 72, 72]


def test_sharding_query(spark, tmp_path):
    """The registered query: sizes, digests and law by plain Python, the home of every row by a walk around the ring."""
    rows = [(i, None if i % 9 == 4 else "é" * (i % 13)) for i in range(700)] + [(None, f"n{i}") for i in range(90)] + [(5, "same")] * 40
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in queries.op5_sharding(spark, str(tmp_path)).collect()]
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    places = {r["doc_id"]: r["p"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.PLACES)).alias("p")).distinct().collect()}
    ring, home = sharding.virtual_nodes(24), 0
    for r in got:
        node = bisect_left(ring, (places[r["doc_id"]],)) % len(ring)
        home += ring[node][1] == r["shard"]
    assert home > 0.6 * len(rows)  # a row leaves its home only where that is full


def test_sharding_hot_place(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("part"), F.lit("mine").alias("row"), F.lit("mine").alias("_lo"), F.lit("mine").alias("rank"))
    one, two = (sharding.assign_shards(df.repartition(n), 7, [F.col("doc_id")], [F.col("part")], hot=h) for n, h in ((3, 100), (5, 100)))
    assert one.columns == [*df.columns, "shard", "slot"] and one.filter("row = 'mine' AND _lo = 'mine' AND rank = 'mine'").count() == 3000
    rows = sorted((r["part"], r["shard"], r["slot"]) for r in one.collect())
    assert rows == sorted((r["part"], r["shard"], r["slot"]) for r in two.collect())
    slots = defaultdict(list)
    for _, s, n in rows:
        slots[s].append(n)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and sorted(map(len, slots.values())) == [428] * 3 + [429] * 4


def test_ring_bounds_and_moves_little():
    rng = random.Random(3)
    keys = Counter(rng.randrange(sharding.PLACES) for _ in range(40_000))

    def where(shards, factor):
        out = {}
        for place, lo, hi, shard, _ in sharding.layout(keys, shards, factor):
            for i in range(lo, hi):
                assert (place, i) not in out
                out[place, i] = shard
        return out

    old, new = where(24, 1.15), where(25, 1.15)
    assert len(old) == 40_000 and max(Counter(old.values()).values()) <= -(-40_000 * 1.15 // 24)
    assert sum(old[k] != new[k] for k in old) < 0.2 * len(old)
    loose = where(24, 1000)
    ring = sharding.virtual_nodes(24)
    assert all(s == ring[bisect_left(ring, (p,)) % len(ring)][1] for (p, _), s in loose.items())


# 6


def test_packing(spark, docs, corpus, empty):
    from tokenizers import Tokenizer

    path = queries.public_tokenizers.path("word_bpe_49k.json")
    one = Tokenizer.from_file(path)
    want = sorted(np.array(one.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in corpus)
    for size, hot in ((1 << 23, 1000), (3000, 1)):
        pieces = packing.pack_documents(docs, packing.word_ids(path, 1), 128, group_bytes=size, with_ids=True, hot=hot).collect()
        seqs, texts = defaultdict(list), defaultdict(list)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and len(p["ids"]) == 4 * p["length"]
            seqs[p["sequence_id"]].append((p["offset"], p["length"]))
            texts[p["doc_id"], p["doc_tokens"]].append((p["start"], bytes(p["ids"])))
        for s in seqs.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= 128 and at & (at - 1) == 0
        single = {r[0]: r[1] for r in corpus if sum(x[0] == r[0] for x in corpus) == 1}
        for i, t in single.items():
            ids = np.array(one.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
            assert b"".join(x for _, x in sorted(texts[i, len(ids) // 4])) == ids
        assert sum(p["length"] for p in pieces) == sum(len(w) // 4 for w in want)
    assert packing.pack_documents(empty, packing.word_ids(path, 1)).isEmpty()


def test_packing_bounds_groups(spark, monkeypatch):
    """Rows of one id and text are spread over partitions, and no group has more bytes than it may; a very long text is alone."""
    monkeypatch.setattr(packing, "PARTITION_BYTES", 20_000)
    rows = [(7, "one two three " * 5)] * 2500 + [(None, "x y")] * 400 + [(8, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def lengths(texts):  # no ids needed: a text's share of its group's bytes in a piece
        assert sum(len(t or b"") for t in texts) <= 5000 or len(texts) == 1
        return [np.full(len(t or b"") + 1, 3, "<u4").tobytes() for t in texts]

    out = packing.pack_documents(df, lengths, 256, group_bytes=5000, hot=100).collect()
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == {7: 2500 * 71, None: 400 * 4, 8: 45_001}
    hot = Counter(r["sequence_id"] >> 32 for r in out if r["doc_id"] == 7)
    assert len(hot) >= 8 and max(hot.values()) < 0.4 * sum(hot.values())
    assert sorted(map(str, out)) == sorted(map(str, packing.pack_documents(df.repartition(3), lengths, 256, group_bytes=5000, hot=100).collect()))


def test_word_merges_are_the_tokenizers():
    """Bulk merges against the tokenizer itself, on words with marks, accents, foreign scripts, contractions and special tokens."""
    from factloom.llm.bpe import WordMerges

    path = queries.public_tokenizers.path("word_bpe_49k.json")
    rng, merges = random.Random(6), WordMerges(path)
    letters = "abzAZ'sS.,!?0129éÉßİΣσςǅñ漢字\u0301\u00b2💡|<>-_dDlLtTvVrReEth"
    made = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))).encode() for _ in range(8000)}
    made |= {b"<|endoftext|>", b"a<|startoftext|>b", b"x" * 3000, "é".encode() * 40, b"the", b"don't", b"I'LL"}
    tokens = [t for t in made if t.split() == [t]]
    want = [np.array(e.ids, "<u4").tobytes() for e in merges.whole.encode_batch([t.decode() for t in tokens], add_special_tokens=False)]
    assert merges.encode(tokens) == want and merges.encode([]) == []
    by = dict(zip(tokens, want))
    vocabulary = packing.Vocabulary(path, 1)
    for limit, chunk in ((1 << 19, 4 << 20), (300, 90)):  # the table starts anew again and again, and texts come in segments
        vocabulary.table.limit, vocabulary.CHUNK = limit, chunk
        texts = [rng.choice((b" ", b"\n", b"")) + rng.choice((b" ", b"\t\r", b"\x0b\x0c")).join(rng.choices(tokens, k=rng.randrange(80))) for _ in range(60)]
        texts += [None, b"", b" ", b"a\0b a\0 \0 a", b"\0", b"x" * 16, b"x" * 17 + b" " + b"x" * 16, b" ".join(tokens[:40])]
        by |= {w: np.array(merges.whole.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts for w in (t or b"").split() if w not in by}
        assert vocabulary.tokenise(texts) == [b"".join(by[w] for w in (t or b"").split()) + b"\1\0\0\0" for t in texts]
    assert vocabulary.tokenise([]) == []


def test_words_in_a_buffer():
    """Bounds, numbers and hashes of words against bytes.split: equal words, and only they, have equal hashes and numbers."""
    rng = random.Random(20)
    pieces = [b"a", b"ab", b"\0", b"a\0", b"x" * 8, b"x" * 9, b"x" * 16, b"x" * 17, b"y" * 256, b"y" * 257, "é\u00a0\u2003".encode(), b"\x1c", b"\x85"] + [bytes(rng.choices(b"abc\xff", k=rng.randrange(1, 40))) for _ in range(300)]
    texts = [None, b"", b"  ", *(rng.choice((b"", b" ")) + b"".join(rng.choice(pieces) + rng.choice((b" ", b"\n\t", b"\r\x0b\x0c")) for _ in range(rng.randrange(60))) for _ in range(80)), b"end"]
    split = [(t or b"").split() for t in texts]
    flat = [w for ws in split for w in ws]
    h, ends = common.hash_texts(texts)
    assert ends.tolist() == [0, *itertools.accumulate(map(len, split))] and len(h) == len(flat)
    assert len(set(zip(h.tolist(), flat))) == len(set(flat)) == len(set(h.tolist()))
    assert common.hash_texts([])[1].tolist() == [0] and common.hash_texts([None, b" "])[1].tolist() == [0, 0, 0]
    table, known = common.WordTable(), []
    for limit in (1 << 19, 90):
        table.limit = limit
        for at in range(0, len(texts), 7):
            number, ends = table.numbers(texts[at : at + 7], known.extend, known.clear)
            assert [known[n] for n in number] == [w for ws in split[at : at + 7] for w in ws] and len(set(known)) == len(known)


def test_first_fit_decreasing():
    rng = random.Random(4)
    tree, plain = packing.Tournament(40, 50), [50] * 40
    for need in sorted((rng.randrange(1, 50) for _ in range(40)), reverse=True):
        at = next(i for i, x in enumerate(plain) if x >= need)
        plain[at] -= need
        assert tree.first_fit(need) == at
    for lengths in ([], [1], [2048], [5000, 1, 1], [rng.randrange(1, 6000) for _ in range(200)]):
        got = defaultdict(list)
        for b in packing.pack(lengths, 2048):
            n = sum(x[2] for x in b)
            assert 0 < n <= 2048 and n & (n - 1) == 0
            for i, a, n in b:
                got[i] += range(a, a + n)
        assert [sorted(got[i]) for i in range(len(lengths))] == [list(range(n)) for n in lengths]


# 7


def test_mixing(spark, docs, corpus, empty):
    size = F.size(common.words(F.col("text")))
    mix = lambda d: mixing.mix_sources(d, F.array("source"), size, [F.col("doc_id"), F.xxhash64("text")])
    rows = mix(docs).collect()
    assert len(rows) == len(corpus)
    held = defaultdict(int)
    for r in corpus:
        held[r[3]] += len(words(r[1]))
    names = sorted(held, key=mixing.source_order)
    assert names[-1] is None
    target = dict(zip(names, mixing.fill(sum(held.values()), [held[x] for x in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = defaultdict(int)
    for r in rows:
        assert r["_taken"] <= 3 * r["_size"] and r["_size"] == len(words(r["text"]))
        assert sum(b["words"] for b in r["_by"]) == r["_taken"]
        taken[r["source"]] += r["_taken"]
    for x in names:
        assert abs(taken[x] - target[x]) <= 1 and target[x] <= 3 * held[x]
    again = mix(docs.repartition(3)).collect()
    assert sorted((r["doc_id"], r["_taken"]) for r in rows) == sorted((r["doc_id"], r["_taken"]) for r in again)
    assert mix(empty).isEmpty()


def test_mixing_reads_each_size_twice(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def size(n):
        calls.add(1)
        return n

    spark.range(300).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "id % 7 AS n").write.parquet(str(tmp_path / "docs"))
    out = mixing.mix_sources(spark.read.parquet(str(tmp_path / "docs")), F.array("source"), size("n"), [F.col("doc_id")]).collect()
    assert len(out) == 300 and all(r["_size"] == r["n"] for r in out)
    # once for the sums, once for the rows; a third pass was most of the time over large tables
    assert 300 < calls.value <= 600


def test_mixing_overlap(spark):
    rows = [(i, ["a", "b"] if i < 10 else ["a"] if i < 20 else ["c", None] if i < 25 else None if i < 28 else []) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>").withColumn("n", F.lit(100))
    out = mixing.mix_sources(df, F.col("members"), F.col("n"), [F.col("doc_id")]).collect()
    got = defaultdict(int)
    for r in out:
        for b in r["_by"]:
            got[b["source"]] += b["words"]
            assert b["source"] in (r["members"] or [None])
    # the null source holds ten rows; its weight is 5 of 13, and c stops at its cap only if it must
    want = dict(zip(["a", "b", "c", None], mixing.fill(3000, [2000, 1000, 500, 1000], [5, 2, 1, 5])))
    assert all(abs(got[x] - want[x]) <= 1 for x in want)


def test_fill_and_flow():
    assert mixing.fill(100, [80, 20], [5, 2]) == pytest.approx([500 / 7, 200 / 7])
    assert mixing.fill(100, [10, 90], [5, 2]) == pytest.approx([30, 70])
    assert mixing.fill(0, [0, 0], [5, 2]) == [0, 0]
    flows = mixing.route({("p", 0): 10, ("q", 0): 10}, {("p", 0): ["a", "b"], ("q", 0): ["b"]}, {"a": 12, "b": 8})
    assert sum(n for s, n in flows["p", 0] + flows["q", 0] if s == "a") == 12 and sum(n for s, n in flows["q", 0]) == 8


def cheapest(arcs, n, s, t):
    """Greatest flow and its least cost by successive shortest paths (Bellman-Ford), arc by arc (from, to, capacity, cost)."""
    e = [[u, v, c, w] for a, b, c, w in arcs for u, v, c, w in ((a, b, c, w), (b, a, 0, -w))]
    flow = cost = 0
    while True:
        dist, via = [float("inf")] * n, [None] * n
        dist[s] = 0
        for _ in range(n):
            for i, (u, v, c, w) in enumerate(e):
                if c > 0 and dist[u] + w < dist[v]:
                    dist[v], via[v] = dist[u] + w, i
        if via[t] is None:
            return flow, cost
        path, v = [], t
        while v != s:
            path.append(via[v])
            v = e[via[v]][0]
        push = min(e[i][2] for i in path)
        for i in path:
            e[i][2] -= push
            e[i ^ 1][2] += push
        flow, cost = flow + push, cost + push * dist[t]


def test_route_is_a_largest_flow_of_least_cost():
    rng = random.Random(14)
    for _ in range(25):
        sources = list("abcd")[: rng.randrange(2, 5)]
        patterns = [tuple(sorted(rng.sample(sources, rng.randrange(1, len(sources) + 1)))) for _ in range(5)]
        cells = {(p, x): rng.randrange(1, 30) for p in patterns for x in (p if rng.random() < 0.5 else ("",))}
        members = {c: [c[1]] if c[1] else list(c[0]) for c in cells}
        quota = {x: rng.randrange(0, 90) for x in sources}
        got = mixing.route(cells, members, quota)
        words_ = defaultdict(int)
        for c, n in cells.items():
            words_[c[0]] += n
        node = {k: i + 2 for i, k in enumerate([*map(str, words_), *map(repr, cells), *sources])}
        arcs = [(0, node[str(p)], n, k * (k + 1) // 2) for p, n in words_.items() for k in range(3)] + [(node[str(c[0])], node[repr(c)], 3 * n, 0) for c, n in cells.items()]
        arcs += [(node[repr(c)], node[x], 10**6, 0) for c in cells for x in members[c]] + [(node[x], 1, q, 0) for x, q in quota.items()]
        used, taken = defaultdict(int), defaultdict(int)
        for c, xs in got.items():
            assert sum(n for _, n in xs) <= 3 * cells[c]
            for x, n in xs:
                used[c[0]] += n
                taken[x] += n
        assert all(taken[x] <= quota[x] for x in sources)
        cost = sum(max(0, min(words_[p], n - k * words_[p])) * (k * (k + 1) // 2) for p, n in used.items() for k in range(3))
        assert (sum(taken.values()), cost) == cheapest(arcs, len(node) + 2, 0, 1)


def test_mixing_query(spark, tmp_path):
    """The query against targets worked out by bisection, with overlaps, nulls, copies and repeated rows."""
    rng = random.Random(15)
    rows = []
    for i in range(300):
        n = rng.choice([0, 1, 5, 30, 200])
        rows.append((i, None if i % 50 == 7 else " ".join(rng.choice("abcdefgh") for _ in range(n)), ("b", "a", "c", "a", None, "d")[i % 6] if i % 40 else "tiny"))
    rows += [(1000 + i, r[1], "e") for i, r in enumerate(rows[:40])] + rows[60:63] * 2
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_mixing(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    held = defaultdict(int)
    for _, t, x in rows:
        held[x] += len(words(t))
    names = sorted(held, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    lo, hi = 0.0, 1e9  # each target is the lesser of its cap and weight times one level
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * held[x], weight[x] * mid) for x in names) < sum(held.values()) else (lo, mid)
    target = {x: min(3 * held[x], weight[x] * hi) for x in names}
    source = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    size = {r[0]: len(words(r[1])) for r in rows}
    for r in out:
        x = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == held[x] and r["target"] == pytest.approx(target[x]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[x] += r["taken"]
    assert all(abs(taken[x] - target[x]) <= 1 for x in names)
    assert any(len(json.loads(r["pattern"])) > 1 for r in out)
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in queries.op7_mixing(spark, str(tmp_path)).collect())


def test_mixing_hot_rows_and_clashes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(1, 10, "a")] * 400 + [(i, i % 7, "ab"[i % 2]) for i in range(2, 200)]
    spark.createDataFrame(rows, "doc_id long, n int, source string").repartition(6).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for name in ("_key", "_bucket", "_in", "_row", "_o0", "_salt", "_all", "_hot", "_home"):
        df = df.withColumn(name, F.lit("mine"))
    df = df.withColumn("_size", F.lit("gone"))
    out = mixing.mix_sources(df, F.array("source"), F.col("n"), [F.col("doc_id"), F.col("n")], weights=(1, 2))
    assert out.filter("_key = 'mine' AND _bucket = 'mine' AND _in = 'mine' AND _row = 'mine' AND _o0 = 'mine' AND _salt = 'mine' AND _all = 'mine' AND _hot = 'mine' AND _home = 'mine'").count() == len(rows)
    taken = {r["source"]: r["t"] for r in out.groupBy("source").agg(F.sum("_taken").alias("t")).collect()}
    held = {x: sum(r[1] for r in rows if r[2] == x) for x in "ab"}
    want = mixing.fill(sum(held.values()), [held["a"], held["b"]], [1, 2])
    assert all(abs(taken[x] - w) <= 1 for x, w in zip("ab", want))
    # the rows of one key take what lies under the line, whoever of them
    hot = sorted(r["_taken"] for r in out.filter("doc_id = 1").collect())
    assert sum(t % 10 != 0 for t in hot) <= 1 and hot[-1] - hot[0] <= 10


# 8


def test_urls(spark):
    link = lambda u: f"<html><LINK rel='canonical' href=\"{u}\">"
    rows = [
        (1, "https://a.Example.COM/de/x?y#z", ""), (2, "http://example.net/en/1", None), (3, "http://x.org", link("http://y.net/p")), (4, "http://z.org/q", link("//x.org?a")),
        (5, "http://w.org/fr/1", link("/t")), (6, "http://w.org/t", link("http://bad.net/1")), (7, None, link("http://bad.net/1")), (8, "no scheme", ""), (9, "", ""), (10, "http://net", ""),
        (11, "http://a.net/?q", ""), (12, "http://v.org/a/b", '<meta http-equiv="refresh" content="0; url=c?x=1&amp;y=2">'), (13, "http://v.org/a/c?x=1&y=2", link("http://u.net/")), (13, "http://v.org/a/c?x=1&y=2", link("http://u.net/")),
        (14, "http://q.org/l", ""), (15, "http://user.notnet/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    redirects = spark.createDataFrame([("http://q.org/l", "http://m.org/1"), ("http://m.org/1", "http://n.example.com/de/"), (None, "http://x")], "u string, v string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["via"]) for r in urls.judge_urls(df, redirects=redirects).collect()]
    want = {
        1: ("a.example.com", "/de/x", "example.com/de/", "block", "rule"), 2: ("example.net", "/en/1", "example.net/en/", "allow", "rule"), 3: ("x.org", "", None, "block", "alias"), 4: ("z.org", "/q", None, "allow", "default"),
        5: ("w.org", "/fr/1", "org/fr/", "allow", "rule"), 6: ("w.org", "/t", None, "allow", "alias"), 7: ("", "", None, "allow", "default"), 8: ("", "", None, "allow", "default"), 9: ("", "", None, "allow", "default"),
        10: ("net", "", None, "allow", "default"), 11: ("a.net", "/", "net/", "block", "rule"), 12: ("v.org", "/a/b", None, "block", "alias"), 13: ("v.org", "/a/c", None, "block", "alias"), 14: ("q.org", "/l", None, "block", "alias"), 15: ("user.notnet", "/", None, "allow", "default"),
    }
    assert len(got) == len(rows) and {g[0]: g[1:] for g in got} == want
    assert urls.judge_urls(df.limit(0)).isEmpty()


# 9


def removed(rows, width=13):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("width", [13, 4, 40])
def test_substrings(docs, corpus, empty, width):
    got = substrings.removal_report(docs, width).collect()
    assert len(got) == len(corpus)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == removed({(r[0], r[1]) for r in corpus}, width)
    assert substrings.removal_report(empty, width).isEmpty()


def test_substrings_text(spark):
    rng = random.Random(9)
    p = prose(rng, 20, 10**6)
    rows = [(1, f"a\n{p}"), (2, f"b  c\t{p} d"), (3, "x  y"), (4, None), (None, p), (5, p)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("clash")))
    assert {(r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()} == {(1, f"a\n{p}", 0), (2, "b c d", 20), (3, "x  y", 0), (4, None, 0), (None, p, 0), (5, "", 20)}


def test_substrings_of_repeated_ids(spark):
    """Rows that share an id but not a text are judged by their own words; copies go by text, not by id."""
    rng = random.Random(10)
    a, b, c, d = (prose(rng, 40, 10**6) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, a), (5, f"{c} x"), (6, f"y {c} {b}"), (7, f"{b} {d}"), (9, d), (9, b), (None, a), (None, a), (3, None), (3, "")]
    rows += [(8, f"{d} z")] * 3 + [(10, f"z {d}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removal_report(df).collect())
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(words(t)) - 12):
            first.setdefault(tuple(words(t)[k : k + 13]), i)
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()] += 1
    assert got == want
    names = ["_id", "_copy", "_starts", "alt", "copy", "row", "digest", "several", "_text", "_0"]
    wide = df.select("*", *[F.lit(n).alias(n) for n in names])
    out = substrings.remove_repeats(wide)
    assert out.columns == [*wide.columns, "n_removed"] and out.filter(" AND ".join(f"`{n}` = '{n}'" for n in names)).count() == len(rows)


def test_factors_name_their_sources(spark):
    """Each factor is a passage of an earlier document, and together they cover just what is removed; a hot passage is in every text."""
    rng = random.Random(11)
    hot, other = prose(rng, 30, 10**6).split(), prose(rng, 300, 10**6).split()
    texts = {i: prose(rng, rng.randrange(5, 30), 10**6).split() + hot + other[i % 7 * 20 : i % 7 * 20 + rng.randrange(60)] for i in range(1, 400)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(7)
    covered = defaultdict(set)
    for r in substrings.factor_table(df).collect():
        i, a, n, source, at = r["doc_id"], r["start"], r["length"], r["source_id"], r["source_start"]
        assert source < i and n >= 13 and texts[i][a : a + n] == texts[source][at : at + n]
        covered[i] |= set(range(a, a + n))
    want = removed([(i, " ".join(t)) for i, t in texts.items()])
    assert {i: len(covered[i]) for i in texts} == {i: w[1] for i, w in want.items()}


def test_parse():
    found = substrings.parse(np.array([4, 2, 3, 9, 10, 5, 3]), np.array([1, 1, 1, 2, 3, 4, 1]), np.array([8, 6, 7, 0, 1, 9, 7]), 13)
    assert [x.tolist() for x in found] == [[2, 5, 9, 10], [17, 18, 22, 23], [1, 4, 2, 3], [6, 9, 0, 1]]
    assert substrings.cut(b"a b c d e f", False, [1, 2], [3, 4], 2) == ([b"a", b"e", b"f"], 3)


# 10


def reference_lzw(stream, least):
    """A plain bit-by-bit reader."""
    clear, size, acc, held, out, prev = 1 << least, least + 1, 0, 0, bytearray(), None
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    for byte in stream:
        acc |= byte << held
        held += 8
        while held >= size:
            c = acc & (1 << size) - 1
            acc >>= size
            held -= size
            if c == clear:
                table, size, prev = table[: clear + 2], least + 1, None
                continue
            if c == clear + 1:
                return bytes(out)
            entry = table[c] if c < len(table) else prev + prev[:1]
            out += entry
            if prev is not None and len(table) < 4096:
                table.append(prev + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            prev = entry
    return bytes(out)


@pytest.mark.parametrize("least,alphabet", [(8, 256), (8, 3), (8, 1), (2, 4), (4, 13)])
def test_lzw(least, alphabet):
    rng = random.Random(alphabet)
    for n in (0, 1, 2, 64, 5000, 30_000):
        data = bytes(rng.randrange(alphabet) for _ in range(n))
        stream = gif.lzw_encode(data, least)
        assert reference_lzw(stream, least) == data == gif.lzw_decode(stream, least, n)


def test_lzw_deferred_clear_and_damage():
    """A writer may leave the table full; a broken stream gives what came before."""
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(12_000))
    codes, table, w, free = [], {bytes([i]): i for i in range(256)}, b"", 258
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
        else:
            codes.append(table[w])
            if free < 4096:
                table[w + bytes([c])] = free
                free += 1
            w = bytes([c])
    codes.append(table[w])
    bits, entries, size = "", 258, 9
    bits += format(256, "09b")[::-1]
    for i, c in enumerate(codes):
        bits += format(c, f"0{size}b")[::-1]
        if i and entries < 4096:
            entries += 1
            if entries == 1 << size and size < 12:
                size += 1
    bits += format(257, f"0{size}b")[::-1]
    bits += "0" * (-len(bits) % 8)
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert gif.lzw_decode(stream, 8, len(data)) == data
    assert data.startswith(gif.lzw_decode(stream[:5000], 8, len(data)))
    assert gif.lzw_decode(b"", 8, 10) == b""


def picture(frames, palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff", size=(4, 4)):
    import struct

    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + palette + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x05\0\0"
    for left, top, w, h, samples, delay, disposal, transparent, interlaced in frames:
        data = gif.lzw_encode(samples, 2)
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + struct.pack("<H", delay) + bytes([transparent or 0, 0])
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced) + b"\x02" + bytes([len(data)]) + data + b"\0"
    return out + b"\x3b"


def test_gif_frames(spark):
    full = bytes([1] * 16)
    data = picture([(0, 0, 4, 4, full, 5, 1, None, 0), (1, 1, 2, 2, bytes([2, 0, 0, 2]), 7, 2, 0, 0), (0, 0, 1, 1, b"\3", 9, 3, None, 0), (3, 3, 1, 1, b"\2", 1, 0, None, 0)])
    read = gif.decode(data)
    assert read.loops == 5 and not read.broken
    shown = [c.copy() for c in gif.composite(read)]
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    assert tuple(shown[1][1, 1]) == green and tuple(shown[1][1, 2]) == red
    assert tuple(shown[2][1, 1]) == (0, 0, 0, 0) and tuple(shown[2][0, 0]) == blue
    assert tuple(shown[3][0, 0]) == red and tuple(shown[3][3, 3]) == green
    rows = [(1, bytearray(data)), (2, None), (3, bytearray(b"junk")), (4, bytearray(data[:-6])), (1, bytearray(data))]
    out = gif.frame_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    one = sorted((r["frame"], r["start_cs"], r["delay_cs"]) for r in out if r["doc_id"] == 1)
    assert one == sorted([(0, 0, 5), (1, 5, 7), (2, 12, 9), (3, 21, 1)] * 2)
    assert next(r for r in out if r["doc_id"] == 1 and r["frame"] == 0)["rgb_histogram"] == [0] * 7 + [16] + [16] + [0] * 7 + [16] + [0] * 7
    assert {r["broken"] for r in out if r["doc_id"] == 4} == {True} and not {2, 3} & {r["doc_id"] for r in out}
    rows_ = bytes([i % 4 for i in range(16)])
    inter = gif.decode(picture([(0, 0, 2, 8, rows_, 0, 0, None, 1)], size=(2, 8))).frames[0].samples
    assert inter == b"".join(rows_[2 * k : 2 * k + 2] for k in (0, 4, 2, 5, 1, 6, 3, 7))


def shown_bins(payload):
    """Shares of red, green and blue by plain loops: every byte but zero shows its palette colour once."""
    bins, n = [0] * 24, 0
    for v in payload:
        if v:
            n += 1
            for c, x in enumerate((v & 0xE0, v << 3 & 0xE0, v << 6 & 0xC0)):
                bins[8 * c + (x >> 5)] += 1
    return ",".join(str(1000 * x // max(1, n)) for x in bins)


def test_gif_claims_too_much(spark):
    """A canvas or an image that claims more pixels than a task may hold is broken, and ends no job."""
    import struct

    wide = b"GIF89a" + struct.pack("<HHBBB", 60_000, 60_000, 0, 0, 0) + b"\x3b"
    image = picture([(0, 0, 4, 4, bytes(16), 1, 1, None, 0)])
    at = image.index(b"\x2c")
    image = image[: at + 5] + struct.pack("<HH", 60_000, 60_000) + image[at + 9 :]
    rows = [(1, bytearray(wide)), (2, bytearray(image)), (3, bytearray(b""))]
    out = gif.frame_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert [(r["doc_id"], r["frame"], r["width"], r["broken"]) for r in out] == [(1, None, 60_000, True)]
    assert gif.decode(image).broken and not gif.decode(image).frames


def test_media_query(spark, tmp_path):
    """The query as registered: payloads and features against plain loops, the stored bytes against the file format."""
    rng = random.Random(16)
    texts = [None, "", "a", "x" * 64, "\0 zero \0", "é中" * 50, prose(rng, 6000, 3000), "\x7f" * 20_000, "a"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (2, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op10_gif_media(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        media = gif.encode(payload)
        frames = -(-len(payload) // (64 * gif.FRAME_ROWS))
        assert media[:6] == b"GIF89a" and media[-1:] == b";" and media.count(b"\x21\xf9\x04\x09") >= frames
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{frames};{10 * frames};{shown_bins(payload)}"] += 1
    assert got == want


def test_media_round_trip(docs, corpus, empty):
    got = media.digests(docs).collect()
    want = Counter()
    for r in corpus:
        p = gif.padded(r[1].encode() if r[1] else None)
        want[r[0], len((r[1] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    stored = {r["doc_id"]: r for r in media.store(docs).collect()}
    for r in got:
        m = bytes(stored[r["doc_id"]]["media"])
        assert len(m) == r["media_bytes"] and hashlib.sha256(m).hexdigest() == r["media_sha256"] and gif.decode(m).width == 64
    assert media.digests(empty).isEmpty()


def test_gif_splits_long_payloads():
    payload = bytes(range(64)) * (2 * gif.FRAME_ROWS + 3)
    read = gif.decode(gif.encode(payload))
    assert [f.height for f in read.frames] == [gif.FRAME_ROWS] * 2 + [3] and b"".join(f.samples for f in read.frames) == payload
    # the last frame shows its own rows only, as the one before is cleared; zero bytes are transparent
    shown = [int((c[..., 3] > 0).sum()) for c in gif.composite(read)]
    assert shown == [63 * gif.FRAME_ROWS] * 2 + [63 * 3]


# the queries and the pipeline


def test_every_query_is_registered():
    names = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert names == list(range(1, 11))
    assert "corpus_pipeline" in importlib.import_module("factloom.llm.pipeline_query").__dict__


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(c.STAGES):
        stage(spark, tables[-1], DATA).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    rows = [[tuple(r) for r in t.select("doc_id", "text").collect()] for t in tables[:-1]]

    def ok(t):
        n = counts(t)
        return n[0] >= 50 and 100 * n[4] <= 50 * n[0]

    assert all(ok(t) for _, t in rows[1])
    near = linked(rows[1], 5, 80)
    assert sorted(i for i, _ in rows[2]) == sorted(i for i, (_, x) in near.items() if i == x)
    want = removed(rows[2])
    assert {i: hashlib.sha256(b" ".join(words(t))).hexdigest() for i, t in rows[3]} == {i: w[2] for i, w in want.items() if w[0] > w[1]}
    used = Counter(i for i, _ in rows[4])
    assert max(used.values()) <= 3 and set(used) <= {i for i, _ in rows[3]}
    pieces = tables[-1].collect()
    assert sum(p["length"] for p in pieces if p["start"] == 0) and {p["doc_id"] for p in pieces} == set(used)
    assert [t.columns for t in tables[1:-1]] == [list(c.COLUMNS)] * 4
    assert json.dumps([n for n, _ in c.STAGES])


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Every stage against brute force on nulls, empties, long texts, ties, repeated rows and ids, extra columns; and on an empty table."""
    import corpus_pipeline as c

    rng = random.Random(19)
    own = lambda n: " ".join(rng.choice(["the", "of", "and"]) if i % 2 else f"w{rng.randrange(10**5)}" for i in range(n))
    texts = [own(90) for _ in range(12)]
    shared = own(30)
    rows = [(i, t, "en", ("b", "a", None)[i % 3]) for i, t in enumerate(texts)]
    rows += [(20, texts[0] + " z", "en", "a"), (21, own(70) + " " + shared, "de", "b"), (22, shared + " " + own(80), "de", "a"), (23, shared, "de", "a"), (24, own(20_000), None, "c")]
    rows += [(25, None, None, None), (26, "", "en", "a"), (27, " \n\t ", "en", "a"), (28, "short", "en", "a"), (None, texts[3], "en", "a"), (None, own(60), "en", "a"), (3, own(75), "en", "b"), (29, texts[5], "en", "b"), (29, own(66), "en", "b")]
    rows += [rows[2], rows[2], rows[13]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).withColumn("q", F.lit("x")).withColumn("_copy", F.lit("x")).repartition(4)
    tables = [docs.select(*c.COLUMNS)]
    for i, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs if not i else tables[-1], DATA).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    data = [[(r["doc_id"], r["text"], r["source"]) for r in t.collect()] for t in tables[:-1]]
    kept = {(r["doc_id"], r["text"]) for r in quality.apply_rules(tables[0]).filter("kept").collect()}
    assert Counter(data[1]) == Counter(r for r in data[0] if (r[0], r[1]) in kept) and len(data[1]) > 20
    # near-duplicates: nodes are (id, text)
    nodes = sorted({r[:2] for r in data[1] if r[0] is not None})
    near = linked(list(enumerate(t for _, t in nodes)), 5, 80)
    group = defaultdict(set)
    for i, (_, root) in near.items():
        group[root].add(nodes[i])
    out = [r[:2] for r in data[2]]
    assert Counter(r for r in out if r[0] is None) == Counter(r[:2] for r in data[1] if r[0] is None)
    for g in group.values():
        stay = [r for r in out if r in g]
        assert len(stay) == 1 and stay[0][0] == min(i for i, _ in g)
    # passages: windows that a smaller id has
    first = {}
    for i, t, _ in sorted((r for r in data[2] if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(words(t)) - 12):
            first.setdefault(tuple(words(t)[k : k + 13]), i)
    want = Counter()
    for i, t, s in data[2]:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        left = t if not gone else b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        want[i, left, s] += bool(left) or not gone
    assert Counter(data[3]) == +want and any(t != left for (_, t, _), (_, left, _) in zip(sorted(data[2], key=str), sorted(data[3], key=str)))
    # mixture: whole documents, near the targets of their sources
    held, used = defaultdict(int), defaultdict(int)
    for _, t, s in data[3]:
        held[s] += len(words(t))
    for _, t, s in data[4]:
        used[s] += len(words(t))
    names = sorted(held, key=mixing.source_order)
    target = dict(zip(names, mixing.fill(sum(held.values()), [held[x] for x in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    largest = {x: max(len(words(t)) for _, t, s in data[3] if s == x) for x in names}
    assert all(abs(used[x] - target[x]) <= largest[x] for x in names)
    times = Counter(data[4])
    assert all(times[r] <= 3 * n for r, n in Counter(data[3]).items()) and set(times) <= set(data[3])
    # packing: all ids of all rows
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(queries.public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for i, t, _ in data[4]:
        ids[i] += len(one.encode(t, add_special_tokens=False).ids) + 1
    got = Counter()
    for p in tables[-1].collect():
        got[p["doc_id"]] += p["length"]
    assert got == ids
    empty = spark.createDataFrame([], schema)
    for name, stage in c.STAGES:
        assert stage(spark, empty, DATA).isEmpty(), name
