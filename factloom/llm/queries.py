"""The queries op1 to op10 of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import language, media, mixing, neardup, packing, quality, sharding, substrings, urls, warc
from factloom.llm.common import durable, over_cores, words

SHARDS, ROOM = 24, 2048


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return over_cores(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_cores(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), "page_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base and verdict of every document."""
    judged = quality.apply_rules(documents(spark, sf_dir, "doc_id", "text"))
    return judged.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT row_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT row_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos),
rep AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT row_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS k FROM rep) GROUP BY row_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(list_filter(ls, lambda x: length(x) < 20)) AS n_short_lines,
 len(list_filter(ws, lambda x: list_contains({quality.STOP_WORDS!r}, lower(x)))) AS n_stop, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (row_id)),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio, n_bangs / nullif(n_words, 0) AS bang_ratio, n_stop / nullif(n_words, 0) AS stop_ratio,
 n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_short_lines / nullif(n_lines, 0) AS short_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR {quality.rules_sql()}) AS kept,
 array_to_string(list_filter([{", ".join(f"CASE WHEN {quality.rules_sql([r])} THEN '{r.name}' END" for r in quality.RULES)}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM r
"""


def op2_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles at a similarity of 0.8."""
    found = neardup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived as a WARC record and read back."""
    return warc.round_trip(pages(spark, sf_dir), 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents that are not held out."""
    d = documents(spark, sf_dir, "doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = language.train(d.withColumn("_held", held), ~F.col("_held"), F.col("doc_id"))
    found = language.identify(d.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document on a ring of 24 shards with loads bounded at an equal share of the rows, so that counts are at most one apart."""
    d = documents(spark, sf_dir, "doc_id", "text")
    utf8 = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = d.select("doc_id", (F.octet_length(utf8) + 8).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    placed = sharding.assign_shards(rows, SHARDS, [F.col("doc_id")], [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in pieces, packed into sequences of at most 2048."""
    tokenise = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"), end=1)
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), tokenise, ROOM)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document for its source, by the weights 5, 2, 1; the pattern is the sources that hold its text."""
    d = documents(spark, sf_dir, "doc_id", "text", "source")
    sized = durable(d.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.md5("text").alias("digest")))
    held = mixing.with_members(sized, "digest")
    mixed = mixing.mix_sources(held, F.col("members"), F.col("size"), [F.col("doc_id"), F.col("size"), F.col("digest")], home=F.col("source"))
    own = F.get("_sources", F.lit(0))
    return mixed.select("doc_id", "size", own["size"].alias("source_size"), own["target"].alias("target"), F.col("_taken").alias("taken"), F.col("_copies").alias("copies"), F.col("_pattern").alias("pattern"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge_urls(pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict", "via")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a 13-word passage of an earlier document covers, and the digest of the rest."""
    return substrings.removal_report(documents(spark, sf_dir, "doc_id", "text"), 13)


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as GIF samples and read back."""
    return media.digests(documents(spark, sf_dir, "doc_id", "text"))


def _op8_sql() -> str:
    host = lambda u: f"lower(regexp_extract(CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END, '^([^/?#]*)', 1))"
    rest = lambda u, to: f"regexp_extract(CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END, '^[^/?#]*([^{to}]*)', 1)"

    def rule(h: str, p: str, what: int) -> str:
        arms = [f"WHEN ({h} = '{x}' OR ends_with({h}, '.{x}')) AND starts_with({p}, '{y}') THEN '{(x + y, v)[what]}'" for v, x, y in sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[1:]))]
        return "CASE " + " ".join(arms) + " END"

    return rf"""
WITH RECURSIVE p AS (SELECT page_id, url, {host("coalesce(url, '')")} AS host, {rest("coalesce(url, '')", "?#")} AS path, {rest("coalesce(url, '')", "#")} AS tail, html FROM pages),
tags AS (SELECT url, host, path, tail, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE host <> ''),
hit AS (SELECT *, replace(CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
 WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END, '&amp;', '&') AS t FROM tags),
abs AS (SELECT host || tail AS u, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN t WHEN starts_with(t, '//') THEN 'x:' || t WHEN starts_with(t, '/') THEN 'x://' || host || t
 ELSE 'x://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || t END AS t FROM hit WHERE t <> ''),
e0 AS (SELECT DISTINCT u, {host("t")} || {rest("t", "#")} AS v FROM abs WHERE {host("t")} <> ''),
e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0),
reach AS (SELECT u AS s, u AS t FROM e UNION SELECT r.s, e.v FROM reach r JOIN e ON r.t = e.u),
flags AS (SELECT s, bool_or(v = 'allow') AS allowed, bool_or(v = 'block') AS blocked FROM (SELECT s, {rule("regexp_extract(t, '^([^/?#]*)', 1)", "regexp_extract(t, '^[^/?#]*([^?#]*)', 1)", 1)} AS v FROM reach) GROUP BY s),
j AS (SELECT page_id, host, path, {rule("host", "path", 0)} AS rule, {rule("host", "path", 1)} AS own, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END AS passed FROM p LEFT JOIN flags ON host <> '' AND s = host || tail)
SELECT page_id, host, path, rule, coalesce(own, passed, 'allow') AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN passed IS NOT NULL THEN 'alias' ELSE 'default' END AS via FROM j
"""


_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d), x AS (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM w),
s0 AS (SELECT DISTINCT doc_id, g FROM x WHERE g IS NOT NULL UNION ALL SELECT doc_id, ws[1] FROM d WHERE len(ws) = 1), n AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS same FROM s0 GROUP BY 1),
s AS (SELECT s0.*, n FROM s0 JOIN n USING (doc_id)), p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept, CASE WHEN same IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY same) END AS class_id FROM c LEFT JOIN n USING (doc_id)
"""


def _base32(hex_: str) -> str:
    """Base32 of a SHA-1 given as hex: four letters for each five digits."""
    five = [f"('0x' || substr({hex_}, {5 * i + 1}, 5))::BIGINT" for i in range(8)]
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({x} >> {shift}) & 31)::INT + 1, 1)" for x in five for shift in (15, 10, 5, 0))


OP3_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), l AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_base32("h")} AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to, url, NULL::VARCHAR AS error FROM l
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
x AS (SELECT doc_id, i, w || {" || ".join(f"' ' || lead(w, {k}) OVER o" for k in range(1, 13))} AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM x WHERE g IS NOT NULL) WHERE first < doc_id), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_odd_sketch": op2_minhash_odd_sketch,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_url_filters": op8_url_filters,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_gif_media": op10_gif_media,
}
ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op2_minhash_odd_sketch": OP2_SQL, "op3_warc": OP3_SQL, "op8_url_filters": _op8_sql(), "op9_substring_dedup": OP9_SQL}
