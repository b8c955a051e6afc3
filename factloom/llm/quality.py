"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import words

#: Frequent short words of four languages, compared after lower-casing.
STOP_WORDS = (
    "the of and to in a is that it was for with as be this on are by or from at an not "
    "der die das und ist nicht ein eine zu den dem des von mit im sich auf für auch es als "
    "le la les de des du un une et est dans que qui en pour pas par sur au avec ce il "
    "el los las y del se por con una su para al lo no como más o pero"
).split()


@dataclass(frozen=True)
class Rule:
    """Bounds (inclusive) for one measure of a text; a null bound doesn't apply, and a null measure passes.

    ``least_words``: the rule is silent on shorter texts, where a ratio says little."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: The production table. Length and repetition come first (the base); the rest is the verdict.
RULES: tuple[Rule, ...] = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.02, None, 50),
    Rule("bangs", "bang_ratio", None, 0.2),
    Rule("dup_lines", "dup_line_ratio", None, 0.5),
    Rule("short_lines", "short_line_ratio", None, 0.8, 50),
)


#: Columns that the operator adds; an input column of such a name is replaced.
ADDED = ("_", "q", "base_failed", "failed_rules", "kept")


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct ``q`` of counts and ratios to each row; other columns stay as they are.

    Null and empty texts have zero counts and null ratios. Rows aren't compared, so ties and repeated rows are kept.
    Repeated windows are found by sorting, per text, (32 bits of a hash, position) packed in a long; equal neighbours are
    confirmed on their words, so hashes never decide. Texts of any length stay n log n.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]).alias("_row")
    df = docs.select(keep, t.alias("_t"))
    df = _with(df, _w=words(F.col("_t")), _lines=F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0))
    w = F.col("_w")
    n = F.size(w)
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    packed = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 32).bitwiseOR(i.cast("long"))))
    df = _with(df, _p=F.sort_array(F.coalesce(packed, F.array().cast("array<long>"))))
    p = F.col("_p")
    near = F.filter(p, lambda x, k: (F.shiftright(F.get(p, k - 1), 32) == F.shiftright(x, 32)) | (F.shiftright(F.get(p, k + 1), 32) == F.shiftright(x, 32)))
    df = _with(df, _near=F.sort_array(F.transform(near, lambda x: F.struct(window(x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("w"), x.bitwiseAND(0x7FFFFFFF).cast("int").alias("i")))))
    s = F.col("_near")
    df = _with(df, _at=F.sort_array(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"])), lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    chars = lambda c: F.length("_t") - F.length(F.translate("_t", c, ""))
    df = df.select(
        "_row",
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            chars("#*$%&|<>").cast("long").alias("n_symbols"),
            chars("!").cast("long").alias("n_bangs"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.size(F.filter("_lines", lambda x: F.length(x) < 20)).cast("long").alias("n_short_lines"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            covered.cast("long").alias("n_repeat_words"),
        ).alias("q"),
    )
    ratio = lambda a, b: F.try_divide(F.col(f"q.{a}").cast("double"), F.col(f"q.{b}").cast("double"))
    q = F.struct(
        "q.*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_bangs", "n_words").alias("bang_ratio"),
        ratio("n_stop", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_short_lines", "n_lines").alias("short_line_ratio"),
    )
    # a generator of one row: a filter on a verdict stays above it, and the optimiser doesn't copy the measures into the filter
    return df.select("_row", F.explode(F.array(q)).alias("q")).select("_row.*", "q").drop("_")


def verdicts(q: str = "q", rules: Sequence[Rule] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> tuple[Column, Column, Column]:
    """Columns base_failed, failed (names of the rules broken, in table order) and kept, from the struct of ``measured``."""
    m = lambda c: F.col(f"`{q}`.{c}")
    base = (m("n_words") < min_words) | (100 * m("n_repeat_words") > max_repeat_percent * m("n_words"))
    broken = []
    for r in rules:
        x, bad = m(r.measure), F.lit(False)
        if r.low is not None:
            bad = bad | (x < r.low)
        if r.high is not None:
            bad = bad | (x > r.high)
        broken.append(F.when((m("n_words") >= r.least_words) & F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    failed = F.array_compact(F.array(*broken))
    return base, failed, ~base & (F.size(failed) == 0)


def apply_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """All columns of docs with q, base_failed, failed_rules and kept; one projection, no shuffle, no user function."""
    base, failed, kept = verdicts(rules=rules)
    return measured(docs, text).select("*", base.alias("base_failed"), failed.alias("failed_rules"), kept.alias("kept"))


def rules_sql(rules: Sequence[Rule] = RULES) -> str:
    """The verdict of the table as a DuckDB expression over columns of the same names."""
    parts = []
    for r in rules:
        b = " OR ".join([f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None))
        parts.append(f"(n_words >= {r.least_words} AND coalesce({b}, false))")
    return " OR ".join(parts)
