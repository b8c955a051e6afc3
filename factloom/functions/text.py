"""Text functions as expressions of built-in functions; none runs Python per row (entropy counts characters of whole Arrow batches)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import DoubleType

SQL_WORDS = "alter create delete drop from insert join select set table union update values where".split()
CHAINED_WORDS = "cat cd cp grep ls mkdir mv pwd rm rmdir".split()
SHELL_WORDS = sorted(CHAINED_WORDS + "apt awk brew chmod chown curl df dnf du echo export find gzip kill nc netcat npm pip printf ps scp sed source ssh tar top wget xargs yum".split())
PROSE_STARTS = "a an can could may might please should that the this would".split()
#: Language -> (pattern, score); the best hit counts. Patterns without look-around or back-references, so that SQL engines agree.
PATTERNS: dict[str, list[tuple[str, float]]] = {
    "sql": [
        (r"(?is)\bselect\b.+\bfrom\b", 0.95), (r"(?is)\binsert\s+into\b..*\bvalues\b", 0.95), (r"(?is)\bupdate\b.+\bset\b", 0.95), (r"(?i)\bcreate\s+table\b", 0.95),
        (r"(?is)\b(alter|create|delete|drop|insert|update)\b.*\b(from|join|set|table|values|where)\b", 0.85),
    ],
    "shell": [
        (r"\S\s*\|\s*\S", 0.85), (rf"(?i)\b({'|'.join(SHELL_WORDS)})\s+-[a-zA-Z]+", 0.9), (r"[<>]", 0.8), (r"\$\(.*\)|`.*`", 0.9), (r"\$\{?\w+\}?", 0.7),
        (rf"(?i)\b({'|'.join(CHAINED_WORDS)})\b.*(&&|\|\||;)", 0.85),
    ],
    "xml": [(r"(?i)<\?xml\s+version=", 0.95), (r"xmlns[:=]", 0.9)],
    "html": [(r"<\s*[A-Za-z][0-9A-Za-z]*\b[^>]*/\s*>", 0.9), (r"(?i)<!doctype\s+html>", 0.95), (r"(?i)<\s*(a|body|div|head|html|img|p|script|span|style)\b", 0.85)],
    "regex": [(r"(\.\*|\.\+|\(.*\)|\{[,\d]+\}|\\[DSWdsw]|\[\^?[^\]]+\])", 0.75), (r"[$^]|\\[Bb]", 0.65)],
}
#: An element closed by its own name; a back-reference, which Java has.
HTML_PAIR = r"(?s)<\s*(\p{Alpha}\p{Alnum}*)\b[^>]*+>(?:.*?)</\s*+\1\s*+>"
REGEX_FEATURES = [r"\^|\$", r"\.\*|\.\+", r"\(.*\)", r"\{[,\d]+\}", r"\\[DSWdsw]", r"\[\^?[^\]]+\]"]
ORDER = ("sql", "shell", "xml", "html", "json", "regex")
SECRETS = [
    ("aws_access_key", r"\b(AKIA[0-9A-Z]{16})\b"), ("github_token", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"), ("stripe_key", r"\b(sk_live_[0-9a-zA-Z]{24,})\b"), ("api_key", r"\b(sk-[A-Za-z0-9_\-]{16,})"), ("google_key", r"\b(AIza[0-9A-Za-z_\-]{35})"),
    ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"), ("assignment", r"(?i)\b(?:password|passwd|secret|token|api_key)\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']"), ("email", r"\b([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b"),
]


def best(text: Column, patterns: Sequence[tuple[str, float]]) -> Column:
    return F.greatest(*[F.when(text.rlike(p), F.lit(s)).otherwise(F.lit(0.0)) for p, s in patterns], F.lit(0.0))


def hits(text: Column, patterns: Sequence[str]) -> Column:
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def distinct_words(text: Column, words: Sequence[str]) -> Column:
    """How many of the words stand in the text, in any case: one pass for all of them."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b({'|'.join(words)})\b"), F.lit(1))
    return F.size(F.array_distinct(F.transform(found, F.lower)))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value. Spark's own parsers stop after the first value, and ignore what follows it.

    Strings are blanked first, by a pattern that holds them strictly, so that a mark behind the value can't be one of its own."""
    blank = F.regexp_replace(text, r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"', '""')
    strict = ~F.contains(F.replace(blank, F.lit('""'), F.lit("")), F.lit('"')) & ~F.contains(blank, F.lit("'"))
    whole = F.get_json_object(F.concat(F.lit("["), blank, F.lit(',"."]')), "$[1]") == "."
    return F.coalesce(F.when(text.rlike(r'\A[\t\n\r ]*+["\[{\-0-9tfn]'), strict & whole), F.lit(False))


def embedded_scores(text: Column, back_references: bool = True) -> dict[str, Column]:
    """Score of each language; 0 where nothing speaks for it. YAML is left to ``embedded_yaml`` in operators.code_text."""
    sql_n, shell_n = distinct_words(text, SQL_WORDS), distinct_words(text, SHELL_WORDS)
    features = hits(text, REGEX_FEATURES)
    prose = F.lower(F.regexp_extract(text, r"(\S+)", 1)).isin(*PROSE_STARTS)
    html = PATTERNS["html"] + ([(HTML_PAIR, 0.95)] if back_references else [])
    parsed = is_json(text)
    return {
        "sql": F.when(prose, 0.0).otherwise(F.greatest(best(text, PATTERNS["sql"]), F.when(sql_n >= 3, 0.8).when(sql_n >= 2, 0.65).otherwise(0.0))),
        "shell": F.greatest(best(text, PATTERNS["shell"]), F.when(shell_n >= 2, 0.75).otherwise(0.0)),
        "xml": best(text, PATTERNS["xml"]),
        "html": best(text, html),
        "json": F.when(parsed & text.rlike(r"\A\s*[\{\[]"), 0.95).when(parsed, 0.7).when(text.rlike(r"(?s)\A\s*[\[{].*[\]}]\s*\z"), 0.5).otherwise(0.0),
        "regex": F.greatest(best(text, PATTERNS["regex"]), F.when(features >= 3, 0.85).when(features >= 2, 0.7).otherwise(0.0)),
    }


def embedded_language(scores: dict[str, Column], text: Column) -> tuple[Column, Column]:
    """Language and score of the best above one half; ties go by ORDER, texts of under five characters have none.

    The scores are read several times: give columns of a projection, not the expressions."""
    top = F.greatest(*scores.values())
    name: Column | None = None
    for k in ORDER:
        name = F.when(scores[k] == top, k) if name is None else name.when(scores[k] == top, k)
    found = (top > 0.5) & (F.length(F.trim(text)) >= 5)
    return F.when(found, name), F.when(found, top).otherwise(0.0)


@arrow_udf(DoubleType())
def _bits(column: pa.Array) -> pa.Array:
    """Entropy of each text, by one count of (text, character) pairs."""
    texts = column.fill_null("").to_pylist()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array(list(map(len, texts)), np.int64)
    pair, k = np.unique(np.repeat(np.arange(len(texts)), size) << 21 | code, return_counts=True)
    of = pair >> 21
    share = k / size[of]
    return pa.array(np.bincount(of, -share * np.log2(share), len(texts)), pa.float64())


def entropy(text: Column, most: int = 2000) -> Column:
    """Shannon entropy in bits of the first characters; 0 for null and empty texts."""
    return _bits(F.substring(text, 1, most))


def obfuscation_reasons(text: Column) -> Column:
    """Names of the signs that a source is obfuscated; two make the verdict, a null byte alone does too."""
    n = F.length(text)
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    long_lines = F.size(F.filter(lines, lambda x: F.length(x) >= 300))
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.size(lines)
    names = F.regexp_extract_all(text, F.lit(r"([_A-Za-z]\w*)"), F.lit(1))
    long_names = F.size(F.filter(names, lambda x: F.length(x) >= 30))
    odd = n - F.length(F.regexp_replace(text, r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", ""))
    rest = F.array_compact(F.array(
        F.when(odd / n > 0.02, "non_printable_ratio"),
        F.when((long_lines / F.size(lines) > 0.2) & (mean > 120), "long_lines"),
        F.when(symbols / n > 0.45, "symbol_density"),
        F.when((long_names >= 10) & (long_names / F.size(names) > 0.25), "long_identifiers"),
        F.when(entropy(text) > 4.8, "high_entropy"),
    ))
    return F.when(F.contains(text, F.lit("\0")), F.array(F.lit("null_byte"))).when(n < 200, F.array().cast("array<string>")).otherwise(rest)


def split_thinking(text: Column) -> tuple[Column, Column]:
    """The text without its thinking blocks, and the first block."""
    block = r"(?is)<thinking>(.*?)</thinking>"
    return F.trim(F.regexp_replace(text, block, "")), F.trim(F.regexp_extract(text, block, 1))


def strip_fence(text: Column) -> Column:
    """The inside of a Markdown fence that holds the whole text, else the text, trimmed."""
    inner = F.regexp_extract(F.trim(text), r"(?s)\A```[A-Za-z]*\n?(.*?)\n?```\z", 1)
    return F.when(F.trim(text).startswith("```"), F.trim(inner)).otherwise(F.trim(text))


def json_object(text: Column) -> Column:
    """A JSON object in free text: in a fence, else from the first opening to the last closing brace; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*+(\{.*?\})\s*+```", 1)
    wide = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(fenced), ok(wide))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def head_tail(text: Column, most: int = 4000, head: float = 0.6) -> Column:
    """The beginning and the end of a text that is too long, with a mark between."""
    n = int(most * head)
    cut = F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("\n...<truncated>...\n"), F.ltrim(F.right(text, F.lit(most - n))))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def format_bytes(n: Column) -> Column:
    """One decimal and the unit, B to TB."""
    out: Column | None = None
    for i, unit in enumerate("B KB MB GB TB".split()):
        part = F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(1024**i)), 1)), F.lit(f" {unit}"))
        out = F.when(n < 1024 ** (i + 1), part) if out is None else out.when(n < 1024 ** (i + 1), part) if unit != "TB" else out.otherwise(part)
    return out


def prefixes(dotted: Column) -> Column:
    """``a.b.c`` to ``[a, a.b, a.b.c]``."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def relative_path(path: Column, root: str) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.startswith(root.rstrip("/") + "/"), F.substring(p, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(p)


def version_key(version: Column) -> Column:
    """Sortable array of the numbers of a release version, padded to four; a pre-release sorts below its release."""
    numbers = F.transform(F.split(F.regexp_extract(version, r"\A[vV]?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long")))
    final = F.when(version.rlike(r"(?i)\d(a|b|rc|alpha|beta|\.?dev)\d*"), 0).otherwise(1)
    return F.concat(F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), 4)), 1, 4), F.array(final.cast("long")))


def span_text(source: Column, start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Text of a span of lines (from 1) and byte columns (from 0); empty where the span doesn't lie in the source."""
    lines = F.split(source, "\n")
    piece = lambda line, a, n: F.decode(F.substring(F.encode(line, "UTF-8"), a + 1, n), "UTF-8")
    first, last = F.get(lines, start_line - 1), F.get(lines, end_line - 1)
    one = piece(first, start_col, end_col - start_col)
    many = F.array_join(F.concat(F.array(piece(first, start_col, F.lit(1 << 30))), F.slice(lines, start_line + 1, F.greatest(end_line - start_line - 1, F.lit(0))), F.array(piece(last, F.lit(0), end_col))), "\n")
    fits = (start_line >= 1) & (end_line >= start_line) & (end_line <= F.size(lines)) & (start_col >= 0) & ((end_line > start_line) | (end_col >= start_col))
    return F.when(fits & (start_line == end_line), one).when(fits, many).otherwise("")


def whole_number(text: Column, fallback: int) -> Column:
    """An integer from text, with a fallback for what is none."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(fallback))


def named(text: Column, fallback: str) -> Column:
    """Trimmed text, with a fallback for null and blank."""
    return F.coalesce(F.when(F.trim(text) != "", F.trim(text)), F.lit(fallback))


def iso_utc(at: Column) -> Column:
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stamp(at: Column) -> Column:
    """Sortable digits, as snapshot folders are named."""
    return F.date_format(at.cast("timestamp"), "yyyyMMddHHmmss")
