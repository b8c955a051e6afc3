"""Queries over all rows of their tables, against brute force on fixtures that reach beyond any filter."""

import ast
import json
import re

import pytest
import yaml

from factloom.functions import text as T
from factloom.plans import code, tables, texts
from factloom.plans.corpus import TEMPLATES


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder with a lineitem table, and its rows: 120 orders of up to nine lines, some with gaps and repeated lines."""
    rows = [(k, n, k % 7, k * n % 5, "ARN"[(k * n + n) % 3]) for k in range(1, 121) for n in range(1, 2 + k % 9) if (k + n) % 11]
    rows += rows[::9]
    folder = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return folder, rows


def orders(rows):
    out = {}
    for k, n, *_ in rows:
        out.setdefault(k, set()).add(n)
    return out


def test_backward_paths_of_every_order_and_line(spark, lines):
    folder, rows = lines

    def back(own, n):
        yield from ([[1]] if n == 1 else (p + [n] for m in (n - 1, n - 2) if m in own for p in back(own, m)))

    want = sorted((k, ">".join(map(str, p))) for k, own in orders(rows).items() for p in back(own, max(own)))
    assert len({k for k, _ in want}) > 60 and max(len(p) for _, p in want) == len("1>2>3>4>5>6>7>8>9")
    assert sorted(map(tuple, tables.backward_paths(spark, folder).collect())) == want


def test_reach_of_every_order(spark, lines):
    folder, rows = lines
    goes = {(k, n) for k, n, *_, flag in rows if flag != "R"}
    want = []
    for k, own in orders(rows).items():
        n = 1
        while n in own:
            want.append((k, n, n - 1))
            if (k, n) not in goes:
                break
            n += 1
    assert {k % 10 for k, *_ in want} == set(range(10))
    assert sorted(map(tuple, tables.dataflow_reach(spark, folder).collect())) == sorted(want)


PROSE = "plain words stand here and more of them follow " * 40
LATE = [
    "SELECT a FROM t WHERE b", "ls -la /tmp", "<custom>x</custom>", "<?xml version='1.0'?>", "[0-9]{2}(x).* y", "cat x | grep y", "", "\nkey: value\n- item", "&& {", "<p>x</p>",
]
TEXTS = [PROSE + x for x in LATE] + ["The " + PROSE + LATE[0], "a: 1\nb: " + PROSE + "x", json.dumps({"a": PROSE}), "{" + PROSE + "}", json.dumps([PROSE] * 3), "- " + PROSE + "\n- x", None, "", "abc", "12345"]


def scores(t, pair=True):
    """Score of each language by Python's own regular expressions and parsers."""
    t = t or ""
    some = lambda ps: max([0.0, *(s for p, s in ps if re.search(p, t))])
    hits = lambda ps: sum(bool(re.search(p, t)) for p in ps)
    words = lambda ws: hits([rf"(?i)\b{w}\b" for w in ws])
    try:
        json.loads(t)
        parsed = True
    except ValueError:
        parsed = False
    first = (t.split() or [""])[0].lower()
    n, m = words(T.SQL_WORDS), hits(T.REGEX_FEATURES)
    tag = [(T.HTML_PAIR.replace(r"\p{Alpha}", "[A-Za-z]").replace(r"\p{Alnum}", "[A-Za-z0-9]"), 0.95)] if pair else []
    return {
        "sql": 0.0 if first in T.PROSE_STARTS else max(some(T.PATTERNS["sql"]), 0.8 if n >= 3 else 0.65 if n >= 2 else 0.0),
        "shell": max(some(T.PATTERNS["shell"]), 0.75 if words(T.SHELL_WORDS) >= 2 else 0.0),
        "xml": some(T.PATTERNS["xml"]),
        "html": some(T.PATTERNS["html"] + tag),
        "json": (0.95 if t.lstrip()[:1] in ("{", "[") else 0.7) if parsed else 0.5 if re.search(r"(?s)\A\s*[\[{].*[\]}]\s*\Z", t) else 0.0,
        "regex": max(some(T.PATTERNS["regex"]), 0.85 if m >= 3 else 0.7 if m >= 2 else 0.0),
    }


def best(t):
    s = scores(t)
    try:
        found = yaml.safe_load(t or "")
        y = (0.9 if ":" in t and not t.strip().startswith("{") else 0.75) if isinstance(found, (dict, list)) else 0.0
    except yaml.YAMLError:
        y = 0.55 if re.search(r"(?m)^\s*[-\w]+\s*:(?:\s*).+|^\s*-\s+\w+", t) else 0.0
    top = max(s.values())
    name, top = (next(k for k in T.ORDER if s[k] == top), top) if top > 0.5 and len((t or "").strip()) >= 5 else (None, 0.0)
    return ("yaml", y) if y > 0.5 and y > top else (name, top)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A folder of the four tables of texts, each with every text."""
    folder, each = str(tmp_path_factory.mktemp("written")), list(enumerate(TEXTS))
    for name, kind, rows in (
        ("documents", "doc_id long, text string", each), ("pages", "page_id long, html string", each), ("events", "event_id long, props string", each), ("conversations", "conv_id long, turn int, text string", [(0, i, t) for i, t in each]),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_embedded_languages_of_whole_texts(spark, written):
    origins = ("conversations", "documents", "events", "pages")
    got = {(r["origin"], r["id"]): (r["language"], r["confidence"]) for r in texts.embedded_language_best(spark, written).collect()}
    assert got == {(o, i): best(t) for o in origins for i, t in enumerate(TEXTS)}
    assert {n for n, _ in got.values()} == {*T.ORDER, "yaml", None}
    got = {(r["origin"], r["id"]): [r[k] for k in T.ORDER] for r in texts.embedded_language_scores(spark, written).collect()}
    assert got == {(o, i): [scores(t, pair=False)[k] for k in T.ORDER] for o in origins for i, t in enumerate(TEXTS)}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A folder with a part table of two files per template."""
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame([(k,) for k in range(1, 21)], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    return folder




def test_code_queries_of_every_template(spark, parts):
    got = sorted(tuple(r[c] for c in ("template", "scope_id", "name", "kind", "n_defs", "n_uses", "files")) for r in code.symbol_defs_uses(spark, parts).collect())
    plain = [(t, "module", n, "import" if n == "shlex" else "var", d, u) for t, n, d, u in code.SYMBOLS]
    assert got == sorted((t, f"scope:{s}", n, kind, d, u, 2) for t, s, n, kind, d, u in plain + code.SCOPED)
    got = sorted(tuple(r[c] for c in ("template", "masked", "names", "files")) for r in code.privacy_mask(spark, parts).collect())
    assert got == sorted((*x, 2) for x in code.MASKED)
    # only template 8 has a comment and docstrings; the others give their own text and their own syntax
    want = [(t, s.replace("# a comment", " " * 11), code._BARE if t == 8 else ast.unparse(ast.parse(s)), 2) for t, s in enumerate(TEMPLATES)]
    assert sorted(tuple(r[c] for c in ("template", "plain", "bare", "files")) for r in code.comment_strip(spark, parts).collect()) == want


def test_every_event_is_looked_up(spark, tmp_path):
    rows = [(i, "abcde"[i % 5], i * 7 % 150, float(i * 37 % 80), 1_000 + i * 31 % 977) for i in range(1500)] + [(10_001, "z", 3, 1.0, 5), (9_998, "none", 151, 1.0, 5)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double, s long").selectExpr("event_id", "event_type", "user_id", "value", "timestamp_seconds(s) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    by_prompt, by_code = {}, {}
    for i, kind, user, value, s in rows:
        if i % 3 == 0:
            for d, k in ((by_prompt, i % 700), (by_code, (kind, user % 40))):
                d[k] = max(d.get(k, ()), (s, i, "TP" if value > 40 else "FP"))
    want = []
    for i, kind, user, *_ in rows:
        p, c = by_prompt.get(i % 700), by_code.get((kind, user % 40))
        want.append((i, p[2], "prompt") if p else (i, c[2], "snippet") if c else (i, None, None))
    got = [tuple(r[c] for c in ("event_id", "verdict", "origin")) for r in tables.decision_cache_lookup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {i % 3 for i, *_ in got} == {0, 1, 2}


def test_every_part_is_matched(spark, tmp_path):
    rows = [(k, f"Brand#{k % 4}", k * 5 % 50 + 1) for k in range(1, 200)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    key = lambda k, size: (size % 4, size, k % 12)
    known = {(b.lower(), key(k, size)) for k, b, size in rows}
    dotted = lambda v: ".".join(map(str, v))
    latest = {n: dotted(max(v for m, v in known if m == n)) for n, _ in known}
    want = {(b.lower(), "99.0", latest[b.lower()]) if k % 2 == 0 else (b.lower(), dotted(key(k, size)), dotted(key(k, size))) for k, b, size in rows}
    assert sorted(map(tuple, tables.profile_match(spark, str(tmp_path)).collect())) == sorted(want)
