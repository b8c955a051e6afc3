"""Rows that can't be read, null keys and claims beyond a bound: each gives a defined result, and ends no job."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions import risk
from factloom.functions import text as T
from factloom.operators import code_text, graphs, knowledge, scan
from factloom.sources import code, project
from factloom.streaming import machines


def test_null_keys_share_a_budget_and_a_breaker(spark):
    rows = [(None, 1, 2000), (None, 2, 2000), (None, 3, 900), (1, 1, 2000), (1, 2, 2000), (2, 1, None), (2, 2, 3000)]
    df = spark.createDataFrame(rows, "user long, at int, cost long")
    got = sorted(map(tuple, machines.budget_admission(df, "user", ["at"], "cost", 3000).collect()), key=str)
    assert got == sorted([(None, 1, 2000, True, 0), (None, 2, 2000, False, 2000), (None, 3, 900, True, 2000), (1, 1, 2000, True, 0), (1, 2, 2000, False, 2000), (2, 1, None, True, 0), (2, 2, 3000, True, 0)], key=str)
    events = spark.createDataFrame([(None, i, float(i), True) for i in range(5)], "key string, event_id long, now double, failed boolean")
    assert [r["allowed"] for r in sorted(machines.circuit_breaker(events).collect(), key=lambda r: r["event_id"])] == [True] * 3 + [False] * 2


def test_budget_is_corrected_by_use(spark):
    df = spark.createDataFrame([(1, 1, 80, 10), (1, 2, 80, None), (1, 3, 20, 0), (1, 4, 5, 5)], "user int, at int, cost long, used long")
    rows = sorted(machines.budget_admission(df, "user", ["at"], "cost", 100, "used").collect(), key=lambda r: r["at"])
    assert [(r["admitted"], r["spent_before"]) for r in rows] == [(True, 0), (True, 10), (False, 90), (True, 90)]
    rows = machines.budget_admission(df, "user", ["at"], "cost", 100, price=1000.0, most_price=85.0).collect()
    assert sorted((r["at"], r["admitted"]) for r in rows) == [(1, True), (2, False), (3, False), (4, True)]


def test_sources_that_nest_too_deep_or_are_none(spark):
    deep = "x = " + "+".join(["a"] * 20_000)
    rows = [(1, deep), (2, "def f(:"), (3, None), (4, '"""d"""\nx = 1'), (5, "x\0"), (6, "a" + ".b" * 20_000)]
    df = spark.createDataFrame([(str(i), t) for i, t in rows], "file_path string, source string")
    bare = {int(r[0]): r[1] for r in df.select("file_path", code_text.strip_docstrings(F.col("source"))).collect()}
    assert bare[4] == "x = 1" and bare[2] is bare[3] is bare[5] is None and set(bare) == {1, 2, 3, 4, 5, 6}
    masked = {int(r["file_path"]): r["masked"] for r in code_text.masked(df).collect()}
    assert masked[2] is masked[3] is None and set(masked) == set(bare)
    texts = ["date: 2020-99-99", "[" * 5000, None, "a: 1", "- x\n- y", ""]
    kinds = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", code_text.yaml_kind(F.col("t"))).collect()
    assert dict(kinds) == {0: "broken", 1: "broken", 2: None, 3: "dict", 4: "list", 5: "scalar"}


def test_project_files_of_the_wrong_shape(spark):
    files = [("a", "pyproject.toml", "project = 'x'"), ("b", "poetry.lock", "package = ['x']"), ("c", "pyproject.toml", "[tool.poetry.dependencies]\nx = 1\ny = {version = 2, extras = 'e'}\nz = '^1.2'"), ("d", "poetry.lock", "[[package]]\nversion = '1'"), ("e", "pyproject.toml", "= broken"), ("f", "pdm.lock", "[[package]]\nname = 'P'\nversion = '1'"), ("g", "requirements.txt", None)]
    got = {(r["project"], r["name"], r["version"], r["specifier"]) for r in project.dependencies(spark.createDataFrame(files, "project string, name string, content string")).collect()}
    assert got == {("c", "x", "", ""), ("c", "y", "", ""), ("c", "z", "", ">=1.2,<2"), ("f", "p", "1", "")}
    specs = ['{"openapi": "3", "paths": 7}', '{"openapi": "3", "paths": {"/a": {"get": {"responses": {"200": 5}}, "x": 3}}}', "paths: {", None, '{"paths": {}}', '{"openapi": "3", "paths": {"/r": {"put": {"requestBody": {"$ref": "#/components/requestBodies/R"}}}}, "components": {"requestBodies": {"R": {"content": {"application/json": {"schema": {"$ref": "#/components/x"}}}}}, "x": {"p": {"$ref": "#/components/x"}}}}']
    ops = [tuple(r) for r in project.openapi(spark.createDataFrame(list(enumerate(specs)), "key int, content string")).collect()]
    assert sorted(ops) == [(1, "/a", "GET", None, None), (5, "/r", "PUT", '{"p":{"$ref":"#/components/x"}}', None)]


def test_requirement_lines(spark):
    lines = {"git+https://h/p.git@v1#egg=My_Pack": ("my_pack", "", ""), "git+https://h/p.git": (None, "", ""), "git+ssh://g@h/p#subdirectory=s&egg=q": ("q", "", ""), "a[x,y] >= 1, <2 # c": ("a", "x,y", ">=1,<2"), "# c": (None, "", ""), "": (None, "", ""), "gitpython==3": ("gitpython", "", "==3")}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    r = knowledge.requirement(F.col("line"))
    assert {x["line"]: (x["n"], x["e"], x["s"]) for x in df.select("line", r["name"].alias("n"), r["extras"].alias("e"), r["specifier"].alias("s")).collect()} == lines


def test_settings_of_containers_and_paths(spark):
    files = [("p", "Dockerfile", "FROM x\nENV MODE=prod\nENV A b c\nARG N=1\nRUN export Z=1\n"), ("p", ".env", "PYTHONPATH=/a:/b: c\n"), ("q", "settings.py", "PYTHONPATH = ['/x', 'y']\n"), ("r", ".env", "PYTHONPATH=C:\\\\x;D:\\\\y\n"), ("s", "Dockerfile", None)]
    found = project.settings(spark.createDataFrame(files, "project string, name string, content string"))
    assert {(r["key"], r["value"]) for r in found.filter("origin = 'Dockerfile'").collect()} == {("MODE", "prod"), ("A", "b c"), ("N", "1")}
    paths = sorted((r["project"], r["i"], r["path"]) for r in project.python_paths(found).collect())
    assert paths == [("p", 0, "/a"), ("p", 1, "/b"), ("p", 2, "c"), ("q", 0, "/x"), ("q", 1, "y"), ("r", 0, "C:\\\\x"), ("r", 1, "D:\\\\y")]


PACK = """
rules:
- id: r.sql
  severity: ERROR
  message: m
  metadata: {cwe: CWE-89}
  patterns:
  - pattern-either:
    - pattern: $C.execute("..." % $V)
    - pattern: |
        $Q = f"..."
        ...
        $C.execute($Q)
- {id: r.shell, severity: WARNING, message: m, pattern: "subprocess.run(..., shell=True)"}
- {id: r.loop, severity: INFO, message: m, pattern: "for $X in $Y: ..."}
"""


def test_rule_packs_run(spark):
    rules, left = project.pack_rules(PACK)
    assert [(r[0], r[3], r[4]) for r in rules] == [("r.sql", "built", r"\.execute$")] * 2 + [("r.shell", "keyword:shell", r"^subprocess\.run$")] and left == [("r.loop", "for $X in $Y: ...")]
    source = 'import subprocess\ncur.execute("a %s" % x)\nq = f"{x}"\ncur.execute(q)\ncur.execute("a")\nsubprocess.run(c, shell=True)\nsubprocess.run(c)\n'
    nodes = code.table(code.parse(spark.createDataFrame([("a.py", source)], "file_path string, source string"), tables=("nodes",)), "nodes")
    assert sorted((r["check_id"], r["severity"], r["cwe"], r["line"]) for r in scan.rule_findings(nodes, rules).collect()) == [("r.shell", "WARNING", None, 6), ("r.sql", "ERROR", "CWE-89", 2), ("r.sql", "ERROR", "CWE-89", 4)]
    assert scan.rule_findings(nodes, []).isEmpty()


def test_limits_of_quality(spark):
    rows = [(0.7, 0.61, 0.3), (0.81, 0.71, 0.19), (0.8, 0.7, 0.2), (None, 0.6, None)]
    df = spark.createDataFrame(rows, "p double, r double, f double").select(risk.quality_alerts(precision=F.col("p"), recall=F.col("r"), fpr=F.col("f")).alias("a"))
    assert [[tuple(x) for x in r["a"]] for r in df.collect()] == [[("precision", "critical"), ("recall", "warning"), ("fpr", "critical")], [], [("precision", "warning"), ("recall", "warning"), ("fpr", "warning")], [("recall", "critical")]]


def test_entropy_and_words(spark):
    texts = [None, "", "a", "ab" * 3000, "é中💡", "select SELECT From x", "selected from_", "x" * 2000 + "abc"]

    def bits(t):
        t = (t or "")[:2000]
        return sum(-n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    out = {r["i"]: (r["e"], r["w"]) for r in df.select("i", T.entropy(F.col("t")).alias("e"), T.distinct_words(F.col("t"), T.SQL_WORDS).alias("w")).collect()}
    assert all(out[i][0] == pytest.approx(bits(t)) for i, t in enumerate(texts))
    assert [out[i][1] for i in (5, 6)] == [2, 0]


def test_bounds_are_errors(spark, monkeypatch):
    monkeypatch.setattr(scan, "MOST_POPULAR", 2)
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "popular string")
    with pytest.raises(ValueError):
        scan.typosquats(names.withColumnRenamed("popular", "name"), names)
    long = spark.createDataFrame([(0, i, i + 1) for i in range(12)], "k int, src int, dst int")
    start = spark.createDataFrame([(0, 0)], "k int, node int")
    with pytest.raises(RuntimeError):
        graphs.reach(start, long, ["k"], rounds=5)
    assert graphs.reach(start, long, ["k"]).count() == 13
