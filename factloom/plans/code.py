"""Queries over the corpus of Python files: syntax, control flow, versions, calls, taint, rules, reports."""

from __future__ import annotations

import ast
from collections import Counter

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import risk
from factloom.operators import code_text, graphs, scan
from factloom.plans.corpus import TEMPLATES, K, corpus, per_template, template_of, values
from factloom.sources import code


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return code.table(code.parse(corpus(spark, sf_dir), tables=(name,)), name).withColumn("template", template_of())


def shared(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """Parsed tables that a query reads several times, kept on disk."""
    return code.parse(corpus(spark, sf_dir), tables=tables).persist(StorageLevel.DISK_ONLY)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.file_findings(code.parse(corpus(spark, sf_dir), tables=("nodes",)))


def _files(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per template with the number of files that have them."""
    return df.groupBy("template", *columns).agg(F.count("*").alias("files"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _table(spark, sf_dir, "flows").withColumn("n", F.size("path"))
    scored = flows.withColumn("risk_score", risk.risk_score(F.col("source"), F.col("sink"), F.col("n"), F.col("implicit")))
    return scored.withColumn("confidence", F.round(risk.confidence(F.col("n"), F.col("implicit")), 4)).withColumn("risk_level", risk.risk_level(F.col("risk_score"))).withColumn("target", risk.route(F.col("risk_level")))


def taint_flows_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint flows of all files, scored, levelled and routed, per template."""
    r = _ranked(spark, sf_dir).withColumn("steps", F.array_join("path", ">")).withColumnRenamed("start_line", "line")
    return _files(r, "source", "sink", "steps", "implicit", "line", "risk_score", "confidence", "risk_level", "target").orderBy(F.desc("risk_score"), "template", "steps")


#: template, source, sink, steps, length, implicit, line
FLOWS = [(0, "input", "eval", "a_1>b_1", 2, False, 3), (2, "getenv", "print", "c_1>c_3", 2, True, 6), (2, "getenv", "print", "c_2>c_3", 2, True, 6), (3, "input", "open", "n_1>n_2", 2, False, 4)]
_SCORED = f"SELECT *, {risk.sql_score('source', 'sink', 'n', 'implicit')} AS risk_score FROM {values('template, source, sink, steps, n, implicit, line', FLOWS)}"
_COUNTS = f"(SELECT (p_partkey % {K})::INT AS t, count(*) AS files FROM part GROUP BY 1)"
FLOWS_SQL = f"""WITH s AS ({_SCORED}), l AS (SELECT *, {risk.sql_level("risk_score")} AS risk_level FROM s)
SELECT template, source, sink, steps, implicit, line, risk_score, round(least(1.0, 0.6 + least(0.25, 0.05 * n) + CASE WHEN implicit THEN 0.05 ELSE 0 END), 4)::DOUBLE AS confidence, risk_level,
CASE WHEN risk_level IN ('CRITICAL', 'HIGH') THEN 'LLM' ELSE 'RULES' END AS target, files FROM l JOIN {_COUNTS} ON t = template"""


def overall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest-scored flow of each file; the first on ties."""
    top = _ranked(spark, sf_dir).groupBy("template", "file_path").agg(F.max_by(F.struct("risk_score", "risk_level", "sink"), F.struct("risk_score", -F.col("seq"))).alias("x"))
    return _files(top.select("template", "x.*"), "risk_score", "risk_level", "sink")


OVERALL_SQL = f"""WITH s AS ({_SCORED}), m AS (SELECT template, max(risk_score) AS risk_score, arg_max(sink, risk_score) AS sink FROM s GROUP BY 1)
SELECT template, risk_score, {risk.sql_level("risk_score")} AS risk_level, sink, files FROM m JOIN {_COUNTS} ON t = template"""


def trace_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graphs.trace(_table(spark, sf_dir, "flows")).withColumn("template", template_of())
    return _files(t, "seq", "id", "version", "kind", "previous")


TRACE_ROWS = [(t, seq, f"n{i + 1}", v, ("Source", "Sink")[i], None if i == 0 else "n1") for t, seq, path in ((0, 0, ("a_1", "b_1")), (2, 0, ("c_1", "c_3")), (2, 1, ("c_2", "c_3")), (3, 0, ("n_1", "n_2"))) for i, v in enumerate(path)]


def ir_node_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nodes").groupBy("template", "kind").agg(F.count("*").alias("nodes"))


def _kinds(source: str) -> Counter:
    """Kinds by a walk of its own: every statement and visited expression, and a block per suite."""
    out = Counter({"Module": 1})
    same = {"AnnAssign": "Assign", "AugAssign": "Assign", "FunctionDef": "Function", "AsyncFunctionDef": "Function", "ClassDef": "Class", "ImportFrom": "Import", "AsyncFor": "For", "AsyncWith": "With", "Constant": "Literal", "List": "Literal", "Tuple": "Literal", "Dict": "Literal", "Set": "Literal", "YieldFrom": "Yield"}
    silent = {"Expr", "Global", "Nonlocal", "Pass", "Module", "keyword", "withitem", "arguments"}

    def doc(n):
        b = getattr(n, "body", None)
        return b[0] if isinstance(n, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and b and isinstance(b[0], ast.Expr) and isinstance(b[0].value, ast.Constant) and isinstance(b[0].value.value, str) else None

    def walk(n):
        cls = type(n).__name__
        if isinstance(n, (ast.stmt, ast.expr)) and cls not in silent:
            out[same.get(cls, cls)] += 1
        out["Block"] += {"If": 1 + bool(getattr(n, "orelse", 0)), "While": 2, "For": 2, "With": 1}.get(cls, 0)
        for f, v in ast.iter_fields(n):
            if f in ("target", "targets") and isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                continue  # names, not expressions
            if f not in ("decorator_list", "args", "returns", "annotation") or f == "args" and isinstance(v, list):
                for x in v if isinstance(v, list) else [v]:
                    if isinstance(x, ast.AST) and x is not doc(n):
                        walk(x)

    walk(ast.parse(source))
    return +out


def ir_edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "ir_edges").groupBy("template", "type").agg(F.count("*").alias("edges"))


#: Flow edges: one between statements that follow each other in a scope (nested ones end first; scopes of one name are one), and again in a block; a body back to its loop; a with to its body.
EDGES = [
    (0, "flow", 2), (1, "flow", 3), (2, "flow", 4), (2, "true", 1), (2, "false", 1), (3, "flow", 4), (3, "true", 1), (3, "false", 1), (4, "flow", 2),
    (5, "flow", 6), (6, "flow", 4), (7, "flow", 7), (8, "flow", 6), (8, "true", 2), (8, "false", 1), (9, "flow", 6),
]


def symbol_defs_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "symbols").withColumn("n_defs", F.size("defs").cast("long")).withColumn("n_uses", F.size("uses").cast("long"))
    return _files(s, "scope_id", "name", "kind", "n_defs", "n_uses")


SYMBOLS = [
    (0, "input", 0, 1), (0, "a", 1, 1), (0, "b", 1, 1), (0, "eval", 0, 1), (1, "shlex", 1, 1), (1, "input", 0, 1), (1, "a", 1, 1), (1, "b", 1, 1), (1, "os", 0, 1),
    (2, "getenv", 0, 1), (2, "a", 1, 1), (2, "c", 2, 1), (2, "print", 0, 1), (3, "input", 0, 1), (3, "n", 2, 3), (3, "step", 0, 1), (3, "open", 0, 1), (4, "input", 0, 1), (4, "a", 2, 2), (4, "print", 0, 1),
]
#: template, scope, name, kind, definitions, uses
SCOPED = [
    (5, "module", "A", "class", 1, 0), (5, "run", "self", "param", 2, 0), (5, "run", "helper", "var", 0, 1), (5, "module", "B", "class", 1, 0), (5, "main", "x", "param", 1, 3), (5, "main", "print", "var", 0, 1), (5, "module", "main", "var", 0, 1),
    (6, "work", "m", "param", 1, 1), (6, "emit", "ch", "var", 0, 1), (6, "emit", "sig", "var", 0, 1), (6, "module", "ch", "var", 0, 1), (6, "module", "work", "var", 0, 2), (6, "module", "sig", "var", 0, 1),
    (7, "module", "o", "import", 1, 2), (7, "module", "c", "import", 1, 1), (7, "module", "f", "var", 1, 1), (7, "module", "eval", "var", 0, 1), (7, "module", "getattr", "var", 0, 1), (7, "module", "password", "var", 1, 0),
    (8, "load", "path", "param", 1, 1), (8, "load", "n", "param", 1, 1), (8, "module", "seen", "var", 0, 0), (8, "load", "range", "var", 0, 1), (8, "load", "i", "var", 1, 2), (8, "load", "seen", "var", 1, 0), (8, "load", "open", "var", 0, 1), (8, "load", "h", "var", 1, 2),
    (8, "load", "requests", "var", 0, 1),
    (9, "module", "Flask", "import", 1, 1), (9, "module", "app", "var", 1, 1), (9, "read", "go", "var", 0, 1), (9, "module", "path", "var", 0, 1), (9, "module", "views", "var", 0, 1), (9, "module", "urlpatterns", "var", 1, 0),
]


def cfg_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, edges and recorded statements per file."""
    p = code.parse(corpus(spark, sf_dir), tables=("blocks", "cfg_edges", "stmts", "calls")).select("file_path", F.size("blocks").alias("blocks"), F.size("cfg_edges").alias("edges"), F.size("stmts").alias("stmts"), F.size("calls").alias("calls"))
    return _files(p.withColumn("template", template_of()), "blocks", "edges", "stmts", "calls")


BLOCKS = [(0, 1, 0, 3, 2), (1, 1, 0, 3, 3), (2, 4, 4, 5, 2), (3, 4, 4, 4, 3), (4, 1, 0, 3, 2), (5, 7, 3, 9, 5), (6, 5, 2, 6, 4), (7, 1, 0, 6, 4), (8, 8, 8, 11, 3), (9, 6, 3, 6, 4)]


def function_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "signatures")
    flat = s.withColumn("inputs", F.array_join(F.transform("inputs", lambda x: F.concat_ws(":", x["name"], x["type"])), ",")).withColumn("calls", F.array_join("calls", ",")).withColumn("side_effects", F.array_join("side_effects", ","))
    return _files(flat, "name", "inputs", "calls", "side_effects", "complexity")


SIGNATURES = [
    (5, "run", "self:Any", "helper", "", 1), (5, "main", "x:Any", "print,x.run,x.stop", "io:print", 1), (6, "work", "m:Any", "", "", 1), (6, "emit", "", "ch.basic_publish,sig.send", "", 1),
    (8, "load", "path:str,n:Any", "open,range,requests.get", "global:write:seen,io:open,net:requests.get", 3), (9, "show", "", "", "", 1), (9, "read", "", "go", "", 1),
]


def ssa_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each variable that phi placement knows; functions aren't entered from the module (their counts are 0)."""
    return _files(_table(spark, sf_dir, "ssa"), "var", "versions")


SSA = [(0, "a", 1), (0, "b", 1), (1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "c", 3), (3, "n", 3), (4, "a", 2), (5, "self", 0), (5, "x", 0), (6, "m", 0), (7, "f", 1), (7, "password", 1), (8, "path", 0), (8, "n", 0), (8, "seen", 0), (9, "app", 1), (9, "urlpatterns", 1)]


def ssa_phis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "phis").withColumn("inputs", F.array_join(F.array_sort(F.map_values("operands")), ","))
    return _files(p, "block_id", "result", "inputs")


PHIS = [(2, 4, "c_3", "c_1,c_2"), (3, 2, "n_2", "n_1,n_3")]


def resolved_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nodes").filter(F.array_contains("tags", "sink")).withColumn("tags", F.array_join("tags", ",")).withColumnRenamed("start_line", "line")
    return _files(n, "line", "resolved", "tags")


RESOLVED = [(1, 4, "os.system", "sink"), (7, 4, "os.system", "sink,alias"), (7, 5, "subprocess.call", "sink,alias")]


def dynamic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nodes").filter(F.array_contains("tags", "dynamic")).withColumn("tags", F.array_join("tags", ",")).withColumnRenamed("start_line", "line")
    return _files(n, "line", "kind", "tags")


DYNAMIC = [(0, 3, "Call", "dynamic,unscannable"), (7, 6, "Call", "dynamic,unscannable"), (7, 7, "Call", "dynamic,unscannable")]


def call_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = shared(spark, sf_dir, "calls", "methods")
    edges = graphs.call_edges(code.table(parsed, "calls"), code.table(parsed, "methods"))
    return _files(edges.withColumn("template", template_of()), "caller", "callee", "type")


CALLS = [
    (0, "module", "input"), (0, "module", "eval"), (1, "module", "input"), (1, "module", "?.quote"), (1, "module", "?.system"), (2, "module", "getenv"), (2, "module", "print"), (3, "module", "input"), (3, "module", "step"), (3, "module", "open"), (4, "module", "input"), (4, "module", "print"),
    (5, "run", "helper"), (5, "main", "A.run"), (5, "main", "B.run"), (5, "main", "?.stop"), (5, "main", "print"), (5, "module", "main"), (6, "emit", "?.basic_publish"), (6, "emit", "?.send"), (6, "module", "?.basic_consume"), (6, "module", "?.connect"),
    (7, "module", "f"), (7, "module", "c"), (7, "module", "eval"), (7, "module", "getattr"), (8, "load", "range"), (8, "load", "open"), (8, "load", "?.get"), (9, "module", "Flask"), (9, "read", "go"), (9, "module", "path"), (9, "module", "?.run"),
]


def synthetic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graphs.synthetic_edges(_table(spark, sf_dir, "messages").drop("template"))
    return _files(e.withColumn("template", template_of()), "caller", "callee", "mechanism")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_table(spark, sf_dir, "routes"), "framework", "path", "method", "handler")


ROUTES = [(9, "flask", "/a", "GET", "show"), (9, "flask", "/a", "POST", "show"), (9, "fastapi", "/b", "GET", "read"), (9, "django", "c/", "ANY", "views.c")]


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return _files(f.withColumn("template", template_of()), "check_id", "severity", "cwe", "line")


FINDINGS = [
    (0, "python.code-execution", 3, 1), (1, "python.command-injection", 4, 1), (3, "python.path-traversal", 4, 4), (7, "python.command-injection", 4, 1), (7, "python.command-injection", 5, 1), (7, "python.code-execution", 6, 1), (7, "python.hardcoded-secret", 8, 1),
    (8, "python.path-traversal", 8, 5), (9, "python.debug-enabled", 11, 6),
]
_RULE = {r[0]: (r[1], r[2]) for r in scan.RULES}


def findings_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding's block, by the lines of its file's statements; all are mapped here."""
    found = graphs.block_within(scan.file_findings(code.parse(corpus(spark, sf_dir), tables=("nodes", "stmts")), keep=("stmts",)))
    return _files(found.withColumn("template", template_of()), "check_id", "line", "block_id")


def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity and check with subtotals (an extension)."""
    f = _findings(spark, sf_dir)
    return f.rollup("severity", "check_id").agg(F.count("*").alias("findings"))


ROLLUP_SQL = f"SELECT severity, check_id, sum(files)::BIGINT AS findings FROM ({per_template('template, check_id, severity', [(t, c, _RULE[c][0]) for t, c, _, _ in FINDINGS])}) GROUP BY ROLLUP (severity, check_id)"


def privacy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked text of every file."""
    files = corpus(spark, sf_dir).withColumn("sensitive", F.array(F.lit("a")))
    m = code_text.masked(files, "sensitive").withColumn("template", template_of())
    return _files(m.withColumn("names", F.size("mapping")), "masked", "names")


MASKED = [
    (0, "USER_VAR_1 = input()\nVAR_1 = USER_VAR_1\neval(VAR_1)", 2), (2, "USER_VAR_1 = VAR_1('K')\nif USER_VAR_1:\n    INT_1 = 1\nelse:\n    INT_1 = 2\nprint(INT_1)", 3), (4, "USER_VAR_1 = input()\nUSER_VAR_1 += 1\nprint(USER_VAR_1)", 1),
    (6, "def FUNC_1(ARG_1):\n    return ARG_1\n\ndef FUNC_2():\n    VAR_1.basic_publish(routing_key='q', body='x')\n    VAR_2.send(1)\nVAR_1.basic_consume(queue='q', on_message_callback=FUNC_1)\nVAR_2.connect(FUNC_1)", 5),
    (1, "import shlex\nUSER_VAR_1 = input()\nVAR_1 = VAR_2.quote(USER_VAR_1)\nVAR_3.system(VAR_1)", 4), (3, "VAR_1 = input()\nwhile VAR_1:\n    VAR_1 = VAR_2(VAR_1)\nopen(VAR_1)", 2),
    (5, "class CLASS_1:\n\n    def FUNC_1(self):\n        return VAR_1()\n\nclass CLASS_2:\n\n    def FUNC_1(self):\n        return 1\n\ndef FUNC_2(ARG_1):\n    ARG_1.run()\n    ARG_1.stop()\n    print(ARG_1)\nFUNC_2(2)", 6),
    (7, "import os as o\nfrom subprocess import call as c\nVAR_1 = VAR_2.system\nVAR_1('ls')\nVAR_3('x')\neval('1')\ngetattr(VAR_2, 'x')\nSTR_1 = 'hunter2-hunter2'", 4),
    (8, '"""Doc."""\n\ndef FUNC_1(STR_1: str, ARG_1=1):\n    """Inner."""\n    global seen\n    for VAR_1 in range(ARG_1):\n        if VAR_1:\n            VAR_2 = VAR_1\n    with open(STR_1) as VAR_3:\n        return VAR_4.get(VAR_3)', 7),
    (9, "from flask import Flask\nVAR_1 = VAR_2('x')\n\n@VAR_1.route('/a', methods=['GET', 'POST'])\ndef FUNC_1():\n    return 'a'\n\n@VAR_1.get('/b')\nasync def FUNC_2():\n    await VAR_3()\n    return 1\nLIST_1 = [VAR_4('c/', VAR_5.c)]\nVAR_1.run(debug=True)", 8),
]


def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments blanked (offsets stay) and docstrings dropped."""
    f = corpus(spark, sf_dir)
    return _files(f.withColumn("plain", code_text.strip_comments(F.col("source"))).withColumn("bare", code_text.strip_docstrings(F.col("source"))), "plain", "bare")


#: Template 8 without docstrings; only it has any, and a comment.
_BARE = "def load(path: str, n=1):\n    global seen\n    for i in range(n):\n        if i:\n            seen = i\n    with open(path) as h:\n        return requests.get(h)"

QUERIES = {
    f.__name__: f
    for f in (
        taint_flows_ranked, overall_risk, trace_export, ir_node_kind_counts, ir_edges_by_type, symbol_defs_uses, cfg_block_stats, function_signatures, ssa_versions, ssa_phis, resolved_sinks, dynamic_tags,
        call_graph_edges, synthetic_edges, routes, rule_findings, findings_to_blocks, findings_rollup, privacy_mask, comment_strip,
    )
}
ORACLE_SQL = {
    "taint_flows_ranked": FLOWS_SQL,
    "overall_risk": OVERALL_SQL,
    "trace_export": per_template("template, seq, id, version, kind, previous", TRACE_ROWS),
    "ir_node_kind_counts": per_template("template, kind, n", [(t, k, n) for t, s in enumerate(TEMPLATES) for k, n in sorted(_kinds(s).items())], "template, kind, (n * files)::BIGINT AS nodes"),
    "ir_edges_by_type": per_template("template, type, n", EDGES, "template, type, (n * files)::BIGINT AS edges"),
    "symbol_defs_uses": per_template("template, scope, name, kind, n_defs, n_uses", [(t, "module", n, "import" if n == "shlex" else "var", d, u) for t, n, d, u in SYMBOLS] + SCOPED, "template, 'scope:' || scope AS scope_id, name, kind, n_defs::BIGINT AS n_defs, n_uses::BIGINT AS n_uses, files"),
    "cfg_block_stats": per_template("template, blocks, edges, stmts, calls", BLOCKS),
    "function_signatures": per_template("template, name, inputs, calls, side_effects, complexity", SIGNATURES),
    "ssa_versions": per_template("template, var, versions", SSA),
    "ssa_phis": per_template("template, block_id, result, inputs", PHIS),
    "resolved_sinks": per_template("template, line, resolved, tags", RESOLVED),
    "dynamic_tags": per_template("template, line, kind, tags", DYNAMIC),
    "call_graph_edges": per_template("template, caller, callee, type", [(t, a, b, "speculative" if b in ("A.run", "B.run") else "direct") for t, a, b in CALLS]),
    "synthetic_edges": per_template("template, caller, callee, mechanism", [(6, "emit", "work", "signal")]),
    "routes": per_template("template, framework, path, method, handler", ROUTES),
    "rule_findings": per_template("template, check_id, line, severity, cwe", [(t, c, line, *_RULE[c]) for t, c, line, _ in FINDINGS]),
    "findings_to_blocks": per_template("template, check_id, line, block_id", FINDINGS),
    "findings_rollup": ROLLUP_SQL,
    "privacy_mask": per_template("template, masked, names", MASKED),
    "comment_strip": per_template("template, plain, bare", [(t, s.replace("# a comment", " " * 11), _BARE if t == 8 else ast.unparse(ast.parse(s))) for t, s in enumerate(TEMPLATES)]),
}
