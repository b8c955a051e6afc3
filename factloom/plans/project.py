"""Queries of project sources, reports and extension points, over files rendered from the driver's tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import graphs, registry, report, scan
from factloom.plans.corpus import K, corpus, per_template, template_of
from factloom.plans.code import _RULE, FINDINGS, TRACE_ROWS
from factloom.sources import code, project, store


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REQUIREMENTS = "concat('# pinned', chr(10), 'Flask==2.', s_nationkey, chr(10), 'numpy>=1.', s_suppkey % 7, ',<2  # maths', chr(10), 'requests[socks]', chr(10))"
_PROJECT = "concat('[project]', chr(10), 'dependencies = [\"flask>=1\", \"pandas~=2.0\"]', chr(10), '[tool.poetry.dependencies]', chr(10), 'python = \"^3.9\"', chr(10), 'click = \"^', s_nationkey % 3, '.4\"', chr(10))"
_LOCK = "concat('[[package]]', chr(10), 'name = \"numpy\"', chr(10), 'version = \"1.', s_suppkey % 5, '\"', chr(10))"


def dependency_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement, project and lock files of each supplier as a project; the lock beats the requirements, they beat the project file."""
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("project"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).alias("content")) for n, e in (("requirements.txt", _REQUIREMENTS), ("pyproject.toml", _PROJECT), ("poetry.lock", _LOCK))])))
    return project.dependencies(s).select("project", "name", "version", "specifier", "extras", "origin")


DEPENDENCY_SQL = """WITH s AS (SELECT s_suppkey::VARCHAR AS project, s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT project, 'flask' AS name, '2.' || n AS version, '==2.' || n AS specifier, '' AS extras, 'requirements.txt' AS origin FROM s UNION ALL SELECT project, 'numpy', '1.' || (k % 5), '', '', 'poetry.lock' FROM s UNION ALL SELECT project, 'requests', '', '', 'socks', 'requirements.txt' FROM s
UNION ALL SELECT project, 'pandas', '', '~=2.0', '', 'pyproject.toml' FROM s UNION ALL SELECT project, 'click', '', '>=' || (n % 3) || '.4,<' || CASE WHEN n % 3 = 0 THEN '0.5' ELSE (n % 3 + 1)::VARCHAR END, '', 'pyproject.toml' FROM s"""

def _body(kind: str) -> str:
    """Content of a request or response whose JSON is of a kind."""
    inner = f'"schema": {{"type": "{kind}"}}'
    return f'{{"content": {{"application/json": {{{inner}}}}}}}'


_SPEC = f"""concat('{{"openapi": "3.0", "paths": {{"/', lower(n_name), '/{{id}}": {{"get": {{"responses": {{"200": {_body("string")}}}}}', CASE WHEN n_nationkey % 2 = 0 THEN ', "post": {{"requestBody": {_body("object")}}}' ELSE '' END, ', "parameters": []}}}}}}')"""


def openapi_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of an API document per nation; documents that don't say they are one give none."""
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.expr(f"CASE WHEN n_nationkey % 5 = 4 THEN '{{\"paths\": {{}}}}' ELSE {_SPEC} END").alias("content"))
    return project.openapi(n)


OPENAPI_SQL = """SELECT n_nationkey AS key, '/' || lower(n_name) || '/{id}' AS path, 'GET' AS method, NULL::VARCHAR AS request, '{"type":"string"}' AS response FROM nation WHERE n_nationkey % 5 <> 4
UNION ALL SELECT n_nationkey, '/' || lower(n_name) || '/{id}', 'POST', '{"type":"object"}', NULL FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 2 = 0"""

_YAML = "concat('openapi: 3.0.0', chr(10), 'paths:', chr(10), '  /', lower(r_name), ':', chr(10), '    post:', chr(10), '      requestBody: {content: {application/json: {schema: {$ref: \"#/components/schemas/A\"}}}}', chr(10), 'components: {schemas: {A: {type: array, items: {$ref: \"#/components/schemas/B\"}}, B: {type: string}}}', chr(10))"


def openapi_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of YAML documents whose schemas are references to references; text that is neither JSON nor YAML gives none."""
    r = _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.expr(f"CASE WHEN r_regionkey = 3 THEN '{{[' WHEN r_regionkey = 4 THEN 'date: 2020-99-99' ELSE {_YAML} END").alias("content"))
    return project.openapi(r)


REFERENCES_SQL = """SELECT r_regionkey AS key, '/' || lower(r_name) AS path, 'POST' AS method, '{"items":{"type":"string"},"type":"array"}' AS request, NULL::VARCHAR AS response FROM region WHERE r_regionkey < 3"""


def git_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of git addresses, with and without a name, beside those of a development file."""
    lines = "concat('git+https://h/x', s_suppkey, '.git@v1#egg=Pack', s_suppkey, chr(10), 'git+https://h/anonymous.git', chr(10), 'black==23.', s_nationkey, chr(10))"
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("project"), F.lit("requirements-dev.txt").alias("name"), F.expr(lines).alias("content"))
    return project.dependencies(s).select("project", "name", "version", "specifier", "origin")


GIT_SQL = """SELECT s_suppkey::VARCHAR AS project, 'pack' || s_suppkey AS name, '' AS version, '' AS specifier, 'requirements-dev.txt' AS origin FROM supplier
UNION ALL SELECT s_suppkey::VARCHAR, 'black', '23.' || s_nationkey, '==23.' || s_nationkey, 'requirements-dev.txt' FROM supplier"""

_ENV = "concat('# env', chr(10), 'export DEBUG=true', chr(10), 'KEY=\"', c_mktsegment, '\"', chr(10), chr(10), 'N = ', c_nationkey, chr(10), 'F(x)=1')"


def project_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.lit(".env").alias("name"), F.expr(_ENV).alias("content"))
    return project.settings(c).select("project", "key", "value")


SETTINGS_SQL = "SELECT c_custkey AS project, 'DEBUG' AS key, 'true' AS value FROM customer UNION ALL SELECT c_custkey, 'KEY', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'N', c_nationkey::VARCHAR FROM customer"


def labelled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved calls joined to the library profiles: sources, sinks and sanitizers."""
    nodes = code.table(code.parse(corpus(spark, sf_dir), tables=("nodes",)), "nodes").filter("kind = 'Call'")
    known = project.standard_profiles(spark).select(F.concat_ws(".", "library", "function").alias("resolved"), "label")
    return nodes.join(F.broadcast(known), "resolved").withColumn("template", template_of()).groupBy("template", "resolved", "label").agg(F.count("*").alias("files"))  # a constant table


LABELLED = [(1, "shlex.quote", "sanitizer"), (1, "os.system", "sink"), (7, "os.system", "sink"), (7, "subprocess.call", "sink")]


def vulnerability_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.vulnerability_types(spark.createDataFrame([(r[0],) for r in scan.RULES], "check_id string"))


TYPES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', '{' '.join(w.capitalize() for w in r[0].split('.')[-1].split('-'))}', 'Standard Mitigation')" for r in scan.RULES) + ") v(id, title, mitigation)"


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files added, removed and modified between two snapshots of the documents."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.sha2("text", 256).alias("file_hash"))
    after = d.filter("file_path % 11 != 0").withColumn("file_hash", F.when(F.col("file_path") % 13 == 0, F.lit("x")).otherwise(F.col("file_hash")))
    return store.snapshot_diff(d.filter("file_path % 17 != 0"), after)


SNAPSHOT_SQL = "SELECT doc_id AS file_path, CASE WHEN doc_id % 17 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'modified' END AS change FROM documents WHERE NOT (doc_id % 17 = 0 AND doc_id % 11 = 0) AND (doc_id % 17 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0)"


def snapshots_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest backups of each target stay."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    kept, pruned = store.keep_newest(o, ["o_custkey"], "o_orderkey", 2)
    return kept.groupBy().agg(F.count("*").alias("n")).withColumn("what", F.lit("kept")).unionByName(pruned.groupBy().agg(F.count("*").alias("n")).withColumn("what", F.lit("pruned")))


KEPT_SQL = "SELECT sum(least(n, 2))::BIGINT AS n, 'kept' AS what FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) UNION ALL SELECT sum(greatest(n - 2, 0))::BIGINT, 'pruned' FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)"


def training_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a bounded length by the first group that they fit."""
    groups = [("licence", r"(?i)licen[cs]e"), ("table", r"\|"), ("plain", r"[a-z]")]
    return project.training_corpus(_read(spark, sf_dir, "documents").select("doc_id", "text"), groups).select("doc_id", "group")


TRAINING_SQL = r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licence' WHEN regexp_matches(text, '\|') THEN 'table' ELSE 'plain' END AS "group" FROM documents WHERE length(text) BETWEEN 100 AND 4096 AND (regexp_matches(text, '(?i)licen[cs]e') OR regexp_matches(text, '\||[a-z]'))"""


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARIF results of the corpus' findings with the last insight on each check."""
    found = scan.file_findings(code.parse(corpus(spark, sf_dir), tables=("nodes",))).persist(StorageLevel.DISK_ONLY)  # read twice
    insights = found.filter("check_id LIKE '%execution'").select("file_path", "check_id", F.inline(F.array(F.struct(F.lit(1).alias("seq"), F.lit("True Positive").alias("verdict"), F.lit("a").alias("text")), F.struct(F.lit(2).alias("seq"), F.lit("False Positive").alias("verdict"), F.lit("b").alias("text")))))
    rows = report.sarif_rows(report.with_insights(found, insights)).withColumn("template", template_of())
    return rows.groupBy("template", F.get_json_object("result", "$.ruleId").alias("rule"), F.get_json_object("result", "$.level").alias("level"), F.get_json_object("result", "$.locations[0].physicalLocation.region.startLine").cast("int").alias("line")).agg(F.count("*").alias("files"))


REPORT = [(t, c, "note" if c.endswith("execution") else {"ERROR": "error"}.get(_RULE[c][0], "warning"), line) for t, c, line, _ in FINDINGS]


def graph_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of flows as graph documents: nodes and edges of each."""
    g = report.graph_rows(graphs.trace(code.table(code.parse(corpus(spark, sf_dir), tables=("flows",)), "flows"))).withColumn("template", template_of())
    n = lambda at: F.size(F.from_json(F.get_json_object("graph", at), "array<string>"))
    return g.groupBy("template", "seq", n("$.nodes").alias("nodes"), n("$.edges").alias("edges")).agg(F.count("*").alias("files"))


GRAPHS = sorted({(t, seq, 2, 1) for t, seq, *_ in TRACE_ROWS})


def staged_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages on events: a gate stops long files, later stages skip them, and all rows come out."""
    p = registry.Pipeline()
    p.on("pre_analysis", lambda d: registry.gate(d.drop("stopped"), 8))
    p.on("static_scan", lambda d: d.withColumn("seen", F.lit(1)))
    p.on("post_analysis", lambda d: d.withColumn("seen", F.col("seen") + 1))
    return p.run(corpus(spark, sf_dir)).groupBy("template", "stopped", "seen").agg(F.count("*").alias("files"))


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered by a cache, then by two providers of which the first fails on some; the rest stay open."""
    c = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "role").withColumn("prompt", F.col("role"))
    cache = c.filter("key % 5 = 0").select("key", F.lit("cached").alias("response"))
    fail = lambda n: lambda d: d.select("key", F.when(F.col("key") % 7 >= n, F.lit(f"answer{n}")).alias("response"))
    return registry.answered(c.select("key", "prompt"), cache, [fail(3), fail(1)]).select("key", "response", "provider")


CALLS_SQL = """WITH c AS (SELECT conv_id * 1000 + turn AS key FROM conversations) SELECT key, CASE WHEN key % 5 = 0 THEN 'cached' WHEN key % 7 >= 3 THEN 'answer3' WHEN key % 7 >= 1 THEN 'answer1' END AS response,
CASE WHEN key % 5 = 0 THEN 'cache' WHEN key % 7 >= 3 THEN 'provider0' WHEN key % 7 >= 1 THEN 'provider1' END AS provider FROM c"""


def stubs_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type stubs, cache keys and sanitizer kinds by brand."""
    p = _read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    kinds = registry.Sanitizers()
    return p.select("p_brand", F.sha2(registry.stub(F.col("p_brand"), F.array(F.lit("run"), F.lit("Run"), F.lit("run"))), 256).alias("stub"), registry.cache_key(model=F.col("p_brand"), prompt=F.lit('a"b')).alias("cache_key"), kinds.kind(F.when(F.col("n") % 2 == 0, "shlex.quote").otherwise("x")).alias("kind"))


STUB_SQL = """SELECT p_brand, sha256('# ' || p_brand || chr(10) || 'class Run: ...' || chr(10) || 'def run(*args, **kwargs): ...') AS stub, sha256('{"model": "' || p_brand || '", "prompt": "a\\"b"}') AS cache_key, CASE WHEN count(*) % 2 = 0 THEN 'SHELL' END AS kind FROM part GROUP BY p_brand"""

_LONG = (5, 8, 7, 9)  # templates of more than eight lines, the last part of a split counted
PACK = """
rules:
- {id: pack.os, severity: ERROR, message: m, metadata: {cwe: [CWE-78]}, pattern-either: [{pattern: os.system(...)}, {pattern: "subprocess.call(..., shell=True)"}]}
- {id: pack.eval, severity: WARNING, message: m, metadata: {cwe: CWE-94}, patterns: [{pattern: eval(...)}, {pattern-not: eval("1")}]}
- {id: pack.open, severity: ERROR, message: m, pattern: open($X)}
- {id: pack.debug, severity: INFO, message: m, pattern: "$APP.run(..., debug=True)"}
- {id: pack.class, severity: INFO, message: m, pattern: "class $C: ..."}
"""


def pack_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a YAML rule pack over the corpus; a pattern that isn't of a call is left out and named by ``pack_rules``."""
    f = scan.file_findings(code.parse(corpus(spark, sf_dir), tables=("nodes",)), project.pack_rules(PACK)[0])
    return f.withColumn("template", template_of()).groupBy("template", "check_id", "severity", "cwe", "line").agg(F.count("*").alias("files"))


PACKED = [(0, "pack.eval", "WARNING", "CWE-94", 3), (1, "pack.os", "ERROR", "CWE-78", 4), (3, "pack.open", "ERROR", None, 4), (7, "pack.os", "ERROR", "CWE-78", 4), (7, "pack.eval", "WARNING", "CWE-94", 6), (8, "pack.open", "ERROR", None, 8), (9, "pack.debug", "INFO", None, 11)]
QUERIES = {f.__name__: f for f in (openapi_references, git_requirements, pack_findings, dependency_resolution, openapi_operations, project_settings, labelled_calls, vulnerability_types, snapshot_changes, snapshots_kept, training_corpus, report_rows, graph_reports, staged_pipeline, model_calls, stubs_and_keys)}
ORACLE_SQL = {
    "openapi_references": REFERENCES_SQL, "git_requirements": GIT_SQL, "pack_findings": per_template("template, check_id, severity, cwe, line", PACKED),
    "dependency_resolution": DEPENDENCY_SQL, "openapi_operations": OPENAPI_SQL, "project_settings": SETTINGS_SQL, "labelled_calls": per_template("template, resolved, label", LABELLED), "vulnerability_types": TYPES_SQL, "snapshot_changes": SNAPSHOT_SQL, "snapshots_kept": KEPT_SQL,
    "training_corpus": TRAINING_SQL, "report_rows": per_template("template, rule, level, line", REPORT), "graph_reports": per_template("template, seq, nodes, edges", GRAPHS),
    "staged_pipeline": per_template("template, stopped, seen", [(t, t in _LONG, None if t in _LONG else 2) for t in range(K)]), "model_calls": CALLS_SQL, "stubs_and_keys": STUB_SQL,
}
