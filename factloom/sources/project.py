"""Sources about a project: dependencies, settings, OpenAPI, profiles, rule packs, git, training corpora."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import knowledge
from factloom.operators.code_text import per_text

#: Lock files beat requirement files, which beat project files.
PRECEDENCE = {"poetry.lock": 0, "pdm.lock": 1, "Pipfile.lock": 2, "requirements.txt": 3, "requirements-dev.txt": 4, "pyproject.toml": 5}
DEPENDENCY = "origin string, name string, version string, specifier string, extras string"


def _from_toml(origin: str, text: str) -> Iterator[dict]:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    at = lambda x, *path: at(x.get(path[0]), *path[1:]) if path and isinstance(x, dict) else None if path else x
    texts = lambda x: [y for y in x if isinstance(y, str)] if isinstance(x, list) else []
    if origin.endswith(".lock"):
        packages = data.get("package", [])
        for p in packages if isinstance(packages, list) else []:
            if isinstance(at(p, "name"), str):
                yield {"name": p["name"], "version": p["version"] if isinstance(p.get("version"), str) else None}
        return
    yield from ({"line": line} for line in texts(at(data, "project", "dependencies")))
    for name, spec in (at(data, "tool", "poetry", "dependencies") or {}).items() if isinstance(at(data, "tool", "poetry", "dependencies"), dict) else ():
        if name.lower() != "python":
            text = spec if isinstance(spec, str) else at(spec, "version") or ""
            yield {"name": name, "specifier": text if isinstance(text, str) else "", "extras": ",".join(texts(at(spec, "extras")))}


def caret(spec: Column) -> Column:
    """``^1.2`` and ``~1.2`` of project files as ranges; others as they are, a bare version as ``==``."""
    n = lambda i: F.coalesce(F.get(F.split(F.regexp_extract(spec, r"(\d+(?:\.\d+)*)", 1), r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    low = F.concat(F.lit(">="), F.regexp_extract(spec, r"(\d[\w.]*)", 1))
    tilde = F.concat(low, F.lit(",<"), n(0).cast("string"), F.lit("."), (n(1) + 1).cast("string"))
    top = F.when(n(0) > 0, (n(0) + 1).cast("string")).when(n(1) > 0, F.concat(F.lit("0."), (n(1) + 1).cast("string"))).otherwise(F.concat(F.lit("0.0."), (n(2) + 1).cast("string")))
    return F.when(spec.startswith("^"), F.concat(low, F.lit(",<"), top)).when(spec.startswith("~") & ~spec.startswith("~="), tilde).when(spec.rlike(r"\A\d"), F.concat(F.lit("=="), spec)).when(spec == "*", "").otherwise(spec)


def dependencies(files: DataFrame) -> DataFrame:
    """project, name, version, specifier, extras, origin of each dependency. files: project, name (of the file), content.

    Of the sources of one dependency the first by PRECEDENCE counts. Files that can't be read give none."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("project", "origin", "line", "name", "version", "specifier", "extras")])
        for b in batches:
            rows = []
            for project, origin, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [{"project": project, "origin": origin} | r for r in _from_toml(origin, text or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    f = files.select("project", F.col("name").alias("origin"), F.col("content").alias("text"))
    toml = f.filter("origin IN ('poetry.lock', 'pdm.lock', 'pyproject.toml')").mapInArrow(kernel, "project string, origin string, line string, name string, version string, specifier string, extras string")
    lines = f.filter("origin IN ('requirements.txt', 'requirements-dev.txt')").select("project", "origin", F.explode(F.split("text", "\n")).alias("line")).unionByName(toml.filter("line IS NOT NULL").select("project", "origin", "line"))
    r = knowledge.requirement(F.col("line"))
    plain = lines.select("project", "origin", r["name"].alias("name"), F.regexp_extract(r["specifier"], r"\A==([\w.]+)\z", 1).alias("version"), r["specifier"].alias("specifier"), r["extras"].alias("extras")).filter("name IS NOT NULL")
    named = toml.filter("line IS NULL").select("project", "origin", F.lower("name").alias("name"), F.coalesce("version", F.lit("")).alias("version"), caret(F.coalesce("specifier", F.lit(""))).alias("specifier"), F.coalesce("extras", F.lit("")).alias("extras"))
    lock = f.filter("origin = 'Pipfile.lock'").select("project", "origin", F.explode(F.from_json(F.get_json_object("text", "$.default"), "map<string,struct<version:string>>")).alias("name", "v"))
    lock = lock.select("project", "origin", F.lower("name").alias("name"), F.regexp_replace(F.coalesce("v.version", F.lit("")), "^==", "").alias("version"), F.coalesce("v.version", F.lit("")).alias("specifier"), F.lit("").alias("extras"))
    order = F.element_at(F.create_map(*[x for k, v in PRECEDENCE.items() for x in (F.lit(k), F.lit(v))]), F.col("origin"))
    return knowledge.prefer(plain.unionByName(named).unionByName(lock), ["project", "name"], order)


def settings(files: DataFrame) -> DataFrame:
    """project, key, value, origin of .env lines, of literal assignments in settings.py, and of ENV and ARG in a Dockerfile.

    Comments and blank lines are skipped."""
    docker = F.col("name") == "Dockerfile"
    files = files.withColumn("content", F.when(docker, F.array_join(F.regexp_extract_all("content", F.lit(r"(?im)^\s*(?:ENV|ARG)\s+([A-Za-z_]\w*[= ].*)$"), F.lit(1)), "\n")).otherwise(F.col("content")))
    files = files.withColumn("content", F.when(docker, F.regexp_replace("content", r"(?m)^(\w+) ", "$1=")).otherwise(F.col("content")))
    lines = files.select("project", F.col("name").alias("origin"), F.explode(F.split("content", "\n")).alias("line")).filter(~F.col("line").rlike(r"^\s*(#|$)") & F.contains("line", F.lit("=")))
    parts = F.split(F.regexp_replace("line", r"^\s*export\s+", ""), "=", 2)
    value = F.regexp_replace(F.trim(parts[1]), r"""^(['"])(.*)\1$""", "$2")
    found = lines.select("project", F.trim(parts[0]).alias("key"), value.alias("value"), "origin")
    literal = F.col("value").rlike(r"""^(True|False|None|-?\d+(\.\d+)?|\[.*\]|\(.*\)|\{.*\}|[^()]*)$""")
    return found.filter(F.col("key").rlike(r"^[A-Za-z_]\w*$") & (F.col("origin").startswith(".env") | (F.col("origin") == "Dockerfile") | literal))


def openapi(specs: DataFrame) -> DataFrame:
    """key, path, method, request and response (JSON schemas of the JSON content) of documents that say what they are.

    specs: key, content (JSON, else YAML). References within a schema are put in place. Documents that can't be read, or
    without ``openapi`` or ``swagger``, give none."""
    v = specs.select("key", F.try_parse_json(resolved_spec(F.col("content"))).alias("v")).filter(F.try_variant_get("v", "$.openapi", "string").isNotNull() | F.try_variant_get("v", "$.swagger", "string").isNotNull())
    paths = v.select("key", F.explode(F.try_variant_get("v", "$.paths", "map<string,variant>")).alias("path", "ops"))
    ops = paths.select("key", "path", F.explode(F.expr("try_variant_get(ops, '$', 'map<string,variant>')")).alias("method", "op")).filter(F.col("method").isin("get", "put", "post", "delete", "options", "head", "patch"))
    schema = lambda at: F.to_json(F.try_variant_get("op", at, "variant"))
    return ops.select("key", "path", F.upper("method").alias("method"), schema("$.requestBody.content['application/json'].schema").alias("request"), schema("$.responses['200'].content['application/json'].schema").alias("response"))


def references(spec: dict, schema: dict, seen: tuple[str, ...] = ()) -> dict:
    """A schema with its ``$ref`` put in place; a cycle stays a reference."""
    if isinstance(schema, list):
        return [references(spec, x, seen) for x in schema]
    if not isinstance(schema, dict):
        return schema
    to = schema.get("$ref")
    if isinstance(to, str) and to.startswith("#/") and to not in seen:
        node = spec
        for part in to[2:].split("/"):
            node = node.get(part, {}) if isinstance(node, dict) else {}
        return references(spec, node, (*seen, to))
    return {k: references(spec, v, seen) for k, v in schema.items()}


def _spec(text: str) -> str | None:
    """A document as JSON, its requests and responses without references."""
    import yaml

    try:
        spec = json.loads(text)
    except (ValueError, RecursionError):
        try:
            spec = yaml.safe_load(text)
        except (yaml.YAMLError, ValueError, RecursionError):
            return None
    if not isinstance(spec, dict) or not isinstance(spec.get("paths"), dict):
        return None
    try:
        for ops in spec["paths"].values():
            for op in ops.values() if isinstance(ops, dict) else ():
                for part in ("requestBody", "responses") if isinstance(op, dict) else ():
                    if part in op:
                        op[part] = references(spec, op[part])
        return json.dumps(spec, default=str)
    except (ValueError, TypeError, RecursionError):
        return None


resolved_spec = per_text(_spec)
PROFILE = "name string, version string, functions array<struct<name:string,label:string,parameters:array<struct<name:string,label:string>>>>"
STANDARD = {
    "os": [("system", "sink"), ("popen", "sink"), ("getenv", "source"), ("remove", "sink"), ("listdir", "none")],
    "subprocess": [("run", "sink"), ("call", "sink"), ("Popen", "sink"), ("check_output", "sink")],
    "pickle": [("load", "sink"), ("loads", "sink")],
    "html": [("escape", "sanitizer")],
    "shlex": [("quote", "sanitizer")],
}


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Library profiles of a folder of JSON files; broken ones are skipped."""
    return spark.read.schema(PROFILE).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder).filter("name IS NOT NULL")


def profile_functions(table: DataFrame) -> DataFrame:
    return table.select("name", "version", F.inline("functions")).toDF("library", "version", "function", "label", "parameters")


def standard_profiles(spark: SparkSession) -> DataFrame:
    """Labels of functions of the standard library; a constant table."""
    return spark.createDataFrame([(lib, f, label) for lib, fs in STANDARD.items() for f, label in fs], "library string, function string, label string")


def vulnerability_types(rules: DataFrame) -> DataFrame:
    """id, title and mitigation for each rule id (check_id) of a pack."""
    title = F.initcap(F.replace(F.element_at(F.split("check_id", r"\."), -1), F.lit("-"), F.lit(" ")))
    return rules.select(F.col("check_id").alias("id"), title.alias("title"), F.lit("Standard Mitigation").alias("mitigation")).distinct()


def changed_files(root: str, base: str = "origin/main") -> list[str]:
    """Names of Python files that differ from a git reference; empty where git can't say."""
    done = subprocess.run(["git", "-C", root, "diff", f"{base}...HEAD", "--name-only"], capture_output=True, text=True, timeout=60)
    return [x for x in done.stdout.splitlines() if x.endswith(".py")] if done.returncode == 0 else []


def head_commit(root: str) -> str | None:
    """The commit that a checkout is at; null where git can't say."""
    done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=60)
    return done.stdout.strip() if done.returncode == 0 else None


def run_scanner(targets: DataFrame, command: list[str], timeout: int = 120) -> DataFrame:
    """Runs an external scanner on each row's target (column target) and gives its output as column content.

    What goes wrong is a document with an error instead: not installed, timed out, failed without output, or no JSON."""

    def one(target: str) -> str:
        try:
            done = subprocess.run([*command, target], capture_output=True, text=True, timeout=timeout)
        except FileNotFoundError:
            return json.dumps({"error": "not installed", "results": []})
        except subprocess.TimeoutExpired:
            return json.dumps({"error": f"no answer within {timeout} s", "results": []})
        if not done.stdout.strip():
            return json.dumps({"error": done.stderr.strip()[-500:] or f"exit code {done.returncode}", "results": []})
        return done.stdout

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(0).to_pylist()], pa.string())], ["target", "content"])

    return targets.select("target").mapInArrow(kernel, "target string, content string")


def read_rules(text: str) -> list[dict]:
    """Rules of a pack in YAML: id, severity, message, CWE; a bounded configuration file, read by the driver."""
    import yaml

    out = []
    for r in (yaml.safe_load(text) or {}).get("rules", []):
        cwe = (r.get("metadata") or {}).get("cwe")
        out.append({"check_id": r.get("id"), "severity": r.get("severity", "INFO"), "message": (r.get("message") or "").strip(), "cwe": cwe[0] if isinstance(cwe, list) and cwe else cwe})
    return out


_CALL = re.compile(r"(\$[A-Z_]+\.)?([A-Za-z_][\w.]*)\((.*)\)")
_BUILT = re.compile(r"""(f["'].*["']|["'].*["']\s*[%+]\s*\$[A-Z_]+|["'].*["']\.format\(.*\))(\s*,.*)?""")


def _patterns(node) -> Iterator[str]:
    """Every pattern of a rule that counts for it; negated ones don't."""
    for item in node if isinstance(node, list) else [node]:
        for k, v in item.items() if isinstance(item, dict) else ():
            if k == "pattern" and isinstance(v, str):
                yield v.strip()
            elif k in ("patterns", "pattern-either"):
                yield from _patterns(v)


def pack_rules(text: str) -> tuple[list[tuple[str, str, str | None, str, str]], list[tuple[str, str]]]:
    """Rules of a YAML pack in the form that ``scan.rule_findings`` runs, and (rule, pattern) of what it can't express.

    Call patterns are understood: ``a.b(...)``, ``$X.b(...)``, a keyword (``..., shell=True``: the name counts), one metavariable
    as the argument (no literal), and an argument that is built from text there or in an assignment before."""
    import yaml

    out, left = [], []
    for r, plain in zip((yaml.safe_load(text) or {}).get("rules", []), read_rules(text)):
        for pattern in _patterns(r):
            lines = [x.strip() for x in pattern.split("\n") if x.strip() not in ("", "...")]
            call = _CALL.fullmatch(lines[-1]) if lines else None
            first = lines[0].split("=", 1) if len(lines) == 2 and re.match(r"\$[A-Z_]+\s*=[^=]", lines[0]) else None
            args = call[3].strip() if call else ""
            keyword = re.fullmatch(r"(?:\.\.\.\s*,\s*)?([A-Za-z_]\w*)\s*=\s*\S+(?:\s*,\s*\.\.\.)?", args)
            if len(lines) == 1 and args in ("", "..."):
                how = "call"
            elif len(lines) == 1 and keyword:
                how = f"keyword:{keyword[1]}"
            elif len(lines) == 1 and _BUILT.fullmatch(args) or first and _BUILT.fullmatch(first[1].strip()) and args.split(",")[0].strip() == first[0].strip():
                how = "built"
            elif len(lines) == 1 and re.fullmatch(r"\$[A-Z_]+(\s*,\s*\.\.\.)?", args):
                how = "open"
            else:
                how = None
            if how is None or call is None:
                left.append((plain["check_id"], pattern))
                continue
            name = re.escape(call[2])
            out.append((plain["check_id"], plain["severity"], plain["cwe"], how, rf"\.{name}$" if call[1] else rf"^{name}$"))
    return out, left


def python_paths(found: DataFrame) -> DataFrame:
    """project and path of each entry of PYTHONPATH in settings (project, key, value), split at colons or semicolons, in order of i."""
    value = F.regexp_replace("value", r"[\[\]'\"]", "")
    parts = F.split(value, F.when(F.contains(value, F.lit(";")), ";").when(F.contains(value, F.lit(",")), ",").otherwise(r":(?!\\)"))
    return found.filter("key = 'PYTHONPATH'").select("project", F.posexplode(F.transform(parts, lambda x: F.trim(x))).alias("i", "path")).filter("path != ''")


def training_corpus(rows: DataFrame, groups: list[tuple[str, str]], text: str = "text", low: int = 100, high: int = 4096) -> DataFrame:
    """Rows of a bounded length with the first group whose pattern fits; others go."""
    kind: Column | None = None
    for name, pattern in groups:
        kind = F.when(F.col(text).rlike(pattern), name) if kind is None else kind.when(F.col(text).rlike(pattern), name)
    return rows.filter(F.length(text).between(low, high)).withColumn("group", kind).filter("group IS NOT NULL")


def scanner_results(output: DataFrame) -> DataFrame:
    """Findings from the JSON output of an external scanner (one document per row, column content); bad documents give an error row."""
    kind = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int,col:int>,extra:struct<message:string,severity:string,metadata:map<string,string>>>>>"
    read = output.select(F.from_json("content", kind).alias("r"), F.try_parse_json("content").isNull().alias("bad"))
    good = read.filter("NOT bad").select(F.explode(F.coalesce("r.results", F.array().cast("array<struct<check_id:string,path:string,start:struct<line:int,col:int>,extra:struct<message:string,severity:string,metadata:map<string,string>>>>"))).alias("x"))
    found = good.select(F.col("x.check_id").alias("check_id"), F.col("x.path").alias("path"), F.col("x.start.line").alias("line"), F.col("x.start.col").alias("column"), F.col("x.extra.message").alias("message"), F.coalesce("x.extra.severity", F.lit("INFO")).alias("severity"), F.col("x.extra.metadata").alias("metadata"), F.lit(None).cast("string").alias("error"))
    empty = F.lit(None)
    return found.unionByName(read.filter("bad").select(*[empty.cast(t).alias(c) for c, t in (("check_id", "string"), ("path", "string"), ("line", "int"), ("column", "int"), ("message", "string"), ("severity", "string"), ("metadata", "map<string,string>"))], F.lit("unreadable output").alias("error")))
