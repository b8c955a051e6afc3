"""Scans: secrets, rule packs over call facts, typosquats, baselines, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

#: check_id, severity, CWE, how it matches, and the pattern of the resolved call or of the assigned name.
#: call: any call; keyword:x: with a keyword of name x; open: with a first argument that isn't a literal; built: with one that is built from parts, there or in an
#: assignment before; assign: a name that is given a string; debug: with a keyword of that name; setup: in install scripts.
RULES = [
    ("python.command-injection", "ERROR", "CWE-78", "call", r"^(os\.system|os\.popen|subprocess\.(call|run|Popen|check_output))$"),
    ("python.code-execution", "ERROR", "CWE-94", "call", r"^(eval|exec|compile)$"),
    ("python.insecure-deserialization", "ERROR", "CWE-502", "call", r"^(pickle\.loads?|yaml\.load|marshal\.loads?)$"),
    ("python.weak-crypto", "WARNING", "CWE-327", "call", r"^hashlib\.(md5|sha1)$"),
    ("python.hardcoded-secret", "WARNING", "CWE-798", "assign", r"(?i)(password|passwd|secret|api_key|token)"),
    ("python.path-traversal", "ERROR", "CWE-22", "open", r"^open$"),
    ("python.debug-enabled", "ERROR", "CWE-489", "debug", r"\.run$"),
    ("python.sql-injection", "ERROR", "CWE-89", "built", r"\.execute(many|script)?$"),
    ("python.ssti", "ERROR", "CWE-1336", "open", r"(^|\.)(render_template_string|Template)$"),
    ("python.supply-chain-code-execution", "ERROR", "CWE-94", "setup", r"^(eval|exec|os\.system|os\.popen|subprocess\.\w+)$"),
    ("python.supply-chain-network-access", "ERROR", "CWE-200", "setup", r"^(requests|urllib|socket|http)\."),
]
#: Names that a typosquat is compared with, one by one.
MOST_POPULAR = 20_000
WEAK_KEYS = ("secret", "changeme", "password", "django-insecure", "default")


def secrets(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row per line and secret type with the matched values; one pass over the lines, patterns as expressions."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line_text"))
    each = F.array(*[F.struct(F.lit(n).alias("type"), F.regexp_extract_all("line_text", F.lit(p), F.lit(1)).alias("matches")) for n, p in T.SECRETS])
    found = F.filter(each, lambda x: F.size(x["matches"]) > 0)
    return lines.select(key, (F.col("i") + 1).alias("line"), F.inline(found))


def high_entropy_tokens(docs: DataFrame, key: str, text: str = "text", least: int = 20, bits: float = 3.5) -> DataFrame:
    """Long tokens of key characters with a high entropy, which no secret pattern matches already."""
    token = F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"([A-Za-z0-9+/_=\-]{{{least},}})"), F.lit(1))).alias("token")
    found = docs.select(key, token).withColumn("entropy", T.entropy(F.col("token")))
    known = F.lit(False)
    for _, p in T.SECRETS[:-2]:
        known = known | F.col("token").rlike(p)
    return found.filter((F.col("entropy") > bits) & ~known & F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]"))


def rule_findings(nodes: DataFrame, rules: list[tuple[str, str, str, str, str]] = RULES) -> DataFrame:
    """Findings of a rule pack (of RULES' form, see ``project.pack_rules``) over syntax nodes, which are gathered by file; where the parse is at hand, ``file_findings`` needs no shuffle."""
    row = F.struct("seq", "id", "kind", "name", "scope_id", "start_line", "start_col", "resolved", "attrs")
    return file_findings(nodes.groupBy("file_path").agg(F.array_sort(F.collect_list(row)).alias("nodes")), rules)


def file_findings(files: DataFrame, rules: list[tuple[str, str, str, str, str]] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of a rule pack over parsed files (file_path and nodes): resolved calls, their first arguments and assignments. Other columns to keep are named.

    All lookups are within a file, in its own array, so nothing is joined, shuffled or broadcast, however many files there are."""
    attr = lambda n, path: F.try_variant_get(F.parse_json(n["attrs"]), path, "string")
    marked = lambda n: F.contains(n["attrs"], F.lit('"unsupported": true'))

    def at(ref: Column) -> Column:
        """The node of an id, which ends with its place; the scan is for ids of other parsers."""
        node = F.get("nodes", F.substring_index(ref, ":", -1).try_cast("int"))
        return F.when(node["id"] == ref, node).when(ref.isNotNull(), F.get(F.filter("nodes", lambda m: m["id"] == ref), F.lit(0)))

    def sites(chosen: Column, ref: str, target: bool) -> Column:
        """The chosen nodes with the node that they refer to and the name that they assign."""
        pairs = F.transform(chosen, lambda n: F.struct(n.alias("n"), attr(n, ref).alias("ref"), (attr(n, "$.targets[0]") if target else F.lit(None).cast("string")).alias("target")))
        pairs = F.transform(pairs, lambda x: F.struct(x["n"].alias("n"), x["target"].alias("target"), at(x["ref"]).alias("v")))
        return F.transform(pairs, lambda x: F.struct(
            x["n"]["kind"].alias("kind"), x["n"]["scope_id"].alias("scope_id"), x["n"]["seq"].alias("seq"), x["n"]["start_line"].alias("line"), x["n"]["start_col"].alias("column"), x["n"]["resolved"].alias("resolved"), x["n"]["attrs"].alias("attrs"), x["target"].alias("target"),
            x["v"]["kind"].alias("_kind"), x["v"]["name"].alias("_name"), x["v"]["scope_id"].alias("_scope"), attr(x["v"], "$.value_type").alias("_type"), ((attr(x["v"], "$.op").isin("Add", "Mod") & (x["v"]["kind"] == "BinOp")) | marked(x["v"])).alias("_built"),
        ))

    called = "|".join(f"(?:{p})" for _, _, _, how, p in rules if how != "assign")
    calls = sites(F.filter("nodes", lambda n: (n["kind"] == "Call") & (n["resolved"].rlike(called) if called else F.lit(False))), "$.args[0]", False)
    assigned = F.filter(sites(F.filter("nodes", lambda n: n["kind"] == "Assign"), "$.value_id", True), lambda x: x["_kind"].isNotNull())
    made = files.select("file_path", *keep, calls.alias("_calls"), assigned.alias("_assigned"))
    built = F.transform(F.filter("_assigned", lambda x: x["_built"]), lambda x: F.struct(x["scope_id"], x["target"], x["seq"]))
    rows = made.select("file_path", *keep, built.alias("_earlier"), F.inline(F.concat("_calls", "_assigned")))
    earlier = F.exists("_earlier", lambda x: (x["scope_id"] == F.col("_scope")) & (x["target"] == F.col("_name")) & (x["seq"] < F.col("seq")))
    installer = F.element_at(F.split("file_path", "/"), -1).isin("install.py", "setup.py")
    when = {
        "call": F.lit(True),
        "open": F.col("_kind").isNotNull() & ((F.col("_kind") != "Literal") | F.coalesce("_built", F.lit(False))),
        "built": F.coalesce("_built", F.lit(False)) | F.coalesce((F.col("_kind") == "Name") & earlier, F.lit(False)),
        "debug": F.contains("attrs", F.lit('"debug"')),
        "setup": installer,
    }
    when |= {how: F.contains("attrs", F.lit(f'"{how.removeprefix("keyword:")}"')) for _, _, _, how, _ in rules if how.startswith("keyword:")}
    hit = lambda c, s, w: F.struct(F.lit(c).alias("check_id"), F.lit(s).alias("severity"), F.lit(w).alias("cwe"))
    none = F.lit(None).cast("struct<check_id:string,severity:string,cwe:string>")
    found = F.array_distinct(F.array_compact(F.array(none, *[F.when(F.col("resolved").rlike(p) & when[how], hit(c, s, w)) for c, s, w, how, p in rules if how != "assign"])))
    names = F.array_distinct(F.array_compact(F.array(none, *[F.when(F.col("target").rlike(p) & (F.col("_type") == "str"), hit(c, s, w)) for c, s, w, how, p in rules if how == "assign"])))
    return rows.select("file_path", *keep, F.inline(F.when(F.col("kind") == "Call", found).otherwise(names)), "line", "column").select("file_path", "check_id", "severity", "cwe", "line", "column", *keep)


def fingerprint(rule: Column, path: Column, line: Column, column: Column, sink: Column, source: Column, code_hash: Column) -> Column:
    """The plain parts joined, so that a finding can be read from it."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (rule, path, line, column, sink, source, code_hash)])


def snippet_hash(lines: Column) -> Column:
    """SHA-256 of the lines without trailing white space."""
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+\z", "")), "\n"), 256)


def against_baseline(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New, existing and resolved: two anti joins and a semi join on the fingerprint."""
    return findings.join(baseline, key, "left_anti"), findings.join(baseline, key, "left_semi"), baseline.join(findings, key, "left_anti")


def typosquats(names: DataFrame, popular: DataFrame, name: str = "name", target: str = "popular") -> DataFrame:
    """Names within two edits of a popular one that they aren't. The popular list (MOST_POPULAR names at most, more are an error) is sent to all tasks; lengths are compared first."""
    if popular.limit(MOST_POPULAR + 1).count() > MOST_POPULAR:
        raise ValueError(f"more than {MOST_POPULAR} popular names")
    far = F.levenshtein(F.lower(name), F.lower(target), 2)
    near = (F.abs(F.length(name) - F.length(target)) <= 2) & far.between(1, 2)
    return names.join(F.broadcast(popular), near).join(F.broadcast(popular.select(F.lower(target).alias("_known"))), F.lower(name) == F.col("_known"), "left_anti").select(name, target, far.alias("distance"))


def config_issues(settings: DataFrame, key: str) -> DataFrame:
    """Issues of debug, secret_key and cors, where env_* beats the settings' own value."""
    pick = lambda c: F.coalesce(F.col(f"env_{c}"), F.col(c))
    secret = pick("secret_key")
    rows = F.array_compact(F.array(
        F.when(F.lower(pick("debug")).isin(*"1 on true yes".split()), F.struct(F.lit("debug_enabled").alias("issue"), F.lit("HIGH").alias("severity"))),
        F.when(secret.isNull() | (secret == ""), F.struct(F.lit("secret_key_missing").alias("issue"), F.lit("HIGH").alias("severity")))
        .when(F.lower(secret).isin(*WEAK_KEYS), F.struct(F.lit("secret_key_weak").alias("issue"), F.lit("HIGH").alias("severity")))
        .when(F.length(secret) < 32, F.struct(F.lit("secret_key_short").alias("issue"), F.lit("MEDIUM").alias("severity"))),
        F.when(pick("cors") == "*", F.struct(F.lit("cors_wildcard").alias("issue"), F.lit("MEDIUM").alias("severity"))),
    ))
    return settings.select(key, F.inline(rows))
