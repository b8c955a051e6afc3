"""What keeps the queries' memory and time in proportion to their tables."""

import pytest

from factloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["report_rows", "findings_rollup", "findings_to_blocks", "pack_findings", "rule_findings"])
def test_facts_are_never_broadcast(spark, name):
    """Spark takes the tables of a parse for as small as the keys of the files, so that it would send all nodes to the driver."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "NestedLoop" not in plan


def test_copies_are_parsed_once(monkeypatch):
    """Copies of a text cost one parse, and have their own path in every id."""
    import pyarrow as pa

    from factloom.operators import pyfacts
    from factloom.sources import code

    seen, real = [], pyfacts.facts
    monkeypatch.setattr(pyfacts, "facts", lambda path, *a, **k: seen.append(path) or real(path, *a, **k))
    row = pa.struct([("id", pa.string()), ("parent_id", pa.string()), ("kind", pa.string()), ("tags", pa.list_(pa.string())), ("attrs", pa.string())])
    schema = pa.schema([("file_path", pa.string()), ("error", pa.string()), ("nodes", pa.list_(row))])
    text, paths = "a = b\neval(a)\n", ["a.py", 'q"u\\o.py', "é/b.py", None]
    got = code._parsed([*paths, "c.py", "d.py"], [text] * 4 + ["def (", None], False, ("nodes",), schema).to_pylist()
    assert len(seen) == 3
    for g, (path, source) in zip(got, [*((p, text) for p in paths), ("c.py", "def ("), ("d.py", None)]):
        want = real(path or "", source, tables=("nodes",))
        assert g == want | {"nodes": [{k: n[k] for k in ("id", "parent_id", "kind", "tags", "attrs")} for n in want["nodes"]]}


def test_files_of_a_batch_are_bounded():
    from factloom.sources import code

    big = "x" * (code.MOST_CHARS + 1)
    cut = [len(p) for p, _ in code._slices(list(range(3003)), [big, "", None, *["y"] * 2999, big])]
    assert sum(cut) == 3003 and max(cut) <= code.MOST_FILES and cut[0] == 1 and cut[-1] == 1


def test_json_is_the_whole_text(spark):
    """A value with something behind it isn't JSON (the number at the head of a prose text), keys may repeat, and long strings don't overflow."""
    from factloom.functions import text as T

    good = ["1", " [1, \"a\"]\n", '{"a": 1, "a": {"b": []}}', '"a\\n\\u00e9"', "null", "-0.5e3", '["x", "."]', '"' + "a\\n" * 100_000 + '"']
    bad = ["8294846167456848 Inly onhe.", "1 2", '[1]]', '{"a":1} x', "1],[2", '1,"."', '1],["."', "{'a':1}", '"a\tb"', '"a\tb":"c"', '"a\\x"', "01", "", " ", "the", "tru", '"', None]
    df = spark.createDataFrame(list(enumerate(good + bad)), "i int, t string")
    assert [r["ok"] for r in df.select("i", T.is_json(df["t"]).alias("ok")).orderBy("i").collect()] == [True] * len(good) + [False] * len(bad)


def test_yaml_loaders_agree(monkeypatch):
    """Plain prose goes to the fast loader; random texts have the same kind as by the loader in Python."""
    import random

    import yaml

    from factloom.operators import code_text

    assert code_text._yaml_loader("Some prose: and more.\n- a list\n") is yaml.CSafeLoader
    assert {code_text._yaml_loader(t) for t in ("a:\tb", "%YAML 1.1", "[a ? b]", "[" * 5000, "- " * 5000, "a\x85b", "a\0")} == {yaml.SafeLoader}
    rng, bits = random.Random(7), ["a", ": ", "- ", "\n", " ", "  ", "{", "}", "[", "]", ",", "'", '"', "#", "&a ", "*a", "!t ", "|\n", "? ", "%", "\t", "é", "\0", "\r", "---", "2020-99-99", "1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    fast = [code_text._yaml_kind(t) for t in texts]
    monkeypatch.setattr(code_text, "_yaml_loader", lambda text: yaml.SafeLoader)
    assert fast == [code_text._yaml_kind(t) for t in texts]


def test_chains_take_one_shuffle(spark):
    """As many shuffles however long the chains are; gaps, closed places, repeats, nulls and places before the first as reach has them."""
    from factloom.operators import graphs

    rows = [(1, n, True) for n in range(1, 301)] + [(2, 1, True), (2, 2, False), (2, 3, True), (3, 2, True), (4, 1, True), (4, 3, True), (5, 1, False), (5, 1, True), (5, 2, None), (5, 3, True), (6, 0, True), (6, 1, True), (6, 2, True), (None, 1, True), (None, 2, True)]
    got = graphs.chains(spark.createDataFrame(rows, "k long, at int, open boolean"), "k", "at", "open")
    want = [(1, n, n - 1) for n in range(1, 301)] + [(2, 1, 0), (2, 2, 1), (4, 1, 0), (5, 1, 0), (5, 2, 1), (6, 1, 0), (6, 2, 1), (None, 1, 0)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = catalogue.QUERIES["dataflow_reach"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan
