"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

The membership pattern of a document is the set of sources that hold it. Words flow from patterns to the quotas of sources;
the k-th repetition of a pattern's words costs more than the one before, and a flow of least cost decides how often each
pattern is repeated and whom it serves. Costs lie on the arcs out of the flow's source only, so a flow of least cost is a
largest flow level by level: first all first uses, then what second uses add, and so on.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import durable, part, small

#: Rows of one seeded bucket, about: the longest run that one task sums.
BUCKET_ROWS = 100_000
#: Patterns that the driver can route; more are an error, never dropped.
MAX_PATTERNS = 200_000
#: Columns that ``mix_sources`` adds.
ADDED = ("_size", "_pattern", "_sources", "_taken", "_copies", "_by")


def fill(total: float, sizes: Sequence[int], weights: Sequence[float], repeats: int = 3) -> list[float]:
    """Targets that share total by weight, none above repeats times its size; what is cut is shared again by weight."""
    target, live, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while live:
        share = left / sum(weights[i] for i in live)
        over = [i for i in live if weights[i] * share > repeats * sizes[i]]
        for i in over or live:
            target[i] = float(repeats * sizes[i]) if over else weights[i] * share
        if not over:
            break
        left -= sum(target[i] for i in over)
        live = [i for i in live if i not in set(over)]
    return target


class Flow:
    """A largest flow in a network of integer arcs, by levels of breadth-first search; capacity may be added and the flow carried on."""

    def __init__(self, nodes: int):
        self.head: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def arc(self, u: int, v: int, capacity: int) -> int:
        for a, b, c in ((u, v, capacity), (v, u, 0)):
            self.head[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.cap[arc + 1]

    def run(self, s: int, t: int) -> int:
        """Adds what still can flow, and says how much."""
        head, to, cap, total = self.head, self.to, self.cap, 0
        while True:
            level = [-1] * len(head)
            level[s], queue = 0, deque([s])
            while queue:
                u = queue.popleft()
                for e in head[u]:
                    if cap[e] > 0 and level[to[e]] < 0:
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if level[t] < 0:
                return total
            at, path, u = [0] * len(head), [], s
            while True:
                if u == t:
                    push = min(cap[e] for e in path)
                    total += push
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    cut = next(i for i, e in enumerate(path) if not cap[e])
                    u = to[path[cut] ^ 1]
                    del path[cut:]
                elif at[u] < len(head[u]):
                    e = head[u][at[u]]
                    if cap[e] > 0 and level[to[e]] == level[u] + 1:
                        path.append(e)
                        u = to[e]
                    else:
                        at[u] += 1
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def route(capacity: dict[tuple, int], members: dict[tuple, list], quota: dict, repeats: int = 3) -> dict[tuple, list[tuple[object, int]]]:
    """For each cell, the words that go to each of its sources. A cell is (pattern, anything): a part of a pattern's words.

    No cell gives more than repeats times its words; the k-th repetition of a pattern, all its cells together, costs k(k-1)/2
    a word, and the flow is a largest one of least cost."""
    cells, sources = sorted(capacity, key=str), list(quota)
    patterns = list(dict.fromkeys(c[0] for c in cells))
    net = Flow(2 + len(patterns) + len(cells) + len(sources))
    of_pattern = {p: 2 + i for i, p in enumerate(patterns)}
    of_source = {x: 2 + len(patterns) + len(cells) + i for i, x in enumerate(sources)}
    words: dict = {}
    for c in cells:
        words[c[0]] = words.get(c[0], 0) + capacity[c]
    starts = {p: net.arc(0, of_pattern[p], 0) for p in patterns}
    out = {}
    for i, c in enumerate(cells):
        node = 2 + len(patterns) + i
        net.arc(of_pattern[c[0]], node, repeats * capacity[c])
        out[c] = [(x, net.arc(node, of_source[x], repeats * capacity[c])) for x in members[c]]
    for x in sources:
        net.arc(of_source[x], 1, quota[x])
    for _ in range(repeats):
        for p in patterns:
            net.cap[starts[p]] += words[p]
        net.run(0, 1)
    return {c: [(x, net.used(e)) for x, e in arcs] for c, arcs in out.items()}


def with_members(docs: DataFrame, text: str = "text", source: str = "source", name: str = "members") -> DataFrame:
    """All rows and columns of docs with the sources that hold an equal text, as a sorted array (null last, as ``source_order``).

    A null text is equal to none. Texts are compared by 128 bits. Only texts of several sources are joined, and a set has at
    most as many elements as there are sources; a hot text is reduced before it is shuffled. Replaces a column of that name."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != name]).alias("row"), F.md5(f"`{text}`").alias("digest"), F.struct(F.col(f"`{source}`").isNull().alias("null"), F.col(f"`{source}`").alias("x")).alias("of"))
    several = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.collect_set("of").alias("all")).filter("size(all) > 1")
    several = durable(several.select("digest", F.transform(F.array_sort("all"), lambda s: s["x"]).alias("all")))
    # null texts meet nothing; their hash spreads them
    rows = rows.withColumn("digest", F.coalesce("digest", F.xxhash64("row").cast("string")))
    return rows.join(small(several), "digest", "left").select("row.*", F.coalesce("all", F.array("of.x")).alias(name))


def source_order(x: str | None) -> tuple[bool, str]:
    """By code point, null last."""
    return (x is None, x or "")


def mix_sources(docs: DataFrame, members: Column, size: Column, order: list[Column], weights: Sequence[float] = (5, 2, 1), repeats: int = 3, seed: int = 17, home: Column | None = None) -> DataFrame:
    """All rows of docs with _size, _pattern (JSON), _sources (size and target of each), _taken (words of the mix), _copies (whole documents) and _by (struct array of source and words).

    ``members``: array of the sources that hold the document (null elements are a source of their own; null or empty: the
    null source). Sources, in order, have the weights in turn and share the sum of all sizes; see ``fill``. With ``home``, a
    document's words count for that one of its sources only; its pattern still bears the cost of repeating it. A document
    never gives more than ``repeats`` times its size; null sizes are 0. Documents of a pattern and home stand in a seeded
    order on a line that is as long as their sizes, laid ``repeats`` times; the flow is the line's beginning, so one document
    at most gives part of its words. ``_copies`` rounds that document to the nearer whole number. ``order`` breaks ties; rows
    equal in it are interchangeable and may repeat. Other columns pass through; those of added names are replaced. An empty
    table gives none. A hot pattern is summed in seeded buckets, and rows equal in ``order`` that exceed one are summed by the
    partition they are read in, so docs should be a stored table."""
    spark = docs.sparkSession
    keys = [f"_o{i}" for i in range(len(order))]
    m = F.coalesce(members, F.array().cast("array<string>"))
    m = F.array_sort(F.array_distinct(F.when(F.size(m) == 0, F.array(F.lit(None).cast("string"))).otherwise(m)))
    own = F.lit("") if home is None else F.to_json(F.array(home))
    kept = [c for c in docs.columns if c not in ADDED]
    df = docs.select(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("_row"), F.to_json(m).alias("_pattern"), own.alias("_home"), F.coalesce(size.cast("long"), F.lit(0)).alias("_size"), *[o.alias(k) for k, o in zip(keys, order)])
    cell = ["_pattern", "_home"]
    df = df.withColumn("_key", F.xxhash64(F.lit(seed), *keys))
    hot = durable(df.groupBy(*cell, "_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > BUCKET_ROWS).select(*cell, "_key", F.lit(True).alias("_hot")))
    df = df.withColumn("_bucket", part(max(1, -(-docs.count() // BUCKET_ROWS)), [F.lit(seed + 1), F.col("_key")]))
    salt = F.lit(0)
    if not hot.isEmpty():
        df, salt = df.join(small(hot), [*cell, "_key"], "left"), F.when(F.col("_hot"), F.spark_partition_id()).otherwise(0)
    df = df.withColumn("_salt", salt)
    # the only pass over the sizes before the last one: those of cells are sums of these
    before = durable(df.groupBy(*cell, "_bucket", "_salt").agg(F.sum("_size").alias("_sum")))
    sums = before.groupBy(*cell).agg(F.sum("_sum").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sets = {(r["_pattern"], r["_home"]): json.loads(r["_home"] or r["_pattern"]) for r in sums}
    capacity = {(r["_pattern"], r["_home"]): int(r["size"]) for r in sums}
    sources = sorted({x for xs in sets.values() for x in xs}, key=source_order)
    held = {x: 0 for x in sources}
    for p, xs in sets.items():
        for x in xs:
            held[x] += capacity[p]
    target = dict(zip(sources, fill(sum(capacity.values()), [held[x] for x in sources], [weights[i % len(weights)] for i in range(len(sources))], repeats)))
    flows = route(capacity, sets, {x: round(target[x]) for x in sources}, repeats)

    before = before.select(*cell, "_bucket", "_salt", (F.sum("_sum").over(Window.partitionBy(*cell).orderBy("_bucket", "_salt")) - F.col("_sum")).alias("_before"))
    line = spark.createDataFrame(
        [(*p, capacity[p], sum(f for _, f in flows[p]), [{"source": x, "words": f} for x, f in flows[p]], [{"source": x, "size": held[x], "target": target[x]} for x in sets[p]]) for p in capacity],
        "_pattern string, _home string, _all long, _flow long, _shares array<struct<source:string,words:long>>, _sources array<struct<source:string,size:long,target:double>>",
    )
    inner = Window.partitionBy(*cell, "_bucket", "_salt").orderBy("_key", *keys).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    df = df.join(small(durable(before)), [*cell, "_bucket", "_salt"]).join(small(line, 20_000), cell)
    start = F.col("_before") + F.col("_in")
    laid = [F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_flow") - start - k * F.col("_all"))) for k in range(repeats)]
    taken, copies = laid[0], F.when(2 * laid[0] >= F.col("_size"), 1).otherwise(0)
    for x in laid[1:]:
        taken, copies = taken + x, copies + F.when(2 * x >= F.col("_size"), 1).otherwise(0)
    # a share [lo, hi) of the pattern's line meets each of the document's places on it
    share = lambda lo, hi: sum((F.greatest(F.lit(0), F.least(start + k * F.col("_all") + F.col("_size"), hi) - F.greatest(start + k * F.col("_all"), lo)) for k in range(repeats)), F.lit(0))
    ends = F.transform("_shares", lambda x, i: F.struct(x["source"].alias("source"), F.aggregate(F.slice("_shares", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b["words"]).alias("lo"), x["words"].alias("n")))
    by = F.filter(F.transform(ends, lambda x: F.struct(x["source"].alias("source"), share(x["lo"], x["lo"] + x["n"]).alias("words"))), lambda x: x["words"] > 0)
    made = [taken.cast("long").alias("_taken"), F.when(F.col("_size") > 0, copies).otherwise(0).cast("int").alias("_copies"), by.alias("_by")]
    df = df.select("_row", "_size", "_pattern", "_sources", *made)
    return df.select(*[F.col("_row").getField(c).alias(c) for c in kept], *ADDED)
