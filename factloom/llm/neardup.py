"""MinHash near-duplicates with Odd sketches, confirmed on full shingle sets.

One pass over the texts makes, per document: the size and a 128-bit digest of its shingle set, the keys of the bands of its
MinHash, and an Odd sketch (the MinHash samples folded into a parity bitmap). Documents of one set are one class; its least
id stands for it. Then, over classes only:

1. every band bucket has a centre (its least id); each class is paired with the nearest centre of its buckets by the XOR
   population count of the sketches, and the pair is confirmed on both sets. That is one pair per class, however large a bucket.
2. components of the confirmed links; buckets that then lie in one component are done. In the others only pairs across
   components are left. Buckets of at most ``BUCKET`` classes compare them by their sketches. Classes of larger ones (of a
   boilerplate that isn't enough for a link, say) are compared only where they share one of their rarest shingles: of two sets
   that similar, the first size - ceil(percent of size) + 1 shingles in one common order must meet, and the order is by rarity.
   Pairs that remain are confirmed on their sets.

A pair inside a component can't change the result, so nothing but a miss of all bands or a sketch far off loses a link: at
a similarity of 0.8, 32 bands of 4 miss 5 pairs of 10^8, and more than 56 of 128 samples differ once in 10^10.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import U64, durable, hash_texts, mix, roll, slices, small, utf8
from factloom.llm.components import connected_components

SAMPLES, BANDS, SKETCH_BITS, MOST_DIFFERENT = 128, 32, 512, 56
#: What the bands and the sketches are made for: the least similarity in per cent.
LEAST_PERCENT = 80
#: Classes of a bucket that are compared with each other; members of larger buckets are compared by rare shingles.
BUCKET = 64
_WORDS = SKETCH_BITS // 64
#: A pair whose sketches differ in more bits is not confirmed: two bits for each of so many differing samples.
MOST_BITS = 2 * MOST_DIFFERENT
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SAMPLES, np.uint32)
_SALT = _RNG.integers(0, 1 << 63, SAMPLES, np.int64).astype(U64)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; a text of fewer words is one shingle."""
    flat, ends = hash_texts([(t or b"").lower() for t in texts])
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        n = b - a
        out.append(np.unique(roll(flat[a:b], int(min(n, k)))) if n else np.empty(0, U64))
    return out


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SAMPLES least hash values per set; sets must not be empty."""
    out = np.empty((len(sets), SAMPLES), np.uint32)
    for i, s in enumerate(sets):
        x = (s >> U64(32)).astype(np.uint32)
        best = None
        for at in range(0, len(x), 1024):
            low = (x[at : at + 1024, None] * _A + _B).min(axis=0)
            best = low if best is None else np.minimum(best, low)
        out[i] = best
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = SAMPLES // BANDS
    key = np.zeros((len(m), BANDS), U64) + np.arange(1, BANDS + 1, dtype=U64)
    for r in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + m[:, r::rows])
    return key.view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as signed longs."""
    bit = (mix(m.astype(U64) ^ _SALT) % U64(SKETCH_BITS)).astype(np.int64)
    at = (bit + np.arange(len(m))[:, None] * SKETCH_BITS).ravel()
    parity = (np.bincount(at, minlength=len(m) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(m), _WORDS, 64), axis=2, bitorder="little").view(np.int64).reshape(len(m), _WORDS)


def estimate(bits: float) -> float:
    """Similarity from the XOR population count of two sketches."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(max(1e-9, 1 - 2 * bits / SKETCH_BITS))


_MADE = "doc_id long, tag long, n_shingles long, d0 long, d1 long, bands array<long>, sketch array<long>"


def _sketches(k: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(utf8(b.column(2)), k)
            some = [i for i, s in enumerate(sets) if len(s)]
            digest = np.zeros((len(sets), 2), np.int64)
            keys: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if some:
                m = minhash([sets[i] for i in some])
                for i, key, sk in zip(some, band_keys(m), odd_sketch(m)):
                    keys[i], sketch[i] = key, sk
                    s = mix(sets[i])
                    digest[i] = np.array([s.sum(dtype=U64), np.bitwise_xor.reduce(mix(s + U64(len(s))))], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], [c.split()[0] for c in _MADE.split(", ")])

    return kernel


def _set_rows(k: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(utf8(b.column(1)), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "members"])

    return kernel


def _far(a: str, b: str):
    """XOR population count of two sketches."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(_WORDS)), F.lit(0))


def _sets(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """node and members (the shingles) of the nodes in ids; ``texts`` has node and text."""
    # the ids, not the texts, are sent; many ids shuffle
    involved = texts.join(small(ids), "node", "left_semi").select("node", "text")
    return durable(involved.mapInArrow(_set_rows(k), f"node {dict(texts.dtypes)['node']}, members array<long>").dropDuplicates(["node"]))


def _confirmed(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union; sets are made for the ids of pairs only."""
    ids = durable(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct())
    sets = _sets(texts, ids, k)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("mu")), "u").join(sets.select(F.col("node").alias("v"), F.col("members").alias("mv")), "v")
    common = F.size(F.array_intersect("mu", "mv"))
    return durable(both.filter(100 * common >= percent * (F.size("mu") + F.size("mv") - common)).select("u", "v"))


def _across(u: DataFrame, v: DataFrame, key: str) -> DataFrame:
    """Pairs of one key and two components whose sketches are near enough."""
    u, v = u.alias("u"), v.alias("v")
    on = (F.col(f"u.{key}") == F.col(f"v.{key}")) & (F.col("u.node") < F.col("v.node")) & (F.col("u.component") != F.col("v.component")) & (_far("u.sketch", "v.sketch") <= MOST_BITS)
    return u.join(v, on).select(F.col("u.node").alias("u"), F.col("v.node").alias("v"))


def _rare(texts: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, component, sketch and rare (a shingle): the shingles of each set of which a similar one must share one at least."""
    each = _sets(texts, durable(nodes.select("node")), k).select("node", F.size("members").alias("n"), F.explode("members").alias("rare"))
    seen = each.groupBy("rare").agg(F.count("*").alias("f"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("f", "rare"))), F.lit(1), F.first("n") - F.ceil(F.first("n") * percent / 100).cast("int") + 1)
    kept = each.join(seen, "rare").groupBy("node").agg(first.alias("first")).select("node", F.inline("first")).filter("f > 1").select("node", "rare")
    return durable(kept.join(nodes, "node"))


def _components(docs: DataFrame, k: int, percent: int, bucket: int) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, node, class_node and component_node of every row; the last two are null where nothing can link.

    A node is the id, or the id with the tag where some id has several texts."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"bands and sketches find links of {LEAST_PERCENT} per cent and more")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    made = durable(texts.mapInArrow(_sketches(k), _MADE))
    live = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    plain = live.groupBy("doc_id").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).filter("a < b").isEmpty()
    node = F.col("doc_id") if plain else F.struct("doc_id", "tag")
    texts = texts.filter("doc_id IS NOT NULL").select(node.alias("node"), "text")
    live, set_ = live.withColumn("node", node), ["n_shingles", "d0", "d1"]
    classes = live.groupBy(*set_).agg(F.min("node").alias("class_node"))
    heads = durable(live.join(classes, set_).filter("node = class_node").dropDuplicates(["node"]).select("node", "bands", "sketch"))

    each = heads.select("node", F.explode("bands").alias("band"))
    centres = each.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last").select("band", "centre")
    buckets = durable(each.join(centres, "band"))
    sketch = heads.select("node", "sketch")
    near = buckets.filter("node != centre").select("node", "centre").distinct()
    near = near.join(sketch, "node").join(sketch.select(F.col("node").alias("centre"), F.col("sketch").alias("other")), "centre")
    near = near.select("node", F.struct(_far("sketch", "other").alias("bits"), "centre").alias("to")).filter(f"to.bits <= {MOST_BITS}")
    stars = durable(near.groupBy("node").agg(F.min("to").alias("to")).select(F.col("node").alias("u"), F.col("to.centre").alias("v")))
    links = _confirmed(texts, stars, k, percent)
    first = connected_components(links)

    held = buckets.select("band", "node").join(first, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    split = held.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).filter("a < b").select("band", "n")
    open_ = durable(held.join(split, "band").join(sketch, "node"))
    few = open_.filter(F.col("n") <= bucket)
    pairs = _across(few, few, "band")
    large = durable(open_.filter(F.col("n") > bucket).select("node", "component", "sketch").dropDuplicates(["node"]))
    if not large.isEmpty():
        rare = _rare(texts, large, k, percent)
        pairs = pairs.unionByName(_across(rare, rare, "rare"))
    done = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    more = _confirmed(texts, durable(pairs.distinct().join(done, ["u", "v"], "left_anti")), k, percent)
    final = connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    out = made.withColumn("node", F.when(F.col("doc_id").isNotNull(), node)).join(classes, set_, "left").withColumn("class_node", F.when(F.col("doc_id").isNotNull(), F.col("class_node")))
    out = out.join(final.select(F.col("node").alias("class_node"), "component"), "class_node", "left")
    return out.select("doc_id", "tag", "n_shingles", "node", "class_node", F.coalesce("component", "class_node").alias("component_node"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, class_id (least id of its shingle set) and component_id of every row of docs (doc_id long, text).

    Words are lower-cased (A to Z) and split at white space. Two documents are linked if 100 * |A and B| >= percent *
    |A or B| (80 at least) over their sets of distinct k-word shingles; a shorter text is one shingle of all its words. Null,
    empty and blank texts have no shingle and link with nothing. component_id is the least id reachable. Texts are read whole,
    however long. Repeated rows are judged alike; rows that share an id but not a text are documents of their own. Null ids
    stay null and link nothing. Other columns are ignored; an empty table gives none."""
    found = _components(docs, k, percent, bucket)
    of = lambda c: F.coalesce(F.col(c) if dict(found.dtypes)[c] == "bigint" else F.col(c)["doc_id"], F.col("doc_id"))
    return found.select("doc_id", "n_shingles", of("class_node").alias("class_id"), of("component_node").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each component of near-duplicates the row of the least id, with all columns; what links with nothing stays.

    Rows that share an id but not a text are documents of their own; of those that are linked, the one of the least hash of
    its text stays. Rows of one id and text are one document: one stays (the least by its JSON). Rows without an id, and
    their repetitions, all stay. Only ids and hashes are joined, so texts are shuffled only if a table of ids is too large to
    send, and for ids that repeat. An empty table gives none."""
    gone = durable(_components(docs, k, percent, BUCKET).filter("node != component_node").select("doc_id", "tag").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"))
    left = rows.join(small(gone), ["doc_id", "tag"], "left_anti")
    twice = durable(rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "tag"))
    if not twice.isEmpty():
        again = left.join(small(twice), ["doc_id", "tag"], "left_semi").groupBy("doc_id", "tag").agg(F.min_by("row", F.to_json("row")).alias("row"))
        left = left.join(small(twice), ["doc_id", "tag"], "left_anti").select("row").unionByName(again.select("row"))
    return left.select("row.*")
