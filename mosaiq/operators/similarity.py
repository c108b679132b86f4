"""Pairs of similar hashes, components of pairs, and the best of each group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mosaiq.functions.hashing import hamming_long
from mosaiq.operators.checkpoints import written


def parts_of(distance: int, rows: int, width: int = 64) -> list[tuple[int, int, int]]:
    """(low bit, bits, radius) of the parts by which hashes within the distance are found, at the least cost for so many rows.

    Hashes within the distance differ in a part by its radius at most, if the radii and one a part add up to one more than the
    distance. Many parts are short and meet many rows by chance; few parts are long, and all values within their radius are
    probed. The cost of a row is its probes and the rows that they meet.
    """

    def cut(parts: int) -> list[tuple[int, int, int]]:
        edges, shares = [width * k // parts for k in range(parts + 1)], [(distance + 1 + k) // parts for k in range(parts)]
        return [(low, high - low, share - 1) for low, high, share in zip(edges[:-1], edges[1:], shares, strict=True)]

    def cost(parts: int) -> float:
        return sum(sum(comb(bits, d) for d in range(radius + 1)) * (1 + rows / 2.0**bits) for _, bits, radius in cut(parts))

    return cut(min(range(1, min(width, distance + 1) + 1), key=cost))


#: Hashes that a block holds where all are compared, and the comparisons that take as long as a probe that is joined.
BLOCK, COMPARED = 16_384, 500


def probing_pays(of: list[tuple[int, int, int]], rows: int) -> bool:
    """Whether probes of the parts take less time than the comparison of all rows with each other."""
    probes = sum(sum(comb(bits, d) for d in range(radius + 1)) * (1 + rows / 2.0**bits) for _, bits, radius in of)
    return probes * COMPARED < rows / 2


def similar_pairs(df: DataFrame, key: str, bits: str, distance: int, gate: Column | None = None) -> DataFrame:
    """id1 < id2 within the distance, exactly.

    Where few values lie within the radii of parts (see parts_of), a join on parts of the hashes, where one side has its
    parts and the other all values within their radii, and a check of the distance. Else, and that is so for large
    distances, whose pairs grow with the square of the rows, blocks of rows are compared with each other.

    gate: one more condition on columns of a and b; it is for the join.
    """
    rows = df.count()
    of = parts_of(distance, rows)
    if gate is not None or probing_pays(of, rows):
        return probed_pairs(df, key, bits, distance, of, gate)
    met = compared_blocks(df, key, bits, distance, rows, forest=False)
    return met.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "distance").where("id1 < id2")


def probed_pairs(df: DataFrame, key: str, bits: str, distance: int, of: list[tuple[int, int, int]], gate: Column | None = None) -> DataFrame:
    part = lambda low, n: F.shiftrightunsigned(F.col(bits), low).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1))
    flips = [(k, sum(1 << b for b in some)) for k, (_, n, radius) in enumerate(of) for d in range(radius + 1) for some in combinations(range(n), d)]
    table = df.sparkSession.createDataFrame([(k, f - (1 << 64) if f >= 1 << 63 else f) for k, f in flips], "__part int, __flip long")
    indexed = df.select("*", F.posexplode(F.array(*[part(low, n) for low, n, _ in of])).alias("__part", "__run"))
    probing = indexed.join(F.broadcast(table), "__part").withColumn("__run", F.col("__run").bitwiseXOR(F.col("__flip")))
    a, b = indexed.alias("a"), probing.hint("merge").alias("b")  # its size is taken for that of the rows, and is not for the driver
    near = hamming_long(F.col(f"a.{bits}"), F.col(f"b.{bits}"))
    on = (F.col("a.__part") == F.col("b.__part")) & (F.col("a.__run") == F.col("b.__run")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (near <= distance)
    found = a.join(b, on if gate is None else on & gate)
    return found.select(F.col(f"a.{key}").alias("id1"), F.col(f"b.{key}").alias("id2"), near.alias("distance")).distinct()


def compared_blocks(df: DataFrame, key: str, bits: str, distance: int, rows: int, forest: bool) -> DataFrame:
    """a, b and distance of rows within the distance, by comparing each block of rows with each; a task holds two blocks.

    forest: of the links in two blocks only so many that they join the same rows.
    """
    blocks = max(-(-rows // BLOCK), min(6, -(-rows // 1024)), 1)
    kind = df.schema[key].dataType
    held = df.where(F.col(key).isNotNull() & F.col(bits).isNotNull()).select(F.pmod(F.xxhash64(key, bits), F.lit(blocks)).alias("__block"), F.struct(F.col(key).alias("id"), F.col(bits).alias("bits")).alias("__row"))
    packed = held.groupBy("__block").agg(F.array_agg("__row").alias("rows"))
    sent = packed.select("__block", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("__other"))
    sides = sent.select(F.least("__block", "__other").alias("lo"), F.greatest("__block", "__other").alias("hi"), (F.col("__block") <= F.col("__other")).alias("first"), "rows")
    dealt = sides.repartition(blocks * (blocks + 1) // 2, "lo", "hi")
    pairs = dealt.groupBy("lo", "hi").agg(F.first(F.when(F.col("first"), F.col("rows")), ignorenulls=True).alias("rows"), F.first(F.when(~F.col("first"), F.col("rows")), ignorenulls=True).alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, same in enumerate(x == y for x, y in zip(lows, highs, strict=True)):
                one, other = (batch.column(c).slice(k, 1).flatten() for c in ((2, 2) if same else (2, 3)))
                for i, j, d in near_places(*(x.field("bits").to_numpy(zero_copy_only=False) for x in (one, other)), distance, same, forest):
                    yield pa.RecordBatch.from_arrays([one.field("id").take(pa.array(i)), other.field("id").take(pa.array(j)), pa.array(d.astype(np.int32))], names=["a", "b", "distance"])

    schema = StructType().add("a", kind).add("b", kind).add("distance", "integer")
    return pairs.mapInArrow(run, schema)


def near_places(x: np.ndarray, y: np.ndarray, distance: int, same: bool, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y within the distance, and how far apart they are, a few rows of x at once; same: y is x, and each pair comes once."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    trees = Trees(len(x) if same else len(x) + len(y)) if forest else None
    step = max(1, 131_072 // max(1, len(y)))
    for start in range(0, len(x), step):
        after = start + 1 if same else 0
        apart = np.bitwise_count(x[start : start + step, None] ^ y[None, after:])
        i, j = np.nonzero(apart <= distance)
        d = apart[i, j]
        i, j = i + start, j + after
        if same:
            once = j > i
            i, j, d = i[once], j[once], d[once]
        if trees is not None and len(i):
            kept = trees.joins(i, j if same else j + len(x))
            i, j, d = i[kept], j[kept], d[kept]
        if len(i):
            yield i, j, d


class Trees:
    """Which of links, as they come, join two trees of nodes: the smaller one takes the larger one's label."""

    def __init__(self, n: int):
        self.label, self.members = np.arange(n), {}

    def joins(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The places of the links that join two trees."""
        kept, left = [], np.flatnonzero(self.label[u] != self.label[v])
        while len(left):
            row = left[u[left] == u[left[0]]]  # of one node, whose links are in order
            _, firsts = np.unique(self.label[v[row]], return_index=True)
            for k in row[firsts]:
                if self.join(self.label[u[k]], self.label[v[k]]):
                    kept.append(k)
            left = left[len(row) :]
            left = left[self.label[u[left]] != self.label[v[left]]] if len(firsts) else left
        return np.array(kept, dtype=np.int64)

    def join(self, a: int, b: int) -> bool:
        if a == b:
            return False
        one, other = (self.members.pop(k, [k]) for k in (a, b))
        if len(one) < len(other):
            a, one, other = b, other, one
        self.label[other] = a
        one.extend(other)
        self.members[a] = one
        return True


def chunk_candidates(df: DataFrame, key: str, chunks: Column, distance: int, bits: str) -> DataFrame:
    """Pairs that share a chunk at the same place and lie within the distance; others are not looked for."""
    indexed = df.select(key, bits, F.posexplode(chunks).alias("__place", "__chunk"))
    a, b = indexed.alias("a"), indexed.alias("b")
    near = hamming_long(F.col(f"a.{bits}"), F.col(f"b.{bits}"))
    on = (F.col("a.__place") == F.col("b.__place")) & (F.col("a.__chunk") == F.col("b.__chunk")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (near <= distance)
    return a.join(b, on).select(F.col(f"a.{key}").alias("id1"), F.col(f"b.{key}").alias("id2"), near.alias("distance")).distinct()


def similar_groups(df: DataFrame, key: str, bits: str, distance: int) -> DataFrame:
    """key and component (its smallest key) of rows whose hashes are linked within the distance.

    Rows of one hash are one node, so copies make no pairs with each other.
    """
    nodes = written(df.groupBy(bits).agg(F.min(key).alias("__first")))
    rows = nodes.count()
    of = parts_of(distance, rows)
    links = probed_pairs(nodes, "__first", bits, distance, of) if probing_pays(of, rows) else compared_blocks(nodes, "__first", bits, distance, rows, forest=True).select(F.col("a").alias("id1"), F.col("b").alias("id2"))
    linked = components(nodes, "__first", links)
    named = nodes.join(linked, "__first").select(F.col(bits).alias("__bits"), "component")
    return df.join(named, F.col(bits).eqNullSafe(F.col("__bits"))).select(key, "component")


def components(nodes: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """key and component, the smallest key that pairs (id1, id2) lead to; nodes without pairs are their own.

    Labels go to neighbours, and then from a label's own row, until none changes; each round is written out.
    """
    edges = written(pairs.select(F.explode(F.array(F.struct(F.col("id1").alias("u"), F.col("id2").alias("v")), F.struct(F.col("id2").alias("u"), F.col("id1").alias("v")))).alias("e")).select("e.*"))
    labels = written(nodes.select(F.col(key).alias("node"), F.col(key).alias("label")))
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("u"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("least"))
        heads = stepped.select(F.col("node").alias("head"), F.col("least").alias("jump"))
        jumped = stepped.join(heads, F.col("least") == F.col("head"), "left").select("node", F.least("least", "jump").alias("new"), "label")
        now = written(jumped)
        labels = now.select("node", F.col("new").alias("label"))
        if not now.where("new <> label").limit(1).count():
            return labels.select(F.col("node").alias(key), F.col("label").alias("component"))


def best_of_groups(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The best row of each group."""
    from mosaiq.operators.ranking import first_per

    return first_per(df, [group], order)
