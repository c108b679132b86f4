"""SimHash fingerprints, and groups of near copies by the generalised pigeonhole principle.

The 64 bits are dealt into partitions, correlated bits together; their number follows
from the number of fingerprints. Two fingerprints within distance t of each other are,
for any thresholds of the partitions that sum to t - partitions + 1, within the
threshold of at least one partition. So each fingerprint chooses its own thresholds:
dynamic programming over the partitions minimises the probes plus the candidates that
counts of partition prefixes lead to expect. It probes the values within each
threshold; what is met there is verified by its whole distance. Linked fingerprints
form components.

Copies share one fingerprint and are one node from the start. First the fingerprints
of a bucket (equal in one partition) are verified against the bucket's commonest one,
which unites large groups of near copies by as many links as they have members. Then
everything is probed, but a probe of a bucket whose fingerprints all are of the
probe's own component is left out, and only links between components are kept. So no
link that could join two components is lost, and a group doesn't emit all its pairs.

Defined results: null or empty text has fingerprint zero, linked like any other; rows
are never dropped, a repeated or null id is a member like any other; a component's id
is the smallest of its documents, null if none has one. Sharing an id links nothing.
Other columns than the text stay; columns named fp or component_id are replaced.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, cut, free_name, map_arrow, map_texts, remove

SHINGLE, SEED, DISTANCE = 4, 42, 4
PROBES_A_TASK = 16_384  # fingerprints that a task probes
PREFIX = 12
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(shingles))


def fingerprint(h: np.ndarray) -> int:
    """Of the hashes of shingles, repeats included."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit number."""
    return map_texts(docs, lambda: lambda texts: [pa.array([fingerprint(shingle_hashes(t)) for t in texts], pa.int64())], f"`{out}` long", text)


def even_thresholds(distance: int, parts: int) -> list[int]:
    total = distance - parts + 1
    return [total // parts + (k < total % parts) for k in range(parts)]


def best_parts(n: int, distance: int = DISTANCE) -> int:
    """So many partitions that probes and candidates of n fingerprints are fewest, were their bits even."""

    def cost(parts: int) -> float:
        width = 64 // parts
        probes = [sum(comb(width, r) for r in range(t + 1)) for t in even_thresholds(distance, parts)]
        return sum(probes) * (1 + n / 2.0**width)

    return min(range(2, distance + 2), key=cost)


def bit_groups(nodes: DataFrame, parts: int) -> list[list[int]]:
    """The 64 bits in so many groups of near equal size, each grown by the bit that correlates most with it.

    The sums over all fingerprints are 64 x 64 numbers, added up by each task first.
    """

    def run(batches):
        n, ones, both = 0, np.zeros(64), np.zeros((64, 64))
        for batch in batches:
            bits = to_bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            n, ones, both = n + len(bits), ones + bits.sum(axis=0), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([ones.tolist()]), pa.array([both.ravel().tolist()])], names=["n", "ones", "both"])

    n, ones, both = 0, np.zeros(64), np.zeros(64 * 64)
    sums = map_arrow(nodes.select("fp"), run, "n long, ones array<double>, both array<double>")
    numbers = sums.select("n", F.posexplode(F.concat("ones", "both"))).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("sum"))
    for r in numbers.collect():
        n = r["n"]
        (ones if r["pos"] < 64 else both)[r["pos"] if r["pos"] < 64 else r["pos"] - 64] = r["sum"]
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs((both.reshape(64, 64) / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (near[b][left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (near[b][group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def to_bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def projected(bits: np.ndarray, group: list[int]) -> np.ndarray:
    """The group's bits as one number, the first bit lowest."""
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def index_rows(nodes: DataFrame, groups: list[list[int]]) -> DataFrame:
    """part, value, fp: a row for each partition of each fingerprint."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            bits = to_bits(fps)
            for k, group in enumerate(groups):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int32)), pa.array(projected(bits, group)), pa.array(fps)], names=["part", "value", "fp"])

    return map_arrow(nodes.select("fp"), run, "part int, value long, fp long")


def prefix_counts(index: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Per partition how many fingerprints have each prefix of the value; of bounded size."""
    counts = [np.zeros(1 << min(PREFIX, len(g))) for g in groups]
    low = F.col("value").bitwiseAND(F.lit((1 << PREFIX) - 1))
    for r in index.groupBy("part", low.alias("prefix")).count().collect():
        counts[r["part"]][r["prefix"]] = r["count"]
    return counts


def expected_candidates(counts: list[np.ndarray], groups: list[list[int]], most: int) -> list[np.ndarray]:
    """Per partition, threshold and prefix the candidates to expect; the bits after the prefix count as even."""
    out = []
    for table, group in zip(counts, groups, strict=True):
        width = int(np.log2(len(table)))
        rings = [table] + [np.zeros(len(table)) for _ in range(most)]
        for bit in range(width):  # rings[r]: rows whose prefix differs in r bits, of those bits seen so far
            swapped = [x.reshape(-1, 2, 1 << bit)[:, ::-1].reshape(-1) for x in rings]
            rings = [rings[0]] + [rings[r] + swapped[r - 1] for r in range(1, most + 1)]
        rest = len(group) - width
        share = [sum(comb(rest, s) for s in range(t + 1)) / 2.0**rest for t in range(most + 1)]
        out.append(np.stack([sum(rings[r] * share[t - r] for r in range(t + 1)) for t in range(most + 1)]))
    return out


def thresholds(prefixes: list[np.ndarray], expected: list[np.ndarray], sizes: list[int], total: int) -> np.ndarray:
    """Per fingerprint and partition a threshold of -1 or more; they sum to total and make probes and candidates fewest."""
    n, parts = len(prefixes[0]), len(prefixes)
    most = total + parts - 1
    cost = np.full((1, n), 0.0)  # by what is spent so far, where a threshold t spends t + 1
    choices = []
    for p in range(parts):
        each = [np.zeros(n)] + [expected[p][t][prefixes[p]] + sum(comb(sizes[p], s) for s in range(t + 1)) for t in range(most + 1)]
        best = np.full((total + parts + 1, n), np.inf)
        pick = np.zeros((total + parts + 1, n), np.int8)
        for spent in range(len(cost)):
            for t, c in enumerate(each):
                if spent + t <= total + parts:
                    better = cost[spent] + c < best[spent + t]
                    best[spent + t][better] = (cost[spent] + c)[better]
                    pick[spent + t][better] = t
        cost = best
        choices.append(pick)
    out = np.zeros((n, parts), np.int64)
    left = np.full(n, total + parts)
    for p in range(parts - 1, -1, -1):
        t = choices[p][left, np.arange(n)].astype(np.int64)
        out[:, p] = t - 1
        left = left - t
    return out


def probe_rows(nodes: DataFrame, groups: list[list[int]], expected: list[np.ndarray], distance: int = DISTANCE) -> DataFrame:
    """part, value, probe, own: every value within a fingerprint's threshold of each partition, for nodes (fp, comp)."""
    sizes, total = [len(g) for g in groups], distance - len(groups) + 1
    shared = nodes.sparkSession.sparkContext.broadcast(expected)

    def run(batches):
        masks = [[np.array([sum(1 << b for b in flip) for r in range(t + 1) for flip in combinations(range(size), r)], dtype=np.int64) for t in range(min(size, total + len(groups) - 1) + 1)] for size in sizes]
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                fps, own = (whole.column(k).slice(start, 4096).to_numpy(zero_copy_only=False) for k in range(2))
                bits = to_bits(fps)
                values = [projected(bits, g) for g in groups]
                chosen = thresholds([v & ((1 << PREFIX) - 1) for v in values], shared.value, sizes, total)
                for p, v in enumerate(values):
                    for t in range(len(masks[p])):
                        of = np.flatnonzero(chosen[:, p] == t)
                        mask = masks[p][t]
                        for few in np.array_split(of, -(-len(of) * len(mask) // 1_000_000) or 1):
                            if len(few):
                                probes = (v[few, None] ^ mask[None, :]).ravel()
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(probes), p, np.int32)), pa.array(probes), pa.array(np.repeat(fps[few], len(mask))), pa.array(np.repeat(own[few], len(mask)))], names=["part", "value", "probe", "own"])

    return map_arrow(nodes.select("fp", "comp"), run, "part int, value long, probe long, own long")


def near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def linked(nodes: DataFrame, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """fp and root of the fingerprints that links lead to another one; nodes: distinct fp and n, how many have it."""
    n = nodes.count()
    groups = bit_groups(nodes, parts or best_parts(n, distance))
    index = cut(index_rows(nodes, groups), compact=True)
    expected = expected_candidates(prefix_counts(index, groups), groups, distance)
    hubs = index.join(beside(nodes.select("fp", "n"), n), "fp").groupBy("part", "value").agg(F.max(F.struct("n", "fp"))["fp"].alias("hub"), F.count(F.lit(1)).alias("of")).where("of > 1").drop("of")
    first = cut(component_labels(index.join(beside(hubs, n * len(groups)), ["part", "value"]).where((F.col("fp") != F.col("hub")) & near("fp", "hub", distance)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))), compact=True)
    n_first = first.count()

    def with_component(df: DataFrame) -> DataFrame:
        return df.join(beside(first, n_first), F.col("fp") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "fp")).drop("node", "root")

    held = with_component(index)
    spans = held.groupBy("part", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    probes = probe_rows(with_component(nodes).repartition(max(1, n // PROBES_A_TASK), "fp"), groups, expected, distance)
    foreign = probes.join(beside(spans, n * len(groups)), ["part", "value"]).where((F.col("lo") != F.col("own")) | (F.col("hi") != F.col("own"))).drop("lo", "hi")
    met = foreign.join(beside(held, n * len(groups)), ["part", "value"]).where((F.col("probe") < F.col("fp")) & (F.col("own") != F.col("comp")) & near("probe", "fp", distance))
    second = cut(component_labels(met.select(F.col("own").alias("a"), F.col("comp").alias("b")).distinct()), compact=True)
    both = first.withColumnsRenamed({"node": "fp", "root": "comp"}).unionByName(second.select(F.col("node").alias("fp"), F.col("node").alias("comp"))).distinct()
    out = both.join(beside(second, second.count()), F.col("comp") == F.col("node"), "left").select("fp", F.coalesce("root", "comp").alias("root"))
    remove(index)
    return out


def component_labels(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, for every node of the edges (a, b).

    Each round links a node's larger neighbours to its smallest one and then its
    smaller ones, until nothing changes; the rounds grow with the logarithm of the
    longest path. Every round is written to the shared folder, in place of the last.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m")).distinct(), compact=True)
    before, rows = None, now.count()
    while True:
        both = now.union(now.select(F.col("m").alias("n"), F.col("n").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo"))
        large = both.join(beside(least, 2 * rows), "n").where("m > n").select(F.col("m").alias("n"), F.col("lo").alias("m"))
        large = large.where("n != m").distinct()
        lows = large.groupBy("n").agg(F.min("m").alias("lo"))
        small = large.join(beside(lows, 2 * rows), "n").select(F.col("m").alias("n"), F.col("lo").alias("m")).where("n != m").union(lows.select("n", F.col("lo").alias("m")))
        now = cut(small.distinct(), instead_of=now, compact=True)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("n", "m").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("n").alias("node"), F.col("m").alias("root")).union(now.select(F.col("m").alias("node"), F.col("m").alias("root"))).distinct()
        before, rows = state, state[0]


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """docs without the text, with fp and component_id, the smallest doc_id that links lead to."""
    printed = cut(fingerprints(docs.drop("fp", "component_id"), text).drop(text))
    nodes = cut(printed.groupBy("fp").agg(F.min(F.col(doc_id)).alias("first"), F.count(F.lit(1)).alias("n")), compact=True)
    roots = cut(linked(nodes, distance, parts).withColumnRenamed("fp", "of"), compact=True)
    n_roots, n_nodes = roots.count(), nodes.count()
    named = beside(roots, n_roots).join(nodes, F.col("of") == F.col("fp")).groupBy("root").agg(F.min("first").alias("least"))
    members = roots.join(beside(named, n_roots), "root").select("of", "least")
    id_of = free_name(printed, "__of")
    classes = nodes.join(beside(members, n_roots), F.col("fp") == F.col("of"), "left").select(F.col("fp").alias(id_of), F.coalesce("least", "first").alias("component_id"))
    return printed.join(beside(classes, n_nodes), F.col("fp") == F.col(id_of)).drop(id_of)


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
