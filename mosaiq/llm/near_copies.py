"""One document of each group of near copies: five-word shingles, similarity 0.8 or more.

Fingerprints of 64 bits can't decide this: texts whose sets of shingles are 0.8 alike
differ in 10 bits on average, far beyond a distance whose links can be searched for.
So the components of five-word SimHash fingerprints (see simhash) are one source of
candidates, and bands of minimal hashes of the shingle sets are the others: texts of
similarity 0.8 share one of BANDS bands of ROWS_A_BAND values with probability 0.995.
Whatever shares a component or a band is a bucket.

Buckets of more than SMALL texts are not compared as they are. Two sets of a and b shingles
that are similar enough share t / (1 + t) of a + b; so, with the shingles of all in one order,
the rarest first, they share one of the first a - t / (1 + t) (a + b) + 1 of a's (and of b's).
Texts of large buckets meet by these shingles, with b as small as any text of their
buckets. No pair of a bucket that is similar enough is lost, and a text whose own words are too many to
be like any other meets none, however large its bucket is.

What shares a small bucket or such a shingle is verified against one of them first, its
hub, the one that meets most others: exactly, by the sets of shingles. Where several components are
left, all texts outside the largest one are compared with all of other components once
they are few against the round's hubs (FINISH for each but one); until then four times as many other
hubs are taken each round. Texts of one component
are not compared, so a large group takes pairs in proportion to its size, and every two
texts of a bucket are linked, led to each other by links, were compared or share too few shingles. The
recall of the buckets is measured in the tests.

Defined results: texts are compared in lower case by words; texts of fewer words than
a shingle are one shingle, and those without words (null, empty) are alike. Of equal
texts and of each group the row with the smallest id stays (a null id is the largest;
then the least row, by its columns in order, which must be of types that have an
order). Rows of one id with different texts are different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, beside, bitmap, cut, free_name, held, in_parts, map_arrow, map_texts, remove
from .simhash import component_labels, fingerprint, linked, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS_A_BAND, HUBS = 10, 4, 1
SMALL, FINISH = 4, 8
FACTORS = np.random.default_rng(6).integers(1 << 62, 1 << 63, BANDS * ROWS_A_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A number for each band: its minimal hashes of the set, folded."""
    least = np.array([(shingles * f).min() for f in FACTORS], dtype=np.uint64).reshape(BANDS, ROWS_A_BAND)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS_A_BAND):
        out = (out ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketched(docs: DataFrame, text: str) -> DataFrame:
    """Adds fp, bands and size (of the set of shingles)."""

    def work(texts: list[str]) -> list[pa.Array]:
        prints, bands, sizes = [], [], []
        for t in texts:
            h = shingle_hashes(t, SHINGLE)
            different = np.unique(h) if len(h) else np.zeros(1, np.uint64)
            prints.append(fingerprint(h))
            bands.append(band_keys(different))
            sizes.append(len(different))
        return [pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]

    return map_texts(docs, lambda: work, "fp long, bands array<long>, size int", text)


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (node, and more) with set (array<long>) of texts (node, text), one a node; a task sends each of the last nodes it met once.

    A bitmap leaves out most texts that are not wanted, so that whole texts are not shuffled.
    """
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("node").alias("hash"))))

    def run(batches):
        met = Memo(lambda key: False, 50_000)
        for batch in in_parts(batches):
            batch = batch.filter(held(batch.column(2), bits.value))
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not met[node]:
                    met[node] = True
                    h = shingle_hashes(text or "", SHINGLE)
                    nodes.append(node)
                    sets.append((np.unique(h) if len(h) else np.zeros(1, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    sets = map_arrow(texts.select("node", "text", F.xxhash64("node").alias("hash")), run, "node string, set array<long>")
    return sets.groupBy("node").agg(F.first("set").alias("set")).join(beside(wanted, wanted.count()), "node")


def top_of_buckets(rows: DataFrame, most: int) -> DataFrame:
    """bucket, hub, hub_comp and hub_size: the texts of each bucket that share most buckets; a large bucket is ranked by parts first."""
    order = [F.desc("weight"), "node"]
    parts = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(64)))
    few = parts.withColumn("k", F.row_number().over(Window.partitionBy("bucket", "part").orderBy(*order))).where(F.col("k") <= most)
    best = few.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("k") <= most)
    return best.select("bucket", F.col("node").alias("hub"), F.col("comp").alias("hub_comp"), F.col("size").alias("hub_size"))


def with_main(rows: DataFrame) -> DataFrame:
    """The rows of buckets that have several components, with main, the one of most texts, and rest, how many texts are outside it."""
    sizes = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    return rows.join(beside(several.where("comps > 1").drop("comps"), rows.count()), "bucket")


def by_rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """bucket, node and size: the shingles by which texts meet all that are similar enough and have least shingles or more; sets: id, node, set and least."""
    items = sets.select("id", F.explode("set").alias("item"))
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("merge")  # many for each set
    shared = items.join(counts, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("shared"))
    sized = sets.select("id", "node", F.size("set").alias("size"), "least")
    other = F.greatest(F.col("least"), similarity * F.col("size"))
    first = F.floor(F.col("size") - similarity / (1 + similarity) * (F.col("size") + other) + 1e-6) + 1
    taken = (first - (F.col("size") - F.size("shared"))).cast("int")  # those that no other text has come first
    met = shared.join(beside(sized, sets.count()), "id").withColumn("taken", taken).where("taken > 0")
    return met.select(F.explode(F.expr("slice(shared.item, 1, taken)")).alias("bucket"), "node", "size")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b, and more) whose sets are similar enough, without the sets."""
    met = cut(pairs, compact=True)
    n = met.count()  # few pairs are sent to the sets, and the sets never to them
    asked = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets.join(beside(asked, 2 * n), "node", "left_semi")
    with_a = beside(met, n).join(sets.withColumnsRenamed({"node": "a", "set": "set_a"}), "a")
    with_b = with_a.join(sets.withColumnsRenamed({"node": "b", "set": "set_b"}).hint("merge"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return with_b.where(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared)).select(*pairs.columns)


def groups(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """node and root of the texts that have near copies other than equal ones; node: the text's MD5 digest."""
    node = F.md5(F.coalesce(F.col(text), F.lit("")))
    texts = docs.select(node.alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nodes = cut(sketched(texts, "text").select("node", "fp", "bands", "size").dropDuplicates(["node"]), compact=True)
    prints = cut(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), compact=True)
    roots = cut(linked(prints).withColumnRenamed("fp", "of"), compact=True)
    n_nodes = nodes.count()
    by_print = nodes.join(beside(roots, roots.count()), F.col("fp") == F.col("of"), "left").select("node", "size", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("bucket"))
    every = by_print.union(nodes.select("node", "size", F.explode("bands").alias("bucket")))
    crowded = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("of"), F.min("size").alias("least")).where("of > 1")
    met = cut(every.join(beside(crowded, n_nodes * (BANDS + 1)), "bucket"), compact=True)
    wanted = cut(met.groupBy("node").agg(F.min(F.when(F.col("of") > SMALL, F.col("least"))).alias("least")), compact=True)
    sets = cut(shingle_sets(texts, wanted).withColumn("id", F.monotonically_increasing_id()))
    small = met.where(F.col("of") <= SMALL).select("bucket", "node", "size")
    keyed = cut(small.union(by_rare_shingles(sets.where("least is not null"), similarity)), compact=True)
    several, n_keyed = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("of")).where("of > 1"), keyed.count()
    meeting = cut(keyed.join(beside(several, n_keyed), "bucket"), compact=True)
    weights = meeting.groupBy("node").agg(F.sum("of").alias("weight"))
    rows = cut(meeting.join(beside(weights, n_keyed), "node").select("bucket", "node", "size", "weight", F.col("node").alias("comp")), compact=True)
    links, hubs_now = None, HUBS
    while True:
        open_rows = cut(with_main(rows), instead_of=rows, compact=True)
        last = F.col("rest") <= 1 + FINISH * (hubs_now - 1)
        outside = open_rows.where(last & (F.col("comp") != F.col("main")) & (F.col("weight") > 0))
        hubs = outside.select("bucket", F.col("node").alias("hub"), F.col("comp").alias("hub_comp"), F.col("size").alias("hub_size"))
        hubs = cut(hubs.union(top_of_buckets(open_rows.where(~last & (F.col("weight") > 0)), hubs_now)), compact=True)
        n_hubs = hubs.count()
        if not n_hubs:  # every bucket is one component, or all its texts outside of one were compared
            break
        alike = F.least("size", "hub_size") >= similarity * F.greatest("size", "hub_size")
        met_hub = open_rows.join(beside(hubs, n_hubs), "bucket").where((F.col("comp") != F.col("hub_comp")) & alike)
        pairs = met_hub.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.first(F.struct("comp", "hub_comp")).alias("of"))
        found = cut(verified(pairs.select("a", "b", F.col("of.comp").alias("u"), F.col("of.hub_comp").alias("v")), sets.select("node", "set"), similarity), compact=True)
        new = found.select("a", "b")
        links = cut(new if links is None else links.union(new), instead_of=links, compact=True)
        merged = cut(component_labels(found.select(F.col("u").alias("a"), F.col("v").alias("b"))), compact=True)  # of components, which carry the links of earlier rounds
        used = hubs.select("bucket", F.col("hub").alias("node"), F.lit(True).alias("used"))
        going = open_rows.where(~last).join(beside(used, n_hubs), ["bucket", "node"], "left")
        going = going.join(beside(merged.withColumnRenamed("node", "of"), merged.count()), F.col("comp") == F.col("of"), "left")
        rows = cut(going.select("bucket", "node", "size", F.when(F.col("used"), 0).otherwise(F.col("weight")).alias("weight"), F.coalesce("root", "comp").alias("comp")), instead_of=open_rows, compact=True)
        hubs_now *= 4
    for done in (nodes, prints, roots, met, open_rows, wanted, sets, keyed, meeting):
        remove(done)
    return component_labels(docs.sparkSession.createDataFrame([], "a string, b string") if links is None else links)


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, with the columns of docs; see the module."""
    node, first = free_name(docs, "__node"), free_name(docs, "__first")
    labels = cut(groups(docs, text, similarity), compact=True)
    n_labels = labels.count()
    order: list[Column] = [F.col(doc_id).isNull().alias("null"), F.col(doc_id).alias("id")]
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    members = docs.select(digest.alias("node"), F.struct(*order).alias("key")).join(beside(labels, n_labels), "node").groupBy("root", "node").agg(F.min("key").alias("key"))
    best = members.groupBy("root").agg(F.min(F.struct("key", "node"))["node"].alias("best"))
    gone = cut(members.join(beside(best, n_labels), "root").where("node <> best").select(F.col("node").alias(node)), compact=True)
    staying = docs.withColumn(first, digest).join(beside(gone, gone.count()), F.col(first) == F.col(node), "left_anti")
    row = F.struct(*order, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("x")
    return staying.select(F.col(first).alias("node"), row).groupBy("node").agg(F.min("x").alias("x")).select("x.row.*")
