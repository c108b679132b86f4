"""Target-distribution importance resampling: documents are drawn without replacement by how likely their words are in a target.

Features are runs of 1 to `ngrams` consecutive words (A-Z lower-cased; letters a-z, digits and everything beyond
ASCII are word characters), hashed to `buckets`. A bucket's gain is the floored log ratio of its smoothed shares in
the target and in the raw corpus, in thousandths; a document's weight is the floored mean of its features' gains, by
one array of gains in each task. The score adds Gumbel noise from the id, so the highest scores are a draw
without replacement in proportion to exp(weight / 1000).

The draw is exact. Scores are whole numbers within about 100,000, so their histogram is small whatever the input;
it gives the number of eligible rows, the last score that is drawn and cuts between blocks of about `block` rows.
Each partition of the written scores is a run, sorted by score, id and a stored random number; its rows that may be
drawn are cut into chunks that don't cross blocks. A block's chunks arrive by their first keys and meet in a
tournament tree, which holds one open chunk a run and stops at the draw count. A score with very many rows is cut by
ids, an id with very many rows of one score by the random number, so no block depends on one key.

Null texts have no features and weight 0. Null ids count as the empty string in the noise and come last among ties.
Rows alike in score and id take ranks in any order. An empty table, or one without eligible rows, gives no ranks.
An empty target counts as target shares that are all alike. Columns named n_features, weight, score or rank are replaced.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, cut, free_name, map_texts, text_of

BUCKETS = 10_000
BLOCK = 20_000
NO_ID = 1 << 63

#: Bytes of UTF-8 that stand in words, A-Z lower-cased; all others become spaces.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLDED).split()


def feature_buckets(buckets: int, ngrams: int):
    """A function from a text to its features' buckets, repeats included."""
    known = Memo(lambda word: zlib.crc32(word) % buckets)

    def find(text: str) -> list[int]:
        words = words_of(text)
        out = [known[w] if len(w) <= 64 else zlib.crc32(w) % buckets for w in words]
        for n in range(2, ngrams + 1):
            out += [zlib.crc32(b" ".join(words[k : k + n])) % buckets for k in range(len(words) - n + 1)]
        return out

    return find


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, ngrams: int = 1) -> DataFrame:
    """(bucket, n): each task adds up one array of counts, so at most `buckets` rows a task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = feature_buckets(buckets, ngrams), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if found := find(text):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, raw: DataFrame, buckets: int = BUCKETS, ngrams: int = 1) -> np.ndarray:
    """The gain of each bucket; two arrays of counts reach the driver, whatever the tables' size."""
    both = []
    for df in (target, raw):
        counts = [0] * buckets
        for row in bucket_counts(df, buckets, ngrams).collect():
            counts[row["bucket"]] = row["n"]
        both.append(counts)
    t, s = both
    of_target, of_raw = float(sum(t) + buckets), float(sum(s) + buckets)
    return np.array([math.floor(1000 * math.log((t[k] + 1) * of_raw / ((s[k] + 1) * of_target))) for k in range(buckets)], dtype=np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, table: np.ndarray, ngrams: int = 1, seed: int = 2024, doc_id: str = "doc_id") -> DataFrame:
    """docs with n_features, weight and score."""

    def make():
        find = feature_buckets(len(table), ngrams)

        def weigh(texts: list[str]) -> list[pa.Array]:
            numbers, weights = [], []
            for text in texts:
                found = find(text)
                numbers.append(len(found))
                weights.append(int(table[found].sum()) // len(found) if found else 0)
            return [pa.array(numbers, type=pa.int64()), pa.array(weights, type=pa.int64())]

        return weigh

    return map_texts(docs, make, "n_features long, weight long").withColumn("score", F.col("weight") + noise(F.col(doc_id), seed))


class Tournament:
    """A tree of winners over open runs: the least key is at the root, and a leaf's new key replays its path only."""

    def __init__(self):
        self.size, self.keys, self.free, self.tree = 1, [None], [0], [0, 0]

    def winner(self) -> int | None:
        leaf = self.tree[1]
        return None if self.keys[leaf] is None else leaf

    def _better(self, a: int, b: int) -> int:
        x, y = self.keys[a], self.keys[b]
        return a if y is None or (x is not None and x <= y) else b

    def put(self, leaf: int, key: tuple | None) -> None:
        self.keys[leaf] = key
        node = (leaf + self.size) // 2
        while node:
            self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])
            node //= 2
        if key is None:
            self.free.append(leaf)

    def open(self, key: tuple) -> int:
        if not self.free:
            self.keys += [None] * self.size
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.size *= 2
            self.tree = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])
        leaf = self.free.pop()
        self.put(leaf, key)
        return leaf


def merged(chunks: Iterator[tuple[list[tuple], pa.StructArray]]) -> Iterator[pa.StructArray]:
    """The rows of chunks in order of their keys; chunks are sorted and come by their first keys."""
    tree, open_runs = Tournament(), {}
    coming = next(chunks, None)
    while coming is not None or tree.winner() is not None:
        leaf = tree.winner()
        if coming is not None and (leaf is None or coming[0][0] <= tree.keys[leaf]):
            open_runs[tree.open(coming[0][0])] = [*coming, 0]
            coming = next(chunks, None)
            continue
        run = open_runs[leaf]
        keys, rows, at = run
        yield rows[at : at + 1]
        run[2] = at + 1
        if at + 1 < len(keys):
            tree.put(leaf, keys[at + 1])
        else:
            del open_runs[leaf]
            tree.put(leaf, None)


def block_cuts(may: DataFrame, histogram: list[tuple[int, int]], last: int, block: int, doc_id: str, salt: str) -> list[tuple]:
    """The first keys of the blocks: by scores, and within scores of many rows by ids, then by the random number."""
    cuts, heavy, size = [], {}, 0
    for score, n in sorted(histogram, reverse=True):
        if score < last:
            break
        if n > 2 * block:
            heavy[score] = n
        if not cuts or size + n > block:
            cuts.append((-score, -NO_ID, -1))
            size = 0
        size += n
    if heavy:
        most = may.where(F.col("score").isin(list(heavy)))
        parts = {s: -(-n // block) for s, n in heavy.items()}
        spread = F.percentile_approx(F.col(doc_id), [k / 64 for k in range(1, 64)], 10_000)
        for row in most.groupBy("score").agg(spread.alias("ids")).collect():
            ids, step = row["ids"] or [], max(1, 64 // parts[row["score"]])
            cuts += [(-row["score"], i, -1) for i in set(ids[::step])]
        for row in most.groupBy("score", F.col(doc_id).alias("id")).count().where(F.col("count") > 2 * block).collect():
            k = -(-row["count"] // block)
            cuts += [(-row["score"], NO_ID if row["id"] is None else row["id"], (j << 31) // k) for j in range(k)]
    return sorted(set(cuts))


def draw(rows: DataFrame, percent: int = 10, least: int = 20, block: int = BLOCK, doc_id: str = "doc_id") -> DataFrame:
    """rows with rank: 1, 2, 3... for the floor(percent * N / 100) highest scores of the N rows with `least` features or more.

    Ties go to the smaller id; rows that are not drawn have a null rank. rows is written once, so keep texts out of it.
    """
    rows = rows.drop("rank")
    salt = free_name(rows, "salt")
    stored = cut(rows.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31))))
    eligible = (F.col("n_features") >= least) & F.col("score").isNotNull()
    histogram = [(r["score"], r["count"]) for r in stored.where(eligible).groupBy("score").count().collect()]
    wanted, seen, last = sum(n for _, n in histogram) * percent // 100, 0, None
    for score, n in sorted(histogram, reverse=True):
        if seen >= wanted:
            break
        seen, last = seen + n, score
    out = T.StructType([*rows.schema, T.StructField("rank", T.LongType())])
    rest = rows.columns
    if last is None:
        return stored.select(*[F.col(f"`{c}`") for c in rest], F.lit(None).cast("long").alias("rank"))
    may = stored.where(eligible & (F.col("score") >= last))
    cuts = block_cuts(may, histogram, last, block, doc_id, salt)
    names = stored.columns
    kept = [names.index(c) for c in rest]

    def keys_of(get) -> list[tuple]:
        return [(-s, NO_ID if i is None else i, x) for s, i, x in zip(get("score").to_pylist(), get(doc_id).to_pylist(), get(salt).to_pylist(), strict=True)]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch.column)
            blocks = [bisect.bisect_right(cuts, k) - 1 for k in keys]
            starts = [k for k in range(len(keys)) if not k or blocks[k] != blocks[k - 1]]
            sizes = np.diff([*starts, len(keys)])
            whole = pa.StructArray.from_arrays(batch.columns, names=names)
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(keys)], type=pa.int32()), whole)
            first = [keys[k] for k in starts]
            columns = [pa.array([blocks[k] for k in starts], type=pa.int32()), pa.array([-k[0] for k in first], type=pa.int64()), pa.array([None if k[1] == NO_ID else k[1] for k in first], type=pa.int64()), pa.array([k[2] for k in first], type=pa.int64()), pa.array(sizes, type=pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "score", "id", "salt", "n", "chunk"])

    shape = T.StructType([T.StructField("block", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("score", "id", "salt", "n")], T.StructField("chunk", T.ArrayType(stored.schema))])
    runs = cut(may.sortWithinPartitions(F.desc("score"), F.asc_nulls_last(doc_id), salt).mapInArrow(chunked, shape))
    before, sizes = {}, {r["block"]: r["n"] for r in runs.groupBy("block").agg(F.sum("n").alias("n")).collect()}
    total = 0
    for b in sorted(sizes):
        before[b], total = total, total + sizes[b]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arriving = ((b, c) for batch in batches for b, c in zip(batch.column("block").to_pylist(), batch.column("chunk"), strict=True))
        current = next(arriving, None)
        while current is not None:
            block_now = current[0]

            def of_block() -> Iterator[tuple[list[tuple], pa.StructArray]]:
                nonlocal current
                while current is not None and current[0] == block_now:
                    values = current[1].values
                    yield keys_of(values.field), values
                    current = next(arriving, None)

            rank, ready = before[block_now], []

            def batch_of(ready: list[pa.StructArray], rank: int) -> pa.RecordBatch:
                found = pa.concat_arrays(ready).flatten()
                ranks = [r if r <= wanted else None for r in range(rank + 1, rank + 1 + len(ready))]
                return pa.RecordBatch.from_arrays([*[found[k] for k in kept], pa.array(ranks, type=pa.int64())], names=[*rest, "rank"])

            for row in merged(of_block()):
                ready.append(row)
                if len(ready) == 4096:
                    yield batch_of(ready, rank)
                    rank, ready = rank + len(ready), []
            if ready:
                yield batch_of(ready, rank)

    ordered = runs.select("block", "score", "id", "salt", "chunk").repartition("block").sortWithinPartitions("block", F.desc("score"), F.asc_nulls_last("id"), "salt")
    drawn = ordered.select("block", "chunk").mapInArrow(ranked, out)
    undrawn = stored.where(~(eligible & (F.col("score") >= last)) | F.col("n_features").isNull() | F.col("score").isNull())
    return drawn.unionByName(undrawn.select(*[F.col(f"`{c}`") for c in rest], F.lit(None).cast("long").alias("rank")))
