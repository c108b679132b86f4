"""Rule counts and an n-gram log-likelihood ratio for every document.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials
over the buckets are counted: one over all documents, one over trusted documents
(those that labels call good and not toxic). A document's score is the sum of log(trusted / raw)
over its words and pairs, divided by their number; it is kept when no base rule
fails and the score reaches a threshold. The threshold is a fixed parameter, so
the verdict on a document depends on nothing but its text and the two models.

Defined results: null or empty text has no words, fails the base rules and has
score 0; repeated rows count each time; rows are never dropped. Without trusted
documents all ratios and scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, map_texts, passing, text_of

BUCKETS = 1 << 16
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FEW_WORDS, REPEATED_PERCENT = 20, 30
PRIOR = 8.0  # occurrences, of which the trusted share is taken as the corpus's
THRESHOLD = -0.09


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window of so many words found twice or more; h: a 64-bit hash of each word."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(h) + 1, dtype=np.int64)
    starts = np.flatnonzero(np.isin(rolled, twice))
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def buckets(h: np.ndarray) -> np.ndarray:
    """The bucket of each word and of each pair of neighbours."""
    shift = np.uint64(48)
    single = (h * np.uint64(0xD6E8FEB86659FD93)) >> shift
    pairs = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)) >> shift
    return np.concatenate([single, pairs]).astype(np.int64)


def rule_counts(text: str, raw: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """The number of words, their characters, symbols, repeated lines and words in repeated windows."""
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h)


def ngram_counts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, raw, target: how often each bucket stands in all documents and in the trusted ones.

    trusted: one column doc_id; each task adds up its rows first. All rows are counted where they are; only rows whose id
    a bitmap of the trusted ids lets pass go to the join that tells which are trusted.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    held = passing(given.where("doc_id is not null"), F.col("doc_id"), bitmap(ids.select(F.xxhash64("doc_id").alias("hash")))).join(ids, "doc_id", "left_semi")

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for doc in batch.column(0).to_pylist():
                total += np.bincount(buckets(word_hashes(doc.encode().split())), minlength=BUCKETS)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    raw, target = (df.select("text").mapInArrow(run, "bucket long, n long") for df in (given, held))
    both = raw.select("bucket", F.col("n").alias("raw"), F.lit(0).cast("long").alias("target")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("raw"), F.col("n").alias("target")))
    return both.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(trusted / raw) of each bucket, drawn towards 0 where little is counted; the rows are as few as the buckets."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]] = r["raw"]
        target[r["bucket"]] = r["target"]
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + PRIOR) / (expected + PRIOR))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of good, non-toxic documents."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id")


def score_rules(docs: DataFrame, ratios: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds the counts, base_failed, score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        table = shared.value

        def work(texts: list[str]) -> list[pa.Array]:
            counts, scores = [], []
            for t in texts:
                raw = t.encode()
                words = raw.split()
                h = word_hashes(words)
                counts.append(rule_counts(t, raw, words, h))
                scores.append(float(table[buckets(h)].mean()) if words else 0.0)
            columns = zip(*counts, strict=True) if counts else [[]] * 5
            return [*(pa.array(c, pa.int64()) for c in columns), pa.array(scores, pa.float64())]

        return work

    scored = map_texts(docs, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double", text)
    failed = (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with their rule counts, score and verdict; see the module."""
    ratios = log_ratios(ngram_counts(docs, trusted_ids(labels)))
    return score_rules(docs, ratios, threshold=threshold)
