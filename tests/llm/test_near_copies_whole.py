"""Buckets of near copies are compared whole, also where their first hubs are like none."""

import hashlib

from mosaiq.llm import near_copies
from pyspark.sql import functions as F


def test_bucket_whose_hubs_find_nothing(spark, monkeypatch):
    """All texts share one bucket only; a and b are alike, and the hubs that come first are like none of the others."""
    word = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [word(k, 60) for k in range(6)]
    pair = word(10, 60)  # its digests come after those of three others, which are hubs first
    rows = [*texts, pair, pair + " more"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    given = near_copies.sketched

    def in_one_bucket(df, text):
        return given(df, text).withColumn("bands", F.array(F.lit(7).cast("long"))).withColumn("fp", F.xxhash64("node"))

    monkeypatch.setattr(near_copies, "sketched", in_one_bucket)
    monkeypatch.setattr(near_copies, "linked", lambda prints: prints.limit(0).select("fp", F.col("fp").alias("root")))
    assert near_copies.groups(docs).count() == 2
    alike = near_copies.groups(docs).select("root").distinct().count()
    assert alike == 1


def test_pairs_of_a_large_bucket_grow_with_its_texts(spark, monkeypatch):
    """One bucket of copies of one text: some are like each other, the others like none, which few comparisons show."""
    base = [f"base{i}" for i in range(100)]

    def copy(k, edits):
        words = list(base)
        for e in range(edits):
            words[(7 * k + 13 * e) % 100] = f"own{k}x{e}"
        return " ".join(words)

    near = [copy(k, 1) for k in range(30)]
    far = [copy(k, 6) for k in range(30, 150)]
    pair = copy(200, 12)
    rows = [*near, *far, pair, pair + " more"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    given, verified, pairs = near_copies.sketched, near_copies.verified, []

    def in_one_bucket(df, text):
        return given(df, text).withColumn("bands", F.array(F.lit(7).cast("long"))).withColumn("fp", F.xxhash64("node"))

    def counted(asked, sets, similarity):
        pairs.append(asked.count())
        return verified(asked, sets, similarity)

    monkeypatch.setattr(near_copies, "sketched", in_one_bucket)
    monkeypatch.setattr(near_copies, "linked", lambda prints: prints.limit(0).select("fp", F.col("fp").alias("root")))
    monkeypatch.setattr(near_copies, "verified", counted)
    found = {r["node"]: r["root"] for r in near_copies.groups(docs).collect()}
    sets = [set(near_copies.shingle_hashes(t, 5).tolist()) for t in rows]
    like = {(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    nodes = [hashlib.md5(t.encode()).hexdigest() for t in rows]
    assert set(found) == {nodes[k] for ij in like for k in ij}
    assert all(found[nodes[i]] == found[nodes[j]] for i, j in like) and len(set(found.values())) == 2
    assert sum(pairs) < 3 * len(rows)
