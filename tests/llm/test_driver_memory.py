"""What goes by way of the driver: tables are sent to all tasks where they are few rows, whatever Spark takes them for."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import common, near_copies, simhash

FEW = 100


@pytest.fixture
def most_sent(spark, monkeypatch):
    """A function for the most rows that a query since the test's begin has sent to all tasks."""
    monkeypatch.setattr(common, "FEW_ROWS", FEW, raising=False)
    store = spark._jsparkSession.sharedState().statusStore()
    items = lambda seq: [seq.apply(k) for k in range(seq.size())]
    before = store.executionsCount()

    def most() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        rows = [0]
        for run in items(store.executionsList())[before:]:
            values = store.executionMetrics(run.executionId())
            for node in items(store.planGraph(run.executionId()).allNodes()):
                if node.name() == "BroadcastExchange":
                    found = [values.get(m.accumulatorId()) for m in items(node.metrics()) if m.name() == "number of output rows"]
                    rows += [int(x.get().replace(",", "")) for x in found if x.isDefined()]
        return max(rows)

    return most


def test_fingerprints_are_not_sent(spark, most_sent):
    """Their index has a row for each partition, and their probes are dozens each."""
    fps = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 300)
    near = [int(fps[k]) ^ 5 for k in range(40)]
    nodes = common.cut(spark.createDataFrame([(int(fp), 1) for fp in [*fps, *near]], "fp long, n long"), compact=True)
    roots = {r["fp"]: r["root"] for r in simhash.linked(nodes).collect()}
    assert len(roots) == 80 and all(roots[int(fps[k])] == roots[near[k]] == min(int(fps[k]), near[k]) for k in range(40))
    assert 0 < most_sent() <= FEW


def test_edges_of_components_are_not_sent(spark, most_sent):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 1000, 2)] + [(k, k + 2) for k in range(0, 300, 2)], "a long, b long")
    labels = dict(simhash.component_labels(edges).collect())
    assert labels == {k: 0 if k <= 301 else k - k % 2 for k in range(1000)}
    assert most_sent() <= FEW


def test_shingles_and_pairs_are_not_sent(spark, most_sent):
    """Few texts with many shingles, and more pairs than texts."""
    words = [[f"w{k}x{i}" for i in range(60)] for k in range(60)]
    texts = [" ".join([*w[:i], f"own{c}", *w[i + 1 :]]) if c else " ".join(w) for w in words for c, i in ((0, 0), (1, 0), (2, 59))]
    rows = near_copies.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in rows.collect()) == list(range(0, 180, 3))
    assert 0 < most_sent() <= FEW


def test_large_buckets_are_not_sent(spark, most_sent, monkeypatch):
    """All texts share one bucket and meet by their shingles."""
    given = near_copies.sketched
    monkeypatch.setattr(near_copies, "sketched", lambda df, text: given(df, text).withColumn("bands", F.array(F.lit(7).cast("long"))))
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) + " more" * c for k in range(50) for c in (0, 1)]
    labels = near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert labels.count() == 100 and labels.select("root").distinct().count() == 50
    assert most_sent() <= FEW


def test_bitmap_comes_in_few_rows(spark, monkeypatch):
    got, frame = [], type(spark.range(0))
    for name in ("collect", "toPandas"):
        given = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda df, given=given: got.append(given(df)) or got[-1])
    hashes = np.random.default_rng(4).integers(-(1 << 63), (1 << 63) - 1, 20_000)
    bits = common.bitmap(spark.createDataFrame([(int(h),) for h in hashes], "hash long"))
    wanted = np.zeros(len(bits), np.uint64)
    place = hashes.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    np.bitwise_or.at(wanted, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    assert (bits == wanted).all() and len(bits) > 10_000
    assert sum(map(len, got)) <= FEW
    assert not common.bitmap(spark.createDataFrame([], "hash long")).any()
