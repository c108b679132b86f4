"""The pipeline's stages on a small table, each held against what its operator decides."""

import corpus_pipeline
from mosaiq.llm import secret_scan
from mosaiq.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    now = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}
        now = stage(spark, now, SF).cache()
        sizes.append(now.count())
        after = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert after <= set(before)
        if name != "sentencepiece":
            assert now.columns == docs.columns
        if name == "simhash near-dedup":
            given = sorted(before.items())
            group = dict(zip((i for i, _ in given), brute.similar_groups(given), strict=True))
            assert {group[i] for i in after} == set(group.values())
            assert len(after) - len(set(group.values())) <= 0.1 * (len(before) - len(set(group.values())))
        if name == "secret scans":
            assert sizes[-1] == sizes[-2]
            assert secret_scan.scan_secrets(now).where("size(secret_spans) > 0").count() == 0
    assert now.where("not round_trip").count() == 0
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] == sizes[5]


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality string"
    rows = [(1, None, None, None, None, "q"), (None, "Some words of prose that stand alone here.", "en", "a", 42, None), (2, "", "en", "b", 0, "q"), (3, "Some words of prose that stand alone here.", "en", "a", 42, "q"), (3, "Some words of prose that stand alone here.", "en", "a", 42, "q")]
    for given in (rows, []):
        now = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF).cache()
        assert [r["doc_id"] for r in now.collect()] == ([3] if given else [])


def test_registered():
    assert [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
