"""What Python workers hold: they serve many tasks, so a task's tables must not outlive it."""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa

from mosaiq.llm import sentencepiece_codec
from mosaiq.llm.common import Memo, map_texts
from mosaiq.llm.queries import tokenizer_path


def test_tables_of_the_codec_end_with_the_task(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(k, f"word{k} and, other{k}-words\n twice  spaced") for k in range(200)], "doc_id long, text string").repartition(4)
    assert sentencepiece_codec.encode_decode(docs, model).where("decoded = text").count() == 200

    def held(batches):
        for _ in batches:
            pass
        c = sentencepiece_codec.codec(model)
        yield pa.RecordBatch.from_arrays([pa.array([len(t) + len(t.before) for t in (c.words, c.short, c.compatible)], pa.int64())], names=["n"])

    assert {r["n"] for r in spark.range(0, 64, 1, 4).mapInArrow(held, "n long").collect()} == {0}


def test_tables_are_bounded_and_keep_frequent_keys():
    asked = []
    memo = Memo(lambda k: asked.append(k) or -k, 10)
    for k in range(1000):
        assert memo[k] == -k
        assert memo[-1] == 1
        assert len(memo) + len(memo.before) <= 10
    assert asked.count(-1) == 1


def test_few_texts_are_strings_at_a_time(spark):
    docs = spark.range(0, 5000, 1, 1).selectExpr("id", "cast(id as string) as text")

    def make():
        return lambda texts: [pa.array([len(texts)] * len(texts), pa.int32()), pa.array(texts, pa.string())]

    rows = map_texts(docs, make, "n int, same string").collect()
    assert len(rows) == 5000 and all(r["n"] <= 1000 and r["same"] == r["text"] == str(r["id"]) for r in rows)


def test_words_alone_and_among_others_have_the_library_s_ids():
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), sentencepiece_codec.codec(model)
    parts = ["word", "word,", ",word", "a-b", "\n", "  ", "▁", "x▁▁y", "l'été", "日本語", "\n\nword", "_under_", "w" * 80, "\t", "3.14%", "\U0001f600"]
    for sep in ("", " ", "  ", "\n", " \n "):
        for a in parts:
            for b in parts:
                text = a + sep + b
                assert own.encode(text).tolist() == library.encode(text), repr(text)


def test_workers_give_back_memory_after_a_task(spark):
    def held(batches):
        for _ in batches:
            pass
        kinds = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, kinds)) / 1024])], names=["mb"])

    def most():
        return max(r["mb"] for r in spark.range(0, 64, 1, 4).mapInArrow(held, "mb double").collect())

    def same(n):
        docs = spark.range(0, n, 1, 4).selectExpr("repeat(concat(cast(id as string), ' '), 4000) as text")
        copied = map_texts(docs, lambda: lambda texts: [pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], "n long, same string")
        return copied.where("same = text").count()

    assert same(40) == 40  # what workers import stays
    before = most()
    assert same(16_000) == 16_000
    assert most() < before + 25
