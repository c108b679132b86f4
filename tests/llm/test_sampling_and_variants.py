"""Importance resampling and spelling variants against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import importance_sampling, spelling_variants

from . import brute_more
from .test_operators import SCHEMA, rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", "s", "i", "sh", "sp", "tt") for i, t in rows()], SCHEMA).repartition(3)


def test_importance_scores_and_ranks(spark, docs):
    rng = random.Random(21)
    words = ["alpha", "Beta", "gamma", "x1", "éclair", "日本", "delta", "the"]
    given = rows() + [(1000 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(15, 40)))) for k in range(300)]
    target = ["alpha beta the", "The éclair", None, ""]
    for ngrams in (1, 2):
        want, drawn = brute_more.importance(given, target, ngrams=ngrams)
        df = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
        table = importance_sampling.gains(spark.createDataFrame([(t,) for t in target], "text string"), df, ngrams=ngrams)
        for block in (importance_sampling.BLOCK, 3):
            got = importance_sampling.draw(importance_sampling.scored(df, table, ngrams=ngrams).drop("text"), block=block).collect()
            assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == sorted(want)
            ranked = sorted((r["rank"], r["doc_id"]) for r in got if r["rank"] is not None)
            assert ranked == [(k + 1, r[0]) for k, r in enumerate(drawn)]


def test_draw_with_one_score_one_id_and_nulls(spark):
    """Blocks are cut within a score, and within an id; every row comes out once and ranks have no gaps."""
    data = [(7, 30, 5)] * 400 + [(None, 30, 5)] * 150 + [(k, 30, 5) for k in range(200)] + [(k, 30, k % 3) for k in range(200, 260)] + [(1, 10, 9), (2, None, 9), (3, 30, None)]
    df = spark.createDataFrame(data, "doc_id long, n_features long, score long").withColumns({"salt": F.lit("own"), "block": F.lit(1), "chunk": F.lit(2), "id": F.lit("x"), "rank": F.lit(-1)}).repartition(6)
    got = importance_sampling.draw(df, percent=90, block=20).collect()
    assert sorted(map(str, [(r["doc_id"], r["n_features"], r["score"]) for r in got])) == sorted(map(str, data)) and {r["salt"] for r in got} == {"own"}
    order = lambda r: (-r[2], float("inf") if r[0] is None else r[0])
    fit = sorted((r for r in data if r[1] == 30 and r[2] is not None), key=order)
    ranked = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"] is not None and r["doc_id"] is not None)
    want = [(k + 1, r[0], r[2]) for k, r in enumerate(fit[: len(fit) * 90 // 100])]
    assert ranked == [x for x in want if x[1] is not None]
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(want) + 1))


def test_tournament_merges_runs():
    rng = random.Random(4)
    runs = [sorted((rng.randrange(50), k, j) for j in range(rng.randrange(1, 9))) for k in range(37)]
    tree, at, out = importance_sampling.Tournament(), {}, []
    for k, run in enumerate(runs):
        at[tree.open(run[0])] = (k, 0)
    while (leaf := tree.winner()) is not None:
        k, j = at[leaf]
        out.append(runs[k][j])
        at[leaf] = (k, j + 1)
        tree.put(leaf, runs[k][j + 1] if j + 1 < len(runs[k]) else None)
    assert out == sorted(x for run in runs for x in run)


def test_importance_of_empty_tables(spark, docs):
    nothing = docs.limit(0)
    table = importance_sampling.gains(nothing, nothing)
    assert (table == 0).all()
    assert importance_sampling.draw(importance_sampling.scored(nothing, table).drop("text")).count() == 0
    got = importance_sampling.draw(importance_sampling.scored(docs, table).drop("text"), least=10**9).collect()
    assert len(got) == len(rows()) and all(r["rank"] is None and r["kept"] == "k" for r in got)


def spelled(rng, n):
    """Words of few letters with many neighbours, some long, some beyond ASCII."""
    heads = ["inter", "tion", "àéîß", "Abcde", "w" * 70]
    out = []
    for _ in range(n):
        w = rng.choice(heads) + "".join(rng.choice("abÿ") for _ in range(rng.randrange(0, 6)))
        out.append(w if rng.random() < 0.5 else w[::-1])
    return out


@pytest.mark.parametrize("settings", [{}, {"shard_letters": 50, "crowd": 0}, {"shard_letters": 200, "hot": 3}, {"hot": 0, "crowd": 10**9}])
def test_spelling_variants(spark, settings):
    rng = random.Random(5)
    texts = [(k, " ".join(spelled(rng, 40)) + " 12,x_y") for k in range(60)] + rows()
    counts = brute_more.thinned_words(texts, modulus=7)
    want = brute_more.variants(counts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = spelling_variants.spelling_variants(df, thinned=7, **settings)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == want
    assert any(r[0] for r in want.values()) and any(r[1] != r[0] and r[0] for r in want.values())
    assert spelling_variants.spelling_variants(df.limit(0)).count() == 0


def test_counts_are_sent_on(spark):
    texts = [(k, t) for k, t in rows() if k < 30]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r["word"]: r["n"] for r in spelling_variants.word_counts(df, most=3).collect()}
    assert got == brute_more.thinned_words(texts)


def test_forms_of_long_words_have_equal_keys():
    rng = random.Random(6)
    for size in (5, 63, 64, 65, 300):
        word = "".join(rng.choice("abcé") for _ in range(size))
        forms = spelling_variants.shorter_forms(word)
        assert set(forms) == {spelling_variants.whole_form(word[:k] + word[k + 1 :]) for k in range(size)}
    assert np.all([brute_more.near(a, b) == spelling_variants.one_edit(a, b) for a in ("abc", "abcd", "", "a", "xbc", "abcx", "aabc", "bc") for b in ("abc", "abcd", "", "a", "abd", "bcd", "acbd")])
