"""The language model: base scores and mixing against plain versions, and held-out bits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import language_model as lm
from mosaiq.llm.queries import op13_language_model

from . import brute_more
from .test_operators import PROSE, SCHEMA, rows


@pytest.fixture(scope="module")
def given():
    rng = random.Random(31)
    words = (PROSE + " Übung straße 日本").split()
    out = rows() + [(1000 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for k in range(200)]
    return [*out, (None, "a text without an id"), (None, None), (7, PROSE)]


@pytest.mark.parametrize("words", [lm.WORDS, 5, 0])
def test_base_scores(spark, given, words, monkeypatch):
    """For any number of words that are sent to the tasks, down to none."""
    monkeypatch.setattr(lm.model, "__defaults__", (words,))
    df = spark.createDataFrame([(i, t, "k", "s", "i", "sh", "sp", "tt") for i, t in given], SCHEMA).withColumns({"row": F.lit(1), "rare": F.lit(2), "n_known": F.lit(3)}).repartition(3)
    got = lm.scored_by_held_out(df).collect()
    assert {r["row"] for r in got} == {1} and {r["kept"] for r in got} == {"k"}
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    want = sorted(((i, *x) for (i, _), x in zip(given, brute_more.unigrams(given), strict=True)), key=order)
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=order)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert np.allclose([w[5] for w in want], [h[5] for h in have], rtol=1e-12)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)


def test_empty_tables_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scored_by_held_out(none).count() == 0
    held = [i for i in range(300) if brute_more.zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm.scored_by_held_out(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert {(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(True, 3, 0, 0, 0.0)}


def code_of(texts):
    counts = brute_more.Counter(w for t in texts for w in [*lm.tokens_of(t), b""])
    known = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], w))
    rare = [w for w in counts if counts[w] == 1]
    letters = brute_more.Counter(b for w in rare for b in w)
    return lm.Code(known, [counts[w] for w in known], 1 + len(rare), [1 + letters[b] for b in range(256)] + [1 + len(rare)])


def plain_score(code, tables, text):
    """One decision after another; what is learnt in a turn counts from the next turn on."""
    s = lm.Symbols(code, [text])
    bits, total = 0.0, 0.0
    for begin in range(0, len(s.symbol), lm.LANE):
        weights = {}
        table = {}
        for turn in range(begin, min(begin + lm.LANE, len(s.symbol)), lm.TURN):
            learnt, seen = [], []
            for at in range(turn, min(turn + lm.TURN, begin + lm.LANE, len(s.symbol))):
                d = lm.Decisions(code, s, np.array([at]))
                for k, (node, bit) in enumerate(zip(d.node, d.bit, strict=True)):
                    odds = [code.odds[node], *[t[slot[k]] for t, slot in zip(tables, d.slots, strict=True)]]
                    x = [float(o) / 16 for o in odds]
                    gate = 4 * (s.symbol[at] > code.escape) + 2 * (odds[2] != 0) + (odds[1] != 0)
                    w = weights.setdefault(gate, list(lm.START))
                    z = min(11.5, max(-11.5, sum(a * b for a, b in zip(w, x, strict=True))))
                    p = 1 / (1 + math.exp(-z))
                    cell = int(2 * z + lm.STEPS + 0.5)
                    q = table.setdefault(cell, 1 / (1 + math.exp(-(cell - lm.STEPS) / 2)))
                    learnt.append((gate, [lm.RATE * (bit - p) * v for v in x]))
                    seen.append((cell, int(bit)))
                    mean = (p + q) / 2
                    total += math.log2(mean if bit else 1 - mean)
                    bits += 1
            for gate, step in learnt:
                weights[gate] = [a + b for a, b in zip(weights[gate], step, strict=True)]
            for cell in {c for c, _ in seen}:
                truths = [b for c, b in seen if c == cell]
                table[cell] += (sum(truths) - len(truths) * table[cell]) / (1 / lm.REFINE_RATE + len(truths))
    return total


def test_mixing_against_one_decision_after_another(monkeypatch):
    monkeypatch.setattr(lm, "LANE", 40)
    rng = random.Random(3)
    texts = ["", "a", " ".join(rng.choice(PROSE.lower().split()) for _ in range(70)), "Zzyzx ß 日本 " * 9 + "x" * 100, PROSE, PROSE]
    code = code_of(texts[:-1] + [PROSE.upper()])
    tables = [np.array([rng.randrange(-90, 90) * (rng.random() < 0.5) for _ in range(1 << lm.SLOT_BITS)], dtype=np.int8) for _ in range(lm.HASHED)]
    got = lm.text_scores(code, tables, texts)[1]
    assert np.allclose(got, [plain_score(code, tables, t) for t in texts], rtol=1e-4)
    monkeypatch.setattr(lm, "DECISIONS", 50)  # in many parts: the same
    assert np.allclose(got, lm.text_scores(code, tables, texts)[1], rtol=1e-6)


def test_codes_are_complete():
    """The words' and the bytes' codes fill their trees, so probabilities of all texts add up to one."""
    code = code_of([PROSE, PROSE, "rare words here"])
    for leaves in (range(code.escape + 1), range(code.byte, code.stop + 1)):
        assert math.isclose(sum(2.0 ** -code.sizes[k] for k in leaves), 1)
        paths = {tuple(code.bits[code.offsets[k] : code.offsets[k] + code.sizes[k]]) for k in leaves}
        assert len(paths) == len(leaves) and not any(p[:j] in paths for p in paths for j in range(len(p)))


def test_held_out_texts_cost_less_than_by_words_alone(spark, monkeypatch):
    """On the test table's held-out rows: mixing beats the code's own order-0 bits."""
    got = op13_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    monkeypatch.setattr(lm, "START", (1.0, 0.0, 0.0, 0.0))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    _, fitted = lm.model(docs.where(~held))
    code = lm.Code(*fitted["code"].value.value)
    alone = 0.0
    for r in docs.where(held).collect():
        s = lm.Symbols(code, [r["text"] or ""])
        d = lm.Decisions(code, s, np.arange(len(s.symbol)))
        p = 1 / (1 + np.exp(-code.odds[d.node] / 16.0))
        alone += np.log10(np.where(d.bit == 1, p, 1 - p)).sum()
    assert got[0] > 0.9 * alone and got[2] < 2.6
