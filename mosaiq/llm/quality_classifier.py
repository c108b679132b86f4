"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. All that
expectation-maximisation needs is how often each pattern of votes occurs, which has
at most 3 to the number of labellers rows however many documents there are; it
gives each labeller's accuracy and each pattern's probability of being good. These
probabilities are the labels of a linear scorer over hashed words and word shapes,
fitted on about fit_most different texts, or fewer so that they have about FIT_WORDS words
together, taken by a hash of the text: that is what comes to the driver. Every document
is then scored.

One labeller looks for toxic wording: words of a short fixed list, and, where labels
are given, words and beginnings of words that are TERM_RATIO times as frequent among
toxic documents as among others. These terms are counted over about fit_most labelled
documents taken by a hash of the id; at most TERMS_MOST of them, the most frequent,
are sent to the tasks. Without labels no word counts as toxic, and toxic
prose is kept like other prose. A document votes bad at TOXIC_LEAST such words or more that
are TOXIC_RATE or more of its words; a single mild word doesn't.

Defined results: null or empty text has no features, gets the score of the
intercept and is rejected (no words); repeated rows get equal scores; rows are
never dropped by the operator itself.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_parts, map_arrow, map_texts, text_of

BUCKETS, WORDS_KEPT = 1 << 16, 200_000
FIT_MOST, FIT_WORDS, ROUNDS, KEEP = 8_000, 4_000_000, 80, 0.5

# Common function words of the languages at hand.
COMMON = frozenset(w.encode() for w in "the of and to in is that it for was on with as be by this are from or le la les de des du et en un une que qui pour dans par sur au der die das und ist von zu mit den im für auf el los las y se por con una su al del lo".split())
SYMBOLS, CAPITALS = b"#*$%&|<>", bytes(range(65, 91))
LABELLERS = ("symbols", "capitals", "exclamations", "neighbours", "distinct", "lines", "shapes", "common", "toxic")
#: Rates of the votes bad, none and good on bad and on good documents, before anything is seen.
BELIEFS = {"": ((0.3, 0.695, 0.005), (0.005, 0.99, 0.005)), "common": ((0.15, 0.3, 0.55), (0.02, 0.13, 0.85)), "toxic": ((0.3, 0.6998, 0.0002), (0.0002, 0.9996, 0.0002))}
#: Labellers whose rates stay at their beliefs: toxic prose is else like good prose, so the others' votes would overrule this one.
PINNED = np.array([name == "toxic" for name in LABELLERS])
#: Bits of a word's packed features beside its two buckets.
IS_COMMON, IS_ODD, IS_TOXIC = 1, 2, 4
FORM = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
RUN = re.compile(rb"(.)\1+", re.DOTALL)
ODD = re.compile(rb"[^aA9.,;:!?'\"()/@=+_-]")
EDGES = b".,;:!?"
# Insults in the languages at hand; the rule for terms from labels; and how many words make a document toxic.
TOXIC = frozenset("idiot idiots moron morons stupid worthless pathetic scum loser losers trash clown disgusting imbecile retard bastard connard connasse salope ordure crétin abruti débile enculé arschloch vollidiot trottel dummkopf schwachkopf abschaum wichser idiota idiotas imbécil estúpido estúpida gilipollas cabrón pendejo escoria".split())
PARTS = re.compile(r"\w+")
PREFIXES, TERM_LEAST, TERM_RATIO, TERMS_MOST = range(3, 8), 4, 20.0, 5_000
TOXIC_LEAST, TOXIC_RATE = 2, 0.005
TOXIC_BUCKET = 1


def hash_bound(n: float, most: float) -> int | None:
    """Below this number are the 64-bit hashes of about most of n things; None: of all."""
    return None if most >= n else int(most / n * 2.0**64) - (1 << 63)


def below(hashed: Column, bound: int | None) -> Column:
    return F.lit(True) if bound is None else hashed < F.lit(bound)


def shape(form: bytes) -> bytes:
    """Of a word's characters by FORM (letters as a or A, digits as 9, others as they are): repeats once, an exclamation mark twice."""
    return RUN.sub(lambda m: b"!!" if m[1] == b"!" else m[1], form)


def read_shape(form: bytes) -> int:
    form = shape(form)
    odd = bool(ODD.search(form)) or b"!!" in form
    return xxhash.xxh32_intdigest(b"\0" + form) % BUCKETS << 3 | IS_ODD * odd


SHAPES = Memo(read_shape, 50_000)


def terms_in(word: str) -> set[str]:
    """The word's parts in lower case, and their beginnings with a star."""
    parts = PARTS.findall(word.lower())
    return {*parts, *(p[:k] + "*" for p in parts for k in PREFIXES if len(p) > k)}


def has_term(parts: list[str], terms: frozenset[str], heads: frozenset[str]) -> bool:
    """Whether terms_in of a word of these parts meets terms; heads: the first letters of those with a star."""
    for p in parts:
        if p in terms or (p[: PREFIXES[0]] in heads and any(p[:k] + "*" in terms for k in PREFIXES if len(p) > k)):
            return True
    return False


def word_reader(terms: frozenset[str] = frozenset()) -> Memo:
    """Numbers of words: the word's bucket, its shape's bucket and three flags."""
    heads = frozenset(t[: PREFIXES[0]] for t in terms if t.endswith("*"))

    def read_word(raw: bytes) -> int:
        core = raw.strip(EDGES).lower()
        parts = [core.decode()] if core.isalpha() else PARTS.findall(raw.decode("utf-8", "replace").lower())  # of bytes, isalpha knows A-Z only
        return xxhash.xxh32_intdigest(raw) % BUCKETS << 19 | SHAPES[raw.translate(FORM)] | IS_COMMON * (core in COMMON) | IS_TOXIC * has_term(parts, terms, heads)

    return Memo(read_word, WORDS_KEPT)


def packed_words(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))


def buckets_of(packed: np.ndarray) -> np.ndarray:
    """The scorer's features: words, shapes, one bucket for each word that repeats the one before, and one for half the words of toxic texts."""
    again = np.count_nonzero(packed[1:] == packed[:-1])
    toxic = np.full(len(packed) // 2 if is_toxic(packed) else 0, TOXIC_BUCKET, np.int64)
    return np.concatenate([packed >> 19, packed >> 3 & (BUCKETS - 1), np.zeros(again, np.int64), toxic])


def is_toxic(packed: np.ndarray) -> bool:
    n = np.count_nonzero(packed & IS_TOXIC)
    return bool(n >= TOXIC_LEAST and n >= TOXIC_RATE * len(packed))


def toxic_terms(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_most: int = FIT_MOST) -> frozenset[str]:
    """The fixed words and the terms that tell documents labelled toxic from others; see the module."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__labelled")).agg((F.max("toxic") > 0).alias("toxic"))
    known = known.where(below(F.xxhash64("__labelled"), hash_bound(known.count(), fit_most)))
    met = docs.select(F.col(doc_id).alias("__id"), text_of(text).alias("text")).join(known, F.col("__id") == F.col("__labelled")).select("text", "toxic")

    def run(batches):
        seen: Counter[tuple[str, bool]] = Counter()
        memo = Memo(terms_in, 50_000)
        for batch in in_parts(batches):
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((x, toxic) for x in {"", *(x for w in set(t.split()) for x in memo[w])})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["term", "toxic", "n"])

    counted = map_arrow(met, run, "term string, toxic boolean, n long").groupBy("term").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in (("bad", F.col("toxic")), ("rest", ~F.col("toxic")))])
    counted = counted.where(F.col("bad") >= TERM_LEAST).persist()
    total = counted.where("term = ''").first()
    if total is None:
        return TOXIC
    rare = F.col("bad") / F.lit(float(total["bad"])) >= TERM_RATIO * (F.col("rest") + 0.5) / F.lit(max(1.0, float(total["rest"])))
    found = counted.where((F.col("term") != "") & rare).orderBy(F.desc("bad"), "term").limit(TERMS_MOST).collect()
    counted.unpersist()
    return TOXIC.union(r["term"] for r in found)


def votes(raw: bytes, words: list[bytes], packed: np.ndarray) -> list[int]:
    """Per labeller 1 for good, -1 for bad, 0 for neither, in the order of LABELLERS; most know only what is bad."""
    n = len(packed)
    if not n:
        return [0] * len(LABELLERS)
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    letters = max(1, len(raw) - gone(b" \n\t.,;:!?0123456789" + SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    common = np.count_nonzero(packed & IS_COMMON) / n
    return [
        -(gone(SYMBOLS) / n >= 0.2),
        -(gone(CAPITALS) / letters >= 0.4 and n >= 4),
        -(raw.count(b"!") / n >= 0.3),
        -int(np.count_nonzero(packed[1:] == packed[:-1]) / n >= 0.15),
        -(n >= 12 and len(set(words)) / n < max(0.12, 0.45 - n / 4000)),
        -(len(lines) > 2 and 1 - len(set(lines)) / len(lines) >= 0.34),
        -int(np.count_nonzero(packed & IS_ODD) / n >= 0.2),
        (1 if common >= 0.12 else -1 if common < 0.02 else 0) if n >= 25 else 0,
        -is_toxic(packed),
    ]


def vote_patterns(docs: DataFrame, text: str = "text", terms: frozenset[str] = frozenset()) -> DataFrame:
    """Adds pattern, the labellers' votes as digits in base 3 (vote + 1, the first lowest), and n_words."""

    def make():
        memo = word_reader(terms)
        base = 3 ** np.arange(len(LABELLERS))

        def work(texts: list[str]) -> list[pa.Array]:
            out, sizes = [], []
            for t in texts:
                raw = t.encode()
                words = raw.split()
                out.append(int((np.array(votes(raw, words, packed_words(words, memo))) + 1) @ base))
                sizes.append(len(words))
            return [pa.array(out, pa.int32()), pa.array(sizes, pa.int64())]

        return work

    return map_texts(docs, make, "pattern int, n_words long", text)


def label_model(counts: dict[int, int], rounds: int = 200, trust: float = 0.3) -> tuple[dict[int, float], np.ndarray]:
    """Each pattern's probability of good, and per class and labeller the rates of its votes (bad, none, good), by expectation-maximisation.

    The rates are drawn towards BELIEFS with the weight of a share (trust) of all
    documents: most labellers fire seldom and are alike in staying silent, which the
    model would else take for independent evidence. It starts from the number of bad
    votes, which also settles which class is good.
    """
    patterns = np.array(sorted(counts), dtype=np.int64)
    beliefs = np.array([[BELIEFS.get(name, BELIEFS[""])[y] for name in LABELLERS] for y in (0, 1)])
    if not len(patterns):
        return {}, beliefs
    weight = np.array([counts[p] for p in patterns.tolist()], dtype=float)
    digits = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = np.array([0.95, 0.2, 0.05])[np.minimum(2, (digits == 0).sum(axis=1))]
    for _ in range(rounds):
        rates = beliefs * trust * weight.sum()
        for y, share in enumerate((1 - good, good)):
            for v in range(3):
                rates[y, :, v] += ((weight * share)[:, None] * (digits == v)).sum(axis=0)
            rates[y] /= rates[y].sum(axis=1, keepdims=True)
            rates[y][PINNED] = beliefs[y][PINNED]
        prior = np.clip((weight * good).sum() / weight.sum(), 0.05, 0.95)
        logs = [np.log(p) + np.log(rates[y][np.arange(len(LABELLERS)), digits]).sum(axis=1) for y, p in enumerate((1 - prior, prior))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done = np.abs(new - good).max() < 1e-6
        good = new
        if done:
            break
    return dict(zip(patterns.tolist(), good.tolist(), strict=True)), rates


def fit(features: list[np.ndarray], target: np.ndarray, rounds: int = ROUNDS, rate: float = 1.0, decay: float = 1e-7) -> tuple[np.ndarray, float]:
    """Weights of the buckets and an intercept: logistic loss on soft labels, both classes weighing the same, by adaptive gradients."""
    weights, intercept = np.zeros(BUCKETS), 0.0
    if not len(features):
        return weights, intercept
    balance = np.where(target >= 0.5, 0.5 / max((target >= 0.5).mean(), 1e-3), 0.5 / max((target < 0.5).mean(), 1e-3))
    blocks = []  # of some documents each, so that what a round computes stays small
    for at in range(0, len(features), 256):
        part = features[at : at + 256]
        sizes = np.array([max(1, len(f)) for f in part])
        flat = np.concatenate([f if len(f) else np.zeros(1, np.uint16) for f in part]).astype(np.uint16)
        blocks.append((flat, sizes, target[at : at + 256], balance[at : at + 256]))
    seen, seen0 = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        step, step0 = decay * weights, 0.0
        for flat, sizes, wanted, weight in blocks:
            row = np.repeat(np.arange(len(sizes)), sizes)
            z = np.bincount(row, weights[flat], minlength=len(sizes)) / sizes + intercept
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - wanted) * weight / len(features)
            step += np.bincount(flat, (error / sizes)[row], minlength=BUCKETS)
            step0 += error.sum()
        seen += step**2
        weights -= rate * step / np.sqrt(seen)
        seen0 += step0**2
        intercept -= 0.2 * step0 / np.sqrt(seen0)
    return weights, intercept


def train(docs: DataFrame, text: str = "text", fit_most: int = FIT_MOST, terms: frozenset[str] = frozenset()) -> tuple[np.ndarray, float, np.ndarray]:
    """The scorer's weights and intercept, and the labellers' rates."""
    voted = vote_patterns(docs.select(text_of(text).alias("text")), "text", terms)
    different = F.approx_count_distinct(F.xxhash64("text"))  # a sketch of fixed size in each task
    met = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"), F.sum("n_words").alias("words"), different.alias("texts")).collect()
    good, rates = label_model({r["pattern"]: r["count"] for r in met})
    texts = sum(r["texts"] for r in met)
    a_text = max(1.0, sum(r["words"] for r in met) / max(1, sum(r["count"] for r in met)))
    bound = hash_bound(texts, min(fit_most, FIT_WORDS / a_text))
    sample = docs.select(text_of(text).alias("text")).where(below(F.xxhash64("text"), bound)).distinct()

    def run(batches):
        memo = word_reader(terms)
        base = 3 ** np.arange(len(LABELLERS))
        for batch in in_parts(batches):
            patterns, found = [], []
            for t in batch.column(0).to_pylist():
                raw = t.encode()
                words = raw.split()
                packed = packed_words(words, memo)
                patterns.append(int((np.array(votes(raw, words, packed)) + 1) @ base))
                found.append(buckets_of(packed).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.int32()), pa.array(found, pa.binary())], names=["pattern", "features"])

    rows = map_arrow(sample, run, "pattern int, features binary").collect()
    features = [np.frombuffer(r["features"], dtype=np.uint16) for r in rows]
    weights, intercept = fit(features, np.array([good.get(r["pattern"], 0.5) for r in rows]))
    return weights, intercept, rates


def scored(docs: DataFrame, weights: np.ndarray, intercept: float, text: str = "text", keep: float = KEEP, terms: frozenset[str] = frozenset()) -> DataFrame:
    """Adds quality (the probability of good) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        memo, w = word_reader(terms), shared.value

        def work(texts: list[str]) -> list[pa.Array]:
            out, kept = [], []
            for t in texts:
                packed = packed_words(t.encode().split(), memo)
                z = intercept + (float(w[buckets_of(packed)].mean()) if len(packed) else 0.0)
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
                kept.append(bool(len(packed)) and out[-1] >= keep)
            return [pa.array(out, pa.float64()), pa.array(kept, pa.bool_())]

        return work

    return map_texts(docs, make, "quality double, kept boolean", text)


def classify(docs: DataFrame, text: str = "text", fit_most: int = FIT_MOST, keep: float = KEEP, labels: DataFrame | None = None) -> DataFrame:
    """docs with quality and kept; see the module. Toxic wording is looked for where labels (doc_id, toxic) are given."""
    terms = frozenset() if labels is None else toxic_terms(docs, labels, text=text, fit_most=fit_most)
    weights, intercept, _ = train(docs, text, fit_most, terms)
    return scored(docs, weights, intercept, text, keep, terms)
