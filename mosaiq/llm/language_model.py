"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lower-cased, between white space) and one end. Each word is a few binary decisions: a path
in a Huffman tree over the frequent words of the training documents; others take the path of an escape, then a path in
a tree over bytes for each byte and for the word's stop. So every text has a code, and log10 of its probability is the
sum over its decisions; `bits_per_byte` sets that against the bytes of words and separators.

For each decision three predictors give a probability: the place in the tree alone (exact counts), and that place hashed
with the word before, and with the second before (within bytes: the two and the three bytes before). Their counts come from all training documents: each task adds up tables of a fixed size, and their sums become
one byte a slot. A mixer adds the predictors' log-odds with weights that the code's level and the predictors' evidence
gate, and learns from each decision; an adaptive table then refines the mixed probability by how such probabilities came
true before. Both start anew every `LANE` symbols of a text, so a batch is computed side by side, step by step, and a
score depends on its own text and the training documents only. What is sent to tasks is bounded: `WORDS` words at most,
and 2**SLOT_BITS bytes a predictor.

The base score is an add-one unigram model. Counts of frequent words are sent to the tasks; the rest meets its counts
in a join, so the vocabulary may be of any size.

Null and empty texts are one end. A null id is the empty string where ids are hashed, and is trained on. Rows count as
often as they stand. Without training documents the base score is 0 and every predictor gives even odds. An empty table
gives no rows. Columns of the result's names are replaced.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, text_of

WORDS = 1 << 17
SLOT_BITS = 20
LANE = 512
#: Symbols after which the mixer learns.
TURN = 8
HASHED = 2
SEGMENT = 1 << 16
DECISIONS = 2_000_000
#: Weights of the mixer before it has learned, its rate, and the rate of the refining table.
START, RATE, REFINE_RATE = (0.55, 0.35, 0.25), 0.02, 0.02
STEPS = 24  # of the refining table, half a unit of log-odds each


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def token_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(token, n) of the words and ends ("") of docs; a task sends its counts on when it holds `most` words."""

    def batch_of(total: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array(list(total), type=pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), type=pa.int64())], names=["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total[b""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                total.update(tokens_of(text))
                if len(total) >= most:
                    yield batch_of(total)
                    total.clear()
        yield batch_of(total)

    return docs.select(text_of().alias("text")).mapInArrow(count, "token string, n long").where("n > 0").groupBy("token").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, words: int) -> int:
    """The least count, 2 or more, that `words` tokens at most reach; counts over 1,024 are taken in steps of a 64th octave."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384)
    found, least = 0, None
    for row in counts.where("n > 1").groupBy(step.alias("step")).agg(F.min("n").alias("n"), F.count("*").alias("tokens")).orderBy(F.desc("step")).collect():
        found += row["tokens"]
        if found > words:
            break
        least = row["n"]
    return least or 1 << 62


def huffman(weights: list[int]) -> np.ndarray:
    """parent * 2 + bit of each leaf and inner node; inner node k of the result is number len(weights) + k, the root is last."""
    up = np.zeros(2 * len(weights) - 1, dtype=np.int64)
    heap = [(w, k) for k, w in enumerate(weights)]
    heapify(heap)
    for node in range(len(weights), 2 * len(weights) - 1):
        (w, a), (x, b) = heappop(heap), heap[0]
        up[a], up[b] = 2 * node, 2 * node + 1
        heapreplace(heap, (w + x, node))
    return up


def paths(up: np.ndarray, first_node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each leaf's code: its length, and for all leaves together the inner nodes (from first_node) and bits, from the root."""
    leaves = (len(up) + 1) // 2
    up = up.astype(np.int32)
    at, ups = np.arange(leaves, dtype=np.int32), []
    while (alive := at < len(up) - 1).any():
        ups.append(np.where(alive, up[at], -1))
        at = np.where(alive, up[at] >> 1, len(up) - 1)
    table = np.array(ups[::-1]).T if ups else np.empty((leaves, 0), dtype=np.int64)
    used = table >= 0
    flat = table[used]
    return used.sum(1), ((flat >> 1) - leaves + first_node).astype(np.int32), (flat & 1).astype(np.uint8)


def log_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """In sixteenths, as one byte; no evidence is 0."""
    return np.clip(np.rint(16 * np.log((ones + 0.4) / (zeros + 0.4))), -127, 127).astype(np.int8)


class Code:
    """Codes of the frequent words, the escape, bytes and the stop, and the predictor that knows the place alone."""

    def __init__(self, words: list[bytes], word_counts: list[int], escapes: int, byte_counts: list[int]):
        self.known = {w: k for k, w in enumerate(words)}
        self.escape, self.byte, self.stop = len(words), len(words) + 1, len(words) + 257
        leaves = [[*word_counts, escapes], byte_counts]
        sizes, nodes, bits, odds = [], [], [], []
        for weights, first in zip(leaves, (0, len(words)), strict=True):
            up = huffman(weights)
            for to, made in zip((sizes, nodes, bits), paths(up, first), strict=True):
                to.append(made)
            sums, sides = np.zeros(len(up)), np.zeros((len(up), 2))
            sums[: len(weights)] = weights
            for k in range(len(up) - 1):
                sums[up[k] >> 1] += sums[k]
                sides[up[k] >> 1, up[k] & 1] = sums[k]
            inner = sides[len(weights) :]
            odds.append(log_odds(inner[:, 1], inner[:, 0]))
        self.sizes = np.concatenate(sizes).astype(np.int32)
        self.offsets = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.nodes, self.bits, self.odds = np.concatenate(nodes), np.concatenate(bits), np.concatenate(odds)
        self.byte_node = len(words)
        self.counts = [*word_counts, 0]


class Sent:
    """A value sent to all tasks, and what they make of it: once for each Python worker, as long as no other of its kind comes."""

    made: dict[str, tuple[str, object]] = {}

    def __init__(self, spark: SparkSession, kind: str, value: object):
        self.kind, self.name, self.value = kind, uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def get(self, make: Callable):
        name, made = Sent.made.get(self.kind, (None, None))
        if name != self.name:
            made = make(self.value.value)
            Sent.made[self.kind] = (self.name, made)
        return made


class Symbols:
    """The symbols of a batch of texts, and the hashes of the two contexts of each."""

    def __init__(self, code: Code, texts: list[str]):
        numbers, self.lengths, self.rare = [], [], []
        for text in texts:
            words = tokens_of(text)
            found = np.fromiter(map(code.known.get, words, [-1] * len(words)), dtype=np.int32, count=len(words))
            self.rare.append([words[k] for k in np.flatnonzero(found < 0)])
            numbers.append(found)
            numbers.append(np.array([code.known.get(b"", -1)], dtype=np.int32))
            self.lengths.append(len(words) + 1)
        token = np.concatenate(numbers) if numbers else np.empty(0, dtype=np.int32)
        rare = [w for ws, n in zip(self.rare, self.lengths, strict=True) for w in (*ws, *([b""] if b"" not in code.known else []))]
        self.token, is_rare = token, token < 0
        rare_size = np.fromiter(map(len, rare), dtype=np.int64, count=len(rare))
        sizes = np.ones(len(token), dtype=np.int64)
        sizes[is_rare] = rare_size + 2
        ends = np.cumsum(sizes)
        begins = ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        symbol = np.empty(total, dtype=np.int32)
        symbol[begins] = np.where(is_rare, code.escape, token)
        symbol[ends[is_rare] - 1] = code.stop
        letters = np.frombuffer(b"".join(rare), dtype=np.uint8)
        at = np.repeat(begins[is_rare] + 1 - (np.cumsum(rare_size) - rare_size), rare_size) + np.arange(len(letters))
        symbol[at] = code.byte + letters.astype(np.int32)
        self.symbol = symbol
        # contexts: of words the tokens before in the same text, of bytes the symbols before in the same word
        mark = token.astype(np.uint32) + np.uint32(1)
        mark[is_rare] = np.fromiter(map(zlib.crc32, rare), dtype=np.uint32, count=len(rare)) | np.uint32(1 << 31)
        first = np.cumsum([0, *self.lengths])[:-1]
        place = np.arange(len(token)) - np.repeat(first, self.lengths) if len(token) else np.empty(0, dtype=np.int64)
        back = [np.where(place >= k, mark[np.maximum(np.arange(len(token)) - k, 0)], 0).astype(np.uint32) for k in (1, 2)]
        of_token = np.repeat(np.arange(len(token)), sizes)
        inside = (np.arange(total) - begins[of_token]).astype(np.int32)
        contexts = [mix32(back[0], 1)[of_token], mix32(back[1], 3)[of_token]]
        spelled = np.flatnonzero(inside)
        if len(spelled):
            before, known, near = np.zeros(len(spelled), dtype=np.uint32), inside[spelled], symbol.astype(np.uint32)
            for k in range(HASHED + 1):
                before = mix32(before ^ np.where(known > k + 1, near[spelled - (k + 1)], 0).astype(np.uint32), 11 + k)
                if k:
                    contexts[k - 1][spelled] = before
        self.contexts = contexts
        text_of_symbol = np.add.reduceat(sizes, first) if len(token) else np.empty(0, dtype=np.int64)
        self.symbols = text_of_symbol  # of each text

    def lanes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts, first symbols and numbers of symbols of the lanes."""
        count = -(-self.symbols // LANE)
        text = np.repeat(np.arange(len(count)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begins = np.repeat(np.cumsum(self.symbols) - self.symbols, count) + number * LANE
        return text, begins, np.minimum(LANE, np.repeat(self.symbols, count) - number * LANE)


def mix32(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    return x * np.uint32(0xC2B2AE35)


class Decisions:
    """The decisions of the given symbols: nodes, bits and slots of the hashed contexts."""

    def __init__(self, code: Code, symbols: Symbols, at: np.ndarray):
        symbol = symbols.symbol[at]
        size = code.sizes[symbol]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(code.offsets[symbol] - (ends - size), size)
        place += np.arange(total)
        self.node, self.bit, self.ends, self.size = np.take(code.nodes, place), np.take(code.bits, place), ends, size
        spread = self.node.astype(np.uint32)
        spread *= np.uint32(0x9E3779B1)
        self.slots = []
        for context in symbols.contexts:
            slot = np.repeat(context[at], size)
            slot ^= spread
            slot *= np.uint32(0x85EBCA6B)
            slot >>= np.uint32(32 - SLOT_BITS)
            self.slots.append(slot)


def groups(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive parts of about `most` at most in sum."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(begin, end)
        begin = end


def context_counts(docs: DataFrame, sent: Sent) -> DataFrame:
    """(segment, odds): log-odds of SEGMENT / 2 slots each, from the bits that the training documents have there."""
    slots = 1 << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.get(lambda value: Code(*value))
        total = np.zeros((HASHED, 2 * slots), dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in groups(np.array([len(t) + 8 for t in texts]), 2_000_000):
                symbols = Symbols(code, texts[part])
                for some in groups(code.sizes[symbols.symbol], DECISIONS):
                    found = Decisions(code, symbols, np.arange(some.start, some.stop))
                    for k, slot in enumerate(found.slots):
                        slot <<= np.uint32(1)
                        slot |= found.bit
                        total[k] += np.bincount(slot.view(np.int32), minlength=2 * slots)
        names, columns = [], []
        for number, part in enumerate(total.reshape(-1, SEGMENT)):
            at = np.flatnonzero(part)
            if len(at):
                names.append(number)
                columns.append(at.astype(np.uint16).tobytes() + part[at].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.int32()), pa.array(columns, type=pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            odds = log_odds(total[1::2].astype(float), total[::2].astype(float))
            return pa.RecordBatch.from_arrays([pa.array([now], type=pa.int32()), pa.array([odds.tobytes()], type=pa.binary())], names=["segment", "odds"])

        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if segment != now:
                    if now is not None:
                        yield out()
                    now, total = segment, np.zeros(SEGMENT, dtype=np.int64)
                n = len(counts) // 6
                total[np.frombuffer(counts, dtype=np.uint16, count=n)] += np.frombuffer(counts, dtype=np.uint32, offset=2 * n)
        if now is not None:
            yield out()

    counted = docs.select(text_of().alias("text")).mapInArrow(count, "segment int, counts binary")
    return counted.repartition("segment").sortWithinPartitions("segment").mapInArrow(add, "segment int, odds binary")


def mixed(odds: list[np.ndarray], row: np.ndarray, bit: np.ndarray, turns: np.ndarray, lanes: int) -> np.ndarray:
    """log2 of each lane's probability. odds: the predictors' bytes for each decision; row: lane * 8 + gate; turns: where each turn ends.

    Within a turn all decisions use what was learnt before it.
    """
    weights = [np.full(lanes * 8, w, dtype=np.float32) for w in START]
    steps = np.arange(-STEPS, STEPS + 1, dtype=np.float32) / 2
    width, hold = 2 * STEPS + 1, np.float32(1 / REFINE_RATE)
    refine = np.tile(1 / (1 + np.exp(-steps)), lanes).astype(np.float32)
    total, begin = np.zeros(lanes), 0
    for end in turns:
        at, truth = row[begin:end], bit[begin:end].astype(np.float32)
        xs = [o[begin:end] * np.float32(1 / 16) for o in odds]
        begin = end
        used = int(at.max()) + 1
        z = np.take(weights[0], at)
        z *= xs[0]
        for w, x in zip(weights[1:], xs[1:], strict=True):
            part = np.take(w, at)
            part *= x
            z += part
        np.clip(z, -11.5, 11.5, out=z)
        p = np.exp(-z)
        p += 1
        np.reciprocal(p, out=p)
        error = truth - p
        error *= np.float32(RATE)
        for w, x in zip(weights, xs, strict=True):
            x *= error
            w[:used] += np.bincount(at, weights=x, minlength=used)
        lane = at >> 3
        z *= 2
        z += STEPS + 0.5
        cell = z.astype(np.int64)
        cell += lane * width
        p += np.take(refine, cell)
        p *= np.float32(0.5)
        cells = ((used + 7) >> 3) * width
        seen, ones = np.bincount(cell, minlength=cells), np.bincount(cell, weights=truth, minlength=cells)
        refine[:cells] += (ones - seen * refine[:cells]) / (hold + seen)
        np.subtract(1, truth, out=truth)
        p -= truth
        np.abs(p, out=p)  # the probability of what came
        total[: (used + 7) >> 3] += np.bincount(lane, weights=np.log2(p), minlength=(used + 7) >> 3)
    return total


def text_scores(code: Code, tables: list[np.ndarray], texts: list[str]) -> tuple[Symbols, np.ndarray]:
    """The symbols, and log2 of each text's probability."""
    symbols = Symbols(code, texts)
    text, begins, sizes = symbols.lanes()
    decided = np.concatenate([[0], np.cumsum(code.sizes[symbols.symbol], dtype=np.int64)])
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(texts))
    for part in groups((decided[begins + sizes] - decided[begins])[order], DECISIONS):
        lane = order[part]
        size = sizes[lane]
        number = np.repeat(np.arange(len(lane)), size)
        place = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size)
        by_turn = np.argsort(place // TURN, kind="stable")
        number, place = number[by_turn], place[by_turn]
        found = Decisions(code, symbols, begins[lane][number] + place)
        turns = found.ends[np.searchsorted(place // TURN, np.arange(1, -(-int(size[0]) // TURN) + 1)) - 1]
        odds = [np.take(code.odds, found.node), *[np.take(t, slot.astype(np.int64)) for t, slot in zip(tables, found.slots, strict=True)]]
        row = np.repeat(number * 8 + 4 * (symbols.symbol[begins[lane][number] + place] > code.escape), found.size)
        row += (odds[2] != 0) * np.int8(2)
        row += odds[1] != 0
        np.add.at(out, text[lane], mixed(odds, row, found.bit, turns, len(lane)))
    return symbols, out


def model(train: DataFrame, words: int = WORDS) -> tuple[DataFrame, dict]:
    """The written counts of tokens, and what tasks need: the code, the tables, the numbers of tokens."""
    spark = train.sparkSession
    counts = cut(token_counts(train))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = whole["n"] or 0, whole["v"]
    least = least_count(counts, words)
    frequent = sorted((-r["n"], r["token"].encode()) for r in counts.where(F.col("n") >= least).collect())

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257, dtype=np.int64)
        for batch in batches:
            tokens, times = [t.encode() for t in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), dtype=np.int64)
            letters = np.frombuffer(b"".join(tokens), dtype=np.uint8)
            sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
            total[:256] += np.bincount(letters, weights=np.repeat(times, sizes), minlength=256).astype(np.int64)
            total[256] += times.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(257), type=pa.int32()), pa.array(total)], names=["byte", "n"])

    rare = counts.where(F.col("n") < least)
    of_bytes = {r["byte"]: r["n"] for r in rare.mapInArrow(bytes_of, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()}
    value = ([t for _, t in frequent], [-c for c, _ in frequent], 1 + of_bytes.get(256, 0), [1 + of_bytes.get(b, 0) for b in range(257)])
    code = Sent(spark, "code", value)
    tables = [bytearray(1 << SLOT_BITS) for _ in range(HASHED)]
    half = SEGMENT // 2
    for row in context_counts(train, code).toLocalIterator():
        k, at = divmod(row["segment"] * half, 1 << SLOT_BITS)
        tables[k][at : at + half] = row["odds"]
    return counts, {"code": code, "tables": Sent(spark, "tables", [bytes(t) for t in tables]), "n": n, "v": v, "least": least}


def score(docs: DataFrame, counts: DataFrame, fitted: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    carried = [c for c in docs.columns if c not in (*new, text)]
    row, rare = free_name(docs, "row"), free_name(docs, "rare")
    given = docs.select(*[F.col(f"`{c}`") for c in carried], F.monotonically_increasing_id().alias(row), text_of(text).alias(free_name(docs, "given")))
    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType())]
    shape = T.StructType([*given.schema[:-1], *[T.StructField(n, t) for n, t in fields], T.StructField(rare, T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("k", T.LongType())])))])
    sent_code, sent_tables, smoothed, names = fitted["code"], fitted["tables"], fitted["n"] + fitted["v"] + 1, shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables = sent_code.get(lambda value: Code(*value)), sent_tables.get(lambda value: [np.frombuffer(x, dtype=np.int8) for x in value])
        logs = np.array([math.log10((c + 1) / smoothed) for c in code.counts[:-1]] + [0.0])
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for part in groups(np.array([len(t) + 8 for t in texts]), 4_000_000):
                some = texts[part]
                symbols, bits = text_scores(code, tables, some)
                first = np.cumsum([0, *symbols.lengths])[:-1]
                base = np.add.reduceat(logs[symbols.token], first) if some else []
                known = np.add.reduceat((symbols.token >= 0).astype(np.int64), first) if some else []
                others = [list(Counter([*ws, b""] if b"" not in code.known else ws).items()) for ws in symbols.rare]
                size = np.array([len(b" ".join(tokens_of(t))) + 1 for t in some])
                structs = pa.StructArray.from_arrays([pa.array([w.decode() for ws in others for w, _ in ws], type=pa.string()), pa.array([k for ws in others for _, k in ws], type=pa.int64())], names=["token", "k"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, others)]), type=pa.int32()), structs)
                columns = [pa.array(symbols.lengths, type=pa.int64()), pa.array(known, type=pa.int64()), pa.array(base, type=pa.float64()), pa.array(bits * math.log10(2)), pa.array(-bits / size), lists]
                own = batch.slice(part.start, part.stop - part.start).columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=names)

    stored = cut(given.mapInArrow(run, shape))
    seen = stored.select(F.col(row).alias("row"), F.explode(rare).alias("x")).select("row", F.col("x.token").alias("token"), F.col("x.k").alias("k"))
    met = seen.join(counts.where(F.col("n") < fitted["least"]), "token", "left")
    at, known, base = (free_name(stored, f"more_{c}") for c in ("row", "known", "base"))
    more = met.groupBy(F.col("row").alias(at)).agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias(known), F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(smoothed)))).alias(base))
    both = stored.drop(rare).join(more, F.col(row) == F.col(at), "left")
    return both.select(
        *[F.col(f"`{c}`") for c in carried], "n_tokens", (F.col("n_known") + F.coalesce(known, F.lit(0))).alias("n_known"), F.lit(fitted["n"]).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce(base, F.lit(0.0))).alias("base_score"), "score", "bits_per_byte",
    )


def scored_by_held_out(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """All docs with held_out and their scores; the model is trained on those that are not held out."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held
    counts, fitted = model(docs.where(~out))
    return score(docs.withColumn("held_out", out), counts, fitted)
