"""Repeated passages by FM-indexes, one a shard, and documents without them.

A window is a number of consecutive words. It is repeated if an equal one stands
earlier: in a row of a smaller doc_id, or before it in the same row. What repeats
within a row is settled where its text is read. For the rest, in each window the
m-gram of words with the smallest hash is its anchor; neighbouring windows with one
anchor make a segment. Equal windows have equal anchors, so segments are dealt by
anchor, and only anchors that occur again matter. Of equal segments those of the
smallest id stand for all, and the others are covered whole. The different segments
of an anchor may share windows: their words are indexed in the anchor's shard - a
suffix array sorted as deep as a window, its Burrows-Wheeler transform, and a wavelet
matrix with packed bits; of the suffix array only each suffix's document stays - and
every window is streamed through it by backward search. The matching statistic of
each place, up to a window's length, and the interval of suffixes come from that; a
window is repeated if its interval holds a smaller document.

Memory: rows are streamed in sorted order, indexes are built over at most about twice
CHUNK segments. Anchors with more than CHUNK different segments aren't indexed: their
single windows are grouped by a second hash to the smallest document, before the
shuffle as far as tasks can, and joined back, which splits a frequent window among
tasks. Texts are shuffled by row, never gathered.

Defined results: null or empty text has no words; a null doc_id counts as the largest
64-bit number; rows are told apart by id and text, so different texts under one id
(or none) are judged each by itself and are not earlier than each other, and rows
alike in both get the same result; rows are never dropped. Other columns stay;
columns named as the new ones are replaced. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut

WINDOW, GRAM = 20, 8
CHUNK, SPREAD = 60_000, 1024
LAST_ID = (1 << 63) - 1
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


class Rolling:
    """Hashes of runs of words, alike wherever they stand: sums of word hashes times powers, modulo 2 to the 64."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            factors = np.full(size, STEP, np.uint64)
            factors[0] = 1
            self.up = np.cumprod(factors, dtype=np.uint64)
            factors[1:] = BACK
            self.down = np.cumprod(factors, dtype=np.uint64)

    def sums(self, h: np.ndarray) -> np.ndarray:
        self._grow(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], dtype=np.uint64, out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def segments_of(h: np.ndarray, rolling: Rolling, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor, content hash, first word and number of windows of each segment of a text; h: its words' hashes."""
    n = len(h) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    sums = rolling.sums(h)
    at = np.arange(len(h) - gram + 1)
    grams = rolling.runs(sums, at, at + gram)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(first, n))
    return grams[least[first]], rolling.runs(sums, first, first + count + window - 1), first, count


def own_repeats(h: np.ndarray, rolling: Rolling, window: int) -> np.ndarray:
    """For each window of a text: does an equal one stand before it in the same text?"""
    n = len(h) - window + 1
    at = np.arange(n)
    hashes = rolling.runs(rolling.sums(h), at, at + window)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    out = np.zeros(n, bool)
    out[order[1:]] = ordered[1:] == ordered[:-1]
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


KEYS = ["anchor", "content", "doc", "row", "start", "windows"]


def combined(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each segment 0, or a number over 0 if an equal one of a smaller doc is among these; such numbers are spread evenly."""
    order = np.lexsort((doc, content, anchor))
    a, c, d = anchor[order], content[order], doc[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    spread = np.zeros(len(order), np.int32)
    spread[order] = np.where(d != d[first], 1 + np.arange(len(order)) % SPREAD, 0)
    return spread


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The KEYS and spread of every segment of every text (doc, row, text).

    Equal segments of one batch are combined before the shuffle: only those of the
    smallest doc go to their anchor's partition, the others are covered already and
    go to any (spread over 0). So copies don't crowd a partition. Windows that repeat
    within their text are sent as covered, and segments of such windows alone aren't
    sent again: what they repeat stands for them.
    """

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in KEYS]
            own: list[list[np.ndarray]] = [[] for _ in KEYS]
            for doc, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = (text or "").encode().split()
                if len(words) < window:
                    continue
                h = word_hashes(words)
                anchor, content, start, count = segments_of(h, rolling, window, gram)
                again = own_repeats(h, rolling, window)
                if again.any():
                    at, n = runs_of(again)
                    zero = np.zeros(len(at), np.int64)
                    for part, values in zip(own, (zero, zero, np.full(len(at), doc), np.full(len(at), row), at.astype(np.int32), n.astype(np.int32)), strict=True):
                        part.append(values)
                    fresh = np.add.reduceat(~again, start) > 0
                    anchor, content, start, count = anchor[fresh], content[fresh], start[fresh], count[fresh]
                for part, values in zip(parts, (anchor.view(np.int64), content.view(np.int64), np.full(len(start), doc), np.full(len(start), row), start.astype(np.int32), count.astype(np.int32)), strict=True):
                    part.append(values)
            for found, covered in ((parts, False), (own, True)):
                if found[0]:
                    columns = [np.concatenate(p) for p in found]
                    spread = 1 + np.arange(len(columns[0]), dtype=np.int32) % SPREAD if covered else combined(*columns[:3])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, spread)], names=[*KEYS, "spread"])

    return docs.select("doc", "row", "text").mapInArrow(run, "anchor long, content long, doc long, row long, start int, windows int, spread int")


def again(found: DataFrame) -> DataFrame:
    """The segments whose anchor occurs again; covered: an equal segment stands in a smaller doc.

    Rows come sorted, so each is judged by its neighbours and by the first of its
    equals, batch by batch; of rows alike in all (copies under one id) one is judged.
    """

    def run(batches):
        names = ["anchor", "doc", "row", "start", "windows", "covered"]
        held: list[np.ndarray] | None = None  # the last row so far, which waits for the next
        before: tuple | None = None  # anchor, content and first doc of the row before it

        def judge(rows: list[np.ndarray], last: bool):
            nonlocal held, before
            alike = np.ones(len(rows[0]), bool)
            alike[0] = False
            for r in rows:
                alike[1:] &= r[1:] == r[:-1]
            rows = [r[~alike] for r in rows]
            anchor, content, doc, row, start, count = rows
            n = len(anchor)
            new_anchor = np.ones(n, bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new = new_anchor.copy()
            new[1:] |= content[1:] != content[:-1]
            if before is not None and before[0] == anchor[0]:
                new_anchor[0], new[0] = False, before[1] != content[0]
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first_doc = np.where(head >= 0, doc[np.maximum(head, 0)], before[2] if before is not None else 0)
            next_same = np.zeros(n, bool)
            next_same[:-1] = ~new_anchor[1:]
            keep = ~new_anchor | next_same
            if not last:
                keep[-1] = False
                held = [r[-1:] for r in rows]
                if n > 1:
                    before = (anchor[-2], content[-2], first_doc[-2])
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, doc, row, start, count, doc > first_doc)], names=names)

        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            follows = rows.pop() > 0
            if follows.any():
                anchor, _, doc, row, start, count = (r[follows] for r in rows)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, doc, row, start, count, np.ones(len(doc), bool))], names=names)
                rows = [r[~follows] for r in rows]
            if len(rows[0]):
                if held is not None:
                    rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
                yield from judge(rows, False)
        if held is not None:
            yield from judge(held, True)

    ordered = found.repartition("anchor", "spread").sortWithinPartitions("anchor", "content", "doc", "row", "start")
    return ordered.mapInArrow(run, "anchor long, doc long, row long, start int, windows int, covered boolean")


class WaveletMatrix:
    """Symbols by bits from the highest; each level keeps packed bits with counts, and where its zeros end."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        now = symbols.astype(np.uint32)
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = (now >> np.uint32(shift) & np.uint32(1)).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
            padded[: len(bits)] = bits
            packed = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            zeros = int(len(bits) - counts[-1])
            self.levels.append((shift, packed, counts, zeros))
            now = np.concatenate([now[~bits], now[bits]])

    @staticmethod
    def _ones(packed: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[block] + np.bitwise_count(packed[block] & below)

    def ranks(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo and before hi, both less what stands before its own block."""
        for shift, packed, counts, zeros in self.levels:
            one = (symbols >> shift & 1).astype(bool)
            ones_lo, ones_hi = self._ones(packed, counts, lo), self._ones(packed, counts, hi)
            lo = np.where(one, zeros + ones_lo, lo - ones_lo)
            hi = np.where(one, zeros + ones_hi, hi - ones_hi)
        return lo, hi


class FmIndex:
    """Over the words of a shard's segments; symbol 0 ends each segment. Patterns up to depth words are found.

    of: a number for each place of the text; in the order of the suffixes it takes the place of the suffix array.
    """

    def __init__(self, text: np.ndarray, size: int, depth: int, of: np.ndarray):
        n = len(text)
        rank, k = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while k < depth:
            after = np.zeros(n, np.int64)
            after[:-k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.zeros(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            k *= 2
        self.of = of[order]
        self.starts = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=size), out=self.starts[1:])
        bwt = text[order - 1]
        self.matrix = WaveletMatrix(bwt, size)
        # where each symbol's block begins after the last level
        every = np.arange(size)
        zero = np.zeros(size, np.int64)
        self.base, _ = self.matrix.ranks(every, zero, zero)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from those of the patterns."""
        a, b = self.matrix.ranks(symbols, lo, hi)
        shift = self.starts[symbols] - self.base[symbols]
        return a + shift, b + shift

    def statistics(self, text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place in the text how many words before it, up to depth, occur twice or more, and the interval of the longest such run."""
        symbols = text[ends - 1]
        lo, hi = self.starts[symbols], self.starts[symbols + 1]
        length = np.where(hi - lo > 1, 1, 0)
        active = np.flatnonzero(length)
        for k in range(2, depth + 1):
            a, b = self.extend(text[ends[active] - k], lo[active], hi[active])
            more = b - a > 1
            active = active[more]
            lo[active], hi[active], length[active] = a[more], b[more], k
            if not len(active):
                break
        return length, lo, hi


def repeated_windows(texts: list[str], doc: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Of the windows of a shard's segments, one after the other: does an equal one stand in a smaller doc?"""
    ids: dict[bytes, int] = {}
    symbols: list[int] = []
    for t in texts:
        symbols.extend([ids.setdefault(w, len(ids) + 1) for w in t.encode().split()])
        symbols.append(0)
    text = np.array(symbols, dtype=np.int64)
    sizes = count + window  # words and the end
    heads = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(count)), count)
    places = heads[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    _, rank = np.unique(doc, return_inverse=True)
    none = len(doc)
    of = np.full(len(text), none, np.int32)
    of[places] = rank[owner]
    index = FmIndex(text, len(ids) + 1, window, of)
    length, lo, hi = index.statistics(text, places + window, window)
    full = np.flatnonzero(length == window)
    out = np.zeros(len(owner), bool)
    if len(full):
        intervals = np.unique(np.stack([lo[full], hi[full]], axis=1), axis=0)
        earliest = np.minimum.reduceat(np.append(index.of, none), intervals.ravel())[::2]
        out[full] = earliest[np.searchsorted(intervals[:, 0], lo[full])] < rank[owner[full]]
    return out


def indexed(found: DataFrame, window: int) -> DataFrame:
    """doc, row, start and windows of the repeated windows among segments (anchor, doc, row, start, windows, words), shard by shard."""
    names = ["doc", "row", "start", "windows"]

    def shard(rows: pa.Table):
        doc, row, start, count = (rows.column(c).to_numpy().astype(np.int64) for c in names)
        flags = repeated_windows(rows.column("words").to_pylist(), doc, count, window)
        owner = np.repeat(np.arange(len(count)), count)
        place = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        head = flags & ~(np.concatenate([[False], flags[:-1]]) & np.concatenate([[False], owner[1:] == owner[:-1]]))
        run = np.cumsum(head)[flags] - 1
        sizes = np.bincount(run, minlength=int(head.sum())).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc[owner][head]), pa.array(row[owner][head]), pa.array(place[head].astype(np.int32)), pa.array(sizes)], names=names)

    def run(batches):
        held: list[pa.Table] = []
        n, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = [table.column(c).to_numpy() for c in ("anchor", "doc", "row", "start")]
            alike = np.ones(len(keys[0]), bool)  # copies under one id send the same segments
            for k, key in enumerate(keys):
                alike[1:] &= key[1:] == key[:-1]
                alike[0] &= last is not None and last[k] == key[0]
            anchor, before = keys[0], last
            last = tuple(key[-1] for key in keys)
            if n >= CHUNK:  # a shard ends where an anchor does
                ends = np.flatnonzero(anchor != before[0])
                if len(ends):
                    cut_at = int(ends[0])
                    held.append(table.slice(0, cut_at).filter(pa.array(~alike[:cut_at])))
                    yield shard(pa.concat_tables(held))
                    table, alike, held, n = table.slice(cut_at), alike[cut_at:], [], 0
            held.append(table.filter(pa.array(~alike)))
            n += held[-1].num_rows
        if n:
            yield shard(pa.concat_tables(held))

    ordered = found.repartition("anchor").sortWithinPartitions("anchor", "doc", "row", "start")
    return ordered.mapInArrow(run, "doc long, row long, start int, windows int")


def pieces(docs: DataFrame, wanted: DataFrame, window: int, single: bool) -> DataFrame:
    """The wanted segments (anchor, doc, row, start, windows) with their words; single: their windows one by one, with a hash for the words.

    Rows alike in id and text hold the same segments: a task sends each of the last ones it met once.
    """
    per_row = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("wanted"))  # as many as the row has segments
    last = ("hash", pa.int64(), "long") if single else ("words", pa.string(), "string")
    names = ["anchor", "doc", "row", "start", "windows", last[0]]

    def batch_of(out: tuple[list, ...]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), last[1])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    def run(batches):
        met = Memo(lambda key: False, 50_000)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, row, text, rows in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if met[doc, row]:
                    continue
                met[doc, row] = True
                words = (text or "").encode().split()
                for r in rows:
                    a, n = r["start"], r["windows"]
                    for start, count in [(a + k, 1) for k in range(n)] if single else [(a, n)]:
                        piece = b" ".join(words[start : start + count + window - 1])
                        value = xxhash.xxh64_intdigest(piece, 9) - (1 << 63) if single else piece.decode()
                        for column, x in zip(out, (r["anchor"], doc, row, start, count, value), strict=True):
                            column.append(x)
                if len(out[0]) >= 10_000:
                    yield batch_of(out)
                    out = ([], [], [], [], [], [])
            if out[0]:
                yield batch_of(out)

    # the rest isn't read, but with it this is the shuffle of the last join, which Spark then reuses
    return docs.join(per_row, ["doc", "row"]).select("doc", "row", "text", "rest", "wanted").mapInArrow(run, f"anchor long, doc long, row long, start int, windows int, {last[0]} {last[2]}")


def frequent(windows: DataFrame) -> DataFrame:
    """doc, row, start and windows of those single windows (anchor, hash, doc, row, start, windows) that also stand in a smaller doc."""
    least = windows.groupBy("anchor", "hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    return windows.join(least, ["anchor", "hash"]).where("doc > least").select("doc", "row", "start", "windows")


def covered_runs(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, row, start and windows: runs of windows that stand earlier, for keyed (doc, row, text, rest)."""
    met = cut(again(segments(keyed, window, gram)))
    firsts = met.where("not covered")
    many = cut(firsts.groupBy("anchor").count().where(F.col("count") > CHUNK).select("anchor"))
    fresh = indexed(pieces(keyed, firsts.join(many, "anchor", "left_anti"), window, False), window)
    runs = met.where("covered").select("doc", "row", "start", "windows").union(fresh)
    if many.isEmpty():
        return runs
    return runs.union(frequent(pieces(keyed, firsts.join(many, "anchor"), window, True)))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with n_words, n_removed, kept_text and removed (array<struct<start,end>> in words), but for the text itself."""
    new = ["n_words", "n_removed", "kept_text", "removed"]
    ours = [c for c in docs.columns if c not in (*new, text)]
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))
    key = F.xxhash64(F.col(doc_id).isNull(), text)
    keyed = docs.select(order.alias("doc"), key.alias("row"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in ours]).alias("rest"))
    runs = covered_runs(keyed, window, gram).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))  # as many as the row has segments
    sent = keyed.join(runs, ["doc", "row"], "left").select("text", "runs", "rest")
    schema = docs.select(*[F.col(f"`{c}`") for c in ours]).schema
    for field in docs.sparkSession.createDataFrame([], "n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>").schema:
        schema = schema.add(field)
    names = [*ours, *new]

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text, found in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                spans: list[dict] = []
                gone = 0
                kept = words
                if found:
                    edges = np.zeros(n + 1, np.int32)
                    for r in found:
                        edges[r["start"]] += 1
                        edges[r["start"] + r["windows"] + window - 1] -= 1
                    mask = np.cumsum(edges[:-1]) > 0
                    gone = int(np.count_nonzero(mask))
                    starts, sizes = runs_of(mask)
                    spans = [{"start": a, "end": a + k} for a, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    kept, at = [], 0
                    for s in spans:
                        kept += words[at : s["start"]]
                        at = s["end"]
                    kept += words[at:]
                for column, value in zip(out, (n, gone, b" ".join(kept).decode(), spans), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.column(2).flatten(), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    return sent.mapInArrow(run, schema)
