"""Benchmark items in documents, also with other numbers, names and units.

Each word becomes a canonical token: numbers, units after numbers, and capitalised
words inside a sentence become typed placeholders, other words lose their case and
outer punctuation. Windows of consecutive tokens are hashed, and the documents'
windows are joined with the benchmark's. Where a window has placeholders, the values
that filled them are kept, without case, outer punctuation and possessive endings.
Over one alignment of a document with an item each value of the item stands for the
value of the document that it meets at most places (of several, itself, else the
least); windows where it meets another one don't count. A document is contaminated
when the windows that count cover enough of an item.

An item of fewer words than a window is one window; of fewer than MIN_WINDOW words,
its values must be the document's own, as placeholders alone would meet any number.

Documents send only windows that a bitmap of the benchmark's windows lets pass. The
bitmap is of bounded size, at most BITS_MOST bits, and lets pass more than it should,
never less; the join then settles it, so the result doesn't depend on its size. A row
meets an item by one of the item's rarest windows (all but those that it may lack),
and only such pairs are looked at with all windows.

Defined results: null or empty text has no windows, in documents as in items; items
of equal text count as the one with the smallest id; rows are judged by id and text,
so rows of one id (or none) with different texts have verdicts of their own, and
rows alike in both the same; rows are never dropped by judged. Columns of docs named
as the new ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, bitmap, cut, free_name, in_parts, map_arrow, passing, row_keys

WINDOW, MIN_WINDOW, MIN_COVER = 8, 4, 0.5
ROWS_AT_ONCE = 20_000

# Units that may follow a number.
UNITS = frozenset("kg g mg km m cm mm mi ft in lb oz l ml s sec min h hr hrs hours hour minutes days day years year % $ € £ usd eur dollars euros cents meters metres miles km/h mph".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
OUTER = re.compile(r"^[^\w$€£%+-]+|[^\w%$€£]+$")
OWNED = re.compile(r"['’]s$")
CAPITAL, ENDS, NUMERIC, UNIT = 1, 2, 4, 8
STEP = np.uint64(0x9E3779B97F4A7C15)


def code_of(token: str) -> int:
    """59 bits, so that four flags fit beside them."""
    return xxhash.xxh64_intdigest(token.encode(), 7) >> 5 or 1


NUM, NAME, MEASURE = (code_of(f"\0{kind}") for kind in ("number", "name", "unit"))


MARKS = {".": ENDS, "!": ENDS, "?": ENDS, ":": ENDS, ",": 0, ";": 0}


def read_word(raw: bytes) -> int:
    """A word's code and flags in one number; letters with at most one mark after them need no patterns."""
    word = raw.decode("utf-8", "replace")
    if word.isalpha():
        core, flags = word, 0
    else:
        core, flags = word[:-1], MARKS.get(word[-1:])
        if flags is None or not core.isalpha():
            return read_any(word)
    low = core.lower()
    if low in UNITS:
        flags |= UNIT
    if core[0].isupper():
        flags |= CAPITAL
    return (xxhash.xxh64_intdigest(low.encode(), 7) >> 5 or 1) << 4 | flags


def read_any(word: str) -> int:
    """The same for any word."""
    core = OUTER.sub("", word)
    flags = ENDS if word.rstrip("\"')]»”")[-1:] in ".!?:" else 0
    if NUMBER.fullmatch(core):
        return NUM << 4 | flags | NUMERIC
    if core.lower() in UNITS:
        flags |= UNIT
    if core[:1].isupper():
        flags |= CAPITAL
    return code_of(core.lower()) << 4 | flags


def canonical(packed: np.ndarray) -> np.ndarray:
    """The codes of a text's tokens from its words' codes and flags."""
    codes = packed >> 4
    flag = lambda f: (packed & f) != 0
    before = lambda f: np.concatenate([[False], flag(f)[:-1]])
    codes = np.where(flag(UNIT) & before(NUMERIC), MEASURE, codes)
    inside = ~before(ENDS)
    if len(inside):
        inside[0] = False
    return np.where(flag(CAPITAL) & inside & ~flag(NUMERIC), NAME, codes).astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_hashes(codes: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """By size the hashes of all windows of so many tokens."""
    out = {}
    h = np.zeros(len(codes), np.uint64)
    for size in range(1, min(max(sizes, default=0), len(codes)) + 1):
        n = len(codes) - size + 1
        h = h[:n] * STEP + codes[size - 1 : size - 1 + n]
        if size in sizes:
            out[size] = mixed(h + np.uint64(size))
    return out


SLOTS = np.array([NUM, NAME, MEASURE], dtype=np.uint64)


def slot_value(raw: bytes) -> str:
    """A word as the value of a placeholder."""
    return OWNED.sub("", OUTER.sub("", raw.decode("utf-8", "replace"))).lower()


def windows_of(words: list[bytes], packed: np.ndarray, sizes: list[int], bits: np.ndarray | None):
    """(size, place, hash, slots) of the text's windows, where slots are (offset, value); bits: the bitmap of hashes that may pass."""
    codes = canonical(packed)
    at = np.flatnonzero(np.isin(codes, SLOTS))
    for size, h in window_hashes(codes, sizes).items():
        starts = np.arange(len(h))
        if bits is not None:
            place = h & np.uint64(len(bits) * 64 - 1)
            starts = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
        for s, x in zip(starts.tolist(), h[starts].view(np.int64).tolist(), strict=True):
            of = at[np.searchsorted(at, s) : np.searchsorted(at, s + size)].tolist()
            yield size, s, x, [{"at": k - s, "value": slot_value(words[k])} for k in of]


WINDOWS = [("size", pa.int32()), ("place", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())])))]


def window_rows(texts: DataFrame, sizes: list[int] | None = None, bits: np.ndarray | None = None) -> DataFrame:
    """The keys of texts (all columns but the last, the text) with size, place, hash and slots of its windows.

    sizes None: one size a text, the window's or the text's own.
    """
    shared = texts.sparkSession.sparkContext.broadcast((sizes, bits))
    keys = texts.columns[:-1]

    def run(batches):
        memo = Memo(read_word, 200_000)
        wanted, allowed = shared.value
        rows: list[list] = [[] for _ in WINDOWS]
        owner: list[int] = []

        def flushed(batch):
            taken = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
            out = pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, (_, t) in zip(rows, WINDOWS, strict=True))], names=[*keys, *(n for n, _ in WINDOWS)])
            for c in (*rows, owner):
                c.clear()
            return out

        for batch in in_parts(batches):
            for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                words = (text or "").encode().split()
                if not words:
                    continue
                packed = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
                for window in windows_of(words, packed, wanted if wanted is not None else [min(WINDOW, len(words))], allowed):
                    owner.append(k)
                    for column, value in zip(rows, window, strict=True):
                        column.append(value)
                    if len(owner) >= ROWS_AT_ONCE:
                        yield flushed(batch)
            if owner:
                yield flushed(batch)

    schema = texts.select(*keys).schema
    for field in texts.sparkSession.createDataFrame([], "size int, place int, hash long, slots array<struct<at:int,value:string>>").schema:
        schema = schema.add(field)
    return map_arrow(texts, run, schema)


def agreeing(windows: list[tuple[int, int, list[tuple[int, str, str]]]], exact: bool) -> tuple[list[int], int | None]:
    """Of an alignment's windows (item_place, place, values) those that count, as places in the item, and the first place in the document.

    values: (place in the item, the item's value, the document's value).
    """
    votes: dict[str, Counter[str]] = {}
    for at, theirs, ours in {v for _, _, values in windows for v in values}:
        votes.setdefault(theirs, Counter())[ours] += 1
    stands = {theirs: min(found, key=lambda x: (-found[x], x != theirs, x)) for theirs, found in votes.items()}
    good = [w for w in windows if all(ours == theirs or (not exact and ours == stands[theirs]) for _, theirs, ours in w[2])]
    return sorted({w[0] for w in good}), min((w[1] for w in good), default=None)


def probing(theirs: DataFrame, min_cover: float) -> DataFrame:
    """The windows of each item, the rarest first, of which a row must have one to reach the cover: all but those that it may lack, and one."""
    shared = theirs.groupBy("hash", "item_size").agg(F.countDistinct("item_id").alias("holders"))
    of = Window.partitionBy("item_id")
    n = F.count(F.lit(1)).over(of)
    place = F.row_number().over(of.orderBy("holders", "hash", "item_place"))
    counted = theirs.select("item_id", "item_place", "hash", "item_size", F.size("item_slots").alias("n_slots")).join(shared, ["hash", "item_size"])
    lacked = n - F.greatest(F.lit(1), F.ceil(n * min_cover - 1e-9))
    return counted.withColumns({"lacked": lacked, "rarest": place}).where("rarest <= lacked + 1").select("item_id", "hash", "item_size", "n_slots").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", min_cover: float = 0.0) -> DataFrame:
    """key1, key2 (see row_keys), item_id, cover (share of the item's windows that stand in the row and count) and first_word.

    Pairs under min_cover may be missing: rows and items meet by the items' rarest windows first, and only rows that do
    send all their windows, to those items, so that wording that all items share doesn't pair all rows with all items.
    """
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")
    theirs = cut(window_rows(items).withColumnsRenamed({"place": "item_place", "slots": "item_slots", "size": "item_size"}))
    sizes = sorted(r[0] for r in theirs.select("item_size").distinct().collect())  # at most as many as a window has tokens
    key1, key2 = row_keys(F.col(doc_id), F.col(text))
    texts = docs.select(key1.alias("key1"), key2.alias("key2"), F.col(text).alias("text"))
    probes = cut(probing(theirs, min_cover))
    probed = window_rows(texts, sizes, bitmap(probes)).withColumnRenamed("hash", "met")
    meets = (F.col("met") == F.col("hash")) & (F.col("size") == F.col("item_size")) & (F.size("slots") == F.col("n_slots"))
    pairs = cut(probed.join(probes, meets).select("key1", "key2", "item_id").distinct())
    rows = pairs.select("key1", "key2").distinct()
    paired = passing(texts, F.col("key1"), bitmap(rows.select(F.xxhash64("key1").alias("hash")))).join(rows, ["key1", "key2"], "left_semi")
    ours = window_rows(paired.select("key1", "key2", "text"), sizes, bitmap(theirs)).withColumnRenamed("hash", "met")
    sought = pairs.join(theirs, "item_id").withColumnsRenamed({"key1": "row1", "key2": "row2"})
    same = (F.col("key1") == F.col("row1")) & (F.col("key2") == F.col("row2")) & (F.col("met") == F.col("hash")) & (F.col("size") == F.col("item_size")) & (F.size("slots") == F.size("item_slots"))
    values = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct((F.col("item_place") + z["item_slots"]["at"]).alias("at"), z["item_slots"]["value"].alias("theirs"), z["slots"]["value"].alias("ours")))
    met = ours.join(sought, same).select("key1", "key2", "item_id", (F.col("place") - F.col("item_place")).alias("shift"), "size", F.struct("item_place", "place", values.alias("values")).alias("window"))
    aligned = met.groupBy("key1", "key2", "item_id", "shift").agg(F.min("size").alias("size"), F.collect_set("window").alias("windows"))  # at most as many as the item has

    def run(batches):
        for batch in batches:
            places, firsts = [], []
            for size, windows in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                read = [(w["item_place"], w["place"], [(v["at"], v["theirs"], v["ours"]) for v in w["values"]]) for w in windows]
                found, first = agreeing(read, size < MIN_WINDOW)
                places.append(found)
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.list_(pa.int32())), pa.array(firsts, pa.int32())], names=["key1", "key2", "item_id", "places", "first_word"])

    kind = items.schema["item_id"].dataType.simpleString()
    counted = map_arrow(aligned.select("key1", "key2", "item_id", "size", "windows"), run, f"key1 long, key2 long, item_id {kind}, places array<int>, first_word int")
    covered = counted.groupBy("key1", "key2", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"), F.min("first_word").alias("first_word"))
    whole = theirs.groupBy("item_id").agg(F.count(F.lit(1)).alias("windows"))
    return covered.join(whole, "item_id").select("key1", "key2", "item_id", (F.col("found") / F.col("windows")).alias("cover"), "first_word")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key1, key2, items (array, ascending) and cover of the rows that hold benchmark items; written, so that its size is known to joins."""
    held = matches(docs, benchmark, doc_id, text, min_cover).where(F.col("cover") >= min_cover)
    return cut(held.groupBy("key1", "key2").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("cover").alias("cover")))


def judged(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with contaminated, items and cover (null where none is held)."""
    kept = docs.drop("contaminated", "items", "cover")
    own = [free_name(kept, n) for n in ("key1", "key2")]
    hits = contaminated(docs, benchmark, min_cover, doc_id, text).withColumnsRenamed({"key1": own[0], "key2": own[1]})
    keys = row_keys(F.col(doc_id), F.col(text))
    joined = kept.join(hits, (keys[0] == F.col(own[0])) & (keys[1] == F.col(own[1])), "left")
    return joined.withColumn("contaminated", F.col(own[0]).isNotNull()).drop(*own)


def clean(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with their columns as they are."""
    own = [free_name(docs, n) for n in ("key1", "key2")]
    hits = contaminated(docs, benchmark, min_cover, doc_id, text).select(F.col("key1").alias(own[0]), F.col("key2").alias(own[1]))
    keys = row_keys(docs[doc_id], docs[text])
    return docs.join(hits, (keys[0] == F.col(own[0])) & (keys[1] == F.col(own[1])), "left_anti")
