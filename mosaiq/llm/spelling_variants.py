"""Spelling variant grouping: each word's frequent neighbour at one inserted, deleted or replaced code point.

Every word is halved. An edit falls into one half, so the other one stands whole in the neighbour, at its beginning
or its end. Halves are dealt to shards by a hash; a shard holds its halves in an Aho-Corasick automaton, with the
words that have them. Each word is sent to the shards that its own beginnings and ends of fitting length fall to (four
at most), scanned there, and each hit is checked for offset and length before the distance is verified. Pairs whose
first half matches are taken from that half only, so that each counts once.

A half of many words (`crowd`) is not compared with each of them: what differs is looked up by its forms with one code
point left out. A half of very many (`hot`) is dealt further, by the halves of what is left of the word; the list of
such halves has at most (number of words / hot) entries. What leaves a shard is one row for each word: the number of
neighbours and the best one.

Shards hold about `shard_letters` code points, so their memory doesn't depend on the table. Words of any length are
compared by whole text. Null and empty texts have no words. Repeated rows count as often as they stand; a null id
is the empty string where ids are hashed. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, text_of

SHARD_LETTERS = 400_000
CROWD = 8
HOT = 20_000

#: Letters of Latin-1 from U+00C0 on and of ASCII, A-Z lower-cased; all others become spaces.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letters, as Latin-1 bytes: one a code point."""
    return text.encode("latin-1", "replace").translate(FOLDED).split()


def word_counts(docs: DataFrame, thinned: int = 97, shortest: int = 5, least: int = 3, most: int = 500_000) -> DataFrame:
    """(word, n): words after the deletion that id and word decide, of `shortest` code points and `least` places at least.

    A task sends its counts on when it holds `most` words, so its memory is bounded.
    """

    def batch_of(total: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], type=pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), type=pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(runs_of(text)).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
                    if h % thinned == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) >= most:
                    yield batch_of(total)
                    total.clear()
        yield batch_of(total)

    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), text_of().alias("text"))
    return given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells a from b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    for at, (x, y) in enumerate(zip(a, b, strict=False)):  # noqa: B007
        if x != y:
            break
    else:
        at = len(a)
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def shorter_forms(rest: str) -> list:
    """Keys of the forms of rest with one code point left out; of long ones two sums stand for the form."""
    if len(rest) <= 64:
        return list({rest[:k] + rest[k + 1 :] for k in range(len(rest))})
    letters, keys = np.frombuffer(rest.encode("utf-32-le"), dtype=np.uint32).astype(np.int64), []
    for base, prime in ((1_000_003, 2_147_483_647), (69_069, 2_147_483_629)):
        powers = np.ones(1, dtype=np.int64)
        while len(powers) < len(letters):
            powers = np.concatenate([powers, powers * pow(base, len(powers), prime) % prime])
        terms = letters * powers[: len(letters)] % prime
        sums = np.concatenate([[0], np.cumsum(terms)])
        keys.append((sums[:-1] + (sums[-1] - sums[1:]) % prime * pow(base, -1, prime)) % prime)
    return list({(len(rest) - 1, int(x), int(y)) for x, y in zip(*keys, strict=True)})


def whole_form(rest: str):
    """The key that a form with one code point left out has if it equals rest."""
    if len(rest) <= 63:
        return rest
    letters, key = np.frombuffer(rest.encode("utf-32-le"), dtype=np.uint32).astype(np.int64), [len(rest)]
    for base, prime in ((1_000_003, 2_147_483_647), (69_069, 2_147_483_629)):
        powers = np.ones(1, dtype=np.int64)
        while len(powers) < len(letters):
            powers = np.concatenate([powers, powers * pow(base, len(powers), prime) % prime])
        key.append(int((letters * powers[: len(letters)] % prime).sum() % prime))
    return tuple(key)


Half = tuple[int, str]  # 0 and a beginning, 1 and an end


def halves(word: str) -> list[Half]:
    at = len(word) // 2
    return [(0, word[:at]), (1, word[at:])]


def rest_of(word: str, half: Half) -> str:
    return word[: len(word) - len(half[1])] if half[0] else word[len(half[1]) :]


def fitting(word: str) -> set[Half]:
    """The halves that a word one edit away may have whole in this one."""
    found = set()
    for size in (len(word) - 1, len(word), len(word) + 1):
        at = size // 2
        found |= {(0, word[:at])} | ({(1, word[len(word) - (size - at) :])} if size - at <= len(word) else set())
    return found


def own_keys(word: str, half: Half, hot: frozenset) -> list[tuple]:
    """Where a word is kept under its half: once, or under both halves of the rest if the half is hot."""
    if half not in hot:
        return [half]
    rest = rest_of(word, half)
    at = len(rest) // 2
    return [(*half, len(rest), 0, rest[:at]), (*half, len(rest), 1, rest[at:])]


def sought_keys(word: str, half: Half, hot: frozenset) -> list[tuple]:
    """Where the neighbours of a word with this half are kept."""
    if half not in hot:
        return [half]
    rest, found = rest_of(word, half), []
    for size in (len(rest) - 1, len(rest), len(rest) + 1):
        whole, at = size + len(half[1]), size // 2
        if whole // 2 == (whole - len(half[1]) if half[0] else len(half[1])):
            found.append((*half, size, 0, rest[:at]))
            if size - at <= len(rest):
                found.append((*half, size, 1, rest[len(rest) - (size - at) :]))
    return found


def shard_of(key: tuple, shards: int) -> int:
    return zlib.crc32("\0".join(map(str, key)).encode()) % shards


class Shard:
    """The words of a shard, by their keys, behind an automaton of their halves."""

    def __init__(self, hot: frozenset, crowd: int):
        self.hot, self.crowd, self.groups = hot, crowd, {}

    def add(self, key: tuple, word: str, n: int) -> None:
        self.groups.setdefault(key, []).append((word, n))

    def build(self) -> None:
        self.automaton, sides = ahocorasick.Automaton(), {}
        for key in self.groups:
            sides.setdefault(key[1], set()).add(key[0])
        for segment, of in sides.items():
            self.automaton.add_word(segment, (segment, tuple(of)))
        self.automaton.make_automaton()
        self.forms = {}
        for key, owners in self.groups.items():
            if len(owners) > self.crowd:
                index = self.forms[key] = {}
                for k, (word, _) in enumerate(owners):
                    rest = rest_of(word, key[:2])
                    for form in {whole_form(rest), *shorter_forms(rest)}:
                        index.setdefault(form, []).append(k)

    def candidates(self, word: str, key: tuple) -> list[tuple[str, int]]:
        owners = self.groups.get(key, [])
        if key not in self.forms:
            return owners
        rest, index = rest_of(word, key[:2]), self.forms[key]
        return [owners[k] for k in {k for form in (whole_form(rest), *shorter_forms(rest)) for k in index.get(form, ())}]

    def neighbours(self, word: str) -> Iterator[tuple[str, int]]:
        size = len(word)
        for end, (segment, sides) in self.automaton.iter(word):
            for side in sides:
                if (end + 1 != size) if side else (end + 1 != len(segment)):
                    continue
                for key in sought_keys(word, (side, segment), self.hot):
                    for other, n in self.candidates(word, key):
                        if abs(len(other) - size) > 1 or not one_edit(word, other):
                            continue
                        if side and word.startswith(other[: len(other) // 2]):
                            continue  # its first half has it
                        if len(key) == 5 and key[3] and rest_of(word, key[:2]).startswith(rest_of(other, key[:2])[: key[2] // 2]):
                            continue  # the first half of the rest has it
                        yield other, n


def neighbour_counts(words: DataFrame, shard_letters: int = SHARD_LETTERS, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, best): for every word the number of its neighbours and the one of largest n, as (-n, word)."""
    total = words.agg(F.sum(F.char_length("word")).alias("letters"), F.count("*").alias("n")).first()
    shards = 1 + (total["letters"] or 0) // shard_letters

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for w in batch.column(0).to_pylist() for h in halves(w)]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in found], type=pa.int32()), pa.array([h[1] for h in found], type=pa.string())], names=["side", "half"])

    crowded: frozenset = frozenset()
    if total["n"] > hot:
        counted = words.select("word").mapInArrow(split, "side int, half string").groupBy("side", "half").count().where(F.col("count") > hot)
        crowded = frozenset((r["side"], r["half"]) for r in counted.collect())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for half in halves(word):
                    out += [(shard_of(key, shards), 0, *half, word, n, key[2:]) for key in own_keys(word, half, crowded)]
                out += [(shard, 1, 0, "", word, n, ()) for shard in {shard_of(key, shards) for half in fitting(word) for key in sought_keys(word, half, crowded)}]
            kinds = (pa.int32(), pa.int8(), pa.int8(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([x[k] for x in out], type=t) for k, t in enumerate(kinds)]
            further = [pa.array([x[6][k] if x[6] else None for x in out], type=t) for k, t in enumerate((pa.int32(), pa.int8(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *further], names=["shard", "sought", "side", "half", "word", "n", "size", "part", "piece"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, built = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for number, sought, side, half, word, n, size, part, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if number != now:
                    shard, now, built = Shard(crowded, crowd), number, False
                if not sought:
                    shard.add((side, half) if size is None else (side, half, size, part, piece), word, n)
                    continue
                if not built:
                    shard.build()
                    built = True
                if shard.groups and (found := list(shard.neighbours(word))):
                    best = min((-n, w) for w, n in found)
                    out.append((word, None, len(found), *best))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=t) for k, t in enumerate(kinds)], names=["word", "n", "n_near", "less", "form"])

    pieces = words.select("word", "n").mapInArrow(dealt, "shard int, sought byte, side byte, half string, word string, n long, size int, part byte, piece string")
    found = pieces.repartition("shard").sortWithinPartitions("shard", "sought").mapInArrow(scanned, "word string, n long, n_near long, less long, form string")
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("less"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("less", "form")))
    return own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: paths are doubled until none goes on. Forms have larger n, so there are no circles."""
    paths = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while paths.where("moved").head(1):
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = paths.join(further, "root", "left")
        paths = cut(longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), instead_of=paths)
    return paths.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = 2, shard_letters: int = SHARD_LETTERS, crowd: int = CROWD, hot: int = HOT, **counting: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n): form is the neighbour of largest n (ties: the smallest word), if that is ratio * n at least."""
    words = cut(word_counts(docs, **counting))
    near = neighbour_counts(words, shard_letters, crowd, hot)
    kept = -F.col("best.less") >= ratio * F.col("n")
    judged = cut(near.select("word", "n", "n_near", F.when(kept, F.col("best.form")).alias("form"), F.when(kept, -F.col("best.less")).alias("form_n")), instead_of=words)
    roots = last_forms(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
