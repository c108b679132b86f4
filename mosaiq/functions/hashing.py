"""Perceptual hashes, keys and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORST_DISTANCE = 64


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of up to 16 digits; 64 where lengths differ, either is empty or isn't hex."""
    valid = (F.length(a) == F.length(b)) & a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    bits = F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))
    return F.when(F.coalesce(valid, F.lit(False)), bits).otherwise(WORST_DISTANCE).cast("int")


def hamming_long(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def differing_digits(a: Column, b: Column) -> Column:
    """Differing hex digits (not bits) of two strings of equal length; else the longer length."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.length(a) == F.length(b), same).otherwise(F.greatest(F.length(a), F.length(b))).cast("int")


def hash_chunks(h: Column) -> Column:
    """Four chunks of four hex digits, padded to the right with zeros."""
    padded = F.rpad(h, 16, "0")
    return F.array(*[F.substring(padded, 1 + 4 * k, 4) for k in range(4)])


def average_hash(pixels: Column) -> Column:
    """16 hex digits of 64 grey values: bit i is set where value i is over the mean, the first bit lowest."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    bit = lambda x, i, m: F.when(x > m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    of = F.transform(F.array(F.struct(pixels.alias("p"), mean.alias("mean"))), lambda o: F.aggregate(F.transform(o["p"], lambda x, i: bit(x, i, o["mean"])), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))
    return F.lower(F.lpad(F.hex(of[0]), 16, "0"))


def sign_bits(vector: Column) -> Column:
    """A 64-bit number from the signs of the first 64 numbers of a vector, the first lowest."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def memory_key(kind: Column, start: Column, end: Column, people: Column) -> Column:
    """kind:start:end:people, the people in lower case and sorted."""
    names = F.array_join(F.array_sort(F.transform(people, F.lower)), ",")
    return F.concat_ws(":", kind, F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd"), names)


def normal_name(name: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def run_id_time(run_id: Column) -> Column:
    """The time in YYYYMMDD_HHMMSS_XXXX; null where the id isn't of that form."""
    return F.when(run_id.rlike("^[0-9]{8}_[0-9]{6}_[0-9a-fA-F]{4}$"), F.try_to_timestamp(F.substring(run_id, 1, 15), F.lit("yyyyMMdd_HHmmss")))


def pseudonym(text: Column, names: list[str]) -> Column:
    """One of the names, by the text's SHA-256 modulo their number."""
    digits = F.split(F.sha2(text, 256), "")
    place = F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("int")) % len(names))
    return F.get(F.array(*[F.lit(n) for n in names]), place)
