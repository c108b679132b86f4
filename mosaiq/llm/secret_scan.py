"""Secrets in documents: fixed patterns, and a battery of randomness tests on token-like strings.

Three kinds of base spans come from patterns. Beside them every long string over
the characters of the common encodings is a candidate. Its encoding is inferred,
and three statistics are taken over the values of its characters: chi-squared
against a uniform alphabet, the runs above and below the middle of the alphabet,
and the correlation of neighbours. They are combined by Fisher's rule; and the
chi-squared sum is also tested from the other side, that of words, whose letters make
more equal pairs than a uniform alphabet does. Both p-values are held against
Benjamini and Hochberg's limit in classes of similar length over all candidates of all
documents, so that long strings, where the tests are strong, aren't weighed with short
ones: a candidate is a secret if the control of false discoveries doesn't find it other
than random, and finds it other than words.

Everything runs as built-in functions. Positions follow from the lengths of the
matches and of what stands between them, added up by blocks, so that a text with many
matches takes little more than its share.

Defined results: null text counts as empty and has no spans; repeated rows give
repeated results; rows are never dropped; with no candidates there are no limits
and no added spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, text_of

# The base kinds in their order, with pattern and least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of 16 or more among [0-9a-f]+
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
# Encodings by name, their pattern and alphabet; the first that fits is taken.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
FALSE_RATE = 0.01
WORD_PAIRS = 0.067  # the share of equal pairs of letters in prose
BLOCK = 128
STEPS, DEEPEST = 20, 60  # p-values are held in steps of a 20th of a power of ten, down to 1e-60


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, use) -> Column:
    """use(value), where the value is computed once."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, start: Column, add) -> Column:
    """For each value the sum (by add, from start) of the values before it, by blocks, so that the work doesn't grow with the square."""
    size = F.lit(BLOCK)
    total = lambda part: F.aggregate(part, start, add)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda b: total(F.slice(v, b * size + 1, size)))
    heads = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, 1, b)))

    def each(v: Column) -> Column:
        return let(blocks(v), lambda sums: let(heads(sums), lambda h: F.transform(v, lambda _, i: add(F.get(h, F.floor(i / size).cast("int")), total(F.slice(v, F.floor(i / size).cast("int") * size + 1, i % size))))))

    return F.when(F.size(values) > 0, let(values, each)).otherwise(F.array().cast("array<int>"))


def match_spans(text: Column, pattern: str, kind: str) -> Column:
    """The pattern's matches as array<struct<start,kind,end,value>>, in code points."""
    none = F.array().cast(SPAN)
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(x: Column) -> Column:
        steps = F.transform(x["found"], lambda f, i: F.get(x["gaps"], i) + F.char_length(f))

        def span(f: Column, i: Column, ends: Column) -> Column:
            start = F.get(ends, i) + F.get(x["gaps"], i)
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.char_length(f)).alias("end"), f.alias("value"))

        return let(before(steps, F.lit(0), lambda a, b: a + b), lambda ends: F.transform(x["found"], lambda f, i: span(f, i, ends)))

    spans = let(F.struct(pieces.alias("gaps"), found.alias("found")), located).cast(SPAN)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """The spans of the three base kinds by start, then kind."""
    assign = F.filter(match_spans(text, ASSIGN, "assign"), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12)
    access = F.filter(match_spans(text, ACCESS, "access"), lambda s: F.char_length(s["value"]) >= 18)
    return F.sort_array(F.concat(assign, access, match_spans(text, HEX, "hex")))


def tail(z: Column) -> Column:
    """The normal distribution's mass above z, by a rational approximation (error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    above = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, above).otherwise(1 - above)


def battery(value: Column) -> Column:
    """struct<n, odd, depth>: length, and the p-values of the tests of randomness (combined) and of words, as -20 log10 of each."""

    def by_encoding(k: int) -> Column:
        out = None
        for _, pattern, alphabet in ENCODINGS:
            v = F.lit([alphabet, len(alphabet)][k])
            out = F.when(value_body.rlike(pattern), v) if out is None else out.when(value_body.rlike(pattern), v)
        return out.otherwise(F.lit([ENCODINGS[-2][2] + "-_", 66][k]))

    value_body = F.regexp_replace(value, "=+$", "")
    d = lambda x: F.lit(float(x))

    def moments(x: Column) -> Column:
        """Sums over the characters' values, in order."""
        first = F.struct(d(-1).alias("last"), d(0).alias("s"), d(0).alias("ss"), d(0).alias("cross"), d(0).alias("runs"), d(0).alias("high"))
        half = x["size"] / 2

        def step(a: Column, v: Column) -> Column:
            begins = a["last"] < 0
            side = (v >= half) != (a["last"] >= half)
            return F.struct(
                v.alias("last"), (a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"), F.when(begins, a["cross"]).otherwise(a["cross"] + a["last"] * v).alias("cross"),
                (a["runs"] + F.when(begins | side, 1.0).otherwise(0.0)).alias("runs"), (a["high"] + F.when(v >= half, 1.0).otherwise(0.0)).alias("high"),
            )

        return F.aggregate(x["values"], first, step)

    def squares(x: Column) -> Column:
        """The sum of the squares of the characters' counts, from runs in sorted order."""
        first = F.struct(d(-1).alias("last"), d(0).alias("run"), d(0).alias("sum"))

        def step(a: Column, v: Column) -> Column:
            run = F.when(v == a["last"], a["run"] + 1).otherwise(1.0)
            return F.struct(v.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum"))

        return F.aggregate(F.array_sort(x["values"]), first, step, lambda a: a["sum"])

    def tests(y: Column) -> Column:
        n, k, m, sq = y["n"], y["size"], y["m"], y["squares"]
        chi = (k / n * sq - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        low = n - m["high"]
        runs_mean = 1 + 2 * m["high"] * low / n
        runs_var = F.greatest((runs_mean - 1) * (runs_mean - 2) / (n - 1), d(1e-9))
        runs = F.when((m["high"] == 0) | (low == 0), d(9)).otherwise((m["runs"] - runs_mean) / F.sqrt(runs_var))
        mean = m["s"] / n
        spread = F.greatest(m["ss"] - n * mean * mean, d(1e-9))
        serial = F.sqrt(n) * ((m["cross"] - (n - 1) * mean * mean) / spread + 1 / n)
        ps = [tail(chi), 2 * tail(F.abs(runs)), 2 * tail(F.abs(serial))]
        fisher = sum(-2 * F.ln(F.greatest(F.least(p, d(1)), d(1e-30))) for p in ps) / 2
        level = F.exp(-fisher) * (1 + fisher + fisher * fisher / 2)
        pairs, equal = n * (n - 1) / 2, (sq - n) / 2
        words = F.greatest(d(WORD_PAIRS), 1.6 / k)
        sd = F.sqrt(pairs * words * (1 - words) + n * pairs * words * words / 12)
        in_steps = lambda p: F.floor(F.least(F.greatest(-F.log10(F.greatest(p, d(10.0**-DEEPEST))), d(0)) * STEPS, d(DEEPEST * STEPS))).cast("int")
        return F.struct(n.cast("int").alias("n"), in_steps(level).alias("odd"), in_steps(tail((pairs * words - equal) / sd)).alias("depth"))

    inferred = F.struct(value_body.alias("body"), by_encoding(0).alias("alphabet"), by_encoding(1).cast("double").alias("size"))
    read = lambda e: F.struct(F.transform(F.split(e["body"], ""), lambda c: (F.call_function("instr", e["alphabet"], c) - 1).cast("double")).alias("values"), e["size"].alias("size"))
    return let(inferred, lambda e: let(read(e), lambda x: let(F.struct(F.size(x["values"]).cast("double").alias("n"), x["size"].alias("size"), moments(x).alias("m"), squares(x).alias("squares")), tests)))


def candidates(text: Column) -> Column:
    """array<struct<start,kind,end,n,odd,depth>> of the strings that are tested."""

    def tested(s: Column) -> Column:
        return let(battery(s["value"]), lambda b: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), b["n"].alias("n"), b["odd"].alias("odd"), b["depth"].alias("depth")))

    return F.transform(match_spans(text, CANDIDATE, "random"), tested)


def length_class(n: Column) -> Column:
    """Strings of similar length: whole powers of two."""
    return F.floor(F.log2(n)).cast("int")


def limits(docs: DataFrame, text: str = "text", false_rate: float = FALSE_RATE) -> dict[tuple[str, int], int]:
    """Per test (odd, depth) and class of length the least step at which the false discovery rate holds; at most one entry a power of two.

    Counts per test, class and step come from all candidates; there are at most 1,201 steps a class.
    """
    tests = F.array(*[F.struct(F.lit(t).alias("test"), F.col(f"c.{t}").alias("step")) for t in ("odd", "depth")])
    each = docs.select(F.explode(candidates(text_of(text))).alias("c")).select(length_class(F.col("c.n")).alias("class"), F.explode(tests).alias("t")).select("class", "t.test", "t.step")
    steps = each.groupBy("test", "class", "step").agg(F.count(F.lit(1)).alias("count"))
    of = Window.partitionBy("test", "class")
    found = steps.withColumn("deeper", F.sum("count").over(of.orderBy(F.desc("step")))).withColumn("all", F.sum("count").over(of))
    passed = found.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= false_rate * F.col("deeper") / F.col("all"))
    return {(r["test"], r["class"]): r["step"] for r in passed.groupBy("test", "class").agg(F.min("step").alias("step")).collect()}


def scan_secrets(docs: DataFrame, text: str = "text", false_rate: float = FALSE_RATE) -> DataFrame:
    """Adds secret_spans: array<struct<start,kind,end>> (kind: place in KINDS), by start, then kind; a column of that name is replaced."""
    limit = limits(docs, text, false_rate)
    t = text_of(text)
    base_name, random_name = free_name(docs, "__base"), free_name(docs, "__random")

    def reaches(test: str, c: Column) -> Column:
        least = F.lit(DEEPEST * STEPS + 1)
        for (name, k), step in sorted(limit.items()):
            if name == test:
                least = F.when(length_class(c["n"]) == k, step).otherwise(least)
        return c[test] >= least

    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    flagged = F.filter(candidates(t), lambda c: ~reaches("odd", c) & reaches("depth", c))
    found = docs.withColumn(base_name, F.transform(base_spans(t), bare)).withColumn(random_name, F.transform(flagged, bare))
    added = F.filter(random_name, lambda r: ~F.exists(base_name, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return found.withColumn("secret_spans", F.sort_array(F.concat(base_name, added))).drop(base_name, random_name)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id with the counts of base kinds, the digest of the base spans, and all spans."""
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["kind"] < KINDS.index("random"))
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def redacted(scanned: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The scanned rows with each span's characters replaced by the mask; overlapping spans are replaced together."""
    t = F.col(text)

    def pieces(spans: Column) -> Column:
        """What stands before each span and after the last, with masks between."""
        ends = F.transform(spans, lambda s: s["end"])

        def piece(s: Column, reach: Column) -> Column:
            return F.concat(F.substring(t, reach + 1, F.greatest(s["start"] - reach, F.lit(0))), F.when(s["start"] >= reach, mask).otherwise(""))

        return let(before(ends, F.lit(0), lambda a, b: F.greatest(a, b)), lambda reach: F.array_append(F.transform(spans, lambda s, i: piece(s, F.get(reach, i))), F.substring(t, F.array_max(ends) + 1, F.char_length(t))))

    whole = F.array_join(let(F.col("secret_spans"), pieces), "")
    return scanned.withColumn(text, F.when(F.size("secret_spans") > 0, whole).otherwise(t)).drop("secret_spans")
