"""Roles in transcripts by a hidden Markov model, and turns in one canonical form.

The segments of a transcript (turns or lines) have features: a speaker marker at
the start, the length, the number of lines and a question mark. A hidden Markov
model over the roles is counted from labelled segments; Viterbi's algorithm recovers
the roles of others, and each segment is rendered with its role; a marker of that role is removed.

Transcripts are cut into blocks: of BLOCK orders each, and where one of these has over
CROWDED rows, of one order each, which is cut further by ranges of the hash of the text,
by the hash itself, and by the row, each where too many rows share what is before. A first pass reduces each
block to its best scores from any role before it to any role at its end (a product
in the max-plus sense), blocks are chained per transcript, and a second pass decodes
each block between the roles at its ends. So no task holds a whole transcript; the
chain holds 12 numbers a block. The result is Viterbi's over the whole transcript.
The features are written to the shared folder first, so both passes see the same rows.

Roles can be recovered by a model counted from other transcripts: format_by_folds
counts one model in each half of the transcripts and applies it to the other half.

Defined results: a null key is a transcript of its own per different row; a null
order comes first; segments of equal order follow by a hash of the text; null text
counts as empty; rows are never dropped, repeated rows are repeated segments. Roles
other than ROLES, or null, don't count when the model is counted. A column named as
the new ones is replaced; names beginning with two underscores and the operator's
words (__key, __block, ...) are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

ROLES = ("system", "user", "assistant")
BLOCK, CROWDED = 4096, 16_384
# The markers of each role, at the start of a segment, any case.
MARKERS = {"system": ("system", "sys", "instructions"), "user": ("user", "human", "question", "q", "customer"), "assistant": ("assistant", "bot", "ai", "answer", "a", "agent")}
ALL, LONG = ("|".join(m for ms in MARKERS.values() for m in ms if len(m) >= least) for least in (1, 3))
OPEN, CLOSE, AFTER = r"(?:\[|<\|?|#+ ?|\*\*)", r"(?:\|?>|\]|\*\*)", r"(?::|>|-(?= )|\n)"
#: A marker that stands bare, or has one or two letters, counts with a colon only: "A" may be a line, "Agent - ..." a sentence.
MARKER = rf"(?i)^\s*(?={OPEN}(?:{LONG}){CLOSE}?\s*{AFTER}|{OPEN}?(?:{ALL}){CLOSE}?[ \t]*:){OPEN}?({ALL}){CLOSE}?\s*{AFTER}\s*"
SIZES = {"__marker": 4, "__length": 16, "__lines": 4, "__question": 2}
MARKER_BELIEF = 50.0  # how many segments the marker's meaning counts as


def marked_as(text: Column) -> Column:
    """The role of the text's speaker marker, null without one."""
    said = F.lower(F.regexp_extract(text, MARKER, 1))
    return F.coalesce(*[F.when(said.isin(*names), role) for role, names in MARKERS.items()])


def with_features(df: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Adds __key, __block, __part, __order, __tie, __row and the features' numbers; written to the shared folder."""
    t = text_of(text)
    marker = F.lit(0)
    for k, role in enumerate(ROLES):
        marker = F.when(marked_as(t).eqNullSafe(role), k + 1).otherwise(marker)
    place = F.coalesce(F.col(order).cast("long"), F.lit(-1))
    named = df.withColumns(
        {
            "__key": F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("n"), F.xxhash64(*df.columns).cast("string"))),
            "__order": place,
            "__block": F.floor(F.greatest(place, F.lit(0)) / BLOCK),
            "__tie": F.xxhash64(t),
            "__row": F.monotonically_increasing_id(),
            "__marker": marker,
            "__length": F.least(F.floor(F.log2(F.char_length(t) + 1)), F.lit(15)).cast("int"),
            "__lines": F.least(F.size(F.split(t, "\n")) - 1, F.lit(3)),
            "__question": t.contains("?").cast("int"),
        }
    )
    return with_parts(cut(named))


def with_parts(named: DataFrame) -> DataFrame:
    """Adds __part, null in blocks that are not crowded; blocks and parts follow the rows' order."""

    def crowded(df: DataFrame, by: list[str]) -> DataFrame:
        return cut(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CROWDED))

    kind = "struct<order:long,range:long,tie:long,row:long>"
    blocks = crowded(named, ["__key", "__block"])
    if blocks.isEmpty():
        return named.withColumn("__part", F.lit(None).cast(kind))

    def step(df: DataFrame, by: list[str], among: str, count: str) -> DataFrame:
        """Adds the count of rows alike in by, where these are crowded and the last step's were."""
        return df.join(crowded(df.where(F.col(among).isNotNull()), by).withColumnRenamed("__n", count), by, "left")

    part_of = lambda count, hashed: F.floor((hashed.cast("double") + 2.0**63) / F.floor(F.lit(2.0**64) / F.ceil(F.col(count) / BLOCK)))
    now = step(named.join(blocks, ["__key", "__block"], "left"), ["__key", "__order"], "__n", "__of_order")
    now = now.withColumn("__range", F.coalesce(part_of("__of_order", F.col("__tie")), F.lit(0)))
    now = step(now, ["__key", "__order", "__range"], "__of_order", "__of_range")
    now = step(now, ["__key", "__order", "__tie"], "__of_range", "__of_tie")
    tie = F.when(F.col("__of_range").isNotNull(), F.col("__tie")).otherwise(0)
    row = F.coalesce(part_of("__of_tie", F.xxhash64("__row")), F.lit(0))
    part = F.struct(F.col("__order").alias("order"), F.col("__range").alias("range"), tie.alias("tie"), row.alias("row")).cast(kind)
    return now.withColumn("__part", F.when(F.col("__n").isNotNull(), part)).drop("__n", "__of_order", "__range", "__of_range", "__of_tie")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows (the first columns are the key), with the groups' starts and the end.

    Rows wait until their group ends; each is put together with the others once.
    """
    held: list[pa.Table] = []
    starts, n, last = [np.zeros(0, np.int64)], 0, None

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = np.zeros(table.num_rows, bool)
        now = []
        for k in range(keys):
            codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
            now.append((batch.column(k)[0].as_py(), batch.column(k)[-1].as_py()))
        new[0] = last is None or last != [first for first, _ in now]
        last = [end for _, end in now]
        begins = np.flatnonzero(new)
        if len(begins) and n + int(begins[-1]):
            cut_at = int(begins[-1])
            held.append(table.slice(0, cut_at))
            yield pa.concat_tables(held), np.concatenate([*starts, begins[:-1] + n, [n + cut_at]])
            held, starts, n = [table.slice(cut_at)], [np.zeros(1, np.int64)], table.num_rows - cut_at
        else:
            held.append(table)
            starts.append(begins + n)
            n += table.num_rows
    if n:
        yield pa.concat_tables(held), np.append(np.concatenate(starts), n)


FEATURES = ("__marker", "__length", "__lines", "__question")


def sorted_blocks(df: DataFrame, more: list[str]) -> DataFrame:
    """__key, __block and __part first, then the features and more; each block together and in order."""
    together = df.repartition("__key", "__block", "__part").sortWithinPartitions("__key", "__block", "__part", "__order", "__tie", "__row")
    return together.select("__key", "__block", F.to_json("__part").alias("__part"), *FEATURES, *more)


class RoleModel:
    """Log-probabilities of first roles, of roles after roles, and of each feature's values per role."""

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        def table(name: str, rows: int, columns: int) -> np.ndarray:
            out = np.full((rows, columns), 0.5)
            for (n, i, j), c in counts.items():
                if n == name:
                    out[i, j] += c
            if name == "__marker":
                out[:, 0] += MARKER_BELIEF
                out[np.arange(rows), np.arange(rows) + 1] += MARKER_BELIEF
            return np.log(out / out.sum(axis=1, keepdims=True))

        k = len(ROLES)
        self.next = table("next", k, k)
        self.begin = table("first_role", 1, k)[0]
        self.features = {name: table(name, k, SIZES[name]) for name in FEATURES}

    def emissions(self, table: pa.Table) -> np.ndarray:
        """Rows by roles."""
        return sum(self.features[name][:, table.column(name).to_numpy()] for name in self.features).T


def count_model(df: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", role: str = "role") -> RoleModel:
    """The model of labelled segments; each task adds up its own counts, which are of bounded number."""
    return counted_models(with_features(df, key, order, text).withColumn("__fold", F.lit(0)), role, 1)[0]


def counted_models(featured: DataFrame, role: str, folds: int) -> list[RoleModel]:
    """For each fold the model of the segments of the other folds (of the only fold: of its own)."""
    known = featured.withColumn("__role", F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.coalesce(F.col(role), F.lit(""))).cast("int") - 1)

    def run(batches):
        sums: dict[tuple[int, str, int, int], int] = {}

        def add(name: str, fold: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
            for v, n in zip(*np.unique((fold.astype(np.int64) * 1000 + i) * 1000 + j, return_counts=True), strict=True):
                place = (int(v) // 1_000_000, name, int(v) // 1000 % 1000, int(v) % 1000)
                sums[place] = sums.get(place, 0) + int(n)

        for table, starts in whole_groups(batches, 3):
            roles, fold = table.column("__role").to_numpy(), table.column("__fold").to_numpy()
            good = roles >= 0
            for name in FEATURES:
                add(name, fold[good], roles[good], table.column(name).to_numpy()[good])
            first = np.zeros(len(roles), bool)
            first[starts[starts < len(roles)]] = True
            opening = first & good & table.column("__opens").to_numpy(zero_copy_only=False)
            add("first_role", fold[opening], np.zeros(opening.sum(), np.int64), roles[opening])
            after = ~first[1:] & good[1:] & good[:-1]
            add("next", fold[1:][after], roles[:-1][after], roles[1:][after])
        rows = list(sums.items())
        columns = [pa.array([r[0][k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int64())], names=["fold", "name", "i", "j", "n"])

    counted = sorted_blocks(with_openings(known), ["__role", "__fold", "__opens"]).mapInArrow(run, "fold int, name string, i int, j int, n long").groupBy("fold", "name", "i", "j").agg(F.sum("n").alias("n")).collect()
    models = []
    for fold in range(folds):
        sums: dict[tuple[str, int, int], float] = {}
        for r in counted:
            if folds == 1 or r["fold"] != fold:
                place = (r["name"], r["i"], r["j"])
                sums[place] = sums.get(place, 0.0) + r["n"]
        models.append(RoleModel(sums))
    return models


def with_openings(featured: DataFrame) -> DataFrame:
    """Adds __opens: the row's block is the first of its transcript."""
    firsts = featured.groupBy("__key").agg(F.min(F.struct("__block", "__part")).alias("__first"))
    return featured.join(firsts, "__key").withColumn("__opens", (F.col("__block") == F.col("__first.__block")) & F.col("__part").eqNullSafe(F.col("__first.__part"))).drop("__first")


def by_position(starts: np.ndarray) -> list[np.ndarray]:
    """For each position the groups that are long enough."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    reach = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right") if len(sizes) else []
    return [order[:r] for r in reach]


def transfers(model: RoleModel, emissions: np.ndarray, starts: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Per group the best scores from each role before it (of an opening group: from its begin, in every row) to each role at its end."""
    k = len(ROLES)
    scores = np.zeros((len(starts) - 1, k, k))
    for t, groups in enumerate(by_position(starts)):
        here = emissions[starts[groups] + t][:, None, :]
        if t == 0:
            scores[groups] = np.where(opening[groups][:, None, None], model.begin[None, None, :], model.next[None]) + here
        else:
            scores[groups] = (scores[groups][:, :, :, None] + model.next[None, None]).max(axis=2) + here
    return scores


def decoded(model: RoleModel, emissions: np.ndarray, starts: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The best roles of each group between the role before it (-1: it opens) and the role at its end."""
    positions = by_position(starts)
    score = np.zeros((len(starts) - 1, len(ROLES)))
    back = np.zeros((len(emissions), len(ROLES)), np.int8)
    for t, groups in enumerate(positions):
        at = starts[groups] + t
        if t == 0:
            opens = before[groups] < 0
            score[groups] = np.where(opens[:, None], model.begin[None], model.next[np.maximum(before[groups], 0)]) + emissions[at]
        else:
            steps = score[groups][:, :, None] + model.next[None]
            back[at] = steps.argmax(axis=1)
            score[groups] = steps.max(axis=1) + emissions[at]
    roles = np.zeros(len(emissions), np.int64)
    last = starts[1:] - 1
    roles[last] = after
    for t in range(len(positions) - 1, 0, -1):
        at = starts[positions[t]] + t
        roles[at - 1] = back[at, roles[at]]
    return roles


def chained(blocks: DataFrame, model: RoleModel) -> DataFrame:
    """__key, __block, __part, before and after: the roles around each block on the best path of the whole transcript."""

    def run(batches):
        for table, starts in whole_groups(batches, 1):
            k = len(ROLES)
            matrices = np.array(table.column("scores").to_pylist(), dtype=float).reshape(-1, k, k)
            before, after = np.full(len(matrices), -1), np.zeros(len(matrices), np.int64)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                total, backs = matrices[a][0], []
                for m in matrices[a + 1 : b]:
                    steps = total[:, None] + m
                    backs.append(steps.argmax(axis=0))
                    total = steps.max(axis=0)
                role = int(total.argmax())
                for at in range(b - 1, a - 1, -1):
                    after[at] = role
                    if at > a:
                        role = int(backs[at - a - 1][role])
                        before[at] = role
            keys = [table.column(c).combine_chunks() for c in ("__key", "__block", "__part")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(before, pa.int32()), pa.array(after, pa.int32())], names=["__key", "__block", "__part", "__before", "__after"])

    part = F.from_json("__part", "order long, range long, tie long, row long")
    together = blocks.withColumn("__sort", part).repartition("__key").sortWithinPartitions("__key", "__block", "__sort")
    return together.select("__key", "__block", "__part", "scores").mapInArrow(run, "__key string, __block long, __part string, __before int, __after int")


def recover_roles(df: DataFrame, model: RoleModel, key: str = "conv_id", order: str = "turn", text: str = "text", out: str = "recovered") -> DataFrame:
    """df with the recovered role of each segment."""
    ours = [c for c in df.columns if c != out]
    return decode_roles(with_features(df, key, order, text), model, ours, out)


def decode_roles(featured: DataFrame, model: RoleModel, ours: list[str], out: str) -> DataFrame:
    """The columns ours of featured rows with the recovered role."""

    def scores(batches):
        for table, starts in whole_groups(batches, 3):
            heads = table.take(pa.array(starts[:-1]))
            opening = heads.column("__opens").to_numpy(zero_copy_only=False)
            found = transfers(model, model.emissions(table), starts, opening).reshape(len(heads), -1)
            keys = [heads.column(c).combine_chunks() for c in ("__key", "__block", "__part")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found.tolist(), pa.list_(pa.float64()))], names=["__key", "__block", "__part", "scores"])

    blocks = sorted_blocks(with_openings(featured), ["__opens"]).mapInArrow(scores, "__key string, __block long, __part string, scores array<double>")
    ends = chained(blocks, model).withColumnsRenamed({"__key": "__k", "__block": "__b", "__part": "__p"})
    here = (F.col("__key") == F.col("__k")) & (F.col("__block") == F.col("__b")) & F.to_json("__part").eqNullSafe(F.col("__p"))
    located = featured.join(ends, here).drop("__k", "__b", "__p")
    kept = sorted_blocks(located, ["__before", "__after", *[F.col(f"`{c}`") for c in ours]])
    names = kept.columns[3 + len(FEATURES) + 2 :]
    schema = kept.select(*[F.col(f"`{c}`") for c in names]).schema.add(out, "string")

    def roles(batches):
        for table, starts in whole_groups(batches, 3):
            found = decoded(model, model.emissions(table), starts, table.column("__before").to_numpy()[starts[:-1]], table.column("__after").to_numpy()[starts[:-1]])
            named = pa.array([ROLES[r] for r in found.tolist()], pa.string())
            yield from pa.Table.from_arrays([*(table.column(n) for n in names), pa.chunked_array([named])], names=[*names, out]).combine_chunks().to_batches()

    return kept.mapInArrow(roles, schema)


def transcript_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 0) and text of every line of whole transcripts, one transcript a row."""
    return df.select(F.col(key), F.posexplode(F.split(text_of(text), "\n")).alias("line", "text"))


def rendered(df: DataFrame, text: str = "text", role: str = "recovered", out: str = "rendered") -> DataFrame:
    """Adds the turn in its canonical form; a speaker marker of the turn's role is removed, all else of the text stays."""
    whole = text_of(text)
    body = F.when(marked_as(whole).eqNullSafe(F.col(role)), F.regexp_replace(whole, MARKER, "")).otherwise(whole)
    return df.withColumn(out, F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"), body, F.lit("\n<|end|>\n")))


def format_conversations(df: DataFrame, model: RoleModel) -> DataFrame:
    """conv_id, turn and text of df with recovered roles and canonical turns."""
    return rendered(recover_roles(df.select("conv_id", "turn", "text"), model))


def format_by_folds(df: DataFrame, folds: int = 2) -> DataFrame:
    """conv_id, turn and text of df with roles recovered by models of other transcripts' roles, and canonical turns."""
    featured = with_features(df.select("conv_id", "turn", "text", "role")).withColumn("__fold", F.pmod(F.xxhash64("__key"), F.lit(folds)).cast("int"))
    models = counted_models(featured, "role", folds)
    parts = [decode_roles(featured.where(F.col("__fold") == k), model, ["conv_id", "turn", "text"], "recovered") for k, model in enumerate(models)]
    return rendered(reduce(DataFrame.union, parts))
