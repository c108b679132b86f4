"""Tolerant reading of JSON, names and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wire_duration(text: Column) -> Column:
    """Seconds from H:M:S, M:S or S in text; null for anything else."""
    parts = F.split(F.trim(text), ":")
    seconds = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 3, seconds(0) * 3600 + seconds(1) * 60 + seconds(2)).when(F.size(parts) == 2, seconds(0) * 60 + seconds(1)).when(F.size(parts) == 1, seconds(0))


def wire_milliseconds(value: Column) -> Column:
    """Seconds from whole milliseconds."""
    return value / 1000.0


def json_body(text: Column) -> Column:
    """The first object in a model's answer: thoughts and fences removed, a missing closing brace added."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    cut = F.regexp_extract(bare, r"(?s)(\{.*)$", 1)
    return F.when(F.length(body) > 0, body).when(F.length(cut) > 0, F.concat(F.rtrim(cut), F.lit("}")))


def json_number(text: Column, field: str, low: float, high: float) -> Column:
    """A number of a tolerant object, held between two ends; null where there is none."""
    found = F.get_json_object(json_body(text), f"$.{field}").try_cast("double")
    return F.greatest(F.lit(low), F.least(F.lit(high), found))


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, cut at a word and with an ellipsis where something is missing."""
    head = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*\z", "")
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(head, F.lit("…")))


def first_category(label: Column, keywords: dict[str, str]) -> Column:
    """The category of the first keyword that the label holds, in the order given; null if none."""
    out = None
    for word, category in keywords.items():
        out = F.when(F.lower(label).contains(word), category) if out is None else out.when(F.lower(label).contains(word), category)
    return out


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, ..."""
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def place_name(city: Column, country: Column) -> Column:
    return F.concat_ws(", ", F.nullif(F.trim(city), F.lit("")), F.nullif(F.trim(country), F.lit("")))


def subject(tagged: Column, label: Column, known: list[str]) -> Column:
    """people where someone is tagged, else the label if it is one of the known, else unknown."""
    return F.when(tagged, "people").when(label.isin(*known), label).otherwise("unknown")


#: Words for emotions that come as numbers, by the least number of each.
EMOTIONS = ((0.8, "joyful"), (0.6, "happy"), (0.4, "calm"), (0.2, "neutral"))
MOST_SUBJECTS = 10


def emotion_of(value: Column) -> Column:
    """The word for an emotion between 0 and 1."""
    word = F.lit("subdued")
    for least, name in reversed(EMOTIONS):
        word = F.when(value >= least, name).otherwise(word)
    return F.when(value.isNotNull(), word)


def partial_analysis(text: Column) -> Column:
    """struct of what can be read of an analysis in broken JSON: description, emotion, interestingness, quality, setting, category, subjects, confidence.

    Fields that aren't there are null, the emotion is empty; confidence is 0.6 where a description or an emotion was found, else 0.4.
    """
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    word = lambda name: found(rf'"{name}"\s*:\s*"([^"]+)"')
    number = lambda name: found(rf'"{name}"\s*:\s*([\d.]+)').try_cast("double")
    said = F.replace(F.replace(found(r'"description"\s*:\s*"([^"\\]*(?:\\.[^"\\]*)*)"'), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" "))
    emotion = F.coalesce(word("emotion"), emotion_of(number("emotion")), F.lit(""))
    listed = F.transform(F.split(found(r'"subjects"\s*:\s*\[([^\]]*)\]'), ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))
    subjects = F.slice(F.filter(listed, lambda x: x != ""), 1, MOST_SUBJECTS)
    sure = F.when(said.isNotNull() | (emotion != ""), 0.6).otherwise(0.4)
    return F.struct(said.alias("description"), emotion.alias("emotion"), number("interestingness").alias("interestingness"), number("quality").alias("quality"), word("setting").alias("setting"), word("category").alias("category"), subjects.alias("subjects"), sure.alias("confidence"))


def recipe_hash(kind: Column, start: Column, end: Column, seconds: Column, clips: Column, extras: Column | None = None) -> Column:
    """Eight digits of a hash of what decides an edit: the same clips (array<struct<id,start,end>>, in order) and settings give the same.

    The JSON that is hashed has sorted names, no spaces, and times rounded to hundredths; nulls are empty. extras: map<string,string>.
    """
    quoted = lambda c: F.to_json(F.array(F.coalesce(c.cast("string"), F.lit("")))).substr(F.lit(2), F.lit(1 << 20))  # noqa: E731  ends with ]
    word = lambda c: F.regexp_replace(quoted(c), r"\]$", "")
    clip = F.transform(clips, lambda x: F.concat(F.lit("["), word(x["id"]), F.lit(","), F.round(x["start"], 2).cast("string"), F.lit(","), F.round(x["end"], 2).cast("string"), F.lit("]")))
    entries = F.array_sort(F.map_entries(extras)) if extras is not None else F.array().cast("array<struct<key:string,value:string>>")
    named = F.array_join(F.transform(entries, lambda e: F.concat(word(e["key"]), F.lit(":"), word(e["value"]))), ",")
    parts = [F.lit('{"clips":['), F.array_join(clip, ","), F.lit('],"date_end":'), word(end), F.lit(',"date_start":'), word(start), F.lit(',"extras":{'), named, F.lit('},"memory_type":'), word(kind), F.lit(',"target_duration":'), F.round(seconds, 2).cast("string"), F.lit("}")]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 8)
