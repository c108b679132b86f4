"""Labels from outside models held to fixed lists, and names of files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.boundaries import let

# The interest of each class of sound; a class that is not named has OTHER_SOUND.
SOUND_WEIGHTS = {
    "Laughter": 1.0, "Giggle": 0.95, "Chuckle, chortle": 0.9, "Baby laughter": 1.0, "Belly laugh": 1.0, "Snicker": 0.9, "Child speech, kid speaking": 0.85,
    "Cheering": 0.8, "Clapping": 0.7, "Applause": 0.7, "Crowd": 0.5, "Whoop": 0.75, "Baby cry, infant cry": 0.6, "Babbling": 0.7,
    "Speech": 0.4, "Conversation": 0.5, "Narration, monologue": 0.3, "Children shouting": 0.6, "Singing": 0.8, "Choir": 0.7, "Music": 0.4, "Musical instrument": 0.5,
    "Engine": 0.5, "Motor vehicle (road)": 0.4, "Car": 0.4, "Motorcycle": 0.5, "Race car, auto racing": 0.7, "Aircraft": 0.4, "Boat, Water vehicle": 0.4,
    "Bird": 0.3, "Ocean": 0.3, "Wind": 0.2, "Water": 0.3, "Rain": 0.3, "Thunder": 0.4, "Dog": 0.4, "Cat": 0.3, "Animal": 0.3,
    "Silence": 0.0, "White noise": 0.0, "Static": 0.0, "Noise": 0.1,
}
OTHER_SOUND = 0.2
#: Sounds that a cut should not fall into.
PROTECTED_SOUNDS = ("Laughter", "Giggle", "Chuckle, chortle", "Baby laughter", "Speech", "Singing", "Cheering", "Applause")

# What answers about moods may hold, and what stands for anything else.
MOODS = ("happy", "sad", "calm", "energetic", "romantic", "dramatic", "playful", "nostalgic", "mysterious", "inspiring", "peaceful", "melancholic", "uplifting", "tender", "exciting")
GENRES = ("acoustic", "electronic", "cinematic", "classical", "jazz", "pop", "rock", "ambient", "folk", "indie", "orchestral", "piano", "guitar", "upbeat", "relaxing")
CHOICES = {"energy_level": (("low", "medium", "high"), "medium"), "tempo_suggestion": (("slow", "medium", "fast"), "medium"), "color_palette": (("warm", "cool", "neutral", "vibrant", "muted"), "neutral")}
MOST_GENRES, LONGEST = 5, 500
MOOD_JSON = "primary_mood string, secondary_mood string, energy_level string, tempo_suggestion string, color_palette string, genre_suggestions string, description string, confidence string"


def sound_weight(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SOUND_WEIGHTS.items() for x in pair])[kind], F.lit(OTHER_SOUND))


def is_protected(kind: Column) -> Column:
    return F.coalesce(kind.isin(*PROTECTED_SOUNDS), F.lit(False))


def mood(answer: Column) -> Column:
    """struct of a mood from an answer in JSON, fences around it or not: each word is trimmed, lower-cased and held to its list.

    Of genres the first five are looked at, and one is 'ambient' if none is known; a confidence that is no number is 0.7; what
    cannot be read at all is calm, medium and neutral.
    """
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    texts = F.from_json(F.trim(F.when(answer.contains("```"), fenced).otherwise(answer)), MOOD_JSON)
    words = ("primary_mood", "secondary_mood", *CHOICES)
    fields = lambda r: F.struct(*[F.lower(F.trim(r[w])).alias(w) for w in words], F.from_json(r["genre_suggestions"], "array<string>").alias("genres"), r["description"].alias("description"), r["confidence"].try_cast("double").alias("confidence"))
    return let(let(texts, fields), _held)


def _held(read: Column) -> Column:
    """What may be of the lower-cased words, genres, description and confidence that were read; each is read once."""
    held = lambda name, known, other: F.when(read[name].isin(*known), read[name]).otherwise(other)
    known = F.filter(F.transform(F.slice(read["genres"], 1, MOST_GENRES), lambda g: F.lower(F.trim(g))), lambda g: g.isin(*GENRES))
    genres = let(known, lambda some: F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("ambient"))))
    number = read["confidence"]
    sure = F.when(number.isNull(), 0.7).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    said = F.regexp_replace(F.substring(F.coalesce(read["description"], F.lit("")), 1, LONGEST), r"[\p{Cc}&&[^\n\t]]", "")
    choices = [held(name, known, other).alias(name) for name, (known, other) in CHOICES.items()]
    return F.struct(held("primary_mood", MOODS, "calm").alias("primary_mood"), held("secondary_mood", MOODS, None).alias("secondary_mood"), *choices, genres.alias("genres"), said.alias("description"), sure.alias("confidence"))


def range_slug(start: Column, end: Column) -> Column:
    """2025 for a whole year, march_2025 for days of one month, mar-may_2025 within a year, else both days as digits."""
    year, month = F.year(start), lambda d, form: F.lower(F.date_format(d, form))
    whole = (F.date_format(start, "MM-dd") == "01-01") & (F.date_format(end, "MM-dd") == "12-31")
    same_year = F.year(start) == F.year(end)
    return (
        F.when(same_year & whole, year.cast("string"))
        .when(same_year & (F.month(start) == F.month(end)), F.concat_ws("_", month(start, "MMMM"), year))
        .when(same_year, F.concat(month(start, "MMM"), F.lit("-"), month(end, "MMM"), F.lit("_"), year))
        .otherwise(F.concat_ws("-", F.date_format(start, "yyyyMMdd"), F.date_format(end, "yyyyMMdd")))
    )


def file_name(kind: Column, names: Column, person: Column, start: Column, end: Column, year: Column, month: Column, season: Column, location: Column, container: str = "mp4") -> Column:
    """who_when_memories.mp4: the people (three at most of several), trip or everyone; the place, season, month, day or range. Parts that are null or empty are left out."""
    lower = F.transform(names, lambda x: F.lower(x))
    several = F.concat(F.array_join(F.slice(lower, 1, 3), "_"), F.when(F.size(names) > 3, "_and_others").otherwise(""))
    some = F.coalesce(F.size(names) > 0, F.lit(False))
    who = F.when((kind == "multi_person") & some, several).when(kind == "trip", "trip").when(some, F.get(lower, F.lit(0))).otherwise(F.lower(F.coalesce(F.nullif(person, F.lit("")), F.lit("everyone"))))
    y = F.coalesce(year.cast("string"), F.lit(""))
    both = start.isNotNull() & end.isNotNull()
    place = F.regexp_replace(F.regexp_replace(F.lower(location), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    name_of = lambda m: F.lower(F.date_format(F.make_date(F.lit(2000), m, F.lit(1)), "MMMM"))
    monthly = F.when(month.isNotNull(), F.concat_ws("_", name_of(month), year)).otherwise(y)
    when = (
        F.when(kind == "trip", F.when(location.isNotNull() & (location != ""), place).when(both, range_slug(start, end)).otherwise(y))
        .when(kind == "season", F.when(season.isNotNull() & year.isNotNull(), F.concat_ws("_", season, year)).otherwise(y))
        .when(kind == "monthly_highlights", monthly)
        .when((kind == "on_this_day") & start.isNotNull(), F.concat_ws("_", name_of(F.month(start)), F.dayofmonth(start)))
        .when(both, range_slug(start, end)).otherwise(y)
    )
    return F.concat(F.array_join(F.filter(F.array(who, when), lambda p: p.isNotNull() & (p != "")), "_"), F.lit(f"_memories.{container}"))
