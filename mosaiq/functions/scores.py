"""Scores of clips, segments and candidates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clip_quality(width: Column, height: Column, bitrate: Column, duration: Column) -> Column:
    """0.4 resolution, 0.4 bit rate and 0.2 duration, against 4K, 50 Mb/s and 60 s; an unknown bit rate counts half."""
    pixels = F.least(F.lit(1.0), width * height / F.lit(3840.0 * 2160.0))
    rate = F.when(F.coalesce(bitrate, F.lit(0)) > 0, F.least(F.lit(1.0), bitrate / F.lit(50_000_000.0))).otherwise(0.5)
    return 0.4 * pixels + 0.4 * rate + 0.2 * F.least(F.lit(1.0), duration / F.lit(60.0))


def group_quality(width: Column, height: Column, bitrate: Column, duration: Column, stability: Column) -> Column:
    """For the best of a group of duplicates: 0.4 resolution, 0.3 bit rate, 0.2 duration, 0.1 stability (unknown: 0.5)."""
    pixels = F.least(F.lit(1.0), width * height / F.lit(3840.0 * 2160.0))
    rate = F.least(F.lit(1.0), F.coalesce(bitrate, F.lit(0)) / F.lit(50_000_000.0))
    return 0.4 * pixels + 0.3 * rate + 0.2 * F.least(F.lit(1.0), duration / F.lit(60.0)) + 0.1 * F.coalesce(stability, F.lit(0.5))


def duration_preference(duration: Column, optimum: Column) -> Column:
    """A bell around the optimum, as wide as 0.6 of it and 3 s at least."""
    width = F.greatest(F.lit(3.0), 0.6 * optimum)
    return F.exp(-F.pow(duration - optimum, 2) / (2 * width * width))


def stability_score(deviation: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - deviation / 20.0)


def camera_stability(variance: Column) -> Column:
    return clamp(1 - variance / 50.0, 0.0, 1.0)


def face_score(coverage: Column, faces: Column) -> Column:
    return F.least(F.lit(1.0), F.least(coverage / 0.15, F.lit(1.0)) + F.least(0.1 * faces, F.lit(0.3)))


def content_score(interest: Column, quality: Column) -> Column:
    return clamp(0.7 * interest + 0.3 * quality, 0.0, 1.0)


def candidate_score(base: Column, is_new: Column, days_ago: Column, n_assets: Column, days_since_run: Column) -> Column:
    """A fifth more when new, a linear decay over a year down to half, 30 % by the logarithm of the size, less after a recent run of its kind (null: none)."""
    fresh = base * F.when(is_new, 1.2).otherwise(1.0) * F.greatest(F.lit(0.5), 1 - days_ago / 365.0)
    richness = F.least(F.lit(1.0), F.ln(F.greatest(F.lit(1), n_assets)) / F.ln(F.lit(1000.0)))
    cooling = F.when(days_since_run <= 7, 0.3).when(days_since_run <= 30, 0.7).otherwise(1.0)
    return clamp((fresh * 0.7 + fresh * 0.3 * richness) * cooling, 0.0, 1.0)


def trip_score(days: Column, n_assets: Column) -> Column:
    return 0.75 * F.least(F.lit(1.0), days / 14.0) * F.least(F.lit(1.0), n_assets / 200.0)


def shared_estimate(a: Column, b: Column) -> Column:
    """A guess of how many assets two people share."""
    return F.floor(F.least(a, b) * 0.3).cast("long")


def trip_duration(days: Column) -> Column:
    return clamp(30.0 + 10.0 * days, 60.0, 300.0)


def range_duration(days: Column) -> Column:
    """Seconds for a range of days: a quadratic through 1, 6 and 12 months, 30 to 600."""
    months = F.greatest(F.lit(1), days) / 30.0
    return clamp((-20 * months * months + 800 * months - 120) / 11, 30.0, 600.0)


def motion_score(mean: Column) -> Column:
    """Some motion is good, none or much is not."""
    return F.when(mean < 1, 0.3).when(mean < 5, 0.5 + (mean - 1) * 0.125).when(mean < 15, 1.0 - (mean - 5) * 0.05).otherwise(0.3)


def photo_score(favorite: Column, people: Column, camera: Column, penalty: float) -> Column:
    """The metadata score of a photo, for which no model's score is known."""
    faces = F.when(people > 0, 0.15 + F.least(F.lit(0.10), 0.10 * people / 3)).otherwise(0.0)
    raw = 0.15 + F.when(favorite, 0.25).otherwise(0.0) + faces + F.when(camera, 0.05).otherwise(0.0) + 0.15
    return clamp(raw, 0.0, 1.0) * (1.0 - penalty)


def backoff_hours(failures: Column) -> Column:
    """How long a key waits after so many failures in a row; null: not at all."""
    return F.when(failures == 2, 24).when(failures == 3, 72).when(failures > 3, 168)


def quota_for(ratio: float, expected: Column) -> Column:
    """A share of the finished video, one at least; none for a ratio of zero."""
    return F.greatest(F.lit(1), F.bround(F.lit(ratio) * expected)).cast("int") if ratio > 0 else F.lit(0)


def with_model_score(metadata: Column, model: Column, penalty: float) -> Column:
    """A photo's metadata score with a model's score in the place that was held for it."""
    return clamp(metadata / (1.0 - penalty) - 0.15 + 0.3 * model, 0.0, 1.0) * (1.0 - penalty)


def normal_weights(*weights: Column) -> list[Column]:
    """The weights as shares of their sum."""
    total = sum(weights[1:], weights[0])
    return [F.when(total > 0, w / F.nullif(total, F.lit(0))).otherwise(w) for w in weights]


def moment_order(total: Column, parts: list[Column], start: Column, end: Column, length: Column, tie: Column) -> Column:
    """struct by which moments of a video are ordered, the best first: the total, how far its parts differ, and the distance from the video's middle; then the tie.

    Moments of one total go by the larger variance of their parts.
    """
    mean = sum(parts[1:], parts[0]) / len(parts)
    variance = sum(((p - mean) * (p - mean) for p in parts[1:]), (parts[0] - mean) * (parts[0] - mean)) / len(parts)
    middle = length / 2
    away = F.abs((start + end) / 2 - middle) / F.greatest(middle, F.lit(0.001))
    return F.struct((-total).alias("total"), (-F.round(variance, 9)).alias("variance"), F.round(away, 9).alias("away"), tie.alias("tie"))
