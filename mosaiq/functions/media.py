"""Properties of clips and photos, and rules on them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transfer functions of high dynamic range and their names.
HDR_FORMATS = {"smpte2084": "HDR10", "arib-std-b67": "HLG", "smpte428": "DCI-P3"}


def is_hdr(transfer: Column) -> Column:
    return F.coalesce(transfer.isin(*HDR_FORMATS), F.lit(False))


def hdr_format(transfer: Column) -> Column:
    out = F.lit("SDR")
    for key, name in HDR_FORMATS.items():
        out = F.when(transfer == key, name).otherwise(out)
    return out


def displayed(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """Width and height as they are seen, after rotation."""
    turned = F.coalesce(rotation.isin(90, 270), F.lit(False))
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height == 0, 0.0).otherwise(width / F.nullif(height, F.lit(0)))


def camera_original(make: Column, model: Column) -> Column:
    return (F.coalesce(make, F.lit("")) != "") | (F.coalesce(model, F.lit("")) != "")


def usable_source(width: Column, height: Column, camera: Column, least: int) -> Column:
    """Sizes that are unknown pass, large enough ones pass, others only from a camera."""
    short = F.when((width > 0) & (height > 0), F.least(width, height)).otherwise(0)
    return (short == 0) | (short >= least) | camera


def passes_quality_gate(favorite: Column, camera: Column, width: Column, height: Column, output: int) -> Column:
    """Favorites, and camera clips of at least half the output's size (540 at least) or of unknown size."""
    long = F.greatest(width, height)
    return favorite | (camera & ((long >= max(540, int(output * 0.5))) | (long == 0)))


def badges(width: Column, height: Column, hdr: Column) -> Column:
    """Labels of a clip: 4K or HD by either side, and HDR."""
    size = F.when((width >= 3840) | (height >= 2160), "4K").when((width >= 1920) | (height >= 1080), "HD")
    return F.array_compact(F.array(size, F.when(hdr, "HDR")))


def longest_segment(source: Column, most: float, good: Column) -> Column:
    """How long a segment of a source may be: all of a short one, most (15 % more if good) to 60 s, then up to a fifth."""
    graced = most * F.when(good, 1.15).otherwise(1.0)
    return F.when(source <= most, source).when(source <= 60, F.least(graced, source)).otherwise(F.greatest(F.lit(most), F.least(source * 0.2, graced)))


def segment_score(visual: Column, audio: Column, duration: Column, content: Column, cut: Column, laughter: Column, audio_weight: float = 0.15, duration_weight: float = 0.15, content_weight: float = 0.2, laughter_bonus: float = 0.1) -> Column:
    """A base of three parts and bonuses; a base under 0.7 doesn't carry its bonuses past 0.8."""
    seen = max(0.0, 1.0 - audio_weight - duration_weight)
    scale = 1.0 if seen or not audio_weight + duration_weight else 1.0 / (audio_weight + duration_weight)
    base = visual * seen + audio * (audio_weight * scale) + duration * (duration_weight * scale)
    total = base + F.greatest(F.lit(0.0), content - 0.5) * (content_weight * 2) + cut * 0.15 + F.when(laughter, laughter_bonus).otherwise(0.0)
    return F.when(base < 0.7, F.least(total, F.lit(0.8))).otherwise(total)


def title_overhead(title: float, ending: float, dividers: Column, divider: float, clips: Column, target: Column, trip: bool = False, fade: float = 0.5) -> Column:
    """Seconds that titles take, less what fades save; at most a fifth of the target, for trips 10 to 30 %."""
    saved = F.when(clips > 0, (clips + 1) * fade * 0.5).otherwise(0.0)
    whole = F.greatest(F.lit(0.0), title + ending + dividers * divider - saved)
    return F.greatest(F.least(whole, target * 0.3), target * 0.1) if trip else F.least(whole, target * 0.2)


def frame_quality(pixels: Column, ideal: float = 128.0, tolerance: float = 128.0) -> Column:
    """struct<sharpness, contrast, exposure> of rows of grey values (array<array<double>>)."""
    flat = F.flatten(pixels)
    n = F.size(flat)
    mean_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    variance = lambda xs: mean_of(F.transform(xs, lambda x: x * x)) - F.pow(mean_of(xs), 2)
    down = lambda r, k: F.abs(F.get(F.get(pixels, r + 1), k) - F.get(F.get(pixels, r), k))
    across = lambda r, k: F.abs(F.get(F.get(pixels, r), k + 1) - F.get(F.get(pixels, r), k))
    edges = F.flatten(F.transform(F.sequence(F.lit(0), F.size(pixels) - 2), lambda r: F.transform(F.sequence(F.lit(0), F.size(F.get(pixels, F.lit(0))) - 2), lambda k: down(r, k) + across(r, k))))
    exposure = F.greatest(F.lit(0.0), 1 - F.abs(mean_of(flat) - ideal) / tolerance)
    return F.when(n > 0, F.struct(variance(edges).alias("sharpness"), F.sqrt(F.greatest(F.lit(0.0), variance(flat))).alias("contrast"), exposure.alias("exposure")))


def overrun(actual: Column, target: Column, jitter: tuple[float, float] = (2.0, 0.05), hard: tuple[float, float] = (10.0, 0.25)) -> Column:
    """ok, warning or refused, by how far a result is over its target (at least so many seconds, or a share)."""
    past = lambda limits: actual > target + F.greatest(F.lit(limits[0]), target * limits[1])
    return F.when(target.isNull(), "ok").when(past(hard), "refused").when(past(jitter), "warning").otherwise("ok")
