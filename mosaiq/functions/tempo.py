"""Tempos whose beats divide a cadence of cuts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REACH = 0.15  # how far a tempo may leave the natural one, as a share of it


def beats_in(bpm: Column, cadence_s: Column) -> Column:
    return cadence_s * bpm / 60.0


def aligned(natural: Column, cadence_s: Column, low: Column | int, high: Column | int, reach: float = REACH) -> Column:
    """The tempo with a whole number of beats a cadence that is nearest to the natural one (of two alike the slower).

    The whole numbers around the natural tempo's beats are tried; a tempo counts within low and high and within reach.
    Where none does, or there is no cadence, the natural tempo stays. Rounded, halves to even.
    """
    below = F.floor(beats_in(natural, cadence_s))

    def tried(n: Column) -> Column:
        bpm = 60.0 * n / cadence_s
        away = F.abs(bpm - natural)
        return F.when((n >= 1) & (bpm >= low) & (bpm <= high) & (away <= natural * reach), F.struct(away.alias("away"), n.alias("n"), bpm.alias("bpm")))

    usable = (cadence_s > 0) & (natural > 0)
    best = F.when(usable, F.array_min(F.array_compact(F.array(tried(below), tried(below + 1)))))
    return F.bround(F.coalesce(best["bpm"], natural)).cast("int")


def misfit(bpm: Column, cadence_s: Column) -> Column:
    """How far a cadence is from a whole number of beats, in beats; null without a tempo or a cadence."""
    beats = beats_in(bpm, cadence_s)
    return F.when(cadence_s > 0, F.abs(beats - F.bround(beats)))
