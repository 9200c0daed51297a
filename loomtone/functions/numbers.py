"""Column functions for beats, tempo, durations and their rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtone import dims


def fixed_text(x: Column, digits: int, width: int = 1) -> Column:
    """Fixed-point text, rounded half-even on the exact binary value (a plain ``round`` sees 2.675 as a tie, it is not)."""
    pattern = "0" * width + ("." + "0" * digits if digits else "")
    return F.call_function("format_number", x, F.lit(pattern))


def round_to(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals by the same rule as :func:`fixed_text`, as a number."""
    return fixed_text(x, digits).cast("double")


def beat_count(tempo: Column, duration: Column) -> Column:
    """Whole beats in ``duration`` seconds at ``tempo``, ties to even; null if either is missing or zero."""
    beats = F.rint((tempo * duration) / F.lit(60.0)).cast("int")
    return F.when((tempo != 0) & (duration != 0), beats)


def tempo_from_beats(beats: Column, duration: Column, midi_tempo: Column) -> Column:
    """Tempo implied by beats over duration, two decimals; else the MIDI tempo; else null."""
    implied = round_to((beats * 60).cast("double") / F.nullif(duration, F.lit(0.0)), 2)
    return F.when((beats > 0) & (duration > 0), implied).when(midi_tempo > 0, midi_tempo.cast("double"))


def bpm(us_per_beat: Column) -> Column:
    """Beats per minute of a tempo in microseconds per beat; 120 for a zero tempo."""
    return F.coalesce(F.rint(F.lit(60000000.0) / F.nullif(us_per_beat, F.lit(0))).cast("int"), F.lit(120))


def midi_duration(ticks: Column, us_per_beat: Column, ticks_per_beat: Column) -> Column:
    """Seconds of ``ticks``; zero when the ticks-per-beat is not positive."""
    seconds = ticks * (us_per_beat / F.lit(1e6)) / F.nullif(ticks_per_beat, F.lit(0))
    return F.when(ticks_per_beat > 0, seconds).otherwise(F.lit(0.0))


def frames_duration(frames: Column, sample_rate: Column) -> Column:
    """Seconds of ``frames``; null unless the rate is positive."""
    return F.when(sample_rate > 0, frames / F.nullif(sample_rate, F.lit(0.0)))


def marker_seconds(position: Column, sample_rate: Column) -> Column:
    """Position in seconds, six decimals; an unknown rate counts as the default one."""
    rate = F.when(sample_rate > 0, sample_rate).otherwise(F.lit(dims.DEFAULT_SAMPLE_RATE))
    return round_to(position / rate, 6)


def signed_byte(b: Column) -> Column:
    """A byte 0-255 read as two's complement."""
    return F.when(b > 127, b - 256).otherwise(b)
