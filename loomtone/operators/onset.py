"""Onsets of an energy series ``(series_id, hop, v)``: strength, peaks, spacing, backtracking.

Series may be arbitrarily long: every step works on blocks of hops, with a halo for windows of fixed reach and carried
state where order matters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtone.functions.rows import let, struct_rows, value_rows
from loomtone.operators.blocked import join_unique, last_seen, with_halo

SPACING_BLOCK = 8_192
SEGMENT_BLOCKS = 4_096
TRACE_STEPS = 64


@dataclass(frozen=True)
class OnsetRule:
    """Reach of the peak test in hops, its threshold above the local mean, and the least distance of two onsets."""

    hop_length: int = 512
    pre_max: int = 1
    post_max: int = 1
    pre_avg: int = 3
    post_avg: int = 3
    delta: float = 0.3
    wait: int = 2

    @staticmethod
    def for_rate(sample_rate: int, hop_length: int = 512, wait: float = 0.03, delta: float = 0.3) -> OnsetRule:
        """The rule for a sample rate: 30 ms maximum, 100 ms mean, ``wait`` seconds between onsets."""
        hops = sample_rate / hop_length
        short, long = int(0.03 * hops), int(0.10 * hops)
        return OnsetRule(hop_length, short, 0, long, long, delta, int(wait * hops))


def hop_energy(samples: DataFrame, key: str, hop_length: int = 512) -> DataFrame:
    """``(key, hop, v)``: sample energy summed per hop, from ``(key, sample, amplitude)``."""
    hop = F.floor(F.col("sample") / F.lit(hop_length)).cast("bigint")
    return samples.groupBy(key, hop.alias("hop")).agg(F.sum(F.col("amplitude") * F.col("amplitude")).alias("v"))


def onset_strength(energy: DataFrame, key: str = "series_id") -> DataFrame:
    """Add ``strength``: the rise against the series' previous hop, never negative, zero at the start."""
    prev = last_seen(energy, [key], "hop", F.col("v"), "_prev", current=False)
    rise = F.greatest(F.col("v") - F.col("_prev"), F.lit(0))
    return prev.withColumn("strength", F.coalesce(rise, F.lit(0))).drop("_prev")


def onset_peaks(strength: DataFrame, rule: OnsetRule, key: str = "series_id", value: str = "strength") -> DataFrame:
    """Hops that are the local maximum and reach the local mean plus ``delta``."""
    before, after = max(rule.pre_max, rule.pre_avg), max(rule.post_max, rule.post_avg)
    blocks = with_halo(strength.select(key, "hop", F.col(value).alias("_v")), "hop", before, after)
    w = Window.partitionBy(key, "_block").orderBy("hop")
    local_max = F.max("_v").over(w.rangeBetween(-rule.pre_max, rule.post_max))
    local_avg = F.avg("_v").over(w.rangeBetween(-rule.pre_avg, rule.post_avg))
    flagged = blocks.withColumn("_peak", (F.col("_v") == local_max) & (F.col("_v") >= local_avg + F.lit(rule.delta)))
    return flagged.filter("_peak AND NOT _halo").select(key, "hop")


def _trace(items, last, each):
    """What ``each(last, item)``, a ``struct<last, told array>``, tells of all items in order, one item's ``last`` handed on to the next.

    An array that grows is copied at every step; so items are taken in groups of ``TRACE_STEPS``, and only short arrays grow.
    """
    none = F.array().cast("array<bigint>")

    def group(part, entered):
        start = F.struct(entered.cast("bigint").alias("last"), none.alias("told"))
        return F.aggregate(part, start, lambda s, item: let(
            each(s["last"], item), lambda r: F.struct(r["last"].alias("last"), F.concat(s["told"], r["told"]).alias("told"))))

    groups = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / F.lit(TRACE_STEPS)).cast("int"))
    parts = F.transform(groups, lambda k: F.slice(items, k * TRACE_STEPS + 1, F.lit(TRACE_STEPS)))
    start = F.struct(last.cast("bigint").alias("last"), F.array().cast("array<array<bigint>>").alias("told"))
    return F.flatten(F.aggregate(parts, start, lambda s, part: let(
        group(part, s["last"]), lambda r: F.struct(r["last"].alias("last"), F.concat(s["told"], F.array(r["told"])).alias("told"))))["told"])


def _fold(hops, last, wait: int):
    """Hops kept greedily from a sorted array when the previously kept hop is ``last`` (null: none)."""
    none = F.array().cast("array<bigint>")
    return _trace(hops, last, lambda kept, h: F.when(
        kept.isNull() | (h > kept + wait), F.struct(h.alias("last"), F.array(h).alias("told"))).otherwise(F.struct(kept.alias("last"), none.alias("told"))))


def _last_kept(hops, last, wait: int):
    """The last hop that :func:`_fold` keeps, without the kept array."""
    return F.aggregate(
        hops, last.cast("bigint"), lambda kept, h: F.when(kept.isNull() | (h > kept + wait), h).otherwise(kept)
    )


def _handed_on(last, edge, wait: int):
    """The last kept hop after an edge block that is entered with ``last``."""
    gap = edge["_start"] - last
    return F.get(edge["_exits"], F.when(gap.between(1, wait), gap).otherwise(F.lit(0)).cast("int"))


def _walk(edges, last, wait: int):
    """The last kept hop after each of the sorted edges, entered with ``last``."""
    return _trace(edges, last, lambda before, edge: let(
        _handed_on(before, edge, wait), lambda h: F.struct(h.alias("last"), F.array(h).alias("told"))))


def onset_wait(peaks: DataFrame, wait: int, key: str = "series_id") -> DataFrame:
    """Peaks kept in order such that each lies more than ``wait`` hops after the one kept before it.

    The choice depends on earlier blocks only through a kept hop within ``wait`` of the block's start. So only blocks
    with a peak that near their end hand anything on. Such a block works out its last kept hop for every state it may be
    entered in, and a segment of blocks does so from its blocks. Then the segments of a series are walked, each segment's
    blocks are walked from the hop it is entered with, and all blocks finish on their own.
    """
    size = max(SPACING_BLOCK, 4 * (wait + 1))
    reach = size * SEGMENT_BLOCKS
    blocks = (
        peaks.select(key, F.col("hop").cast("bigint").alias("hop"))
        .withColumn("_start", F.floor(F.col("hop") / F.lit(size)).cast("bigint") * size)
        .groupBy(key, "_start")
        .agg(F.array_sort(F.collect_list("hop")).alias("_hops"))
    )
    states = F.sequence(F.lit(0), F.lit(wait))
    entered = lambda d: F.when(d > 0, F.col("_start") - d).cast("bigint")
    edge = F.struct("_start", F.transform(states, lambda d: _last_kept(F.col("_hops"), entered(d), wait)).alias("_exits"))
    edges = blocks.filter(F.array_max("_hops") + wait >= F.col("_start") + size).select(
        key, (F.floor(F.col("_start") / F.lit(reach)).cast("bigint") * reach).alias("_segment"), edge.alias("_edge")
    )
    segments = edges.groupBy(key, F.col("_segment").alias("_start")).agg(F.array_sort(F.collect_list("_edge")).alias("_edges"))
    ends = F.transform(
        states, lambda d: F.aggregate("_edges", entered(d), lambda last, e: _handed_on(last, e, wait))
    )
    series = (
        segments.select(key, F.struct("_start", ends.alias("_exits")).alias("_edge"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("_edge")).alias("_edges"))
    )
    firsts = let(
        _walk(F.col("_edges"), F.lit(None), wait),
        lambda lasts: F.transform(
            "_edges", lambda e, i: F.struct(e["_start"].alias("_start"), F.get(lasts, i - 1).alias("_first"))
        ),
    )
    entries = struct_rows(series, [key], firsts, "_start")
    entry = let(
        _walk(F.col("_edges"), F.col("_first"), wait),
        lambda lasts: F.transform(
            "_edges", lambda e, i: F.struct((e["_start"] + size).alias("_start"), F.get(lasts, i).alias("_entry"))
        ),
    )
    handed = struct_rows(segments.join(entries, [key, "_start"]), [key], entry, "_start")
    done = blocks.join(handed, [key, "_start"], "left")
    return value_rows(done, [key], _fold(F.col("_hops"), F.col("_entry"), wait), "hop")


def onset_backtrack(onsets: DataFrame, energy: DataFrame, key: str = "series_id") -> DataFrame:
    """``(key, hop, start_hop)``: each onset moved back to the latest local minimum of the energy at or before it.

    A hop is a minimum if it is not above the previous and below the next hop; without one the series start counts.
    """
    blocks = with_halo(energy.select(key, "hop", "v"), "hop", 1, 1)
    w = Window.partitionBy(key, "_block").orderBy("hop")
    prev = F.max("v").over(w.rangeBetween(-1, -1))
    following = F.max("v").over(w.rangeBetween(1, 1))
    low = (F.col("v") <= prev) & (F.col("v") < following)
    minima = blocks.withColumn("_low", low).filter("NOT _halo").select(key, "hop", "_low")
    marked = minima.join(onsets.select(key, "hop", F.lit(True).alias("_onset")), [key, "hop"], "left")
    marked = marked.filter("_low OR _onset")
    first = energy.groupBy(key).agg(F.min("hop").alias("_first"))
    back = last_seen(marked, [key], "hop", F.when(F.col("_low"), F.col("hop")), "_min", current=True)
    found = join_unique(back.filter("_onset"), first, key, "hop", counted=energy)
    return found.select(key, "hop", F.coalesce("_min", "_first").alias("start_hop"))


def onset_markers(energy: DataFrame, rule: OnsetRule, key: str = "series_id", backtrack: bool = True) -> DataFrame:
    """Sample positions ``(key, pos)`` of the onsets of each series."""
    peaks = onset_wait(onset_peaks(onset_strength(energy, key), rule, key), rule.wait, key)
    if backtrack:
        peaks = onset_backtrack(peaks, energy, key).select(key, F.col("start_hop").alias("hop"))
    return peaks.select(key, (F.col("hop") * rule.hop_length).alias("pos")).distinct()
