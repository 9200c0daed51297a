"""Beat markers and onset series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.loops import MIDI_FILES
from checks.views import ENERGY, LOOP_FILES, energy, loop_files, midi_blob, midi_files, table
from loomtone.operators import markers as M
from loomtone.operators import midi_stats
from loomtone.operators import onset as O
from loomtone.sources import midi

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# beats of a derived file: 0 .. 16
BEATS = "beaten AS (SELECT *, CAST(id % 17 AS INTEGER) AS beat_count FROM loop_files)"
GRID = """grid AS (SELECT id, CAST(i AS INTEGER) AS idx, CASE WHEN i = CASE WHEN beat_count > 0 THEN beat_count * 4 ELSE 1 END
    THEN num_frames WHEN beat_count > 0 THEN least(CAST(round_even(i * (num_frames / beat_count / 4), 0) AS BIGINT), num_frames)
    ELSE 0 END AS pos FROM beaten, unnest(range(0, CASE WHEN beat_count > 0 THEN beat_count * 4 + 1 ELSE 2 END)) t(i))"""
WITH_GRID = S.with_(LOOP_FILES, BEATS, GRID)


def beaten(spark, sf):
    return loop_files(spark, sf).withColumn("beat_count", (F.col("id") % 17).cast("int"))


@query("grid_markers", WITH_GRID + "SELECT id, idx, pos FROM grid")
def _(spark, sf):
    return M.grid_markers(beaten(spark, sf), "id")


@query("marker_summary", WITH_GRID + "SELECT id, count(*) AS marker_count, arg_min(pos, idx) AS first_pos, arg_max(pos, idx) "
       "AS last_pos FROM grid GROUP BY id")
def _(spark, sf):
    return M.marker_summary(M.grid_markers(beaten(spark, sf), "id"), "id")


@query(
    "midi_grid_markers",
    S.with_(S.KEYS, MIDI_FILES) + """SELECT id, CAST(i AS INTEGER) AS idx, CASE WHEN i = beats * 4 THEN frames ELSE
      least(CAST(round_even(i * (frames / beats / 4), 0) AS BIGINT), frames) END AS pos FROM (
        SELECT id, CAST(round_even(tempo * duration / 60.0, 0) AS BIGINT) AS beats, CAST(floor(duration * 44100.0::DOUBLE) AS BIGINT) AS frames
        FROM midi_files) m, unnest(range(0, beats * 4 + 1)) t(i) WHERE beats > 0""",
)
def _(spark, sf):
    files = midi_stats.midi_summary(midi.midi_events(midi_blob(spark, sf), "id"), "id", midi_files(spark, sf))
    return M.midi_grid_markers(files, "id")


# onsets of a derived file, some outside it: one to six line items
ONSETS = """onsets AS (SELECT l_orderkey AS id, CAST(floor(l_extendedprice * 3) AS BIGINT) AS pos FROM lineitem),
built AS (SELECT f.id, o.pos FROM onsets o JOIN loop_files f USING (id) WHERE o.pos > 0 AND o.pos < f.num_frames
  UNION SELECT id, 0 FROM loop_files UNION SELECT id, num_frames FROM loop_files)"""


def onsets(spark, sf):
    item = table(spark, sf, "lineitem")
    return item.select(F.col("l_orderkey").alias("id"), F.floor(F.col("l_extendedprice") * 3).cast("bigint").alias("pos"))


@query("build_markers", S.with_(LOOP_FILES, ONSETS) + "SELECT id, pos FROM built")
def _(spark, sf):
    return M.build_markers(onsets(spark, sf), loop_files(spark, sf), "id")


FALLBACK = """wanted AS (SELECT id, num_frames, id % 9 AS min_markers FROM loop_files),
filled AS (SELECT id, pos FROM built UNION
  SELECT w.id, least(CAST(round_even(i * (num_frames / (min_markers - 1)), 0) AS BIGINT), num_frames) FROM (
    SELECT w.* FROM wanted w JOIN (SELECT id, count(*) AS n FROM built GROUP BY id) USING (id)
    WHERE n < min_markers AND min_markers > 1) w, unnest(range(0, min_markers)) t(i))"""


@query("fallback_markers", S.with_(LOOP_FILES, ONSETS, FALLBACK) + "SELECT id, pos FROM filled")
def _(spark, sf):
    files = loop_files(spark, sf).withColumn("min_markers", F.col("id") % 9)
    return M.fallback_markers(M.build_markers(onsets(spark, sf), files, "id"), files, "id")


@query("sort_markers", S.with_(LOOP_FILES, ONSETS) + "SELECT DISTINCT id, pos FROM onsets ORDER BY id, pos")
def _(spark, sf):
    return M.sort_markers(onsets(spark, sf), "id")


@query(
    "choose_markers",
    S.with_(LOOP_FILES, BEATS, GRID, ONSETS) + """, chosen AS (SELECT DISTINCT id FROM built WHERE id % 3 > 0 AND id % 5 > 0)
      SELECT id, pos, 'onset' AS source FROM built WHERE id IN (SELECT id FROM chosen)
      UNION ALL SELECT id, pos, 'grid' FROM grid WHERE id NOT IN (SELECT id FROM chosen)""",
)
def _(spark, sf):
    files = beaten(spark, sf).withColumn("loop_type", F.when(F.col("id") % 3 > 0, "audio").otherwise("midi"))
    ready = M.build_markers(onsets(spark, sf), files, "id").filter("id % 5 > 0")
    return M.choose_markers(files, ready, "id")


# ---- onsets ---------------------------------------------------------------------------------------------------------

RULE = O.OnsetRule(hop_length=512, pre_max=2, post_max=1, pre_avg=6, post_avg=6, delta=0.25, wait=5)
WITH_ENERGY = S.with_(ENERGY)
STRENGTH = """strength AS (SELECT series_id, hop, v, coalesce(greatest(v - lag(v) OVER (PARTITION BY series_id ORDER BY hop), 0), 0)
  AS strength FROM energy)"""
PEAKS = """peaks AS (SELECT series_id, hop FROM (SELECT *,
    max(strength) OVER (PARTITION BY series_id ORDER BY hop RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m,
    avg(strength) OVER (PARTITION BY series_id ORDER BY hop RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS a FROM strength)
  WHERE strength = m AND strength >= a + 0.25::DOUBLE)"""
KEPT = """kept AS (SELECT series_id, unnest(list_reduce(list_transform(hops, lambda h: [h]),
    lambda acc, h: CASE WHEN h[1] > acc[-1] + 5 THEN list_concat(acc, h) ELSE acc END)) AS hop
  FROM (SELECT series_id, list(hop ORDER BY hop) AS hops FROM peaks GROUP BY series_id))"""
MINIMA = """minima AS (SELECT e.series_id, e.hop FROM energy e JOIN energy p ON p.series_id = e.series_id AND p.hop = e.hop - 1
  JOIN energy n ON n.series_id = e.series_id AND n.hop = e.hop + 1 WHERE e.v <= p.v AND e.v < n.v),
firsts AS (SELECT series_id, min(hop) AS first_hop FROM energy GROUP BY series_id),
moved AS (SELECT k.series_id, k.hop, coalesce(max(m.hop), any_value(first_hop)) AS start_hop FROM kept k
  LEFT JOIN minima m ON m.series_id = k.series_id AND m.hop <= k.hop JOIN firsts f ON f.series_id = k.series_id
  GROUP BY k.series_id, k.hop)"""


def strength(spark, sf):
    return O.onset_strength(energy(spark, sf))


@query("hop_energy", """SELECT user_id AS series_id, CAST(event_id // 64 AS BIGINT) AS hop, CAST(sum((event_id % 100) *
  (event_id % 100)) AS BIGINT) AS v FROM events GROUP BY ALL""")
def _(spark, sf):
    e = F.col("event_id")
    samples = table(spark, sf, "events").select(
        F.col("user_id").alias("series_id"), e.alias("sample"), (e % 100).alias("amplitude")
    )
    return O.hop_energy(samples, "series_id", 64)


@query("onset_strength", S.with_(ENERGY, STRENGTH) + "SELECT series_id, hop, strength FROM strength")
def _(spark, sf):
    return strength(spark, sf).select("series_id", "hop", "strength")


@query("onset_peaks", S.with_(ENERGY, STRENGTH, PEAKS) + "SELECT series_id, hop FROM peaks")
def _(spark, sf):
    return O.onset_peaks(strength(spark, sf), RULE)


@query("onset_wait", S.with_(ENERGY, STRENGTH, PEAKS, KEPT) + "SELECT series_id, hop FROM kept")
def _(spark, sf):
    return O.onset_wait(O.onset_peaks(strength(spark, sf), RULE), RULE.wait)


@query("onset_backtrack", S.with_(ENERGY, STRENGTH, PEAKS, KEPT, MINIMA) + "SELECT series_id, hop, start_hop FROM moved")
def _(spark, sf):
    kept = O.onset_wait(O.onset_peaks(strength(spark, sf), RULE), RULE.wait)
    return O.onset_backtrack(kept, energy(spark, sf))


@query("onset_markers", S.with_(ENERGY, STRENGTH, PEAKS, KEPT, MINIMA) + "SELECT DISTINCT series_id, start_hop * 512 AS pos FROM moved")
def _(spark, sf):
    return O.onset_markers(energy(spark, sf), RULE)
