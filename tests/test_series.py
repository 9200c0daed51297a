"""Onset steps against plain loops, with blocks small enough to be crossed often."""

import random

import pytest

from loomtone.operators import blocked, onset
from loomtone.operators.quality import check_markers
from loomtone.operators.selection import row_progress


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(onset, "SPACING_BLOCK", 8)
    monkeypatch.setattr(onset, "SEGMENT_BLOCKS", 3)
    for fn in (blocked.with_halo, blocked.last_seen):
        monkeypatch.setattr(fn, "__defaults__", tuple(8 if d == blocked.BLOCK else d for d in fn.__defaults__))


def series(seed, n=3, length=150):
    rng = random.Random(seed)
    return {s: {h: rng.randrange(9) for h in range(length) if s < 2 or rng.random() < 0.8} for s in range(n)}


@pytest.mark.parametrize("wait", [0, 1, 3, 7])
def test_wait(spark, small_blocks, wait):
    rng = random.Random(wait)
    peaks = {s: sorted(rng.sample(range(600), k)) for s, k in enumerate((200, 40, 3, 550))}
    df = spark.createDataFrame([(s, h) for s, hs in peaks.items() for h in hs], "series_id int, hop bigint")
    want = set()
    for s, hops in peaks.items():
        last = None
        for h in hops:
            if last is None or h > last + wait:
                want.add((s, h))
                last = h
    assert {tuple(r) for r in onset.onset_wait(df, wait).collect()} == want


def test_carries_over_a_sparse_series(spark):
    """Orders so far apart that each row is a block of its own and a span holds few of them."""
    rng = random.Random(9)
    orders = sorted(rng.sample(range(200_000), 1500))
    values = [rng.randrange(-5, 9) for _ in orders]
    df = spark.createDataFrame([(1, o, v, v if v > 5 else None) for o, v in zip(orders, values)], "k int, o bigint, v bigint, seen bigint")
    summed = {r["o"]: r["s"] for r in blocked.running_sum(df, ["k"], "o", "v", "s", 16).collect()}
    last = {r["o"]: r["l"] for r in blocked.last_seen(df, ["k"], "o", df["seen"], "l", False, 16).collect()}
    total, seen = 0, None
    for o, v in zip(orders, values):
        total += v
        assert (summed[o], last[o]) == (total, seen)
        seen = v if v > 5 else seen


def test_strength_peaks_and_backtrack(spark, small_blocks):
    data = series(5)
    df = spark.createDataFrame([(s, h, v) for s, hv in data.items() for h, v in hv.items()], "series_id int, hop bigint, v bigint")
    rule = onset.OnsetRule(pre_max=2, post_max=1, pre_avg=5, post_avg=4, delta=0.5, wait=2)
    rise = {}
    for s, hv in data.items():
        prev = None
        for h in sorted(hv):
            rise[s, h] = max(hv[h] - prev, 0) if prev is not None else 0
            prev = hv[h]
    strength = onset.onset_strength(df)
    assert {(r["series_id"], r["hop"]): r["strength"] for r in strength.collect()} == rise
    want = set()
    for (s, h), v in rise.items():
        near = [rise[s, x] for x in range(h - 2, h + 2) if (s, x) in rise]
        wide = [rise[s, x] for x in range(h - 5, h + 5) if (s, x) in rise]
        if v == max(near) and v >= sum(wide) / len(wide) + 0.5:
            want.add((s, h))
    peaks = onset.onset_peaks(strength, rule)
    assert {tuple(r) for r in peaks.collect()} == want
    moved = {(r[0], r[1]): r[2] for r in onset.onset_backtrack(peaks, df).collect()}
    for s, h in want:
        hv = data[s]
        lows = [x for x in hv if x <= h and x - 1 in hv and x + 1 in hv and hv[x] <= hv[x - 1] and hv[x] < hv[x + 1]]
        assert moved[s, h] == max(lows, default=min(hv))


def test_marker_rules(spark, small_blocks):
    lists = {1: [0, 5, 9], 2: [1, 5, 9], 3: [0, 5, 8], 4: list(range(0, 20)) + [3, 9], 5: []}
    rows = [(k, i, p) for k, ps in lists.items() for i, p in enumerate(ps)]
    markers = spark.createDataFrame(rows, "id int, idx int, pos bigint")
    files = spark.createDataFrame([(k, 9, 3) for k in lists], "id int, num_frames bigint, declared bigint")
    got = {tuple(r) for r in check_markers(markers, files, "id").collect()}
    assert got == {
        (2, "first marker not at zero"), (3, "last marker not at end"), (4, "markers go back"),
        (4, "marker count differs"), (5, "marker count differs"),
    }


def test_explode_count_in_steps(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 25), (4, -3)], "id int, n int")
    got = blocked.explode_count(df, df["n"], "i", size=4).groupBy("id").agg({"i": "count"}).collect()
    assert {r[0]: r[1] for r in got} == {2: 1, 3: 25}


def test_row_progress_numbers_every_file(spark):
    paths = [f"/lib/{i * 7919 % 1000:04d}.wav" for i in range(1000)]
    df = spark.createDataFrame([(p,) for p in paths + paths[:10]], "path string")
    got = {r["path"]: r["position"] for r in row_progress(df).collect()}
    assert got == {p: i + 1 for i, p in enumerate(sorted(set(paths)))}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("hot", [0, 50, 10**6])
def test_join_unique_with_hot_keys(spark, how, hot):
    rows = spark.range(600).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 40)) AS key", "id AS pos")
    unique = spark.createDataFrame([("hot", 1), *((f"k{k}", k) for k in range(0, 40, 2))], "key string, v int")
    got = blocked.join_unique(rows, unique, "key", "pos", how, hot)
    want = rows.join(unique, "key", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_long_runs_of_onsets_in_one_block(spark):
    hops = list(range(0, 3000, 2)) + [7001, 7004, 8191]
    df = spark.createDataFrame([(1, h) for h in hops], "series_id int, hop bigint")
    want, last = [], None
    for h in hops:
        if last is None or h > last + 3:
            want.append(h)
            last = h
    assert sorted(r.hop for r in onset.onset_wait(df, 3).collect()) == want
