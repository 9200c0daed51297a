"""The language model: exact base scores, a proper distribution, and better than the base on held-out reports."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomtone.llm import language_model as lm


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def plain_base(rows):
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    count = Counter(t for (_, text), h in zip(rows, held) if not h for t in tokens(text))
    n, v = sum(count.values()), len(count)
    return [(i, h, len(tokens(text)), sum(count[t] > 0 for t in tokens(text)), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(text)))
            for (i, text), h in zip(rows, held)]


@pytest.mark.parametrize("settings", [{}, {"bucket_words": 9_000}])
def test_base_is_exact(spark, settings):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id file_id", "text report", "lang row", "1 score")
    rows = [(r.file_id, r.report) for r in docs.collect()]
    got = {r.file_id: r for r in lm.score_reports(docs, **settings).collect()}
    assert len(got) == len(rows)
    for i, held, n, known, total, base in plain_base(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_beats_the_base_on_held_out_reports(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id file_id", "text report")
    got = lm.score_reports(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert got.s > got.b


def test_a_restaurant_serves_a_distribution():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 30, 200)
    parent = rng.random(200)
    parent /= parent.sum()
    tables, _ = lm.seat(np.maximum(n, 1), parent, np.full(200, 40.0), rng)
    tables = np.where(n > 0, tables, 0)
    assert lm.predict(n, tables, n.sum(), tables.sum(), parent).sum() == pytest.approx(1)


def test_seating(spark):
    rng = np.random.default_rng(1)
    n = np.array([1, 2, 5, 200, 100_000] * 50)
    tables, weight = lm.seat(n, np.full(len(n), 0.01), np.full(len(n), 50.0), rng)
    assert ((tables >= 1) & (tables <= n)).all() and (weight[n == 1] == 0).all() and (tables[n == 1] == 1).all()
    total = np.zeros(3)
    for _ in range(4000):  # two customers share a table by the ratio of their weights
        t, _ = lm.seat(np.array([2]), np.array([0.3]), np.array([4.0]), rng)
        total[t[0]] += 1
    fresh = (lm.STRENGTH + lm.DISCOUNT * 5) * 0.3
    assert abs(total[2] / 4000 - fresh / (fresh + 1 - lm.DISCOUNT)) < 0.03
    for _ in range(5):
        tables, weight = lm.gibbs(n, tables, weight, np.full(len(n), 0.01), np.full(len(n), 60.0), rng)
        assert ((tables >= 1) & (tables <= n)).all()


def plainly_seated(customers, parent, others, rng):
    tables, weight, seated = np.ones(len(customers), np.int64), np.zeros(len(customers)), 1
    while (open_ := np.flatnonzero(customers > seated)).size:
        block = np.minimum(max(1, seated >> 6), customers[open_] - seated)
        fresh = (lm.STRENGTH + lm.DISCOUNT * (others[open_] + tables[open_])) * parent[open_]
        total = fresh + seated - lm.DISCOUNT * tables[open_]
        tables[open_] += rng.binomial(block, fresh / total)
        weight[open_] += block * np.log(total)
        seated += max(1, seated >> 6)
    return tables, weight


def test_seating_draws_as_the_binomial_does():
    rng = np.random.default_rng(8)
    n = np.minimum(1 + rng.pareto(0.7, 4000), 5000).astype(np.int64)
    parent, others = rng.random(4000), rng.integers(0, 500, 4000)
    one, other = np.random.default_rng(9), np.random.default_rng(9)
    binomials = []

    class Watched:
        def random(self, size):
            return one.random(size)

        def binomial(self, block, chance):
            binomials.append(int(block.max()))
            return one.binomial(block, chance)

    for got, plain in zip(lm.seat(n, parent, others, Watched()), plainly_seated(n, parent, others, other)):
        assert (got == plain).all()
    assert one.random() == other.random()
    assert binomials and min(binomials[:-1]) > 1  # a binomial draw for each single customer took most of a sweep's time


def test_order_and_ranks():
    rng = np.random.default_rng(6)
    codes = rng.integers(-2**63, 2**63, 300)
    near = np.concatenate([codes, codes ^ 1, [lm._START, lm._END, -1, 2**63 - 1, -2**63]])  # some agree in all but the last bits
    for values in (rng.choice(codes, 2000), rng.choice(near, 5000), rng.integers(0, 50, 3000), rng.integers(0, 50, 700).astype(np.int32), codes[:1], codes[:0]):
        assert lm._order(values).tolist() == np.argsort(values, kind="stable").tolist()
        for got, plain in zip(lm._ranked(values), np.unique(values, return_inverse=True)):
            assert got.tolist() == plain.tolist()


def test_packed_columns_come_back():
    rng = np.random.default_rng(7)
    for n in (0, 1, 1000):
        columns = [rng.integers(-2**63, 2**63, n), rng.integers(0, 2**64, n, np.uint64), rng.random(n), rng.integers(-9, 9, n).astype(np.int32), rng.random(n) < 0.5]
        back = lm.unpack(lm.pack(*columns))
        assert [c.dtype for c in back] == [c.dtype for c in columns] and all((a == b).all() for a, b in zip(back, columns))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "pad"), (3, "pad"), (None, "Pad PAD loop"), (4, "loop " * 100_000), (5, "é \t x"), (6, "unseen words here"), (9, "pad loop")]
    loops = spark.createDataFrame(rows, "file_id bigint, report string").selectExpr("*", "1 row", "'x' copies")
    got = sorted(((r.file_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score_reports(loops).collect()), key=str)
    assert got == sorted(((*r[:5], round(r[5], 6)) for r in plain_base(rows)), key=str)
    small = lm.score_reports(loops, bucket_words=20_000).collect()
    assert sorted(((r.file_id, r.n_known) for r in small), key=str) == sorted(((r[0], r[3]) for r in plain_base(rows)), key=str)
    assert lm.score_reports(loops.limit(0)).count() == 0
    held = [k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    unknown = lm.score_reports(spark.createDataFrame([(k, "a b") for k in held], "file_id bigint, report string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 and r.base_score == 0 for r in unknown)


def test_every_context_has_a_restaurant(spark):
    # 200 contexts, each with a word of its own: after any of them that word is nearly certain, the others are not
    texts = [f"a{k} b{k}" for k in range(200)]
    learnt = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2][:2000]
    held = [i for i in range(4000, 8000) if zlib.crc32(str(i).encode()) % 7 == 2][:400]
    rows = [(i, texts[j % 200]) for j, i in enumerate(learnt)]
    rows += [(i, texts[j] if j < 200 else f"a{j - 200} b{(j - 199) % 200}") for j, i in enumerate(held)]
    got = {r.file_id: r.score for r in lm.score_reports(spark.createDataFrame(rows, "file_id bigint, report string")).collect()}
    assert min(got[i] for i in held[:200]) > max(got[i] for i in held[200:]) + 1


def test_the_root_counts_tables(spark):
    # "x" is frequent after one word only, "y" comes once after each of many: after an unknown word "y" is likelier
    learnt = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(2000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, "one x" if j < 400 else f"c{j} y") for j, i in enumerate(learnt[:500])] + [(held[0], "new x"), (held[1], "new y")]
    for settings in ({}, {"bucket_words": 150}):
        got = {r.file_id: r.score for r in lm.score_reports(spark.createDataFrame(rows, "file_id bigint, report string"), **settings).collect()}
        assert got[held[1]] > got[held[0]]


def rows_made(plan):
    """Rows that each MapInArrow of a finished plan has made."""
    while plan.nodeName() == "AdaptiveSparkPlan" or "QueryStage" in plan.nodeName():
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan()
    own = [plan.metrics().apply("pythonNumRowsReceived").value()] if plan.nodeName() == "MapInArrow" else []
    return own + [n for k in range(plan.children().size()) for n in rows_made(plan.children().apply(k))]


def test_scores_do_not_multiply_by_slots(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id file_id", "text report").limit(200).coalesce(1)
    got = lm.score_reports(docs, bucket_words=1_000)
    reports = len(got.collect())
    made = rows_made(got._jdf.queryExecution().executedPlan())
    assert len(made) == 3 and max(made) <= reports


def test_pairs_stand_side_by_side():
    rng = np.random.default_rng(3)
    u, w = (rng.choice(rng.integers(-2**63, 2**63, 60), 5000) for _ in range(2))
    for slots in (1, 2, 37):
        slot = np.abs(u) % slots
        order = lm._side_by_side(slot, u, w, slots)
        assert sorted(order.tolist()) == list(range(5000)) and (np.diff(slot[order]) >= 0).all()
        assert len(lm._new(slot[order], u[order], w[order])) == len(set(zip(u.tolist(), w.tolist())))
    bodies = []
    for part in np.array_split(np.lexsort((w, u)), 3):
        at = lm._new(u[part], w[part])
        bodies.append(lm.pack(*lm._coded(u[part][at], w[part][at]), np.diff(np.append(at, len(part))), np.ones(len(at), np.int64)))
    own, a, b, n, parts = lm._merged(bodies)
    assert own.tolist() == sorted(set(w.tolist())) and dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(u.tolist(), w.tolist()))
    assert sorted(zip(a.tolist(), b.tolist())) == list(zip(a.tolist(), b.tolist())) and parts.sum() >= len(a)
