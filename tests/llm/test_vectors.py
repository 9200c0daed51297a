"""Feature vectors: links against all pairs."""

import numpy as np

from loomtone.llm import vectors


def plain(rows, least=0.93):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [None if c is None else unit(v) for _, v, c in rows]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids, default=None)))
    return out


def answer(df):
    return [(r.file_id, r.n_links, r.component_id) for r in df.collect()]


def test_equals_all_pairs_with_split_cells(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for c in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((n, [float(x) for x in base + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])], int(c % 3)))
            n += 1
    df = spark.createDataFrame(rows, "file_id bigint, features array<double>, category int")
    assert sorted(answer(vectors.link_vectors(df, block_rows=7))) == sorted(plain(rows))


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(900):
        base = rng.normal(size=64)
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=64) * 0.22], 1))
    held = spark.createDataFrame(rows, "file_id bigint, features array<double>, category int")
    expected = plain(rows)
    index = answer(vectors.link_vectors(held, cell_rows=60))
    true, found = sum(r[1] for r in expected), sum(r[1] for r in index)
    assert true > 500 and 0.9 * true <= found <= true
    assert all(n <= m for n, m in zip([r[1] for r in sorted(index)], [r[1] for r in expected]))


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
            (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (None, [2.0, 4.0], 1), (9, [1e300, 2e300], 1), (10, [1e-300, 2e-300], 1),
            (11, [1.0, 2.0, 0.0], 1), (12, [1.0, 2.0], 2), (None, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "file_id bigint, features array<double>, category int").selectExpr("*", "1 least", "2 copies")
    assert sorted(answer(vectors.link_vectors(df)), key=str) == sorted(plain(rows), key=str)
    assert vectors.link_vectors(df.limit(0)).count() == 0
