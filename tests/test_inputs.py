"""Inputs made for the queries: no more than what a query reads, dealt to tasks before any bytes are made."""

import os

from checks import views


def tables(spark, folder, orders, suppliers):
    spark.createDataFrame([(k, 1000.5 + k) for k in orders], "o_orderkey bigint, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k,) for k in suppliers], "s_suppkey bigint").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_a_tree_makes_bytes_of_its_own_files_only(spark, tmp_path):
    sf = tables(spark, tmp_path, range(300), range(12))
    root = views.library_tree(spark, sf)
    assert not [key for key in views._STORED if key[1] == sf]  # no table of the bytes of all orders
    found = sorted(name for _, _, files in os.walk(root) for name in files)
    assert len(found) == 12
    for make, kind in ((views.caf_blob, 0), (views.aiff_blob, 1), (views.midi_blob, 2)):
        made = {r["id"]: bytes(r["content"]) for r in make(spark, sf).where(f"id % 6 = {kind} AND id < 12").collect()}
        assert len(made) == 2
        for k, content in made.items():
            path, = (os.path.join(at, n) for at, _, files in os.walk(root) for n in files if f"bpm_no{k}." in n)
            assert open(path, "rb").read() == content


def test_tasks_make_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    sf = tables(spark, tmp_path, range(200), [])
    monkeypatch.setattr(views, "ORDERS_PER_TASK", 10)
    sizes = [len(p) for p in views.midi_blob(spark, sf).rdd.glom().collect()]
    assert sum(sizes) == 200 and len(sizes) == 20 and max(sizes) <= 20


def test_kinds_of_mixed_files_lie_side_by_side(spark, tmp_path):
    sf = tables(spark, tmp_path, range(90), [])
    parts = [{r["path"][-4:] for r in p} for p in views.mixed_files.__wrapped__(spark, sf).rdd.glom().collect() if p]
    assert all(kinds == {".caf", ".aif", ".mid"} for kinds in parts)


def test_bytes_are_written_as_they_are_made(spark, tmp_path):
    sf = tables(spark, tmp_path, range(90), [])
    for make in (views.caf_blob, views.aiff_blob, views.mixed_files):
        plan = make.__wrapped__(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Repartition"):]
        assert plan.count("Repartition") == 1 and "content" not in below and "o_totalprice" in below
