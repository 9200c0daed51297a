"""Chat texts: exact round trips, whatever the turns hold."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtone.llm import chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE:", "] ", "\\", "<\\/s>", "[\\\\INST]", "<", "[", "/", "é", "\n", " ", "$1", "ok", "😀", "</", "s>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)
ROLE = st.sampled_from(["user", "assistant", "system", "tool", "", "a b%]", "é\n", None])


def check(spark, rows):
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("formatted", F.lit(1)))
    got = {r.conv_id: r for r in made.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss == "".join(t for r, t in turns if r == "assistant")
        assert got[conv].formatted.count("</s>") == len(turns)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(ROLE, TEXT | st.none()), min_size=1, max_size=6), min_size=15, max_size=25))
def test_round_trip(spark, talks):
    check(spark, [(c, n, r, t) for c, talk in enumerate(talks) for n, (r, t) in enumerate(talk)])


def test_edge_rows(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", None), (1, None, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, "a"),
            (2, 0, "assistant", "[INST] " * 200_000), (3, 5, "assistant", "</s>[INST] ok [/INST]")] + [(4, i, "user", str(i)) for i in range(3000)]
    check(spark, rows)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


def test_texts_without_control_strings_stay(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain [x] <b> \\ text")], "conv_id int, turn int, role string, text string")
    assert chat.format_conversations(df).first().formatted == "[INST] plain [x] <b> \\ text</s>"


def test_plan_is_native(spark):
    from loomtone.llm.queries import op4_chat_format
    plan = op4_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    row = op4_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.n_turns == 2
