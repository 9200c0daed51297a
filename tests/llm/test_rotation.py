"""Fill-in-the-middle forms against a plain version, and the exact way back."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from loomtone.llm import rotation


def plain(ident, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return ident, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return ident, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return ident, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_reports():
    rng = random.Random(3)
    texts = ["", None, "a", "é", "Key: F#m\nTempo: 120", "held <S> here", "<P>", "<", "<<", "<S", "P>", "M>x<", "ab" * 200_000, "日本語 loop\r\n\t", "😀" * 50]
    texts += ["".join(rng.choice("aB é<>PSM/\n9") for _ in range(rng.randrange(60))) for _ in range(300)]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "no id at all"), (5, "held twice"), (5, "held twice")]


def test_forms_and_way_back(spark):
    rows = some_reports()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "file_id bigint, report string, form string")
    made = rotation.fill_in_middle(df).withColumn("back", rotation.restore(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=str)
    assert got == sorted(((*plain(i, t), t or "") for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_rotations_beyond_a_stride():
    rng = random.Random(1)
    for size in (0, 1, 2, rotation.STRIDE - 1, 2 * rotation.STRIDE, 2 * rotation.STRIDE + 1, 5 * rotation.STRIDE + 7):
        data = rng.randbytes(size)
        a, m, b = sorted(rng.randrange(size + 1) for _ in range(3))
        buffer = bytearray(data)
        rotation.rotate(buffer, a, m, b)
        assert bytes(buffer) == data[:a] + data[m:b] + data[a:m] + data[b:]
        rotation.rotate(buffer, a, a + b - m, b)
        assert bytes(buffer) == data


def test_sentinels_at_every_cut():
    text = b"S>P>><<S<P<M"  # parts of sentinels, but no whole one
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            for form in ("psm", "spm"):
                assert rotation.rearrange(rotation.arrange(text, (a, b), form), form) == text


def test_other_texts_are_not_restored(spark):
    bad = spark.createDataFrame([("x", "psm"), ("<P>a<M>b<S>c", "psm"), ("<P>a<S>b<M>c", "spm"), (None, "psm"), ("x", "other"), ("x", None)], "o string, f string")
    assert [r[0] for r in bad.select(rotation.restore(F.col("o"), F.col("f"))).collect()] == [None] * 6


def test_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c")], "output bigint, `the text` string")
    out = rotation.fill_in_middle(df, "output", "the text")
    assert out.columns == ["output", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == 1
    assert rotation.fill_in_middle(df.limit(0).toDF("doc id", "t`t"), "doc id", "t`t").collect() == []
