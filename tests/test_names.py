"""Tempo, key and keyword rules on names whose result follows from the rules."""

import pytest
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.functions import automaton
from loomtone.functions import text as X
from loomtone.operators import lookup as L
from loomtone.sources.files import name_glob, parse_extensions, path_parts

CASES = [
    ("Bass_120bpm_Am", 120, "A", "minor"),
    ("120BPM", 120, "", ""),
    ("x_A_minor", None, "A", "minor"),
    ("[500]_120_Am", 120, "A", "minor"),
    ("x_70_y_100_z", 100, "", ""),
    ("x_120_90_y", 120, "", ""),
    ("pad_128", 128, "", ""),
    ("F#", None, "", ""),
    ("C#m", None, "C#", "minor"),
    ("loop a", None, "A", "major"),
    ("bpm 95 (140)", 95, "", ""),
    ("999bpm_bpm90", 90, "", ""),
    ("beat_55_x_210_y_61_z", 61, "", ""),
    ("x_100_Bb.wav", 100, "Bb", "major"),
    ("E Maj Em", None, "E", "major"),
    ("a_Bbm_loop", None, "Bb", "minor"),
    ("g Gm", None, "G", "minor"),
    ("", None, "", ""),
]


def test_tempo_and_key(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "stem string")
    rows = L.with_key(L.with_tempo(df)).collect()
    got = {r["stem"]: (r["tempo"], r["key"]["key"], r["key"]["key_type"]) for r in rows}
    assert got == {c[0]: c[1:] for c in CASES}


def test_longest_keyword_wins_and_ties_follow_dictionary_order(spark):
    df = spark.createDataFrame([("Synth_Bass-808",), ("bottom",), ("hi-hat",), ("nothing",), ("viola cello",)], "stem string")
    got = {r["stem"]: (r["category"], r["subcategory"]) for r in L.lookup_instrument(df).collect()}
    assert got["Synth_Bass-808"] == ("Bass", "Synthetic Bass")
    assert got["bottom"] == ("Drums", "Drum Kit")  # a keyword inside a word counts
    assert got["hi-hat"] == ("Drums", "Hi-hat")
    assert got["nothing"] == ("Other Instrument", "Other")
    assert got["viola cello"] == ("Strings", "Viola")


def test_programs_decide_only_without_a_name(spark):
    df = spark.createDataFrame([("kick", [40]), ("take", [104, 33]), ("take", []), ("take", None)], "stem string, p array<int>")
    rows = L.lookup_instrument(df, programs=F.col("p")).select("category").collect()
    assert [r[0] for r in rows] == ["Drums", "Bass", "Other Instrument", "Other Instrument"]


@pytest.mark.parametrize("shard, block", [(1, 1), (60, 50), (1 << 20, 1 << 20)])
def test_dictionary_search_equals_brute_force(spark, monkeypatch, shard, block):
    words = ["a", "ab", "abc", "bca", "cab", "aaaa", "bcabc", "abcabcabcabc", "xyz", "c a", "\u00e9t\u00e9", "\U0001f3b9\u00e9"]
    texts = {i: t for i, t in enumerate(["", "a", "abcabcabcabcabc" * 9, "xxaaaabx", "b c a b", "cabcabc", "zzz", "xy" + "z" * 40, "\u00e9t\u00e9t\u00e9", "\U0001f3b9\u00e9"])}
    monkeypatch.setattr(automaton, "SHARD_BYTES", shard)
    monkeypatch.setattr(automaton, "TEXT_BYTES", block)
    dictionary = spark.createDataFrame([(w, i, w.upper()) for i, w in enumerate(words)], "keyword string, position int, v string")
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    best = {r["id"]: r["v"] for r in L.dictionary_longest(df, "t", dictionary, ["v"]).collect()}
    ranked = sorted(words, key=lambda w: -len(w))
    assert best == {i: next((w.upper() for w in ranked if w in t), None) for i, t in texts.items()}
    every = {(r["id"], r["v"]) for r in L.dictionary_all(df, "id", "t", dictionary, "v").collect()}
    assert every == {(i, w.upper()) for i, t in texts.items() for w in words if w in t}


def test_keywords_with_several_rows_and_ties(spark, monkeypatch):
    rows = [("pad", 2, "b"), ("pad", 1, "a"), ("pad", None, "n"), ("bad", 0, "z"), ("pad", 1, "a"), ("lead", 5, "l")]
    dictionary = spark.createDataFrame(rows, "keyword string, position int, v string")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a pad bad", "bad", "pad lead", None])], "id int, t string")
    for shard in (1, 1 << 20):
        monkeypatch.setattr(automaton, "SHARD_BYTES", shard)
        assert {r["id"]: r["v"] for r in L.dictionary_longest(df, "t", dictionary, ["v"]).collect()} == {0: "n", 1: "z", 2: "l", 3: None}
        every = sorted((r["id"], r["v"]) for r in L.dictionary_all(df, "id", "t", dictionary, "v").collect())
        assert every == [(0, "a"), (0, "b"), (0, "n"), (0, "z"), (1, "z"), (2, "a"), (2, "b"), (2, "l"), (2, "n")]


def test_many_shards_of_a_large_dictionary(spark, monkeypatch):
    """Text positions do not become rows: what leaves the tasks is at most one row per text and shard."""
    monkeypatch.setattr(automaton, "SHARD_BYTES", 1 << 20)
    dictionary = spark.range(100_000).selectExpr("concat('k', hex(id * 7919 % 1000003), '.') AS keyword", "id AS position", "id AS v")
    df = spark.range(200).selectExpr("id", "concat('text k', hex((id * 37) * 7919 % 1000003), '. and more k k k k1 ', repeat('k.', 300)) AS t")
    shards = len(automaton.write_shards(dictionary))
    assert shards > 4
    out = L.dictionary_longest(df, "t", dictionary, ["v"])
    assert {r["id"]: r["v"] for r in out.collect()} == {k: 37 * k for k in range(200)}
    hits = automaton.find_keywords(df, ["id"], "t", dictionary, best=True)
    assert 200 <= hits.count() <= 200 * shards


def test_dictionaries_of_any_size_answer_alike(spark):
    """Same columns, types and rows for 3 and for 10,000 keywords, with null keys, repeated keys and empty texts and keywords."""
    base = [("pad", 0, 7), ("padded", 1, 8), ("ape", 2, 9), ("", 3, 1), (None, 4, 2)]
    df = spark.createDataFrame([("x", "a padded"), ("x", "ape pad"), (None, "pad"), ("y", ""), ("z", None)], "t_id string, t string")
    seen = []
    for more in (0, 495, 496, 9_995):
        rows = base + [(f"#{i}#", 10 + i, i) for i in range(more)]
        dictionary = spark.createDataFrame(rows, "keyword string, position int, v bigint")
        out = L.dictionary_longest(df, "t", dictionary, ["v"])
        every = L.dictionary_all(df, "t_id", "t", dictionary, "v")
        seen.append((out.dtypes, every.dtypes, sorted(map(str, out.collect())), sorted(map(str, every.collect()))))
    assert all(s == seen[0] for s in seen)
    assert seen[0][0] == [("t_id", "string"), ("t", "string"), ("v", "bigint")]
    got = {(r["t_id"], r["t"]): r["v"] for r in L.dictionary_longest(df, "t", dictionary, ["v"]).collect()}
    assert got == {("x", "a padded"): 8, ("x", "ape pad"): 7, (None, "pad"): 7, ("y", ""): None, ("z", None): None}
    nothing = L.dictionary_longest(df, "t", dictionary.limit(0), ["v"])
    assert nothing.count() == 5 and nothing.where("v IS NOT NULL").count() == 0


def test_key_argument(spark):
    one = spark.range(1)
    for text, want in {"Am": ("A", "minor"), "F# minor": ("F#", "minor"), "Bb": ("Bb", "major"), "xm": ("XM", "minor")}.items():
        key, key_type = X.parse_key_argument(text)
        assert tuple(one.select(key, key_type).first()) == want


def test_enharmonic_keys_share_a_pitch_class(spark):
    df = spark.createDataFrame([(k,) for k in ("C#", "Db", "Cb", "B", "G")], "k string")
    assert [r[0] for r in df.select(X.pitch_class(F.col("k"))).collect()] == [1, 1, 11, 11, 7]


def test_fixed_values_keep_their_numbers():
    assert len(dims.entries(dims.INSTRUMENTS)) == 83
    assert len(dims.entries(dims.GENRE_KEYWORDS)) == 70
    assert len(dims.entries(dims.DESCRIPTOR_KEYWORDS)) == 36
    assert [e[0] for e in dims.keyword_rank([("b",), ("aa",), ("c",), ("dd",)])] == ["aa", "dd", "b", "c"]


def test_extensions_and_paths(spark):
    assert parse_extensions(" .wav, MID ") == ["wav", "mid"]
    assert parse_extensions(midi_only=True) == ["mid", "midi", "smf"]
    assert name_glob(["m4a"]) == "*.{[mM]4[aA]}"
    df = spark.createDataFrame([("/lib/a.b/x.tar.Wav",), ("/lib/.hid",), ("/lib/end.",), ("/lib/d/plain",)], "path string")
    got = [(r["stem"], r["ext"], r["rel_parent"]) for r in path_parts(df, root="/lib").collect()]
    assert got == [("x.tar", "wav", "a.b"), (".hid", "", "."), ("end.", "", "."), ("plain", "", "d")]
