"""Listing in rounds, and loop files read by ranges."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.plans.decode import decode_files, decode_library
from loomtone.operators.sinks import split_errors
from loomtone.sources import listing, ranged
from loomtone.sources.files import LIBRARY_EXTENSIONS, read_content


def write(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def below(rows, root):
    return {r["path"].split(f"{root}/", 1)[1]: r["reason"] for r in rows}


def test_wide_folders_are_divided_by_names(spark, tmp_path):
    rng = random.Random(4)
    root, wanted = str(tmp_path / "lib"), {}
    for folder, n in (("wide", 300), ("deep/er", 40), ("wide/sub", 35), ("few", 3), ("_held", 30)):
        for k in range(n):
            name = f"{folder}/{rng.choice(['a', 'Z', 'é', '~', '.x', '_y', ' '])}{k}.{rng.choice(['WAV', 'mid', 'txt', 'Caf'])}"
            data = rng.choice([b"", b"x"])
            write(f"{root}/{name}", data)
            hidden = any(p.startswith((".", "_")) for p in name.split("/"))
            if not name.endswith("txt"):
                wanted[name] = "empty file" if not data else "hidden file" if hidden else None
    os.symlink(f"{root}/wide", f"{root}/few/again")  # a folder behind a link is not entered
    os.symlink(f"{root}/nowhere.wav", f"{root}/few/broken.wav")
    wanted["few/broken.wav"] = "unreadable file"
    base = listing.write_listing(spark, root, LIBRARY_EXTENSIONS, width=25, parts=6)
    rows = listing.read_listing(spark, base).collect()
    assert len(rows) == len(wanted) and below(rows, root) == wanted
    divided = spark.read.option("recursiveFileLookup", "true").schema(listing.ROWS).parquet(base).where("kind = 2")
    assert {r.path.split("/lib/")[1]: r["count"] for r in divided.groupBy("path").count().collect()} == {"wide": 6, "deep/er": 2, "wide/sub": 2, "_held": 2}
    flat = listing.list_library(spark, root + "/wide", ["mid"], recursive=False, width=25).collect()
    assert below(flat, root + "/wide") == {n[5:]: r for n, r in wanted.items() if n.startswith("wide/") and not n.startswith("wide/sub") and n.endswith("mid")}


def test_names_that_are_not_text(spark, tmp_path):
    root = str(tmp_path)
    write(os.fsencode(root) + b"/b\xffd.wav")
    write(f"{root}/good.wav")
    assert sorted(below(listing.list_library(spark, root, ["wav"], width=1).collect(), root).values(), key=str) == [None, "unreadable name"]


@pytest.mark.parametrize("count, width, most", [(100, 10, 50), (100, 10, 3), (7, 10, 3), (5000, 1, 64)])
def test_ranges_cover_all_names(count, width, most):
    names = [str(random.Random(k).random()) for k in range(count)]
    ranges = listing.name_ranges(names[:200], count, width, most)
    assert len(ranges) <= most and all(sum((a is None or a <= n) and (b is None or n < b) for a, b in ranges) == 1 for n in names)


def chunk(kind, body, pad=False):
    return kind + struct.pack(">I" if pad else ">Q", len(body)) + body + (b"\0" if pad and len(body) % 2 else b"")


def loop(audio=b"", marks=3):
    uuid = bytes.fromhex(dims.TAG_UUID) + struct.pack(">I", 2) + b"genre\0Jazz\0beat count\0" + b"8\0"
    mark = bytes.fromhex(dims.MARKER_UUID) + struct.pack(">IIHHII", 0, 0x10000, 0x32, 0x10, 0, marks) + b"".join(struct.pack(">HHII", 1, 0, 0, 10 * k) for k in range(marks))
    desc = struct.pack(">d4sIIIII", 44100.0, b"lpcm", 0, 0, 0, 2, 16)
    return (b"caff\0\1\0\0" + chunk(b"desc", desc) + chunk(b"data", audio) + chunk(b"uuid", uuid) + chunk(b"uuid", b"?" * 40) + chunk(b"uuid", mark)
            + chunk(b"pakt", struct.pack(">qqii", 1, 88200, 0, 0)) + chunk(b"info", struct.pack(">I", 1) + b"genre\0Funk\0"))


def tree(root):
    rng = random.Random(9)
    aiff = b"FORM\0\0\0\0AIFF" + chunk(b"NAME", b"odd", True) + chunk(b"COMM", struct.pack(">HIH", 2, 44100, 16) + bytes.fromhex("400EAC44000000000000"), True)
    midi = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 480) + b"MTrk" + struct.pack(">I", 12) + bytes.fromhex("00903C40 60803C00 00FF2F00")
    files = {"a.caf": loop(), "b.CAF": loop(rng.randbytes(70_000), 5000), "c.aif": aiff, "d.mid": midi, "e.caf": b"caff", "f.caf": b"RIFF1234", "g.caf": b"caff\0\1\0\0" + b"data" + b"\xff" * 8 + b"zz",
             "h.caf": loop()[:-9], "i.aiff": b"FORM\0\0\0\0AIFF" + b"SSND\xff\xff\xff\xff", "j.caf": b"caff\0\1\0\0" + chunk(b"midi", midi) + chunk(b"t\xe9st", b""), "k.caf": b"caff\0\1\0\0" + b"\0" * 900,
             "sub/l.mid": b"MThd", "m.caf": b"caff\0\1\0\0" + chunk(b"uuid", b"short") + chunk(b"desc", b"")}
    for name, data in files.items():
        write(f"{root}/{name}", data)
    return files


@pytest.mark.parametrize("ahead", [12, 16 << 10])
def test_ranged_reads_give_the_records_of_whole_files(spark, tmp_path, ahead):
    root = str(tmp_path / "lib")
    files = tree(root)
    from loomtone.plans.decode import decode_chunked

    read = ranged.scan_loops(spark, root, recursive=True, read_ahead=ahead, files_per_task=3)
    got = {r["file_path"].split("/lib/")[1]: r for r in decode_chunked(read).collect()}
    names = [(f"file:{root}/{n}", len(d), bytearray(d)) for n, d in files.items()]
    whole = {r["file_path"].split("/lib/")[1]: r for r in decode_files(spark.createDataFrame(names, "path string, length bigint, content binary")).collect()}
    assert set(got) == set(files)
    for name in files:
        if whole[name]["error"] is None:
            assert got[name] == whole[name]
        else:
            assert (got[name]["error"], got[name]["loop_type"]) == (whole[name]["error"], None)


def test_audio_data_is_not_read(spark, tmp_path):
    root = str(tmp_path / "lib")
    whole = loop()
    head, at = whole[:52], whole.index(b"data")
    assert at == 52
    with_gap = {"big.caf": 3 << 30, "some.caf": 12 << 20}  # the gap is a hole and takes no room on disk
    for name, gap in with_gap.items():
        write(f"{root}/{name}", head + b"data" + struct.pack(">Q", gap))
        with open(f"{root}/{name}", "r+b") as f:
            f.seek(gap, os.SEEK_END)
            f.write(whole[at + 12:])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in ranged.scan_loops(spark, root).collect()}
    for name, gap in with_gap.items():
        assert rows[name]["length"] == len(whole) + gap and rows[name]["bytes_read"] < 0.01 * gap
        assert [c["type"] for c in rows[name]["chunks"]] == ["desc", "data", "uuid", "uuid", "uuid", "pakt", "info"]
    record = {r["file_path"].rsplit("/", 1)[1]: r for r in decode_library(spark, root).collect()}["big.caf"]
    assert (record["metadata"]["genre"], record["audio"]["duration"], record["beat_markers"]["positions"]) == ("Funk", 2.0, [0, 10, 20])


def test_every_listed_file_has_a_row(spark, tmp_path):
    root = str(tmp_path / "lib")
    tree(root)
    write(f"{root}/empty.caf", b"")
    write(f"{root}/.trash/gone.caf", loop())
    write(f"{root}/_kept.aif", loop())
    os.symlink(f"{root}/nowhere", f"{root}/link.caf")
    good, bad = split_errors(decode_library(spark, root, recursive=True))
    errors = {r["file"].split("/lib/")[1]: r["error"].split(":")[0] for r in bad.collect()}
    assert errors == {"empty.caf": "empty file", ".trash/gone.caf": "hidden file", "_kept.aif": "hidden file", "link.caf": "unreadable file",
                      "e.caf": "Invalid CAF file", "f.caf": "Unknown file format"}
    assert good.count() + len(errors) == listing.list_library(spark, root, dims.LOOP_EXTENSIONS).count() == 17


def test_damaged_files_are_rows(spark, tmp_path):
    root = str(tmp_path / "lib")
    write(f"{root}/chunks.caf", b"caff\0\1\0\0" + chunk(b"free", b"") * 20)
    write(f"{root}/info.caf", b"caff\0\1\0\0" + chunk(b"info", b"x" * 400))
    write(f"{root}/long.mid", b"MThd" + b"\0" * 400)
    base = listing.write_listing(spark, root, dims.LOOP_EXTENSIONS)
    write(f"{root}/late.caf", loop())  # not in the listing any more
    os.remove(f"{root}/long.mid")
    got = {r.path.rsplit("/", 1)[1]: r.error.split(":")[0] for r in ranged.read_loops(spark, base, most_payload=300, most_chunks=10).collect()}
    assert got == {"chunks.caf": "more than 10 chunks", "info.caf": "chunk info of 400 bytes", "long.mid": "cannot be read (FileNotFoundError)"}


def test_empty_library_and_unreadable_content(spark, tmp_path):
    assert ranged.scan_loops(spark, str(tmp_path)).collect() == []
    assert decode_library(spark, str(tmp_path), recursive=True).collect() == []
    write(f"{tmp_path}/a.mid", b"MThd")
    paths = spark.createDataFrame([(f"file:{tmp_path}/a.mid",), (f"file:{tmp_path}/none.mid",)], "path string")
    assert {r.path.rsplit("/", 1)[1]: r.content for r in read_content(paths, 1).select("path", F.col("content").cast("string")).collect()} == {"a.mid": "MThd", "none.mid": None}
