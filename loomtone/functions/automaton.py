"""Many keywords looked for in one walk over a text: automata with failure links, one per shard of a dictionary.

Tasks build the shards from the dictionary table and keep them in the shared folder; a task that searches texts takes one shard after the other over the texts it
holds, so that neither the dictionary's size nor its most frequent letters make rows of text positions. A shard has a bounded size, whatever the
dictionary's. Python workers keep their last shards between batches and tasks.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtone.workspace import forget_later, scratch_path

#: Bytes of keywords and values, as JSON, of one shard: some 100 MB of automaton in a worker.
SHARD_BYTES = 8 << 20
#: Bytes of text that a task holds while it goes through the shards.
TEXT_BYTES = 32 << 20
_HELD_SHARDS = 2
_held: OrderedDict[tuple[str, int], tuple] = OrderedDict()


def _build(table: pa.Table) -> pa.Table:
    """One row: the pickled automaton of a shard with the rows of repeated keywords, and its words in matching order."""
    shard, words = table.column("_shard")[0].as_py(), table.drop_columns(["_shard"])
    keys = words.column("keyword").to_pylist()
    at = words.column("position").to_pylist() if "position" in words.column_names else [None] * len(keys)
    order = sorted(range(len(keys)), key=lambda k: (-len(keys[k]), at[k] is not None, at[k], keys[k]))
    words = words.take(pa.array(order)).combine_chunks()
    found, more = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
    for place, k in enumerate(order):
        first = found.get(keys[k], -1)
        if first < 0:
            found.add_word(keys[k], place)
        else:
            more.setdefault(first, []).append(place)
    found.make_automaton()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, words.schema) as out:
        out.write_table(words)
    return pa.table({"_shard": pa.array([shard], pa.int32()), "automaton": pa.array([pickle.dumps((found, more))], pa.binary()),
                     "words": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def write_shards(dictionary: DataFrame) -> list[tuple[str, int]]:
    """Build the shards of ``dictionary(keyword, position?, values...)`` and tell where each lies: part file and row group. Null and empty keywords are left out."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    from loomtone.sources.listing import open_store, qualified

    spark = dictionary.sparkSession
    words = dictionary.where(F.length("keyword") > 0)
    size = words.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    shards = max(-(-size // SHARD_BYTES), 1)
    dealt = words.withColumn("_shard", F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(shards)).cast("int"))
    path = qualified(spark, scratch_path(spark, "automata"))
    # a row group per shard, so that a task reads no more than the shard it needs
    dealt.groupBy("_shard").applyInArrow(_build, "_shard int, automaton binary, words binary").write.option("parquet.block.row.count.limit", "1").parquet(path)
    forget_later(spark, path)
    system, inner, prefix = open_store(path)
    parts = sorted(i.path for i in system.get_file_info(fs.FileSelector(inner)) if i.path.endswith(".parquet"))
    return [(prefix + p, k) for p in parts for k in range(pq.read_metadata(p, filesystem=system).num_row_groups)]


def _load(part: str, group: int) -> tuple:
    """``(automaton, rows of repeated keywords, words)`` of each row of a row group."""
    if (part, group) in _held:
        _held.move_to_end((part, group))
        return _held[part, group]
    import pyarrow.parquet as pq

    from loomtone.sources.listing import open_store

    system, inner, _ = open_store(part)
    with pq.ParquetFile(inner, filesystem=system) as file:
        rows = file.read_row_group(group, columns=["automaton", "words"]).to_pylist()
    made = tuple((*pickle.loads(r["automaton"]), pa.ipc.open_stream(r["words"]).read_all().combine_chunks()) for r in rows)
    while len(_held) >= _HELD_SHARDS:
        _held.popitem(last=False)
    _held[part, group] = made
    return made


def find_keywords(texts: DataFrame, keys: list[str], text: str, dictionary: DataFrame, best: bool = False) -> DataFrame:
    """``keys`` and the columns of ``dictionary`` for every keyword that a text contains, once per text and row of the dictionary.

    ``best``: of each shard only the first in matching order, longest first, then by ``position`` (null first), then by keyword. Exact substrings; a null text
    contains nothing.
    """
    shards = write_shards(dictionary)
    fields = [texts.schema[k] for k in keys] + list(dictionary.schema)

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        lines = table.column(len(keys)).to_pylist()
        for part, group in shards:
            for automaton, more, words in _load(part, group):
                rows, found = [], []
                for k, line in enumerate(lines):
                    if not line:
                        continue
                    if best:
                        first = min((w for _, w in automaton.iter(line)), default=-1)
                        hits = (first,) if first >= 0 else ()
                    else:
                        hits = {w for _, w in automaton.iter(line)}
                        hits |= {m for w in hits & more.keys() for m in more[w]}
                    rows += [k] * len(hits)
                    found += hits
                    if len(found) >= 100_000:
                        yield pack(table, words, rows, found)
                        rows, found = [], []
                if found:
                    yield pack(table, words, rows, found)

    def pack(table: pa.Table, words: pa.Table, rows: list[int], found: list[int]) -> pa.RecordBatch:
        own, hit = table.select(range(len(keys))).take(pa.array(rows)), words.take(pa.array(found))
        columns = [c.combine_chunks() for c in (*own.columns, *hit.columns)]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= TEXT_BYTES:
                yield from search(held)
                held, size = [], 0
        if held:
            yield from search(held)

    return texts.select(*keys, text).mapInArrow(scan, T.StructType(fields))
