"""Names and paths: parsing, keyword lookups, precedence, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.views import LOOP_FILES, loop_files, table
from loomtone import dims
from loomtone.functions import display as D
from loomtone.functions import numbers as N
from loomtone.functions import text as X
from loomtone.operators import lookup as L
from loomtone.operators import postings as P
from loomtone.operators import quality as Q
from loomtone.operators import reports as R
from loomtone.operators import resolve as V
from loomtone.operators import selection as W
from loomtone.operators import sinks
from loomtone.operators import stats as T
from loomtone.plans.convert import convert_catalog, report_rows
from loomtone.sources import files as Fs
from loomtone.workspace import keep

QUERIES: dict = {}
SQL: dict[str, str] = {}
WITH_FILES = S.with_(LOOP_FILES)


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# ---- paths and listings ---------------------------------------------------------------------------------------------

PARTS = """
parts AS (SELECT *, stem || '.' || ext_token AS file_name, lower(ext_token) AS ext, '/lib/' || dir AS parent,
  dir AS rel_parent FROM loop_files)
"""
WITH_PARTS = S.with_(LOOP_FILES, PARTS)


def parts(spark, sf):
    return Fs.path_parts(loop_files(spark, sf).drop("stem"), "path", "/lib")


@query("path_parts", WITH_PARTS + "SELECT id, file_name, stem, ext, parent, rel_parent FROM parts")
def _(spark, sf):
    return parts(spark, sf).select("id", "file_name", "stem", "ext", "parent", "rel_parent")


@query(
    "path_parts_urls",
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS file_name FROM pages),
       n AS (SELECT *, regexp_extract(file_name, '^(.+)\\.([^.]+)$', 1) AS s,
               lower(regexp_extract(file_name, '^.+\\.([^.]+)$', 1)) AS ext FROM u)
       SELECT page_id, file_name, CASE WHEN s = '' THEN file_name ELSE s END AS stem, ext,
         substr(url, 1, length(url) - length(file_name) - 1) AS parent FROM n""",
)
def _(spark, sf):
    return Fs.path_parts(table(spark, sf, "pages"), "url").select("page_id", "file_name", "stem", "ext", "parent")


@query("scan_extension_filter", WITH_FILES + "SELECT id, path FROM loop_files WHERE lower(ext_token) IN ('wav', 'mid')")
def _(spark, sf):
    return Fs.filter_extensions(loop_files(spark, sf), Fs.parse_extensions(" .wav, mid ")).select("id", "path")


@query(
    "is_midi",
    WITH_FILES + "SELECT id, lower(ext_token) IN ('mid', 'midi', 'smf') AS is_midi FROM loop_files",
)
def _(spark, sf):
    return parts(spark, sf).select("id", Fs.is_midi(F.col("ext")).alias("is_midi"))


@query(
    "is_supported",
    WITH_FILES + """SELECT id, path FROM loop_files
      WHERE lower(ext_token) IN ('wav','aif','aiff','mp3','m4a','aac','flac','alac','caf','ogg','wma')""",
)
def _(spark, sf):
    return parts(spark, sf).filter(Fs.is_supported(F.col("ext"))).select("id", "path")


@query("scan_counts", WITH_FILES + "SELECT lower(ext_token) = 'mid' AS is_midi, count(*) AS files FROM loop_files "
       "WHERE ext_token <> 'txt' GROUP BY 1")
def _(spark, sf):
    known = parts(spark, sf).filter(F.col("ext").isin(Fs.LIBRARY_EXTENSIONS))
    return T.scan_counts(known.withColumn("is_midi", Fs.is_midi(F.col("ext"))))


@query(
    "add_files",
    WITH_FILES + """SELECT DISTINCT path FROM (
      SELECT CASE WHEN id % 6 = 0 THEN replace(path, '/lib/', '/lib/.hidden/') ELSE path END AS path, ext_token
      FROM loop_files) WHERE path NOT LIKE '%/.%' AND ext_token IN ('wav', 'aif', 'caf', 'mp3')
      AND path NOT IN (SELECT path FROM loop_files WHERE id % 3 = 0)""",
)
def _(spark, sf):
    files = loop_files(spark, sf)
    hidden = F.regexp_replace("path", "^/lib/", "/lib/.hidden/")
    incoming = files.select(F.when(F.col("id") % 6 == 0, hidden).otherwise(F.col("path")).alias("path"))
    return W.add_files(files.filter("id % 3 = 0"), incoming)


@query("select_files", WITH_FILES + "SELECT id, path FROM loop_files WHERE id IN (SELECT o_orderkey FROM orders "
       "WHERE o_orderstatus = 'F')")
def _(spark, sf):
    chosen = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return W.select_files(loop_files(spark, sf), chosen, "id").select("id", "path")


@query("remove_files", WITH_FILES + "SELECT id, path FROM loop_files WHERE id NOT IN (SELECT o_orderkey FROM orders "
       "WHERE o_orderstatus = 'F')")
def _(spark, sf):
    chosen = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return W.remove_files(loop_files(spark, sf), chosen, "id").select("id", "path")


@query("union_listing", WITH_FILES + "SELECT DISTINCT path FROM loop_files")
def _(spark, sf):
    files = loop_files(spark, sf)
    listings = [Fs.filter_extensions(files, [e]) for e in ("wav", "aif", "caf", "mp3", "mid", "txt")]
    return W.union_listing(*listings, Fs.filter_extensions(files, ["WAV", "mid"]))


@query("sort_files", WITH_FILES + "SELECT DISTINCT path FROM loop_files ORDER BY path")
def _(spark, sf):
    return W.sort_files(loop_files(spark, sf))


@query(
    "row_progress",
    WITH_FILES + """SELECT path, row_number() OVER (ORDER BY path) AS position, count(*) OVER () AS total,
      row_number() OVER (ORDER BY path) / count(*) OVER () AS share FROM (SELECT DISTINCT path FROM loop_files)""",
)
def _(spark, sf):
    return W.row_progress(loop_files(spark, sf))


@query(
    "plan_output",
    WITH_PARTS + """SELECT id, target, count(*) OVER (PARTITION BY target) > 1 AS collides FROM (
      SELECT id, '/out/' || stem || '.caf' AS target FROM parts)""",
)
def _(spark, sf):
    return sinks.plan_output(parts(spark, sf), "/out/").select("id", "target", "collides")


@query(
    "plan_output_tree",
    WITH_PARTS + """SELECT id, target, count(*) OVER (PARTITION BY target) > 1 AS collides FROM (
      SELECT id, '/out/' || dir || '/' || stem || '.caf' AS target FROM parts)""",
)
def _(spark, sf):
    return sinks.plan_output(parts(spark, sf), "/out", preserve_structure=True).select("id", "target", "collides")


# ---- facts in names -------------------------------------------------------------------------------------------------


@query("normalize_text", f"SELECT doc_id, {S.normal('text')} AS norm FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


@query("extract_tempo", WITH_FILES + f"SELECT id, {S.tempo('stem')} AS tempo FROM loop_files")
def _(spark, sf):
    return L.with_tempo(loop_files(spark, sf)).select("id", "tempo")


@query(
    "extract_tempo_names",
    "WITH n AS (SELECT c_custkey, c_name || '_' || (c_custkey * 37 % 400) || '_' || (c_custkey % 250) || '_' || "
    "(c_custkey * 11 % 320) || CASE WHEN c_custkey % 3 = 0 THEN '_A' WHEN c_custkey % 3 = 1 THEN '_x.wav' ELSE '' END AS stem "
    f"FROM customer) SELECT c_custkey, stem, {S.tempo('stem')} AS tempo FROM n",
)
def _(spark, sf):
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, F.lit("_A")).when(k % 3 == 1, F.lit("_x.wav")).otherwise(F.lit(""))
    stem = F.concat(F.concat_ws("_", "c_name", (k * 37 % 400).cast("string"), (k % 250).cast("string"),
                                (k * 11 % 320).cast("string")), tail)
    named = table(spark, sf, "customer").select("c_custkey", stem.alias("stem"))
    return L.with_tempo(named)


@query("extract_key", WITH_FILES + f"SELECT * FROM {S.key_columns('loop_files', 'id', 'stem')}")
def _(spark, sf):
    return L.with_key(loop_files(spark, sf)).select("id", F.col("key.key").alias("key_signature"), "key.key_type")


@query(
    "lookup_instrument",
    S.with_(LOOP_FILES, S.INSTRUMENTS) + f"""SELECT f.id, coalesce(v1, 'Other Instrument') AS category,
      coalesce(v2, 'Other') AS subcategory
      FROM loop_files f LEFT JOIN {S.longest('loop_files', 'id', S.normal('s.stem'), 'd_instrument')} h USING (id)""",
)
def _(spark, sf):
    return L.lookup_instrument(loop_files(spark, sf)).select("id", "category", "subcategory")


@query(
    "lookup_instrument_prose",
    S.with_(S.INSTRUMENTS) + f"""SELECT f.doc_id, coalesce(v1, 'Other Instrument') AS category,
      coalesce(v2, 'Other') AS subcategory
      FROM documents f LEFT JOIN {S.longest('documents', 'doc_id', S.normal('s.text'), 'd_instrument')} h USING (doc_id)""",
)
def _(spark, sf):
    return L.lookup_instrument(table(spark, sf, "documents"), "text").select("doc_id", "category", "subcategory")


@query(
    "lookup_genre",
    S.with_(LOOP_FILES, PARTS, S.GENRES) + f"""SELECT f.id, coalesce(v1, 'Other Genre') AS genre FROM parts f
      LEFT JOIN {S.longest('parts', 'id', S.normal("s.rel_parent || ' ' || s.stem"), 'd_genre')} h USING (id)""",
)
def _(spark, sf):
    return L.lookup_genre(parts(spark, sf)).select("id", "genre")


@query(
    "lookup_genre_urls",
    S.with_(S.GENRES) + f"""SELECT f.page_id, coalesce(v1, 'Other Genre') AS genre FROM pages f
      LEFT JOIN {S.longest('pages', 'page_id', S.normal('s.url'), 'd_genre')} h USING (page_id)""",
)
def _(spark, sf):
    urls = Fs.path_parts(table(spark, sf, "pages"), "url")
    return L.lookup_genre(urls, "file_name", "parent").select("page_id", "genre")


@query(
    "lookup_descriptors",
    S.with_(LOOP_FILES, S.DESCRIPTORS) + f"""SELECT f.id, coalesce(v, '') AS descriptors FROM loop_files f LEFT JOIN (
      SELECT s.id, array_to_string(list_sort(list(DISTINCT d.v1)), ',') AS v FROM loop_files s
      JOIN d_descriptor d ON contains({S.normal('s.stem')}, d.kw) GROUP BY s.id) h USING (id)""",
)
def _(spark, sf):
    found = L.lookup_descriptors(loop_files(spark, sf))
    return found.select("id", F.array_join("descriptors", ",").alias("descriptors"))


@query(
    "lookup_descriptors_prose",
    S.with_(S.DESCRIPTORS) + f"""SELECT f.doc_id, coalesce(v, '') AS descriptors FROM documents f LEFT JOIN (
      SELECT s.doc_id, array_to_string(list_sort(list(DISTINCT d.v1)), ',') AS v FROM documents s
      JOIN d_descriptor d ON contains({S.normal('s.text')}, d.kw) GROUP BY s.doc_id) h USING (doc_id)""",
)
def _(spark, sf):
    found = L.lookup_descriptors(table(spark, sf, "documents"), "text")
    return found.select("doc_id", F.array_join("descriptors", ",").alias("descriptors"))


BRANDS = """
brands AS (SELECT kw, md5(kw) AS pos, 'brand ' || kw AS tag FROM (
  SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS kw FROM benchmark) WHERE length(kw) >= 3)
"""


def own_dictionary(spark, sf):
    """A dictionary brought by the user: every word of three or more letters of the benchmark passages, in the order of a digest."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword"))
    kept = words.filter(F.length("keyword") >= 3).distinct()
    return kept.select("keyword", F.md5("keyword").alias("position"), F.concat(F.lit("brand "), "keyword").alias("tag"))


@query(
    "sort_keywords",
    S.with_(BRANDS) + "SELECT kw AS keyword, row_number() OVER (ORDER BY length(kw) DESC, pos) AS place FROM brands",
)
def _(spark, sf):
    return L.rank_keywords(own_dictionary(spark, sf), "place").select("keyword", F.col("place").cast("bigint").alias("place"))


@query(
    "lookup_dictionary_longest",
    S.with_(BRANDS) + """SELECT f.page_id, tag FROM pages f LEFT JOIN (
      SELECT s.page_id, first(tag ORDER BY length(kw) DESC, pos) AS tag FROM pages s JOIN brands ON contains(lower(s.html), kw)
      GROUP BY 1) h USING (page_id)""",
)
def _(spark, sf):
    texts = table(spark, sf, "pages").select("page_id", F.lower("html").alias("html"))
    return L.dictionary_longest(texts, "html", own_dictionary(spark, sf), ["tag"]).select("page_id", "tag")


@query(
    "lookup_dictionary_all",
    S.with_(BRANDS) + """SELECT DISTINCT s.page_id, kw AS keyword FROM pages s JOIN brands ON contains(lower(s.html), kw)""",
)
def _(spark, sf):
    texts = table(spark, sf, "pages").select("page_id", F.lower("html").alias("html"))
    words = own_dictionary(spark, sf).withColumn("word", F.col("keyword"))
    return L.dictionary_all(texts, "page_id", "html", words, "word").select("page_id", F.col("word").alias("keyword"))


OWN = """
own AS (SELECT DISTINCT lower(regexp_extract(p_name, '^[A-Za-z]+')) AS kw, 'Own ' || lower(regexp_extract(p_name, '^[A-Za-z]+')) AS v1 FROM part
  WHERE length(regexp_extract(p_name, '^[A-Za-z]+')) > 1)
"""


@query(
    "convert_own_dictionary",
    S.with_(OWN) + f"""SELECT doc_id, coalesce(i.v, '{dims.DEFAULT_CATEGORY}') AS category, coalesce(i.v, '{dims.DEFAULT_GENRE}') AS genre,
      coalesce(i.every, '') AS descriptors FROM documents LEFT JOIN (
        SELECT doc_id, first(v1 ORDER BY length(kw) DESC, kw) AS v, array_to_string(list_sort(list(DISTINCT v1)), ',') AS every
        FROM (SELECT doc_id, {S.normal('text')} AS t FROM documents) JOIN own ON contains(t, kw) GROUP BY 1) i USING (doc_id)""",
)
def _(spark, sf):
    word = F.lower(F.regexp_extract("p_name", "^[A-Za-z]+", 0))
    own = table(spark, sf, "part").select(word.alias("keyword")).where("length(keyword) > 1").distinct().select(
        "keyword", F.col("keyword").alias("position"), F.concat(F.lit("Own "), "keyword").alias("value1"), F.lit("own").alias("value2"))
    files = table(spark, sf, "documents").select("doc_id", F.col("text").alias("stem"), F.lit("").alias("rel_parent"))
    made = convert_catalog(files, dictionaries={k: own for k in ("instrument", "genre", "descriptor")}, key="doc_id")
    return made.select("doc_id", "category", "genre", "descriptors")


@query(
    "first_match",
    WITH_FILES + f"""SELECT tempo, count(*) AS files FROM (SELECT {S.tempo('stem')} AS tempo FROM loop_files) GROUP BY 1""",
)
def _(spark, sf):
    return L.with_tempo(loop_files(spark, sf)).groupBy("tempo").agg(F.count("*").alias("files"))


@query(
    "key_text",
    WITH_FILES + f"""SELECT id, CASE WHEN key_signature <> '' THEN key_signature ||
      CASE WHEN key_type = 'minor' THEN 'm' ELSE '' END END AS key_text FROM {S.key_columns('loop_files', 'id', 'stem')}""",
)
def _(spark, sf):
    text = X.key_text(F.col("key.key"), F.col("key.key_type"))
    return L.with_key(loop_files(spark, sf)).select("id", text.alias("key_text"))


@query(
    "time_sig_text",
    "SELECT event_id, (event_id % 12 + 1) || '/' || CAST(pow(2, event_id % 6) AS INTEGER) AS signature FROM events",
)
def _(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", X.time_sig_text(e % 12 + 1, e % 6).alias("signature"))


@query(
    "time_sig_parts",
    """SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 12 + 1 AS INTEGER) END AS numerator,
      CASE WHEN event_id % 5 > 0 THEN CAST(pow(2, event_id % 6) AS INTEGER) END AS denominator FROM events""",
)
def _(spark, sf):
    e = F.col("event_id")
    signature = F.when(e % 5 > 0, X.time_sig_text(e % 12 + 1, e % 6)).otherwise(F.lit(""))
    parted = X.time_sig_parts(signature)
    return table(spark, sf, "events").select(
        "event_id", parted["numerator"].alias("numerator"), parted["denominator"].alias("denominator")
    )


@query(
    "note_name",
    f"""SELECT event_id, list_extract({"[" + ", ".join(S.quote(n) for n in dims.NOTE_NAMES.split()) + "]"},
      ((event_id % 128 - 48) % 12 + 12) % 12 + 1) AS note, CAST(((event_id % 128 - 48) % 12 + 12) % 12 AS INTEGER)
      AS pitch_class FROM events""",
)
def _(spark, sf):
    note = X.pitch_class_name(F.col("event_id") % 128)
    return table(spark, sf, "events").select("event_id", note.alias("note"), X.pitch_class(note).alias("pitch_class"))


@query("signed_byte", "SELECT event_id, CASE WHEN event_id % 256 > 127 THEN event_id % 256 - 256 ELSE event_id % 256 END "
       "AS signed FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", N.signed_byte(F.col("event_id") % 256).alias("signed"))


@query(
    "lookup_key_signature",
    S.with_(S.KEYS) + """SELECT event_id, k.key AS key_signature, k.key_type FROM events
      LEFT JOIN d_key k ON k.sf = event_id % 17 - 8 AND k.mi = event_id % 3""",
)
def _(spark, sf):
    e = F.col("event_id")
    found = L.lookup_key_signature(e % 17 - 8, e % 3)
    return table(spark, sf, "events").select(
        "event_id", found["key"].alias("key_signature"), found["key_type"].alias("key_type")
    )


# ---- numbers and texts of reports -----------------------------------------------------------------------------------


@query(
    "beat_count",
    """SELECT o_orderkey AS id, CAST(round_even((60 + o_orderkey % 130) * (o_totalprice / 10000) / 60.0, 0) AS INTEGER)
      AS beats FROM orders""",
)
def _(spark, sf):
    tempo, duration = F.lit(60) + F.col("o_orderkey") % 130, F.col("o_totalprice") / F.lit(10000.0)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), N.beat_count(tempo, duration).alias("beats")
    )


@query(
    "tempo_from_beats",
    """SELECT o_orderkey AS id, CASE WHEN b > 0 AND d > 0 THEN CAST(printf('%.2f', CAST(b * 60 AS DOUBLE) / d) AS DOUBLE)
      WHEN m > 0 THEN CAST(m AS DOUBLE) END AS tempo FROM (
        SELECT o_orderkey, o_orderkey % 17 AS b, CASE WHEN o_orderkey % 9 = 0 THEN 0.0::DOUBLE ELSE o_totalprice / 10000 END
          AS d, o_orderkey % 2 * 120 AS m FROM orders)""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    duration = F.when(k % 9 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / F.lit(10000.0))
    return table(spark, sf, "orders").select(
        k.alias("id"), N.tempo_from_beats(k % 17, duration, k % 2 * 120).alias("tempo")
    )


@query(
    "bpm",
    "SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 120 ELSE CAST(round_even(60000000.0::DOUBLE / "
    "(event_id % 100 * 10007), 0) AS INTEGER) END AS bpm FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", N.bpm(F.col("event_id") % 100 * 10007).alias("bpm"))


@query(
    "midi_duration",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE (event_id % 5000) * "
    "((300000 + event_id % 700000) / 1e6) / (event_id % 7 * 96) END AS duration FROM events",
)
def _(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", N.midi_duration(e % 5000, F.lit(300000) + e % 700000, e % 7 * 96).alias("duration")
    )


@query("frames_duration", WITH_FILES + "SELECT id, CASE WHEN id % 5 > 0 THEN num_frames / sample_rate END AS duration "
       "FROM loop_files")
def _(spark, sf):
    rate = F.when(F.col("id") % 5 > 0, F.col("sample_rate")).otherwise(F.lit(0.0))
    return loop_files(spark, sf).select("id", N.frames_duration(F.col("num_frames"), rate).alias("duration"))


@query(
    "marker_seconds",
    WITH_FILES + "SELECT id, CAST(printf('%.6f', num_frames / CASE WHEN id % 5 > 0 THEN sample_rate ELSE 44100.0::DOUBLE END) "
    "AS DOUBLE) AS seconds FROM loop_files",
)
def _(spark, sf):
    rate = F.when(F.col("id") % 5 > 0, F.col("sample_rate")).otherwise(F.lit(0.0))
    return loop_files(spark, sf).select("id", N.marker_seconds(F.col("num_frames"), rate).alias("seconds"))


@query(
    "fmt_duration",
    """SELECT o_orderkey AS id, CASE WHEN s > 0 THEN CAST((s - s % 60) / 60 AS INTEGER) || ':' || printf('%06.3f', s % 60)
      ELSE '0:00.000' END AS shown FROM (SELECT o_orderkey, (o_totalprice - 50000) / 1000 AS s FROM orders)""",
)
def _(spark, sf):
    seconds = (F.col("o_totalprice") - 50000) / F.lit(1000.0)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), D.fmt_duration(seconds).alias("shown"))


@query(
    "fmt_duration_short",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN '--:--' ELSE
      (CAST(floor(a) AS BIGINT) // 60) || ':' || printf('%02d', CAST(floor(a) AS BIGINT) % 60) || '.' ||
      printf('%02d', CAST(floor((a % 1) * 100) AS BIGINT)) END AS shown
      FROM (SELECT o_orderkey, o_totalprice / 1000 AS a FROM orders)""",
)
def _(spark, sf):
    known = F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice") / F.lit(1000.0))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), D.fmt_duration_short(known).alias("shown"))


@query(
    "fmt_size",
    """SELECT o_orderkey AS id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024) || ' KB'
      ELSE printf('%.2f', n / 1048576) || ' MB' END AS size_text FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT)
      * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 977 END) + o_orderkey % 1024 AS n FROM orders)""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    times = F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).otherwise(977)
    n = F.floor("o_totalprice").cast("bigint") * times + k % 1024
    return table(spark, sf, "orders").select(k.alias("id"), D.fmt_size(n).alias("size_text"))


@query(
    "fmt_tempo",
    WITH_FILES + """SELECT id, CASE WHEN id % 4 = 0 THEN '—' ELSE printf('%.1f', CAST(bpm AS DOUBLE)) || ' BPM' ||
      CASE WHEN id % 2 = 0 THEN ' (auto)' ELSE '' END END AS shown FROM loop_files""",
)
def _(spark, sf):
    i = F.col("id")
    known = F.when(i % 4 != 0, F.col("bpm"))
    return loop_files(spark, sf).select("id", D.fmt_tempo(known, i % 2 == 0).alias("shown"))


@query(
    "fmt_key",
    WITH_FILES + f"""SELECT id, CASE WHEN key_signature = '' THEN '—' ELSE key_signature || CASE WHEN key_type = 'minor' THEN 'm' ELSE '' END ||
        CASE WHEN id % 3 = 0 THEN ' (auto)' ELSE '' END END AS shown
      FROM {S.key_columns('loop_files', 'id', 'stem')}""",
)
def _(spark, sf):
    shown = D.fmt_key(F.col("key.key"), F.col("key.key_type"), F.col("id") % 3 == 0)
    return L.with_key(loop_files(spark, sf)).select("id", shown.alias("shown"))


@query(
    "status_text",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Pending' WHEN 'view' THEN 'Queued' WHEN 'purchase' THEN
      'Converting...' WHEN 'signup' THEN 'Completed' ELSE 'Failed: ' || props END AS shown FROM events""",
)
def _(spark, sf):
    t = F.col("event_type")
    state = F.when(t == "click", "pending").when(t == "view", "queued").when(t == "purchase", "converting").when(
        t == "signup", "completed").otherwise("failed")
    return table(spark, sf, "events").select("event_id", D.status_text(state, F.col("props")).alias("shown"))


# ---- precedence, overrides, reports ---------------------------------------------------------------------------------

CATALOG = f"""
base AS (SELECT p.*, {S.tempo('p.stem')} AS tempo, coalesce(i.v1, 'Other Instrument') AS category,
    coalesce(i.v2, 'Other') AS subcategory, coalesce(g.v1, 'Other Genre') AS genre,
    k.key_signature AS k0, k.key_type AS t0, coalesce(d.v, '') AS descriptors, '4/4' AS time_signature,
    CASE WHEN p.id % 9 = 0 THEN 4.0::DOUBLE ELSE p.num_frames / p.sample_rate END AS duration, 'audio' AS loop_type
  FROM parts p
  LEFT JOIN {S.longest('parts', 'id', S.normal('s.stem'), 'd_instrument')} i USING (id)
  LEFT JOIN {S.longest('parts', 'id', S.normal("s.rel_parent || ' ' || s.stem"), 'd_genre')} g USING (id)
  LEFT JOIN (SELECT s.id, array_to_string(list_sort(list(DISTINCT x.v1)), ',') AS v FROM parts s
    JOIN d_descriptor x ON contains({S.normal('s.stem')}, x.kw) GROUP BY s.id) d USING (id)
  JOIN {S.key_columns('parts', 'id', 'stem')} k USING (id)),
resolved AS (SELECT * EXCLUDE (k0, t0), CASE WHEN category IN ('Drums', 'Percussion') THEN '' ELSE k0 END AS key_signature,
  CASE WHEN category IN ('Drums', 'Percussion') THEN 'neither' ELSE t0 END AS key_type FROM base),
catalog AS (SELECT *, coalesce(CAST(CASE WHEN tempo <> 0 AND duration <> 0 THEN round_even(tempo * duration / 60.0, 0) END
  AS INTEGER), 0) AS beat_count FROM resolved)
"""
ALL_DICTIONARIES = (S.INSTRUMENTS, S.GENRES, S.DESCRIPTORS)
WITH_CATALOG = S.with_(LOOP_FILES, PARTS, *ALL_DICTIONARIES, CATALOG)
META = "id, category, subcategory, genre, beat_count, time_signature, key_signature, key_type, descriptors, tempo, " \
       "duration, loop_type"


def durations(spark, sf):
    known = F.when(F.col("id") % 9 != 0, F.col("num_frames") / F.col("sample_rate"))
    return loop_files(spark, sf).select("id", known.alias("audio_duration"))


def catalog(spark, sf, **options):
    """Catalog of the derived library, all taken as audio; the length is part of the listing here."""
    known = F.when(F.col("id") % 9 != 0, F.col("num_frames") / F.col("sample_rate"))
    return convert_catalog(parts(spark, sf).withColumn("audio_duration", known), key="id", **options)


def _meta(df):
    return df.select(*META.split(", "))


@query("resolve_metadata", WITH_CATALOG + f"SELECT {META} FROM catalog")
def _(spark, sf):
    return _meta(catalog(spark, sf))


@query(
    "catalog_by_category",
    WITH_CATALOG + """SELECT category, count(*) AS files, CAST(sum(beat_count) AS BIGINT) AS beats,
      CAST(count(tempo) AS BIGINT) AS with_tempo, count(DISTINCT genre) AS genres FROM catalog GROUP BY category""",
)
def _(spark, sf):
    return catalog(spark, sf).groupBy("category").agg(
        F.count("*").alias("files"),
        F.sum("beat_count").alias("beats"),
        F.count("tempo").alias("with_tempo"),
        F.count_distinct("genre").alias("genres"),
    )


OVERRIDES = """
overrides AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN CAST(100 + o_orderkey % 50 AS INTEGER) END AS o_tempo,
  CASE WHEN o_orderkey % 15 = 0 THEN 'C#' END AS o_key, CASE WHEN o_orderkey % 20 = 0 THEN 'Drums' END AS o_category,
  CASE WHEN o_orderkey % 35 = 0 THEN 'Jazz' END AS o_genre FROM orders WHERE o_orderkey % 5 = 0)
"""


def overrides(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").filter(k % 5 == 0).select(
        k.alias("id"),
        F.when(k % 10 == 0, F.lit(100) + k % 50).cast("int").alias("tempo"),
        F.when(k % 15 == 0, F.lit("C#")).alias("key_signature"),
        F.when(k % 20 == 0, F.lit("Drums")).alias("category"),
        F.when(k % 35 == 0, F.lit("Jazz")).alias("genre"),
    )


@query(
    "merge_overrides",
    S.with_(LOOP_FILES, PARTS, *ALL_DICTIONARIES, CATALOG, OVERRIDES) + """SELECT id, coalesce(o_tempo, tempo) AS tempo,
      coalesce(o_key, key_signature) AS key_signature, coalesce(o_category, category) AS category,
      coalesce(o_genre, genre) AS genre, o_tempo IS NULL AS auto_tempo, o_key IS NULL AS auto_key,
      o_category IS NULL AS auto_category, o_genre IS NULL AS auto_genre FROM resolved LEFT JOIN overrides USING (id)""",
)
def _(spark, sf):
    merged = V.merge_overrides(catalog(spark, sf), overrides(spark, sf), "id", flags=True)
    return merged.select("id", "tempo", "key_signature", "category", "genre", *V.AUTO_FLAGS.values())


@query(
    "convert_with_overrides",
    S.with_(LOOP_FILES, PARTS, *ALL_DICTIONARIES, CATALOG, OVERRIDES) + """SELECT id, tempo, key_signature, category, genre,
      coalesce(CAST(CASE WHEN tempo <> 0 THEN round_even(tempo * duration / 60.0, 0) END AS INTEGER), 0) AS beat_count
      FROM (SELECT id, duration, coalesce(o_tempo, tempo) AS tempo,
      coalesce(o_key, key_signature) AS key_signature, coalesce(o_category, category) AS category,
      coalesce(o_genre, genre) AS genre FROM resolved LEFT JOIN overrides USING (id))""",
)
def _(spark, sf):
    merged = catalog(spark, sf, overrides=overrides(spark, sf))
    return merged.select("id", "tempo", "key_signature", "category", "genre", "beat_count")


@query(
    "apply_batch",
    WITH_CATALOG + """SELECT id, CASE WHEN s THEN 98 ELSE tempo END AS tempo, CASE WHEN s THEN 'D' ELSE key_signature END
      AS key_signature, CASE WHEN s THEN 'minor' ELSE key_type END AS key_type, category, CASE WHEN s THEN 'Funk' ELSE genre
      END AS genre, CASE WHEN s THEN '3/4' ELSE time_signature END AS time_signature, NOT s AS auto_tempo, NOT s AS auto_key,
      NOT s AS auto_genre FROM (SELECT *, id % 4 = 1 AS s FROM catalog)""",
)
def _(spark, sf):
    flags = {f: F.lit(True) for f in ("auto_tempo", "auto_key", "auto_genre")}
    files = catalog(spark, sf).withColumns(flags)
    chosen = loop_files(spark, sf).filter("id % 4 = 1")
    edit = V.BatchEdit(tempo=98, key_signature="D", key_type="minor", genre="Funk", time_signature="3/4")
    return V.apply_batch(files, chosen, "id", edit).select(
        "id", "tempo", "key_signature", "key_type", "category", "genre", "time_signature", *flags
    )


@query(
    "merge_literal_overrides",
    WITH_CATALOG + """SELECT id, 98 AS tempo, 'F#' AS key_signature, 'minor' AS key_type, category, 'Funk' AS genre,
      CAST(CASE WHEN duration <> 0 THEN round_even(98 * duration / 60.0, 0) END AS INTEGER) AS beat_count FROM catalog""",
)
def _(spark, sf):
    run = V.RunOverrides(tempo=98, key="F# min", genre="Funk")
    return catalog(spark, sf, run=run).select(
        "id", "tempo", "key_signature", "key_type", "category", "genre", "beat_count"
    )


SHOWN = """id, file_name AS filename, 'Audio' AS type, coalesce(CAST(tempo AS VARCHAR), '-') AS tempo,
  coalesce(nullif(key_signature, ''), '-') AS key, coalesce(nullif(key_type, ''), '-') AS scale,
  CASE WHEN beat_count > 0 THEN CAST(beat_count AS VARCHAR) ELSE '-' END AS beats, printf('%.2f', duration) || 's' AS duration,
  subcategory AS category, genre"""


@query(
    "report_convert",
    WITH_CATALOG + f"SELECT {SHOWN}, CASE WHEN beat_count > 0 THEN CAST(beat_count * 4 + 1 AS VARCHAR) ELSE '-' END AS "
    "markers, 'OK' AS status FROM catalog",
)
def _(spark, sf):
    return R.report_convert(report_rows(catalog(spark, sf)), "id")


@query("report_dry_run", WITH_CATALOG + f"SELECT {SHOWN} FROM catalog")
def _(spark, sf):
    return R.report_dry_run(catalog(spark, sf), "id")


@query(
    "tag_rows",
    WITH_CATALOG + """SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS INTEGER) AS pos, tag, value FROM (
      SELECT id, unnest([{'o': 1, 'tag': 'subcategory', 'value': subcategory}, {'o': 2, 'tag': 'category', 'value': category},
        {'o': 3, 'tag': 'key signature', 'value': key_signature}, {'o': 4, 'tag': 'time signature', 'value': time_signature},
        {'o': 5, 'tag': 'beat count', 'value': CASE WHEN beat_count > 0 THEN CAST(beat_count AS VARCHAR) END},
        {'o': 6, 'tag': 'descriptors', 'value': descriptors}, {'o': 7, 'tag': 'genre', 'value': genre},
        {'o': 8, 'tag': 'key type', 'value': key_type}], recursive := true) FROM catalog) WHERE value <> ''""",
)
def _(spark, sf):
    return R.tag_rows(catalog(spark, sf), "id")


@query("genre_index", WITH_CATALOG + "SELECT id, 'genre' AS tag, genre AS value FROM catalog")
def _(spark, sf):
    return T.genre_index(catalog(spark, sf), "id")


def _postings(spark, sf):
    words = F.filter(F.split("descriptors", ","), lambda d: d != "")
    numbered = catalog(spark, sf).withColumns({"number": F.col("id") + 1, "descriptors": words})
    return P.tag_postings(numbered, "number", ["genre", "category", "descriptors"])


WORDS = "list_filter(string_split(descriptors, ','), lambda d: d <> '')"

@query("tag_postings", WITH_CATALOG + f"""SELECT 'genre' AS tag, genre AS value, count(*) AS files FROM catalog GROUP BY genre
    UNION ALL SELECT 'category', category, count(*) FROM catalog GROUP BY category
    UNION ALL SELECT 'descriptors', v, count(*) FROM (SELECT unnest({WORDS}) AS v FROM catalog) GROUP BY v""")
def _(spark, sf):
    return P.file_count(_postings(spark, sf), "tag", "value")


@query("tag_members", WITH_CATALOG + "SELECT genre, id FROM catalog")
def _(spark, sf):
    genres = _postings(spark, sf).where("tag = 'genre'")
    return P.members(genres, "value").select(F.col("value").alias("genre"), (F.col("number") - 1).alias("id"))


@query("tag_matching", WITH_CATALOG + f"""SELECT id FROM catalog WHERE genre IN ('Jazz', 'Other Genre') AND category = 'Drums' AND list_contains({WORDS}, 'Dark')""")
def _(spark, sf):
    found = P.matching(_postings(spark, sf), ("genre", ["Jazz", "Other Genre"]), ("category", ["Drums"]), ("descriptors", ["Dark"]))
    return P.members(found).select((F.col("number") - 1).alias("id"))


@query("tag_facets", WITH_CATALOG + """SELECT category AS value, count(*) AS files FROM catalog WHERE genre IN ('Jazz', 'World/Ethnic') GROUP BY category""")
def _(spark, sf):
    """The lists are kept: the facet and the files that match are both read from them."""
    lists = keep(_postings(spark, sf), "postings")
    return P.facet_counts(lists, "category", P.matching(lists, ("genre", ["Jazz", "World/Ethnic"])))


STATUS = "CASE WHEN id % 7 = 3 THEN 'FAILED' ELSE 'OK' END"


def _outcome(spark, sf):
    ext = Fs.extension_of(F.col("path"))
    return loop_files(spark, sf).select(
        F.when(Fs.is_midi(ext), "midi").otherwise("audio").alias("loop_type"),
        F.when(F.col("id") % 7 == 3, "FAILED").otherwise("OK").alias("status"),
    )


FIGURES = """count(*) AS total, count(*) FILTER (status = 'OK') AS converted, CAST(0 AS BIGINT) AS skipped,
  count(*) FILTER (status <> 'OK') AS errors, count(*) FILTER (status = 'OK' AND loop_type = 'audio') AS audio,
  count(*) FILTER (status = 'OK' AND loop_type = 'midi') AS midi"""
OUTCOME = f"(SELECT CASE WHEN lower(ext_token) = 'mid' THEN 'midi' ELSE 'audio' END AS loop_type, {STATUS} AS status " \
          "FROM loop_files)"


@query("batch_stats", WITH_FILES + f"SELECT {FIGURES} FROM {OUTCOME}")
def _(spark, sf):
    return T.batch_stats(_outcome(spark, sf))


@query("batch_stats_by_type", WITH_FILES + f"SELECT loop_type, {FIGURES} FROM {OUTCOME} GROUP BY ROLLUP (loop_type)")
def _(spark, sf):
    return T.batch_stats(_outcome(spark, sf), by_type=True)


@query(
    "progress",
    "SELECT count(*) FILTER (o_orderstatus = 'F') AS current_index, count(*) AS total_files, "
    "count(*) FILTER (o_orderstatus = 'F') / count(*) AS percentage FROM orders",
)
def _(spark, sf):
    return T.progress(table(spark, sf, "orders").withColumn("done", F.col("o_orderstatus") == "F"))


@query(
    "run_result",
    "SELECT count(*) FILTER (event_type = 'purchase') AS success_count, count(*) FILTER (event_type = 'error') AS "
    "failure_count, CAST(0 AS BIGINT) AS skipped_count, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS total_duration "
    "FROM events",
)
def _(spark, sf):
    t = F.col("event_type")
    state = F.when(t == "purchase", "completed").when(t == "error", "failed").otherwise("converting")
    return T.run_result(table(spark, sf, "events").select(state.alias("state"), F.col("ts").cast("timestamp").alias("ts")))


# ---- checks ---------------------------------------------------------------------------------------------------------

_KNOWN = {k: "[" + ", ".join(S.quote(v) for v in dims.values(t)) + "]" for k, t in dims.VOCABULARIES.items()}
VOCAB_SQL = f"""SELECT id, kind, value FROM (
  SELECT id, 'category' AS kind, category AS value FROM (SELECT id, CASE WHEN id % 13 = 0 THEN 'World/Ethnic' ELSE category
    END AS category FROM catalog)
  UNION ALL SELECT id, 'genre', genre FROM catalog
  UNION ALL SELECT id, 'descriptor', unnest(string_split(CASE WHEN id % 17 = 0 THEN 'Clean,Loud' ELSE descriptors END, ','))
    FROM catalog)
  WHERE value <> '' AND NOT CASE kind WHEN 'category' THEN list_contains({_KNOWN['category']}, value)
    WHEN 'genre' THEN list_contains({_KNOWN['genre']}, value) ELSE list_contains({_KNOWN['descriptor']}, value) END"""


def _vocab_input(spark, sf):
    i = F.col("id")
    return catalog(spark, sf).withColumns({
        "category": F.when(i % 13 == 0, "World/Ethnic").otherwise(F.col("category")),
        "descriptors": F.when(i % 17 == 0, "Clean,Loud").otherwise(F.col("descriptors")),
    })


_VOCAB_COLUMNS = {"category": "category", "genre": "genre", "descriptor": "descriptors"}


@query("vocab_check", WITH_CATALOG + VOCAB_SQL)
def _(spark, sf):
    return Q.vocab_check(_vocab_input(spark, sf), "id", _VOCAB_COLUMNS)


@query("vocab_check_table", WITH_CATALOG + VOCAB_SQL)
def _(spark, sf):
    return Q.vocab_check(_vocab_input(spark, sf), "id", _VOCAB_COLUMNS, dims.dim_vocab(spark))


@query(
    "vocab_or_null",
    WITH_CATALOG + "SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE category END AS category, genre FROM catalog",
)
def _(spark, sf):
    known = Q.vocab_or_null(_vocab_input(spark, sf), {"category": "category", "genre": "genre"})
    return known.select("id", "category", "genre")


@query(
    "check_required_tags",
    WITH_CATALOG + """SELECT id, 'missing ' || tag AS rule FROM (
      SELECT id, category, unnest([{'tag': 'key signature', 'v': key_signature}, {'tag': 'key type', 'v': key_type},
        {'tag': 'beat count', 'v': CASE WHEN beat_count > 0 THEN 'x' ELSE '' END},
        {'tag': 'descriptors', 'v': descriptors}], recursive := true) FROM catalog)
      WHERE v = '' AND NOT (tag LIKE 'key%' AND category IN ('Drums', 'Percussion'))""",
)
def _(spark, sf):
    return Q.check_required_tags(R.tag_rows(catalog(spark, sf), "id"), "id")
