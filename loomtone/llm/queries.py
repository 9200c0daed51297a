"""The operators over the given tables: documents stand for loop files, ``doc_id`` for the file and ``text`` for its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtone.llm import chat, decontamination, language_model, lines, manifest, mixing, privacy, quality, repeats, rotation, simhash, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("report"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_loops(spark, sf_dir), _judged(spark, sf_dir)).withColumnRenamed("file_id", "doc_id")


def _goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("golden_id"), F.col("text").alias("report"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.golden_hits(_loops(spark, sf_dir), _goldens(spark, sf_dir))
    return hits.select(
        F.col("file_id").alias("doc_id"), "n_words", "n_hit", F.size("golden").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "golden"), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(_loops(spark, sf_dir), _judged(spark, sf_dir)).withColumnRenamed("file_id", "doc_id")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_loops(spark, sf_dir))
    return near.select(F.col("file_id").alias("doc_id"), simhash.fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the digest are of the plain identifiers; ``spans`` has the disguised ones too."""
    found = privacy.personal_data(_loops(spark, sf_dir)).withColumn("plain", F.filter("spans", lambda s: ~s["added"]))
    kinds = F.transform("plain", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("bigint") for k in privacy.KINDS]
    counts = [(F.size("plain") - n).alias(f"n_{k}") for k, n in zip(privacy.KINDS, counts)]
    return found.select(F.col("file_id").alias("doc_id"), *counts, F.sha2(privacy.span_text(F.col("plain")), 256).alias("base_sha256"),
                        privacy.span_text(F.col("spans")).alias("spans"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_reports(_loops(spark, sf_dir)).withColumnRenamed("file_id", "doc_id")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.drop_repeats(_loops(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["first"])
    return cut.select(F.col("file_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("repeated"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings stand for feature vectors, their label for the category."""
    held = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("file_id"), F.col("embedding").alias("features"), F.col("label").alias("category"))
    return vectors.link_vectors(held).withColumnRenamed("file_id", "vec_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for folders; target weights are the square roots of their sizes."""
    loops = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("folder"))
    return mixing.mix(loops, mixing.damped_weights(loops)).withColumnsRenamed({"file_id": "doc_id", "folder": "source"})


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rotation.fill_in_middle(_loops(spark, sf_dir)).withColumnRenamed("file_id", "doc_id")
    restored = rotation.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored, 256).alias("restored_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.drop_repeated_lines(_loops(spark, sf_dir)).withColumnRenamed("file_id", "doc_id")
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for folders, languages for categories; in a third of the files the copy that is checked has lower-case letters."""
    files = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("folder"), F.col("lang").alias("category"), F.col("n_chars").alias("length"),
        F.col("text").alias("report"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(F.crc32(F.col("file_id").cast("string")) % 3 == 0, F.translate("report", upper, upper.lower())).otherwise(F.col("report"))
    told = manifest.check_files(manifest.catalog_manifest(files, seen={"report": changed}))
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded_root")}
    return told.select(F.col("file_id").alias("doc_id"), *(text[c].alias(c) for c in ("leaf", "subroot", "root")),
                       F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), text["folded_root"].alias("folded_root"), "verified")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_chat_format": op4_chat_format,
    "op5_quality": op5_quality,
    "op6_personal_data": op6_personal_data,
    "op7_language_model": op7_language_model,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_repeats": op9_repeats,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {}

SQL["op2_decontamination"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, lengths WHERE len(w) >= n)
), found AS (SELECT r, k, n, item FROM places JOIN windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

SQL["op4_chat_format"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), shown AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' WHEN 'assistant' THEN '[/INST] ' WHEN 'system' THEN '[SYS] '
      ELSE '[ROLE:' || url_encode(role) || '] ' END AS tag,
    regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE:)', '\1\\\2\3', 'g') AS body
  FROM given
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(tag) + length(body) + 4) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id"""

SQL["op8_vector_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    embedding IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0 AS good FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM (SELECT * FROM v WHERE good) a JOIN (SELECT * FROM v WHERE good) b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = v.vec_id"""

SQL["op11_fill_in_middle"] = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90
      THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts"""

SQL["op12_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
every_line AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM every_line
), shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INTEGER) > 1),
told AS (SELECT k.*, first IS NOT NULL AND k.doc_id IS DISTINCT FROM first AS gone FROM keyed k LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY r"""

SQL["op13_merkle_manifest"] = """
WITH RECURSIVE texts AS (
  SELECT *, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS t,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), heads AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM texts
), leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, sha256(head || t) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END) AS lowered FROM heads
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), up AS (
  SELECT tree, CAST(0 AS BIGINT) AS lev, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, min(lev) + 1, pos // 8, (min(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, pos // 8
), subroots AS (
  SELECT tree, h, lev, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), over_ AS (
  SELECT CAST(0 AS BIGINT) AS lev, pos, n, h FROM subroots
  UNION ALL
  SELECT min(lev) + 1, pos // 8, (min(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM over_ WHERE n > 1 GROUP BY pos // 8
), runs AS (
  SELECT up.tree, up.lev, up.pos // 8 AS run, list(up.h ORDER BY up.pos) AS hs FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT s.tree, s.lev + o.lev, o.pos // 8, list(o.h ORDER BY o.pos) FROM over_ o, subroots s WHERE o.n > 1 GROUP BY ALL
), steps AS (
  SELECT r.tree, r.lev, r.run, r.hs, s.lev AS sublev, s.pos AS subpos FROM runs r JOIN subroots s USING (tree)
), crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), sums AS (
  SELECT row_number() OVER () AS r, p.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d))),
    lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]))) AS crc FROM placed p, crc
), walk AS (
  SELECT r, p.tree, CAST(0 AS BIGINT) AS lev, CASE WHEN s.lev = 0 THEN s.pos ELSE p.pos END AS pos, '' AS proof,
    CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS folded FROM sums p JOIN subroots s USING (tree)
  UNION ALL
  SELECT r, w.tree, w.lev + 1, CASE WHEN w.lev + 1 = sublev THEN subpos ELSE w.pos // 8 END,
    proof || array_to_string(hs[1:w.pos % 8] || hs[w.pos % 8 + 2:], ''),
    sha256(array_to_string(hs[1:w.pos % 8], '') || folded || array_to_string(hs[w.pos % 8 + 2:], ''))
  FROM walk w JOIN steps s ON s.tree = w.tree AND s.lev = w.lev AND s.run = w.pos // 8
), ends AS (SELECT r, arg_max(proof, lev) AS proof, arg_max(folded, lev) AS folded FROM walk GROUP BY r)
SELECT doc_id, leaf, s.h AS subroot, o.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = o.h AS verified
FROM sums JOIN ends USING (r) JOIN subroots s USING (tree), (SELECT arg_max(h, lev) AS h FROM over_) o"""
