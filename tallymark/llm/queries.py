"""The operators as queries over the given tables, with the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.decontaminate import leaks
from tallymark.llm.exact_dedup import exact_groups
from tallymark.llm.fill_middle import fill_in_middle, restored
from tallymark.llm.licenses import TEMPLATES, scan
from tallymark.llm.line_dedup import line_dedup
from tallymark.llm.minhash import near_duplicates
from tallymark.llm.packing import best_fit
from tallymark.llm.pii import pseudonymise
from tallymark.llm.quality import GOOD, GRADES, classify, graded, train
from tallymark.llm.simhash import simhash_duplicates
from tallymark.llm.substring_dedup import remove_repeats
from tallymark.llm.warc import archive_folder, read_archives, write_archives
from tallymark.llm.whitening import whiten
from tallymark.session import apply_settings


def prepared(spark: SparkSession) -> SparkSession:
    """The session settings of the library, and small Arrow batches: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return apply_settings(spark)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "text", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"))


OP1_SQL = """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, i AS pos, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS w
  FROM cut, unnest(range(0, len(l) - 2)) AS places(i)),
firsts AS (
  SELECT doc_id, pos, first(doc_id) OVER o AS first_doc, first(pos) OVER o AS first_pos
  FROM windows WINDOW o AS (PARTITION BY w ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(
    CASE WHEN first_doc = doc_id THEN greatest(pos, first_pos + 3) ELSE pos END, pos + 3)) AS pos
  FROM firsts WHERE first_doc <> doc_id OR first_pos <> pos),
lines AS (SELECT doc_id, i AS pos, l[i + 1] AS line FROM cut, unnest(range(0, len(l))) AS places(i)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT c.doc_id, CASE WHEN c.l IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(len(c.l), 0) AS n_lines, coalesce(len(c.l), 0) - coalesce(k.n, 0) AS n_removed
FROM cut c LEFT JOIN kept k USING (doc_id)
"""


def document_path() -> Column:
    """A file tree over the documents: source / 256 documents / 16 documents; the first of each level is its licence file."""
    top, sub = (F.floor(F.col("doc_id") / n).cast("string") for n in (256, 16))
    return F.when(F.col("doc_id") % 256 == 0, F.concat_ws("/", "source", F.concat(F.lit("LICENSE."), top))) \
        .when(F.col("doc_id") % 16 == 0, F.concat_ws("/", "source", F.concat(F.lit("b"), top), F.concat(F.lit("LICENSE."), sub))) \
        .when(F.col("doc_id") % 4 == 0, F.concat_ws("/", "source", F.concat(F.lit("b"), top), F.concat(F.lit("c"), sub),
                                                    F.concat(F.lit("COPYING."), F.col("doc_id").cast("string")))) \
        .otherwise(F.concat_ws("/", "source", F.concat(F.lit("b"), top), F.concat(F.lit("c"), sub),
                               F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    files = _table(spark, folder, "documents").withColumn("path", document_path()).select("doc_id", "path", "text")
    return scan(files).drop("text")


_TERMS = r"regexp_extract_all(lower({}), '[0-9]+(?:\.[0-9]+)*|[a-z]+')"
_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(k, name, body.replace("'", "''")) for k, (name, body) in enumerate(TEMPLATES))
OP2_SQL = rf"""
WITH files AS (
  SELECT doc_id, coalesce(text, '') AS text, source || CASE
    WHEN doc_id % 256 = 0 THEN '/LICENSE.' || doc_id // 256
    WHEN doc_id % 16 = 0 THEN '/b' || doc_id // 256 || '/LICENSE.' || doc_id // 16
    WHEN doc_id % 4 = 0 THEN '/b' || doc_id // 256 || '/c' || doc_id // 16 || '/COPYING.' || doc_id
    ELSE '/b' || doc_id // 256 || '/c' || doc_id // 16 || '/' || doc_id || '.txt' END AS path FROM documents),
templates AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) AS t(template, license, body)),
template_terms AS (SELECT template, license, unnest({_TERMS.format('body')}) AS term FROM templates),
known AS (SELECT DISTINCT term FROM template_terms),
held AS (SELECT term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM files) AS words
  JOIN known USING (term) GROUP BY term),
total AS (SELECT count(*) AS n FROM files),
weights AS (SELECT term, ln((total.n + 1.0) / (coalesce(held.n, 0) + 1.0)) + 1.0 AS idf FROM known LEFT JOIN held USING (term), total),
vectors AS (SELECT template, license, term, count(*) * any_value(idf) AS w FROM template_terms JOIN weights USING (term) GROUP BY ALL),
norms AS (SELECT template, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY template),
passages AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'))) AS passage
  FROM files),
counted AS (SELECT doc_id, passage, term, count(*) AS tf FROM (
  SELECT doc_id, passage, unnest({_TERMS.format('passage')}) AS term FROM passages) AS words GROUP BY ALL),
valued AS (SELECT doc_id, passage, term, tf * coalesce(idf, ln(total.n + 1.0) + 1.0) AS v FROM counted LEFT JOIN weights USING (term), total),
lengths AS (SELECT doc_id, passage, sqrt(sum(v * v)) AS length FROM valued GROUP BY doc_id, passage),
dots AS (SELECT doc_id, passage, template, license, sum(v * w) AS dot FROM valued JOIN vectors USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, template, license, round(dot / length / norm, 6) AS score
  FROM dots JOIN lengths USING (doc_id, passage) JOIN norms USING (template)),
own AS (SELECT doc_id, first(license ORDER BY score DESC, template) AS license, max(score) AS score
  FROM scored WHERE score >= 0.75 GROUP BY doc_id),
placed AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '[^/]*$', '') AS dir, o.license, o.score,
  regexp_matches(f.path, '/(LICENSE|COPYING)[.][^/]*$') AS is_licence FROM files f LEFT JOIN own o USING (doc_id)),
ranks AS (SELECT license, min(template) AS rank FROM templates GROUP BY license),
dirs AS (SELECT dir, first(license ORDER BY score DESC, rank) AS license FROM placed JOIN ranks USING (license) WHERE is_licence GROUP BY dir),
nearest AS (SELECT p.dir, max_by(d.dir, length(d.dir)) AS above, max_by(d.license, length(d.dir)) AS license
  FROM (SELECT DISTINCT dir FROM placed) p JOIN dirs d ON starts_with(p.dir, d.dir) GROUP BY p.dir)
SELECT p.doc_id, p.path, coalesce(p.license, n.license) AS license, p.score AS license_score,
  CASE WHEN p.license IS NOT NULL AND is_licence THEN 'file' WHEN p.license IS NOT NULL THEN 'header'
    WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS license_origin,
  CASE WHEN p.license IS NULL THEN n.above END AS license_dir
FROM placed p LEFT JOIN nearest n USING (dir)
"""


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return read_archives(write_archives(pages, archive_folder(spark))).drop("url", "record_id")


OP3_SQL = """
WITH texts AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
heads AS (SELECT *, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS head FROM texts)
SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < head THEN head END AS refers_to
FROM heads
"""


def op4_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    # The key of a real run comes from its owner's secret store.
    return pseudonymise(_table(spark, folder, "documents").select("doc_id", "text"), key="check-run")


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("text_hash")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = train(docs, graded(_table(spark, folder, "labels")), GRADES)
    return classify(docs.select("doc_id", "text"), model, GOOD).drop("text")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), special=True)


def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents")).drop("text_hash")


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS places(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c ON c.doc_id = d.doc_id
"""


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(_table(spark, folder, "documents"))


OP9_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first(doc_id) OVER o AS kept, sha256(norm) AS text_sha256
FROM texts WINDOW o AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""


def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents")).drop("kept")


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(_table(spark, folder, "embeddings"))


def op12_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_duplicates(_table(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_in_middle(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(), 256).alias("restored_sha256"))


OP13_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
hashed AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
  ('0x' || h[25:32])::BIGINT AS h4 FROM texts),
formed AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, left(text, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_warc": op3_warc,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op2_license_scan": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
