from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import textscan as ts
from tallymark.registry.core import query
from tallymark.session import work_dir
from tallymark.sources.corpus import corpus_scan, lines

BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
DETECTOR = """CASE WHEN doc_id % 7 = 0 THEN 'env_file' WHEN path LIKE '%/.github/workflows/%' THEN 'ci' WHEN path LIKE '%/k8s/%' THEN 'k8s_manifest'
 WHEN path LIKE '%.tf' THEN 'terraform' WHEN path LIKE '%.md' THEN 'docs' WHEN path LIKE '%.prisma' THEN 'prisma_schema'
 WHEN path LIKE '%.toml' THEN 'toml_config' WHEN path LIKE '%.yaml' THEN 'config' ELSE 'code_or_text' END"""
TAGS = "CASE doc_id % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'ci' WHEN 2 THEN 'staging' ELSE '' END"
# what each appended configuration block must give, stated field by field
RAW_CTE = f"""src AS (SELECT doc_id, source, lang, path, len(REGEXP_SPLIT_TO_ARRAY(body, '{BREAK}')) + 1 AS ln,
 {DETECTOR} AS detector, {TAGS} AS tags FROM corpus),
raw AS (SELECT src.*, 'postgres' AS datastore_type, 'DATABASE_URL' AS instance_name, 'db-' || lang || '.example.com' AS host, '5432' AS port,
   'app_' || source AS database, 'svc_' || source AS "user", 'require' AS ssl_mode, 'postgresql://svc_' || source || ':***REDACTED***@DB-'
   || lang || '.example.com:5432/app_' || source || '?sslmode=require' AS url_redacted, 'url_password' AS secret_fields, k AS copy_no
   FROM src, (VALUES (1), (2)) v(k) WHERE doc_id % 6 = 0
 UNION ALL SELECT *, 'redis', 'REDIS', 'cache-' || lang || '.example.com', '6379', '0', NULL, NULL, 'redis://cache-' || lang
   || '.example.com:6379/0?token=***REDACTED***', 'query:token,token', 1 FROM src WHERE doc_id % 6 = 1
 UNION ALL SELECT *, 'unknown', 'DB_*', 'host-' || lang || '.example.com', '3306', 'shop_' || source, NULL, NULL, NULL, 'DB_PASSWORD', 1
   FROM src WHERE doc_id % 6 = 2
 UNION ALL SELECT *, 'postgres', 'PG*', 'pg-' || lang || '.example.com', NULL, 'dw_' || source, 'reader', NULL, NULL, '', 1
   FROM src WHERE doc_id % 6 = 3
 UNION ALL SELECT *, 'sqlite', NULL, NULL, NULL, 'data/' || source || '.sqlite3', NULL, NULL, NULL, '', 1 FROM src WHERE doc_id % 6 = 4
 UNION ALL SELECT *, 'supabase', 'SUPABASE_URL', 'abcdefghij' || lang || '.supabase.co', NULL, NULL, NULL, NULL,
   'https://abcdefghij' || lang || '.supabase.co', '', 1 FROM src WHERE doc_id % 6 = 5),
found AS (SELECT SUBSTR(SHA256(LOWER(CONCAT_WS('|', datastore_type, COALESCE(host, ''), COALESCE(port, ''), COALESCE(database, ''),
 COALESCE("user", ''), COALESCE(url_redacted, ''), COALESCE(instance_name, '')))), 1, 16) AS id, *, path AS file_path, ln AS line_start,
 ln AS line_end, secret_fields <> '' AS secrets_present FROM raw),
first_found AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY file_path, line_start) AS rn FROM found) z WHERE rn = 1)"""
SPEC = ("id:s datastore_type:s instance_name:s host:s port:s database:s user:s ssl_mode:s url_redacted:s secrets_present:b"
        " secret_fields:s file_path:s line_start:l line_end:l detector:s tags:s")


def _corpus(t):
    return t.view("corpus")


def _all(t):
    return ts.datastore_findings(_corpus(t))


@query("datastore_findings", SPEC, "SELECT * FROM found", "corpus", RAW_CTE)
def datastore_findings(t):
    return ts.flat(_all(t))


@query("findings_union", "detector:s instance_name:s datastore_type:s n:l",
       "SELECT detector, instance_name, datastore_type, COUNT(*) AS n FROM found GROUP BY 1, 2, 3", "corpus", RAW_CTE)
def findings_union(t):
    return _all(t).groupBy("detector", "instance_name", "datastore_type").agg(F.count("*").alias("n"))


@query("dedupe_earliest", SPEC, "SELECT * FROM first_found", "corpus", RAW_CTE)
def dedupe_earliest(t):
    return ts.flat(ts.dedupe_earliest(_all(t)))


@query("findings_sort", "datastore_type:s host:s database:s file_path:s line_start:l",
       "SELECT * FROM first_found ORDER BY COALESCE(datastore_type, ''), COALESCE(host, ''), COALESCE(database, ''), file_path, line_start",
       "corpus", RAW_CTE)
def findings_sort(t):
    return ts.findings_sort(ts.dedupe_earliest(_all(t)))


BY_TYPE = "SELECT datastore_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE secrets_present) AS with_secrets FROM first_found GROUP BY 1"


@query("findings_by_type", "datastore_type:s n:l with_secrets:l", BY_TYPE, "corpus", RAW_CTE)
def findings_by_type(t):
    return ts.findings_by_type(ts.dedupe_earliest(_all(t)))


@query("findings_sink", SPEC, "SELECT * FROM first_found", "corpus", RAW_CTE)
def findings_sink(t):
    paths = ts.findings_sink(ts.dedupe_earliest(_all(t)), work_dir(t.spark, "report"))
    df = t.spark.read.option("header", True).option("nullValue", "").option("emptyValue", "").csv(paths["csv"])
    return df.fillna("", ["secret_fields", "tags"])


@query("env_compose", "instance_name:s file_path:s host:s port:s database:s user:s line_start:l secrets_present:b",
       "SELECT * FROM found WHERE instance_name IN ('DB_*', 'PG*')", "corpus", RAW_CTE)
def env_compose(t):
    return ts.env_compose(_corpus(t))


@query("redact_corpus", "doc_id:l digest:s secret_fields:s changed:b",
       r"""SELECT doc_id, SHA256(REGEXP_REPLACE(text, pat, '\1=***REDACTED***', 'gi')) AS digest,
 ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(REGEXP_EXTRACT_ALL(text, '(?i)' || pat, 1))), ',') AS secret_fields,
 REGEXP_MATCHES(text, pat, 'i') AS changed FROM documents,
 (SELECT '\b(password|passwd|pwd|token|api[_-]?key|service[_-]?role|secret|private[_-]?key)\b\s*[:=]\s*(?:"[^"]*"|''[^'']*''|[^\s''",)]+)' AS pat) p""")
def redact_corpus(t):
    df = ts.redact_corpus(t.documents.select("doc_id", "text"), "doc_id", mode="quoted")
    return df.select("doc_id", F.sha2("text", 256).alias("digest"), F.array_join("secret_fields", ",").alias("secret_fields"), "changed")


WORDS = r"\b(password|passwd|pwd|token|api[_-]?key|service[_-]?role|secret|private[_-]?key)\b\s*[:=]\s*"
PLAIN_VALUE, QUOTED_VALUE = r"""[^\s'",)]+""", r"""(?:"[^"]*"|'[^']*'|[^\s'",)]+)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def redacted_sql(text: str, value: str) -> str:
    """Check SQL: user passwords and token parameters of URLs are masked, then key = value secrets."""
    url = rf"REGEXP_REPLACE({text}, '([a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@''" + r'"' + rf")]*):[^\s@/''" + r'"' + r")]*@', '\1:***REDACTED***@', 'g')"
    query = rf"REGEXP_REPLACE({url}, '(://[^\s''" + r'"' + r")]*[?&]token)=[^\s&''" + r'"' + r")]+', '\1=***REDACTED***', 'g')"
    return rf"REGEXP_REPLACE({query}, {_quoted(WORDS + value)}, '\1=***REDACTED***', 'gi')"


@query("redact_urls", "doc_id:l digest:s secret_fields:s changed:b",
       rf"""SELECT doc_id, SHA256({redacted_sql('text', QUOTED_VALUE)}) AS digest, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(fields)), ',') AS secret_fields,
 len(fields) > 0 AS changed FROM (SELECT doc_id, text, REGEXP_EXTRACT_ALL(text, {_quoted('(?i)' + WORDS + QUOTED_VALUE)}, 1)
  || CASE WHEN REGEXP_MATCHES(text, '://[^\s/@]*:[^\s/@]*@') THEN ['url_password'] ELSE [] END
  || CASE WHEN REGEXP_MATCHES(text, '://\S*[?&]token=') THEN ['query:token'] ELSE [] END AS fields FROM corpus) z""", "corpus")
def redact_urls(t):
    """Whole files, whose connection strings carry passwords and tokens."""
    df = ts.redact_corpus(_corpus(t).select("doc_id", "text"), "doc_id", mode="quoted")
    return df.select("doc_id", F.sha2("text", 256).alias("digest"), F.array_join("secret_fields", ",").alias("secret_fields"), "changed")


@query("findings_snippets", "id:s file_path:s line_start:l snippet_redacted:s",
       rf"""SELECT id, file_path, line_start, CASE WHEN length(snip) > 240 THEN left(snip, 240) || '…' ELSE snip END AS snippet_redacted FROM
 (SELECT f.id, f.file_path, f.line_start, {redacted_sql("TRIM(REGEXP_SPLIT_TO_ARRAY(c.text, '" + BREAK + "')[f.line_start])", PLAIN_VALUE)} AS snip
  FROM first_found f JOIN corpus c ON c.path = f.file_path) z""", "corpus", RAW_CTE)
def findings_snippets(t):
    """The line of every finding as the JSON report stores it: read from the file again, masked and cut."""
    findings = ts.dedupe_earliest(_all(t))
    paths = ts.findings_sink(findings, work_dir(t.spark, "report"))
    return t.spark.read.schema(findings.schema).json(paths["json"])


@query("datastore_mentions", "path:s line_no:l kind:s raw:s",
       rf"""SELECT path, line_no, kind, raw FROM (SELECT path, line_no, UNNEST(
  list_transform(REGEXP_EXTRACT_ALL(line, '(?i)\b(?:{ts.DB_SCHEMES})://[^\s''")]+'), lambda x: {{'kind': 'url', 'raw': x}})
  || list_transform(REGEXP_EXTRACT_ALL(line, '(?i)\bsqlite:///[^\s''")]+|\b\w[\w./-]*\.sqlite3?\b'),
    lambda x: {{'kind': CASE WHEN LOWER(x) LIKE 'sqlite:///%' THEN 'sqlite_url' ELSE 'sqlite' END, 'raw': x}})
  || list_transform(REGEXP_EXTRACT_ALL(line, '(?i)\bhttps://[a-z0-9-]{{10,}}\.supabase\.co\b')[1:1], lambda x: {{'kind': 'hosted', 'raw': x}}),
  recursive := true) FROM
 (SELECT path, UNNEST(l) AS line, UNNEST(RANGE(1, len(l) + 1)) AS line_no FROM
  (SELECT path, REGEXP_SPLIT_TO_ARRAY(text, '{BREAK}') AS l FROM corpus) split) numbered) hits""", "corpus")
def datastore_mentions(t):
    """URLs, SQLite files and hosted projects in every line of the documents' own text and what is appended."""
    return ts.line_hits(lines(_corpus(t).select("path", "text")))


@query("corpus_scan", "path:s digest:s",
       r"""SELECT path, SHA256(text) AS digest FROM (SELECT path, text, encode(text) AS b FROM corpus) z
 WHERE NOT contains(text, CHR(0)) AND
 len(list_filter(regexp_extract_all(hex(b), '..'), lambda h: (h >= '09' AND h <= '0D') OR (h >= '20' AND h <= '7E')))
 >= 0.60 * octet_length(b)""", "corpus")
def scan_corpus(t):
    files = t.view("corpus").select("path", F.encode("text", "UTF-8").alias("content"))
    files = files.withColumn("length", F.octet_length("content"))
    df = corpus_scan(files)
    return df.select("path", F.sha2("text", 256).alias("digest"))
