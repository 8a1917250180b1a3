"""Datastore references in text: detectors, composed settings, de-duplication, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.redact import (detector_for_path, parse_db_url_sql, redact_text_sql, redact_url_sql,
                                        stable_id, tags_for_path)
from tallymark.functions.scalars import ellipsis, strip_quotes, unfold
from tallymark.session import materialize
from tallymark.sources.corpus import lines

c = F.col

# Patterns of the detectors and the settings that are composed.
DB_SCHEMES = "postgres(?:ql)?|mysql|mariadb|mssql|sqlserver|redis|mongodb|clickhouse|elasticsearch|opensearch"
URL_TAIL = r"://[^\s\x27\x22)]+"
SQLITE_PATTERN = r"(?i)\bsqlite:///[^\s\x27\x22)]+|\b\w[\w./-]*\.sqlite3?\b"
HOSTED_PATTERN = r"(?i)\bhttps://[a-z0-9-]{10,}\.supabase\.co\b"
ASSIGN_PATTERN = r"^\s*(export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)\s*$"
FAMILIES = {
    "DB_*": {"host": "DB_HOST", "port": "DB_PORT", "database": "DB_NAME", "user": "DB_USER", "password": "DB_PASSWORD"},
    "PG*": {"host": "PGHOST", "port": "PGPORT", "database": "PGDATABASE", "user": "PGUSER", "password": "PGPASSWORD"},
}
# The columns of the report in their order.
COLUMNS = ("id", "datastore_type", "instance_name", "host", "port", "database", "user", "ssl_mode", "url_redacted",
           "secrets_present", "secret_fields", "file_path", "line_start", "line_end", "snippet_redacted", "detector", "tags")


# a detector hands over these, plus the URL to parse and redact where it has one
HIT = ("path", "line_no", "line", "kind", "raw", "instance_name", "host", "port", "database", "user", "own_fields")


def _finish(hits: DataFrame, driver_suffix: bool = False) -> DataFrame:
    """Detector hits to findings: parse and redact the URL, redact the line, derive the id.

    Every detector passes through here once, after their union.
    """
    is_db = c("kind").isin("url", "env_url")
    staged = hits.withColumns({
        "p": F.when(is_db, F.expr(parse_db_url_sql("raw", driver_suffix))),
        "r": F.when(is_db | (c("kind") == "sqlite_url"), F.expr(redact_url_sql("raw"))),
        "snip": F.expr(redact_text_sql(r"regexp_replace(line, r'^[\s\p{Z}]+|[\s\p{Z}]+$', '')"))})
    kind = (F.when(is_db, c("p.datastore_type")).when(c("kind").startswith("sqlite"), "sqlite")
            .when(c("kind") == "hosted", "supabase").when(c("kind") == "PG*", "postgres").otherwise("unknown"))
    none = F.array().cast("array<string>")
    own = F.when(is_db, c("r.fields")).otherwise(F.coalesce("own_fields", none))
    named = staged.select(
        "path", "line_no", "snip", kind.alias("datastore_type"), "instance_name",
        *[F.when(is_db, c(f"p.{x}")).otherwise(c(x)).alias(x) for x in ("host", "port", "database", "user")],
        c("p.ssl_mode").alias("ssl_mode"),
        F.coalesce(c("r.text"), F.when(c("kind") == "hosted", c("raw"))).alias("url_redacted"),
        F.array_sort(F.array_distinct(F.concat(own, c("snip.fields")))).alias("secret_fields"))
    return named.select(
        stable_id(*[c(x) for x in ("datastore_type", "host", "port", "database", "user", "url_redacted", "instance_name")]).alias("id"),
        "datastore_type", "instance_name", "host", "port", "database", "user", "ssl_mode", "url_redacted",
        (F.size("secret_fields") > 0).alias("secrets_present"), "secret_fields", c("path").alias("file_path"),
        c("line_no").alias("line_start"), c("line_no").alias("line_end"), ellipsis(c("snip.text")).alias("snippet_redacted"),
        detector_for_path(c("path")).alias("detector"), tags_for_path(c("path")).alias("tags"))


def _mentions_url(text: str):
    """Cheap byte search that every line with a URL or an SQLite path passes."""
    return c(text).contains("://") | F.lower(text).contains(".sqlite")


def _mentions_setting(text: str):
    return c(text).contains("DATABASE_URL") | c(text).contains("DB_") | c(text).contains("PG")


def line_hits(rows: DataFrame, driver_suffix: bool = False) -> DataFrame:
    """Connection URLs, SQLite paths and the first hosted-project URL of every line, in one pass.

    ``driver_suffix`` also accepts ``scheme+driver://``.
    """
    url = rf"(?i)\b(?:{DB_SCHEMES}){r'(?:[+][a-z0-9_]+)?' if driver_suffix else ''}{URL_TAIL}"
    found = (f"concat(transform(regexp_extract_all(line, r'{url}', 0), x -> named_struct('kind', 'url', 'raw', x)),"
             f" transform(regexp_extract_all(line, r'{SQLITE_PATTERN}', 0), x -> named_struct('kind',"
             " CASE WHEN startswith(lower(x), 'sqlite:///') THEN 'sqlite_url' ELSE 'sqlite' END, 'raw', x)),"
             f" transform(slice(regexp_extract_all(line, r'{HOSTED_PATTERN}', 0), 1, 1),"
             " x -> named_struct('kind', 'hosted', 'raw', x)))")
    # Fixed values in the text below: the names that findings are reported under.
    hits = (unfold(rows.filter(_mentions_url("line")), ["path", "line_no", "line"], F.expr(found), "h").select("path", "line_no", "line", "h.*"))
    return hits.selectExpr(
        "path", "line_no", "line", "kind", "raw",
        "CASE kind WHEN 'hosted' THEN 'SUPABASE_URL' WHEN 'url' THEN CASE WHEN contains(upper(line), 'DATABASE_URL') THEN 'DATABASE_URL'"
        " WHEN contains(upper(line), 'SUPABASE') THEN 'SUPABASE' WHEN contains(upper(line), 'REDIS') THEN 'REDIS' END END AS instance_name",
        "CASE kind WHEN 'hosted' THEN replace(raw, 'https://', '') END AS host", "CAST(NULL AS STRING) AS port",
        "CASE kind WHEN 'sqlite' THEN raw WHEN 'sqlite_url' THEN regexp_extract(raw, '^[^:]+://([^?#]*)', 1) END AS database",
        "CAST(NULL AS STRING) AS user", "CAST(NULL AS ARRAY<STRING>) AS own_fields")


def setting_hits(rows: DataFrame) -> DataFrame:
    """KEY=value settings folded per file: the last DATABASE_URL, and one hit per DB_* / PG* family.

    Per setting the last assignment wins; a family points at the earliest line
    among those. One aggregate per file, folded on the map side.
    """
    known = ["DATABASE_URL", *[k for roles in FAMILIES.values() for k in roles.values()]]
    entry = F.struct("line_no", "value", "line")
    folded = (rows.filter(c("line").contains("=")).withColumn("key", F.regexp_extract("line", ASSIGN_PATTERN, 2))
              .filter(c("key").isin(*known)).withColumn("value", strip_quotes(F.regexp_extract("line", ASSIGN_PATTERN, 3)))
              .groupBy("path").agg(*[F.max(F.when(c("key") == k, entry)).alias(k) for k in known]))
    url = ("CASE WHEN DATABASE_URL.value <> '' THEN named_struct('line_no', DATABASE_URL.line_no, 'line', DATABASE_URL.line,"
           " 'kind', 'env_url', 'raw', DATABASE_URL.value, 'instance_name', 'DATABASE_URL', 'host', CAST(NULL AS STRING),"
           " 'port', CAST(NULL AS STRING), 'database', CAST(NULL AS STRING), 'user', CAST(NULL AS STRING),"
           " 'own_fields', CAST(NULL AS ARRAY<STRING>)) END")
    hits = [url]
    for family, roles in FAMILIES.items():
        keys = list(roles.values())
        present = " OR ".join(f"{k} IS NOT NULL" for k in keys)
        places = ", ".join(f"CASE WHEN {k} IS NOT NULL THEN named_struct('n', {k}.line_no, 't', {k}.line) END" for k in keys)
        spot = f"array_min(array_compact(array({places})))"
        fields = (f"CASE WHEN {roles['password']}.value <> '' THEN array('{roles['password']}') END")
        values = ", ".join(f"'{role}', {roles[role]}.value" for role in ("host", "port", "database", "user"))
        hits.append(f"CASE WHEN {present} THEN named_struct('line_no', {spot}.n, 'line', {spot}.t, 'kind', '{family}',"
                    f" 'raw', CAST(NULL AS STRING), 'instance_name', '{family}', {values}, 'own_fields', {fields}) END")
    return unfold(folded, ["path"], F.expr(f"array_compact(array({', '.join(hits)}))"), "h").select("path", "h.*")


def env_compose(corpus: DataFrame) -> DataFrame:
    """Only the composed DB_* and PG* findings."""
    rows = lines(corpus.filter(_mentions_setting("text"))).filter(_mentions_setting("line"))
    return _finish(setting_hits(rows).filter(c("kind").isin(*FAMILIES)).select(*HIT))


def datastore_findings(corpus: DataFrame, driver_suffix: bool = False) -> DataFrame:
    """All detectors over the lines of a corpus (path, text), not yet de-duplicated."""
    # files, then lines, without a trace of a reference stop at a byte search; the corpus is read once
    rows = lines(corpus.filter(_mentions_url("text") | _mentions_setting("text")))
    rows = materialize(rows.filter(_mentions_url("line") | _mentions_setting("line")), "mentions")
    settings = rows.filter(_mentions_setting("line"))
    return _finish(line_hits(rows, driver_suffix).select(*HIT).unionByName(setting_hits(settings).select(*HIT)), driver_suffix)


def dedupe_earliest(findings: DataFrame) -> DataFrame:
    """One finding per id: the one with the smallest (path, line)."""
    values = [x for x in COLUMNS if x not in ("id", "file_path", "line_start")]
    first = F.min(F.struct("file_path", "line_start", *values)).alias("f")
    return findings.groupBy("id").agg(first).select("id", "f.*").select(*COLUMNS)


def findings_sort(findings: DataFrame) -> DataFrame:
    blank = [F.coalesce(x, F.lit("")) for x in ("datastore_type", "host", "database", "file_path")]
    return findings.orderBy(*blank, F.coalesce("line_start", F.lit(0)))


def findings_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("datastore_type").agg(
        F.count("*").alias("n"), F.count_if(c("secrets_present")).alias("with_secrets"))


def redact_corpus(texts: DataFrame, key: str, text: str = "text", mode: str = "reference") -> DataFrame:
    """Whole texts with secrets masked, the masked fields, and whether anything changed."""
    return (texts.select(key, F.expr(redact_text_sql(text, mode)).alias("r"))
            .select(key, c("r.text").alias("text"), c("r.fields").alias("secret_fields"), (F.size("r.fields") > 0).alias("changed")))


def flat(findings: DataFrame) -> DataFrame:
    """The 16 report columns, arrays joined by commas."""
    return findings.select(
        "id", "datastore_type", "instance_name", "host", "port", "database", "user", "ssl_mode", "url_redacted", "secrets_present",
        F.array_join("secret_fields", ",").alias("secret_fields"), "file_path", "line_start", "line_end", "detector",
        F.array_join("tags", ",").alias("tags"))


def findings_sink(findings: DataFrame, folder: str) -> dict[str, str]:
    """Write the full findings as JSON, the flat ones as CSV and the summary; gives the three paths.

    The scan runs once: CSV and summary are made from the stored JSON.
    """
    paths = {name: f"{folder}/{name}" for name in ("json", "csv", "summary")}
    findings.write.mode("overwrite").json(paths["json"])
    stored = findings.sparkSession.read.schema(findings.schema).json(paths["json"])
    flat(stored).write.mode("overwrite").option("header", True).csv(paths["csv"])
    findings_by_type(stored).orderBy("datastore_type").write.mode("overwrite").json(paths["summary"])
    return paths
