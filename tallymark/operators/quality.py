"""Data-quality rules and asset checks. Rules give (rule, key, detail) rows; none means pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import unfold

c = F.col

# Closed value sets.
WORKFLOW_TYPES = ("portfolio_intake", "resource_allocation", "budget_sync", "variance_alert", "invoice_generation",
                  "demand_intake", "evm_calculation", "task_sync", "capacity_sync")
CLEARANCE_EVENTS = ("created", "submitted", "department_cleared", "finance_cleared", "it_cleared", "hr_cleared",
                    "clearance_complete", "final_pay_calculated", "final_pay_approved", "final_pay_executed", "cancelled")
DEPARTMENTS = ("IT", "Finance", "HR", "Admin", "Department", "Legal", "Facilities")

# Required fields per asset type, supported versions, drift policy.
REQUIRED_FIELDS = {
    "databases": ("version", "schema_version", "database_name", "sqlalchemy_uri"),
    "datasets": ("version", "schema_version", "table_name", "database_id"),
    "charts": ("version", "schema_version", "slice_name", "viz_type", "params"),
    "dashboards": ("version", "schema_version", "dashboard_title", "position_json"),
}
SUPPORTED_VERSIONS = ("1.0",)
# The schema version text of each asset type; a deployment passes its own.
SCHEMA_VERSIONS = {"databases": "database_v1", "datasets": "dataset_v1", "charts": "chart_v1", "dashboards": "dashboard_v1"}
DRIFT_POLICY = {"dev": "warn", "staging": "fail", "prod": "fail"}


def _text_key(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(c(k).cast("string"), F.lit("")) for k in keys])


def q_domain(df: DataFrame, column: str, allowed: tuple[str, ...], keys: list[str]) -> DataFrame:
    return (df.filter(c(column).isNotNull() & ~c(column).isin(*allowed))
            .select(F.lit(f"domain:{column}").alias("rule"), _text_key(keys).alias("key"), c(column).cast("string").alias("detail")))


def q_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    # as in SQL, a key with a null in it repeats nothing
    return (df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
            .select(F.lit("unique:" + ",".join(keys)).alias("rule"), _text_key(keys).alias("key"),
                    c("n").cast("string").alias("detail")))


def q_not_null(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One pass over the rows, one output row per missing value."""
    found = F.array_compact(F.array(*[F.when(c(x).isNull(), F.lit(x)) for x in columns]))
    return (unfold(df, [_text_key(keys).alias("key")], found, "detail")
            .select(F.lit("not_null").alias("rule"), "key", "detail"))


def q_date_order(df: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    return (df.filter(c(start) > c(end))
            .select(F.lit(f"date_order:{start},{end}").alias("rule"), _text_key(keys).alias("key"),
                    F.concat_ws(" > ", c(start).cast("string"), c(end).cast("string")).alias("detail")))


def _with_errors(docs: DataFrame) -> DataFrame:
    """(asset_type, file, errors): the problems of each asset document as an array.

    A document that is not an object has that one error only; an empty version
    or schema version counts as absent, as does an unknown asset type's schema.
    """
    fields = F.from_json("doc", "map<string,string>")
    required = F.create_map(*[x for k, v in REQUIRED_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    schemas = F.create_map(*[F.lit(x) for kv in SCHEMA_VERSIONS.items() for x in kv])

    def problem(kind: str, message) -> Column:
        return F.struct(F.lit(kind).alias("error_kind"), message.alias("message"))

    df = docs.select("asset_type", "file", fields.alias("f"), F.try_parse_json("doc").alias("parsed"),
                     F.try_element_at(required, c("asset_type")).alias("required"),
                     F.try_element_at(schemas, c("asset_type")).alias("expected"))
    version, schema = F.try_element_at("f", F.lit("version")), F.try_element_at("f", F.lit("schema_version"))
    missing = F.transform(F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.map_keys("f")),
                          lambda x: problem("missing_field", F.concat(F.lit("Missing required field: "), x)))
    bad_version = F.when((version != "") & ~version.isin(*SUPPORTED_VERSIONS), problem("version", F.concat(
        F.lit("Unsupported version: "), version, F.lit(f" (supported: {', '.join(SUPPORTED_VERSIONS)})"))))
    bad_schema = F.when((schema != "") & (schema != c("expected")), problem("schema_version", F.concat(
        F.lit("Invalid schema_version: expected "), c("expected"), F.lit(", got "), schema)))
    errors = (F.when(c("parsed").isNull(), F.array(problem("syntax", F.lit("Document is not valid JSON"))))
              .when(c("f").isNull(), F.array(problem("root", F.lit("Root must be a dictionary"))))
              .otherwise(F.concat(missing, F.array_compact(F.array(bad_version, bad_schema)))))
    return df.select("asset_type", "file", errors.alias("errors"))


def bundle_validate(docs: DataFrame) -> DataFrame:
    """(asset_type, file, error_kind, message) per problem of an asset document."""
    return (unfold(_with_errors(docs), ["asset_type", "file"], c("errors"), "e")
            .select("asset_type", "file", "e.error_kind", "e.message"))


def validation_summary(docs: DataFrame) -> DataFrame:
    """Valid and total documents per asset type, in one pass."""
    n = F.size("errors")
    return _with_errors(docs).groupBy("asset_type").agg(
        F.count("*").alias("total"), F.count_if(n == 0).alias("valid"), F.sum(n).alias("n_errors"))


def drift_diff(bundle: DataFrame, runtime: DataFrame, keys: list[str]) -> DataFrame:
    """Full comparison by key and content hash: added, removed or changed."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        values = sorted(x for x in df.columns if x not in keys)
        return df.select(*keys, F.sha2(F.to_json(F.struct(*values)), 256).alias(name))

    both = hashed(bundle, "_want").join(hashed(runtime, "_have"), keys, "full")
    change = (F.when(c("_want").isNull(), "added").when(c("_have").isNull(), "removed")
              .when(c("_want") != c("_have"), "changed"))
    return both.withColumn("change", change).filter(c("change").isNotNull()).select(*keys, "change")


def drift_gate(drift: DataFrame, environment: str = "environment") -> DataFrame:
    """Per environment: pass without drift, else what its policy says (warn when it has none)."""
    policy = F.create_map(*[F.lit(x) for kv in DRIFT_POLICY.items() for x in kv])
    return (drift.groupBy(environment).agg(F.count_if(c("change").isNotNull()).alias("n_changes"))
            .withColumn("status", F.when(c("n_changes") > 0, "DRIFT_FOUND").otherwise("NO_DRIFT"))
            .withColumn("gate", F.when(c("n_changes") == 0, "pass")
                        .otherwise(F.coalesce(F.try_element_at(policy, c(environment)), F.lit("warn")))))


def expected_datasets(expected: DataFrame, registered: DataFrame, column: str = "name") -> DataFrame:
    """Expected names that are not registered."""
    return expected.join(registered.select(column).distinct(), column, "left_anti")


def template_tokenize(texts: DataFrame, column: str, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """Environment words become ``{{ ENV }}``, then the custom rules apply in order."""
    out = F.regexp_replace(c(column), r"(?i)\b(?:dev|staging|prod)\b", "{{ ENV }}")
    for pattern, token in rules:
        out = F.regexp_replace(out, pattern, token)
    return texts.withColumn(column, out)


def deploy_stats(deploys: DataFrame) -> DataFrame:
    """Deployments per environment by status, with mean duration and assets."""
    seconds = F.unix_seconds("completed_at") - F.unix_seconds("started_at")
    return deploys.groupBy("environment").agg(
        F.count("*").alias("total"),
        *[F.count_if(c("status") == s).alias(s) for s in ("success", "failed", "running")],
        (F.sum(seconds).cast("double") / F.count(seconds)).alias("avg_seconds"), F.sum("n_assets").alias("assets"))
