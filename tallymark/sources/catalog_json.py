"""Catalogue documents: sites with arrays of nodes, some parts nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = """STRUCT<id: STRING, parent_id: STRING, depth: INT, title: STRING, url: STRING, breadcrumb: ARRAY<STRING>, page_type: STRING,
 tags: ARRAY<STRING>, summary: STRING, leaf_extractions: STRUCT<key_points: ARRAY<STRING>, relevant_api: ARRAY<STRING>,
 config_files: ARRAY<STRING>, implementation_notes: STRING>>"""
SITE_SCHEMA = f"site_id STRING, root_url STRING, nodes ARRAY<{NODE}>"
CATALOG_SCHEMA = f"generated_at STRING, version STRING, catalogs ARRAY<STRUCT<site_id: STRING, root_url: STRING, nodes: ARRAY<{NODE}>>>"
PARITY_SCHEMA = """parity_map ARRAY<STRUCT<capability_id: STRING, capability_name: STRING, domain: STRING, enterprise_refs: ARRAY<STRING>,
 parity_target: STRUCT<odoo_core: ARRAY<STRING>, oca_modules: ARRAY<STRUCT<repo: STRING, module: STRING>>, alt_stack: ARRAY<STRING>>,
 gap_level: INT, smart_delta: STRING, implementation_notes: ARRAY<STRING>, automation_pipeline: STRING>>,
 coverage_summary STRUCT<total_capabilities: BIGINT, gap_0_config: BIGINT, gap_1_oca: BIGINT, gap_2_custom: BIGINT,
 gap_3_external: BIGINT, parity_percentage: DOUBLE>"""


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of whole-file catalogue documents."""
    docs = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    return nodes(docs.select(F.explode("catalogs").alias("s")).select("s.*"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of site documents stored one per line, which splits over many tasks."""
    return nodes(spark.read.schema(SITE_SCHEMA).json(path))


def nodes(sites: DataFrame) -> DataFrame:
    return sites.select("site_id", F.explode("nodes").alias("n")).select("site_id", "n.*")


def read_parity(spark: SparkSession, path: str) -> DataFrame:
    """Parity rows of a catalogue document, with the target struct opened."""
    docs = spark.read.schema(PARITY_SCHEMA).option("multiLine", True).json(path)
    rows = docs.select(F.explode("parity_map").alias("p")).select("p.*")
    return rows.select(
        "capability_id", "capability_name", "domain", "enterprise_refs", F.col("parity_target.odoo_core").alias("core_modules"),
        F.col("parity_target.oca_modules").alias("community_modules"), F.col("parity_target.alt_stack").alias("alt_stack"),
        "gap_level", "smart_delta", "implementation_notes", "automation_pipeline")


def read_stated_coverage(spark: SparkSession, path: str) -> DataFrame:
    """The published totals of a catalogue document."""
    s = spark.read.schema(PARITY_SCHEMA).option("multiLine", True).json(path).select("coverage_summary.*")
    return s.toDF("total", "gap_0", "gap_1", "gap_2", "gap_3", "parity_pct")
