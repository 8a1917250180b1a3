"""Capability catalogue: gap classification, gates, coverage, cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import unfold
from tallymark.operators.quality import drift_diff

c = F.col

# The choice name of each gap level, and the share targets in percent.
CHOICES = {0: "Config", 1: "OCA", 2: "Minimal Custom", 3: "External"}
TARGETS = {0: (">", 60), 1: (">", 30), 2: ("<", 10), 3: ("<", 5)}


def oca_exists(parity: DataFrame, registry: DataFrame) -> DataFrame:
    """Capabilities with at least one community module that is really registered."""
    modules = parity.select("capability_id", F.explode("community_modules").alias("m"))
    return (modules.select("capability_id", "m.repo", "m.module").join(registry, ["repo", "module"], "left_semi")
            .select("capability_id").distinct())


def gap_classify(parity: DataFrame) -> DataFrame:
    """Core with settings only, else community module, else reusable custom, else external, else unresolved."""
    level = (F.when((F.size("core_modules") > 0) & c("settings_only"), 0).when(F.size("community_modules") > 0, 1)
             .when(c("reusable"), 2).when(c("erp_unsafe"), 3))
    names = F.create_map(*[F.lit(x) for kv in CHOICES.items() for x in kv])
    return (parity.withColumn("computed_gap", level)
            .withColumn("computed_choice", F.coalesce(F.try_element_at(names, level), F.lit("unresolved"))))


def parity_gates(parity: DataFrame) -> DataFrame:
    """(rule, key, detail) per broken gate, in one pass."""
    gap = c("gap_level")
    names = F.create_map(*[F.lit(x) for kv in CHOICES.items() for x in kv])

    def broken(rule: str, condition: Column, detail: Column) -> Column:
        return F.when(condition, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))

    gates = F.array_compact(F.array(
        broken("no_phantom_custom", c("smart_delta").contains("Custom") & (gap < 2), c("smart_delta")),
        broken("oca_ref_required", (gap == 1) & (F.size("community_modules") == 0), F.lit("no module")),
        broken("external_justification", (gap == 3) & F.coalesce(c("justification") == "", F.lit(True)), F.lit("no justification")),
        broken("label_mismatch", c("smart_delta") != F.try_element_at(names, gap), c("smart_delta"))))
    return (unfold(parity, [c("capability_id").alias("key")], gates, "g")
            .select("g.rule", "key", "g.detail"))


def unmapped_capabilities(leaves: DataFrame, parity: DataFrame) -> DataFrame:
    """Leaf nodes in scope that no parity row refers to."""
    refs = parity.select(F.explode("enterprise_refs").alias("id")).distinct()
    return leaves.filter(~c("out_of_scope")).join(refs, "id", "left_anti")


def capability_sources(parity: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every reference with the node it resolves to, if any."""
    refs = parity.select("capability_id", F.explode("enterprise_refs").alias("ref"))
    return refs.join(nodes.select(c("id").alias("ref"), "url"), "ref", "left")


def parity_coverage(parity: DataFrame) -> DataFrame:
    """Counts per gap level and parity percentage by domain, plus the overall row (null domain)."""
    counts = [F.count_if(c("gap_level") == g).alias(f"gap_{g}") for g in CHOICES]
    easy = F.count_if(c("gap_level") <= 1)
    return (parity.rollup("domain").agg(F.count("*").alias("total"), *counts,
                                        (easy * 100).cast("double").alias("_easy"))
            .withColumn("parity_pct", c("_easy") / c("total")).drop("_easy"))


def coverage_targets(parity: DataFrame) -> DataFrame:
    """Share of each gap level against its target; one aggregate row unpivoted."""
    counted = parity.agg(F.count("*").alias("total"), *[F.count_if(c("gap_level") == g).alias(f"g{g}") for g in CHOICES])
    entries = F.array(*[F.struct(F.lit(g).alias("gap_level"), F.lit(op).alias("op"), F.lit(t).alias("target"),
                                 c(f"g{g}").alias("n")) for g, (op, t) in TARGETS.items()])
    share = (c("n") * 100).cast("double") / F.when(c("total") > 0, c("total"))
    return (counted.select("total", F.explode(entries).alias("e")).select("total", "e.*").withColumn("share_pct", share)
            .withColumn("passed", F.when(c("op") == ">", c("share_pct") > c("target")).otherwise(c("share_pct") < c("target"))))


def coverage_mismatch(parity: DataFrame, stated: DataFrame) -> DataFrame:
    """Stated summary figures that differ from the recomputed ones: (domain, figure, stated, computed)."""
    figures = ["total", *[f"gap_{g}" for g in CHOICES]]
    computed = parity_coverage(parity).filter(c("domain").isNotNull())
    long = [d.unpivot(["domain"], figures, "figure", v) for d, v in
            ((computed.select("domain", *figures), "computed"), (stated.select("domain", *figures), "stated"))]
    return (long[0].join(long[1], ["domain", "figure"], "full")
            .filter(~c("computed").eqNullSafe(c("stated"))).select("domain", "figure", "stated", "computed"))


def parity_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Capabilities added, removed or changed between two runs."""
    kept = ["capability_id", "domain", "gap_level", "smart_delta"]
    return drift_diff(after.select(*kept), before.select(*kept), ["capability_id"]).withColumn(
        "change", F.when(c("change") == "added", "removed").when(c("change") == "removed", "added").otherwise(c("change")))


def row_digest(columns: list[str]) -> Column:
    """Hex digest of a row's values as JSON, nulls kept, so no two different rows read alike.

    Arrays are sorted first by the caller if order is free.
    """
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def determinism_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of a table: XOR and sum of 60-bit row digests, foldable on the map side."""
    part = F.conv(F.substring(row_digest(columns), 1, 15), 16, 10).cast("bigint")
    return df.select(part.alias("d")).agg(
        F.count("*").alias("n"), F.bit_xor("d").alias("xor"), F.sum(c("d").cast("decimal(38,0)")).cast("string").alias("total"))


def capability_tag(df: DataFrame, tags: str, taxonomy: dict[str, list[str]]) -> DataFrame:
    """Domain of the first taxonomy entry that shares a tag with the row."""
    domain = F.lit(None).cast("string")
    for name, words in reversed(taxonomy.items()):
        domain = F.when(F.arrays_overlap(c(tags), F.array(*[F.lit(w) for w in words])), name).otherwise(domain)
    return df.withColumn("domain", domain)


def feature_request_queue(parity: DataFrame) -> DataFrame:
    """Draft requests for gap levels 1 and 2."""
    module = F.get("community_modules", F.lit(0))["module"]
    return (parity.filter(c("gap_level").isin(1, 2)).select(
        c("capability_id").alias("id"), F.concat(F.lit("Feature Request - "), "capability_name").alias("title"),
        F.coalesce("justification", F.lit("")).alias("justification"),
        F.concat(F.lit("Extend existing "), F.coalesce(module, F.lit("new module"))).alias("proposed_solution"),
        F.array_join("enterprise_refs", ",").alias("references"), "gap_level",
        F.when(c("gap_level") == 1, "OCA").otherwise("Custom").alias("preferred_resolution"), F.lit("Draft").alias("status")))


def catalog_union(*catalogs: DataFrame) -> DataFrame:
    """Node tables of several sites in one; absent columns become null."""
    out = catalogs[0]
    for other in catalogs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
