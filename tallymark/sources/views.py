"""Derived input views over the base tables.

Line items are folded to one row per order before they meet another table, so
an order, customer or user holding a large share of the rows shrinks on the map
side and never travels as a group. Dimension joins are left joins on a unique
key, so a view may leave out the ones whose columns are not asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.sources import payloads
from tallymark.sources.tables import Tables

# Widths are larger than the declared NUMERIC(12,2)/(6,2)/(5,2): same rounding,
# but a hot key with a large total does not abort the job.
MONEY = "decimal(20,2)"
RATIO = "decimal(20,3)"
PERCENT = "decimal(20,2)"



def cents(col: str):
    """A stored two-place amount as whole hundredths.

    Whole-number arithmetic on the scanned rows is several times faster than
    decimals made from doubles, and just as exact.
    """
    return F.rint(F.col(col) * 100).cast("bigint")


def money(col: str):
    """A stored two-place amount as an exact decimal."""
    return cents(col).cast("decimal(12,0)") * F.lit("0.01").cast("decimal(2,2)")


def _ten_thousandths(units):
    return units.cast("decimal(13,0)") * F.lit("0.0001").cast("decimal(4,4)")


def _month(col: str):
    return F.trunc(F.col(col).cast("date"), "MM")


def fact_sales(t: Tables, columns: str = "") -> DataFrame:
    """Sales lines with the dimension columns named in ``columns`` (all when empty).

    ``order_date`` keeps the stored type, so a date filter reaches the scan.
    """
    every = ("order_id order_date customer_id segment nation region brand category product_name "
             "channel quantity revenue profit")
    want = (columns or every).split()
    customer_cols = {"segment", "nation", "region"}
    df = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), "l_partkey",
        F.col("l_returnflag").alias("channel"),
        money("l_quantity").cast("decimal(12,2)").alias("quantity"),
        _ten_thousandths(cents("l_extendedprice") * (100 - cents("l_discount"))).alias("revenue"),
        _ten_thousandths(cents("l_extendedprice") * (30 - cents("l_discount"))).alias("profit"))
    # the chain of order dimensions is joined on its own first, so the sales
    # lines are shuffled once, by order, however long the chain is
    if {"order_date", "customer_id", *customer_cols} & set(want):
        orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_date"))
        if customer_cols & set(want):
            customer = t.customer.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
            if {"nation", "region"} & set(want):
                nation = t.nation.select("n_nationkey", "n_regionkey", F.col("n_name").alias("nation"))
                customer = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
            if "region" in want:
                region = t.region.select("r_regionkey", F.col("r_name").alias("region"))
                customer = customer.join(region, customer.n_regionkey == region.r_regionkey, "left")
            orders = orders.join(customer, orders.customer_id == customer.c_custkey, "left")
        df = df.join(orders, df.order_id == orders.o_orderkey, "left")
    if {"brand", "category", "product_name"} & set(want):
        part = t.part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
                             F.col("p_name").alias("product_name"))
        df = df.join(part, df.l_partkey == part.p_partkey, "left")
    return df.select(*want)


def order_sums(t: Tables) -> DataFrame:
    """Per order: price, price x discount and price x tax, in whole units.

    Every monthly amount below is a linear mix of these three, so all project
    views share one fold (and one shuffle) of the line items.
    """
    price = cents("l_extendedprice")

    def total(units):
        return F.sum(units.cast("decimal(18,0)"))

    return t.lineitem.groupBy("l_orderkey").agg(
        total(price).alias("price"), total(price * cents("l_discount")).alias("discounted"),
        total(price * cents("l_tax")).alias("taxed"))


def _by_project_month(t: Tables, *extra) -> DataFrame:
    monthly = (t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", _month("o_orderdate").alias("month"))
               .join(order_sums(t), F.col("o_orderkey") == F.col("l_orderkey"))
               .groupBy("o_custkey", "month")
               .agg(*[F.sum(s).cast("decimal(30,0)").alias(s) for s in ("price", "discounted", "taxed")], *extra))
    customer = t.customer.select("c_custkey", "c_nationkey", "c_name")
    return monthly.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def _amount(price: int, discount: int = 0, tax: int = 0, of: str = "price"):
    """sum(price * (p + d*discount + x*tax)) from the whole-unit sums."""
    units = 100 * price * F.col(of) + discount * F.col("discounted") + tax * F.col("taxed")
    return (units.cast("decimal(34,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast(MONEY)


def evm(t: Tables) -> DataFrame:
    return _by_project_month(t).select(
        F.col("c_nationkey").alias("company_id"), F.col("o_custkey").alias("project_id"),
        F.col("c_name").alias("project_name"), F.col("month").alias("calculation_date"),
        _amount(2).alias("bac"), _amount(1, discount=-1).alias("pv"), _amount(1, tax=-2).alias("ev"),
        F.when(F.col("o_custkey") % 40 == 0, F.lit(0).cast(MONEY)).otherwise(_amount(1, discount=1, tax=-2)).alias("ac"))


def budget(t: Tables) -> DataFrame:
    """Every month with orders; what is still pending (status P) is spent without a plan, and a month of only that has a null plan."""
    planned = F.sum(F.when(F.col("o_orderstatus") != "P", F.col("price"))).cast("decimal(30,0)")
    df = _by_project_month(t, F.min("o_orderkey").alias("first_order"), planned.alias("planned"))
    return df.select(
        F.col("c_nationkey").alias("company_id"), F.col("o_custkey").alias("project_id"),
        F.col("c_name").alias("project_name"), F.col("month").alias("snapshot_date"),
        F.when(F.col("o_custkey") % 30 == 0, F.lit(0).cast(MONEY)).otherwise(_amount(1, of="planned")).alias("planned_amount"),
        _amount(1, discount=-4, tax=5).alias("actual_amount"), "first_order")


def capacity(t: Tables) -> DataFrame:
    hours = cents("value").cast("decimal(12,0)") * F.lit("0.001").cast("decimal(3,3)")
    user = F.col("user_id")
    name = F.when(user % 17 != 0, F.concat(F.lit("user_"), (user % 100).cast("string")))
    return (t.events.groupBy("user_id", F.trunc(F.col("ts").cast("date"), "WEEK").alias("week_of"))
            .agg(F.sum(hours).alias("allocated"),
                 F.sum(F.when(F.col("event_type") == "purchase", hours).otherwise(F.lit(0))).alias("billable"))
            .select((user % 5).alias("company_id"), user.alias("resource_id"), name.alias("resource_name"),
                    F.when(user % 19 != 0, F.concat(name, F.lit("@example.com"))).alias("resource_email"),
                    "week_of", F.when(user % 25 == 0, 0).otherwise(40).cast(MONEY).alias("available_hours"),
                    F.col("allocated").cast(MONEY).alias("allocated_hours"),
                    F.col("billable").cast(MONEY).alias("billable_hours")))


def sla(t: Tables) -> DataFrame:
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("shipped"))
    key = F.col("o_orderkey")
    return (t.orders.join(shipped, key == F.col("l_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_nationkey").alias("company_id"), key.alias("clearance_request_id"),
                    F.col("o_custkey").alias("employee_id"), F.col("c_name").alias("employee_name"),
                    F.col("c_mktsegment").alias("department"),
                    F.col("o_orderdate").cast("date").alias("last_working_date"),
                    F.when(key % 11 != 0, F.col("shipped")).alias("clearance_date"),
                    F.when(F.col("o_orderstatus") != "O", F.date_add("shipped", (key % 13).cast("int")))
                    .alias("final_pay_executed_date")))


def checklist(t: Tables) -> DataFrame:
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("c_nationkey").alias("company_id"), F.col("l_orderkey").alias("clearance_request_id"),
                    F.expr("CASE l_returnflag WHEN 'A' THEN 'IT' WHEN 'N' THEN 'Finance' ELSE 'HR' END")
                    .alias("department"), F.col("l_linenumber").alias("checklist_item"),
                    (F.col("l_linestatus") == "F").alias("is_cleared")))


def timesheet(t: Tables) -> DataFrame:
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                    F.col("o_custkey").alias("project_id"), F.col("l_suppkey").alias("employee_id"),
                    F.col("s_name").alias("employee_name"),
                    F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("@example.com")).alias("employee_email"),
                    money("l_quantity").alias("unit_amount"),
                    F.col("l_shipdate").alias("work_date"),
                    (F.col("l_returnflag") == "A").alias("is_invoiced")))


def rates(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("decimal(10,2)")).alias("hourly_rate"))


def billing_config(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("project_id"), F.when(key % 4 == 0, "fixed").otherwise("tm").alias("billing_type"),
        ((key % 3) * 75).cast("decimal(10,2)").alias("base_rate"),
        ((key % 5) * 5).cast("decimal(5,2)").alias("markup_percentage"))


def portfolios(t: Tables) -> DataFrame:
    return t.supplier.selectExpr(
        "s_suppkey AS portfolio_id", "s_name AS name", "s_suppkey % 4 AS priority",
        "(s_suppkey * 37) % 101 AS strategic_alignment", "(s_suppkey * 53) % 101 AS business_value",
        "(s_suppkey * 71) % 101 AS risk_level", "(s_suppkey * 89) % 101 AS resource_availability",
        "CAST(40000 + 20000 * (s_suppkey % 5) AS DECIMAL(20,2)) AS budget_total",
        "CASE s_suppkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' ELSE 'on_hold' END AS state",
        "CASE s_suppkey % 7 WHEN 0 THEN 'On Hold' WHEN 1 THEN 'Approved' WHEN 2 THEN 'Parked' WHEN 3 THEN ''"
        " WHEN 4 THEN NULL WHEN 5 THEN 'Closed' ELSE 'Submitted' END AS status_label",
        "CASE WHEN s_suppkey % 3 <> 0 THEN CONCAT('acc_', s_suppkey) END AS account_id",
        "date_add(DATE'2024-01-01', CAST(s_suppkey % 60 AS INT)) AS date_start",
        "CASE WHEN s_suppkey % 9 <> 0 THEN date_add(DATE'2024-01-01', CAST(s_suppkey % 45 AS INT)) END AS date_end")


def projects(t: Tables) -> DataFrame:
    return t.customer.selectExpr(
        "c_custkey AS project_id", "c_custkey DIV 15 AS portfolio_id", "c_name AS name",
        "CAST(ABS(CAST(c_acctbal AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS budget_total",
        "CASE WHEN c_custkey % 3 <> 0 THEN CONCAT('acc_p', c_custkey) END AS account_id")


def ledger(t: Tables) -> DataFrame:
    price = money("l_extendedprice")
    amount = F.when(F.col("l_linestatus") == "F", -price).otherwise(price)
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("project_id"),
                    (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), amount.alias("amount")))


def assets_bundle(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        f"{payloads.ASSET_TYPE} AS asset_type", "CONCAT(CASE p_brand WHEN 'Brand#7' THEN 'old_' ELSE 'asset_' END, p_partkey) AS name",
        f"{payloads.ASSET_CONTENT.format(size='p_size')} AS content")


def assets_runtime(t: Tables) -> DataFrame:
    size = "CASE WHEN p_size = 10 THEN p_size + 1 ELSE p_size END"
    return t.part.selectExpr(
        f"{payloads.ASSET_TYPE} AS asset_type", "CONCAT(CASE p_brand WHEN 'Brand#13' THEN 'new_' ELSE 'asset_' END, p_partkey) AS name",
        f"{payloads.ASSET_CONTENT.format(size=size)} AS content")


def bundle_docs(t: Tables) -> DataFrame:
    return t.part.selectExpr(f"{payloads.BUNDLE_TYPE} AS asset_type", "CONCAT('f', p_partkey, '.yaml') AS file",
                             f"{payloads.BUNDLE_DOC} AS doc")


def asset_texts(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "CONCAT('asset_', p_partkey) AS name",
        "CONCAT('host: db-', CASE p_partkey % 3 WHEN 0 THEN 'Dev' WHEN 1 THEN 'staging' ELSE 'PROD' END,"
        " '.example.com schema: \"public\" db: analytics_dev note: developer ', p_name) AS body")


def deploys(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS deployment_id",
        "CASE o_orderkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'staging' ELSE 'prod' END AS environment",
        "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS status",
        "CAST(o_orderdate AS TIMESTAMP) AS started_at",
        "CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, 30 + o_orderkey % 600)"
        " END AS completed_at",
        "1 + o_orderkey % 35 AS n_assets")


def skills(t: Tables) -> DataFrame:
    # parts first: a filter on the skill then cuts the lines before they meet the orders
    return (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("resource_id"), F.col("p_brand").alias("skill")))


def tree(t: Tables) -> DataFrame:
    regions = t.region.selectExpr("CONCAT('R', r_regionkey) AS id", "CAST(NULL AS STRING) AS parent_id", "r_name AS label")
    nations = t.nation.selectExpr("CONCAT('N', n_nationkey)", "CONCAT('R', n_regionkey)", "n_name")
    customers = t.customer.selectExpr("CONCAT('C', c_custkey)", "CONCAT('N', c_nationkey)", "c_name")
    return regions.union(nations).union(customers)


def names(t: Tables) -> DataFrame:
    per_part = t.lineitem.groupBy("l_partkey", F.col("l_linestatus").alias("state"), F.year("l_shipdate").alias("year"),
                                  F.col("l_returnflag").alias("gender")).agg(F.count("*").alias("n"))
    return (per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("state", "year", "gender", F.col("p_name").alias("name")).agg(F.sum("n").alias("num")))


def intake(t: Tables) -> DataFrame:
    return t.customer.selectExpr(f"{payloads.INTAKE_PAYLOAD} AS payload")


def ocr(t: Tables) -> DataFrame:
    return t.orders.selectExpr("o_orderkey AS doc_id", f"{payloads.OCR_PAYLOAD} AS payload")


def invoice_events(t: Tables) -> DataFrame:
    """Nested invoice events, one per order."""
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select(F.col("o_orderkey").alias("id"), F.struct(F.col("c_name").alias("name")).alias("partner_id"),
                    F.col("o_totalprice").cast("decimal(12,2)").alias("amount_total"),
                    F.expr("CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'draft' ELSE 'cancel' END").alias("state"),
                    F.col("o_orderdate").cast("date").alias("invoice_date"),
                    F.struct(F.when(F.col("c_nationkey") < 13, "EUR").otherwise("PHP").alias("name")).alias("currency_id"),
                    F.struct(F.col("c_nationkey").alias("id")).alias("company_id")))


def invoices(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS invoice_id", "o_custkey AS partner_id",
        "CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'draft' ELSE 'cancel' END AS state",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS amount_total", "o_orderdate AS invoice_date",
        "date_add(CAST(o_orderdate AS DATE), 30) AS due_date")


def events_ts(t: Tables) -> DataFrame:
    """Events with an absolute event time (the files hold zone-less timestamps, read as UTC)."""
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def clearance_events(t: Tables) -> DataFrame:
    return events_ts(t).selectExpr(
        "user_id % 5 AS company_id", "user_id AS clearance_request_id", "event_id", "ts AS created_at",
        "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'department_cleared'"
        " WHEN 'purchase' THEN 'clearance_complete' ELSE 'final_pay_executed' END AS event_type",
        "CAST(value AS DECIMAL(12,2)) AS gross_pay")


def workflow_events(t: Tables) -> DataFrame:
    return events_ts(t).selectExpr(
        "event_id", "user_id % 5 AS company_id",
        "CASE event_type WHEN 'purchase' THEN 'invoice_generation' WHEN 'signup' THEN 'portfolio_intake'"
        " WHEN 'click' THEN 'task_sync' WHEN 'view' THEN 'capacity_sync' ELSE 'unknown_flow' END AS workflow_type",
        "CASE user_id % 3 WHEN 0 THEN 'notion' WHEN 1 THEN 'odoo' ELSE 'n8n' END AS source_system",
        "CAST(user_id AS STRING) AS source_record_id", "'created' AS action", "props", "ts AS created_at")


def drift_log(t: Tables) -> DataFrame:
    return events_ts(t).selectExpr(
        "event_id AS id", "CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'staging' ELSE 'prod' END AS environment",
        "CASE event_type WHEN 'error' THEN 'drift_found' ELSE 'clean' END AS status", "props AS diff_output",
        "ts AS checked_at")


def commands(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id", f"{payloads.COMMAND_TEXT} AS command",
        "CASE user_id % 4 WHEN 0 THEN 'advisory' WHEN 1 THEN 'warning' WHEN 2 THEN 'confirmation' ELSE 'strict' END AS level",
        "CASE WHEN value > 60 THEN 'shell' WHEN value > 30 THEN 'builtin' ELSE 'mcp' END AS tool_kind",
        "value > 100 AS fallback_used", "event_type = 'error' AS failed",
        "CAST(CAST(value AS DECIMAL(10,2)) * 100 AS BIGINT) AS detect_us",
        "CASE WHEN ts < TIMESTAMP_NTZ'2024-01-16 00:00:00' THEN 'before' ELSE 'after' END AS phase")


def corpus(t: Tables) -> DataFrame:
    """Whole documents as files: path, text."""
    return t.documents.selectExpr("doc_id", f"{payloads.CORPUS_PATH} AS path",
                                  f"CONCAT(text, CHR(10), {payloads.CORPUS_BLOCK}) AS text")


def parity(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "CONCAT('cap_', p_partkey) AS capability_id", "p_name AS capability_name",
        "CASE p_type WHEN 'STANDARD' THEN 'PPM' WHEN 'MEDIUM' THEN 'HR' WHEN 'PROMO' THEN 'Ops'"
        " WHEN 'LARGE' THEN 'Analytics' ELSE 'Finance' END AS domain",
        "array(CONCAT('page_', p_partkey * 3), CONCAT('doc:', p_brand)) AS enterprise_refs",
        "CASE p_size % 3 WHEN 0 THEN array('account', 'analytic') WHEN 1 THEN array('project')"
        " ELSE CAST(array() AS ARRAY<STRING>) END AS core_modules",
        "CASE WHEN p_size BETWEEN 13 AND 25 THEN array(named_struct('repo', p_brand, 'module', CONCAT('module_', p_name)))"
        " ELSE CAST(array() AS ARRAY<STRUCT<repo: STRING, module: STRING>>) END AS community_modules",
        "CASE WHEN p_size % 5 = 0 THEN array('warehouse') ELSE CAST(array() AS ARRAY<STRING>) END AS alt_stack",
        "p_size % 2 = 0 AS settings_only", "p_partkey % 2 = 0 AS reusable", "p_size >= 45 AS erp_unsafe",
        "CASE WHEN p_partkey % 6 <> 0 THEN CONCAT('needs ', p_name) END AS justification",
        "p_size % 4 AS gap_level",
        "CASE WHEN p_brand = 'Brand#9' THEN 'Minimal Custom' ELSE element_at(array('Config', 'OCA', 'Minimal Custom',"
        " 'External'), p_size % 4 + 1) END AS smart_delta")


def registry_entries(t: Tables) -> DataFrame:
    """Community module registry: module names known per repo; parts of other sizes are known by another name."""
    return t.part.selectExpr(
        "p_brand AS repo", "CONCAT(CASE WHEN p_size BETWEEN 13 AND 19 THEN 'module_' ELSE 'addon_' END, p_name) AS module").distinct()


VIEWS = {f.__name__: f for f in (
    fact_sales, evm, budget, capacity, sla, checklist, timesheet, rates, billing_config, portfolios, projects, ledger,
    assets_bundle, assets_runtime, bundle_docs, asset_texts, deploys, skills, tree, names, intake, ocr, invoice_events,
    invoices, events_ts, clearance_events, workflow_events, drift_log, commands, corpus, parity, registry_entries)}
