"""Time-and-materials billing, invoice events, intake and OCR payloads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import js_or, parse_float_prefix, unfold
from tallymark.plans.periods import between, period_bounds

c = F.col
BASE_RATE = 150
MARKUP_PCT = 15
ID_CHUNK = 1000
FIXED_MESSAGE = "Fixed price billing requires milestone completion check"


def _dec(value, type_: str = "decimal(10,2)") -> Column:
    return F.lit(value).cast(type_)


def billing_terms(config: DataFrame) -> DataFrame:
    """Billing configuration with the defaults applied (a 0 counts as missing)."""
    def truthy_or(col: Column, default, type_: str) -> Column:
        return F.coalesce(F.when(col != 0, col), _dec(default, type_))

    return config.select(
        "project_id", js_or(c("billing_type"), "tm").alias("billing_type"),
        truthy_or(c("base_rate"), BASE_RATE, "decimal(10,2)").alias("base_rate"),
        truthy_or(c("markup_percentage"), MARKUP_PCT, "decimal(5,2)").alias("markup_percentage"))


def with_terms(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Billing terms beside each row; a project without configuration has the defaults."""
    return (rows.join(billing_terms(config), "project_id", "left")
            .withColumns({"billing_type": F.coalesce("billing_type", F.lit("tm")),
                          "base_rate": F.coalesce("base_rate", _dec(BASE_RATE)),
                          "markup_percentage": F.coalesce("markup_percentage", _dec(MARKUP_PCT, "decimal(5,2)"))}))


def open_entries(timesheet: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Entries not yet invoiced, both period ends included."""
    return between(timesheet.filter(~c("is_invoiced")), "work_date", start, end + dt.timedelta(days=1))


def rate_lookup(rows: DataFrame, rates: DataFrame, rate_key: str = "employee_name", base: str = "base_rate",
                rate_order: str = "hourly_rate") -> DataFrame:
    """Rate whose e-mail equals ``rate_key``, else the base rate.

    Of several rates for an e-mail the last one by ``rate_order`` counts: name the
    column that numbers the list (the workflow keeps the last of the list). A
    table without such a column has no last row, and the highest rate counts.

    The workflow keys its rates by e-mail but looks them up by employee name, so
    the default finds one only when both texts agree; pass
    ``rate_key="employee_email"`` for the evident intent.
    """
    known = (rates.filter((c("email") != "") & (c("hourly_rate") != 0))
             .groupBy(c("email").alias("_key")).agg(F.max_by("hourly_rate", F.struct(rate_order, "hourly_rate")).alias("_rate")))
    return (rows.join(known, rows[rate_key] == known["_key"], "left")
            .withColumn("rate", F.coalesce("_rate", base)).drop("_key", "_rate"))


def tm_invoice_lines(timesheet: DataFrame, config: DataFrame, rates: DataFrame, start: dt.date, end: dt.date,
                     rate_key: str = "employee_name") -> DataFrame:
    """One line per project and employee. Entries are folded before any join.

    The contributing ids come from ``timesheet_id_chunks``: an array per line
    would have no size limit.
    """
    folded = (open_entries(timesheet, start, end).groupBy("project_id", "employee_id")
              .agg(F.min("employee_name").alias("employee_name"), F.min("employee_email").alias("employee_email"),
                   F.sum(F.coalesce("unit_amount", F.lit(0))).cast("decimal(18,2)").alias("quantity"),
                   F.count("*").alias("n_entries")))
    lines = with_terms(folded, config).filter("billing_type = 'tm'")
    priced = rate_lookup(lines, rates, rate_key).withColumn(
        "price_unit", (c("rate") * (100 + c("markup_percentage")) * _dec("0.01", "decimal(3,2)")).cast("decimal(20,6)"))
    return priced.select(
        "project_id", "employee_id", js_or(c("employee_name"), "Unknown").alias("employee_name"),
        F.concat(F.lit("Labor - "), js_or(c("employee_name"), "Unknown")).alias("name"), "quantity", "price_unit",
        (c("quantity") * c("price_unit")).cast("decimal(38,8)").alias("subtotal"), "n_entries")


def tm_invoice_total(lines: DataFrame, config: DataFrame) -> DataFrame:
    """Total per project; a project that is not billed by time gets a marker row."""
    totals = lines.groupBy("project_id").agg(F.sum("subtotal").alias("total"), F.count("*").alias("n_lines"))
    is_tm = F.coalesce("billing_type", F.lit("tm")) == "tm"
    return (billing_terms(config).join(totals, "project_id", "full")
            .select("project_id", F.when(is_tm, "tm").otherwise("fixed").alias("billing_type"),
                    F.when(is_tm, F.coalesce("total", F.lit(0))).alias("total"),
                    F.when(is_tm, F.coalesce("n_lines", F.lit(0))).alias("n_lines"),
                    F.when(~is_tm, FIXED_MESSAGE).alias("message")))


def timesheet_id_chunks(timesheet: DataFrame, config: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Sorted ids behind each line, at most ``ID_CHUNK`` per row (one row per id range)."""
    chunks = (open_entries(timesheet, start, end)
              .groupBy("project_id", "employee_id", F.expr(f"id DIV {ID_CHUNK}").alias("chunk"))
              .agg(F.sort_array(F.collect_set("id")).alias("timesheet_ids")))
    return chunks.join(billing_terms(config).filter("billing_type <> 'tm'"), "project_id", "left_anti")


def timesheet_link(chunks: DataFrame, orders: DataFrame) -> DataFrame:
    """The created order id on every contributing timesheet id."""
    return (chunks.select("project_id", F.explode("timesheet_ids").alias("timesheet_id"))
            .join(orders.select("project_id", "sale_order_id"), "project_id"))


INTAKE_SCHEMA = """id STRING, properties STRUCT<
 Name: STRUCT<title: ARRAY<STRUCT<plain_text: STRING>>>, Sponsor: STRUCT<email: STRING>, Budget: STRUCT<number: DOUBLE>,
 StartDate: STRUCT<date: STRUCT<start: STRING>>, Description: STRUCT<rich_text: ARRAY<STRUCT<plain_text: STRING>>>,
 Priority: STRUCT<select: STRUCT<name: STRING>>>"""


def intake_flatten(payloads: DataFrame) -> DataFrame:
    """Read the optional paths of an intake page; a null, 0 or '' takes the default."""
    p = "p.properties"
    df = payloads.select(F.from_json("payload", INTAKE_SCHEMA).alias("p"))
    return df.select(
        js_or(F.get(f"{p}.Name.title", F.lit(0))["plain_text"], "Untitled").alias("portfolio_name"),
        js_or(c(f"{p}.Sponsor.email"), "").alias("sponsor_email"),
        js_or(c(f"{p}.Budget.number"), 0.0).alias("budget_total"),
        js_or(c(f"{p}.StartDate.date.start"), None, blank="").alias("start_date"),
        js_or(F.get(f"{p}.Description.rich_text", F.lit(0))["plain_text"], "").alias("description"),
        c("p.id").alias("page_id"),
        js_or(c(f"{p}.Priority.select.name"), "Medium").alias("priority"))


OCR_SCHEMA = """tables ARRAY<STRUCT<type: STRING, vendor: STRING, total: STRING, date: STRING,
 items: ARRAY<STRUCT<sku: STRING, qty: BIGINT>>>>"""


def ocr_invoice_lines(docs: DataFrame) -> DataFrame:
    """Invoice tables of the OCR output, one row per item (a table without items keeps one row)."""
    tables = (unfold(docs, ["doc_id"], F.from_json("payload", OCR_SCHEMA)["tables"], "t")
              .filter("t.type = 'invoice'"))
    return (tables.select("doc_id", c("t.vendor").alias("vendor"), parse_float_prefix(c("t.total")).alias("amount"),
                          c("t.date").alias("date"), F.explode_outer("t.items").alias("item"))
            .select("doc_id", "vendor", "amount", "date", c("item.sku").alias("sku"), c("item.qty").alias("qty")))


def invoice_projection(events: DataFrame) -> DataFrame:
    return events.select(
        c("id").alias("invoice_id"), c("partner_id.name").alias("partner_name"), "amount_total", "state", "invoice_date",
        c("currency_id.name").alias("currency"), c("company_id.id").alias("company_id"))


def invoice_search(invoices: DataFrame, state: str | None = None, partner_id: int | None = None,
                   date_from: dt.date | None = None, date_to: dt.date | None = None, limit: int | None = None) -> DataFrame:
    """Optional filters (dates inclusive), newest first, then by id."""
    df = invoices
    if state is not None:
        df = df.filter(c("state") == state)
    if partner_id is not None:
        df = df.filter(c("partner_id") == partner_id)
    last = None if date_to is None else date_to + dt.timedelta(days=1)
    df = between(df, "invoice_date", date_from, last)
    ordered = df.orderBy(c("invoice_date").desc(), "invoice_id")
    return ordered if limit is None else ordered.limit(limit)


def period_filter(invoices: DataFrame, period: str, as_of: dt.date, column: str = "invoice_date") -> DataFrame:
    return between(invoices, column, *period_bounds(period, as_of))


def period_summary(invoices: DataFrame, periods: list[str], as_of: dt.date, column: str = "invoice_date") -> DataFrame:
    """Rows and amount of several periods in one pass; the rows of none of them are not read."""
    bounds = {p: period_bounds(p, as_of) for p in periods}
    kind = invoices.schema[column].dataType
    df = between(invoices, column, min(b[0] for b in bounds.values()), max(b[1] for b in bounds.values()))
    inside = [F.when((c(column) >= F.lit(lo).cast(kind)) & (c(column) < F.lit(hi).cast(kind)), F.lit(p)) for p, (lo, hi) in bounds.items()]
    return (unfold(df, ["amount_total"], F.array_compact(F.array(*inside)), "period")
            .groupBy("period").agg(F.count("*").alias("n_rows"), F.sum("amount_total").alias("amount")))


def financial_summary(invoices: DataFrame, period: str, as_of: dt.date) -> DataFrame:
    return (period_filter(invoices, period, as_of).groupBy("state")
            .agg(F.count("*").alias("n_invoices"), F.sum("amount_total").alias("amount"),
                 F.countDistinct("partner_id").alias("n_partners")))


def _due_before(invoices: DataFrame, last: dt.date) -> DataFrame:
    """Posted invoices due on ``last`` or before; the bound is a literal of the column's own type and reaches the scan."""
    end = F.lit(last + dt.timedelta(days=1)).cast(invoices.schema["due_date"].dataType)
    return invoices.filter((c("state") == "posted") & (c("due_date") < end))


def ar_aging(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """Open amounts by days past due: 0-30, 31-60, 61-90, 90+."""
    days = c("days")
    bucket = (F.when(days <= 30, "0-30").when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise("90+"))
    return (_due_before(invoices, as_of).withColumn("days", F.datediff(F.lit(as_of), "due_date"))
            .groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_invoices"), F.sum("amount_total").alias("amount")))


def top_overdue(invoices: DataFrame, as_of: dt.date, limit: int) -> DataFrame:
    return (_due_before(invoices, as_of - dt.timedelta(days=1)).groupBy("partner_id")
            .agg(F.sum("amount_total").alias("amount")).orderBy(c("amount").desc(), "partner_id").limit(limit))


def aging_trend(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    return (_due_before(invoices, as_of - dt.timedelta(days=1))
            .groupBy(F.trunc("due_date", "MM").alias("month")).agg(F.sum("amount_total").alias("amount")))
