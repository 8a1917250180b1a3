"""Boundary cases on a few authored rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark.functions.redact import parse_db_url_sql, redact_text_sql, redact_url_sql
from tallymark.functions.scalars import js_or, parse_float_prefix
from tallymark.functions.status import register_sql_functions
from tallymark.operators import billing, clearance, finance, portfolio, quality, textscan
from tallymark.operators.commands import command_classify
from tallymark.operators.resolve import resolve_candidates
from tallymark.plans.chart_catalog import check_bindings
from tallymark.plans.periods import period_bounds, time_range_bounds
from tallymark.plans.semantic import Filter, adhoc_filters
from tallymark.sources.views import MONEY

D = Decimal
DAY = dt.date


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def evm_row(spark, bac, pv, ev, ac):
    return spark.createDataFrame([(1, 1, "p", DAY(2024, 1, 1), *[None if x is None else D(x) for x in (bac, pv, ev, ac)])],
                                 "company_id int, project_id int, project_name string, calculation_date date,"
                                 f" bac {MONEY}, pv {MONEY}, ev {MONEY}, ac {MONEY}")


@pytest.mark.parametrize("bac,pv,ev,ac,want", [
    ("100", "50", "40", "0", (D("0.000"), D("0.800"), D("100.00"))),        # no cost: cpi 0, eac = bac
    ("100", "0", "40", "80", (D("0.500"), D("0.000"), D("200.00"))),        # no plan: spi 0
    ("1000", "3", "1", "3", (D("0.333"), D("0.333"), D("3003.00"))),        # eac divides by the rounded index
    ("100", "50", "0", "10", (D("0.000"), D("0.000"), D("100.00"))),
    ("100", "50", "40", None, (D("0.000"), D("0.800"), D("100.00"))),       # unknown cost falls to 0
])
def test_evm_indices(spark, bac, pv, ev, ac, want):
    assert rows(finance.evm_metrics(evm_row(spark, bac, pv, ev, ac)), "cpi", "spi", "eac") == [want]


@pytest.mark.parametrize("bac,ev,ac,want", [("100", "40", "0", "60.00"), ("100", "40", "80", "120.00"), ("100", "0", "80", "100.00"),
                                            ("1000", "1", "3", "2997.00"), ("100", "110", "55", "-5.00")])
def test_estimate_to_complete_uses_the_unrounded_index(spark, bac, ev, ac, want):
    assert rows(finance.evm_etc(evm_row(spark, bac, "1", ev, ac)), "etc") == [(D(want),)]


def test_health_boundaries(spark):
    register_sql_functions(spark)
    got = spark.sql("""SELECT health_status(0.95, 0.95) a, health_status(0.949, 1) b, health_status(0.85, 0.85) c,
        health_status(0.849, 2) d, health_status(NULL, 1) e""").first()
    assert tuple(got) == ("GREEN", "YELLOW", "YELLOW", "RED", "RED")


@pytest.mark.parametrize("as_of,executed,cleared,want", [
    (DAY(2024, 1, 6), None, DAY(2024, 1, 1), "pending"),      # due - 2
    (DAY(2024, 1, 7), None, DAY(2024, 1, 1), "at_risk"),      # due - 1
    (DAY(2024, 1, 8), None, DAY(2024, 1, 1), "at_risk"),      # due
    (DAY(2024, 1, 9), None, DAY(2024, 1, 1), "breach"),       # due + 1
    (DAY(2024, 2, 1), DAY(2024, 1, 8), DAY(2024, 1, 1), "compliant"),
    (DAY(2024, 2, 1), DAY(2024, 1, 9), DAY(2024, 1, 1), "breach"),
    (DAY(2024, 2, 1), DAY(2024, 1, 9), None, "pending"),      # no due date
    (DAY(2024, 2, 1), None, None, "pending"),
])
def test_sla_status(spark, as_of, executed, cleared, want):
    df = spark.createDataFrame([(1, 1, None, cleared, executed)], "company_id int, clearance_request_id int,"
                               " last_working_date date, clearance_date date, final_pay_executed_date date")
    assert rows(clearance.sla_compliance(df, as_of), "internal_sla_status", "statutory_compliant") == [(want, None)]


def test_zero_plan_gives_zero_in_the_table_but_no_alert(spark):
    df = spark.createDataFrame([(1, D("0"), D("5")), (2, D("100"), D("110")), (3, D("100"), D("110.01")), (4, D("100"), D("75")),
                                (5, D("100"), D("74.99")), (6, D("100"), None)],
                               f"project_id int, planned_amount {MONEY}, actual_amount {MONEY}")
    assert rows(finance.budget_variance(df.limit(1)), "variance_pct") == [(D("0.00"),)]
    compared = df.select("project_id", F.lit(None).cast("string").alias("project_name"), F.col("planned_amount").alias("planned"),
                         F.coalesce("actual_amount", F.lit(0)).cast(MONEY).alias("actual"))
    alerts = finance.variance_alerts(compared, 0).orderBy("project_id")     # 0 means the default of 10
    assert rows(alerts, "project_id", "variance_type", "severity", "project_name") == [
        (3, "OVER", "MEDIUM", "Unknown"), (4, "UNDER", "MEDIUM", "Unknown"), (5, "UNDER", "HIGH", "Unknown"), (6, "UNDER", "HIGH", "Unknown")]


def test_js_or(spark):
    df = spark.sql("SELECT * FROM VALUES (0, ''), (NULL, NULL), (3, 'x') t(n, s)")
    assert rows(df, js_or(F.col("n"), 10).alias("a"), js_or(F.col("s"), "d").alias("b")) == [(10, "d"), (10, "d"), (3, "x")]


def test_invoice_lines_rate_key_and_defaults(spark):
    sheet = spark.createDataFrame(
        [(1, 1, 7, "ann@x", "ann@x", D("2"), DAY(2024, 1, 5), False), (2, 1, 8, "Bob", "bob@x", D("3"), DAY(2024, 1, 31), False),
         (3, 1, 8, "Bob", "bob@x", D("1"), DAY(2024, 2, 1), False), (4, 1, 8, "Bob", "bob@x", D("9"), DAY(2024, 1, 2), True),
         (5, 2, 8, "Bob", "bob@x", D("4"), DAY(2024, 1, 2), False), (6, 9, 8, "", "bob@x", D("1"), DAY(2024, 1, 2), False)],
        "id long, project_id int, employee_id int, employee_name string, employee_email string, unit_amount decimal(10,2),"
        " work_date date, is_invoiced boolean")
    config = spark.createDataFrame([(1, "tm", D("0"), D("0")), (2, "fixed", D("1"), D("1")), (3, None, None, None)],
                                   "project_id int, billing_type string, base_rate decimal(10,2), markup_percentage decimal(5,2)")
    rates = spark.createDataFrame([("ann@x", D("100")), ("bob@x", D("200")), ("", D("1")), ("zed@x", D("0"))],
                                  "email string, hourly_rate decimal(10,2)")
    span = (DAY(2024, 1, 1), DAY(2024, 1, 31))
    literal = billing.tm_invoice_lines(sheet, config, rates, *span)
    # the name equals an e-mail only for the first employee; the other falls back to 150, and a markup of 0 means 15 %
    # a project without configuration is billed by time on the defaults
    assert rows(literal.orderBy("project_id", "employee_id"), "project_id", "quantity", "price_unit", "name") == [
        (1, D("2.00"), D("115.000000"), "Labor - ann@x"), (1, D("3.00"), D("172.500000"), "Labor - Bob"),
        (9, D("1.00"), D("172.500000"), "Labor - Unknown")]
    by_email = billing.tm_invoice_lines(sheet, config, rates, *span, rate_key="employee_email")
    assert rows(by_email.filter("project_id = 1").orderBy("employee_id"), "price_unit") == [(D("115.000000"),), (D("230.000000"),)]
    ids = billing.timesheet_id_chunks(sheet, config, *span)
    assert sorted(i for r in ids.collect() for i in r.timesheet_ids) == [1, 2, 6]
    total = billing.tm_invoice_total(literal, config).orderBy("project_id")
    assert rows(total, "billing_type", "total", "message") == [
        ("tm", D("747.50000000"), None), ("fixed", None, billing.FIXED_MESSAGE), ("tm", D("0E-8"), None), ("tm", D("172.50000000"), None)]


def test_parse_float_reads_a_prefix(spark):
    df = spark.sql("SELECT * FROM VALUES ('12.50 EUR'), ('n/a'), (' 3'), ('-1e3x'), ('.5'), ('') t(s)")
    assert [r[0] for r in rows(df, parse_float_prefix(F.col("s")).alias("v"))] == [12.5, None, 3.0, -1000.0, 0.5, None]


@pytest.mark.parametrize("url,want,fields", [
    ("postgres://u:p@ss@h:5432/db", "postgres://u:***REDACTED***@h:5432/db", ["url_password"]),
    ("redis://h/0?token=a&x=1#f", "redis://h/0?token=***REDACTED***&x=1#f", ["query:token"]),
    ("MySQL://u@h/db", "mysql://u@h/db", []),
    ("https://h/p?a=b%20c&PWD=z", "https://h/p?a=b c&PWD=***REDACTED***", ["query:PWD"]),
    ("sqlite:///data/x.db", "sqlite:/data/x.db", []),
    ("https://h/p?flag", "https://h/p?flag=", []),
])
def test_redact_url(spark, url, want, fields):
    r = spark.createDataFrame([(url,)], "u string").select(F.expr(redact_url_sql("u")).alias("r")).first().r
    assert (r["text"], r["fields"]) == (want, fields)


@pytest.mark.parametrize("url,want", [
    ("postgresql://Svc:pw@DB.Host:5432/app?sslmode=require&ssl=x", ("postgres", "db.host", "5432", "app", "Svc", "x")),
    ("mongodb://h:99999/db", ("mongo", "h", None, "db", None, None)),
    ("redis://h:abc", ("redis", "h", None, None, None, None)),
    ("mysql://[::1]:3306/d", ("mysql", "::1", "3306", "d", None, None)),
    ("plain", ("unknown", None, None, "plain", None, None)),
    ("postgres://h/", ("postgres", "h", None, "", None, None)),
])
def test_parse_db_url(spark, url, want):
    assert tuple(spark.createDataFrame([(url,)], "u string").select(F.expr(parse_db_url_sql("u")).alias("r")).first().r) == want


@pytest.mark.parametrize("mode,text,want,fields", [
    ("reference", 'token = "abc"', 'token = "abc"', []),                     # the quote stops the value class
    ("quoted", 'token = "abc" x', "token=***REDACTED*** x", ["token"]),
    ("reference", "Password: hunter2, next", "Password=***REDACTED***, next", ["Password"]),
    ("reference", "see postgres://a:b@h/d?key=1 and api_key=z", "see postgres://a:***REDACTED***@h/d?key=***REDACTED*** and api_key=***REDACTED***",
     ["api_key", "query:key", "url_password"]),
    ("reference", "x eyJabcdefghijk.abcdefghijk.abcdefghijk y", "x ***REDACTED*** y", ["jwt"]),
    ("reference", "nothing here", "nothing here", []),
    ("reference", "mytoken=5", "mytoken=5", []),
])
def test_redact_text(spark, mode, text, want, fields):
    once = spark.createDataFrame([(text,)], "t string").select(F.expr(redact_text_sql("t", mode)).alias("r")).first().r
    assert (once["text"], once["fields"]) == (want, fields)
    again = spark.createDataFrame([(want,)], "t string").select(F.expr(redact_text_sql("t", mode)).alias("r")).first().r
    assert again["text"] == want


def test_scan_lines(spark):
    text = "\n".join([
        "DATABASE_URL=postgres://a:b@h/d", 'url "postgresql+psycopg2://u:p@h/d"', "bad redis://h:7x/0 port", "DB_HOST='one'", "DB_HOST=two",
        "DB_PORT=1", "export PGUSER=me", "PGPASSWORD=", "file data/app.sqlite and sqlite:///x.db", "go https://abcdefghij1.supabase.co/x", "DATABASE_URL="])
    corpus = spark.createDataFrame([("/r/.env", text)], "path string, text string")
    found = textscan.datastore_findings(corpus)
    got = sorted(rows(found, "datastore_type", "instance_name", "host", "database", "line_start"), key=str)
    assert got == sorted([
        ("postgres", "DATABASE_URL", "h", "d", 1), ("redis", "REDIS", "h", "0", 3), ("unknown", "DB_*", "two", None, 5),
        ("postgres", "PG*", None, None, 7), ("sqlite", None, None, "data/app.sqlite", 9), ("sqlite", None, None, "/x.db", 9),
        ("supabase", "SUPABASE_URL", "abcdefghij1.supabase.co", None, 10)], key=str)
    with_driver = textscan.datastore_findings(corpus, driver_suffix=True)
    assert with_driver.count() == found.count() + 1
    assert found.filter("instance_name = 'PG*'").first().secrets_present is False      # an empty password is no secret


def test_bundle_messages_are_clean(spark):
    docs = spark.createDataFrame([
        ("charts", "a", '{"version":"1.0","schema_version":"chart_v1","slice_name":"s","viz_type":"v","params":{}}'),
        ("charts", "b", '{"version":"3","schema_version":"other","slice_name":"s","params":null}'), ("charts", "c", "[1]"), ("charts", "d", "{oops"),
        ("other", "e", '{"version":""}')], "asset_type string, file string, doc string")
    assert sorted(rows(quality.bundle_validate(docs), "file", "message")) == [
        ("b", "Invalid schema_version: expected chart_v1, got other"), ("b", "Missing required field: viz_type"),
        ("b", "Unsupported version: 3 (supported: 1.0)"), ("c", "Root must be a dictionary"), ("d", "Document is not valid JSON")]


def test_commands(spark):
    text = ["cat a", "cat << EOF", "ls -R .", "ls .", "git grep x", "perl -i f", "echo a > b", "echo a", "rg x", "sshx y", "make cat"]
    df = spark.createDataFrame([(x,) for x in text], "command string")
    assert [r[0] for r in rows(command_classify(df), "detected_as")] == [
        "file_read", "file_read", "file_search", None, None, "file_edit", "file_write", None, "content_search", None, None]


def test_candidate_order(spark):
    options = [("k", 0, 0, "echarts_a"), ("k", 0, 1, "echarts-b"), ("k", 1, 0, "plain"), ("m", 1, 0, "zed")]
    have = spark.createDataFrame([(1, "my_ECharts_x_a"), (1, "echarts-b"), (2, "plain"), (2, "ECHARTS.B.2"), (3, "plain"), (4, "other")],
                                 "env int, viz_type string")
    ask = spark.createDataFrame([(e, k) for e in (1, 2, 3, 4) for k in ("k", "m")], "env int, kind string")
    got = {(r.env, r.kind): (r.viz_type, r.how) for r in resolve_candidates(ask, have, "env", options).collect()}
    assert got[1, "k"] == ("echarts-b", "exact")        # exact beats an earlier fuzzy hit
    assert got[2, "k"] == ("ECHARTS.B.2", "fuzzy")
    assert got[3, "k"] == ("plain", "exact")
    assert got[4, "k"] == ("plain", "default") and got[1, "m"] == ("zed", "default")


def test_tenant_scope(spark):
    df = spark.range(3).withColumnRenamed("id", "company_id")
    assert portfolio.tenant_scope(df, "company_id", None).count() == 0
    with pytest.raises(ValueError):
        portfolio.tenant_scope(df, "company_id", None, strict=True)


def test_ranges_and_bindings(spark):
    assert period_bounds("last_month", DAY(2024, 1, 15)) == (DAY(2023, 12, 1), DAY(2024, 1, 1))
    assert period_bounds("this_quarter", DAY(2024, 12, 31)) == (DAY(2024, 10, 1), DAY(2025, 1, 1))
    assert time_range_bounds("Last month", DAY(2024, 3, 31)) == (DAY(2024, 2, 29), DAY(2024, 3, 31))
    assert time_range_bounds("Last 7 days", DAY(2024, 3, 7)) == (DAY(2024, 2, 29), DAY(2024, 3, 7))
    with pytest.raises(ValueError):
        time_range_bounds("yesterday-ish", DAY(2024, 1, 1))
    with pytest.raises(ValueError):
        check_bindings("pie", {"metric": "m"})
    with pytest.raises(ValueError):
        adhoc_filters(spark.range(1), [Filter("id", 1, "~~")])
