from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import commands as cmd
from tallymark.registry.core import query

CLASS_SQL = r"""CASE WHEN REGEXP_MATCHES(command, '^(git|docker|npm|make|ssh)\s+') THEN NULL
 WHEN REGEXP_MATCHES(command, '^(cat|head|tail|less|more)\s+') THEN 'file_read'
 WHEN REGEXP_MATCHES(command, '^(find|locate)\s+|^ls\s+.*-R') THEN 'file_search'
 WHEN REGEXP_MATCHES(command, '^(grep|rg|ag|ack)\s+') THEN 'content_search'
 WHEN REGEXP_MATCHES(command, '^(sed|awk)\s+|^perl\s+-[pi]') THEN 'file_edit'
 WHEN REGEXP_MATCHES(command, '^(echo|printf)\s+.*>|^cat\s+<<') THEN 'file_write' END"""


@query("command_classify", "event_id:l command:s detected_as:s", f"SELECT *, {CLASS_SQL} AS detected_as FROM commands", "commands")
def command_classify(t):
    return cmd.command_classify(t.view("commands"))


@query("enforcement_level", "event_id:l level:s detected_as:s action:s",
       f"""SELECT *, CASE WHEN detected_as IS NULL THEN 'pass' WHEN level = 'advisory' THEN 'info' WHEN level = 'warning' THEN 'warn'
 WHEN level = 'confirmation' THEN 'confirm' ELSE 'block' END AS action FROM (SELECT *, {CLASS_SQL} AS detected_as FROM commands) z""", "commands")
def enforcement_level(t):
    return cmd.enforcement_level(t.view("commands"))


@query("tool_adoption", "phase:s operations:l mcp_share:d builtin_share:d shell_share:d fallback_rate:d error_rate:d p99_us:d",
       """SELECT phase, COUNT(*) AS operations, CAST(COUNT(*) FILTER (WHERE tool_kind = 'mcp') AS DOUBLE) / COUNT(*) AS mcp_share,
 CAST(COUNT(*) FILTER (WHERE tool_kind = 'builtin') AS DOUBLE) / COUNT(*) AS builtin_share,
 CAST(COUNT(*) FILTER (WHERE tool_kind = 'shell') AS DOUBLE) / COUNT(*) AS shell_share,
 CAST(COUNT(*) FILTER (WHERE fallback_used) AS DOUBLE) / COUNT(*) AS fallback_rate,
 CAST(COUNT(*) FILTER (WHERE failed) AS DOUBLE) / COUNT(*) AS error_rate,
 ROUND(QUANTILE_CONT(CAST(detect_us AS DOUBLE), 0.99), 6) AS p99_us FROM commands GROUP BY 1""", "commands")
def tool_adoption(t):
    return cmd.tool_adoption(t.view("commands")).withColumn("p99_us", F.round("p99_us", 6))
