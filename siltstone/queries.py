"""Queries over the star schema, one or more to an operator, and the DuckDB SQL that gives the same rows.

The tables hold hardly a log line, so lines are put together from their columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns, lines
from .functions.identity import FRACTION, unit_class_column
from .operators import canonical, reports
from .operators.stream import Declaration
from .plans.packages import NO_RULES, all_rules
from .session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over all cores where their table has fewer files than there are; a table of many files stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def event_lines(spark: SparkSession, sf_dir: str, line: str, stream: str = "'s'", order: str = "event_id") -> DataFrame:
    events = spread(table(spark, sf_dir, "events"))
    return events.select(F.expr(stream).cast("string").alias("stream_id"), F.expr(order).cast("long").alias("line_no"), F.expr(line).alias("raw"))


# --- templates: how often each kind of line occurs

_ORDER_LINE = "concat('order id=', o_orderkey, ' status=', o_orderstatus, ' customer ', o_custkey, ' total ', cast(o_totalprice as long), 'EUR')"
_ORDER_TEMPLATE = "'order id=<*> status=' || o_orderstatus || ' customer <*> total <*>'"
_TEMPLATE_SQL = f"""
WITH t AS (SELECT {_ORDER_TEMPLATE} AS template_str FROM orders)
SELECT template_str, 'h:' || substr(sha256(template_str), 1, 32) AS template_id, count(*) AS n FROM t GROUP BY template_str
"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice", "o_orderpriority"))
    return orders.select(F.lit("orders").alias("stream_id"), F.col("o_orderkey").alias("line_no"), F.expr(_ORDER_LINE).alias("raw"), "o_orderpriority")


@query("template_counts", _TEMPLATE_SQL)
def template_counts(spark, sf_dir):
    return reports.template_counts(canonical.canonicalize(order_lines(spark, sf_dir))).select("template_str", "template_id", "n")


@query("template_counts_expressions", _TEMPLATE_SQL)
def template_counts_expressions(spark, sf_dir):
    """The same in built-in expressions alone."""
    t = order_lines(spark, sf_dir).select(columns.simple_template(F.col("raw")).alias("template_str"))
    counts = t.groupBy("template_str").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("template_str", canonical.template_ids(F.col("template_str")).alias("template_id"), "n")


@query(
    "template_top",
    f"WITH t AS (SELECT {_ORDER_TEMPLATE} AS template_str FROM orders) SELECT template_str, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, template_str LIMIT 15",
)
def template_top(spark, sf_dir):
    return reports.top_templates(canonical.canonicalize(order_lines(spark, sf_dir))).select("template_str", "n")


_ITEM_LINE = "concat('item ', l_linenumber, ' flag=', l_returnflag, l_linestatus, ' mode ', substring('abcdefghij', cast(l_quantity as int) % 10 + 1, 1))"


@query(
    "template_cardinality",
    """WITH t AS (SELECT 'item <*> flag=' || l_returnflag || l_linestatus || ' mode ' || substr('abcdefghij', l_quantity::INT % 10 + 1, 1) AS t FROM lineitem),
c AS (SELECT t, count(*) AS n FROM t GROUP BY t)
SELECT sum(n)::BIGINT AS lines, count(*) AS templates, count(*) FILTER (WHERE n = 1) AS singletons FROM c""",
)
def template_cardinality(spark, sf_dir):
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"))
    items = items.select(F.lit("i").alias("stream_id"), F.col("l_orderkey").alias("line_no"), F.expr(_ITEM_LINE).alias("raw"))
    return reports.cardinality(canonical.canonicalize(items))


@query(
    "template_entropy",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT sum(n) AS t, sum(n * log2(n)) AS x FROM c)
SELECT t::BIGINT AS total, round(log2(t) - x / t, 6) AS bits FROM s""",
)
def template_entropy(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return reports.entropy_bits(counts).select("total", F.round("bits", 6).alias("bits"))


@query("log2_weighted_sum")
def log2_weighted_sum(spark, sf_dir):
    """The exact fixed-point sum of n log2 n; tests hold it to whole-number arithmetic."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(reports.weighted_log2(F.col("n"), F.col("n")).alias("raw"), F.lit(FRACTION).alias("fraction_bits"))


# --- line endings, escapes, transports

_ESCAPED = r"concat(char(27), '[36;1muser ', user_id, char(27), '[0m did ', char(27), ']0;t', char(7), event_type, repeat(char(13), cast(event_id % 3 as int)))"


@query("line_normalize", "SELECT event_id, 'user ' || user_id || ' did ' || event_type AS line FROM events")
def line_normalize(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", lines.normalize_column(F.expr(_ESCAPED)).alias("line"))


_STAMP = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
_NS = "((epoch_us(ts) // 1000000) * 1000000000)::BIGINT"


@query(
    "transport_peel",
    f"""SELECT event_id, 'user ' || user_id AS content, CASE event_id % 3 WHEN 2 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN '.1234567Z' ELSE '.250Z' END END AS observed
FROM events""",
)
def transport_peel(spark, sf_dir):
    line = (
        f"CASE event_id % 3 WHEN 0 THEN concat({_STAMP}, '.1234567Z user ', user_id) WHEN 1 THEN concat('[', {_STAMP}, '.250Z]  user ', user_id) "
        "ELSE concat(char(239), char(187), char(191), 'user ', user_id) END"
    )
    stack = lines.transport_stack(["utf8-bom-line-prefix", "api-rfc3339-line-prefix", "bracket-rfc3339-line-prefix"])
    content, seen = lines.peel_column(F.expr(line), stack)
    return table(spark, sf_dir, "events").select("event_id", content.alias("content"), seen.alias("observed"))


@query("transport_render", "SELECT event_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z] ' AS prefix FROM events")
def transport_render(spark, sf_dir):
    ns = F.unix_seconds(F.col("ts").cast("timestamp")) * 1_000_000_000
    return table(spark, sf_dir, "events").select("event_id", lines.render_transport_column("bracket-rfc3339-line-prefix", ns).alias("prefix"))


@query(
    "utf8_repair",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'é' WHEN 1 THEN chr(65533) || 'x' WHEN 2 THEN 'x' || chr(65533) ELSE chr(65533) || chr(65533) END AS text FROM events",
)
def utf8_repair(spark, sf_dir):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN X'C3A9' WHEN 1 THEN X'C378' WHEN 2 THEN X'78E282' ELSE X'FFFE' END")
    return table(spark, sf_dir, "events").select("event_id", lines.utf8_column(lines.latin_column(raw)).alias("text"))


# --- formats: the line of each, and what is read from it

_SAID = "concat('user ', user_id, ' did ', event_type)"
_SAID_T = "'user <*> did ' || event_type"
_INFERRED = "CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Unknown' END"
_D = lambda p: f'date_format(ts, "{p}")'
_EPOCH = "unix_seconds(cast(ts as timestamp))"
_NULL = "NULL::BIGINT"


def _format_case(name: str, line: str, level: str, declared: str, component: str = "''", host: str = "''", template: str = _SAID_T, ns: str = _NS, rules: bool = False, layout: str = "", pinned: str = ""):
    sql = f"""WITH e AS (SELECT event_id, '{name}' AS format, {level} AS level, {declared} AS declared_level, {component} AS component, {host} AS host,
{template} AS template_str, {ns} AS timestamp_ns FROM events) SELECT *, 'h:' || substr(sha256(template_str), 1, 32) AS template_id FROM e"""

    def run(spark, sf_dir):
        events = canonical.canonicalize(event_lines(spark, sf_dir, line), all_rules() if rules else NO_RULES, pinned=pinned)
        return events.select(F.col("line_no").alias("event_id"), "format", "level", "declared_level", "component", "host", "template_str", "timestamp_ns", "template_id")

    query(f"format_{name.lower()}{layout}", sql)(run)


_PRIORITY = "CASE event_id % 8 WHEN 0 THEN 'Fatal' WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Fatal' WHEN 3 THEN 'Error' WHEN 4 THEN 'Warn' WHEN 7 THEN 'Debug' ELSE 'Info' END"
_BSD = f"concat({_D('MMM')}, ' ', lpad({_D('d')}, 2, ' '), ' ', {_D('HH:mm:ss')})"
_ISO, _ISO_T = _D("yyyy-MM-dd HH:mm:ss"), _STAMP
_STATUS = "(200 + 100 * (event_id % 4))"
_STATUS_LEVEL = "CASE event_id % 4 WHEN 0 THEN 'Info' WHEN 1 THEN 'Info' WHEN 2 THEN 'Warn' ELSE 'Error' END"

_format_case("RawText", f"concat('  ', {_SAID})", _INFERRED, "false", ns=_NULL)
_format_case("Syslog", f"concat({_BSD}, ' web01 app[', event_id, ']: ', {_SAID})", _INFERRED, "false", "'app'", ns=_NULL)
_format_case("Rfc3339Text", f"concat({_ISO_T}, 'Z ', {_SAID})", _INFERRED, "false", template=f"'<*> ' || {_SAID_T}")
_format_case("RFC5424", f"concat('<', 8 + event_id % 8, '>1 ', {_ISO_T}, 'Z host1 api 77 ID4 - ', {_SAID})", _PRIORITY, "true", "'api'")
_format_case("Log4j", f"concat({_ISO}, ',123 WARN [main] app.Core: ', {_SAID})", "'Warn'", "true", "'app.Core'")
_format_case("SparkHDFS", f"concat({_D('yy/MM/dd HH:mm:ss')}, ' INFO storage.Block: ', {_SAID})", "'Info'", "true", "'storage.Block'")
_format_case(
    "BGL",
    f"concat('- ', {_EPOCH}, ' ', {_D('yyyy.MM.dd')}, ' R02-M1 ', {_D('yyyy-MM-dd-HH.mm.ss')}, '.000000 R02-M1 RAS KERNEL FATAL ', {_SAID})",
    "'Fatal'",
    "true",
    "'KERNEL'",
    "'R02-M1'",
)
_format_case(
    "CLF",
    f"concat('10.0.0.', event_id % 200, ' - - [', {_D('dd/MMM/yyyy:HH:mm:ss')}, ' +0000] \"GET /u/', user_id, ' HTTP/1.1\" ', {_STATUS}, ' 512')",
    _STATUS_LEVEL,
    "true",
    host="'10.0.0.' || (event_id % 200)",
    template="'GET /u/<*> <*>'",
)
_format_case("IISW3C", f"concat({_ISO}, ' W3SVC1 srv1 GET /index - ', {_STATUS}, ' 0')", _STATUS_LEVEL, "true", "'srv1'", template="'GET /index - <*> <*>'")
_format_case("NginxError", f"concat({_D('yyyy/MM/dd HH:mm:ss')}, ' [crit] 12#0: ', {_SAID})", "'Fatal'", "true", "'nginx'")
_format_case("ApacheError", f"concat('[', {_D('EEE MMM dd HH:mm:ss yyyy')}, '] [core:notice] [pid 5] ', {_SAID})", "'Info'", "true", "'core'")
_format_case("AndroidLogcat", f"concat({_D('MM-dd HH:mm:ss')}, '.123  12  34 W Radio: ', {_SAID})", "'Warn'", "true", "'Radio'", ns=_NULL)
_format_case("WindowsCBS", f"concat({_ISO}, ', Verbose      CBS    ', {_SAID})", "'Trace'", "true", "'CBS'")
_format_case("HealthApp", f"concat({_D('yyyyMMdd-H:m:s')}, ':42|Step|300|', {_SAID})", "'Unknown'", "false", "'Step'")
_format_case("HPC", f"concat(event_id, ' node-12 unix.hw state ', {_EPOCH}, ' 1 ', {_SAID})", "'Unknown'", "false", "'unix.hw.state'")
_format_case("Proxifier", f"concat('[', {_D('MM.dd HH:mm:ss')}, '] chrome.exe - ', {_SAID})", "'Unknown'", "false", "'chrome.exe'", ns=_NULL)
_format_case(
    "KeyValue",
    f"concat('ts=', {_ISO_T}, 'Z level=debug service=api user=', user_id, ' event=', event_type)",
    "'Debug'",
    "true",
    "'api'",
    template="'user=<*> event=' || event_type",
)
_format_case(
    "JSON",
    f'concat(\'{{"time":"\', {_ISO_T}, \'Z","severity":"err","msg":"\', {_SAID}, \'","logger":"api"}}\')',
    "'Error'",
    "true",
    "'api'",
)
_format_case("CloudWatch", f'concat(\'{{"logGroup":"g1","timestamp":\', {_EPOCH}, \'250,"level":"info","message":"\', {_SAID}, \'"}}\')', "'Info'", "true", "'g1'")
_format_case(
    "SystemdJournal",
    f'concat(\'{{"__REALTIME_TIMESTAMP":"\', {_EPOCH}, \'000123","PRIORITY":"\', event_id % 8, \'","_COMM":"sshd","MESSAGE":"\', {_SAID}, \'"}}\')',
    _PRIORITY,
    "true",
    "'sshd'",
)
_format_case("GitLab", f"concat({_ISO_T}, '.123456Z 01O ', {_SAID})", _INFERRED, "false", rules=True)

# The other layouts of formats that have several. Compact HDFS lines have no candidate: they need the format set.
_format_case("Log4j", f"concat({_ISO}, ',123 - WARN  [main:Q[a[1]]@12] - ', {_SAID})", "'Warn'", "true", "'main:Q[a[1]]@12'", layout="_dash")
_format_case("Log4j", f"concat('nova-api.log.1 ', {_ISO}, '.008 25746 INFO nova.osapi [req-', event_id, ' - -] ', {_SAID})", "'Info'", "true", "'nova.osapi'", layout="_file")
_format_case("SparkHDFS", f"concat({_D('yyMMdd HHmmss')}, ' 148 INFO dfs.Data: ', {_SAID})", "'Info'", "true", "'dfs.Data'", layout="_compact", pinned="SparkHDFS")
_format_case("IISW3C", f"concat({_ISO}, ' GET /index - ', {_STATUS})", _STATUS_LEVEL, "true", "'IIS'", template="'GET /index - <*>'", layout="_method")
_format_case("RFC5424", f"concat('<', 8 + event_id % 8, '>1 ', {_ISO_T}, 'Z host1 api 77 ID4 [ex@1 a=\"b\" c=\"', user_id, '\"] ', {_SAID})", _PRIORITY, "true", "'api'", layout="_data")
_format_case(
    "CLF",
    f"concat('10.0.0.1 - - [', {_D('dd/MMM/yyyy:HH:mm:ss')}, ' ', if(event_id % 2 = 0, '+0230', '-0800'), '] \"GET /u/', user_id, ' \\\\\"q\\\\\" HTTP/1.1\" ', {_STATUS}, ' 512')",
    _STATUS_LEVEL,
    "true",
    host="'10.0.0.1'",
    template="'GET /u/<*> <*>'",
    ns=f"{_NS} + CASE event_id % 2 WHEN 0 THEN -9000 ELSE 28800 END::BIGINT * 1000000000",
    layout="_zone",
)


@query(
    "format_detect_batch",
    "SELECT event_type AS stream_id, CASE event_type WHEN 'error' THEN 'RFC5424' WHEN 'click' THEN 'KeyValue' WHEN 'view' THEN 'JSON' ELSE 'RawText' END AS format FROM events GROUP BY event_type",
)
def format_detect_batch(spark, sf_dir):
    line = (
        f"CASE event_type WHEN 'error' THEN concat('<11>1 ', {_ISO_T}, 'Z h a 1 2 - x') WHEN 'click' THEN concat('a=', user_id, ' b=2 c=3') "
        "WHEN 'view' THEN concat('{\"a\":', user_id, '}') ELSE 'plain words' END"
    )
    return canonical.detect_formats(event_lines(spark, sf_dir, line, "event_type"))


# --- order within a stream


@query(
    "stream_ids",
    "SELECT event_type AS stream_id, event_id AS line_no, CASE WHEN event_id % 5 <> 0 THEN (sum(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) - 1)::BIGINT ELSE -1 END AS id FROM events",
)
def stream_ids(spark, sf_dir):
    """Every fifth line is blank and has no event."""
    rows = event_lines(spark, sf_dir, f"CASE WHEN event_id % 5 = 0 THEN ' ' ELSE {_SAID} END", "event_type")
    return canonical.canonicalize(rows, mode="stream").select("stream_id", "line_no", F.coalesce("id", F.lit(-1)).alias("id"))


@query(
    "stream_ids_window",
    "SELECT event_type AS stream_id, event_id AS line_no, CASE WHEN event_id % 5 <> 0 THEN (sum(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) - 1)::BIGINT ELSE -1 END AS id FROM events",
)
def stream_ids_window(spark, sf_dir):
    """The same from events read without state: a running count behind them."""
    rows = event_lines(spark, sf_dir, f"CASE WHEN event_id % 5 = 0 THEN ' ' ELSE {_SAID} END", "event_type")
    events = canonical.canonicalize(rows)
    has = F.col("no_event_reason").isNull()
    running = F.sum(has.cast("long")).over(Window.partitionBy("stream_id").orderBy("line_no")) - 1
    return events.select("stream_id", "line_no", F.when(has, running).otherwise(-1).alias("id"))


@query(
    "stream_yearless",
    f"SELECT event_id AS line_no, {_NS} AS timestamp_ns FROM events",
)
def stream_yearless(spark, sf_dir):
    """A stream alternates dated lines with BSD stamps, whose year follows from the line before."""
    line = f"CASE WHEN event_id % 2 = 0 THEN concat({_ISO_T}, 'Z web01 app: ', {_SAID}) ELSE concat({_BSD}, ' web01 app: ', {_SAID}) END"
    rows = event_lines(spark, sf_dir, line, "event_id div 2", "event_id")
    return canonical.canonicalize(rows, mode="stream").select("line_no", "timestamp_ns")


def _yearless_case(name: str, line: str, ns: str):
    """A stream alternates dated lines with stamps without a year, which follows from the line before."""

    def run(spark, sf_dir):
        dated = f"CASE WHEN event_id % 2 = 0 THEN concat({_ISO_T}, 'Z web01 app: ', {_SAID}) ELSE {line} END"
        events = canonical.canonicalize(event_lines(spark, sf_dir, dated, "event_id div 2", "event_id"), mode="stream")
        return events.select("line_no", "format", "timestamp_ns")

    first = "CASE WHEN event_id % 2 = 0 THEN 'Syslog' ELSE"
    query(f"stream_{name.lower()}", f"SELECT event_id AS line_no, {first} '{name}' END AS format, CASE WHEN event_id % 2 = 0 THEN {_NS} ELSE {ns} END AS timestamp_ns FROM events")(run)


_yearless_case("AndroidLogcat", f"concat({_D('MM-dd HH:mm:ss')}, '.123  12  34 W Radio: ', {_SAID})", f"{_NS} + 123000000")
_yearless_case("Proxifier", f"concat('[', {_D('MM.dd HH:mm:ss')}, '] chrome.exe - ', {_SAID})", _NS)


@query("stream_pinned", "SELECT event_id AS line_no, 'JSON' AS format FROM events")
def stream_pinned(spark, sf_dir):
    """A format that is set holds for every line, also where a line by itself would go elsewhere."""
    rows = event_lines(spark, sf_dir, "concat('{\"logGroup\":\"g\",\"message\":\"m', event_id, '\"}')")
    return canonical.canonicalize(rows, pinned="JSON").select("line_no", "format")


@query("stable_lines", "SELECT event_id AS line_no, 'x' || chr(27) || '[0m <*>' AS template_str, 'x' || chr(27) || '[0m ' || user_id AS content FROM events")
def stable_lines(spark, sf_dir):
    """Lines that are stable already keep their escapes."""
    rows = event_lines(spark, sf_dir, "concat('x', char(27), '[0m ', user_id)")
    return canonical.canonicalize(rows, normalize=False).select("line_no", "template_str", "content")


@query(
    "stream_split",
    f"""SELECT event_id AS line_no, CASE WHEN event_id % 5 <> 0 THEN (sum(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) - 1)::BIGINT ELSE -1 END AS id,
CASE WHEN event_id % 5 <> 0 THEN {_NS} ELSE -1 END AS timestamp_ns FROM events""",
)
def stream_split(spark, sf_dir):
    """One stream of all lines, cut in chunks that are read in parallel; the first line of each ten has a year."""
    line = f"CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 10 = 1 THEN concat({_ISO_T}, 'Z web01 app: ', {_SAID}) ELSE concat({_BSD}, ' web01 app: ', {_SAID}) END"
    events = canonical.canonicalize(event_lines(spark, sf_dir, line), mode="split", chunk_lines=1000)
    return events.select("line_no", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("id", "timestamp_ns")])


@query(
    "stream_sticky",
    "SELECT event_id AS line_no, CASE WHEN event_id % 2 = 0 THEN 'JSON' ELSE 'JSON' END AS format, 'm' AS content FROM events",
)
def stream_sticky(spark, sf_dir):
    """A stream that begins as plain records keeps to them where a line alone would go elsewhere."""
    line = """CASE WHEN event_id % 2 = 0 THEN '{"message":"m"}' ELSE '{"logGroup":"g","message":"m"}' END"""
    rows = event_lines(spark, sf_dir, line, "event_id div 2", "event_id")
    return canonical.canonicalize(rows, mode="stream").select("line_no", "format", "content")


@query(
    "stream_counters",
    """SELECT event_type AS stream_id, count(*) FILTER (WHERE event_id % 7 > 1) AS parsed, count(*) FILTER (WHERE event_id % 7 = 1) AS failed,
count(*) FILTER (WHERE event_id % 7 = 0) AS skipped, count(*) FILTER (WHERE event_id % 7 > 1) AS events, count(*) FILTER (WHERE event_id % 7 = 2) AS empty_projections
FROM events GROUP BY event_type""",
)
def stream_counters(spark, sf_dir):
    line = (
        "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '{\"resourceSpans\":[]}' "
        f"WHEN 2 THEN concat({_D('yyyyMMdd-H:m:s')}, ':42|Step|300|') ELSE {_SAID} END"
    )
    return canonical.counters(canonical.canonicalize(event_lines(spark, sf_dir, line, "event_type")))


@query(
    "context_carry",
    """SELECT event_type AS stream_id, event_id, coalesce(last_value(CASE WHEN event_id % 10 = 0 THEN user_id END IGNORE NULLS)
OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS context FROM events""",
)
def context_carry(spark, sf_dir):
    """A declared value holds for the lines behind it: each tenth event declares a pull request."""
    events = table(spark, sf_dir, "events")
    declared = events.where("event_id % 10 = 0 AND user_id IS NOT NULL").select(
        F.col("event_type").alias("stream_id"), F.col("event_id").alias("line_no"), F.create_map(F.lit("pull_request"), F.col("user_id").cast("string")).alias("context")
    )
    lines = event_lines(spark, sf_dir, "concat('merged PR#', user_id)", "event_type")
    carried = canonical.canonicalize(lines, all_rules(), Declaration("github"), mode="split", contexts=declared)
    value = F.coalesce(F.col("context")["pull_request"].cast("long"), F.lit(-1))
    return carried.select("stream_id", F.col("line_no").alias("event_id"), value.alias("context"))


# --- levels


@query(
    "level_cues",
    """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'Error' WHEN 1 THEN 'Warn' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Warn' WHEN 4 THEN 'Error' WHEN 5 THEN 'Unknown'
WHEN 6 THEN 'Fatal' WHEN 7 THEN 'Error' WHEN 8 THEN 'Error' ELSE 'Unknown' END AS level FROM events""",
)
def level_cues(spark, sf_dir):
    said = (
        "connection refused by peer",
        "warning: low disk",
        "no problems here at all",
        "3 failed checks of all",
        "ValueError: bad input",
        "0 failed",
        "[CRITICAL] core is hot",
        "ERROR something odd",
        "segmentation fault in worker",
        "ok 4 tests, none failed",
    )
    line = "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(said)) + " END"
    return canonical.canonicalize(event_lines(spark, sf_dir, line)).select(F.col("line_no").alias("event_id"), "level")


@query(
    "level_numbers",
    """SELECT event_id, CASE WHEN event_id % 600 >= 500 THEN 'Error' WHEN event_id % 600 >= 400 THEN 'Warn' WHEN event_id % 600 >= 200 THEN 'Info' ELSE 'Unknown' END AS of_status,
CASE least(5, greatest(0, floor((event_id % 30 - 1) / 4)))::INT WHEN 0 THEN 'Trace' WHEN 1 THEN 'Debug' WHEN 2 THEN 'Info' WHEN 3 THEN 'Warn' WHEN 4 THEN 'Error' ELSE 'Fatal' END AS of_severity,
CASE event_id % 10 WHEN 0 THEN 'Fatal' WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Fatal' WHEN 3 THEN 'Error' WHEN 4 THEN 'Warn' WHEN 5 THEN 'Info' WHEN 6 THEN 'Info' WHEN 7 THEN 'Debug' ELSE 'Unknown' END AS of_priority,
CASE event_type WHEN 'error' THEN 'Error' ELSE 'Unknown' END AS of_word FROM events""",
)
def level_numbers(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        columns.status_column(n % 600).alias("of_status"),
        columns.severity_number_column(n % 30).alias("of_severity"),
        columns.priority_column(n % 10).alias("of_priority"),
        columns.level_word_column(F.upper("event_type")).alias("of_word"),
    )


@query(
    "level_positions",
    """WITH p AS (SELECT CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE NULL END AS position FROM events), c AS (SELECT position, count(*) AS n FROM p WHERE position IS NOT NULL GROUP BY 1)
SELECT position::BIGINT AS position, n, sum(n) OVER (ORDER BY position) / (sum(n) OVER ()) AS share FROM c""",
)
def level_positions(spark, sf_dir):
    return reports.level_positions(event_lines(spark, sf_dir, "CASE event_id % 3 WHEN 0 THEN 'info all good' WHEN 1 THEN 'then came warning here' ELSE 'none' END"))


# --- vocabularies

_CI = "element_at(array('##[group]Build', '::endgroup::', '##[error]bad', '##[warning]odd', '::notice::so', 'Received 5 of 10 (50.0%), 1.5 MBs/sec', '##[error]The operation was canceled.', 'plain'), cast(event_id % 8 as int) + 1)"


@query(
    "dialect_roles",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'GroupBegin' WHEN 1 THEN 'GroupEnd' WHEN 2 THEN 'Terminator' WHEN 5 THEN 'Progress' WHEN 6 THEN 'Terminator' ELSE 'None' END AS role,
CASE event_id % 8 WHEN 2 THEN 'Error' WHEN 3 THEN 'Warn' WHEN 4 THEN 'Info' WHEN 6 THEN 'Error' END AS lifted, event_id % 8 = 6 AS stops FROM events""",
)
def dialect_roles(spark, sf_dir):
    view, content = all_rules().for_stream("github"), F.expr(_CI)
    events = table(spark, sf_dir, "events")
    return events.select("event_id", columns.role_column(content, view).alias("role"), columns.lift_column(content, view).alias("lifted"), columns.stop_column(content, view).alias("stops"))


@query(
    "dialect_events",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'GroupBegin' WHEN 1 THEN 'GroupEnd' WHEN 2 THEN 'Terminator' WHEN 5 THEN 'Progress' WHEN 6 THEN 'Terminator' ELSE 'None' END AS structural_role,
CASE event_id % 8 WHEN 2 THEN 'Error' WHEN 3 THEN 'Warn' WHEN 4 THEN 'Info' WHEN 6 THEN 'Error' ELSE 'Unknown' END AS level, event_id % 8 IN (2, 3, 4, 6) AS declared_level FROM events""",
)
def dialect_events(spark, sf_dir):
    events = canonical.canonicalize(event_lines(spark, sf_dir, _CI), all_rules(), Declaration("github"))
    return events.select(F.col("line_no").alias("event_id"), "structural_role", "level", "declared_level")


@query(
    "echoed_source",
    "SELECT event_id, event_id % 2 = 0 AS echoed_source, CASE WHEN event_id % 2 = 0 THEN 'Unknown' ELSE 'Error' END AS level, 'ERROR in ' || event_type AS content FROM events",
)
def echoed_source(spark, sf_dir):
    line = "concat(if(event_id % 2 = 0, concat(char(27), '[36;1m'), ''), 'ERROR in ', event_type, if(event_id % 2 = 0, concat(char(27), '[0m '), ''))"
    events = canonical.canonicalize(event_lines(spark, sf_dir, line), all_rules())
    return events.select(F.col("line_no").alias("event_id"), "echoed_source", "level", F.rtrim("content").alias("content"))


@query(
    "outcome_tokens",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' WHEN 'view' THEN 'CANCELLED' WHEN 'signup' THEN 'UNKNOWN' END AS outcome,
event_type = 'error' AND event_id % 2 = 0 AS regressed FROM events""",
)
def outcome_tokens(spark, sf_dir):
    token = F.expr("CASE event_type WHEN 'click' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'view' THEN 'cancelled' WHEN 'signup' THEN 'skipped' ELSE 'done' END")
    outcome = columns.outcome_column(token, all_rules().for_stream("github"))
    before = F.when(F.col("event_id") % 2 == 0, "SUCCESS").otherwise("CANCELLED")
    return table(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"), columns.regressed_column(before, outcome).alias("regressed"))


@query(
    "run_outcomes",
    """WITH l AS (SELECT (event_id % 50)::VARCHAR AS stream_id, event_id, CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'purchase' THEN 'SUCCESS' END AS o FROM events),
c AS (SELECT stream_id, arg_max(o, event_id) FILTER (WHERE o IS NOT NULL) AS c FROM l GROUP BY stream_id)
SELECT stream_id, CASE WHEN stream_id::INT < 10 THEN 'UNSTABLE' ELSE coalesce(c, 'UNKNOWN') END AS outcome, coalesce(c, 'UNKNOWN') AS console, stream_id::INT < 10 AS authoritative,
stream_id::INT < 10 AND c IS NOT NULL AS divergent, '' AS note FROM c""",
)
def run_outcomes(spark, sf_dir):
    line = "CASE event_type WHEN 'error' THEN 'Finished: FAILURE' WHEN 'purchase' THEN concat('x', char(13), 'Finished: SUCCESS') ELSE 'Finished: not yet' END"
    rows = event_lines(spark, sf_dir, line, "event_id % 50")
    return reports.run_outcomes(rows, all_rules(), Declaration("jenkins"), {str(k): ("jenkins", "UNSTABLE") for k in range(10)})


@query("run_outcomes_table", ORACLE_SQL["run_outcomes"])
def run_outcomes_table(spark, sf_dir):
    """run_outcomes() with declarations and side inputs as tables, joined by stream."""
    line = "CASE event_type WHEN 'error' THEN 'Finished: FAILURE' WHEN 'purchase' THEN concat('x', char(13), 'Finished: SUCCESS') ELSE 'Finished: not yet' END"
    rows = event_lines(spark, sf_dir, line, "event_id % 50")
    streams = rows.select("stream_id").distinct()
    said = streams.selectExpr("stream_id", "'jenkins' AS dialect", "CAST(NULL AS string) AS channel", "CAST(NULL AS array<string>) AS transports", "CAST(NULL AS map<string,string>) AS context")
    side = streams.where("CAST(stream_id AS int) < 10").selectExpr("stream_id", "'jenkins' AS vocabulary", "'UNSTABLE' AS token")
    return reports.run_outcomes(rows, all_rules(), said, side)


@query(
    "units",
    """SELECT event_id, 'Step' AS kind, CASE event_id % 2 WHEN 0 THEN 'build v' || user_id || '.' || (event_id % 7) || ' (x)' ELSE 'tool@v' || user_id END AS name,
CASE event_id % 2 WHEN 0 THEN 'build vX (M)' ELSE 'tool@vX' END AS unit_class,
CASE event_id % 2 WHEN 0 THEN 'v' || user_id || '.' || (event_id % 7) || ' (x)' ELSE 'v' || user_id END AS discriminant,
CASE event_id % 2 WHEN 0 THEN '' ELSE 'v' || user_id END AS version FROM events WHERE event_id % 3 <> 0""",
)
def units(spark, sf_dir):
    line = "CASE WHEN event_id % 3 = 0 THEN 'nothing' WHEN event_id % 2 = 0 THEN concat('##[group]Run build v', user_id, '.', event_id % 7, ' (x)') ELSE concat('##[group]Run tool@v', user_id) END"
    declaration = Declaration("github", "annotated")
    rules = all_rules()
    found = reports.units(canonical.canonicalize(event_lines(spark, sf_dir, line), rules, declaration), rules.for_stream("github", "annotated"))
    return found.select(F.col("line_no").alias("event_id"), "kind", "name", "unit_class", "discriminant", "version")


@query(
    "unit_edges",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Job' WHEN 1 THEN 'Step' ELSE 'None' END AS opens, event_id % 3 = 2 AS closes FROM events",
)
def unit_edges(spark, sf_dir):
    content = F.expr("element_at(array('Current runner version: 2', 'Prepare all required actions', 'Post job cleanup.'), cast(event_id % 3 as int) + 1)")
    view = all_rules().for_stream("github", "annotated")
    return table(spark, sf_dir, "events").select("event_id", columns.opener_column(content, view).alias("opens"), columns.closer_column(content, view).alias("closes"))


@query("unit_ends", "SELECT event_id, 'InnerStep' AS kind, event_type AS outcome, 'success' AS propagated FROM events")
def unit_ends(spark, sf_dir):
    rules, declaration = all_rules(), Declaration("github", "annotated")
    events = canonical.canonicalize(event_lines(spark, sf_dir, "concat('##[end-action id=a;outcome=', event_type, ';conclusion=success]')"), rules, declaration)
    return reports.unit_ends(events, rules.for_stream("github", "annotated")).select(F.col("line_no").alias("event_id"), "kind", "outcome", "propagated")


@query(
    "unit_classes",
    r"""SELECT c_custkey, 'Customer#' || regexp_extract(c_name, '[0-9]+') AS name, CASE WHEN length(regexp_extract(c_name, '[0-9]+')) >= 2 THEN 'Customer#N (M) vX' ELSE 'Customer#' || regexp_extract(c_name, '[0-9]+') || ' (M) vX' END AS unit_class FROM customer""",
)
def unit_classes(spark, sf_dir):
    name = F.concat(F.lit("Customer#"), F.regexp_extract("c_name", "[0-9]+", 0))
    shown = F.concat(name, F.lit(" (try 3) v"), F.col("c_nationkey").cast("string"), F.lit(".1 "))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), unit_class_column(shown).alias("unit_class"))


@query("test_locations", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'src/app.spec.ts' WHEN 1 THEN 'tests/test_' || event_type || '.py' WHEN 2 THEN './pkg/x_test.go' ELSE '' END AS component FROM events")
def test_locations(spark, sf_dir):
    line = "element_at(array('at (src/app.spec.ts:5:3)', concat('in tests/test_', event_type, '.py now'), 'ran ./pkg/x_test.go', 'src/app.ts'), cast(event_id % 4 as int) + 1)"
    return canonical.canonicalize(event_lines(spark, sf_dir, line), all_rules(), test_where=True).select(F.col("line_no").alias("event_id"), "component")


# --- masking

_MASKED = {
    "addresses": ("concat('client 10.0.', event_id % 256, '.7:80 and [2001:db8::', lower(hex(1 + event_id % 255)), ']:443 up')", "'client <*> and <*> up'"),
    "composites": (
        "concat('at core/x.cc:', event_id, ':7 in /tmp/run-', user_id, '/a ==', event_id, '==ERROR Build#', event_id, ' #', user_id, ' $', user_id, '.50 item[', event_id, '] id=', user_id)",
        "'at core/x.cc:<*>:<*> in /tmp/<*> ==<*>==ERROR Build#' || event_id || ' #<*> $<*> item[<*>] id=<*>'",
    ),
    "identities": ("concat('run ', uuid_, ' of ', md5(cast(user_id as string)), ' obj-', md5(cast(user_id as string)), ' (', user_id, '),')", "'run <*> of <*> obj-<*> <*>'"),
    "status_kept": ("concat('exit code ', event_id % 1000, ' then status (', event_id % 7, '), took ', event_id, 'ms')", "'exit code ' || (event_id % 1000) || ' then status (' || (event_id % 7) || '), took <*>'"),
    "json_order": ("concat('{\"b\": ', event_id % 3, ', \"a\": \"', event_type, '\"}')", "'{\"a\": \"' || event_type || '\", \"b\": <*>'"),
}
_MASKED |= {
    "versions": ("concat('uses pkg/core/', event_id, '.2.', user_id, ' at [', stamp_, 'Z] now')", "'uses pkg/core/<*> at [<*>] now'"),
    "roots": (
        "concat('in /var/tmp/x', event_id, '/y /var/folders/a', event_id, '/c /private/var/folders/q/z', event_id, ' /private/tmp/k', user_id, ' /nix/store/a', event_id, '-x/bin/sh h/.conan2/p/b/a', event_id, '/x n/global/v11/a', event_id, '/x')",
        "'in /var/tmp/<*> /var/folders/<*> /private/var/folders/<*> /private/tmp/<*> /nix/store/<*>/bin/sh h/.conan2/p/b/<*>/x n/global/v11/<*>/x'",
    ),
    "temp_folder": ("concat('wrote C:', char(92), 'Users', char(92), 'me', char(92), 'AppData', char(92), 'Local', char(92), 'Temp', char(92), 'x', event_id)", "'wrote C:\\Users\\me\\AppData\\Local\\Temp\\<*>'"),
    "hardware": (
        "concat('mac 00:1a:2b:3c:4d:', lower(lpad(hex(event_id % 256), 2, '0')), ' and 001a.2b3c.', lower(lpad(hex(event_id % 65536), 4, '0')), ' or 00-1a-2b-3c-4d-', lower(lpad(hex(event_id % 256), 2, '0')), ' up')",
        "'mac <*> and <*> or <*> up'",
    ),
    "segments": ("concat('set a=', event_id, ';b=', user_id, ';c=', event_type, ' done')", "'set a=<*>;b=<*>;c=' || event_type || ' done'"),
}
_UUID = "regexp_replace(md5(cast(event_id as string)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')"


def _mask_case(name: str, line: str, template: str):
    def run(spark, sf_dir):
        rows = event_lines(spark, sf_dir, line.replace("uuid_", _UUID).replace("stamp_", _STAMP))
        return canonical.canonicalize(rows, pinned="none").select(F.col("line_no").alias("event_id"), "template_str", F.size("params").cast("long").alias("n_params"))

    count = "len(list_filter(string_split(template_str, ' '), lambda x: x = '<*>'))"
    query(f"mask_{name}", f"WITH t AS (SELECT event_id, {template} AS template_str FROM events) SELECT *, {count} AS n_params FROM t")(run)


for _name, (_line, _template) in _MASKED.items():
    _mask_case(_name, _line, _template)


@query(
    "mask_declared",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'merge PR-<*> into refs/heads/<*>' WHEN 1 THEN 'see pull/<*> of run <*>' ELSE 'Runner name: ''<*>''' END AS template_str FROM events",
)
def mask_declared(spark, sf_dir):
    line = "element_at(array('merge PR-4711 into refs/heads/fix-it', 'see pull/47110 of run 12345678901', 'Runner name: \\'box 7\\''), cast(event_id % 3 as int) + 1)"
    rows = event_lines(spark, sf_dir, line, "if(event_id % 3 = 1, 'b', 'a')")
    said = {k: Declaration("github", context=(("pull_request", n), ("head_ref", "fix-it"), ("run_id", "12345678901"))) for k, n in (("a", "4711"), ("b", "47110"))}
    return canonical.canonicalize(rows, all_rules(), said).select(F.col("line_no").alias("event_id"), "template_str")


@query(
    "mask_declared_table",
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'merge PR-<*> into main' ELSE 'merge PR-' || (10000 + user_id) || ' into main' END AS template_str FROM events""",
)
def mask_declared_table(spark, sf_dir):
    """A stream to each user; a table joined by stream declares a value for those of even id."""
    rows = event_lines(spark, sf_dir, "concat('merge PR-', 10000 + user_id, ' into main')", "user_id")
    context = F.create_map(F.lit("pull_request"), (F.col("user_id") + 10000).cast("string"))
    said = table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("stream_id")).distinct().withColumn("user_id", F.col("stream_id"))
    said = said.select("stream_id", F.lit("github").alias("dialect"), F.lit("").alias("channel"), F.array().cast("array<string>").alias("transports"), context.alias("context"))
    return canonical.canonicalize(rows, all_rules(), said).select(F.col("line_no").alias("event_id"), "template_str")


# --- records and telemetry


@query(
    "record_ordinals",
    """SELECT event_id, 'latency_ms' AS field_name, 'dur-log2-ns-v1' AS schedule, event_id * 1000000 + 500000 AS value FROM events
UNION ALL SELECT event_id, 'size_bytes', 'size-log2-bytes-v1', json_extract(props, '$.k')::BIGINT FROM events""",
)
def record_ordinals(spark, sf_dir):
    line = "concat('{\"latency_ms\":', event_id, '.5,', '\"size_bytes\":', get_json_object(props, '$.k'), ',\"message\":\"m\"}')"
    events = canonical.canonicalize(event_lines(spark, sf_dir, line))
    return events.select(F.col("line_no").alias("event_id"), F.inline("ordinals"))


@query(
    "record_roleless",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'foo' ELSE '' END AS no_role_witness_key FROM events",
)
def record_roleless(spark, sf_dir):
    line = "if(event_id % 2 = 0, concat('{\"foo\":', event_id, '}'), concat('{\"foo\":', event_id, ',\"message\":\"m\"}'))"
    return canonical.canonicalize(event_lines(spark, sf_dir, line)).select(F.col("line_no").alias("event_id"), "no_role_witness_key")


@query(
    "telemetry_logs",
    "SELECT event_id, (epoch_us(ts) // 1000000) * 1000000000 + event_id % 1000 AS timestamp_ns, true AS declared_timestamp, CASE event_id % 2 WHEN 0 THEN 'Info' ELSE 'Error' END AS level, 'took <*>' AS template_str FROM events",
)
def telemetry_logs(spark, sf_dir):
    line = (
        f"concat('{{\"timeUnixNano\":\"', {_EPOCH}, lpad(event_id % 1000, 9, '0'), '\",\"severityNumber\":', 9 + 8 * (event_id % 2), ',\"body\":{{\"stringValue\":\"took ', event_id, 'ms\"}}}}')"
    )
    return canonical.canonicalize(event_lines(spark, sf_dir, line)).select(F.col("line_no").alias("event_id"), "timestamp_ns", "declared_timestamp", "level", "template_str")


_SPAN = (
    "concat('{\"traceId\":\"', md5(cast(user_id as string)), '\",\"spanId\":\"s', event_id, '\",\"name\":\"op\",\"kind\":2,\"startTimeUnixNano\":\"1700000000000000000\",\"endTimeUnixNano\":\"', "
    "1700000000000000000 + event_id, '\",\"status\":{\"code\":', if(event_type = 'error', 2, 1), '},\"links\":[{\"spanId\":\"x\"}]}')"
)
_EXPORT = f"concat('{{\"resourceSpans\":[{{\"resource\":{{\"attributes\":[{{\"key\":\"service.name\",\"value\":{{\"stringValue\":\"shop\"}}}}]}},\"scopeSpans\":[{{\"spans\":[', {_SPAN}, ',', {_SPAN}, ']}}]}}]}}')"


@query(
    "telemetry_spans",
    """SELECT event_id, s.k::BIGINT AS sub_no, 'shop' AS component, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Info' END AS level, 'op' AS template_str, event_id AS duration_ns, true AS is_span, 1::BIGINT AS n_links
FROM events, (SELECT unnest([0, 1]) AS k) s""",
)
def telemetry_spans(spark, sf_dir):
    records = canonical.unpack_exports(event_lines(spark, sf_dir, _EXPORT))
    flat = records.select("stream_id", (F.col("line_no") * 2 + F.col("sub_no")).alias("line_no"), "raw")
    e = canonical.canonicalize(flat)
    number = F.col("line_no")
    duration = F.element_at("ordinals", 1)["value"].alias("duration_ns")
    links = F.size("linked_span_ids").cast("long").alias("n_links")
    return e.select((F.floor(number / 2)).alias("event_id"), (number % 2).alias("sub_no"), "component", "level", "template_str", duration, F.col("trace.is_span").alias("is_span"), links)


@query("telemetry_ids")
def telemetry_ids(spark, sf_dir):
    """64-bit FNV ids of traces, which SQL has no wrapping arithmetic for; tests hold them to known values."""
    events = canonical.canonicalize(event_lines(spark, sf_dir, _SPAN))
    return events.select(F.col("line_no").alias("event_id"), "trace.trace_id", "trace.span_id")


# --- projection and digests


@query(
    "projection",
    f"""SELECT event_id::VARCHAR AS line_no, 'user <*> did ' || event_type AS template_str, '1|' || user_id AS params, '0,0,0,0,0,0' AS trace, '0' AS ordinals, '' AS timestamp_ns, {_INFERRED} AS level, '' AS id FROM events""",
)
def projection(spark, sf_dir):
    p = canonical.projection(canonical.canonicalize(event_lines(spark, sf_dir, _SAID)))
    return p.select(F.col("line_no").cast("string").alias("line_no"), "template_str", "params", "trace", "ordinals", "timestamp_ns", "level", "id")


_CELLS_SQL = f"""SELECT event_type AS stream_id, event_id, {{'id': (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::VARCHAR, 'timestamp_ns': '', 'declared_timestamp': '0', 'level': {_INFERRED},
'declared_level': '0', 'format': 'RawText', 'component': '', 'host': '', 'template_str': {_SAID_T}, 'params': '1|' || user_id, 'structural_role': 'None', 'trace': '0,0,0,0,0,0', 'ordinals': '0', 'linked_span_ids': '0',
'echoed_source': '0', 'no_role_witness_key': ''}} AS cells FROM events"""


@query(
    "projection_digests",
    f"""WITH c AS ({_CELLS_SQL}), m AS (SELECT stream_id, event_id, unnest(map_entries(MAP(['id', 'timestamp_ns', 'declared_timestamp', 'level', 'declared_level', 'format', 'component', 'host', 'template_str', 'params',
'structural_role', 'trace', 'ordinals', 'linked_span_ids', 'echoed_source', 'no_role_witness_key'], [cells.id, cells.timestamp_ns, cells.declared_timestamp, cells.level, cells.declared_level, cells.format, cells.component,
cells.host, cells.template_str, cells.params, cells.structural_role, cells.trace, cells.ordinals, cells.linked_span_ids, cells.echoed_source, cells.no_role_witness_key]))) AS e FROM c)
SELECT stream_id, e.key AS member, substr(sha256(string_agg(e.value || chr(10), '' ORDER BY event_id)), 1, 32) AS digest, count(*) AS events FROM m GROUP BY ALL""",
)
def projection_digests(spark, sf_dir):
    """A digest of each member over a stream's rows in order; tests hold it to hashlib."""
    return reports.digests(canonical.projection(canonical.canonicalize(event_lines(spark, sf_dir, _SAID, "event_type"), mode="stream")))


@query(
    "template_ids",
    "SELECT o_orderkey, 'h:' || substr(sha256(o_orderpriority), 1, 32) AS template_id FROM orders",
)
def template_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", canonical.template_ids(F.col("o_orderpriority")).alias("template_id"))


_WORDS_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS lines, count(*) FILTER (WHERE trim(line, ' ' || chr(9) || chr(13)) = '') AS skipped FROM l"""


@query("document_lines", _WORDS_SQL)
def document_lines(spark, sf_dir):
    """Every line of every text through the kernel: how many there are, and how many are blank."""
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").cast("string").alias("stream_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    events = canonical.canonicalize(rows)
    return events.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("no_event_reason").isNotNull()).alias("skipped"))


@query("projection_digests_by_arm")
def projection_digests_by_arm(spark, sf_dir):
    """Digests of the same lines with no rules, and under each CI dialect; tests hold digests to hashlib."""
    rules = all_rules()
    arms = {"plain": (NO_RULES, Declaration()), "undeclared": (rules, Declaration())}
    arms |= {"github": (rules, Declaration("github", "annotated", ("api-rfc3339-line-prefix",))), "gitlab": (rules, Declaration("gitlab")), "jenkins": (rules, Declaration("jenkins"))}
    line = f"concat({_ISO_T}, '.1234567Z ', {_CI})"
    return reports.arm_digests(event_lines(spark, sf_dir, line, "event_type"), arms)


@query(
    "template_runs",
    """WITH t AS (SELECT event_id % 2 AS run, 'user <*> did ' || event_type || CASE WHEN event_id % 14 = 7 THEN ' again' ELSE '' END AS template_str FROM events)
SELECT template_str, count(*) FILTER (WHERE run = 0) AS n_before, count(*) FILTER (WHERE run = 1) AS n_after FROM t GROUP BY template_str""",
)
def template_runs(spark, sf_dir):
    """Two runs side by side: the events of even and of odd numbers, of which the odd ones alone say 'again'."""
    line = f"concat({_SAID}, if(event_id % 14 = 7, ' again', ''))"
    events = canonical.canonicalize(event_lines(spark, sf_dir, line, "event_id % 2"))
    return reports.compare_templates(events, "stream_id", "0", "1")


@query(
    "template_tail",
    "SELECT 'item <*> part ' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') AS template_str FROM part",
)
def template_tail(spark, sf_dir):
    """Templates that one line has."""
    line = "concat('item ', p_size, ' part ', translate(cast(p_partkey as string), '0123456789', 'abcdefghij'))"
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.lit("p").alias("stream_id"), F.col("p_partkey").alias("line_no"), F.expr(line).alias("raw"))
    return reports.singletons(canonical.canonicalize(rows)).select("template_str")


@query(
    "level_verdicts",
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'Error' WHEN 4 THEN 'Warn' ELSE 'Unknown' END AS level FROM events""",
)
def level_verdicts(spark, sf_dir):
    """Glyphs and leading verdicts against failure words, and a compiler's note beside its error."""
    line = (
        "CASE event_id % 5 WHEN 0 THEN concat('\u2713 handles error of ', event_type) WHEN 1 THEN concat('\u2717 page of ', event_type) WHEN 2 THEN concat('PASS error handler ', event_type) "
        "WHEN 3 THEN concat('x.cc:', event_id, ': note: error was here') ELSE concat('x.cc:', event_id, ': error: bad') END"
    )
    return canonical.canonicalize(event_lines(spark, sf_dir, line)).select(F.col("line_no").alias("event_id"), "level")
