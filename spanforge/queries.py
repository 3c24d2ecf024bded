"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as a
from .operators import insight as i
from .operators import preview
from .operators import traces as t
from .operators import viewers as v
from .oracle import ENTRIES, NOW_MS, SPANS, SUMMARIES
from .plans import dialect
from .sources import calls, landing, otlp
from .streaming import live

DAY = 86_400_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name with the SQL that gives the same rows."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


# --- dialect ---

_DIALECT = {
    "q_select_star": ("SELECT * FROM logs", "SELECT CAST(ms AS DOUBLE) AS observed_at_ms, signal, service_name, duration_ms FROM entries WHERE signal = 'logs' ORDER BY ms, seq LIMIT 10000"),
    "q_count_star": ("SELECT count(*) FROM traces", "SELECT CAST(count(*) AS DOUBLE) AS \"count(*)\" FROM entries WHERE signal = 'traces'"),
    "q_group_by_service": (
        "SELECT service_name, count(*) AS n FROM logs GROUP BY service_name",
        "SELECT service_name, CAST(count(*) AS DOUBLE) AS n FROM entries WHERE signal = 'logs' GROUP BY service_name",
    ),
    "q_where_and_or": (
        "SELECT payload, duration_ms FROM traces WHERE (service_name = 'SVC-1' OR service_name = 'svc-2') AND duration_ms > 100 OR duration_ms <= '0.5' LIMIT 5000",
        "SELECT payload_text AS payload, duration_ms FROM entries WHERE signal = 'traces' AND (service_name IN ('svc-1', 'svc-2') AND duration_ms > 100 OR duration_ms <= 0.5) ORDER BY ms, seq LIMIT 5000",
    ),
    "q_like_ci": (
        "SELECT service_name, payload FROM metrics WHERE payload LIKE 'METRIC.P_rch%' AND service_name LIKE 'svc-_'",
        "SELECT service_name, payload_text AS payload FROM entries WHERE signal = 'metrics' AND payload_text ILIKE 'METRIC.P_rch%' AND service_name LIKE 'svc-_' ORDER BY ms, seq LIMIT 10000",
    ),
    "q_null_ne": (
        "SELECT count(*) AS n FROM logs WHERE service_name != 'svc-3' AND duration_ms != 5",
        "SELECT CAST(count(*) AS DOUBLE) AS n FROM entries WHERE signal = 'logs' AND service_name IS DISTINCT FROM 'svc-3'",
    ),
    "q_count_col_nulls": (
        "SELECT signal, count(service_name) AS n, count(duration_ms) AS d FROM logs GROUP BY signal",
        "SELECT signal, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS d FROM entries WHERE signal = 'logs' GROUP BY signal",
    ),
    "q_sum_avg_min_max": (
        "SELECT service_name, sum(duration_ms) AS s, avg(duration_ms) AS a, min(duration_ms) AS lo, max(duration_ms) AS hi, sum(payload) AS none FROM traces GROUP BY service_name",
        "SELECT service_name, round(sum(duration_ms), 6) AS s, round(avg(duration_ms), 6) AS a, min(duration_ms) AS lo, max(duration_ms) AS hi, CAST(0 AS DOUBLE) AS none FROM entries WHERE signal = 'traces' GROUP BY service_name",
    ),
    "q_global_empty": (
        "SELECT count(*) AS n, sum(duration_ms) AS s, avg(duration_ms) AS a FROM traces WHERE service_name = 'nobody'",
        "SELECT CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS a",
    ),
    "q_group_limit": (
        "SELECT service_name, payload, count(*) AS n FROM traces GROUP BY service_name, payload LIMIT 7",
        "SELECT service_name, payload_text AS payload, CAST(count(*) AS DOUBLE) AS n FROM entries WHERE signal = 'traces' GROUP BY service_name, payload_text ORDER BY coalesce('s' || service_name, 'n') || chr(31) || ('s' || payload_text) LIMIT 7",
    ),
    "q_group_number_order": (
        "SELECT duration_ms, count(*) AS n FROM traces WHERE duration_ms < 3 GROUP BY duration_ms LIMIT 20",
        "SELECT duration_ms, CAST(count(*) AS DOUBLE) AS n FROM entries WHERE signal = 'traces' AND duration_ms < 3 GROUP BY duration_ms ORDER BY CASE WHEN duration_ms = floor(duration_ms) THEN CAST(CAST(duration_ms AS BIGINT) AS VARCHAR) ELSE CAST(duration_ms AS VARCHAR) END LIMIT 20",
    ),
    "q_group_without_aggregate": (
        "SELECT service_name FROM metrics GROUP BY service_name LIMIT 100",
        "SELECT service_name FROM entries WHERE signal = 'metrics' ORDER BY ms, seq LIMIT 100",
    ),
    "q_time_range": (
        "SELECT signal, count(*) AS n FROM traces WHERE observed_at_ms >= 1705000000000 AND observed_at_ms < '1706000000000' GROUP BY signal",
        "SELECT signal, CAST(count(*) AS DOUBLE) AS n FROM entries WHERE signal = 'traces' AND ms >= 1705000000000 AND ms < 1706000000000 GROUP BY signal",
    ),
    "q_text_order": (
        "SELECT payload, count(*) AS n FROM metrics WHERE payload > 'metric.d' AND service_name < 'svc-5' GROUP BY payload",
        "SELECT payload_text AS payload, CAST(count(*) AS DOUBLE) AS n FROM entries WHERE signal = 'metrics' AND payload_text > 'metric.d' AND service_name < 'svc-5' GROUP BY ALL",
    ),
}


def _rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order: six places are compared."""
    return df.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if c in ("s", "a", "value", "change_pct") and k == "double" else F.col(f"`{c}`") for c, k in df.dtypes))


def _dialect(text: str):
    return lambda spark, sf_dir: _rounded(dialect.plan(text, a.entries(spark, sf_dir)))


for _name, (_text, _sql) in _DIALECT.items():
    query(f"WITH {ENTRIES} {_sql}", _name)(_dialect(_text))


@query(f"WITH {ENTRIES} SELECT service_name, CAST(count(*) AS DOUBLE) AS n FROM entries WHERE signal = 'traces' AND ms > {NOW_MS} - {3 * DAY} GROUP BY service_name")
def q_lookback(spark, sf_dir):
    recent = v.within_lookback(a.entries(spark, sf_dir), 3 * DAY, a.NOW)
    return dialect.plan("SELECT service_name, count(*) AS n FROM traces GROUP BY service_name", recent)


@query(f"WITH {ENTRIES} SELECT entry_id, signal FROM entries WHERE signal = 'logs' AND (ms > 1704500000000 OR ms = 1704500000000 AND seq > 10) ORDER BY ms, seq LIMIT 500")
def s_read_since(spark, sf_dir):
    return v.read_since(a.entries(spark, sf_dir), "logs", (1704500000000, 10), 500).select("entry_id", "signal")


# --- viewers ---


def _viewer(body: dict, mask: int = 7, lookback: int = 30 * DAY) -> v.Viewer:
    return v.compile_viewer({"id": "v", "signal_mask": mask, "lookback_ms": lookback, "definition_json": body})


def _ids(body: dict, mask: int = 7, lookback: int = 30 * DAY):
    return lambda spark, sf_dir: v.matching(_viewer(body, mask, lookback), a.entries(spark, sf_dir), a.NOW).select("entry_id", "signal")


_IDS = f"WITH {ENTRIES} SELECT entry_id, signal FROM entries WHERE ms > {NOW_MS} - {{ms}} AND ({{where}})"
for _name, _body, _mask, _ms, _where in (
    ("v_query_substring", {"query": " SVC-3 "}, 7, 30 * DAY, "service_name LIKE '%svc-3%' OR lower(payload_text) LIKE '%svc-3%'"),
    ("v_filters_and", {"filters": [{"field": "service_name", "op": "eq", "value": "SVC-1"}, {"field": "payload", "op": "contains", "value": "VIEW"}]}, 7, 30 * DAY, "service_name = 'svc-1' AND payload_text LIKE '%view%'"),
    ("v_filters_or", {"filter_mode": "or", "filters": [{"field": "service_name", "op": "eq", "value": "svc-1"}, {"field": "payload", "op": "contains", "value": "purchase"}]}, 3, 30 * DAY, "signal <> 'logs' AND (service_name = 'svc-1' OR payload_text LIKE '%purchase%')"),
    ("v_filter_regex", {"query": "ignored", "filters": [{"field": "payload", "op": "regex", "value": r"error k=\d$"}]}, 4, 30 * DAY, "signal = 'logs' AND regexp_matches(payload_text, '^ERROR k=[0-9]$')"),
    ("v_lookback", {}, 6, 2 * DAY, "signal <> 'traces'"),
):
    query(_IDS.format(ms=_ms, where=_where), _name)(_ids(_body, _mask, _ms))


def _buckets_of(agg: v.Aggregation, entries: DataFrame, mask: int = 2) -> DataFrame:
    rows = v.aggregate(agg, v.matching(_viewer({}, mask), entries, a.NOW))
    return _rounded(rows.select("bucket_start_ms", F.array_join("group_keys", "|").alias("keys"), "value"))


def _buckets(agg: v.Aggregation, mask: int = 2):
    return lambda spark, sf_dir: _buckets_of(agg, a.entries(spark, sf_dir), mask)


_BUCKET = "WITH {e} SELECT CAST(ms - ms % {w} AS BIGINT) AS bucket_start_ms, {keys} AS keys, {value} AS value FROM entries WHERE signal = {signal} AND ms > {now} - {back} {more} GROUP BY ALL"


def _bucket_sql(value: str, keys: str = "''", signal: str = "'metrics'", more: str = "", width: int = 3_600_000) -> str:
    return _BUCKET.format(e=ENTRIES, w=width, keys=keys, value=value, signal=signal, now=NOW_MS, back=30 * DAY, more=more)


HOUR = 3_600_000
for _fn, _sql in (
    ("count", "CAST(count(*) AS DOUBLE)"), ("rate", "round(count(*) / 3600.0, 6)"), ("sum", "round(sum(value), 6)"), ("avg", "round(avg(value), 6)"),
    ("p50", "quantile_disc(value, 0.5)"), ("p95", "quantile_disc(value, 0.95)"), ("p99", "quantile_disc(value, 0.99)"),
):
    query(_bucket_sql(_sql), f"v_bucket_{_fn}")(_buckets(v.Aggregation(_fn, HOUR)))
_KEYS = "coalesce(service_name, 'unknown') || '|' || coalesce(host, 'unknown') || '|' || pod"
query(_bucket_sql("round(avg(value), 6)", _KEYS, width=DAY), "v_bucket_group_by")(_buckets(v.Aggregation("avg", DAY, ("service_name", "host.name", "k8s.pod.name"))))
query(_bucket_sql("round(sum(value), 6)", "pod", more="AND event_type = 'purchase'"), "v_bucket_metric_name")(_buckets(v.Aggregation("sum", HOUR, ("k8s.pod.name",), "metric.purchase")))
query(_bucket_sql("CAST(count(*) AS DOUBLE)", "coalesce(service_name, 'unknown')"), "v_bucket_unmatched_metric")(_buckets(v.Aggregation("count", HOUR, ("service_name",), "metric.purchase")))
query(_bucket_sql("CAST(count(*) AS DOUBLE)", "coalesce(service_name, 'unknown') || '|unknown'", "'logs'", width=DAY), "v_bucket_logs")(_buckets(v.Aggregation("count", DAY, ("service_name", "host.name")), 4))


@query(f"WITH {ENTRIES} SELECT DISTINCT service_name FROM entries WHERE service_name IS NOT NULL")
def v_services(spark, sf_dir):
    return v.services(a.entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT entry_id, signal, service_name FROM entries WHERE signal = 'traces' ORDER BY ms DESC, seq DESC LIMIT 50")
def v_newest_50(spark, sf_dir):
    return v.newest(a.entries(spark, sf_dir).where("signal = 'traces'")).select("entry_id", "signal", "service_name")


@query(f"WITH {ENTRIES} SELECT signal, CAST(count(*) AS BIGINT) AS n FROM entries WHERE coalesce(service_name, '') IN ('svc-1', 'svc-4') AND (lower(service_name) LIKE '%k=1%' OR lower(payload_text) LIKE '%k=1%') GROUP BY signal")
def v_dashboard_filter(spark, sf_dir):
    return v.dashboard_filter(a.entries(spark, sf_dir), "svc-1, svc-4", " K=1").groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


_FAN = [
    v.compile_viewer({"id": n, "signal_mask": m, "lookback_ms": DAY, "definition_json": b})
    for n, m, b in (("all", 7, {}), ("logs", 4, {}), ("one", 3, {"query": "svc-1"}), ("buy", 2, {"filters": [{"field": "payload", "op": "eq", "value": "metric.purchase"}]}))
]


@query(f"""WITH {ENTRIES} SELECT viewer_id, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'all' AS viewer_id FROM entries UNION ALL SELECT 'logs' FROM entries WHERE signal = 'logs' UNION ALL SELECT 'one' FROM entries WHERE signal <> 'logs' AND service_name = 'svc-1'
  UNION ALL SELECT 'buy' FROM entries WHERE payload_text = 'metric.purchase') GROUP BY viewer_id""")
def v_fan_out(spark, sf_dir):
    return v.fan_out(_FAN, a.entries(spark, sf_dir)).groupBy("viewer_id").agg(F.count(F.lit(1)).alias("n"))


_MANY = [
    v.compile_viewer({"id": f"{kind}-{n}", "signal_mask": mask, "lookback_ms": 20 * DAY, "definition_json": {"filter_mode": mode, "filters": [{"field": "payload", "op": "contains", "value": f"K={n}"}, {"field": "service_name", "op": op, "value": f"Svc-{n % 9}"}]}})
    for kind, mask, mode, op in (("both", 4, "and", "contains"), ("one", 7, "or", "eq"))
    for n in range(100)
]


@query(f"""WITH {ENTRIES}, live AS (SELECT * FROM entries WHERE ms > {NOW_MS} - {20 * DAY}), n AS (SELECT unnest(range(100)) AS n)
SELECT 'both-' || n AS viewer_id, count(*) AS n FROM live, n WHERE signal = 'logs' AND contains(lower(payload_text), 'k=' || n) AND contains(service_name, 'svc-' || (n % 9)) GROUP BY ALL
UNION ALL SELECT 'one-' || n, count(*) FROM live, n WHERE contains(lower(payload_text), 'k=' || n) OR service_name = 'svc-' || (n % 9) GROUP BY ALL""")
def v_fan_out_many(spark, sf_dir):
    """Two hundred viewers in one pass of an automaton."""
    return v.fan_out(_MANY, a.entries(spark, sf_dir), a.NOW).groupBy("viewer_id").agg(F.count(F.lit(1)).alias("n"))


# --- streams: the state that is left once the newest entry has taken back what its look-back leaves out ---


def _live(fn: str):
    def made(spark, sf_dir):
        rows = a.entry_stream(spark, sf_dir).where("signal = 'metrics'").select("observed_at", F.coalesce("service_name", F.lit("unknown")).alias("group_key"), "value")
        left = live.run_through(live.live_buckets(rows, v.Aggregation(fn, DAY), 10 * DAY), live.scratch(spark, "live"))
        return left.select("group_key", "bucket_start_ms", "n", F.round("value", 6).alias("value"))

    return made


for _fn, _sql in (("sum", "round(sum(value), 6)"), ("p95", "quantile_disc(value, 0.95)")):
    query(f"""WITH {ENTRIES}, m AS (SELECT * FROM entries WHERE signal = 'metrics')
SELECT coalesce(service_name, 'unknown') AS group_key, CAST(ms - ms % {DAY} AS BIGINT) AS bucket_start_ms, count(*) AS n, round({_sql}, 6) AS value FROM m
WHERE ms > (SELECT max(ms) FROM m) - {10 * DAY} GROUP BY ALL""", f"w_live_{_fn}")(_live(_fn))


# --- traces ---


def _flat(df: DataFrame) -> DataFrame:
    return df.select("trace_id", F.col("started_at_ns").cast("string").alias("started_at_ns"), "span_count", "has_error", F.array_join("service_names", ",").alias("services"), "root_span_name", "duration_ms")


for _name, _options, _where in (
    ("t_search", {}, "true"),
    ("t_search_service", {"service": "supplier-3"}, "list_contains(string_split(services, ','), 'supplier-3')"),
    ("t_search_min_duration", {"min_duration_ms": 1000, "service": "cache"}, "duration_ms >= 1000 AND list_contains(string_split(services, ','), 'cache')"),
    ("t_search_errors", {"only_errors": True}, "has_error"),
    ("t_search_attr", {"span_name": "QUERY", "attribute": ("db.system", "MYSQL")}, "trace_id IN (SELECT trace_id FROM spans WHERE name LIKE '%query%' AND system = 'mysql')"),
    ("t_search_attr_key", {"attribute": ("peer.service", None)}, "trace_id IN (SELECT trace_id FROM spans WHERE peer IS NOT NULL)"),
):
    query(f"{SUMMARIES} SELECT * FROM traces WHERE {_where}", _name)(lambda spark, sf_dir, o=_options: _flat(t.search(a.spans(spark, sf_dir), **o)))


@query(f"WITH {SPANS} SELECT span_id, name, CAST(start_us * 1000 AS VARCHAR) AS start_ns FROM spans WHERE trace_id = 't7'")
def t_lookup(spark, sf_dir):
    return t.lookup(a.spans(spark, sf_dir), "t7").select("span_id", "name", F.col("start_ns").cast("string").alias("start_ns"))


def _waterfall_sql() -> str:
    return f"""WITH RECURSIVE {SPANS}, own AS (SELECT *, CASE WHEN parent = '' OR parent NOT IN (SELECT span_id FROM spans z WHERE z.trace_id = s.trace_id) THEN NULL ELSE parent END AS up FROM spans s),
walk AS (
  SELECT trace_id, span_id, 0 AS depth, [struct_pack(s := start_us, r := rs, i := i)] AS path FROM own WHERE up IS NULL
  UNION ALL
  SELECT o.trace_id, o.span_id, w.depth + 1, list_append(w.path, struct_pack(s := o.start_us, r := o.rs, i := o.i)) FROM walk w JOIN own o ON o.up = w.span_id AND o.trace_id = w.trace_id
) SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS INTEGER) AS position, CAST(depth AS INTEGER) AS depth, span_id FROM walk"""


@query(_waterfall_sql())
def t_waterfall(spark, sf_dir):
    return t.waterfall(a.spans(spark, sf_dir)).select("trace_id", "position", "depth", "span_id")


@query(f"WITH {SPANS} SELECT service, count(*) AS span_count, count(*) FILTER (status = 2) AS error_count, quantile_disc((end_us - start_us) / 1000.0, 0.95) AS p95_ms FROM spans GROUP BY service")
def m_nodes(spark, sf_dir):
    return t.service_nodes(a.spans(spark, sf_dir))


_EDGES = f"""WITH {SPANS}, calls AS (
  SELECT coalesce(p.service, c.service) AS source, CASE WHEN p.service IS NULL THEN c.peer ELSE c.service END AS target, c.status = 2 AS failed, p.service IS NULL AS lone
  FROM spans c LEFT JOIN spans p ON p.span_id = c.parent WHERE c.parent <> '')
SELECT source, target, count(*) AS calls, round(avg(CAST(failed AS INTEGER)), 6) AS error_rate FROM calls WHERE source <> target AND target <> '' """


@query(_EDGES + "GROUP BY source, target")
def m_edges(spark, sf_dir):
    return t.service_edges(a.spans(spark, sf_dir)).withColumn("error_rate", F.round("error_rate", 6))


@query(_EDGES + "AND target LIKE 'peer-%' GROUP BY source, target")
def m_peer_edges(spark, sf_dir):
    return t.service_edges(a.spans(spark, sf_dir)).where("target LIKE 'peer-%'").withColumn("error_rate", F.round("error_rate", 6))


# --- errors, database calls, exemplars ---

_LOGS = f"""{ENTRIES}, errors AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN 'ERROR' ELSE 'severity=17' END AS kind, 'code ' || chr(CAST(97 + entry_id % 7 AS INTEGER)) || ' user ' || user_id || ' failed k=' || k AS body FROM entries WHERE signal = 'logs'
), occurrences AS (
  SELECT *, kind || ': ' || body AS signature, substr(sha256(CASE WHEN k % 2 = 0 THEN 'error' ELSE 'severity=<num>' END || chr(0) || regexp_replace(body, '[0-9]+', '<num>', 'g')), 1, 16) AS fingerprint FROM errors)"""


@query(f"WITH {_LOGS} SELECT entry_id, fingerprint, signature FROM occurrences")
def e_fingerprint(spark, sf_dir):
    return i.log_errors(a.log_records(spark, sf_dir)).select(F.col("ord.seq").alias("entry_id"), "fingerprint", "signature")


@query(f"WITH {_LOGS} SELECT fingerprint, count(*) AS count, epoch_us(min(observed_at)) // 1000 AS first_ms, epoch_us(max(observed_at)) // 1000 AS last_ms, arg_max(signature, (observed_at, -entry_id)) AS signature, arg_max(struct_pack(s := service_name), (observed_at, -entry_id)).s AS service_name FROM occurrences GROUP BY fingerprint")
def e_groups(spark, sf_dir):
    g = i.error_groups(i.log_errors(a.log_records(spark, sf_dir)))
    return g.select("fingerprint", "count", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"), "signature", "service_name")


@query(f"WITH {_LOGS} SELECT fingerprint, epoch_us(max(observed_at)) // 1000 AS last_ms FROM occurrences GROUP BY fingerprint HAVING max(ms) >= {NOW_MS} - {2 * DAY}")
def e_recent(spark, sf_dir):
    g = i.recent_error_groups(i.error_groups(i.log_errors(a.log_records(spark, sf_dir))), a.NOW, 2 * DAY)
    return g.select("fingerprint", F.unix_millis("last_seen").alias("last_ms"))


_CALLS = f"WITH {SPANS}, calls AS (SELECT trace_id, regexp_replace(statement, '\\b[0-9]+\\b', '?', 'g') AS statement, system AS db_system, service, (end_us - start_us) // 1000 AS ms FROM spans WHERE statement IS NOT NULL)"
_SLOW = "SELECT statement, db_system, count(*) AS count, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, quantile_disc(ms, 0.99) AS p99_ms, max(ms) AS max_ms FROM calls GROUP BY statement, db_system"


@query(f"{_CALLS} {_SLOW} HAVING p95_ms >= 100")
def d_slow_queries(spark, sf_dir):
    return i.slow_queries(i.db_spans(a.spans(spark, sf_dir, calls_only=True)))


@query(f"{_CALLS} {_SLOW} HAVING p95_ms >= 481")
def d_slow_queries_none(spark, sf_dir):
    return i.slow_queries(i.db_spans(a.spans(spark, sf_dir, calls_only=True)), 481)


@query(f"{_CALLS} SELECT trace_id, statement, db_system, count(*) AS count, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM calls GROUP BY trace_id, statement, db_system HAVING count(*) >= 2")
def d_n_plus_one(spark, sf_dir):
    return i.n_plus_one(i.db_spans(a.spans(spark, sf_dir, calls_only=True)), 2).withColumn("services", F.array_join("services", ","))


@query(f"""WITH {ENTRIES}, active AS (SELECT DISTINCT ms - ms % {HOUR} AS b FROM entries WHERE signal = 'metrics' AND ms BETWEEN {NOW_MS} - {7 * DAY} AND {NOW_MS}),
seen AS (SELECT ms - ms % {HOUR} AS b, 'u' || user_id AS trace_id, min((ms, seq)) AS o FROM entries WHERE signal = 'traces' AND ms BETWEEN {NOW_MS} - {7 * DAY} AND {NOW_MS} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o) AS n FROM seen WHERE b IN (SELECT b FROM active))
SELECT CAST(b AS BIGINT) AS bucket_start_ms, string_agg(trace_id, ',' ORDER BY n) AS ids FROM ranked WHERE n <= 3 GROUP BY b""")
def x_exemplars(spark, sf_dir):
    e = a.entries(spark, sf_dir)
    zero = F.lit(0)
    spans = e.where("signal = 'traces'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("trace_id"), "observed_at", F.col("service_name").alias("entry_service_name"), F.struct(F.col("stream_ms").alias("ms"), F.col("stream_seq").alias("seq"), zero.alias("rs"), zero.alias("ss"), zero.alias("i")).alias("ord"))
    return i.exemplars(e, spans, a.NOW, 7 * DAY, HOUR, max_samples=3).select("bucket_start_ms", F.array_join("sample_trace_ids", ",").alias("ids"))


# --- rollups, attributes, budgets, detectors, alerts, charts ---


def _rollups(resolution: str):
    def run(spark, sf_dir):
        rows = i.rollup_range(i.rollup(a.entries(spark, sf_dir), (resolution,)), "traces", resolution, NOW_MS - 20 * DAY, NOW_MS)
        return rows.select("bucket_start_seconds", "count", F.array_join(F.transform(F.array_sort(F.map_entries("by_service")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("services"))

    return run


for _name, _width in i.RESOLUTIONS.items():
    query(
        f"""WITH {ENTRIES}, s AS (SELECT ms // 1000 - (ms // 1000) % {_width} AS b, service_name, count(*) AS n FROM entries WHERE signal = 'traces' GROUP BY ALL)
SELECT CAST(b AS BIGINT) AS bucket_start_seconds, CAST(sum(n) AS BIGINT) AS count, coalesce(string_agg(service_name || '=' || n, ',' ORDER BY service_name), '') AS services FROM s
WHERE b BETWEEN {(NOW_MS - 20 * DAY) // 1000 // _width * _width} AND {NOW_MS // 1000 // _width * _width} GROUP BY b""",
        f"r_rollup_{_name}",
    )(_rollups(_name))


def _index(spark, sf_dir) -> DataFrame:
    metrics = a.metric_points(spark, sf_dir).select(F.lit("metrics").alias("signal"), "entry_id", "observed_at", F.col("resource_attrs").alias("attributes"))
    logs = a.log_records(spark, sf_dir).select(F.lit("logs").alias("signal"), "entry_id", "observed_at", F.col("attrs").alias("attributes"))
    return i.attribute_index(metrics, logs)


_INDEX = f"WITH {ENTRIES}, idx AS (SELECT 'k8s.pod.name' AS key, pod AS value, signal, entry_id FROM entries WHERE pod IS NOT NULL UNION ALL SELECT 'host.name', host, signal, entry_id FROM entries WHERE host IS NOT NULL UNION ALL SELECT 'k', CAST(k AS VARCHAR), signal, entry_id FROM entries WHERE signal = 'logs')"


@query(f"{_INDEX} SELECT key, value, signal, entry_id FROM idx")
def i_attr_index(spark, sf_dir):
    return _index(spark, sf_dir).select("key", "value", "signal", "entry_id")


@query(f"{_INDEX} SELECT DISTINCT key FROM idx")
def i_attr_keys(spark, sf_dir):
    return i.attribute_keys(_index(spark, sf_dir))


@query(f"{_INDEX} SELECT DISTINCT value FROM idx WHERE key = 'k8s.pod.name' AND value ILIKE 'POD-%' ORDER BY value LIMIT 50")
def i_attr_values(spark, sf_dir):
    return i.attribute_values(_index(spark, sf_dir), "k8s.pod.name", "POD-")


@query(f"""WITH {ENTRIES}, c AS (SELECT count(*) AS t, count(*) FILTER (signal <> 'logs') AS s FROM entries WHERE ms >= {NOW_MS} - {20 * DAY} AND service_name = 'svc-1')
SELECT t AS total_count, s AS success_count, round(s / t * 100.0, 6) AS current_pct, round(least((100 - s / t * 100.0) / 25.0 * 100, 100), 6) AS consumed_pct, round(100 - least((100 - s / t * 100.0) / 25.0 * 100, 100), 6) AS remaining_pct FROM c""")
def s_budget(spark, sf_dir):
    out = i.slo_budget(a.entries(spark, sf_dir), F.col("service_name") == "svc-1", F.col("signal") != "logs", 75.0, 20 * DAY, a.NOW)
    return out.select("total_count", "success_count", *(F.round(c, 6).alias(c) for c in ("current_pct", "consumed_pct", "remaining_pct")))


@query(f"WITH {ENTRIES} SELECT {NOW_MS} - max(ms) > {DAY} AS breached, round(({NOW_MS} - max(ms)) / 1000.0, 6) AS value, CAST(86400 AS DOUBLE) AS expected FROM entries WHERE signal = 'logs'")
def a_nodata(spark, sf_dir):
    return i.no_data(a.entries(spark, sf_dir).where("signal = 'logs'"), DAY, a.NOW).withColumn("value", F.round("value", 6))


@query(f"""WITH {ENTRIES}, b AS (SELECT greatest(({NOW_MS} - ms) // {DAY}, 0) AS b, count(*) AS c FROM entries WHERE signal = 'logs' AND ms < {NOW_MS} - {DAY} GROUP BY ALL), n AS (SELECT max(b) AS n FROM b),
h AS (SELECT g.b, coalesce(b.c, 0) AS c FROM (SELECT unnest(range(1, n + 1)) AS b FROM n) g LEFT JOIN b USING (b)), m AS (SELECT avg(c) + 1.5 * stddev_pop(c) AS expected FROM h), l AS (SELECT CAST(coalesce(sum(c), 0) AS DOUBLE) AS v FROM b WHERE b = 0)
SELECT v > expected AS breached, v AS value, round(expected, 6) AS expected FROM m, l""")
def a_zscore(spark, sf_dir):
    old = a.entries(spark, sf_dir).where(F.col("signal") == "logs").where(F.unix_millis("observed_at") < NOW_MS - DAY)
    return i.zscore(old, DAY, 1.5, a.NOW).withColumn("expected", F.round("expected", 6))


_ALERTS = [i.Alert("a1", "all", ">", 10.0), i.Alert("a2", "logs", "<", 1.0), i.Alert("a3", "gone", ">", 0.0), i.Alert("a4", "buy", "!=", 0.0)]


@query(f"""WITH {ENTRIES}, c AS (SELECT 'all' AS viewer_id, CAST(count(*) AS DOUBLE) AS value FROM entries UNION ALL SELECT 'logs', count(*) FROM entries WHERE signal = 'logs' UNION ALL SELECT 'buy', count(*) FROM entries WHERE payload_text = 'metric.purchase'),
x AS (SELECT * FROM (VALUES ('a1', 'all'), ('a2', 'logs'), ('a3', 'gone'), ('a4', 'buy')) AS z(alert_id, viewer_id))
SELECT alert_id, viewer_id, CASE WHEN value IS NULL THEN 'missing_viewer' WHEN alert_id = 'a1' AND value > 10 OR alert_id = 'a2' AND value < 1 OR alert_id = 'a4' AND value <> 0 THEN 'breached' ELSE 'ok' END AS status, value FROM x LEFT JOIN c USING (viewer_id)""")
def al_threshold(spark, sf_dir):
    counts = v.fan_out(_FAN, a.entries(spark, sf_dir)).groupBy("viewer_id").agg(F.count(F.lit(1)).alias("count"))
    return i.evaluate_alerts(counts, _ALERTS)


def _metric_rows(spark, sf_dir) -> DataFrame:
    rows = a.metric_points(spark, sf_dir).select("metric_name", F.col("entry_service_name").alias("service_name"), "observed_at", "value")
    return v.within_lookback(rows, 4 * DAY, a.NOW)


_CHART = f"WITH {ENTRIES}, rows AS (SELECT payload_text || ' (' || coalesce(service_name, 'unknown') || ')' AS series, ms - ms % 300000 AS b, value FROM entries WHERE signal = 'metrics' AND ms > {NOW_MS} - {4 * DAY})"


@query(f"{_CHART}, g AS (SELECT series, b FROM (SELECT DISTINCT series FROM rows), (SELECT DISTINCT b FROM rows)) SELECT series, CAST(b AS BIGINT) AS bucket_start_ms, round(coalesce(sum(value), 0), 6) AS value FROM g LEFT JOIN rows USING (series, b) GROUP BY ALL")
def c_series(spark, sf_dir):
    return _rounded(i.chart_series(_metric_rows(spark, sf_dir), 4 * DAY))


@query(f"{_CHART} SELECT series, round(sum(value), 6) AS value FROM rows GROUP BY series")
def c_pie(spark, sf_dir):
    return _rounded(i.chart_totals(_metric_rows(spark, sf_dir)))


@query(f"{_CHART}, z AS (SELECT b, sum(value) AS v, row_number() OVER (ORDER BY b DESC) AS n FROM rows GROUP BY b), w AS (SELECT max(CASE WHEN n = 1 THEN v END) AS latest, max(CASE WHEN n = 2 THEN v END) AS previous FROM z) SELECT round(latest, 6) AS latest, round(previous, 6) AS previous, round((latest - previous) / previous * 100, 6) AS change_pct FROM w")
def c_billboard(spark, sf_dir):
    out = i.billboard(_metric_rows(spark, sf_dir), 4 * DAY)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(_bucket_sql("CAST(count(*) AS DOUBLE)", "coalesce(service_name, 'unknown') || ' / unknown'", "'traces'", width=DAY).replace("AS keys", "AS series"))
def c_timeseries(spark, sf_dir):
    agg = v.Aggregation("count", DAY, ("service_name", "host.name"))
    return i.timeseries(v.aggregate(agg, v.matching(_viewer({}, 1), a.entries(spark, sf_dir), a.NOW)))


# --- decoding: requests as they come, to tables ---


def _bodies(spark, sf_dir) -> DataFrame:
    return otlp.name_services(otlp.parse(otlp.decode_bodies(a.raw_entries(spark, sf_dir))))


_SAID = "'code ' || chr(CAST(97 + entry_id % 7 AS INTEGER)) || ' user ' || user_id || ' failed k=' || k"
_NS = "CAST(floor(value * 1000) AS BIGINT) * 1000"


@query(f"""WITH {ENTRIES} SELECT entry_id, signal, service_name, CASE WHEN signal = 'traces' THEN round({_NS} / 1e6, 6) END AS duration_ms,
  CASE signal WHEN 'traces' THEN event_type WHEN 'metrics' THEN payload_text || ' metric.k' ELSE CASE WHEN k % 2 = 0 THEN 'ERROR ' ELSE '' END || {_SAID} END AS payload_text FROM entries""")
def o_entries(spark, sf_dir):
    return otlp.entries(_bodies(spark, sf_dir)).select("entry_id", "signal", "service_name", F.round("duration_ms", 6).alias("duration_ms"), "payload_text")


@query(f"""WITH {ENTRIES} SELECT entry_id, service_name, 'u' || user_id AS trace_id, 's' || entry_id AS span_id, event_type AS name, CAST(epoch_us(observed_at) * 1000 AS VARCHAR) AS start_ns,
  CAST(epoch_us(observed_at) * 1000 + {_NS} AS VARCHAR) AS end_ns, k % 3 AS status_code FROM entries WHERE signal = 'traces'""")
def o_spans(spark, sf_dir):
    s = otlp.spans(_bodies(spark, sf_dir))
    return s.select("entry_id", F.col("resource_service_name").alias("service_name"), "trace_id", "span_id", "name", *(F.col(c).cast("string").alias(c) for c in ("start_ns", "end_ns")), "status_code")


@query(f"WITH {ENTRIES}, m AS (SELECT * FROM entries WHERE signal = 'metrics') SELECT entry_id, payload_text AS metric_name, 'gauge' AS kind, value FROM m UNION ALL SELECT entry_id, 'metric.k', 'sum', CAST(k AS DOUBLE) FROM m")
def o_points(spark, sf_dir):
    return otlp.metric_points(_bodies(spark, sf_dir)).select("entry_id", "metric_name", "kind", "value")


@query(f"WITH {ENTRIES} SELECT entry_id, service_name, CASE WHEN k % 2 = 0 THEN 'ERROR' END AS severity_text, CASE WHEN k % 2 = 1 THEN 17 END AS severity_number, {_SAID} AS body FROM entries WHERE signal = 'logs'")
def o_records(spark, sf_dir):
    return otlp.log_records(_bodies(spark, sf_dir)).select("entry_id", F.col("resource_service_name").alias("service_name"), "severity_text", "severity_number", "body")


@query(f"""WITH {ENTRIES}, c AS (SELECT *, entry_id % 10 AS n FROM entries WHERE signal = 'logs' AND entry_id % 2 = 0)
SELECT entry_id, CASE n WHEN 0 THEN 'grpc' WHEN 2 THEN 'grpc-web' WHEN 4 THEN 'grpc-web-text' WHEN 6 THEN 'connect' ELSE 'grpc' END AS transport, CASE WHEN n = 8 THEN 13 ELSE 0 END AS code,
  CASE WHEN n <> 8 THEN service_name END AS service_name, CASE WHEN n <> 8 THEN CASE WHEN k % 2 = 0 THEN 'ERROR ' ELSE '' END || {_SAID} END AS payload_text FROM c""")
def o_calls(spark, sf_dir):
    """Remote calls in all framings, one kind cut short."""
    r, n, p = a.raw_entries(spark, sf_dir).where("signal = 'logs' AND entry_id % 2 = 0"), F.col("entry_id") % 10, F.col("payload")
    frame = F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), p)
    web = F.concat(frame, F.unhex(F.lit("8000000004")), F.lit("ok\r\n").cast("binary"))
    body = F.when(n == 0, frame).when(n == 2, web).when(n == 4, F.base64(web).cast("binary")).when(n == 6, p).otherwise(F.substring(frame, 1, F.octet_length(frame) - 1))
    kind = F.when(n == 2, "application/grpc-web+proto").when(n == 4, "application/grpc-web-text").when(n == 6, "application/proto").otherwise("application/grpc")
    path = F.lit("/opentelemetry.proto.collector.logs.v1.LogsService/Export")
    sent = r.select("entry_id", "stream_ms", "stream_seq", "observed_at", F.lit(None).cast("string").alias("service_name"), path.alias("path"), kind.alias("content_type"), F.lit(None).cast("string").alias("content_encoding"), body.alias("body"))
    taken = calls.normalize(sent)
    good = otlp.entries(calls.name_services(otlp.parse(otlp.decode_bodies(taken.where(F.col("code") == calls.OK).drop("body")))))
    return taken.select("entry_id", "transport", "code").join(good.select("entry_id", "service_name", "payload_text"), "entry_id", "left")


@query(f"""WITH {ENTRIES} SELECT DISTINCT key, value, signal, entry_id FROM (SELECT 'k8s.pod.name' AS key, pod AS value, signal, entry_id FROM entries UNION ALL SELECT 'host.name', host, signal, entry_id FROM entries
  UNION ALL SELECT 'k', CAST(k AS VARCHAR), signal, entry_id FROM entries WHERE signal <> 'metrics') WHERE value IS NOT NULL""")
def o_attributes(spark, sf_dir):
    return i.attribute_index(*otlp.indexable_attributes(_bodies(spark, sf_dir))).select("key", "value", "signal", "entry_id")


@query(f"""WITH {ENTRIES} SELECT 'Error' || (k % 3) || ': failed at ' || k AS signature, service_name, entry_id, substr(sha256('error<num>' || chr(0) || 'failed at <num>'), 1, 16) AS fingerprint
  FROM entries WHERE signal = 'traces' AND k % 7 = 0""")
def o_exceptions(spark, sf_dir):
    return i.span_errors(otlp.spans(_bodies(spark, sf_dir))).select("signature", "service_name", F.col("ord.seq").alias("entry_id"), "fingerprint")


@query(f"WITH {ENTRIES} SELECT DISTINCT signal, service_name FROM entries WHERE service_name IS NOT NULL")
def o_services(spark, sf_dir):
    return _bodies(spark, sf_dir).where("service_name is not null").select("signal", "service_name").distinct()


@query(f"WITH {ENTRIES} SELECT CAST(ms - ms % {DAY} AS BIGINT) AS bucket_start_ms, coalesce(pod, 'unknown') AS keys, CAST(sum(k) AS DOUBLE) AS value FROM entries WHERE signal = 'metrics' GROUP BY ALL")
def o_bucket_named(spark, sf_dir):
    rows = v.aggregate(v.Aggregation("sum", DAY, ("k8s.pod.name",), "metric.k"), otlp.entries(_bodies(spark, sf_dir)).where("signal = 'metrics'"))
    return _rounded(rows.select("bucket_start_ms", F.array_join("group_keys", "|").alias("keys"), "value"))


@query(_bucket_sql("round(sum(value), 6)", width=DAY))
def o_bucket_unnamed(spark, sf_dir):
    return _buckets_of(v.Aggregation("sum", DAY), otlp.entries(_bodies(spark, sf_dir)))


@query(f"""WITH {ENTRIES} SELECT ms, signal, CASE WHEN service_name IS NOT NULL THEN 'service=' || service_name || ' | ' ELSE '' END || CASE signal WHEN 'traces' THEN 'span=' || event_type
    ELSE CASE WHEN k % 2 = 0 THEN 'severity=ERROR | ' ELSE '' END || 'body=' || {_SAID} END || ' | otlp_json' AS preview, CAST(NULL AS VARCHAR) AS metric_name
  FROM entries WHERE signal <> 'metrics' ORDER BY ms DESC, seq DESC LIMIT 50""")
def o_preview(spark, sf_dir):
    p = preview.preview(_bodies(spark, sf_dir).where("signal <> 'metrics'"))
    return p.select(F.unix_millis("observed_at").alias("ms"), "signal", "preview", "metric_name")


@query(f"""WITH {ENTRIES}, m AS (SELECT * FROM entries WHERE signal = 'metrics') SELECT entry_id, service_name, payload_text AS metric_name, value AS metric_value FROM m WHERE payload_text LIKE '%k%'
  UNION ALL SELECT entry_id, service_name, 'metric.k', CAST(k AS DOUBLE) FROM m""")
def o_metric_rows(spark, sf_dir):
    return preview.metric_rows(_bodies(spark, sf_dir), "K").select("entry_id", "service_name", "metric_name", "metric_value")


@query(f"WITH {ENTRIES} SELECT entry_id, 'metric.k' AS metric_name, CAST(k AS DOUBLE) AS metric_value FROM entries WHERE signal = 'metrics'")
def o_first_metric(spark, sf_dir):
    return preview.first_metric(_bodies(spark, sf_dir), "ric.k")


_TYPES = ("application/json", "application/json; charset=utf-8", "application/x-protobuf", "text/plain", "Application/JSON")
_CODINGS = (None, "identity", "gzip", "zstd", "br")


@query(f"""WITH {ENTRIES} SELECT CASE WHEN entry_id % 5 >= 3 OR entry_id % 7 % 5 = 4 THEN 415 WHEN entry_id % 7 % 5 IN (2, 3) THEN 400 ELSE 200 END AS status, count(*) AS n FROM entries GROUP BY ALL""")
def o_status(spark, sf_dir):
    """What a server answers to content types and codings; bodies are plain, so a compressed one is bad."""
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    r = a.raw_entries(spark, sf_dir).select("signal", at(_TYPES, F.col("entry_id") % 5).alias("content_type"), at(_CODINGS, F.col("entry_id") % 7 % 5).alias("content_encoding"), F.col("payload").alias("body"))
    return otlp.normalize(r).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY ms DESC, seq DESC) AS n FROM entries) SELECT entry_id, signal FROM r WHERE n <= 1000")
def s_retained(spark, sf_dir):
    e = a.entries(spark, sf_dir)
    return e.where(landing.above(landing.floors(e, 1000), F.col("signal"), F.col("stream_ms"), F.col("stream_seq"))).select("entry_id", "signal")


@query(f"WITH {ENTRIES} SELECT entry_id, ms || '-' || seq AS id, ms AS parsed_ms, seq AS parsed_seq FROM entries WHERE signal = 'logs'")
def s_stream_ids(spark, sf_dir):
    e = a.entries(spark, sf_dir).where("signal = 'logs'").select("entry_id", landing.stream_id(F.col("stream_ms"), F.col("stream_seq")).alias("id"))
    ms, seq = landing.parse_stream_id(F.col("id"))
    return e.select("entry_id", "id", ms.alias("parsed_ms"), seq.alias("parsed_seq"))


@query(f"WITH {ENTRIES} SELECT viewer_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'all' AS viewer_id FROM entries WHERE ms > {NOW_MS} - {DAY} UNION ALL SELECT 'logs' FROM entries WHERE signal = 'logs' AND ms > {NOW_MS} - {DAY}) GROUP BY viewer_id")
def v_fan_out_live(spark, sf_dir):
    """Each viewer within its own look-back, in one pass."""
    return v.fan_out(_FAN[:2], a.entries(spark, sf_dir), a.NOW).groupBy("viewer_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOGS} SELECT fingerprint, count(*) AS count, epoch_us(min(observed_at)) // 1000 AS first_ms, epoch_us(max(observed_at)) // 1000 AS last_ms FROM occurrences GROUP BY fingerprint")
def e_folded(spark, sf_dir):
    """Groups kept by batch, here by the id's last digit, folded to one."""
    found = i.log_errors(a.log_records(spark, sf_dir))
    parts = [i.error_groups(found.where(F.col("ord.seq") % 3 == n)) for n in range(3)]
    g = i.fold_error_groups(parts[0].union(parts[1]).union(parts[2]))
    return g.select("fingerprint", "count", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services with most log entries of the last month, in the dialect."""
    recent = v.within_lookback(a.entries(spark, sf_dir), int(timedelta(days=30).total_seconds() * 1000), a.NOW)
    return dialect.plan("SELECT service_name, count(*) AS n FROM logs WHERE payload LIKE 'error%' GROUP BY service_name LIMIT 20", recent)
