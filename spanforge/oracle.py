"""SQL twins of the adapters, as common table expressions for the registered queries' SQL."""

ENTRIES = """
entries AS (
  SELECT *, CASE WHEN signal = 'logs' THEN 'ERROR k=' || k WHEN signal = 'metrics' THEN 'metric.' || event_type ELSE event_type END AS payload_text,
    CASE WHEN signal = 'traces' THEN value END AS duration_ms, CASE WHEN signal = 'metrics' THEN 'pod-' || (k % 8) END AS pod,
    CASE WHEN signal = 'metrics' AND k % 5 <> 0 THEN 'host-' || (k % 5) END AS host
  FROM (
    SELECT event_id AS entry_id, epoch_us(ts) // 1000 AS ms, event_id AS seq, ts AS observed_at, event_type, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      CASE WHEN event_type = 'error' THEN 'logs' WHEN event_type IN ('click', 'purchase') THEN 'metrics' ELSE 'traces' END AS signal,
      CASE WHEN user_id % 10 <> 9 THEN 'svc-' || (user_id % 10) END AS service_name
    FROM events)
)"""
#: Milliseconds of the fixed instant that stands for the wall clock.
NOW_MS = 1706659200000

SPANS = """
base AS (
  SELECT o_orderkey, epoch_us(o_orderdate) AS t0, c_mktsegment, o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_tax) AS n FROM lineitem
), lines AS (
  SELECT *, l_orderkey || '-' || n AS place, 'supplier-' || (l_suppkey % 5) AS supplier, CAST(l_quantity AS INTEGER) AS q FROM numbered JOIN base ON l_orderkey = o_orderkey
), spans AS (
  SELECT o_orderkey AS trace, 't' || o_orderkey AS trace_id, 'o' || o_orderkey AS span_id, '' AS parent, 'seg-' || c_mktsegment AS service, 'order ' || o_orderpriority AS name,
    t0 AS start_us, t0 + 1000000 AS end_us, 0 AS status, CAST(NULL AS VARCHAR) AS statement, CAST(NULL AS VARCHAR) AS system, CAST(NULL AS VARCHAR) AS peer, 0 AS rs, 0 AS i FROM base
  UNION ALL
  SELECT l_orderkey, 't' || l_orderkey, 'l' || place, CASE WHEN l_partkey % 50 = 0 THEN 'missing-' || l_partkey ELSE 'o' || l_orderkey END, supplier, 'query part',
    t0 + n * 1000, t0 + n * 1000 + q * 10000, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END,
    'SELECT * FROM part_' || l_returnflag || ' WHERE p_partkey = ' || l_partkey || ' AND qty > ' || q, CASE WHEN l_linestatus = 'F' THEN 'postgresql' ELSE 'mysql' END,
    CASE WHEN l_partkey % 50 = 0 THEN 'peer-' || (l_suppkey % 3) END, 1, n FROM lines
  UNION ALL
  SELECT l_orderkey, 't' || l_orderkey, 'g' || place, 'l' || place, CASE WHEN l_tax > 0.04 THEN supplier ELSE 'cache' END, 'lookup',
    t0 + n * 1000 + 1000, t0 + n * 1000 + 1000 + q * 1000, 0, NULL, NULL, NULL, 2, n FROM lines WHERE n % 2 = 0
)"""

SUMMARIES = f"""WITH {SPANS}, t AS (
  SELECT trace_id, min(start_us) AS s, max(end_us) AS e, count(*) AS span_count, bool_or(status = 2) AS has_error, string_agg(DISTINCT service, ',' ORDER BY service) AS services,
    min(CASE WHEN parent = '' THEN name END) AS root_span_name FROM spans GROUP BY trace_id
), traces AS (
  SELECT trace_id, CAST(s * 1000 AS VARCHAR) AS started_at_ns, span_count, has_error, services, root_span_name, CAST((e - s) // 1000 AS BIGINT) AS duration_ms FROM t)"""
