"""The driver's tables as telemetry: entries, metric points, log records and spans.

``events`` stand for decoded requests, ``orders`` and ``lineitem`` for traces.  Each adapter has its twin in
``oracle.py`` as SQL.
"""

from __future__ import annotations

from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.core import wall_micros
from .schema import ATTRS

#: Stands for the wall clock over the driver's tables.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
NOW_MS = int(NOW.timestamp() * 1000)


def text_attrs(**pairs) -> F.Column:
    """Attributes that hold strings, without those that are null."""
    return F.filter(F.array(*(_text_attr(k, v) for k, v in pairs.items())), lambda a: a["value"]["stringValue"].isNotNull())


def _text_attr(key: str, value: Column) -> Column:
    others = (F.lit(None).cast("string").alias(n) for n in ("boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue"))
    return F.struct(F.lit(key.replace("__", ".")).alias("key"), F.struct(value.alias("stringValue"), *others).alias("value"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, stream_ms, stream_seq, signal, observed_at, service_name, duration_ms, payload_text."""
    return entries_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def entry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream; a stream takes folders or patterns, and the table may be one file."""
    path = f"{sf_dir}/events.parquet"
    return entries_of(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))


def entries_of(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    user, micros = F.col("user_id") % 10, wall_micros(F.col("ts"))
    signal = F.when(F.col("event_type") == "error", "logs").when(F.col("event_type").isin("click", "purchase"), "metrics").otherwise("traces")
    text = F.when(signal == "logs", F.concat(F.lit("ERROR k="), k)).when(signal == "metrics", F.concat(F.lit("metric."), "event_type")).otherwise(F.col("event_type"))
    is_metric = signal == "metrics"
    service = F.when(user != 9, F.concat(F.lit("svc-"), user.cast("string")))
    pod = F.concat(F.lit("pod-"), (k % 8).cast("string"))
    host = F.when(k % 5 != 0, F.concat(F.lit("host-"), (k % 5).cast("string")))
    return e.select(
        F.col("event_id").alias("entry_id"),
        F.floor(micros / 1000).alias("stream_ms"),
        F.col("event_id").alias("stream_seq"),
        signal.alias("signal"),
        F.timestamp_micros(micros).alias("observed_at"),
        service.alias("service_name"),
        F.when(signal == "traces", F.col("value")).alias("duration_ms"),
        text.alias("payload_text"),
        F.when(is_metric, F.array(F.struct(text.alias("name"), F.col("value").alias("value"), F.lit(0).alias("rs")))).alias("metrics"),
        F.when(is_metric, F.array(text_attrs(service__name=service, k8s__pod__name=pod, host__name=host))).alias("resources"),
        k.alias("k"),
        "event_type",
        "user_id",
        "value",
    )


def _pairs(**values) -> Column:
    """Attributes as request bodies have them; those that are null are left out."""
    made = (F.when(v.isNotNull(), F.struct(F.lit(k.replace("__", ".")).alias("key"), F.struct(v.alias("stringValue")).alias("value"))) for k, v in values.items())
    return F.array_compact(F.array(*made))


def _field(number: int, raw: bytes) -> bytes:
    """A length-delimited field of a protobuf message; the lengths here need two bytes at most."""
    size = len(raw)
    return bytes([number << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + raw


def log_message(service: str | None, text: str | None, number: int | None, body: str, k: str) -> bytes:
    """A request with one log record as a protobuf message."""
    pair = lambda key, value: _field(1, key.encode()) + _field(2, _field(1, value.encode()))
    resource = _field(1, _field(1, pair("service.name", service))) if service is not None else b""
    record = (bytes([2 << 3, number]) if number is not None else b"") + (_field(3, text.encode()) if text is not None else b"") + _field(5, _field(1, body.encode())) + _field(6, pair("k", k))
    return _field(1, resource + _field(2, _field(2, record)))


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entries`` as landed requests, to be decoded: JSON bodies, and protobuf ones for logs of even ids.

    A trace request has one span, of which every seventh ``k`` carries an exception; times are numbers or strings.
    A metric request has a gauge and a sum.  The service is only in the body.
    """
    e = entries(spark, sf_dir)
    even, k = F.col("entry_id") % 2 == 0, F.col("k").cast("string")
    start = F.unix_micros("observed_at") * 1000
    event = F.struct(F.lit("exception").alias("name"), _pairs(exception__type=F.concat(F.lit("Error"), (F.col("k") % 3).cast("string")), exception__message=F.concat(F.lit("failed at "), k)).alias("attributes"))
    span = lambda at: F.struct(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("traceId"), F.concat(F.lit("s"), F.col("entry_id").cast("string")).alias("spanId"), F.col("event_type").alias("name"),
        at.alias("startTimeUnixNano"), (start + F.floor(F.col("value") * 1000) * 1000).cast("string").alias("endTimeUnixNano"), F.struct((F.col("k") % 3).alias("code")).alias("status"),
        _pairs(k=k).alias("attributes"), F.when(F.col("k") % 7 == 0, F.array(event)).otherwise(F.array().cast("array<struct<name:string,attributes:array<struct<key:string,value:struct<stringValue:string>>>>>")).alias("events"),
    )
    resource = lambda attributes: F.struct(attributes.alias("attributes")).alias("resource")
    own = resource(_pairs(service__name=F.col("service_name")))
    body = lambda outer, middle, inner, r, x: F.to_json(F.struct(F.array(F.struct(r, F.array(F.struct(F.array(x).alias(inner))).alias(middle))).alias(outer)))
    traces = F.when(even, body("resourceSpans", "scopeSpans", "spans", own, span(start))).otherwise(body("resourceSpans", "scopeSpans", "spans", own, span(start.cast("string"))))
    point = lambda on, value, number: F.when(F.lit(on), F.struct(F.array(F.struct(value.alias("asDouble"), number.alias("asInt"))).alias("dataPoints")))
    no_value, no_number = F.lit(None).cast("double"), F.lit(None).cast("string")
    # Fields that are null are left out of the text.
    metric = lambda name, gauge: F.struct(name.alias("name"), point(gauge, F.col("value"), no_number).alias("gauge"), point(not gauge, no_value, k).alias("sum"))
    measured = [metric(F.col("payload_text"), True), metric(F.lit("metric.k"), False)]
    held = resource(_pairs(service__name=F.col("service_name"), k8s__pod__name=F.concat(F.lit("pod-"), (F.col("k") % 8).cast("string")), host__name=F.when(F.col("k") % 5 != 0, F.concat(F.lit("host-"), (F.col("k") % 5).cast("string")))))
    scope = F.array(F.struct(F.array(measured[0]).alias("metrics")), F.struct(F.array(measured[1]).alias("metrics")))
    metrics = F.to_json(F.struct(F.array(F.struct(held, scope.alias("scopeMetrics"))).alias("resourceMetrics")))
    text, number, said = log_parts()
    record = F.struct(text.alias("severityText"), number.alias("severityNumber"), F.struct(said.alias("stringValue")).alias("body"), _pairs(k=k).alias("attributes"))
    logs = body("resourceLogs", "scopeLogs", "logRecords", own, record)
    ids = ["entry_id", "stream_ms", "stream_seq", "signal", "observed_at"]
    made = F.when(F.col("signal") == "traces", traces).when(F.col("signal") == "metrics", metrics).otherwise(logs)
    none = F.lit(None).cast("string").alias("service_name")
    binary = (F.col("signal") == "logs") & even
    as_json = e.where(~binary).select(*ids, none, made.cast("binary").alias("payload"))

    def run(batches):
        for batch in batches:
            out = [log_message(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(5, 10)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.nulls(batch.num_rows, pa.string()), pa.array(out, pa.binary())], RAW_NAMES)

    parts = e.where(binary).select(*ids, "service_name", text.alias("text"), number.cast("int").alias("number"), said.alias("said"), k.alias("k"))
    return as_json.union(parts.mapInArrow(run, as_json.schema))


RAW_NAMES = ["entry_id", "stream_ms", "stream_seq", "signal", "observed_at", "service_name", "payload"]


def log_parts() -> tuple[Column, Column, Column]:
    """Severity as text for even ``k``, as a number for the others; and the message."""
    even = F.col("k") % 2 == 0
    said = F.concat(F.lit("code "), F.chr(97 + F.col("entry_id") % 7), F.lit(" user "), F.col("user_id").cast("string"), F.lit(" failed k="), F.col("k").cast("string"))
    return F.when(even, "ERROR"), F.when(~even, 17), said


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric a request: entry_id, ord, observed_at, entry_service_name, resource_attrs, metric_name, kind, value."""
    return entries(spark, sf_dir).where("signal = 'metrics'").select(
        "entry_id",
        F.struct(F.col("stream_ms").alias("ms"), F.col("stream_seq").alias("seq"), F.lit(0).alias("rs"), F.lit(0).alias("ss"), F.lit(0).alias("i")).alias("ord"),
        "observed_at",
        F.col("service_name").alias("entry_service_name"),
        F.get("resources", F.lit(0)).alias("resource_attrs"),
        F.col("payload_text").alias("metric_name"),
        F.lit("gauge").alias("kind"),
        "value",
    )


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, number, body = log_parts()
    return entries(spark, sf_dir).where("signal = 'logs'").select(
        "entry_id",
        F.struct(F.col("stream_ms").alias("ms"), F.col("stream_seq").alias("seq"), F.lit(0).alias("rs"), F.lit(0).alias("ss"), F.lit(0).alias("i")).alias("ord"),
        "observed_at",
        F.col("service_name").alias("entry_service_name"),
        F.col("service_name").alias("resource_service_name"),
        text.alias("severity_text"),
        number.alias("severity_number"),
        body.alias("body"),
        text_attrs(k=F.col("k").cast("string")).alias("attrs"),
    )


#: Columns of a line that its spans show; lines of an order that are equal in all of them are the same spans.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_tax")


def spans(spark: SparkSession, sf_dir: str, calls_only: bool = False) -> DataFrame:
    """Spans of the traces: an order is the root, its lines are children, even lines have a grandchild.

    ``calls_only``: the children alone, which are the spans with a database statement.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nano = lambda micros: (micros * 1000).cast("decimal(20,0)")
    o = read("orders").join(read("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    base = o.select("o_orderkey", wall_micros(F.col("o_orderdate")).alias("at"), "c_mktsegment", "o_orderpriority")
    no_attrs = F.array().cast(ATTRS)

    def made(trace, span, parent, service, name, start_us, ms, status, attrs, rs: int, i) -> Column:
        start = nano(start_us)
        ord_ = F.struct(F.floor(start_us / 1000).alias("ms"), trace.alias("seq"), F.lit(rs).alias("rs"), F.lit(0).alias("ss"), i.cast("int").alias("i"))
        return F.struct(
            trace.alias("entry_id"),
            ord_.alias("ord"),
            F.timestamp_micros(start_us).alias("observed_at"),
            service.alias("entry_service_name"),
            service.alias("resource_service_name"),
            F.concat(F.lit("t"), trace.cast("string")).alias("trace_id"),
            span.alias("span_id"),
            parent.alias("parent_span_id"),
            name.alias("name"),
            start.alias("start_ns"),
            nano(start_us + ms * 1000).alias("end_ns"),
            status.alias("status_code"),
            no_attrs.alias("resource_attrs"),
            attrs.alias("attrs"),
        )

    key = F.col("o_orderkey")
    roots = base.select(made(key, F.concat(F.lit("o"), key.cast("string")), F.lit(""), F.concat(F.lit("seg-"), "c_mktsegment"), F.concat(F.lit("order "), "o_orderpriority"), F.col("at"), F.lit(1000), F.lit(0), no_attrs, 0, F.lit(0)).alias("s"))
    numbered = read("lineitem").select("l_orderkey", *LINE).withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)))
    lines = numbered.join(base.select("o_orderkey", "at"), F.col("l_orderkey") == key)
    place = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("seq").cast("string"))
    at = F.col("at") + F.col("seq") * 1000
    supplier = F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 5).cast("string"))
    missing = F.concat(F.lit("missing-"), F.col("l_partkey").cast("string"))
    orphan = F.col("l_partkey") % 50 == 0
    quantity = F.col("l_quantity").cast("int")
    statement = F.concat(F.lit("SELECT * FROM part_"), "l_returnflag", F.lit(" WHERE p_partkey = "), F.col("l_partkey").cast("string"), F.lit(" AND qty > "), quantity.cast("string"))
    peer = F.when(orphan, F.concat(F.lit("peer-"), (F.col("l_suppkey") % 3).cast("string")))
    system = F.when(F.col("l_linestatus") == "F", "postgresql").otherwise("mysql")
    # Only the peer may be missing, so no filter has to run over each row's attributes.
    known = (_text_attr("db.statement", statement), _text_attr("db.system", system))
    child_attrs = F.when(peer.isNotNull(), F.array(*known, _text_attr("peer.service", peer))).otherwise(F.array(*known))
    child = made(key, F.concat(F.lit("l"), place), F.when(orphan, missing).otherwise(F.concat(F.lit("o"), key.cast("string"))), supplier, F.lit("query part"), at, quantity * 10, F.when(F.col("l_returnflag") == "R", 2).otherwise(0), child_attrs, 1, F.col("seq"))
    deeper = made(key, F.concat(F.lit("g"), place), F.concat(F.lit("l"), place), F.when(F.col("l_tax") > 0.04, supplier).otherwise(F.lit("cache")), F.lit("lookup"), at + 1000, quantity, F.lit(0), no_attrs, 2, F.col("seq"))
    if calls_only:
        return lines.select(child.alias("s")).select("s.*")
    # A line gives its span and, every second one, another below it: one pass over the numbered lines for both.
    below = lines.select(F.explode(F.array_compact(F.array(child, F.when(F.col("seq") % 2 == 0, deeper)))).alias("s"))
    return roots.union(below).select("s.*")
