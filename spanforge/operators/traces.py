"""Trace search, look-up, waterfall and service map over spans."""

from __future__ import annotations

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import attribute_json, attribute_scalar, attribute_text, duration_ns, has_attribute
from .selection import at_ranks
from .tree import preorder

ERROR = 2
PEER_KEYS = ("peer.service", "server.address", "net.peer.name")
WATERFALL = "trace_id string, position int, depth int, span_id string, parent_span_id string, name string, service_name string, start_ms double, duration_ms double, status_code int"
#: Spans of a trace that one task may walk.
WALKED = 50_000


def _has(attrs: str, key: str, value: str | None) -> Column:
    if value is None:
        return has_attribute(F.col(attrs), key)
    return F.coalesce(F.lower(attribute_scalar(F.col(attrs), key)).contains(value.lower()), F.lit(False))


def summaries(spans: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """One row a trace; spans without a trace id belong to none. One aggregation, partial before the exchange."""
    root = F.when(F.coalesce("parent_span_id", F.lit("")) == "", F.struct("ord", "name"))
    service = F.coalesce("resource_service_name", "entry_service_name")
    grouped = spans.where(F.coalesce("trace_id", F.lit("")) != "").groupBy("trace_id").agg(
        F.min("start_ns").alias("started_at_ns"),
        F.max("end_ns").alias("ended_at_ns"),
        F.count(F.lit(1)).alias("span_count"),
        F.coalesce(F.bool_or(F.col("status_code") == ERROR), F.lit(False)).alias("has_error"),
        F.array_sort(F.collect_set(F.when(service != "", service))).alias("service_names"),
        F.min(root)["name"].alias("root_span_name"),
        *(extra or []),
    )
    length = duration_ns(F.col("started_at_ns"), F.col("ended_at_ns"))
    return grouped.withColumn("duration_ns", length).withColumn("duration_ms", F.floor(length / 1000000).cast("long")).drop("ended_at_ns")


def search(spans: DataFrame, service: str | None = None, min_duration_ms: int | None = None, span_name: str | None = None, only_errors: bool = False, attribute: tuple[str, str | None] | None = None) -> DataFrame:
    """Summaries, latest start first.  Name and attribute must be met by one span of the trace together."""
    one = F.lit(True)
    if span_name is not None:
        one = one & F.lower("name").contains(span_name.lower())
    if attribute is not None:
        one = one & (_has("attrs", *attribute) | _has("resource_attrs", *attribute))
    asked = span_name is not None or attribute is not None
    found = summaries(spans, [F.bool_or(one).alias("_met")] if asked else None)
    if asked:
        found = found.where("_met").drop("_met")
    if service is not None:
        found = found.where(F.array_contains("service_names", service))
    if min_duration_ms is not None:
        found = found.where(F.col("duration_ms") >= min_duration_ms)
    if only_errors:
        found = found.where("has_error")
    return found.orderBy(F.desc("started_at_ns"), "trace_id")


def parse_attribute(text: str) -> tuple[str, str | None]:
    """``key`` or ``key=value`` of a search request, both trimmed; an empty value asks for the key alone."""
    key, _, value = text.partition("=")
    return key.strip(), value.strip() or None


def truthy(text: str | None, strict: bool = False) -> bool:
    """Request flags: anything but a no, or in strict use only a clear yes."""
    if text is None:
        return False
    return text.lower() in ("1", "true", "yes", "on") if strict else text.lower() not in ("false", "0", "no", "off")


def lookup(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of a trace by start, arrival order at ties."""
    return spans.where(F.col("trace_id") == trace_id).orderBy("start_ns", "ord")


def attribute_map(attrs: Column) -> Column:
    """Attributes as a map of JSON texts; of repeated keys the last one counts."""
    named = F.filter(attrs, lambda a: a["key"].isNotNull())
    last = F.filter(named, lambda a, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda b: b["key"] == a["key"]))
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"], attribute_json(a["value"]))))


def depth_first(ids: list[str], parents: list[str], starts: list[float]) -> list[tuple[int, int]]:
    """(span, depth) of one trace's spans, given as they arrived, in pre-order, siblings by start; spans that no root reaches come last."""
    known, below, todo = set(ids), {}, []
    for i in sorted(range(len(ids)), key=starts.__getitem__):
        if not parents[i] or parents[i] not in known:
            todo.append((i, 0))
        else:
            below.setdefault(parents[i], []).append(i)
    todo.reverse()
    seen, out = set(), []
    while todo:
        i, d = todo.pop()
        if i in seen:
            continue
        seen.add(i)
        out.append((i, d))
        todo += [(c, d + 1) for c in reversed(below.get(ids[i], ())) if c not in seen]
    return out + [(i, 0) for i in range(len(ids)) if i not in seen]


def _walk(batches):
    """Rows in the order of trace and arrival; many traces a batch, the last of which may go on in the next one."""

    def walked(table: pa.Table) -> pa.RecordBatch:
        trace = table.column("trace_id").to_pylist()
        ids, parents, starts = (table.column(c).to_pylist() for c in ("span_id", "parent_span_id", "start_ms"))
        cuts = [i for i in range(len(trace)) if i == 0 or trace[i] != trace[i - 1]] + [len(trace)]
        order, position, depth = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            for n, (i, d) in enumerate(depth_first(ids[a:b], parents[a:b], starts[a:b])):
                order.append(a + i)
                position.append(n)
                depth.append(d)
        rows = table.take(pa.array(order, pa.int64()))
        names = ["span_id", "parent_span_id", "name", "service_name", "start_ms", "duration_ms", "status_code"]
        made = pa.table([rows.column("trace_id"), pa.array(position, pa.int32()), pa.array(depth, pa.int32()), *(rows.column(c) for c in names)], ["trace_id", "position", "depth", *names])
        return made.combine_chunks().to_batches()[0]

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = table.column("trace_id")[-1]
        open_ = pc.index(table.column("trace_id"), last).as_py()
        if open_:
            yield walked(table.slice(0, open_))
        held = table.slice(open_)
    if held is not None:
        yield walked(held)


def waterfall(spans: DataFrame, trace_id: str | None = None, walked: int = WALKED) -> DataFrame:
    """Spans of one trace, or of all, in display order.

    Traces of up to ``walked`` spans are walked in Arrow batches, many sorted traces in each; larger ones are placed by
    ``tree.preorder``, whose rounds split them, but for those in which an id is not clear.
    """
    rows = spans.where(F.col("trace_id") == trace_id) if trace_id is not None else spans.where(F.coalesce("trace_id", F.lit("")) != "")
    flat = rows.select(
        "trace_id",
        "ord",
        F.coalesce("span_id", F.lit("")).alias("span_id"),
        F.coalesce("parent_span_id", F.lit("")).alias("parent_span_id"),
        "name",
        F.coalesce("resource_service_name", "entry_service_name").alias("service_name"),
        (F.col("start_ns") / 1e6).cast("double").alias("start_ms"),
        (duration_ns(F.col("start_ns"), F.col("end_ns")) / 1e6).cast("double").alias("duration_ms"),
        F.coalesce("status_code", F.lit(0)).cast("int").alias("status_code"),
    )
    large = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > walked).select("trace_id")
    if large.isEmpty():
        return _walked(flat)
    placed, unclear = preorder(flat.join(large, "trace_id", "left_semi"))
    rest = flat.join(large, "trace_id", "left_anti")
    return placed.select(*(c.split()[0] for c in WATERFALL.split(", "))).unionByName(_walked(rest if unclear is None else rest.unionByName(unclear)))


def _walked(rows: DataFrame) -> DataFrame:
    arrived = rows.withColumn("ord", F.concat_ws("-", *(F.lpad(F.col(f"ord.{p}").cast("string"), 20, "0") for p in ("ms", "seq", "rs", "ss", "i"))))
    return arrived.repartition("trace_id").sortWithinPartitions("trace_id", "ord").mapInArrow(_walk, WATERFALL)


def _recent(spans: DataFrame, now: datetime | None, lookback_ms: int) -> DataFrame:
    """Spans of the look-back, its bound included; 0 or less is no bound."""
    return spans.where(F.col("observed_at") >= F.lit(now - timedelta(milliseconds=lookback_ms))) if now is not None and lookback_ms > 0 else spans


def _owned(spans: DataFrame, now: datetime | None, lookback_ms: int) -> DataFrame:
    return _recent(spans, now, lookback_ms).where(F.coalesce("resource_service_name", F.lit("")) != "")


def service_nodes(spans: DataFrame, now: datetime | None = None, lookback_ms: int = 0) -> DataFrame:
    """service, span_count, error_count, p95_ms."""
    ms = F.when(F.col("end_ns") >= F.col("start_ns"), (F.col("end_ns") - F.col("start_ns")) / 1e6).otherwise(F.lit(0.0)).cast("double")
    rows = _owned(spans, now, lookback_ms).select(F.col("resource_service_name").alias("service"), "status_code", ms.alias("ms"))
    found = at_ranks(rows, ["service"], "ms", {"p95_ms": 0.95}, {"error_count": F.count_if(F.col("status_code") == ERROR)})
    return found.select("service", F.col("n").alias("span_count"), "error_count", "p95_ms").orderBy("service")


def service_edges(spans: DataFrame, now: datetime | None = None, lookback_ms: int = 0) -> DataFrame:
    """source, target, calls, error_rate: calls from the service of a span's parent to the span's own.

    The last span to arrive with an id owns the id.  A span whose parent is not among the spans calls the peer that
    its attributes name.  The build side is one row a span id, aggregated before the join.
    """
    rows = _owned(spans, now, lookback_ms)
    owners = rows.where(F.coalesce("span_id", F.lit("")) != "").groupBy("span_id").agg(F.max(F.struct("ord", "resource_service_name"))["resource_service_name"].alias("owner"))
    children = rows.where(F.coalesce("parent_span_id", F.lit("")) != "").select("parent_span_id", F.col("resource_service_name").alias("own"), (F.col("status_code") == ERROR).alias("failed"), F.coalesce(*(attribute_text(F.col("attrs"), k) for k in PEER_KEYS)).alias("peer"))
    joined = children.join(owners.withColumnRenamed("span_id", "parent_span_id"), "parent_span_id", "left")
    known = F.col("owner").isNotNull()
    edges = joined.select(F.when(known, F.col("owner")).otherwise(F.col("own")).alias("source"), F.when(known, F.col("own")).otherwise(F.col("peer")).alias("target"), F.coalesce("failed", F.lit(False)).alias("failed"))
    edges = edges.where((F.col("source") != F.col("target")) & (F.col("target") != ""))
    return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("calls"), F.avg(F.col("failed").cast("double")).alias("error_rate")).orderBy("source", "target")
