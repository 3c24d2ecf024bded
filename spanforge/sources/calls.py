"""Requests that come as remote calls: framed protobuf messages, one a call.

A call names its method by path and its framing by media type: length-prefixed messages, the same with trailers behind
them, that as base64 text, or the bare message.  ``normalize`` gives each its signal, its payload without frames, its
``transport`` and the ``code`` that a server would answer with; payloads then go through ``otlp`` like any other.  What
differs behind it: the service's name comes by a rule of its own (``name_services``), and calls put nothing into
rollups and the attribute index.
"""

from __future__ import annotations

import base64
import binascii
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .otlp import _OUTER, MAX_BODY, BodyError, decompress

# Paths of the methods, media types of the framings, and the public status codes.
METHODS = {f"/opentelemetry.proto.collector.{package}.v1.{service}/Export": signal for package, service, signal in (("trace", "TraceService", "traces"), ("metrics", "MetricsService", "metrics"), ("logs", "LogsService", "logs"))}
FRAMINGS = {
    "application/grpc": "grpc", "application/grpc+proto": "grpc", "application/grpc-web": "grpc-web", "application/grpc-web+proto": "grpc-web",
    "application/grpc-web-text": "grpc-web-text", "application/grpc-web-text+proto": "grpc-web-text", "application/proto": "connect",
}
OK, INVALID, EXHAUSTED, UNIMPLEMENTED, INTERNAL = 0, 3, 8, 12, 13
TRAILERS, COMPRESSED = 0x80, 0x01


class CallError(ValueError):
    def __init__(self, code: int, detail: str):
        super().__init__(detail)
        self.code = code


def _inflate(body: bytes, encoding: str | None) -> bytes:
    try:
        return decompress(body, encoding)
    except BodyError as e:
        raise CallError({413: EXHAUSTED, 415: UNIMPLEMENTED}.get(e.status, INTERNAL), str(e)) from e


def frames(body: bytes) -> list[tuple[int, bytes]]:
    """(flags, data) of each frame: a byte of flags, four of length, then the data."""
    out, at = [], 0
    while at < len(body):
        size = int.from_bytes(body[at + 1 : at + 5], "big")
        data = body[at + 5 : at + 5 + size]
        if at + 5 > len(body) or len(data) != size:
            raise CallError(INTERNAL, "truncated frame")
        out.append((body[at], data))
        at += 5 + size
    return out


def unframe(body: bytes, framing: str, encoding: str | None) -> bytes:
    """The one message of a call's body; ``encoding`` holds for frames that are marked as compressed, and for a bare message."""
    if framing == "connect":
        return _inflate(body, encoding)
    if framing == "grpc-web-text":
        try:
            # Senders may break lines, and may encode each frame for itself, so padding can stand inside.
            body = b"".join(base64.b64decode(x, validate=True) for x in re.findall(rb"[^=]+={0,2}", b"".join(body.split())))
        except binascii.Error as e:
            raise CallError(INTERNAL, "bad base64") from e
    found, messages = frames(body), []
    for n, (flags, data) in enumerate(found):
        if flags & TRAILERS:
            if framing == "grpc" or n != len(found) - 1:
                raise CallError(INTERNAL, "misplaced trailers")
        elif flags not in (0, COMPRESSED):
            raise CallError(INTERNAL, f"flags {flags}")
        elif flags == COMPRESSED and (encoding or "identity").strip() in ("", "identity"):
            raise CallError(INTERNAL, "compressed frame without an encoding")
        else:
            messages.append(_inflate(data, encoding) if flags else data)
    if len(messages) != 1:
        raise CallError(UNIMPLEMENTED if messages else INTERNAL, f"{len(messages)} messages")
    if len(messages[0]) > MAX_BODY:
        raise CallError(EXHAUSTED, "message too large")
    return messages[0]


def read_call(path: str | None, content_type: str | None, encoding: str | None, body: bytes | None) -> tuple[str | None, bytes | None, str | None, int]:
    """(signal, payload, transport, code) of a call."""
    signal, framing = METHODS.get(path or ""), FRAMINGS.get((content_type or "").split(";")[0].strip().lower())
    if signal is None or framing is None:
        return signal, None, framing, UNIMPLEMENTED
    try:
        return signal, unframe(body or b"", framing, encoding), framing, OK
    except CallError as e:
        return signal, None, framing, e.code


def normalize(raw: DataFrame) -> DataFrame:
    """Calls (path, content_type, content_encoding, body) with ``signal``, ``payload``, ``transport`` and ``code``."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            columns = (batch.column(names.index(n)).to_pylist() for n in ("path", "content_type", "content_encoding", "body"))
            made = [read_call(*row) for row in zip(*columns)]
            types = (pa.string(), pa.binary(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in made], t) for i, t in enumerate(types))], [*names, "signal", "payload", "transport", "code"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    return raw.mapInArrow(run, f"{fields}, signal string, payload binary, transport string, code int")


def service_name(p: Column, outer: str) -> Column:
    """The first resource block that names its service: in a block the first ``service.name`` that is text, unless one without any value stands before it."""

    def of(block: Column) -> Column:
        own = F.filter(block["resource"]["attributes"], lambda a: a["key"] == "service.name")
        return F.get(F.filter(own, lambda a: a["value"].isNull() | a["value"]["stringValue"].isNotNull()), F.lit(0))["value"]["stringValue"]

    return F.get(F.filter(F.transform(p[outer], of), lambda n: n.isNotNull()), F.lit(0))


def name_services(bodies: DataFrame) -> DataFrame:
    """``service_name`` of parsed calls, and no other name later: ``transport`` marks rows whose name is settled."""
    found = F.coalesce(*(F.when(F.col("signal") == s, service_name(F.col(f"parsed.{s}"), o)) for s, o in _OUTER.items()))
    return bodies.withColumn("service_name", found)
