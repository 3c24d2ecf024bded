"""Column types of telemetry: what request bodies hold and what the decoded tables hold.

Scalars that senders write as number or string are read as strings and converted by expressions.
"""

VALUE = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>"
ATTRS = f"array<struct<key:string,value:{VALUE}>>"
RESOURCES = f"array<{ATTRS}>"
METRICS = "array<struct<name:string,value:double,rs:int>>"
RESOURCE = f"struct<attributes:{ATTRS}>"
SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"status:struct<code:string,message:string>,attributes:{ATTRS},events:array<struct<name:string,timeUnixNano:string,attributes:{ATTRS}>>>"
)
#: A quoted double is no number, so doubles are read as such; a whole number counts quoted or not.
POINTS = f"struct<dataPoints:array<struct<asDouble:double,asInt:string,sum:double,attributes:{ATTRS}>>>"
KINDS = ("sum", "gauge", "histogram", "summary", "exponentialHistogram")
METRIC = "struct<name:string," + ",".join(f"{k}:{POINTS}" for k in KINDS) + ">"
RECORD = f"struct<severityText:string,severityNumber:string,body:string,attributes:{ATTRS}>"
BODIES = {
    "traces": f"struct<resourceSpans:array<struct<resource:{RESOURCE},scopeSpans:array<struct<spans:array<{SPAN}>>>>>>",
    "metrics": f"struct<resourceMetrics:array<struct<resource:{RESOURCE},scopeMetrics:array<struct<metrics:array<{METRIC}>>>>>>",
    "logs": f"struct<resourceLogs:array<struct<resource:{RESOURCE},scopeLogs:array<struct<logRecords:array<{RECORD}>>>>>>",
}
#: Metrics as previews show them, any scalar as it stands.
SHOWN_METRICS = BODIES["metrics"].replace("asDouble:double", "asDouble:string").replace("sum:double", "sum:string")
RAW_ENTRY = "entry_id bigint, stream_ms bigint, stream_seq bigint, signal string, observed_at timestamp, service_name string, payload binary"
