"""Scalar expressions of telemetry analytics, all built from Spark's own functions.

Everything here returns ``Column``s that stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a decimal number looks like to the dialect (no blanks around it, no type suffix).
NUMBER_TEXT = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
# Numbers inside statements, and blobs and digits inside messages.
STATEMENT_NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
MESSAGE_HEX = r"(?U)\b[0-9a-f]{8,}(?:-[0-9a-f]+)*\b"
MAX_U64 = "18446744073709551615"


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp read as UTC, in any session time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def bucket_start(value: Column, width: int | Column) -> Column:
    """Start of the bucket that holds ``value``; floors below zero too."""
    w = F.lit(width) if isinstance(width, int) else width
    return value - F.pmod(value, w)


def number_of(text: Column) -> Column:
    """A text as a double, or null where it isn't a plain number."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def nanos(raw: Column) -> Column:
    """Unsigned 64-bit nanoseconds from a JSON number or string; anything else is 0, too large is the maximum."""
    whole = F.when(raw.rlike(r"^[0-9]{1,38}$"), raw.try_cast("decimal(38,0)"))
    real = F.when(raw.rlike(r"^[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?$"), F.least(raw.try_cast("double"), F.lit(float(MAX_U64))))
    limit = F.lit(MAX_U64).cast("decimal(38,0)")
    return F.coalesce(F.when(whole <= limit, whole), F.when(real.isNotNull(), F.least(F.floor(real.cast("decimal(38,6)")).cast("decimal(38,0)"), limit)), F.lit(0).cast("decimal(38,0)")).cast("decimal(20,0)")


def duration_ns(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0).cast("decimal(20,0)"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_statement(text: Column) -> Column:
    """A statement without its numbers; text literals stay."""
    return squeeze(F.regexp_replace(text, STATEMENT_NUMBER, "?"))


def normalize_message(text: Column) -> Column:
    """A message in lower case without blobs and digits."""
    hexless = F.regexp_replace(lower_ascii(text), MESSAGE_HEX, "<hex>")
    return squeeze(F.regexp_replace(hexless, r"(?U)\d+", "<num>"))


def fingerprint(kind: Column, message: Column) -> Column:
    """First 16 hex digits of SHA-256 over the normalised type, a zero byte and the normalised message."""
    both = F.concat(normalize_message(F.coalesce(kind, F.lit(""))), F.lit("\0"), normalize_message(F.coalesce(message, F.lit(""))))
    return F.substring(F.sha2(both.cast("binary"), 256), 1, 16)


def signature(kind: Column, message: Column) -> Column:
    """How an error group is shown: ``type: message``, or the part that there is."""
    k, m = F.coalesce(kind, F.lit("")), F.coalesce(message, F.lit(""))
    return F.when((k != "") & (m != ""), F.concat_ws(": ", k, m)).when(k != "", k).when(m != "", m).otherwise(F.lit("<unknown error>"))


def sanitize_service(name: Column) -> Column:
    """A service name fit for a key: control characters, blanks and colons become ``_``; 200 bytes at most."""
    clean = F.regexp_replace(name, r"(?U)[\p{Cntrl}\s:]", "_")
    return F.when(F.octet_length(clean) <= 200, clean).otherwise(F.decode(F.substring(F.encode(clean, "UTF-8"), 1, 200), "UTF-8"))


def percentile(p: float, value: str) -> Column:
    """Exact nearest-rank percentile of a column: the value at rank ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


# --- attributes: arrays of (key, value); keys may repeat ---


def attribute_text(attrs: Column, key: str) -> Column:
    """Value of the first attribute of the key that holds a string."""
    return F.get(F.filter(attrs, lambda a: (a["key"] == key) & a["value"]["stringValue"].isNotNull()), F.lit(0))["value"]["stringValue"]


def attribute_scalar(attrs: Column, key: str) -> Column:
    """The first attribute of the key as text, if it is a scalar."""
    v = F.get(F.filter(attrs, lambda a: a["key"] == key), F.lit(0))["value"]
    return F.coalesce(v["stringValue"], v["boolValue"], v["intValue"], v["doubleValue"])


def has_attribute(attrs: Column, key: str) -> Column:
    return F.coalesce(F.exists(attrs, lambda a: a["key"] == key), F.lit(False))


def attribute_json(value: Column) -> Column:
    """Any attribute value as JSON text."""
    quoted = F.regexp_replace(F.to_json(F.array(value["stringValue"])), r"^\[|\]$", "")
    return F.coalesce(
        F.when(value["stringValue"].isNotNull(), quoted), value["boolValue"], value["intValue"], value["doubleValue"], value["bytesValue"], value["arrayValue"], value["kvlistValue"]
    )
