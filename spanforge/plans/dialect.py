"""The query dialect: text to a checked statement, statement to a DataFrame.

    SELECT * | column | fn(* | column) [AS alias], ...  FROM traces | metrics | logs
    [WHERE condition] [GROUP BY column, ...] [LIMIT n]

Comparisons never give null: a missing value differs from everything.  ``spark.sql`` would answer otherwise, so
conditions become ``Column``s here; projection, filter and partition pruning are left to Catalyst.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import NUMBER_TEXT, lower_ascii, number_of

#: Rows of a result at most.
MAX_ROWS = 10_000
SOURCES = ("traces", "metrics", "logs")
FUNCTIONS = ("count", "sum", "avg", "min", "max")
TEXT_COLUMNS = {"service_name": "service_name", "signal": "signal", "payload": "payload_text"}
NUMBER_COLUMNS = {"observed_at_ms": "observed_at", "duration_ms": "duration_ms"}
STAR = ("observed_at_ms", "signal", "service_name", "duration_ms")


class QueryError(ValueError):
    """``kind`` names the error; ``offset`` is a byte offset where there is one."""

    def __init__(self, kind: str, detail: str, offset: int | None = None):
        super().__init__(f"{kind}: {detail}" + ("" if offset is None else f" at offset {offset}"))
        self.kind, self.detail, self.offset = kind, detail, offset


@dataclass(frozen=True)
class Item:
    """A projection: ``*``, a column, or an aggregate of a column or of all rows."""

    column: str | None
    fn: str | None = None
    name: str = ""


@dataclass(frozen=True)
class Statement:
    items: tuple[Item, ...]
    source: str
    where: tuple | None = None  # ("and" | "or", left, right) or (operator, column, literal)
    group_by: tuple[str, ...] = ()
    limit: int | None = None

    @property
    def aggregates(self) -> bool:
        return any(i.fn for i in self.items)


_LEXEME = re.compile(
    r"""(?P<blank>[ \t\n\r\f]+)|(?P<text>'[^']*'|"[^"]*")|(?P<number>-?[0-9]+(?:\.[0-9]*)?|-?\.[0-9]+|-\.?)|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<mark><=|<>|!=|>=|[(),*=<>])"""
)
_COMPARE = {"=": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def lex(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, byte offset) of each lexeme."""
    out, at = [], 0
    while at < len(text):
        offset = len(text[:at].encode())
        m = _LEXEME.match(text, at)
        if not m:
            if text[at] in "'\"":
                raise QueryError("UnterminatedString", text[at:], offset)
            raise QueryError("Unexpected", text[at], offset)
        at, kind, piece = m.end(), m.lastgroup, m.group()
        if kind == "number" and not re.search("[0-9]", piece):
            raise QueryError("Unexpected" if piece == "-" else "InvalidNumber", piece, offset)
        if kind == "number" and piece.lstrip("-").startswith("."):
            raise QueryError("Unexpected" if piece[0] == "." else "InvalidNumber", piece, offset)
        if kind != "blank":
            out.append((kind, piece, offset))
    return out


@dataclass
class _Reader:
    lexemes: list[tuple[str, str, int]]
    at: int = 0
    end: tuple[str, str, int] = field(default=("end", "", -1))

    def look(self, ahead: int = 0) -> tuple[str, str, int]:
        i = self.at + ahead
        return self.lexemes[i] if i < len(self.lexemes) else self.end

    def take(self, wanted: str, *kinds: str) -> str:
        """The next lexeme if it is of a kind or mark that is wanted."""
        kind, piece, offset = self.look()
        if kind == "end":
            raise QueryError("UnexpectedEof", wanted)
        if kind not in kinds and not (kind == "mark" and piece in kinds):
            raise QueryError("Unexpected", f"{piece!r} (expected {wanted})", offset)
        self.at += 1
        return piece

    def word(self, keyword: str) -> bool:
        kind, piece, _ = self.look()
        if kind == "name" and piece.upper() == keyword:
            self.at += 1
            return True
        return False

    def need(self, keyword: str) -> None:
        if not self.word(keyword):
            kind, piece, offset = self.look()
            raise QueryError("UnexpectedEof", keyword) if kind == "end" else QueryError("Unexpected", f"{piece!r} (expected {keyword})", offset)

    def listed(self, one) -> tuple:
        out = [one()]
        while self.look()[:2] == ("mark", ","):
            self.at += 1
            out.append(one())
        return tuple(out)

    def item(self) -> Item:
        if self.look()[:2] == ("mark", "*"):
            self.at += 1
            return Item(None)
        name = self.take("column or aggregate", "name")
        if self.look()[:2] != ("mark", "("):
            if self.word("AS"):
                raise QueryError("Unexpected", "alias of a plain column", self.look()[2])
            return Item(name, name=name)
        self.at += 1
        fn = name.lower()
        if fn not in FUNCTIONS:
            raise QueryError("UnknownAggregate", name)
        arg = self.take("* or column", "name", "*")
        self.take("')'", ")")
        alias = f"{fn}({arg})"
        if self.word("AS"):
            quoted = self.look()[0] == "text"
            alias = self.take("alias", "name", "text")
            alias = alias[1:-1] if quoted else alias
        return Item(None if arg == "*" else arg, fn, alias)

    def condition(self) -> tuple:
        """Operators and operands on two stacks; AND binds tighter than OR."""
        tight = {"or": 1, "and": 2}
        done: list[tuple] = []
        waiting: list[str] = []

        def reduce() -> None:
            right, left = done.pop(), done.pop()
            done.append((waiting.pop(), left, right))

        while True:
            while self.look()[:2] == ("mark", "("):
                waiting.append("(")
                self.at += 1
            done.append(self.comparison())
            while self.look()[:2] == ("mark", ")") and "(" in waiting:
                self.at += 1
                while waiting[-1] != "(":
                    reduce()
                waiting.pop()
            joint = "and" if self.word("AND") else "or" if self.word("OR") else None
            if joint is None:
                break
            while waiting and waiting[-1] != "(" and tight[waiting[-1]] >= tight[joint]:
                reduce()
            waiting.append(joint)
        if "(" in waiting:
            self.take("')'", ")")
        while waiting:
            reduce()
        return done[0]

    def comparison(self) -> tuple:
        column = self.take("column", "name")
        op = "like" if self.word("LIKE") else _COMPARE.get(self.take("comparison", *_COMPARE))
        kind, piece, _ = self.look()
        self.take("literal", "text", "number")
        return op, column, piece[1:-1] if kind == "text" else float(piece)


def parse(text: str) -> Statement:
    r = _Reader(lex(text))
    r.need("SELECT")
    items = r.listed(r.item)
    r.need("FROM")
    source = r.take("source", "name")
    if source.lower() not in SOURCES:
        raise QueryError("UnknownSource", source)
    where = r.condition() if r.word("WHERE") else None
    group: tuple[str, ...] = ()
    if r.word("GROUP"):
        r.need("BY")
        group = r.listed(lambda: r.take("column", "name"))
    limit = None
    if r.word("LIMIT"):
        kind, piece, _ = r.look()
        if kind == "end":
            raise QueryError("UnexpectedEof", "LIMIT")
        if kind != "number" or float(piece) < 0 or float(piece) % 1:
            raise QueryError("InvalidLimit", piece)
        r.at += 1
        limit = int(float(piece))
    kind, piece, offset = r.look()
    if kind != "end":
        raise QueryError("Unexpected", f"{piece!r} (expected end of input)", offset)
    return Statement(items, source.lower(), where, group, limit)


def check(s: Statement) -> Statement:
    """Column and grouping rules; raises before anything is scanned."""

    def columns(w: tuple | None):
        if w is not None:
            if w[0] in ("and", "or"):
                yield from columns(w[1])
                yield from columns(w[2])
            else:
                yield w[1]

    for c in [*(i.column for i in s.items if i.column), *columns(s.where), *s.group_by]:
        if c.lower() not in TEXT_COLUMNS and c.lower() not in NUMBER_COLUMNS:
            raise QueryError("UnknownColumn", c)
    plain = [i.column.lower() for i in s.items if i.column and not i.fn]
    grouped = [c.lower() for c in s.group_by]
    if s.aggregates:
        if any(not i.fn and i.column is None for i in s.items):
            raise QueryError("StarWithAggregate", "* beside an aggregate has no row to stand for")
        for c in plain:
            if c not in grouped:
                raise QueryError("NonAggregateNotInGroupBy", c)
    for c in grouped:
        if c not in plain:
            raise QueryError("GroupByNotInSelect", c)
    return s


def _value(name: str) -> Column:
    name = name.lower()
    if name == "observed_at_ms":
        return F.unix_millis("observed_at").cast("double")
    return F.col(NUMBER_COLUMNS[name]) if name in NUMBER_COLUMNS else F.col(TEXT_COLUMNS[name])


_ORDER = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _numbers(x: Column, op: str, y: float) -> Column:
    """Comparison of doubles in which NaN differs from everything, also from a missing ``x``; else null for null ``x``."""
    if op == "like":
        return F.lit(False)
    if math.isnan(y):
        return F.lit(op == "!=")
    plain = _ORDER[op](x, F.lit(y))
    if op == "!=":
        return F.isnan(x) | plain
    # Spark orders NaN after all numbers, so only these two need a guard.
    return ~F.isnan(x) & plain if op in (">", ">=") else plain


def _as_number(text: str) -> float | None:
    return float(text) if re.fullmatch(NUMBER_TEXT.strip("^$"), text) else None


def _compare(op: str, column: str, literal: str | float) -> Column:
    """A missing value meets only ``!=``.

    The dialect has no NOT, so a null condition can only end as a row not taken, as false would: all comparisons
    but ``!=`` stay plain, which lets Spark push them into the scan.
    """
    x = _value(column)
    if column.lower() in NUMBER_COLUMNS:
        y = literal if isinstance(literal, float) else _as_number(literal)
        found = F.lit(False) if y is None else _numbers(x, op, y)
    elif isinstance(literal, float):
        found = _numbers(number_of(x), op, literal)
    elif op == "like":
        found = x.ilike(literal.replace("\\", "\\\\"))
    elif op in ("=", "!="):
        found = _ORDER[op](lower_ascii(x), F.lit("".join(c.lower() if c.isascii() else c for c in literal)))
    else:
        found = _ORDER[op](x, F.lit(literal))
    if op != "!=":
        return found
    unlike = column.lower() in NUMBER_COLUMNS and not isinstance(literal, float) and _as_number(literal) is None
    return F.lit(True) if unlike else F.coalesce(found, F.lit(True))


def condition(w: tuple) -> Column:
    if w[0] in ("and", "or"):
        return (operator.and_ if w[0] == "and" else operator.or_)(condition(w[1]), condition(w[2]))
    return _compare(*w)


def number_text(n: Column) -> Column:
    """A double as the dialect prints it: no trailing .0, no exponent."""
    whole = F.when((n == F.floor(n)) & (F.abs(n) < 1e37), n.cast("decimal(38,0)").cast("string"))
    text = n.cast("string")
    plain = F.when(text.contains("E"), F.regexp_replace(n.cast("decimal(38,18)").cast("string"), "0+$", "")).otherwise(text)
    return F.coalesce(whole, plain)


def group_order(columns: tuple[str, ...]) -> Column:
    """The order of groups: their tagged keys as text; numbers before nulls before strings."""
    keys = []
    for c in columns:
        x = _value(c)
        tagged = F.concat(F.lit("#"), number_text(x)) if c.lower() in NUMBER_COLUMNS else F.concat(F.lit("s"), x)
        keys.append(F.coalesce(tagged, F.lit("n")))
    return F.concat_ws("\x1f", *keys)


def _aggregate(i: Item) -> Column:
    if i.fn == "count":
        return F.count(F.lit(1)).cast("double").alias(i.name)
    if i.column is None:
        n = F.lit(None).cast("double")
    elif i.column.lower() in NUMBER_COLUMNS:
        n = _value(i.column)
    else:
        n = number_of(_value(i.column))
    out = {"sum": lambda: F.coalesce(F.sum(n), F.lit(0.0)), "avg": lambda: F.avg(n), "min": lambda: F.min(n), "max": lambda: F.max(n)}[i.fn]()
    return out.alias(i.name)


def _matched(s: Statement, entries: DataFrame) -> DataFrame:
    rows = entries.where(F.col("signal") == s.source)
    return rows if s.where is None else rows.where(condition(s.where))


def _unlimited(s: Statement, rows: DataFrame) -> DataFrame:
    if not s.aggregates:
        columns = functools.reduce(lambda out, i: out + ([(i.name, i.column)] if i.column else [(c, c) for c in STAR]), s.items, [])
        return rows.orderBy("stream_ms", "stream_seq").select(*(_value(c).alias(n) for n, c in columns))
    aggs = [_aggregate(i) for i in s.items if i.fn]
    if not s.group_by:
        return rows.agg(*aggs).select(*(f"`{i.name}`" for i in s.items))
    keys = {c.lower(): f"_k{n}" for n, c in enumerate(dict.fromkeys(c.lower() for c in s.group_by))}
    ordered = rows.withColumn("_order", group_order(s.group_by)).groupBy("_order", *(_value(c).alias(k) for c, k in keys.items())).agg(*aggs)
    return ordered.orderBy("_order").select(*(F.col(f"`{i.name}`") if i.fn else F.col(keys[i.column.lower()]).alias(i.name) for i in s.items))


def plan(query: str | Statement, entries: DataFrame) -> DataFrame:
    """The result rows of a query over decoded entries, in the dialect's order and limit."""
    s = check(parse(query) if isinstance(query, str) else query)
    return _unlimited(s, _matched(s, entries)).limit(MAX_ROWS if s.limit is None else min(s.limit, MAX_ROWS))


@dataclass(frozen=True)
class QueryResult:
    columns: list[str]
    rows: list[tuple]
    scanned: int
    matched: int
    returned: int
    truncated: bool


def run(query: str, entries: DataFrame) -> QueryResult:
    """Rows with exact counts of the rows in the look-back, those matched and those returned."""
    s = check(parse(query))
    here = F.col("signal") == s.source
    met = here if s.where is None else here & condition(s.where)
    counts = entries.agg(F.count(F.lit(1)), F.count_if(met)).first()
    df = plan(s, entries)
    rows = [tuple(r) for r in df.collect()]
    if not s.aggregates:
        total = counts[1]
    elif not s.group_by:
        total = 1
    else:
        total = _matched(s, entries).select(*(_value(c) for c in s.group_by)).distinct().count()
    return QueryResult(df.columns, rows, counts[0], counts[1], len(rows), total > len(rows))
