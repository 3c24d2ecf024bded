"""Many viewers at once: one pass of an automaton over each entry's texts, whatever the number of viewers.

All strings that viewers look for are put into one Aho-Corasick automaton; a text of an entry is run through it once
and gives the strings that it holds.  A viewer whose conditions must all hold is filed under one of them, the longest
string, and the others are looked at only where that one was found; a viewer of which one condition is enough is
filed under each.  So an entry costs its texts and the viewers filed under what it holds.  Patterns have no strings to
look for and are worked out by the engine, each once however many viewers ask for it.

Viewers are dealt into groups whose strings together stay below ``SENT_BYTES``, each a broadcast of its own; one group
is the common case.
"""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import patterns

SENT_BYTES = 16 << 20


class Table:
    """What a group of viewers asks for, in plain tuples, fit to be sent."""

    def __init__(self, viewers: list, fields: dict[str, str], regexes: dict[tuple[str, str], int], now: datetime | None):
        self.ids = [v.id for v in viewers]
        self.signals = [frozenset(v.signals()) for v in viewers]
        self.after = [None if now is None else int(now.timestamp() * 1_000_000) - v.lookback_ms * 1000 for v in viewers]
        #: (kind, column, value) of each condition; kind: contains, eq or regex (then value is the pattern's number).
        self.filed: dict[tuple, list[tuple[int, tuple]]] = defaultdict(list)
        self.always: list[int] = []
        columns = list(fields.values())
        for n, v in enumerate(viewers):
            if v.filters:
                tests = [("regex", None, regexes[columns.index(fields[f]), x]) if op == "regex" else (op, columns.index(fields[f]), x.lower()) for f, op, x in v.filters]
                alone = v.any_filter
            elif v.query:
                tests, alone = [("contains", c, v.query) for c in range(len(columns))], True
            else:
                self.always.append(n)
                continue
            if alone:
                for t in set(tests):
                    self.filed[t].append((n, ()))
            else:
                first = max(tests, key=lambda t: (t[0] != "regex", len(str(t[2])), t[0]))
                self.filed[first].append((n, tuple(set(tests) - {first})))

    def built(self) -> tuple:
        """(automaton or None, strings that are asked for as a whole)."""
        needles, whole = set(), set()
        for kind, column, value in [t for f, on in self.filed.items() for t in (f, *(x for _, more in on for x in more))]:
            if kind == "contains":
                needles.add(value)
            elif kind == "eq":
                whole.add((column, value))
        if not needles:
            return None, whole
        a = ahocorasick.Automaton()
        for s in needles:
            a.add_word(s, s)
        a.make_automaton()
        return a, whole


def met(table: Table, automaton, whole: set, signal: str, micros: int, texts: list[str | None], regex: list[bool]) -> list[str]:
    """Ids of the viewers that an entry meets."""
    true = {("regex", None, i) for i, x in enumerate(regex) if x}
    for c, text in enumerate(texts):
        if text is None:
            continue
        if automaton is not None:
            true.update(("contains", c, s) for _, s in automaton.iter(text))
        if (c, text) in whole:
            true.add(("eq", c, text))
    found = set(table.always)
    for t in true & table.filed.keys():
        found.update(n for n, more in table.filed[t] if all(x in true for x in more))
    return [table.ids[n] for n in sorted(found) if signal in table.signals[n] and (table.after[n] is None or micros > table.after[n])]


def _groups(viewers: list) -> list[list]:
    out, size = [[]], 0
    for v in viewers:
        need = 200 + sum(len(x.encode()) for _, _, x in v.filters) + len((v.query or "").encode())
        if out[-1] and size + need > SENT_BYTES:
            out.append([])
            size = 0
        out[-1].append(v)
        size += need
    return out


def fan_out(viewers: list, entries: DataFrame, fields: dict[str, str], now: datetime | None = None) -> DataFrame:
    """Each entry once for every viewer that it meets, with ``viewer_id``; ``fields``: column of each filter field."""
    made = None
    for group in _groups(viewers):
        part = _fan_out(group, entries, fields, now)
        made = part if made is None else made.unionByName(part)
    return made


def _fan_out(viewers: list, entries: DataFrame, fields: dict[str, str], now: datetime | None) -> DataFrame:
    columns = list(fields.values())
    regexes: dict[tuple[str, str], int] = {}
    for v in viewers:
        for f, op, x in v.filters:
            if op == "regex":
                regexes.setdefault((columns.index(fields[f]), x), len(regexes))
    sent = entries.sparkSession.sparkContext.broadcast(Table(viewers, fields, regexes, now))

    @F.pandas_udf("array<string>")
    def ids(signal: pd.Series, micros: pd.Series, texts: pd.Series, regex: pd.Series) -> pd.Series:
        table = sent.value
        if not hasattr(table, "ready"):  # once a worker: it keeps what was sent to it
            table.ready = table.built()
        automaton, whole = table.ready
        return pd.Series([met(table, automaton, whole, *row) for row in zip(signal, micros, texts, regex)])

    matched = [F.coalesce(patterns.found(F.col(columns[c]), x), F.lit(False)) for c, x in regexes]
    flags = F.array(*matched) if matched else F.array().cast("array<boolean>")
    found = ids("signal", F.unix_micros("observed_at"), F.array(*(F.lower(c) for c in columns)), flags)
    return entries.withColumn("viewer_id", F.explode(found))
