"""Filter patterns of the linear-time kind: checked by their own rules, and run so that they stay linear.

A pattern is read once.  What needs backtracking (look-around, back references, atomic groups) is refused, and so is
any escape that the dialect does not have; a quantifier behind a quantifier repeats what it stands behind, as in the
dialect, and is not possessive.  Java's engine runs what comes out, unless an unbounded repetition holds another
repetition or a choice: there it can take exponential time, so such a pattern runs on Arrow's linear engine instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that may follow a backslash.
CLASSES = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{N}_", "s": r"\s\x{85}\p{Z}"}
LETTERS = set("aftnrvxuUAzbBpPdDsSwW")
FLAGS = re.compile(r"\(\?([imsUuxR]*)(?:-([imsUuxR]+))?([:)])")
COUNT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Pattern:
    java: str
    linear: str
    #: Whether Java's engine may take exponential time.
    nested: bool


def _escape(p: str, i: int, in_class: bool) -> tuple[int, str, str]:
    """(end, for Java, for the linear engine) of the escape at ``i``."""
    if i + 1 >= len(p):
        raise PatternError("pattern ends in a backslash")
    c = p[i + 1]
    if c.isdigit():
        raise PatternError("back references are not supported")
    if c.isascii() and c.isalpha() and (c not in LETTERS or in_class and c in "AzbB"):
        raise PatternError(f"unknown escape \\{c}")
    if c in "xuU":
        m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{%d})" % {"x": 2, "u": 4, "U": 8}[c]).match(p, i + 2)
        if not m or int(m[1] or m[2], 16) > 0x10FFFF:
            raise PatternError("bad code point")
        text = "\\x{%s}" % (m[1] or m[2])
        return m.end(), text, text
    if c in "pP":
        m = re.compile(r"\{\^?[\w=:! -]+\}|[A-Za-z]").match(p, i + 2)
        if not m:
            raise PatternError("bad property")
        name = m[0].strip("{}")
        script = len(name) > 2 and name.isalpha()  # Java's names of scripts begin with Is
        return m.end(), f"\\{c}{{Is{name}}}" if script else p[i : m.end()], p[i : m.end()]
    if c.lower() in CLASSES:
        if not in_class:
            return i + 2, p[i : i + 2], f"[{'^' if c.isupper() else ''}{CLASSES[c.lower()]}]"
        return i + 2, p[i : i + 2], CLASSES[c] if c.islower() else p[i : i + 2]
    return i + 2, "\\x{b}" if c == "v" else p[i : i + 2], p[i : i + 2]


def _char_class(p: str, i: int) -> tuple[int, str, str]:
    """The bracket at ``i``; a leading ] is itself, brackets nest."""
    java, linear, start = ["["], ["["], i
    i += 1
    if p[i : i + 1] == "^":
        java.append("^")
        linear.append("^")
        i += 1
    first = True
    while True:
        if i >= len(p):
            raise PatternError("unclosed character class")
        if p[i] == "]" and not first:
            return i + 1, "".join(java) + "]", "".join(linear) + "]"
        first = False
        if p[i] == "[":
            named = re.compile(r"\[:\^?[a-z]+:\]").match(p, i)
            if named:
                raise PatternError("named classes are not supported here")
            i, j, n = _char_class(p, i)
        elif p[i] == "\\":
            i, j, n = _escape(p, i, True)
        elif p[i : i + 2] in ("--", "~~"):
            raise PatternError("differences of classes are not supported here")
        else:
            j = n = "\\" + p[i] if p[i] == "]" or p[i] == "#" or p[i] == " " else p[i]
            i += 1
        java.append(j)
        linear.append(n)
        if i - start > 10_000:
            raise PatternError("character class too long")


def read(p: str) -> Pattern:
    """Reads a pattern; PatternError where the dialect has no such pattern."""
    # Per open group: parts for each engine (the last one is what a quantifier repeats), and what the group holds.
    stack: list[dict] = [{"java": [], "linear": [], "repeats": False, "choice": False, "open": ("", "")}]
    nested, i = False, 0
    last: dict | None = None  # the atom that a quantifier would repeat

    def put(java: str, linear: str, holds: bool = False, quantified: bool = False) -> None:
        nonlocal last
        stack[-1]["java"].append(java)
        stack[-1]["linear"].append(linear)
        last = {"holds": holds, "quantified": quantified}

    while i < len(p):
        c = p[i]
        if c == "(":
            named = re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(p, i)
            flags = FLAGS.match(p, i)
            if named:
                i, opening = named.end(), ("(", "(")
            elif flags and p[i + 1] == "?":
                if set((flags[1] or "") + (flags[2] or "")) & set("UR") or flags[3] == ")" and not flags[1] and not flags[2]:
                    raise PatternError(f"flags {flags[0]}")
                # The engines spell the flags alike; Unicode is on in Java by (?uU).
                on, off = (re.sub("u", "", x or "") for x in (flags[1], flags[2]))
                spelled = "(?" + on + (f"-{off}" if off else "") + flags[3]
                i = flags.end()
                if flags[3] == ")":
                    stack[-1]["java"].append("" if spelled == "(?)" else spelled)
                    stack[-1]["linear"].append("" if spelled == "(?)" else spelled)
                    last = None
                    continue
                opening = (spelled, spelled)
            elif p[i + 1 : i + 2] == "?":
                raise PatternError("look-around and atomic groups are not supported")
            else:
                i, opening = i + 1, ("(", "(")
            stack.append({"java": [], "linear": [], "repeats": False, "choice": False, "open": opening})
            last = None
        elif c == ")":
            if len(stack) == 1:
                raise PatternError("unopened group")
            g = stack.pop()
            i += 1
            put(g["open"][0] + "".join(g["java"]) + ")", g["open"][1] + "".join(g["linear"]) + ")", g["repeats"] or g["choice"])
            stack[-1]["repeats"] |= g["repeats"]
            stack[-1]["choice"] |= g["choice"]
        elif c in "*+?" or c == "{":
            if last is None:
                raise PatternError("nothing to repeat")
            m = None
            if c == "{":
                m = COUNT.match(p, i)
                if not m or m[3] and int(m[3]) < int(m[1]) or int(m[3] or m[1]) > 1000:
                    raise PatternError("bad repetition")
            text = m[0] if m else c
            i += len(text)
            lazy = p[i : i + 1] == "?"
            i += lazy
            many = c in "*+" or m is not None and (bool(m[2]) and not m[3] or int(m[3] or m[1]) > 1)
            for kind in ("java", "linear"):
                atom = stack[-1][kind][-1]
                stack[-1][kind][-1] = (f"(?:{atom})" if last["quantified"] else atom) + text + ("?" if lazy else "")
            nested |= many and (last["holds"] or last["quantified"])
            stack[-1]["repeats"] |= many
            last = {"holds": last["holds"] or many, "quantified": True}
        elif c == "[":
            i, java, linear = _char_class(p, i)
            put(java, linear)
        elif c == "\\":
            i, java, linear = _escape(p, i, False)
            put(java, linear)
        elif c == "|":
            stack[-1]["java"].append("|")
            stack[-1]["linear"].append("|")
            stack[-1]["choice"] = True
            i, last = i + 1, None
        else:
            put("\\" + c if c in "]}" else c, "\\" + c if c in "]}" else c)
            i += 1
    if len(stack) > 1:
        raise PatternError("unclosed group")
    return Pattern("(?iuU)" + "".join(stack[0]["java"]), "(?i)" + "".join(stack[0]["linear"]), nested)


def found(text: Column, pattern: str) -> Column:
    """Whether a text holds a match."""
    p = read(pattern)
    if not p.nested:
        return text.rlike(p.java)

    @F.pandas_udf("boolean")
    def linear(texts: pd.Series) -> pd.Series:
        return pc.match_substring_regex(pa.array(texts, pa.string()), p.linear).to_pandas()

    return linear(text)
