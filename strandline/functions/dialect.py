"""One pattern, three engines.

Patterns are written once in the regular-expression dialect whose results are wanted (ASCII word
characters, Unicode white space, ``$`` strictly at the end) and compiled for Java (Spark columns),
Python (Arrow functions) and RE2 (SQL oracles).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space of the dialect: code points and inclusive ranges
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
_WORD = "[A-Za-z0-9_]"
_EDGE = {
    "java": f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))",
    "python": r"\b",
    "re2": r"\b",
}


def _point(cp: int, engine: str) -> str:
    return f"\\x{{{cp:X}}}" if engine == "re2" else f"\\u{cp:04x}"


def spaces(engine: str) -> str:
    """The inside of a character class of white space."""
    return "".join(_point(s, engine) if isinstance(s, int) else f"{_point(s[0], engine)}-{_point(s[1], engine)}" for s in SPACES)


@dataclass(frozen=True)
class Rx:
    """A pattern with flags among ``i`` and ``m``, and what its matches are replaced with."""

    source: str
    flags: str = ""
    to: str = ""
    once: bool = False  # replace the first match only
    re2_source: str | None = field(default=None, repr=False)  # where RE2 lacks a construct
    holds: tuple[str, ...] = ()  # lower-case ASCII of which every match holds one in either case, for a cheap test before

    def text(self, engine: str) -> str:
        source = self.re2_source if engine == "re2" and self.re2_source is not None else self.source
        out, i, inside = [], 0, False
        while i < len(source):
            c = source[i]
            two = source[i : i + 2]
            if source.startswith(r"[\s\S]", i) and not inside:
                out.append("(?s:.)")
                i += 6
                continue
            if two == r"\s":
                out.append(spaces(engine) if inside else f"[{spaces(engine)}]")
            elif two == r"\S" and not inside:
                out.append(f"[^{spaces(engine)}]")
            elif two == r"\b" and not inside:
                out.append(_EDGE[engine])
            elif two == r"\u":
                out.append(_point(int(source[i + 2 : i + 6], 16), engine))
                i += 6
                continue
            elif c == "\\":
                out.append(two)
            elif inside and c == "[":
                out.append(r"\[")
                i += 1
                continue
            elif inside:
                inside = c != "]"
                out.append(c)
                i += 1
                continue
            elif c == "[":
                inside = True
                end = 2 if two == "[^" else 1
                out.append(source[i : i + end])
                i += end
                continue
            elif c == "." and not inside:
                out.append(f"[^\\n\\r{_point(0x2028, engine)}{_point(0x2029, engine)}]")
                i += 1
                continue
            elif c == "$" and "m" not in self.flags:
                out.append(r"\Z" if engine == "python" else r"\z")
                i += 1
                continue
            else:
                out.append(c)
                i += 1
                continue
            i += 2
        flags = self.flags + ("d" if engine == "java" and "m" in self.flags else "")
        return (f"(?{flags})" if flags else "") + "".join(out)

    @cached_property
    def java(self) -> str:
        return self.text("java")

    @cached_property
    def python(self) -> re.Pattern:
        return re.compile(self.text("python"), re.ASCII)

    @cached_property
    def python_to(self) -> str:
        return re.sub(r"\$(\d)", r"\\\1", self.to)

    @cached_property
    def re2(self) -> str:
        return self.text("re2")

    # Spark columns
    def test(self, c: Column) -> Column:
        return c.rlike(self.java)

    def replace(self, c: Column) -> Column:
        if self.once and not self.source.startswith("^"):
            # the part before the first match is kept, so one replacement is made
            return F.regexp_replace(c, f"(?s)\\A(.*?)(?:{self.java})", "$1" + self.to)
        return F.regexp_replace(c, self.java, self.to)

    def find(self, c: Column, group: int = 0) -> Column:
        return F.regexp_extract(c, self.java, group)

    def count(self, c: Column) -> Column:
        return F.regexp_count(c, F.lit(self.java))

    # Python strings
    def test_py(self, s: str) -> bool:
        return self.python.search(s) is not None

    def replace_py(self, s: str) -> str:
        return self.python.sub(self.python_to, s, count=1 if self.once else 0)

    # SQL text
    def test_sql(self, e: str) -> str:
        return f"regexp_matches({e}, {quoted(self.re2)})"

    def replace_sql(self, e: str) -> str:
        to = re.sub(r"\$(\d)", r"\\\1", self.to)
        return f"regexp_replace({e}, {quoted(self.re2)}, {quoted(to)}{'' if self.once else ', ' + chr(39) + 'g' + chr(39)})"

    def find_sql(self, e: str, group: int = 0) -> str:
        return f"regexp_extract({e}, {quoted(self.re2)}, {group})"

    def count_sql(self, e: str) -> str:
        return f"len(regexp_extract_all({e}, {quoted(self.re2)}))"


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


TRIM = Rx(r"^\s+|\s+$")
#: the characters of ``\s``
BLANKS = "".join(chr(c) for s in SPACES for c in (range(s[0], s[1] + 1) if isinstance(s, tuple) else (s,)))
WHITE = Rx(r"\s+")


def steps(rules: Iterable[Rx], c: Column) -> Column:
    for r in rules:
        c = r.replace(c)
    return c


def steps_py(rules: Iterable[Rx], s: str) -> str:
    for r in rules:
        s = r.replace_py(s)
    return s


def steps_sql(rules: Iterable[Rx], e: str) -> str:
    for r in rules:
        e = r.replace_sql(e)
    return e


def any_of(rules: Iterable[Rx], c: Column) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | r.test(c)
    return out


def any_py(rules: Iterable[Rx], s: str) -> bool:
    return any(r.test_py(s) for r in rules)


def any_sql(rules: Iterable[Rx], e: str) -> str:
    return "(" + " OR ".join(r.test_sql(e) for r in rules) + ")"


def trim(c: Column) -> Column:
    """What ``TRIM`` does, read from the ends only: the pattern tries every blank inside a text."""
    return F.btrim(c, F.lit(BLANKS))


def trim_py(s: str) -> str:
    return s.strip(BLANKS)


def trim_sql(e: str) -> str:
    return TRIM.replace_sql(e)
