r"""Expressions written once for two SQL dialects: Spark's, which runs them, and DuckDB's, which checks them.

Word boundaries and whitespace mean the same in both: `\b` is the ASCII word boundary, `\s` also
holds the Unicode spaces.

Patterns are rewritten for Spark's engine, which tries every place of a text: `\b` becomes one look to the side
where letters are sure to stand on the other, the first characters that can begin a match are looked up
before anything else is tried, words in a list are tried by their first letters, and a class looks among its characters beyond Latin-1 only for such a character. Where each match must hold a
sign or a digit, a column without it isn't searched.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


class E(NamedTuple):
    """An expression: s for Spark, d for DuckDB."""

    s: str
    d: str

    def col(self) -> Column:
        return F.expr(self.s)


def x(sql: str, duck: str | None = None) -> E:
    return E(sql, duck if duck is not None else sql)


def t(template: str, **parts: E) -> E:
    """template with <name> replaced by the parts, for each dialect."""
    s = d = template
    for k, v in parts.items():
        s, d = s.replace(f"<{k}>", v.s), d.replace(f"<{k}>", v.d)
    return E(s, d)


_SPACE = r"\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LATIN_SPACES, _FAR_SPACES = r" \t\n\x0B\f\r\x{A0}", r"\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_DIGITS = frozenset("0123456789")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_") | _DIGITS
_ATOM = re.compile(r"\\x\{[0-9A-Fa-f]+\}|\\x[0-9A-Fa-f]{2}|\\[pP]\{\w+\}|\\.|.", re.S)
_TIMES = re.compile(r"(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?")


def _point(atom: str) -> int | None:
    """The code point that an atom of a pattern stands for, if it is one."""
    if atom.startswith("\\x"):
        return int(atom[2:].strip("{}"), 16)
    return ord(atom[-1]) if len(atom) == 1 or not atom[1].isalnum() else {"\\t": 9, "\\n": 10, "\\r": 13, "\\f": 12}.get(atom)


class _Class:
    """[..]: text for Spark, and its characters if they are known."""

    def __init__(self, body: str) -> None:
        no, atoms, near, far, known, beyond = body.startswith("^"), _ATOM.findall(body.removeprefix("^")), [], [], set(), False
        while atoms:
            a = atoms.pop(0)
            lo = hi = _point(a)
            if lo is None:
                near.append(_LATIN_SPACES if a == r"\s" else a)
                far += [_FAR_SPACES] if a == r"\s" else []
                chars = {r"\d": _DIGITS, r"\w": _WORD}.get(a)
                known = known | chars if known is not None and chars else None
                continue
            if len(atoms) > 1 and atoms[0] == "-":
                a, hi = f"{a}-{atoms[1]}", _point(atoms[1])
                del atoms[:2]
            beyond |= hi > 0xFFFF
            (far if lo > 255 else near).append(rf"\{a}" if a in ("-", "^") else a)
            known = known | set(map(chr, range(lo, hi + 1))) if known is not None and hi < 128 else None
        self.known = None if no else known
        most = "10FFFF" if beyond else "FFFF"  # the engine is faster without characters of two halves
        text = "".join(near) + (rf"[\x{{100}}-\x{{{most}}}&&[{''.join(far)}]]" if far else "")
        self.text = f"[{'^' if no else ''}{text}]"


class _Pattern:
    """A pattern as alternatives of (what, times); what is an atom, a _Class or a group (its opening and alternatives)."""

    def __init__(self, p: str) -> None:
        self.p, self.i = p, 0
        flag = m[0] if (m := re.compile(r"\(\?[is]+\)").match(p)) else ""
        self.i = len(flag)
        self.captures = bool(re.search(r"\((?!\?)", re.sub(r"\\.|\[[^\]]*\]", "", p)))
        ways = self.ways()
        self.needed = self.need(ways)
        ahead = self.ahead(ways) if len(ways) > 1 or isinstance(ways[0][0][0], tuple) else ""
        text = self.text(ways)
        self.spark = flag + (f"{ahead}(?:{text})" if ahead else text)

    def ways(self) -> list:
        out = [[]]
        while self.i < len(self.p) and self.p[self.i] != ")":
            c = self.p[self.i]
            if c == "|":
                out.append([])
                self.i += 1
                continue
            if c == "(":
                opening = re.compile(r"\((?:\?(?:<?[=!]|i?:))?").match(self.p, self.i)[0]
                self.i += len(opening)
                what = (opening, self.ways())
                self.i += 1
            elif c == "[":
                end = re.compile(r"\[\^?(?:\\.|[^\]\\])+\]", re.S).match(self.p, self.i).end()
                what, self.i = _Class(self.p[self.i + 1 : end - 1]), end
            else:
                what = _ATOM.match(self.p, self.i)[0]
                self.i += len(what)
            times = _TIMES.match(self.p, self.i)
            self.i = times.end() if times else self.i
            out[-1].append((what, times[0] if times else ""))
        return out

    def edge(self, ways: list, step: int) -> frozenset | None:
        """Characters with which every way begins (step 1) or ends (-1); None if they aren't known."""
        found = frozenset()
        for way in ways:
            for what, times in way[::step]:
                if what == r"\b":
                    continue
                if isinstance(what, tuple):
                    one = self.edge(what[1], step) if what[0] in ("(", "(?:") else None
                elif isinstance(what, _Class):
                    one = what.known
                elif what in (".", "^", "$"):
                    one = None
                else:
                    point = _point(what)
                    one = {r"\d": _DIGITS, r"\w": _WORD}.get(what) if point is None else frozenset(chr(point))
                if one is None:
                    return None
                found |= one
                if not times or times[0] not in "?*{" or (times[0] == "{" and times[1] != "0"):
                    break
            else:
                return None
        return found

    def need(self, ways: list) -> frozenset:
        """Signs that every match holds; 0 stands for a digit."""
        found = []
        for way in ways:
            found.append(set())
            for what, times in way:
                if times.startswith(("?", "*", "{0")) or what in ("^", "$", ".", r"\b"):
                    continue
                if isinstance(what, tuple):
                    found[-1] |= self.need(what[1]) if what[0] in ("(", "(?:", "(?i:") else set()
                elif isinstance(what, _Class) or what == r"\d":
                    found[-1] |= {"0"} if what == r"\d" or (what.known and what.known <= _DIGITS) else set()
                elif (point := _point(what)) is not None and 32 < point < 127:
                    found[-1] |= {"0"} if chr(point).isdigit() else set() if chr(point).isalpha() else {chr(point)}
        return frozenset.intersection(*map(frozenset, found))

    def ahead(self, ways: list) -> str:
        first = self.edge(ways, 1)
        return f"(?=[{''.join(c if c.isalnum() else f'{chr(92)}x{{{ord(c):x}}}' for c in sorted(first))}])" if first else ""

    def text(self, ways: list) -> str:
        """Many words as alternatives are tried by their first letters: those with other ones can't match at the same place."""
        first = [w[0] if w else ("", "") for w in ways]
        if len(ways) < 4 or self.captures or not all(isinstance(a, str) and a.isalnum() and a.isascii() and not times for a, times in first):
            return "|".join(self.way(w) for w in ways)
        by: dict[str, list] = {}
        for (a, _), w in zip(first, ways, strict=True):
            by.setdefault(a, []).append(w)
        if len({a.lower() for a in by}) < len(by):
            return "|".join(self.way(w) for w in ways)
        return "|".join(self.way(g[0]) if len(g) == 1 else f"{a}(?:{self.text([w[1:] for w in g])})" for a, g in by.items())

    def way(self, way: list) -> str:
        out = ""
        for i, (what, times) in enumerate(way):
            if what == r"\b":
                after, before = self.edge([way[i + 1 :]], 1), self.edge([way[:i]], -1)
                if before and before <= _WORD:
                    out += r"(?!\w)"
                else:
                    out += self.ahead([way[i + 1 :]]) + (r"(?<!\w)" if after and after <= _WORD else _BOUND)
            elif isinstance(what, tuple):
                out += what[0] + self.text(what[1]) + ")"
            elif isinstance(what, _Class):
                out += what.text
            else:
                out += {r"\s": _Class(r"\s").text, r"\S": _Class(r"^\s").text}.get(what, what)
            out += times
        return out


_parsed = functools.cache(_Pattern)


def _spelled(p: str) -> str:
    """p for DuckDB: `\\s` as the class of all spaces."""
    out, inside = "", False
    for a in re.compile(r"\\.|.", re.S).findall(p):
        inside = (a == "[" or inside) and a != "]"
        out += (_SPACE if inside else f"[{_SPACE}]") if a == r"\s" else f"[^{_SPACE}]" if a == r"\S" else a
    return out


def _pattern(p: str) -> E:
    """p is without quotes (use \\x27); `\\s` inside a class is written [..\\s..] as usual."""
    return E(_parsed(p).spark, _spelled(p))


def _may(c: E, p: str) -> str | None:
    """Spark only: a quick test that a column (not a computed text) must pass to match p; None if there is none."""
    signs = _parsed(p).needed - set(",.-_'\\")
    if not re.fullmatch(r"[a-z_]\w*(?:\.\w+)*", c.s) or not signs:
        return None
    return f"({c.s} rlike '[0-9]')" if signs == {"0"} else f"contains({c.s}, '{min(signs - {'0'})}')"


def replace(c: E, pattern: str, to: str) -> E:
    p, may = _pattern(pattern), _may(c, pattern)
    s = f"regexp_replace({c.s}, r'{p.s}', '{to}')"
    return E(f"(CASE WHEN {may} THEN {s} ELSE {c.s} END)" if may else s, f"regexp_replace({c.d}, '{p.d}', '{to}', 'g')")


def matches(c: E, pattern: str) -> E:
    p, may = _pattern(pattern), _may(c, pattern)
    return E(f"({may} AND {c.s} rlike r'{p.s}')" if may else f"({c.s} rlike r'{p.s}')", f"regexp_matches({c.d}, '{p.d}')")


def count(c: E, pattern: str) -> E:
    p, may = _pattern(pattern), _may(c, pattern)
    s = f"CAST(regexp_count({c.s}, r'{p.s}') AS BIGINT)"
    return E(f"(CASE WHEN NOT {may} THEN 0L ELSE {s} END)" if may else s, f"CAST(len(regexp_extract_all({c.d}, '{p.d}')) AS BIGINT)")


def once(value: E, body: Callable[[E], E], name: str = "one") -> E:
    """body of value, which Spark computes once however often body reads it; a column is read as it is."""
    if re.fullmatch(r"[a-z_]\w*(?:\.\w+)*", value.s):
        return body(value)
    out = body(E(name, value.d))
    return E(f"transform(array({value.s}), {name} -> {out.s})[0]", out.d)


def gated(may: str, e: E, other: E) -> E:
    """e, which Spark computes only where may holds, as it is other elsewhere."""
    return E(f"(CASE WHEN {may} THEN {e.s} ELSE {other.s} END)", e.d)


def extract(c: E, pattern: str, group: int = 0) -> E:
    p = _pattern(pattern)
    return E(f"regexp_extract({c.s}, r'{p.s}', {group})", f"regexp_extract({c.d}, '{p.d}', {group})")


def extract_all(c: E, pattern: str, group: int = 0) -> E:
    p = _pattern(pattern)
    return E(f"regexp_extract_all({c.s}, r'{p.s}', {group})", f"regexp_extract_all({c.d}, '{p.d}', {group})")


def split(c: E, pattern: str) -> E:
    """What stands around the matches of a pattern, empty parts included."""
    p = _pattern(pattern)
    return E(f"split({c.s}, r'{p.s}', -1)", f"regexp_split_to_array({c.d}, '{p.d}')")


def any_of(*parts: E) -> E:
    return E("(" + " OR ".join(p.s for p in parts) + ")", "(" + " OR ".join(p.d for p in parts) + ")")


def all_of(*parts: E) -> E:
    return E("(" + " AND ".join(p.s for p in parts) + ")", "(" + " AND ".join(p.d for p in parts) + ")")


def between(c: E, lo: int, hi: int) -> E:
    return t(f"(length(<c>) BETWEEN {lo} AND {hi})", c=c)
