"""JSON and TOML 1.0 by recursive descent; after a fault JSON goes on at the next comma or bracket, TOML at the next key or header."""

from __future__ import annotations

import re
from collections.abc import Callable

from fathom.llm.grammar import unbounded

JSON_TOKEN = re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b|[\[\]{},:]|\Z)')


class Fault(Exception):
    """A message and a position."""


# what is passed over after a fault: strings, closed or not, what tells of nesting, and the rest
JSON_PIECE = re.compile(r'"(?:[^"\\\n]|\\.)*"?|[\[\]{},]|[^"\[\]{},]+')
BLANK = re.compile(r"[ \t\n\r]*")
CLOSES = {"{": "}", "[": "]"}


class Json:
    """One fault a place; what is open is known, so that a bracket too few or too many ends no more than its own level."""

    def __init__(self, source: str):
        self.s, self.at, self.start = source, 0, 0
        self.open: list[str] = []
        self.faults: list[Fault] = []

    def token(self) -> str:
        m = JSON_TOKEN.match(self.s, self.at)
        if not m:
            self.start = self.at = BLANK.match(self.s, self.at).end()
            raise Fault("unexpected character", self.at)
        self.start, self.at = m.start(1), m.end()
        return m[1]

    def fail(self, what: str) -> None:
        at, self.at = self.at, self.start  # recovery sees the token again
        raise Fault(what, at)

    def note(self, fault: Fault) -> None:
        if not self.faults or self.faults[-1].args[1] < fault.args[1]:
            self.faults.append(fault)

    def value(self) -> None:
        t = self.token()
        if t in CLOSES:
            self.listed(CLOSES[t], self.member if t == "{" else self.value)
        elif not t or t in "]},:":
            self.fail("expected a value")

    def member(self) -> None:
        if self.token()[:1] != '"':
            self.fail("expected a key in double quotes")
        if self.token() != ":":
            self.fail("expected ':'")
        self.value()

    def listed(self, close: str, one: Callable[[], None]) -> None:
        """What stands between brackets, the first of which is read."""
        m = JSON_TOKEN.match(self.s, self.at)
        if m and m[1] == close:
            self.at = m.end()
            return
        self.open.append(close)
        more = True
        while more:
            try:
                one()
                t = self.token()
                if t not in (",", close):
                    self.fail(f"expected ',' or '{close}'")
                more = t == ","
            except Fault as f:
                self.note(f)
                more = self.recovered(close)
        self.open.pop()

    def recovered(self, close: str) -> bool:
        """Goes on to the comma or bracket that ends the faulty part; whether more follows on this level."""
        inner: list[str] = []
        while m := JSON_PIECE.match(self.s, self.at):
            t = m[0]
            if t in CLOSES:
                inner.append(CLOSES[t])
            elif t in ("]", "}"):
                if t in inner:
                    while inner.pop() != t:
                        pass
                elif t == close or t in self.open:
                    self.at = m.end() if t == close else self.at  # an outer level's bracket is left to it
                    return False
            elif t == "," and not inner:
                self.at = m.end()
                return True
            self.at = m.end()
        return False

    def whole(self) -> list[Fault]:
        while True:
            try:
                self.value()
                self.at = BLANK.match(self.s, self.at).end()
                if self.at == len(self.s):
                    return self.faults
                raise Fault("extra data", self.at)
            except Fault as f:
                self.note(f)
            while (m := JSON_PIECE.match(self.s, self.at)) and m[0] not in CLOSES:
                self.at = m.end()
            if not m:
                return self.faults


def json_faults(source: str) -> list[tuple[int, str]]:
    """(line, message) of everything wrong with a JSON text; an empty text is wrong."""
    return _lines(source, unbounded(lambda s: Json(s).whole(), source))


def _lines(source: str, faults: list[Fault]) -> list[tuple[int, str]]:
    """Faults, in order of their positions, with their lines."""
    out, line, at = [], 1, 0
    for f in faults:
        line, at = line + source.count("\n", at, f.args[1]), f.args[1]
        out.append((line, f.args[0]))
    return out


SPACE = re.compile(r"[ \t]*")
LINES = re.compile(r"(?:[ \t]*(?:#[^\x00-\x08\x0a-\x1f\x7f]*)?(?:\r?\n))*[ \t]*(?:#[^\x00-\x08\x0a-\x1f\x7f]*)?")
END = re.compile(r"[ \t]*(?:#[^\x00-\x08\x0a-\x1f\x7f]*)?(?:\r?\n|\Z)")
BARE = re.compile(r"[A-Za-z0-9_-]+")
ESCAPE = r'\\(?:["\\bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})'
BASIC = re.compile(rf'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|{ESCAPE})*"')
PLAIN = re.compile(r"'[^'\x00-\x08\x0a-\x1f\x7f]*'")
LONG_BASIC = re.compile(rf'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|"(?!"")|{ESCAPE}|\\[ \t]*\r?\n\s*)*"{{3,5}}')
LONG_PLAIN = re.compile(r"'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'(?!''))*'{3,5}")
DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
SCALAR = re.compile(rf"(?:true|false|{DATE}(?:[Tt ]{TIME}(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|{TIME}|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w.:+-])")


DAY = re.compile(r"(\d{4})-(\d\d)-(\d\d)")


def days(year: int, month: int) -> int:
    """How many days a month has."""
    if month == 2:
        return 29 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 28
    return 30 if month in (4, 6, 9, 11) else 31


STATEMENT = re.compile(r"""^[ \t]*(?:\[|(?:[A-Za-z0-9_-]+|"[^"\n]*"|'[^'\n]*')[ \t]*[=.])""", re.MULTILINE)  # how a line looks that begins anew


class Toml:
    """Tables as dictionaries; closed ones (inline, or defined by a header) may not be opened again."""

    def __init__(self, source: str):
        self.s, self.at = source, 0
        self.root: dict = {}

    def fail(self, what: str) -> None:
        raise Fault(what, self.at)

    def skip(self, rule: re.Pattern) -> None:
        self.at = rule.match(self.s, self.at).end()

    def key(self) -> list[str]:
        parts = []
        while True:
            self.skip(SPACE)
            for rule in (BARE, BASIC, PLAIN):
                if m := rule.match(self.s, self.at):
                    text = m[0]
                    parts.append(text if rule is BARE else text[1:-1])
                    self.at = m.end()
                    break
            else:
                self.fail("expected a key")
            self.skip(SPACE)
            if self.s[self.at : self.at + 1] != ".":
                return parts
            self.at += 1

    def value(self) -> object:
        c = self.s[self.at : self.at + 1]
        if c == "[":
            return self.array()
        if c == "{":
            return self.inline()
        rules = (LONG_BASIC, BASIC) if c == '"' else (LONG_PLAIN, PLAIN) if c == "'" else (SCALAR,)
        if c in "\"'" and c and self.s.startswith(c * 3, self.at):
            rules = rules[:1]
        for rule in rules:
            if m := rule.match(self.s, self.at):
                day = DAY.match(m[0]) if rule is SCALAR else None
                if day and int(day[3]) > days(int(day[1]), int(day[2])):
                    self.fail("no such day")
                self.at = m.end()
                return 0
        self.fail("invalid value")

    def array(self) -> int:
        self.at += 1
        while True:
            self.skip(LINES)
            if self.s[self.at : self.at + 1] == "]":
                break
            self.value()
            self.skip(LINES)
            if self.s[self.at : self.at + 1] == ",":
                self.at += 1
            elif self.s[self.at : self.at + 1] != "]":
                self.fail("unclosed array")
        self.at += 1
        return 0

    def inline(self) -> int:
        self.at += 1
        table: dict = {}
        self.skip(SPACE)
        if self.s[self.at : self.at + 1] == "}":
            self.at += 1
            return 0
        while True:
            self.pair(table)
            self.skip(SPACE)
            c = self.s[self.at : self.at + 1]
            self.at += 1
            if c == "}":
                return 0
            if c != ",":
                self.fail("unclosed inline table")
            self.skip(SPACE)

    def pair(self, table: dict) -> None:
        parts = self.key()
        if self.s[self.at : self.at + 1] != "=":
            self.fail("expected '=' after a key")
        self.at += 1
        self.skip(SPACE)
        for p in parts[:-1]:
            table = table.setdefault(p, {"\0dotted": True})
            if not isinstance(table, dict) or "\0header" in table or "\0many" in table:
                self.fail("key is taken")
        if parts[-1] in table:
            self.fail("cannot overwrite a value")
        table[parts[-1]] = self.value()

    def header(self) -> dict:
        many = self.s.startswith("[[", self.at)
        self.at += 1 + many
        parts = self.key()
        close = "]]" if many else "]"
        if not self.s.startswith(close, self.at):
            self.fail(f"expected '{close}'")
        self.at += len(close)
        table = self.root
        for p in parts[:-1]:
            table = table.setdefault(p, {})
            if not isinstance(table, dict):
                self.fail("cannot declare a table over a value")
            table = table.get("\0many", table)
        last = parts[-1]
        there = table.get(last)
        if many:
            if there is not None and not (isinstance(there, dict) and "\0many" in there):
                self.fail("cannot declare an array over a value")
            new: dict = {}
            table[last] = {"\0many": new}
            return new
        if there is None:
            there = table[last] = {}
        if not isinstance(there, dict) or any(k in there for k in ("\0header", "\0many", "\0dotted")):
            self.fail("cannot declare a table twice")
        there["\0header"] = True
        return there

    def whole(self) -> list[Fault]:
        table, faults = self.root, []
        while True:
            try:
                self.skip(LINES)
                if self.at >= len(self.s):
                    return faults
                if self.s[self.at] == "[":
                    table = {}  # of what follows a faulty header
                    table = self.header()
                else:
                    self.pair(table)
                m = END.match(self.s, self.at)
                if not m:
                    self.fail("expected the end of the line")
                self.at = m.end()
            except Fault as f:
                faults.append(f)
                end = self.s.find("\n", self.at)
                m = STATEMENT.search(self.s, end + 1) if end >= 0 else None
                if not m:
                    return faults
                self.at = m.start()


def toml_faults(source: str) -> list[tuple[int, str]]:
    """(line, message) of everything wrong with a TOML 1.0 text."""
    return _lines(source, unbounded(lambda s: Toml(s).whole(), source))
