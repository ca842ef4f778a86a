"""Python 3.13: statements by recursive descent, expressions by precedence climbing, recovery at the next logical line.

A file is first reduced to its shape: one character per token, which drops names, numbers and the text of strings. Logical
lines of one shape are parsed once; the worker keeps the verdicts, so a corpus costs about what its distinct lines cost.
What a line needs around it (a function, a loop, a coroutine) is part of its verdict and is held against the blocks it
stands in. Lines that name parameters, keywords or global names are read again with their names.
"""

from __future__ import annotations

import re
import unicodedata

from fathom.llm.grammar import unbounded

# The characters that stand for keywords and operators in a shape.
KEYWORDS = {"if": "I", "else": "E", "elif": "e", "for": "f", "while": "w", "in": "i", "not": "N", "and": "A", "or": "O", "is": "s", "lambda": "L", "def": "D", "class": "K", "return": "R", "yield": "Y", "await": "W", "async": "a", "import": "m", "from": "r", "as": "z", "with": "h", "try": "t", "except": "x", "finally": "y", "raise": "q", "pass": "p", "break": "b", "continue": "c", "del": "d", "global": "g", "nonlocal": "l", "assert": "v", "True": "k", "False": "k", "None": "k", "match": "M", "case": "C", "type": "T"}
OPERATORS = {"**": "P", "//": "Q", "<<": "H", ">>": "H", "<": "<", ">": "<", "<=": "<", ">=": "<", "==": "<", "!=": "<", "->": "V", ":=": "U", "...": "k"} | {c: c for c in "+-*/%@&|^~()[]{},:.;="}
OPERATORS |= {op: "G" for op in ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")}
TOKEN = re.compile(
    r"[ \t\f]*(?:\\\n[ \t\f]*)*(?:#[^\n]*)?"
    r"((?:[rRbBuUfF]{1,2}(?=[\"']))?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*')"
    r"|[^\W\d]\w*|\n[ \t\f]*|\.\.\.|\*\*=?|//=?|<<=?|>>=?|->|:=|[-+*/%@&|^<>=!]=|0[xX](?:_?[0-9a-fA-F])++(?=(?:and|else|for|if|in|is|or|not)\b)|(?:\d|\.\d)(?:[eE][+-](?=\d)|(?!(?:and|else|for|if|in|is|or|not)\b)[\w.])*|[^ \t\f\n]|\Z)"
)
NUMBER = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*)\Z")
BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00[01][0-9a-fA-F]{5})|N(?!\{[^}]+\}))")
RUNS = re.compile(r"(?:[0nSk],){2,}|(?:[0nSk]:[0nSk],){2,}")
INDENTS = re.compile("([\U000f0000-\U0010fffd])")  # private characters; each stands for an indentation
FIELDS = re.compile(r"(?<![^\W\d])(?:[fF][rR]?|[rR][fF])[\"']")
NAMED = re.compile(r"D|L|[nMCT]=.*,[nMCT]=")
FEATURES = frozenset("nested_scopes generators division absolute_import with_statement print_function unicode_literals barry_as_FLUFL generator_stop annotations".split())
BRACKETS = str.maketrans({c: None for c in map(chr, range(32, 127)) if c not in "()[]{}"})
BAD = "?"
CACHE = 200_000


class Fault(Exception):
    """The first thing in a logical line that the grammar has no place for."""


class Classes(dict):
    """Token text to shape character; indentations get private characters of their own."""

    def __init__(self):
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.update(KEYWORDS | OPERATORS | {"": ""})
        self.indents: dict[str, tuple[int, int]] = {}
        self.kinds: dict[tuple[int, int], str] = {}

    def __missing__(self, token: str) -> str:
        c = token[0]
        if c == "\n":
            place = columns(token[1:])
            kind = self.kinds.get(place)
            if kind is None:
                kind = self.kinds[place] = chr(0xF0000 + len(self.kinds))
                self.indents[kind] = place
        elif c in "\"'" or token[-1] in "\"'":
            kind = string_kind(token)
        elif c.isdigit() or c == "." and len(token) > 1:
            kind = "0" if NUMBER.match(token) else BAD
        else:
            kind = "n" if token.isidentifier() else BAD
        if len(token) < 60 or c == "\n":
            self[token] = kind
        return kind


def columns(blank: str) -> tuple[int, int]:
    """Column by tab stops of eight, and with tabs as one."""
    col = alt = 0
    for c in blank:
        if c == "\t":
            col, alt = (col // 8 + 1) * 8, alt + 1
        elif c == "\f":
            col = alt = 0
        else:
            col, alt = col + 1, alt + 1
    return col, alt


def string_kind(token: str) -> str:
    """S for text, B for bytes, BAD for wrong prefixes, escapes and replacement fields."""
    prefix = token[: re.search("[\"']", token).start()].lower()
    if len(token) - len(prefix) < 2 or (len(prefix) > 1 and prefix not in ("rb", "br", "rf", "fr")):
        return BAD
    if "r" not in prefix and "\\" in token and BAD_ESCAPE.search(token if "b" not in prefix else re.sub(r"\\[uUN]", "", token)):
        return BAD
    if "b" not in prefix and "r" not in prefix and "\\N{" in token and not all(map(_is_character, re.findall(r"(?<!\\)(?:\\\\)*\\N\{([^}]*)\}", token))):
        return BAD
    if "b" in prefix:
        return "B" if token.isascii() else BAD
    if "f" in prefix:
        q = 3 if token[-3:] in ('"""', "'''") and len(token) - len(prefix) >= 6 else 1
        return "S" if fields_fit(token[len(prefix) + q : -q]) else BAD
    return "S"


def _is_character(name: str) -> bool:
    try:
        unicodedata.lookup(name)
        return True
    except KeyError:
        return False


def fields_fit(body: str, depth: int = 0) -> bool:
    """Whether the replacement fields of an f-string close and hold expressions."""
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "}":
            if depth == 0 and body[i : i + 2] == "}}":
                i += 2
                continue
            return False
        if c != "{":
            i += 1
            continue
        if body[i : i + 2] == "{{" and depth == 0:
            i += 2
            continue
        j, nest, quote = i + 1, [], ""
        while j < n:
            d = body[j]
            if quote:
                quote = "" if d == quote else quote
            elif d in "\"'":
                quote = d
            elif d in "([{":
                nest.append(d)
            elif d in ")]" or d == "}" and nest:
                if not nest or "([{".index(nest.pop()) != ")]}".index(d):
                    return False
            elif not nest and (d == "}" or d == ":" or (d == "!" and body[j + 1 : j + 2] != "=")):
                break
            j += 1
        if j >= n:
            return False
        inner = body[i + 1 : j].strip()
        inner = re.sub(r"(?<![=!<>])=\s*$", "", inner)
        if not inner or not expression_fits(inner):
            return False
        if body[j] == "!":
            if body[j + 1 : j + 2] not in ("r", "s", "a") or body[j + 2 : j + 3] not in ("}", ":"):
                return False
            j += 2
        if body[j] == ":":
            k, level = j + 1, 0
            while k < n and (body[k] != "}" or level):
                level += {"{": 1, "}": -1}.get(body[k], 0)
                k += 1
            if k >= n or not fields_fit(body[j + 1 : k], depth + 1):
                return False
            j = k
        i = j + 1
    return True


CLASSES = Classes()
VERDICTS: dict[str, tuple[str, bool, str, str, str]] = {}
LEFT: dict[str, str] = {}


def expression_fits(text: str) -> bool:
    shape = "".join(map(CLASSES.__getitem__, TOKEN.findall(text)))
    shape = INDENTS.sub("", shape)
    if BAD in shape or open_brackets(shape):
        return False
    p = Line(shape)
    try:
        p.star_expressions(True)
        return p.i == len(shape)
    except Fault:
        return False


STRING_START = re.compile(r"#[^\n]*|(?<![^\W\d])[rRbBuUfF]{0,2}(?:\"\"\"|'''|[\"'])")


def string_end(source: str, at: int, quote: str, raw: bool) -> int:
    """Where a plain string's text ends that begins at at; -1 if it doesn't."""
    while at < len(source):
        c = source[at]
        if c == "\\":
            at += 2
        elif source.startswith(quote, at):
            return at
        elif c == "\n" and len(quote) == 1:
            return -1
        else:
            at += 1
    return -1


def fields_end(source: str, at: int, quote: str, raw: bool, nested: bool = False) -> int:
    """Where the text of an f-string ends, or with nested a format, whose fields may hold strings with the same quotes; -1 if
    it doesn't or a field is no expression."""
    while at < len(source):
        c = source[at]
        if c == "\\" and not (raw and source[at + 1 : at + 2] in ("{", "}")):
            at += 2
        elif source.startswith(quote, at) or nested and c == "}":
            return at
        elif c == "\n" and len(quote) == 1:
            return -1
        elif c in "{}" and source[at + 1 : at + 2] == c and not nested:
            at += 2
        elif c == "}":
            return -1
        elif c != "{":
            at += 1
        else:
            begin, at, open_ = at + 1, at + 1, []
            while at < len(source):
                c = source[at]
                m = STRING_START.match(source, at) if c in "#\"'rRbBuUfF" else None
                if m and m[0][0] != "#":
                    mark = m[0].lstrip("rRbBuUfF")
                    prefix = m[0][: -len(mark)].lower()
                    at = (fields_end if "f" in prefix else string_end)(source, m.end(), mark, "r" in prefix)
                    if at < 0:
                        return -1
                    at += len(mark)
                    continue
                if m:
                    at = m.end()
                    continue
                if c in "([{":
                    open_.append(c)
                elif c in ")]}" and open_:
                    if "([{".index(open_.pop()) != ")]}".index(c):
                        return -1
                elif c in "})]:" or c == "!" and source[at + 1 : at + 2] != "=":
                    if not open_:
                        break
                at += 1
            inner = re.sub(r"(?<![=!<>])=\s*$", "", without_fields(source[begin:at].strip()) or "")
            if not inner or not expression_fits(inner):
                return -1
            if source[at : at + 1] == "!":
                if source[at + 1 : at + 2] not in ("r", "s", "a"):
                    return -1
                at += 2
            if source[at : at + 1] == ":":
                at = fields_end(source, at + 1, quote, raw, True)
            if at < 0 or source[at : at + 1] != "}":
                return -1
            at += 1
    return -1


def without_fields(source: str) -> str | None:
    """The source with plain strings of as many lines in place of f-strings; None if one of them is not valid."""
    out, done = [], 0
    at = 0
    while m := STRING_START.search(source, at):
        at = m.end()
        if m[0][0] == "#":
            continue
        mark = m[0].lstrip("rRbBuUfF")
        prefix = m[0][: -len(mark)].lower()
        end = (fields_end if "f" in prefix else string_end)(source, at, mark, "r" in prefix)
        if end < 0:
            return None
        if "f" in prefix:
            lines = source.count("\n", m.start(), end)
            out += [source[done : m.start()], '"""' + "\n" * lines + '"""' if lines else '""']
            done = end + len(mark)
        at = end + len(mark)
    return "".join([*out, source[done:]])


def open_brackets(shape: str) -> str:
    """Brackets of a shape that stay open, BAD for one that closes wrongly."""
    b = shape.translate(BRACKETS)
    while b and (r := b.replace("()", "").replace("[]", "").replace("{}", "")) != b:
        b = r
    return BAD if any(c in ")]}" for c in b) else b


LEVELS = {"|": 5, "^": 6, "&": 7, "H": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "@": 10, "Q": 10}
ENDS = frozenset(")]},:;=GU")
NAME, PLACE, GROUP, STARRED, VALUE = range(5)  # what an expression is as a target


class Line:
    """One logical line by its shape."""

    def __init__(self, shape: str):
        self.s, self.i = shape + "\0\0\0", 0
        self.needs: list[str] = []  # what must be around: R function, r with a value, b c loops, Y function, F no coroutine, W coroutine, m module; a makes a coroutine, e catches all, u matches all

    def fail(self, what: str) -> None:
        raise Fault(what)

    def need(self, c: str, what: str = "") -> None:
        if self.s[self.i] != c:
            self.fail(what or f"expected '{c}'")
        self.i += 1

    def take(self, c: str) -> bool:
        if self.s[self.i] == c:
            self.i += 1
            return True
        return False

    def name(self) -> None:
        if self.s[self.i] not in "nMCT":
            self.fail("expected a name")
        self.i += 1

    # expressions
    def primary(self) -> int:
        s, c = self.s, self.s[self.i]
        if c == "W":
            self.i += 1
            self.needs.append("W")
            self.primary()
            return VALUE
        self.i += 1
        if c in "nMCT":
            kind = NAME
        elif c in "0k":
            kind = VALUE
        elif c in "SB":
            while s[self.i] in "SB":
                if s[self.i] != c:
                    self.fail("cannot mix bytes and nonbytes literals")
                self.i += 1
            kind = VALUE
        elif c == "(":
            kind = self.parenthesis()
        elif c == "[":
            kind = self.elements("]", GROUP)
        elif c == "{":
            self.braces()
            kind = VALUE
        else:
            self.i -= 1
            self.fail("invalid syntax")
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                self.name()
                kind = PLACE
            elif c == "(":
                self.i += 1
                self.arguments()
                kind = VALUE
            elif c == "[":
                self.i += 1
                self.subscripts()
                kind = PLACE
            else:
                return kind

    def parenthesis(self) -> int:
        if self.take(")"):
            return GROUP
        if self.s[self.i] == "Y":
            self.yielded()
            self.need(")", "'(' was never closed")
            return VALUE
        mark = len(self.needs)
        first = self.star_or_named()
        if self.s[self.i] in "fa":
            self.comprehension(first, mark, True)
            self.need(")", "'(' was never closed")
            return VALUE
        if self.s[self.i] == ",":
            kind = self.rest_of_elements(")", first)
            return kind
        self.need(")", "'(' was never closed")
        if first == STARRED:
            self.fail("cannot use starred expression here")
        return first

    def elements(self, close: str, whole: int) -> int:
        if self.take(close):
            return whole
        mark = len(self.needs)
        first = self.star_or_named()
        if self.s[self.i] in "fa":
            self.comprehension(first, mark)
            self.need(close)
            return VALUE
        return self.rest_of_elements(close, first)

    def rest_of_elements(self, close: str, first: int) -> int:
        kind = VALUE if first == VALUE else GROUP
        while self.take(","):
            if self.s[self.i] == close:
                break
            if self.star_or_named() == VALUE:
                kind = VALUE
        self.need(close, "invalid syntax. Perhaps you forgot a comma?")
        return kind

    def star_or_named(self) -> int:
        if self.take("*"):
            kind = self.binary(5)
            return VALUE if kind == VALUE else STARRED
        return self.named()

    def named(self) -> int:
        kind = self.test()
        if kind == NAME and self.s[self.i] == "U" and self.s[self.i - 1] in "nMCT":
            self.i += 1
            self.test()
            return VALUE
        return kind

    def comprehension(self, first: int, mark: int, generator: bool = False) -> None:
        """The clauses after an element that was read from mark on; all but the first iterable is a scope of its own."""
        if first == STARRED:
            self.fail("iterable unpacking cannot be used in comprehension")
        inner, clauses = self.needs[mark:], 0
        del self.needs[mark:]
        while self.s[self.i] in "fa":
            if self.take("a"):
                inner.append("W")
                if self.s[self.i] != "f":
                    self.fail("invalid syntax")
            self.need("f")
            self.targets()
            self.need("i", "expected 'in'")
            at = len(self.needs)
            self.disjunction()
            if clauses:
                inner += self.needs[at:]
                del self.needs[at:]
            clauses += 1
            at = len(self.needs)
            while self.take("I"):
                k = self.disjunction()
                if k == NAME and self.take("U"):
                    self.test()
            inner += self.needs[at:]
            del self.needs[at:]
        if "Y" in inner:
            self.fail("'yield' inside comprehension")
        if not generator and "W" in inner:
            self.needs.append("W")

    def targets(self) -> None:
        """Targets of for and of comprehensions."""
        while True:
            self.take("*")
            if self.binary(5) == VALUE:
                self.fail("cannot assign to expression here")
            if not self.take(",") or self.s[self.i] in "i=":
                return

    def braces(self) -> None:
        if self.take("}"):
            return
        if self.take("P"):
            self.binary(5)
            pairs = True
        else:
            mark = len(self.needs)
            first = self.star_or_named()
            pairs = self.take(":")
            if pairs:
                if first == STARRED:
                    self.fail("cannot use a starred expression in a dictionary key")
                self.test()
            if self.s[self.i] in "fa":
                self.comprehension(first, mark)
                return self.need("}")
        while self.take(","):
            if self.s[self.i] == "}":
                break
            if pairs and self.take("P"):
                self.binary(5)
            elif pairs:
                self.test()
                self.need(":", "':' expected after dictionary key")
                self.test()
            else:
                self.star_or_named()
        self.need("}", "invalid syntax. Perhaps you forgot a comma?")

    def arguments(self) -> None:
        keyword = double = False
        count = 0
        while not self.take(")"):
            if self.take("*"):
                if double:
                    self.fail("iterable argument unpacking follows keyword argument unpacking")
                self.test()
            elif self.take("P"):
                self.test()
                double = True
            elif self.s[self.i] in "nMCT" and self.s[self.i + 1] == "=":
                self.i += 2
                self.test()
                keyword = True
            else:
                mark = len(self.needs)
                first = self.named()
                if self.s[self.i] == "=":
                    self.fail("expression cannot contain assignment")
                if self.s[self.i] in "fa":
                    self.comprehension(first, mark, True)
                    if count or self.s[self.i] != ")" and not (self.s[self.i] == "," and self.s[self.i + 1] == ")"):
                        self.fail("Generator expression must be parenthesized")
                elif keyword or double:
                    self.fail("positional argument follows keyword argument")
            count += 1
            if not self.take(","):
                self.need(")", "invalid syntax. Perhaps you forgot a comma?")
                return

    def subscripts(self) -> None:
        if self.s[self.i] == "]":
            self.fail("expected an index")
        while True:
            if self.take("*"):
                self.binary(5)
            else:
                if self.s[self.i] != ":":
                    self.named()
                for _ in range(2):
                    if self.take(":") and self.s[self.i] not in ":],":
                        self.test()
            if not self.take(",") or self.s[self.i] == "]":
                break
        self.need("]", "invalid syntax. Perhaps you forgot a comma?")

    def binary(self, least: int) -> int:
        """Precedence climbing from | up to the unary operators and powers."""
        c = self.s[self.i]
        if c in "+-~":
            self.i += 1
            self.binary(11)
            kind = VALUE
        else:
            kind = self.primary()
            if self.take("P"):
                self.binary(11)
                kind = VALUE
        while (level := LEVELS.get(self.s[self.i], 0)) >= least:
            self.i += 1
            self.binary(level + 1)
            kind = VALUE
        return kind

    def comparison(self) -> int:
        if self.take("N"):
            self.comparison()
            return VALUE
        kind = self.binary(5)
        while True:
            c = self.s[self.i]
            if c == "<" or c == "i":
                self.i += 1
            elif c == "N" and self.s[self.i + 1] == "i":
                self.i += 2
            elif c == "s":
                self.i += 1
                self.take("N")
            else:
                return kind
            self.binary(5)
            kind = VALUE

    def disjunction(self) -> int:
        kind = self.comparison()
        while self.s[self.i] in "AO":
            self.i += 1
            self.comparison()
            kind = VALUE
        return kind

    def test(self) -> int:
        if self.take("L"):
            self.parameters(":", False)
            self.need(":")
            mark = len(self.needs)
            self.test()
            if "W" in self.needs[mark:]:
                self.fail("'await' outside async function")
            del self.needs[mark:]
            return VALUE
        kind = self.disjunction()
        if self.take("I"):
            self.disjunction()
            self.need("E", "expected 'else' after 'if' expression")
            self.test()
            return VALUE
        return kind

    def star_expressions(self, named: bool = False) -> int:
        one = self.star_or_named if named else lambda: self.star_or_named() if self.s[self.i] == "*" else self.test()
        if self.s[self.i] == "Y":
            self.yielded()
            return VALUE
        kind = one()
        if self.s[self.i] != ",":
            return kind
        kind = VALUE if kind == VALUE else GROUP
        while self.take(","):
            if self.s[self.i] in ")]}:;=G\0":
                break
            if one() == VALUE:
                kind = VALUE
        return kind

    def yielded(self) -> None:
        self.need("Y")
        self.needs.append("Y")
        if self.take("r"):
            self.needs.append("F")
            self.test()
        elif self.s[self.i] not in ")]};=\0":
            self.star_expressions()

    def parameters(self, close: str, typed: bool) -> None:
        default = star = bare = False
        seen = 0
        while self.s[self.i] != close:
            if self.take("/"):
                if not seen or star:
                    self.fail("/ must be ahead of *")
            elif self.take("*"):
                if star:
                    self.fail("* argument may appear only once")
                star, bare = True, self.s[self.i] == ","
                if not bare:
                    self.name()
                    if typed and self.take(":"):
                        self.take("*")
                        self.test()
                elif self.s[self.i + 1] in (close, "P"):
                    self.fail("named arguments must follow bare *")
            elif self.take("P"):
                self.name()
                if typed and self.take(":"):
                    self.test()
                self.take(",")
                if self.s[self.i] != close:
                    self.fail("arguments cannot follow var-keyword argument")
                return
            else:
                self.name()
                if typed and self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                    default = default or not star
                elif default and not star:
                    self.fail("parameter without a default follows parameter with a default")
            seen += 1
            if not self.take(",") and self.s[self.i] != close:
                self.fail("invalid syntax")

    # statements
    def simple(self) -> None:
        c = self.s[self.i]
        if c in "pbc":
            self.i += 1
            if c != "p":
                self.needs.append(c)
        elif c == "R":
            self.i += 1
            if self.s[self.i] not in ";\0":
                self.needs.append("r")
                start = self.i
                self.star_expressions()
                self.lone_star(start)
            else:
                self.needs.append("R")
        elif c == "q":
            self.i += 1
            if self.s[self.i] not in ";\0":
                self.test()
                if self.take("r"):
                    self.test()
        elif c == "m":
            self.i += 1
            while True:
                self.dotted()
                if self.take("z"):
                    self.name()
                if not self.take(","):
                    break
        elif c == "r":
            self.imported()
        elif c in "gl":
            self.i += 1
            self.name()
            while self.take(","):
                self.name()
        elif c == "v":
            self.i += 1
            self.test()
            if self.take(","):
                self.test()
        elif c == "d":
            self.i += 1
            kind = self.star_expressions()
            if kind in (VALUE, STARRED):
                self.fail("cannot delete expression")
        elif c == "T" and self.s[self.i + 1] in "nMCT":
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.test()
        else:
            self.assignment()

    def assignment(self) -> None:
        start = self.i
        kind = self.star_expressions()
        if self.s[self.i] == ":":
            if kind not in (NAME, PLACE):
                self.fail("only single target can be annotated")
            self.i += 1
            self.test()
            if self.take("="):
                self.star_expressions()
        elif self.s[self.i] == "G":
            if kind not in (NAME, PLACE):
                self.fail("illegal expression for augmented assignment")
            self.i += 1
            self.star_expressions()
        elif self.s[self.i] == "=":
            while self.take("="):
                if kind in (VALUE, STARRED):
                    self.fail("cannot assign to expression here. Maybe you meant '==' instead of '='?")
                self.one_star(self.s[start : self.i - 1])
                start = self.i
                kind = self.star_expressions()
            self.lone_star(start)
        else:
            self.lone_star(start)

    def lone_star(self, start: int) -> None:
        """A star needs a list around it."""
        if self.s[start] == "*" and "," not in self.s[start : self.i]:
            self.fail("can't use starred expression here")

    def one_star(self, target: str) -> None:
        """No list of targets has two with stars."""
        if target.count("*") < 2:
            return
        counts = [0]
        for before, c in zip("," + target, target):
            if c in "([{":
                counts.append(0)
            elif c in ")]}":
                counts.pop()
            elif c == "*" and before in ",([":
                counts[-1] += 1
                if counts[-1] > 1:
                    self.fail("multiple starred expressions in assignment")

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def imported(self) -> None:
        self.need("r")
        dots = 0
        while self.s[self.i] == "." or self.s[self.i] == "k":
            self.i += 1
            dots += 1
        if not dots or self.s[self.i] != "m":
            self.dotted()
        self.need("m", "invalid syntax")
        if self.take("*"):
            self.needs.append("m")
            return
        group = self.take("(")
        while True:
            self.name()
            if self.take("z"):
                self.name()
            if not self.take(","):
                break
            if group and self.s[self.i] == ")":
                break
            if not group and self.s[self.i] in ";\0":
                self.fail("trailing comma not allowed without surrounding parentheses")
        if group:
            self.need(")")

    def type_parameters(self) -> None:
        if self.take("["):
            while True:
                self.i += self.s[self.i] in "*P"
                self.name()
                if self.take(":"):
                    self.test()
                if self.take("="):
                    self.take("*")
                    self.test()
                if not self.take(",") or self.s[self.i] == "]":
                    break
            self.need("]")

    def header(self) -> str | None:
        """The kind of compound statement that begins here, its header read up to the colon; None for a simple one."""
        c = self.s[self.i]
        kind = c
        if c == "a":
            self.i += 1
            kind = self.s[self.i]
            if kind not in "Dfh":
                self.fail("invalid syntax")
            self.needs.append("a" if kind == "D" else "W")
            c = kind
        if c in "Iew":
            self.i += 1
            self.named()
        elif c == "f":
            self.i += 1
            self.targets()
            self.need("i", "invalid syntax")
            self.star_expressions()
        elif c in "Ety":
            self.i += 1
        elif c == "x":
            self.i += 1
            if self.take("*"):
                kind = "X"
            if self.s[self.i] != ":":
                self.test()
                if self.s[self.i] == ",":
                    self.fail("multiple exception types must be parenthesized")
                if self.take("z"):
                    self.name()
            elif kind == "X":
                self.fail("expected one or more exception types")
            else:
                self.needs.append("e")
        elif c == "h":
            self.i += 1
            self.items()
        elif c == "D":
            self.i += 1
            self.name()
            self.type_parameters()
            self.need("(", "expected '('")
            self.parameters(")", True)
            self.need(")")
            if self.take("V"):
                self.test()
        elif c == "K":
            self.i += 1
            self.name()
            self.type_parameters()
            if self.take("("):
                self.arguments()
        elif c == "M" or c == "C":
            at = self.i
            try:  # both are names as well
                self.simple()
                if self.s[self.i] in ";\0":
                    self.i = at
                    self.needs.clear()
                    return None
            except Fault:
                pass
            self.needs.clear()
            self.i = at + 1
            if c == "M":
                self.star_expressions(True)
            else:
                if self.s[self.i] in "nMCT" and self.s[self.i + 1] == ":":
                    self.needs.append("u")
                self.pattern(True)
                if self.take("I"):
                    self.named()
        elif c == "@":
            self.i += 1
            self.named()
            if self.s[self.i] != "\0":
                self.fail("invalid syntax")
            return "@"
        else:
            return None
        self.need(":", "expected ':'")
        return kind

    def items(self) -> None:
        at, mark = self.i, len(self.needs)
        if self.take("("):  # the parenthesised form first, then an expression
            try:
                while True:
                    self.test()
                    if self.take("z"):
                        if self.star_or_named() == VALUE:
                            self.fail("cannot assign to expression")
                    if not self.take(",") or self.s[self.i] == ")":
                        break
                self.need(")")
                if self.s[self.i] == ":":
                    return
            except Fault:
                pass
            self.i = at
            del self.needs[mark:]
        while True:
            self.test()
            if self.take("z") and self.star_target() == VALUE:
                self.fail("cannot assign to expression")
            if not self.take(","):
                return

    def star_target(self) -> int:
        return self.binary(5)

    def pattern(self, top: bool = False) -> None:
        stars = 0
        while True:
            stars += self.take("*")
            if stars > 1:
                self.fail("multiple starred names in sequence pattern")
            self.closed_pattern()
            while self.take("|"):
                self.closed_pattern()
            if self.take("z"):
                self.name()
            if not top or not self.take(",") or self.s[self.i] in ":I":
                return

    def closed_pattern(self) -> None:
        c = self.s[self.i]
        if c in "SB":
            while self.s[self.i] in "SB":
                self.i += 1
        elif c in "0-":
            self.take("-")
            self.need("0")
            if self.s[self.i] in "+-":
                self.i += 1
                self.need("0")
        elif c == "k":
            self.i += 1
        elif c in "([":
            self.i += 1
            close, stars = ")" if c == "(" else "]", 0
            while not self.take(close):
                stars += self.s[self.i] == "*"
                if stars > 1:
                    self.fail("multiple starred names in sequence pattern")
                self.pattern()
                if not self.take(",") and self.s[self.i] != close:
                    self.fail("invalid syntax")
        elif c == "{":
            self.i += 1
            while not self.take("}"):
                if self.take("P"):
                    self.name()
                else:
                    self.closed_pattern()
                    self.need(":")
                    self.pattern()
                if not self.take(",") and self.s[self.i] != "}":
                    self.fail("invalid syntax")
        else:
            self.dotted()
            if self.take("("):
                keyword = False
                while not self.take(")"):
                    if self.s[self.i] in "nMCT" and self.s[self.i + 1] == "=":
                        self.i += 2
                        keyword = True
                    elif keyword:
                        self.fail("positional patterns follow keyword patterns")
                    self.pattern()
                    if not self.take(",") and self.s[self.i] != ")":
                        self.fail("invalid syntax")

    def whole(self) -> tuple[str, bool, str, str, str]:
        """(kind of compound statement or '', whether a block must follow, fault or '', what the header needs, what follows it)."""
        kind, mark = "", 0
        try:
            found = self.header()
            if found is not None:
                kind, mark = found, len(self.needs)
                if self.s[self.i] == "\0":
                    return kind, kind != "@", "", "".join(self.needs), ""
            while True:
                self.simple()
                if not self.take(";") or self.s[self.i] == "\0":
                    break
            if self.s[self.i] != "\0":
                self.fail("invalid syntax")
            return kind, False, "", "".join(self.needs[:mark]), "".join(self.needs[mark:])
        except Fault as f:
            c = self.s[0] if self.s[0] != "a" else self.s[1]
            return kind or (c if c in "IEewftxyhDK@" else ""), self.s.rstrip("\0")[-1:] == ":", str(f), "", ""


class Scope:
    """A module, a class or a function, with what its lines may need; loops and handlers of it are views of the same names."""

    __slots__ = ("kind", "loop", "star", "names")

    def __init__(self, kind: str, loop: bool, star: str, names: "Names"):
        self.kind, self.loop, self.star, self.names = kind, loop, star, names

    def inside(self, kind: str, header: str) -> "Scope":
        """The scope of the block of a statement."""
        if kind == "D":
            return Scope("async" if "a" in header else "def", False, "", Names(self.names, True))
        if kind == "K":
            return Scope("class", False, "", Names(self.names, False))
        if kind in ("f", "w"):
            return Scope(self.kind, True, "R" if self.star else "", self.names)
        if kind == "X":
            return Scope(self.kind, self.loop, "Rbc", self.names)
        return self

    def lacks(self, needs: str) -> str:
        """What is missing around a statement, '' for nothing."""
        inside = self.kind in ("def", "async")
        for c in needs:
            if c in "Rr":
                if not inside:
                    return "'return' outside function"
                if self.star:
                    return "'break', 'continue' and 'return' cannot appear in an 'except*' block"
                self.names.seen |= {c} if self.kind == "async" else set()
            elif c in "bc":
                if c in self.star:
                    return "'break', 'continue' and 'return' cannot appear in an 'except*' block"
                if not self.loop:
                    return f"'{'break' if c == 'b' else 'continue'}' outside loop"
            elif c == "Y":
                if not inside:
                    return "'yield' outside function"
                self.names.seen |= {c} if self.kind == "async" else set()
            elif c == "F" and self.kind == "async":
                return "'yield from' inside async function"
            elif c == "W" and self.kind != "async":
                return "'await' outside async function"
            elif c == "m" and self.kind != "module":
                return "import * only allowed at module level"
        return "'return' with value in async generator" if self.names.seen >= {"r", "Y"} else ""


class Names:
    """What a scope's own lines name, kept only for files with global or nonlocal names."""

    __slots__ = ("outer", "function", "seen", "parameters", "lines")

    def __init__(self, outer: "Names | None", function: bool):
        self.outer, self.function = outer, function
        self.seen: set[str] = set()
        self.parameters: set[str] = set()
        self.lines: list[list[str]] = []

    def used(self, name: str) -> bool:
        """Whether a line of the scope uses a name; lines with scopes of their own are passed over."""
        for line in self.lines:
            if name in line and not any(t in ("for", "lambda", "import", "from") for t in line):
                for before, t, after in zip(["", *line], line, [*line[1:], ""]):
                    if t == name and before != "." and not (after == "=" and before in ("(", ",")):
                        return True
        return False

    def binds(self, name: str) -> bool:
        return name in self.parameters or any(name in line for line in self.lines)


def parameter_names(line: list[str]) -> tuple[list[str], str]:
    """The parameters of the function that a line defines, and what is wrong with names in it: a parameter or a keyword of a
    call that occurs twice."""
    own: list[str] = []
    stack: list[tuple[str, set[str]]] = []  # brackets and lambdas that are open
    defined, wrong = "def" in line, ""
    for i, t in enumerate(line):
        before = line[i - 1] if i else ""
        if t in ("(", "[", "{"):
            if t == "(" and defined and not any(k != "other" for k, _ in stack):
                stack.append(("parameters", set()))
                defined = False
            else:
                call = t == "(" and (before in (")", "]") or before.isidentifier() and before not in KEYWORDS) or t == "(" and before in ("match", "case", "type")
                stack.append(("call" if call else "other", set()))
        elif t in (")", "]", "}"):
            while stack and stack[-1][0] == "lambda":
                stack.pop()
            if stack:
                stack.pop()
        elif t == "lambda":
            stack.append(("lambda", set()))
        elif stack and t == ":" and stack[-1][0] == "lambda":
            stack.pop()
        elif stack and t.isidentifier() and stack[-1][0] != "other":
            kind, seen = stack[-1]
            if kind == "call":
                fits = before in ("(", ",") and line[i + 1 : i + 2] == ["="]
            else:
                lead = line[i - 2] if before in ("*", "**") and i > 1 else before
                fits = lead in ("(", ",", "lambda") and t not in KEYWORDS or lead in ("(", ",", "lambda") and t in ("match", "case", "type")
            if fits:
                if t in seen:
                    wrong = wrong or (f"keyword argument repeated: {t}" if kind == "call" else f"duplicate argument '{t}' in function definition")
                seen.add(t)
                if kind == "parameters":
                    own.append(t)
    return own, wrong


# which clauses may follow at the same indentation, and whether one must
FOLLOW = {"I": "eE", "e": "eE", "w": "E", "f": "E", "t": "xXy", "x": "xEy", "X": "XEy", "@": "DK@"}
MUST = "t@"


def faults(source: str) -> list[tuple[int, str]]:
    """(line, message) of what is wrong with a Python file, in order, however deep it is nested; empty if nothing is."""
    found = unbounded(lines_faults, source)
    if found and FIELDS.search(source) and "\0" not in source:  # fields of f-strings may hold the quotes around them
        flat = without_fields(source.replace("\r\n", "\n").replace("\r", "\n"))
        if flat is not None:
            return unbounded(lines_faults, flat)
    return found


def lines_faults(source: str) -> list[tuple[int, str]]:
    if "\0" in source:
        return [(source[: source.index("\0")].count("\n") + 1, "source code string cannot contain null bytes")]
    if "\r" in source:
        source = source.replace("\r\n", "\n").replace("\r", "\n")
    if len(CLASSES) > CACHE or len(CLASSES.indents) > 60_000:
        CLASSES.fresh()
    if len(VERDICTS) > CACHE:
        VERDICTS.clear()
    if len(LEFT) > CACHE:
        LEFT.clear()
    tokens = TOKEN.findall("\n" + source)
    whole = "".join(map(CLASSES.__getitem__, tokens))  # a character for a token
    parts = INDENTS.split(whole)
    named = "g" in whole or "l" in whole
    future = 1 if "__future__" in source else 0
    out: list[tuple[int, str]] = []
    indents = CLASSES.indents
    module = Scope("module", False, "", Names(None, False))
    levels: list[list] = [[0, 0, "", "", module, False]]  # column, its twin with narrow tabs, last clause chain, what the block belongs to, its scope, whether a clause took all exceptions
    block = ""  # the statement whose block must follow
    inner = module  # the scope of that block
    pending: list[tuple[int, str, Names]] = []  # nonlocal names
    pos = 0  # tokens read
    n = 0
    k, total = 1, len(parts)

    def fault(at: int, what: str) -> None:
        # strings and continued lines hide some line ends: the line is the number of line ends among the tokens before
        out.append((at, what))

    def leave() -> None:
        if levels[-1][2] and levels[-1][2] in MUST:
            fault(n, "expected 'except' or 'finally' block" if levels[-1][2] == "t" else "a decorator must be followed by a definition")
        levels.pop()

    while k < total:
        shape = parts[k + 1]
        n = (k + 1) // 2
        indent = parts[k]
        k += 2
        begin = pos + 1
        pos += 1 + len(shape)
        if not shape:
            continue
        left = LEFT.get(shape)
        if left is None:
            left = LEFT[shape] = open_brackets(shape)
        if left and left != BAD:
            rows = [shape]
            while left and left != BAD and k < total:
                more = parts[k + 1]
                if more[:1] in ("D", "K"):  # def and class stand in no bracket: reading goes on here
                    break
                k += 2
                pos += 1 + len(more)
                rows.append(more)
                if more:
                    b = LEFT.get(key := left + "|" + more)
                    if b is None:
                        b = open_brackets(left + more)
                        if len(more) < 200:
                            LEFT[key] = b
                    left = b
            shape = "".join(rows)
        if left:
            fault(n, "unmatched or mismatched bracket" if left == BAD else f"'{left[-1]}' was never closed")
            block = ""
            if left != BAD:
                continue
        if len(shape) > 120:
            shape = RUNS.sub(lambda m: "0:0," if ":" in m[0] else "n,", shape)
        v = VERDICTS.get(shape)
        if v is None:
            v = ("", False, "invalid character or literal", "", "") if BAD in shape else Line(shape).whole()
            if len(shape) < 400:
                VERDICTS[shape] = v
        kind, opens, wrong, header, rest = v
        if wrong:
            fault(n, wrong)
        col, alt = indents[indent]
        top = levels[-1]
        if block:
            if col <= top[0]:
                fault(n, "expected an indented block")
            else:
                if alt <= top[1]:
                    fault(n, "inconsistent use of tabs and spaces in indentation")
                top = [col, alt, "", block, inner, False]
                levels.append(top)
            block = ""
        if col > top[0]:
            fault(n, "unexpected indent")
            levels.append([col, alt, "", "", levels[-1][4], False])
        else:
            while col < levels[-1][0]:
                leave()
            if col > levels[-1][0]:
                fault(n, "unindent does not match any outer indentation level")
                levels.append([col, alt, "", "", levels[-1][4], False])
            elif alt != levels[-1][1]:
                fault(n, "inconsistent use of tabs and spaces in indentation")
        top = levels[-1]
        chain = top[2]
        if chain and kind and kind in FOLLOW.get(chain, ""):
            nxt = "l" if kind == "E" else "z" if kind == "y" else kind
            if kind == "E" and chain in "xX":
                nxt = "o"
        else:
            if chain == "o" and kind == "y":
                nxt = "z"
            else:
                if chain and chain in MUST:
                    fault(n, "expected 'except' or 'finally' block" if chain == "t" else "a decorator must be followed by a definition")
                if kind and kind in "eExXy":
                    fault(n, "invalid syntax")
                if (kind == "C") != (top[3] == "M"):
                    fault(n, "invalid syntax")
                nxt = kind if kind and kind in FOLLOW else ""
        top[2] = nxt
        scope = top[4]
        if kind == "x":
            if chain == "x" and top[5]:
                fault(n, "default 'except:' must be last")
            top[5] = "e" in header
        elif kind == "C":
            if top[5]:
                fault(n, "the pattern before makes this one unreachable")
            top[5] = "u" in header
        inner = scope.inside(kind, header)
        if header and (lack := scope.lacks(header)):
            fault(n, lack)
        if rest and (lack := inner.lacks(rest)):
            fault(n, lack)
        if named or kind == "D" or NAMED.search(shape):
            line = [t for t in tokens[begin:pos] if t[:1] != "\n"]
            own, wrong = parameter_names(line) if NAMED.search(shape) else ([], "")
            if wrong:
                fault(n, wrong)
            if named:
                names = scope.names
                if kind == "D":
                    inner.names.parameters |= set(own)
                if shape[0] in "gl":
                    for name in line[1::2]:
                        if name in names.parameters:
                            fault(n, f"name '{name}' is parameter and {line[0]}")
                        elif names.used(name):
                            fault(n, f"name '{name}' is used prior to {line[0]} declaration")
                        if shape[0] == "l":
                            pending.append((n, name, names))
                            if scope.kind == "module":
                                fault(n, "nonlocal declaration not allowed at module level")
                else:
                    names.lines.append(line)
        if future:
            if shape[:2] == "rn" and tokens[begin + 1] == "__future__":
                if future == 2:
                    fault(n, "from __future__ imports must occur at the beginning of the file")
                for before, name in zip(tokens[begin + 2 : pos], tokens[begin + 3 : pos]):
                    if name.isidentifier() and name not in FEATURES and name != "as" and before != "as":
                        fault(n, f"future feature {name} is not defined")
            elif shape.strip("S"):
                future = 2
        if opens:
            block = kind or "I"
    if block:
        fault(n, "expected an indented block")
    while levels:
        leave()
    for at, name, names in pending:
        outer = names.outer
        while outer is not None and not (outer.function and outer.binds(name)):
            outer = outer.outer
        if outer is None:
            fault(at, f"no binding for nonlocal '{name}' found")
    out.sort(key=lambda f: f[0])
    return numbered(source, out) if out else out


def numbered(source: str, out: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Line ends among the tokens to lines of the file: strings and continued lines hold line ends of their own."""
    lines, line, at = [0], 0, 0
    text = "\n" + source
    for m in TOKEN.finditer(text):
        if m[1][:1] == "\n":
            line += text.count("\n", at, m.start(1) + 1)
            at = m.start(1) + 1
            lines.append(line)
    return [(lines[min(n, len(lines) - 1)], what) for n, what in out]
