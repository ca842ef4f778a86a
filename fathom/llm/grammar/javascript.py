"""ECMAScript modules: statements by recursive descent, expressions by precedence climbing, recovery at the next statement."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

from fathom.llm.grammar import unbounded

# Reserved words of module code, punctuators and binary operators by precedence.
RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static await implements interface package private protected public".split())
PUNCTUATION = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
SKIP = re.compile(r"(?:[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/|[\n\r\u2028\u2029])*")
LINE_ENDS = "\n\r\u2028\u2029"
WORD = re.compile(r"#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|[\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)(?:n|(?:\.(?:\d(?:_?\d)*)?)?+(?:[eE][+-]?\d(?:_?\d)*)?)|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?))(?![\w$])")
STRING = re.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'")
BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})|[1-9]|0\d)")
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/(\w*)")
CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
NAME, PLACE, PATTERN, OTHER, REST = range(5)


class Fault(Exception):
    """What went wrong, with the token at which it did."""


def tokens(source: str, start: int = 0) -> tuple[list[str], list[bool], list[int], str]:
    """Token kinds (names n, private names #, numbers 0, strings S, templates T, regexes R, words and punctuation as they are), line break before, position, fault."""
    kinds, breaks, at = [], [], []
    i, n, braces, last = start, len(source), [], ""
    before: list[str] = []  # what stood before each open bracket; after a condition or a block a regular expression may come
    functions: list[int] = []  # depths at which a function that is a value waits for its body
    if not start and source.startswith("#!"):
        i = min((x for x in (source.find("\n"),) if x >= 0), default=n)
    skip, word, number, string, punct = SKIP.match, WORD.match, NUMBER.match, STRING.match, PUNCTUATION.match
    while True:
        m = skip(source, i)
        e = m.end()
        nl = e > i and any(c in LINE_ENDS for c in source[i:e])
        i = e
        if i >= n:
            break
        breaks.append(nl)
        at.append(i)
        c = source[i]
        if m := word(source, i):
            w = m[0]
            kind = w if w in RESERVED or w in ("async", "of", "from", "as", "get", "set", "static") else "#" if w[0] == "#" else "n"
            if w == "function":
                lead = kinds[-2] if last == "async" and len(kinds) > 1 else last
                if lead in BEFORE_OPERAND or lead and not lead[0].isalnum() and lead not in (")", "]", "}", ";", "{", "++", "--", "#", "`"):
                    functions.append(len(before))
        elif c in "\"'":
            m = string(source, i)
            if not m:
                return kinds, breaks, at, "unterminated string"
            if "\\" in m[0] and BAD_ESCAPE.search(m[0]):
                return kinds, breaks, at, "bad escape in string"
            kind = "S"
        elif m := number(source, i):
            kind = "0"
        elif c == "`" or c == "}" and braces and braces[-1] == 0:
            if c == "}":
                braces.pop()
                kinds.append("}$")
            else:
                kinds.append("T")
            e = CHUNK.match(source, i + 1).end()
            if e >= n:
                return kinds, breaks, at, "unterminated template"
            if source[e] == "$":
                braces.append(0)
                breaks.append(False)
                at.append(e)
                kinds.append("${")
                i = e + 2
                last = "${"
            else:
                breaks.append(False)
                at.append(e)
                kinds.append("`")
                i = e + 1
                last = "`"
            continue
        elif c == "/" and (last not in ("n", "#", "0", "S", "R", "`", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--")):
            m = REGEX.match(source, i)
            if not m or not re.fullmatch(r"(?!.*(.).*\1)[dgimsuvy]*", m[1]) or "u" in m[1] and "v" in m[1] or not groups_close(m[0][1 : -1 - len(m[1])]):
                return kinds, breaks, at, "invalid regular expression"
            kind = "R"
        else:
            m = punct(source, i)
            if not m:
                return kinds, breaks, at, f"unexpected character {c!r}"
            kind = m[0]
            if braces:
                braces[-1] += {"{": 1, "}": -1}.get(kind, 0)
        kinds.append(kind)
        if kind == "(" or kind == "{":
            value = kind == "{" and bool(functions) and functions[-1] == len(before)
            if value:
                functions.pop()
            before.append(last if kind == "(" else "block" if last in BEFORE_BLOCK and not value else "")
        elif (kind == ")" or kind == "}") and before:
            opener = before.pop()
            kind = ";" if opener in ("if", "while", "for") and kind == ")" or opener == "block" and kind == "}" else kind
        last = kind
        i = m.end()
    return kinds, breaks, at, "unterminated template" if braces else ""


BEFORE_BLOCK = frozenset((")", ";", "{", "}", "else", "do", "try", "finally", "=>", ""))
BEFORE_OPERAND = frozenset("return typeof new void delete in of instanceof await yield throw case".split())
GROUP = re.compile(r"\\[\s\S]|\[(?:\\[\s\S]|[^\]\\])*\]|\((?:\?(?:[:=!]|<[=!]|<[\w$]+>|[a-z-]+:))?|[\s\S]")


def groups_close(pattern: str) -> bool:
    """Whether a regular expression's groups close and every quantifier has something to repeat."""
    depth, before = 0, "("
    for m in GROUP.finditer(pattern):
        c = m[0]
        if c[0] == "(":
            depth += 1
            c = "("
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
        elif c in ("*", "+", "?"):
            if before in ("(", "|", "lazy") or before == "quantifier" and c != "?":
                return False
            c = "lazy" if before == "quantifier" else "quantifier"
        before = c
    return depth == 0


class Block:
    """The names of one scope: lexical ones, variables that are declared in it or pass through, and parameters of a function."""

    __slots__ = ("lexical", "variables", "parameters", "function")

    def __init__(self, function: bool = False, parameters: set[str] | None = None):
        self.lexical: set[str] = set()
        self.variables: set[str] = set()
        self.parameters, self.function = parameters or set(), function


class Module:
    """A token stream and the grammar of module code over it."""

    def __init__(self, kinds: list[str], breaks: list[bool], at: list[int], source: str):
        self.t, self.nl, self.i = kinds + ["\0"] * 4, breaks + [True] * 4, 0
        self.at, self.source = at, source
        self.fresh()
        self.exported: set[str] = set()
        self.exports: list[tuple[str, int]] = []  # local names and where they are exported
        self.top = self.blocks[0]

    def fresh(self) -> None:
        """Back to the top of the module, after a fault."""
        self.function = self.loop = self.switch = 0
        self.labels: list[str] = []
        self.generator = False
        self.is_async = True
        self.cover = -1  # where {a = 1} waits to become a pattern
        self.blocks: list[Block] = [getattr(self, "top", None) or Block(True)]
        self.bound: list[str] = []  # names of the patterns being read
        self.private: list[tuple[dict[str, str], list[tuple[str, int]]]] = []  # names that the classes around declare, and use
        self.super_property = self.super_call = self.new_target_fits = self.field = self.in_parameters = False
        self.exporting = False
        self.logic = ""  # the logical operator that the last expression has at its top

    def text(self, i: int) -> str:
        """The text of a name or a string token."""
        rule = STRING if self.t[i] == "S" else WORD
        m = rule.match(self.source, self.at[i]) if i < len(self.at) else None
        return (m[0][1:-1] if self.t[i] == "S" else m[0]) if m else ""

    def declare(self, name: str, kind: str) -> None:
        """kind is lexical, variable, or function; the last is a variable at the top of a function that is no module."""
        here = self.blocks[-1]
        if kind == "function":
            kind = "variable" if here.function and here is not self.top else "lexical"
        if kind == "lexical":
            if name in here.lexical or name in here.variables or name in here.parameters:
                self.fail(f"{name!r} is declared already")
            here.lexical.add(name)
            return
        for block in reversed(self.blocks):
            if name in block.lexical:
                self.fail(f"{name!r} is declared already")
            block.variables.add(name)
            if block.function:
                return

    def scoped(self, run: Callable[[], None], block: Block | None = None) -> None:
        self.blocks.append(block or Block())
        run()
        self.blocks.pop()

    def fail(self, what: str = "") -> None:
        raise Fault(what or f"unexpected token {self.t[self.i]!r}")

    def take(self, k: str) -> bool:
        if self.t[self.i] == k:
            self.i += 1
            return True
        return False

    def need(self, k: str) -> None:
        if self.t[self.i] != k:
            self.fail(f"expected {k!r}, not {self.t[self.i]!r}")
        self.i += 1

    def is_name(self, k: str) -> bool:
        return k == "n" or k in ("async", "of", "from", "as", "get", "set")

    def binding_name(self) -> None:
        if not self.is_name(self.t[self.i]):
            self.fail()
        name = self.text(self.i)
        if name in ("eval", "arguments"):
            self.fail(f"{name} cannot be bound")
        self.bound.append(name)
        self.i += 1

    def any_name(self) -> None:
        k = self.t[self.i]
        if k == "n" or k[:1].isalpha() and k not in ("S", "T", "R"):
            self.i += 1
        else:
            self.fail()

    def semicolon(self) -> None:
        if self.take(";") or self.t[self.i] in ("}", "\0") or self.nl[self.i]:
            return
        self.fail()

    # patterns and functions
    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding()
                if not rest and self.take("="):
                    self.assign()
                if rest or not self.take(","):
                    self.need("]")
                    return
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.binding_name()
                    self.need("}")
                    return
                named = self.is_name(self.t[self.i]) and self.text(self.i)
                self.property_name()
                if self.take(":"):
                    self.binding()
                elif not named:
                    self.fail()
                else:
                    self.bound.append(named)
                if self.take("="):
                    self.assign()
                if not self.take(","):
                    self.need("}")
                    return
        else:
            self.binding_name()

    def property_name(self) -> None:
        k = self.t[self.i]
        if k == "[":
            self.i += 1
            self.assign()
            self.need("]")
        elif k in ("S", "0"):
            self.i += 1
        else:
            self.any_name()

    def parameters(self) -> tuple[int, bool, set[str]]:
        """How many there are, whether they are plain names, and all names they bind."""
        kept, self.bound = self.bound, []
        self.need("(")
        count, plain = 0, True
        while not self.take(")"):
            rest = self.take("...")
            plain = plain and not rest and self.t[self.i] not in ("[", "{") and self.t[self.i + 1] != "="
            self.binding()
            count += 1 + rest
            if not rest and self.take("="):
                inside, self.bound = self.bound, []
                self.assign()
                self.bound = inside
            if rest or not self.take(","):
                self.need(")")
                break
        names, self.bound = self.bound, kept
        if len(set(names)) < len(names):
            self.fail("duplicate parameter name")
        return count, plain, set(names)

    def body(self, generator: bool = False, is_async: bool = False, plain: bool = True, names: set[str] | None = None, function: int = 1) -> None:
        kept = self.function, self.loop, self.switch, self.generator, self.is_async, self.labels
        self.function, self.loop, self.switch, self.generator, self.is_async, self.labels = function, 0, 0, generator, is_async, []
        self.need("{")
        if not plain and self.t[self.i] == "S" and self.text(self.i) == "use strict":
            self.fail("'use strict' in a function whose parameters are no plain names")
        self.blocks.append(Block(True, names))
        while not self.take("}"):
            self.statement()
        self.blocks.pop()
        self.function, self.loop, self.switch, self.generator, self.is_async, self.labels = kept

    def function_rest(self, is_async: bool, named: bool, declares: bool = False) -> None:
        star = self.take("*")
        if self.is_name(self.t[self.i]):
            self.binding_name()
            name = self.bound.pop()
            if declares:
                self.declare(name, "function")
        elif named:
            self.fail()
        self.callable(star, is_async)

    def callable(self, generator: bool, is_async: bool, method: bool = False, constructor: bool = False) -> int:
        """Parameters and body; how many parameters there are."""
        kept = self.generator, self.is_async, self.super_property, self.super_call, self.new_target_fits, self.field, self.in_parameters
        self.generator, self.is_async, self.super_property, self.super_call, self.new_target_fits, self.field = generator, is_async, method, constructor, True, False
        self.in_parameters = generator or is_async
        count, plain, names = self.parameters()
        self.in_parameters = False
        self.body(generator, is_async, plain, names)
        self.generator, self.is_async, self.super_property, self.super_call, self.new_target_fits, self.field, self.in_parameters = kept
        return count

    def class_rest(self, named: bool, declares: bool = False) -> None:
        if self.is_name(self.t[self.i]):
            self.binding_name()
            name = self.bound.pop()
            if declares:
                self.declare(name, "lexical")
        elif named:
            self.fail()
        derived = self.take("extends")
        self.private.append(({}, []))
        if derived:
            self.unary_tail()
        self.need("{")
        constructors = 0
        while not self.take("}"):
            if self.take(";"):
                continue
            constructors += self.member(derived)
            if constructors > 1:
                self.fail("a class has one constructor")
        declared, used = self.private.pop()
        for name, where in used:
            if name not in declared:
                if not self.private:
                    self.i = where
                    self.fail(f"{name} is not declared")
                self.private[-1][1].append((name, where))

    def private_name(self) -> bool:
        """Takes a private name where one is used."""
        if self.t[self.i] != "#":
            return False
        if not self.private:
            self.fail("private name outside of a class")
        self.private[-1][1].append((self.text(self.i), self.i))
        self.i += 1
        return True

    def member(self, derived: bool) -> bool:
        """Whether the member is the constructor."""
        stop = ("(", "=", ";", "}")
        static = False
        if self.t[self.i] == "static" and self.t[self.i + 1] not in stop:
            self.i += 1
            static = True
            if self.t[self.i] == "{":
                self.initialiser(lambda: self.body(function=0))
                return False
        is_async = generator = False
        accessor = ""
        if self.t[self.i] == "async" and self.t[self.i + 1] not in stop and not self.nl[self.i + 1]:
            self.i += 1
            is_async = True
        if self.take("*"):
            generator = True
        elif self.t[self.i] in ("get", "set") and self.t[self.i + 1] not in stop and not is_async:
            accessor = self.t[self.i]
            self.i += 1
        name = self.text(self.i) if self.t[self.i] in ("S", "n", "#") else ""
        if self.t[self.i] == "#":
            declared = self.private[-1][0]
            kind = f"{accessor}{static}"
            if name == "#constructor" or name in declared and {declared[name], kind} not in ({f"get{static}", f"set{static}"},):
                self.fail(f"{name} is declared already" if name in declared else "a private name cannot be #constructor")
            declared[name] = "both" if name in declared else kind
            self.i += 1
        else:
            self.property_name()
        constructor = name == "constructor" and not static
        if self.t[self.i] == "(":
            if constructor and (is_async or generator or accessor) or static and name == "prototype":
                self.fail(f"{name} cannot be such a member")
            count = self.callable(generator, is_async, True, constructor and derived)
            if accessor and count != (accessor == "set"):
                self.fail("a getter has no parameters, a setter one")
            return constructor
        if is_async or generator or accessor or name == "constructor" or static and name == "prototype":
            self.fail()
        if self.take("="):
            self.initialiser(lambda: self.assign())
        self.semicolon()
        return False

    def initialiser(self, run: Callable[[], object]) -> None:
        """Code of a class that runs like a method without parameters."""
        kept = self.super_property, self.super_call, self.new_target_fits, self.is_async, self.generator, self.field
        self.super_property, self.super_call, self.new_target_fits, self.is_async, self.generator, self.field = True, False, True, False, False, True
        run()
        self.super_property, self.super_call, self.new_target_fits, self.is_async, self.generator, self.field = kept

    # expressions
    def expression(self, no_in: bool = False) -> int:
        kind = self.assign(no_in)
        while self.take(","):
            self.assign(no_in)
            kind = OTHER
        return kind

    def arrow_body(self, is_async: bool, no_in: bool, plain: bool = True, names: set[str] | None = None) -> int:
        if self.nl[self.i]:
            self.fail()
        self.i += 1
        if self.t[self.i] == "{":
            self.body(False, is_async, plain, names)
        else:
            kept = self.generator, self.is_async
            self.generator, self.is_async = False, is_async
            self.assign(no_in)
            self.generator, self.is_async = kept
        return OTHER

    def assign(self, no_in: bool = False) -> int:
        t, k = self.t, self.t[self.i]
        if k == "yield" and self.generator:
            if self.in_parameters:
                self.fail("yield in parameters")
            self.i += 1
            if not self.nl[self.i] and t[self.i] not in (")", "]", "}", ",", ";", ":", "\0", "in", "}$"):
                self.take("*")
                self.assign(no_in)
            return OTHER
        if k == "async" and not self.nl[self.i + 1]:
            if self.is_name(t[self.i + 1]) and t[self.i + 2] == "=>":
                self.i += 1
                self.binding_name()
                return self.arrow_body(True, no_in, True, {self.bound.pop()})
            if t[self.i + 1] == "(" and (end := self.closing(self.i + 1)) and t[end + 1] == "=>":
                self.i += 1
                _, plain, names = self.parameters()
                return self.arrow_body(True, no_in, plain, names)
        if self.is_name(k) and t[self.i + 1] == "=>":
            self.binding_name()
            return self.arrow_body(False, no_in, True, {self.bound.pop()})
        if k == "(" and (t[self.i + 1] in (")", "...", "{", "[") or t[self.i + 2] in (",", ")", "=")) and (end := self.closing(self.i)) and t[end + 1] == "=>":
            _, plain, names = self.parameters()
            return self.arrow_body(False, no_in, plain, names)
        cover, start = self.cover, self.i
        self.cover = -1
        kind = self.conditional(no_in)
        if t[self.i] in ASSIGN:
            if kind == NAME and self.text(start) in ("eval", "arguments"):
                self.fail("invalid assignment target")
            if kind == OTHER or (kind == PATTERN and t[self.i] != "="):
                self.fail("invalid assignment target")
            self.cover = -1
            self.i += 1
            self.assign(no_in)
            kind = OTHER
        if self.cover < 0:
            self.cover = cover
        return kind

    def closing(self, i: int) -> int:
        """Where the bracket at i closes; 0 if it doesn't."""
        depth, t = 0, self.t
        while t[i] != "\0":
            if t[i] in ("(", "[", "{", "${"):
                depth += 1
            elif t[i] in (")", "]", "}", "}$"):
                depth -= 1
                if not depth:
                    return i
            i += 1
        return 0

    def conditional(self, no_in: bool) -> int:
        kind = self.binary(1, no_in)
        if self.take("?"):
            self.assign()
            self.need(":")
            self.assign(no_in)
            return OTHER
        return kind

    def binary(self, least: int, no_in: bool) -> int:
        if self.t[self.i] == "#" and self.t[self.i + 1] == "in":
            if least > BINARY["in"]:
                self.fail()
            self.private_name()
            kind = OTHER
        else:
            kind = self.unary()
        logic = ""
        while (level := BINARY.get(self.t[self.i], 0)) >= least:
            op = self.t[self.i]
            if op == "in" and no_in:
                break
            self.i += 1
            self.binary(level + (op != "**"), no_in)
            kind = OTHER
            if op in ("??", "||", "&&"):
                group = "?" if op == "??" else "|"
                if {group, logic, self.logic} >= {"?", "|"}:
                    self.fail("?? beside && or || needs brackets")
                logic = group
        self.logic = logic
        return kind

    def unary(self) -> int:
        k = self.t[self.i]
        if k in ("!", "~", "+", "-", "typeof", "void", "delete") or k == "await" and self.is_async:
            if k == "await" and self.in_parameters:
                self.fail("await in parameters")
            self.i += 1
            kind = self.unary()
            if self.t[self.i] == "**" and k != "await":
                self.fail()
            if k == "delete" and (kind == NAME or kind == PLACE and self.t[self.i - 1] == "#"):
                self.fail("delete of a name")
            return OTHER
        start = self.i
        if k in ("++", "--"):
            self.i += 1
            if self.unary() not in (NAME, PLACE) or self.i == start + 2 and self.text(start + 1) in ("eval", "arguments"):
                self.fail("invalid operand of ++ or --")
            return OTHER
        kind = self.unary_tail()
        if self.t[self.i] in ("++", "--") and not self.nl[self.i]:
            if kind not in (NAME, PLACE) or kind == NAME and self.text(start) in ("eval", "arguments"):
                self.fail("invalid operand of ++ or --")
            self.i += 1
            return OTHER
        return kind

    def template(self, tagged: bool = False) -> None:
        self.chunk(tagged)
        self.need("T")
        while self.take("${"):
            self.expression()
            self.chunk(tagged)
            self.need("}$")
        self.need("`")

    def chunk(self, tagged: bool) -> None:
        """The text after this token has only escapes that strings may have, unless a function reads it raw."""
        if not tagged and self.i < len(self.at) and BAD_ESCAPE.search(CHUNK.match(self.source, self.at[self.i] + 1)[0]):
            self.fail("bad escape in template")

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.assign()
            if not self.take(","):
                self.need(")")
                return

    def unary_tail(self) -> int:
        kind = self.primary()
        t = self.t
        chain = False
        while True:
            k = t[self.i]
            if k == ".":
                self.i += 1
                if not self.private_name():
                    self.any_name()
                kind = OTHER if chain else PLACE
            elif k == "?.":
                self.i += 1
                chain = True
                if t[self.i] == "(":
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif not self.private_name():
                    self.any_name()
                kind = OTHER
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
                kind = OTHER if chain else PLACE
            elif k == "(":
                self.arguments()
                kind = OTHER
            elif k == "T":
                if chain:
                    self.fail("template after ?.")
                self.template(True)
                kind = OTHER
            else:
                return kind

    def primary(self) -> int:
        k = self.t[self.i]
        if k == "n" or self.is_name(k) and not (k == "async" and self.t[self.i + 1] == "function"):
            if self.field and self.text(self.i) == "arguments":
                self.fail("arguments in a class field")
            self.i += 1
            return NAME
        if k in ("0", "S", "R", "this", "null", "true", "false"):
            self.i += 1
            return OTHER
        if k == "T":
            self.template()
        elif k == "(":
            self.i += 1
            kind = self.expression()
            self.need(")")
            return kind if kind in (NAME, PLACE) else OTHER
        elif k == "[":
            return self.array()
        elif k == "{":
            return self.object()
        elif k == "function":
            self.i += 1
            self.function_rest(False, False)
        elif k == "async":
            self.i += 2
            self.function_rest(True, False)
        elif k == "class":
            self.i += 1
            self.class_rest(False)
        elif k == "new":
            self.i += 1
            if self.take("."):
                if self.text(self.i) != "target" or not self.new_target_fits:
                    self.fail()
                self.any_name()
                return OTHER
            self.new_target()
        elif k == "super":
            self.i += 1
            if not (self.t[self.i] in (".", "[") and self.super_property or self.t[self.i] == "(" and self.super_call) or self.t[self.i + 1] == "#":
                self.fail("super is not possible here")
        elif k == "import":
            self.i += 1
            if self.take("."):
                if self.text(self.i) != "meta":
                    self.fail()
                self.any_name()
            elif self.t[self.i] != "(":
                self.fail()
        else:
            self.fail()
        return OTHER

    def new_target(self) -> None:
        if self.take("new"):
            if self.take("."):
                self.any_name()
            else:
                self.new_target()
        elif self.t[self.i] == "import":
            self.fail()
        else:
            self.primary()
        while True:
            if self.take("."):
                if not self.private_name():
                    self.any_name()
            elif self.take("["):
                self.expression()
                self.need("]")
            elif self.t[self.i] == "T":
                self.template(True)
            else:
                break
        if self.t[self.i] == "?.":
            self.fail("?. after new")
        if self.t[self.i] == "(":
            self.arguments()

    def array(self) -> int:
        self.i += 1
        kind = PATTERN
        while not self.take("]"):
            if self.take(","):
                continue
            rest = self.take("...")
            at = self.i
            if self.assign() == OTHER and not self.has_default(at) or rest and self.t[self.i] == ",":
                kind = OTHER
            if not self.take(","):
                self.need("]")
                break
        return kind

    def has_default(self, at: int) -> bool:
        return self.is_name(self.t[at]) or self.t[at] in ("[", "{", "this", "super")

    def object(self) -> int:
        self.i += 1
        t = self.t
        protos = 0
        while not self.take("}"):
            if self.take("..."):
                self.assign()
            else:
                stop = (",", ":", "(", "}", "=")
                is_async = generator = False
                accessor = ""
                if t[self.i] == "async" and t[self.i + 1] not in stop and not self.nl[self.i + 1]:
                    self.i += 1
                    is_async = True
                if self.take("*"):
                    generator = True
                elif t[self.i] in ("get", "set") and t[self.i + 1] not in stop:
                    accessor = t[self.i]
                    self.i += 1
                name = self.is_name(t[self.i])
                proto = t[self.i] in ("n", "S") and self.text(self.i) == "__proto__"
                self.property_name()
                if t[self.i] == "(":
                    count = self.callable(generator, is_async, True)
                    if accessor and count != (accessor == "set"):
                        self.fail("a getter has no parameters, a setter one")
                elif is_async or generator or accessor:
                    self.fail()
                elif self.take(":"):
                    self.assign()
                    protos += proto
                elif not name:
                    self.fail()
                elif t[self.i] == "=":
                    at = self.i
                    self.i += 1
                    self.assign()
                    self.cover = at
            if not self.take(","):
                self.need("}")
                break
        if protos > 1 and t[self.i] != "=":
            self.fail("duplicate __proto__")
        return PATTERN

    # statements
    def settled(self) -> None:
        if self.cover >= 0:
            self.i, self.cover = self.cover, -1
            self.fail("'=' in an object that is no pattern")

    def block(self) -> None:
        self.scoped(self.braces)

    def braces(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def declarations(self, word: str, no_in: bool = False) -> int:
        n, const = 0, word == "const"
        while True:
            pattern = self.t[self.i] in ("[", "{")
            kept, self.bound = self.bound, []
            self.binding()
            names, self.bound = self.bound, kept
            for name in names:
                if name == "let" and word != "var":
                    self.fail("let cannot be bound")
                self.declare(name, "variable" if word == "var" else "lexical")
                if self.exporting:
                    self.exports_as(name)
            n += 1
            if self.take("="):
                self.assign(no_in)
                self.settled()
                n += 100
            elif (pattern or const) and not (no_in and self.t[self.i] in ("of", "in")):
                self.fail("missing initializer")
            if not self.take(","):
                return n

    def looped(self) -> None:
        self.loop += 1
        self.nested()
        self.loop -= 1

    def nested(self) -> None:
        """A statement where declarations may not stand."""
        k = self.t[self.i]
        if k in ("const", "class", "import", "export", "function") or k == "let" and self.t[self.i + 1] in ("n", "[", "{"):
            self.fail("declaration in a single-statement context")
        self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.settled()
        self.need(")")

    def statement(self, top: bool = False) -> None:
        t, k = self.t, self.t[self.i]
        if k == "\0":
            self.fail("unexpected end of file")
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k in ("var", "let", "const"):
            self.i += 1
            self.declarations(k)
            self.semicolon()
        elif k == "function":
            self.i += 1
            self.function_rest(False, True, True)
        elif k == "async" and t[self.i + 1] == "function" and not self.nl[self.i + 1]:
            self.i += 2
            self.function_rest(True, True, True)
        elif k == "class":
            self.i += 1
            self.class_rest(True, True)
        elif k == "if":
            self.i += 1
            self.condition()
            self.nested()
            if self.take("else"):
                self.nested()
        elif k == "for":
            self.i += 1
            self.scoped(self.for_rest)
        elif k == "while":
            self.i += 1
            self.condition()
            self.looped()
        elif k == "do":
            self.i += 1
            self.looped()
            self.need("while")
            self.condition()
            self.take(";")
        elif k == "return":
            if not self.function:
                self.fail("return outside of a function")
            self.i += 1
            if t[self.i] not in (";", "}", "\0") and not self.nl[self.i]:
                self.expression()
                self.settled()
            self.semicolon()
        elif k in ("break", "continue"):
            self.i += 1
            if self.is_name(t[self.i]) and not self.nl[self.i]:
                name = self.text(self.i)
                if name not in self.labels and "*" + name not in self.labels or k == "continue" and "*" + name not in self.labels:
                    self.fail("undefined label")
                self.i += 1
            elif not (self.loop or k == "break" and self.switch):
                self.fail(f"{k} outside of a loop")
            self.semicolon()
        elif k == "throw":
            self.i += 1
            if self.nl[self.i]:
                self.fail()
            self.expression()
            self.semicolon()
        elif k == "try":
            self.i += 1
            self.block()
            caught = self.take("catch")
            if caught:
                self.scoped(self.catch)
            if self.take("finally"):
                self.block()
            elif not caught:
                self.fail("missing catch or finally after try")
        elif k == "switch":
            self.i += 1
            self.condition()
            self.need("{")
            self.switch += 1
            self.scoped(self.cases)
            self.switch -= 1
        elif k == "debugger":
            self.i += 1
            self.semicolon()
        elif k == "import" and t[self.i + 1] not in ("(", "."):
            if not top:
                self.fail("import inside of a block")
            self.i += 1
            self.import_rest()
        elif k == "export":
            if not top:
                self.fail("export inside of a block")
            self.i += 1
            self.export_rest()
        elif self.is_name(k) and t[self.i + 1] == ":":
            name = self.text(self.i)
            if name in self.labels or "*" + name in self.labels:
                self.fail("label is used already")
            self.i += 2
            after = self.i
            while self.is_name(t[after]) and t[after + 1] == ":":
                after += 2
            self.labels.append("*" + name if t[after] in ("for", "while", "do") else name)
            self.nested()
            self.labels.pop()
        else:
            self.expression()
            self.settled()
            self.semicolon()

    def catch(self) -> None:
        names: set[str] = set()
        if self.take("("):
            simple = self.is_name(self.t[self.i])
            kept, self.bound = self.bound, []
            self.binding()
            bound, self.bound = self.bound, kept
            names = set(bound)
            if len(names) < len(bound):
                self.fail("duplicate name in a catch clause")
            if not simple:
                self.blocks[-1].lexical |= names
            self.need(")")
        self.scoped(self.braces, Block(False, names))

    def cases(self) -> None:
        t, default = self.t, 0
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
                default += 1
                if default > 1:
                    self.fail("a switch has one default")
            self.need(":")
            while t[self.i] not in ("case", "default", "}"):
                self.statement()

    def exports_as(self, name: str) -> None:
        if name in self.exported:
            self.fail(f"{name!r} is exported already")
        self.exported.add(name)

    def for_rest(self) -> None:
        if self.take("await") and not self.is_async:
            self.fail("for await outside of an async function")
        self.need("(")
        t = self.t
        if t[self.i] in ("var", "let", "const"):
            self.i += 1
            n = self.declarations(t[self.i - 1], True)
            if t[self.i] in ("of", "in") and n == 1:
                is_of = t[self.i] == "of"
                self.i += 1
                self.assign() if is_of else self.expression()
                self.need(")")
                return self.looped()
        elif t[self.i] != ";":
            if t[self.i] == "async" and t[self.i + 1] == "of" and t[self.i - 2] != "await":
                self.fail("invalid target of a loop")
            kind = self.expression(True)
            if t[self.i] in ("of", "in"):
                if kind == OTHER:
                    self.fail("invalid target of a loop")
                self.cover = -1
                is_of = t[self.i] == "of"
                self.i += 1
                self.assign() if is_of else self.expression()
                self.need(")")
                return self.looped()
            self.settled()
        self.need(";")
        if t[self.i] != ";":
            self.expression()
        self.need(";")
        if t[self.i] != ")":
            self.expression()
        self.need(")")
        self.looped()

    def module_name(self) -> None:
        self.any_name() if self.t[self.i] != "S" else self.need("S")

    def attributes(self) -> None:
        if self.t[self.i] == "with":
            self.i += 1
            self.object()
        self.semicolon()

    def import_rest(self) -> None:
        if self.take("S"):
            return self.attributes()
        more = True
        if self.is_name(self.t[self.i]):
            self.imported()
            more = self.take(",")
        if more:
            if self.take("*"):
                self.need("as")
                self.imported()
            else:
                self.specifiers(True)
        self.need("from")
        self.need("S")
        self.attributes()

    def imported(self) -> None:
        self.binding_name()
        self.declare(self.bound.pop(), "lexical")

    def specifiers(self, bind: bool) -> list[tuple[str, int, bool]]:
        """The names on the left of each specifier, where they stand, and whether they are names that a module may have."""
        self.need("{")
        found = []
        while not self.take("}"):
            at, plain = self.i, self.is_name(self.t[self.i])
            found.append((self.text(at), at, plain))
            self.module_name()
            if self.take("as"):
                at = self.i
                if bind:
                    self.imported()
                else:
                    self.module_name()
            elif bind:
                if not plain:
                    self.fail()
                self.i = at
                self.imported()
            if not bind:
                self.exports_as(self.text(at))
            if not self.take(","):
                self.need("}")
                break
        return found

    def export_rest(self) -> None:
        t = self.t
        if self.take("default"):
            self.exports_as("default")
            if self.take("function"):
                self.function_rest(False, False, True)
            elif t[self.i] == "async" and t[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 2
                self.function_rest(True, False, True)
            elif self.take("class"):
                self.class_rest(False, True)
            else:
                self.assign()
                self.settled()
                self.semicolon()
        elif self.take("*"):
            if self.take("as"):
                self.exports_as(self.text(self.i))
                self.module_name()
            self.need("from")
            self.need("S")
            self.attributes()
        elif t[self.i] == "{":
            found = self.specifiers(False)
            if self.take("from"):
                self.need("S")
                return self.attributes()
            for name, at, plain in found:
                if not plain:
                    self.i = at
                    self.fail()
                self.exports.append((name, at))
            self.semicolon()
        elif t[self.i] in ("var", "let", "const", "function", "class", "async"):
            if t[self.i] == "async" and t[self.i + 1] != "function":
                self.fail()
            if t[self.i] in ("var", "let", "const"):
                at = self.i
                self.i += 1
                self.exporting = True
                self.declarations(t[at])
                self.exporting = False
                return self.semicolon()
            at = self.i + 1 + (t[self.i] == "async")
            at += t[at] == "*"
            self.exports_as(self.text(at))
            self.statement()
        else:
            self.fail()


def module_faults(source: str) -> list[tuple[int, str]]:
    """(line, message) of what is wrong with a module, in order; empty if nothing is.

    After a token that is none, reading goes on in the next line.
    """
    ends = [m.start() for m in re.finditer("\n", source)]
    out: list[tuple[int, str]] = []
    start = 0
    while True:
        bad = part_faults(source, start, ends, out)
        k = bisect_left(ends, len(source) if bad is None else bad)
        if k == len(ends):
            return out
        start = ends[k] + 1


def faults(source: str) -> list[tuple[int, str]]:
    """(line, message) of what is wrong with a module, in order, however deep it is nested; empty if nothing is."""
    return unbounded(module_faults, source)


def part_faults(source: str, start: int, ends: list[int], out: list[tuple[int, str]]) -> int | None:
    """Adds what is wrong from start on to out, up to a token that is none, whose position is returned."""
    kinds, breaks, at, wrong = tokens(source, start)
    start_at = start
    p = Module(kinds, breaks, at, source)
    end = len(kinds)
    line = lambda k: bisect_left(ends, at[k] if 0 <= k < len(at) else len(source)) + 1

    def skip() -> None:
        while p.i < end and not (p.nl[p.i] and p.t[p.i] in ("import", "export", "function", "const", "let", "var", "class")):
            p.i += 1

    if start:
        skip()
    while p.i < end:
        start = p.i
        try:
            p.statement(True)
        except Fault as f:
            if wrong and p.i >= end:
                break
            out.append((line(p.i), str(f)))
            p.i = max(p.i, start + 1)
            skip()
            p.fresh()
    if not wrong and not start_at:  # a module that was read in parts has faults of its own
        out += [(line(k), f"{name!r} is exported but not declared") for name, k in p.exports if name not in p.top.lexical and name not in p.top.variables]
        out.sort(key=lambda f: f[0])
    if wrong:
        out.append((line(len(at) - 1) if at else 1, wrong))
        return at[-1] if at else None
    return None
