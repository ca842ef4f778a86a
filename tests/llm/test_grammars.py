"""Problem 3: the recognisers against the languages' own readers and small cases."""

import json
import random
import tomllib
import warnings

import pytest

from fathom.llm.grammar import data, javascript, python
from fathom.llm.parse_files import rates, verdicts

GOOD = [
    "", "\n", "# only a comment", "x = 1", "x: int = 1\n", "def f(a, /, b=1, *c, d, **e) -> int:\n    return a\n", "class A(B, metaclass=C): pass\n", "async def f():\n  async with a as b, c: await d\n  async for x in y: yield x\n",
    "try:\n    pass\nexcept* (A, B) as e:\n    pass\nelse:\n    pass\nfinally:\n    pass\n", "match x:\n    case [1, *_] | {'a': 2} if y: pass\n    case A(b=1) as c: pass\n    case _: pass\n", "match = case = type = 1\nprint(match[0])\n",
    "async def f():\n    a = [i async for i in b if c if d]\n", "f(*a, b, **c)\n", "lambda *a, b=1: (yield)\n", "x = a if b else c\n", "print(a := 1)\n", "type X[T: int] = list[T]\n", "def f[T](x: T): ...\n", "f'{x!r:>{w}} {{}}'\n", "with (open(a) as b, c): pass\n", "a[1:2, ::3, ...] = 1\n",
    "if a:\n\tb\nelse:\n\tc\n", "x = (1,\n  2)\n", "s = '''a\nb'''\nt = 1\n", "del a, (b), [c]\n", "from . import (a as b,)\n", "from ...x import *\n", "a = b = yield_ = 1\n", "raise A from b\n", "for x, in y: break\nelse: pass\n", "@a.b(c)\n@d\ndef f(): pass\n", "0x_f + 0b1 + 1_0.5e-3j\n", "x = not a in b is not c\n", "\\\n  \nx = 1\n", "while (y := f()): pass\n", "{**a, 'b': 1}; {1, *c}; {k: v for k, v in z}\n", "x = a @ b ** -c // ~d\n", "global a, b; nonlocal_ = 1\n", "assert a, b\n", "x = *a, b\n", "def f(a, *, b): return\n", "\ufeffx"[1:],
]
BAD = [
    "def f(:\n    pass\n", "print 'x'\n", "x = (1\n", "x = 1)\n", "if a\n    b\n", "if a:\nb\n", "  x = 1\n", "if a:\n    b\n  c\n", "x ==\n", "1 = x\n", "f() = 1\n", "x = 'a\n", "try:\n    a\n", "else: b\n", "except A, B: pass\n", "try: a\nexcept A, B: pass\n", "a b\n", "<<<<<<< HEAD\nx = 1\n", "x = 1\0\n", "0777\n", "f(a=1, b)\n", "def f(a=1, b): pass\n", "x = “a”\n", "f'{'\n", "f'{}'\n", "'\\x1'\n", "import\n", "from x import\n", "class\n", "@a\nx = 1\n", "for x y: pass\n", "x = [1 2]\n", "{1: 2, 3}\n", "lambda x\n", "del f()\n", "a = yield = 1\n", "match x:\n    a\n", "if a:\n\tb\n        c\n", "x = a if b\n", "b'é'\n", "1__0\n", "x +\n", "(a for a in b, c)\nf(x for x in y, 1)\n", "return = 1\n", "async x\n", "with a as f(): pass\n", "*a\n", "x += y = z\n", "def f(*): pass\n", "exec 'x'\n", "a <> b\n", "`a`\n", "$x\n", "x: int, y = 1\n",
]


SCOPES = [
    "return 1\n", "yield x\n", "x = yield\n", "await x\n", "break\n", "continue\n", "nonlocal x\n", "a = 1\nglobal a\n", "global a\na = 1\n", "def f(a, a): pass\n", "lambda a, a: 1\n", "lambda a=(lambda a: a): a\n", "f(a=1, a=2)\n", "f(a=1, b=g(a=2))\n", "from x import *\n", "async def g():\n    await z\n", "for i in x:\n    break\nelse:\n    continue\n",
    "def f(x):\n    global x\n", "def f():\n    x = 1\n    def g():\n        nonlocal x\n        x = 2\n", "def f():\n    def g():\n        nonlocal q\n", "try: pass\nexcept: pass\nexcept A: pass\n", "try:\n    pass\nexcept* A:\n    break\n", "f\"{\"a\"}\"\n", "f'{x['a']!r:>{w['b']}}'\n", "f'{x[}'\n", "f'{'\n'\n}'\n", "1if x else 2\n", "0x1for x in y\n", "from __future__ import annotations\n",
    "x = 1\nfrom __future__ import annotations\n", "from __future__ import foo\n", "*a, *b = c\n", "*a, (*b, d) = c\n", "x = *a\n", "x = *a,\n", "'\\N{BULLET}'\n", "'\\N{NO SUCH NAME}'\n", "match x:\n  case _: pass\n  case 1: pass\n", "match x:\n  case _ if y: pass\n  case 1: pass\n", "match a:\n    case A(x=1, y): pass\n", "match a:\n    case [*a, *b]: pass\n", "[await x for x in y]\n", "(await x for x in y)\n", "[i async for i in y]\n", "(i async for i in y)\n", "lambda: await x\n", "[(yield) for x in y]\n", "yield from x\n", "async with a: pass\n",
]
SCOPES += [head + "".join(f"    {row}\n" for row in s.splitlines()) for s in SCOPES if "\n'" not in s for head in ("def outer():\n", "async def outer():\n", "class Outer:\n", "while True:\n")]


@pytest.mark.parametrize("source", GOOD + BAD + SCOPES)
def test_python_agrees_with_the_compiler(source):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(source, "f", "exec", dont_inherit=True)
            fine = True
        except (SyntaxError, ValueError):
            fine = False
    assert (not python.faults(source)) == fine


def test_python_goes_on_after_a_fault_and_numbers_lines():
    f = python.faults("x = 1\ny = (]\nz = 2\nprint 'a'\n'''\n\n'''\ndef f()\n    pass\n")
    assert [n for n, _ in f][:1] == [2] and {n for n, _ in f} >= {2, 4, 8}


def test_faults_are_found_to_the_end_of_a_file():
    assert [n for n, _ in python.faults("x = = 1\ny = 2\n" * 120)] == list(range(1, 240, 2))
    assert [n for n, _ in javascript.faults("".join(f"const x{i} = = 1;\nconst y{i} = 2;\n" for i in range(120)))] == list(range(1, 240, 2))
    assert [n for n, _ in python.faults("x = (1\ndef f():\n    pass\ny = = 2\n")] == [1, 4]
    assert [n for n, _ in javascript.faults("let a = 'b\nlet c = 1;\nlet d = = 2;\n")][-1] == 3


def test_depth_is_no_fault():
    chain = "if (a === 0) { b(); }" + "".join(f" else if (a === {i}) {{ b({i}); }}" for i in range(3000))
    for good in (chain, "let x = " + "[" * 3000 + "]" * 3000 + ";", "f(" * 2000 + ")" * 2000, "let y = " + "{a: (" * 500 + "1" + ")}" * 500):
        assert javascript.faults(good) == []
    assert [n for n, _ in javascript.faults(chain + "\nlet z = = 1;")] == [2]
    assert javascript.faults("let x = " + "[" * 3000 + "]" * 2999 + ";")
    assert data.toml_faults("a = " + "[" * 3000 + "]" * 3000) == [] and data.toml_faults("a = " + "[" * 3000 + "]" * 2999)


def test_python_mutations_of_this_library():
    import glob
    import os

    rng = random.Random(2)
    files = glob.glob(os.path.join(os.path.dirname(python.__file__), "*.py"))
    missed = []
    for path in files:
        text = open(path, encoding="utf-8").read()
        assert not python.faults(text), path
        for _ in range(60):
            at = rng.randrange(len(text))
            cut = rng.choice([text[:at], text[:at] + rng.choice("()[]{}:,'\"=\n ") + text[at:], text[:at] + text[at + 1 :]])
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    compile(cut, "f", "exec", dont_inherit=True)
                    continue
                except SyntaxError as e:
                    # later stages than the grammar may refuse what it accepts
                    if "outside" in str(e) or "duplicate" in str(e) or "prior to" in str(e) or "nonlocal" in str(e) or "repeated" in str(e):
                        continue
            if not python.faults(cut):
                missed.append((path[-20:], at))
    assert len(missed) <= 2, missed


JS_GOOD = [
    "", "import a, {b as c} from 'x';\nimport * as d from \"y\"\nimport 'z'\n", "export default function () {}\nexport const a = 1, {b, c: [d = 2, ...e]} = f\nexport * as g from 'h'\nexport {a as k}\n", "const f = async ({a = 1, ...b}, [c], ...d) => { await a; for await (const x of y) {} }\n", "class A extends (b, c) { static #x = 1; get y() { return this.#x } static { } async *[z]() { yield* w } 'q'() {} static async = 1\n async\n x\n }\n",
    "let x = /[/]\\/(?<a>b)/giu.test(y) / 2 / z\n", "a = `x${b + `y${c}`}z`\n", "if (a) b\nelse c\nfor (;;) { break }\ndo x++; while (y) z\n", "l: for (const k in o) { continue l }\n", "var o = {a, 'b': 1, 3: 2, [c]: 3, get d() { return 1 }, set d(v) {}, async e() {}, *f() {}, ...g, async: 1, get: 2}\n", "({a, b = 1} = c);\n[a, b] = [b, a]\n", "a ?? b; a?.b?.[c]?.(d)\n", "x = a ? b : c ? d : e\n", "switch (a) { case 1: case 2: b; break; default: c }\n", "try { a } catch { b } finally { c }\n", "new A\nnew a.b(c)\nnew (f())()\nnew.target\n".replace("new.target\n", ""), "a\n++b\n", "async function f() {}\nasync () => 1\nasync (x)\n", "var a = 1\nvar b = 2\n", "0x1f + 0b1 + 0o7 + 1_000n + .5e3\n", "x = function* () { yield\n yield* a }\n", "#!/bin/node\na\n", "import.meta.url; import('x')\n", "throw a\n", "// c\n/* d\n */ e\n", "a = b\n/c/d\n", "const {length} = 'x', of = 1, get = 2, from = 3, as = 4\n",
]
JS_BAD = ["import a from b", "export function (", "const a", "let = 1 2", "function f( {", "a b", "{", "}", "(a", "[1, 2", "x = 'a", "`a", "<html>", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "def f(x):\n  return x\n", "return 1", "if (a", "for (const x of) {}", "a = {b: }", "class { }", "import {a b} from 'x'", "({a = 1})", "1 = a", "a++ = 1", "break", "\"\"\"doc\"\"\"", "x = “a”", "var 1a", "f(,)", "a ? b", "try {}", "else {}", "x = /a", "a => {", "0777", "with (a) {}", "{ import 'a' }", "from . import x", "\0", "enum A {}", "a.#", "() + 1", "async function f() { for (await x of y) {} }", "new a.", "case 1:"]


JS_GOOD += ["var a; var a\nfunction f() { function a() {} function a() {} var b; let c; { let b; var d } }", "try {} catch (e) { var e }", "class A { #x = 1; get #y() { return this.#x } set #y(v) {} m(o) { return #x in o } }", "class A extends B { constructor() { super(); super.m() } static m = () => super.n }", "(a ?? b) || c; a || (b ?? c)", "export {q}; let q\nexport default 1", "if (/a/.test(b)) /c/.test(d)\n{}\n/e/g.test(f)", "x = function () {} / 2; y = {} / 2; z = a\n/ b / g", "l: for (;;) { for (;;) continue l }", "for (let i of x) { let i }", "switch (a) { case 1: let b; default: c }", "({__proto__: 1, ['__proto__']: 2, get a() { return 1 }, set a(v) {}})", "a`\\01`", "function f(a = 1, {b}, [c]) { { let a } }", "let f = (a, b) => { let c }, g = async ({a}) => { await a }", "/(?<a>x)[(](?:y)?\\(+/u"]
JS_BAD += ["let a; let a", "let a; var a", "var a; function a() {}", "{ function a() {} function a() {} }", "function f(a) { let a }", "(a) => { let a }", "try {} catch (e) { let e }", "import a from 'x'; const a = 1", "class A { m() { return this.#x } }", "class A { #x; #x }", "class A { constructor() {} constructor() {} }", "class A { constructor() { super() } }", "function f() { super.x }", "a ?? b || c", "a && b ?? c", "export {zz}", "export default 1; export default 2", "export const a = 1; export {a}", "new a?.b()", "a?.b`x`", "a?.b = 1", "delete a", "eval = 1", "arguments++", "function f(a, a) {}", "([a], {a}) => 1", "break l", "l: { continue l }", "l: l: x", "let [a, a] = b", "new.target", "import.foo", "function f(a = 1) { 'use strict' }", "({get a(b) {}})", "({__proto__: 1, '__proto__': 2})", "/(/", "/a**/", "/+a/", "`\\01`", "[a, ...b, c] = d", "1.a", "class A { static { return } }", "class A { x = arguments }", "async function f(a = await 1) {}", "for (async of x) {}", "switch (a) { default: default: }"]


@pytest.mark.parametrize("source", JS_GOOD)
def test_good_modules(source):
    assert javascript.faults(source) == []


@pytest.mark.parametrize("source", JS_BAD)
def test_bad_modules(source):
    assert javascript.faults(source)


@pytest.mark.parametrize("source", ["", " ", "{}", "[]", "1", '"a"', "null", '{"a": [1, -2.5e3, true, {"b": []}]}', '{"a": 1,}', "[1,]", "{a: 1}", "{'a': 1}", "[1 2]", "01", "1.", '"\\x"', '"a\nb"', "[", "]", "{", '{"a"}', "nul", "[1]x", "// c\n{}", '"\\ud83d\\ude00"', "[[[[1]]]]" * 2, "-", "[" * 3000 + "]" * 3000])
def test_json_agrees(source):
    try:
        json.loads(source)
        fine = True
    except (ValueError, RecursionError):
        fine = source.startswith("[[[[[[")
    assert (not data.json_faults(source)) == fine


@pytest.mark.parametrize("source", ["", "a = 1\n", "[a]\nb = 'x'\n[a.c]\n[[d]]\n[[d]]\n[d.e]\n", "a.b = 1\na.c = 2\n", "a = 1\na = 2\n", "[a]\n[a]\n", "a = \n", "a 1\n", "= 1\n", "a = [1, 2,\n 3, # c\n]\n", "a = {b = 1, c.d = 2}\n", "a = {b = 1,}\n", "a = '''x\ny'''\n", 'a = """x\\\n  y"""\n', 'a = "\\q"\n', "a = 1979-05-27T07:32:00Z\nb = 07:32:00\nc = 1979-05-27\n", "a = 1_000\nb = 0xff\nc = inf\nd = -nan\n", "a = 01\n", "a = tru\n", "[a\n", "[a]]\n", "a = 'b\n", "a = {b = 1\n}\n", "<<<<<<< x\n", "a.b = 1\n[a]\n", "[a.b]\n[a]\nc = 1\n", "a = 1 b = 2\n", '"a b".c = 1\n', "a = [\n", "[[a]]\n[a]\n", "a = 1\n[a.b]\n", "a = 1\r\nb = 2\r\n", "a = 1979-13-01\n", "a = 2024-02-30\n", "a = 2024-02-29\n", "a = 1900-02-29\n", "a = 2023-04-31T00:00:00Z\n"])
def test_toml_agrees(source):
    try:
        tomllib.loads(source)
        fine = True
    except tomllib.TOMLDecodeError:
        fine = False
    assert (not data.toml_faults(source)) == fine


def test_json_and_toml_go_on_after_a_fault():
    assert [n for n, _ in data.json_faults('{\n"a": 01,\n"b": [1 2, {"c" 3}, 4],\nd: 5,\n"e": 6,\n}\n')] == [2, 3, 3, 4, 6]
    assert [n for n, _ in data.json_faults("[" + "nul,\n" * 300 + "1]")] == list(range(1, 301))
    assert data.json_faults('[{"a": [1, 2}, 3,\n4,\n]') == [(1, "expected ',' or ']'"), (3, "expected a value")]
    assert len(data.json_faults('{"a": [1, {"b": 2\n')) == 1 and len(data.json_faults("[" * 5000)) == 1
    assert [n for n, _ in data.json_faults('// c\n{"a": "\\x",\n"b": tru}\n{}')] == [1, 2, 3, 4]
    assert [n for n, _ in data.toml_faults("a = \nb = 1\n[c\nb = 2\nb = [1,\n2\nd = 01\n[e]\nf = 1\nf = 2\n")] == [1, 3, 5, 7, 10]


def test_many_indentations_and_deep_brackets():
    rows = "x = [\n" + "".join(" " * (i % 90) + "\t" * (i // 90) + "1,\n" for i in range(7000)) + "]\n"
    assert python.faults(rows) == [] and python.faults("if a:\n    b\n") == []
    assert python.faults("x = " + "(" * 190 + "1" + ")" * 190 + "\n") == [] and python.faults("x = " + "(" * 190 + "1" + ")" * 189 + "\n")


def test_verdicts_and_rates(spark):
    rows = [(1, "r", "a.py", "x = 1\r\n", "k"), (1, "r", "a.py", "x = 1\r\n", "k"), (2, "r", "b.py", "x = (", "k"), (3, "r", "c.json", "", "k"), (4, "r", "d.py", "", "k"), (5, "r", "e.js", None, "k"), (6, None, "f.toml", "a =", "k"), (7, "r", "g.txt", "(", "k"), (8, "r", None, "x", "k"), (9, "q", "h.py", "f'{d['a']}'\n" + "x" * 200_000, "k")]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, source string, language string")
    v = verdicts(df)
    assert {(r.file_id, r.accepted) for r in v.collect()} == {(1, True), (2, False), (3, False), (4, True), (6, False), (9, True)}
    got = {(r.repo, r.language): (r.files, r.invalid) for r in rates(v).collect()}
    assert got == {("r", "python"): (3, 1), ("r", "json"): (1, 1), (None, "toml"): (1, 1), ("q", "python"): (1, 0)}
    assert verdicts(df.limit(0)).count() == 0
