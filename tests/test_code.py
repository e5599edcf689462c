"""The TypeScript lexer and the declarations it finds."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewell.sources.code import Tokens, chunk_code, declarations


def paths(text):
    return ["/".join(r["heading_path"]) for r in chunk_code("a.ts", text)]


def lines(text):
    return {"/".join(r["heading_path"]): (r["line_range"]["start"], r["line_range"]["end"]) for r in chunk_code("a.ts", text)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        # decorators on the line of what they decorate
        ("@Component struct Index { build() { Text('x') } }", ["Index", "Index/build"]),
        ("@Injectable() export class A { m() {} }", ["A", "A/m"]),
        ("@Extend(Text) function fancy() {}\n@a.b.c({ d: '}' })\nclass D {}", ["fancy", "D"]),
        # regular expressions and divisions
        ("const r = /`/;\nclass B { go() { return 1 } }", ["B", "B/go"]),
        ("a = b / c; d = e / f\nclass D {}", ["D"]),
        ("x = (1 + 2) / 3 / 4; y = z[0] / 2 / `q`\nclass E {}", ["E"]),
        ("function t() { return /[/}]\\/{/.test(a) ? 1 : 2 }\nclass Z {}", ["t", "Z"]),
        ("const f = x => /}/g\nif (/{/.test(a)) {}\nclass Y {}", ["f", "Y"]),
        # templates in templates
        ("const s = `a ${`b ${c} {`} d`;\nclass C { x = 1 }", ["C"]),
        ("const s = `${ { a: `}` }.a }`; class C {}", ["C"]),
        ("const s = `\\`${'`'}\\${`; class C {}", ["C"]),
        # types and type parameters with braces
        ("export const f = async (a: (x) => void) => {}", ["f"]),
        ("class A<T extends {x: number}> { m(): void {} n<U>(u: U): {a: number} { return u } }", ["A", "A/m", "A/n"]),
        ("class Z extends mixin({a: 1})<{b: 2}> implements P<Q<R>> { q() {} }", ["Z", "Z/q"]),
        ("function f(): { a: number } | null { return null }\nconst g = (a): Promise<{ b: 1 }> => ({ b: 1 })", ["f", "g"]),
        ("function p(x: unknown): x is { a: 1 } { return true }", ["p"]),
        ("type A = { x: number }\ntype B<T> = T extends string\n  ? 'a'\n  : 'b'\nlet x = 1", ["A", "B"]),
        # members
        ("struct S {\n @State n: number = 0\n @Builder menu() {}\n on = () => { this.a() }\n private h = async (e: E): Promise<void> => {\n }\n o = { m() {} }\n}", ["S", "S/menu", "S/on", "S/h"]),
        ("class Q { abstract a(): void; b?(): void {} get z() { return 1 } static { foo() } static async *gen() {} ['k']() {} 'str'() {} #p() {} get() {} static = 1; async() {} }", ["Q", "Q/b", "Q/z", "Q/gen", "Q/anonymous@1", "Q/str", "Q/#p", "Q/get", "Q/async"]),
        ("class A { constructor(private x: number) { super() } f = function () {} ; g = class { m() {} } }", ["A", "A/constructor", "A/f", "A/g", "A/g/m"]),
        # declarations inside others
        ("namespace N { export function f() { function g() {} const h = () => 1 } export namespace M { class X {} } }", ["N", "N/f", "N/f/g", "N/M", "N/M/X"]),
        ("declare module 'm' { interface I { a: number } }\ndeclare global { interface J {} }", ["m", "m/I", "J"]),
        ("if (x) { class Y {} } else { function z() {} }\nclass W {}", ["Y", "z", "W"]),
        ("describe('a', () => { class In {} })", ["In"]),
        # names and none
        ("export default function () { return 1 }\nexport default class { m() {} }", ["anonymous@1", "anonymous@2", "anonymous@2/m"]),
        ("const g = function* named() {}\nconst K = class extends B { m() {} }\nvar h = x => x + 1;\nconst enum E { A, B }", ["g", "K", "K/m", "h", "E"]),
        ("function o(a: number): number;\nfunction o(a: any) { return a }", ["o"]),
        ("let type = 5; type = 6; module.exports = { a() {} }; namespace = 1\nclass R {}", ["R"]),
        ("// class No {}\n/* class No2 { */\nconst s = 'class No3 {'\nclass Yes { /* } */ a() { return '}' } }", ["Yes", "Yes/a"]),
        ("const a = 1\nfoo()\n", [""]),
        ("", []),
    ],
)
def test_declarations(text, want):
    assert paths(text) == want


def test_lines_and_parents():
    text = "import a from 'b'\n\n@Entry\n@Component\nstruct Page {\n  @State n: number = 0\n\n  build() {\n    Column() { Text(`${this.n}`) }\n      .width('1')\n  }\n}\nexport type T =\n  | 'a'\n  | 'b'\nconst x = 1\n"
    assert lines(text) == {"Page": (3, 12), "Page/build": (8, 11), "T": (13, 15)}
    rows = chunk_code("a.ets", text)
    assert rows[1]["parent_id"] == rows[0]["chunk_id"] == "a.ets#Page@3" and rows[1]["content"].startswith("build()") and rows[0]["content"].startswith("@Entry")


def test_broken_sources_end():
    for text in ("class A {", "class A { m( }", "`${`${", "((((", "}}}}", "@", "function", "class", "const x = (a", "/", "a = /[", "type T =", "class A<T", "'unclosed\nclass B {}", "/* open"):
        chunk_code("a.ts", text)
    assert paths("'unclosed\nclass B {}") == ["B"] and paths("class A { m( }\nclass B {}")[0] == "A"


@given(st.text("{}()[]<>`$/'\"=;,:.@ \nab", max_size=40))
def test_any_text(text):
    tokens = Tokens(text)
    assert all(i < c <= len(tokens.kind) for i, c in enumerate(tokens.close) if c)
    for start, end, _, _ in declarations(text):
        assert 0 <= start < end <= len(text)


def test_time_is_linear():
    took = []
    for n in (3000, 12000):
        text = "\n".join(f"class C{i}<T> {{ m(a: {{ x: T }}): void {{ return a / {i} }} f = () => `${{1}}` }}" for i in range(n))
        began = time.process_time()
        assert len(chunk_code("a.ts", text)) == 3 * n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]
    for text in ("`${" * 5000, "(" * 50_000, "class A { " * 2000, "a < " * 20_000, "@a(" * 5000):
        began = time.process_time()
        chunk_code("a.ts", text)
        assert time.process_time() - began < 5
