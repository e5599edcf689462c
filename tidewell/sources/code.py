"""TypeScript and ArkTS files to chunks by declaration.

One pass cuts a file into tokens: a pushdown lexer that knows nested templates, regular expressions (by what stands before the slash), strings and comments. Brackets are matched once. A walk over the tokens
then finds declarations: classes, structs, interfaces, enums, namespaces, type aliases, functions, methods, fields and constants that hold functions or classes. It steps over brackets by their match,
reads decorators as the beginning of what follows, and types and type parameters as such, so their braces are no bodies. The time is linear in the file.

Names of classes, structs, interfaces, enums, namespaces, functions and methods lead the heading path of what they hold, and they are its parents. Inside functions only named declarations count, not
constants. A file of statements only is one chunk; a blank file none. Kotlin and Swift are recognised and skipped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotImplementedYet, UnsupportedLanguageError
from ..schema import CHUNK

_SCOPES = frozenset("class struct interface namespace module enum function method".split())
_MEMBERS = frozenset("class struct".split())

# ---- tokens ----------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f\v\u00a0\ufeff]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|$))
    |(?P<word>\#?[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)
    |(?P<tick>`)|(?P<arrow>=>)|(?P<slash>/)|(?P<sign>.)""",
    re.VERBOSE | re.DOTALL,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{|$)", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await instanceof".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """kind, text, begin and end of each token, whether a line break stands before it, and the token that closes each bracket."""

    def __init__(self, text: str):
        self.kind: list[str] = []
        self.text: list[str] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.fresh: list[bool] = []
        self._cut(text)
        self._match()

    def _cut(self, text: str) -> None:
        at, n, fresh = 0, len(text), True
        open_: list[str] = []  # "{" for a brace, "`" for an expression in a template
        began: list[int] = []  # of templates
        before = ""  # the last token's text, also inside templates

        def put(kind: str, begin: int, end: int) -> None:
            nonlocal fresh
            if not began:
                for column, x in ((self.kind, kind), (self.text, text[begin:end]), (self.begin, begin), (self.end, end), (self.fresh, fresh)):
                    column.append(x)
                fresh = False

        def template(begin: int) -> int:
            """Reads on in a template; at an expression it stays open."""
            nonlocal before
            end = _TEMPLATE.match(text, begin).end()
            if text[end - 2 : end] == "${" and text[end - 1] == "{":
                open_.append("`")
                before = "{"
            else:
                first = began.pop()
                before = "`"
                put("string", first, end)
            return end

        while at < n:
            m = _TOKEN.match(text, at)
            kind, end = m.lastgroup, m.end()
            if kind == "line":
                fresh = True
            elif kind == "comment":
                fresh = fresh or "\n" in m[0]
            elif kind == "tick":
                began.append(at)
                end = template(end)
            elif kind == "sign" and m[0] == "}" and open_ and open_[-1] == "`":
                open_.pop()
                end = template(end)
            elif kind != "space":
                if kind == "slash":
                    value = before[-1:].isalnum() and before not in _BEFORE_REGEX or before in (")", "]", "<") or before[-1:] in "_$`\"'" and before != ""
                    found = None if value else _REGEX.match(text, at)
                    kind, end = ("string", found.end()) if found else ("sign", end)
                elif kind == "sign" and m[0] == "{":
                    open_.append("{")
                elif kind == "sign" and m[0] == "}" and open_:
                    open_.pop()
                before = text[at:end]
                put("sign" if kind == "arrow" else kind, at, end)
            at = end
        if began:
            first = began[0]
            began.clear()
            put("string", first, n)

    def _match(self) -> None:
        """A bracket that nothing closes ends with the one around it."""
        self.close = [0] * len(self.kind)
        waiting: list[int] = []
        for i, (kind, t) in enumerate(zip(self.kind, self.text, strict=True)):
            if kind != "sign":
                continue
            if t in "([{":
                waiting.append(i)
            elif t in _CLOSES and any(self.text[w] == _CLOSES[t] for w in waiting[-8:]):
                while waiting:
                    w = waiting.pop()
                    self.close[w] = i
                    if self.text[w] == _CLOSES[t]:
                        break
        for w in waiting:
            self.close[w] = len(self.kind)


# ---- declarations ----------------------------------------------------------------------------------------------------

_MODIFIERS = frozenset("export default declare abstract public private protected static async readonly override accessor get set".split())
_NAMED = frozenset("class struct interface enum namespace module function type".split())
#: After these an expression or a type goes on.
_OPEN_SIGNS = frozenset("= + - * / % & | ^ ! ~ ? : , . < => ( [ {".split())
_OPEN_WORDS = frozenset("extends implements typeof in of instanceof as satisfies new return await yield void delete".split())
#: After these a type goes on.
_TYPE_SIGNS = frozenset("| & ? : .".split())
_TYPE_WORDS = frozenset("extends keyof typeof infer is unique readonly asserts new".split())
#: Before these it goes on over a line break.
_GOES_ON = frozenset("= + - * / % & | ^ ? : , . < > => ( [ ) ] }".split())
_GOES_ON_WORDS = frozenset("extends implements in of instanceof as satisfies is".split())
_BLOCK_WORDS = frozenset("if else for while do switch try catch finally with".split())


class _Walk:
    def __init__(self, text: str):
        self.t = Tokens(text)
        self.n = len(self.t.kind)
        self.found: list[tuple[int, int, str, str | None]] = []

    def at(self, i: int) -> str:
        return self.t.text[i] if i < self.n and self.t.kind[i] != "string" else ""

    def is_word(self, i: int) -> bool:
        return i < self.n and self.t.kind[i] == "word"

    def angles(self, i: int) -> int:
        """After the type parameters or arguments that begin at i."""
        depth = 0
        while i < self.n:
            t = self.at(i)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif t and t in "([{":
                i = self.t.close[i]
            elif t and t in ")]};":
                return i
            i += 1
        return i

    def decorators(self, i: int) -> int:
        while self.at(i) == "@":
            i += 1
            while self.is_word(i) and self.at(i + 1) == ".":
                i += 2
            if self.is_word(i):
                i += 1
            if self.at(i) == "(":
                i = self.t.close[i] + 1
        return i

    def type_end(self, i: int, hi: int) -> int:
        """After the type that begins at i."""
        wants = True
        while i < hi:
            t = self.at(i)
            if t == "<":
                i = self.angles(i)
                wants = False
                continue
            if wants and t and t in "([{" or t in ("[", "("):
                if not wants and self.t.fresh[i]:
                    return i
                i, wants = self.t.close[i] + 1, False
                continue
            of_function = t == "=>" and self.at(i - 1) == ")"  # else the arrow of a function whose result this type is
            if t == "{" or t and t in ")]};,=" or t == "=>" and not of_function or not wants and self.t.fresh[i] and not of_function and t not in _TYPE_SIGNS and t not in _TYPE_WORDS:
                return i
            wants = of_function or t in _TYPE_SIGNS or t in _TYPE_WORDS
            i += 1
        return i

    def statement_end(self, i: int, hi: int, first: int | None = None) -> int:
        """After the statement (or field) that goes on at i: at a semicolon, or at a line break where nothing asks for more."""
        word = self.at(first if first is not None else i)
        block = word in _BLOCK_WORDS
        start = i
        while i < hi:
            t = self.at(i)
            if i > start and self.t.fresh[i]:
                last = self.at(i - 1)
                if last not in _OPEN_SIGNS and last not in _OPEN_WORDS and t not in _GOES_ON and t not in _GOES_ON_WORDS and not (block and t == "{"):
                    return i
                if t in ("[", "(", "<") and last in (")", "]", "}") or t == "}" or t == "*" and last not in _OPEN_SIGNS:
                    return i
            if t == ";":
                return i + 1
            if t and t in "([{":
                end = self.t.close[i] + 1
                if t == "{" and block:
                    return end
                i = end
                continue
            if t and t in ")]}":
                return i + 1 if i == start else i
            i += 1
        return hi

    def put(self, first: int, after: int, kind: str, name: str | None) -> None:
        self.found.append((self.t.begin[first], self.t.end[min(after, self.n) - 1], kind, name))

    def body(self, i: int, hi: int) -> int | None:
        """The brace of the body of what has its head at i: type parameters, heritage."""
        while i < hi:
            t = self.at(i)
            if t == "{":
                return i
            if t == "<":
                i = self.angles(i)
            elif t and t in "([":
                i = self.t.close[i] + 1
            elif t == ";":
                return None
            else:
                i += 1
        return None

    def signature(self, i: int, hi: int) -> int | None:
        """After the parameters and the return type of a function whose name ends before i; None if there are none."""
        if self.at(i) == "<":
            i = self.angles(i)
        if self.at(i) != "(":
            return None
        i = self.t.close[i] + 1
        return self.type_end(i + 1, hi) if self.at(i) == ":" else i

    def function(self, first: int, i: int, hi: int, kind: str, name: str | None) -> int | None:
        """A function or method with parameters at i; those without a body are no declarations of their own."""
        after = self.signature(i, hi)
        if after is None:
            return None
        if self.at(after) != "{" or after >= hi:
            return self.statement_end(after, hi) if after < hi else hi
        end = min(self.t.close[after] + 1, hi)
        self.put(first, end, kind, name)
        self.statements(after + 1, end - 1, False)
        return end

    def value(self, first: int, i: int, hi: int, kind: str, name: str | None, inside: bool) -> int | None:
        """What a constant or field holds, from after its equals sign: a function or a class. None for other values."""
        at = i + 1 if self.at(i) == "async" and self.at(i + 1) in ("function", "(", "<") or self.at(i) == "async" and self.at(i + 2) == "=>" else i
        brace = None
        if self.at(at) == "class":
            brace, kind = self.body(at + 1, hi), "class"
            if brace is None:
                return None
        elif self.at(at) == "function":
            at += 1 + (self.at(at + 1) == "*")
            after = self.signature(at + (self.is_word(at)), hi)
            brace = after if after is not None and self.at(after) == "{" else None
            if brace is None:
                return None
        else:
            after = at + 1 if self.is_word(at) else self.signature(at, hi)
            if after is None or self.at(after) != "=>":
                return None
            brace = after + 1 if self.at(after + 1) == "{" else None
        end = self.statement_end(i, hi)
        self.put(first, end, kind, name)
        if brace is not None and brace < hi:
            if kind == "class":
                self.members(brace + 1, min(self.t.close[brace], hi))
            else:
                self.statements(brace + 1, min(self.t.close[brace], hi), False)
        return end

    def statements(self, i: int, hi: int, constants: bool) -> None:
        """Declarations among the statements from i on."""
        while i < hi:
            t = self.at(i)
            if t and t in ";,)]}":
                i += 1
                continue
            if t == "{":
                self.statements(i + 1, min(self.t.close[i], hi), False)
                i = self.t.close[i] + 1
                continue
            i = max(i + 1, self.declaration(i, hi, constants))

    def declaration(self, first: int, hi: int, constants: bool) -> int:
        i = self.decorators(first)
        while self.at(i) in _MODIFIERS and i < hi and self.at(i + 1) not in ("=", "(", ".", ":", ";"):
            i = self.decorators(i + 1)
        word, name = self.at(i), i + 1
        if word == "const" and self.at(i + 1) == "enum":
            word, i, name = "enum", i + 1, i + 2
        if word == "function":
            name += self.at(name) == "*"
            named = self.is_word(name)
            end = self.function(first, name + named, hi, "function", self.at(name) if named else None)
            if end is not None:
                return end
        elif word in _NAMED and (self.is_word(name) and not self.t.fresh[name] or word == "class" or word == "module" and self.t.kind[name : name + 1] == ["string"]):
            named = self.is_word(name) and self.at(name) not in ("extends", "implements") or word == "module"
            label = self.t.text[name].strip("'\"`") if named and name < self.n else None
            if word == "type":
                if self.at(name + 1) in ("=", "<"):
                    end = self.statement_end(name + 1, hi)
                    self.put(first, end, word, label)
                    return end
            else:
                brace = self.body(name + named, hi)
                if brace is not None:
                    end = min(self.t.close[brace] + 1, hi)
                    self.put(first, end, word, label)
                    if word in _MEMBERS:
                        self.members(brace + 1, end - 1)
                    elif word in ("namespace", "module"):
                        self.statements(brace + 1, end - 1, True)
                    return end
        elif word in ("const", "let", "var") and constants and self.is_word(name):
            at = self.type_end(name + 2, hi) if self.at(name + 1) == ":" else name + 1
            end = self.value(first, at + 1, hi, "function", self.at(name), False) if self.at(at) == "=" else None
            if end is not None:
                return end
        end = self.statement_end(max(i, first), hi, i)
        for k in self.blocks(i, end):  # declarations inside other statements
            self.statements(k + 1, min(self.t.close[k], end), False)
        return end

    def blocks(self, i: int, hi: int) -> Iterator[int]:
        """The outermost braces from i on, also those in parentheses."""
        while i < hi:
            t = self.at(i)
            if t == "{":
                yield i
                i = self.t.close[i]
            i += 1

    def members(self, i: int, hi: int) -> None:
        while i < hi:
            t = self.at(i)
            if t and t in ";,)]}":
                i += 1
                continue
            first, i = i, self.decorators(i)
            while self.at(i) in _MODIFIERS and i + 1 < hi and self.at(i + 1) not in ("=", "(", ":", ";", "?", "!", "<", ",", "}") and not (self.t.fresh[i + 1] and self.at(i) in ("get", "set", "static", "accessor")):
                i += 1
            if self.at(i - 1) == "static" and self.at(i) == "{":
                self.statements(i + 1, self.t.close[i], False)
                i = self.t.close[i] + 1
                continue
            i += self.at(i) == "*"
            if i >= hi:
                return
            if self.at(i) == "[":
                after, name = self.t.close[i] + 1, None
            else:
                after, name = i + 1, self.t.text[i].strip("'\"`") if self.t.kind[i] in ("word", "string", "number") else None
            after += self.at(after) in ("?", "!")
            end = self.function(first, after, hi, "method", name) if self.at(after) in ("(", "<") and (name or self.at(i) == "[") else None
            if end is None:
                at = self.type_end(after + 1, hi) if self.at(after) == ":" else after
                if self.at(at) == "=" and name:
                    end = self.value(first, at + 1, hi, "method", name, True)
                if end is None:
                    end = self.statement_end(max(at, i), hi)
            i = max(end, i + 1)


def declarations(text: str) -> list[tuple[int, int, str, str | None]]:
    """(start, end, kind, name) of each declaration, outer before inner. Decorators belong to what they decorate."""
    walk = _Walk(text)
    walk.statements(0, walk.n, True)
    return sorted(walk.found, key=lambda d: (d[0], -d[1]))


def chunk_code(source: str, text: str) -> list[dict]:
    """CHUNK fields of one file."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at - 1) + 1

    def row(ident: str, content: str, path: list[str], first: int, last: int, parent: str | None) -> dict:
        return {"chunk_id": ident, "source": source, "lang": "arkts", "content": content, "heading_path": path, "line_range": {"start": first, "end": last}, "platforms": [], "api_version": None, "deprecated": False, "type": "code_example", "source_framework": None, "complexity": None, "tags": [], "parent_id": parent, "extra": {}}

    out: list[dict] = []
    open_: list[tuple[int, str, str]] = []  # end, name, id of the scopes around
    for start, end, kind, name in declarations(text):
        while open_ and start >= open_[-1][0]:
            open_.pop()
        first = line(start)
        name = name or f"anonymous@{first}"
        path = [n for _, n, _ in open_] + [name]
        ident = f"{source}#{'/'.join(path)}@{first}"
        out.append(row(ident, text[start:end], path, first, line(max(start, end - 1)), open_[-1][2] if open_ else None))
        if kind in _SCOPES:
            open_.append((end, name, ident))
    if not out and text.strip():
        out.append(row(f"{source}#@1", text, [], 1, max(1, len(text.splitlines())), None))
    return out


def _chunk_batches(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in stream:
        rows = [r for s, t in zip(pdf["source"], pdf["text"], strict=True) for r in chunk_code(s, t or "")]
        yield pd.DataFrame(rows, columns=CHUNK.names)


def chunk_typescript(files: DataFrame) -> DataFrame:
    """CHUNK rows of TypeScript and ArkTS files (source, lang, text). Any other language is an error."""
    checked = files.select("source", F.when(F.col("lang") == "arkts", F.col("text")).otherwise(F.raise_error(F.concat(F.lit(f"{UnsupportedLanguageError.__name__}: not arkts: "), F.col("source")))).alias("text"))
    return checked.mapInPandas(_chunk_batches, CHUNK)


def chunk_planned(files: DataFrame) -> DataFrame:
    """Kotlin and Swift have no chunker yet."""
    raise NotImplementedYet("kotlin and swift files are recognised and not chunked")
