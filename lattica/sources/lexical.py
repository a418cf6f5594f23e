"""A lexical extractor for C and C++ trees without a compiler.

It reads tokens, follows namespaces, records and blocks, and tells declarations from their shape: functions and methods,
variables and fields, records with all their bases, enums, typedefs and aliases, macros, includes; and within bodies calls
and references. Names are resolved against what the file itself declares, from the innermost scope outwards; others stay as
they are spelt, for the project-wide resolution. Types are spelt as in the text. What needs a compiler (overloads, types of
expressions, templates, conditional compilation) isn't known here: a member call means the method of that name if the file
has one.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

_COMMENT_OR_STRING = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'""", re.S)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\n|[^\n])*", re.M)
_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*(?:"([^"\n]+)"|<([^>\n]+)>)', re.M)
_MACRO = re.compile(r"^[ \t]*#[ \t]*define[ \t]+(\w+)", re.M)
_TOKEN = re.compile(r"""[A-Za-z_]\w*|\d[\w.']*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'|::|->|\+\+|--|<<=|>>=|[-+*/%&|^]=|[=!<>]=|&&|\|\||\S""")
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
_ACCESS = {"public", "protected", "private"}
_RECORDS = {"class", "struct", "union"}
_SPECIFIERS = {"static", "inline", "virtual", "extern", "constexpr", "explicit", "friend", "mutable", "register", "thread_local", "volatile", "typename"}
_BUILTIN = {"void", "bool", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "auto", "const"}
_STATEMENTS = {
    "if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "return", "goto", "throw", "try", "catch", "new", "delete", "sizeof",
    "alignof", "decltype", "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast", "this", "nullptr", "true", "false", "operator", "using", "typedef", "and", "or", "not",
}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class _Body:
    """A function's body: its tokens, and what is known on entry."""

    name: str
    scope: tuple[str, ...]
    first: int
    end: int
    parameters: set[str]


@dataclass
class _Reader:
    path: str
    text: str
    tokens: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    symbols: list[dict] = field(default_factory=list)
    inherits: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    bodies: list[_Body] = field(default_factory=list)
    functions: dict[str, bool] = field(default_factory=dict)  # qualified name: virtual
    values: set[str] = field(default_factory=set)  # variables of files, namespaces and classes, enum constants
    methods: dict[str, str] = field(default_factory=dict)  # name: qualified name

    def __post_init__(self) -> None:
        for m in _TOKEN.finditer(self.text):
            self.tokens.append(m[0])
            self.places.append(m.start())
        self.newlines = [i for i, c in enumerate(self.text) if c == "\n"]

    def at(self, i: int) -> tuple[int, int]:
        """Line and column of a token, from 1."""
        from bisect import bisect_left

        place = self.places[i]
        line = bisect_left(self.newlines, place)
        return line + 1, place - (self.newlines[line - 1] if line else -1)

    def token(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ""

    def closing(self, i: int) -> int:
        """The token that closes the bracket at i (the last one of all, if none does)."""
        depth = 0
        for j in range(i, len(self.tokens)):
            if self.tokens[j] in _OPEN:
                depth += 1
            elif self.tokens[j] in _CLOSE:
                depth -= 1
                if not depth:
                    return j
        return len(self.tokens) - 1

    def angled(self, i: int) -> int:
        """The token behind the template brackets that open at i; i itself if they don't look like any."""
        depth = 0
        for j in range(i, min(len(self.tokens), i + 400)):
            t = self.tokens[j]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t in ";{}" or t in ("&&", "||"):
                return i
        return i

    def named(self, i: int) -> bool:
        t = self.token(i)
        return bool(t) and (t[0].isalpha() or t[0] == "_") and t not in _STATEMENTS

    def spelt(self, a: int, b: int) -> str:
        """Tokens as text: a space between words, and before * and & behind a word."""
        out = ""
        for i in range(a, b):
            t = self.tokens[i]
            if out and ((out[-1].isalnum() or out[-1] in "_>") and (t[0].isalnum() or t[0] in "_*&") or out[-1] == "," or t[0] in "*&" and out[-1] not in "*&(<: "):
                out += " "
            out += t
        return out

    def add(self, i: int, name: str, scope: tuple[str, ...], kind: str, definition: bool, **more) -> str:
        line, column = self.at(i)
        qualified = "::".join((*scope, name))
        self.symbols.append({"name": name.rpartition("::")[2], "qualified_name": qualified, "kind": kind, "file_path": self.path, "line": line, "column": column, "is_definition": definition, **more})
        return qualified

    # Declarations

    def declarations(self, i: int, end: int, scope: tuple[str, ...], record: bool = False, access: str | None = None) -> None:
        while i < end:
            t = self.tokens[i]
            if t in (";", "}", ")", "]"):
                i += 1
            elif t in _ACCESS and self.token(i + 1) == ":":
                access, i = t, i + 2
            elif t == "namespace" or t == "inline" and self.token(i + 1) == "namespace":
                i = self.namespace(i + (t == "inline"), end, scope)
            elif t == "extern" and self.token(i + 1)[:1] == '"' and self.token(i + 2) == "{":
                self.declarations(i + 3, self.closing(i + 2), scope)
                i = self.closing(i + 2) + 1
            elif t == "template" and self.token(i + 1) == "<":
                i = max(self.angled(i + 1), i + 2)
            elif t == "using" and self.token(i + 2) == "=":
                stop = self.until(i, end)
                self.add(i + 1, self.tokens[i + 1], scope, "type", True, sub_kind="typedef", return_type=self.spelt(i + 3, stop))
                i = stop + 1
            elif t in ("using", "friend", "static_assert"):
                i = self.until(i, end) + 1
            elif t == "typedef":
                i = self.typedef(i, end, scope)
            else:
                i = self.declaration(i, end, scope, record, access)

    def until(self, i: int, end: int, stops: str = ";") -> int:
        while i < end and self.tokens[i] not in stops:
            i = (self.closing(i) if self.tokens[i] in _OPEN else i) + 1
        return min(i, end)

    def namespace(self, i: int, end: int, scope: tuple[str, ...]) -> int:
        j, names = i + 1, []
        while j < end and self.tokens[j] not in "{;=":
            if self.named(j):
                names.append(self.tokens[j])
            j += 1
        if j >= end or self.tokens[j] != "{":
            return self.until(i, end) + 1
        close = self.closing(j)
        self.declarations(j + 1, close, (*scope, *(names or ["(anonymous namespace)"])))
        return close + 1

    def typedef(self, i: int, end: int, scope: tuple[str, ...]) -> int:
        first = i + 1
        if self.token(first) in _RECORDS or self.token(first) == "enum":
            brace = self.until(first, end, ";{")
            if brace < end and self.tokens[brace] == "{":
                self.record_or_enum(first, end, scope)
        stop = self.until(i, end)
        pointer = next((j for j in range(first, stop - 1) if self.tokens[j] == "(" and self.tokens[j + 1] == "*"), None)
        name = next((j for j in (range(pointer + 2, stop) if pointer else range(stop - 1, first, -1)) if self.named(j)), None)
        if name is not None:
            brace = next((j for j in range(first, name) if self.tokens[j] == "{"), None)
            own = self.spelt(first, brace if brace is not None else name)
            self.add(name, self.tokens[name], scope, "type", True, sub_kind="typedef", return_type=self.spelt(first, stop).replace(self.tokens[name], "", 1) if pointer else own.strip())
        return stop + 1

    def record_or_enum(self, i: int, end: int, scope: tuple[str, ...]) -> int:
        """Reads a record or enum with its body, or its declaration; returns what follows."""
        kind, j = self.tokens[i], i + 1
        scoped = kind == "enum" and self.token(j) in _RECORDS
        j += scoped
        while self.token(j) == "[" or self.named(j) and self.token(j + 1) == "(":  # attributes
            j = self.closing(j if self.tokens[j] == "[" else j + 1) + 1
        name, at = "", j
        while self.named(j) or self.token(j) == "::":
            if self.tokens[j] != "final":
                name, at = name + self.tokens[j], j
            j += 1
        if self.token(j) == "<":
            j = self.angled(j)
        if self.token(j) not in ("{", ":", ";"):
            return i
        brace = self.until(j, end, ";{")
        body = brace < end and self.tokens[brace] == "{"
        qualified = self.add(at if name else i, name, scope, "type", body, sub_kind=kind)
        if not body:
            return brace
        close = self.closing(brace)
        inner = (*scope, *name.split("::")) if name else scope
        if kind == "enum":
            k = brace + 1
            while k < close:
                if self.named(k):
                    self.values.add("::".join((*(inner if scoped else scope), self.tokens[k])))
                k = self.until(k, close, ",") + 1
        else:
            if self.token(j) == ":":
                self.bases(j + 1, brace, qualified, "private" if kind == "class" else "public")
            self.declarations(brace + 1, close, inner, True, "private" if kind == "class" else "public")
        return close + 1

    def bases(self, i: int, end: int, derived: str, default: str) -> None:
        while i < end:
            access, virtual, first = default, False, i
            while self.tokens[first] in _ACCESS or self.tokens[first] == "virtual":
                virtual, access = virtual or self.tokens[first] == "virtual", self.tokens[first] if self.tokens[first] in _ACCESS else access
                first += 1
            j = first
            while j < end and self.tokens[j] != ",":
                j = max(self.angled(j), j + 1) if self.tokens[j] == "<" else j + 1
            self.inherits.append({"derived": derived, "base": self.spelt(first, j), "access": access, "is_virtual": virtual})
            i = j + 1

    def declaration(self, i: int, end: int, scope: tuple[str, ...], record: bool, access: str | None) -> int:
        first = i
        words: set[str] = set()
        while self.token(i) in _SPECIFIERS:
            words.add(self.tokens[i])
            i += 1
        if self.token(i) in (*_RECORDS, "enum"):
            behind = self.record_or_enum(i, end, scope)
            if behind != i:
                stop = self.until(behind, end)
                self.variables(i, behind, stop, scope, record, access, words)
                return stop + 1
        j, name = i, None
        while j < end and self.tokens[j] not in ";={":
            t = self.tokens[j]
            if t == "operator":
                k = next((k for k in range(j + 1, min(end, j + 6)) if self.tokens[k] == "(" and not (self.tokens[k + 1 : k + 2] == [")"] and self.token(k + 2) == "(")), j + 2)
                return self.function(first, i, j, k, "operator" + "".join(self.tokens[j + 1 : k]), end, scope, record, access, words)
            if t == "(":
                if name is not None and not self.token(j + 1)[:1].isdigit() and self.token(j + 1)[:1] not in ("\"", "'") and self.token(j + 1) != "*":
                    a = name
                    while self.token(a - 1) == "::" and self.named(a - 2) and a - 2 >= i:
                        a -= 2
                    if self.token(name - 1) == "~":
                        a = name - 1
                        while self.token(a - 1) == "::" and a - 2 >= i:
                            a -= 2
                    return self.function(first, i, a, j, "".join(self.tokens[a:j]), end, scope, record, access, words)
                j = self.closing(j) + 1
                continue
            if t == "<" and name is not None:
                j = max(self.angled(j), j + 1)
                continue
            name = j if self.named(j) else name
            j = (self.closing(j) if t == "[" else j) + 1
        stop = self.until(j, end)
        self.variables(i, i, stop, scope, record, access, words)
        return stop + 1

    def function(self, first: int, type_at: int, at: int, paren: int, name: str, end: int, scope: tuple[str, ...], record: bool, access: str | None, words: set[str]) -> int:
        close = self.closing(paren)
        j, pure = close + 1, False
        while j < end and self.tokens[j] not in ";{":
            if self.tokens[j] == ":":  # initialisers of a constructor
                j += 1
                while j < end and self.tokens[j] != "{" or self.named(j - 1) and self.token(j) == "{" and self.token(self.closing(j) + 1) in (",", "{"):
                    j = (self.closing(j) if self.tokens[j] in _OPEN else j) + 1
                break
            words.update({"virtual"} if self.tokens[j] == "override" else ())
            pure = pure or self.tokens[j] == "="
            j = (self.closing(j) if self.tokens[j] in "([" else j) + 1
        body = j < end and self.tokens[j] == "{"
        opening = j
        parameters = self.parameters(paren + 1, close)
        method = record or "::" in name
        more: dict = {"return_type": self.spelt(type_at, at), "parameters": json.dumps(parameters)}
        if method:
            more["attributes"] = json.dumps({"is_virtual": "virtual" in words, "is_static": "static" in words, "is_inline": "inline" in words or record and body})
        if record:
            more["access"] = access
        defaulted = pure and self.token(j - 1) == "default"
        if body:
            more["end_line"] = self.at(self.closing(j))[0]
        qualified = self.add(at + name.count("::") * 2, name, scope, "function", body or defaulted, **more)
        self.functions[qualified] = "virtual" in words or self.functions.get(qualified, False)
        if method:
            self.methods[name.rpartition("::")[2]] = qualified
        if not body:
            return self.until(j, end) + 1
        self.bodies.append(_Body(qualified, tuple(qualified.split("::")[:-1]), opening, self.closing(j), {n for _, n in parameters if n}))
        return self.closing(j) + 1

    def parameters(self, i: int, end: int) -> list[list[str]]:
        """[type, name] of each parameter, the name empty where there is none."""
        out = []
        while i < end:
            stop = i
            while stop < end and self.tokens[stop] != ",":
                t = self.tokens[stop]
                stop = max(self.angled(stop), stop + 1) if t == "<" else (self.closing(stop) if t in _OPEN else stop) + 1
            equals = next((k for k in range(i, stop) if self.tokens[k] == "="), stop)
            last = equals - 1
            while last > i and self.tokens[last] == "]":
                last = next(k for k in range(last, -1, -1) if self.tokens[k] == "[") - 1
            has = last > i and self.named(last) and self.tokens[last] not in _BUILTIN and self.tokens[last - 1] not in ("::", *_RECORDS, "enum")
            if self.spelt(i, equals) != "void":
                out.append([self.spelt(i, last if has else equals), self.tokens[last] if has else ""])
            i = stop + 1
        return out

    def variables(self, i: int, declarators: int, stop: int, scope: tuple[str, ...], record: bool, access: str | None, words: set[str]) -> None:
        """The variables of a declaration up to stop: a type, and names with initialisers. declarators: where names begin, if
        a record's body came before."""
        kind = i
        j = max(i, declarators)
        base_end = None
        while j < stop:
            part = j
            name = None
            while part < stop and self.tokens[part] not in ",=:{":
                t = self.tokens[part]
                if t == "<":
                    part = max(self.angled(part), part + 1)
                    continue
                if t in _OPEN:
                    inner = next((k for k in range(part + 1, self.closing(part)) if self.named(k)), None) if t == "(" and self.token(part + 1) == "*" else None
                    name = inner if inner is not None else name
                    part = self.closing(part) + 1
                    continue
                name = part if self.named(part) and t not in _BUILTIN else name
                part += 1
            typed = declarators > i or name is not None and name > kind or base_end is not None
            if name is not None and typed:
                first = name
                while self.token(first - 1) == "::" and first - 2 >= i:
                    first -= 2
                if first > i or declarators > i or base_end is not None:
                    base_end = first if base_end is None else base_end
                    self.variable(name, first, self.spelt(i, min(base_end, declarators if declarators > i else base_end)), scope, record, access, words)
            j = self.until(part, stop, ",") + 1

    def variable(self, at: int, first: int, type_: str, scope: tuple[str, ...], record: bool, access: str | None, words: set[str]) -> None:
        name = "".join(self.tokens[first : at + 1])
        if record and "static" not in words:
            self.add(at, name, scope, "variable", True, sub_kind="member", return_type=type_, access=access)
            return
        attributes = json.dumps({"type_name": type_, "scope": "member" if record or "::" in name else "global", "is_const": bool(re.match(r"const\b", type_)) or "constexpr" in words})
        definition = "extern" not in words or self.token(at + 1) == "="
        qualified = self.add(at, name, scope, "variable", definition and not (record and "inline" not in words and self.token(at + 1) != "="), return_type=type_, attributes=attributes)
        self.values.add(qualified)

    # Bodies

    def resolved(self, name: str, scope: tuple[str, ...], among) -> str | None:
        for k in range(len(scope), -1, -1):
            if (full := "::".join((*scope[:k], name))) in among:
                return full
        return None

    def body(self, b: _Body) -> None:
        locals_: set[str] = set()
        i = b.first
        statement = False
        while i < b.end:
            t = self.tokens[i]
            if t in ";{}" or t == "(" and self.token(i - 1) in ("for", "if", "while", "switch"):
                statement, i = True, i + 1
                continue
            if not self.named(i):
                statement, i = False if t != ":" else statement, i + 1
                continue
            if statement and (names := self.local(i, b.end)):
                type_end = names[0]
                for n in names:
                    line, column = self.at(n)
                    type_ = self.spelt(i, type_end)
                    self.symbols.append({
                        "name": self.tokens[n], "qualified_name": self.tokens[n], "kind": "variable", "file_path": self.path, "line": line, "column": column, "is_definition": True,
                        "return_type": type_, "attributes": json.dumps({"type_name": type_, "scope": "local", "is_const": type_.startswith("const")}),
                    })
                    locals_.add(self.tokens[n])
                self.declared = {*names}
                i, statement = names[0] + 1, False
                continue
            i = self.use(i, b, locals_)
            statement = False

    declared: set[int] = frozenset()  # type: ignore[assignment]

    def local(self, i: int, end: int) -> list[int]:
        """The names that a statement at i declares, if it looks like a declaration."""
        j = i
        while self.token(j) in _SPECIFIERS or self.token(j) in ("const", *_RECORDS, "enum"):
            j += 1
        builtin = False
        while self.token(j) in _BUILTIN:
            builtin, j = True, j + 1
        if not builtin:
            if not self.named(j):
                return []
            j += 1
            while self.token(j) == "::" and self.named(j + 1):
                j += 2
            if self.token(j) == "<":
                j = self.angled(j)
        while self.token(j) in ("*", "&", "&&", "const"):
            j += 1
        if not self.named(j) or self.token(j + 1) not in ("=", ";", ",", "[", "{", ":", "(") or self.token(j) in _BUILTIN:
            return []
        if self.token(j + 1) == "(" and (self.token(j + 2) in (")", "*") or not builtin and self.token(j - 1) in ("*", "&")):
            return []
        names, stop = [j], self.until(j, end)
        if self.token(j + 1) != ":":
            k = self.until(j + 1, stop, ",")
            while k < stop:
                k += 1
                while self.token(k) in ("*", "&"):
                    k += 1
                if not self.named(k):
                    break
                names.append(k)
                k = self.until(k, stop, ",")
        return names

    def use(self, i: int, b: _Body, locals_: set[str]) -> int:
        """One name in an expression: a call or a reference; returns what follows its last part."""
        j = i
        while self.token(j + 1) == "::" and self.named(j + 2):
            j += 2
        name = "".join(self.tokens[i : j + 1])
        before, behind = self.token(i - 1), self.token(j + 1)
        if i in self.declared:
            return j + 1
        member = before in (".", "->")
        after = self.angled(j + 1) if behind == "<" else j + 1
        line, column = self.at(i)
        if self.token(after) == "(" and (after == j + 1 or after > j + 1):
            if name in b.parameters or name in locals_ or name in _BUILTIN:
                return j + 1
            full = self.methods.get(name) if member else self.resolved(name, b.scope, self.functions)
            if full is None and b.scope and b.name in self.methods.values():  # of a base
                full = self.methods.get(name)
            virtual = bool(full and (member or full == self.methods.get(name)) and self.functions.get(full))
            start = i
            while self.token(start - 1) in (".", "->") and self.named(start - 2):
                start -= 2
            line, column = self.at(start)
            self.calls.append({"caller": b.name, "callee": full or name, "file": self.path, "line": line, "column": column, "is_virtual": virtual, "is_indirect": False})
            return j + 1
        if member or name in b.parameters:
            return j + 1
        full = name if name in locals_ else self.resolved(name, b.scope, self.values) or self.resolved(name, b.scope, self.functions)
        if full is None:
            return j + 1
        if behind in _ASSIGN and before not in ("*", ".", "->", "&") or "++" in (before, behind) or "--" in (before, behind):
            kind = "write"
        elif before == "&" and not (self.named(i - 2) or self.token(i - 2) in (")", "]") or self.token(i - 2)[:1].isdigit()):
            kind = "address"
        else:
            kind = "read"
        self.references.append({"symbol_name": full, "file": self.path, "line": line, "column": column, "ref_kind": kind})
        return j + 1


def lexical(path: str, text: str) -> dict:
    """The extraction document (schema.EXTRACTION) of one file."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    clean = _COMMENT_OR_STRING.sub(lambda m: blank(m[0]) if m[0][0] == "/" else m[0], text)
    bare = _DIRECTIVE.sub(lambda m: blank(m[0]), clean)
    line_of = lambda at: clean.count("\n", 0, at) + 1
    r = _Reader(path, bare)
    includes = [{"source_file": path, "target_file": m[1] or m[2], "line": line_of(m.start()), "is_system": m[2] is not None} for m in _INCLUDE.finditer(clean)]
    for m in _MACRO.finditer(clean):
        column = m.start(1) - clean.rfind("\n", 0, m.start(1))
        r.symbols.append({"name": m[1], "qualified_name": m[1], "kind": "macro", "file_path": path, "line": line_of(m.start()), "column": column, "is_definition": True})
    r.declarations(0, len(r.tokens), ())
    for b in r.bodies:
        r.body(b)
    return {"symbols": r.symbols, "calls": r.calls, "includes": includes, "inherits": r.inherits, "references": r.references}
