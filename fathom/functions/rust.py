"""A reader of Rust source for its items: no types or expressions, but all that says which items there are.

`parse` gives the named items with kind, line, visibility and parent, whether the
file has tests of its own, and which of the crate's modules it uses. Files that
are no sequence of items, or whose literals, comments or brackets do not close,
raise ParseError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LEX = re.compile(
    r"""(?P<space>\s+|//[^\n]*)
    |(?P<comment>/\*)
    |(?P<raw>(?:b|c)?r(?P<marks>\#*)")
    |(?P<string>(?:b|c)?"(?:[^"\\]|\\.)*")
    |(?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')
    |(?P<life>'[^\W\d]\w*)
    |(?P<name>(?:r\#)?[^\W\d]\w*)
    |(?P<number>\d[\w]*(?:\.\d[\w]*)?)
    |(?P<mark>[{}()\[\]]|::|->|=>|[^\w\s])""",
    re.X | re.S,
)
COMMENT_EDGE = re.compile(r"/\*|\*/")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
STARTS = {"pub", "fn", "struct", "enum", "trait", "mod", "const", "static", "type", "impl", "use", "extern", "unsafe", "async", "union", "auto", "default", "macro_rules"}


#: A text that begins with a word which begins no item, path or macro call.
PROSE = re.compile(r"\s*([^\W\d]\w*)(?=[\s,.;)])\s*(?![\s!:/])")


class ParseError(ValueError):
    pass


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Parsed:
    symbols: list[tuple[int, str, str, str, str | None]] = field(default_factory=list)  # line, kind, name, visibility, parent
    has_tests: bool = False
    uses: list[str] = field(default_factory=list)


def lex(source: str) -> list[Token]:
    out, at, line = [], 1 if source.startswith("\ufeff") else 0, 1
    if source.startswith("#!") and not re.match(r"#!\s*\[", source):
        at = source.find("\n") if "\n" in source else len(source)
    while at < len(source):
        m = LEX.match(source, at)
        if not m:
            raise ParseError(f"line {line}: unexpected character")
        kind, end, word = m.lastgroup, m.end(), m.group()
        if kind == "space":
            line += word.count("\n")
        elif kind == "comment":
            depth = 1
            while depth:
                m2 = COMMENT_EDGE.search(source, end)
                if not m2:
                    raise ParseError(f"line {line}: unterminated comment")
                depth += 1 if m2.group() == "/*" else -1
                end = m2.end()
            line += source.count("\n", at, end)
        elif kind in ("raw", "marks"):
            end = source.find('"' + m["marks"], end)
            if end < 0:
                raise ParseError(f"line {line}: unterminated string")
            end += 1 + len(m["marks"])
            out.append(Token("literal", '"', line))
            line += source.count("\n", at, end)
        elif word in ('"', "'"):
            raise ParseError(f"line {line}: unterminated literal")
        elif kind in ("string", "char", "number"):
            out.append(Token("literal", word, line))
            line += word.count("\n")
        else:
            out.append(Token(kind, word, line))
        at = end
    return out


class _Reader:
    def __init__(self, tokens: list[Token]):
        self.t, self.out, self.match = tokens, Parsed(), {}
        stack = []
        for i, x in enumerate(tokens):
            if x.kind == "mark" and x.text in OPEN:
                stack.append(i)
            elif x.kind == "mark" and x.text in CLOSE:
                if not stack or OPEN[tokens[stack[-1]].text] != x.text:
                    raise ParseError(f"line {x.line}: unbalanced delimiter")
                self.match[stack.pop()] = i
        if stack:
            raise ParseError(f"line {tokens[stack[-1]].line}: unclosed delimiter")

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].kind in ("mark", "name") and self.t[i].text in texts

    def name(self, i: int) -> bool:
        return i < len(self.t) and self.t[i].kind == "name"

    def seek(self, i: int, hi: int, *ends: str) -> int:
        """The first of the marks from i on, outside all brackets."""
        while i < hi:
            if self.is_(i, *ends):
                return i
            i = self.match[i] + 1 if i in self.match else i + 1
        raise ParseError(f"line {self.t[min(i, len(self.t)) - 1].line}: expected {' or '.join(ends)}")

    def add(self, line: int, kind: str, name: str, visibility: str, parent: str | None) -> None:
        self.out.symbols.append((line, kind, name, visibility, parent))

    def attributes(self, i: int) -> tuple[int, list[list[str]]]:
        found = []
        while self.is_(i, "#"):
            j = i + 1 + self.is_(i + 1, "!")
            if not self.is_(j, "["):
                raise ParseError(f"line {self.t[i].line}: expected an attribute")
            found.append([x.text for x in self.t[j + 1 : self.match[j]]])
            i = self.match[j] + 1
        return i, found

    def visibility(self, i: int) -> tuple[int, str]:
        if not self.is_(i, "pub"):
            return i, "Private"
        if self.is_(i + 1, "(") and self.is_(i + 2, "crate", "super", "self", "in"):
            inner = [x.text for x in self.t[i + 2 : self.match[i + 1]]]
            return self.match[i + 1] + 1, "Crate" if inner == ["crate"] else "Restricted"
        return i + 1, "Public"

    def items(self, i: int, hi: int, parent: str | None, top: bool = False) -> None:
        while i < hi:
            while i < hi and self.is_(i, ";"):
                i += 1
            if i < hi:
                i = self.item(i, hi, parent, top=top)

    def members(self, i: int, hi: int, parent: str | None) -> None:
        while i < hi:
            i = self.item(i, hi, parent, member=True)

    def item(self, i: int, hi: int, parent: str | None, top: bool = False, member: bool = False) -> int:
        i, attributes = self.attributes(i)
        if i >= hi:
            return hi
        i, seen = self.visibility(i)
        while self.is_(i, "unsafe", "async", "default", "auto", "safe") and self.name(i + 1) or self.is_(i, "const") and self.is_(i + 1, "fn", "unsafe", "async", "extern"):
            i += 1
        if self.is_(i, "extern") and not self.is_(i + 1, "crate"):
            i += 1
            i += i < len(self.t) and self.t[i].kind == "literal"
            if self.is_(i, "{"):
                return self.match[i] + 1
        while self.is_(i, "unsafe", "async") and self.name(i + 1):
            i += 1
        if i >= hi:
            raise ParseError("unexpected end of file")
        word, line = self.t[i].text, self.t[i].line
        if word == "fn" and self.name(i + 1):
            self.add(self.t[i + 1].line, "Function", self.t[i + 1].text, seen, parent)
            if top and any((a.split("(")[0].split("::")[-1]) == "test" for a in map("".join, attributes)):
                self.out.has_tests = True
            end = self.seek(i + 2, hi, "{", ";")
            if self.is_(end, ";"):
                return end + 1
            self.body(end + 1, self.match[end], parent)
            return self.match[end] + 1
        if word in ("struct", "enum", "union") and self.name(i + 1) and not member:
            if word != "union":
                self.add(self.t[i + 1].line, word.capitalize(), self.t[i + 1].text, seen, parent)
            end = self.seek(i + 2, hi, "{", ";")
            return end + 1 if self.is_(end, ";") else self.match[end] + 1
        if word == "trait" and self.name(i + 1) and not member:
            name = self.t[i + 1].text
            self.add(self.t[i + 1].line, "Trait", name, seen, parent)
            end = self.seek(i + 2, hi, "{", ";")
            if self.is_(end, "{"):
                self.members(end + 1, self.match[end], name)
                return self.match[end] + 1
            return end + 1
        if word == "impl" and not member:
            end = self.seek(i + 1, hi, "{")
            name = self.self_type(i + 1, end)
            self.add(line, "Implementation", name, "Private", parent)
            self.members(end + 1, self.match[end], name)
            return self.match[end] + 1
        if word == "mod" and self.name(i + 1) and not member:
            name = self.t[i + 1].text
            self.add(self.t[i + 1].line, "Module", name, seen, parent)
            if top and ["cfg", "(", "test", ")"] in attributes:
                self.out.has_tests = True
            if self.is_(i + 2, ";"):
                return i + 3
            if not self.is_(i + 2, "{"):
                raise ParseError(f"line {line}: expected a module's body")
            self.items(i + 3, self.match[i + 2], name)
            return self.match[i + 2] + 1
        if word in ("const", "static", "type"):
            at = i + 1 + self.is_(i + 1, "mut")
            end = self.seek(at, hi, ";")
            if not member and (self.name(at)):
                self.add(self.t[at].line, {"const": "Constant", "static": "Static", "type": "TypeAlias"}[word], self.t[at].text, seen, parent)
            self.body(at + 1, end, parent)
            return end + 1
        if word in ("use", "extern") and not member:
            end = self.seek(i + 1, hi, ";")
            if top and word == "use" and self.is_(i + 1, "crate") and self.is_(i + 2, "::"):
                self.roots(i + 3, end)
            return end + 1
        if word == "macro_rules" and self.is_(i + 1, "!") and self.name(i + 2):
            self.add(self.t[i + 2].line, "Macro", self.t[i + 2].text, "Private", parent)
            return self.after_macro(i + 3)
        j = i + self.is_(i, "::")
        while self.name(j) and self.is_(j + 1, "::"):
            j += 2
        if self.name(j) and self.is_(j + 1, "!"):
            return self.after_macro(j + 2)
        raise ParseError(f"line {line}: expected an item")

    def after_macro(self, i: int) -> int:
        if i not in self.match:
            raise ParseError("expected a macro's arguments")
        end = self.match[i] + 1
        return end + (self.is_(end, ";") and not self.is_(i, "{"))

    def self_type(self, i: int, hi: int) -> str:
        """The last segment of the type that an impl is for."""
        depth, start = 0, i
        if self.is_(i, "<"):
            while i < hi:
                depth += self.is_(i, "<") - self.is_(i, ">")
                i += 1
                if not depth:
                    break
            start = i
        depth, end, j = 0, hi, start
        while j < hi:
            if j in self.match:
                j = self.match[j] + 1
                continue
            depth += self.is_(j, "<") - self.is_(j, ">")
            if not depth and self.is_(j, "for") and not self.is_(j + 1, "<"):
                start = j + 1
            if not depth and self.is_(j, "where"):
                end = j
                break
            j += 1
        last, depth = None, 0
        if not self.name(start) and not self.is_(start, "::") or self.is_(start, "dyn", "impl", "fn"):
            return "<anonymous>"
        for j in range(start, end):
            depth += self.is_(j, "<") - self.is_(j, ">")
            if not depth and self.name(j):
                last = self.t[j].text
        return last or "<anonymous>"

    def body(self, i: int, hi: int, parent: str | None) -> None:
        """Items between the statements of a block."""
        fresh = True
        while i < hi:
            if self.is_(i, "#") and self.is_(i + 1, "["):
                j, _ = self.attributes(i)
                if fresh and self.starts(j):
                    i = self.item(i, hi, parent)
                else:
                    i = j
                continue
            if fresh and self.starts(i):
                i = self.item(i, hi, parent)
                continue
            if self.name(i) and self.is_(i + 1, "!") and i + 2 in self.match:
                i, fresh = self.match[i + 2] + 1, True
                continue
            fresh = self.is_(i, ";", "{", "}")
            i += 1

    def starts(self, i: int) -> bool:
        i, _ = self.visibility(i)
        while self.is_(i, "unsafe", "async", "const", "extern", "default") and self.name(i + 1) and not self.is_(i, "const") or self.is_(i, "const") and self.is_(i + 1, "fn", "unsafe", "async", "extern"):
            i += 1
        if self.is_(i, "fn", "struct", "enum", "trait", "mod", "type", "union"):
            return self.name(i + 1)
        if self.is_(i, "const", "static"):
            return self.name(i + 1) and not self.is_(i + 1, "move") and (self.is_(i + 2, ":") or self.is_(i + 1, "mut"))
        return self.is_(i, "impl", "use") or self.is_(i, "macro_rules") and self.is_(i + 1, "!")

    def roots(self, i: int, hi: int) -> None:
        if self.is_(i, "{"):
            at, end = i + 1, self.match[i]
            while at < end:
                if self.name(at) and self.t[at].text not in self.out.uses:
                    self.out.uses.append(self.t[at].text)
                elif self.is_(at, "{"):
                    self.roots(at, self.match[at])
                while at < end and not self.is_(at, ","):
                    at = self.match[at] + 1 if at in self.match else at + 1
                at += 1
        elif self.name(i) and self.t[i].text not in self.out.uses:
            self.out.uses.append(self.t[i].text)


def hopeless(source: str) -> bool:
    """True only where parse is sure to fail, told by the first word."""
    m = PROSE.match(source)
    return bool(m) and m[1] not in STARTS and m[1] != "safe"


def parse(source: str) -> Parsed:
    reader = _Reader(lex(source))
    reader.items(0, len(reader.t), None, top=True)
    return reader.out
