"""The code and links of a Markdown text: code spans, lines of code blocks, and link destinations, with their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
MARKER = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( {1,4}(?=\S)| *$| )")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(<[^<>]*>|\S+)")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>")
SPAN = re.compile(r"\\.|`+|!?\[|\]|<[^<>\s]*>", re.S)
PUNCTUATION = re.compile(r"\\([!-/:-@\[-`{-~])")


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


def events(source: str) -> Iterator[tuple[str, int, str]]:
    """("code" | "block" | "link", line from 1, text)"""
    lines = source.replace("\r\n", "\n").split("\n")
    blocks: list[tuple[int, list[str]]] = []
    out: list[tuple[str, int, str]] = []
    labels: dict[str, str] = {}
    fence, paragraph, indent = None, [], 0

    def close() -> None:
        if paragraph:
            blocks.append((paragraph[0][0], [x for _, x in paragraph]))
            paragraph.clear()

    for n, raw in enumerate(lines, 1):
        line = raw.expandtabs(4)
        quoted = re.match(r"(?: {0,3}> ?)+", line)
        if quoted and not fence:
            line = line[quoted.end() :]
        elif quoted and fence and fence[2]:
            line = line[quoted.end() :]
        inner = line[indent:] if indent and line[:indent].isspace() else line
        if fence:
            if re.fullmatch(rf" {{0,3}}{re.escape(fence[0][0])}{{{len(fence[0])},}} *", inner):
                fence = None
            else:
                out.append(("block", n, inner))
            continue
        if not line.strip():
            close()
            continue
        if indent and not line[:indent].isspace() and not paragraph:
            indent, inner = 0, line
        if m := MARKER.match(inner if inner is not line else line):
            close()
            indent = (len(line) - len(inner)) + m.end()
            inner = inner[m.end() :]
        if m := FENCE.match(inner):
            close()
            fence = (m[1], n, bool(quoted))
        elif inner.startswith("    ") and not paragraph:
            out.append(("block", n, inner[4:]))
        elif (m := DEFINITION.match(inner)) and not paragraph:
            labels.setdefault(_label(m[1]), m[2].strip("<>"))
        elif re.match(r" {0,3}#{1,6}(\s|$)", inner):
            close()
            blocks.append((n, [inner.lstrip("# ")]))
        else:
            paragraph.append((n, inner))
    close()
    for n, text in blocks:
        out += _inline("\n".join(text), n, labels)
    return iter(sorted(out, key=lambda e: e[1]))


def _inline(text: str, first: int, labels: dict[str, str]) -> Iterator[tuple[str, int, str]]:
    line = lambda i: first + text.count("\n", 0, i)
    at, open_ = 0, []
    while m := SPAN.search(text, at):
        at, token = m.end(), m.group()
        if token[0] == "`":
            end = re.compile(rf"(?<!`)`{{{len(token)}}}(?!`)").search(text, at)
            if end:
                code = text[at : end.start()].replace("\n", " ")
                if code.strip() and code[0] == code[-1] == " ":
                    code = code[1:-1]
                yield "code", line(m.start()), code
                at = end.end()
        elif token in ("[", "!["):
            open_.append((m.start(), token, at))
        elif token == "]" and open_:
            start, kind, inner = open_.pop()
            dest = None
            rest = re.compile(r"\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)").match(text, at)
            if rest:
                dest, at = PUNCTUATION.sub(r"\1", rest[1].strip("<>")), rest.end()
            else:
                other = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, at)
                label = _label(other[1] if other and other[1].strip() else text[inner : m.start()])
                if label in labels:
                    dest, at = labels[label], other.end() if other else at
            if dest is not None and kind == "[":
                yield "link", line(start), dest
                open_ = [o for o in open_ if o[1] == "!["]
        elif token[0] == "<" and (auto := AUTOLINK.fullmatch(token)):
            yield "link", line(m.start()), auto[1]
