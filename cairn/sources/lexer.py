"""Tokens of source text in one pass: a state machine over code, strings, templates, comments and brackets.

Each step takes one token at its place. Strings may hold escapes, be raw, triple or in back-ticks; a template goes back to code inside `${ }`; block comments
nest where the language lets them. Every token knows its line, its column and how many brackets are open around it; the two ends of a pair have the same depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tokens that leave at once.
PIECE = 32_768


class Token(NamedTuple):
    kind: str
    text: str
    at: int
    line: int
    column: int
    depth: int


_NAME, _NUMBER = r"[^\W\d]\w*", r"\d\w*(?:\.\d\w*)*"
_MARKS = r"=>|->|::|:=|==|!=|<=|>=|&&|\|\||\?\?|\?\.|[^\w\s]"
_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
_CHAR = r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]+|u\{?[0-9a-fA-F]+\}?|[\s\S]))'"
_LINE, _HASH, _BLOCK = r"//[^\n]*", r"\#[^\n]*", r"/\*(?:[\s\S]*?\*/|[\s\S]*)"
_TRIPLE = r'(?:"""(?:[^\\]|\\[\s\S])*?"""|' + r"'''(?:[^\\]|\\[\s\S])*?''')"

#: Comments and strings by family, in the order in which they are tried.
FAMILIES = {
    "c": ([_LINE, _BLOCK], [_QUOTED, _CHAR]),
    "go": ([_LINE, _BLOCK], [_QUOTED, "`[^`]*`", _CHAR]),
    "java": ([_LINE, _BLOCK], [r'"""(?:[^\\]|\\[\s\S])*?"""', _QUOTED, _CHAR]),
    "rust": ([_LINE, r"/\*"], [r'b?r(?P<rail>\#*)"[\s\S]*?"(?P=rail)', r'b?"(?:[^"\\]|\\[\s\S])*"', "b?" + _CHAR]),
    "script": ([_LINE, _BLOCK], [_QUOTED, _SINGLE]),
    "python": ([_HASH], [rf"[rRbBuUfF]{{0,2}}(?:{_TRIPLE}|{_QUOTED}|{_SINGLE})"]),
    "plain": ([_LINE, _BLOCK], [_QUOTED, _SINGLE, "`[^`]*`"]),
}
FAMILY = {"c": "c", "cpp": "c", "go": "go", "java": "java", "rust": "rust", "typescript": "script", "javascript": "script", "python": "python"}
_PATTERNS = {
    name: re.compile(f"(?P<comment>{'|'.join(comments)})|(?P<string>{'|'.join(strings)})|(?P<name>{_NAME})|(?P<number>{_NUMBER})|(?P<mark>{_MARKS})")
    for name, (comments, strings) in FAMILIES.items()
}
_NESTED, _TEMPLATE = re.compile(r"/\*|\*/"), re.compile(r"(?:[^`\\$]|\\(?:[\s\S]|\Z)|\$(?!\{))*(?:`|\$\{|\Z)")
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "else", "do"}


def _end_of_nested(text: str, at: int) -> int:
    """Behind the block comment that opens at `at`, with those inside it."""
    open_ = 0
    for m in _NESTED.finditer(text, at):
        open_ += 1 if m[0] == "/*" else -1
        if not open_:
            return m.end()
    return len(text)


def tokens(text: str, language: str | None) -> Iterator[Token]:
    """Tokens in order: comment, string, name, number, open, close, mark. A quote without its end is a mark."""
    family = FAMILY.get(language or "", "plain")
    search, at, line, line_start, depth = _PATTERNS[family].search, 0, 1, 0, 0
    templates: list[int] = []  # depths at which a template waits for its code to end
    before = ""
    while m := search(text, at):
        start, kind = m.start(), m.lastgroup
        end = m.end()
        if start > at and (breaks := text.count("\n", at, start)):
            line, line_start = line + breaks, text.rindex("\n", at, start) + 1
        at = end
        if kind == "name" or kind == "number":
            before = m[0]
            yield Token(kind, before, start, line, start - line_start, depth)
            continue
        kind = "string" if kind == "rail" else kind
        own = depth
        if kind == "mark":
            mark = text[start]
            if mark in "([{":
                kind, depth = "open", depth + 1
            elif mark in ")]}":
                kind, depth = "close", max(0, depth - 1)
                own = depth
                if templates and mark == "}" and depth == templates[-1]:
                    templates.pop()
                    yield Token(kind, "}", start, line, start - line_start, own)
                    kind, start = "string", end
                    end = _TEMPLATE.match(text, end).end()
            elif mark == "`" and family == "script":
                kind, end = "string", _TEMPLATE.match(text, end).end()
            elif mark == "/" and family == "script" and (before in _BEFORE_REGEX or not before or not (before[-1].isalnum() or before[-1] in "_)]}\"'`")):
                if found := _REGEX.match(text, start):
                    kind, end = "string", found.end()
        elif kind == "comment" and family == "rust" and text.startswith("/*", start):
            end = _end_of_nested(text, start)
        word = text[start:end]
        if kind == "string" and family == "script" and word.endswith("${"):
            yield Token(kind, word[:-2], start, line, start - line_start, own)
            if breaks := text.count("\n", start, end):
                line, line_start = line + breaks, text.rindex("\n", start, end) + 1
            kind, word, start = "open", "${", end - 2
            templates.append(depth)
            own, depth = depth, depth + 1
        yield Token(kind, word, start, line, start - line_start, own)
        if kind != "comment":
            before = word
        # Only strings and comments go over lines.
        if (kind == "string" or kind == "comment") and (breaks := text.count("\n", start, end)):
            line, line_start = line + breaks, text.rindex("\n", start, end) + 1
        at = end


def skeleton(code: list[Token], keep: bool = False) -> str:
    """Tokens without comments; strings, numbers and names become one placeholder unless they are kept; any white space between two becomes one space."""
    out, last = [], None
    for t in code:
        if t.kind == "comment":
            continue
        if last is not None and last < t.at:
            out.append(" ")
        out.append(t.text if keep or t.kind not in ("string", "number", "name") else "_")
        last = t.at + len(t.text)
    return re.sub(r"\s+", " ", "".join(out)).strip()


def pieces(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of `token_table` for batches of (key, text, language), PIECE at a time."""
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())

    def piece(keys, at, rows):
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *columns], names=[key, "n", "kind", "text", "line", "column", "depth"])

    for batch in batches:
        keys, rows, at = batch.column(0), [], []
        for k, (text, language) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            for n, t in enumerate(tokens(text.as_py() or "", language.as_py())):
                rows.append((n, t.kind, t.text, t.line, t.column, t.depth))
                at.append(k)
                if len(rows) == PIECE:
                    yield piece(keys, at, rows)
                    rows, at = [], []
        if rows:
            yield piece(keys, at, rows)


def token_table(files: DataFrame, key: str = "id") -> DataFrame:
    """(key, n, kind, text, line, column, depth): the tokens of files (key, text, language) by number from 0; null texts have none.

    Tokens leave in pieces, so a task holds no more of them, however long a text is and however many are in a batch.
    """
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "text", "language").mapInArrow(lambda batches: pieces(batches, key), f"`{key}` {kind}, n int, kind string, text string, line int, column int, depth int")
