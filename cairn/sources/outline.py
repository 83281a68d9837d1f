"""What a file declares and calls, read off its tokens: symbols, call sites, type relations."""

from __future__ import annotations

import hashlib
import re

from cairn.sources.lexer import Token, skeleton, tokens

#: Words that open a branch, and marks that do.
BRANCHES = {"if", "elif", "for", "while", "case", "catch", "except", "match", "when", "and", "or"}
#: Words before a bracket that are no calls.
NO_CALLS = BRANCHES | {"switch", "return", "fn", "def", "func", "function", "class", "not", "in", "with", "yield", "await", "assert", "lambda", "else", "sizeof", "typeof", "impl", "where", "super", "pub"}
#: Kinds whose identity lies in what they hold; their shape keeps names and literals.
DATA = {"const", "variable", "static"}
MODIFIERS = {"pub", "export", "default", "public", "private", "protected", "static", "abstract", "final", "async", "unsafe", "const", "extern", "declare", "readonly", "override", "get", "set", "synchronized", "native", "crate", "inline", "virtual"}
TYPES = {"rust": {"struct", "trait", "enum", "union", "mod"}, "typescript": {"class", "interface", "enum"}, "java": {"class", "interface", "enum", "record"}, "c": {"struct", "enum", "union"}, "cpp": {"struct", "class", "enum", "union", "namespace"}}
TYPES["javascript"] = TYPES["typescript"]


class Outline:
    """symbols, calls and relations of one file. A symbol's `first` and `last` are token numbers. `facts` and `calls` say whether these are wanted."""

    def __init__(self, text: str | None, language: str | None, facts: bool = True, calls: bool = True):
        self.text, self.language = text or "", language or ""
        self.tokens = list(tokens(self.text, language))
        self.code = [t for t in self.tokens if t.kind != "comment"]
        self.words = [t.text for t in self.code]
        self.pair, open_ = {}, []
        for k, t in enumerate(self.code):
            if t.kind == "open":
                open_.append(k)
            elif t.kind == "close" and open_:
                self.pair[open_.pop()] = k
        self.symbols: list[dict] = []
        self.relations: list[tuple[str, str, str, int]] = []
        self.owners: list[tuple[int, int, str]] = []  # bodies of types: first and last token, name
        if self.language == "python":
            self._python()
        elif self.language in TYPES or self.language == "go":
            self._braces()
        self.symbols.sort(key=lambda s: (s["first"], -s["last"]))
        if facts:
            self._facts()
        self.calls = self._calls() if calls else []

    def _text(self, k: int) -> str:
        return self.words[k] if 0 <= k < len(self.words) else ""

    def _is_name(self, k: int) -> bool:
        return 0 <= k < len(self.code) and self.code[k].kind == "name"

    def _add(self, name: str, kind: str, first: int, last: int, body: int | None, owner: str | None = None, exported: bool = False) -> None:
        self.symbols.append({"name": name, "kind": kind, "first": first, "last": min(last, len(self.code) - 1), "body": body, "owner_type": owner, "is_exported": exported})

    # Languages with brackets.

    def _body(self, k: int, stop: str = ";") -> tuple[int | None, int]:
        """(the bracket that opens the body, the last token) of what goes on at k; bracket pairs before it are passed over."""
        depth = self.code[k].depth if k < len(self.code) else 0
        while k < len(self.code):
            t = self.code[k]
            if t.text == "{":
                return k, self.pair.get(k, len(self.code) - 1)
            if t.text in stop or t.kind == "close" and t.depth < depth:
                return None, k - (t.kind == "close")
            k = self.pair.get(k, k) + 1 if t.kind == "open" else k + 1
        return None, len(self.code) - 1

    def _past_angles(self, k: int) -> int:
        """Behind the angle brackets that open at k."""
        open_ = 0
        while k < len(self.code):
            open_ += {"<": 1, ">": -1, "<<": 2, ">>": -2}.get(self._text(k), 0)
            k += 1
            if open_ <= 0:
                break
        return k

    def _path(self, k: int, end: int) -> tuple[str, int]:
        """(last name of a dotted or `::` path, what follows it and its type parameters), from k on."""
        name = ""
        while k < end:
            t = self.code[k]
            if t.kind == "name" and t.text not in ("dyn", "mut", "const", "virtual", "public", "private", "protected"):
                if name and self.code[k - 1].kind == "name":
                    break
                name = t.text
            elif t.text == "<":
                return name, self._past_angles(k)
            elif t.kind != "name" and t.text not in ("::", ".", "&", "*", "'", ":"):
                break
            k += 1
        return name, k

    def _listed(self, k: int, end: int, sub: str, kind: str) -> None:
        """Relations to the comma-separated types from k on."""
        while k < end:
            name, after = self._path(k, end)
            if not name:
                break
            self.relations.append((sub, name, kind, self.code[k].line))
            if self._text(after) != ",":
                break
            k = after + 1

    def _exported(self, k: int, name: str) -> tuple[int, bool]:
        """(first token of a declaration whose keyword is at k, whether it is exported)."""
        first, seen = k, set()
        while first > 0:
            before = self._text(first - 1)
            if before == ")" and self._text(first - 4) == "pub":
                first -= 4
            elif before in MODIFIERS or self.code[first - 1].kind == "string" and self._text(first - 2) == "extern":
                first -= 1
            else:
                break
            seen.add(self._text(first))
        return first, name[:1].isupper() if self.language == "go" else bool(seen & {"pub", "export", "public"})

    def _owner(self, k: int) -> tuple[int, int, str] | None:
        """The innermost type body around k."""
        return max((o for o in self.owners if o[0] < k < o[1]), default=None)

    def _braces(self) -> None:
        lang, k = self.language, 0
        while k < len(self.code):
            t, after = self.code[k], self._text(k + 1)
            if t.kind == "name":
                if lang == "rust" and t.text == "impl":
                    self._impl(k)
                elif lang == "go" and t.text == "type" and self._is_name(k + 1) and self._text(k + 2) in ("struct", "interface"):
                    self._go_type(k)
                elif t.text in TYPES.get(lang, ()) and self._is_name(k + 1) and self._text(k - 1) not in (".", "->", "::"):
                    self._type(k)
                elif t.text in ("fn", "func", "function") and lang in ("rust", "go", "typescript", "javascript"):
                    self._function(k)
                elif t.text in ("const", "static", "let", "var") and lang != "java" and t.depth == 0 and self._is_name(k + 1) and after not in ("fn", "unsafe", "async", "extern", "enum", "function", "mut") and lang not in ("c", "cpp"):
                    _, last = self._statement(k + 1)
                    first, exported = self._exported(k, after)
                    self._add(after, "variable" if t.text in ("let", "var") else "const", first, last, None, None, exported)
                elif after == "(" and lang in ("typescript", "javascript", "java", "c", "cpp"):
                    self._member(k)
            k += 1

    def _statement(self, k: int) -> tuple[None, int]:
        """The last token of a statement that ends with a semicolon, or with a line behind which nothing goes on."""
        while k < len(self.code):
            k = self.pair.get(k, k)
            if self._text(k) == ";" or k + 1 >= len(self.code) or self.code[k + 1].kind == "close":
                break
            here, then = self.code[k], self.code[k + 1]
            if then.line > here.line + here.text.count("\n") and here.kind != "mark" and then.kind not in ("mark", "open"):
                break
            k += 1
        return None, k

    def _function(self, k: int) -> None:
        owner, at = None, k + 1
        if self.language == "go" and self._text(at) == "(":
            end = self.pair.get(at, at)
            owner, at = next((self._path(j, end)[0] for j in range(end - 1, at, -1) if self._is_name(j) and self._text(j + 1) in (")", "[", "<")), None), end + 1
        if self._text(at) == "*":
            at += 1
        if not self._is_name(at):
            return
        body, last = self._body(at + 1)
        first, exported = self._exported(k, self._text(at))
        around = self._owner(k)
        owner = owner or (around[2] if around else None)
        self._add(self._text(at), "method" if owner else "function", first, last, body, owner, exported)

    def _impl(self, k: int) -> None:
        if self._text(k - 1) in ("->", ":", "(", ",", "<", "&", "=", "+", "|"):
            return
        at = self._past_angles(k + 1) if self._text(k + 1) == "<" else k + 1
        body, last = self._body(at)
        if body is None:
            return
        name, after = self._path(at, body)
        if self._text(after) == "for":
            trait, (name, _) = name, self._path(after + 1, body)
            if trait and name:
                self.relations.append((name, trait, "implements", self.code[k].line))
        if name:
            self.owners.append((body, last, name))

    def _type(self, k: int) -> None:
        name, lang = self._text(k + 1), self.language
        body, last = self._body(k + 2)
        if lang in ("c", "cpp") and (body is None or "(" in [self._text(j) for j in range(k + 2, body)] or "=" in [self._text(j) for j in range(k + 2, body)]):
            return
        first, exported = self._exported(k, name)
        kind = {"mod": "module", "namespace": "module", "record": "class", "union": "struct"}.get(self._text(k), self._text(k))
        self._add(name, kind, first, last, body, None, exported)
        end = body if body is not None else last
        for j in range(k + 2, end):
            word = self._text(j)
            if word in ("extends", "implements") and lang in ("typescript", "javascript", "java"):
                self._listed(j + 1, end, name, word)
            elif word == ":" and (lang == "cpp" or lang == "rust" and self._text(k) == "trait"):
                if lang == "cpp":
                    self._listed(j + 1, end, name, "extends")
                else:
                    for i in range(j, end):
                        if self._text(i) in (":", "+") and (sup := self._path(i + 1, end)[0]):
                            self.relations.append((name, sup, "extends", self.code[i].line))
                        if self._text(i) == "where":
                            break
                break
        if body is not None and kind != "module" and (kind != "enum" or lang == "java"):
            self.owners.append((body, last, name))

    def _go_type(self, k: int) -> None:
        name, kind = self._text(k + 1), self._text(k + 2)
        body, last = self._body(k + 3)
        self._add(name, kind, k, last, body, None, name[:1].isupper())
        if body is None:
            return
        if kind == "interface":
            self.owners.append((body, last, name))
        lines: dict[int, list[Token]] = {}
        for t in self.code[body + 1 : last]:
            lines.setdefault(t.line, []).append(t)
        for row in lines.values():
            words = [t.text for t in row if t.kind != "string"]
            if row[0].depth == self.code[body].depth + 1 and re.fullmatch(r"\*?\w+(\.\w+)?", "".join(words)) and sum(t.kind == "name" for t in row) == 1 + words.count("."):
                self.relations.append((name, words[-1], "extends", row[0].line))

    def _member(self, k: int) -> None:
        """A method of a class body, or a function of C, whose name is at k, a bracket behind it."""
        t, lang = self.code[k], self.language
        around, close = self._owner(k), self.pair.get(k + 1)
        if close is None or t.text in NO_CALLS:
            return
        inside = around is not None and t.depth == self.code[around[0]].depth + 1
        if lang in ("c", "cpp") and not inside and not (t.depth == 0 and k and (self._is_name(k - 1) or self._text(k - 1) in ("*", "&", "::", ">")) and self._text(k - 1) not in ("return", "new", "else")):
            return
        if lang not in ("c", "cpp") and not inside:
            return
        before = self._text(k - 1)
        if lang in ("typescript", "javascript") and not (before in MODIFIERS or before in ("{", "}", ";", "*", "#") or self.code[k - 1].line < t.line):
            return
        if lang == "java" and not (t.text == around[2] or self._is_name(k - 1) and before not in ("new", "return", "throw", "else") or before in (">", "]")):
            return
        j = close + 1
        while j < len(self.code) and self._text(j) not in ("{", ";", "=", "}") and self.code[j].depth == t.depth and not (self.code[j].line > self.code[j - 1].line and lang in ("typescript", "javascript") and self._text(j - 1) != ":"):
            j = self.pair.get(j, j) + 1
        if self._text(j) != "{" and not (inside and lang == "java" and self._text(j) == ";"):
            return
        body = j if self._text(j) == "{" else None
        owner = self._text(k - 2) if lang == "cpp" and before == "::" else around[2] if inside else None
        first, exported = self._exported(k, t.text)
        while lang in ("java", "c", "cpp") and first > 0 and self.code[first - 1].line == t.line and self._text(first - 2) != "@" and (self.code[first - 1].kind == "name" or self._text(first - 1) in ("<", ">", "*", "&", ",", "[", "]", "::")):
            first -= 1
            exported |= self._text(first) == "public"
        exported = exported if lang in ("java",) or not inside else "private" not in {self._text(i) for i in range(first, k)}
        self._add(t.text, "method" if owner else "function", first, self.pair.get(j, j), body, owner, exported)

    # Indentation.

    def _python(self) -> None:
        code = self.code
        starts = [k for k, t in enumerate(code) if t.depth == 0 and (not k or code[k - 1].line + code[k - 1].text.count("\n") < t.line)]
        open_: list[tuple[int, dict | None, str]] = []  # indents of what is open, its symbol, its keyword
        for n, k in enumerate(starts):
            while open_ and code[k].column <= open_[-1][0]:
                open_.pop()[1]["last"] = k - 1
            at = k + (self._text(k) == "async")
            word = self._text(at)
            if word not in ("class", "def") or not self._is_name(at + 1):
                continue
            name, holder = self._text(at + 1), open_[-1] if open_ else None
            owner = holder[1]["name"] if holder and holder[2] == "class" else None
            self._add(name, "class" if word == "class" else "method" if owner else "function", k, len(code) - 1, None, owner, not name.startswith("_"))
            colon = next((j for j in range(at + 2, len(code)) if code[j].depth == code[k].depth and code[j].text == ":"), len(code) - 1)
            self.symbols[-1]["body"] = colon
            open_.append((code[k].column, self.symbols[-1], word))
            if word == "class" and self._text(at + 2) == "(":
                end = self.pair.get(at + 2, at + 2)
                row, inner = [], code[at + 2].depth + 1
                for j in range(at + 3, end + 1):
                    if j == end or code[j].text == "," and code[j].depth == inner:
                        words = [t.text for t in row if t.depth == inner]
                        if words and "=" not in words and row[0].kind == "name":
                            path = re.match(r"[\w.]+", "".join(words))[0]
                            self.relations.append((name, path.rpartition(".")[2], "extends", row[0].line))
                        row = []
                    else:
                        row.append(code[j])

    # Facts of all.

    def _facts(self) -> None:
        question = self.language in ("typescript", "javascript", "java", "c", "cpp")
        for s in self.symbols:
            body = self.code[s["first"] : s["last"] + 1]
            end = body[-1]
            s["line_start"], s["line_end"] = body[0].line, end.line + end.text.count("\n")
            stop = s["body"] if s["body"] is not None else s["last"] + 1
            last = self.code[min(stop, len(self.code)) - 1]
            head = " ".join(self.text[body[0].at : last.at + len(last.text)].split())
            s["signature"] = head.encode()[:200].decode("utf-8", "ignore")
            s["complexity"] = s["arms"] = None
            if s["kind"] in ("function", "method"):
                s["arms"] = sum(t.text == "=>" and t.kind == "mark" for t in body)
                s["complexity"] = 1 + sum(
                    t.kind == "name" and t.text in BRANCHES or t.kind == "mark" and (t.text in ("&&", "||") or question and t.text == "?" and self.text[t.at + 1 : t.at + 2].isspace()) for t in body
                )
            shape = skeleton(body, s["kind"] in DATA) if s["line_end"] - s["line_start"] >= 2 else ""
            s["shape_hash"] = hashlib.md5(shape.encode()).hexdigest() if len(shape.encode()) >= 10 else None

    def _calls(self) -> list[dict]:
        """Call sites in order: idx of the innermost symbol, name, receiver, line, and how deep in brackets."""
        holder = [-1] * len(self.code)
        for n, s in enumerate(self.symbols):  # inner ones come later
            holder[s["first"] : s["last"] + 1] = [n] * (s["last"] + 1 - s["first"])
        heads = {(s["name"], k) for s in self.symbols for k in range(s["first"], (s["body"] if s["body"] is not None else s["last"]) + 1)}
        out = []
        for k, t in enumerate(self.code):
            if t.kind != "name" or t.text in NO_CALLS or self._text(k + 1) not in ("(", "::"):
                continue
            after = k + 1
            if self._text(after) == "::" and self._text(after + 1) == "<":
                after = self._past_angles(after + 1)
            before = self._text(k - 1)
            if self._text(after) != "(" or before in ("fn", "def", "func", "function", "class") or holder[k] >= 0 and (t.text, k) in heads and before not in (".", "="):
                continue
            around = self._owner(k)
            if before == "@" and self.language == "java" or around and t.depth == self.code[around[0]].depth + 1 and before not in ("=", ".", "new", "::", "->", "?", ":", "&&", "||", "+", ",", "@"):
                continue  # an annotation, or a method without a body
            receiver = None
            if before in (".", "::", "?.", "->"):
                receiver = self._text(k - 2) if self._is_name(k - 2) else ""
            out.append({"idx": holder[k], "name": t.text, "receiver": receiver, "line": t.line, "depth": t.depth})
        return out


def lines_of_code(outline: Outline) -> list[tuple[int, str]]:
    """(number, line) of the lines that do not lie inside a string or comment that began on an earlier one."""
    inside = set()
    for t in outline.tokens:
        if t.kind in ("string", "comment") and (n := t.text.count("\n")):
            inside.update(range(t.line + 1, t.line + n + 1))
    return [(n, line) for n, line in enumerate(outline.text.split("\n"), 1) if n not in inside]
