"""Tokens, outlines and shapes of source text."""

import random

import pytest

from cairn.sources.lexer import skeleton, token_table, tokens
from cairn.sources.outline import Outline

#: Whole tokens by language; each must come out as it is, whatever stands around it.
PIECES = {
    "rust": {"comment": ["// a \" ' /*\n", "/* x /* y */ \" */", "/**/"], "string": ['"a \\" // b"', '"two\nlines"', 'r"\\"', 'r#"x " y"#', 'br##"q "# z"##', "'x'", "'\\''", "b'{'", "'\\u{1F600}'"], "mark": ["=>", "::", "->", "!", "'"], "name": ["fn", "été", "_x1"], "number": ["1_000u32", "2.5e3"]},
    "go": {"comment": ["// \" `\n", "/* /* */"], "string": ['"a \\" b"', '`raw " \\ // \n x`', "'\\n'", "'{'"], "mark": [":=", "&&", "<"], "name": ["func"], "number": ["0x1F"]},
    "java": {"comment": ["// x\n", "/* \" */"], "string": ['"a"', '"""\n text " // \n"""', "'\"'"], "mark": ["->", "||", "?"], "name": ["class"], "number": ["10L"]},
    "typescript": {"comment": ["// `\n", "/* ' */"], "string": ['"a"', "'it\\'s'", "`plain // \\` {`"], "mark": ["=>", "?.", "??", "="], "name": ["const"], "number": ["1.5"]},
    "python": {"comment": ["# \" '\n"], "string": ['"a # b"', "'it\\'s'", 'rb"x"', '"""a "" \n # b"""', "'''x '' y'''", 'f"{a(1)}"'], "mark": ["->", "==", "@", "/"], "name": ["def"], "number": ["1_0"]},
    "c": {"comment": ["// \"\n", "/* ' */"], "string": ['"%d\\n"', "'\\0'", "'\\x41'"], "mark": ["->", "*", "#"], "name": ["int"], "number": ["3.0f"]},
    None: {"comment": ["// x\n", "/* ' */"], "string": ['"a"', "'b c'", "`d`"], "mark": ["%", "=="], "name": ["word"], "number": ["42"]},
}


@pytest.mark.parametrize("language", PIECES, ids=str)
def test_tokens_come_out_whole(language):
    rng = random.Random(str(language))
    flat = [(kind, text) for kind, texts in PIECES[language].items() for text in texts if text != "'"]
    for _ in range(300):
        chosen, text, want, open_ = [rng.choice(flat) for _ in range(rng.randint(1, 25))], "", [], []
        for kind, word in chosen:
            if rng.random() < 0.3:
                bracket = rng.choice("([{")
                want.append(("open", bracket, len(text), len(open_)))
                text += bracket + " "
                open_.append({"(": ")", "[": "]", "{": "}"}[bracket])
            want.append((kind, word.rstrip("\n") if kind == "comment" else word, len(text), len(open_)))
            text += word + " "
            if open_ and rng.random() < 0.3:
                want.append(("close", open_[-1], len(text), len(open_) - 1))
                text += open_.pop() + "\n"
        got = list(tokens(text, language))
        assert [(t.kind, t.text, t.at, t.depth) for t in got] == want
        for t in got:
            assert t.line == 1 + text.count("\n", 0, t.at) and t.column == t.at - (text.rfind("\n", 0, t.at) + 1)


@pytest.mark.parametrize("language", PIECES, ids=str)
def test_any_text_is_covered_in_order(language):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a", "1", "'", '"', "`", "${", "}", "{", "(", ")", "/*", "*/", "//", "#", "\n", " ", "\\", "r#", "é", "'''", "/"]) for _ in range(rng.randint(0, 60)))
        at = 0
        for t in tokens(text, language):
            assert not text[at : t.at].strip() and text[t.at : t.at + len(t.text)] == t.text and t.depth >= 0
            at = t.at + len(t.text)
        assert not text[at:].strip()


def test_templates_go_back_to_code():
    got = [(t.kind, t.text) for t in tokens("a(`x ${f({b: `y ${g} z`})} w`) / 2", "typescript")]
    assert got == [("name", "a"), ("open", "("), ("string", "`x "), ("open", "${"), ("name", "f"), ("open", "("), ("open", "{"), ("name", "b"), ("mark", ":"), ("string", "`y "), ("open", "${"), ("name", "g"), ("close", "}"), ("string", " z`"), ("close", "}"), ("close", ")"), ("close", "}"), ("string", " w`"), ("close", ")"), ("mark", "/"), ("number", "2")]
    assert [t.text for t in tokens("x = a / b / c; return /d(/g", "javascript") if t.kind == "string"] == ["/d(/g"]


RUST = """
pub(crate) trait Shape: Base + Send { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() } }
impl<'a, T: Clone> Shape for Square<'a, T> {
    /// fn no() {}
    fn area(&self) -> f64 {
        let l = "fn x() { y()";
        match self.k { 1 => a(), _ if self.b.check(2) => self.0.len(), _ => Vec::<u8>::new() }
    }
}
pub async fn run(x: i32) -> Result<()> { if x > 1 && y { go(x)?; } /* lost() */ Ok(()) }
const LIMIT: &str = "a(b)";
"""
SCRIPT = """
export class Foo<T> extends Bar.Baz<T> implements A, B {
  private x = foo();
  async get(k: string): Promise<void> { return /a{(/.test(k) ? go(`${deep(k)}`) : null; }
}
interface I extends J { m(): void; }
export const arrow = (x) => { return other(x) };
function top(a, b) { return a / b / call(2); }
"""
PYTHON = '''
class A(base.B, C[int], metaclass=M):
    """doc
def fake(): pass
    """
    async def f(self, a=(1, 2)):
        x = f"call({a})"  # if or and
        return self.g(a) if a and len(x) else os.path.join("a", "b")
    def g(self): return [
  1, h(2)]

def _top():
    def inner():
        return 1
    return inner()
'''


def names(outline):
    return [(s["name"], s["kind"], s["owner_type"], s["line_start"], s["line_end"], s["is_exported"], s["complexity"]) for s in outline.symbols]


def calls(outline):
    return [(outline.symbols[c["idx"]]["name"] if c["idx"] >= 0 else None, c["receiver"], c["name"]) for c in outline.calls]


def test_outlines():
    o = Outline(RUST, "rust")
    assert names(o) == [("Shape", "trait", None, 2, 2, True, None), ("area", "method", "Shape", 2, 2, False, 1), ("twice", "method", "Shape", 2, 2, False, 1), ("area", "method", "Square", 5, 8, False, 3), ("run", "function", None, 10, 10, True, 3), ("LIMIT", "const", None, 11, 11, False, None)]
    assert o.symbols[3]["arms"] == 3 and o.symbols[4]["signature"] == "pub async fn run(x: i32) -> Result<()>"
    assert calls(o) == [("twice", "self", "area"), ("area", None, "a"), ("area", "b", "check"), ("area", "", "len"), ("area", "", "new"), ("run", None, "go"), ("run", None, "Ok")]
    assert o.relations == [("Shape", "Base", "extends", 2), ("Shape", "Send", "extends", 2), ("Square", "Shape", "implements", 3)]
    o = Outline(SCRIPT, "typescript")
    assert names(o) == [("Foo", "class", None, 2, 5, True, None), ("get", "method", "Foo", 4, 4, True, 2), ("I", "interface", None, 6, 6, False, None), ("arrow", "const", None, 7, 7, True, None), ("top", "function", None, 8, 8, False, 1)]
    assert calls(o) == [("Foo", None, "foo"), ("get", "", "test"), ("get", None, "go"), ("get", None, "deep"), ("arrow", None, "other"), ("top", None, "call")]
    assert o.relations == [("Foo", "Baz", "extends", 2), ("Foo", "A", "implements", 2), ("Foo", "B", "implements", 2), ("I", "J", "extends", 6)]
    o = Outline(PYTHON, "python")
    assert names(o) == [("A", "class", None, 2, 10, True, None), ("f", "method", "A", 6, 8, True, 3), ("g", "method", "A", 9, 10, True, 1), ("_top", "function", None, 12, 15, False, 1), ("inner", "function", None, 13, 14, True, 1)]
    assert calls(o) == [("f", "self", "g"), ("f", None, "len"), ("f", "path", "join"), ("g", None, "h"), ("_top", None, "inner")]
    assert o.relations == [("A", "B", "extends", 2), ("A", "C", "extends", 2)]


@pytest.mark.parametrize("language", ["rust", "typescript", "javascript", "go", "java", "python", "c", "cpp", None])
def test_outlines_of_broken_text(language):
    rng = random.Random(3)
    words = ["fn", "class", "impl", "type", "struct", "interface", "func", "def", "extends", "for", "x", "Y", "(", ")", "{", "}", "<", ">", "::", ":", ";", ",", "\n", "    ", "=", '"', "'", "pub", "const", "=>", "@"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))
        for s in Outline(text, language).symbols:
            assert 1 <= s["line_start"] <= s["line_end"] <= text.count("\n") + 1
    assert Outline(None, language).symbols == [] and Outline("", language).calls == []


def test_shapes():
    def shape(text, keep=False):
        return skeleton(list(tokens(text, "rust")), keep)

    one, two = 'fn a(x: i32) {\n  let s = "q"; // c\n  if x > 1 { b(s) }\n}', "fn zz(y: u8) {\n let t = 'r'; /* d */\n if y > 22 { cc(t) } }"
    assert shape(one) == "_ _(_: _) { _ _ = _; _ _ > _ { _(_) } }" == shape(two)
    assert shape(one, True) != shape(two, True) and shape("a \" b // \n \" c") == "_ _ _"
    rows = {s["name"]: s["shape_hash"] for s in Outline('const A: &[&str] = &[\n"a",\n"b"];\nconst B: &[&str] = &[\n"a",\n"c"];\n' + one + "\n" + two.replace("}", "}\n"), "rust").symbols}
    assert rows["A"] != rows["B"] and None not in rows.values() and rows["a"] != rows["A"]


def test_token_table(spark):
    df = spark.createDataFrame([(1, "a(b)", "rust"), (2, None, "go"), (3, "", None)], "id long, text string, language string")
    got = [tuple(r) for r in token_table(df).orderBy("id", "n").collect()]
    assert got == [(1, 0, "name", "a", 1, 0, 0), (1, 1, "open", "(", 1, 1, 0), (1, 2, "name", "b", 1, 2, 1), (1, 3, "close", ")", 1, 3, 0)]


def test_tokens_leave_in_pieces(monkeypatch):
    import pyarrow as pa

    from cairn.sources import lexer

    taken = []
    monkeypatch.setattr(lexer, "tokens", lambda text, language: (taken.append(t) or t for t in tokens(text, language)))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["a " * 100_000, None, "b c"], "language": pa.array([None] * 3, pa.string())})
    got = lexer.pieces(iter([batch]), "id")
    assert next(got).num_rows == lexer.PIECE == len(taken)
    rest = [p.num_rows for p in got]
    assert max(rest) <= lexer.PIECE and sum(rest) + lexer.PIECE == 100_002
