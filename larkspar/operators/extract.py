"""Functions of Rust and Swift sources, by a small lexer: one pass that knows strings, comments and brackets, then declarations by keyword.

Units have 1-based lines, both ends included. min_lines counts physical lines. Functions inside functions are not units of their own. Methods carry the fields of
their type, if the file declares them, as a comment before the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from larkspar.functions.scalars import LANGUAGES
from larkspar.schemas import RAW_UNIT, ddl
from larkspar.tables import spread

#: What a lexer has to know of, in the order it is tried at a place: line comments, starts of block comments (which nest), literals. Unterminated ones reach to the end.
_RUST = re.compile(r"""//[^\n]*+|(?P<block>/\*)|(?<!\w)(?:br|r)(?P<hashes>\#*)"(?s:.*?)(?:"(?P=hashes)|\Z)|"(?:[^"\\]|\\[\s\S]?)*+"?|'(?:\\u\{[0-9a-fA-F]+\}|\\x[0-9a-fA-F]{2}|\\.|[^\\'\n])'""")
_SWIFT = re.compile(r"""//[^\n]*+|(?P<block>/\*)|\"\"\"(?s:.*?)(?:\"\"\"|\Z)|(?<!\w)(?P<hashes>\#+)"(?s:.*?)(?:"(?P=hashes)|\Z)|"(?:[^"\\]|\\[\s\S]?)*+"?""")
_NEST = re.compile(r"/\*|\*/")
_SHOWN = re.compile(r"[^\n]+")


def _spaces(m: re.Match) -> str:
    return " " * len(m[0])


def blanked(code: str, language: str) -> str:
    """The code with comments and literals replaced by spaces of equal length (line breaks stay)."""
    lexer, out, at = _RUST if language == "rust" else _SWIFT, [], 0
    while m := lexer.search(code, at):
        end = m.end()
        if m["block"]:
            depth = 1
            while depth:
                nest = _NEST.search(code, end)
                if not nest:
                    end = len(code)
                    break
                depth, end = depth + (1 if nest[0] == "/*" else -1), nest.end()
        out += [code[at : m.start()], _SHOWN.sub(_spaces, code[m.start() : end])]
        at = end
    return "".join(out) + code[at:]


_BRACES, _BODY, _FIELD = re.compile("[{}]"), re.compile(r"[()\[\]{};]"), re.compile(r"[()\[\]{}<>,]")


def _close(code: str, at: int) -> int:
    """The place after the brace that closes the one at this place."""
    depth = 0
    for m in _BRACES.finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _body(code: str, at: int, end: int) -> int | None:
    """The brace that opens the body of a declaration, or None if it ends without one."""
    depth = 0
    for m in _BODY.finditer(code, at, end):
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "{" and depth == 0:
            return m.start()
        elif (c == ";" and depth == 0) or (c == "}" and depth == 0):
            return None
    return None


def _fields(code: str, clean: str, start: int, end: int) -> list[str]:
    """The comma-separated fields of a struct's braces, as written, without attributes and comments before them."""
    out, depth, last = [], 0, start
    for m in _FIELD.finditer(clean, start, end):
        c = m[0]
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and clean[m.start() - 1] != "-"):
            depth -= 1
        elif c == "," and depth == 0:
            out.append((last, m.start()))
            last = m.end()
    out.append((last, end))
    found = []
    for a, b in out:
        text = re.sub(r"#\[[^\]]*\]", lambda m: " " * len(m[0]), clean[a:b])
        if text.strip():
            lead = len(text) - len(text.lstrip())
            found.append(code[a + lead : a + len(text.rstrip())])
    return found


def _unit(code: str, path: str, name: str, kind: str, start: int, end: int, context: str) -> tuple:
    first, last = code.count("\n", 0, start), code.count("\n", 0, end - 1)
    body = "\n".join(x.removesuffix("\r") for x in code.split("\n")[first : last + 1])
    return (name, path, kind, first + 1, last + 1, context + body, first + 1, 0)


def rust_units(code: str, path: str, min_lines: int, free_colons: str = ":") -> list[tuple]:
    clean = blanked(code, "rust")
    structs: dict[str, list[str]] = {}
    for m in re.finditer(r"\bstruct\s+([^\W\d]\w*)", clean):
        brace = _body(clean, m.end(), len(clean))
        if brace is not None:
            fields = _fields(code, clean, brace + 1, _close(clean, brace) - 1)
            if fields:
                structs[m[1]] = fields
    out: list[tuple] = []

    def visit(start: int, end: int, owner: str | None) -> None:
        at = start
        declaration = re.compile(r"(?m)\b(?:(fn)\s+([^\W\d]\w*)|(impl)\b)")
        while m := declaration.search(clean, at, end):
            brace = _body(clean, m.end(), end)
            if brace is None:
                at = m.end()
                continue
            close = _close(clean, brace)
            if m[1]:
                head = clean.rfind("\n", 0, m.start()) + 1
                before = re.search(r"(?:pub(?:\s*\([^)]*\))?\s+|const\s+|async\s+|unsafe\s+|extern\s+)+$", clean[head : m.start()])
                begin = head + before.start() if before else m.start()
                if code.count("\n", begin, close - 1) + 1 >= min_lines:
                    context = f"// Struct fields:\n{chr(10).join(structs[owner])}\n\n" if owner in structs else ""
                    name = f"rust:{path}::{owner}::{m[2]}" if owner else f"rust{free_colons}{path}::{m[2]}"
                    out.append(_unit(code, path, name, "method" if owner else "function", begin, close, context))
            else:
                # the first plain type name of the header: the trait of a trait's impl; generic types don't count
                head = clean[m.end() : brace].split(" where ")[0]
                while (plain := re.sub(r"(?:\w+(?:::\w+)*)?\s*<[^<>]*>", "", head)) != head:
                    head = plain
                names = [x for x in re.findall(r"(?<![\w:'])[^\W\d]\w*(?!\w|::)", head) if x not in ("for", "dyn", "unsafe", "mut", "const")]
                visit(brace + 1, close - 1, names[0] if names else None)
            at = close

    visit(0, len(clean), None)
    return out


def swift_units(code: str, path: str, min_lines: int) -> list[tuple]:
    clean = blanked(code, "swift")
    out: list[tuple] = []
    declaration = re.compile(r"\b(?:(func)\s+([^\s(<]+)|(init|subscript)\b[?!]?\s*[(<]|(class|struct|extension|enum|actor)\s+([^\W\d]\w*))")
    modifier = r"(?:(?:@\w+(?:\([^)]*\))?|public|private|fileprivate|internal|open|static|class|final|override|mutating|nonmutating|convenience|required|async|lazy|weak)\s+)*"

    def properties(start: int, end: int) -> list[str]:
        found, at = [], start
        prop = re.compile(rf"(?m)^[ \t]*({modifier}(?:var|let)\s+\w[^\n{{]*)|[{{]")
        while m := prop.search(clean, at, end):
            if m[1] is None:
                at = _close(clean, m.start())
                continue
            stop = m.end()
            brace = re.compile(r"\s*\{").match(clean, stop)
            if brace:
                stop = _close(clean, brace.end() - 1)
            found.append(code[m.start(1) : stop].rstrip())
            at = stop
        return found

    def visit(start: int, end: int, owner: str | None, context: str) -> None:
        at = start
        while m := declaration.search(clean, at, end):
            brace = _body(clean, m.end() - 1 if m[3] else m.end(), end)
            if brace is None:
                at = m.end()
                continue
            close = _close(clean, brace)
            if m[4]:
                props = properties(brace + 1, close - 1)
                visit(brace + 1, close - 1, m[5], f"// Class properties:\n{chr(10).join(props)}\n\n" if props else "")
            else:
                head = clean.rfind("\n", 0, m.start()) + 1
                begin = head + len(clean[head : m.start()]) - len(clean[head : m.start()].lstrip()) if re.fullmatch(rf"\s*{modifier}", clean[head : m.start()]) else m.start()
                if code.count("\n", begin, close - 1) + 1 >= min_lines:
                    name = "init" if m[3] == "init" else "unknown" if m[3] else m[2]
                    full = f"swift:{path}::{owner}::{name}" if owner else f"swift:{path}::{name}"
                    out.append(_unit(code, path, full, "method" if owner else "function", begin, close, context))
            at = close

    visit(0, len(clean), None, "")
    return out


def language(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return LANGUAGES.get(ext.lower()) if dot and stem else None


def functions_of(code: str, path: str, min_lines: int = 5, strict_names: bool = False) -> list[tuple]:
    """RAW_UNIT rows of a file; languages other than Rust and Swift have none.

    strict_names: free Rust functions have two colons after the language, which no indexed name has, so a function would not recognise itself there."""
    kind = language(path)
    if kind == "rust":
        return rust_units(code, path, min_lines, "::" if strict_names else ":")
    return swift_units(code, path, min_lines) if kind == "swift" else []


def extract_functions(files: DataFrame, min_lines: int = 5, keep: list[str] | None = None, strict_names: bool = False) -> DataFrame:
    """RAW_UNIT rows of (file_path, content) files, with the kept columns of the file before them. Files are parsed where they are; nothing is shuffled, unless there are fewer splits than
    cores."""
    keep = keep or []
    names = [f.name for f in RAW_UNIT]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if r["file_path"] is not None and r["content"] is not None:
                    rows += [(*(r[k] for k in keep), *u) for u in functions_of(r["content"], r["file_path"], min_lines, strict_names)]
            yield pd.DataFrame(rows, columns=[*keep, *names])

    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), ddl(RAW_UNIT)])
    return spread(files.select(*dict.fromkeys(["file_path", "content", *keep]))).mapInPandas(parse, schema)
