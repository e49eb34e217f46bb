"""Scalar functions as Column expressions: hashes, code normalisation, names, paths, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code file extensions and their languages.
LANGUAGES = {"rs": "rust", "swift": "swift", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go"}
#: A function whose lower-case name contains one of these is an entry point.
ENTRY_POINTS = ("main", "test_", "_test", "new", "default", "init", "setup", "run")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: Column | str) -> Column:
    """The lines of a text: a final line break adds no empty line, and CR before LF is part of the break."""
    text = _col(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def trimmed(c: Column) -> Column:
    """Without white space (any Unicode kind) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def content_hash(body: Column | str) -> Column:
    return F.sha2(_col(body), 256)


def short_content_hash(body: Column | str) -> Column:
    return F.substring(content_hash(body), 1, 16)


def structure_text(body: Column | str) -> Column:
    """Trimmed lines without empty ones and comment lines."""
    return F.array_join(F.filter(F.transform(lines(body), trimmed), lambda x: (x != "") & ~x.startswith("//")), "\n")


def structure_hash(body: Column | str) -> Column:
    return F.sha2(structure_text(body), 256)


def normalize_code(code: Column | str) -> Column:
    """Without comments, with single spaces, and with placeholders for strings and numbers."""
    x = F.regexp_replace(_col(code), r"//[^\n]*", "")
    x = F.regexp_replace(x, r"\r?\n", " ")
    x = F.regexp_replace(x, r"/\*/|(?s)/\*.*?\*/", "")
    x = trimmed(F.regexp_replace(x, r"(?U)\s+", " "))
    x = F.regexp_replace(x, r'(?s)"(?:\\.|[^"\\])*(?:"|\\?\z)', r'"\$STR"')
    return F.regexp_replace(x, r"[0-9][0-9.]*", r"\$NUM")


def normalized_hash(code: Column | str) -> Column:
    return F.substring(F.sha2(normalize_code(code), 256), 1, 16)


def short_name(name: Column | str) -> Column:
    """What follows the last pair of colons, pairs being read from the left."""
    return F.element_at(F.split(_col(name), "::"), -1)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(_col(path), r"/+$", ""), "/"), -1)


def format_name(name: Column | str) -> Column:
    """'function (file)' for names with a pair of colons, else the name."""
    name = _col(name)
    parts = F.split(name, "::", 2)
    file = F.element_at(F.split(F.element_at(parts, 1), "/"), -1)
    file = F.regexp_replace(F.regexp_replace(file, "^(swift:)+", ""), "^(rust:)+", "")
    return F.when(F.size(parts) == 2, F.concat(F.element_at(parts, 2), F.lit(" ("), file, F.lit(")"))).otherwise(name)


def _extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"(?:^|/)[^/]+\.([^./]+)$", 1))


def language_of(path: Column | str) -> Column:
    """The language of a code file by its extension, else null."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, _extension(path))


def is_code_file(path: Column | str) -> Column:
    return F.coalesce(_extension(path).isin(*LANGUAGES), F.lit(False))


def is_entry_point(name: Column | str) -> Column:
    return F.lower(_col(name)).rlike("|".join(ENTRY_POINTS))


def node_id(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), r"::|[/.\-]", "_")


def ref_id(file: Column | str, line: Column | str) -> Column:
    return F.concat(node_id(file), F.lit("_"), _col(line).cast("string"))


def module_of(path: Column | str, workspace: str = "") -> Column:
    """A file's path below the workspace without extension, with colons for slashes."""
    path = _col(path)
    below = F.when(path.startswith(workspace), F.substring(path, len(workspace) + 1, 1 << 30)).otherwise(path)
    return F.replace(F.regexp_replace(F.regexp_replace(below, "^/+", ""), r"([^/])\.[^./]*$", "$1"), F.lit("/"), F.lit("::"))


def relative_path(path: Column | str, root: str) -> Column:
    path = _col(path)
    return F.when(path.startswith(root), F.regexp_replace(F.substring(path, len(root) + 1, 1 << 30), "^/+", "")).otherwise(path)


def percent_whole(similarity: Column | str) -> Column:
    """Truncated per cent, multiplied in single precision (0.95 gives 95)."""
    return (_col(similarity).cast("float") * F.lit(100).cast("float")).cast("int")


def percent_text(similarity: Column | str) -> Column:
    return F.format_string("%.2f%%", (_col(similarity).cast("float") * F.lit(100).cast("float")).cast("double"))


def indent(depth: Column | str) -> Column:
    return F.repeat(F.lit("  "), _col(depth))


def at_least(similarity: Column | str, threshold: float) -> Column:
    """similarity >= threshold in single precision; NaN is below any threshold."""
    s = _col(similarity).cast("float")
    return ~F.isnan(s) & (s >= F.lit(threshold).cast("float"))


def pair_key(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """The canonical (lesser, greater) order of a pair, by bytes."""
    return F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b))


def unit_name(language: str, file: Column | str, parent: Column | str | None, name: Column | str) -> Column:
    head = F.concat(F.lit(f"{language}:"), _col(file), F.lit("::"))
    if parent is None:
        return F.concat(head, _col(name))
    return F.concat(head, F.coalesce(F.concat(_col(parent), F.lit("::")), F.lit("")), _col(name))


def pair_status(value: Column | str) -> Column:
    """A stored status; unknown ones read as new."""
    from larkspar.schemas import PAIR_STATUSES

    return F.when(_col(value).isin(*PAIR_STATUSES), _col(value)).otherwise("new")
