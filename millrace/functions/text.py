"""Column helpers over lines, templates, properties and paths.

A text is one row, so every helper works inside its row: no shuffle, no
regrouping of lines, and the whole text is always processed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_lines(text: Column) -> Column:
    """The lines of a text, each with its own line end kept."""
    return F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))


def has_line_with(text: Column, fragment: str) -> Column:
    """Whether a line holds the fragment; without a line end in it, the whole text tells."""
    if "\n" not in fragment:
        return text.contains(fragment)
    return F.exists(text_lines(text), lambda line: line.contains(fragment))


def without_lines_with(text: Column, fragment: str) -> Column:
    """The text less every line that holds the fragment."""
    if "\n" not in fragment:
        return F.regexp_replace(text, f"(?dm)^[^\n]*{like_literal(fragment)}[^\n]*\n?", "")
    return F.array_join(F.filter(text_lines(text), lambda line: ~line.contains(fragment)), "")


def with_first_line(text: Column, line: str, once: bool = True) -> Column:
    """Put a line on top; with ``once``, only where no line holds it yet."""
    longer = F.concat(F.lit(line.rstrip("\r\n") + "\n"), text)
    return F.when(has_line_with(text, line), text).otherwise(longer) if once else longer


def extract_tokens(text: Column, delimiter: str = "#") -> Column:
    """What stands between the 1st and 2nd delimiter, the 3rd and 4th, and so on."""
    if len(delimiter) != 1:
        raise ValueError("the delimiter is a single character")
    d = delimiter if delimiter.isalnum() else "\\" + delimiter
    return F.regexp_extract_all(text, F.lit(f"{d}([^{d}]*){d}"), F.lit(1))


def render_line(line: Column, variables: Column) -> Column:
    """Replace ``(k, v)`` variables in list order while a ``#`` is left."""
    return F.aggregate(
        variables,
        line,
        lambda acc, var: F.when(
            acc.contains("#"), F.replace(acc, var["k"], F.coalesce(var["v"], F.lit("None")))
        ).otherwise(acc),
    )


def render_text(text: Column, variables: Column) -> Column:
    """``render_line`` on each line of a whole text.

    Where every variable name holds a ``#`` and none a line end, a line without
    ``#`` cannot change, so the text is rendered in one piece.
    """
    whole = F.forall(variables, lambda var: var["k"].contains("#") & ~var["k"].contains("\n"))
    by_line = F.array_join(F.transform(text_lines(text), lambda line: render_line(line, variables)), "")
    return F.when(whole, render_line(text, variables)).otherwise(by_line)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unknown_tokens(value: Column, lookup: Column) -> Column:
    """Tokens of a property value that the lookup map does not know."""
    return F.filter(extract_tokens(value), lambda t: ~F.map_contains_key(lookup, t))


def render_property(value: Column, lookup: Column, strict: bool = False) -> Column:
    """Fill a property value from a lookup map.

    The bare token text is replaced wherever it stands in the value, then all
    ``#`` and ``"`` go. An unknown token gives NULL, or an error if ``strict``.
    """
    def fill(tokens: Column) -> Column:
        filled = F.aggregate(tokens, value, lambda acc, token: F.replace(acc, token, F.try_element_at(lookup, token)))
        bad = F.filter(tokens, lambda t: ~F.map_contains_key(lookup, t))
        if strict:
            message = F.concat(F.lit("unknown token: "), F.array_join(bad, ", "))
            return F.when(F.size(bad) > 0, F.raise_error(message).cast("string")).otherwise(filled)
        return F.when(F.size(bad) == 0, filled)

    filled = let(extract_tokens(value), fill)
    plain = F.when(value.contains("#"), F.replace(filled, F.lit("#"), F.lit(""))).otherwise(value)
    return F.replace(plain, F.lit('"'), F.lit(""))


def replace_last(text: Column, sub: str, rep: str = "") -> Column:
    """Replace the last occurrence only; unchanged if there is none."""
    if not sub:
        return text
    tail = F.substring_index(text, sub, -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail) - len(sub))
    return F.when(text.contains(sub), F.concat(head, F.lit(rep), tail)).otherwise(text)


def env_value(lines: Column, name: str, keep_rest: bool = False) -> Column:
    """Value of the first ``NAME=value`` line; cut at a second ``=`` by default."""
    first = F.get(F.filter(lines, lambda line: line.startswith(f"{name}=")), F.lit(0))
    value = F.substring(first, F.lit(len(name) + 2), F.length(first))
    return value if keep_rest else F.substring_index(value, "=", 1)


# Fixed values of the properties format: an entry's key, the separator, and the value.
ENTRY = r"(?s)^[ \t\f]*((?:\\.|[^\\=:\s])*+)(?:[ \t\f]*[=:][ \t\f]*|[ \t\f]+|\z)(.*)$"


# Fixed value: a logical line, that is a comment up to its line end, or an entry over all its escaped line ends.
LOGICAL_LINE = r"(?s)([ \t\f]*+[#!][^\r\n]*+|(?:\\(?:\r\n|.|\z)|[^\\\r\n]++)++)"


def property_lines(text: Column) -> Column:
    """Entries and comments of a properties text: continued lines joined, blank ones left out."""
    lines = F.regexp_extract_all(text, F.lit(LOGICAL_LINE), F.lit(1))
    joined = F.transform(lines, lambda line: F.regexp_replace(line, r"(?<!\\)((?:\\\\)*+)\\(?:\r\n|\n|\r)[ \t\f]*+", "$1"))
    return F.filter(joined, lambda line: line.rlike(r"\S"))


def unescape_property(text: Column) -> Column:
    """Escapes of keys and values; runs of ``\\uXXXX`` are read together, as pairs may form one character."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)((?:\\u[0-9a-fA-F]{4})+|\\.|[^\\]++|\\\z)"), F.lit(1))

    def plain(piece: Column) -> Column:
        code = F.decode(F.unhex(F.replace(piece, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        named = F.when(piece == "\\t", "\t").when(piece == "\\n", "\n").when(piece == "\\r", "\r").when(piece == "\\f", "\f")
        return F.when(piece.rlike(r"^\\u[0-9a-fA-F]{4}"), code).when(piece.startswith("\\"), F.coalesce(named, F.substring(piece, 2, 1))).otherwise(piece)

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def parse_property(line: Column) -> Column:
    """``struct<key, value, is_comment>`` of one properties line; a bare key has an empty value."""
    comment = line.rlike(r"^[ \t\f]*[#!]")
    note = F.regexp_extract(line, r"(?s)^[ \t\f]*[#!]\s*(.*)$", 1)
    return F.struct(
        F.when(~comment, unescape_property(F.regexp_extract(line, ENTRY, 1))).alias("key"),
        F.when(comment, note).otherwise(unescape_property(F.regexp_extract(line, ENTRY, 2))).alias("value"),
        comment.alias("is_comment"),
    )


def append_properties(text: Column, props: Column, comment: str | None = None) -> Column:
    """Append ``(k, v)`` entries as lines; entries without a value are skipped."""
    head = "" if comment is None else f"# {comment}\n"
    rows = F.transform(
        F.filter(props, lambda p: p["v"].isNotNull()),
        lambda p: F.concat(p["k"], F.lit("="), p["v"], F.lit("\n")),
    )
    return F.concat(text, F.lit(head), F.array_join(rows, ""))


def append_property_text(text: Column, addition: Column) -> Column:
    """Append a second properties text, its comments kept and reformatted."""
    rows = F.transform(property_lines(addition), lambda line: _property_line(parse_property(F.rtrim(line))))
    return F.concat(text, F.array_join(rows, ""))


def render_property_text(text: Column, lookup: Column) -> Column:
    """A properties template as its instance: values filled, comments reformatted.

    NULL if a value names a token the lookup map does not know.
    """
    rendered = F.transform(F.transform(property_lines(text), parse_property), lambda prop: _rendered_line(prop, lookup))
    return let(rendered, lambda lines: F.when(~F.exists(lines, lambda line: line.isNull()), F.array_join(lines, "")))


def _rendered_line(prop: Column, lookup: Column) -> Column:
    value = F.when(prop["is_comment"], prop["value"]).otherwise(render_property(prop["value"], lookup))
    return _property_line(F.struct(prop["key"].alias("key"), value.alias("value"), prop["is_comment"].alias("is_comment")))


def _property_line(prop: Column) -> Column:
    return F.when(
        prop["is_comment"], F.concat(F.lit("\n\n#  "), prop["value"], F.lit("\n"))
    ).otherwise(F.concat(prop["key"], F.lit("="), prop["value"], F.lit("\n")))


# Fixed values of the report format, a YAML scalar after a name on one line: quoted or plain, a note behind it.
QUOTED = r"""'(?:[^']|'')*+'|"(?:[^"\\]|\\.)*+\""""
PLAIN = r"(?:[^:#]++|:(?=\S)|(?<=\S)#)*+"
NOTE = r"(?:(?<=\s)#.*)?"
ACTION = rf"""^\s*(?![-?](?:\s|$))({QUOTED}|[^\s:#'"\[\]{{}},&*!|>%@`]{PLAIN})\s*+:(?:\s+({QUOTED}|(?![#'"&*!|>%@`]){PLAIN}))?\s*{NOTE}\s*$"""
ONE_LINE_MAP = r"^\s*\{(.*)\}\s*(?:\s#.*)?$"
MAP_ENTRY = rf"""({QUOTED}|[^,:{{}}\[\]'"\s][^,:{{}}\[\]]*+)\s*:\s+({QUOTED}|[^,{{}}\[\]'"]*+)(?:,|$)"""


def yaml_scalar(text: Column) -> Column:
    """A scalar as text: without its quotes, NULL where it is empty or null."""
    bare = F.trim(text)
    single = F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit("''"), F.lit("'"))
    double = unescape_property(F.substring(bare, F.lit(2), F.length(bare) - 2))
    return (
        F.when((F.length(bare) > 1) & bare.startswith("'") & bare.endswith("'"), single)
        .when((F.length(bare) > 1) & bare.startswith('"') & bare.endswith('"'), double)
        .when(~bare.isin("", "~", "null", "Null", "NULL"), bare)
    )


def action_entries(line: Column) -> Column:
    """``array<struct<name, value>>`` of a report line: one of ``name: value``, all of a map on one line, none of any other line."""
    inside = F.regexp_extract(line, ONE_LINE_MAP, 1)

    def pair(text: Column, pattern: str) -> Column:
        return F.struct(
            F.coalesce(yaml_scalar(F.regexp_extract(text, pattern, 1)), F.lit("")).alias("name"),
            yaml_scalar(F.regexp_extract(text, pattern, 2)).alias("value"),
        )

    several = F.transform(F.regexp_extract_all(inside, F.lit(f"({MAP_ENTRY})"), F.lit(1)), lambda entry: pair(entry, MAP_ENTRY))
    every = F.when(line.rlike(ONE_LINE_MAP), several).otherwise(F.array(pair(line, ACTION)))
    return F.filter(every, lambda entry: entry["name"] != "")


def rename_path(path: Column, origin: str, target: str) -> Column:
    """Clone path: ``/origin/``, ``origin-`` and ``origin_`` become the target's."""
    for old, new in (
        (f"/{origin}/", f"/{target}/"),
        (f"{origin}-", f"{target}-"),
        (f"{origin}_", f"{target}_"),
    ):
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def rename_text(text: Column, origin: str, target: str) -> Column:
    return F.replace(text, F.lit(origin), F.lit(target))


def like_literal(text: str) -> str:
    """A string as a regular expression that matches only itself."""
    return re.escape(text)
