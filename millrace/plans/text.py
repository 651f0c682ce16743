"""Queries over text files, templates and properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as fx
from millrace.functions.jsons import beautified_json
from millrace.operators.objects import clone_plan
from millrace.plans.bindings import BODIES_SQL, FILES_SQL, files, json_bodies
from millrace.plans.registry import query, table

LINES = "regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')"


@query("line_contains", """
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'the of'))) > 0 AS found
FROM documents
""")
def line_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.has_line_with(F.col("text"), "the of").alias("found"))


@query("line_remove", f"""
SELECT doc_id, array_to_string(list_filter({LINES}, lambda l: NOT contains(l, 'the')), '') AS text FROM documents
""")
def line_remove(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.without_lines_with(F.col("text"), "the").alias("text")
    )


@query("line_prepend", """
SELECT doc_id, CASE WHEN contains(text, 'that') THEN text ELSE 'that' || chr(10) || text END AS once,
       'that' || chr(10) || text AS always
FROM documents
""")
def line_prepend(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        fx.with_first_line(text, "that").alias("once"),
        fx.with_first_line(text, "that\r\n", once=False).alias("always"),
    )


@query("extract_tokens", """
SELECT doc_id, CAST(len(regexp_extract_all(t, '#([^#]*)#', 1)) AS INTEGER) AS n_tokens,
       array_to_string(regexp_extract_all(t, '#([^#]*)#', 1), '|') AS tokens
FROM (SELECT doc_id, '#lang# #source# ' || text AS t FROM documents)
""")
def extract_tokens(spark, sf_dir):
    tokens = fx.extract_tokens(F.concat(F.lit("#lang# #source# "), "text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, "|").alias("tokens")
    )


MARKED_SQL = f"""
marked AS (
  SELECT doc_id, lang, source, list_transform({LINES}, lambda l: '#lang# #source# ' || l) AS marked_lines
  FROM documents
)
"""


def _templates(spark, sf_dir):
    """Each line of a document behind two tokens, and the variables to fill them."""
    marked = F.array_join(
        F.transform(fx.text_lines(F.col("text")), lambda line: F.concat(F.lit("#lang# #source# "), line)), ""
    )
    variables = F.array(
        F.struct(F.lit("#lang#").alias("k"), F.concat(F.lit("#code#-"), "lang").alias("v")),
        F.struct(F.lit("#source#").alias("k"), F.col("source").alias("v")),
        F.struct(F.lit("#code#").alias("k"), F.lit("l").alias("v")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("text"), variables.alias("variables"))


@query("template_render", f"""
WITH {MARKED_SQL}
SELECT doc_id, array_to_string(list_transform(marked_lines,
         lambda l: replace(replace(replace(l, '#lang#', '#code#-' || lang), '#source#', source), '#code#', 'l')), '')
         AS text
FROM marked
""")
def template_render(spark, sf_dir):
    return _templates(spark, sf_dir).select("doc_id", fx.render_text(F.col("text"), F.col("variables")).alias("text"))


@query("rendered_sink", f"""
WITH {MARKED_SQL}, {FILES_SQL}
SELECT replace(path, '.tmpl', '') AS path,
       replace(replace(replace(array_to_string(marked_lines, ''), '#lang#', '#code#-' || lang), '#source#', source),
               '#code#', 'l') AS text
FROM marked JOIN files USING (doc_id) WHERE ends_with(path, '.tmpl')
""")
def rendered_sink(spark, sf_dir):
    """The files a render would write: one row per template, no regrouping of lines."""
    paths = files(spark, sf_dir).select("doc_id", "path").where(F.col("path").endswith(".tmpl"))
    return (
        _templates(spark, sf_dir)
        .join(paths, "doc_id")
        .select(
            F.replace("path", F.lit(".tmpl"), F.lit("")).alias("path"),
            fx.render_text(F.col("text"), F.col("variables")).alias("text"),
        )
    )


@query("prop_render", """
WITH v AS (SELECT doc_id, lang, source, '"#lang#/#source#" ' || text AS value FROM documents),
t AS (SELECT *, list_filter(regexp_extract_all(value, '#([^#]*)#', 1), lambda t: t NOT IN ('lang', 'source')) AS bad
      FROM v)
SELECT doc_id, array_to_string(bad, '|') AS unknown,
       CASE WHEN len(bad) = 0
            THEN replace(replace(replace(replace(value, 'lang', lang), 'source', source), '#', ''), '"', '') END AS value
FROM t
""")
def prop_render(spark, sf_dir):
    value = F.concat(F.lit('"#lang#/#source#" '), "text")
    lookup = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(fx.unknown_tokens(value, lookup), "|").alias("unknown"),
        fx.render_property(value, lookup).alias("value"),
    )


@query("prop_render_file", """
WITH flat AS (SELECT doc_id, lang, source, rtrim(ltrim(replace(replace(text, chr(10), ' '), '#', ''), ' '), ' ') AS note
              FROM documents)
SELECT doc_id, 'lang=' || lang || chr(10) || 'note=' || replace(replace(replace(note, 'lang', lang), 'source', source), '"', '')
       || ' ' || lang || '/' || source || chr(10) || chr(10) || chr(10) || '#  from ' || source || chr(10) AS text
FROM flat
""")
def prop_render_file(spark, sf_dir):
    """A properties template per document, the whole text as one of its values."""
    flat = F.trim(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("#"), F.lit("")))
    template = F.concat(
        F.lit('lang="#lang#"\n\nnote='), flat, F.lit(" #lang#/#source#\n# from "), "source", F.lit("\n")
    )
    lookup = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", fx.render_property_text(template, lookup).alias("text"))


def _property_text():
    """Three lines of properties per document, the first note holding its whole text in one line."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    return F.concat(
        F.lit("lang="), "lang", F.lit("\nnote="), flat, F.lit("\n# from "), "source"
    )


@query("properties_source", """
WITH flat AS (SELECT doc_id, lang, source, rtrim(ltrim(replace(text, chr(10), ' '), ' '), ' ') AS note FROM documents)
SELECT doc_id, unnest([0, 1, 2]) AS seq, unnest(['lang', 'note', NULL]) AS key,
       unnest([lang, note, 'from ' || source]) AS value, unnest([false, false, true]) AS is_comment
FROM flat
""")
def properties_source(spark, sf_dir):
    parsed = F.transform(F.split(_property_text(), "\n"), fx.parse_property)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(parsed).alias("seq", "prop"))
        .select("doc_id", "seq", "prop.key", F.trim("prop.value").alias("value"), "prop.is_comment")
    )


@query("properties_append", """
SELECT doc_id, text || '# added' || chr(10) || 'lang=' || lang || chr(10)
       || CASE WHEN doc_id % 2 = 0 THEN 'source=' || source || chr(10) ELSE '' END AS text
FROM documents
""")
def properties_append(spark, sf_dir):
    props = F.array(
        F.struct(F.lit("lang").alias("k"), F.col("lang").alias("v")),
        F.struct(F.lit("source").alias("k"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("v")),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.append_properties(F.col("text"), props, "added").alias("text")
    )


@query("properties_append_file", """
SELECT doc_id, text || 'lang=' || lang || chr(10) || chr(10) || chr(10) || '#  from ' || source || chr(10) AS text
FROM documents
""")
def properties_append_file(spark, sf_dir):
    addition = F.concat(F.lit("lang="), "lang", F.lit("\n# from "), "source", F.lit("\n"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.append_property_text(F.col("text"), addition).alias("text")
    )


@query("replace_last", """
SELECT doc_id, CASE WHEN len(parts) = 1 THEN text
                    ELSE array_to_string(parts[:-2], 'the') || 'THE' || parts[-1] END AS text
FROM (SELECT doc_id, text, string_split(text, 'the') AS parts FROM documents)
""")
def replace_last(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.replace_last(F.col("text"), "the", "THE").alias("text")
    )


@query("rename_copy", f"""
WITH {FILES_SQL}
SELECT path, replace(replace(replace(path, '/en/', '/tongue/'), 'en-', 'tongue-'), 'en_', 'tongue_') AS new_path,
       replace(text, 'en', 'tongue') AS new_text
FROM files
WHERE NOT ends_with(path, '.conf') AND NOT ends_with(path, '1.txt')
  AND len(list_filter(string_split(path, '/')[:-2], lambda d: ends_with(d, 'egg-info') OR ends_with(d, 'cache'))) = 0
""")
def rename_copy(spark, sf_dir):
    plan = clone_plan(files(spark, sf_dir), "en", "tongue", ["egg-info", "cache"], [".conf", "1.txt"])
    return plan.select("path", "new_path", fx.rename_text(F.col("text"), "en", "tongue").alias("new_text"))


@query("rename_copy_root", f"""
WITH {FILES_SQL},
below AS (SELECT *, substr(path, 6) AS rel FROM files WHERE starts_with(path, 'src1/'))
SELECT path, 'clone/src1/' || substr(replace(replace(replace('/' || rel, '/en/', '/tongue/'), 'en-', 'tongue-'), 'en_', 'tongue_'), 2) AS new_path,
       replace(text, 'en', 'tongue') AS new_text
FROM below WHERE NOT ends_with(path, '.conf') AND len(list_filter(string_split(rel, '/')[:-2], lambda d: ends_with(d, 'egg-info'))) = 0
""")
def rename_copy_root(spark, sf_dir):
    """Clone the tree below one source to another root."""
    plan = clone_plan(files(spark, sf_dir), "en", "tongue", ["egg-info"], [".conf"], "src1", "clone/src1/")
    return plan.select("path", "new_path", fx.rename_text(F.col("text"), "en", "tongue").alias("new_text"))


@query("env_lookup", """
SELECT doc_id, lang, source AS cut, source || '=x=' || regexp_replace(text, '\\n', ' ', 'g') AS whole,
       CAST(NULL AS VARCHAR) AS absent
FROM documents
""")
def env_lookup(spark, sf_dir):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    lines = F.array(
        F.lit("plain"),
        F.concat(F.lit("LANG="), "lang"),
        F.concat(F.lit("SRC="), "source", F.lit("=x="), flat),
        F.lit("LANG=second"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        fx.env_value(lines, "LANG").alias("lang"),
        fx.env_value(lines, "SRC").alias("cut"),
        fx.env_value(lines, "SRC", keep_rest=True).alias("whole"),
        fx.env_value(lines, "HOME").alias("absent"),
    )


@query("json_beautify", f"""
WITH {BODIES_SQL}
SELECT replace(path, '.json', '') || '_pretty.json' AS path,
       CASE WHEN json_valid(body)
            THEN '{{' || chr(10) || '    "k": ' || (body::JSON->>'k') || chr(10) || '}}' ELSE body END AS body
FROM bodies
""")
def json_beautify(spark, sf_dir):
    return json_bodies(spark, sf_dir).select(
        F.concat(F.replace("path", F.lit(".json"), F.lit("")), F.lit("_pretty.json")).alias("path"),
        beautified_json(F.col("body")).alias("body"),
    )
