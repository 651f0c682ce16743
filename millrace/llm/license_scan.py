"""License scans with DataFrame functions only.

The templates' key phrases form a positional index: word -> (template, place
in the template). Of each key phrase only the two words that are rarest in the
corpus are looked up. For each text, the places of those words minus their
places in the template give relative positions; a template stays a candidate
where both of its rare words agree on one. There the whole key phrase is
compared, and the score is the share of the template's words that stand where
they should.

Defined results: a null or empty text has no words, no labels and score 0;
first and last place are null without a base phrase; ids may be null or
repeated, each row is scanned by itself; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of words, in the order of the code points.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    label: str
    key: str  # mandatory phrase
    text: str  # contains the key
    base: bool = False


# Phrases of public licences.
TEMPLATES = [
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("mit", "released under the mit license", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache", "licensed under the apache license", "licensed under the apache license version 2 0"),
    Template("gpl", "gnu general public license", "licensed under the gnu general public license version 3"),
    Template("gpl", "gnu gpl", "licensed under the gnu gpl"),
    Template("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("bsd", "bsd license", "released under the bsd license"),
    Template("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Template("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    Template("isc", "copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    Template("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    Template("cc0", "cc0 1 0", "cc0 1 0 universal"),
    Template("cc", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
]


def lowered(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BREAK), "")


def document_frequencies(docs: DataFrame, text_col: str = "text", templates: list[Template] = TEMPLATES) -> dict[str, int]:
    """In how many texts each word of the key phrases occurs: a few numbers, counted over all texts."""
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    found = F.explode(F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))).alias("word")
    counted = {r.word: r.n for r in docs.select(found).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def rare_places(template: Template, frequencies: dict[str, int]) -> list[int]:
    """Places, in the key phrase, of its two words with the highest IDF."""
    key = template.key.split()
    return sorted(sorted(range(len(key)), key=lambda i: (frequencies.get(key[i], 0), i))[:2])


def _literal(values: list) -> Column:
    return F.array(*[_literal(v) if isinstance(v, list) else F.lit(v) for v in values])


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES, frequencies: dict[str, int] | None = None,
) -> DataFrame:
    """``id, n_words, matches``: each match has the template's number, label, base flag, first word and score.

    ``frequencies`` may be given to save the counting pass; they change what is looked up, never what is found.
    """
    if frequencies is None:
        frequencies = document_frequencies(docs, text_col, templates)
    postings: dict[str, list[tuple[int, int, int]]] = {}
    for t, template in enumerate(templates):
        key = template.key.split()
        for k, place in enumerate(rare_places(template, frequencies)):
            postings.setdefault(key[place], []).append((t, place, k))
    rare = sorted(postings)
    index = F.create_map(*[
        x for w in rare for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(k).alias("k")) for t, p, k in postings[w]]))
    ])
    keys = _literal([t.key.split() for t in templates])
    texts = _literal([t.text.split() for t in templates])
    offsets = _literal([f" {t.text} ".partition(f" {t.key} ")[0].count(" ") for t in templates])
    labels, bases = _literal([t.label for t in templates]), _literal([t.base for t in templates])

    # a necessary condition that needs no words: some template's two rare words stand somewhere in the text
    pairs = [[t.key.split()[i] for i in rare_places(t, frequencies)] for t in templates]
    text = F.col("_text")
    anchor = [min(p, key=lambda w: frequencies.get(w, 0)) for p in pairs]
    maybe = F.lit(False)
    if anchor:
        maybe = text.rlike("(?i)(?<![0-9a-z])(?:" + "|".join(sorted(set(anchor))) + ")(?![0-9a-z])")

    step = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    step = step.select("id", F.regexp_count("_text", F.lit(WORD)).cast("long").alias("n_words"), F.when(maybe, words_of(text)).alias("_words"))
    places = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(rare))
    step = step.withColumn("_hits", places)
    relative = F.flatten(F.transform(
        "_hits", lambda h: F.transform(F.element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("r"), p["k"].alias("k")))
    ))
    step = step.withColumn("_relative", F.array_sort(relative))

    def agrees(c: Column, i: Column) -> Column:
        following = F.get(F.col("_relative"), i + 1)
        return F.when((c["k"] == 0) & (following["t"] == c["t"]) & (following["r"] == c["r"]), F.struct(c["t"].alias("t"), c["r"].alias("r")))

    step = step.withColumn("_candidates", F.filter(F.transform("_relative", agrees), lambda c: c.isNotNull() & (c["r"] >= 0)))
    verified = F.filter(
        "_candidates", lambda c: F.slice(F.col("_words"), c["r"] + 1, F.size(F.get(keys, c["t"]))) == F.get(keys, c["t"])
    )

    def scored(c: Column) -> Column:
        whole = F.get(texts, c["t"])
        equal = F.size(F.filter(whole, lambda w, j: _at(c["r"] - F.get(offsets, c["t"]) + j) == w))
        return F.struct(
            c["t"].alias("template"), F.get(labels, c["t"]).alias("label"), F.get(bases, c["t"]).alias("base"),
            c["r"].cast("long").alias("first_word"), (equal / F.size(whole)).alias("score"),
        )

    def _at(i: Column) -> Column:
        return F.when(i >= 0, F.get(F.col("_words"), i))

    return step.withColumn("_verified", verified).select("id", "n_words", F.coalesce(F.transform("_verified", scored), F.array()).alias("matches"))
