"""Licence notices in texts by a positional index of their rarest words, with DataFrame functions only.

Each template is a short notice with mandatory phrases. Its rarest mandatory words, by document frequency over the whole table, are
its index words: a posting is (word, template, position). In a text, an index word at word i with a posting at position q puts the
template's start at i - q; starts on which the postings of all of a template's index words agree are candidates. A
candidate counts if every word of the mandatory phrases stands in its place. As index words are mandatory words, no place that
fulfils a template is missed, whatever the frequencies are. The score is the share of the template's IDF weight found in place.

Everything happens inside a row, so no text is shuffled; what travels is the document frequency of the templates' own words.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase.llm.frames import table

# Runs of these separate words; A-Z counts as a-z.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Index words of a template; postings of all of them have to agree on the template's start.
RARE = 2
PLACES = 6

# ---- fixed values: phrases of the contract and their labels
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# ---- fixed values: excerpts of public licence texts, (label, words of the notice, mandatory phrases of it)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "with or without fee")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
     ("neither the name of", "to endorse or promote products")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ("except in compliance with the license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     ("this program is free software",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("boost-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
     ("in no event will the authors be held liable",)),
    ("cc0-1.0", "creative commons zero v1 0 universal", ("creative commons zero",)),
    ("cc-by", "licensed under cc by 4 0", ("under cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("under cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("under cc by nc",)),
    ("cc-by", "this work is licensed under a creative commons attribution license", ("creative commons attribution",)),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    must: tuple[bool, ...]
    base: bool


def _template(label: str, notice: str, phrases: tuple[str, ...], base: bool = False) -> Template:
    words = tuple(notice.split())
    must = [False] * len(words)
    for phrase in phrases:
        part = tuple(phrase.split())
        at = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
        must[at:at + len(part)] = [True] * len(part)
    return Template(label, words, tuple(must), base)


TEMPLATES = (
    *(_template(label, phrase, (phrase,), True) for phrase, label in BASE),
    *(_template(label, notice, phrases) for label, notice, phrases in NOTICES),
)


def words(text: Column) -> Column:
    """The words of a text in their own case. A-Z may be lower-cased later, as no separator is a letter."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda w: w != "")


def _plain(word: Column) -> Column:
    """The word with A-Z lower-cased, or NULL if it has other letters than ASCII, which no template has."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word))


def weights(split: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """The IDF weight of every word of the templates over all rows of ``split`` (column ``words``): one row a template word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array_distinct(F.filter(F.transform("words", _plain), lambda w: w.isin(*vocabulary)))
    counted = {r.w: r.n for r in split.select(F.explode(known).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rows = split.count()
    return {w: log((1 + rows) / (1 + counted.get(w, 0))) + 1 for w in vocabulary}


def index(templates: tuple[Template, ...], weight: dict[str, float]) -> list[dict[str, list[tuple[int, int]]]]:
    """Postings {word: [(template, position)]}, one table for the rarest mandatory word of each template, one for the next, and so on."""
    tables: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(RARE)]
    for number, template in enumerate(templates):
        places = sorted((i for i, must in enumerate(template.must) if must), key=lambda i: (-weight[template.words[i]], i))
        for rank in range(RARE):
            # A template with fewer mandatory words than RARE is looked up by its rarest one again.
            at = places[min(rank, len(places) - 1)]
            tables[rank].setdefault(template.words[at], []).append((number, at))
    return tables


def _literal_lists(values) -> Column:
    return F.array(*[F.array(*[F.lit(v) for v in row]) for row in values])


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: n_words, places of the base phrases, labels, score, and the places of all fulfilled templates as ``places``.

    A null or empty text has no words and no labels; a null id and repeated rows keep their own result rows; other columns of ``docs``
    are ignored, whatever their names. A text of any length is scanned whole, in time linear in its words and its hits. An empty table gives no rows.
    """
    split = docs.select(F.col(id_column).alias("doc_id"), words(F.col(text_column)).alias("words"))
    weight = weights(split, templates)
    tables = index(templates, weight)
    longest, size = max(len(t.words) for t in templates), len(templates)
    looked_up = sorted({w for postings in tables for w in postings})

    def starts(postings: dict[str, list[tuple[int, int]]]) -> Column:
        """Every start that a hit proposes, as (start + longest) * size + template; it may lie before the text."""
        pairs = F.create_map(*[c for w, found in sorted(postings.items()) for c in (
            F.lit(w), F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(q).cast("long").alias("q")) for t, q in found]))])
        empty = F.array().cast("array<struct<t:bigint,q:bigint>>")
        return F.flatten(F.transform("hits", lambda h: F.transform(
            F.coalesce(F.try_element_at(pairs, h["w"]), empty), lambda p: (h["i"] - p["q"] + longest) * size + p["t"])))

    def agreed() -> Column:
        found = starts(tables[0])
        for postings in tables[1:]:
            found = F.array_intersect(found, starts(postings))
        return F.array_distinct(found)

    hits = F.array_compact(F.transform("words", lambda w, i: F.when(_plain(w).isin(*looked_up), F.struct(_plain(w).alias("w"), i.cast("long").alias("i")))))
    template_words = _literal_lists(t.words for t in templates)
    template_must = _literal_lists(t.must for t in templates)
    template_weights = _literal_lists([weight[w] for w in t.words] for t in templates)
    totals = F.array(*[F.lit(sum(weight[w] for w in t.words)) for t in templates])

    def judged(code: Column) -> Column:
        number, start = (code % size).cast("int"), F.floor(code / size) - longest
        in_place = F.transform(F.get(template_words, number), lambda w, j: F.coalesce(_plain(F.get(F.col("words"), (start + j).cast("int"))) == w, F.lit(False)))
        return F.struct(number.alias("template"), start.alias("start"), in_place.alias("in_place"))

    def fulfilled(place: Column) -> Column:
        return F.forall(F.zip_with(F.get(template_must, place["template"]), place["in_place"], lambda must, there: ~must | there), lambda ok: ok)

    def scored(place: Column) -> Column:
        found = F.aggregate(F.zip_with(F.get(template_weights, place["template"]), place["in_place"], lambda x, there: F.when(there, x).otherwise(F.lit(0.0))),
                            F.lit(0.0), lambda a, b: a + b)
        return F.struct(place["template"].alias("template"), place["start"].alias("start"), F.least(F.lit(1.0), found / F.get(totals, place["template"])).alias("share"))

    labels = F.array(*[F.lit(t.label) for t in templates])
    base = F.array(*[F.lit(t.base) for t in templates])
    found = (
        split.select("doc_id", "words", hits.alias("hits"))
        .select("doc_id", "words", agreed().alias("codes"))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform("codes", judged).alias("judged"))
        .select("doc_id", "n_words", F.transform(F.filter("judged", fulfilled), scored).alias("places"))
        .withColumn("base_places", F.filter("places", lambda p: F.get(base, p["template"])))
    )

    def named(places: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(labels, p["template"])))), ",")

    return found.select(
        "doc_id", "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places.start").alias("first_word"),
        F.array_max("base_places.start").alias("last_word"),
        named("base_places").alias("base_labels"),
        named("places").alias("labels"),
        F.round(F.coalesce(F.array_max("places.share"), F.lit(0.0)), PLACES).alias("score"),
        "places",
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all ``documents``."""
    return scan(table(spark, sf_dir, "documents")).drop("places")



OP12_SQL = rf"""
WITH templates(t, label, base, q, w, must) AS (VALUES {", ".join(f"({n}, '{t.label}', {t.base}, {q}, '{w}', {t.must[q]})" for n, t in enumerate(TEMPLATES) for q, w in enumerate(t.words))}),
split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
flat AS (SELECT r, unnest(words) AS w, unnest(range(0, len(words))) AS i FROM split),
frequency AS (SELECT w, count(DISTINCT r) AS n FROM flat GROUP BY w),
weighted AS (SELECT t.*, ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(f.n, 0))) + 1 AS idf FROM templates t LEFT JOIN frequency f USING (w)),
totals AS (SELECT t, sum(idf) AS total, count(*) FILTER (must) AS n_must FROM weighted GROUP BY t),
placed AS (SELECT f.r, x.t, f.i - x.q AS start, sum(x.idf) AS found, count(*) FILTER (x.must) AS n_must, any_value(x.label) AS label, any_value(x.base) AS base
  FROM flat f JOIN weighted x ON x.w = f.w GROUP BY 1, 2, 3),
places AS (SELECT p.*, least(1.0, p.found / o.total) AS share FROM placed p JOIN totals o ON o.t = p.t AND o.n_must = p.n_must)
SELECT s.doc_id, len(s.words) AS n_words, count(*) FILTER (p.base) AS n_base, min(p.start) FILTER (p.base) AS first_word, max(p.start) FILTER (p.base) AS last_word,
  coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label) FILTER (p.base), '') AS base_labels, coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label), '') AS labels,
  round(coalesce(max(p.share), 0), {PLACES}) AS score
FROM split s LEFT JOIN places p ON p.r = s.r GROUP BY s.r, s.doc_id, s.words"""
