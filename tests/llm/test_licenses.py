import re

import pytest
from conftest_llm import ROWS, SCHEMA, rows

from wheelbase.llm import license_scan

CASES = [
    (500, "Released under the MIT License. Mit\n\tlicense; MIT-LICENSE, mit_license and mit  license", "en", "a", 1),
    (501, "mité license, mit licensé, MKT license, MİT License, mit no license", "en", "a", 1),
    (502, "Licensed under the Apache License, Version 2.0. " * 3 + "apache license", "en", "a", 1),
    (503, "This work is licensed under the GNU General Public License, version 3.", "en", "a", 1),
    (504, "Permission is hereby granted, free of charge, to any person who wants a copy", "en", "a", 1),
    (505, "person obtaining a copy of this software. Permission is hereby granted free of cost", "en", "a", 1),
    (506, "license " * 500 + "mit " * 500 + "license", "en", "a", 1),
    (507, "Licensed under CC BY-NC 4.0.", "en", "a", 1),
    (507, "Licensed under CC BY-NC 4.0.", "en", "a", 1),
    (508, "general public license general public license version 2 lesser general public license", "en", "a", 1),
    (509, "License, Version 2.0, Apache License", "en", "a", 1),
    (510, "the " * 20_000 + "mit license", "en", "a", 1),
    (511, "漢字 mit license 漢字mit license", "en", "a", 1),
]


def brute(table, templates):
    texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t[1] or "")) for t in table]
    weight = license_scan.log
    frequency = {w: sum(w in set(words) for words in texts) for t in templates for w in t.words}
    idf = {w: weight((1 + len(table)) / (1 + n)) + 1 for w, n in frequency.items()}
    out = []
    for row, words in zip(table, texts):
        base, every, best = [], [], 0.0
        for t in templates:
            for start in range(-len(t.words), len(words)):
                there = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(t.words)]
                if all(ok for ok, must in zip(there, t.must) if must):
                    every.append(t.label)
                    if t.base:
                        base.append((start, t.label))
                    best = max(best, sum(idf[w] for w, ok in zip(t.words, there) if ok) / sum(idf[w] for w in t.words))
        starts = [s for s, _ in base]
        out.append((row[0], len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({label for _, label in base})), ",".join(sorted(set(every))), pytest.approx(best, abs=1e-6)))
    return out


COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def in_order(found):
    return sorted(found, key=lambda r: repr(r[:-1]))


def test_places_labels_and_scores_equal_brute_force(spark):
    table = [*ROWS, *CASES]
    got = in_order(tuple(r) for r in license_scan.scan(spark.createDataFrame(table, SCHEMA)).select(*COLUMNS).collect())
    assert got == in_order(brute(table, license_scan.TEMPLATES))
    labels = {r[0]: r[6] for r in got}
    assert labels[504] == "mit" and labels[505] == "" and labels[507] == "cc-by-nc" and labels[503] == "gpl,gpl-3.0" and labels[501] == ""


def test_which_words_are_rare_changes_no_place(spark):
    """The rarest words of the table decide what is looked up, not what is found."""
    padding = [(i, "mit apache general public version permission hereby", "en", "a", 1) for i in range(1000, 1030)]
    for table in (CASES, [*CASES, *padding]):
        frame = spark.createDataFrame(table, SCHEMA)
        got = {tuple(r) for r in license_scan.scan(frame).filter("doc_id < 1000").select(*COLUMNS[:-1]).collect()}
        assert got == {r[:-1] for r in brute(CASES, license_scan.TEMPLATES)}
    rare = license_scan.index(license_scan.TEMPLATES, {w: float(len(w)) for t in license_scan.TEMPLATES for w in t.words})
    assert len(rare) == license_scan.RARE and all(sum(map(len, r.values())) == len(license_scan.TEMPLATES) for r in rare)


def test_clashing_columns_and_no_rows(docs, clashing, empty):
    more = clashing.selectExpr("*", "1 AS words", "2 AS hits", "3 AS codes", "4 AS places", "5 AS labels")
    assert rows(license_scan.scan(more)) == rows(license_scan.scan(docs))
    assert rows(license_scan.scan(empty)) == []


def test_the_plan_holds_no_python(docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
