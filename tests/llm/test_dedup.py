import hashlib
import re
from collections import Counter

import numpy as np
from conftest_llm import ROWS, rows

from wheelbase.llm import byte_repeats, line_dedup, near_dedup, unit_dedup
from wheelbase.llm.frames import versions

WITH_ID = [r for r in ROWS if r[0] is not None]


def words(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(table, k, percent):
    sets = {i: shingles(t, k) for i, t in table}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] < label[b]:
                    label[b], changed = label[a], True
    return sets, label


def test_near_duplicates_equal_brute_force(docs, clashing):
    for k, percent in ((3, 85), (5, 80)):
        sets, label = brute_components([(r[0], r[1]) for r in WITH_ID], k, percent)
        want = sorted(((r[0], len(sets[r[0]]), label[r[0]], label[r[0]] == r[0]) for r in WITH_ID), key=repr)
        assert rows(near_dedup.near_duplicates(docs, k, percent), "doc_id", "n_shingles", "component_id", "kept") == want
    assert rows(near_dedup.near_duplicates(clashing, 3, 85)) == rows(near_dedup.near_duplicates(docs, 3, 85))


def test_a_chain_and_a_family_of_copies_keep_all_links(spark):
    base = [f"w{i}" for i in range(120)]
    family = [(i, " ".join(w if n % 40 != i % 40 or i == 500 else f"new{i}" for n, w in enumerate(base))) for i in [500, *range(300, 340)]]
    chain = [(i, " ".join(f"c{n}" for n in range(i - 700, i - 700 + 130))) for i in range(700, 715)]
    made = near_dedup.near_duplicates(spark.createDataFrame(family + chain, "doc_id long, text string"), 3, 85)
    _, label = brute_components(family + chain, 3, 85)
    assert {r.doc_id: r.component_id for r in made.collect()} == label


def test_near_duplicates_of_nothing(empty):
    assert rows(near_dedup.near_duplicates(empty)) == []


def test_bands_reach_the_promised_recall():
    for threshold in (0.8, 0.85):
        n = near_dedup.bands_for(threshold)
        assert (1 - threshold**near_dedup.ROWS_PER_BAND) ** n <= near_dedup.MISS


def brute_lines(table):
    blank = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for i, text in table:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(blank).translate(lower), set()).add(i)
    out = []
    for i, text in table:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(blank).translate(lower)) >= 40 and len(holders[k]) >= 5 and i != max(holders[k]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(docs, clashing, empty, folder, spark):
    want = brute_lines([(r[0], r[1]) for r in WITH_ID])
    assert any(r[2] for r in want)
    assert rows(line_dedup.op10(spark, folder)) == want
    made = line_dedup.deduplicate(clashing)
    assert made.select("row.*").columns == clashing.columns and made.count() == len(ROWS)
    assert rows(made.filter("row.doc_id is not null"), "row.doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert line_dedup.deduplicate(empty).count() == 0


def test_line_index_is_reversible(spark, docs):
    whole = docs.filter("doc_id is not null")
    part, extra = whole.filter("doc_id <= 12"), whole.filter("doc_id > 12")
    small = line_dedup.LineIndex.build(part)
    grown = small.insert(extra)
    assert rows(grown.counts) == rows(line_dedup.LineIndex.build(whole).counts)
    as_sets = lambda index: {r.doc_id: set(map(bytes, r["keys"])) for r in index.dropped().collect()}
    assert as_sets(grown) == as_sets(line_dedup.LineIndex.build(whole)) != {}
    back = grown.delete(extra.select("doc_id"))
    assert rows(back.counts) == rows(small.counts) and as_sets(back) == as_sets(small)
    assert rows(grown.insert(extra).counts) == rows(grown.counts)


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    made = line_dedup.CuckooFilter.build(keys)
    assert made.contains(keys).all()
    made.delete(keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01


def brute_bytes(table, n):
    texts = [(i, (t or "").encode()) for i, t in table]
    seen = Counter(b[j:j + n] for _, b in texts for j in range(len(b) - n + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            if seen[b[j:j + n]] > 1:
                gone[j:j + n] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_byte_repeats_equal_brute_force(docs, clashing, empty):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    table = [(r[0], r[1]) for r in WITH_ID]
    for n in (200, 37):
        assert rows(byte_repeats.repeated(docs, n), *columns) == brute_bytes(table, n)
    assert rows(byte_repeats.repeated(clashing), *columns) == brute_bytes(table, 200)
    assert byte_repeats.repeated(empty).count() == 0


def test_a_text_over_the_part_size_is_parsed_without_losing_a_window():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 1200, 1200, 1210, 5000])
    whole, cut = byte_repeats.parse(data, offsets, 50), byte_repeats.parse_long(data, offsets, 50, most=700)
    windows = lambda x: sorted(w for f, c in zip(x[0], x[1]) for w in range(f, f + c))
    assert windows(whole) == windows(cut) == [s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - 49)]


def cut_sentences(t):
    out, first, at = [], 0, 0
    while at < len(t):
        end = at
        if t[at] == "\n":
            end = at + 1
        elif at and t[at - 1] in ".!?":
            while end < len(t) and t[end] in " \t":
                end += 1
        if end > at:
            out.append((first, at))
            first = end
        at = max(end, at + 1)
    return [(a, b) for a, b in [*out, (first, len(t))] if t[a:b].strip()]


def brute_units(table, min_words, version):
    owner = {}
    for i, t in sorted({(i, t or "") for i, t in table}, key=lambda r: (r[0], version[r])):
        for n, (a, b) in enumerate(cut_sentences(t)):
            owner.setdefault(" ".join(t[a:b].lower().split()), (i, t, n))
    out = []
    for i, t in table:
        t, spans, gone, at = t or "", cut_sentences(t or ""), [], 0
        again = [owner[" ".join(t[a:b].lower().split())] != (i, t, n) for n, (a, b) in enumerate(spans)]
        while at < len(spans):
            end = at
            while end < len(spans) and again[end]:
                end += 1
            if end > at and sum(len(t[a:b].split()) for a, b in spans[at:end]) >= min_words:
                gone.append((spans[at][0], spans[end][0] if end < len(spans) else spans[-1][1], end - at))
            at = max(end, at + 1)
        kept = "".join(t[a:b] for a, b in zip([0, *[g[1] for g in gone]], [*[g[0] for g in gone], len(t)]))
        out.append((i, len(spans), sum(g[2] for g in gone), kept))
    return sorted(out, key=repr)


def test_unit_dedup_equals_brute_force(docs, clashing, empty):
    version = {(r.doc_id, r.text): r.version for r in versions(docs).collect()}
    want = brute_units([(r[0], r[1]) for r in WITH_ID], unit_dedup.MIN_WORDS, version)
    assert {r[0] for r in want if r[2]} >= {2, 9}
    assert rows(unit_dedup.deduplicate(docs), "doc_id", "n_units", "n_removed", "kept_text") == want
    assert rows(unit_dedup.deduplicate(clashing), "doc_id", "n_units", "n_removed", "kept_text") == want
    assert unit_dedup.deduplicate(empty).count() == 0
    assert unit_dedup.units("a\n\nb c\nd", "paragraph") == [(0, 1), (3, 8)]


SEVERAL = [
    (1, "common words here. a tail of doc one"),
    (2, "common words here. something else"),
    (2, "found in no other text. common words here"),
    (2, "found in no other text. common words here"),
    (2, "second place twice.\nsecond place twice."),
    (3, None),
    (3, "a tail of doc one\tand\nmore! common  WORDS here."),
]


def test_units_of_several_texts_under_one_id(spark):
    docs = spark.createDataFrame(SEVERAL, "doc_id long, text string")
    version = {(r.doc_id, r.text): r.version for r in versions(docs).collect()}
    made = unit_dedup.deduplicate(docs, min_words=1)
    assert rows(made, "doc_id", "n_units", "n_removed", "kept_text") == brute_units(SEVERAL, 1, version)
    kept = " ".join(r.kept_text for r in made.collect())
    assert all(" ".join(t[a:b].lower().split()) in " ".join(kept.lower().split()) for _, t in SEVERAL if t for a, b in cut_sentences(t))


def test_sets_of_several_texts_under_one_id(spark, folder):
    p, q, z = (" ".join(f"{c}{n}" for n in range(60)) for c in "pqz")
    table = [(1, p), (1, q), (1, q), (6, p + " yy"), (4, q + " x"), (7, z), (7, p), (7, None), (9, z), (None, p)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    named = [r for r in table if r[0] is not None]
    sets, label = brute_components(list(enumerate(t for _, t in named)), 3, 85)
    lowest = {}
    for n, c in label.items():
        lowest[c] = min(lowest.get(c, 10**9), named[n][0])
    want = sorted(((named[n][0], len(sets[n]), lowest[label[n]], lowest[label[n]] == named[n][0]) for n in label), key=repr)
    assert rows(near_dedup.near_duplicates(docs, 3, 85), "doc_id", "n_shingles", "component_id", "kept") == want
    assert rows(near_dedup.stage(spark, docs, folder)) == sorted([(1, p), (1, q), (1, q), (7, z), (7, None), (None, p)], key=repr)


def test_probe_groups_follow_the_number_of_holdings(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "ROWS_PER_GROUP", 100)
    common = "this one line is found in a handful of documents only"
    long_ = "\n".join(f"line {n} of the one long document, which no other text of the table holds" for n in range(1500))
    table = [(i, f"a line of its own, told from all others by its number {i}" + ("\n" + common if i % 300 == 0 else "")) for i in range(1800)] + [(5000, long_)]
    index = line_dedup.LineIndex.build(spark.createDataFrame(table, "doc_id long, text string"))
    assert index.shards == 1
    grouped, salts = index.grouped(index.holdings)
    sizes = [r["count"] for r in grouped.groupBy("shard", "salt").count().collect()]
    assert sum(sizes) == 1800 + 1500 + 6 and max(sizes) < 200 and salts == 34
    assert {r.doc_id: len(r["keys"]) for r in index.dropped().collect()} == {i: 1 for i in range(0, 1500, 300)}
