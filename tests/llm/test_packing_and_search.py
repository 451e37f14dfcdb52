import zlib

import numpy as np
import pytest
from conftest_llm import PASSAGE, ROWS, prose, rows

import corpus_pipeline
from wheelbase.llm import decontaminate, nearest, packing
from wheelbase.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
WITH_ID = [r for r in ROWS if r[0] is not None]


def fewest(items, capacity):
    best = len(items)

    def go(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(items):
            best = len(rooms)
            return
        for n, room in enumerate(rooms):
            if room >= items[at] and room not in rooms[:n]:
                go(at + 1, [*rooms[:n], room - items[at], *rooms[n + 1:]])
        go(at + 1, [*rooms, capacity - items[at]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(8)
    for _ in range(60):
        items = sorted(rng.integers(1, 31, 10).tolist(), reverse=True)
        counts = {s: items.count(s) for s in set(items)}
        plan = packing.bin_completion(counts, 30)
        used = {}
        for pattern, n in plan:
            assert sum(pattern) <= 30
            for s in pattern:
                used[s] = used.get(s, 0) + n
        assert used == counts
        assert packing.lower_bound(counts, 30) <= fewest(items, 30) <= sum(n for _, n in plan) <= fewest(items, 30) + 0


def test_pieces_and_places(spark, docs, clashing, empty):
    made = packing.pack(docs, keep_ids=True).collect()
    encode = packing.tokenizer(packing.vocabulary_path("byte_bpe_50k.json"))
    want = []
    for r in WITH_ID:
        ids = [*encode(r[1] or ""), 0]
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r[0], n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted(tuple(r)[:5] for r in made) == sorted(want)
    own = {}
    for r in made:
        own.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in own.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(own) == -(-sum(r.length for r in made) // 2048)
    whole = {r.sequence_id: list(r.ids) for r in packing.sequences(packing.pack(docs, keep_ids=True)).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in made)
    assert len(packing.pack(clashing).collect()) == len(made) and packing.pack(empty).count() == 0


def test_myers_equals_the_edit_table():
    rng = np.random.default_rng(2)
    for _ in range(300):
        p, t = ("".join(rng.choice(list("abc"), int(rng.integers(1, n)))) for n in (12, 25))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p):
            last, row = row, [i + 1]
            for j, y in enumerate(t):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        assert decontaminate.myers(p, t, len(p))[0] == min(*row, len(p))


def test_leaks_within_the_budget_are_all_found(spark, folder, docs, clashing, empty):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    budget = int(len(decontaminate.normal(PASSAGE)) * decontaminate.ERRORS)
    assert rows(decontaminate.leaks(docs, items), "doc_id", "item_id", "distance", "budget") == [(8, 1, 0, budget), (9, 1, 0, budget)]
    text = decontaminate.normal(PASSAGE)
    rng = np.random.default_rng(6)
    cases = []
    for n, edits in enumerate((1, budget // 2, budget, budget + 40)):
        letters = list(text)
        for at in rng.choice(len(letters), edits, replace=False):
            letters[at] = "q"
        cases.append((n, prose(n, 50) + " " + "".join(letters) + " " + prose(n + 5, 50)))
    found = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(cases, "doc_id long, text string"), items).collect()}
    assert found == {0, 1, 2}
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert rows(decontaminate.leaks(clashing, items)) == rows(decontaminate.leaks(docs, items))


def least_edits(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for letter in text:
        last, row = row, [0]
        for i, own in enumerate(pattern):
            row.append(min(last[i] + (own != letter), last[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


def test_leaks_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(12)
    long_ = [" ".join(prose(n, 12).split()) for n in (70, 71, 72)]
    items = [(1, long_[0]), (2, "What is the capital of France?"), (3, long_[1]), (3, "two texts"), (4, "--!"), (5, None), (None, long_[2]), (6, "Aa"), (6, "Aa")]
    docs = [(1, "so: what is the CAPITAL of france"), (2, "what is the capital of francesca"), (3, "Two, texts. x"), (4, ""), (5, None), (None, long_[0]), (7, "aa"), (7, "baa aab"), (8, "baa aa")]
    for n in range(12):
        letters = list(long_[n % 2])
        for _ in range(int(rng.integers(0, 12))):
            at, kind = int(rng.integers(0, len(letters))), n % 3
            letters[at:at + (kind != 1)] = [] if kind == 0 else ["z"]
        docs.append((20 + n, prose(n, 6) + " " + "".join(letters) + " " + prose(n + 1, 6)))
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want, clean = [], []
    for doc, text in docs:
        body, found = decontaminate.normal(text), {}
        for item, t in items:
            pattern = decontaminate.normal(t)
            if item is None or not pattern:
                continue
            short = len(pattern.split()) < decontaminate.LEAST_WORDS
            budget = 0 if short else int(len(pattern) * decontaminate.ERRORS)
            edits = int(f" {pattern} " not in f" {body} ") if short else least_edits(pattern, body)
            if edits <= budget:
                found[item] = min(found.get(item, (edits, budget)), (edits, budget))
        want += [(doc, item, *f) for item, f in found.items() if doc is not None]
        clean += [(doc, text)] * (not found)
    assert {w[1] for w in want} == {1, 2, 3, 6} and {d for d, _ in clean} > {2, 4, 5, 7}
    assert rows(decontaminate.leaks(docs_, items_), "doc_id", "item_id", "distance", "budget") == sorted(want, key=repr)
    items_.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(decontaminate.stage(spark, docs_, str(tmp_path))) == sorted(clean, key=repr)


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 7)).astype(np.float32)
    x[50:60] = x[40]
    vectors = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 7), (902, [float("nan")] * 7), (903, [None] * 7), (904, [1.0, 2.0]), (905, []), (None, [1.0] * 7)]
    vectors += vectors[:5]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = df.filter("vec_id % 100 = 0 or vec_id in (40, 904)")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest.nearest(df, asked, 10, block).collect()}
    for q in (0, 100, 200, 40):
        d = np.sqrt(((x[q].astype(float) - x.astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert [got[q, n + 1][0] for n in range(10)] == order
        assert np.allclose([got[q, n + 1][1] for n in range(10)], d[order], rtol=1e-12, atol=0)
    assert {q for q, _ in got} == {0, 100, 200, 40}
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 2100)), rng.normal(size=(50, 2100)) * 1e3
    (qa, sa, na, ea), (qb, sb, nb, eb) = nearest.quantised(a), nearest.quantised(b)
    assert (nearest.products(qa, qb) == qa.astype(np.int64) @ qb.astype(np.int64).T).all()
    near = np.sqrt(np.maximum(na[:, None] + nb - 2 * nearest.products(qa, qb) * sa[:, None] * sb, 0))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert (np.abs(true - near) <= ea[:, None] + eb + 1e-6).all()


def test_pipeline(spark, folder, docs, clashing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, clashing, folder)
        assert kept.columns == clashing.columns, name
    made = corpus_pipeline.run(spark, folder)
    left = {r.doc_id for r in made.collect()}
    assert {2, 3, 8, 9}.isdisjoint(left) and {1, 4, 5, 6, 7, 10, 16} <= left
    assert sum(r.length for r in made.collect()) > 0


def test_every_numbered_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_added_tokens_in_texts_keep_their_ids(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    said = ["a <|endoftext|> b", end, end * 3, f"x{end}\n\n y", f"  {end}  z", "<|endoftext|", "<|EndOfText|>", prose(3, 1500) + end + prose(4, 1500), prose(5, 40), ""]
    want = [own.encode(text, add_special_tokens=False).ids for text in said]
    assert want[0] == [64, 220, 50256, 275]
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
        encode = packing.tokenizer(packing.vocabulary_path(name))
        assert [list(encode(text)) for text in said] == want
    got = {}
    for r in packing.pack(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), keep_ids=True).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: [*ids, packing.END_ID] for i, ids in enumerate(want)}
