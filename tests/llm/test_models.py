import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import ROWS, rows

from wheelbase.llm import katz, language, toxicity
from wheelbase.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
#: 800 held-out labels; the small table has only a dozen toxic ones.
MORE = "/root/testdata/sf0.1"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_lexicon_automaton_equals_edit_distance():
    terms = ["idiot", "trash", "disgusting", "scum", "abcabc"]
    made = toxicity.LexiconAutomaton([*terms, "blöd*"])
    rng = np.random.default_rng(4)
    words = ["blödmann", "blö", "xblöd", "", *terms]
    for term in terms:
        for _ in range(200):
            w = list(term)
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(0, len(w) + 1))
                w[at:at + int(rng.integers(0, 2))] = rng.choice(list("abcdiost"), int(rng.integers(0, 2))).tolist()
            words.append("".join(w))
    for word in words:
        want = min(((d, t) for t in terms if (d := edit_distance(word, t)) <= toxicity.edits_for(t)), default=None)
        if word.startswith("blöd"):
            want = min(x for x in (want, (0, "blöd*")) if x)
        assert made.match(word) == want, word


def test_quoted_terms_weigh_less():
    matcher = toxicity.Matcher({"idiot": 5.0})
    named = lambda t: dict(zip(toxicity.FEATURES, matcher.features(t)))
    assert named("you idiot")["exact"] > 0 == named("you idiot")["quoted"]
    assert named('the word "idiot" is old')["quoted"] > 0 == named('the word "idiot" is old')["exact"]
    assert named("you idiott")["fuzzy"] > 0 and named("")["any"] == 0


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    got = toxicity.op3(spark, MORE).join(labels, "doc_id").filter("held_out").collect()
    bad, good = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([(np.array(bad) > x).mean() + 0.5 * (np.array(bad) == x).mean() for x in good]) > 0.95
    assert np.mean(np.array(good) >= 0.5) < 0.03
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_edge_cases(spark, folder, docs, empty, clashing):
    made = toxicity.op3(spark, folder)
    assert made.count() == sum(r[0] is not None for r in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in made.collect())
    assert toxicity.scored(empty, toxicity.fit(toxicity.sample(empty, spark.read.parquet(f"{folder}/labels.parquet"), toxicity.bucket_of_id(5) != 0))).count() == 0
    assert toxicity.stage(spark, clashing, folder).columns == clashing.columns


def test_language_on_held_out_rows(spark):
    got = language.op7(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, folder, empty, clashing):
    got = {r.doc_id: r.lang_pred for r in language.op7(spark, folder).collect()}
    assert got[4] == got[5] == got[6] == "und" and set(got.values()) <= {"und", "en", "de", "fr"}
    assert language.predicted(empty, None).count() == 0
    assert language.predicted(clashing, None).select("lang_pred").distinct().collect()[0][0] == "und"
    for n in (2, 4, 6, 9, 40):
        codes = language.codewords(n)
        gap = min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i))
        assert gap >= (1 if n == 2 else codes.shape[1] // 4)


def brute_katz(table):
    tokens = [(i, held, [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]) for i, t, held in table]
    train = [ws for _, held, ws in tokens if not held]
    c1 = Counter(w for ws in train for w in ws)
    c2 = Counter(p for ws in train for p in zip(["<s>", *ws], ws))
    history = Counter({**c1, "<s>": len(train)})
    n, v = sum(c1.values()), len(c1)
    mass = lambda c: katz.Discounts.of(np.array([0, *[Counter(c.values())[r] for r in range(1, katz.CUT + 2)]])).mass
    m1, m2 = mass(c1), mass(c2)
    p1 = {w: float(m1(np.array([c]))[0]) / n for w, c in c1.items()}
    unseen = 1 - sum(p1.values())
    used, below = defaultdict(float), defaultdict(float)
    for (h, w), c in c2.items():
        used[h] += float(m2(np.array([c]))[0]) / history[h]
        below[h] += p1[w]
    out = {}
    for i, _, ws in tokens:
        score = sum(math.log10(float(m2(np.array([c2[h, w]]))[0]) / history[h] if (h, w) in c2 else (1 - used[h]) / (1 - below[h]) * p1.get(w, unseen)) for h, w in zip(["<s>", *ws], ws))
        out[i] = (len(ws), sum(c1[w] > 0 for w in ws), n, sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), score)
    return out


def test_katz_equals_brute_force(spark, docs, clashing, empty, monkeypatch):
    from pyspark.sql import functions as F

    want = brute_katz([(r[0], r[1], r[0] % 3 == 0) for r in ROWS if r[0] is not None])
    for split in (2_000_000, 20):
        monkeypatch.setattr(katz, "PER_SHARD", split)
        for frame in (docs, clashing.drop("held_out")):
            for r in katz.scored(frame.withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))).collect():
                n, known, train, base, score = want[r.doc_id]
                assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
                assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    monkeypatch.undo()
    assert katz.scored(empty.withColumn("held_out", F.lit(False))).count() == 0
    assert {r.score for r in katz.scored(docs.withColumn("held_out", F.lit(True))).collect()} == {0.0}


def test_katz_beats_the_base_on_held_out_rows(spark):
    got = QUERIES["op5_lm_scoring"](spark, SMALL).filter("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def brute_katz_of_order(table, order):
    """doc_id -> score by the recursion itself, over plain counters of k-grams."""
    tokens = [(i, held, [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]) for i, t, held in table]
    grams = lambda ws, k: zip(*[(["<s>"] * (k - 1) + ws)[j:] for j in range(k)])
    counts = {k: Counter(g for _, held, ws in tokens if not held for g in grams(ws, k)) for k in range(1, order + 1)}
    mass = {k: katz.Discounts.of(np.array([0, *[Counter(c.values())[r] for r in range(1, katz.CUT + 2)]])).mass for k, c in counts.items()}
    discounted = {k: {g: float(mass[k](np.array([n]))[0]) for g, n in c.items()} for k, c in counts.items()}
    total = {k: Counter() for k in counts}
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            total[k][g[:-1]] += n
            after[k][g[:-1]].append(g)
    unseen = 1 - sum(discounted[1].values()) / total[1][()]

    def p(g):
        k = len(g)
        if g in counts[k]:
            return discounted[k][g] / total[k][g[:-1]]
        if k == 1:
            return unseen
        seen = after[k].get(g[:-1], [])
        if not seen:
            return p(g[1:])
        return (1 - sum(map(p, seen))) / (1 - sum(p(s[1:]) for s in seen)) * p(g[1:])

    return {i: (sum(math.log10(p(g)) for g in grams(ws, order)), sum(g not in counts[order] for g in grams(ws, order))) for i, _, ws in tokens}


def test_katz_of_higher_order_equals_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    said = "a b c a b d a b c d a b c a c b a b e b c a"
    table = [(r[0], r[1]) for r in ROWS if r[0] is not None and len(r[1] or "") < 20_000]
    table += [(100 + i, " ".join(said.split()[i:] + said.split()[: i // 2])) for i in range(12)] + [(120, "c b d zz a b"), (123, "a b zz c a b c")]
    frame = spark.createDataFrame(table, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 3 == 0)
    for order, split in ((2, 20), (3, 2_000_000), (3, 10), (4, 10)):
        monkeypatch.setattr(katz, "PER_SHARD", split)
        want = brute_katz_of_order([(i, t, i % 3 == 0) for i, t in table], order)
        got = katz.scored(frame, order).collect()
        assert len(got) == len(table)
        for r in got:
            assert math.isclose(r.score, want[r.doc_id][0], rel_tol=1e-9) and r.n_backed_off == want[r.doc_id][1], (order, split, r)


def test_op5_uses_contexts_of_two_words(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").filter("doc_id is not null")
    table = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in docs.collect()]
    want = brute_katz_of_order(table, 3)
    for r in QUERIES["op5_lm_scoring"](spark, folder).collect():
        assert math.isclose(r.score, want[r.doc_id][0], rel_tol=1e-9)


def test_katz_keys_tell_all_histories_apart():
    one, two = (x.ravel() for x in np.meshgrid(np.arange(600), np.arange(600)))
    assert len(np.unique(katz.keys_of([one, two]))) == 360_000


def test_packed_order_equals_the_order_of_columns():
    random = np.random.default_rng(8)
    for top in (3, 1 << 20, 1 << 40):  # the last does not fit one number and is ranked first
        columns = [random.integers(0, top, 500) for _ in range(3)]
        order = katz.in_order(columns)
        assert sorted(order) == list(range(500))
        assert np.array_equal(np.stack(columns)[:, order], np.stack(columns)[:, np.lexsort(columns[::-1])])
    assert len(katz.in_order([np.zeros(0, np.int64)] * 2)) == 0
