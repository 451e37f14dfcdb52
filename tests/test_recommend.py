import itertools
import json
import random

from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.operators import bands, compare, contest, counting, recommend, requests
from wheelbase.staging import written
from workload import recommend_checks
from tests.conftest import ITEM_SCHEMA


def answer(items, raw):
    valid, rejected = requests.validate_requests(raw)
    ranked, envelope = recommend.recommend(items, valid)
    by_request = {}
    for row in ranked.orderBy("request_id", "rank").collect():
        by_request.setdefault(row.request_id, []).append(row)
    return by_request, {r.request_id: r for r in envelope.collect()}, {r.request_id: r for r in rejected.collect()}


def test_base_request_gives_four_items_with_factors(items, request_frame):
    ranked, envelope, _ = answer(items, request_frame())
    rows = ranked["base"]
    assert len(rows) == 4 and envelope["base"].total_candidates == 4
    assert all(len(r.matched_factors) >= 2 for r in rows)
    assert [r["rank"] for r in rows] == [1, 2, 3, 4]
    again, _, _ = answer(items, request_frame())
    assert [r.car_id for r in again["base"]] == [r.car_id for r in rows]
    assert rows[0].reason.startswith(f"推荐 {rows[0].model_name}，因为") and "，并且" in rows[0].reason


def test_relaxations_are_reported(items, request_frame):
    ranked, envelope, _ = answer(
        items, request_frame(brand={"brands": ["海川"]}, tight={"budget_min_wan": "16.9"})
    )
    assert vocab.RELAXED_BRAND in envelope["brand"].relaxed_conditions and len(ranked["brand"]) >= 3
    assert any("预算上限放宽 10% 至 18.70 万元" == note for note in envelope["tight"].relaxed_conditions)
    assert len(ranked["tight"]) == 2


def test_minimum_sales_excludes_unknown(items, request_frame):
    unknown_last = items.withColumn("sales", F.when(F.col("car_id") != "car_4", F.col("sales")))
    ranked, _, _ = answer(unknown_last, request_frame(sold={"min_sales": "500"}))
    assert len(ranked["sold"]) == 3 and all(r.sales >= 500 for r in ranked["sold"])


def test_missing_optional_fields_still_score(items, request_frame):
    bare = items.withColumns({"range_km": F.lit(None).cast("double"), "normalized_heat": F.lit(None).cast("double")})
    ranked, _, _ = answer(bare, request_frame())
    assert all(0 <= r.score <= 100 for r in ranked["base"])


def test_endless_numbers_stop_no_batch(spark, items, request_frame, monkeypatch):
    raw = request_frame(endless={"budget_max_wan": "1e999"}, long_limit={"limit": "1e30"})
    for few in (64, 0):
        monkeypatch.setattr(recommend, "FEW", few)
        ranked, envelope, rejected = answer(items, raw)
        assert envelope["endless"].total_candidates == 5 and len(ranked["endless"]) == 5 and len(ranked["base"]) == 4
        assert rejected["long_limit"].code == "INVALID_LIMIT"
    bodies = spark.createDataFrame([("a", '{"budget_min_wan": 1, "budget_max_wan": 2, "limit": 1e30}')], "request_id string, body string")
    assert [r.code for r in requests.validate_requests(requests.requests_from_json(bodies, "body"))[1].collect()] == ["INVALID_LIMIT"]


def test_request_without_candidates_keeps_an_envelope(items, request_frame):
    ranked, envelope, _ = answer(items, request_frame(none={"budget_min_wan": "1", "budget_max_wan": "2"}))
    assert "none" not in ranked and envelope["none"].total_candidates == 0


def test_first_failing_rule_is_reported(request_frame):
    raw = request_frame(
        order={"budget_min_wan": "17.01"}, missing={"budget_min_wan": None}, text={"budget_max_wan": "abc"},
        zero={"budget_max_wan": "0"}, limit={"limit": "6"}, seats={"min_seats": "12"}, half={"min_seats": "x"},
        sales={"min_sales": "-1"}, scenario={"scenario": "越野"}, double={"limit": "9", "scenario": "越野"},
    )
    valid, rejected = requests.validate_requests(raw)
    got = {r.request_id: (r.code, r.field) for r in rejected.collect()}
    assert got == {
        "order": ("INVALID_BUDGET", "budget_min_wan"), "missing": ("MISSING_FIELD", "budget_min_wan"),
        "text": ("INVALID_NUMBER", "budget_max_wan"), "zero": ("INVALID_BUDGET", "budget_max_wan"),
        "limit": ("INVALID_LIMIT", "limit"), "seats": ("INVALID_SEATS", "min_seats"), "half": ("INVALID_SEATS", "min_seats"),
        "sales": ("INVALID_SALES", "min_sales"), "scenario": ("INVALID_SCENARIO", "scenario"), "double": ("INVALID_LIMIT", "limit"),
    }
    assert [r.request_id for r in valid.collect()] == ["base"]


def test_json_types_are_judged(spark):
    good = {"budget_min_wan": 15, "budget_max_wan": "20", "brands": ["b", " a ", ""], "limit": 4.7, "min_seats": ""}
    bodies = {
        "good": good, "bool": {**good, "budget_min_wan": True}, "brands": {**good, "brands": [1]},
        "brand_text": {**good, "brands": "b"}, "no_brands": {**good, "brands": None}, "limit_bool": {**good, "limit": True},
        "limit_null": {**good, "limit": None}, "limit_text": {**good, "limit": "4.7"}, "sales_bool": {**good, "min_sales": False},
    }
    rows = [(k, json.dumps(v)) for k, v in bodies.items()] + [("list", "[1]"), ("broken", "{")]
    raw = requests.requests_from_json(spark.createDataFrame(rows, "request_id string, body string"), "body")
    valid, rejected = requests.validate_requests(raw)
    kept = {r.request_id: r for r in valid.collect()}
    assert set(kept) == {"good", "no_brands"}
    assert kept["good"].brands == ["a", "b"] and kept["good"].limit == 4 and kept["no_brands"].brands == []
    assert {r.request_id: r.code for r in rejected.collect()} == {
        "bool": "MISSING_FIELD", "brands": "INVALID_BRANDS", "brand_text": "INVALID_BRANDS", "limit_bool": "INVALID_LIMIT",
        "limit_null": "INVALID_LIMIT", "limit_text": "INVALID_LIMIT", "sales_bool": "INVALID_SALES",
        "list": "INVALID_JSON", "broken": "INVALID_JSON",
    }


def test_band_join_equals_brute_force_with_hot_bands(spark):
    """A third of both sides sits in one band; tiny slices force the grid to split it."""
    rng = random.Random(5)
    hot = lambda: rng.random() < 0.34
    item_rows = []
    for i in range(150):
        low = 10.0 if hot() else round(rng.uniform(1, 200), 2)
        item_rows.append((f"i{i}", low, low + (0 if hot() else rng.randint(0, 30)), rng.choice(["A", "B", None]), rng.choice(["x", "y"])))
    request_rows = []
    for r in range(90):
        low = 9.5 if hot() else round(rng.uniform(1, 200), 2)
        request_rows.append((f"r{r}", low, low + rng.randint(0, 40), rng.choice(["", "A"]), rng.choice(["", "y"])))
    left = spark.createDataFrame(item_rows, "car_id string, price_min_wan double, price_max_wan double, body_type string, energy_type string")
    right = spark.createDataFrame(request_rows, "sig string, band_low double, band_high double, want_body string, want_energy string")
    got = bands.band_join(left, right, F.lit(True), "car_id", "sig", slice_rows=7).select("car_id", "sig").collect()
    want = {
        (i[0], r[0])
        for i, r in itertools.product(item_rows, request_rows)
        if i[1] <= r[2] and i[2] >= r[1] and r[3] in ("", i[3]) and r[4] in ("", i[4])
    }
    assert len(got) == len(want) and {(g.car_id, g.sig) for g in got} == want


def catalog_rows(n, seed):
    """Items with a hot price, missing values of every kind, and tags that repeat."""
    rng = random.Random(seed)
    maybe = lambda value: None if rng.random() < 0.1 else value
    rows = []
    for i in range(n):
        low = 12.0 if rng.random() < 0.34 else round(rng.uniform(5, 60), 2)
        high = low if rng.random() < 0.5 else round(low + rng.randint(1, 8), 2)
        tags = maybe(rng.choice([[], ["城市通勤"], ["城市通勤", "长途出行", "城市通勤"], ["家庭出行", "长途出行"]]))
        rows.append((
            f"i{i:05d}", f"m{rng.randint(0, 3)}", maybe(rng.choice("ABC")), low, high, round((low + high) / 2, 2), maybe(rng.choice(["SUV", "轿车"])),
            rng.choice(["纯电", "燃油"]), maybe(rng.choice([2, 4, 5, 7, 9, 11])), None, None, None, 2025, maybe(rng.randint(0, 300)), "2025-01",
            maybe(round(rng.random(), 4)), tags, maybe(round(rng.random(), 2)),
        ))
    return rows


def asked_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for r in range(n):
        low = 11 if rng.random() < 0.34 else rng.randint(4, 60)
        rows.append((
            f"r{r}", str(low), str(low + rng.randint(0, 9)), rng.choice(["", "SUV", "轿车", "MPV"]), rng.choice(["", "纯电"]), rng.choice([[], ["A"], ["B", "C"], ["Z"]]),
            rng.choice(["", *vocab.SCENARIOS]), rng.choice([None, "2", "5", "9"]), rng.choice([None, "0", "7", "40", "41", str(rng.randint(0, 320))]), rng.choice(["3", "5"]),
        ))
    return rows


def named(spark, rows):
    return spark.createDataFrame(rows, "request_id string, budget_min_wan string, budget_max_wan string, body_type string, energy_type string, "
                                       "brands array<string>, scenario string, min_seats string, min_sales string, limit string")


def test_counts_equal_enumeration(spark):
    catalog = catalog_rows(260, 3)
    sigs = recommend.distinct_requests(requests.validate_requests(named(spark, asked_rows(120, 4)))[0])
    groups = recommend.item_groups(spark.createDataFrame(catalog, ITEM_SCHEMA))
    got = {r.sig: r for r in recommend.count_matches(groups, sigs).collect()}
    for r in sigs.withColumn("raised", recommend.raised_ceiling()).collect():
        fits = [
            i for i in catalog
            if r.body_type in ("", i[6]) and r.energy_type in ("", i[7]) and (r.min_seats is None or (i[8] or 0) >= r.min_seats)
            and (r.min_sales is None or (i[13] is not None and i[13] >= r.min_sales)) and i[4] >= r.budget_min_wan
        ]
        core = [i for i in fits if i[3] <= r.budget_max_wan]
        brand, tag = (lambda i: i[2] in r.brands), (lambda i: r.scenario in (i[16] or []))
        want = (len(core), sum(map(brand, core)), sum(map(tag, core)), sum(brand(i) and tag(i) for i in core), sum(i[3] <= r.raised for i in fits))
        found = got.get(r.sig)
        assert (tuple(found[c] for c in counting.COUNTS) if found else (0,) * 5) == want
    nothing = recommend.count_matches(groups.limit(0), sigs).collect()
    assert all(r[c] == 0 for r in nothing for c in counting.COUNTS)


def test_few_and_many_requests_get_the_same_answers(spark, monkeypatch):
    catalog, asked = spark.createDataFrame(catalog_rows(300, 12), ITEM_SCHEMA), named(spark, asked_rows(60, 13))
    columns = ("request_id", "rank", "car_id", "score", "matched_factors")

    def answers(few):
        monkeypatch.setattr(recommend, "FEW", few)
        ranked, envelope = recommend.recommend(catalog, requests.validate_requests(asked)[0])
        return (sorted(map(tuple, ranked.select(*columns).collect())),
                sorted((r.request_id, r.total_candidates, tuple(r.relaxed_conditions)) for r in envelope.collect()))

    assert answers(0) == answers(1000)


def test_levels_of_minimums_are_covered_by_blocks(spark):
    for sizes in (1, 2, 3, 5):
        top = 2**sizes
        frame = spark.range(0, top).withColumnRenamed("id", "level")
        held = {r.level: set(r.b) for r in frame.select("level", counting.blocks_of_level(sizes).alias("b")).collect()}
        for r in frame.filter("level > 0").select("level", counting.blocks_from_level(sizes).alias("b")).collect():
            assert {i for i in held if len(held[i] & set(r.b)) == 1} == set(range(r.level, top))
            assert all(len(held[i] & set(r.b)) <= 1 for i in held)


def contest_of(spark, catalog, asked, **settings):
    groups = recommend.item_groups(spark.createDataFrame(catalog, ITEM_SCHEMA))
    sigs = recommend.distinct_requests(requests.validate_requests(asked)[0])
    wanted = recommend._wanted(sigs, F.col("budget_max_wan"))
    met = contest.contenders(groups, wanted, recommend.price_basis(), recommend.weighted_score, recommend._minimums(), recommend._minimums(), **settings)
    every = bands.band_join(groups.withColumnRenamed("sales", "item_sales"), wanted, recommend._minimums(), "car_id", "sig").withColumn("score", recommend.weighted_score())
    return met, every


def best(frame):
    """The first places of every request by the full order, by a plain sort."""
    by_request = {}
    for r in frame.select("sig", "limit", "score", "data_completeness", "normalized_heat", "model_name", "car_id").collect():
        by_request.setdefault(r.sig, []).append((-r.score, -(r.data_completeness or 0), -(r.normalized_heat or 0), r.model_name, r.car_id, r.limit))
    return {sig: [x[4] for x in sorted(rows)[:rows[0][5]]] for sig, rows in by_request.items()}


def test_contest_keeps_the_best_and_meets_few_items(spark):
    asked = named(spark, asked_rows(40, 8))
    shares = []
    for n in (150, 1200, 4800):
        met, every = contest_of(spark, catalog_rows(n, 7), asked, slice_rows=50)
        assert best(met) == best(every)
        shares.append((met.count(), every.count()))
    # A catalog 32 times as large: the pairs that fit grow with it, those that are scored much less.
    assert shares[-1][1] > 25 * shares[0][1] and shares[-1][0] < 12 * shares[0][0]


def test_copies_of_items_and_requests_are_counted_in_full(spark, items, request_frame):
    copies = items.filter("car_id = 'car_3'").crossJoin(spark.range(40)).withColumn(
        "car_id", F.concat(F.lit("copy_"), F.lpad(F.col("id").cast("string"), 3, "0"))
    ).drop("id")
    crowded = items.unionByName(copies)
    raw = request_frame(twin={}, third={})
    ranked, envelope, _ = answer(crowded, raw)
    assert {e.total_candidates for e in envelope.values()} == {44}
    assert len({tuple(r.car_id for r in rows) for rows in ranked.values()}) == 1
    assert [r.car_id for r in ranked["base"]][:5] == ["car_3", "copy_000", "copy_001", "copy_002", "copy_003"]


def test_comparison_rules_and_scores(spark, items):
    sets = spark.createDataFrame(
        [("two", ["car_1", "car_0"]), ("one", ["car_0"]), ("same", ["car_0", "car_0"]), ("gone", ["car_0", "nope"]), ("none", None)],
        "set_id string, car_ids array<string>",
    )
    valid, rejected = compare.check_sets(sets, items)
    assert {r.set_id: (r.code, r.status) for r in rejected.collect()} == {
        "one": ("INVALID_COMPARE_COUNT", 400), "same": ("DUPLICATE_CAR", 400), "gone": ("CAR_NOT_FOUND", 404),
        "none": ("INVALID_COMPARE_COUNT", 400),
    }
    rows = compare.compare_items(items, valid)
    assert [r.car_id for r in rows.orderBy("pos").collect()] == ["car_1", "car_0"]
    radar = {r.car_id: r for r in compare.radar_scores(rows).collect()}
    assert radar["car_0"].price_score == 100.0 and radar["car_1"].price_score == 30.0
    assert radar["car_1"].power_score == 100.0 and radar["car_0"].freshness_score == 100.0
    matrix = {r.attribute: r for r in compare.comparison_matrix(rows).collect()}
    assert matrix["参考价格"].item_1 == "13.48—14.08 万" and matrix["参考价格"].item_3 is None
    assert matrix["数据完整度"].item_2 == "88%"


def test_public_json_drops_blank_fields(items):
    row = items.withColumn("brand", F.lit("")).select(recommend.public_json().alias("j")).first()
    fields = json.loads(row.j)
    assert "fuel_consumption" not in fields and "brand" not in fields and fields["seats"] == 5


def test_contest_hands_on_only_items_that_reach_the_last_place(spark):
    """Pairs are judged where they arise: what goes on to be ranked grows with the places, not with the items of a cell."""
    met, every = contest_of(spark, catalog_rows(4800, 7), named(spark, asked_rows(40, 8)))
    assert best(met) == best(every)
    places = sum(len(places) for places in best(every).values())
    assert places <= met.count() < 4 * places


def test_large_tables_of_the_ranking_hold_numbers(spark, monkeypatch):
    """Points and pairs are written with numbers for requests, lines and cells, and only the ranked rows get texts back."""
    monkeypatch.setattr(recommend, "FEW", 0)
    made = []

    def stage(df):
        made.append(dict(df.dtypes))
        return written(df)

    valid = requests.validate_requests(named(spark, asked_rows(30, 5)))[0]
    recommend.recommend(spark.createDataFrame(catalog_rows(80, 6), ITEM_SCHEMA), valid, stage=stage)[0].collect()
    points, pairs = [t for t in made if "side" in t], [t for t in made if "bound" in t]
    assert points and pairs
    assert all(t["sig"] == t["number"] == "bigint" and "key" not in t for t in points)
    assert all(t["sig"] == t["cell"] == "bigint" for t in pairs)


def test_core_match_equals_enumeration_without_sorting_pairs(spark, monkeypatch):
    catalog = [(None, *row[1:]) if n % 9 == 0 else row for n, row in enumerate(catalog_rows(200, 21))]
    # Requests that differ only beyond the hard conditions, and items with the same or no car_id.
    asked = asked_rows(40, 22) + [(f"twin{r[0]}", *r[1:5], ["B"], *r[6:]) for r in asked_rows(40, 22)]
    valid = requests.validate_requests(named(spark, asked))[0]
    items = spark.createDataFrame(catalog + catalog[:20], ITEM_SCHEMA)
    monkeypatch.setattr(recommend_checks.views, "items", lambda *_: items)
    monkeypatch.setattr(recommend_checks, "valid_requests", lambda *_: valid)
    found = recommend_checks.core_match(spark, "")
    got = {r.request_id: tuple(r)[1:] for r in found.collect()}
    want = {}
    for r in valid.collect():
        fits = [
            i for i in catalog + catalog[:20]
            if r.body_type in ("", i[6]) and r.energy_type in ("", i[7]) and (r.min_seats is None or (i[8] or 0) >= r.min_seats)
            and (r.min_sales is None or (i[13] is not None and i[13] >= r.min_sales)) and i[3] <= r.budget_max_wan and i[4] >= r.budget_min_wan
        ]
        ids = [i[0] for i in fits if i[0] is not None]
        if fits:
            want[r.request_id] = (len(fits), min(ids, default=None), max(ids, default=None))
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("SortAggregate" in line and "count(1)" in line for line in plan.splitlines())


def test_pairs_of_bands_are_made_by_many_tasks(spark):
    """Few narrow rows on both sides become many pairs; they must not be made by the one task that read the items."""
    items = spark.createDataFrame(catalog_rows(60, 3), ITEM_SCHEMA).coalesce(1)
    sigs = recommend.distinct_requests(requests.validate_requests(named(spark, asked_rows(30, 4)))[0], recommend.CORE_FIELDS)
    plan = recommend.core_matches(items, sigs)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_summed_points_are_stored_before_they_are_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(recommend, "FEW", 0)
    made = []

    def stage(df):
        made.append(set(df.columns))
        return written(df)

    valid = requests.validate_requests(named(spark, asked_rows(30, 5)))[0]
    recommend.decisions(spark.createDataFrame(catalog_rows(80, 6), ITEM_SCHEMA), valid, stage=stage)
    summed = made.index({"number", "line", "price", "weight"})
    assert any({"side", "_part"} <= columns for columns in made[summed + 1:])
