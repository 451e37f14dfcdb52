import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from wheelbase.session import build_session  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ITEM_SCHEMA = (
    "car_id string, model_name string, brand string, price_min_wan double, price_max_wan double, price_mid_wan double, "
    "body_type string, energy_type string, seats int, range_km double, fuel_consumption double, horsepower int, "
    "model_year int, sales int, sales_period string, normalized_heat double, scenario_tags array<string>, "
    "data_completeness double"
)
# (lowest price, brand, sales, heat, power) of six plug-in saloons; four of them meet the base request below.
SALOONS = (
    (11.98, "云桥", 90, 0.21, 204), (13.48, "云桥", 2100, 0.97, 218), (14.28, "海川", 640, 0.66, 190), (15.08, "云桥", 1500, 0.88, 231),
    (16.88, "云桥", 980, 0.74, 245), (18.18, "海川", 75, 0.17, 260),
)


@pytest.fixture()
def items(spark):
    """Six catalog items of one class, two brands, prices from 11.98 to 18.78."""
    rows = [
        (
            f"car_{i}", f"轿车 {i} 号", brand, low, round(low + 0.6, 2), round(low + 0.3, 2), "轿车", "插混", 5, 980.0 + 35 * i, None, power,
            2025, sales, "2025-11", heat, ["长途出行"], 0.88,
        )
        for i, (low, brand, sales, heat, power) in enumerate(SALOONS)
    ]
    return spark.createDataFrame(rows, ITEM_SCHEMA)


@pytest.fixture()
def request_frame(spark):
    """Raw text requests: the base case with changes."""
    base = {
        "budget_min_wan": "13", "budget_max_wan": "17", "body_type": "轿车", "energy_type": "插混", "brands": [],
        "scenario": "长途出行", "min_seats": "5", "min_sales": None, "limit": "5",
    }
    schema = (
        "request_id string, budget_min_wan string, budget_max_wan string, body_type string, energy_type string, "
        "brands array<string>, scenario string, min_seats string, min_sales string, limit string"
    )

    def make(**changes):
        cases = {"base": {}, **changes}
        rows = [(name, *({**base, **change}).values()) for name, change in cases.items()]
        return spark.createDataFrame(rows, schema)

    return make
