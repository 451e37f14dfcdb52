"""Explicit schemas of the source tables; scans never infer types."""

from __future__ import annotations

# DDL text, which readers and from_json take as it is.
SERIES = (
    "series_id string, series_name string, list_price_min_wan double, list_price_max_wan double, "
    "body_hints string, energy_hints string, source_url string, options_url string, sales_url string, "
    "captured_at string"
)
TRIMS = (
    "trim_id string, series_id string, trim_name string, model_year int, status string, "
    "energy_type_raw string, displacement string, transmission string, drive_style string, "
    "body_structure string, seats_raw string, options_url string, captured_at string"
)
TRIM_PARAMETERS = (
    "trim_id string, series_id string, parameter_key string, group_id string, group_name string, "
    "parameter_name string, value_raw string, value_text string, value_numeric double, "
    "value_unit string, equipment_state string, captured_at string"
)
PARAMETER_DEFINITIONS = (
    "parameter_key string, group_id string, group_name string, parameter_name string, declared_unit string"
)
MONTHLY_MEASURES = (
    "series_id string, sales_period string, sales int, overall_rank string, manufacturer_share string, "
    "manufacturer_rank string, segment_rank string, registration_related string, sales_url string, "
    "captured_at string"
)
FLAT_SNAPSHOT = (
    "source_key string, series_id string, model_name string, brand string, price_min_wan double, "
    "price_max_wan double, level_name string, body_structure string, energy_type string, seats int, "
    "range_km double, fuel_consumption double, horsepower int, model_year int, sales int, "
    "sales_period string, trim_count int, source_url string, options_url string, sales_url string, "
    "captured_at date"
)
# An exported catalog is read as text first: its numbers may be blank.
CATALOG_DOUBLES = (
    "price_min_wan", "price_max_wan", "price_mid_wan", "range_km", "fuel_consumption", "heat_score",
    "normalized_heat", "data_completeness",
)
CATALOG_INTEGERS = ("seats", "horsepower", "model_year", "sales")

OPTIONS_PAYLOAD = (
    "ret string, data struct<arrCar: array<struct<car_id: string, car_name: string, decade: string, "
    "status: string, fueltype: string, displacement: string, transmission: string, driveStyle: string, "
    "body_structure: string, seatnum: string>>, "
    "arrConfig: map<string, map<string, map<string, array<string>>>>>"
)
