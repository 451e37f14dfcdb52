"""Ingest job: stored responses to the five normalized tables and a manifest."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.operators import ingest
from wheelbase.sources import tables
from wheelbase.staging import checkpointed


def build_tables(
    candidates: DataFrame,
    option_responses: DataFrame,
    measure_pages: DataFrame,
    captured_at: str,
    links: vocab.SiteLinks = vocab.SiteLinks(),
) -> dict[str, DataFrame]:
    """``option_responses (series_id, body)``, ``measure_pages (series_id, html)`` to tables and failures."""
    known = ingest.has_response(candidates, option_responses, measure_pages)
    payloads = ingest.parse_payloads(option_responses.join(known, "series_id", "left_semi"))
    parameters = ingest.explode_parameters(payloads, captured_at)
    # Pages are read once; the rows and the failures come from their stored cells.
    cells = checkpointed(ingest.page_cells(measure_pages.join(known, "series_id", "left_semi")))
    return {
        "series": ingest.series_rows(known, payloads, captured_at, links),
        "trims": ingest.explode_trims(payloads, captured_at, links),
        "trim_parameters": parameters,
        "parameter_definitions": ingest.parameter_definitions(parameters),
        "series_month_sales": ingest.monthly_rows(cells, captured_at, links),
        "failures": ingest.failures(payloads).unionByName(ingest.measure_failures(cells)),
    }


def run(
    candidates: DataFrame, option_responses: DataFrame, measure_pages: DataFrame, captured_at: str, output: str,
    links: vocab.SiteLinks = vocab.SiteLinks(),
) -> DataFrame:
    """Write every table as Parquet; the manifest's counts are observed in the writes, no table is read again for them."""
    spark = candidates.sparkSession
    built = build_tables(candidates, option_responses, measure_pages, captured_at, links)
    # The catalog job reads the year as a number; a year that is none becomes null and stops nothing.
    built["trims"] = built["trims"].withColumn("model_year", F.expr("try_cast(model_year as int)"))
    counts = {name: tables.write_counted(frame, f"{output}/{name}.parquet") for name, frame in built.items()}
    failed = spark.read.parquet(f"{output}/failures.parquet")
    selected = counts["series"]
    record = ingest.manifest_record(
        spark, counts, failed, selected, captured_at, datetime.now(timezone.utc).isoformat(), links.source_label)
    tables.write_json(record, f"{output}/manifest.json")
    return spark.createDataFrame(list(counts.items()), "table_name string, n_rows long")
