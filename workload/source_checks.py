"""Sources and sinks: derived tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wheelbase import schemas
from wheelbase.operators import catalog, evidence, overview, summary
from wheelbase.plans import analysis_job, overview_job
from wheelbase.session import ensure_checkpoint_dir
from wheelbase.sources import tables
from wheelbase.staging import checkpointed
from workload import views
from workload.analysis_checks import OVERVIEW_SQL, evidence_frames
from workload.ctes import with_ctes
from workload.registry import check


def new_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def in_one_part(df):
    """For a single file: all tasks compute the rows, the one that writes them only passes them on (``coalesce`` would compute in it)."""
    return df.repartition(1)


MEASURE_COLUMNS = [part.split()[0] for part in schemas.MONTHLY_MEASURES.split(", ")]


def full_measures(spark, sf):
    frame = views.measures(spark, sf)
    quoted = F.concat(F.lit('a "b", '), F.col("series_id"))
    filled = {"registration_related": quoted, "overall_rank": F.lit("")}
    return frame.select(
        *[F.col(c) if c in frame.columns else filled.get(c, F.lit(None).cast("string")).alias(c) for c in MEASURE_COLUMNS]
    )


@check("scan_csv", with_ctes(("measures",), """
SELECT series_id, sales_period, sales, NULL::VARCHAR AS overall_rank, 'a "b", ' || series_id AS registration_related FROM measures"""))
def scan_csv(spark, sf):
    folder = new_folder(spark)
    tables.write_csv(full_measures(spark, sf), folder)
    return tables.scan_csv(spark, folder, schemas.MONTHLY_MEASURES).select(
        "series_id", "sales_period", "sales", "overall_rank", "registration_related"
    )


@check("scan_csv_gz", with_ctes(("measures",), "SELECT series_id, sales_period, sales FROM measures"))
def scan_csv_gz(spark, sf):
    folder = new_folder(spark)
    full_measures(spark, sf).write.options(**tables.CSV_OPTIONS, compression="gzip").csv(folder)
    return tables.scan_csv_gz(spark, folder, schemas.MONTHLY_MEASURES).select("series_id", "sales_period", "sales")


@check("write_parquet", with_ctes(("measures",), """
SELECT series_id, sales_period, sales FROM measures"""))
def write_parquet(spark, sf):
    """Measures partitioned by period, read again as a whole."""
    folder = new_folder(spark)
    tables.write_parquet(views.measures(spark, sf).repartition("sales_period"), folder, ["sales_period"])
    schema = "series_id string, sales int, sales_period string"
    written = spark.read.schema(schema).parquet(folder)
    return written.select("series_id", "sales_period", "sales")


@check("write_json", with_ctes(("measures",), """
SELECT sales_period, count(*) AS n_rows, max(sales) AS top FROM measures GROUP BY 1"""))
def write_json(spark, sf):
    folder = new_folder(spark)
    grouped = views.measures(spark, sf).groupBy("sales_period").agg(F.count("*").alias("n_rows"), F.max("sales").alias("top"))
    tables.write_json(grouped, folder)
    return spark.read.schema("sales_period string, n_rows bigint, top int").json(folder)


@check("write_rows_csv", with_ctes(("classified",), "SELECT parameter_key, rows, recognized_rate, selected_for_adapter, excluded_reason FROM classified"))
def write_rows_csv(spark, sf):
    folder = new_folder(spark)
    columns = ("parameter_key", "rows", "recognized_rate", "selected_for_adapter", "excluded_reason")
    tables.write_rows_csv(views.classified(spark, sf), folder, columns)
    schema = "parameter_key string, rows bigint, recognized_rate double, selected_for_adapter boolean, excluded_reason string"
    return tables.scan_csv(spark, folder, schema).fillna("", ["excluded_reason"])


@check("source_switch", with_ctes(("assembled",), """
SELECT source_key, model_name, brand, price_min_wan, price_max_wan, level_name, seats, horsepower, sales FROM assembled"""))
def source_switch(spark, sf):
    """A folder of normalized Parquet tables, assembled by the same reader the job uses."""
    folder = new_folder(spark)
    built = {"series": views.series(spark, sf), "trims": views.trims(spark, sf), "parameters": views.attributes(spark, sf, whole=True),
             "measures": views.measures(spark, sf)}
    for name, frame in built.items():
        tables.write_parquet(frame, f"{folder}/{tables.INPUT_FILES[name][0].split('.')[0]}.parquet")
    return tables.source_switch(spark, folder, catalog.assemble).select(
        "source_key", "model_name", "brand", "price_min_wan", "price_max_wan", "level_name", "seats", "horsepower", "sales"
    )


@check("catalog_csv_load", with_ctes(("catalog",), """
SELECT car_id, brand, price_mid_wan, seats, normalized_heat, data_completeness, array_to_string(scenario_tags, '+') AS tags FROM catalog"""))
def catalog_csv_load(spark, sf):
    folder = new_folder(spark)
    tables.write_csv(catalog.export_form(catalog.clean_catalog(views.assembled(spark, sf))), folder)
    return tables.typed_catalog_load(spark, folder).select(
        "car_id", "brand", "price_mid_wan", "seats", "normalized_heat", "data_completeness",
        F.array_join("scenario_tags", "+").alias("tags"),
    )


@check("dataset_fingerprint")
def dataset_fingerprint(spark, sf):
    return tables.dataset_fingerprint(spark, sf, "*.parquet")


@check("file_lines", with_ctes(("measures",), """
SELECT n_rows, n_files FROM (SELECT count(*) AS n_rows FROM measures), (SELECT 1 AS n_files)"""))
def file_lines(spark, sf):
    """A written file hashed by its lines: as many as rows, and a fingerprint that follows from them."""
    folder = new_folder(spark)
    in_one_part(views.measures(spark, sf)).write.csv(folder)
    digests = tables.file_digests(spark, folder, whole_file_bytes=0)
    lines = tables.table_fingerprint(spark.read.text(folder)).select("n_rows")
    return lines.withColumn("n_files", digests.agg(F.count("*").cast("int")).scalar())


@check("run_metadata", with_ctes(("assembled", "catalog"), """
SELECT 'parts' AS data_source, input_rows, output_rows, input_rows - output_rows AS removed_rows
FROM (SELECT count(*) AS input_rows FROM assembled), (SELECT count(*) AS output_rows FROM catalog)"""))
def run_metadata(spark, sf):
    """The record of a cleaning run whose counts come from the write, without its times, paths and digests."""
    raw = checkpointed(views.assembled(spark, sf))
    n_out = tables.write_counted(catalog.clean_catalog(raw), f"{new_folder(spark)}/cars.parquet")
    record = tables.run_metadata(spark, summary.accounted(spark, raw.count(), n_out), tables.dataset_fingerprint(spark, sf), sf, "out", "parts")
    return record.filter("length(input_sha256) = 64 AND generated_at IS NOT NULL AND spark_version IS NOT NULL").select(
        "data_source", "input_rows", "output_rows", "removed_rows")


def _write_artifacts(spark, sf, folder: str) -> None:
    rows, tested, weighed, merged = evidence_frames(spark, sf)
    described = evidence.describe_associations(tested, rows)
    weighed = weighed.join(rows.select("feature_name", "group_name", "parameter_name", "parameter_type"), "feature_name")
    results = {
        "parameter_quality": rows, "univariate_associations": described, "parameter_importance": weighed,
        "consolidated_parameter_results": merged,
    }
    for name, frame in results.items():
        tables.write_rows_csv(frame, f"{folder}/{name}.csv", analysis_job.RESULT_COLUMNS[name])
    latest = views.measures(spark, sf).filter(F.col("sales").isNotNull()).agg(F.max("sales_period").alias("sales_period"))
    tables.write_json(latest, f"{folder}/model_metrics.json")


@check("overview_loaded", with_ctes(("associations", "selected", "classified"), f""", {OVERVIEW_SQL}
SELECT feature_name, group_name, parameter_name, parameter_type, round(spearman_rho, 6) AS spearman_rho, elastic_net_coefficient,
  random_forest_importance, evidence_strength, association_direction, excluded_reason FROM overview
ORDER BY random_forest_importance DESC NULLS LAST, feature_name LIMIT 187"""))
def overview_loaded(spark, sf):
    """Analysis tables written as CSV and JSON, then read tolerantly and merged."""
    folder = new_folder(spark)
    _write_artifacts(spark, sf, folder)
    top = overview_job.load(spark, folder)["top_parameters"].drop("fdr_q_value", "trend_status")
    return top.withColumn("spearman_rho", F.round("spearman_rho", 6))


@check("overview_warnings")
def overview_warnings(spark, sf):
    """Health of a folder that holds only the quality table: the other three are reported."""
    folder = new_folder(spark)
    columns = ("feature_name", "selected_for_adapter", "selected_for_adapter AS selected_for_model")
    tables.write_csv_single(views.classified(spark, sf).selectExpr(*columns), f"{folder}/parameter_quality.csv")
    _, health = tables.artifact_health(spark, folder)
    return overview.overview_warnings(health)
