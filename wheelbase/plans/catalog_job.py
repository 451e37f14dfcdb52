"""Cleaning job: normalized tables or a flat snapshot to the catalog, its statistics and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wheelbase import vocab
from wheelbase.operators import catalog, summary
from wheelbase.staging import checkpointed
from wheelbase.sources import tables


def catalog_statistics(cleaned: DataFrame) -> dict[str, DataFrame]:
    return {
        "price_wan": summary.price_stats(cleaned),
        "sales": summary.sales_stats(cleaned),
        "energy_distribution": summary.distribution(cleaned, "energy_type"),
        "body_distribution": summary.distribution(cleaned, "body_type"),
    }


def run(
    spark: SparkSession, source: str, output: str, catalog_rules: vocab.CatalogRules = vocab.CatalogRules()
) -> dict[str, DataFrame]:
    """Assemble once, clean from the materialised assembly, write catalog, statistics and metadata."""
    def assemble(*frames: DataFrame) -> DataFrame:
        return catalog.assemble(*frames, energy_rules=catalog_rules.energy_rules)

    raw = checkpointed(tables.source_switch(spark, source, assemble))
    n_out = tables.write_counted(catalog.clean_catalog(raw, catalog_rules), f"{output}/cars.parquet")
    cleaned = spark.read.parquet(f"{output}/cars.parquet")
    tables.write_csv(catalog.export_form(cleaned), f"{output}/cars.csv")
    results = catalog_statistics(cleaned)
    accounting = summary.accounted(spark, raw.count(), n_out)
    results["rows"] = accounting
    results["metadata"] = tables.run_metadata(
        spark, accounting, tables.dataset_fingerprint(spark, source), source, f"{output}/cars.csv",
        catalog_rules.links.source_label,
    )
    for name, frame in results.items():
        tables.write_json(frame, f"{output}/{name}.json")
    return {"catalog": cleaned, **{n: spark.read.json(f"{output}/{n}.json") for n in results}}
