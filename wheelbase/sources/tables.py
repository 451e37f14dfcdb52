"""Reading and writing tables: schemas are explicit, text quoting follows RFC 4180."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wheelbase import schemas, vocab
from wheelbase.functions.rules import split_tags

# Quotes inside fields are doubled, and raw text may hold line breaks.
CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"'}
INPUT_FILES = {
    "series": ("series.csv", schemas.SERIES),
    "trims": ("trims.csv", schemas.TRIMS),
    "parameters": ("trim_parameters.csv.gz", schemas.TRIM_PARAMETERS),
    "measures": ("series_month_sales.csv", schemas.MONTHLY_MEASURES),
}


class MissingInputs(FileNotFoundError):
    """Names every required table that is absent."""


def _path_api(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path_api(spark, path)
    return fs.exists(hadoop_path)


def is_directory(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path_api(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def require_inputs(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    missing = [name for name in names if not path_exists(spark, f"{folder}/{name}")]
    if missing:
        raise MissingInputs(f"完整车型表缺失：{', '.join(missing)}")


def scan_csv(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """Headered CSV; empty fields are NULL.  ``multiline`` allows line breaks inside quotes."""
    return spark.read.options(**CSV_OPTIONS, multiLine=multiline).schema(schema).csv(path)


def scan_csv_gz(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """A gzip file is one task to read, so its rows are spread right after the scan.

    Spreading by row instead of by key keeps a frequent key from filling one partition.
    """
    return spread_rows(scan_csv(spark, path, schema, multiline))


def spread_rows(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores (one gzip file, one row group).

    A scan that is already split finely enough is left as it is, so large tables are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def read_tables(spark: SparkSession, folder: str, which: Sequence[str] = tuple(INPUT_FILES)) -> dict[str, DataFrame]:
    """The normalized tables of a folder; a Parquet copy is preferred to the CSV file."""
    wanted = {}
    absent = []
    for name in which:
        file, schema = INPUT_FILES[name]
        copy = f"{folder}/{file.split('.')[0]}.parquet"
        if path_exists(spark, copy):
            wanted[name] = spark.read.schema(schema).parquet(copy)
        elif path_exists(spark, f"{folder}/{file}"):
            scan = scan_csv_gz if file.endswith(".gz") else scan_csv
            wanted[name] = scan(spark, f"{folder}/{file}", schema, multiline=True)
        else:
            absent.append(file)
    if absent:
        require_inputs(spark, folder, absent)
    return wanted


def source_switch(spark: SparkSession, path: str, assemble, file_schema: str = schemas.FLAT_SNAPSHOT) -> DataFrame:
    """A folder holds normalized tables to assemble, a file is a flat snapshot; same columns either way."""
    if not path_exists(spark, path):
        raise MissingInputs(f"原始数据不存在：{path}")
    if is_directory(spark, path):
        tables = read_tables(spark, path)
        return assemble(tables["series"], tables["trims"], tables["parameters"], tables["measures"])
    return scan_csv(spark, path, file_schema)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_counted(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Write and return the number of rows, counted by the write itself."""
    seen = Observation()
    write_parquet(df.observe(seen, F.count(F.lit(1)).alias("n_rows")), path, partition_by)
    return seen.get["n_rows"]


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV parts, written in parallel."""
    df.write.mode("overwrite").options(**CSV_OPTIONS, emptyValue="").csv(path)


def write_csv_single(df: DataFrame, path: str) -> None:
    """One headered CSV part, for result tables whose size is bounded by the catalog's vocabulary."""
    df.coalesce(1).write.mode("overwrite").options(**CSV_OPTIONS, emptyValue="").csv(path)


def write_rows_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A result table with its columns in the given order."""
    write_csv_single(df.select(*columns), path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def typed_catalog(text_catalog: DataFrame) -> DataFrame:
    """Exported catalog text to types: blanks NULL, whole numbers read through double, tags split."""
    def number(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit("")).cast("double")

    doubles = {c: number(c) for c in schemas.CATALOG_DOUBLES if c in text_catalog.columns}
    integers = {c: number(c).cast("int") for c in schemas.CATALOG_INTEGERS if c in text_catalog.columns}
    return text_catalog.withColumns({**doubles, **integers, "scenario_tags": split_tags("scenario_tags")})


def typed_catalog_load(spark: SparkSession, path: str) -> DataFrame:
    text_schema = ", ".join(f"{c} string" for c in vocab.CATALOG_COLUMNS)
    return typed_catalog(scan_csv(spark, path, text_schema))


# Files up to this size are hashed as they are; larger ones by their rows, in as many tasks as they have splits.
WHOLE_FILE_BYTES = 1 << 30
DATA_FILES = "*.{csv,gz,json,parquet}"


# Larger files are not held by a task but streamed through it.
HELD_FILE_BYTES = 1 << 24
# A codec that decodes nothing makes Spark read a file of the given ending as it lies, in one piece and in order. Spark's own Hadoop has the second name.
AS_IT_LIES = "org.apache.hadoop.io.compress.PassthroughCodec"
ENDING_OPTIONS = ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension")
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, digest) of files that arrive as their pieces between line feeds.

    The reader drops a byte order mark and does not tell whether the last piece ends in a line feed; the file's length does.
    """
    path = size = None
    hashes, length = (), 0

    def ended() -> pa.RecordBatch:
        marked, feed = {0: (0, b""), 1: (0, b"\n"), 3: (1, b""), 4: (1, b"\n")}[size - length]
        hashes[marked].update(feed)
        return pa.record_batch([[unquote(path)], [hashes[marked].hexdigest()]], ["path", "digest"])

    for batch in batches:
        runs = pc.run_end_encode(batch.column("path"))
        begin = 0
        for end, own in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
            piece = b"\n".join(batch.column("piece").slice(begin, end - begin).to_pylist())
            if own == path:
                piece = b"\n" + piece
            else:
                if path is not None:
                    yield ended()
                path, size, length = own, batch.column("size")[begin].as_py(), 0
                hashes = hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)
            for kind in hashes:
                kind.update(piece)
            length, begin = length + len(piece), end
    if path is not None:
        yield ended()


def file_digests(
    spark: SparkSession, path: str, pattern: str = DATA_FILES, whole_file_bytes: int = WHOLE_FILE_BYTES, held_file_bytes: int = HELD_FILE_BYTES
) -> DataFrame:
    """(name, digest) of every data file below ``path``, names relative to it.

    Files up to ``held_file_bytes`` are hashed as one value, those up to ``whole_file_bytes`` to the same digest as a stream of pieces, each by one task.
    A larger file's digest is taken from the number, xor and sum of the hashes of its lines, or of its rows for Parquet, so no
    value has to hold the file and the order in which tasks read it does not matter. Its listing entry is all that the driver sees of it.
    """
    folder = is_directory(spark, path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if folder else reader).load(path)
    root = _path_api(spark, path)[0].toUri().getPath().rstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:(//[^/]*)?", ""), "^" + re.escape(root) + "/?", "")
    # A file that is but a byte order mark has no pieces.
    held = min(max(held_file_bytes, len(BYTE_ORDER_MARK)), whole_file_bytes)
    # The reader sees these plain conditions itself and opens no other files.
    digests = files.filter(F.col("length") <= held).select(name.alias("name"), F.sha2("content", 256).alias("digest"))
    by_ending: dict[str, list[str]] = {}
    for file in files.filter((F.col("length") > held) & (F.col("length") <= whole_file_bytes)).select("path").collect():
        by_ending.setdefault(os.path.splitext("_" + os.path.basename(file.path))[1], []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", file.path))
    if unnamed := by_ending.pop("", None):
        contents = spark.read.format("binaryFile").load(unnamed)
        digests = digests.unionByName(contents.select(name.alias("name"), F.sha2("content", 256).alias("digest")))
    for own, paths in by_ending.items():
        options = {"io.compression.codecs": AS_IT_LIES, "lineSep": "\n", **dict.fromkeys(ENDING_OPTIONS, own)}
        pieces = spark.read.options(**options).text(paths).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("piece"))
        digests = digests.unionByName(pieces.mapInArrow(_streamed_digests, "path string, digest string").select(name.alias("name"), "digest"))
    for large in files.filter(F.col("length") > whole_file_bytes).select("path", name.alias("name")).collect():
        rows = spark.read.parquet(large.path) if large.path.endswith(".parquet") else spark.read.text(large.path)
        text = F.concat_ws(" ", "n_rows", "row_hash", "row_sum")
        digests = digests.unionByName(table_fingerprint(rows).select(F.lit(large.name).alias("name"), F.sha2(text, 256).alias("digest")))
    return digests


def dataset_fingerprint(spark: SparkSession, path: str, pattern: str = DATA_FILES, whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """SHA-256 of a file, or of a folder's sorted (name, digest) list with all of its sub-folders, as one row.

    The list has one short entry per file, like the file listing the driver already holds.
    """
    digests = file_digests(spark, path, pattern, whole_file_bytes)
    if not is_directory(spark, path):
        return digests.select(F.col("digest").alias("fingerprint"))
    ordered = F.array_sort(F.collect_list(F.struct("name", "digest")))
    joined = F.array_join(F.transform(ordered, lambda f: F.concat(f["name"], f["digest"])), "")
    return digests.agg(F.sha2(joined, 256).alias("fingerprint"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table of any size: row count, xor and sum of row hashes."""
    hashed = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(hashed).alias("row_hash"), F.sum(hashed.cast("decimal(38,0)")).alias("row_sum"))


def run_metadata(spark: SparkSession, accounting: DataFrame, fingerprint: DataFrame, source: str, output: str, label: str) -> DataFrame:
    """One record about a run: time, version, source, fingerprint and row accounting."""
    return accounting.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        F.lit(spark.version).alias("spark_version"),
        F.lit(label).alias("data_source"),
        F.lit(source).alias("input_file"),
        fingerprint.select("fingerprint").scalar().alias("input_sha256"),
        F.lit(output).alias("output_file"),
        "input_rows",
        "output_rows",
        "removed_rows",
    )


# ------------------------------------------------------------------ tolerant reads
OVERVIEW_FILES = {
    "model_metrics": ("model_metrics.json", ()),
    "associations": ("univariate_associations.csv", ("feature_name", "spearman_rho", "fdr_q_value")),
    "importance": (
        "parameter_importance.csv",
        ("feature_name", "group_name", "parameter_name", "parameter_type", "elastic_net_coefficient", "random_forest_importance"),
    ),
    "quality": ("parameter_quality.csv", ("feature_name", "selected_for_adapter", "selected_for_model")),
    "consolidated": (
        "consolidated_parameter_results.csv",
        (
            "feature_name", "group_name", "parameter_name", "parameter_type", "spearman_rho", "fdr_q_value",
            "elastic_net_coefficient", "random_forest_importance", "evidence_strength", "association_direction",
            "trend_status",
        ),
    ),
}
OPTIONAL_FILES = ("consolidated",)


def read_optional_table(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame | None, str | None]:
    """(table, None) or (None, warning): absent, unreadable and incomplete files never raise."""
    file, required = OVERVIEW_FILES[name]
    path = f"{folder}/{file}"
    if not path_exists(spark, path):
        return None, None if name in OPTIONAL_FILES else f"{vocab.WARNING_MISSING}{file}"
    try:
        if file.endswith(".json"):
            document = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
            kind = document.select(F.schema_of_variant("v")).first()[0]
            if not (kind or "").startswith("OBJECT"):
                return None, f"{vocab.WARNING_UNREADABLE}{file}（JSON 顶层必须是对象）"
            return document, None
        table = spark.read.options(**CSV_OPTIONS, multiLine=True).csv(path)
        table = table.toDF(*[c.lstrip("\ufeff") for c in table.columns])
        absent = sorted(set(required) - set(table.columns))
        if absent:
            return None, f"{vocab.WARNING_UNREADABLE}{file}（缺少字段: {', '.join(absent)}）"
        return table, None
    except (AnalysisException, PySparkException) as problem:
        return None, f"{vocab.WARNING_UNREADABLE}{file}（{problem.getCondition() or type(problem).__name__}）"


def artifact_health(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Readable analysis tables, and one health row per table."""
    tables, rows = {}, []
    for position, name in enumerate(OVERVIEW_FILES):
        table, warning = read_optional_table(spark, folder, name)
        if table is not None:
            tables[name] = table
        rows.append((position, name, warning is None, warning))
    return tables, spark.createDataFrame(rows, "position int, name string, ok boolean, warning string")


def json_row(spark: SparkSession, payload: Mapping) -> DataFrame:
    """A small record as a one-row frame of JSON text."""
    return spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "value string")
