"""Writers (each runs a job): reports, tables, versioned changes, operation log."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import catalog_document, label_lines
from .records import CSV_OPTIONS


def write_document(document: DataFrame, path: str) -> None:
    """Write a one-row ``value`` frame as one text file in a new or replaced folder."""
    document.coalesce(1).write.mode("overwrite").text(path)


def write_report_csv(table: DataFrame, path: str) -> None:
    """Write a class-sized report table as one headed CSV file, in its row order."""
    table.coalesce(1).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_predictions_csv(details: DataFrame, path: str) -> None:
    """Write per-image rows as headed CSV files, one per partition."""
    details.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_epoch_history_csv(history: DataFrame, path: str) -> None:
    """Write the epochs of a run in order as one headed CSV file, arrays as JSON text."""
    arrays = {f.name: F.to_json(f.name) for f in history.schema if f.dataType.typeName() == "array"}
    write_report_csv(history.withColumns(arrays).orderBy("epoch"), path)


def write_predictions_json(nested: DataFrame, path: str, *, checkpoint: str, device: str = "spark") -> None:
    """Write one JSON line per image, each stamped with its checkpoint and device."""
    nested.withColumns({"checkpoint": F.lit(checkpoint), "device": F.lit(device)}).write.mode(
        "overwrite").json(path)


def log_operation(spark: SparkSession, path: str, command: str, details: DataFrame) -> None:
    """Append one entry per row of ``details`` to the audit trail."""
    now = datetime.now(timezone.utc)
    details.select(
        F.lit(now).alias("timestamp"), F.lit(command).alias("command"),
        F.to_json(F.struct(*details.columns)).alias("details"),
    ).write.mode("append").json(path)


def write_version(root: str, catalog: DataFrame, manifest: DataFrame | None = None,
                  tables: dict[str, DataFrame] | None = None) -> str:
    """Write a catalog change with its manifest as a whole and make it current.

    Everything goes to a new version folder; the last step replaces the small
    pointer file ``CURRENT``, so readers see the old or the new state only.
    Returns the version name.
    """
    spark = catalog.sparkSession
    version = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    folder = f"{root.rstrip('/')}/{version}"
    write_document(catalog_document(catalog), f"{folder}/labels.json")
    write_document(label_lines(catalog), f"{folder}/label.txt")
    if manifest is not None:
        manifest.write.mode("error").options(**CSV_OPTIONS).csv(f"{folder}/manifest.csv")
    for name, table in (tables or {}).items():
        table.write.mode("error").json(f"{folder}/{name}")
    _replace_file(spark, f"{root.rstrip('/')}/CURRENT", version)
    return version


def current_version(spark: SparkSession, root: str) -> str:
    """Name of the version the pointer file names."""
    return spark.read.text(f"{root.rstrip('/')}/CURRENT").first()[0]


def _replace_file(spark: SparkSession, path: str, content: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    temporary = jvm.org.apache.hadoop.fs.Path(path + ".next")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(temporary, True)
    stream.write(bytearray(content.encode("utf-8")))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, target, options)
