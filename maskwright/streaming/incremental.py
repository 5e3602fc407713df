"""Scan documents as they arrive, each one once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.hits import Context, findings
from ..operators.ignores import attach
from ..plans.scan import scan
from ..session import new_folder


def read_new(spark: SparkSession, folder: str, schema, fmt: str = "parquet", names: str = "*") -> DataFrame:
    """Files of a folder as a stream; those seen before are not read again."""
    return spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", names).load(folder)


def scan_stream(files: DataFrame, ctx: Context) -> DataFrame:
    """Findings of a stream of files.  No state is kept between batches."""
    return findings(scan(files, ctx), "path")


def scan_stream_ignoring(files: DataFrame, ignores: DataFrame, ctx: Context) -> DataFrame:
    """The same with a static ignore list joined to each batch."""
    return findings(scan(attach(files, ignores), replace(ctx, ignores="ignores")), "path")


def drain(found: DataFrame, label: str, output: str | None = None, checkpoint: str | None = None) -> str:
    """Process what is there and stop; returns the folder with the findings.  With
    the same two folders the next call continues where this one ended."""
    spark = found.sparkSession
    output = output or new_folder(spark, label)
    checkpoint = checkpoint or new_folder(spark, f"{label}-progress")
    query = (
        found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return output

