"""Files in and out. ``NA`` stands for a missing value in text files.

A quoted value may hold line breaks, so a text file is not cut at its lines:
one task streams one file, and the files are the parts of the work. Ledger
folders have a file per paying body, lookups are small. A file above
``MAX_FILE_BYTES`` is refused before anything is read; with ``line_breaks=False``,
for files known to have none inside values, large files are cut and have no
bound.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.schemas import MONEY, RAW_LEDGER

MISSING = "NA"
# A quote inside a quoted value is doubled, on reading and on writing.
QUOTING = {"quote": '"', "escape": '"'}
# What one task reads of a text file that can't be cut.
MAX_FILE_BYTES = 1 << 30


def _file_name() -> Column:
    """Name of the file a row is from; Spark percent-encodes it, but leaves '+'."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _text_options(spark: SparkSession, paths: list[str], line_breaks: bool) -> dict:
    """How text files are read; fails on a file too large to be read whole by one task."""
    if line_breaks:
        refuse_large(spark, paths)
    return {"header": True, "nullValue": MISSING, "mode": "FAILFAST", "multiLine": line_breaks, **QUOTING}


def refuse_large(spark: SparkSession, paths: list[str], most: int | None = None) -> None:
    """Fail, naming them, on files of more than ``most`` bytes; contents are not read."""
    most = MAX_FILE_BYTES if most is None else most
    listed = spark.read.format("binaryFile").load(paths).filter(F.col("length") > most)
    large = [r["path"] for r in listed.select("path").orderBy("path").limit(5).collect()]
    if large:
        names = ", ".join(large)
        raise ValueError(
            f"text files of more than {most} bytes, which one task would read: {names}; if no value"
            " has a line break, read them with line_breaks=False"
        )


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, line_breaks: bool = True
) -> DataFrame:
    """A headed text file under a given schema; nothing is inferred."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.csv(paths, schema=schema, **_text_options(spark, paths, line_breaks))


def read_named(
    spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = True
) -> DataFrame:
    """A headed text file of which the columns of ``schema`` are taken by name.

    Only the header line is looked at beforehand. A value that does not fit its
    type fails the job.
    """
    text = spark.read.csv(path, **_text_options(spark, [path], line_breaks))
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def _exact_money(text: Column) -> Column:
    """Text as money. Digits beyond pennies fail the job: they could decide the threshold."""
    whole = text.cast(T.DecimalType(38, 12))
    money = whole.cast(MONEY)
    message = F.concat(F.lit("amount with more than two decimals: "), text)
    return F.when(whole.isNull() | (whole == money), money).otherwise(F.raise_error(message).cast(MONEY))


def _literal_path(directory: str, name: str) -> str:
    """The path of one file; characters that would be a pattern stand for themselves."""
    return f"{directory}/" + re.sub(r"([*?{}\[\]\\])", r"\\\1", name)


def read_ledgers(
    spark: SparkSession,
    directory: str,
    manifest: DataFrame | None = None,
    file_format: str = "csv",
    layout: T.StructType = RAW_LEDGER,
    line_breaks: bool = True,
) -> DataFrame:
    """Ledger files of a folder as one scan, with the file each row is from.

    ``layout`` lists the columns of the files; only the five ledger columns are
    kept. Headed text files must carry those headers in that order, otherwise
    the read fails. With a manifest only the files it names are opened; names
    without a file (see :func:`missing_files`) give no rows.
    """
    amount = RAW_LEDGER.names[-1]
    paths = [directory]
    if manifest is not None:
        # A manifest is a closed list: one name per paying body.
        found = manifest.select("FileName").distinct().join(_files(spark, directory), "FileName")
        paths = [_literal_path(directory, r["FileName"]) for r in found.collect()]
    reader = spark.read.schema(layout)
    if file_format == "csv" and paths:
        as_text = [
            T.StructField(f.name, T.StringType()) if f.name == amount else f for f in layout.fields
        ]
        reader = spark.read.schema(T.StructType(as_text)).options(
            enforceSchema=False, **_text_options(spark, paths, line_breaks)
        )
    columns = [F.col(f"`{name}`") for name in RAW_LEDGER.names]
    if file_format == "csv":
        columns[-1] = _exact_money(columns[-1]).alias(amount)
    if not paths:
        return spark.createDataFrame([], layout).select(
            *RAW_LEDGER.names, F.lit(None).cast("string").alias("File")
        )
    return reader.format(file_format).load(paths).select(*columns, _file_name().alias("File"))


def _files(spark: SparkSession, directory: str) -> DataFrame:
    """Names of the files of a folder; contents are not read."""
    return spark.read.format("binaryFile").load(directory).select(_file_name().alias("FileName"))


def missing_files(spark: SparkSession, directory: str, manifest: DataFrame) -> DataFrame:
    """Files the manifest names that are not in the folder; contents are not read."""
    return manifest.select("FileName").join(_files(spark, directory), "FileName", "left_anti")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headed text; values with commas, quotes or line breaks are quoted, missing ones are ``NA``."""
    # Spark's writer would trim values; white space at their ends is kept.
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).csv(path, header=True, nullValue=MISSING, **whole, **QUOTING)
