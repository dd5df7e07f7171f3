"""Reading and writing tables: CSV, JSON and Parquet, chosen by file extension."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scour.functions.columns import col, with_columns

# The texts a CSV cell may hold to mean "missing".
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Lossless text form of a timestamp without zone.
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _loaded(load, path) -> DataFrame:
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(str(path)) from e
        raise


def inferred(df: DataFrame) -> DataFrame:
    """Narrow all-text columns to BIGINT, DOUBLE or BOOLEAN where every known value fits; one aggregate."""
    if not df.columns:
        return df
    cells = {c: F.when(~F.trim(col(c)).isin(MISSING_TEXTS), col(c)) for c in df.columns}
    aggs = []
    for i, c in enumerate(cells.values()):
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count(F.when(c.rlike(r"^\s*[+-]?\d{1,19}\s*$"), c.try_cast("bigint"))).alias(f"int{i}"),
            F.count(F.when(~c.rlike(r"[dDfF]\s*$"), c.try_cast("double"))).alias(f"float{i}"),
            F.count_if(c.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"bool{i}"),
        ]
    row = df.agg(*aggs).first()
    exprs: dict[str, Column] = {}
    for i, (name, c) in enumerate(cells.items()):
        kinds = [("int", "bigint"), ("float", "double"), ("bool", "boolean")]
        fits = [spark_type for kind, spark_type in kinds if row[f"n{i}"] and row[f"{kind}{i}"] == row[f"n{i}"]]
        exprs[name] = c.try_cast(fits[0]) if fits else c
    return with_columns(df, exprs)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    multiline: bool = False,
    infer: bool = True,
) -> DataFrame:
    """Header CSV. A declared schema skips the inference scan; a malformed file is fatal.

    ``multiline`` allows line breaks inside quoted cells, at the price of one task per file.
    """
    reader = spark.read.options(
        header=True, mode="FAILFAST", quote='"', escape='"', multiLine=multiline, timestampNTZFormat=TIMESTAMP_TEXT
    )
    if schema is not None:
        return _loaded(lambda: reader.schema(schema).csv(path), path)
    raw = _loaded(lambda: reader.option("inferSchema", False).csv(path), path)
    return inferred(raw) if infer else raw


def read_json(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """A JSON array document, or JSON Lines (splittable) with ``lines=True``."""
    reader = spark.read.options(
        multiLine=not lines, mode="FAILFAST", primitivesAsString=False, timestampNTZFormat=TIMESTAMP_TEXT
    )
    if schema is not None:
        reader = reader.schema(schema)
    return _loaded(lambda: reader.json(path), path)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return _loaded(lambda: spark.read.parquet(*paths), path)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Pick the reader by extension (any case). Unknown extension: ValueError; no such path: FileNotFoundError."""
    kind = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet}
    if kind not in readers:
        raise ValueError(f"Unsupported file type: {kind or path!r}")
    return readers[kind](spark, path, **options)


def load_datasets(spark: SparkSession, paths: Iterable[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Load every path by its base name; failures are reported, not raised."""
    tables: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    for path in paths:
        name = os.path.basename(path.rstrip("/"))
        try:
            tables[name] = read_table(spark, path)
        except (AnalysisException, FileNotFoundError, ValueError) as e:
            errors[name] = f"{type(e).__name__}: {e}"
    return tables, errors


def concat(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all inputs over the union of their columns; absent cells are NULL."""
    if not tables:
        raise ValueError("no table to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_table(df: DataFrame, base: str, fmt: str = "csv", mode: str = "errorifexists") -> str:
    """Write ``base.csv`` or ``base.parquet`` as a folder of part files; returns its path."""
    path = f"{base}.{fmt}"
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.options(header=True, quote='"', escape='"', timestampNTZFormat=TIMESTAMP_TEXT).csv(path)
    elif fmt == "json":
        writer.options(timestampNTZFormat=TIMESTAMP_TEXT, ignoreNullFields=False).json(path)
    else:
        raise ValueError(f"Unsupported file type: {fmt}")
    return path
