"""Table sources and sinks: Parquet, CSV with a checked header, strict text formats, array files, and registered datasets."""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.contracts import GateError
from tallyframe.operators.audit import partition_columns
from tallyframe.operators.preprocess import sanitize
from tallyframe.operators.reports import merge_specs


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The header's names; a repeated or empty name is refused before a reader could rename it."""
    line = spark.read.text(path).first()
    names = next(csv.reader([line[0].lstrip("﻿")])) if line else []
    if not names or any(not n for n in names):
        raise GateError("schema_mismatch", "empty column name")
    if len(set(names)) != len(names):
        raise GateError("duplicate_columns")
    return names


def load_table(spark: SparkSession, path: str, *, header: bool = True) -> DataFrame:
    """The suffix decides the format; CSV columns stay text until the gate types them."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if not path.endswith(".csv"):
        raise GateError("unsupported_input_format", path)
    if header:
        names = csv_header(spark, path)
        return spark.read.csv(path, header=True, schema=", ".join(f"`{n}` string" for n in names), escape='"')
    found = spark.read.csv(path, header=False, escape='"')
    return found.toDF(*[f"column_{i}" for i in range(len(found.columns))])


def save_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)


def save_csv(df: DataFrame, path: str, order: list[str] = ()) -> None:
    """CSV with a header and line feeds; in the given order across its part files, or as the rows come."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"').csv(path)


def save_json(df: DataFrame, path: str) -> None:
    """A JSON object per line, nulls told as such."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_record(record: dict, path: str) -> None:
    """One small JSON record (a state or a manifest), put in place of an older one in one step: on the driver's file system."""
    held = f"{path}.new"
    with open(held, "w", encoding="utf-8") as out:
        json.dump(record, out, sort_keys=True, allow_nan=False)
        out.flush()
        os.fsync(out.fileno())
    os.replace(held, path)


def save_splits(splits: dict[str, DataFrame], path: str) -> None:
    """All splits as one Parquet table with a folder per split."""
    reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(name)) for name, df in splits.items()]).write.mode("overwrite").partitionBy("split").option("compression", "zstd").parquet(path)


def load_splits(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    df = spark.read.parquet(path)
    return {r[0]: df.where(F.col("split") == r[0]).drop("split") for r in df.select("split").distinct().orderBy("split").collect()}


def union_splits(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of all splits with the split's name."""
    return reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(name)) for name, df in tables.items()])


def load_arrays(spark: SparkSession, path: str, prefixes: dict[str, str]) -> DataFrame:
    """(split, row, a column per prefix as an array): saved array files named ``<prefix>_<split>.npy``, each file read in one task.

    Rows are matched by their place in the files; a two-dimensional file gives an array per row, any other a single element.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    kinds = {p: "double" if k == "number" else "string" for p, k in prefixes.items()}

    def read(prefix: str) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    values = np.load(io.BytesIO(content), allow_pickle=False)
                    values = values.reshape(len(values), -1)
                    split = name.rsplit("/", 1)[-1].removeprefix(prefix + "_").removesuffix(".npy")
                    as_kind = values.astype(float).tolist() if kinds[prefix] == "double" else values.astype(str).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([split] * len(values)), pa.array(range(len(values)), pa.int64()), pa.array(as_kind, pa.list_(pa.float64() if kinds[prefix] == "double" else pa.string()))], names=["split", "row", prefix])

        return files.where(F.element_at(F.split("path", "/"), -1).startswith(prefix + "_")).mapInArrow(task, f"split string, row long, `{prefix}` array<{kinds[prefix]}>")

    return reduce(lambda a, b: a.join(b, ["split", "row"], "full_outer"), [read(p) for p in prefixes])


def checked_files(spark: SparkSession, path: str, digests: dict[str, str]) -> DataFrame:
    """(name, sha256) of the files of a folder; refused if one is missing or has another SHA-256 than told."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    told = {r.name: r.sha256 for r in found.where(F.col("name").isin(*digests)).collect()}  # a row per told file
    if wrong := [n for n, d in digests.items() if told.get(n) != d]:
        raise GateError("checksum_mismatch", ", ".join(wrong))
    return found


def dataset_specs(spark: SparkSession, preferred: str, other: str, key: str) -> DataFrame:
    """Dataset descriptions (a JSON file each) of two folders, by key; fields of the preferred folder come first."""
    read = lambda path: spark.read.option("multiLine", True).json(path)
    return merge_specs(read(preferred), read(other), key)


def materialize_dataset(splits: dict[str, DataFrame], path: str, dataset: str) -> dict:
    """Writes the splits and a manifest with their rows and columns; what it gives is that manifest."""
    save_splits(splits, f"{path}/data")
    manifest = {"dataset_id": dataset, "splits": {name: {"rows": df.count(), "columns": df.columns} for name, df in splits.items()}}
    one = next(iter(splits.values())).sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    one.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def materialization_status(spark: SparkSession, path: str) -> DataFrame:
    """(split, told, found, complete): rows that the manifest tells and those that are there."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    told = spark.createDataFrame([(k, v["rows"]) for k, v in manifest["splits"].items()], "split string, told long")
    there = spark.read.parquet(f"{path}/data").groupBy("split").agg(F.count(F.lit(1)).alias("found"))
    return told.join(there, "split", "left").select("split", "told", F.coalesce("found", F.lit(0)).alias("found"), (F.col("told") == F.coalesce("found", F.lit(0))).alias("complete"))


def register_dataset(spark: SparkSession, source: str, path: str, dataset: str, *, target: str, header: bool = True, key_seed: int = 0, share: float = 0.8) -> dict:
    """A table of a user as a dataset: columns typed by what they hold, missing values refused, rows split by a seeded hash of all their fields, and a description of it all."""
    raw = load_table(spark, source, header=header)
    groups = partition_columns(raw, target=target)
    clean = sanitize(raw, groups["numeric"], groups["categorical"])
    part = F.pmod(F.xxhash64(F.lit(key_seed), *clean.columns), F.lit(1_000_000)) < int(share * 1_000_000)
    manifest = materialize_dataset({"train": clean.where(part), "test": clean.where(~part)}, path, dataset)
    return manifest | {"columns": groups, "target": target}


def delimited_records(spark: SparkSession, path: str, names: list[str], delimiter: str, *, strip_suffix: str = "", skip: str | None = None, ascii_only: bool = False) -> DataFrame:
    """Lines of exactly ``len(names)`` fields; others are refused with their count. Blank lines and a header line go.

    With ``ascii_only`` lines with other characters or a carriage return are refused.
    """
    lines = spark.read.option("lineSep", "\n").text(path).where(F.length("value") > 0)
    if ascii_only and lines.where(F.col("value").rlike(r"[^\x00-\x7f]|\r")).limit(1).count():
        raise GateError("schema_mismatch", "a line is not plain ASCII ended by a line feed")
    if skip is not None:
        lines = lines.where(~F.col("value").startswith(skip))
    fields = F.split("value", "\\Q" + delimiter + "\\E")
    parsed = lines.select(fields.alias("f"))
    wrong = parsed.where(F.size("f") != len(names)).limit(1).count()
    if wrong:
        raise GateError("schema_mismatch", "a line has a wrong number of fields")
    last = F.regexp_replace(F.get("f", F.lit(len(names) - 1)), "\\Q" + strip_suffix + "\\E$", "") if strip_suffix else F.get("f", F.lit(len(names) - 1))
    return parsed.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names[:-1])], last.alias(names[-1]))


def class_and_record(df: DataFrame, column: str, classes: list[str], fields: int | None = None) -> DataFrame:
    """Splits ``class.|id`` into the class and a record id, which must be unique; ``fields`` columns are asked for if told."""
    if fields is not None and len(df.columns) != fields:
        raise GateError("schema_mismatch", f"{len(df.columns)} fields, expected {fields}")
    pattern = rf"\A({'|'.join(classes)})\.\|([0-9]+)\z"
    out = df.withColumn("record_id", F.regexp_extract(column, pattern, 2)).withColumn(column, F.regexp_extract(column, pattern, 1))
    counts = out.agg(F.count_if(F.col(column) == "").alias("bad"), F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("ids")).first()
    if counts.bad:
        raise GateError("type_mismatch", column)
    if counts.n != counts.ids:
        raise GateError("duplicate_records")
    return out
