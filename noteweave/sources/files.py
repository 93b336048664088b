"""Notes, records and terminologies read from and written to files, many at once."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECORD = "array<struct<text:string,position:array<int>,type:string,assertions:array<string>,candidates:array<string>>>"
RRF = "RXCUI LAT TS LUI STT SUI ISPREF RXAUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF".split()


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, ord, text): one row per UTF-8 text file; ``ord`` is the number in its name, null for a name that is none."""
    d = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("file_id"), F.col("value").alias("text"))
    return d.select("file_id", F.col("file_id").try_cast("long").alias("ord"), "text")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, records): one JSON array of records per file; null records for a file that isn't one."""
    d = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("file_id"), F.col("value").alias("v"))
    return d.select("file_id", F.from_json("v", RECORD).alias("records"))


def format_records(spans: DataFrame) -> DataFrame:
    """(id, json): per text its records by position, as one JSON array; candidates only for types that have codes.

    ``spans``: id, text, start_pos, end_pos, entity_type, assertions, candidates. A text's records form one row.
    """
    coded = F.col("entity_type").isin("THUỐC", "CHẨN_ĐOÁN")
    none = F.array().cast("array<string>")
    record = F.struct(
        F.col("text"), F.array("start_pos", "end_pos").alias("position"), F.col("entity_type").alias("type"),
        F.coalesce("assertions", none).alias("assertions"), F.when(coded, F.coalesce("candidates", none)).alias("candidates"),
    )
    g = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "entity_type", record.alias("r")))).alias("s"))
    return g.select("id", F.to_json(F.transform("s", lambda x: x["r"])).alias("json"))


def read_diagnosis_csv(spark: SparkSession, path: str) -> DataFrame:
    """A diagnosis list: semicolons, byte-order mark, all strings; the second line (a description of columns) is left out."""
    d = spark.read.csv(path, sep=";", header=True, inferSchema=False)
    d = d.toDF(*(c.lstrip("﻿") for c in d.columns))
    first = d.columns[0]
    return d.filter(F.col(first).rlike(r"^[A-Z][0-9]{2}(?:\.[0-9]+)?$")).na.fill("")


def read_drug_rrf(spark: SparkSession, path: str) -> DataFrame:
    """A drug terminology: bars, 18 columns and a bar at each line's end, no header, empty strings rather than nulls."""
    parts = F.split("value", r"\|", -1)
    return spark.read.text(path).filter("value != ''").select(*(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(RRF)))


def keep_drug_rows(df: DataFrame, sources: list[str], types: list[str]) -> DataFrame:
    """English rows of given sources and term types that are named and not suppressed."""
    return df.filter((F.col("LAT") == "ENG") & F.col("SAB").isin(sources) & F.col("TTY").isin(types) & ~F.col("SUPPRESS").isin("O", "Y", "E") & (F.trim("STR") != ""))


def in_natural_order(df: DataFrame, name: str) -> DataFrame:
    """Rows by the number that a name is, names that are none after them by spelling."""
    n = F.col(name).try_cast("long")
    return df.orderBy(n.isNull(), n, name)


# --- samples, records and tables written -------------------------------------------------------------------------------

SAMPLE = "file_id string, text string, source string, confidence_tier string, generator_version string, seed int, entities array<struct<text:string,start:int,end:int,type:string,source:string,metadata:struct<template_family:string,concept_family:string,noise_profile:string,concept_id:string,original_sample_id:string,transformations:array<string>>>>"


def write_samples(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; mode "append" adds to what is there."""
    samples.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples as written, by a fixed schema; a line that is no object has nulls."""
    return spark.read.schema(SAMPLE).json(path)


def write_records(formatted: DataFrame, path: str) -> None:
    """(id, json) as text files, a folder for each document named after it."""
    formatted.select("json", F.col("id").cast("string").alias("doc")).write.mode("overwrite").partitionBy("doc").text(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Terminology or index tables as Parquet, one folder each; a later read needs no building."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Tables written by ``write_tables``, only the given columns of each (all for an empty list)."""
    return {name: spark.read.parquet(f"{folder}/{name}").select(*(c or ["*"])) for name, c in columns.items()}


def store_key(*parts: str):  # noqa: ANN201
    """The key of a stored result: a hash of the columns it depends on."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256)


def split_by_store(wanted: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): rows of ``wanted`` (key, ...) with the stored value, and those without one. The newest value of a key counts."""
    w = W.partitionBy("key").orderBy(F.col("stored_at").desc())
    newest = store.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return wanted.join(newest, "key"), wanted.join(newest, "key", "left_anti")


# --- small files on the driver -----------------------------------------------------------------------------------------


def write_text(path: str, text: str) -> None:
    """A UTF-8 file; folders above it are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_json(path: str, value: object) -> None:
    """Indented JSON with letters as they are, ending with a line end."""
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def zip_records(folder: str, path: str, count: int, root: str = "output", overwrite: bool = False) -> list[str]:
    """``1.json`` to ``count.json`` of a folder in one archive. Raises if one is missing or the archive exists."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    names = [f"{i}.json" for i in range(1, count + 1)]
    gone = [n for n in names if not os.path.isfile(os.path.join(folder, n))]
    if gone:
        raise FileNotFoundError(", ".join(gone))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(os.path.join(folder, n), f"{root}/{n}")
    return names


def merged(base: dict, change: dict) -> dict:
    """``base`` with the values of ``change``, mappings merged level by level."""
    out = dict(base)
    for k, v in change.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def load_config(path: str, seen: tuple[str, ...] = ()) -> dict:
    """A YAML mapping over the one it ``extends``, and so on. Raises on a circle or on anything but a mapping."""
    import yaml

    here = os.path.abspath(path)
    if here in seen:
        raise ValueError("configurations extend each other: " + " -> ".join([*seen, here]))
    with open(here, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    if not isinstance(own, dict):
        raise ValueError(f"{path} is no mapping")
    above = own.pop("extends", None)
    return merged(load_config(os.path.join(os.path.dirname(here), above), (*seen, here)), own) if above else own
