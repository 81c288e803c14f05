"""Whole-table backup as JSON lines, and its import with validation and key remapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2
KEEP = 10


def encode(df: DataFrame) -> DataFrame:
    """Binary columns as base64, null arrays as empty, times as ISO text: what JSON can hold."""

    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            return F.base64(c)
        if isinstance(f.dataType, T.ArrayType):
            return F.coalesce(c, F.array().cast(f.dataType))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return c

    return df.select(*[one(f).alias(f.name) for f in df.schema])


def decode(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The reverse of ``encode``; columns that are missing become null."""

    def one(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType)
        c = F.col(f"`{f.name}`")
        return F.unbase64(c) if isinstance(f.dataType, T.BinaryType) else c.cast(f.dataType)

    return df.select(*[one(f).alias(f.name) for f in schema])


def export_lines(tables: dict[str, DataFrame], omit: dict[str, list[str]] | None = None) -> DataFrame:
    """table, line: a header with the format's version, then one JSON object for each row."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.range(1).select(F.lit("_header").alias("table"), F.to_json(F.struct(F.lit(VERSION).alias("version"))).alias("line"))
    for name, df in tables.items():
        df = encode(df.drop(*(omit or {}).get(name, [])))
        out = out.unionByName(df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("line")))
    return out


def write(tables: dict[str, DataFrame], path: str, omit: dict[str, list[str]] | None = None) -> None:
    """One folder for each table, written in parallel."""
    export_lines(tables, omit).write.partitionBy("table").mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).text(path).select("table", F.col("value").alias("line"))


def import_table(lines: DataFrame, name: str, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines with the reason) of a table in a backup of this version or an earlier one."""
    header = lines.where(F.col("table") == "_header").select(F.get_json_object("line", "$.version").cast("int").alias("v")).first()
    if header is None or header["v"] not in range(1, VERSION + 1):
        raise ValueError(f"no backup of version 1 to {VERSION}")
    plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.BinaryType, T.TimestampType, T.TimestampNTZType)) else f.dataType) for f in schema] + [T.StructField("_bad", T.StringType())])
    parsed = lines.where(F.col("table") == name).select("line", F.from_json("line", plain, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    issue = F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "malformed")
    for c in required:
        issue = F.coalesce(issue, F.when(F.col(f"r.{c}").isNull(), F.lit(f"{c}: required")))
    marked = parsed.withColumn("_issue", issue)
    return decode(marked.where("_issue IS NULL").select("r.*"), schema), marked.where("_issue IS NOT NULL").select("line", F.col("_issue").alias("issue"))


def import_merge(existing: DataFrame, incoming: DataFrame, id_col: str, natural_keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged table, old id to new id, one row of counts): rows that match a natural key keep the id that exists."""
    from ..operators.relational import resolve_by_priority

    found = resolve_by_priority(incoming, existing, [id_col, *natural_keys], id_col, "_to")
    remap = found.select(F.col(id_col), F.coalesce("_to", id_col).alias("keeper"))
    added = found.where("_to IS NULL").drop("_to")
    counts = found.agg(F.count_if(F.col("_to").isNull()).alias("added"), F.count_if(F.col("_to").isNotNull()).alias("skipped"))
    return existing.unionByName(added, allowMissingColumns=True), remap, counts


def prune(snapshots: DataFrame, keep: int = KEEP, name_col: str = "name") -> DataFrame:
    """Names of snapshots beyond the newest ``keep`` (names sort by time)."""
    newest = snapshots.select(name_col).orderBy(F.desc(name_col)).limit(keep)
    return snapshots.join(newest, name_col, "left_anti").select(name_col)
