"""Readers of tables by suffix, of many result files at once, and of parameters held in paths and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet, ORC, JSON or CSV table by the suffix of its path; CSV needs a schema or gives strings."""
    low = path.lower().rstrip("/").removesuffix(".gzip").removesuffix(".gz")
    if low.endswith((".csv", ".txt")):
        return read_csv(spark, path, schema)
    kind = "json" if low.endswith((".json", ".jsonl")) else "orc" if low.endswith(".orc") else "parquet"
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; quotes are doubled inside fields, fields may span lines; an unnamed saved index goes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(list(path) if not isinstance(path, str) else path)
    return df.drop(*[c for c in df.columns if c in ("_c0", "Unnamed: 0", "")])


def read_many(spark: SparkSession, pattern: str, kind: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """All files of a pattern as one table with their path; unreadable files are skipped."""
    reader = spark.read.format(kind).option("ignoreCorruptFiles", True)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader).load(pattern)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def path_parameters(path: Column, places: dict[str, int], separator: str = "_", folder: int = -2) -> dict[str, Column]:
    """Parameters by their place, from the end, in a folder's name; null where there are too few parts."""
    parts = F.split(F.element_at(F.split(path, "/"), folder), separator)
    return {name: F.try_element_at(parts, F.lit(place)) for name, place in places.items()}


def name_parameters(path: Column, patterns: dict[str, str], part: int = -1) -> dict[str, Column]:
    """Parameters by a regular expression's first group on the name of the file, or of another part of the path; null where it doesn't match."""
    name = F.element_at(F.split(path, "/"), part)
    return {n: F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for n, p in patterns.items()}


def bundle_to_long(df: DataFrame, keys: Sequence[str], arrays: dict[str, str]) -> DataFrame:
    """Rows of parallel arrays as one row per position: arrays maps column to output name; unequal lengths are an error."""
    sizes = [F.size(c) for c in arrays]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.when(same, F.arrays_zip(*[F.col(c).alias(n) for c, n in arrays.items()])).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    return df.select(*keys, F.posexplode(zipped).alias("position", "__z")).select(*keys, "position", *[F.col(f"__z.{n}").alias(n) for n in arrays.values()])


def vector_text(text: Column) -> Column:
    """An array of numbers from "[0.1 0.9]"."""
    return F.transform(F.split(F.trim(F.translate(text, "[],", "   ")), r"\s+"), lambda x: x.try_cast("double"))


def normalised_predictions(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Prediction tables of different methods as one: method, target (with - for _), split, key, score, y."""
    out = None
    for method, df in parts:
        part = df.select(F.lit(method).alias("method"), F.translate("target", "_", "-").alias("target"), "split", "key", F.col("score").cast("double").alias("score"), F.col("y").cast("int").alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of strings, one document per file, as rows (id, text)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "text"))
