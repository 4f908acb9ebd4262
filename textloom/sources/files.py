"""Tables by path and type: reading, writing, finding files, label files, matrices and factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a suffix is read and written.
FORMATS = {"csv": ("csv", {"header": "true"}), "tsv": ("csv", {"header": "true", "sep": "\t"}), "json": ("json", {}), "jsonl": ("json", {}), "parquet": ("parquet", {}), "orc": ("orc", {}), "txt": ("text", {}), "html": ("text", {"wholetext": "true"})}


def format_of(path: str) -> tuple[str, dict[str, str]]:
    """Format and options by the last suffix of a path; other suffixes are read as bytes."""
    name = path.rstrip("/").rpartition("/")[2]
    return FORMATS.get(name.rpartition(".")[2].lower() if "." in name else "parquet", ("binaryFile", {}))


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table at ``path``, a file or folder whose suffix tells its type; without ``schema``, csv columns are text."""
    kind, options = format_of(path)
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def save(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes the table to the folder ``path`` in the form its suffix tells."""
    kind, options = format_of(path)
    if kind == "binaryFile":
        raise ValueError(f"no table is written as {path!r}")
    table.write.format(kind).options(**{k: v for k, v in options.items() if k != "wholetext"}).mode(mode).save(path)


def find_files(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "", deep: bool = True) -> DataFrame:
    """path, length, modificationTime of the files whose names have the prefix and suffix; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", f"{prefix}*{suffix}").load(folder)
    return files.select("path", "length", "modificationTime")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), label of a text file, which is one row while it is numbered."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\n$", ""), "\r?\n")
    return whole.select(F.posexplode(lines).alias("line", "label"))


def save_tensor(cells: DataFrame, names: dict[str, DataFrame], folder: str) -> None:
    """Cells and, for each mode, the table of its names, as parquet folders."""
    cells.write.parquet(f"{folder}/cells.parquet")
    for mode, table in names.items():
        table.write.parquet(f"{folder}/{mode}.parquet")


def load_tensor(spark: SparkSession, folder: str, modes: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    return spark.read.parquet(f"{folder}/cells.parquet"), {m: spark.read.parquet(f"{folder}/{m}.parquet") for m in modes}


def save_factors(factors: dict[int, DataFrame], path: str) -> None:
    """Factors of several ranks, a folder for each rank k."""
    for k, table in sorted(factors.items()):
        table.withColumn("k", F.lit(k)).write.mode("append").partitionBy("k").parquet(path)
