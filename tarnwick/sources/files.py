"""Import and export of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def import_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, delimiter: str = ",", line_breaks: bool = False) -> DataFrame:
    """A CSV file; give a schema for large files, else types are inferred in one more pass.  line_breaks: fields may hold some, and no file can be split."""
    reader = spark.read.option("header", header).option("sep", delimiter).option("escape", '"').option("multiLine", line_breaks)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def import_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """A JSON document on each line; lines=False for files that are one document or array each, which cannot be split."""
    reader = spark.read.option("multiLine", not lines)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def preview(df: DataFrame, rows: int = 20) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(rows).collect()]


def export_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    df.write.option("header", header).option("sep", delimiter).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT a row, in the dialect, as column value."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string",):
            text = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
        elif kind == "binary":
            text = F.concat(F.lit("x'"), F.hex(c), F.lit("'"))
        elif kind == "date":
            text = F.concat(F.lit("DATE'"), c.cast("string"), F.lit("'"))
        elif kind.startswith("timestamp"):
            text = F.concat(F.lit("TIMESTAMP'"), c.cast("string"), F.lit("'"))
        elif kind.startswith(("struct", "array", "map")):
            raise EngineError(f"column {name} of type {kind} has no literal")
        else:
            text = c.cast("string")
        parts.append(F.coalesce(text, F.lit("NULL")))
    names = ", ".join(f'"{n}"' for n in df.columns)
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), F.concat_ws(", ", *parts), F.lit(");")).alias("value"))


def export_sql(df: DataFrame, table: str, path: str) -> None:
    insert_statements(df, table).write.text(path)
