"""Reading and writing tables. Schemas are given, paths may be folders or globs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str = "UTF-8", rename: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the data once more.

    An unnamed index column arrives as ``_c0``; name it in ``drop``.
    """
    reader = spark.read.option("header", True).option("encoding", encoding).option("enforceSchema", False)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.drop(*drop).withColumnsRenamed(dict(rename or {}))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Convert once; later reads use the columnar copy."""
    read_csv(spark, source, schema, **options).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Transactions with their identity rows, if any."""
    return left.join(right, key, "left")


def read_tagged(spark: SparkSession, paths: Mapping[str, str], tag: str = "split", form: str = "parquet") -> DataFrame:
    """Stack several sources, each row tagged with its source's name."""
    out = None
    for name, path in paths.items():
        part = spark.read.format(form).load(path).withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# --- labelled text lines ----------------------------------------------------

# Sentiment names and their codes.
SENTIMENT = {"negative": 0, "neutral": 1, "positive": 2}
BLANK = " \t\r\n"


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One row per line in the column ``value``; other charsets go through the CSV reader, which decodes them."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return spark.read.text(path)
    reader = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").option("escape", "")
    return reader.schema("value string").csv(path)


def _coded(df: DataFrame, labels: Mapping[str, int]) -> DataFrame:
    code = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("_name"))
    return df.withColumn("label", code).where(F.col("label").isNotNull()).drop("_name")


def parse_sentence_at_label(lines: DataFrame, labels: Mapping[str, int] = SENTIMENT, line: str = "value") -> DataFrame:
    """Lines ``sentence@label``; the last ``@`` separates. Lines without a known label are left out."""
    text = F.btrim(F.col(line), F.lit(BLANK))
    name = F.substring_index(text, "@", -1)
    rows = lines.where(F.contains(F.col(line), F.lit("@"))).withColumns(
        {
            "sentence": F.btrim(F.substring(text, F.lit(1), F.length(text) - F.length(name) - 1), F.lit(BLANK)),
            "_name": F.lower(F.btrim(name, F.lit(BLANK))),
        }
    )
    return _coded(rows.drop(line), labels)


def parse_label_comma_sentence(lines: DataFrame, labels: Mapping[str, int] = SENTIMENT, line: str = "value", longer_than: int = 5) -> DataFrame:
    """Lines ``label,sentence``; the first comma separates, quotes are stripped, short sentences left out."""
    parts = F.split(F.btrim(F.col(line), F.lit(BLANK)), ",", 2)
    plain = lambda c: F.btrim(F.btrim(c, F.lit(BLANK)), F.lit('"'))
    rows = lines.where(F.contains(F.col(line), F.lit(","))).withColumns(
        {"sentence": plain(parts[1]), "_name": F.lower(plain(parts[0]))}
    )
    return _coded(rows.where(F.length("sentence") > longer_than).drop(line), labels)


def clean_sentences(df: DataFrame, text: str, label: str, longer_than: int = 5) -> DataFrame:
    """Trimmed text, whole-number label, rows without either or with short text left out."""
    rows = df.withColumns({text: F.btrim(F.col(text), F.lit(BLANK)), label: F.col(label).try_cast("int")})
    return rows.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(text) > longer_than))


# --- sinks ------------------------------------------------------------------

def write_table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small aggregate as one CSV file with a header; only its rows meet in one task, not the work before."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_stats(stats: Mapping[str, DataFrame], folder: str) -> None:
    """Fitted statistics frames, one parquet folder each."""
    for name, df in stats.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_stats(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The written table if there is one, else build and write it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise  # a table that can't be read is not one that isn't there
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
