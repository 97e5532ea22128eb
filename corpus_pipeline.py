"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next.

Every stage but the last returns the columns of documents, whatever they are called, and works on all rows that the one
before kept. Rows with a null id take part under a stand-in made from their text, which is greater than any real id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from ledgerlens.llm import bpe, decontamination, language, near_dedup, substring_dedup
from ledgerlens.llm.catalog import learnable
from ledgerlens.llm.common import WORD, keep, shared_folder, small

KEY = "__key"
#: Percent of common shingles, and minhashes a small hash, of the near-duplicate stage.
ALIKE, ROWS = 80, 4


def keyed(docs: DataFrame) -> DataFrame:
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    return docs.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), stand_in))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: no letters, or unlike all languages they learned."""
    model = language.fit(learnable(docs).select("doc_id", "text", "lang"), ["doc_id"])
    if model is None:  # nothing to learn from, so nothing to reject by
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]  # other columns may be called like the results
    judged = language.predict(docs.toDF(*names), model, text=names[docs.columns.index("text")], keep_text=True)
    return judged.where(~F.col("rejected")).select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; equal rows are one document."""
    found = near_dedup.near_duplicates(keyed(docs).select(KEY, "text"), KEY, "text", ALIKE, rows=ROWS)
    kept = keep(found.where("kept").select(F.col("row").alias("__row")).distinct())
    rows = keyed(docs).withColumn("__row", F.xxhash64(KEY, "text"))
    return rows.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*[f"`{c}`" for c in docs.columns])


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are taken out; documents of which no word is left go."""
    rows = keyed(docs)
    found = substring_dedup.shared_passages(rows.select(KEY, "text"), KEY)
    before = rows.withColumn("__before", F.octet_length("text"))
    cut = substring_dedup.remove_passages(before, found, KEY)
    same = F.col("text").isNull() | (F.octet_length("text") == F.col("__before"))
    left = cut.where(same | F.col("text").rlike(WORD))
    size = F.when(same, F.col("n_chars")).otherwise(F.char_length("text"))
    return left.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    rows = keyed(docs)
    found = decontamination.find_leaks(rows.select(KEY, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), KEY)
    leaks = keep(found.select(KEY).distinct())
    return rows.join(small(leaks), KEY, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the same bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", digest.alias("digest"))
    encoded = bpe.encode(rows, path, decoded="decoded", drop=True)
    return encoded.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_shared_passages),
    ("decontamination", drop_leaks),
    ("bpe", encode_documents),
]

#: SQL can express neither the fitted language models nor alignments nor merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What passes between stages lies in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{number}-{name}")
            docs = spark.read.parquet(f"{place}/{number}-{name}")
    return docs
