"""The training-data pipeline: five operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.cluster import ship
from grafwerk.llm import decontaminate, mixing, near_dups, perplexity, tokens
from grafwerk.llm.common import fresh_path, written

MOST_BROADCAST = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, and the key's name: a hash of the row's file and place, the same whenever the files are read.

    Documents that don't come from files are written first. The name is one that no column has.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    where = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(key)
    try:
        return docs.select("*", where), key
    except AnalysisException:
        return written(docs, "documents").select("*", where), key


def _where(docs: DataFrame, key: str, rows: DataFrame, kind: str) -> DataFrame:
    """The columns of documents of those rows whose key is in rows (kind left_semi) or isn't (left_anti): broadcast if few, else joined."""
    rows = written(rows.select(key).distinct(), "keys")
    if rows.count() <= MOST_BROADCAST:
        rows = F.broadcast(rows)
    return docs.join(rows, key, kind).drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the Kneser-Ney classifier keeps.

    Each row is judged by its own text, whatever its doc_id (null or repeated). Null, empty and wordless texts go. Long texts
    are judged whole. No documents, no rows; no trusted documents, all rows with words stay. Columns beyond those of
    documents come along.
    """
    ship(spark)
    rows, key = _keyed(docs)
    return _where(rows, key, perplexity.classify(rows, _table(spark, sf_dir, "labels"), key).filter("NOT kept"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that with the smallest doc_id (null last; of equal ones, that with the smallest key).

    Rows are compared by their texts alone, so rows with one doc_id and other texts are told apart, and rows without a
    doc_id are grouped too. Rows without words have no group and stay. Texts of any length are compared whole; an empty table
    stays empty; columns beyond those of documents come along.
    """
    ship(spark)
    rows, key = _keyed(docs)
    found = near_dups.groups(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    grouped = written(found.join(found.groupBy("component_id").count().filter("count > 1").select("component_id"), "component_id", "left_semi"), "groups")
    named = written(_where_ids(rows, key, grouped), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)
    stays = named.groupBy("component_id").agg(F.min(rank).alias("first")).select(F.col(f"first.{key}").alias(key))
    return _where(rows, key, named.select(key).join(stays, key, "left_anti"), "left_anti")


def _where_ids(rows: DataFrame, key: str, grouped: DataFrame) -> DataFrame:
    """key, doc_id, component_id of the grouped rows."""
    if grouped.count() <= MOST_BROADCAST:
        grouped = F.broadcast(grouped)
    return rows.select(key, "doc_id").join(grouped, key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark item, by their own texts, whatever their doc_ids.

    Null and empty texts hold none and stay; long ones are searched whole; an empty table stays empty; columns beyond those of
    documents come along.
    """
    ship(spark)
    rows, key = _keyed(docs)
    found = decontaminate.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark"))
    return _where(rows, key, found.select(F.col("doc_id").alias(key)), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: rows repeat, and those with no copy go.

    Every row is a document of its own, repeated doc_ids too. Rows without words are taken as often as their source's whole
    copies say. An empty table stays empty; columns beyond those of documents come along.
    """
    ship(spark)
    rows, key = _keyed(docs)
    columns = docs.columns
    copies = mixing.mix(rows, key).select("_key", "copies")
    copies = written(copies.filter("copies <> 1"), "copies")
    if copies.count() <= MOST_BROADCAST:
        copies = F.broadcast(copies)
    counted = rows.select(F.struct(*columns).alias("_doc"), F.col(key).alias("_key")).join(copies, "_key", "left")
    times = F.coalesce("copies", F.lit(1)).cast("int")
    return counted.filter(times > 0).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).select("_doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, read back: one row per row of the mix, with its place among all ids, their checksum and its shard.

    Null and empty texts are the end id alone; rows with one doc_id stay apart, in an order of their texts; no rows, no shards.
    """
    ship(spark)
    manifest = tokens.write_shards(docs, fresh_path(spark, "corpus-ids"), tokens.vocabulary_path())
    return tokens.read_digests(manifest)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token ids", token_ids),
]

#: Perplexities and tokenizers can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents on; each is written to the shared folder and read again as the next one's documents."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
