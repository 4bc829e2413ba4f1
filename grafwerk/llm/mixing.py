"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words; a whole number of copies of each of its documents is certain, and what is left of
the target is filled by Pareto order sampling with unequal inclusion odds. A document's chance p of one more copy is in
proportion to the binary digits of its size, so longer documents are likelier to be taken: p = min(1, c * digits), with c
so that the expected words of a source are the words left; those with p = 1 are certain. The others are ranked by
(u / (1 - u)) / (p / (1 - p)), u a fixed uniform number of the document, and taken from the smallest on until the words
left are reached.

c has a closed form over at most 64 classes of digits, so the words are summed by source and class first. The ranking never
puts a source into one task: documents fall into buckets of their rank, sized so that one holds about ROWS_A_BUCKET rows
whatever the size of the source; running totals are made over bucket totals, and only the bucket where the target is
crossed is ordered row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # all targets are 3/2 of all sizes
MOST = 2
ROWS_A_BUCKET = 4096
U_BITS = 52
MOST_BROADCAST = 1_000_000


def uniform(doc_id: Column) -> Column:
    """52 bits from the MD5 of the document's id: the same in every run and in SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target: weights repeat over sources by code point, null last.

    Targets share SHARE of all sizes by weight; one stops at MOST times its source's size, and the excess
    goes to the others by weight. In order of size / weight those that stop come first, so running sums give
    the level at which the rest stand. One row per source, so the windows hold as many rows as there are sources.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(named) - 1) % len(WEIGHTS) + 1).cast("long")
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    up, down = SHARE
    s = (
        sources.withColumn("weight", w)
        .withColumn("_left", F.sum("source_size").over(every) * up - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (MOST * down))
        .withColumn("_w", F.sum("weight").over(after))
        .withColumn("_stops", F.col("_left") * F.col("weight") >= F.col("source_size") * (MOST * down) * F.col("_w"))
    )
    level = F.min(F.when(~F.col("_stops"), F.struct((F.col("source_size") / F.col("weight")).alias("k"), "_left", "_w"))).over(every)
    return (
        s.withColumn("_at", level)
        .withColumn("target", F.when(F.col("_stops"), (F.col("source_size") * MOST).cast("double")).otherwise((F.col("_at._left") * F.col("weight")).cast("double") / (F.col("_at._w") * down).cast("double")))
        .select("source", "source_size", "weight", "target")
    )


def chances(classes: DataFrame) -> DataFrame:
    """(source, digits, words, rest) -> with sure (documents of that class are certain), c and left (words to sample) of the source.

    From the longest class down, a class is certain if c, reckoned with all longer ones certain, would make p 1 or more.
    """
    above = Window.partitionBy("source").orderBy(F.desc("digits")).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("source").orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = (
        classes.withColumn("_left", F.col("rest") - F.coalesce(F.sum("words").over(above), F.lit(0)).cast("double"))
        .withColumn("_points", F.sum(F.col("words") * F.col("digits")).over(down).cast("double"))
        .withColumn("sure", (F.col("rest") > 0) & (F.col("_left") * F.col("digits") >= F.col("_points")))
    )
    first = F.max(F.when(~F.col("sure"), F.struct("digits", "_left", "_points"))).over(Window.partitionBy("source"))
    return s.withColumn("_first", first).select("source", "digits", "sure", F.try_divide("_first._left", "_first._points").alias("c"), F.col("_first._left").alias("left"))


def mix(documents: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken, p, odds (by which rows are ranked): one row per row of documents.

    documents needs doc_id, text and source; a column `key` comes along if it is named, other columns are ignored, whatever
    their names. A null text has size 0 and takes 0 words; a null source is a source
    of its own. Rows with one doc_id share u and, where sizes are equal, a rank; a null doc_id has the u of an empty id. Texts
    of any length are counted whole. An empty table gives an empty result. If no document has a word, nothing is taken.
    """
    kept = [F.col(key).alias("_key")] if key else []
    rows = written(
        documents.select(*kept, F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).withColumn("u", uniform(F.col("doc_id"))).withColumn("digits", F.length(F.bin("size"))),
        "mix-sizes",
    )
    n = rows.count()
    classes = written(rows.groupBy("source", "digits").agg(F.sum("size").alias("words")), "mix-classes")  # 64 rows a source at most
    planned = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    planned = planned.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    joined = classes.join(planned.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    of = chances(joined.select("source", "digits", "words", "rest")).select(F.col("source").alias("_s"), F.col("digits").alias("_d"), "sure", "c", "left")
    plan = written(joined.join(of, F.col("source").eqNullSafe(F.col("_s")) & (F.col("digits") == F.col("_d"))).select(F.col("source").alias("_source"), F.col("digits").alias("_digits"), "source_size", "target", "whole", "rest", "sure", "c", "left"), "mix-plan")
    if plan.count() <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    x = F.col("u") / F.lit(float(1 << U_BITS))
    p = F.when((F.col("rest") > 0) & ~F.col("sure"), F.col("c") * F.col("digits"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("digits") == F.col("_digits"))).withColumn("p", p)
    rows = rows.withColumn("odds", F.when(F.col("p") > 0, F.try_divide(x / (1 - x), F.try_divide(F.col("p"), 1 - F.col("p")))))
    bits = max(0, min(40, math.ceil(math.log2(max(1, n) / ROWS_A_BUCKET))))
    place = F.floor(F.col("odds") / (1 + F.col("odds")) * F.lit(float(1 << bits))).cast("long")
    rows = rows.withColumn("bucket", F.when(F.col("odds").isNotNull(), place))
    out = ["doc_id", "size", "source", "source_size", "target", (F.col("whole") + F.col("more").cast("long")).alias("copies"), ((F.col("whole") + F.col("more").cast("long")) * F.col("size")).alias("taken"), F.when((F.col("rest") > 0) & F.col("sure"), F.lit(1.0)).otherwise(F.coalesce("p", F.lit(0.0))).alias("p"), "odds"]
    out = ["_key", *out] if key else out
    settled = rows.filter("odds IS NULL").withColumn("more", (F.col("rest") > 0) & F.col("sure"))
    ranked = rows.filter("odds IS NOT NULL")
    totals = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("_words"), F.max("left").alias("left"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_words").over(up_to), F.lit(0))).withColumn("_crossing", (F.col("_base") <= F.col("left")) & (F.col("_base") + F.col("_words") > F.col("left")))
    totals = totals.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "_base", "_words", "_crossing")
    crossed = written(totals.filter("_crossing"), "mix-crossed")  # one row a source at most
    edge = crossed.select("_s", "_b", "_base")
    if edge.count() <= MOST_BROADCAST:
        edge = F.broadcast(edge)
    near = ranked.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left")
    # without a crossing bucket all of a source's ranked documents fit
    sure = near.filter(F.col("_b").isNull() | (F.col("bucket") != F.col("_b"))).withColumn("more", F.col("_b").isNull() | (F.col("bucket") < F.col("_b")))
    within = Window.partitionBy("source").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within_crossing = near.filter(F.col("bucket") == F.col("_b")).withColumn("more", F.col("_base") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2 <= F.col("left"))
    return settled.select(*out).unionByName(sure.select(*out)).unionByName(within_crossing.select(*out))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, sum(source_size) OVER () * 3
           - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 AS lft,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr
  FROM w),
c AS (SELECT *, lft * weight >= source_size * 4 * wr AS stops FROM l),
f AS (SELECT lft, wr FROM c WHERE NOT stops ORDER BY source_size / weight, lft, wr LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN stops THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST((SELECT lft FROM f) * weight AS DOUBLE) / CAST((SELECT wr FROM f) * 2 AS DOUBLE) END AS target
  FROM c),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(2, floor(target / source_size)) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0.0, target - whole * source_size) AS rest FROM p),
b AS (SELECT source, length(bin(size)) AS digits, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
k AS (
  SELECT b.*, q.rest,
         q.rest - CAST(coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lft,
         CAST(sum(words * digits) OVER (PARTITION BY b.source ORDER BY digits ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS points
  FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source),
m AS (SELECT *, rest > 0 AND lft * digits >= points AS sure FROM k),
o AS (SELECT source, max(digits) AS top FROM m WHERE NOT sure GROUP BY source),
g AS (
  SELECT m.source, m.digits, m.sure, z.lft / z.points AS c, z.lft
  FROM m LEFT JOIN o ON m.source IS NOT DISTINCT FROM o.source
  LEFT JOIN m z ON z.source IS NOT DISTINCT FROM m.source AND z.digits = o.top),
i AS (
  SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.whole, q.rest, g.sure, g.lft,
         CASE WHEN q.rest > 0 AND NOT g.sure THEN g.c * g.digits END AS p,
         d.u / CAST(4503599627370496 AS DOUBLE) AS x
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
  JOIN g ON d.source IS NOT DISTINCT FROM g.source AND length(bin(d.size)) = g.digits),
j AS (SELECT *, CASE WHEN p > 0 THEN (x / (1 - x)) / (p / (1 - p)) END AS odds FROM i),
r AS (
  SELECT *, coalesce(sum(CASE WHEN odds IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM j)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN odds IS NULL THEN CAST(rest > 0 AND sure AS INT) WHEN before + size / 2 <= lft THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
