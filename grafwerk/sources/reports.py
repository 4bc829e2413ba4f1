"""Security reports and ground truth as DataFrames, and their measures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SARIF = "runs array<struct<tool: struct<driver: struct<name: string>>, results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>"
_SEMGREP = "results array<struct<check_id: string, path: string, start: struct<line: int>, extra: struct<message: string, severity: string, metadata: struct<cwe: string>>>>"
CATEGORIES = {"22": "path-traversal", "23": "path-traversal", "78": "command-injection", "79": "xss", "89": "sql-injection", "90": "ldap-injection", "94": "code-injection", "502": "deserialization", "643": "xpath-injection", "918": "ssrf"}


def cwes(text: Column) -> Column:
    """The CWE numbers in a text, without leading zeros, distinct and in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)cwe[-_ ]?0*(\d+)")), lambda x: x)))


def category(text: Column) -> Column:
    """The category of the first known CWE in a text, else of a word in it."""
    known = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    by_cwe = F.get(F.filter(F.transform(cwes(text), lambda c: F.try_element_at(known, c)), lambda c: c.isNotNull()), 0)
    t = F.lower(text)
    word = F.when(t.rlike("sql"), "sql-injection").when(t.rlike("command|os\\.system|exec"), "command-injection").when(t.rlike("xss|cross.site"), "xss").when(t.rlike("path|traversal"), "path-traversal").when(t.rlike("deserial|pickle"), "deserialization").when(t.rlike("ssrf"), "ssrf")
    return F.coalesce(by_cwe, word, F.lit("other"))


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """tool, rule, path, line, message, category."""
    r = spark.read.schema(_SARIF).option("multiLine", True).json(path)
    x = r.select(F.explode("runs").alias("run")).select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("x"))
    place = F.get("x.locations", 0)["physicalLocation"]
    return x.select("tool", F.col("x.ruleId").alias("rule"), F.regexp_replace(place["artifactLocation"]["uri"], "^file:/*", "/").alias("path"), place["region"]["startLine"].alias("line"), F.col("x.message.text").alias("message"), category(F.concat_ws(" ", "x.ruleId", "x.message.text")).alias("category"))


def read_semgrep(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(_SEMGREP).option("multiLine", True).json(path).select(F.explode("results").alias("x"))
    return r.select(F.lit("semgrep").alias("tool"), F.col("x.check_id").alias("rule"), F.col("x.path").alias("path"), F.col("x.start.line").alias("line"), F.col("x.extra.message").alias("message"), category(F.concat_ws(" ", "x.extra.metadata.cwe", "x.check_id", "x.extra.message")).alias("category"))


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """case_id, category, is_vulnerable, cwe of a CSV with # comment lines."""
    return spark.read.option("comment", "#").schema("case_id string, category string, is_vulnerable boolean, cwe string").csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, flaws: the files of an XML test manifest, and how many flaws each has."""
    text = spark.read.option("wholetext", True).text(path)
    files = text.select(F.explode(F.regexp_extract_all("value", F.lit(r'(?s)(<file path="[^"]*"(?:\s*/>|.*?</file>))'))).alias("x"))
    return files.select(F.regexp_extract("x", r'path="([^"]*)"', 1).alias("path"), F.regexp_count("x", F.lit("<(?:flaw|mixed)\\b")).cast("long").alias("flaws"))


def fingerprints(findings: DataFrame) -> DataFrame:
    """findings with a fingerprint of tool, rule, path and line; equal ones once."""
    key = F.substring(F.sha2(F.concat_ws("\u0000", "tool", "rule", "path", F.col("line").cast("string")), 256), 1, 24)
    return findings.withColumn("fingerprint", key).dropDuplicates(["fingerprint"])


def confusion_by_category(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """category, tp, fp, fn, tn, wrong_category per category of ground truth (case_id, category, is_vulnerable); findings have case_id, category."""
    f = findings.select("case_id", F.col("category").alias("said")).distinct().groupBy("case_id").agg(F.collect_set("said").alias("said"))
    x = expected.join(f, "case_id", "left").withColumn("hit", F.coalesce(F.array_contains("said", F.col("category")), F.lit(False)))
    v = F.col("is_vulnerable")
    return x.groupBy("category").agg(F.count_if(v & F.col("hit")).alias("tp"), F.count_if(~v & F.col("hit")).alias("fp"), F.count_if(v & ~F.col("hit")).alias("fn"), F.count_if(~v & ~F.col("hit")).alias("tn"), F.count_if(~F.col("hit") & (F.size("said") > 0)).alias("wrong_category"))


def case_name(path: str) -> str | None:
    m = re.search(r"(\w+Test\d+)", path)
    return m[1] if m else None
