"""Program graphs derived from the star schema: supply graph, session graph and order chains, as symbols, files and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazily read tables of one directory, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in T:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def symbols(self) -> DataFrame:
        """symbol_id, kind, name, fqn, path, size: one row per region, nation, supplier, customer and part."""
        n = self.nation
        nation_path = F.concat(F.lit("nations/"), F.col("n_name"), F.lit(".py"))
        row = lambda df, letter, key, kind, name, fqn, path, size: df.select(F.concat(F.lit(letter), F.col(key)).alias("symbol_id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), fqn.alias("fqn"), path.alias("path"), size.cast("long").alias("size"))
        of_nation = lambda name: F.concat(F.lit("nations."), F.col("n_name"), F.lit("."), F.col(name))
        parts = [
            row(self.region, "R", "r_regionkey", "module", "r_name", F.concat(F.lit("regions."), F.col("r_name")), F.lit("regions/__init__.py"), F.lit(10)),
            row(n, "N", "n_nationkey", "class", "n_name", F.concat(F.lit("nations."), F.col("n_name")), nation_path, F.lit(20)),
            row(self.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")), "S", "s_suppkey", "function", "s_name", of_nation("s_name"), nation_path, F.length("s_name")),
            row(self.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")), "C", "c_custkey", "method", "c_name", of_nation("c_name"), nation_path, F.length("c_name")),
            row(self.part, "P", "p_partkey", "function", "p_name", F.concat(F.lit("parts."), F.regexp_replace("p_brand", "#", "_"), F.lit("."), F.col("p_name")), F.concat(F.when(F.col("p_brand") == "Brand#1", "tests/").otherwise("parts/"), F.col("p_brand"), F.lit(".py")), F.col("p_size")),
        ]  # nation has 25 rows at every scale
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def edges(self) -> DataFrame:
        """kind, src, dst (null: dangling), dst_name, line, conf, resolver of the supply graph."""
        edge = lambda df, kind, src, dst, name, line, conf, loose: df.select(F.lit(kind).alias("kind"), src.alias("src"), F.when(~loose, dst).alias("dst"), name.alias("dst_name"), line.cast("long").alias("line"), conf.cast("int").alias("conf"), F.lit("l0").alias("resolver"))
        key = lambda letter, c: F.concat(F.lit(letter), F.col(c))
        no = F.lit(False)
        sure = F.lit(2)
        l = self.lineitem.filter("l_linenumber = 1 AND l_quantity > 45").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
        conf = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
        loose = (F.col("l_linestatus") == "F") & (F.col("l_quantity") == 50)
        by = l.join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return (
            edge(self.nation, "inherits", key("N", "n_nationkey"), key("R", "n_regionkey"), key("R", "n_regionkey"), F.lit(1), sure, no)
            .unionByName(edge(self.supplier, "imports", key("S", "s_suppkey"), key("N", "s_nationkey"), key("N", "s_nationkey"), F.lit(2), sure, no))
            .unionByName(edge(self.customer, "imports", key("C", "c_custkey"), key("N", "c_nationkey"), key("N", "c_nationkey"), F.lit(3), sure, no))
            .unionByName(edge(l, "calls", key("S", "l_suppkey"), key("P", "l_partkey"), key("P", "l_partkey"), F.col("l_orderkey"), conf, loose))
            .unionByName(edge(by, "calls", key("C", "o_custkey"), key("S", "l_suppkey"), key("S", "l_suppkey"), F.col("l_orderkey"), conf, no))
        )

    def session_edges(self) -> DataFrame:
        """src, dst, conf: each error event's user, to the user of the next error event; cyclic."""
        e = self.events.filter("event_type = 'error'").select("event_id", "ts", "user_id", F.date_trunc("day", "ts").alias("day"))
        w = Window.partitionBy("day").orderBy("ts", "event_id")
        return e.withColumn("next", F.lead("user_id").over(w)).filter("next IS NOT NULL").select(F.concat(F.lit("U"), F.col("user_id")).alias("src"), F.concat(F.lit("U"), F.col("next")).alias("dst"), F.lit("calls").alias("kind"), F.lit(2).alias("conf"), F.col("event_id").alias("line"))

    def chain_edges(self) -> DataFrame:
        """src, dst, conf: each order to the same customer's previous order."""
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("before")).filter("before IS NOT NULL").select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("src"), F.concat(F.lit("O"), F.col("before")).alias("dst"), F.lit("calls").alias("kind"), F.lit(2).alias("conf"))


#: The same views in SQL, to stand before a query.
SQL = """
sym AS (
  SELECT 'R' || r_regionkey AS symbol_id, 'module' AS kind, r_name AS name, 'regions.' || r_name AS fqn, 'regions/__init__.py' AS path, CAST(10 AS BIGINT) AS size FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'class', n_name, 'nations.' || n_name, 'nations/' || n_name || '.py', 20 FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'function', s_name, 'nations.' || n_name || '.' || s_name, 'nations/' || n_name || '.py', length(s_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'C' || c_custkey, 'method', c_name, 'nations.' || n_name || '.' || c_name, 'nations/' || n_name || '.py', length(c_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'P' || p_partkey, 'function', p_name, 'parts.' || replace(p_brand, '#', '_') || '.' || p_name, CASE WHEN p_brand = 'Brand#1' THEN 'tests/' ELSE 'parts/' END || p_brand || '.py', p_size FROM part),
li AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS cf FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45),
edge AS (
  SELECT 'inherits' AS kind, 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'R' || n_regionkey AS dst_name, CAST(1 AS BIGINT) AS line, 2 AS conf FROM nation
  UNION ALL SELECT 'imports', 'S' || s_suppkey, 'N' || s_nationkey, 'N' || s_nationkey, 2, 2 FROM supplier
  UNION ALL SELECT 'imports', 'C' || c_custkey, 'N' || c_nationkey, 'N' || c_nationkey, 3, 2 FROM customer
  UNION ALL SELECT 'calls', 'S' || l_suppkey, CASE WHEN NOT (l_linestatus = 'F' AND l_quantity = 50) THEN 'P' || l_partkey END, 'P' || l_partkey, l_orderkey, cf FROM li
  UNION ALL SELECT 'calls', 'C' || o_custkey, 'S' || l_suppkey, 'S' || l_suppkey, l_orderkey, cf FROM li JOIN orders ON l_orderkey = o_orderkey),
sess AS (
  SELECT 'U' || user_id AS src, 'U' || nxt AS dst, 'calls' AS kind, 2 AS conf, event_id AS line FROM (
    SELECT event_id, user_id, lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'error') WHERE nxt IS NOT NULL),
chain AS (
  SELECT 'O' || o_orderkey AS src, 'O' || before AS dst, 'calls' AS kind, 2 AS conf FROM (
    SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL)
"""
