"""Queries over sources: the connector's modes, learned shapes of documents, a keyspace walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators import discovery as V
from lakeward.plans import detector_sql as Q
from lakeward.plans.base import pick, pick_sql, read
from lakeward.plans.discovery_queries import _COLUMNS, _KEYS
from lakeward.sources import sampling as P
from lakeward.sources import shapes as S
from lakeward.sources.connector import Connector

_CHECKED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")
_LETTERS = ("0123456789", "abcdefghij")


def connector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables of the folder can be read, and how many rows they have by their footers."""
    return Connector(spark, sf_dir, include=_CHECKED).check().select("object", "readable", "problem", "rows")


def connector_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Connector(spark, sf_dir, include=_CHECKED).catalog().select("object", "field", "rows")


def connector_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discovery scan over all rows that the connector reads, and whole values; the fields are selected in its plan."""
    names = sorted({c for columns in _COLUMNS.values() for c in columns})
    values = Connector(spark, sf_dir, include=sorted(_COLUMNS)).discover().where(F.col("field").isin(*names))
    scan = V.scanned(values, ("email", "card_number"), whole=True)
    return V.decide(V.column_statistics(scan), V.hinted(_COLUMNS)).select("object", "field", "classifier", "sampled", "n", "matched", "candidates", "reported", "confidence")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON documents: a map keyed by customers (in letters), maps in lists, fields, long lists."""
    word = lambda c: F.translate(c.cast("string"), *_LETTERS)
    body = F.struct(
        F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("account")).alias("terms"),
        F.create_map(word(F.col("o_custkey")), F.struct(F.create_map(word(F.col("o_orderkey")), F.col("o_orderkey")).alias("seen"), F.lit(True).alias("known"))).alias("buyers"),
        F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 20 + 1).cast("int")), lambda i: F.struct(i.alias("line"))).alias("lines"),
    )
    # Orders are dealt out before documents are made of them: walking costs more than moving these columns.
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey").select("o_orderkey", F.to_json(body).alias("doc"))


def shape_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of documents by their learned shape, and how many documents were cut and why."""
    docs = _documents(spark, sf_dir)
    leaves = S.flatten_documents(docs, "o_orderkey", "doc", S.learn_shape(docs, "doc"))
    return leaves.groupBy("path", "cut").agg(F.count("*").alias("n"), F.count_distinct("value").alias("different"))


def keyspace_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers as keys of a key-value store."""
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"), F.lit("/items")).alias("key"), F.lit("list").alias("kind"))
    word = F.translate(F.col("c_custkey").cast("string"), *_LETTERS)
    first = F.when(F.col("c_custkey") % 3 == 0, "mail").when(F.col("c_custkey") % 3 == 1, "phone").otherwise("cart")
    customers = read(spark, sf_dir, "customer").select(F.concat(first, F.lit(":"), word).alias("key"), F.lit("string").alias("kind"))
    walked = P.keyspace_walk(orders.unionByName(customers), "key", "kind", 9)
    families = F.size(F.array_distinct(F.transform("samples", lambda s: F.regexp_extract(s, "^[a-z]+", 0)))).cast("long")
    return walked.select("pattern", "n", "families", F.size("samples").cast("long").alias("samples"), families.alias("sampled_families"))


_ENGINES = tuple(P.METHODS)


def sample_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How parts would be sampled as tables of some engine, by a count of rows made from their keys."""
    k = F.col("p_partkey")
    tables = read(spark, sf_dir, "part").select(pick(k, _ENGINES).alias("engine"), (k * k % 3_000_017).alias("rows"))
    return tables.groupBy("engine", P.sample_method(F.col("engine"), F.col("rows"), 1000).alias("method")).agg(F.count("*").alias("n"), F.max("rows").alias("most"))


QUERIES = {f.__name__: f for f in (sample_methods, connector_check, connector_catalog, connector_discovery, shape_paths, keyspace_patterns)}

# ---- SQL ----------------------------------------------------------------------------------------
_ALL_ROWS = 10**15
_LISTED = ", ".join(f"'{t}'" for t in _CHECKED)

ORACLE_SQL = {
    "sample_methods": f"""WITH t AS (SELECT {pick_sql('p_partkey', _ENGINES)} AS engine, p_partkey * p_partkey % 3000017 AS rows FROM part),
      m AS (SELECT *, CASE WHEN engine = 'mongodb' THEN CASE WHEN rows > 20000 THEN 'hash' ELSE 'first' END WHEN rows >= 10000 THEN CASE engine {" ".join(f"WHEN '{e}' THEN '{m}'" for e, m in P.METHODS.items())} END ELSE 'first' END AS method FROM t)
      SELECT engine, method, count(*) AS n, max(rows) AS most FROM m GROUP BY 1, 2""",
    "connector_check": " UNION ALL ".join(f"SELECT '{t}' AS object, true AS readable, CAST(NULL AS VARCHAR) AS problem, count(*) AS rows FROM {t}" for t in _CHECKED),
    "connector_catalog": f"""WITH n AS ({" UNION ALL ".join(f"SELECT '{t}' AS object, count(*) AS rows FROM {t}" for t in _CHECKED)})
      SELECT object, column_name AS field, rows FROM n JOIN information_schema.columns c ON c.table_name = n.object WHERE c.table_name IN ({_LISTED})""",
    "connector_discovery": f"""WITH {Q.scan_sql(Q.sample_sql(_COLUMNS, _KEYS, _ALL_ROWS), ('email', 'card_number'), whole=True)}
      SELECT object, field, classifier, sampled, n, matched, candidates, reported, confidence FROM (SELECT *, {Q.decided()} FROM st)""",
    "shape_paths": """WITH o AS (SELECT *, o_orderkey % 20 + 1 AS lines FROM orders), p AS (
      SELECT 'status' AS path, CAST(NULL AS VARCHAR) AS cut, o_orderstatus AS v FROM o UNION ALL SELECT 'terms.priority', NULL, o_orderpriority FROM o UNION ALL SELECT 'terms.account', NULL, CAST(o_custkey AS VARCHAR) FROM o
      UNION ALL SELECT 'buyers.*.seen.*', NULL, CAST(o_orderkey AS VARCHAR) FROM o UNION ALL SELECT 'buyers.*.known', NULL, 'true' FROM o UNION ALL SELECT NULL, 'elements', NULL FROM o WHERE lines > 16
      UNION ALL SELECT 'lines[].line', NULL, CAST(unnest(range(1, least(lines, 16) + 1)) AS VARCHAR) FROM o) SELECT path, cut, count(*) AS n, count(DISTINCT v) AS different FROM p GROUP BY 1, 2""",
    "keyspace_patterns": """WITH c AS (SELECT c_custkey % 3 AS f, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS families FROM c)
      SELECT 'order:*/items' AS pattern, count(*) AS n, 1::BIGINT AS families, least(9, count(*)) AS samples, 1::BIGINT AS sampled_families FROM orders
      UNION ALL SELECT '*:*', n, families, least(9, n), families FROM t""",
}
