"""The given tables in the roles the library works on, for Spark and as SQL.

posts          orders: community = priority, author = customer
comments       lineitem with its order: author = supplier
members        events: community = event type, author = user
audience       lineitem with order and part: community = brand, author = customer
docs           documents with labels: community = source, dates spread over 426 days
chat           conversations: community = role, dates spread over 426 days
trips          orders as trips
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens.operators.sentiment import LEXICON, Rules
from communitylens.session import checkpoint_dir, literal_table, written
from communitylens.sources.tables import scan_parquet

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
BRANDS = tuple(f"Brand#{i}" for i in range(1, 26))
SOURCES = tuple(f"src{i}" for i in range(20))
START, END = "1995-01-01", "2001-12-31"

CATEGORIES = {
    "first": SOURCES[0:6], "second": SOURCES[6:12], "third": SOURCES[12:16], "mixed": (SOURCES[3], SOURCES[14]),
}
EVENTS = {"2023-07-12": "alpha", "2023-11-06": "beta", "2024-02-15": "gamma", "2024-04-17": "delta", "2024-09-01": "late"}
KEYWORDS = {"formal": ("license", "copyright"), "praise": ("best", "great", "free"), "blame": ("worthless", "spam", "hate")}
LEMMAS = (("licenses", "license"), ("licensed", "license"), ("erer", "hate"), ("anal", "free"), ("worthless", "worth"))
WORDS = LEXICON + (("the", 0.4), ("and", -0.3), ("der", 0.7), ("que", -0.6), ("les", 1.2), ("for", 0.9), ("was", -0.8))
RULES = Rules(
    negators=("no", "not", "nicht", "on", "en"), boosters=("that", "la", "die", "very"),
    dampeners=("by", "un", "as"), contrast="with",
)


#: Parts for tables that are one row group each and whose rows are texts or are joined before they are reduced.
PARTS = {"documents": 16, "conversations": 16, "lineitem": 16}

#: Counted documents in a part that the classifier's fits read: each part costs a sum of 65,540 numbers in every iteration.
FIT_ROWS = 20_000


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{root}/{name}.parquet", partitions=PARTS.get(name))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors can reach."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _seconds(column: str):
    """Epoch seconds of a zone-free timestamp."""
    days = F.unix_date(F.col(column).cast("date")).cast("bigint")
    return days * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


def posts(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("subreddit"),
        F.col("o_custkey").cast("string").alias("author"), _seconds("o_orderdate").alias("created_utc"),
        F.floor("o_totalprice").cast("bigint").alias("score"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderstatus").alias("title"),
    )


POSTS = """posts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS subreddit, CAST(o_custkey AS VARCHAR) AS author,
         CAST(epoch(o_orderdate) AS BIGINT) AS created_utc, CAST(floor(o_totalprice) AS BIGINT) AS score,
         CAST(o_orderdate AS DATE) AS date, o_orderstatus AS title
  FROM orders)"""


def comments(spark: SparkSession, root: str) -> DataFrame:
    lines = load(spark, root, "lineitem")
    parents = load(spark, root, "orders").select("o_orderkey", "o_orderpriority")
    return lines.join(parents, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.concat(F.lit("t3_"), F.col("l_orderkey").cast("string")).alias("link_id"),
        F.col("o_orderpriority").alias("subreddit"), F.col("l_suppkey").cast("string").alias("author"),
        _seconds("l_shipdate").alias("created_utc"), F.floor("l_extendedprice").cast("bigint").alias("score"),
        F.col("l_shipdate").cast("date").alias("date"),
    )


COMMENTS = """comments AS (
  SELECT l_orderkey || '-' || l_linenumber AS id, 't3_' || l_orderkey AS link_id, o_orderpriority AS subreddit,
         CAST(l_suppkey AS VARCHAR) AS author, CAST(epoch(l_shipdate) AS BIGINT) AS created_utc,
         CAST(floor(l_extendedprice) AS BIGINT) AS score, CAST(l_shipdate AS DATE) AS date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def members(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "events").select(
        F.col("event_type").alias("subreddit"), F.col("user_id").cast("string").alias("author"),
        F.col("ts").cast("date").alias("day"), "value",
    )


MEMBERS = """members AS (
  SELECT event_type AS subreddit, CAST(user_id AS VARCHAR) AS author, CAST(ts AS DATE) AS day, value FROM events)"""


def audience(spark: SparkSession, root: str) -> DataFrame:
    lines = load(spark, root, "lineitem").select("l_orderkey", "l_partkey")
    orders = load(spark, root, "orders").select("o_orderkey", "o_custkey")
    parts = load(spark, root, "part").select("p_partkey", "p_brand")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("p_brand").alias("subreddit"), F.col("o_custkey").cast("string").alias("author"))
    )


AUDIENCE = """audience AS (
  SELECT p_brand AS subreddit, CAST(o_custkey AS VARCHAR) AS author
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def _spread(key: str):
    return F.date_add(F.lit("2023-06-01").cast("date"), (F.col(key) % 426).cast("int"))


def _moment(key: str):
    return F.unix_date(_spread(key)).cast("bigint") * 86400 + (F.col(key) * 7919) % 86400


def _as_docs(documents: DataFrame, *more) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("subreddit"), _spread("doc_id").alias("date"),
        _moment("doc_id").alias("created_utc"), F.col("text").alias("body"), F.col("lang").alias("title"),
        F.col("text").alias("selftext"), F.col("n_chars").alias("score"), *more,
    )


def docs(spark: SparkSession, root: str) -> DataFrame:
    labels = load(spark, root, "labels").withColumnRenamed("doc_id", "labelled_id")
    joined = load(spark, root, "documents").join(labels, F.col("doc_id") == F.col("labelled_id"), "left")
    return _as_docs(joined, F.col("quality").alias("label"))


def unlabelled(spark: SparkSession, root: str) -> DataFrame:
    """The rows of ``docs`` without their label: a document once for each row of its id in ``labels``, or once.

    Only ids that repeat in ``labels`` change the number of rows. They are stored first: few of them, as usual, are broadcast,
    and the texts are not exchanged to meet them.
    """
    labels = load(spark, root, "labels").groupBy(F.col("doc_id").alias("labelled_id")).agg(F.count(F.lit(1)).alias("copies"))
    joined = load(spark, root, "documents").join(written(labels.where("copies > 1")), F.col("doc_id") == F.col("labelled_id"), "left")
    copies = F.coalesce("copies", F.lit(1).cast("bigint"))
    return _as_docs(joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))))


DOCS = """docs AS (
  SELECT doc_id AS id, source AS subreddit, DATE '2023-06-01' + CAST(doc_id % 426 AS INTEGER) AS date,
         CAST(epoch(DATE '2023-06-01' + CAST(doc_id % 426 AS INTEGER)) AS BIGINT) + (doc_id * 7919) % 86400 AS created_utc,
         text AS body, lang AS title, text AS selftext, n_chars AS score, quality AS label
  FROM documents LEFT JOIN labels USING (doc_id))"""


def chat(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("subreddit"),
        F.col("conv_id").cast("string").alias("author"), _spread("conv_id").alias("date"),
        _moment("conv_id").alias("created_utc"), F.col("text").alias("body"), F.col("turn").alias("score"),
    )


CHAT = """chat AS (
  SELECT conv_id || '-' || turn AS id, role AS subreddit, CAST(conv_id AS VARCHAR) AS author,
         DATE '2023-06-01' + CAST(conv_id % 426 AS INTEGER) AS date,
         CAST(epoch(DATE '2023-06-01' + CAST(conv_id % 426 AS INTEGER)) AS BIGINT) + (conv_id * 7919) % 86400 AS created_utc,
         text AS body, turn AS score
  FROM conversations)"""


def trips(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "orders").select(
        F.col("o_orderdate").alias("tpep_pickup_datetime"), F.col("o_totalprice").alias("fare_amount"),
        (F.col("o_orderkey") % 97).cast("double").alias("trip_distance"),
        (F.col("o_custkey") % 7).cast("double").alias("mta_tax"),
        (F.col("o_custkey") % 31).cast("double").alias("tip_amount"),
        (F.col("o_orderkey") % 6).cast("double").alias("passenger_count"),
    )


TRIPS = """trips AS (
  SELECT o_orderdate AS pickup, o_totalprice AS fare_amount, CAST(o_orderkey % 97 AS DOUBLE) AS trip_distance,
         CAST(o_custkey % 7 AS DOUBLE) AS mta_tax, CAST(o_custkey % 31 AS DOUBLE) AS tip_amount,
         CAST(o_orderkey % 6 AS DOUBLE) AS passenger_count
  FROM orders)"""


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """Labelled documents judged by their length alone."""
    prob = F.least(F.col("n_chars") / 4000.0, F.lit(1.0))
    return (
        load(spark, root, "documents").join(load(spark, root, "labels"), "doc_id")
        .select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), prob.alias("prob"))
        .withColumn("prediction", F.when(F.col("prob") > 0.1, 1.0).otherwise(0.0))
    )


PREDICTIONS = """predictions AS (
  SELECT doc_id AS id, quality AS label, least(CAST(n_chars AS DOUBLE) / 4000, 1) AS prob,
         CASE WHEN least(CAST(n_chars AS DOUBLE) / 4000, 1) > 0.1 THEN 1 ELSE 0 END AS prediction
  FROM documents JOIN labels USING (doc_id))"""


def lexicon(spark: SparkSession) -> DataFrame:
    return literal_table(spark, WORDS, "term string, valence double")


def lemmas(spark: SparkSession) -> DataFrame:
    return literal_table(spark, LEMMAS, "term string, lemma string")


def sql_list(words) -> str:
    """('a', 'b')"""
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_rows(rows) -> str:
    """('a', 1), ('b', 2)"""
    def literal(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else repr(value)
    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
