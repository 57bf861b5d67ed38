"""Scans, sinks, samples and profiles."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.operators import counting, features, filters, models
from communitylens.session import in_parts, parts_for, written
from communitylens.sources import profile, sampling, sinks, tables
from workload import roles
from workload.registry import query, rounded
from workload.roles import load, scratch

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, note string"
HASH = "CAST(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query("scan_parquet", "SELECT * FROM customer")
def _(spark, root):
    return tables.scan_parquet(spark, f"{root}/customer.parquet")


@query("scan_parquet_multi", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997) GROUP BY 1""")
def _(spark, root):
    folder = scratch(spark, "orders")
    orders = load(spark, root, "orders").withColumn("order_year", F.year("o_orderdate"))
    sinks.write_parquet(orders.withColumn("yyyy", F.col("order_year")), folder, ("yyyy",))
    paths = tables.monthly_paths("{root}/yyyy={month}", (1995, 1996, 1997), root=folder)
    scanned = tables.scan_parquet(spark, *paths)
    return rounded(scanned.groupBy("order_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), ["total"], 2)


@query("scan_parquet_glob", "SELECT * FROM part")
def _(spark, root):
    return tables.scan_parquet(spark, f"{root}/par*.parquet")


@query("scan_partition_pruned", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yyyy, CAST(month(o_orderdate) AS INTEGER) AS mm, count(*) AS n, min(o_orderkey) AS first_order
FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 6 GROUP BY 1, 2""")
def _(spark, root):
    folder = scratch(spark, "orders-by-month")
    orders = load(spark, root, "orders").withColumns({"yyyy": F.year("o_orderdate"), "mm": F.month("o_orderdate")})
    sinks.write_parquet(orders, folder, ("yyyy", "mm"))
    part = tables.scan_partitions(spark, folder, 1996, 6)
    return part.groupBy("yyyy", "mm").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_order"))


@query("scan_csv", """
SELECT *, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN NULL WHEN doc_id % 7 = 2 THEN '  "' || lang || '" ' ELSE lang END AS note FROM documents""")
def _(spark, root):
    """Whole texts with quotes, line ends, blanks, '' and null through several CSV files.

    A file whose values hold line ends is read by one task, so there is one for every part that the table is read in.
    """
    folder, rest = scratch(spark, "documents"), F.col("doc_id") % 7
    note = F.when(rest == 0, "").when(rest == 2, F.concat(F.lit('  "'), "lang", F.lit('" '))).when(rest > 2, F.col("lang"))
    sinks.write_csv(load(spark, root, "documents").withColumn("note", note), folder)
    return tables.scan_csv(spark, folder, DOCUMENT)


@query("source_range", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey BETWEEN 0 AND (SELECT count(*) - 1 FROM orders)")
def _(spark, root):
    """The first ids, one for each order, that are order keys."""
    orders = load(spark, root, "orders").select("o_orderkey")
    ids = tables.source_range(spark, orders.count())
    return ids.join(orders, F.col("id") == F.col("o_orderkey"), "left_semi")


@query("source_rows", "SELECT 'orders' AS data_type, count(*) AS total_rows FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def _(spark, root):
    rows = [(name, load(spark, root, name).count()) for name in ("orders", "events")]
    return tables.source_rows(spark, rows, "data_type string, total_rows bigint")


@query("sql_temp_view", "SELECT count(*) AS total FROM lineitem")
def _(spark, root):
    return tables.run_sql(load(spark, root, "lineitem"), "lines_view", "SELECT COUNT(*) AS total FROM lines_view")


@query("sample_fraction", "SELECT count(*) AS source_rows, 0 AS foreign_rows, 0 AS repeated_rows, true AS in_bounds FROM orders")
def _(spark, root):
    """A sample has rows of its source only, each once, and a size within five standard deviations."""
    orders = load(spark, root, "orders")
    sample = sampling.sample_fraction(orders, 0.05)
    known = orders.select(F.col("o_orderkey").alias("known"), F.struct("*").alias("whole"))
    joined = sample.select("o_orderkey", F.struct("*").alias("row")).join(known, F.col("o_orderkey") == F.col("known"), "left")
    found = joined.agg(
        F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_rows"),
        F.count(F.when(F.col("row").eqNullSafe(F.col("whole")), 1)).alias("own"))
    total = orders.agg(F.count("*")).scalar()
    return found.select(
        total.alias("source_rows"), (F.col("n") - F.col("own")).cast("int").alias("foreign_rows"), (F.col("n") - F.col("distinct_rows")).cast("int").alias("repeated_rows"),
        (F.abs(F.col("n") - total * 0.05) <= 5 * F.sqrt(total * 0.05 * 0.95)).alias("in_bounds"))


@query("sample_hash", f"SELECT * FROM orders WHERE {HASH.format(key='o_orderkey')} < 0.05")
def _(spark, root):
    return sampling.hash_sample(load(spark, root, "orders"), "o_orderkey", 0.05)


@query("sample_adaptive", f"""
SELECT 'part' AS sample, * FROM orders WHERE {HASH.format(key='o_orderkey')} < 0.05 UNION ALL SELECT 'all', * FROM orders""")
def _(spark, root):
    orders = load(spark, root, "orders")
    part, every = sampling.sample_adaptive(orders, "o_orderkey", 0.05), sampling.sample_adaptive(orders, "o_orderkey")
    return part.select(F.lit("part").alias("sample"), "*").unionByName(every.select(F.lit("all").alias("sample"), "*"))


@query("sample_n", f"SELECT * FROM orders ORDER BY {HASH.format(key='o_orderkey')}, o_orderkey LIMIT 5000")
def _(spark, root):
    return sampling.sample_n(load(spark, root, "orders"), "o_orderkey", 5000)


def _profile_sql(table: str, columns) -> str:
    def cut(value):
        return f"CASE WHEN length({value}) > 100 THEN substring({value}, 1, 100) || '...' ELSE {value} END"
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS \"column\", '{kind}' AS type, count(*) AS rows, "
        f"count(*) - count({name}) AS nulls, {cut(f'CAST(min({name}) AS VARCHAR)')} AS smallest, "
        f"{cut(f'CAST(max({name}) AS VARCHAR)')} AS largest FROM {table}"
        for i, (name, kind) in enumerate(columns, 1)
    )


@query("schema_profile", _profile_sql("documents", [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]))
def _(spark, root):
    return profile.schema_profile(load(spark, root, "documents"), approx_distinct=False)


@query("show_sample", """
SELECT doc_id, lang, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS text
FROM documents ORDER BY doc_id LIMIT 5""")
def _(spark, root):
    return profile.show_sample(load(spark, root, "documents"), 5, ["doc_id", "absent", "lang", "text"], 50, ["doc_id"])


@query("row_count", "SELECT 'orders' AS stage, count(*) AS total FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def _(spark, root):
    def total(name):
        return load(spark, root, name).agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("stage"), "total")
    return total("orders").unionByName(total("lineitem"))


@query("write_parquet", "SELECT *, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders")
def _(spark, root):
    folder = scratch(spark, "written")
    orders = load(spark, root, "orders").withColumn("year_month", F.date_format("o_orderdate", "yyyy-MM"))
    sinks.write_parquet(orders, folder, ("year_month",))
    return tables.scan_parquet(spark, folder).withColumn("year_month", F.col("year_month").cast("string"))


SEGMENTS = "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1"


@query("write_csv_single", SEGMENTS)
def _(spark, root):
    folder = scratch(spark, "segments")
    sinks.write_csv_single(counting.rows_per_group(load(spark, root, "customer"), "c_mktsegment"), folder, ["c_mktsegment"])
    return tables.scan_csv(spark, folder, "c_mktsegment string, count bigint")


@query("write_csv_named", SEGMENTS)
def _(spark, root):
    path = scratch(spark, "segments") + ".csv"
    sinks.write_csv_named(counting.rows_per_group(load(spark, root, "customer"), "c_mktsegment"), path)
    return tables.scan_csv(spark, path, "c_mktsegment string, count bigint")


@query("write_csv_pandas", f"""
SELECT 'segments' AS report, c_mktsegment AS key, count(*) AS count FROM customer GROUP BY ALL
UNION ALL SELECT 'statuses', o_orderstatus, count(*) FROM orders GROUP BY ALL""")
def _(spark, root):
    """Several report tables as plain CSV files, written by Spark and not through pandas."""
    folder = scratch(spark, "reports")
    sinks.write_tables({
        "segments": counting.rows_per_group(load(spark, root, "customer"), "c_mktsegment"),
        "statuses": counting.rows_per_group(load(spark, root, "orders"), "o_orderstatus"),
    }, folder)
    def read(name):
        return tables.scan_csv(spark, f"{folder}/{name}.csv", "key string, count bigint").withColumn("report", F.lit(name))
    return read("segments").unionByName(read("statuses")).select("report", "key", "count")


@query("write_json", SEGMENTS)
def _(spark, root):
    folder = scratch(spark, "segments-json")
    sinks.write_json(counting.rows_per_group(load(spark, root, "customer"), "c_mktsegment"), folder)
    return spark.read.schema("c_mktsegment string, count bigint").json(folder)


@query("save_model", f"""
WITH {roles.DOCS} SELECT model, count(*) AS n, count(*) AS equal_rows FROM docs, (VALUES ('classifier'), ('clusters'), ('words')) AS v(model)
WHERE trim(body) <> '' GROUP BY 1""")
def _(spark, root):
    """A classifier pipeline, a K-Means model and a tokenizer answer alike before and after saving.

    Three fits and six answers read the texts: what they need of them is stored once, compressed.
    """
    docs = written(filters.non_blank(roles.unlabelled(spark, root), "body").select("id", "body", "created_utc", "score"))
    labelled = features.behaviour_features(docs.withColumn("label", (F.col("score") >= 1000).cast("int")))
    parts = max(parts_for(docs, roles.FIT_ROWS), spark.sparkContext.defaultParallelism)  # each exchanges 65,540 numbers in every iteration
    classifier = models.fit_classifier(in_parts(features.with_class_weight(labelled), parts))
    _, vectors = models.cluster_features(docs, "body", keep=["id"])
    answers = {
        "classifier": (classifier, PipelineModel, labelled, "prediction"),
        "clusters": (models.fit_clusters(vectors), KMeansModel, vectors, "cluster"),
        "words": (Pipeline(stages=[features.tokenizer("body")]).fit(docs), PipelineModel, docs, "words"),
    }
    parts = []
    for name, (model, kind, rows, answer) in answers.items():
        folder = scratch(spark, name)
        sinks.save_model(model, folder)
        before = model.transform(rows).select("id", F.xxhash64(answer).alias("x"))
        after = kind.load(folder).transform(rows).select(F.col("id").alias("i"), F.xxhash64(answer).alias("y"))
        parts.append(before.join(after, F.col("id") == F.col("i")).agg(
            F.count("*").alias("n"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("equal_rows")).withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("schema_profile_kinds", """
SELECT 'comments' AS kind, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN c IN ('subreddit', 'author', 'score', 'created_utc', 'id', 'link_id') THEN 1 ELSE 0 END)::BIGINT AS wanted, (SELECT count(*) FROM lineitem) AS rows
FROM (SELECT unnest(['subreddit', 'author', 'score', 'created_utc', 'id', 'link_id']) AS c)""")
def _(spark, root):
    """The columns of interest of a comment table, those that exist; distinct counts within the sketch's error."""
    made = profile.schema_profile(profile.of_interest(roles.comments(spark, root), "comments"))
    good = F.col("approx_distinct") <= F.col("rows") * 1.2
    return made.agg(
        F.lit("comments").alias("kind"), F.count("*").alias("n"), F.sum(F.col("column").isin(*K.PROFILE_COMMENT_COLUMNS).cast("int") * good.cast("int")).alias("wanted"),
        F.max("rows").alias("rows"))
