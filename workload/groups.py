"""Aggregations, windows, rankings, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.functions import text, timeparts
from communitylens.operators import counting, events, filters, inequality, network, overlap, ranking, retention, terms
from communitylens.plans import sentiment as sentiment_plan
from communitylens.plans import summary, trips
from communitylens.session import literal_table
from workload import roles
from workload.registry import query, rounded
from workload.roles import AUDIENCE, BRANDS, CHAT, COMMENTS, DOCS, MEMBERS, POSTS, TRIPS, load

MONTH = "CAST(date_trunc('month', date) AS DATE)"


# ----------------------------------------------------------------------- joins
@query("join_full_outer_2key", f"""
WITH {POSTS}, {COMMENTS},
p AS (SELECT subreddit, {MONTH} AS month, count(*) AS posts FROM posts GROUP BY ALL),
c AS (SELECT subreddit, {MONTH} AS month, count(*) AS comments FROM comments GROUP BY ALL)
SELECT subreddit, month, coalesce(posts, 0) AS posts, coalesce(comments, 0) AS comments
FROM p FULL JOIN c USING (subreddit, month)""")
def _(spark, root):
    def monthly(df, alias):
        return counting.rows_per_group(df.withColumn("month", timeparts.month_start("date")), "subreddit", "month", alias=alias)
    return counting.outer_merge(
        monthly(roles.posts(spark, root), "posts"), monthly(roles.comments(spark, root), "comments"), ["subreddit", "month"]
    )


@query("join_full_outer_1key", f"""
WITH {POSTS}, {COMMENTS},
p AS (SELECT author, count(*) AS posts FROM posts GROUP BY ALL),
c AS (SELECT author, count(*) AS comments FROM comments GROUP BY ALL)
SELECT author, coalesce(posts, 0) AS posts, coalesce(comments, 0) AS comments FROM p FULL JOIN c USING (author)""")
def _(spark, root):
    return counting.outer_merge(
        counting.rows_per_group(roles.posts(spark, root), "author", alias="posts"),
        counting.rows_per_group(roles.comments(spark, root), "author", alias="comments"), ["author"],
    )


@query("all_pairs_self_join", f"""
WITH {AUDIENCE}, u AS (SELECT DISTINCT subreddit, author FROM audience WHERE author IS NOT NULL)
SELECT x.subreddit AS a, y.subreddit AS b, count(*) AS shared FROM u x JOIN u y USING (author) GROUP BY ALL""")
def _(spark, root):
    return overlap.shared_audience(roles.audience(spark, root), BRANDS)


@query("semi_join_topk", f"""
WITH {POSTS}, top AS (SELECT author FROM posts GROUP BY 1 ORDER BY count(*) DESC, author LIMIT 500)
SELECT id, author FROM posts WHERE author IN (SELECT author FROM top)""")
def _(spark, root):
    posts = roles.posts(spark, root).select("id", "author")
    return ranking.keep_keys(posts, ranking.most_frequent(posts, "author", 500), "author").select("id", "author")


@query("join_lookup_dict", f"""
SELECT o_orderkey, weight FROM orders JOIN (VALUES {roles.sql_rows([(p, i * 0.5) for i, p in enumerate(roles.PRIORITIES)])}) AS t(priority, weight)
  ON o_orderpriority = priority""")
def _(spark, root):
    weights = literal_table(spark, [(p, i * 0.5) for i, p in enumerate(roles.PRIORITIES)], "o_orderpriority string, weight double")
    return load(spark, root, "orders").join(weights, "o_orderpriority").select("o_orderkey", "weight")


CATEGORY_ROWS = [(c, s) for c, names in roles.CATEGORIES.items() for s in names]


@query("join_category_map", f"""
WITH {DOCS} SELECT id, category FROM docs JOIN (VALUES {roles.sql_rows(CATEGORY_ROWS)}) AS t(category, name) ON subreddit = name""")
def _(spark, root):
    docs = roles.docs(spark, root).select("id", "subreddit")
    return sentiment_plan.categorised(docs, roles.CATEGORIES).select("id", "category")


EVENTS_SQL = f"events_t AS (SELECT CAST(d AS DATE) AS event_date, label FROM (VALUES {roles.sql_rows(roles.EVENTS.items())}) AS t(d, label))"


@query("event_overlay_range_join", f"""
WITH {DOCS}, {EVENTS_SQL}, span AS (SELECT min({MONTH}) AS span_start, max({MONTH}) AS span_end FROM docs)
SELECT event_date, label, span_start, span_end FROM events_t, span WHERE event_date BETWEEN span_start AND span_end""")
def _(spark, root):
    series = counting.rows_per_group(roles.docs(spark, root).withColumn("month", timeparts.month_start("date")), "month")
    return events.events_in_span(series, "month", roles.EVENTS)


@query("event_before_after", f"""
WITH {DOCS}, {EVENTS_SQL}, j AS (
  SELECT event_date, e.label, subreddit, date < event_date AS before, score
  FROM docs d JOIN events_t e ON date >= event_date - 30 AND date < event_date + 30)
SELECT event_date, label, subreddit,
  round(avg(score) FILTER (before), 6) AS avg_before, round(avg(score) FILTER (NOT before), 6) AS avg_after,
  round(avg(score) FILTER (NOT before) - avg(score) FILTER (before), 6) AS delta,
  count(*) FILTER (before) AS n_before, count(*) FILTER (NOT before) AS n_after
FROM j GROUP BY event_date, label, subreddit""")
def _(spark, root):
    impact = events.before_after(roles.docs(spark, root), "date", "score", 30, roles.EVENTS, by=["subreddit"])
    return rounded(impact, ["avg_before", "avg_after", "delta"])


# ---------------------------------------------------------------- aggregations
@query("agg_count_star", f"WITH {POSTS} SELECT subreddit, count(*) AS count FROM posts GROUP BY 1")
def _(spark, root):
    return counting.rows_per_group(roles.posts(spark, root), "subreddit")


@query("agg_group_count", f"WITH {DOCS} SELECT label, count(*) AS count FROM docs GROUP BY 1")
def _(spark, root):
    return roles.docs(spark, root).groupBy("label").count()


@query("agg_count_distinct", f"WITH {COMMENTS} SELECT subreddit, {MONTH} AS month, count(DISTINCT id) AS comments FROM comments GROUP BY ALL")
def _(spark, root):
    comments = roles.comments(spark, root).withColumn("month", timeparts.month_start("date"))
    return counting.distinct_per_group(comments, ["subreddit", "month"], "id", "comments")


@query("agg_avg", f"WITH {POSTS} SELECT subreddit, count(*) AS n, round(avg(score), 6) AS avg_score FROM posts GROUP BY 1")
def _(spark, root):
    return rounded(counting.count_and_mean(roles.posts(spark, root), ["subreddit"], "score", "n", "avg_score"), ["avg_score"])


@query("agg_max", f"WITH {COMMENTS} SELECT author, max(score) AS highest, max(date) AS last FROM comments GROUP BY 1")
def _(spark, root):
    return roles.comments(spark, root).groupBy("author").agg(F.max("score").alias("highest"), F.max("date").alias("last"))


@query("agg_min", f"WITH {COMMENTS} SELECT author, min(score) AS lowest, min(date) AS first FROM comments GROUP BY 1")
def _(spark, root):
    return roles.comments(spark, root).groupBy("author").agg(F.min("score").alias("lowest"), F.min("date").alias("first"))


@query("agg_percentile", "SELECT CAST(o_orderdate AS DATE) AS day, quantile_disc(o_totalprice, 0.95) AS q95 FROM orders GROUP BY 1")
def _(spark, root):
    return load(spark, root, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.percentile_approx("o_totalprice", 0.95, 10_000_000).alias("q95"))


@query("agg_ceil_avg", f"WITH {TRIPS} SELECT CAST(pickup AS DATE) AS day, CAST(ceil(avg(passenger_count)) AS BIGINT) AS passengers FROM trips GROUP BY 1")
def _(spark, root):
    return roles.trips(spark, root).groupBy(F.col("tpep_pickup_datetime").cast("date").alias("day")).agg(
        F.ceil(F.avg("passenger_count")).alias("passengers"))


@query("agg_collect_set", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def _(spark, root):
    """A group's set of values as distinct rows, which no group can outgrow."""
    return filters.not_null(load(spark, root, "orders").select("o_custkey", "o_orderpriority"), "o_orderpriority").distinct()


@query("agg_collect_list", "SELECT l_orderkey, l_quantity, count(*) AS count FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL")
def _(spark, root):
    """A group's list of values as (value, count) rows."""
    lines = filters.not_null(load(spark, root, "lineitem").select("l_orderkey", "l_quantity"), "l_quantity")
    return counting.rows_per_group(lines, "l_orderkey", "l_quantity")


def gini_sql(source: str, keys: str, value: str, alias: str) -> str:
    return f"""SELECT {keys}, round(coalesce(CASE WHEN sum(x) > 0 THEN 2.0 * sum(i * x) / (count(x) * sum(x)) - (count(x) + 1.0) / count(x) END, 0.0), 9) AS {alias}
FROM (SELECT {keys}, CAST({value} AS DOUBLE) AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS i FROM {source} WHERE {value} >= 0)
GROUP BY {keys}"""


@query("agg_gini", f"WITH {MEMBERS} {gini_sql('members', 'subreddit, day', 'value', 'gini')}")
def _(spark, root):
    return rounded(inequality.gini(roles.members(spark, root), ["subreddit", "day"], "value"), ["gini"], 9)


@query("agg_gini_large_groups", gini_sql("lineitem", "l_returnflag", "l_extendedprice", "gini"))
def _(spark, root):
    return rounded(inequality.gini(load(spark, root, "lineitem"), ["l_returnflag"], "l_extendedprice"), ["gini"], 9)


@query("agg_mean_of_group_metric", f"""
WITH {MEMBERS}, g AS ({gini_sql('members', 'subreddit, day', 'value', 'gini')})
SELECT subreddit, round(avg(gini), 6) AS gini FROM g GROUP BY 1""")
def _(spark, root):
    daily = inequality.gini(roles.members(spark, root), ["subreddit", "day"], "value")
    return rounded(counting.mean_over(daily, "subreddit", ["gini"], "gini"), ["gini"])


@query("agg_sum", f"WITH {POSTS} SELECT author, CAST(sum(score) AS BIGINT) AS total FROM posts GROUP BY 1")
def _(spark, root):
    return roles.posts(spark, root).groupBy("author").agg(F.sum("score").alias("total"))


DAILY = """SELECT CAST(year(pickup) AS INTEGER) AS dt_year, CAST(month(pickup) AS INTEGER) AS dt_month, CAST(day(pickup) AS INTEGER) AS dt_day, count(*) AS num_trips,
  round(avg(trip_distance), 6) AS mean_trip_distance, max(mta_tax) AS max_mta_tax,
  quantile_disc(fare_amount, 0.95) AS q95_fare_amount, min(tip_amount) AS min_tip_amount,
  CAST(ceil(avg(passenger_count)) AS BIGINT) AS mean_passenger_count
FROM trips {where} GROUP BY 1, 2, 3"""


@query("agg_run_summary", f"""
WITH {TRIPS}, days AS ({DAILY.format(where='')})
SELECT count(*) AS days, min(dt_month) AS first_month, min(dt_day) AS first_day, max(dt_month) AS last_month, max(dt_day) AS last_day,
  CAST(sum(num_trips) AS BIGINT) AS total_trips, round(avg(num_trips), 6) AS mean_daily_trips FROM days""")
def _(spark, root):
    return rounded(trips.run_summary(trips.daily(roles.trips(spark, root), None, accuracy=10_000_000)), ["mean_daily_trips"])


WORDS_SQL = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(body), 'http\\S+|www\\.\\S+', ' ', 'g'), '[^a-z]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query("agg_word_count", f"WITH {DOCS} SELECT term, count(*) AS count FROM (SELECT unnest({WORDS_SQL}) AS term FROM docs) GROUP BY 1")
def _(spark, root):
    docs = roles.docs(spark, root).withColumn("words", text.tokens(text.topic_text("body")))
    return terms.word_count(docs, "words")


@query("agg_value_counts", f"WITH {COMMENTS} SELECT author, count(*) AS count FROM comments GROUP BY 1")
def _(spark, root):
    return roles.comments(spark, root).where(F.col("author").isNotNull()).groupBy("author").count()


EDGES = f"""{MEMBERS},
signs AS (SELECT author, subreddit, CASE WHEN value >= 100 THEN 1.0 WHEN value <= 20 THEN -1.0 ELSE 0.0 END AS s FROM members),
e AS (SELECT author AS "user", subreddit, avg(s) AS sentiment FROM signs GROUP BY ALL)"""


def _edges(spark, root):
    sign = F.when(F.col("value") >= 100, 1.0).when(F.col("value") <= 20, -1.0).otherwise(0.0)
    return network.edges(roles.members(spark, root).withColumn("sentiment_score", sign))


@query("agg_node_mean", f"""WITH {EDGES}
SELECT author AS id, 'user' AS type, round(avg(s), 6) AS sentiment FROM signs GROUP BY 1
UNION ALL SELECT subreddit, 'subreddit', round(avg(s), 6) FROM signs GROUP BY 1""")
def _(spark, root):
    return rounded(network.node_means(_edges(spark, root)), ["sentiment"])


@query("agg_node_degree", f"""WITH {EDGES}
SELECT author AS id, 'user' AS type, count(DISTINCT subreddit) AS degree FROM signs GROUP BY 1
UNION ALL SELECT subreddit, 'subreddit', count(DISTINCT author) FROM signs GROUP BY 1""")
def _(spark, root):
    return network.degrees(_edges(spark, root))


@query("agg_concat_text", f"""
WITH {DOCS}, t AS (SELECT title, unnest({WORDS_SQL}) AS term FROM docs)
SELECT title, CAST(sum(length(term)) + count(*) AS BIGINT) AS characters, count(DISTINCT term) AS terms FROM t GROUP BY 1""")
def _(spark, root):
    docs = roles.docs(spark, root).withColumn("words", text.tokens(text.topic_text("body")))
    return terms.word_count(docs, "words", ["title"]).groupBy("title").agg(
        F.sum((F.length("term") + 1) * F.col("count")).alias("characters"), F.count(F.lit(1)).alias("terms"))


@query("agg_pivot", f"""
WITH {POSTS} SELECT date_trunc('month', date)::DATE AS month,
{', '.join(f"coalesce(count(*) FILTER (subreddit = '{p}'), 0) AS " + '"' + p + '"' for p in roles.PRIORITIES)}
FROM posts GROUP BY 1""")
def _(spark, root):
    long = counting.rows_per_group(
        roles.posts(spark, root).withColumn("month", timeparts.month_start("date")), "month", "subreddit")
    return counting.pivoted(long, "month", "subreddit", "count", roles.PRIORITIES, fill=0)


SHARES = f"WITH {POSTS}, c AS (SELECT subreddit, title, count(*) AS count FROM posts GROUP BY ALL)"


@query("agg_row_percent", SHARES + " SELECT subreddit, title, count, round(100.0 * count / sum(count) OVER (PARTITION BY subreddit), 6) AS percent FROM c")
def _(spark, root):
    counts = counting.rows_per_group(roles.posts(spark, root), "subreddit", "title")
    return rounded(counting.row_percent(counts, "subreddit"), ["percent"])


@query("agg_share_overall", SHARES + """
SELECT title, CAST(sum(count) AS BIGINT) AS count, round(sum(count)::DOUBLE / (SELECT sum(count) FROM c), 6) AS share FROM c GROUP BY 1""")
def _(spark, root):
    counts = counting.rows_per_group(roles.posts(spark, root), "subreddit", "title")
    return rounded(counting.overall_share(counts, "title"), ["share"])


@query("agg_global_stats", f"""
WITH {COMMENTS} SELECT 'comments' AS data_type, count(*) AS total_rows, round(count(*) * 0.000001, 2)::DOUBLE AS size_gb,
  CAST(min(date) AS VARCHAR) AS date_range_start, CAST(max(date) AS VARCHAR) AS date_range_end FROM comments""")
def _(spark, root):
    return summary.global_stats(roles.comments(spark, root), "comments")


@query("agg_unique_totals", f"WITH {COMMENTS} SELECT count(DISTINCT id) AS unique_comments, count(DISTINCT author) AS unique_users FROM comments")
def _(spark, root):
    return summary.unique_totals(roles.comments(spark, root))


@query("agg_peak_hours", f"""
WITH {CHAT} SELECT CAST(hour(make_timestamp(created_utc * 1000000)) AS INTEGER) AS hour, count(*) AS num_comments FROM chat GROUP BY 1""")
def _(spark, root):
    return summary.peak_hours(roles.chat(spark, root))


# --------------------------------------------------------------------- windows
RETENTION = """
seen AS (SELECT DISTINCT subreddit, {period} AS period, author FROM {source}),
calendar AS (SELECT subreddit, period, lag(period) OVER (PARTITION BY subreddit ORDER BY period) AS before
             FROM (SELECT DISTINCT subreddit, period FROM seen)),
r AS (SELECT c.subreddit, c.period, count(s.author) AS active_users, count(p.author) AS returning_users
      FROM calendar c JOIN seen s ON s.subreddit = c.subreddit AND s.period = c.period
      LEFT JOIN seen p ON p.subreddit = c.subreddit AND p.period = c.before AND p.author = s.author GROUP BY ALL)
SELECT subreddit, period AS {alias}, active_users, returning_users,
       round(CASE WHEN active_users > 0 THEN returning_users::DOUBLE / active_users ELSE 0.0 END, 9) AS engagement_ratio FROM r"""


@query("window_lag", f"WITH {MEMBERS}, {RETENTION.format(period='day', source='members', alias='day')}")
def _(spark, root):
    return rounded(retention.retention(roles.members(spark, root), period="day"), ["engagement_ratio"], 9)


@query("rank_position", """
WITH r AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i FROM lineitem)
SELECT l_returnflag, l_extendedprice, count(*) AS count, min(i) AS first_position, max(i) AS last_position FROM r GROUP BY 1, 2""")
def _(spark, root):
    return inequality.positions(load(spark, root, "lineitem"), ["l_returnflag"], "l_extendedprice")


# ------------------------------------------------------------- order and limit
@query("sort_asc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey")
def _(spark, root):
    return load(spark, root, "orders").select("o_orderkey", "o_custkey").orderBy("o_custkey", "o_orderkey")


@query("sort_mixed", f"WITH {POSTS} SELECT subreddit, title, count(*) AS count FROM posts GROUP BY ALL ORDER BY 1, 3 DESC")
def _(spark, root):
    return counting.rows_per_group(roles.posts(spark, root), "subreddit", "title").orderBy("subreddit", F.desc("count"))


@query("sort_multi_desc", "SELECT CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS m, CAST(day(l_shipdate) AS INTEGER) AS d, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY 1 DESC, 2 DESC, 3 DESC")
def _(spark, root):
    lines = load(spark, root, "lineitem").select(
        F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.dayofmonth("l_shipdate").alias("d"))
    return counting.rows_per_group(lines, "y", "m", "d", alias="n").orderBy(F.desc("y"), F.desc("m"), F.desc("d"))


@query("top_k", f"WITH {POSTS} SELECT author, count(*) AS n FROM posts GROUP BY 1 ORDER BY n DESC, author LIMIT 15")
def _(spark, root):
    return ranking.top_k(counting.rows_per_group(roles.posts(spark, root), "author", alias="n"), 15, "n", "author")


@query("bottom_k", f"WITH {POSTS} SELECT author, count(*) AS n FROM posts GROUP BY 1 ORDER BY n, author LIMIT 15")
def _(spark, root):
    return ranking.bottom_k(counting.rows_per_group(roles.posts(spark, root), "author", alias="n"), 15, "n", "author")


@query("top_bottom_union", f"""
WITH {DOCS}, m AS (SELECT subreddit, round(avg(score), 6) AS mean FROM docs GROUP BY 1)
SELECT * FROM (SELECT * FROM m ORDER BY mean DESC, subreddit LIMIT 15) UNION SELECT * FROM (SELECT * FROM m ORDER BY mean, subreddit LIMIT 15)""")
def _(spark, root):
    means = rounded(roles.docs(spark, root).groupBy("subreddit").agg(F.avg("score").alias("mean")), ["mean"])
    return ranking.extremes(means, 15, "mean", "subreddit")


@query("top_k_per_group", """
WITH t AS (SELECT p_brand, p_partkey, CAST(sum(l_quantity) AS BIGINT) AS total
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_brand, CAST(rank AS INTEGER) AS rank, p_partkey, total
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY total DESC, p_partkey) AS rank FROM t) WHERE rank <= 10""")
def _(spark, root):
    parts = load(spark, root, "part").select("p_partkey", "p_brand")
    totals = (
        load(spark, root, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.sum("l_quantity").cast("bigint").alias("total")).join(parts, "p_partkey")
    )
    best = ranking.top_k_per_group(totals, "p_brand", 10, [F.desc("total"), F.asc("p_partkey")])
    return best.select("p_brand", "rank", "p_partkey", "total")


@query("limit_rows", "SELECT event_id, ts FROM events ORDER BY event_id LIMIT 100")
def _(spark, root):
    return load(spark, root, "events").select("event_id", "ts").orderBy("event_id").limit(100)


# -------------------------------------------------------------- set operations
@query("union_positional", f"WITH {POSTS}, {COMMENTS} SELECT subreddit, author FROM comments UNION ALL SELECT subreddit, author FROM posts")
def _(spark, root):
    return roles.comments(spark, root).select("subreddit", "author").union(roles.posts(spark, root).select("subreddit", "author"))


@query("union_by_name", f"WITH {POSTS}, {COMMENTS} SELECT subreddit, date, author FROM comments UNION ALL SELECT subreddit, date, author FROM posts")
def _(spark, root):
    return roles.comments(spark, root).select("subreddit", "date", "author").unionByName(
        roles.posts(spark, root).select("author", "subreddit", "date"))


@query("union_fold", f"""
WITH {DOCS} SELECT category, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n, round(avg(score), 6) AS mean
FROM docs JOIN (VALUES {roles.sql_rows(CATEGORY_ROWS)}) AS t(category, name) ON subreddit = name GROUP BY ALL""")
def _(spark, root):
    """One pass over all categories takes the place of a union of one table per category."""
    docs = roles.docs(spark, root).withColumn("month", timeparts.month_start("date")).select("subreddit", "month", "score")
    grouped = sentiment_plan.categorised(docs, roles.CATEGORIES).groupBy("category", "month")
    return rounded(grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")), ["mean"])
