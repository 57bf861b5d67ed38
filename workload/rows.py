"""Projections, filters, null handling and scalar expressions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from communitylens.functions import labels, text, timeparts
from communitylens.operators import counting, filters
from workload import roles
from workload.registry import query, rounded
from workload.roles import load

P, C, D, CH = (f"WITH {c} " for c in (roles.POSTS, roles.COMMENTS, roles.DOCS, roles.CHAT))


@query("select_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def _(spark, root):
    return load(spark, root, "customer").select("c_custkey", "c_mktsegment")


@query("select_available", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, root):
    return filters.select_available(load(spark, root, "supplier"), ["s_suppkey", "permalink", "s_name", "s_acctbal"])


@query("add_columns", P + "SELECT id, score * 2 AS double_score, score > 100000 AS is_high, score IS NULL AS is_missing FROM posts")
def _(spark, root):
    return roles.posts(spark, root).withColumns({
        "double_score": F.col("score") * 2, "is_high": F.col("score") > 100000, "is_missing": F.col("score").isNull(),
    }).select("id", "double_score", "is_high", "is_missing")


@query("rename_column", D + "SELECT id, body AS content, score AS upvotes FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", "body", "score").withColumnRenamed("body", "content").withColumnRenamed("score", "upvotes")


@query("literal_column", CH + "SELECT id, 'comment' AS type FROM chat")
def _(spark, root):
    return roles.chat(spark, root).select("id", F.lit("comment").alias("type"))


@query("filter_in_list", P + "SELECT id, subreddit FROM posts WHERE subreddit IN ('1-URGENT', '5-LOW')")
def _(spark, root):
    return filters.in_communities(roles.posts(spark, root), ["1-URGENT", "5-LOW", "5-low"]).select("id", "subreddit")


@query("filter_equals", P + "SELECT id, created_utc FROM posts WHERE subreddit = '2-HIGH'")
def _(spark, root):
    return roles.posts(spark, root).where(F.col("subreddit") == "2-HIGH").select("id", "created_utc")


@query("filter_threshold", P + "SELECT id, score FROM posts WHERE score >= 250000")
def _(spark, root):
    return roles.posts(spark, root).where(F.col("score") >= 250000).select("id", "score")


@query("filter_mod", "SELECT o_orderkey * 2 AS doubled FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, root):
    orders = load(spark, root, "orders")
    return orders.where(F.col("o_orderkey") % 2 == 0).select((F.col("o_orderkey") * 2).alias("doubled"))


@query("filter_time_range", P + """
SELECT id, created_utc FROM posts
WHERE make_timestamp(created_utc * 1000000) BETWEEN TIMESTAMP '1996-06-01' AND TIMESTAMP '1999-07-31'""")
def _(spark, root):
    return filters.in_period(roles.posts(spark, root), "1996-06-01", "1999-07-31").select("id", "created_utc")


@query("filter_time_range_day", D + """
SELECT id, created_utc FROM docs
WHERE make_timestamp(created_utc * 1000000) >= TIMESTAMP '2023-07-01' AND make_timestamp(created_utc * 1000000) < TIMESTAMP '2024-04-01'""")
def _(spark, root):
    return filters.in_period(roles.docs(spark, root), "2023-07-01", "2024-03-31", end_inclusive="day").select("id", "created_utc")


@query("filter_date_range", P + "SELECT id, date FROM posts WHERE date >= DATE '1996-06-01' AND date <= DATE '1999-07-31'")
def _(spark, root):
    posts = roles.posts(spark, root)
    return posts.where(timeparts.between_dates("date", "1996-06-01", "1999-07-31")).select("id", "date")


@query("filter_live_text_comment", CH + """
SELECT id FROM chat WHERE body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]') AND body <> ''""")
def _(spark, root):
    return filters.live_comments(roles.chat(spark, root)).select("id")


@query("filter_live_text_post", D + "SELECT id FROM docs WHERE title IS NOT NULL AND title <> ''")
def _(spark, root):
    return filters.live_posts(roles.docs(spark, root)).select("id")


@query("filter_not_null", D + "SELECT id, label FROM docs WHERE label IS NOT NULL")
def _(spark, root):
    return roles.docs(spark, root).where(F.col("label").isNotNull()).select("id", "label")


@query("filter_nonempty_clean", D + """
SELECT * FROM (
  SELECT id, trim(regexp_replace(regexp_replace(lower(body), 'http\\S+|www\\.\\S+', ' ', 'g'), '[^a-z]+', ' ', 'g')) AS clean_text
  FROM docs) WHERE clean_text IS NOT NULL AND clean_text <> ''""")
def _(spark, root):
    docs = filters.with_words(roles.docs(spark, root), "body")
    return docs.select("id", text.topic_text("body").alias("clean_text"))


@query("drop_nulls", D + "SELECT id, title, label FROM docs WHERE title IS NOT NULL AND label IS NOT NULL")
def _(spark, root):
    return filters.not_null(roles.docs(spark, root).select("id", "title", "label"), "title", "label")


@query("fill_nulls", D + "SELECT id, coalesce(label, 0) AS label FROM docs")
def _(spark, root):
    return filters.zero_filled(roles.docs(spark, root).select("id", "label"), ["label"])


@query("coerce_types", """
SELECT event_id, coalesce(TRY_CAST(substr(props, 7, length(props) - 7) AS DOUBLE), 0) AS props_number,
       TRY_CAST(CASE WHEN event_type = 'click' THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS day,
       CAST(user_id AS VARCHAR) AS user_id
FROM events""")
def _(spark, root):
    events = load(spark, root, "events").select(
        "event_id", F.expr("substr(props, 7, length(props) - 7)").alias("props_number"),
        F.when(F.col("event_type") == "click", "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        "user_id",
    )
    return filters.coerced(events, dates=["day"], numbers=["props_number"], texts=["user_id"])


@query("distinct_rows", C + "SELECT DISTINCT subreddit, author FROM comments")
def _(spark, root):
    return roles.comments(spark, root).select("subreddit", "author").distinct()


# ------------------------------------------------------------------ time parts
@query("fn_epoch_to_ts", P + "SELECT id, make_timestamp(created_utc * 1000000) AS created_ts FROM posts")
def _(spark, root):
    moment = F.unix_seconds(timeparts.epoch_timestamp("created_utc"))
    return roles.posts(spark, root).select("id", timeparts.utc_clock(moment).alias("created_ts"))


@query("fn_from_unixtime", D + "SELECT id, strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%d %H:%M:%S') AS created FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", timeparts.unix_time_text("created_utc").alias("created"))


@query("fn_to_date", D + "SELECT id, CAST(make_timestamp(created_utc * 1000000) AS DATE) AS day FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", timeparts.utc_date("created_utc").alias("day"))


@query("fn_date_trunc_month", P + "SELECT id, CAST(date_trunc('month', date) AS DATE) AS month FROM posts")
def _(spark, root):
    return roles.posts(spark, root).select("id", timeparts.utc_month("created_utc").alias("month"))


@query("fn_year_month_unpadded", P + "SELECT id, year(date) || '-' || month(date) AS year_month FROM posts")
def _(spark, root):
    return roles.posts(spark, root).select("id", timeparts.year_month_unpadded("date").alias("year_month"))


@query("fn_year_month_padded", P + "SELECT id, strftime(date, '%Y-%m') AS year_month FROM posts")
def _(spark, root):
    return roles.posts(spark, root).select("id", timeparts.year_month_padded("date").alias("year_month"))


@query("fn_year", P + "SELECT id, CAST(year(date) AS INTEGER) AS part FROM posts")
def _(spark, root):
    return roles.posts(spark, root).select("id", F.year("date").alias("part"))


@query("fn_month", P + "SELECT id, CAST(month(date) AS INTEGER) AS part FROM posts")
def _(spark, root):
    return roles.posts(spark, root).select("id", F.month("date").alias("part"))


@query("fn_dayofmonth", P + "SELECT id, CAST(day(date) AS INTEGER) AS part FROM posts")
def _(spark, root):
    return roles.posts(spark, root).select("id", F.dayofmonth("date").alias("part"))


@query("fn_hour", D + "SELECT id, CAST(hour(make_timestamp(created_utc * 1000000)) AS INTEGER) AS hour_of_day FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", timeparts.utc_hour("created_utc").alias("hour_of_day"))


@query("fn_dayofweek", D + "SELECT id, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", timeparts.utc_weekday("created_utc").alias("day_of_week"))


# ------------------------------------------------------------------------ text
@query("fn_lower", D + "SELECT id, lower(body) AS lowered FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", F.lower("body").alias("lowered"))


@query("fn_trim", "SELECT item_id, trim('  ' || text || ' ') AS trimmed FROM benchmark")
def _(spark, root):
    padded = F.concat(F.lit("  "), F.col("text"), F.lit(" "))
    return load(spark, root, "benchmark").select("item_id", F.trim(padded).alias("trimmed"))


@query("fn_length", D + "SELECT id, length(body) AS comment_length FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", F.length("body").cast("bigint").alias("comment_length"))


@query("fn_concat_ws", D + "SELECT id, concat_ws(' ', CASE WHEN label = 0 THEN NULL ELSE title END, selftext) AS text FROM docs")
def _(spark, root):
    title = F.when(F.col("label") == 0, None).otherwise(F.col("title"))
    return roles.docs(spark, root).select("id", text.title_and_text(title, "selftext").alias("text"))


@query("fn_coalesce", D + "SELECT id, concat_ws(' ', title, coalesce(CASE WHEN label = 1 THEN selftext END, '')) AS content FROM docs")
def _(spark, root):
    body = F.when(F.col("label") == 1, F.col("selftext"))
    return roles.docs(spark, root).select("id", text.title_and_text_padded("title", body).alias("content"))


@query("fn_rlike_flag", "SELECT page_id, CAST(regexp_matches(html, 'http') AS INTEGER) AS has_url FROM pages")
def _(spark, root):
    return load(spark, root, "pages").select("page_id", text.has_url("html").alias("has_url"))


@query("fn_strip_prefix", C + "SELECT id, regexp_replace(link_id, '^t3_', '') AS post_id FROM comments")
def _(spark, root):
    return roles.comments(spark, root).select("id", text.strip_post_prefix("link_id").alias("post_id"))


@query("fn_remove_urls", """
SELECT page_id, regexp_replace(html, 'http\\S+|www\\.\\S+', ' ', 'g') AS spaced,
       regexp_replace(html, 'http\\S+|www\\S+', '', 'g') AS dropped FROM pages""")
def _(spark, root):
    return load(spark, root, "pages").select(
        "page_id", text.remove_urls("html").alias("spaced"), text.remove_urls("html", "", text.URL_LOOSE).alias("dropped")
    )


@query("fn_remove_markdown", "SELECT page_id, regexp_replace(html, '[\\*_~`#]', ' ', 'g') AS plain FROM pages")
def _(spark, root):
    return load(spark, root, "pages").select("page_id", text.remove_markdown("html").alias("plain"))


@query("fn_letters_only", D + """
SELECT id, regexp_replace(lower(body), '[^a-z\\s]', ' ', 'g') AS spaced, regexp_replace(body, '[^A-Za-z\\s]', '', 'g') AS dropped FROM docs""")
def _(spark, root):
    return roles.docs(spark, root).select(
        "id", text.letters_only(F.lower("body")).alias("spaced"), text.letters_only("body", "", keep_case=True).alias("dropped")
    )


@query("fn_collapse_ws", D + "SELECT id, regexp_replace(body, '\\s+', ' ', 'g') AS collapsed FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", text.collapse_spaces("body").alias("collapsed"))


@query("fn_case_threshold", P + """
SELECT id, CASE WHEN score >= 250000 THEN 1 ELSE 0 END AS high, CASE WHEN score < 5000 THEN 1 ELSE 0 END AS low FROM posts""")
def _(spark, root):
    return roles.posts(spark, root).select(
        "id", labels.score_label("score", 250000).alias("high"), labels.score_label("score", 5000, "below").alias("low")
    )


@query("fn_case_sentiment", """
SELECT event_id, CASE WHEN s >= 0.05 THEN 'positive' WHEN s <= -0.05 THEN 'negative' ELSE 'neutral' END AS class,
       CASE WHEN s >= 0.05 THEN 1.0::DOUBLE WHEN s <= -0.05 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sign
FROM (SELECT event_id, (CAST(event_id % 41 AS DOUBLE) - 20) / 100 AS s FROM events)""")
def _(spark, root):
    score = ((F.col("event_id") % 41).cast("double") - 20) / 100
    return load(spark, root, "events").select(
        "event_id", labels.sentiment_class(score).alias("class"), labels.sentiment_sign(score).alias("sign")
    )


@query("fn_case_guarded_ratio", """
SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN (c_custkey % 10)::DOUBLE / c_nationkey ELSE 0.0 END AS ratio FROM customer""")
def _(spark, root):
    return load(spark, root, "customer").select(
        "c_custkey", labels.guarded_ratio(F.col("c_custkey") % 10, "c_nationkey").alias("ratio")
    )


def keyword_case(column: str, classes=roles.KEYWORDS) -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, '{'|'.join(words)}') THEN '{name}'" for name, words in classes.items())
    return f"CASE {cases} ELSE 'other' END"


@query("fn_keyword_class", D + f"SELECT id, {keyword_case('lower(body)')} AS topic_type FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", text.keyword_class(F.lower("body"), roles.KEYWORDS).alias("topic_type"))


@query("fn_ceil", "SELECT o_orderkey, CAST(ceil(o_totalprice / 7) AS BIGINT) AS up FROM orders")
def _(spark, root):
    return load(spark, root, "orders").select("o_orderkey", F.ceil(F.col("o_totalprice") / 7).alias("up"))


@query("fn_arithmetic", """
SELECT o_orderkey, o_custkey + o_orderkey AS total, round(o_custkey::DOUBLE / o_orderkey, 6) AS ratio,
       CAST(o_totalprice > 1000 AND o_custkey <> 5 AS INTEGER) AS flag, o_orderstatus IS NULL AS is_missing
FROM orders WHERE o_orderkey > 0""")
def _(spark, root):
    orders = load(spark, root, "orders").where(F.col("o_orderkey") > 0)
    return orders.select(
        "o_orderkey", (F.col("o_custkey") + F.col("o_orderkey")).alias("total"),
        F.round(F.col("o_custkey") / F.col("o_orderkey"), 6).alias("ratio"),
        ((F.col("o_totalprice") > 1000) & (F.col("o_custkey") != 5)).cast("int").alias("flag"),
        F.col("o_orderstatus").isNull().alias("is_missing"),
    )


ARRAYS = """WITH sets AS (
  SELECT o_custkey, list(DISTINCT o_orderpriority) AS a, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS f
  FROM orders GROUP BY 1)"""


def _sets(spark, root):
    """Per customer, the priorities of all and of finished orders: at most five values each."""
    return load(spark, root, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderpriority").alias("a"),
        F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("f"),
    )


@query("fn_array_size", ARRAYS + " SELECT o_custkey, CAST(len(a) AS INTEGER) AS n_all, CAST(coalesce(len(f), 0) AS INTEGER) AS n_finished FROM sets")
def _(spark, root):
    return _sets(spark, root).select("o_custkey", F.size("a").alias("n_all"), F.size("f").alias("n_finished"))


@query("fn_array_intersect", ARRAYS + " SELECT o_custkey, list_aggregate(list_sort(coalesce(list_intersect(a, f), [])), 'string_agg', '/') AS shared FROM sets")
def _(spark, root):
    shared = F.array_join(F.array_sort(F.array_intersect("a", "f")), "/")
    return _sets(spark, root).select("o_custkey", F.nullif(shared, F.lit("")).alias("shared"))


@query("set_intersect_size", ARRAYS + " SELECT o_custkey, CAST(coalesce(len(list_intersect(a, f)), 0) AS INTEGER) AS shared FROM sets")
def _(spark, root):
    return _sets(spark, root).select("o_custkey", labels.shared_size("a", "f").alias("shared"))


@query("set_union_size", ARRAYS + " SELECT o_custkey, CAST(len(list_distinct(list_concat(a, f))) AS INTEGER) AS joint FROM sets")
def _(spark, root):
    return _sets(spark, root).select("o_custkey", labels.joint_size("a", "f").alias("joint"))


@query("jaccard", ARRAYS + """
SELECT o_custkey, round(coalesce(len(list_intersect(a, f)), 0)::DOUBLE / len(list_distinct(list_concat(a, f))), 6) AS jaccard FROM sets""")
def _(spark, root):
    value = labels.jaccard(labels.shared_size("a", "f"), labels.joint_size("a", "f"))
    return rounded(_sets(spark, root).select("o_custkey", value.alias("jaccard")), ["jaccard"])


@query("fn_vector_element", "SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS second FROM embeddings")
def _(spark, root):
    vectors = load(spark, root, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    return vectors.select("vec_id", labels.class_probability("v").alias("second"))


@query("window_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS largest FROM embeddings")
def _(spark, root):
    return load(spark, root, "embeddings").select("vec_id", labels.argmax("embedding").alias("largest"))


@query("fn_suffix_stem", D + """
SELECT id, list_aggregate(list_transform(string_split(trim(regexp_replace(lower(body), '[^a-z]+', ' ', 'g')), ' '), lambda w:
  CASE WHEN w LIKE '%ing' THEN substring(w, 1, length(w) - 3) WHEN w LIKE '%ed' THEN substring(w, 1, length(w) - 2)
       WHEN w LIKE '%es' THEN substring(w, 1, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 3 THEN substring(w, 1, length(w) - 1)
       ELSE w END), 'string_agg', ' ') AS stems FROM docs""")
def _(spark, root):
    words = F.split(text.topic_text("body"), " ")
    return roles.docs(spark, root).select("id", F.array_join(F.transform(words, text.suffix_stem), " ").alias("stems"))


@query("fn_normalize_by_max", """
SELECT c_custkey, round(c_acctbal / max(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS relative FROM customer""")
def _(spark, root):
    customers = load(spark, root, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    relative = counting.relative_to_max(customers, "c_nationkey", "c_acctbal")
    return rounded(relative.select("c_custkey", "relative"), ["relative"])
