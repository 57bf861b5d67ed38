"""The complete jobs."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import timeparts
from communitylens.operators.network import active_users
from communitylens.plans import clusters, community, discussion, ingest, network, quality, sentiment, summary, topics, trips
from communitylens.session import cut_lineage
from communitylens.sources import sinks, tables
from workload import roles
from workload.groups import DAILY, EVENTS_SQL, MONTH, RETENTION, CATEGORY_ROWS, gini_sql
from workload.registry import query, rounded
from workload.roles import AUDIENCE, BRANDS, CHAT, COMMENTS, DOCS, END, EVENT_TYPES, KEYWORDS, MEMBERS, POSTS, PRIORITIES, RULES, START, TRIPS, sql_list, sql_rows
from workload.rows import keyword_case
from workload.learning import SPLIT
from workload.texts import CLOUD_SQL, CLOUD_STOP, ENGLISH, SENTIMENT_TEXT, TOPIC_SQL, sentiment_sql


# ----------------------------------------------------------- ingest and summary
@query("job_filter_ingest", f"""
WITH {COMMENTS}, {POSTS}
SELECT 'comments' AS kind, id, subreddit, author, score, created_utc, link_id, NULL::VARCHAR AS title, date, strftime(date, '%Y-%m') AS year_month
FROM comments WHERE subreddit IN ('1-URGENT', '3-MEDIUM')
UNION ALL SELECT 'submissions', id, subreddit, author, score, created_utc, NULL, title, date, strftime(date, '%Y-%m')
FROM posts WHERE subreddit IN ('1-URGENT', '3-MEDIUM')""")
def _(spark, root):
    """Both written tables."""
    source, target = roles.scratch(spark, "raw"), roles.scratch(spark, "project")
    sinks.write_parquet(roles.comments(spark, root).drop("date"), f"{source}/comments/")
    sinks.write_parquet(roles.posts(spark, root).drop("date"), f"{source}/submissions/")
    ingest.run(spark, source, target, ["1-URGENT", "3-MEDIUM"])
    left, right = (tables.scan_parquet(spark, f"{target}/{kind}/").withColumn("kind", F.lit(kind)) for kind in ("comments", "submissions"))
    return left.unionByName(right, allowMissingColumns=True)


@query("job_dataset_summary", f"""
WITH {POSTS}, {COMMENTS} {' UNION ALL '.join(f'''
SELECT '{name}' AS data_type, count(*) AS total_rows, round(count(*) * 0.000001, 2)::DOUBLE AS size_gb,
  CAST(min(date) AS VARCHAR) AS date_range_start, CAST(max(date) AS VARCHAR) AS date_range_end FROM {source}'''
  for name, source in (('comments', 'comments'), ('submissions', 'posts')))}""")
def _(spark, root):
    return summary.dataset_summary(roles.comments(spark, root), roles.posts(spark, root))


@query("job_community_stats", f"""
WITH {POSTS}, {COMMENTS},
c AS (SELECT subreddit, count(*) AS num_comments, avg(score) AS avg_comment_score FROM comments GROUP BY 1),
p AS (SELECT subreddit, count(*) AS num_submissions, avg(score) AS avg_submission_score FROM posts GROUP BY 1)
SELECT subreddit, coalesce(num_comments, 0) AS num_comments, round(coalesce(avg_comment_score, 0), 6) AS avg_comment_score,
  coalesce(num_submissions, 0) AS num_submissions, round(coalesce(avg_submission_score, 0), 6) AS avg_submission_score,
  coalesce(num_comments, 0) + coalesce(num_submissions, 0) AS total_rows
FROM c FULL JOIN p USING (subreddit)""")
def _(spark, root):
    stats = summary.community_statistics(roles.comments(spark, root), roles.posts(spark, root))
    return rounded(stats, ["avg_comment_score", "avg_submission_score"])


@query("job_temporal_distribution", f"""
WITH {POSTS}, {COMMENTS},
c AS (SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS num_comments FROM comments GROUP BY 1),
p AS (SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS num_submissions FROM posts GROUP BY 1)
SELECT year_month, coalesce(num_comments, 0) AS num_comments, coalesce(num_submissions, 0) AS num_submissions,
  coalesce(num_comments, 0) + coalesce(num_submissions, 0) AS total_rows FROM c FULL JOIN p USING (year_month)""")
def _(spark, root):
    def dated(df):
        return df.withColumn("year_month", timeparts.year_month_padded("date"))
    return summary.temporal_distribution(dated(roles.comments(spark, root)), dated(roles.posts(spark, root)))


@query("job_forum_basics", f"""
WITH {COMMENTS},
top AS (SELECT subreddit, count(*) AS n FROM comments GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT 'unique_comments' AS measure, '' AS key, count(DISTINCT id) AS n FROM comments
UNION ALL SELECT 'unique_users', '', count(DISTINCT author) FROM comments
UNION ALL SELECT 'top', subreddit, n FROM top
UNION ALL SELECT 'hour', CAST(hour(make_timestamp(created_utc * 1000000)) AS VARCHAR), count(*) FROM comments GROUP BY 2""")
def _(spark, root):
    basics = summary.forum_basics(roles.comments(spark, root))
    totals = basics["dataset_stats"].select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.lit("").alias("key"), F.col(m).alias("n")) for m in ("unique_comments", "unique_users")])))
    top = basics["top_subreddits"].select(F.lit("top").alias("measure"), F.col("subreddit").alias("key"), F.col("num_comments").alias("n"))
    hours = basics["peak_hours"].select(F.lit("hour").alias("measure"), F.col("hour").cast("string").alias("key"), F.col("num_comments").alias("n"))
    return totals.unionByName(top).unionByName(hours)


@query("job_reports_written", f"""
WITH {POSTS}, {COMMENTS}, {CHAT}, b AS (SELECT subreddit, date FROM comments UNION ALL SELECT subreddit, date FROM posts),
top AS (SELECT author FROM chat GROUP BY 1 ORDER BY count(*) DESC, author LIMIT 500), g AS (SELECT DISTINCT author, subreddit FROM chat WHERE author IN (SELECT author FROM top))
SELECT 'dataset_summary' AS report, 2 AS n UNION ALL SELECT 'subreddit_statistics', count(DISTINCT subreddit) FROM b
UNION ALL SELECT 'temporal_distribution', count(DISTINCT strftime(date, '%Y-%m')) FROM b
UNION ALL SELECT 'network_edges', count(*) FROM g
UNION ALL SELECT 'network_nodes', count(DISTINCT author) + count(DISTINCT subreddit) FROM g
UNION ALL SELECT 'network_messages', count(*) FROM chat WHERE author IN (SELECT author FROM top)
UNION ALL SELECT 'user_activity', (SELECT count(*) FROM (SELECT DISTINCT subreddit, date_trunc('month', date) FROM b))""")
def _(spark, root):
    """Report tables written as CSV and JSON and read again, by their numbers of rows."""
    folder = roles.scratch(spark, "reports")
    comments, posts = roles.comments(spark, root), roles.posts(spark, root)
    chosen = network.messages(roles.chat(spark, root), None, "2023-01-01", "2025-01-01")
    nodes, edges = network.graph(chosen, K.NETWORK_USERS, roles.lexicon(spark), RULES)
    made = summary.tables(comments, posts) | {
        "network_nodes": nodes, "network_edges": edges, "user_activity": community.activity(comments, posts, PRIORITIES, START, END),
    }
    sinks.write_tables(made, folder)
    scored = network.signed(active_users(chosen, K.NETWORK_USERS), roles.lexicon(spark), RULES)
    sinks.write_json(scored, f"{folder}/network_messages")
    parts = [tables.scan_csv(spark, f"{folder}/{name}.csv").agg(F.count("*").alias("n")).withColumn("report", F.lit(name)) for name in made]
    parts.append(spark.read.schema("copies bigint").json(f"{folder}/network_messages").agg(F.sum("copies").alias("n")).withColumn("report", F.lit("network_messages")))
    return functools.reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------- community
@query("job_activity_monthly", f"""
WITH {POSTS}, {COMMENTS},
p AS (SELECT subreddit, {MONTH} AS month, count(DISTINCT id) AS posts FROM posts GROUP BY ALL),
c AS (SELECT subreddit, {MONTH} AS month, count(DISTINCT id) AS comments FROM comments GROUP BY ALL)
SELECT subreddit, month, coalesce(posts, 0) AS posts, coalesce(comments, 0) AS comments,
       coalesce(posts, 0) + coalesce(comments, 0) AS total_activity
FROM p FULL JOIN c USING (subreddit, month)""")
def activity_monthly(spark, root):
    return community.activity(roles.comments(spark, root), roles.posts(spark, root), PRIORITIES, START, END)


BOTH = "both_sides AS (SELECT subreddit, date, author FROM comments UNION ALL SELECT subreddit, date, author FROM posts)"


@query("job_retention", f"WITH {POSTS}, {COMMENTS}, {BOTH}, {RETENTION.format(period=MONTH, source='both_sides', alias='month')}")
def _(spark, root):
    result = community.retention(roles.comments(spark, root), roles.posts(spark, root), PRIORITIES, START, END)
    return rounded(result, ["engagement_ratio"], 9)


ATTENTION = f"""{POSTS}, {COMMENTS},
replies AS (SELECT subreddit, {MONTH} AS month, replace(link_id, 't3_', '') AS post_id, count(DISTINCT id) AS n FROM comments GROUP BY ALL),
heights AS (SELECT subreddit, {MONTH} AS month, id, max(score) AS score FROM posts GROUP BY ALL),
gc AS ({gini_sql('replies', 'subreddit, month', 'n', 'gini_comments')}),
gs AS ({gini_sql('heights', 'subreddit, month', 'score', 'gini_scores')})"""


def _attention(spark, root):
    return community.attention(roles.comments(spark, root), roles.posts(spark, root), PRIORITIES, START, END)


@query("job_gini", f"WITH {ATTENTION} SELECT subreddit, month, gini_comments, gini_scores FROM gc FULL JOIN gs USING (subreddit, month)")
def _(spark, root):
    return rounded(_attention(spark, root), ["gini_comments", "gini_scores"], 9)


@query("job_gini_avg", f"""
WITH {ATTENTION} SELECT subreddit, round(avg(gini_comments), 6) AS gini_comments, round(avg(gini_scores), 6) AS gini_scores
FROM gc FULL JOIN gs USING (subreddit, month) GROUP BY 1""")
def _(spark, root):
    return rounded(community.attention_mean(_attention(spark, root)), ["gini_comments", "gini_scores"])


OVERLAP = """
u AS (SELECT DISTINCT subreddit, author FROM {source} WHERE author IS NOT NULL),
s AS (SELECT subreddit, count(*) AS n FROM u GROUP BY 1),
i AS (SELECT x.subreddit AS a, y.subreddit AS b, count(*) AS shared FROM u x JOIN u y USING (author) GROUP BY ALL),
pairs AS (SELECT x.subreddit AS a, y.subreddit AS b, coalesce(shared, 0) AS shared, x.n + y.n - coalesce(shared, 0) AS joint
          FROM s x CROSS JOIN s y LEFT JOIN i ON i.a = x.subreddit AND i.b = y.subreddit)"""


@query("job_overlap", f"WITH {POSTS}, {COMMENTS}, {BOTH}, {OVERLAP.format(source='both_sides')} SELECT a, b, shared, joint, round(shared::DOUBLE / joint, 9) AS jaccard FROM pairs")
def _(spark, root):
    pairs = community.audience_overlap(roles.comments(spark, root), roles.posts(spark, root), PRIORITIES, START, END)
    return rounded(pairs, ["jaccard"], 9)


@query("job_overlap_matrix", f"""
WITH {AUDIENCE}, {OVERLAP.format(source='audience')}
SELECT a AS subreddit, {', '.join(f"round(max(shared::DOUBLE / joint) FILTER (b = '{b}'), 9) AS " + '"' + b + '"' for b in BRANDS)} FROM pairs GROUP BY 1""")
def _(spark, root):
    from communitylens.operators.overlap import overlap

    pairs = rounded(overlap(roles.audience(spark, root), BRANDS), ["jaccard"], 9)
    return community.overlap_matrix(pairs, BRANDS)


# ------------------------------------------------------------------- sentiment
def _texts(spark, root):
    return sentiment.documents(roles.chat(spark, root), roles.docs(spark, root))


def _cells(spark, root):
    return sentiment.cube(_texts(spark, root), roles.lexicon(spark), RULES)


SCORED = f"""{CHAT}, {DOCS},
texts AS (
  SELECT 'c' || id AS id, body AS text, subreddit, date FROM chat
  WHERE body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]') AND body <> ''
  UNION ALL SELECT 'd' || id, concat_ws(' ', title, selftext), subreddit, date FROM docs WHERE title IS NOT NULL AND title <> ''),
clean AS (SELECT id, {SENTIMENT_TEXT.format(c='text')} AS text FROM texts),
{sentiment_sql('clean', 'id', 'text')},
all_scores AS (
  SELECT subreddit, date, year(date) || '-' || month(date) AS year_month, scored.score AS s,
         CASE WHEN scored.score >= 0.05 THEN 'positive' WHEN scored.score <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_category
  FROM texts JOIN scored ON key = id)"""


@query("job_sentiment_distribution_overall", f"WITH {SCORED} SELECT sentiment_category, count(*) AS count FROM all_scores GROUP BY 1")
def _(spark, root):
    return sentiment.distribution(_cells(spark, root))


@query("job_sentiment_by_subreddit", f"WITH {SCORED} SELECT subreddit, round(avg(s), 6) AS avg_sentiment, count(*) AS total_posts FROM all_scores GROUP BY 1")
def _(spark, root):
    return rounded(sentiment.by_community(_cells(spark, root)), ["avg_sentiment"])


@query("job_sentiment_trends", f"WITH {SCORED} SELECT year_month, round(avg(s), 6) AS avg_sentiment, count(*) AS total_posts FROM all_scores GROUP BY 1")
def _(spark, root):
    return rounded(sentiment.by_month(_cells(spark, root)), ["avg_sentiment"])


@query("job_sentiment_subreddit_time", f"""
WITH {SCORED} SELECT subreddit, year_month, round(avg(s), 6) AS avg_sentiment, count(*) AS post_count FROM all_scores GROUP BY ALL""")
def _(spark, root):
    return rounded(sentiment.by_community_month(_cells(spark, root)), ["avg_sentiment"])


@query("job_sentiment_distribution", f"WITH {SCORED} SELECT subreddit, sentiment_category, count(*) AS count FROM all_scores GROUP BY ALL")
def _(spark, root):
    return sentiment.distribution_by_community(_cells(spark, root))


@query("job_sentiment_percent", f"""
WITH {SCORED}, c AS (SELECT subreddit, sentiment_category, count(*) AS count FROM all_scores GROUP BY ALL),
top AS (SELECT subreddit FROM c GROUP BY 1 ORDER BY sum(count) DESC, 1 LIMIT 20)
SELECT subreddit, sentiment_category, count, round(100.0 * count / sum(count) OVER (PARTITION BY subreddit), 6)::DOUBLE AS percent
FROM c WHERE subreddit IN (SELECT subreddit FROM top)""")
def _(spark, root):
    return rounded(sentiment.category_percent(_cells(spark, root)), ["percent"])


@query("job_sentiment", f"""
WITH {SCORED}
SELECT 'overall' AS report, sentiment_category AS key, count(*) AS n, NULL::DOUBLE AS mean FROM all_scores GROUP BY 2
UNION ALL SELECT 'community', subreddit, count(*), round(avg(s), 6) FROM all_scores GROUP BY 2
UNION ALL SELECT 'month', year_month, count(*), round(avg(s), 6) FROM all_scores GROUP BY 2
UNION ALL SELECT 'community month', subreddit || ' ' || year_month, count(*), round(avg(s), 6) FROM all_scores GROUP BY 2
UNION ALL SELECT 'distribution', subreddit || ' ' || sentiment_category, count(*), NULL FROM all_scores GROUP BY 2""")
def _(spark, root):
    """All five tables from one scoring of the texts."""
    made = sentiment.tables(cut_lineage(_cells(spark, root)))
    def part(report, name, key, n, mean=None):
        return made[name].select(
            F.lit(report).alias("report"), F.concat_ws(" ", *key).alias("key"), F.col(n).alias("n"),
            (F.round(mean, 6) if mean else F.lit(None).cast("double")).alias("mean"))
    return (
        part("overall", "sentiment_distribution_overall", ["sentiment_category"], "count")
        .unionByName(part("community", "sentiment_by_subreddit", ["subreddit"], "total_posts", "avg_sentiment"))
        .unionByName(part("month", "sentiment_trends", ["year_month"], "total_posts", "avg_sentiment"))
        .unionByName(part("community month", "sentiment_subreddit_time", ["subreddit", "year_month"], "post_count", "avg_sentiment"))
        .unionByName(part("distribution", "sentiment_distribution", ["subreddit", "sentiment_category"], "count"))
    )


def _category_scores(spark, root):
    return sentiment.category_scores(
        roles.docs(spark, root), roles.CATEGORIES, "2023-01-01", "2025-01-01", fraction=None,
        lexicon=roles.lexicon(spark), rules=RULES)


BY_CATEGORY = f"""{DOCS}, {sentiment_sql('docs', 'id', 'body')},
cat AS (SELECT category, docs.date, scored.score AS s FROM docs JOIN scored ON key = id
        JOIN (VALUES {sql_rows(CATEGORY_ROWS)}) AS t(category, name) ON subreddit = name)"""


@query("job_sentiment_category_trend", f"WITH {BY_CATEGORY} SELECT {MONTH} AS month, round(avg(s), 6) AS avg_sentiment, category FROM cat GROUP BY ALL")
def _(spark, root):
    return rounded(sentiment.category_trend(_category_scores(spark, root)), ["avg_sentiment"])


@query("job_event_impact", f"""
WITH {BY_CATEGORY}, {EVENTS_SQL}, j AS (
  SELECT event_date, label, category, date < event_date AS before, s
  FROM cat JOIN events_t ON date >= event_date - 30 AND date < event_date + 30)
SELECT event_date, label, category, round(avg(s) FILTER (before), 6) AS avg_before, round(avg(s) FILTER (NOT before), 6) AS avg_after,
  round(avg(s) FILTER (NOT before) - avg(s) FILTER (before), 6) AS delta,
  count(*) FILTER (before) AS n_before, count(*) FILTER (NOT before) AS n_after
FROM j GROUP BY ALL""")
def _(spark, root):
    return rounded(sentiment.event_impact(_category_scores(spark, root), 30, roles.EVENTS), ["avg_before", "avg_after", "delta"])


# ------------------------------------------------------------ discussion types
TYPED = f"""{DOCS}, {CHAT},
contents AS (SELECT subreddit, {MONTH} AS month, body AS body FROM chat
             UNION ALL SELECT subreddit, {MONTH}, concat_ws(' ', coalesce(title, ''), coalesce(selftext, '')) FROM docs),
typed AS (SELECT subreddit, month, words, {keyword_case("array_to_string(words, ' ')")} AS topic_type
          FROM (SELECT subreddit, month, {CLOUD_SQL} AS words FROM contents))"""


def _discussion(spark, root):
    docs = discussion.contents(roles.chat(spark, root), roles.docs(spark, root), None, "2023-01-01", "2025-01-01")
    return discussion.tables(docs, KEYWORDS, CLOUD_STOP)


@query("job_discussion_type", f"WITH {TYPED} SELECT topic_type, count(*) AS count FROM typed GROUP BY 1")
def _(spark, root):
    return _discussion(spark, root)["discussion_types"]


@query("job_discussion_type_by_subreddit", f"WITH {TYPED} SELECT subreddit, topic_type, count(*) AS count FROM typed GROUP BY ALL")
def _(spark, root):
    return _discussion(spark, root)["discussion_types_by_subreddit"]


@query("job_discussion_type_by_month", f"WITH {TYPED} SELECT month, topic_type, count(*) AS count FROM typed GROUP BY ALL")
def _(spark, root):
    return _discussion(spark, root)["discussion_types_by_month"]


@query("job_discussion_terms", f"""
WITH {TYPED}, t AS (SELECT topic_type, unnest(words) AS term FROM typed), c AS (SELECT topic_type, term, count(*) AS count FROM t GROUP BY ALL)
SELECT * FROM (SELECT topic_type, CAST(row_number() OVER (PARTITION BY topic_type ORDER BY count DESC, term) AS INTEGER) AS rank, term, count FROM c) WHERE rank <= 100""")
def _(spark, root):
    return _discussion(spark, root)["discussion_terms"]


# --------------------------------------------------------------------- network
NETWORK = f"""{CHAT}, top AS (SELECT author FROM chat GROUP BY 1 ORDER BY count(*) DESC, author LIMIT 500),
chosen AS (SELECT * FROM chat WHERE author IN (SELECT author FROM top)), {sentiment_sql('chosen', 'id', 'body')},
signs AS (SELECT author, subreddit, CASE WHEN scored.score >= 0.05 THEN 1.0 WHEN scored.score <= -0.05 THEN -1.0 ELSE 0.0 END::DOUBLE AS s
          FROM chosen JOIN scored ON key = id)"""


def _graph(spark, root):
    rows = network.messages(roles.chat(spark, root), None, "2023-01-01", "2025-01-01")
    return network.graph(rows, K.NETWORK_USERS, roles.lexicon(spark), RULES)


@query("job_user_network_nodes", f"""
WITH {NETWORK} SELECT author AS id, 'user' AS type, count(DISTINCT subreddit) AS degree, round(avg(s), 6) AS sentiment FROM signs GROUP BY 1
UNION ALL SELECT subreddit, 'subreddit', count(DISTINCT author), round(avg(s), 6) FROM signs GROUP BY 1""")
def _(spark, root):
    return rounded(_graph(spark, root)[0], ["sentiment"])


@query("job_user_network_edges", f"""
WITH {NETWORK} SELECT author AS "user", subreddit, CAST(1 AS INTEGER) AS weight, round(avg(s), 6) AS sentiment FROM signs GROUP BY ALL""")
def _(spark, root):
    return rounded(_graph(spark, root)[1], ["sentiment"])


@query("job_user_network", f"""
WITH {NETWORK}
SELECT 'node' AS part, author AS id, 'user' AS other, count(DISTINCT subreddit) AS n, round(avg(s), 6) AS sentiment FROM signs GROUP BY 2
UNION ALL SELECT 'node', subreddit, 'subreddit', count(DISTINCT author), round(avg(s), 6) FROM signs GROUP BY 2
UNION ALL SELECT 'edge', author, subreddit, 1, round(avg(s), 6) FROM signs GROUP BY 2, 3""")
def _(spark, root):
    """Nodes (type, degree) and edges (community, weight) in one table."""
    nodes, edges = _graph(spark, root)
    listed = nodes.select(F.lit("node").alias("part"), "id", F.col("type").alias("other"), F.col("degree").alias("n"), "sentiment")
    linked = edges.select(
        F.lit("edge").alias("part"), F.col("user").alias("id"), F.col("subreddit").alias("other"),
        F.col("weight").cast("bigint").alias("n"), "sentiment")
    return rounded(listed.unionByName(linked), ["sentiment"])


@query("job_user_network_last", f"""
WITH {NETWORK.replace("SELECT author, subreddit, CASE", "SELECT author, subreddit, created_utc, CASE")},
r AS (SELECT author, subreddit, s, row_number() OVER (PARTITION BY author, subreddit ORDER BY created_utc DESC, s DESC) AS place FROM signs)
SELECT author AS "user", subreddit, CAST(1 AS INTEGER) AS weight, s AS sentiment FROM r WHERE place = 1""")
def _(spark, root):
    """Edges with the tone of each pair's last message."""
    rows = network.messages(roles.chat(spark, root), None, "2023-01-01", "2025-01-01")
    return network.graph(rows, K.NETWORK_USERS, roles.lexicon(spark), RULES, pick="last")[1]


# ---------------------------------------------------------------------- models
TOPIC_DOCS = f"""{CHAT}, {DOCS},
said AS (SELECT subreddit, date, body FROM chat WHERE body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]') AND body <> ''
         UNION ALL SELECT subreddit, date, concat_ws(' ', title, selftext) FROM docs WHERE title IS NOT NULL AND title <> ''),
kept AS (SELECT subreddit, date, {TOPIC_SQL} AS body FROM said WHERE {TOPIC_SQL} <> ''),
t AS (SELECT row_number() OVER () AS id, subreddit, date, body FROM kept),
vocabulary AS (SELECT least(count(*), {K.TOPIC_VOCABULARY}) AS n FROM (SELECT term FROM (
  SELECT id, unnest(list_filter(string_split(body, ' '), lambda w: w NOT IN {sql_list([*ENGLISH, *K.TOPIC_STOP_WORDS])})) AS term FROM t)
  GROUP BY 1 HAVING count(DISTINCT id) >= {K.TOPIC_MIN_DF}))"""


def _topics(spark, root):
    return topics.run(topics.documents(roles.chat(spark, root), roles.docs(spark, root)))


@query("job_topics", f"""
WITH {TOPIC_DOCS}
SELECT 'month' AS report, year(date) || '-' || month(date) AS key, count(*) AS n, true AS in_range FROM t GROUP BY 2
UNION ALL SELECT 'community', subreddit, count(*), true FROM t GROUP BY 2
UNION ALL SELECT 'terms', '', {K.TOPIC_COUNT} * least(n, {K.TOPIC_WORDS}), true FROM vocabulary
UNION ALL SELECT 'shares', '', count(*), true FROM t""")
def _(spark, root):
    """All four tables, by their exact totals: documents per month and community, ranks per topic, shares that add up to one."""
    made = _topics(spark, root)
    valid = F.min(F.col("dominant_topic").between(0, K.TOPIC_COUNT - 1)).alias("in_range")
    total = lambda name, report, key: made[name].groupBy(F.lit(report).alias("report"), F.col(key).alias("key")).agg(F.sum("count").alias("n"), valid)
    words = made["topics"].agg(F.count("*").alias("n"), F.min(F.col("relative").between(0, 1)).alias("in_range"))
    shares = made["topic_shares"].agg(F.sum("count").alias("n"), (F.abs(F.sum("share") - 1) < 1e-9).alias("in_range"))
    rest = [df.select(F.lit(name).alias("report"), F.lit("").alias("key"), "n", "in_range") for name, df in (("terms", words), ("shares", shares))]
    return total("topic_trends", "month", "year_month").unionByName(total("topic_by_subreddit", "community", "subreddit")).unionByName(rest[0]).unionByName(rest[1])


@query("job_topic_grids", f"""
WITH {TOPIC_DOCS}, top AS (SELECT subreddit, count(*) AS n FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
SELECT 'month' AS grid, year(date) || '-' || month(date) AS key, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'community', subreddit, n FROM top""")
def _(spark, root):
    """The grids of topics by month and by the 20 largest communities; each row adds up to its documents."""
    made = _topics(spark, root)
    whole = sum((F.col(str(k)) for k in range(1, K.TOPIC_COUNT)), F.col("0")).cast("bigint").alias("n")
    months, places = topics.month_grid(made["topic_trends"]), topics.community_grid(made["topic_by_subreddit"])
    return months.select(F.lit("month").alias("grid"), F.col("year_month").alias("key"), whole).unionByName(
        places.select(F.lit("community").alias("grid"), F.col("subreddit").alias("key"), whole))


@query("job_topic_change", f"""
WITH {EVENTS_SQL}, docs_t AS (SELECT doc_id % 4 AS topic, DATE '2023-06-01' + CAST(doc_id % 426 AS INTEGER) AS date FROM documents),
j AS (SELECT event_date, label, date < event_date AS before, topic FROM docs_t JOIN events_t ON date >= event_date - 30 AND date < event_date + 30),
n AS (SELECT event_date, label, topic, count(*) FILTER (before) AS n_before, count(*) FILTER (NOT before) AS n_after FROM j GROUP BY ALL),
s AS (SELECT *, sum(n_before) OVER w AS all_before, sum(n_after) OVER w AS all_after FROM n WINDOW w AS (PARTITION BY event_date, label))
SELECT event_date, label, CAST(topic AS INTEGER) AS dominant_topic, n_before, n_after,
  round(CASE WHEN all_before > 0 THEN n_before / all_before END, 9)::DOUBLE AS share_before, round(CASE WHEN all_after > 0 THEN n_after / all_after END, 9)::DOUBLE AS share_after,
  round(CASE WHEN all_before > 0 AND all_after > 0 THEN n_after / all_after - n_before / all_before END, 9)::DOUBLE AS delta FROM s""")
def _(spark, root):
    """Shares of topics before and after each event, over an assignment that SQL can repeat."""
    assigned = roles.docs(spark, root).select("date", (F.col("id") % 4).cast("int").alias("dominant_topic"))
    return rounded(topics.around_events(assigned, 30, roles.EVENTS), ["share_before", "share_after", "delta"], 9)


LABELS = (("high", 1000, "at_least"), ("low", 500, "below"), ("long", 2000, "at_least"))


@query("job_quality_classifier", f"""
WITH {DOCS}, d AS (SELECT score, {SPLIT} AS place FROM docs WHERE body IS NOT NULL),
l AS (SELECT 'high' AS model, CAST(score >= 1000 AS INTEGER) AS label FROM d WHERE place >= 0.8
      UNION ALL SELECT 'low', CAST(score < 500 AS INTEGER) FROM d WHERE place >= 0.8
      UNION ALL SELECT 'long', CAST(score >= 2000 AS INTEGER) FROM d WHERE place >= 0.8)
SELECT model, 'true_' || label AS part, count(*) AS n, true AS in_range FROM l GROUP BY ALL
UNION ALL SELECT DISTINCT model, part, 1, true FROM l, (VALUES ('metrics'), ('roc'), ('pr'), ('aupr')) AS v(part)""")
def _(spark, root):
    """Are long and short documents recognised by their words and behaviour features? All five tables of three labels."""
    parts = []
    runs = quality.run_labels(roles.docs(spark, root), {name: (threshold, side) for name, threshold, side in LABELS}, part_rows=roles.FIT_ROWS)
    for name, (_, _, made) in runs.items():
        unit = lambda c: F.col(c).between(0, 1)
        confusion = made["confusion_matrix"].select(F.col("truth").alias("part"), (F.col("pred_0") + F.col("pred_1")).alias("n"), F.lit(True).alias("in_range"))
        one = F.lit(1).cast("bigint").alias("n")
        metrics = made["model_metrics_summary"].select(F.lit("metrics").alias("part"), one, (unit("accuracy") & unit("precision") & unit("recall") & unit("f1") & unit("auc")).alias("in_range"))
        roc = made["roc"].agg(F.max("fpr").alias("x"), F.max("tpr").alias("y"), F.min("tpr").alias("z")).select(
            F.lit("roc").alias("part"), one, ((F.col("x") == 1) & (F.col("y") == 1) & (F.col("z") >= 0)).alias("in_range"))
        pr = made["pr"].agg(F.max("recall").alias("x"), F.min("precision").alias("y")).select(F.lit("pr").alias("part"), one, ((F.col("x") == 1) & (F.col("y") >= 0)).alias("in_range"))
        area = made["aupr"].select(F.lit("aupr").alias("part"), one, unit("aupr").alias("in_range"))
        for df in (confusion, metrics, roc, pr, area):
            parts.append(df.withColumn("model", F.lit(name)))
    return functools.reduce(DataFrame.unionByName, parts)


@query("job_text_clusters", f"""
WITH {DOCS}, n AS (SELECT count(*) AS n FROM docs WHERE concat_ws(' ', title, selftext) <> '')
SELECT report, n, true AS in_range FROM n, (VALUES ('assignments'), ('profile'), ('points'), ('sentiment'), ('model')) AS v(report)
UNION ALL SELECT 'elbow', {K.ELBOW_MAX_K - K.ELBOW_MIN_K + 1}, true""")
def _(spark, root):
    """All four tables, by their exact totals, the elbow curve, and the model as it was saved."""
    docs, folder = clusters.documents(roles.docs(spark, root)), roles.scratch(spark, "clusters")
    model, made = clusters.run(docs, lexicon=roles.lexicon(spark), rules=RULES, ks=range(K.ELBOW_MIN_K, K.ELBOW_MAX_K + 1), folder=folder)
    saved = np.array_equal(KMeansModel.load(folder).clusterCenters(), model.clusterCenters())
    known = F.min(F.col("cluster").between(0, K.CLUSTER_K - 1))
    def total(report, n, good=known):
        return made[report].agg(n.alias("n"), good.alias("in_range")).select(F.lit(report).alias("report"), "n", "in_range")
    return (
        total("assignments", F.count_distinct("id"))
        .unionByName(total("profile", F.sum("size"), F.min(F.size("top_terms").between(1, K.CLUSTER_TERMS))))
        .unionByName(total("points", F.count_distinct("id")))
        .unionByName(total("sentiment", F.sum("n"), F.min(F.col("avg_sentiment").between(-1, 1))))
        .unionByName(total("elbow", F.count_distinct("k"), F.min((F.col("wcss") >= 0) & (F.col("wcss") < float("inf")))))
        .unionByName(total("assignments", F.count(F.lit(1)), F.lit(bool(saved))).withColumn("report", F.lit("model")))
    )


# ----------------------------------------------------------------------- trips
@query("job_daily_trip_summary", f"WITH {TRIPS} {DAILY.format(where='WHERE year(pickup) = 1998')}")
def _(spark, root):
    return rounded(trips.daily(roles.trips(spark, root), 1998, accuracy=10_000_000), ["mean_trip_distance"])


@query("job_daily_trip_summary_all", f"WITH {TRIPS} {DAILY.format(where='')}")
def _(spark, root):
    return rounded(trips.daily(roles.trips(spark, root), None, accuracy=10_000_000), ["mean_trip_distance"])
