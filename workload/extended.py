"""Principal axes, cluster curves, stored sketches, intervals, phrases and coherence over the given tables."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import text, timeparts
from communitylens.operators import coherence, features, filters, intervals, lemmas, models, overlap, passes, phrases, sketches, terms
from communitylens.plans import clusters, ingest
from communitylens.session import cut_lineage, literal_table
from communitylens.sources import sinks, tables
from communitylens.sources.sampling import part_by_hash
from communitylens.streaming import counts
from workload import roles
from workload.learning import SPLIT, TOPIC_WORDS
from workload.registry import query, rounded
from workload.roles import DOCS, POSTS, TRIPS, load, scratch, sql_rows
from workload.texts import TOPIC_SQL

# --------------------------------------------------------------- principal axes
#: Words whose weights are laid out as a dense matrix in SQL.
FEW_TERMS = 24


def _leading(source: str, name: str, steps: int = 14) -> str:
    """CTEs ending in ``{name}(i, x)``, the first axis, and ``{name}_value(lambda)`` of the matrix ``source(i, j, v)``.

    Powers of a matrix tend to the projection on its first axis; each step squares the one before, brought to trace 1.
    """
    chain = "".join(f"""
{name}_m{k} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}_s{k} WHERE i = j) AS v FROM {name}_s{k}),
{name}_s{k + 1} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_m{k} a JOIN {name}_m{k} b ON a.j = b.i GROUP BY ALL),""" for k in range(steps))
    return f"""{name}_s0 AS MATERIALIZED (SELECT i, j, v FROM {source}),{chain}
{name}_column AS (SELECT i, v FROM {name}_s{steps} WHERE j = (SELECT arg_max(i, v) FROM {name}_s{steps} WHERE i = j)),
{name} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM {name}_column) AS x FROM {name}_column),
{name}_value AS MATERIALIZED (SELECT sum(a.x * c.v * b.x) AS top FROM {source} c JOIN {name} a ON a.i = c.i JOIN {name} b ON b.i = c.j)"""


@query("pca_text_terms", f"""
WITH {DOCS}, t AS (SELECT id, unnest({TOPIC_WORDS}) AS term FROM docs WHERE {TOPIC_SQL} <> ''),
n AS (SELECT count(*)::DOUBLE AS n FROM docs WHERE {TOPIC_SQL} <> ''),
vocabulary AS (
  SELECT term, ln(((SELECT n FROM n) + 1) / (count(DISTINCT id) + 1)) AS idf, row_number() OVER (ORDER BY count(*) DESC, term) AS i
  FROM t GROUP BY term ORDER BY count(*) DESC, term LIMIT {FEW_TERMS}),
w AS (SELECT id, i, count(*) * any_value(idf) AS v FROM t JOIN vocabulary USING (term) GROUP BY id, i),
mean AS (SELECT i, coalesce(sum(v), 0) / (SELECT n FROM n) AS m FROM vocabulary LEFT JOIN w USING (i) GROUP BY i),
met AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM w a JOIN w b USING (id) GROUP BY ALL),
c AS MATERIALIZED (SELECT a.i, b.i AS j, (coalesce(met.v, 0) - n * a.m * b.m) / (n - 1) AS v FROM n, mean a, mean b LEFT JOIN met ON met.i = a.i AND met.j = b.i),
{_leading("c", "axis_one")},
d AS (SELECT c.i, c.j, c.v - top * a.x * b.x AS v FROM axis_one_value, c JOIN axis_one a ON a.i = c.i JOIN axis_one b ON b.i = c.j),
{_leading("d", "axis_two")},
total AS (SELECT sum(v) AS total FROM c WHERE i = j)
SELECT CAST(1 AS INTEGER) AS component, round(top, 4) AS variance, round(top / total, 4) AS share FROM axis_one_value, total
UNION ALL SELECT 2, round(top, 4), round(top / total, 4) FROM axis_two_value, total""")
def _(spark, root):
    """The variances along both axes of the weighted counts of the most frequent words, and their share of all variance."""
    docs = roles.docs(spark, root).select("id", "body")
    docs = filters.with_words(docs, "body").withColumn("clean_text", text.topic_text("body"))
    _, vectors = models.topic_vectors(docs, ["id"], vocabulary=FEW_TERMS, min_df=1)
    found = passes.principal_axes(vectors)
    rows = [(k + 1, float(v), float(v) / found.total if found.total else 0.0) for k, v in enumerate(found.variance)]
    return rounded(literal_table(spark, rows, "component int, variance double, share double"), ["variance", "share"], 4)


@query("pca_text_axes", f"""
SELECT CAST(component AS INTEGER) AS component, true AS is_axis, true AS same_variance, true AS apart
FROM range(1, 3) t(component) WHERE EXISTS (SELECT 1 FROM documents)""")
def _(spark, root):
    """The plane of all documents over 65,536 hashed words: the axes' variances are those of the points, which do not vary together."""
    docs = clusters.documents(roles.docs(spark, root))
    stages = features.hashed_tfidf("text", K.HASH_FEATURES)
    counted = cut_lineage(Pipeline(stages=stages[:3]).fit(docs).transform(docs).select("id", "raw_features"))
    vectors = stages[3].fit(counted).transform(counted).select("id", "features")
    found = passes.principal_axes(vectors, tolerance=1e-6)
    xy = vector_to_array("pca_features")
    spread = passes.projected(vectors, found.axes).select(F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y")).agg(
        F.var_samp("x").alias("x"), F.var_samp("y").alias("y"), F.covar_samp("x", "y").alias("xy"))
    rows = [(k + 1, name, float(found.variance[k])) for k, name in enumerate("xy")]
    listed = literal_table(spark, rows, "component int, name string, variance double")
    own = F.when(F.col("name") == "x", spread.select("x").scalar()).otherwise(spread.select("y").scalar())
    return listed.select(
        "component", F.lit(found.residual <= 1e-6).alias("is_axis"),
        (F.abs(own - F.col("variance")) <= 1e-6 * F.col("variance")).alias("same_variance"),
        (F.abs(spread.select("xy").scalar()) <= 1e-5 * found.variance[0]).alias("apart"))


# ----------------------------------------------------------------- cluster curve
MOST_K = 10


@query("kmeans_elbow_costs", f"""
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
whole AS (SELECT sum(ss) AS whole FROM (SELECT var_pop(x) * count(*) AS ss FROM v GROUP BY i))
SELECT CAST(k AS INTEGER) AS k, CASE WHEN k = 1 THEN round(whole, 3) END AS wcss, true AS own_squares, true AS no_rise FROM range(1, {MOST_K + 1}) t(k), whole""")
def _(spark, root):
    """One cluster costs the squares around the mean; every cost is that of its own centres, and none is above a smaller k's."""
    rows = load(spark, root, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    stored = cut_lineage(rows.select("vec_id", "x", array_to_vector("x").alias("features")))
    curve = passes.cluster_curve(stored, range(1, MOST_K + 1))
    places = [(k, [float(x) for x in centre]) for k, all_ in curve.centres.items() for centre in all_]
    centres = spark.createDataFrame(places, "k int, centre array<double>").groupBy("k").agg(F.collect_list("centre").alias("centres"))
    squares = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = stored.select("x", F.explode(F.sequence(F.lit(1), F.lit(MOST_K))).alias("k")).join(centres, "k")
    own = near.groupBy("k").agg(F.sum(F.array_min(F.transform("centres", squares))).alias("own"))
    listed = [(k, cost, bool(k == 1 or cost <= curve.costs[k - 1] * (1 + 1e-9))) for k, cost in curve.costs.items()]
    costs = literal_table(spark, [(k, c, int(r)) for k, c, r in listed], "k int, cost double, falls int")
    return costs.join(own, "k").select(
        "k", F.when(F.col("k") == 1, F.round("cost", 3)).alias("wcss"),
        (F.abs(F.col("own") - F.col("cost")) <= 1e-6 * F.col("own")).alias("own_squares"), (F.col("falls") == 1).alias("no_rise"))


# ------------------------------------------------------------------------ models
@query("logreg_gradient", f"""
WITH {DOCS} SELECT CAST(count(*) AS BIGINT) AS rows, true AS is_flat, true AS better FROM docs WHERE body IS NOT NULL AND {SPLIT} < 0.6""")
def _(spark, root):
    """Are long documents told from their words? At the fitted weights the loss hardly falls any more in any direction: its
    derivatives, summed over all training rows' entries, are small beside those of a model without weights."""
    docs = roles.docs(spark, root)
    stages = features.hashed_tfidf("body", K.CLUSTER_FEATURES)[:3]
    rows = features.behaviour_features(features.labelled(docs, 1000)).withColumn("part", part_by_hash("id")).where("part = 0")
    kept = cut_lineage(Pipeline(stages=stages).fit(rows).transform(rows).select("id", "label", "raw_features", *features.BEHAVIOUR))
    train = features.with_class_weight(kept)
    model = models.fit_counted(train, 200)
    scored = model.transform(train).select("label", "class_weight", F.unwrap_udt("features").alias("x"), vector_to_array("probability")[1].alias("p"))
    entry = F.when(F.col("x.type") == 0, F.arrays_zip(F.col("x.indices").alias("i"), F.col("x.values").alias("v"))).otherwise(
        F.transform("x.values", lambda v, i: F.struct(i.alias("i"), v.alias("v"))))
    y, w = F.col("label"), F.col("class_weight")
    laid = scored.select("label", "class_weight", "p", F.explode(entry).alias("e"))
    # derivatives by standardised features, as the weights were fitted
    n = scored.count()
    sums = laid.groupBy("e.i").agg(
        F.sum(w * (F.col("p") - y) * F.col("e.v")).alias("g"), F.sum(w * (0.5 - y) * F.col("e.v")).alias("g0"),
        F.sum("e.v").alias("s"), F.sum(F.col("e.v") * F.col("e.v")).alias("ss"))
    deviation = F.sqrt((F.col("ss") - F.col("s") * F.col("s") / n) / F.lit(max(n - 1, 1)))
    scaled = sums.where(deviation > 0).select((F.abs("g") / deviation).alias("g"), (F.abs("g0") / deviation).alias("g0"))
    loss = scored.agg(F.sum(-w * F.log(F.greatest(F.when(y == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-300)))).alias("l"), F.sum(w).alias("w"))
    return scaled.agg(F.max("g").alias("g"), F.max("g0").alias("g0")).select(
        F.lit(n).cast("bigint").alias("rows"), (F.col("g") <= 0.05 * F.col("g0")).alias("is_flat"),
        (loss.select("l").scalar() < 0.6931 * loss.select("w").scalar()).alias("better"))


@query("lda_distribution", f"WITH {DOCS} SELECT id, true AS adds_up, true AS is_largest FROM docs WHERE {TOPIC_SQL} <> ''")
def _(spark, root):
    """Every document's shares of topics add up to one, or to none without words of the vocabulary; its topic has the largest share, by sorting."""
    docs = roles.docs(spark, root).select("id", "body")
    docs = filters.with_words(docs, "body").withColumn("clean_text", text.topic_text("body"))
    _, vectors = models.topic_vectors(docs, ["id"])
    lda = models.fit_topics(vectors)
    worded = F.exists(F.unwrap_udt("features")["values"], lambda x: x != 0)
    shares = lda.transform(vectors).select("id", worded.cast("double").alias("whole"), vector_to_array("topicDistribution").alias("shares"))
    best = shares.select("id", "shares", "whole", F.reverse(F.array_sort(F.transform("shares", lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))))[0]["i"].alias("i"))
    named = models.dominant_topic(lda, vectors)
    return best.join(named, "id").select(
        "id", (F.abs(F.aggregate("shares", F.lit(0.0), lambda a, x: a + x) - F.col("whole")) < 1e-9).alias("adds_up"), (F.col("dominant_topic") == -F.col("i")).alias("is_largest"))


# ---------------------------------------------------------------------- sketches
def _stored(spark, df, name):
    """Write sketches and read them again."""
    folder = scratch(spark, name)
    sinks.write_parquet(df, folder)
    return tables.scan_parquet(spark, folder)


PERIODS = "(VALUES ('month'), ('year'), ('all')) AS p(period)"
PERIOD_START = "CASE period WHEN 'month' THEN date_trunc('month', date)::DATE WHEN 'year' THEN date_trunc('year', date)::DATE END"


def _periods(df):
    """Every row under its month, its year and the whole time."""
    month = F.col("month")
    spans = F.array(
        F.struct(F.lit("month").alias("period"), month.alias("start")),
        F.struct(F.lit("year").alias("period"), F.trunc(month, "year").alias("start")),
        F.struct(F.lit("all").alias("period"), F.lit(None).cast("date").alias("start")))
    return df.select("*", F.inline(spans))


@query("distinct_sketch_rollup", f"""
WITH {POSTS} SELECT subreddit, period, {PERIOD_START} AS start, count(DISTINCT author) AS authors, true AS within_error
FROM posts, {PERIODS} GROUP BY ALL""")
def _(spark, root):
    """Authors by month, year and over all time from one stored table of monthly sketches, beside exact counts."""
    posts = roles.posts(spark, root).withColumn("month", timeparts.month_start("date").cast("date"))
    stored = _stored(spark, sketches.distinct_sketches(posts, ["subreddit", "month"], "author"), "authors")
    keys = ["subreddit", "period", "start"]
    estimates = sketches.distinct_rollup(_periods(stored), keys, alias="estimate")
    exact = _periods(posts.select("subreddit", "month", "author").distinct()).groupBy(*keys).agg(F.count_distinct("author").alias("authors"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys]
    close = F.abs(F.col("estimate") - F.col("authors")) <= F.col("authors") * sketches.distinct_error()
    return exact.alias("x").join(estimates.alias("e"), same).select(*[f"x.{k}" for k in keys], "authors", close.alias("within_error"))


@query("distinct_sketch_shared", f"""
WITH {POSTS}, m AS (SELECT DISTINCT subreddit, author FROM posts WHERE author IS NOT NULL)
SELECT a.subreddit AS a, b.subreddit AS b, count(*) FILTER (a.author = b.author) AS shared, true AS within_error
FROM m a JOIN m b ON a.subreddit < b.subreddit AND a.author = b.author GROUP BY ALL""")
def _(spark, root):
    """Members that two communities share, from their stored sketches, beside exact counts."""
    posts = roles.posts(spark, root).withColumn("month", timeparts.month_start("date"))
    stored = _stored(spark, sketches.distinct_sketches(posts, ["subreddit", "month"], "author"), "authors")
    found = sketches.distinct_shared(stored, "subreddit")
    lists = posts.where("author is not null").select("subreddit", "author").distinct().groupBy("author").agg(F.array_sort(F.collect_set("subreddit")).alias("all"))
    laid = lists.select("all", F.posexplode("all").alias("at", "a")).select("a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b"))
    exact = laid.groupBy("a", "b").agg(F.count("*").alias("exact"))
    close = F.abs(F.col("shared") - F.col("exact")) <= F.col("joint") * sketches.distinct_error()
    return found.join(exact, ["a", "b"]).select("a", "b", F.col("exact").alias("shared"), close.alias("within_error"))


@query("quantile_sketch_rollup", f"""
WITH {TRIPS.replace("SELECT o_orderdate AS pickup", "SELECT o_orderdate::DATE AS date, o_orderdate AS pickup")}
SELECT period, {PERIOD_START} AS start, count(*) AS n, true AS within_error FROM trips, {PERIODS} GROUP BY ALL""")
def _(spark, root):
    """The 95 % quantile of fares by month, year and over all time from daily sketches: its exact rank is within the bound."""
    trips = roles.trips(spark, root).select(F.col("tpep_pickup_datetime").cast("date").alias("day"), "fare_amount")
    stored = _stored(spark, sketches.quantile_sketches(trips, ["day"], "fare_amount"), "fares")
    month = F.trunc("day", "month")
    found = sketches.quantile_rollup(_periods(stored.withColumn("month", month)), ["period", "start"], 0.95)
    rows = _periods(trips.withColumn("month", month))
    same = F.col("r.period").eqNullSafe(F.col("q.period")) & F.col("r.start").eqNullSafe(F.col("q.start"))
    ranks = rows.alias("r").join(found.alias("q"), same).groupBy("q.period", "q.start", "q.n").agg(
        F.avg((F.col("fare_amount") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("fare_amount") <= F.col("value")).cast("int")).alias("upto"))
    error = sketches.rank_error()
    return ranks.select("period", "start", "n", ((F.col("below") <= 0.95 + error) & (F.col("upto") >= 0.95 - error)).alias("within_error"))


# --------------------------------------------------------------------- intervals
SPANS = (
    ("winter", "2023-11-15", "2024-03-01"), ("launch", "2023-12-01", "2023-12-02"), ("nested", "2023-12-20", "2024-01-10"),
    ("overlapping", "2024-02-01", "2024-06-01"), ("open", "2024-05-01", None), ("always", None, None), ("before", None, "2023-07-01"),
    ("nothing", "2024-01-05", "2024-01-05"), ("twin", "2023-12-20", "2024-01-10"),
)
SPANS_SQL = "spans AS (SELECT name, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in SPANS) + ") AS t(name, a, b))"


@query("interval_overlay", f"""
WITH {DOCS}, {SPANS_SQL}
SELECT name, id, date FROM docs JOIN spans ON (a IS NULL OR date >= a) AND (b IS NULL OR date < b) AND (a IS NULL OR b IS NULL OR a < b)""")
def _(spark, root):
    """Every document under every event that covers its day: nested, overlapping, open, empty and equal events."""
    spans = literal_table(spark, SPANS, "name string, a string, b string").select(
        "name", F.unix_date(F.col("a").cast("date")).alias("a"), F.unix_date(F.col("b").cast("date")).alias("b"))
    docs = roles.docs(spark, root).select("id", "date", F.unix_date("date").alias("day"))
    return intervals.overlapping(docs, spans, "day", None, "a", "b").select("name", "id", "date")


OPEN_TIMES = """
spans AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST((o_orderkey * 37) % 400 AS INTEGER) AS b FROM orders),
terms AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS year, o_orderstatus AS status, min(CAST(o_orderdate AS DATE)) AS x, max(CAST(o_orderdate AS DATE)) AS y FROM orders GROUP BY ALL)"""


@query("interval_pairs", f"""
WITH {OPEN_TIMES} SELECT priority, year, status, count(*) AS n, sum(date_diff('day', greatest(a, x), least(b, y)))::BIGINT AS days
FROM spans JOIN terms ON a < y AND x < b AND a < b AND x < y GROUP BY ALL""")
def _(spark, root):
    """Orders, open for 0 to 399 days, against the terms of each priority, year and status: pairs and shared days."""
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    orders = load(spark, root, "orders")
    spans = orders.select(F.col("o_orderkey").alias("id"), day.alias("a"), (day + (F.col("o_orderkey") * 37) % 400).alias("b"))
    terms_ = orders.groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("bigint").alias("year"), F.col("o_orderstatus").alias("status")).agg(
        F.min(day).alias("x"), F.max(day).alias("y"))
    shared = F.least("b", "y") - F.greatest("a", "x")
    return intervals.overlapping(spans, terms_, "a", "b", "x", "y").groupBy("priority", "year", "status").agg(
        F.count("*").alias("n"), F.sum(shared).cast("bigint").alias("days"))


# ----------------------------------------------------------------------- phrases
PHRASE_WORDS = ("the", "der", "que", "les", "for", "la", "die", "en", "un", "and")
PHRASES = tuple(
    (" ".join(words), round((7 * k) % 41 / 8 - 2.5, 3))
    for k, words in enumerate(itertools.chain.from_iterable(itertools.product(PHRASE_WORDS, repeat=n) for n in (2, 3)))
)


@query("phrase_lexicon_score", f"""
WITH {DOCS}, lex AS (SELECT * FROM (VALUES {sql_rows(PHRASES)}) AS t(term, valence)),
w AS (SELECT id, string_split({TOPIC_SQL}, ' ') AS w FROM docs),
places AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
runs AS (SELECT id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS term FROM places, range(2, 4) r(n) WHERE i + n - 1 <= len(w)),
best AS (SELECT id, i, max(n) AS n, arg_max(valence, n)::DOUBLE AS valence FROM runs JOIN lex USING (term) GROUP BY id, i),
walk AS (
  SELECT id, list_reduce(list_prepend({{'i': 0::BIGINT, 'n': 0::BIGINT, 'upto': 1::BIGINT, 'found': 0::BIGINT, 'valence': 0.0::DOUBLE}},
           list({{'i': i::BIGINT, 'n': n::BIGINT, 'upto': 0::BIGINT, 'found': 0::BIGINT, 'valence': valence}} ORDER BY i)),
           lambda a, x: CASE WHEN x.i >= a.upto THEN {{'i': x.i, 'n': x.n, 'upto': x.i + x.n, 'found': a.found + 1, 'valence': a.valence + x.valence}} ELSE a END) AS r
  FROM best GROUP BY id)
SELECT d.id, coalesce(r.found, 0) AS phrases, round(coalesce(r.valence, 0), 6) AS valence FROM docs d LEFT JOIN walk USING (id)""")
def _(spark, root):
    """Documents against 1,100 phrases of two and three words, leftmost and longest first."""
    docs = roles.docs(spark, root).select("id", F.split(text.topic_text("body"), " ").alias("words"))
    lexicon = literal_table(spark, PHRASES, "term string, valence double")
    return rounded(phrases.phrase_score(docs, "words", ["id"], lexicon), ["valence"])


# --------------------------------------------------------------------- coherence
COHERENT_TERMS, COHERENT_TOPICS = 40, 4


@query("topic_coherence", f"""
WITH {DOCS}, kept AS (SELECT id, {TOPIC_WORDS} AS w FROM docs), t AS (SELECT id, unnest(w) AS term FROM kept),
listed AS (
  SELECT term, CAST((row_number() OVER (ORDER BY count(*) DESC, term) - 1) % {COHERENT_TOPICS} AS INTEGER) AS topic
  FROM t WHERE term <> '' GROUP BY term ORDER BY count(*) DESC, term LIMIT {COHERENT_TERMS}),
held AS (SELECT DISTINCT id, topic, term FROM t JOIN listed USING (term)),
n AS (SELECT count(*)::DOUBLE AS n FROM docs),
own AS (SELECT topic, term, count(id) AS n FROM listed LEFT JOIN held USING (topic, term) GROUP BY ALL),
met AS (SELECT a.topic, a.term AS a, b.term AS b, count(*) AS n FROM held a JOIN held b ON a.id = b.id AND a.topic = b.topic AND a.term < b.term GROUP BY ALL),
pairs AS (
  SELECT a.topic, a.n AS n_a, b.n AS n_b, coalesce(met.n, 0) AS n_both
  FROM own a JOIN own b ON a.topic = b.topic AND a.term < b.term LEFT JOIN met ON met.topic = a.topic AND met.a = a.term AND met.b = b.term)
SELECT topic, count(*) AS pairs, round(avg(CASE WHEN n_both = 0 THEN -1 WHEN n_both = n THEN 1
         ELSE ln((n_both / n) / ((n_a / n) * (n_b / n))) / -ln(n_both / n) END), 6) AS npmi
FROM pairs, n GROUP BY topic""")
def _(spark, root):
    """NPMI of four lists of frequent words, dealt by their frequency."""
    docs = roles.docs(spark, root).select("id", "body").withColumn("clean_text", text.topic_text("body"))
    split = Pipeline(stages=[features.tokenizer("clean_text", "tokens"), features.stop_words_remover("tokens", "words", K.TOPIC_STOP_WORDS)]).fit(docs).transform(docs)
    split = split.select("id", "words")
    chosen = terms.word_count(split.withColumn("words", F.filter("words", lambda w: w != "")), "words").orderBy(F.desc("count"), "term").limit(COHERENT_TERMS)
    rows = [(r["term"], k % COHERENT_TOPICS) for k, r in enumerate(chosen.collect())]
    return rounded(coherence.coherence(split, "id", "words", literal_table(spark, rows, "term string, topic int")), ["npmi"])


@query("lda_coherence", f"""
SELECT CAST(topic AS INTEGER) AS topic, {K.TOPIC_WORDS * (K.TOPIC_WORDS - 1) // 2}::BIGINT AS pairs, true AS as_counted, true AS in_range FROM range({K.TOPIC_COUNT}) t(topic)""")
def _(spark, root):
    """NPMI of the fitted topics' leading words; a topic's is the same when its documents are counted word by word on the driver's list."""
    docs = roles.docs(spark, root).select("id", "body")
    docs = filters.with_words(docs, "body").withColumn("clean_text", text.topic_text("body"))
    words, vectors = models.topic_vectors(docs, ["id"])
    listed = cut_lineage(models.topic_words(words, models.fit_topics(vectors)).select("topic", "term"))
    split = features.tokenizer("clean_text", "words").transform(docs).select("id", "words")
    made = coherence.coherence(split, "id", "words", listed)
    rows = {}
    for topic, term in listed.collect():  # a bounded list
        rows.setdefault(topic, []).append(term)
    pairs = [(t, a, b) for t, ws in rows.items() for a, b in itertools.combinations(sorted(ws), 2)]
    used = sorted({w for ws in rows.values() for w in ws})
    seen, total = coherence.document_counts(split, "words", used)
    at, values = {w: k for k, w in enumerate(used)}, {}
    for t, a, b in pairs:
        x, y, both = (float(seen[i, j]) for i, j in ((at[a], at[a]), (at[b], at[b]), (at[a], at[b])))
        values.setdefault(t, []).append(-1.0 if both == 0 else 1.0 if both == total else np.log(both * total / (x * y)) / -np.log(both / total))
    own = literal_table(spark, [(t, float(np.mean(v))) for t, v in values.items()], "topic int, own double")
    return made.join(own, "topic").select(
        "topic", "pairs", (F.abs(F.col("npmi") - F.col("own")) < 1e-9).alias("as_counted"), F.col("npmi").between(-1, 1).alias("in_range"))


# ------------------------------------------------------------------------ lemmas
def _rules_sql() -> str:
    made = ["SELECT term, 0 AS rule, term AS candidate FROM terms"]
    for k, (ending, replacement) in enumerate(lemmas.RULES, 1):
        made.append(f"SELECT term, {k}, left(term, length(term) - {len(ending)}) || '{replacement}' FROM terms "
                    f"WHERE suffix(term, '{ending}') AND length(term) - {len(ending)} + {len(replacement)} >= 2")
    return " UNION ALL ".join(made)


@query("lemma_rules", f"""
WITH {DOCS}, terms AS (SELECT DISTINCT unnest(string_split({TOPIC_SQL}, ' ')) AS term FROM docs),
made AS ({_rules_sql()}),
stems AS (SELECT DISTINCT candidate FROM made WHERE rule > 0 AND candidate IN (SELECT term FROM terms)),
ruled AS (SELECT term, arg_min(candidate, rule) AS ruled FROM made WHERE candidate IN (SELECT candidate FROM stems) GROUP BY term),
named AS (SELECT * FROM (VALUES {sql_rows(roles.LEMMAS)}) AS l(term, lemma))
SELECT terms.term, coalesce(lemma, ruled, terms.term) AS lemma FROM terms LEFT JOIN ruled USING (term) LEFT JOIN named USING (term)""")
def _(spark, root):
    """Every distinct term's lemma in the vocabulary of terms that a rule leaves of others, so that no longer form stays."""
    words = cut_lineage(roles.docs(spark, root).select(F.explode(F.split(text.topic_text("body"), " ")).alias("term")).distinct())
    stems = words.select(F.inline(lemmas.candidates(F.col("term")))).where("rule > 0").join(
        words.select(F.col("term").alias("candidate")), "candidate", "left_semi").select(F.col("candidate").alias("word"))
    return lemmas.lemma_table(words, stems, roles.lemmas(spark))


# ----------------------------------------------------------------------- overlap
@query("overlap_by_index", """
WITH u AS (SELECT DISTINCT l_suppkey AS c, o_custkey AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey IS NOT NULL AND o_custkey IS NOT NULL)
SELECT x.c AS a, y.c AS b, count(*) AS shared FROM u x JOIN u y USING (author) GROUP BY ALL""")
def _(spark, root):
    """Customers that every two suppliers share, with no list of suppliers."""
    lines, orders = load(spark, root, "lineitem").select("l_orderkey", "l_suppkey"), load(spark, root, "orders").select("o_orderkey", "o_custkey")
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return overlap.shared_by_index(sold, "l_suppkey", "o_custkey")


# ------------------------------------------------------------------------ ingest
@query("ingest_incremental", f"""
WITH {POSTS} SELECT id, subreddit, author, score, created_utc, title, date, strftime(date, '%Y-%m') AS year_month FROM posts WHERE subreddit IN ('1-URGENT', '3-MEDIUM')""")
def _(spark, root):
    """Posts that arrive in three deliveries, the second of which falls into months already written: as if read at once."""
    posts = roles.posts(spark, root)
    source, target = scratch(spark, "deliveries"), scratch(spark, "ingested")
    year = F.year("date")
    later = F.coalesce(F.col("title") == "O", F.lit(False))
    columns = K.SUBMISSION_COLUMNS
    for name, delivery in (("first", (year < 1999) & ~later), ("second", (year < 1999) & later), ("third", year >= 1999)):
        sinks.write_parquet(posts.where(delivery).drop("date"), f"{source}/{name}")
        ingest.run_new(spark, source, target, ["1-URGENT", "3-MEDIUM"], columns)
        ingest.run_new(spark, source, target, ["1-URGENT", "3-MEDIUM"], columns)  # nothing new
    return tables.scan_parquet(spark, f"{target}/data").drop("yyyy", "mm")


# --------------------------------------------------------------------- streaming
@query("stream_window_counts", """
SELECT time_bucket(INTERVAL '6 hours', ts) AS start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS "end", event_type, count(*) AS count
FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def _(spark, root):
    """Events per type and six hours, counted as a stream of files; a second look finds nothing new."""
    rows = tables.scan_parquet(spark, f"{root}/events.parquet").select("ts", "event_type")
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    stream = counts.scan_stream(spark, f"{root}/events.parque[t]", schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    made = counts.windowed_counts(stream, "ts", ["event_type"], "6 hours", "1 day")
    counter = counts.Counter(made, ["event_type"], scratch(spark, "stream"))
    counter.advance()
    counter.advance()
    kind = rows.schema["ts"].dataType
    return counter.table().withColumns({c: F.col(c).cast(kind) for c in ("start", "end")})
