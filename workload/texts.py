"""Text cleaning, terms, sentiment and discussion types."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.functions import text
from communitylens.functions.labels import sentiment_class
from communitylens.operators import discussion, features, sentiment, terms
from workload import roles
from workload.registry import query, rounded
from workload.roles import CHAT, DOCS, KEYWORDS, RULES, sql_list, sql_rows
from workload.rows import keyword_case

ENGLISH = discussion.stop_words(())
CLOUD_STOP = discussion.stop_words()
TOPIC_SQL = "trim(regexp_replace(regexp_replace(lower(body), 'http\\S+|www\\.\\S+', ' ', 'g'), '[^a-z]+', ' ', 'g'))"
SPLIT_SQL = "string_split_regex(regexp_replace(lower({c}), '\\s+$', ''), '\\s')"
CLOUD_SQL = f"""list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(body, '')), 'http\\S+|www\\S+', '', 'g'), '[^a-z]+', ' ', 'g')), ' '),
  lambda w: length(w) >= 3 AND w NOT IN {sql_list(CLOUD_STOP)})"""


@query("text_clean_topic", f"WITH {DOCS} SELECT id, {TOPIC_SQL} AS clean_text FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", text.topic_text("body").alias("clean_text"))


SENTIMENT_TEXT = "regexp_replace(regexp_replace(regexp_replace({c}, 'http\\S+|www\\.\\S+', ' ', 'g'), '[\\*_~`#]', ' ', 'g'), '\\s+', ' ', 'g')"


@query("text_clean_sentiment", f"WITH {DOCS} SELECT id, {SENTIMENT_TEXT.format(c='body')} AS text FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", text.sentiment_text("body").alias("text"))


CLUSTER_SQL = "regexp_replace(concat_ws(' ', title, selftext), '[^A-Za-z\\s]', '', 'g')"


@query("text_clean_cluster", f"WITH {DOCS} SELECT id, {CLUSTER_SQL} AS text FROM docs")
def _(spark, root):
    return roles.docs(spark, root).select("id", text.cluster_text(text.title_and_text("title", "selftext")).alias("text"))


@query("text_clean_cloud", f"WITH {DOCS} SELECT id, list_aggregate({CLOUD_SQL}, 'string_agg', ' ') AS clean_text FROM docs")
def _(spark, root):
    words = text.cloud_tokens("body", CLOUD_STOP, 3)
    joined = F.when(F.size("words") > 0, F.array_join("words", " "))
    return roles.docs(spark, root).select("id", words.alias("words")).select("id", joined.alias("clean_text"))


@query("lemma_lookup", f"""
WITH {DOCS}, t AS (SELECT unnest({CLOUD_SQL}) AS term FROM docs)
SELECT coalesce(lemma, t.term) AS term, count(*) AS count
FROM t LEFT JOIN (VALUES {sql_rows(roles.LEMMAS)}) AS l(term, lemma) ON l.term = t.term GROUP BY 1""")
def _(spark, root):
    docs = roles.docs(spark, root).withColumn("words", text.cloud_tokens("body", CLOUD_STOP, 3))
    return terms.word_count(docs, "words", lemmas=roles.lemmas(spark))


@query("tokenize_ws", f"""
WITH {DOCS}, w AS (SELECT id, {SPLIT_SQL.format(c='body')} AS words FROM docs)
SELECT id, len(words) AS n_tokens, len(list_filter(words, lambda w: w = '')) AS n_empty, array_to_string(words, '/') AS words FROM w""")
def _(spark, root):
    split = features.tokenizer("body").transform(roles.docs(spark, root))
    return split.select(
        "id", F.size("words").cast("bigint").alias("n_tokens"),
        F.size(F.filter("words", lambda w: w == "")).cast("bigint").alias("n_empty"), F.array_join("words", "/").alias("words"),
    )


@query("tokenize_drop_empty", f"""
WITH {DOCS}, w AS (SELECT id, {SPLIT_SQL.format(c='body')} AS words FROM docs)
SELECT id, array_to_string(list_filter(words, lambda w: w <> ''), '/') AS words FROM w""")
def _(spark, root):
    return roles.docs(spark, root).select("id", F.array_join(text.tokens("body"), "/").alias("words"))


@query("remove_stopwords", f"""
WITH {DOCS} SELECT id, array_to_string(list_filter({SPLIT_SQL.format(c='body')}, lambda w: w NOT IN {sql_list(ENGLISH)}), '/') AS words FROM docs""")
def _(spark, root):
    split = features.tokenizer("body").transform(roles.docs(spark, root))
    kept = features.stop_words_remover("words", "filtered").transform(split)
    return kept.select("id", F.array_join("filtered", "/").alias("words"))


@query("vocabulary", f"""
WITH {DOCS}, t AS (SELECT id, unnest(string_split({TOPIC_SQL}, ' ')) AS term FROM docs)
SELECT term, count(*) AS count, count(DISTINCT id) AS documents FROM t GROUP BY 1 HAVING count(DISTINCT id) >= 10
ORDER BY 2 DESC, 1 LIMIT 5000""")
def _(spark, root):
    docs = roles.docs(spark, root).withColumn("words", F.split(text.topic_text("body"), " "))
    return terms.vocabulary(docs, "words", min_df=10, size=5000)


@query("idf_weight", f"""
WITH {DOCS}, n AS (SELECT count(*) AS n FROM docs), t AS (SELECT DISTINCT id, unnest(string_split({TOPIC_SQL}, ' ')) AS term FROM docs)
SELECT term, count(*) AS documents, round(ln(((SELECT n FROM n) + 1.0) / (count(*) + 1.0)), 9) AS idf FROM t GROUP BY 1""")
def _(spark, root):
    docs = roles.docs(spark, root).withColumn("words", F.split(text.topic_text("body"), " "))
    return rounded(terms.inverse_document_frequency(docs, "words"), ["idf"], 9)


PUNCT = "[!-/:-@\\[-`{-~]"


def sentiment_sql(source: str, key: str, body: str, lexicon=roles.WORDS, rules=RULES) -> str:
    """CTEs ending in ``scored(key, score)``: the published rules, word by word."""
    boost = sql_list(rules.boosters)
    damp = sql_list(rules.dampeners)
    negate = sql_list(rules.negators)
    def shout(c):
        return f"({c} = upper({c}) AND {c} <> lower({c}))"
    def bare(c):
        stripped = f"regexp_replace({c}, '^{PUNCT}+|{PUNCT}+$', '', 'g')"
        return f"CASE WHEN length({stripped}) <= 2 THEN {c} ELSE {stripped} END"
    def step(n, damping):
        """v after the n-th word before: first its modifier, then its negation."""
        p, low = f"p{n}", [f"lower(p{k})" for k in (1, 2, 3)]
        added = (f"coalesce(CASE WHEN lower({p}) IN {boost} THEN 0.293 WHEN lower({p}) IN {damp} THEN -0.293 END * CASE WHEN v < 0 THEN -1 ELSE 1 END"
                 f" + CASE WHEN capitals AND {shout(p)} THEN CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END, 0) * {damping}")
        never = doubt = "false"
        if n > 1:
            never = f"({low[n - 1]} = 'never' AND {low[n - 2]} IN ('so', 'this'))" + (f" OR {low[0]} IN ('so', 'this')" if n == 3 else "")
            doubt = f"({low[n - 1]} = 'without' AND {low[n - 2]} = 'doubt')" + (f" OR {low[0]} = 'doubt'" if n == 3 else "")
        factor = f"CASE WHEN {never} THEN 1.25 WHEN {doubt} THEN 1 WHEN {low[n - 1]} IN {negate} OR contains({low[n - 1]}, 'n''t') THEN -0.74 ELSE 1 END"
        return f"CASE WHEN i >= {n} AND NOT k{n} THEN (v + {added}) * {factor} ELSE v END"
    idioms = " ".join(f"WHEN '{phrase}' THEN {value}" for phrase, value in rules.idioms)
    def idiom(*places):
        return "coalesce(" + ", ".join(f"CASE {place} {idioms} END" for place in places) + ", {rest})"
    w, b1, b2, b3, n1, n2 = (f"lower({c})" for c in ("word", "p1", "p2", "p3", "n1", "n2"))
    said = idiom(f"{b1} || ' ' || {w}", f"{b2} || ' ' || {b1} || ' ' || {w}", f"{b2} || ' ' || {b1}", f"{b3} || ' ' || {b2} || ' ' || {b1}", f"{b3} || ' ' || {b2}")
    saying = idiom(f"{w} || ' ' || {n1} || ' ' || {n2}", f"{w} || ' ' || {n1}").format(rest=said.format(rest="v"))
    phrases = " ".join(f"- CASE WHEN {place} IN {sql_list(rules.phrases)} THEN 0.293 ELSE 0 END" for place in (
        f"{b3} || ' ' || {b2} || ' ' || {b1}", f"{b3} || ' ' || {b2}", f"{b2} || ' ' || {b1}"))
    return f"""
body AS (SELECT {key} AS key, coalesce({body}, '') AS body FROM {source}),
raw AS (SELECT key, body, unnest(w) AS raw, generate_subscripts(w, 1) - 1 AS i
        FROM (SELECT key, body, string_split(trim(regexp_replace(body, '\\s+', ' ', 'g')), ' ') AS w FROM body)),
words AS (SELECT key, i, raw, {bare('raw')} AS word FROM raw),
doc AS (SELECT key, bool_or({shout('raw')}) AND bool_or(NOT {shout('raw')}) AS capitals,
               min(i) FILTER (lower(word) = '{rules.contrast}') AS contrast FROM words GROUP BY 1),
near AS (SELECT key, i, word, coalesce(lag(word, 1) OVER w, '') AS p1, coalesce(lag(word, 2) OVER w, '') AS p2,
                coalesce(lag(word, 3) OVER w, '') AS p3, coalesce(lead(word, 1) OVER w, '') AS n1, coalesce(lead(word, 2) OVER w, '') AS n2
         FROM words WINDOW w AS (PARTITION BY key ORDER BY i)),
lex AS (SELECT term, max(valence)::DOUBLE AS valence FROM (VALUES {sql_rows(lexicon)}) AS t(term, valence) GROUP BY 1),
start AS (
  SELECT near.*, capitals, contrast, lower(p1) IN (SELECT term FROM lex) AS k1, lower(p2) IN (SELECT term FROM lex) AS k2, lower(p3) IN (SELECT term FROM lex) AS k3,
    CASE WHEN {b1} = 'no' OR {b2} = 'no' OR ({b3} = 'no' AND {b1} IN ('or', 'nor')) THEN valence * -0.74
         WHEN {w} = 'no' AND {n1} IN (SELECT term FROM lex) THEN 0 ELSE valence END AS v
  FROM near JOIN doc USING (key) JOIN lex ON {w} = term),
loud AS (SELECT * REPLACE (v + CASE WHEN capitals AND {shout('word')} THEN CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END AS v) FROM start),
one AS (SELECT * REPLACE ({step(1, 1.0)} AS v) FROM loud),
two AS (SELECT * REPLACE ({step(2, 0.95)} AS v) FROM one),
three AS (SELECT * REPLACE ({step(3, 0.9)} AS v) FROM two),
said AS (SELECT * REPLACE (CASE WHEN i >= 3 AND NOT k3 THEN {saying} {phrases} ELSE v END AS v) FROM three),
hits AS (
  SELECT key, CAST(CASE WHEN {w} IN {boost} OR {w} IN {damp} OR ({w} = 'kind' AND {n1} = 'of') THEN 0
      WHEN {b1} = 'least' AND NOT k1 AND (i = 1 OR {b2} NOT IN ('at', 'very')) THEN v * -0.74 ELSE v END
      * CASE WHEN contrast IS NULL OR i = contrast THEN 1 WHEN i < contrast THEN 0.5 ELSE 1.5 END AS DOUBLE) AS v
  FROM said),
sums AS (
  SELECT key, coalesce(total, 0) AS total,
         least(length(body) - length(replace(body, '!', '')), 4) * 0.292
         + CASE WHEN length(body) - length(replace(body, '?', '')) <= 1 THEN 0
                WHEN length(body) - length(replace(body, '?', '')) <= 3 THEN (length(body) - length(replace(body, '?', ''))) * 0.18
                ELSE 0.96 END AS emphasis
  FROM body LEFT JOIN (SELECT key, sum(v) AS total FROM hits GROUP BY 1) USING (key)),
moved AS (SELECT key, total + sign(total) * emphasis AS s FROM sums),
scored AS (SELECT key, greatest(-1.0, least(1.0, s / sqrt(s * s + 15)))::DOUBLE AS score FROM moved)"""


@query("sentiment_lexicon_score", f"WITH {DOCS}, {sentiment_sql('docs', 'id', 'body')} SELECT key AS id, round(score, 6) AS sentiment_score FROM scored")
def _(spark, root):
    docs = roles.docs(spark, root).select("id", "body")
    return rounded(sentiment.score_sentiment(docs, "body", ["id"], roles.lexicon(spark), rules=RULES), ["sentiment_score"])


@query("sentiment_default_rules", f"""
WITH {CHAT}, {sentiment_sql('chat', 'id', 'body', sentiment.LEXICON, sentiment.Rules())} SELECT key AS id, round(score, 6) AS sentiment_score FROM scored""")
def _(spark, root):
    """The built-in lexicon and rules."""
    return rounded(sentiment.score_sentiment(roles.chat(spark, root), "body", ["id"]), ["sentiment_score"])


LEMMA_WORDS = f"""
t AS (SELECT id, unnest({CLOUD_SQL}) AS term FROM docs),
lemmatised AS (SELECT id, coalesce(l.lemma, t.term) AS term FROM t LEFT JOIN (VALUES {sql_rows(roles.LEMMAS)}) AS l(term, lemma) ON l.term = t.term),
typed AS (SELECT d.id, {keyword_case("coalesce(string_agg(term, ' '), '')")} AS topic_type FROM docs d LEFT JOIN lemmatised USING (id) GROUP BY d.id)"""


@query("discussion_type", f"WITH {DOCS}, {LEMMA_WORDS} SELECT id, topic_type FROM typed")
def _(spark, root):
    typed = discussion.discussion_type(
        roles.docs(spark, root), "body", KEYWORDS, CLOUD_STOP, lemmas=roles.lemmas(spark))
    return typed.select("id", "topic_type")


TERM_TOP = """
counts AS (SELECT topic_type, term, count(*) AS count FROM lemmatised JOIN typed USING (id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_type ORDER BY count DESC, term) AS rank FROM counts)"""


@query("term_top_n", f"WITH {DOCS}, {LEMMA_WORDS}, {TERM_TOP} SELECT topic_type, CAST(rank AS INTEGER) AS rank, term, count FROM ranked WHERE rank <= 100")
def _(spark, root):
    lemmas = roles.lemmas(spark)
    typed = discussion.discussion_type(roles.docs(spark, root), "body", KEYWORDS, CLOUD_STOP, lemmas=lemmas)
    return terms.leading_terms(typed, "tokens", "topic_type", 100, lemmas)


@query("sentiment_classes", f"""
WITH {CHAT}, {sentiment_sql('chat', 'id', 'body')}
SELECT subreddit, CASE WHEN scored.score >= 0.05 THEN 'positive' WHEN scored.score <= -0.05 THEN 'negative' ELSE 'neutral' END AS class, count(*) AS n
FROM scored JOIN chat ON key = id GROUP BY ALL""")
def _(spark, root):
    scored = sentiment.score_sentiment(roles.chat(spark, root), "body", ["id", "subreddit"], roles.lexicon(spark), rules=RULES)
    return scored.groupBy("subreddit", sentiment_class("sentiment_score").alias("class")).agg(F.count(F.lit(1)).alias("n"))
