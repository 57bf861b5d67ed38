"""The operators over the given tables, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens.llm import (
    decontaminate,
    jaccard,
    katz,
    merkle,
    packed,
    pieces,
    quality,
    resample,
    secret_scan,
    substrings,
    token_counts,
    vectors,
    wrappers,
)
from communitylens.session import checkpoint_dir, cut_lineage
from workload.registry import query


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


#: The table of CRC-32 by its rule, and a text's CRC-32 by that table.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(1, 2 * strlen({text}), 2), lambda p: CAST('0x' || substr(hex(encode({text})), p, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op1_benchmark_decontamination", """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
starts AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k
  FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS span FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, lengths WHERE len(w) >= n),
hits AS (
  SELECT doc_id, k, p.n, item_id
  FROM (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS span FROM places) p
  JOIN windows USING (span)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op1(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.report(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op3_secret_scans")
def op3(spark: SparkSession, root: str) -> DataFrame:
    return secret_scan.report(table(spark, root, "documents"))


@query("secret_ledger_growth", """
SELECT r.run, r.kind, CAST(1 AS INT) AS version, count(DISTINCT coalesce(text, '')) AS n_blobs
FROM documents, (VALUES (1, 'assign'), (1, 'access'), (2, 'hex'), (2, 'pem'), (2, 'jwt'), (2, 'forge')) r(run, kind)
GROUP BY r.run, r.kind""")
def secret_ledger_growth(spark: SparkSession, root: str) -> DataFrame:
    """What each run of a growing rule set adds to a stored ledger: two rules, then all, then all again (nothing)."""
    folder = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    # stored at once: Spark takes scans of one folder for equal, also where it has grown between them
    count = lambda ledger: cut_lineage(ledger.groupBy("kind", "version").agg(F.count("*").alias("n")))
    added = None
    for run, rules in enumerate((secret_scan.BASE[:2], secret_scan.RULES, secret_scan.RULES), 1):
        before = count(secret_scan.stored_ledger(spark, folder))
        after = count(secret_scan.scan_stored(table(spark, root, "documents"), "doc_id", folder, rules)[1])
        new = after.join(before.withColumnRenamed("n", "old"), ["kind", "version"], "left").select(
            F.lit(run).alias("run"), "kind", "version", (F.col("n") - F.coalesce("old", F.lit(0))).alias("n_blobs")).filter("n_blobs > 0")
        added = new if added is None else added.unionByName(new)
    return added


@query("op5_sentencepiece_encoding")
def op5(spark: SparkSession, root: str) -> DataFrame:
    coded = pieces.encode(table(spark, root, "documents"), "doc_id", public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_token_counts")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return token_counts.count(table(spark, root, "documents"), "doc_id", public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, root: str) -> DataFrame:
    return quality.score(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op9_repeated_strings")
def op9(spark: SparkSession, root: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, root, "documents")).drop("kept")


@query("op10_ngram_jaccard_join", """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 3), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS k FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * common >= 85 * (s.n + t.n - common)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)""")
def op10(spark: SparkSession, root: str) -> DataFrame:
    return jaccard.classes(table(spark, root, "documents"))


@query("op4_html_extraction")
def op4(spark: SparkSession, root: str) -> DataFrame:
    return wrappers.extract(table(spark, root, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op2_embedding_near_duplicates", """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)""")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, root, "embeddings"))


@query("op8_lm_scoring")
def op8(spark: SparkSession, root: str) -> DataFrame:
    return katz.score(table(spark, root, "documents"))


@query("op11_importance_resampling", f"""
WITH {CRC_TABLE},
docs AS (
  SELECT doc_id, row_number() OVER () AS row, text,
         regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
words AS (SELECT row, unnest(w) AS word FROM docs),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM benchmark),
codes AS (
  SELECT word, {crc32("word")} % 10000 AS bucket
  FROM (SELECT word FROM words UNION SELECT word FROM target), crc_table),
in_source AS (SELECT bucket, count(*) AS n FROM words JOIN codes USING (word) GROUP BY bucket),
in_target AS (SELECT bucket, count(*) AS n FROM target JOIN codes USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM in_source) AS every_s, (SELECT coalesce(sum(n), 0) FROM in_target) AS every_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(b.n, 0) AS DOUBLE) + 1) * (CAST(every_s AS DOUBLE) + 10000)
                                      / ((CAST(a.n AS DOUBLE) + 1) * (CAST(every_t AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM in_source a LEFT JOIN in_target b USING (bucket), sums),
weights AS (SELECT row, sum(gain) AS weight FROM words JOIN codes USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((
           CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (row)),
drawn AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN drawn USING (row)""")
def op11(spark: SparkSession, root: str) -> DataFrame:
    return resample.resample(table(spark, root, "documents"), table(spark, root, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query("op12_packed_token_ids")
def op12(spark: SparkSession, root: str) -> DataFrame:
    folder = packed.folder_for(spark)
    files = packed.write(table(spark, root, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return packed.read(spark, folder, files).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def tree_sql(levels: int, fanout: int = 8) -> str:
    """SQL of the Merkle manifest for groups of at most fanout ** levels rows."""
    def field(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"

    def hashes(name: str, k: int) -> str:  # a tree with one node left hands it up as it is
        return f"""
{name}{k} AS (
  SELECT g, r // {fanout} AS r, max(n) AS n, CASE WHEN max(n) <= {fanout ** (k - 1)} THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h
  FROM {name}{k - 1} GROUP BY g, r // {fanout}),
{name}_kids{k} AS (SELECT g, r // {fanout} AS up, list(h ORDER BY r) AS kids, max(n) AS n FROM {name}{k - 1} GROUP BY g, r // {fanout})"""

    def climb(name: str) -> tuple[str, str]:  # joins, and the path as a list of (left, right)
        joins = "".join(f" JOIN {name}_kids{k} ON {name}_kids{k}.g = {name}0.g AND {name}_kids{k}.up = {name}0.r // {fanout ** k}" for k in range(1, levels + 1))
        steps = ", ".join(
            f"CASE WHEN {name}0.n > {fanout ** (k - 1)} THEN ["
            f"array_to_string(list_slice({name}_kids{k}.kids, 1, {name}0.r // {fanout ** (k - 1)} % {fanout}), ''), "
            f"array_to_string(list_slice({name}_kids{k}.kids, {name}0.r // {fanout ** (k - 1)} % {fanout} + 2, {fanout}), '')] END" for k in range(1, levels + 1))
        return joins, f"[{steps}]"

    lower, upper = climb("a"), climb("b")
    return f"""
WITH {CRC_TABLE},
docs AS (
  SELECT *, CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN translate(text, {LOWER}) ELSE text END AS other
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, lang, {field("lang")} AS g,
         sha256({" || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS h,
         sha256({" || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "other"))}) AS claimed
  FROM docs),
a0 AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{",".join(hashes("a", k) for k in range(1, levels + 1))},
b0 AS (
  SELECT 0 AS g, a.g AS of, a.h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n
  FROM a{levels} a JOIN (SELECT DISTINCT g, lang FROM leaves) USING (g)),
{",".join(hashes("b", k) for k in range(1, levels + 1))},
tops AS (SELECT of, b0.h AS subroot, b{levels}.h AS root, {upper[1]} AS steps FROM b{levels}, b0{upper[0]}),
paths AS (
  SELECT doc_id, a0.h AS leaf, claimed, subroot, root, list_filter(list_concat({lower[1]}, steps), lambda s: s IS NOT NULL) AS path
  FROM a0{lower[0]} JOIN tops ON of = a0.g),
folded AS (
  SELECT *, list_reduce(list_prepend([claimed, ''], path), lambda x, s: [sha256(s[1] || x[1] || s[2]), ''])[1] AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[1] || s[2]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded"""


@query("op13_merkle_manifest", tree_sql(7))
def op13(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
                      F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return merkle.verify(documents, changed={"text": tampered}).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof("path"), 256).alias("proof_sha256"), "folded_root", "verified")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, root: str) -> DataFrame:
    return corpus_pipeline.run(spark, root)
