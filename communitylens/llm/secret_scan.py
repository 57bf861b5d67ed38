"""Secret scans with a ledger of blobs, in DataFrame functions only.

A version's text is addressed by its SHA-256. The ledger holds, for every (blob, rule, rule
version) ever scanned, the spans found; a scan takes only pairs that are not in it, one copy of
each blob, and joins the findings back to every path by the address.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from communitylens.session import cut_lineage, literal_table


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int  #: the group whose length counts
    least: int


#: In the order in which equal starts are listed.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
RULES = BASE + MORE
LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


def _blob() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def paths(versions: DataFrame, path: str) -> DataFrame:
    """(path, blob) of every version; a null text is the empty blob."""
    return versions.select(F.col(path).alias("path"), _blob().alias("blob"))


def _unseen(named: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """One path of each blob that some rule version has not seen, with those rules' kinds."""
    blobs = named.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    seen = ledger.select("blob", "kind", "version").distinct()
    wanted = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]))
    return (
        blobs.select("blob", "path", wanted.alias("w")).select("blob", "path", "w.kind", "w.version")
        .join(seen, ["blob", "kind", "version"], "left_anti")
        .groupBy("blob").agg(F.min("path").alias("path"), F.collect_set("kind").alias("todo"))
    )


def fresh(versions: DataFrame, path: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, new): the address of every version, and the ledger rows of the (blob, rule, version) not yet in ``ledger``."""
    named = cut_lineage(paths(versions, path))
    todo = _unseen(named, ledger, rules).withColumnsRenamed({"path": "p", "blob": "b"})
    texts = versions.select(F.col(path).alias("path"), _blob().alias("blob"), "text")
    blobs = texts.join(todo, texts["path"].eqNullSafe(todo["p"]) & (texts["blob"] == todo["b"]))

    def matched(rule: Rule) -> Column:
        found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        return F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.pattern).alias("pattern"),
            F.lit(rule.group).alias("grp"), F.lit(rule.least).alias("least"),
            F.when(F.array_contains("todo", rule.kind), F.coalesce(found, F.array().cast("array<string>"))).alias("found"),
        )

    def measured(x: Column) -> Column:
        size = lambda texts: F.transform(texts, lambda t: F.length(t))
        return F.struct(x["kind"], x["least"], F.arrays_zip(
            size(F.split("text", x["pattern"], -1)).alias("gap"), size(x["found"]).alias("size"),
            size(F.regexp_extract_all("text", x["pattern"], x["grp"])).alias("value"),
        ).alias("parts"))

    scanned = blobs.select("blob", "todo", "text", F.array(*[matched(r) for r in rules]).alias("raw")).select(
        "blob", "todo", F.transform(F.filter("raw", lambda x: F.size(x["found"]) > 0), measured).alias("found")
    )
    scanned = cut_lineage(scanned.dropDuplicates(["blob"]))
    so_far = Window.partitionBy("blob", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        scanned.select("blob", F.explode("found").alias("f"))
        .select("blob", "f.kind", "f.least", F.posexplode("f.parts").alias("place", "part"))
        .select("blob", "kind", "least", "part.*", F.sum(F.expr("part.gap + coalesce(part.size, 0)")).over(so_far).alias("upto"))
        .filter("value >= least")
        .groupBy("blob", "kind").agg(F.array_sort(F.collect_list(
            F.expr("struct(cast(upto - size as int) as start, cast(upto as int) as end)"))).alias("spans"))
    )
    versions_of = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    new = (
        scanned.select("blob", F.explode("todo").alias("kind")).join(spans, ["blob", "kind"], "left")
        .select("blob", "kind", versions_of[F.col("kind")].alias("version"),
                F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"))
    )
    return named, new


def scan(versions: DataFrame, path: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES):
    """(paths, ledger): the address of every version, and the ledger with the new findings added.

    Spans count code points from 0 and exclude their end. Matches of one rule are leftmost and
    do not overlap; those with too short a group are dropped afterwards, so they still use up
    their text. Null and empty texts have no spans; a null path is a path like any other;
    repeated versions are scanned once; an empty table leaves the ledger as it is.
    """
    named, new = fresh(versions, path, ledger, rules)
    return named, new if ledger is None else ledger.unionByName(new)


def stored_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger table kept in ``folder``; without rows where the folder is empty or not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(LEDGER).parquet(folder) if system.exists(place) else spark.createDataFrame([], LEDGER)


def scan_stored(versions: DataFrame, path: str, folder: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``scan`` with the ledger table in ``folder``: read, only what it lacks is scanned, and that is appended.

    A ledger row is complete in itself, so a run that broke off while it appended leaves a valid ledger and the
    next run scans the rest. Two runs at a time may both append a row; ``findings`` takes equal spans once. Don't
    use ledgers read before and after an append in one plan: Spark takes scans of one folder for equal.
    An empty table of versions appends nothing.
    """
    spark = versions.sparkSession
    named, new = fresh(versions, path, stored_ledger(spark, folder), rules)
    new.write.mode("append").option("compression", "zstd").parquet(folder)
    return named, stored_ledger(spark, folder)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob with findings: all spans of the given rule versions as (start, rank, kind, end), in order."""
    order = literal_table(ledger.sparkSession, [(r.kind, r.version, k) for k, r in enumerate(rules)], "kind string, version int, rank int")
    return (
        ledger.filter(F.size("spans") > 0).join(order, ["kind", "version"])
        .select("blob", F.explode("spans").alias("s"), "rank", "kind")
        .groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("s.start", "rank", "kind", "s.end"))).alias("spans"))
    )


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document row."""
    named, ledger = scan(documents, "doc_id")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    digests = findings(ledger).select(
        "blob", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )
    return named.join(digests, "blob", "left").select(
        F.col("path").alias("doc_id"), *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("bigint")).alias(f"n_{r.kind}") for r in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced by ``mark``; spans that overlap are replaced as one.

    n_chars, where it exists, is counted anew for changed texts.
    """
    quoted = mark.replace("\\", "\\\\").replace("'", "\\'")
    named, ledger = scan(documents, "doc_id")
    found = named.join(findings(ledger), "blob").select(
        F.col("path").alias("secret_id"), F.col("blob").alias("secret_blob"), "spans").distinct()
    packed = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("document"), "doc_id", "text", _blob().alias("blob"))
    joined = packed.join(found, F.col("doc_id").eqNullSafe(F.col("secret_id")) & (F.col("blob") == F.col("secret_blob")), "left")
    pieces = F.expr(f"""aggregate(spans, struct(0 AS upto, cast(array() AS array<string>) AS out),
        (a, s) -> if(s.start >= a.upto,
            struct(s.end AS upto, concat(a.out, array(substring(text, a.upto + 1, s.start - a.upto), '{quoted}')) AS out),
            struct(greatest(a.upto, s.end) AS upto, a.out AS out)),
        a -> concat_ws('', concat(a.out, array(substring(text, a.upto + 1)))))""")
    new = {"text": pieces, "n_chars": F.length(pieces)}
    old = F.col("document")
    return joined.select(*[
        F.when(F.col("spans").isNull(), old[c]).otherwise(new[c].cast(documents.schema[c].dataType)).alias(c) if c in new else old[c].alias(c)
        for c in documents.columns
    ])
