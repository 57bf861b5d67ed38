"""A Merkle tree over the rows of a dataset, one subtree per group, by nested-interval labels.

Rows are ranked inside their group. Every node carries the interval of leaf ranks it covers. A node's
ancestor is found by a join on the group and the level's bucket (rank div fanout ** level) with a containment
test; what is left of the parent's interval without the node's own, child by child, are its siblings. Paths
come down from the root one level at a time, so a parent meets its few children only and no node near
the root becomes a hot join key. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from communitylens.llm.store import written

FANOUT = 8
EMPTY_PATH = "array<struct<left:string,right:string>>"


def field(column: Column | str) -> Column:
    """A value as text that no other values can be read as: ``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column | str) -> Column:
    """A row's digest."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(start: Column | str, path: Column | str) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, F.col(start) if isinstance(start, str) else start,
                       lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof(path: Column | str) -> Column:
    """The digests of a path, from the leaf up, joined."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` (tree, ...) with lo, their rank in their tree, and total, the tree's size, without one task per tree.

    ``order`` sorts by tree first. Rows are dealt to ranges and numbered; each range's first number and
    count per tree (as many rows as ranges and trees) turn these numbers into ranks.
    """
    # stored first: the bounds of the ranges are sampled from the rows, and the digests in them are made once
    placed = written(written(rows).orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy("part", "tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "part", "tree", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return placed.join(runs, ["part", "tree"]).withColumn("lo", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _raised(nodes: DataFrame, span: int, more: Sequence[str] = ()) -> DataFrame:
    """The parents of ``nodes`` (tree, total, lo, hi, hash): runs of nodes in one ``span`` of leaf ranks, with their kids."""
    kid = F.struct("lo", "hi", "hash", *more)
    parents = nodes.groupBy("tree", "total", F.expr(f"lo div {span}L").alias("bucket")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["hash"]), ""), 256)
    return parents.select(
        "tree", "total", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
        F.when(F.col("total") == 1, F.col("kids")[0]["hash"]).otherwise(joined).alias("hash"), "kids")


def _levels(leaves: DataFrame, fanout: int, more: Sequence[str]) -> list[DataFrame]:
    """Stored nodes of each level above the leaves. A tree's last level has one node; a lone leaf is its own parent."""
    stored = [written(_raised(leaves.withColumn("hi", F.col("lo") + 1), fanout, more))]
    largest = stored[0].agg(F.max("total")).first()[0] or 0
    span = fanout
    while span < largest:
        stored.append(written(_raised(stored[-1].filter(F.col("total") > span).drop("kids"), span * fanout)))
        span *= fanout
    return stored


def _tops(levels: list[DataFrame], fanout: int) -> list[DataFrame]:
    """Of each level the nodes that are their tree's root."""
    return [
        level.filter((F.col("total") <= fanout ** k) & (F.col("total") > (fanout ** (k - 1) if k > 1 else 0)))
        for k, level in enumerate(levels, 1)
    ]


def _step(kids: str, lo: Column, hi: Column) -> Column:
    """The digests of a node's siblings on both sides: its parent's kids without its own interval."""
    def side(test) -> Column:
        return F.array_join(F.transform(F.filter(kids, test), lambda k: k["hash"]), "")

    return F.struct(side(lambda k: k["hi"] <= lo).alias("left"), side(lambda k: k["lo"] >= hi).alias("right"))


def _attached(levels: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """The nodes of the lowest level with the path above them.

    ``roots`` (tree, path and further columns) gives each tree's root its path; all columns but tree are handed down.
    """
    handed = [c for c in roots.columns if c not in ("tree", "path")]
    above = None
    for k in range(len(levels), 0, -1):
        nodes = _tops(levels, fanout)[k - 1].join(roots, "tree")
        if above is not None:
            bucket = F.expr(f"lo div {fanout ** (k + 1)}L")
            parents = above.select(
                "tree", bucket.alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("kids").alias("peers"),
                F.col("path").alias("upper"), *handed)
            inner = levels[k - 1].filter(F.col("total") > fanout ** k).withColumn("bucket", bucket).join(parents, ["tree", "bucket"])
            inner = inner.filter((F.col("lo") >= F.col("from")) & (F.col("hi") <= F.col("to")))
            path = F.concat(F.array(_step("peers", F.col("lo"), F.col("hi"))), F.col("upper"))
            nodes = inner.withColumn("path", path).select(nodes.columns).unionByName(nodes)
        above = nodes
    return above


def _each_leaf(nodes: DataFrame, more: Sequence[str], handed: Sequence[str]) -> DataFrame:
    """The leaves below the lowest nodes with their whole paths."""
    rows = nodes.select("total", "kids", F.col("path").alias("upper"), *handed, F.explode("kids").alias("kid"))
    path = F.concat(F.array(_step("kids", F.col("kid")["lo"], F.col("kid")["hi"])), F.col("upper"))
    return rows.select(
        F.col("kid")["hash"].alias("leaf"), F.col("kid")["lo"].alias("leaf_rank"), *[F.col("kid")[c].alias(c) for c in more], *handed,
        F.when(F.col("total") == 1, F.col("upper")).otherwise(path).alias("path"))


def manifest(leaves: DataFrame, group: str, key: str, keep: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """key, ``keep``, leaf, leaf_rank, subroot, root and path of every row of ``leaves`` (group, key, leaf).

    Leaves of one group ascend by key (null first) and are joined ``fanout`` at a time until one node is left, the
    subroot; a lone leaf is its own. The subroots, by group (null first, then by UTF-8 bytes), are joined alike to the root.
    ``path`` lists, from the leaf to the root, the digests left and right of the way at each step. Rows with one
    key in a group are ordered by leaf, so rows that repeat change places without effect. Other columns are not used;
    an empty table gives no rows.
    """
    rows = leaves.select(
        field(group).alias("tree"), F.col(group).cast("string").alias("name"), F.col(key).alias("ident"), F.col("leaf").alias("hash"),
        F.struct(F.lit(0).alias("none"), *[F.col(c) for c in keep]).alias("kept"))
    order = [F.asc_nulls_first("name"), F.asc_nulls_first("ident"), F.asc("hash"), F.asc("kept")]
    more = ["ident", "kept"]
    lower = _levels(_ranked(rows, order).drop("name"), fanout, more)
    tops = _tops(lower, fanout)
    subroots = tops[0].select("tree", "hash")
    for top in tops[1:]:
        subroots = subroots.unionByName(top.select("tree", "hash"))
    name = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    groups = subroots.select(F.lit("").alias("tree"), name.alias("name"), F.col("tree").alias("of"), "hash")
    upper = _levels(_ranked(groups, [F.asc_nulls_first("name")]).drop("name"), fanout, ["of"])
    root = _tops(upper, fanout)[-1].select("tree", F.col("hash").alias("root"), F.array().cast(EMPTY_PATH).alias("path"))
    roots = _each_leaf(_attached(upper, root, fanout), ["of"], ["root"]).select(
        F.col("of").alias("tree"), F.col("leaf").alias("subroot"), "root", "path")
    out = _each_leaf(_attached(lower, roots, fanout), more, ["subroot", "root"])
    return out.select(F.col("ident").alias(key), *[F.col("kept")[c].alias(c) for c in keep], "leaf", "leaf_rank", "subroot", "root", "path")


def verify(documents: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
           key: str = "doc_id", changed: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """The manifest of ``documents``, and folded_root and verified of each row as it is claimed to be.

    ``changed`` replaces columns of the claimed rows; by default rows are claimed as they are. A null counts as
    a value of its own in every column. The claimed row's leaf is folded up with the siblings of the manifest; it is
    verified where that gives the root.
    """
    claims = leaf(*[(changed or {}).get(c, F.col(c)) for c in columns])
    rows = documents.select(F.col(group), F.col(key), leaf(*columns).alias("leaf"), claims.alias("claimed"))
    out = manifest(rows, group, key, ["claimed"], fanout)
    out = out.withColumn("folded_root", fold("claimed", "path"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
