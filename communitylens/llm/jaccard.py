"""Exact Jaccard join of shingle sets with skipping by set relations.

Equal sets are one set. A set is indexed under the first tokens of an order that puts frequent
tokens last, as many as any similar set must share one of. First every set is compared with its
neighbour in each index list (lists stand in order of size); what that links is one class, and no two
sets of a class are compared again: a set takes over the answers of the similar set it is linked to.
Then short lists that still hold several classes are joined, skipping positions that leave too few
tokens. Similar sets share not one but SHARED tokens of slightly longer prefixes, so a pair is compared in
full only if that many lists hold both. Sets that meet in a long list belong to one group; groups are dealt to
blocks of bounded size, and a task gets two blocks: it derives every set's intersections from those of one
reference set, the tokens that most sets of both blocks hold, by the tokens in which a set differs from
it, and sends on a spanning set of links, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from communitylens.llm import arrays
from communitylens.llm.bitmaps import bitmap
from communitylens.llm.graph import components
from communitylens.llm.store import written
from communitylens.session import cut_lineage

#: Text bytes whose whole sets leave a task together.
CHUNK_BYTES = 1 << 20
#: Tokens that head the lists of at least so many documents go to the end of the order.
FREQUENT = 10
#: Prefix tokens that similar sets have in common at least (fewer only where a set is that small).
SHARED = 3
FILTER_LOG2 = 25
#: Sets in a list beyond which it is compared in blocks.
LIST = 64
#: Sets in a list beyond which it is ordered in parts.
PART = 4096
#: Tokens and sets in a block, on average at most.
BLOCK_TOKENS, BLOCK_SETS = 1 << 18, 1024
#: Meetings of two sets in a token that are counted at once.
MEETINGS = 1 << 22


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; a text of fewer words is one shingle."""
    low = arrays.LOWER[data]
    starts, ends, first = arrays.words(low, offsets, arrays.NONSPACE)
    hashes = arrays.span_hashes(low, starts, ends)
    grams = arrays.gram_hashes(hashes, words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a:b - words + 1]))
        else:
            out.append(arrays.gram_hashes(hashes[a:b], b - a) if b > a else grams[:0])
    return out


def prefix(tokens: np.ndarray, percent: int, frequent: np.ndarray | None) -> np.ndarray:
    """The tokens of which every set with that similarity shares SHARED, rare tokens first."""
    least = (percent * len(tokens) + 99) // 100
    size = len(tokens) - least + min(SHARED, least)
    if frequent is None:
        return tokens[:size]
    late = arrays.set_bits(frequent, tokens)
    rare = tokens[~late]
    return rare[:size] if len(rare) >= size else np.concatenate([rare, tokens[late]])[:size]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=bounds[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64), kind))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _entries(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of every entry of a column of lists."""
    counts = np.diff(tokens.offsets.to_numpy())
    return np.repeat(np.arange(len(counts)), counts), tokens.flatten().to_numpy()


def common_counts(left: tuple[np.ndarray, np.ndarray, int], right: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets; a block is its entries' rows and tokens, and its number of sets.

    The reference set C holds the tokens of more than half of all sets. For sets X and Y,
    |X and Y| = |C| - |C without X| - |C without Y| + |what both lack of C| + |what both have beside C|.
    """
    tokens, ids = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    reference = np.bincount(ids, minlength=len(tokens)) * 2 > left[2] + right[2]
    size = int(reference.sum())
    place = np.cumsum(reference) - 1
    lacking, differing = [], []
    for (rows, _, n), mine in ((left, ids[:len(left[0])]), (right, ids[len(left[0]):])):
        inside = reference[mine]
        held = np.zeros((n, size), bool)
        held[rows[inside], place[mine[inside]]] = True
        lack_row, lack_place = np.nonzero(~held)
        lacking.append(np.bincount(lack_row, minlength=n))
        row = np.concatenate([rows[~inside], lack_row])
        token = np.concatenate([mine[~inside], np.flatnonzero(reference)[lack_place]])
        order = np.argsort(token, kind="stable")
        differing.append((row[order], token[order]))
    out = size - lacking[0][:, None] - lacking[1][None, :]
    (row_a, token_a), (row_b, token_b) = differing
    shared = np.intersect1d(token_a, token_b)
    start_a, start_b = np.searchsorted(token_a, shared), np.searchsorted(token_b, shared)
    count_a = np.searchsorted(token_a, shared, side="right") - start_a
    count_b = np.searchsorted(token_b, shared, side="right") - start_b
    # each entry of the left meets the right's entries of its token
    entry = np.repeat(start_a - np.cumsum(count_a) + count_a, count_a) + np.arange(count_a.sum())
    first, meets = np.repeat(start_b, count_a), np.repeat(count_b, count_a)
    ends = np.cumsum(meets)
    at = 0
    while at < len(entry):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - meets[at] + MEETINGS, side="right")))
        n = meets[at:upto]
        other = np.repeat(first[at:upto] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cells = np.repeat(row_a[entry[at:upto]], n) * right[2] + row_b[other]
        out += np.bincount(cells, minlength=out.size).reshape(out.shape)
        at = upto
    return out


def _spanning(left: pa.StructArray, right: pa.StructArray, percent: int) -> pa.RecordBatch:
    """(a, b): links that connect what the similar sets of two blocks connect; sets of one class are connected already."""
    sides = []
    for side in (left, right):
        node, kind, tokens = (side.field(c) for c in ("node", "class", "tokens"))
        rows, flat = _entries(tokens)
        sides.append((node.to_numpy(), kind.to_numpy(), (rows, flat, len(node)), np.bincount(rows, minlength=len(node))))
    (node_a, kind_a, block_a, n_a), (node_b, kind_b, block_b, n_b) = sides
    common = common_counts(block_a, block_b)
    similar = (100 * common >= percent * (n_a[:, None] + n_b[None, :] - common)) & (kind_a[:, None] != kind_b[None, :])
    at_a, at_b = np.nonzero(similar)
    kinds, ends = np.unique(np.concatenate([kind_a[at_a], kind_b[at_b]]), return_inverse=True)
    a, b = ends[:len(at_a)], ends[len(at_a):]
    roots = np.arange(len(kinds))
    while True:
        least = roots.copy()
        np.minimum.at(least, a, roots[b])
        np.minimum.at(least, b, roots[a])
        least = least[least]
        if (least == roots).all():
            break
        roots = least
    # a class is named by one of its nodes, so classes can be linked in place of the sets that were similar
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(kinds[roots])], ["a", "b"])


class Join:
    """The join of one table of documents: its sets, the index over them, and the links found."""

    def __init__(self, documents: DataFrame, key: str, words: int, percent: int):
        self.key, self.words, self.percent = key, words, percent
        self.kind = documents.schema[key].dataType.simpleString()
        self.texts = documents.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), F.xxhash64(key).alias("ident"),
            F.col("text").cast("string").alias("text"),
        )
        self.sets = self._sets()
        self.first = written(self.sets.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc").alias("least")))

    def _frequent(self) -> np.ndarray:
        words, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, data, offsets in arrays.chunks(batch.column("text")):
                    found = [prefix(s, percent, None) for s in shingle_sets(data, offsets, words)]
                    tokens, counts = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], ["token", "n"])

        counts = self.texts.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
        return bitmap(counts.filter(F.col("n") >= FREQUENT), "token", FILTER_LOG2)

    def _sets(self) -> DataFrame:
        """row, doc, n, digest and indexed tokens of every document row."""
        words, percent = self.words, self.percent
        frequent = self.texts.sparkSession.sparkContext.broadcast(self._frequent())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, data, offsets in arrays.chunks(batch.column("text")):
                    sets = shingle_sets(data, offsets, words)
                    part = batch.slice(first, last - first)
                    yield pa.RecordBatch.from_arrays([
                        part.column("row"), part.column("doc"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        _lists([prefix(s, percent, frequent.value) for s in sets], pa.int64()),
                    ], ["row", "doc", "n", "digest", "tokens"])

        return written(self.texts.mapInArrow(run, f"row bigint, doc {self.kind}, n bigint, digest binary, tokens array<bigint>"))

    def index(self) -> DataFrame:
        """(token, node, n, place, size) of one row per distinct set, where another set has the token; with the one before it in size.

        ``size`` is the list's; a list beyond PART is ordered in parts by a hash of the set, and its size is its part's.
        """
        rows = self.sets.join(self.first.select(F.col("node").alias("row")), "row", "left_semi")
        rows = rows.select(F.col("row").alias("node"), "n", F.posexplode("tokens").alias("place", "token"))
        long = rows.groupBy("token").agg(F.count("*").alias("size")).filter(F.col("size") > PART)
        long = cut_lineage(long.select("token", F.ceil(F.col("size") / PART).alias("parts")))
        rows = rows.join(long, "token", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
        order = Window.partitionBy("token", "part").orderBy("n", "node")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return written(
            rows.withColumn("before", F.lag("node").over(order)).withColumn("before_n", F.lag("n").over(order))
            .withColumn("size", F.when(F.col("parts").isNull(), F.count("*").over(whole)).otherwise(PART + 1))
            .filter("size > 1").drop("part", "parts")
        )

    def _whole(self, asked: DataFrame) -> DataFrame:
        """(digest, tokens): the whole sets of documents asked for by ``ident``; others may come too, and a set more than once."""
        words = self.words
        wanted = self.texts.sparkSession.sparkContext.broadcast(bitmap(asked, "ident", FILTER_LOG2))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(arrays.set_bits(wanted.value, batch.column("ident").to_numpy().view(np.uint64))))
                sent = set()  # copies have one digest and one set
                for _, _, data, offsets in arrays.chunks(batch.column("text"), CHUNK_BYTES):
                    sets = {_digest(x): x for x in shingle_sets(data, offsets, words)}
                    new = sets.keys() - sent
                    sent |= new
                    yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), _lists([sets[x] for x in new], pa.int64())], ["digest", "tokens"])

        return self.texts.mapInArrow(whole, "digest binary, tokens array<bigint>")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose whole sets are similar enough."""
        percent = self.percent
        asked = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
        asked = written(self.sets.join(asked, "row", "left_semi").select(F.col("row").alias("node"), F.xxhash64("doc").alias("ident"), F.col("digest").alias("x")))
        named = asked.select("node", "x")
        pairs = pairs.join(named.withColumnsRenamed({"node": "a", "x": "x"}), "a").withColumnRenamed("x", "xa").join(
            named.withColumnsRenamed({"node": "b", "x": "xb"}), "b")
        sets = self._whole(asked)
        common = F.size(F.array_intersect("left", "right"))
        return cut_lineage(
            pairs.join(sets.alias("l"), F.col("xa") == F.col("l.digest")).select("a", "b", "xb", F.col("l.tokens").alias("left"))
            .join(sets.alias("r"), F.col("xb") == F.col("r.digest")).select("a", "b", "left", F.col("r.tokens").alias("right"))
            .select("a", "b", common.alias("common"), F.size("left").alias("n_a"), F.size("right").alias("n_b"))
            .filter(f"100 * common >= {percent} * (n_a + n_b - common)").select("a", "b")
        )

    def links(self) -> DataFrame:
        """Pairs (a, b) of nodes that link all similar sets, through others or directly."""
        percent = self.percent
        index = self.index()
        least = lambda n: F.expr(f"cast(({percent} * {n} + 99) div 100 as int)")
        enough = F.col("shared") >= F.least(F.lit(SHARED), least("n_a"), least("n_b"))
        near = written(
            index.filter(F.col("before_n") * 100 >= F.col("n") * percent)
            .groupBy(F.col("before").alias("a"), F.col("node").alias("b"), F.col("before_n").alias("n_a"), F.col("n").alias("n_b"))
            .agg(F.count("*").alias("shared")).filter(enough).select("a", "b")
        )
        found = self.verified(near)
        classes = components(found)
        rows = (
            index.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
            .select("token", "node", "n", "place", "class", "size")
        )
        mixed = rows.groupBy("token").agg(F.min("class").alias("one"), F.max("class").alias("other"), F.min("node").alias("least")).filter("one != other")
        rows = written(rows.join(mixed.select("token", "least"), "token"))
        short = rows.filter(F.col("size") <= LIST)
        left, right = (short.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "place", "class")]) for side in "ab")
        left_over = F.least(F.expr("n_a - place_a"), F.expr("n_b - place_b"))  # from this token on
        needed = F.expr(f"{percent} * (n_a + n_b)")
        rest = (
            left.join(right, "token")
            .filter("class_a != class_b and (n_a < n_b or (n_a = n_b and node_a < node_b))")
            .filter(F.col("n_a") * 100 >= F.col("n_b") * percent)
            # the first SHARED common tokens of a similar pair all leave enough behind them
            .filter((left_over + (SHARED - 1)) * (100 + percent) >= needed)
            .groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b")
            .agg(F.count("*").alias("shared"), F.min("place_a").alias("place_a"), F.min("place_b").alias("place_b"))
            .filter(enough).filter(left_over * (100 + percent) >= needed).select("a", "b")
        )
        found = found.unionByName(self.verified(written(rest.join(near, ["a", "b"], "left_anti"))))
        return found.unionByName(self._blocks(rows.filter(F.col("size") > LIST)))

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Links (a, b) of sets that meet in long lists: ``rows`` (token, node, n, class, least), ``least`` a list's first node.

        Similar sets that share a token of a long list are in one group, so all sets of a group are compared, but for those of
        one class and of sizes too far apart. In a short list's count such a pair may fall short; here it cannot.
        """
        percent = self.percent
        groups = components(rows.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
        kinds = rows.select("node", "class").distinct()
        # sets of one size or the next are similar at most; the factor keeps rounding from making it two
        step = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-6))).cast("int") if percent < 100 else F.col("n")
        members = written(
            groups.join(kinds, "node").join(self.sets.select(F.col("row").alias("node"), "n", "doc", "digest"), "node")
            .select("node", "class", "n", F.col("component").alias("group"), step.alias("step"), F.xxhash64("doc").alias("ident"), F.col("digest").alias("x"))
        )
        counts = members.groupBy(F.col("group").alias("g"), F.col("step").alias("s")).agg(
            F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("*") / BLOCK_SETS)).alias("blocks"))
        placed = members.join(counts, (F.col("group") == F.col("g")) & (F.col("step") == F.col("s"))).withColumn(
            "block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        sets = self._whole(members)
        blocks = written(
            placed.join(sets, F.col("x") == F.col("digest"))
            .groupBy("group", "step", "block").agg(
                F.collect_list(F.struct("node", "class", "tokens")).alias("sets"), F.min("class").alias("one"), F.max("class").alias("other"))
            .withColumn("name", F.monotonically_increasing_id())
        )
        names = blocks.drop("sets", "block")
        mine, theirs = (names.select("group", *[F.col(c).alias(f"{c}_{side}") for c in ("name", "step", "one", "other")]) for side in "ab")
        pairs = (
            mine.join(theirs, "group").filter("name_a <= name_b and abs(step_a - step_b) <= 1")
            .filter("one_a != other_a or one_b != other_b or one_a != one_b").select("name_a", "name_b")
        )
        tiles = pairs.join(blocks.select(F.col("name").alias("name_a"), F.col("sets").alias("left")), "name_a").join(
            blocks.select(F.col("name").alias("name_b"), F.col("sets").alias("right")), "name_b").select("left", "right")

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                    yield _spanning(left.values, right.values, percent)

        return cut_lineage(tiles.mapInArrow(compared, "a bigint, b bigint").filter("a != b").distinct())

    def classes(self) -> DataFrame:
        """key, n_shingles and component_id of every document row."""
        linked = components(self.links())
        named = self.first.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(least, "component").select(F.col("digest").alias("x"), "component_id")
        return self.sets.join(named, (F.col("digest") == F.col("x")) & (F.col("n") > 0), "left").select(
            F.col("doc").alias(self.key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def classes(documents: DataFrame, words: int = 4, percent: int = 85, key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every document row.

    Texts are lower-cased (A to Z) and split at ASCII white space. Two rows link when
    100 * |intersection| >= percent * |union| of their distinct shingles. A text of fewer words is one
    shingle; a null or wordless text has none and links with nothing. Repeated rows each get a row, in
    one class. A null key never names a class; if all keys of a class are null, so is its name.
    """
    return Join(documents, key, words, percent).classes()


def keep_first(documents: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """The documents without those in whose class a smaller key stays; rows that repeat a staying key stay."""
    worse = classes(documents, words, percent, key).filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct()
    return documents.join(worse, documents[key] == worse["gone"], "left_anti")
