"""Near-duplicate vectors by product quantisation.

Unit vectors stand in inverted lists of coarse centroids; in a list each is a code of its residual's parts.
A vector looks into every list whose centroid is almost as near as its own, adds up table
entries for the codes there, and the exact cosine decides about all that its code's error could bring to the threshold.
Equal vectors are one; lists are dealt out in blocks, and a pair of blocks gives counts and a spanning
set of links, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm.graph import components
from communitylens.llm.store import written
from communitylens.session import cut_lineage

THRESHOLD = 0.93
#: The index is fitted on at most so many distinct vectors, chosen by a hash; all vectors are indexed.
SAMPLE = 20_000
PARTS = 8
CODES = 256
#: Lists whose centroid is at most this angle (radians) farther than the nearest one are probed, however many.
REACH = 0.15
#: Taken off the proven bounds of approximate cosines for rounding.
ROUNDING = 1e-6
#: Vectors in a block, on average at most.
BLOCK = 512


class Index(NamedTuple):
    centroids: np.ndarray
    books: list[np.ndarray]  #: per part of the dimensions, the code book of residuals
    cuts: np.ndarray

    def home(self, vectors: np.ndarray) -> np.ndarray:
        return np.argmax(vectors @ self.centroids.T, axis=1)

    def codes(self, vectors: np.ndarray, home: np.ndarray) -> np.ndarray:
        rest = vectors - self.centroids[home]
        return np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1).astype(np.uint8)

    def probes(self, vectors: np.ndarray) -> list[np.ndarray]:
        angles = np.arccos(np.clip(vectors @ self.centroids.T, -1, 1))
        return [np.flatnonzero(row <= row.min() + REACH).astype(np.int32) for row in angles]

    def approximate(self, queries: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Cosines of queries with coded vectors of one list, from one table per part."""
        out = np.repeat((queries @ self.centroids[place])[:, None], len(codes), axis=1)
        for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            out += (queries[:, a:b] @ self.books[k].T)[:, codes[:, k]]
        return out

    def floors(self, vectors: np.ndarray, home: np.ndarray, codes: np.ndarray, threshold: float) -> np.ndarray:
        """Per coded vector, the least approximate cosine of any unit query whose true cosine reaches the threshold.

        Such a query is at most arccos(threshold) away from the vector, so at most that much farther from what its code stands for.
        """
        coded = self.centroids[home] + np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)
        length = np.linalg.norm(coded, axis=1)
        angles = np.arccos(np.clip(np.einsum("ij,ij->i", vectors, coded) / np.maximum(length, 1e-12), -1, 1)) + math.acos(min(max(threshold, -1.0), 1.0))
        return length * np.cos(np.minimum(angles, np.pi)) - ROUNDING


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book ** 2).sum(axis=1) - 2 * points @ book.T, axis=1)


def _means(points: np.ndarray, count: int, rounds: int, random: np.random.Generator, unit: bool) -> np.ndarray:
    """Centres of k-means; of unit length for directions."""
    centres = points[random.choice(len(points), min(count, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centres.T, axis=1) if unit else _nearest(points, centres)
        order = np.argsort(near, kind="stable")
        filled, heads = np.unique(near[order], return_index=True)
        centres[filled] = np.add.reduceat(points[order], heads, axis=0) / np.diff(np.append(heads, len(points)))[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(sample: np.ndarray, lists: int, seed: int = 3) -> Index:
    random = np.random.default_rng(seed)
    centroids = _means(sample, lists, 8, random, unit=True)
    rest = sample - centroids[np.argmax(sample @ centroids.T, axis=1)]
    cuts = np.unique(np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int))
    books = [_means(rest[:, a:b], CODES, 6, random, unit=False) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return Index(centroids, books, cuts)


def _prepared(vectors: DataFrame, key: str, label: str) -> DataFrame:
    """row, key, label, size and unit (packed doubles; null for vectors that link with nothing)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, sizes = [], []
            for values, group in zip(batch.column("embedding"), batch.column("label"), strict=True):
                unit = None
                if values.is_valid and group.is_valid and len(values.values) and not values.values.null_count:
                    x = values.values.to_numpy(zero_copy_only=False).astype(float)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        unit = (x / np.linalg.norm(x)).tobytes()
                packed.append(unit)
                sizes.append(len(values.values) if unit else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("key"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())],
                ["row", "key", "label", "size", "unit"])

    chosen = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(label).alias("label"), "embedding")
    return chosen.mapInArrow(
        run, f"row bigint, key {vectors.schema[key].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}, size int, unit binary")


def _units(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), size)


def _links(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, root, links) per node and pair of blocks: how many it links to there, and what it is connected with."""
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("unit").toArrow()
    lists = max(1, min(math.isqrt(nodes.count()), SAMPLE // 16))
    sample = _units(chosen.column("unit").combine_chunks(), size)
    index = fit(sample, lists)
    books = nodes.sparkSession.sparkContext.broadcast(tuple(index))  # a few MB at most
    label = nodes.schema["label"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*books.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                unit = _units(part.column("unit"), size)
                home = index.home(unit)
                codes = index.codes(unit, home)
                yield pa.RecordBatch.from_arrays([
                    part.column("node"), part.column("label"), part.column("copies"), part.column("unit"), pa.array(home.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(index.floors(unit, home, codes, threshold)),
                    pa.array([p.tolist() for p in index.probes(unit)], pa.list_(pa.int32())),
                ], ["node", "label", "copies", "unit", "home", "code", "floor", "probes"])

    coded = written(nodes.select("node", "label", "copies", "unit").mapInArrow(
        placed, f"node bigint, label {label}, copies bigint, unit binary, home int, code binary, floor double, probes array<int>"))

    def blocks(rows: DataFrame, entry) -> DataFrame:
        counts = rows.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumnsRenamed({"label": "l", "list": "p"})
        return (
            rows.join(counts, (F.col("label") == F.col("l")) & (F.col("list") == F.col("p")))
            .groupBy("label", "list", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")).agg(F.collect_list(entry).alias("entries"))
        )

    stored = blocks(coded.withColumn("list", F.col("home")), F.struct("node", "copies", "unit", "code", "floor", "probes"))
    asking = blocks(coded.withColumn("list", F.explode("probes")), F.struct("node", "copies", "unit", "home"))
    tiles = stored.select("label", "list", F.col("entries").alias("stored")).join(
        asking.select("label", "list", F.col("entries").alias("asking")), ["label", "list"]).select("list", "stored", "asking")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*books.value)
        for batch in batches:
            for place, stored, asking in zip(batch.column("list").to_pylist(), batch.column("stored"), batch.column("asking"), strict=True):
                yield _tile(index, place, stored.values, asking.values, size, threshold)

    return tiles.mapInArrow(compared, "node bigint, root bigint, links bigint")


def _tile(index: Index, place: int, stored: pa.StructArray, asking: pa.StructArray, size: int, threshold: float) -> pa.RecordBatch:
    field = lambda rows, name: rows.field(name)
    node_v, node_q = field(stored, "node").to_numpy(), field(asking, "node").to_numpy()
    copies_v, copies_q = field(stored, "copies").to_numpy(), field(asking, "copies").to_numpy()
    unit_v, unit_q = _units(field(stored, "unit"), size), _units(field(asking, "unit"), size)
    codes = np.frombuffer(b"".join(field(stored, "code").to_pylist()), np.uint8).reshape(len(node_v), -1)
    q, v = np.nonzero(index.approximate(unit_q, place, codes) >= field(stored, "floor").to_numpy())
    other = node_q[q] != node_v[v]
    q, v = q[other], v[other]
    good = np.concatenate([np.einsum("ij,ij->i", unit_q[q[k:k + 50_000]], unit_v[v[k:k + 50_000]]) >= threshold for k in range(0, len(q), 50_000)]) if len(q) else np.zeros(0, bool)
    q, v = q[good], v[good]
    # a pair that the other vector also asks for counts where the smaller one asks
    home_q = field(asking, "home").to_numpy()
    asked = np.zeros((len(node_v), len(index.centroids)), bool)
    for k, probes in enumerate(field(stored, "probes").to_pylist()):
        asked[k, probes] = True
    counted = ~asked[v, home_q[q]] | (node_q[q] < node_v[v])
    nodes, at = np.unique(np.concatenate([node_q[q], node_v[v]]), return_inverse=True)
    a, b = at[:len(q)], at[len(q):]
    links = np.bincount(a, copies_v[v] * counted, len(nodes)) + np.bincount(b, copies_q[q] * counted, len(nodes))
    roots = np.arange(len(nodes))
    while True:
        least = roots.copy()
        np.minimum.at(least, a, roots[b])
        np.minimum.at(least, b, roots[a])
        least = least[least]
        if (least == roots).all():
            break
        roots = least
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots]), pa.array(links.astype(np.int64))], ["node", "root", "links"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", label: str = "label") -> DataFrame:
    """key, n_links, component_id and kept of every vector row.

    Rows with equal, non-null labels (and equally many components) link when the cosine of their
    ``embedding`` columns, in doubles, is at least ``threshold``. A vector that is null, empty or zero, or holds a null or
    non-finite component, links with nothing. Repeated rows link with each other. A null
    key names no component. Other columns are not used. In the lists that are probed every link is found; links to other
    lists are not (measured: see the README). No link is wrong.
    """
    rows = written(_prepared(vectors, key, label).withColumn("mark", F.sha2("unit", 256)))
    nodes = written(
        rows.filter("unit is not null").groupBy("label", "size", "mark")
        .agg(F.min("row").alias("node"), F.min("key").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    )
    sizes = sorted(r[0] for r in nodes.select("size").distinct().collect())  # one, in a sound table
    found = None
    for size in sizes:
        part = _links(nodes.filter(F.col("size") == size), size, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node bigint, root bigint, links bigint")
    found = cut_lineage(found)
    linked = components(found, "node", "root").withColumnRenamed("node", "n")
    counts = found.groupBy(F.col("node").alias("m")).agg(F.sum("links").alias("links"))
    named = (
        nodes.select("label", "size", "mark", "node", "least", "copies")
        .join(linked, F.col("node") == F.col("n"), "left").join(counts, F.col("node") == F.col("m"), "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    named = named.join(least, F.col("component") == F.col("c")).select(
        "label", "size", "mark", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(named, ["label", "size", "mark"], "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
