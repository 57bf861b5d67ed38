"""A quality classifier on random Fourier features.

Statistics of the whole text, standardised, are sent through random cosines, whose inner products
approximate a Gaussian kernel. Every partition sums its part of the normal equations; the sums give
ridge scores, and isotonic calibration on other labelled rows turns these into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm import arrays
from communitylens.session import cut_lineage

FEATURES = 160
#: Width of the kernel in standard deviations of all statistics together.
WIDTH = 5.0
RIDGE = 1e-3
#: Equal bins of the raw score between -0.5 and 1.5 that calibration sums labels in.
BINS = 2000
THRESHOLD = 0.7

_CLASS = np.full(256, 5, np.int64)  # other signs
_CLASS[0x61:0x7B] = 0
_CLASS[0x80:] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 6
_CLASS[ord("!")] = 7
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False
N_STATISTICS = 18


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct hashes, and how often its most frequent one occurs."""
    keys = np.sort(rows.astype(np.int64) << 40 | (hashes >> np.uint64(24)).astype(np.int64))
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    owners = keys[heads] >> 40
    most = np.zeros(n)
    np.maximum.at(most, owners, np.diff(np.append(heads, len(keys))))
    return np.bincount(owners, minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One line of statistics per text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(n), size)
    signs = np.bincount(row_of * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8).astype(float)
    starts, ends, first = arrays.words(data, offsets, arrays.NONSPACE)
    count = np.diff(first).astype(float)
    hashes = arrays.span_hashes(data, starts, ends)
    rows = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    mean = _share(np.bincount(rows, length, n), count)
    spread = np.sqrt(np.maximum(_share(np.bincount(rows, length ** 2, n), count) - mean ** 2, 0))
    distinct, most = _repeats(hashes, rows, n)
    three, at = arrays.starts_within(first, 3)
    grams = arrays.gram_hashes(hashes, 3)
    triples, _ = _repeats(grams[at] if len(at) else grams[:0], three, n)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd_end = np.bincount(rows, np.isin(_CLASS[last], (5, 7)), n)
    lone = np.bincount(rows, (ends - starts == 1) & (_CLASS[last] == 5), n)
    line_starts, line_ends, line_first = arrays.words(data, offsets, _NOT_NEWLINE)
    lines = np.diff(line_first).astype(float)
    line_rows = np.repeat(np.arange(n), np.diff(line_first))
    distinct_lines, _ = _repeats(arrays.span_hashes(data, line_starts, line_ends), line_rows, n)
    letters = signs[:, 0] + signs[:, 1]
    columns = [
        np.log1p(size), np.log1p(count), np.minimum(mean, 40), np.minimum(spread, 40),
        *[_share(signs[:, k], size) for k in range(8)],
        _share(signs[:, 1], letters), _share(distinct, count), _share(most, count),
        _share(triples, np.maximum(count - 2, 0)), _share(odd_end + lone, count), _share(distinct_lines, lines),
    ]
    return np.stack(columns, axis=1).astype(float) if n else np.zeros((0, N_STATISTICS))


def with_statistics(df: DataFrame, key: str) -> DataFrame:
    """(key, stats array<double>) of every row; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in arrays.chunks(batch.column("text")):
                values = statistics(data, offsets)
                bounds = np.arange(last - first + 1, dtype=np.int32) * N_STATISTICS
                stats = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, last - first), stats], [key, "stats"])

    return df.select(key, df["text"].cast("string").alias("text")).mapInArrow(
        run, f"{key} {df.schema[key].dataType.simpleString()}, stats array<double>"
    )


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  #: raw scores and the probabilities they stand for, ascending
    probability: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        waves = np.cos((stats - self.centre) / self.scale @ self.directions + self.phases)
        return np.hstack([np.ones((len(stats), 1)), waves * np.sqrt(2 / len(self.phases))])

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_scores(stats), self.raw, self.probability), 0.0, 1.0)


def isotonic(places: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best non-decreasing means of ordered bins: mean place and value of each block."""
    blocks: list[list[float]] = []
    for place, total, count in zip(places, sums, counts, strict=True):
        blocks.append([place * count, total, count])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, N_STATISTICS))


def _normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Sums of (features, label) products: per partition in numpy, then line by line over partitions."""
    size = len(model.phases) + 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for frame in frames:
            z = model.features(_matrix(frame["stats"]))
            total += z.T @ np.hstack([z, frame[["label"]].to_numpy(float)])
        yield pd.DataFrame({"line": np.arange(size), "sums": list(total)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": frame["line"][:1], "sums": [np.sum(np.stack(frame["sums"].to_numpy()), axis=0)]})

    schema = "line int, sums array<double>"
    table = rows.mapInPandas(partial, schema).groupBy("line").applyInPandas(add, schema).toPandas()
    return np.stack(table.sort_values("line")["sums"].to_numpy()) if len(table) else np.zeros((size, size + 1))


def _score(rows: DataFrame, model: Model, raw: bool) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stats = _matrix(frame["stats"])
            yield frame.drop(columns="stats").assign(score=model.raw_scores(stats) if raw else model.scores(stats))

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "stats"]
    return rows.mapInPandas(run, ", ".join([*kept, "score double"]))


def fit(labelled: DataFrame, features: int = FEATURES, seed: int = 7) -> Model | None:
    """A model of (stats, label, fold) rows: fold 0 fits the scores, others calibrate them.

    None without labelled rows. Only sums and matrices of fixed size reach the driver.
    """
    sums = labelled.select("label", F.posexplode("stats").alias("k", "x")).groupBy("k").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.avg("label").alias("y")).orderBy("k").toPandas()
    if not len(sums):
        return None
    random = np.random.default_rng(seed)
    scale = np.where(sums["s"].to_numpy() > 1e-9, sums["s"].to_numpy(), 1.0)
    model = Model(
        sums["m"].to_numpy(), scale, random.normal(size=(N_STATISTICS, features)) / WIDTH,
        random.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1),
    )
    total = _normal_equations(labelled.filter("fold = 0"), model)
    n = max(total[0, 0], 1.0)
    weights = np.linalg.solve(total[:, :-1] + RIDGE * n * np.eye(len(total)) / features, total[:, -1])
    model = model._replace(weights=weights)
    place = F.least(F.greatest(F.floor((F.col("score") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1))
    bins = (
        _score(labelled.filter("fold != 0"), model, raw=True)
        .groupBy(place.alias("bin")).agg(F.sum("label").alias("y"), F.count("*").alias("n")).toPandas().sort_values("bin")
    )
    if not len(bins):  # nothing to calibrate with
        return model._replace(raw=np.array([0.0, 1.0]), probability=np.array([0.0, 1.0]))
    raw, probability = isotonic((bins["bin"].to_numpy() + 0.5) * 2 / BINS - 0.5, bins["y"].to_numpy(float), bins["n"].to_numpy(float))
    return model._replace(raw=raw, probability=probability)


def score(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, held_out, score and predicted of every document row.

    Labels are used only from documents whose crc32(key as text) mod 4 is not 2; a key labelled
    several times counts once with its mean label; null labels, and labels of unknown or null keys,
    are not used. Empty and null texts are scored by their (zero) statistics. Without any
    usable label every score is 1. Other columns are not used.
    """
    remainder = F.crc32(F.col(key).cast("string")) % 4
    stats = cut_lineage(with_statistics(documents, key))
    marks = labels.filter("quality is not null").groupBy(F.col(key).alias("label_key")).agg(F.avg("quality").alias("label"))
    labelled = cut_lineage(
        stats.filter(remainder != 2).join(marks, F.col(key) == F.col("label_key"))
        .select("stats", "label", F.when(remainder == 3, 1).otherwise(0).alias("fold"))
    )
    model = fit(labelled)
    scored = stats.withColumn("score", F.lit(1.0)).drop("stats") if model is None else _score(stats, model, raw=False)
    return scored.select(
        key, F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without those that are predicted 0; rows with a null key stay."""
    bad = score(documents, labels, key).filter("predicted = 0").select(F.col(key).alias("bad_id")).distinct()
    return documents.join(bad, documents[key] == bad["bad_id"], "left_anti")
