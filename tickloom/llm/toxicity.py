"""Toxic text by compression distance: a zstandard dictionary trained on each class, windows of words, calibrated thresholds.

Both dictionaries are trained by zstandard on windows of real text of their class. A window's distance is the number of
bytes that the toxic dictionary, laid before the ordinary one, takes off its compressed length with the ordinary one
alone: what a window shares with ordinary text costs the same in both, so it adds no noise. The toxic dictionary is
trained again on those toxic windows that it shortens beyond nearly all ordinary ones, since most of a toxic document
is ordinary text. A logistic curve over a document's window distances is calibrated on documents that trained neither
dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, texts_of

#: Bytes that stay: ASCII letters in lower case and all bytes of other letters; the rest separate words.
_LETTERS = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of a window, and the bytes of its longest word: unspaced text is cut there, so all of it is in windows.
WORDS, LONGEST = 8, 64
#: zstandard does not search the last bytes of its input.
_TAIL = b" 00000000"
#: Sizes of the dictionaries, and how zstandard picks their segments (bytes, bytes of a match).
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, MATCH = 1 << 17, 1 << 14, 16, 6
PARAMETERS = zstandard.ZstdCompressionParameters(
    window_log=18, chain_log=19, hash_log=18, search_log=2, min_match=4, target_length=16, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False
)
#: What ends the header of a trained dictionary: its first three match offsets.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def windows(text: bytes) -> list[bytes]:
    """The text's letters, lower-cased, in windows of WORDS words, one after the other."""
    words = text.translate(_LETTERS).split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, len(words), WORDS)]


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained by zstandard on the samples, of `size` bytes or, where they are too few for that, the
    largest halving that they allow; empty below 512 bytes."""
    while size >= 512:
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b""


def _split(dictionary: bytes) -> tuple[bytes, bytes]:
    """(entropy tables, content) of a trained dictionary."""
    at = dictionary.index(_OFFSETS) + len(_OFFSETS)
    return dictionary[:at], dictionary[at:]


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    def distances(self):
        """A function from windows to their distances in bytes."""
        head, content = _split(self.ordinary)
        sizes = []
        for data in (self.ordinary, head + _split(self.toxic)[1] + content):
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT)
            held.precompute_compress(compression_params=PARAMETERS)
            sizes.append(zstandard.ZstdCompressor(dict_data=held, compression_params=PARAMETERS).compress)
        alone, both = sizes

        def measure(found: list[bytes]) -> np.ndarray:
            return np.fromiter((len(alone(x)) - len(both(x)) for x in (w + _TAIL for w in found)), np.int64, len(found))

        return measure


def fit_dictionaries(toxic: list[bytes], ordinary: list[bytes], rounds: int = 3, tail: float = 0.995) -> Dictionaries | None:
    """Train both dictionaries on windows of their class; None where the windows are too few to train on.

    Each round keeps the toxic windows whose distance is beyond that of the share `tail` of the ordinary windows, and
    trains the toxic dictionary on them alone.
    """
    base, first = train(ordinary, ORDINARY_BYTES), train(toxic, TOXIC_BYTES)
    if not base or not first:
        return None
    found = Dictionaries(base, first)
    for _ in range(rounds):
        measure = found.distances()
        far = measure(toxic) > max(1.0, float(np.quantile(measure(ordinary), tail)))
        again = train([w for w, x in zip(toxic, far) if x], TOXIC_BYTES)
        if not again:
            break
        found = Dictionaries(base, again)
    return found


def features(distances: np.ndarray) -> np.ndarray:
    """What the document curve looks at: total, mean and largest distance, and how many windows are shortened."""
    if not len(distances):
        return np.array([1.0, 0, 0, 0, 0, 0])
    up = np.maximum(distances, 0)
    return np.array([1.0, np.log1p(up.sum()), np.log1p(20 * up.mean()), np.log1p(up.max()), np.log1p((up >= 2).sum()), np.log1p(100 * (up >= 2).mean())])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries
    weights: tuple[float, ...]

    def scorer(self):
        """A function from a text to (score, windows that are two bytes shorter, windows)."""
        measure, weights = self.dictionaries.distances(), np.array(self.weights)

        def score(text: bytes) -> tuple[float, int, int]:
            found = measure(windows(text))
            return float(1 / (1 + np.exp(-np.clip(features(found) @ weights, -30, 30)))), int((found >= 2).sum()), len(found)

        return score


def _held_out(folds: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def _least(rows: DataFrame, hashed: Column, limit: int, totals: dict[int, int]) -> DataFrame:
    """The `limit` rows of each class (toxic) whose hashes are least, ties by all columns.

    Rows whose hash lies far above what `limit` of a class's rows take go first, so the task that ranks a class reads
    some 2 * limit rows however large the class; that fewer than `limit` stay has no measurable chance."""
    end = F.lit(2.0**63)
    for kind, n in totals.items():
        share = (2 * limit + 100) / n
        if share < 1:
            end = F.when(F.col("toxic") == kind, F.lit(2.0**64 * share - 2.0**63)).otherwise(end)
    held = rows.withColumn("_h", hashed).filter(F.col("_h") <= end)
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy("_h", *(c for c in rows.columns if c != "toxic")))
    return held.withColumn("_nth", nth).filter(F.col("_nth") <= limit).select(rows.columns)


def _class_counts(rows: DataFrame) -> dict[int, int]:
    return {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}


def _learn_from(labels: DataFrame, folds: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, toxic, part) of at most per_class labelled documents of each class outside the held-out fold, by a hash of
    the id, and each class's number of labelled documents. Part 0 of 3 calibrates, the others train."""
    each = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~_held_out(folds)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    total = _class_counts(each)
    ids = _least(each, F.xxhash64("id"), per_class, total)
    return ids.select("id", "toxic", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)).alias("part")), total


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = 4000, per_class_windows: int = 60_000) -> Model | None:
    """The model of a bounded sample of the labelled documents (per_class of each class, whole texts); None where a
    class is missing or has too little text.

    Windows and features are made in tasks: the driver gets at most per_class_windows different windows of each class
    and one row of features for each calibrating document, no texts. Classes weigh as they are among all labels.
    """
    prepare(docs.sparkSession)
    ids, total = _learn_from(labels, folds, per_class)
    read = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text is not null").join(F.broadcast(ids), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, text in zip(batch.column("toxic").to_pylist(), texts_of(batch)):
                found = list(set(windows(text)))
                yield pa.record_batch([pa.array([kind] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["toxic", "window"])

    held = read.filter("part != 0").select("toxic", "text").mapInArrow(cut, "toxic int, window binary").distinct()
    each = materialize(held, "windows")
    held = _least(each, F.xxhash64("window"), per_class_windows, _class_counts(each)).toPandas().sort_values(["toxic", "window"])
    discard(each)
    found = fit_dictionaries(*([bytes(w) for w in held.window[held.toxic == k]] for k in (1, 0)))
    if found is None:
        return None

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = found.distances()
        for batch in batches:
            rows = [features(measure(windows(t))).tolist() for t in texts_of(batch)]
            yield pa.record_batch([batch.column("id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "toxic", "x"])

    seen = read.filter("part = 0").select("id", "toxic", "text").mapInArrow(look, "id long, toxic int, x array<double>")
    seen = seen.groupBy("id", "toxic").agg(F.max("x").alias("x")).toPandas().sort_values("id")  # ids may repeat in docs
    kinds = seen.toxic.to_numpy()
    if len(set(kinds.tolist())) < 2:
        return None
    weight = np.array([total[k] / (kinds == k).sum() for k in kinds.tolist()])
    return Model(found, tuple(logistic(np.array(seen.x.tolist()), kinds.astype(float), weight * len(kinds) / weight.sum()).tolist()))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, hits, windows) of every whole text; hits are windows that the toxic dictionary makes two bytes
    shorter. Without a model scores are 0; null and empty texts have no windows, and the score that a document without
    a hit has. Rows keep their number."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.scorer() if model else lambda text: (0.0, 0, 0)
        for batch in batches:
            cols = list(zip(*map(judge, texts_of(batch)))) or [[], [], []]
            yield pa.record_batch([batch.column("id").cast(pa.int64()), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["id", "score", "hits", "windows"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, hits long, windows long")
    return out.withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, **sample) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits, windows): fits on the labelled rows outside the held-out fold and
    scores every document.

    Repeated, conflicting and null labels: the largest of 0 and 1 counts. Null ids are never held out nor learned from;
    repeated rows are scored each. Very long texts are scored whole, unspaced ones in windows of LONGEST bytes a word;
    a document whose id repeats calibrates once. Empty tables give no rows; extra columns of either table are not read.
    """
    model = fit(docs, labels, folds, **sample)
    return score(docs, model).select("doc_id", _held_out(folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "windows")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, all their columns; the model sees each text in place.

    Null, empty and repeated texts are kept or go as classify() scores them; without a model all stay. Extra columns
    of docs stay whatever their names; those of labels are not read; empty tables give no rows.
    """
    prepare(docs.sparkSession)
    model = fit(docs, labels)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([judge(t)[0] < 0.5 for t in texts_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
