"""Language by rank-order profiles: a document's most frequent n-grams against each language's, out of place."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

UNKNOWN = "und"
#: Languages whose shares are sent to all tasks; with more of them the texts are joined by a shuffle.
BROADCAST_LANGS = 1 << 16
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _letters(text: str | None) -> str:
    """The text's words in lower case, one blank around each; empty without a letter."""
    found = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {found} " if any(map(str.isalpha, found)) else ""


def gram_counts(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of code points as 63-bit codes in order, and how often each is there."""
    c = np.frombuffer(letters.encode("utf-32-le"), "<u4").astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    codes = np.concatenate([c[c != 32], two, two[:-1] << 21 | c[2:]])
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def top_grams(letters: str, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    codes, counts = gram_counts(letters)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, size: int = 400, per_lang: int = 3000) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams, from a hashed sample of about per_lang documents of it (a bound in
    expectation), whole texts. All languages count; those of a corpus are few, as are their profiles."""
    prepare(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    share = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = share.select("lang", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n")).alias("p"))
    if share.count() <= BROADCAST_LANGS:
        share = F.broadcast(share)
    sample = known.join(share, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("p") * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if letters := _letters(text):
                    by.setdefault(lang, []).append(gram_counts(letters))
            for lang, found in by.items():
                codes, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x for _, x in found])).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    grams = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = grams.withColumn("rank", rank).filter(F.col("rank") <= size).toPandas().sort_values(["lang", "rank"])
    return {lang: g.gram.to_numpy(np.int64) for lang, g in rows.groupby("lang")}


class Profiles:
    """Ranks of all profiles side by side, for one look-up of a document's n-grams."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to each language, 0 (same order) to 1 (no n-gram in common)."""
        at = np.searchsorted(self.codes, grams)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != grams] = len(self.codes)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams))[:, None]))
        return np.minimum(away, self.size).mean(axis=0) / self.size

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score among the languages, distance. Equal distances: the first language by name."""
        letters = _letters(text)
        if not letters or not self.langs:
            return UNKNOWN, 0.0, 1.0
        d = self.distances(top_grams(letters, self.size))
        best = int(d.argmin())
        return self.langs[best], float(1 / np.exp(-20 * (d - d[best])).sum()), float(d[best])


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, distance) of every whole text; `und` with score 0 for null and letterless texts, and
    where nothing was learned."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Profiles(profiles, size)
        for batch in batches:
            cols = list(zip(*map(held.predict, batch.column("text").to_pylist()))) or [[], [], []]
            yield pa.record_batch([batch.column("id").cast(pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], names=["id", "lang_pred", "score", "distance"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, distance double")
    return out.withColumnRenamed("id", id_col)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, size: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, distance): learns from the rows outside the held-out fold that have a
    language, predicts every row from its text alone. Null ids are never held out nor learned from; repeated rows are
    predicted each; empty tables give no rows; extra columns are not read."""
    profiles = learn_profiles(docs.filter(~_held_out() & F.col("doc_id").isNotNull()), size)
    return predict(docs, profiles, size).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "distance")


def keep_known(docs: DataFrame, size: int = 400, farthest: float = 0.97) -> DataFrame:
    """The rows of docs whose text has a language: not `und`, and within `farthest` of its profile (text that shares
    almost no n-gram with any language goes). All columns stay, whatever their names; each text is judged in place and
    whole, null and empty ones go, repeated rows are judged each. Null ids are not learned from. Empty tables give no
    rows."""
    prepare(docs.sparkSession)
    profiles = learn_profiles(docs.filter(~_held_out() & F.col("doc_id").isNotNull()), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Profiles(profiles, size)
        for batch in batches:
            found = [held.predict(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and far <= farthest for lang, _, far in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
