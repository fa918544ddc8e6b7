"""Likelihood of documents under a subword lattice, learned from the corpus.

A text is a run of pieces and an end. Its words are segmented into the pieces of an existing vocabulary or into single
characters' bytes; the vocabulary's scores weight all segmentations, and the pieces are counted anew by the
forward-backward recursion over all training words. A word's probability is the sum over all its segmentations, by the
forward recursion in log space; as no piece goes beyond a word, a document's is the product of its words' and the end's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare
from .lattice import BLANK, Pieces, by_length, expected_counts, forward, log_weights

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: A word of which more than one in so many tokens is one is sent to all tasks; there are fewer than this many.
FREQUENT = 1 << 15
#: Shares of the lattice that single characters and, before counting, the end have, and the prior's count.
CHARACTER_SHARE, END_SHARE, PRIOR_COUNT = 1e-3, 1e-3, 1000.0
LN10 = float(np.log(10))


def batch_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, the tokens): runs without ASCII white space, A-Z in lower case, in order."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # where a row ends, a word does
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | edge[1:])) + 1 if len(inside) else starts
    rows = np.searchsorted(offsets, starts, side="right") - 1
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[inside])])
    return rows, words.cast(pa.large_string(), safe=False)


def _train(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 != 2, F.lit(True))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): every word of every document, and how often the training documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = batch_words(batch.column("text"))
            known = words.dictionary_encode()
            train = batch.column("train").to_numpy(zero_copy_only=False)[rows]
            n = np.bincount(known.indices.to_numpy()[train], minlength=len(known.dictionary))
            yield pa.record_batch([known.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], names=["word", "c"])

    return docs.select("text", _train().alias("train")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Subwords:
    """Pieces of an existing vocabulary, by name, with the log probabilities of the lattice's arcs. Those of all
    pieces, the end and the single characters sum to one."""

    names: list[str]
    logp: np.ndarray
    end: float
    character: float

    _pieces = None

    @property
    def pieces(self) -> Pieces:
        if self._pieces is None:
            self._pieces = Pieces(self.names)
        return self._pieces

    def fallback(self, chars: np.ndarray) -> np.ndarray:
        """A character by itself: its share, by the number of its bytes."""
        size = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        return self.character - size * np.log(256)

    def __getstate__(self):
        return self.__dict__ | {"_pieces": None}

    def marginals(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, summed over all its segmentations."""
        out = np.full(len(words), -np.inf)
        for rows, chars, lengths in by_length([BLANK + w for w in words]):
            out[rows] = forward(self.pieces, self.logp, chars, self.fallback)[lengths, np.arange(len(rows))]
        return out

    def counts(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.names))
        for rows, chars, lengths in by_length([BLANK + w for w in words]):
            out += expected_counts(self.pieces, self.logp, chars, lengths, weights[rows], self.fallback)
        return out


def vocabulary(model_path: str) -> Subwords:
    """The existing pieces that can be in a word, weighted by their scores (lattice.log_weights)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    names, logp = [model.id_to_piece(i) for i in ids], log_weights(np.array([model.get_score(i) for i in ids]))
    kept = [k for k, x in enumerate(names) if BLANK not in x[1:]]
    names, logp = [names[k] for k in kept], logp[kept]
    return Subwords(names, logp - np.logaddexp.reduce(logp) + np.log((1 - CHARACTER_SHARE) * (1 - END_SHARE)), float(np.log((1 - CHARACTER_SHARE) * END_SHARE)), float(np.log(CHARACTER_SHARE)))


def learn(words: DataFrame, start: Subwords, n_ends: int, rounds: int = 2) -> Subwords:
    """Count the pieces anew over all training words, by expectation, with the existing weights as a prior."""
    model = start
    prior, prior_end = np.exp(start.logp), np.exp(start.end)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Subwords = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(model.names))
            for batch in batches:
                total += model.counts(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float))
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["piece", "n"])

        rows = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = PRIOR_COUNT * prior
        n[rows.piece.to_numpy()] += rows.n.to_numpy()
        end = PRIOR_COUNT * prior_end + n_ends
        share = (1 - CHARACTER_SHARE) / (n.sum() + end)
        model = Subwords(start.names, np.log(n * share), float(np.log(end * share)), start.character)
    return model


def _hashed(words: DataFrame) -> tuple[DataFrame, int]:
    """The words with a 64-bit hash h, and its seed: the first under which no two of them share a hash, so a join by h
    is one by the word."""
    for seed in range(42, 64):
        hashed = words.withColumn("h", F.xxhash64(F.lit(seed), "word"))
        if hashed.groupBy("h").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] in (None, 1):
            return hashed, seed
    raise RuntimeError("no seed tells all words apart")


def score_documents(docs: DataFrame, model_path: str | None = None, rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole document.

    score is the sum of the log10 marginals of the document's words and of its end. Words that are frequent (FREQUENT
    at most, by their share of all tokens) are scored where the document is read; the others go by a hash that tells
    all words apart to a join with the table of all words, salted by nothing, as none of them is hot. Null and empty
    texts are one end token. Every row is scored by itself, repeated ids too; null ids count as training. Long unspaced
    texts are long words, which cost in proportion to their characters. An empty table gives no rows; with no training
    rows every c is 0 and the vocabulary's own weights score. Extra columns are not read.
    """
    import public_tokenizers

    spark = docs.sparkSession
    prepare(spark, 4 << 20)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = materialize(count_words(docs), "words")
    ends = docs.filter(_train()).count()
    stats = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n = (stats["n"] or 0) + ends
    v = (stats["v"] or 0) + (ends > 0)
    model = learn(words, vocabulary(model_path or public_tokenizers.path("piece_bpe_32k.model")), ends, rounds)
    base_of = float(n + (v + 1))
    words, seed = _hashed(words)

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("word"), batch.column("h"), batch.column("c"), pa.array(model.marginals(batch.column("word").to_pylist()) / LN10)], names=["word", "h", "c", "score"])

    scored = materialize(words.select("word", "h", "c").mapInArrow(marginals, "word string, h long, c long, score double"), "word-scores")
    top = scored.filter(F.col("c") > max(1, n // FREQUENT)).select("word", "c", "score").toPandas()
    frequent = dict(zip(top.word, zip(top.c.tolist(), top.score.tolist())))
    end_row = (int(ends > 0), float(np.log10((ends + 1) / base_of)), model.end / LN10)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        names = ["row", "word", "tf", "doc_id", "n_tokens", "n_known", "base", "score"]
        for batch in batches:
            rows, tokens = batch_words(batch.column("text"))
            known = tokens.dictionary_encode()
            distinct = known.dictionary.to_pylist()
            pairs = rows.astype(np.int64) << 32 | known.indices.to_numpy().astype(np.int64)
            pairs, tf = np.unique(pairs, return_counts=True)
            row, word = pairs >> 32, pairs & 0xFFFFFFFF
            at = [frequent.get(w) for w in distinct]
            here = np.array([x is not None for x in at], bool)
            c = np.array([x[0] if x else 0 for x in at], float)
            log10 = np.array([x[1] if x else 0.0 for x in at], float)
            mine = here[word] if len(word) else np.zeros(0, bool)
            r, w, k = row[mine], word[mine], tf[mine]
            size = batch.num_rows

            def total(values):
                return np.bincount(r, values, size)

            n_tokens = np.bincount(rows, minlength=size) + 1
            empty = pa.nulls(size, pa.int64())
            yield pa.record_batch(
                [
                    pa.array(number + np.arange(size)), pa.nulls(size, pa.string()), empty, batch.column("doc_id"), pa.array(n_tokens.astype(np.int64)), pa.array((total(k) + end_row[0]).astype(np.int64)),
                    pa.array(total(k * np.log10((c[w] + 1) / base_of)) + end_row[1]), pa.array(total(k * log10[w]) + end_row[2]),
                ],
                names=names,
            )
            r, w, k = row[~mine], word[~mine], tf[~mine]
            none, real = pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.float64())
            yield pa.record_batch([pa.array(number + r), known.dictionary.cast(pa.string()).take(pa.array(w)), pa.array(k.astype(np.int64)), none, none, none, real, real], names=names)
            number += size

    parts = docs.mapInArrow(read, "row long, word string, tf long, doc_id long, n_tokens long, n_known long, base double, score double")
    parts = parts.withColumn("h", F.when(F.col("word").isNotNull(), F.xxhash64(F.lit(seed), "word"))).drop("word")
    parts = materialize(parts, "document-words")
    rare = scored.filter(F.col("c") <= max(1, n // FREQUENT)).select("h", "c", F.col("score").alias("log10"))
    joined = parts.filter("h is not null").select("row", "h", "tf").join(rare, "h")
    joined = joined.select("row", F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * F.log10((F.col("c") + 1) / base_of)).alias("base"), (F.col("tf") * F.col("log10")).alias("score"))
    joined = joined.groupBy("row").agg(F.sum("n_known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    whole = parts.filter("h is null").select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(joined, "row", "left")
    zero = F.lit(0.0)
    return whole.select(
        "doc_id", (~_train()).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
