"""SentencePiece unigram encoding and decoding: batched Viterbi over words of equal length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .lattice import BLANK, Pieces, by_length, log_weights, viterbi

#: sentencepiece counts an unknown character as the least score of a normal piece less this.
UNKNOWN_PENALTY = 10.0
_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Texts to piece ids and back, with a blank in front, no other normalisation, and bytes for unknown characters.
    The pieces and scores are an existing model's; nothing is trained.

    A unigram model gives the ids that sentencepiece gives. A BPE model's scores are merge ranks, which no sum over a
    path makes sense of; its pieces weigh as lattice.log_weights says, and the ids are those of the likeliest path, not
    of the merges that sentencepiece would make. Either way decode(encode(text)) is the text.
    """

    def __init__(self, model_path: str, cache: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = np.array(normal, np.int32)
        self.names = [model.id_to_piece(i) for i in normal]
        self.scores = log_weights(np.array([model.get_score(i) for i in normal]))
        self.pieces = Pieces(self.names)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.text = {i: x.replace(BLANK, " ").encode() for i, x in zip(normal, self.names)} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.unk_id = model.unk_id()
        self.kept: dict[str, bytes] = {}
        self.limit = cache

    def _encode_units(self, units: list[str]) -> dict[str, bytes]:
        out = {}
        for rows, chars, lengths in by_length(units):
            step, which = viterbi(self.pieces, self.scores, chars, self.unknown)
            n = len(rows)
            at, found = lengths.copy(), []
            alive = np.arange(n)
            while len(alive):  # all words step back together
                end = at[alive]
                found.append((alive, end, which[end, alive]))
                at[alive] = end - step[end, alive]
                alive = alive[at[alive] > 0]
            word, end, piece = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((end, word))
            word, end, piece = word[order], end[order], piece[order]
            ids = self.ids[np.maximum(piece, 0)].astype("<i4")
            cuts = np.searchsorted(word, np.arange(n + 1)).tolist()
            odd = set(word[piece < 0].tolist())
            for r, row in enumerate(rows.tolist()):
                lo, hi = cuts[r], cuts[r + 1]
                if r in odd:
                    unit, parts = units[row], []
                    for e, p in zip(end[lo:hi].tolist(), piece[lo:hi].tolist()):
                        parts += [int(self.ids[p])] if p >= 0 else [self.bytes.get(b, self.unk_id) for b in unit[e - 1].encode("utf-8", "surrogatepass")]
                    out[units[row]] = np.array(parts, "<i4").tobytes()
                else:
                    out[units[row]] = ids[lo:hi].tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_UNITS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = list({u for units in split for u in units if u not in self.kept})
        if len(self.kept) + len(new) > self.limit:
            self.kept.clear()
            new = list({u for units in split for u in units})
        fresh = self._encode_units(new)
        out = [np.frombuffer(b"".join([fresh[u] if u in fresh else self.kept[u] for u in units]), "<i4") for units in split]
        if len(new) <= self.limit:
            self.kept |= {u: x for u, x in fresh.items() if len(u) <= 64}
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Inverse of encode, byte by byte; unknown ids give nothing."""
        text = b"".join(map(self.text.get, ids.tolist(), [b""] * len(ids)))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_made: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    if model_path not in _made:
        _made[model_path] = Codec(model_path)
    return _made[model_path]


#: Texts encoded together.
ROWS = 2000


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every whole text; null and empty texts have no ids. Rows keep their number."""
    prepare(docs.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = codec(path).encode([t or "" for t in part.column("text").to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(run, f"id {out.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of every list of ids; null ids give an empty text."""
    prepare(encoded.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return out.mapInArrow(run, f"id {out.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_crc32, exact) of every whole document: encoded, decoded again and compared.

    Checksums are unsigned: of the ids as little-endian 32-bit integers, and of the decoded text in UTF-8. Null and
    empty texts have no ids and are exact; null ids and repeated rows keep a row each; long unspaced texts cost in
    proportion to their characters. An empty table gives no rows; extra columns are not read."""
    prepare(docs.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for text, ids in zip(texts, codec(path).encode(texts)):
                    back = codec(path).decode(ids)
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode()), back == text))
                cols = list(zip(*rows))
                yield pa.record_batch([part.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "exact"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, exact boolean")
