"""Segmentations of words into vocabulary pieces, for many words of one length at a time.

A word's substrings are looked up by rolling hashes among the sorted hashes of all pieces, then compared, so a
collision cannot pass. Best paths (Viterbi) and marginals (forward, backward) advance all words of a length together;
words beyond EXACT characters are padded to one of a few widths. Work and memory are in proportion to the characters,
however long a word is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

BLANK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
_FILTER = np.uint64(64 - _FILTER_BITS)
#: Characters whose words advance together, and of which one table of arcs is made.
BLOCK = 1 << 16
#: Words up to this length only share a batch with words of the same length.
EXACT = 32


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points in one array, and each word's length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def _width(lengths: np.ndarray) -> np.ndarray:
    """The width that each length is padded to: itself up to EXACT, then the next of eight widths an octave."""
    step = 1 << np.maximum(0, np.floor(np.log2(np.maximum(lengths, 1))).astype(np.int64) - 3)
    return np.where(lengths <= EXACT, lengths, -(-lengths // step) * step)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in words, code points, lengths) of words of one width, in blocks of bounded size; empty words left
    out. Code points beyond a word's end are -1."""
    flat, lengths = code_points(words)
    starts = np.cumsum(lengths) - lengths
    widths = _width(lengths)
    order = np.argsort(widths, kind="stable")
    cuts = np.flatnonzero(np.diff(widths[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        w = int(widths[order[lo]])
        step = max(1, BLOCK // max(1, w))
        for at in range(lo, hi if w else lo, step):
            rows = order[at : min(hi, at + step)]
            inside = np.arange(w) < lengths[rows][:, None]
            yield rows, np.where(inside, flat[np.minimum(starts[rows][:, None] + np.arange(w), len(flat) - 1)], -1), lengths[rows]


class Pieces:
    """Pieces that can be looked up as substrings. Piece numbers are positions in the given list."""

    def __init__(self, pieces: list[str]):
        flat, self.lengths = code_points(pieces)
        self.longest = int(self.lengths.max(initial=0))
        self.sizes = set(self.lengths.tolist())
        self.chars = np.zeros((len(pieces), self.longest), np.int64)
        self.chars[np.arange(self.longest) < self.lengths[:, None]] = flat
        hashes = np.zeros(len(pieces), np.uint64)
        for k in range(self.longest):
            inside = k < self.lengths
            hashes[inside] = hashes[inside] * _BASE + (self.chars[inside, k] + 1).astype(np.uint64)
        hashes = self._mix(hashes, self.lengths)
        self.order = np.argsort(hashes, kind="stable")
        self.keys = hashes[self.order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> _FILTER).astype(np.int64)] = True

    @staticmethod
    def _mix(hashes: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        x = hashes ^ np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)

    def arcs(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, rows, starts, pieces), for each length, of all substrings of the rows that are a piece."""
        n, width = chars.shape
        if not len(self.keys):
            return
        codes = (chars + 1).astype(np.uint64)
        hashes = np.zeros((n, width), np.uint64)
        for length in range(1, min(width, self.longest) + 1):
            hashes = hashes[:, : width - length + 1] * _BASE + codes[:, length - 1 :]
            if length not in self.sizes:
                continue
            x = self._mix(hashes, length)
            rows, starts = np.nonzero(self.filter[(x >> _FILTER).astype(np.int64)])
            x = x[rows, starts]
            at = np.searchsorted(self.keys, x)
            at[at == len(self.keys)] = 0
            same = self.keys[at] == x
            rows, starts, piece = rows[same], starts[same], self.order[at[same]]
            same = (self.lengths[piece] == length) & (self.chars[piece, :length] == chars[rows[:, None], starts[:, None] + np.arange(length)]).all(axis=1)
            yield length, rows[same], starts[same], piece[same]

    def tables(self, chars: np.ndarray, backward: bool = False) -> Iterator[tuple[int, list, np.ndarray]]:
        """For runs of ends in order: (the first end, its arcs with starts in the whole word, an empty [end, length,
        row] table of -inf to fill). A run is as many ends as a block allows; backward begins with the last."""
        n, width = chars.shape
        step = max(1, BLOCK // n)
        runs = range(0, width, step)
        for lo in reversed(runs) if backward else runs:
            hi, back = min(width, lo + step), max(0, lo - self.longest + 1)
            found = []
            for length, rows, starts, piece in self.arcs(chars[:, back:hi]):
                late = starts + back + length > lo
                found.append((length, rows[late], starts[late] + back, piece[late]))
            yield lo, found, np.full((hi - lo, max(1, self.longest), n), -np.inf)


def _sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials along the first axis; -inf where all are."""
    most = x.max(axis=0)
    shift = np.where(np.isfinite(most), most, 0.0)
    with np.errstate(divide="ignore"):
        return shift + np.log(np.exp(x - shift).sum(axis=0))


def viterbi(pieces: Pieces, scores: np.ndarray, chars: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Backpointers [end, word]: the best last piece's length, and its number, -1 for an unknown character.

    An unknown character counts `unknown` where no piece is that character alone. Equal sums: the longest last piece.
    """
    n, width = chars.shape
    best = np.full((width + 1, n), -np.inf)
    best[0] = 0
    step, which = np.ones((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
    words = np.arange(n)
    for lo, arcs, value in pieces.tables(chars):
        piece = np.full(value.shape, -1, np.int32)
        for length, rows, starts, found in arcs:
            value[starts + length - 1 - lo, length - 1, rows] = scores[found]
            piece[starts + length - 1 - lo, length - 1, rows] = found
        value[:, 0] = np.where(piece[:, 0] < 0, unknown, value[:, 0])
        for k in range(len(value)):
            end = lo + k + 1
            reach = min(end, value.shape[1])
            x = (value[k, :reach] + best[end - reach : end][::-1])[::-1]  # the longest first
            at = x.argmax(axis=0)
            best[end] = x[at, words]
            step[end] = reach - at
            which[end] = piece[k, reach - 1 - at, words]
    return step, which


def forward(pieces: Pieces, logp: np.ndarray, chars: np.ndarray, fallback: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Log of the summed probability of all segmentations up to each end: [end, word].

    fallback: log probability of each character by itself, outside the pieces; it is one more arc everywhere.
    """
    n, width = chars.shape
    alpha = np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    for lo, arcs, value in pieces.tables(chars):
        for length, rows, starts, piece in arcs:
            value[starts + length - 1 - lo, length - 1, rows] = logp[piece]
        value[:, 0] = np.logaddexp(value[:, 0], fallback(chars[:, lo : lo + len(value)]).T)
        for k in range(len(value)):
            end = lo + k + 1
            reach = min(end, value.shape[1])
            alpha[end] = _sum(value[k, :reach] + alpha[end - reach : end][::-1])
    return alpha


def expected_counts(pieces: Pieces, logp: np.ndarray, chars: np.ndarray, lengths: np.ndarray, weights: np.ndarray, fallback: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each piece is expected in the words, over all segmentations by their probability."""
    n, width = chars.shape
    words = np.arange(n)
    alpha = forward(pieces, logp, chars, fallback)
    total = alpha[lengths, words]
    beta = np.full((width + 1, n), -np.inf)
    beta[lengths, words] = 0
    out = np.zeros(len(logp))
    for lo, arcs, value in pieces.tables(chars, backward=True):
        for length, rows, starts, piece in arcs:
            value[starts + length - 1 - lo, length - 1, rows] = logp[piece]
        value[:, 0] = np.logaddexp(value[:, 0], fallback(chars[:, lo : lo + len(value)]).T)
        for k in range(len(value) - 1, -1, -1):
            end = lo + k + 1
            reach = min(end, value.shape[1])
            span = slice(end - reach, end)
            beta[span] = np.logaddexp(beta[span], (value[k, :reach] + beta[end])[::-1])
        for length, rows, starts, piece in arcs:
            share = alpha[starts, rows] + logp[piece] + beta[starts + length, rows] - total[rows]
            out += np.bincount(piece, weights[rows] * np.exp(share), len(out))
    return out


def log_weights(scores: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces from a vocabulary's scores. A unigram model's scores are that already; those of a
    BPE model, which are minus the ranks of its merges, weigh 1 / (10 + rank), as frequencies by rank do in text."""
    whole = bool(len(scores)) and bool((scores == np.round(scores)).all()) and scores.min() < -100
    weight = 1.0 / (10.0 - scores) if whole else np.exp(scores)
    return np.log(weight / weight.sum()) if whole else scores.astype(float)
