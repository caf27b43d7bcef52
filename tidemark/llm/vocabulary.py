"""Subword vocabularies read from a file, and lattices of their pieces."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tidemark.llm.shared import HashLookup

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
ZIPF_OFFSET = 10.0


@dataclass
class Vocabulary:
    """Pieces with their ids, ids of single bytes, and log-probabilities by id.

    ``edges`` has the id of each piece, and -1 for each proper prefix of one that is no piece itself.
    A character that is no piece becomes the pieces of its UTF-8 bytes.
    """

    pieces: list[str]
    logp: np.ndarray
    byte_ids: list[int]
    end_id: int
    edges: dict[str, int] = field(default_factory=dict)

    def lattice(self, text: str) -> list[list[tuple[int, int]]]:
        """For each start the (end, id) of the pieces there; id -1 stands for the bytes of one character."""
        edges, n, out = self.edges, len(text), []
        for i in range(n):
            here, j = [], i + 1
            while j <= n:
                v = edges.get(text[i:j])
                if v is None:
                    break
                if v >= 0:
                    here.append((j, v))
                j += 1
            if not here or here[0][0] != i + 1:
                here.insert(0, (i + 1, -1))
            out.append(here)
        return out

    def bytes_logp(self, char: str, logp: list[float]) -> float:
        return sum(logp[self.byte_ids[b]] for b in char.encode("utf-8", "surrogatepass"))


def load_vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    """The vocabulary of a SentencePiece model file.

    The file's scores only order the pieces (the score of the r-th is -r), so they are read as ranks and
    weighted by Zipf's law, P proportional to 1 / (r + 10). Byte pieces come after all others in rank. The
    space mark as a literal character of a text is written in bytes, which keeps decoding exact.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    byte_ids, normal = [-1] * 256, []
    for i, piece in enumerate(pieces):
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal.append(i)
    order = sorted(normal, key=lambda i: (-model.get_score(i), i))
    weight = np.full(n, 0.0)
    for rank, i in enumerate(order):
        weight[i] = 1 / (rank + ZIPF_OFFSET)
    for i in byte_ids:
        weight[i] = 1 / (len(order) + ZIPF_OFFSET)
    end = model.eos_id()
    weight[end] = 1 / (100 + ZIPF_OFFSET)
    with np.errstate(divide="ignore"):
        logp = np.log(weight / weight.sum())
    edges: dict[str, int] = {}
    for i in normal:
        piece = pieces[i]
        if SPACE in piece.lstrip(SPACE):  # a piece over a word's end could not be told apart by words
            continue
        for j in range(1, len(piece)):
            edges.setdefault(piece[:j], -1)
        edges[piece] = i
    return Vocabulary(pieces, logp, byte_ids, end, edges)


def marginal(vocabulary: Vocabulary, logp: list[float], text: str) -> tuple[float, list[list[tuple[int, int]]], list[float]]:
    """Log-probability of a text over all its segmentations by the forward recursion, its lattice and forward values."""
    lattice, n = vocabulary.lattice(text), len(text)
    into: list[list[float]] = [[] for _ in range(n + 1)]
    forward = [0.0] * (n + 1)
    exp, log = math.exp, math.log
    for i in range(n):
        if i:
            terms = into[i]
            if len(terms) == 1:
                forward[i] = terms[0]
            else:
                top = max(terms)
                forward[i] = top + log(sum([exp(t - top) for t in terms]))
        f = forward[i]
        for j, v in lattice[i]:
            into[j].append(f + (logp[v] if v >= 0 else vocabulary.bytes_logp(text[i], logp)))
    if n:
        terms = into[n]
        top = max(terms)
        forward[n] = top + log(sum([exp(t - top) for t in terms]))
    return forward[n], lattice, forward


def expected_counts(vocabulary: Vocabulary, logp: list[float], text: str, weight: float, counts: np.ndarray | list[float]) -> None:
    """Add to ``counts`` how often each piece is expected in ``weight`` occurrences of a text."""
    total, lattice, forward = marginal(vocabulary, logp, text)
    n = len(text)
    backward = [0.0] * (n + 1)
    exp, log = math.exp, math.log
    for i in range(n - 1, -1, -1):
        terms = [backward[j] + (logp[v] if v >= 0 else vocabulary.bytes_logp(text[i], logp)) for j, v in lattice[i]]
        top = max(terms)
        backward[i] = top + log(sum([exp(t - top) for t in terms]))
        rest = forward[i] - total
        for (_, v), t in zip(lattice[i], terms):
            share = weight * exp(rest + t)
            if v >= 0:
                counts[v] += share
            else:
                for b in text[i].encode("utf-8", "surrogatepass"):
                    counts[vocabulary.byte_ids[b]] += share


class BatchLattice:
    """The lattices of many words at once: words of one length share each step of the recursions."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    LONGEST = 100

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        known = vocabulary.edges
        self.most = max(len(p) for p in known)
        keys = np.array([int(self._hash(np.array([[ord(c) for c in p]], np.uint64))[0]) for p in known], np.uint64)
        self.table = HashLookup(keys, np.array(list(known.values()), np.float64))

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(rows.shape[1]):
                h = (h + rows[:, i] + np.uint64(1)) * self.BASE
        return h

    def by_length(self, words: list[str], rows: int = 4096):
        """(positions of the words in the list, their code points) for batches of words of one length."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            for i in range(0, len(at), rows):
                part = at[i : i + rows]
                yield part, np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), -1).astype(np.uint64)

    def edges(self, codes: np.ndarray, logp: np.ndarray, char_logp: Callable[[str], float] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each piece length that occurs: it, the ids (-1: none) and log-probabilities by word and start."""
        out, (m, n) = [], codes.shape
        flat, start, column = codes.ravel(), np.arange(m * n), np.tile(np.arange(n), m)
        h = np.zeros(m * n, np.uint64)
        for size in range(1, min(n, self.most) + 1):
            with np.errstate(over="ignore"):
                h = (h + flat[start + (size - 1)] + np.uint64(1)) * self.BASE
            values, found = self.table.get(h)
            piece = np.flatnonzero(found & (values >= 0))
            if size == 1 or len(piece):
                all_ids, all_lp, at = np.full(m * n, -1, np.int32), np.full(m * n, -np.inf), values[piece].astype(np.int32)
                all_ids[start[piece]], all_lp[start[piece]] = at, logp[at]
                ids, lp = (x.reshape(m, n)[:, : n - size + 1] for x in (all_ids, all_lp))
                if size == 1 and len(piece) < m * n:
                    listed = logp.tolist()
                    of = char_logp or (lambda c: self.vocabulary.bytes_logp(c, listed))
                    chars, at = np.unique(codes[ids < 0], return_inverse=True)
                    lp[ids < 0] = np.array([of(chr(int(c))) for c in chars])[at]
                out.append((size, ids, lp))
            on = np.flatnonzero(found & (column < n - size))  # only what some piece begins with can grow
            start, column, h = start[on], column[on], h[on]
            if not len(h):
                break
        return out

    @staticmethod
    def _sum(terms: np.ndarray) -> np.ndarray:
        top = terms.max(0)
        return top + np.log(np.exp(terms - top).sum(0))

    def forward(self, edges: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """Log-probability of reaching each place of each word over all segmentations."""
        f = np.zeros((n + 1, edges[0][1].shape[0]))
        for j in range(1, n + 1):
            f[j] = self._sum(np.stack([f[j - s] + lp[:, j - s] for s, _, lp in edges if s <= j]))
        return f

    def best(self, edges: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi: the best scores, what the second best segmentations lose, and ids and starts of the best pieces from the end back.

        Of equal scores the longer last piece is taken. An id of -1 stands for a character's bytes, -2 for nothing more.
        """
        m, words = edges[0][1].shape[0], np.arange(edges[0][1].shape[0])
        score, gap, back = np.zeros((n + 1, m)), np.full((n + 1, m), np.inf), np.zeros((n + 1, m), np.int64)
        for j in range(1, n + 1):
            usable = [(s, lp) for s, _, lp in reversed(edges) if s <= j]
            sizes = np.array([s for s, _ in usable])
            terms = np.stack([score[j - s] + lp[:, j - s] for s, lp in usable])
            top = terms.argmax(0)
            score[j], back[j] = terms[top, words], sizes[top]
            terms[top, words] = -np.inf
            gap[j] = score[j] - terms.max(0)
        ids = np.full((edges[-1][0], m, n), -1, np.int32)
        for s, found, _ in edges:
            ids[s - 1, :, : n - s + 1] = found
        at, loss, path, starts = np.full(m, n), np.full(m, np.inf), [], []
        while at.any():
            on = at > 0
            size = np.maximum(back[at, words], 1)
            loss = np.where(on, np.minimum(loss, gap[at, words]), loss)
            begin = np.maximum(at - size, 0)
            path.append(np.where(on, ids[size - 1, words, begin], -2))
            starts.append(begin)
            at = np.where(on, begin, 0)
        return score[n], loss, np.stack(path), np.stack(starts)

    def marginals(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Log-probabilities of words over all their segmentations; very long words go one at a time."""
        out, listed = np.zeros(len(words)), logp.tolist()
        for at, codes in self.by_length(words):
            n = codes.shape[1]
            out[at] = [marginal(self.vocabulary, listed, words[k])[0] for k in at] if n > self.LONGEST else self.forward(self.edges(codes, logp), n)[n]
        return out

    def add_expected(self, words: list[str], weights: np.ndarray, logp: np.ndarray, counts: np.ndarray) -> None:
        """Add to ``counts`` the expected pieces of words that occur ``weights`` times."""
        listed = logp.tolist()
        for at, codes in self.by_length(words):
            n = codes.shape[1]
            if n > self.LONGEST:
                for k in at:
                    expected_counts(self.vocabulary, listed, words[k], float(weights[k]), counts)
                continue
            edges = self.edges(codes, logp)
            f = self.forward(edges, n)
            b = np.zeros_like(f)
            for i in range(n - 1, -1, -1):
                b[i] = self._sum(np.stack([b[i + s] + lp[:, i] for s, _, lp in edges if s <= n - i]))
            for s, ids, lp in edges:
                share = weights[at][:, None] * np.exp(f[: n - s + 1].T + lp + b[s:].T - f[n][:, None])
                hit = ids >= 0
                counts += np.bincount(ids[hit], share[hit], len(counts))
                if s == 1 and not hit.all():
                    chars, place = np.unique(codes[~hit], return_inverse=True)
                    for c, w in zip(chars.tolist(), np.bincount(place, share[~hit])):
                        for byte in chr(c).encode("utf-8", "surrogatepass"):
                            counts[self.vocabulary.byte_ids[byte]] += w
