"""Operator 4: encoding and decoding with an existing piece vocabulary, with exact N-best segmentations.

A forward Viterbi pass over a lattice gives the best score of reaching each place. These scores are exact
heuristics for an A-star search from the lattice's end backwards, which then brings out segmentations in
order of score without looking at worse ones. No piece crosses the mark of a space, so a text's lattice falls
apart there (and wherever else no piece crosses): the N best of the whole text differ from the best in at most
N - 1 parts, those with the smallest losses, and are put together from the searches of these. Best
segmentations of parts are kept as flat arrays in a table of bounded size.

Decoding is exact: characters without a piece, and the space mark itself where a text has it, are written as
bytes. Empty texts have one segmentation of no pieces, and null texts, kept apart from them, give nulls.
Whole texts are encoded in blocks of parts, however long. Ties are broken by the order of the lattice, and
between parts of equal loss by place, alike in every run. Repeated rows give equal results, rows of one key a result
each, whose ``decoded_sha256`` tells their texts apart; an empty table gives an empty one. Columns other than key and
text are neither read nor returned. Ids that the vocabulary lacks can't be decoded and raise.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import mapped, process_cache
from tidemark.llm.vocabulary import MODEL_PATH, SPACE, BatchLattice, Vocabulary, load_vocabulary

NBEST, CACHE, LONG, BLOCK, ROWS = 4, 400_000, 200, 1 << 20, 1024
MARK = "\ud8a1"  # stands for a literal space mark; no text that is valid UTF-8 has it
PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

Part = tuple[tuple[int, ...], float, float | None]


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class PartTable:
    """Best segmentations of parts as flat arrays; when it is full, parts that came but once go."""

    def __init__(self, room: int = CACHE):
        self.room, self.index = room, {}
        self.score, self.loss = np.empty(0), np.empty(0)
        self.start, self.size, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def add(self, names: list[str], score: np.ndarray, loss: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        self.index.update(zip(names, range(len(self.index), len(self.index) + len(names))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size, self.score, self.loss = np.concatenate([self.size, size]), np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        self.used, self.ids = np.concatenate([self.used, np.zeros(len(names), np.int64)]), np.concatenate([self.ids, ids])

    def shrink(self) -> None:
        """Keep the parts that came more than once, if that makes room enough, and else none."""
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > self.room // 2:
            kept = kept[:0]
        names = list(self.index)
        ids = self.ids[gathered(self.start[kept], self.size[kept])]
        size, score, loss = self.size[kept], self.score[kept], self.loss[kept]
        self.__init__(self.room)
        self.add([names[k] for k in kept.tolist()], score, loss, size, ids)

    def pieces(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts one after the other, and how many each has."""
        size = self.size[at]
        return self.ids[gathered(self.start[at], size)], size


class Segmenter:
    """N-best segmentations of texts into a vocabulary's pieces."""

    def __init__(self, vocabulary: Vocabulary, nbest: int = NBEST, name: str = MODEL_PATH):
        self.vocabulary, self.nbest, self.name = vocabulary, nbest, f"{name}:{nbest}"
        self.logp = vocabulary.logp.tolist()
        self.lattice = BatchLattice(vocabulary)
        self.bytes = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in vocabulary.pieces]
        for value, piece in enumerate(vocabulary.byte_ids):
            self.bytes[piece] = bytes([value])

    def char_ids(self, char: str) -> tuple[int, ...]:
        data = SPACE.encode() if char == MARK else char.encode("utf-8", "surrogatepass")
        return tuple(self.vocabulary.byte_ids[b] for b in data)

    def search(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a part with their scores, best first."""
        length, logp = len(part), self.logp
        into: list[list[tuple[int, int | tuple[int, ...], float]]] = [[] for _ in range(length + 1)]
        best = [0.0] * (length + 1)
        for i, edges in enumerate(self.vocabulary.lattice(part)):
            if i:
                best[i] = max([best[s] + lp for s, _, lp in into[i]])
            for j, v in edges:
                if v >= 0:
                    into[j].append((i, v, logp[v]))
                else:
                    ids = self.char_ids(part[i])
                    into[j].append((i, ids, sum([logp[x] for x in ids])))
        best[length] = max([best[s] + lp for s, _, lp in into[length]])
        heap, made, out = [(-best[length], 0, length, 0.0, None)], 0, []
        pop, push = heapq.heappop, heapq.heappush
        while heap and len(out) < n:
            _, _, at, g, path = pop(heap)
            while at:  # follow the best edge at once, and keep the others for later
                others, top, chosen = into[at], -1e300, None
                for edge in others:
                    f = g + edge[2] + best[edge[0]]
                    if f > top:
                        top, chosen = f, edge
                for edge in others:
                    if edge is not chosen:
                        made += 1
                        push(heap, (-(g + edge[2] + best[edge[0]]), made, edge[0], g + edge[2], (edge[1], path)))
                at, g, path = chosen[0], g + chosen[2], (chosen[1], path)
            ids = []
            while path is not None:
                v, path = path
                if isinstance(v, tuple):
                    ids.extend(v)
                else:
                    ids.append(v)
            out.append((g, tuple(ids)))
        return out

    def cuts(self, part: str) -> list[str]:
        """A long part where no piece crosses a place, cut there."""
        out, start, reach = [], 0, 0
        for i, edges in enumerate(self.vocabulary.lattice(part)):
            if i and reach <= i:
                out.append(part[start:i])
                start = i
            reach = max(reach, edges[-1][0])
        return [*out, part[start:]]

    def part(self, part: str) -> Part:
        """The best segmentation of a part, its score, and how much the second best loses (None without one).

        On the way back along the best path, leaving it by another edge costs what the forward scores tell,
        so the least of these is the second best's exact loss.
        """
        edges, logp, length = self.vocabulary.edges, self.logp, len(part)
        best, back = [-1e300] * (length + 1), [(0, 0)] * (length + 1)
        into: list[list[float]] = [[] for _ in range(length + 1)]
        best[0], j = 0.0, 1
        for i in range(length):
            here, j, single = best[i], i + 1, False
            while j <= length:
                v = edges.get(part[i:j])
                if v is None:
                    break
                if v >= 0:
                    f = here + logp[v]
                    into[j].append(f)
                    if f > best[j]:
                        best[j], back[j] = f, (i, v)
                    single = single or j == i + 1
                j += 1
            if not single:
                ids = self.char_ids(part[i])
                f = here + sum([logp[x] for x in ids])
                into[i + 1].append(f)
                if f > best[i + 1]:
                    best[i + 1], back[i + 1] = f, (i, ids)
        ids, at, loss = [], length, None
        while at:
            top, same = best[at], 0
            for f in into[at]:
                if f == top:
                    same += 1
                elif loss is None or top - f < loss:
                    loss = top - f
            if same > 1:
                loss = 0.0
            at, v = back[at]
            if isinstance(v, tuple):
                ids.extend(v[::-1])
            else:
                ids.append(v)
        return tuple(ids[::-1]), best[length], loss

    def others(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of the second to N-th best segmentations of a part."""
        cache = process_cache(f"{self.name}:others")
        found = cache.get(part)
        if found is None:
            told, table = self.search(part, self.nbest), self.table()
            best = tuple(table.pieces(np.array([table.index[part]]))[0].tolist()) if part in table.index else self.part(part)[0]
            found = [(max(0.0, told[0][0] - score), ids) for score, ids in told if ids != best][: self.nbest - 1]
            if len(part) <= LONG:
                if len(cache) >= CACHE // 10:
                    cache.clear()
                cache[part] = found
        return found

    def batch(self, table: PartTable, names: list[str]) -> None:
        """As ``part``, for many parts at once, which are added to the table."""
        char_logp = lambda c: sum([self.logp[x] for x in self.char_ids(c)])
        found: list[tuple] = []
        for at, codes in self.lattice.by_length(names):
            score, loss, path, starts = self.lattice.best(self.lattice.edges(codes, self.vocabulary.logp, char_logp), codes.shape[1])
            ids, begins = path.T[:, ::-1], starts.T[:, ::-1]
            odd = np.flatnonzero((ids == -1).any(1))  # has characters that are written as bytes
            plain = np.setdiff1d(np.arange(len(at)), odd)
            whole = ids[plain]
            found.append((at[plain], score[plain], loss[plain], (whole >= 0).sum(1), whole[whole >= 0]))
            if len(odd):
                made = []
                for name, path_ids, path_begins in zip((names[k] for k in at[odd]), ids[odd].tolist(), begins[odd].tolist()):
                    made.append([x for i, b in zip(path_ids, path_begins) if i > -2 for x in ((i,) if i >= 0 else self.char_ids(name[b]))])
                found.append((at[odd], score[odd], loss[odd], np.array(list(map(len, made))), np.array([x for ids in made for x in ids], np.int32)))
        if found:
            at, *columns = (np.concatenate(x) for x in zip(*found))
            table.add([names[k] for k in at.tolist()], *columns)

    def blocks(self, text: str) -> Iterator[list[str]]:
        """A text's parts, in blocks of about ``BLOCK`` characters."""
        whole = SPACE + text.replace(SPACE, MARK).replace(" ", SPACE) if text else ""
        if len(whole) > BLOCK:
            yield from map(PARTS.findall, self.long_blocks(whole))
        elif whole:
            yield PARTS.findall(whole)

    @staticmethod
    def long_blocks(whole: str) -> Iterator[str]:
        """Runs of whole parts of a marked text."""
        at = 0
        while at < len(whole):
            end = whole.find(SPACE, at + BLOCK)
            while end > 0 and whole[end - 1] == SPACE:  # a part begins with all of its marks
                end = whole.find(SPACE, end + 1)
            end = len(whole) if end < 0 else end
            yield whole[at:end]
            at = end

    def table(self) -> PartTable:
        home = process_cache(self.name)
        if "table" not in home:
            home["table"] = PartTable()
        return home["table"]

    def prepare(self, blocks: list[list[str]]) -> np.ndarray:
        """The places in the table of the parts of all blocks, one after the other; long parts are cut first."""
        table = self.table()
        if len(table.index) > table.room:
            table.shrink()
        parts, at, new = self.missing(blocks)
        long = [x for x in new if len(x) > LONG]
        if long:
            cut = {x: self.cuts(x) for x in long}
            for k, names in enumerate(blocks):
                if not cut.keys().isdisjoint(names):
                    blocks[k] = [y for x in names for y in cut.get(x, (x,))]
            parts, at, new = self.missing(blocks)
        self.batch(table, [x for x in new if len(x) <= LONG])
        for x in new:
            if len(x) > LONG:
                ids, score, loss = self.part(x)
                table.add([x], np.array([score]), np.array([np.inf if loss is None else loss]), np.array([len(ids)]), np.array(ids, np.int32))
        rest = np.flatnonzero(at < 0)
        at[rest] = [table.index[parts[k]] for k in rest.tolist()]
        table.used += np.bincount(at, minlength=len(table.used))
        return at

    def missing(self, blocks: list[list[str]]) -> tuple[list[str], np.ndarray, set[str]]:
        """All parts in order, their places in the table (-1: none), and those that have none."""
        parts = list(chain.from_iterable(blocks))
        at = np.fromiter(map(self.table().index.get, parts, repeat(-1)), np.int64, len(parts))
        return parts, at, {parts[k] for k in np.flatnonzero(at < 0).tolist()}

    def encode_all(self, texts: Sequence[str]) -> list[tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """Of each text: ids of the best segmentation, its score, and the N best as (score, changes).

        A change (place, count, ids) puts ids in the stead of ``count`` pieces at a place of the best.
        """
        out: list = [None] * len(texts)
        held: list[tuple[int, list[str]]] = []
        state: dict[int, tuple[list[np.ndarray], float, list, int]] = {}
        size = 0

        def flush() -> None:
            blocks = [names for _, names in held]
            at, table = self.prepare(blocks), self.table()
            ids, counts = table.pieces(at)
            score, loss = table.score[at], table.loss[at]
            ends = np.cumsum([0, *map(len, blocks)])
            upto = np.r_[0, np.cumsum(counts)]
            for (k, _), names, a, b in zip(held, blocks, ends[:-1].tolist(), ends[1:].tolist()):
                parts, total, near, placed = state.get(k, ([], 0.0, [], 0))
                base = upto[a]
                near = near + [(float(loss[a + i]), placed + int(upto[a + i] - base), int(counts[a + i]), names[i]) for i in self.nearest(loss[a:b])]
                near = sorted(near, key=lambda x: (x[0], x[1]))[: self.nbest - 1]
                state[k] = parts + [ids[base : upto[b]]], total + float(score[a:b].sum()), near, placed + int(upto[b] - base)
            held.clear()

        for k, text in enumerate(texts):
            for names in self.blocks(text):
                held.append((k, names))
                size += len(names)
                if size > BLOCK // 4:
                    flush()
                    size = 0
        if held:
            flush()
        for k in range(len(texts)):
            parts, total, near, _ = state.get(k, ([np.empty(0, np.int32)], 0.0, [], 0))
            ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
            out[k] = ids, total, [(total - loss, changes) for loss, changes in self.combined(near)]
        return out

    def nearest(self, loss: np.ndarray) -> list[int]:
        """The places of the N - 1 smallest finite losses, of equal ones the first."""
        n = self.nbest - 1
        if n < 1:
            return []
        some = np.flatnonzero(loss <= np.partition(loss, n - 1)[n - 1]) if len(loss) > n else np.arange(len(loss))
        some = some[np.isfinite(loss[some])]
        return some[np.argsort(loss[some], kind="stable")][:n].tolist()

    def combined(self, near: list[tuple[float, int, int, str]]) -> list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]:
        """(loss, changes) of the N best segmentations of all parts together, of the parts that can differ."""
        told: list[tuple[float, tuple]] = [(0.0, ())]
        for k, (_, place, count, name) in enumerate(near):
            # The best and the k nearer parts' second best are no worse than any other of this part.
            ways = [(0.0, ()), *((d, ((place, count, ids),)) for d, ids in self.others(name)[: self.nbest - 1 - k])]
            told = heapq.nsmallest(self.nbest, [(loss + more, (*chosen, *way)) for loss, chosen in told for more, way in ways], key=lambda x: x[0])
        return [(loss, sorted(changes)) for loss, changes in told]

    @staticmethod
    def changed(best: np.ndarray, changes: list[tuple[int, int, tuple[int, ...]]]) -> np.ndarray:
        """The ids of a segmentation that differs from the best by ``changes``."""
        out, at = [], 0
        for place, count, ids in changes:
            out += [best[at:place], np.array(ids, np.int32)]
            at = place + count
        return np.concatenate([*out, best[at:]]) if changes else best

    def encode(self, text: str) -> tuple[list[int], float, list[float]]:
        """Ids of the best segmentation, its score, and the scores of the N best."""
        ids, score, told = self.encode_all([text])[0]
        return ids.tolist(), score, [s for s, _ in told]

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a whole text, best first."""
        best, _, told = self.encode_all([text])[0]
        return [(score, self.changed(best, changes).tolist()) for score, changes in told]

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        """UTF-8 of the text that was encoded."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]

    def decode(self, ids: Sequence[int]) -> str:
        """The text that was encoded."""
        if len(ids) and not 0 <= min(ids) <= max(ids) < len(self.bytes):
            raise ValueError("there are ids that the vocabulary lacks")
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH, nbest: int = NBEST, nbest_ids: bool = True) -> DataFrame:
    """Key, the N best segmentations (best first) with their scores, and digests of them and of the decoded text.

    ``piece_ids`` has the best, ``nbest_changes`` what each of the N puts in its stead: (place, count, ids) for ids
    instead of ``count`` pieces from a place of the best on, a few integers each; ``changed_ids`` puts them together.
    ``nbest_ids`` has all N written out, N times the room, and can be left out.
    """
    segmenter = Segmenter(load_vocabulary(model_path), nbest, model_path)
    kind = docs.schema[key].dataType.simpleString()
    columns = ("piece_ids", "nbest_changes", "nbest_ids", "n_pieces", "score", "nbest_scores", "pieces_sha256", "nbest_sha256", "decoded_sha256", "exact")
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def encode(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in columns}
        told = iter(segmenter.encode_all([t for t in rows["text"] if t is not None]))
        for t in rows["text"]:
            if t is None:
                row = (None,) * len(columns)
            else:
                best, score, found = next(told)
                ways = [segmenter.changed(best, changes).astype("<i4") for _, changes in found]
                back = segmenter.decode_bytes(best.tolist())
                digests = [digest(x) for x in ways]
                told_changes = [[{"place": a, "count": n, "ids": x} for a, n, x in changes] for _, changes in found]
                row = (best, told_changes, ways if nbest_ids else None, len(best), score, [s for s, _ in found], digests[0], digests, digest(back), back == t.encode("utf-8", "surrogatepass"))
            for n, v in zip(columns, row):
                out[n].append(v)
        return {"key": rows["key"], **out}

    made = mapped(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")), encode,
        f"key {kind}, piece_ids array<int>, nbest_changes array<array<struct<place:int,count:int,ids:array<int>>>>, nbest_ids array<array<int>>, n_pieces int, score double, nbest_scores array<double>, pieces_sha256 string, nbest_sha256 array<string>, decoded_sha256 string, exact boolean",
        ROWS, segmenter.name,
    )
    return made.drop(*([] if nbest_ids else ["nbest_ids"])).withColumnRenamed("key", key)


def changed_ids(best: str = "piece_ids", changes: str = "nbest_changes") -> Column:
    """All N segmentations from the best and the changes to it, without Python."""

    def put(way: Column) -> Column:
        """From the last change to the first, so that places before it hold."""
        return F.aggregate(F.reverse(way), F.col(best), lambda ids, c: F.concat(F.slice(ids, 1, c["place"]), c["ids"], F.slice(ids, c["place"] + c["count"] + 1, F.size(ids))))

    return F.transform(F.col(changes), put)


def decode_documents(encoded: DataFrame, ids: str = "piece_ids", text: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` with the texts of its ids in a column ``text``; null for null."""
    segmenter = Segmenter(load_vocabulary(model_path), 1, model_path)

    @F.pandas_udf("string")
    def decode(found):
        return found.map(lambda x: segmenter.decode(x.tolist()), na_action="ignore")

    return encoded.withColumn(text, decode(F.col(ids)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded into its N best segmentations, and decoded again."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), nbest_ids=False)
