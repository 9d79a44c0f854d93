"""SentencePiece encoding and decoding, with distinct sampled segmentations by perturbed A* search (operator 10)."""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidied
from .words import hashes, mix

SPACE = "▁"
#: Cost of a piece: PIECE + RANK * log(1 + its rank in the vocabulary); a segmentation has probability ~ exp(-sum of costs).
PIECE, RANK = 8.0, 4.0
SAMPLES, SEED = 3, 11
RESCALE = 1e140
#: Chunks up to this length are decoded many at a time; each character scales a path by exp(SHIFT), which all paths share.
SHORT, SHIFT = 20, 30.0
#: Chunks of some texts, padded to the longest, that are sampled together.
CELLS = 1 << 14
#: Bytes of the texts that are prepared and returned together.
TOGETHER = 1_000_000
#: Pieces that are spelled out together.
SPELLED = 1 << 16
#: Chunks that a worker keeps decoded; beyond that they are forgotten and made again, with equal results.
KEPT, KEPT_LATTICES = 160_000, 8_000


def likeliest(model: Pieces, text: str) -> tuple[float, tuple[int, ...]]:
    """Log probability and ids of a chunk's best segmentation: Viterbi and backward sums over the lattice in one pass."""
    weights, n = model.weights, len(text)
    get = weights.get
    mass, high, to = [1.0] * (n + 1), [1.0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        total = peak = 0.0
        for j in range(i + 1, n + 1):
            w = get(text[i:j])
            if w is None:
                break
            if w:
                total += w * mass[j]
                h = w * high[j]
                if h > peak:
                    peak, to[i] = h, j
        if not get(text[i]):
            w = model.byte_weight(text[i])
            total += w * mass[i + 1]
            if w * high[i + 1] > peak:
                peak, to[i] = w * high[i + 1], i + 1
        mass[i], high[i] = total, peak
        if total < 1e-150:  # in long chunks: rescale all that later steps read
            for j in range(i, min(n, i + model.longest) + 1):
                mass[j] *= RESCALE
                high[j] *= RESCALE
    ids, i = [], 0
    while i < n:
        ids += model.piece_ids(text, i, to[i])
        i = to[i]
    return min(0.0, math.log(high[0] / mass[0])), tuple(ids)


class Lattice:
    """The segmentations of one chunk, of any length, as paths from its start to its end; a path is the tuple of its pieces' ends.

    ``arcs`` has, for each position, the probability of each piece given that a path comes by. Paths met so far have codes: 0 the
    likeliest, 1 the second likeliest where the store has it, then as they come. What is left without some paths is a sum of
    what leaves them anywhere, without differences, so it is exact however small."""

    __slots__ = ("arcs", "codes", "model", "paths", "text")

    def __init__(self, model: Pieces, text: str, row: int | None = None):
        self.text, self.model = text, model
        get, n = model.weights.get, len(text)
        mass, self.arcs = [1.0] * (n + 1), [None] * n
        for i in range(n - 1, -1, -1):
            out, total = [], 0.0
            for j in range(i + 1, n + 1):
                w = get(text[i:j])
                if w is None:
                    break
                if w:
                    x = w * mass[j]
                    out.append((x, j))
                    total += x
            if not get(text[i]):
                x = model.byte_weight(text[i]) * mass[i + 1]
                out.append((x, i + 1))
                total += x
            mass[i] = total
            self.arcs[i] = [(x / total, j) for x, j in out]
            if total < 1e-150:  # in long chunks: rescale all that later steps read
                for j in range(i, min(n, i + model.longest) + 1):
                    mass[j] *= RESCALE
        self.paths: dict[int, tuple[int, ...]] = {}
        if row is not None:
            store = model.store
            for code, (at, count) in enumerate(((store.at1[row], store.n1[row]), (store.at2[row], store.n2[row]))):
                if count:
                    self.paths[code] = model.ends(text, store.ids[at : at + count].tolist())
        self.codes = {p: c for c, p in self.paths.items()}

    def log(self, path: tuple[int, ...]) -> float:
        i, total = 0, 0.0
        for j in path:
            total += math.log(next(p for p, e in self.arcs[i] if e == j))
            i = j
        return min(0.0, total)

    def ids(self, code: int) -> list[int]:
        i, out = 0, []
        for j in self.paths[code]:
            out += self.model.piece_ids(self.text, i, j)
            i = j
        return out

    def _without(self, out: Iterable[tuple[int, ...]]) -> tuple[list[float], list[dict[int, int]]]:
        """The tree of these paths' beginnings: for each node the share of the paths by there that goes on as none of them, and its
        children by their ends."""
        kids: list[dict[int, int]] = [{}]
        place = [0]
        for path in out:
            node = 0
            for j in path:
                after = kids[node].get(j)
                if after is None:
                    after = kids[node][j] = len(kids)
                    kids.append({})
                    place.append(j)
                node = after
        left, n = [0.0] * len(kids), len(self.text)
        for node in range(len(kids) - 1, -1, -1):
            if place[node] < n:
                own, total = kids[node], 0.0
                for p, j in self.arcs[place[node]]:
                    total += p * left[own[j]] if j in own else p
                left[node] = total
        return left, kids

    def rest(self, codes: Iterable[int]) -> float:
        """Log probability of all paths but these."""
        left = self._without([self.paths[c] for c in codes])[0][0]
        return min(0.0, math.log(left)) if left > 0 else -math.inf

    def draw(self, codes: Iterable[int], u: float) -> int | None:
        """A path that isn't one of these, with the probabilities of what is left; None if nothing is. ``u`` seeds the choices."""
        left, kids = self._without([self.paths[c] for c in codes])
        if not left[0]:
            return None
        state, path, node, i, n = int(u * 2**53) ^ 0x5DEECE66D, [], 0, 0, len(self.text)
        while i < n:
            arcs = self.arcs[i]
            if node >= 0:
                branch = kids[node]
                arcs = [(p * left[branch[j]] if j in branch else p, j) for p, j in arcs]
                total = sum(p for p, _ in arcs)
            else:
                branch, total = {}, 1.0
            got = arcs[0][1]
            if len(arcs) > 1:
                state = (state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
                x = ((state ^ (state >> 33)) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
                aim = ((x >> 11) + 0.5) * 2.0**-53 * total
                for p, j in arcs:
                    if p > 0:
                        got = j
                        aim -= p
                        if aim <= 0:
                            break
            node = branch.get(got, -1)
            path.append(got)
            i = got
        found = tuple(path)
        if found not in self.codes:
            code = 2 + sum(c > 1 for c in self.paths)
            self.codes[found], self.paths[code] = code, found
        return self.codes[found]


class Table:
    """Weights of pieces, and of what begins one (0), by a 64-bit hash of the characters, for arrays of hashes: a table of
    slots, and further ones for what clashes in the first."""

    def __init__(self, weights: dict[str, float], ids: dict[str, int]):
        names = list(weights)
        self.ids = np.array([*[ids.get(p, -1) for p in names], -1], dtype=np.int32)
        rng = np.random.default_rng(97)
        self.mul = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        keys = np.array([self.hash(p) for p in names], dtype=np.uint64)
        if len(np.unique(keys)) < len(names):
            raise ValueError("two pieces share a hash")
        self.keys = np.append(keys, np.uint64(0))
        self.values = np.append([weights[p] * math.exp(SHIFT * len(p)) if len(p) <= SHORT else 0.0 for p in names], 0.0)
        self.tables, left = [], np.arange(len(names))
        while len(left):
            by = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
            slot = (keys[left] * by) >> np.uint64(44)
            _, first = np.unique(slot, return_index=True)
            places = np.full(1 << 20, len(names), dtype=np.int32)
            places[slot[first]] = left[first]
            self.tables.append((by, places))
            left = np.delete(left, first)

    def hash(self, piece: str) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in piece:
            h = self.add(h, np.array([ord(c)], dtype=np.uint64))
        return int(h[0])

    def add(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Hash of a string that goes on with ``c``."""
        return (h ^ (h >> np.uint64(29))) * self.mul + c + np.uint64(0x9E3779B97F4A7C15)

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of these hashes have an entry, their weights, 0 where there is none, and their places."""
        by, places = self.tables[0]
        at = places[(h * by) >> np.uint64(44)]
        hit = self.keys[at] == h
        for by, places in self.tables[1:]:
            miss = np.flatnonzero(~hit)
            other = places[(h[miss] * by) >> np.uint64(44)]
            found = self.keys[other] == h[miss]
            at[miss[found]] = other[found]
            hit[miss[found]] = True
        return hit, np.where(hit, self.values[at], 0.0), at


def two_likeliest(model: Pieces, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """For chunks by rising length: log probabilities of the best and the second best segmentation and of all but the best, and ids.

    ``codes`` has a column of characters for each. The lattice passes of ``likeliest`` for all at once, aligned at their ends, with the two best paths from each
    position. Ids come flat, with their number per chunk; the second has none where it is rarely drawn, and probability 0
    where there is none."""
    n, size = codes.shape
    n_bytes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    spelled = np.exp(n_bytes * math.log(model.per_byte) + SHIFT)
    mass, h1, h2 = (np.zeros((n + 1, size)) for _ in range(3))
    mass[n] = h1[n] = 1.0
    e1, e2, r2 = (np.zeros((n, size), dtype=np.int8) for _ in range(3))
    g1, g2 = (np.zeros((n, size), dtype=np.int32) for _ in range(2))
    for i in range(n - 1, -1, -1):
        alive = np.arange(np.searchsorted(sizes, n - i), size)
        h = np.zeros(len(alive), dtype=np.uint64)
        for j in range(i + 1, min(n, i + model.longest) + 1):
            h = model.table.add(h, codes[j - 1][alive])
            hit, w, place = model.table.get(h)
            if j == i + 1:
                by_bytes = w == 0
                piece = np.where(by_bytes, model.spell[np.minimum(codes[i, alive], 128).astype(np.int64)], model.table.ids[place])
                w = np.where(by_bytes, spelled[i, alive], w)
                mass[i, alive], h1[i, alive], h2[i, alive] = w * mass[j, alive], w * h1[j, alive], w * h2[j, alive]
                e1[i, alive], e2[i, alive], r2[i, alive], g1[i, alive], g2[i, alive] = j, j, 1, piece, piece
            else:
                some = np.flatnonzero(w)
                if len(some):
                    at, v, piece = alive[some], w[some], model.table.ids[place[some]]
                    mass[i, at] += v * mass[j, at]
                    c1, c2, a1, a2 = v * h1[j, at], v * h2[j, at], h1[i, at], h2[i, at]
                    first = c1 > a1
                    kept, late = first & (a1 >= c2), ~first & (c1 > a2)
                    change = np.flatnonzero(first | late)
                    if len(change):
                        at, c1, c2, a1, piece, first, kept = at[change], c1[change], c2[change], a1[change], piece[change], first[change], kept[change]
                        e2[i, at] = np.where(kept, e1[i, at], j)
                        g2[i, at] = np.where(kept, g1[i, at], piece)
                        r2[i, at] = first & ~kept
                        h2[i, at] = np.where(kept, a1, np.where(first, c2, c1))
                        up = at[first]
                        h1[i, up], e1[i, up], g1[i, up] = c1[first], j, piece[first]
            if not hit.all():
                alive, h = alive[hit], h[hit]
                if not len(alive):
                    break
    start, every = n - sizes, np.arange(size)

    def follow(chosen: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray]:
        at, pos, rank = chosen, start[chosen], np.full(len(chosen), second)
        who, what = [], []
        while len(at):
            who.append(at)
            what.append(np.where(rank, g2[pos, at], g1[pos, at]))
            after = np.where(rank, e2[pos, at], e1[pos, at]).astype(np.int64)
            rank = rank & (r2[pos, at] == 1)
            on = after < n
            at, pos, rank = at[on], after[on], rank[on]
        order = np.argsort(np.concatenate(who) if who else chosen, kind="stable")
        return (np.concatenate(what)[order] if what else np.zeros(0, dtype=np.int32)), np.bincount(np.concatenate(who), minlength=size) if who else np.zeros(size, dtype=np.int64)

    total, best, other = mass[start, every], h1[start, every], h2[start, every]
    top, share = np.minimum(0.0, np.log(best / total)), other / total
    ids1, n1 = follow(every, False)
    ids2, n2 = follow(np.flatnonzero(share > 1e-6), True)
    with np.errstate(divide="ignore"):
        second = np.log(share)
        # a difference from 1; exact through the second where that is tiny
        gone = np.where(second > -np.inf, np.maximum(np.log(-np.expm1(top)), second), -np.inf)
    return top, second, gone, ids1, n1, ids2, n2


class Store:
    """Best and second best segmentations of chunks, in arrays, and the log probability of all but the best. A chunk's row is found
    by its 64-bit hash."""

    def __init__(self):
        self.key, self.sorted = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.top, self.second, self.gone = np.zeros(0), np.zeros(0), np.zeros(0)
        self.at1, self.n1, self.at2, self.n2, self.uses, self.place = (np.zeros(0, dtype=np.int64) for _ in range(6))
        self.ids = np.zeros(0, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of these chunks, -1 for those not here."""
        if not len(self.key):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.place[at], -1)

    def add(self, key: np.ndarray, top: np.ndarray, second: np.ndarray, gone: np.ndarray, ids1: np.ndarray, n1: np.ndarray, ids2: np.ndarray, n2: np.ndarray) -> None:
        base, here = len(self.top), len(self.ids)
        order = np.argsort(key, kind="stable")
        at = np.searchsorted(self.sorted, key[order])
        self.sorted, self.place = np.insert(self.sorted, at, key[order]), np.insert(self.place, at, base + order)
        starts = lambda n, off: off + np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
        join = lambda a, b: np.concatenate((a, b))
        self.key = join(self.key, key)
        self.at1, self.at2 = join(self.at1, starts(n1, here)), join(self.at2, starts(n2, here + len(ids1)))
        self.n1, self.n2, self.uses = join(self.n1, n1), join(self.n2, n2), join(self.uses, np.zeros(len(key), dtype=np.int64))
        self.top, self.second, self.gone = join(self.top, top), join(self.second, second), join(self.gone, gone)
        self.ids = np.concatenate((self.ids, ids1, ids2)).astype(np.int32)

    def gather(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of stretches (at, n), one after the other."""
        ends = np.cumsum(n)
        return self.ids[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def trim(self, most: int) -> bool:
        """Beyond ``most`` chunks keep the three quarters that were used most; what goes is made again when it is needed. Whether
        rows have changed."""
        if len(self.key) <= most:
            return False
        keep, left = np.sort(np.argsort(-self.uses, kind="stable")[: most * 3 // 4]), Store()
        left.add(self.key[keep], self.top[keep], self.second[keep], self.gone[keep], self.gather(self.at1[keep], self.n1[keep]), self.n1[keep], self.gather(self.at2[keep], self.n2[keep]), self.n2[keep])
        left.uses = self.uses[keep] // 2
        self.__dict__.update(left.__dict__)
        return True


class Chunks:
    """The chunks of some normalised texts: characters, where chunks begin and end, how many each text has, and their hashes. No
    piece spans the border between another character and a space mark, so the lattice falls apart there."""

    def __init__(self, texts: list[str]):
        self.whole = "".join(texts)
        self.chars = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        mark = self.chars == ord(SPACE)
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[(ends - sizes)[sizes > 0]] = True
        self.first = np.flatnonzero(begins)
        self.last = np.append(self.first[1:], len(self.chars))[: len(self.first)]
        self.counts = np.diff(np.searchsorted(self.first, np.concatenate(([0], ends))))
        self.keys = hashes(self.chars.view(np.uint8), 4 * self.first, 4 * self.last)

    def name(self, i: int) -> str:
        return self.whole[self.first[i] : self.last[i]]


class Pieces:
    """A SentencePiece model: piece costs, chunk distributions, and the library's own encoder and decoder."""

    def __init__(self, path: str, piece: float = PIECE, rank: float = RANK):
        import sentencepiece

        gc.set_threshold(200_000, 50, 1000)  # what is kept holds no cycles; frequent collections only walk over it

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weights, self.ids, self.bytes = {}, {}, {}
        for i in range(self.lib.get_piece_size()):
            p = self.lib.id_to_piece(i)
            if self.lib.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i)):
                self.ids[p] = i
                self.weights[p] = math.exp(-piece - rank * math.log1p(max(0.0, min(-self.lib.get_score(i), 1e6))))
        self.longest = max(map(len, self.ids))
        for p in self.ids:  # 0: begins a piece, is none; what begins none has no entry
            for i in range(1, len(p)):
                self.weights.setdefault(p[:i], 0.0)
        self.per_byte = math.exp(-piece)
        self.table = Table(self.weights, self.ids)
        self.store, self.spans = Store(), None
        self.spell = np.array([*[self.bytes.get(b, -1) for b in range(128)], -1], dtype=np.int32)
        self.unknown = self.lib.unk_id()
        self.lengths = {i: len(p) for p, i in self.ids.items()}
        self.lattices: dict[int, Lattice] = {}

    def byte_ids(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode("utf-8", "replace")) if self.bytes else (self.unknown,)

    def byte_weight(self, char: str) -> float:
        return self.per_byte ** len(char.encode("utf-8", "replace"))

    def piece_ids(self, text: str, i: int, j: int) -> tuple[int, ...]:
        got = self.ids.get(text[i:j])
        return (got,) if got is not None else self.byte_ids(text[i])

    def arcs(self, text: str, i: int) -> list[tuple[float, int]]:
        """Log weight and end of each piece from ``i`` on; characters that are no piece go by their bytes."""
        out = []
        for j in range(i + 1, len(text) + 1):
            w = self.weights.get(text[i:j])
            if w is None:
                break
            if w:
                out.append((math.log(w), j))
        if not self.weights.get(text[i]):
            out.append((math.log(self.byte_weight(text[i])), i + 1))
        return out

    def ends(self, text: str, ids: list[int]) -> tuple[int, ...]:
        """The path through a chunk that these ids stand for."""
        out, i, at = [], 0, 0
        while i < len(text):
            if ids[at] in self.lengths:
                i, at = i + self.lengths[ids[at]], at + 1
            else:
                i, at = i + 1, at + len(self.byte_ids(text[i]))
            out.append(i)
        return tuple(out)

    def prepared(self, texts: list[str]) -> Chunks:
        """The normalised texts' chunks, with the space mark that the model puts before a text."""
        return Chunks([self.lib.normalize(t).replace(" ", SPACE) if t else "" for t in texts])

    def located(self, chunks: Chunks) -> np.ndarray:
        """Rows in the store of some texts' chunks; those not known yet are decoded, the short ones together."""
        keys, at, back = np.unique(chunks.keys, return_index=True, return_inverse=True)
        new = at[self.store.find(keys) < 0]
        if len(new):
            self._decode(chunks, new)
        return self.store.find(keys)[back]

    def _decode(self, chunks: Chunks, new: np.ndarray) -> None:
        sizes = chunks.last[new] - chunks.first[new]
        order = np.argsort(sizes, kind="stable")
        new, sizes = new[order], sizes[order]
        short, single = int(np.searchsorted(sizes, SHORT + 1)), []
        for a in range(0, short, 30_000):
            part, size = new[a : min(a + 30_000, short)], sizes[a : min(a + 30_000, short)]
            back = np.arange(-int(size[-1]), 0)[:, None]
            codes = np.where(back >= -size, chunks.chars[np.maximum(chunks.last[part] + back, 0)], 0).astype(np.uint64)
            got = two_likeliest(self, codes, size)
            odd = np.zeros(len(part), dtype=bool)  # has characters that several bytes spell
            for ids, n in ((got[3], got[4]), (got[5], got[6])):
                odd[np.repeat(np.arange(len(part)), n)[ids < 0]] = True
            single += part[odd].tolist()
            if odd.any():
                keep1, keep2 = np.repeat(~odd, got[4]), np.repeat(~odd, got[6])
                got = (got[0][~odd], got[1][~odd], got[2][~odd], got[3][keep1], got[4][~odd], got[5][keep2], got[6][~odd])
                part = part[~odd]
            self.store.add(chunks.keys[part], *got)
        single += new[short:].tolist()
        if single:
            tops, ids, gone = [], [], []
            for i in single:
                name = chunks.name(i)
                top, best = likeliest(self, name)
                lattice = Lattice(self, name)
                lattice.paths[0] = self.ends(name, list(best))
                tops.append(top)
                ids.append(best)
                gone.append(lattice.rest([0]))
            none = np.zeros(len(single), dtype=np.int64)
            self.store.add(chunks.keys[single], np.array(tops), np.full(len(single), np.nan), np.array(gone), np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32), np.array([len(x) for x in ids]), none[:0].astype(np.int32), none)

    def sample(self, text: str, k: int, key: object, seed: int = SEED) -> list[tuple[np.ndarray, float, float, float]]:
        """``k`` distinct segmentations of one text; see ``sample_many``."""
        return self.sample_many([text], np.array([seeded(seed, key)], dtype=np.uint64), k)[0]

    def sample_many(self, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text ``k`` distinct segmentations (fewer where there are not so many) by Gumbel top-k without replacement.

        A* over regions of the space of segmentations, each with the greatest perturbed log probability in it as its exact
        bound. The whole space draws a Gumbel; popping a region draws its best member from the lattice, and splits the rest
        by the first chunk that differs; the parts' maxima are Gumbels of their mass, truncated at the popped value. Each
        result has ids, log probability, perturbed value and inclusion score: the probability to pass the (k+1)-th value.
        Texts of like length go together, in arrays; a text's random numbers follow from its seed alone.
        """
        chunks = self.prepared(texts)
        rows, sizes = self.located(chunks), chunks.counts
        self.store.uses += np.bincount(rows, minlength=len(self.store.uses))
        starts = np.cumsum(sizes) - sizes
        out: list = [[] for _ in texts]
        for i in np.flatnonzero(sizes == 0).tolist() if k > 0 else ():
            out[i] = [(np.zeros(0, dtype=np.int32), 0.0, float(-np.log(-np.log(_uniform(seeds[i : i + 1], 0, 1)))[0, 0]), 1.0)]
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        end = len(order)
        while end and k > 0:
            begin = max(0, end - max(1, CELLS // int(sizes[order[end - 1]])))
            part = order[begin:end]
            for i, got in zip(part.tolist(), self._sampled_group(chunks, rows, starts[part], sizes[part], seeds[part], k), strict=True):
                out[i] = got
            end = begin
        return out

    def _sampled_group(self, chunks: Chunks, rows: np.ndarray, starts: np.ndarray, n: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        store, size, width = self.store, len(n), int(n.max())
        col, every = np.arange(width), np.arange(size)
        mask = col < n[:, None]
        row = np.where(mask, rows[np.minimum(starts[:, None] + col, len(rows) - 1)], 0)
        top = np.where(mask, store.top[row], 0.0)
        two = mask & (store.n2[row] > 0)
        second = np.where(two, store.second[row], -np.inf)
        gone = np.where(mask, store.gone[row], -np.inf)
        top_p = np.exp(top)
        both_p = top_p + np.exp(second)
        lattices = self.lattices

        def lattice(r: int, c: int) -> Lattice:
            at = int(row[r, c])
            got = lattices.get(at)
            if got is None:
                got = lattices[at] = Lattice(self, chunks.name(starts[r] + c), at)
            return got

        # a region: picks before ``at`` are those of an earlier result; at ``at`` those in ``taken`` are out; free after it
        value = -np.log(-np.log(_uniform(seeds, 0, 1)))[:, 0]
        queues: list[list[tuple]] = [[(-v, 0, -1, 0, frozenset())] for v in value.tolist()]
        history: list[np.ndarray] = []
        results: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        pushed = 0
        for t in range(k):
            live = np.array([bool(q) for q in queues])
            if not live.any():
                break
            at, base, taken = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), {}
            for r in np.flatnonzero(live).tolist():
                v, _, b, a, out = heapq.heappop(queues[r])
                value[r], base[r], at[r] = -v, b, a
                if out:
                    taken[r] = out
            u = _uniform(seeds, 2 * t + 1, width)
            free = col >= at[:, None]
            picks = ((u > top_p) & two).astype(np.int32)
            if history:
                picks = np.where(free, picks, np.stack(history)[base, every])
            deep = (u > both_p) & free & live[:, None]
            for r in taken:
                deep[r, at[r]] = False
            known = []
            for r, c in zip(*(x.tolist() for x in np.nonzero(deep)), strict=True):
                got = lattice(r, c).draw((0, 1) if two[r, c] else (0,), u[r, c])
                picks[r, c] = got if got is not None else int(two[r, c])  # None: a rounded probability promised more than there is
            for r, out in taken.items():
                c = at[r]
                if out == {0} and two[r, c] and u[r, c] < math.exp(second[r, c] - gone[r, c]):
                    picks[r, c] = 1
                else:
                    got = lattice(r, c).draw({0, 1} if out == {0} and two[r, c] else out, u[r, c])
                    if got is None:
                        got = 1 if out == {0} and two[r, c] else -1
                    if got < 0:  # nothing left: such a region has no mass and is not pushed
                        live[r] = False
                        continue
                    picks[r, c] = got
                known.append((r, c, out | {int(picks[r, c])}))
            moved = np.nonzero(picks)
            logs = top.copy()
            logs[moved] = second[moved]
            for r, c in zip(*(x.tolist() for x in np.nonzero(picks > 1)), strict=True):
                found = lattice(r, c)
                logs[r, c] = found.log(found.paths[int(picks[r, c])])
            history.append(picks)
            prefix = np.zeros((size, width + 1))
            np.cumsum(logs, axis=1, out=prefix[:, 1:])
            results.append((live, picks, prefix[:, -1], value.copy()))
            # the rest of each region, by the first chunk that differs from what was found
            left = gone.copy()
            left[moved] = np.log(-np.expm1(logs[moved]))
            for r, c, out in known:
                rest = 1.0 - both_p[r, c] if out == {0, 1} and two[r, c] else 0.0
                left[r, c] = math.log(rest) if rest > 1e-6 else lattice(r, c).rest(out)
            open_ = free & mask & live[:, None] & (left > -600)
            with np.errstate(invalid="ignore"):
                g = np.where(open_, prefix[:, :-1] + left - np.log(-np.log(_uniform(seeds, 2 * t + 2, width))), -np.inf)
            # truncated at the region's value, which keeps their order; only the k - t greatest can still be popped or be the next
            best = np.argpartition(-g, k - t, axis=1)[:, : k - t] if width > k - t else np.broadcast_to(col, (size, width))
            chosen = -np.logaddexp(-np.maximum(value, -700.0)[:, None], -np.take_along_axis(g, best, axis=1))
            for r, cs, vs in zip(every.tolist(), best.tolist(), chosen.tolist(), strict=True):
                for c, v in zip(cs, vs, strict=True):
                    if v > -math.inf:
                        pushed += 1
                        one = frozenset((int(picks[r, c]),))
                        heapq.heappush(queues[r], (-v, pushed, t, c, taken[r] | one if r in taken and c == at[r] else one))
        kappa = [-q[0][0] if q else -math.inf for q in queues]
        found_of: list[list] = [[] for _ in range(size)]
        for live, picks, log_prob, v in results:
            is_second = picks == 1
            start, count = np.where(is_second, store.at2[row], store.at1[row]), np.where(mask & live[:, None], np.where(is_second, store.n2[row], store.n1[row]), 0)
            pool, extra = store.ids, []
            extra_at = len(pool)
            for r, c in zip(*(x.tolist() for x in np.nonzero((picks > 1) & live[:, None])), strict=True):
                ids = lattice(r, c).ids(int(picks[r, c]))
                start[r, c], count[r, c] = extra_at, len(ids)
                extra_at += len(ids)
                extra += ids
            if extra:
                pool = np.concatenate((pool, np.array(extra, dtype=np.int32)))
            a, m = start[mask], count[mask]
            ends = np.cumsum(m)
            flat = pool[np.repeat(a - ends + m, m) + np.arange(ends[-1] if len(ends) else 0)]
            cuts = np.cumsum(count.sum(axis=1))
            for r, ids in enumerate(np.split(flat, cuts[:-1])):
                if live[r]:
                    score = 1.0 if kappa[r] == -math.inf else -math.expm1(-math.exp(min(50.0, log_prob[r] - kappa[r])))
                    found_of[r].append((ids, float(log_prob[r]), float(v[r]), score))
        return found_of

    def encode(self, text: str) -> list[int]:
        return self.lib.encode(text)

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)

    def spelled_out(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """What ``decode`` gives for each of the stretches of ``ids`` that texts have: the pieces' bytes, without the mark put before."""
        if self.spans is None:
            raw = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.lib.id_to_piece, range(self.lib.get_piece_size())))]
            n = np.array([len(x) for x in raw], dtype=np.int64)
            self.spans = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(n) - n, n
        data, n = self.spans[0], self.spans[2][ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = bytearray()
        for i in range(0, len(ids), SPELLED):  # eight bytes of places for each byte of text, so not for all at once
            part, sizes_of = ids[i : i + SPELLED], n[i : i + SPELLED]
            flat += data[np.repeat(self.spans[1][part] - ends[i : i + len(part)] + ends[i], sizes_of) + np.arange(sizes_of.sum())].tobytes()
        cuts = ends[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        texts = [flat[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
        return [t[1:] if t[:1] == " " else t for t in texts]


def seeded(seed: int, key: object) -> int:
    """A row's random numbers follow from this, made of seed and key alone."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


def _uniform(seeds: np.ndarray, stream: int, width: int) -> np.ndarray:
    """Uniform numbers in (0, 1), a row for each seed."""
    x = seeds[:, None] + (np.arange(width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(stream * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))[None, :]
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    """The worker's model of a file; one for each process."""
    return Pieces(path)


def sample_segmentations(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", k: int = SAMPLES, seed: int = SEED, decode: bool = True) -> DataFrame:
    """One row for each document and segmentation: ``key``, sample (1 ..), ids, log_prob, perturbed, inclusion, decoded.

    Whole texts are segmented, in the order of descending perturbed log probability; ``decoded`` is the text that the ids
    give back (null with ``decode`` false). Null and empty texts have one segmentation, without ids, log_prob 0 and
    inclusion 1. Equal keys with equal texts get equal samples. Nothing is shuffled; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema[key], *[T.StructField(n, t) for n, t in (("sample", T.IntegerType()), ("ids", T.ArrayType(T.IntegerType())), ("log_prob", T.DoubleType()), ("perturbed", T.DoubleType()), ("inclusion", T.DoubleType()), ("decoded", T.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Pieces(path)
            for part in _together(batch):
                yield _sampled(model, part, k, seed, decode)

    return docs.select(key, text).mapInArrow(tidied(run), schema)


def _sampled(model: Pieces, part: pa.RecordBatch, k: int, seed: int, decode: bool) -> pa.RecordBatch:
    """Samples of some rows (key, text), as columns."""
    keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
    at, numbers, ids, facts = [], [], [], []
    seeds = np.array([seeded(seed, row_key) for row_key in keys], dtype=np.uint64)
    for row, got in enumerate(model.sample_many([t or "" for t in texts], seeds, k)):
        for i, (found, *rest) in enumerate(got, 1):
            at.append(row)
            numbers.append(i)
            ids.append(found)
            facts.append(rest)
    if model.store.trim(KEPT) or len(model.lattices) > KEPT_LATTICES:  # between texts only, as codes and rows hold within one
        model.lattices.clear()
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    whole = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    decoded = model.spelled_out(whole, sizes) if decode else [None] * len(ids)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    numeric = [pa.array([f[j] for f in facts], type=pa.float64()) for j in range(3)]
    columns = [part.column(0).take(pa.array(at, type=pa.int64())), pa.array(numbers, type=pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(whole, type=pa.int32())), *numeric, pa.array(decoded, type=pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[part.schema.names[0], "sample", "ids", "log_prob", "perturbed", "inclusion", "decoded"])


def _together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about TOGETHER bytes of text, in which a longer text is on its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > TOGETHER:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the model's own encoding of each text; null texts encode to no pieces."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(path)
        for texts in batches:
            yield pd.Series([np.array(model.encode(t), dtype=np.int32) for t in texts.fillna("")])

    return docs.withColumn(out, encoded(F.col(text)))


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that each array of ids stands for; null arrays decode to the empty text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(path)
        for arrays in batches:
            yield pd.Series([model.decode([int(i) for i in a]) if a is not None else "" for a in arrays])

    return df.withColumn(out, decoded(F.col(ids)))
