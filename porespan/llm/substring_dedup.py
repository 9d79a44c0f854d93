"""Repeated passages by collinear chaining of shared k-mer seeds (operator 3)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied
from .words import _LOWER, _MIX, as_bytes, hashes, mix, spans, windows

#: Words in a seed, and neighbouring seeds of which the least hash is kept: any K + WINDOW - 1 equal words share a seed.
K, WINDOW = 5, 4
#: The same of long seeds, which link what several documents hold in pieces: any 50 equal words share one.
LONG, LONG_WINDOW = 30, 21
#: A passage counts from so many words on, with this share of words equal.
LEAST, ALIKE = 50, 0.8
#: A chain earns K for each seed and pays GAP for each word between seeds, on either side; SLIP for each by which they differ.
GAP, SLIP = 0.05, 0.2
#: Context words fetched on either side of a chain; the alignment's drop-off.
CONTEXT, DROP = 80, 12
NEARBY = 32
#: Bytes of text in a block of documents and seeds in a bucket: what a worker holds at a time. Tasks hold several beyond MOST_TASKS.
BLOCK_BYTES, BUCKET_SEEDS, MOST_TASKS = 4 << 20, 1 << 19, 20_000
#: Blocks in a pile, which is moved as one, at most; a block's seeds go to so many buckets before piles have more than one.
PILE, FEW_BUCKETS = 16, 256
#: Rows of a packed table; bytes of a word of text with its share of blanks; bytes of text that are compressed together.
PACKED, WORD_BYTES, TEXT_BYTES = 1 << 16, 6, 32 << 20
#: What a worker works on at a time, so that arrays in between stay small: bytes of a block's texts, seeds of a bucket, answers or chains.
TEXT_PART, SEED_PART, ROW_PART = 1 << 19, 1 << 16, 1 << 10
_SPANS = re.compile(r"[^\x20\x09-\x0D]+").finditer


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """The place of the least of each ``window`` neighbours, the first one of equals."""
    at, width = np.arange(len(h)), 1
    while width < window and len(at):
        step = min(width, window - width)
        a, b = at[:-step], at[step:]
        at, width = np.where(h[a] <= h[b], a, b), width + step
    return at


def seeds(codes: np.ndarray, edges: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places among all words and texts of the seeds kept of texts that begin at ``edges`` (the last one: the end): short ones,
    their last bit 0, and long ones, their last bit 1."""
    of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    left = edges[1:][of] - np.arange(len(codes))
    n = max(len(codes) - k + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = mix(h * _MIX + codes[i : n + i])
    least = _least(h, window)
    few = [edges[i] + h[edges[i] : edges[i + 1] - k + 1].argmin() for i in np.flatnonzero((np.diff(edges) >= k) & (np.diff(edges) < k + window - 1)).tolist()]
    at = np.unique(np.concatenate((least[left[: len(least)] >= k + window - 1], np.array(few, dtype=np.int64))))
    h = h[at]
    # a seed that comes again nearby also carries its count, so that runs of one seed match in step
    order = np.lexsort((h, of[at]))
    start = np.flatnonzero(np.concatenate(([True], (np.diff(of[at][order]) != 0) | (np.diff(h[order]) != 0) | (np.diff(at[order]) > NEARBY)))[: len(h)])
    again = np.empty(len(h), dtype=np.int64)
    again[order] = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    more = again > 0
    found = [(h & ~np.uint64(1), at), (mix(h[more] * _MIX + again[more].astype(np.uint64)) & ~np.uint64(1), at[more])]
    h = windows(codes, LONG)
    least = _least(h, LONG_WINDOW)
    at = np.unique(least[left[: len(least)] >= LEAST])
    found.append((h[at] | np.uint64(1), at))
    h, at = (np.concatenate(c) for c in zip(*found, strict=True))
    return h, at, of[at]


_pack, _unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress


def packed(*columns: np.ndarray) -> Iterator[bytes]:
    """Integer columns as compressed bytes, each as it is or by its differences, in the least width that its range needs; at most
    PACKED rows together."""
    for a in range(0, len(columns[0]), PACKED):
        parts = [c[a : a + PACKED].astype(np.int64) for c in columns]
        out = [np.array([len(parts[0])], dtype=np.int64)]
        for c in parts:
            best = None
            for steps, v in ((0, c), (1, np.diff(c, prepend=c[0]))):
                low = int(v.min())
                reach = int(v.max()) - low
                width = next(w for w in (1, 2, 4, 8) if reach < 1 << 8 * w)
                if best is None or width < best[2]:
                    best = (steps, 0 if width == 8 else low, width, v)
            steps, low, width, v = best
            out += [np.array([int(c[0]), steps, low, width], dtype=np.int64), (v - low).astype(f"{'i' if width == 8 else 'u'}{width}")]
        yield _pack(b"".join(x.tobytes() for x in out))


def unpacked(data: bytes) -> list[np.ndarray]:
    data = _unpack(data)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    while at < len(data):
        first, steps, low, width = np.frombuffer(data, np.int64, 4, at).tolist()
        column = np.frombuffer(data, f"{'i' if width == 8 else 'u'}{width}", n, at + 32).astype(np.int64) + low
        out.append(np.cumsum(column) + first if steps else column)
        at += 32 + n * width
    return out


TEXTS = "pile int, kind int, blob binary"


def _text_tables(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]], size: int) -> pa.RecordBatch:
    block, key, text_hash = (np.concatenate(c) for c in list(zip(*held, strict=True))[:3])
    raw = [t for h in held for t in h[3]]
    heads, out = np.stack([block, key, text_hash, np.array([len(memoryview(t)) for t in raw])]).astype(np.int64), []
    for pile, at in _cut(block // size):
        out.append((pile, 0, _pack(np.array([len(at)], dtype=np.int64).tobytes() + heads[:, at].tobytes() + b"".join([raw[i] for i in at.tolist()]))))
    return _rows(TEXTS, list(zip(*out, strict=True)))


def _text_blobs(size: int):
    """Rows ``(block, id, text_hash, _text)`` as compressed tables for piles of ``size`` blocks, of TEXT_BYTES of text together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                raw = [t.as_buffer() if t.is_valid else b"" for t in batch.column(3)]
                held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), raw))
                n += sum(len(memoryview(t)) for t in raw)
            if n >= TEXT_BYTES:
                yield _text_tables(held, size)
                held, n = [], 0
        if held:
            yield _text_tables(held, size)

    return run


def _cut(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``by`` with its places."""
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    for at in np.split(order, cuts) if len(by) else ():
        yield int(by[at[0]]), at


def _texts_of(blobs: list[bytes]) -> dict[int, dict[int, tuple[int, memoryview]]]:
    """Compressed tables by block and id: ``(text_hash, text)``, of unlike texts under one id the one with the least hash."""
    out: dict[int, dict[int, tuple[int, memoryview]]] = {}
    for blob in blobs:
        data = memoryview(_unpack(blob))
        n = int(np.frombuffer(data, np.int64, 1)[0])
        at = 8 + 32 * n
        for block, key, text_hash, size in zip(*np.frombuffer(data, np.int64, 4 * n, 8).reshape(4, n).tolist(), strict=True):
            texts = out.setdefault(block, {})
            if key not in texts or text_hash < texts[key][0]:
                texts[key] = (text_hash, data[at : at + size])
            at += size
    return out


def _words_of(texts: dict[int, tuple[int, memoryview]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every TEXT_PART bytes of a block's whole texts: their ids, ascending, the codes of all words, and of each text its first word
    among these (the last one: the end)."""

    def words(keys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = as_bytes(b"\n".join([texts[key][1] for key in keys]))
        begin, end = spans(data)
        edges = np.searchsorted(begin, np.cumsum([0, *(len(texts[key][1]) + 1 for key in keys)]))
        return np.array(keys, dtype=np.int64), hashes(_LOWER[data], begin, end), edges

    held, n = [], 0
    for key in sorted(texts):
        held.append(key)
        n += len(texts[key][1])
        if n >= TEXT_PART:
            yield words(held)
            held, n = [], 0
    if held:
        yield words(held)


def together(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def meet(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Match each place of a seed to the first document that has the seed, and to the last one before its own.

    Returns the order by seed, document and place, in that order the places of the first documents, and the matches: a place, and
    the place that it meets. A document meets another one's first place where that is the first, else its last."""
    order = np.lexsort((pos, doc, h))
    h, doc = h[order], doc[order]
    n = np.arange(len(h))
    new = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
    holder = new | np.concatenate(([True], doc[1:] != doc[:-1]))[: len(h)]
    first, begin = np.maximum.accumulate(np.where(new, n, 0)), np.maximum.accumulate(np.where(holder, n, 0))
    own = doc == doc[first]
    me = np.flatnonzero(~own)
    before = begin[me] - 1
    two = doc[before] != doc[first[me]]
    return order, np.flatnonzero(own), np.concatenate((me, me[two])), np.concatenate((first[me], before[two]))


def _holders(h: np.ndarray, doc: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    """How many documents hold each place's seed, the places sorted by seed and document; each stands for ``more`` further ones."""
    new = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
    held = new | np.concatenate(([True], doc[1:] != doc[:-1]))[: len(h)]
    group = np.cumsum(new) - 1
    return np.bincount(group, weights=held * (1 + more))[group].astype(np.int64)


def _matches(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, me: np.ndarray, it: np.ndarray) -> list[np.ndarray]:
    """Rows (document, other, place, place there less place) of matches; a long seed matches at both ends."""
    rows = [doc[me], doc[it], pos[me], pos[it] - pos[me]]
    far = np.flatnonzero(h[me] & 1)
    return [np.concatenate((c, c[far] + (LONG - K if i == 2 else 0))) for i, c in enumerate(rows)]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Rows by their value in the first column, which they are sorted by, and whether that value is a new one."""
    last = None
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)] if len(values) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield last is None or values[a] != last, batch.slice(a, b - a)
            last = values[a]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Each value of the first column with all its rows."""
    held: list[pa.RecordBatch] = []
    for new, part in _stretches(batches):
        if new and held:
            yield held[0].column(0)[0].as_py(), held
            held = []
        held.append(part)
    if held:
        yield held[0].column(0)[0].as_py(), held


def _rows(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "byte": pa.int8(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


BLOBS = "dest int, src int, kind byte, blob binary"
MATCHES = "pile int, kind byte, blob binary"


def _by_bucket(h: np.ndarray, n_buckets: int, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each bucket of hashes begins in the columns (the last one: the end), and the columns in that order."""
    bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.searchsorted(bucket[order], np.arange(n_buckets + 1)), [c[order] for c in columns]


def _sent(pile: int, n_buckets: int, own: list[tuple[int, bytes]], blocks: list[tuple[np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """A pile's rows: tables that come back to it as they are, by kind, and what its blocks send to each bucket, as one table."""
    out = [(pile % n_buckets, pile, kind, blob) for kind, blob in own]
    for bucket in range(n_buckets):
        parts = [[c[edges[bucket] : edges[bucket + 1]] for c in columns] for edges, columns in blocks if edges[bucket] < edges[bucket + 1]]
        if parts:
            out += [(bucket, pile, 0, blob) for blob in packed(*together(parts))]
        if len(out) >= 1024:
            yield _rows(BLOBS, list(zip(*out, strict=True)))
            out = []
    if out:
        yield _rows(BLOBS, list(zip(*out, strict=True)))


def _seed_blobs(n_buckets: int, k: int, window: int):
    """From texts by pile to packed tables: of kind 0 the places of a seed in the first document of a block that has it, and whether
    one (1) or several others (2) of the block do, a table for each bucket of hashes; of kind 1 the blocks' own matches. So of a seed that very many documents share only one document's
    places leave a block. What lies in a block depends on keys alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pile, parts in _blocks(batches):
            texts = _texts_of([blob for part in parts for blob in part.column(2).to_pylist()])
            own, sent = [], []
            for block in sorted(texts):
                got = []
                for keys, codes, edges in _words_of(texts.pop(block)):
                    h, at, of = seeds(codes, edges, k, window)
                    got.append([h, keys[of], at - edges[of]])
                h, doc, pos = together(got)
                if not len(h):
                    continue
                order, firsts, me, it = meet(h, doc, pos)
                h, doc, pos = h[order], doc[order], pos[order]
                rows = _matches(h, doc, pos, me, it)
                order = np.lexsort((rows[2], rows[1], rows[0]))
                own += [(1, blob) for blob in packed(*(c[order] for c in rows))]
                more = np.minimum(_holders(h, doc) - 1, 2)[firsts]
                h, doc, pos = h[firsts], doc[firsts], pos[firsts]
                order = np.lexsort((pos, doc))
                h, doc, pos, more = h[order], doc[order], pos[order], more[order]
                # within a bucket 40 bits of a hash tell seeds apart; what they mix up makes no chain
                sent.append(_by_bucket(h, n_buckets, (h >> np.uint64(8)).astype(np.uint32), h.astype(np.uint8), doc, pos.astype(np.int32), more.astype(np.int8)))
            yield from _sent(pile, n_buckets, own, sent)

    return run


def _received(parts: list[pa.RecordBatch], shift: int) -> tuple[list[tuple[int, int, bytes]], list[np.ndarray]]:
    """A bucket's rows: tables that go back to their piles as they are, and columns of the others: hash, whose low ``shift`` bits are the
    second column, document, place, a further column or 0, and pile."""
    back, got = [], []
    for part in parts:
        for pile, kind, blob in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if kind:
                back.append((pile, kind - 1, blob))
            else:
                high, low, doc, pos, *more = unpacked(blob)
                more = more[0].astype(np.int8) if more else np.zeros(len(doc), dtype=np.int8)
                got.append([high << shift | low, doc, pos.astype(np.int32), more, np.full(len(doc), pile, dtype=np.int32)])
    return back, together(got) if got else []


def _by_seed(columns: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The rows of a bucket, all rows of a hash (the first column) together, in parts of about SEED_PART."""
    h = columns[0]
    n = min(128, -(-len(h) // SEED_PART))
    if n < 2:
        yield columns
        return
    part = ((h >> 1 & 127) % n).astype(np.int8)
    for i in range(n):
        at = np.flatnonzero(part == i)
        yield [c[at] for c in columns]


def _match_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match the places of a bucket's seeds between blocks; matches go, packed, to their documents' piles (kind 0), and so do the long
    seeds that several documents hold (kind 1), as such a place may not have met all of them."""
    for _, parts in _blocks(batches):
        out, got = _received(parts, 8)
        if got:
            met, shared = [], []
            for h, doc, pos, more, src in _by_seed(got):
                order, _, me, it = meet(h, doc, pos)
                h, doc, pos, src = h[order], doc[order], pos[order], src[order]
                common = np.flatnonzero((h & 1 == 1) & (_holders(h, doc, more[order]) > 1))
                shared.append([h[common], src[common]])
                met.append([*_matches(h, doc, pos, me, it), np.concatenate((src[me], src[me][(h[me] & 1) == 1]))])
            common, src = together(shared)
            for pile, at in _cut(src):
                out += [(pile, 1, blob) for blob in packed(np.unique(common[at]))]
            *rows, src = together(met)
            for pile, at in _cut(src):
                at = at[np.lexsort((rows[2][at], rows[1][at], rows[0][at]))]
                out += [(pile, 0, blob) for blob in packed(*(c[at] for c in rows))]
        if out:
            yield _rows(MATCHES, list(zip(*out, strict=True)))


CHAIN = "doc long, other long, x0 int, x1 int, y0 int, y1 int, solid byte"
#: Chains, or a pile's common seeds.
FOUND = CHAIN + ", pile int, blob binary"


def _chain_rows(k: int, least: int, alike: float):
    """Chain the matches of a pile's documents, source by source; its common seeds go on as they are."""

    def chained(doc: int, others: np.ndarray, pairs: np.ndarray) -> list[tuple]:
        cuts, mine = np.flatnonzero(np.diff(others)) + 1, []
        sure = []
        for other, part in zip(others[np.concatenate(([0], cuts))].tolist(), np.split(pairs, cuts), strict=True):
            if len(part) < 2:
                continue
            for c in chains(part, k):
                size = max(c[1] - c[0], c[3] - c[2])
                # solid: equal seeds cover every word, so the stretches are equal
                mine.append((doc, other, *c[:4], int(c[5] == size == c[1] - c[0] == c[3] - c[2])))
                # what lies in a chain whose seeds prove it a passage needs no other source
                if min(c[1] - c[0], c[3] - c[2]) >= least and c[5] >= alike * size:
                    sure.append(mine[-1])
        out, starts, ends = [], [], []
        for c in sorted(sure, key=lambda c: (c[2], -c[3], c[1])):
            if not ends or c[3] > ends[-1]:
                starts.append(c[2])
                ends.append(c[3])
                out.append(c)
        for c in mine:
            j = bisect_right(starts, c[2]) - 1
            if j < 0 or ends[j] < c[3]:
                out.append(c)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pile, parts in _blocks(batches):
            rows = [x for part in parts for x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            passed = [(*[None] * 7, pile, blob) for kind, blob in rows if kind]
            if passed:
                yield _rows(FOUND, list(zip(*passed, strict=True)))
            got = [unpacked(blob) for kind, blob in rows if not kind]
            if not got:
                continue
            doc, other, pos, there = together(got)
            there = there + pos
            order = np.lexsort((there, pos, other, doc))
            doc, other, pairs = doc[order], other[order], np.stack([pos[order], there[order]], axis=1)
            # long seeds' ends may be short seeds' places too
            once = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(other) != 0) | (np.diff(pairs, axis=0) != 0).any(axis=1)))
            doc, other, pairs = doc[once], other[once], pairs[once]
            cuts, out = np.flatnonzero(np.diff(doc)) + 1, []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
                out += chained(int(doc[a]), other[a:b], pairs[a:b])
            if out:
                yield _rows(FOUND, [*zip(*out, strict=True), [None] * len(out), [None] * len(out)])

    return run


def chains(matches: np.ndarray, k: int = K, gap: float = GAP, slip: float = SLIP) -> list[tuple[int, int, int, int, int, int]]:
    """Chain ``matches`` (rows of place here, place there, both ascending along a chain); best chains first.

    Score of a chain: k for each match, less ``gap`` for each word from match to match on both sides. That cost depends on
    x + y alone, so the best match before (x, y) is a prefix maximum over y in a Fenwick tree, in the order of x. From the
    link taken, ``slip`` is paid for each word by which the two gaps differ; a link that doesn't pay starts a new chain.
    Returns (first here, end here, first there, end there, number, words that its seeds prove equal) of disjoint chains of two
    matches or more.
    """
    m = matches[np.lexsort((-matches[:, 1], matches[:, 0]))]
    n = len(m)
    step = np.diff(m, axis=0)
    if (step[:, 0] == step[:, 1]).all() and (step[:, 0] > 0).all() and (2 * gap * step[:, 0] < k).all():  # one diagonal: each link pays
        return [(int(m[0, 0]), int(m[-1, 0]) + k, int(m[0, 1]), int(m[-1, 1]) + k, n, k + int(np.minimum(step[:, 0], k).sum()))] if n > 1 else []
    ys = sorted(set(m[:, 1].tolist()))
    low, size = -1e18, len(ys)
    tree: list[tuple[float, int]] = [(low, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    xs, yv = m[:, 0].tolist(), m[:, 1].tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # equal places here don't follow each other
            best, at = low, -1
            p = bisect_left(ys, yv[j])  # ys below this one
            while p > 0:
                if tree[p][0] > best:
                    best, at = tree[p]
                p -= p & -p
            gain = best - gap * (xs[j] + yv[j]) if at >= 0 else low
            if at >= 0:
                gain -= slip * abs((xs[j] - xs[at]) - (yv[j] - yv[at]))
            score[j], before[j] = (k + gain, at) if gain > 0 else (float(k), -1)
            j += 1
        for q in range(i, j):
            value = (score[q] + gap * (xs[q] + yv[q]), q)
            p = bisect_left(ys, yv[q]) + 1
            while p <= size:
                if value[0] > tree[p][0]:
                    tree[p] = value
                p += p & -p
        i = j
    used, out = [False] * n, []
    for e in sorted(range(n), key=lambda q: -score[q]):
        if used[e]:
            continue
        path, q = [], e
        while q >= 0 and not used[q]:
            used[q] = True
            path.append(q)
            q = before[q]
        if len(path) > 1:
            covered = k + sum(min(k, xs[a] - xs[b], yv[a] - yv[b]) for a, b in zip(path, path[1:], strict=False))
            out.append((xs[path[-1]], xs[path[0]] + k, yv[path[-1]], yv[path[0]] + k, len(path), covered))
    return out


def _extend(a: list, b: list, i: int, j: int, step: int, ends: list | None = None) -> tuple[int, int, int]:
    """Walk on from (i, j) while words mostly agree; a differing word may be replaced, put in or left out. Places after the
    last gain, and equal words on the way. ``ends`` takes the same of every equal word past it."""
    best_i, best_j, best_eq, score, best, equal = i, j, 0, 0, 0, 0
    na, nb = len(a), len(b)
    while 0 <= i < na and 0 <= j < nb and score > best - DROP:
        if a[i] == b[j]:
            i, j, score, equal = i + step, j + step, score + 1, equal + 1
            if score > best:
                best, best_i, best_j, best_eq = score, i, j, equal
            elif ends is not None:
                ends.append((i, j, equal))
            continue
        score -= 2
        for da, db in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 0), (0, 2), (2, 1), (1, 2), (3, 3), (3, 0), (0, 3)):
            x, y = i + da * step, j + db * step
            if 0 <= x < na and 0 <= y < nb and a[x] == b[y] and (not 0 <= x + step < na or not 0 <= y + step < nb or a[x + step] == b[y + step]):
                i, j, score = x, y, score - max(da, db) + 1
                break
        else:
            x, y = i + step, j + step
            if ends is not None and 0 <= x < na and 0 <= y < nb and a[x] == b[y]:  # one equal word at the very end
                ends.append((x + step, y + step, equal + 1))
            break
    if ends is not None:
        ends[:] = [(best_i, best_j, best_eq), *[e for e in ends if (e[0] - best_i) * step > 0]]
    return best_i, best_j, best_eq


def _common(a: list, b: list) -> int:
    """Longest common subsequence of two stretches, by bits: a set bit of ``row`` is a place in ``b`` that adds none."""
    if a == b:
        return len(a)
    at: dict[str, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for w in a:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def align(here: list, there: list, x0: int, x1: int, y0: int, y1: int, least: int = LEAST, alike: float = ALIKE) -> tuple[int, int, int, int, int]:
    """Align a chain's stretches and extend them at both ends: (x0, x1, y0, y1, equal words). Stretches with few changes are
    walked in step; the others are aligned in a band. Where the ends of best gain leave fewer than ``least`` words, ends
    further out are taken that reach ``least`` and keep ``alike``, the most alike ones."""
    after: list[tuple[int, int, int]] = []
    before: list[tuple[int, int, int]] = []
    ex, ey, equal = _extend(here, there, x0, y0, 1, after)
    start = 0
    if ex < x1:
        after = []
        start = _common(here[x0:x1], there[y0:y1])
        ex, ey, more = _extend(here, there, x1, y1, 1, after)
        equal = start + more
    bx, by, less = _extend(here, there, x0 - 1, y0 - 1, -1, before)
    if min(ex - bx, ey - by) <= least:
        best = alike
        for i, j, e in before:
            for x, y, f in after:
                n = max(x - i, y - j) - 1
                if min(x - i, y - j) > least and start + e + f >= best * n:
                    best, bx, by, ex, ey, equal, less = (start + e + f) / n, i, j, x, y, start + f, e
    return bx + 1, ex, by + 1, ey, equal + less


def _placed(docs: DataFrame, key: str, text: str, n_blocks: int, pile: int) -> DataFrame:
    """The rows with a key, in compressed tables ``(pile, kind 0, blob)``."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("_text"))
    rows = rows.where("id IS NOT NULL").select(_block(F.col("id"), n_blocks).alias("block"), "id", "text_hash", "_text")
    return rows.mapInArrow(tidied(_text_blobs(pile)), TEXTS)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _spread(df: DataFrame, n: int, by: str) -> DataFrame:
    return df.repartition(min(n, MOST_TASKS), F.col(by))


def _dealt(df: DataFrame, n: int, by: str, *order: str) -> DataFrame:
    """The rows by a number under ``n``, each number in a task of its own up to MOST_TASKS; by a hash several would meet in one."""
    n = min(n, MOST_TASKS)
    return df.repartitionById(n, F.col(by) % n).sortWithinPartitions(by, *order)


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, alike: float = ALIKE, k: int = K, window: int = WINDOW) -> DataFrame:
    """Passages of at least ``least`` words that a document has in common with one of a smaller key.

    ``(key, source_<key>, start_word, end_word, source_start, source_end, n_equal, similarity, text_hash)``: words ``start_word`` to
    ``end_word`` - 1 of the document, counting from 0, repeat those of the source; ``similarity`` is the share of
    equal words of the longer stretch, at least ``alike``; ``text_hash`` is the document's ``xxhash64``. Keys are longs. Every later
    copy is reported once against one earlier one, so a passage that n documents share gives n - 1 rows, and copies hang
    together through the sources; the first copy is in no row of its own. Null and short texts, null keys and repetitions inside
    one document give no rows. Of unlike texts under one key the one with the least hash is searched, the others are left alone.

    Documents lie in blocks and seeds in buckets by hashes of key and seed; their numbers follow from the bytes of all texts, and
    results depend on nothing else: not on files, partitions or task order. Blocks are moved in piles, larger ones where there are many
    buckets, so that the tables sent from each pile to each bucket don't become small and many.

    1. A block matches its own documents and sends a seed's places in the first of them to the seed's bucket, packed.
    2. A bucket matches these. Each place meets the seed's first document and the one before its own, in the block or, for the
       block's first, among all blocks' firsts: matches grow with seeds, not pairs, and a seed has a row for each block at most.
    3. Matches go back to their document's pile, and are chained per source.
    4. The words around a chain are asked of both documents' piles, whose texts still lie where the seeds were taken; the chain is
       aligned and extended.
    5. A place that meets two documents need not meet the one that goes on like it. So where documents share a long seed, every
       window of ``least`` words (LEAST at least) meets the first document that has it whole: no stretch of so many equal words is
       lost, whoever holds its pieces, and rows grow with windows, not pairs.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n_buckets = max(1, -(-size * 2 // (WORD_BYTES * window * BUCKET_SEEDS)))
    pile = min(PILE, max(1, n_buckets // FEW_BUCKETS))
    n_piles = -(-n_blocks // pile)
    texts = _spread(_placed(docs, key, text, n_blocks, pile), n_piles, "pile")
    blobs = texts.sortWithinPartitions("pile").mapInArrow(tidied(_seed_blobs(n_buckets, k, window)), BLOBS)
    matches = _dealt(blobs, n_buckets, "dest", "kind").mapInArrow(tidied(_match_blobs), MATCHES)
    found = _dealt(matches, n_piles, "pile").mapInArrow(tidied(_chain_rows(k, least, alike)), FOUND)
    return _aligned(found, texts, n_blocks, pile, n_buckets, key, least, alike)


WORDS = CHAIN + ", side int, text_hash long, words binary"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answer a pile's asks, which come after its texts and by document, with the words of a stretch, unless it is solid, and CONTEXT
    more on either side."""
    names = [f.split()[0] for f in CHAIN.split(", ")]
    texts: dict[int, tuple[int, memoryview]] = {}
    last = None
    for new, part in _stretches(batches):
        if new:
            texts, last = {}, None
        kind = part.column("kind").to_numpy(zero_copy_only=False)
        asks = kind == 2
        for found in _texts_of(part.filter(pa.array(kind == 0)).column("blob").to_pylist()).values():
            texts |= {key: t for key, t in found.items() if key not in texts or t[0] < texts[key][0]}
        asked = part.filter(pa.array(asks))
        for i in range(0, asked.num_rows, ROW_PART):
            part = asked.slice(i, ROW_PART)
            words, hashed = [], []
            for key, a, b, solid in zip(*(part.column(c).to_pylist() for c in ("id", "a", "b", "solid")), strict=True):
                text_hash, text = texts[key]
                if key != last:
                    begin, end = spans(as_bytes(text))
                    last = key
                stretch = lambda i, j: bytes(text[begin[i] : end[j - 1]]) if i < j else b""  # noqa: B023, E731
                low, high = max(0, a - CONTEXT), min(len(begin), b + CONTEXT)
                words.append(stretch(low, a) + b" " + stretch(b, high) if solid else stretch(low, high))
                hashed.append(text_hash)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*names, "side")), pa.array(hashed, type=pa.int64()), pa.array(words, type=pa.binary())], names=[*names, "side", "text_hash", "words"])


PASSAGE = "doc long, other long, a0 int, a1 int, b0 int, b1 int, n int, s double, text_hash long"


def _first(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``meet``, each place with the first document only, which has the window as well as any other one."""
    order, firsts, me, it = meet(h, doc, pos)
    others = len(h) - len(firsts)
    return order, firsts, me[:others], it[:others]


def _window_blobs(n_buckets: int, size: int):
    """Windows of ``size`` words whose own long seed is a common one, by hash: of kind 0 those of the first document of a block that has
    them, a table for each bucket; of kind 1 the blocks' own matches; of kind 2 their documents' text hashes."""

    def solved(texts: dict[int, tuple[int, memoryview]], sought: np.ndarray, table: np.ndarray) -> tuple[list[tuple[int, bytes]], tuple[np.ndarray, list[np.ndarray]]] | None:
        found = []
        for part in _words_of(texts):
            found.append(windowed(*part, sought, table))
        h, pos, doc = together(found)
        if not len(h):
            return None
        order, firsts, me, it = _first(h, doc, pos)
        h, doc, pos = h[order], doc[order], pos[order]
        rows = [doc[me], doc[it], pos[me], pos[it] - pos[me]]
        at = np.lexsort((rows[2], rows[1], rows[0]))
        own = [(1, blob) for blob in packed(*(c[at] for c in rows))]
        held = np.unique(doc)
        own += [(2, blob) for blob in packed(held, np.array([texts[d][0] for d in held.tolist()], dtype=np.int64))]
        firsts = firsts[np.lexsort((pos[firsts], doc[firsts]))]
        h = h[firsts]
        return own, _by_bucket(h, n_buckets, (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32), doc[firsts], pos[firsts].astype(np.int32))

    def windowed(keys: np.ndarray, codes: np.ndarray, edges: np.ndarray, sought: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
        long = windows(codes, LONG)
        least = _least(long, LONG_WINDOW)  # the seed that the first LEAST words of each window are found by, wherever they are
        low = ((long | np.uint64(1)) & np.uint64((1 << 40) - 1)).astype(np.int64)
        at = np.unique(least)
        at = at[table[low[at] & 0xFFFFF]]  # first by 20 bits
        common = np.zeros(len(long), dtype=bool)
        common[at[np.isin(low[at], sought)]] = True
        at = np.flatnonzero(common[least])
        of = np.searchsorted(edges, at, side="right") - 1
        whole = edges[of + 1] - at >= size
        at, of = at[whole], of[whole]
        h = windows(codes, size)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        return [h, at - edges[of], keys[of]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pile, parts in _blocks(part.select(["pile", "kind", "blob"]).filter(pc.less(part.column("kind"), 2)) for part in batches):
            of_kind = lambda k: [blob for part in parts for blob in part.filter(pc.equal(part.column(1), k)).column(2).to_pylist()]  # noqa: B023, E731
            sought = of_kind(1)
            if not sought:
                continue
            sought = np.concatenate([unpacked(blob)[0] for blob in sought])
            table = np.zeros(1 << 20, dtype=bool)
            table[sought & 0xFFFFF] = True
            texts, own, sent = _texts_of(of_kind(0)), [], []
            if not texts:
                raise RuntimeError("a pile's seeds came without its texts: the union was not spread by pile")
            for block in sorted(texts):
                got = solved(texts.pop(block), sought, table)
                if got is not None:
                    own += got[0]
                    sent.append(got[1])
            yield from _sent(pile, n_buckets, own, sent)

    return run


def _window_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match a bucket's windows between blocks, each with its first document; matches go to their documents' piles."""
    for _, parts in _blocks(batches):
        out, got = _received(parts, 32)
        if got:
            met = []
            for h, doc, pos, _, src in _by_seed(got):
                order, _, me, it = _first(h, doc, pos)
                doc, pos, src = doc[order], pos[order], src[order]
                met.append([doc[me], doc[it], pos[me], pos[it] - pos[me], src[me]])
            *rows, src = together(met)
            for pile, at in _cut(src):
                at = at[np.lexsort((rows[2][at], rows[1][at], rows[0][at]))]
                out += [(pile, 0, blob) for blob in packed(*(c[at] for c in rows))]
        if out:
            yield _rows(MATCHES, list(zip(*out, strict=True)))


def _window_runs(size: int):
    """Windows of a pile's documents that go on as their sources do, as one passage; of passages that overlap only those needed to
    cover the same words, as in a run of one word each place is one."""

    def needed(doc: list[int], begin: list[int], end: list[int]) -> Iterator[int]:
        last, reach, best = None, -1, -1
        for i in sorted(range(len(doc)), key=lambda i: (doc[i], begin[i], -end[i])):
            if best >= 0 and (doc[i] != last or begin[i] > reach):
                yield best
                reach, best = end[best], -1
            if doc[i] != last or begin[i] > reach:
                yield i
                last, reach, best = doc[i], end[i], -1
            elif end[i] > (end[best] if best >= 0 else reach):
                best = i
        if best >= 0:
            yield best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _blocks(batches):
            rows = [x for part in parts for x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            keys, text_hash = together([unpacked(blob) for kind, blob in rows if kind])
            got = [unpacked(blob) for kind, blob in rows if not kind]
            if not got:
                continue
            doc, other, pos, there = together(got)
            order = np.lexsort((pos, there, other, doc))
            doc, other, pos, there = (c[order] for c in (doc, other, pos, there))
            new = (np.diff(doc) != 0) | (np.diff(other) != 0) | (np.diff(there) != 0) | (np.diff(pos) > size)
            a = np.flatnonzero(np.concatenate(([True], new)))
            b = np.append(a[1:], len(doc)) - 1
            end = pos[b] + size
            some = np.array(list(needed(doc[a].tolist(), pos[a].tolist(), end.tolist())))
            a, end = a[some], end[some]
            order = np.argsort(keys)
            text_hash = text_hash[order][np.searchsorted(keys[order], doc[a])]
            yield _rows(PASSAGE, [doc[a], other[a], pos[a], end, pos[a] + there[a], end + there[a], end - pos[a], np.ones(len(a)), text_hash])

    return run


def _aligned(found: DataFrame, texts: DataFrame, n_blocks: int, pile: int, n_buckets: int, key: str, least: int, alike: float) -> DataFrame:
    """Fetch the words around each chain from both documents, align, and keep what is long and like enough. Asks and common seeds go to
    the piles, whose texts aren't moved again: a union of what is spread alike has each pile in one place."""
    chain = [f.split()[0] for f in CHAIN.split(", ")]
    ask = lambda side, name, a, b: F.struct(F.lit(side).alias("side"), F.col(name).alias("id"), F.col(a).alias("a"), F.col(b).alias("b"))
    asks = F.explode(F.when(F.col("blob").isNull(), F.array(ask(0, "doc", "x0", "x1"), ask(1, "other", "y0", "y1"))).otherwise(F.array(ask(0, "doc", "x0", "x1"))))
    wanted = found.select(*chain, "pile", "blob", asks.alias("q"))
    wanted = wanted.select(F.coalesce("pile", F.floor(_block(F.col("q.id"), n_blocks) / pile).cast("int")).alias("pile"), F.when(F.col("blob").isNull(), 2).otherwise(1).alias("kind"), "blob", *chain, "q.*")
    n_piles = -(-n_blocks // pile)
    both = texts.unionByName(_spread(wanted, n_piles, "pile"), allowMissingColumns=True).sortWithinPartitions("pile", "kind", "id")
    size = max(least, LEAST)
    same = _dealt(both.mapInArrow(tidied(_window_blobs(n_buckets, size)), BLOBS), n_buckets, "dest", "kind").mapInArrow(tidied(_window_matches), MATCHES)
    same = _dealt(same, n_piles, "pile").mapInArrow(tidied(_window_runs(size)), PASSAGE)
    answers = both.mapInArrow(tidied(_asked), WORDS)
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    both = answers.groupBy(*chain).agg(pick("words", 0).alias("here"), pick("words", 1).alias("there"), pick("text_hash", 0).alias("text_hash"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, ROW_PART) for batch in batches for i in range(0, batch.num_rows, ROW_PART)):
            out = []
            for doc, other, x0, x1, y0, y1, solid, here, there, text_hash in zip(*(b.column(c).to_pylist() for c in (*chain, "here", "there", "text_hash")), strict=True):
                # bytes.lower() changes A-Z alone, bytes.split() parts at ASCII white space alone
                h, t = here.lower().split(), there.lower().split()
                dx, dy = max(0, x0 - CONTEXT), max(0, y0 - CONTEXT)
                if solid:
                    h[x0 - dx : x0 - dx], t[y0 - dy : y0 - dy] = [b""] * (x1 - x0), [b""] * (x1 - x0)
                a0, a1, b0, b1, equal = align(h, t, x0 - dx, x1 - dx, y0 - dy, y1 - dy, least, alike)
                like = equal / max(a1 - a0, b1 - b0, 1)
                if a1 - a0 >= least and b1 - b0 >= least and like >= alike:
                    out.append((doc, other, a0 + dx, a1 + dx, b0 + dy, b1 + dy, equal, like, text_hash))
            if out:
                yield _rows(PASSAGE, list(zip(*out, strict=True)))

    rows = both.mapInArrow(tidied(solve), PASSAGE).unionByName(same)
    # a passage inside another one of the document is the same copy met at another source
    earlier = Window.partitionBy("doc").orderBy("a0", F.desc("a1"), "other", "b0", "b1").rowsBetween(Window.unboundedPreceding, -1)
    once = rows.distinct().withColumn("_end", F.max("a1").over(earlier)).where("_end IS NULL OR _end < a1")
    return once.select(F.col("doc").alias(key), F.col("other").alias(f"source_{key}"), F.col("a0").alias("start_word"), F.col("a1").alias("end_word"), F.col("b0").alias("source_start"), F.col("b1").alias("source_end"), F.col("n").alias("n_equal"), F.col("s").alias("similarity"), "text_hash")


def cut_passages(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their repeated passages; the first copy of each stays. Documents that are nothing but repeats
    go; those without repeats come back as they are, as do unlike texts under the same key. ``n_chars`` (where there is one) follows
    the text."""
    spans = found.groupBy(F.col(key).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))
    joined = docs.join(spans, (F.col(key).cast("long") == F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(texts, cuts, strict=True):
            if c is None or t is None or not len(c):
                out.append(t)
                continue
            at = [m.span() for m in _SPANS(t)]
            parts, last = [], 0
            for a, b in sorted((s["start_word"], s["end_word"]) for s in c):
                a, b = max(0, a), min(b, len(at))
                if a < b:
                    parts.append(t[last : at[a][0]] if at[a][0] > last else "")
                    last = max(last, at[b - 1][1])
            out.append("".join(parts) + t[last:])
        return pd.Series(out)

    kept = joined.withColumn("_new", F.when(F.col("_spans").isNull(), F.col(text)).otherwise(without(F.when(F.col("_spans").isNotNull(), F.col(text)), F.col("_spans"))))
    kept = kept.where(F.col("_spans").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    kept = kept.withColumn(text, F.col("_new"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
