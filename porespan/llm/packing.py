"""Packing documents into token sequences by linear grouping, configurations and best fit (operator 12)."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied, written

CAPACITY, END = 1024, 2
#: Lengths up to this share of a sequence are small: they are best-fit at the end.
SMALL_SHARE = 8
#: Groups of equally many large pieces; each counts as long as its longest when configurations are optimised.
GROUPS = 192
#: Characters that are encoded together; longer texts are cut before a blank that follows a letter, where no token reaches across.
CHUNK = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the
    other bytes in ascending order from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Token ids of a text, as the tokenizers library has them for the byte-level file at ``path``, without added tokens.

    Where ids number the merges in order, as they do here, the same ids come from the ranks of the vocabulary alone, several times
    faster (a test holds both together over all assigned characters); other files are left to the library."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    vocab, pairs = stated["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in stated["model"]["merges"]]
    plain = stated["pre_tokenizer"] and stated["pre_tokenizer"]["type"] == "ByteLevel" and not stated["pre_tokenizer"]["add_prefix_space"] and stated["normalizer"] is None
    if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in stated["added_tokens"]):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import public_tokenizers
    import tiktoken

    byte = byte_alphabet()
    special = {t["content"]: t["id"] for t in stated["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    ranked = tiktoken.Encoding(base64.b16encode(path.encode()).decode(), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: np.asarray(ranked.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text in chunks whose tokens are those of the whole: cuts are before a blank between two ASCII letters."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while (cut := text.find(" ", cut)) > 0 and not (text[cut - 1 : cut].isascii() and text[cut - 1 : cut].isalpha() and text[cut + 1 : cut + 2].isascii() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def token_ids(text: str | None, path: str, end: int = END, size: int = CHUNK) -> np.ndarray:
    """Ids of a whole text (null: none) and the closing id, as little-endian numbers of 32 bits."""
    encode = encoder(path)
    return np.concatenate([*(encode(c) for c in chunks(text or "", size)), [end]]).astype("<u4")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences but for the first, which has what is over."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, part, place)`` of every document; ``place`` numbers the pieces of a length within
    the task ``part`` that made them. One pass, nothing is shuffled; written once, so places stay as they are."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, place long"
    columns = ["piece", "start", "length", "ids_crc32", "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows, whose = [], []
            for i, t in enumerate(batch.column(1)):
                ids = token_ids(t.as_py(), path, end)
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, int(seen[n])))
                    whose.append(i)
                    seen[n] += 1
            made = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], [key, *columns])

    return written(docs.select(key, text).mapInArrow(tidied(run), schema), "pieces")


def best_column(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of greatest value: how often each size is in it; a knapsack by dynamic programming."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        for _ in range(capacity // s if v > 0 else 0):
            more = best[: capacity + 1 - s] + v
            better = np.flatnonzero(more > best[s:] + 1e-12) + s
            if not len(better):
                break
            best[better], last[better] = more[better - s], i
    chosen, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        chosen[last[room]] += 1
        room -= int(sizes[last[room]])
    return chosen, float(chosen @ values)


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY, rounds: int = 5000) -> list[tuple[list[int], int]]:
    """Configurations of few sizes and how many whole sequences each fills: the linear programme of least sequences, solved by
    generating columns, rounded down. ``[(how often each size, sequences)]``; what is left of the demand is less than a
    sequence for each size."""
    if not sizes:
        return []
    size, x = np.array(sizes, dtype=np.int64), np.array(demand, dtype=float)
    columns = np.diag(capacity // size).astype(float)
    inverse = np.linalg.inv(columns)
    x = inverse @ x
    for step in range(rounds):
        a, value = best_column(size, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ a
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        columns[:, r] = a
        if step % 25 == 24:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[r] / d[r]
            inverse -= np.outer(d, row)
            inverse[r] = row
        x = inverse @ np.array(demand, dtype=float)
    left, out = np.array(demand, dtype=np.int64), []
    for c in range(len(size)):
        often = columns[:, c].astype(np.int64)
        uses = often > 0
        n = min(int(np.floor(x[c] + 1e-6)), int((left[uses] // often[uses]).min()))
        if n > 0:
            left -= n * often
            out.append((often.tolist(), n))
    return out


def grouped(lengths: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Large pieces in groups of equal number, longest first: (size of the longest, [(length, first place, number)]). Groups of one
    size are joined; with no more lengths than groups every length is its own."""
    share = 1 if len(lengths) <= groups else -(-sum(lengths.values()) // groups)
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    room = 0
    for length in sorted(lengths, reverse=True):
        done, n = 0, lengths[length]
        if share == 1 or out and out[-1][0] == length:
            room = 0
        while done < n:
            if room == 0:
                if out and out[-1][0] == length:  # the same size as the group before: one group
                    room = n - done if share == 1 else min(share, n - done)
                else:
                    out.append((length, []))
                    room = n if share == 1 else share
            take = min(room, n - done)
            out[-1][1].append((length, done, take))
            done, room = done + take, room - take
    return out


def plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go: slots (length, first place, number, how many a sequence, first sequence, offset), and
    the number of sequences.

    Pieces of a length are numbered from 0; sequences with the same lengths at the same offsets make one run, so the plan's size
    depends on the lengths there can be, not on the documents.
    1. Large lengths are rounded up to the longest of their group; configurations of the few sizes are optimised.
    2. Actual pieces take the places of rounded ones, longest first.
    3. Large pieces left over and then small ones go, longest first, where they fit best; new sequences open at last."""
    slots: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    n_sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in free:
                insort(rooms, room)
            free.setdefault(room, []).append((first, n))

    large = {length: n for length, n in lengths.items() if capacity // SMALL_SHARE < length < capacity}
    if lengths.get(capacity):
        slots.append((capacity, 0, lengths[capacity], 1, 0, 0))
        n_sequences = lengths[capacity]
    streams = grouped(large, groups)
    for often, n in configurations([s for s, _ in streams], [sum(t[2] for t in members) for _, members in streams], capacity):
        taken = [take(streams[g][1], n) for g, times in enumerate(often) for _ in range(times)]
        ends = sorted({e for t in taken for e in np.cumsum([x[2] for x in t]).tolist()})
        at, where, start = [0] * len(taken), [0] * len(taken), 0
        for end in ends:
            offset = 0
            for i, t in enumerate(taken):
                length, first, number = t[at[i]]
                slots.append((length, first + where[i], end - start, 1, n_sequences + start, offset))
                offset += length
                where[i] += end - start
                if where[i] == number:
                    at[i], where[i] = at[i] + 1, 0
            leave(capacity - offset, n_sequences + start, end - start)
            start = end
        n_sequences += n
    rest = [t for _, members in streams for t in members] + [(length, 0, n) for length, n in lengths.items() if length <= capacity // SMALL_SHARE]
    for length, first, n in sorted(rest, key=lambda t: (-t[0], t[1])):
        def fill(sequence: int, number: int, room: int, length: int = length) -> None:
            """Put the next pieces into ``number`` equal sequences with this room, as many as fit or are left."""
            nonlocal first, n
            per = room // length
            whole = min(number, n // per)
            offset = capacity - room
            if whole:
                slots.append((length, first, whole * per, per, sequence, offset))
                first, n = first + whole * per, n - whole * per
                leave(room - per * length, sequence, whole)
            if n and whole < number:
                slots.append((length, first, n, n, sequence + whole, offset))
                leave(room - n * length, sequence + whole, 1)
                first, n, whole = first + n, 0, whole + 1
            leave(room, sequence + whole, number - whole)

        while n and (i := bisect_left(rooms, length)) < len(rooms):
            room = rooms[i]
            runs = free[room]
            sequence, number = runs.pop()
            if not runs:
                del free[room]
                rooms.pop(i)
            fill(sequence, number, room)
        if n:
            opened = -(-n // (capacity // length))
            n_sequences += opened
            fill(n_sequences - opened, opened, capacity)
    return np.array(slots, dtype=np.int64).reshape(-1, 6), n_sequences


def take(stream: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """The next ``n`` pieces of a group's stream, which loses them."""
    out = []
    while n:
        length, first, number = stream[0]
        m = min(n, number)
        out.append((length, first, m))
        stream[0] = (length, first + m, number - m)
        if m == number:
            stream.pop(0)
        n -= m
    return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, groups: int = GROUPS) -> DataFrame:
    """Every document's pieces packed into sequences of at most ``capacity`` tokens: ``(key, piece, start, length, ids_crc32,
    sequence_id, offset)``; offsets of a sequence are gapless from 0.

    A null or empty text is the closing id alone. Rows are packed one by one, whatever their key: rows with the same key,
    or with none, are documents of their own. No documents, no rows. Longer documents are cut; all pieces but the first are whole.

    1. ``pieces``: one pass over the texts.
    2. The number of pieces of each length, at most ``capacity`` rows, is all that ``plan`` needs.
    3. A piece's number among those of its length is its place in its task and what the tasks before it have; the plan
       says which sequence and offset that number has. No text is shuffled, and no length is in one task."""
    made = pieces(docs, path, key, text, capacity, end)
    counts = written(made.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    slots, _ = plan(lengths, capacity, groups)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = made.join(starts, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).withColumn("place", F.col("place") + F.col("_before"))
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    firsts = np.searchsorted(slots[:, 0], np.arange(capacity + 2))  # where the slots of each length begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            order = np.lexsort((place, length))
            slot = np.empty(len(order), dtype=np.int64)
            for n in np.unique(length).tolist():
                mine = order[np.searchsorted(length[order], n) : np.searchsorted(length[order], n, side="right")]
                slot[mine] = firsts[n] + np.searchsorted(slots[firsts[n] : firsts[n + 1], 1], place[mine], side="right") - 1
            _, first, _, per, sequence, offset = slots[slot].T
            i = place - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence + i // per), pa.array(offset + i % per * length)], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select(key, "piece", "start", "length", "ids_crc32", "place").mapInArrow(tidied(run), schema)
