"""Near-duplicate groups by SetSketch registers, banding, likelihood and exact verification (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import hot_join, hot_keys
from .common import checkpointed, connected_components, tidied, written
from .words import _MIX, mix, word_codes

#: Words in a shingle and the least similarity, in percent, for pipelines; the contract query passes its own.
SHINGLE, PERCENT = 5, 80
#: Registers count down from the expected minimum in steps of factor B: floor(1 - log_B(minimum)), cut to 0 .. TOP.
B, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
SEED = 41
#: A pair of documents at the threshold may miss all bands with this probability at most.
MISS = 2e-5
#: Candidates whose likelihood estimate is further below the threshold lead to no group: over four standard errors of 140 registers.
LOOSE = 0.15
#: Shingles of a block: the documents that one task compares with each other. Members of a bucket that are chained in one task.
BLOCK, CHAINED = 400_000, 4096
def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of shorter texts the whole sequence; else none."""
    codes = word_codes(text)
    n = len(codes)
    if not n:
        return codes
    if n < k:
        h = np.full(1, n, dtype=np.uint64)
        for c in codes:
            h = mix(h * _MIX + c)
        return h
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        h = mix(h * _MIX + codes[i : n - k + 1 + i])
    return np.unique(h)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that don't depend on the order of a set's hashes, as two signed numbers."""
    sums = np.array([mix(shingles).sum(dtype=np.uint64), mix(shingles * _MIX + np.uint64(7)).sum(dtype=np.uint64)], dtype=np.uint64)
    return tuple(sums.view(np.int64).tolist())


def bands_for(percent: int, miss: float = MISS, rows: int | None = None) -> tuple[int, int]:
    """Bands and registers in each, so that a pair at the threshold misses all with probability ``miss`` at most."""
    j = percent / 100
    rows = rows or (6 if percent >= 85 else 5)
    return math.ceil(math.log(miss) / math.log(1 - (0.997 * j) ** rows)), rows


@lru_cache(maxsize=4)
def _factors(m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, size=m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(shingles: np.ndarray, m: int, seed: int = SEED) -> np.ndarray:
    """SetSketch registers of a set of hashes. Sketches of parts merge by the greater register.

    Register i is the truncated, exponentially spaced minimum of one exponential variable for each element: elements get a
    uniform number from their hash, the least of them gives the least exponential.
    """
    least = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    factors = _factors(m, seed)[:, None]
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[None, i : i + 1024] * factors).min(axis=1), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(B)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows) with known set sizes.

    Registers compare as greater, less or equal; with u and v the sizes' shares, their probabilities are p(u - v J),
    p(v - u J) and the rest, p(x) = -log_B(1 - x (B - 1) / B). The log likelihood is concave in J; golden section.
    """
    m = a.shape[1]
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    high = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (B - 1) / B) / math.log(B)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        g, s = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return up * np.log(np.maximum(g, tiny)) + down * np.log(np.maximum(s, tiny)) + (m - up - down) * np.log(np.maximum(1 - g - s, tiny))

    lo, hi, phi = np.zeros(len(u)), high.copy(), (math.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = hi - phi * (hi - lo), lo + phi * (hi - lo)
        better = log_likelihood(x) > log_likelihood(y)
        hi, lo = np.where(better, y, hi), np.where(better, lo, x)
    return (lo + hi) / 2


def sketched(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int, seed: int = SEED) -> DataFrame:
    """``(key, text_hash, n_shingles, fp1, fp2, sketch, keys)`` of each row: hash of the text, set size, 128-bit fingerprint of the set,
    registers, and a hash of each band. Sets without shingles have null fingerprint, sketch and keys."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, text_hash long, n_shingles long, fp1 long, fp2 long, sketch binary, keys array<bigint>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bands * rows
        for batch in batches:
            out = []
            for d, t, of_text in zip(batch.iloc[:, 0], batch.iloc[:, 1], batch.iloc[:, 2], strict=True):
                d = None if d is None else int(d)
                s = shingle_set(t, k)
                if not len(s):
                    out.append((d, of_text, 0, None, None, None, None))
                    continue
                r = registers(s, m, seed)
                h = np.full(bands, seed, dtype=np.uint64)
                for c in r.reshape(bands, rows).T.astype(np.uint64):
                    h = mix(h * _MIX + c)
                h = mix(h * _MIX + np.arange(bands, dtype=np.uint64))
                out.append((d, of_text, len(s), *fingerprint(s), r.tobytes(), h.view(np.int64)))
            columns = list(zip(*out, strict=True)) or [()] * 7  # nulls among long numbers would make them floats
            whole = [pd.array(c, dtype="Int64") for c in columns[:5]]
            frame = pd.DataFrame(dict(zip([key, "text_hash", "n_shingles", "fp1", "fp2"], whole, strict=True)) | {"sketch": pd.Series(columns[5], dtype=object), "keys": pd.Series(columns[6], dtype=object)})
            yield frame

    return docs.select(F.col(key).cast("string"), text, F.xxhash64(text).alias("text_hash")).mapInPandas(tidied(run), schema)


def _estimated(pairs: DataFrame, sketches: DataFrame, loose: float) -> DataFrame:
    """The pairs (src, dst) whose estimate is ``loose`` or more."""
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a, c = (np.frombuffer(b"".join(b[x]), dtype=np.uint16).reshape(len(b), -1) for x in ("s_src", "s_dst"))
                ok = jaccard_estimate(a, c, b["n_src"].to_numpy(float), b["n_dst"].to_numpy(float)) >= loose
                yield b.loc[ok, ["src", "dst"]]

    return both.select("src", "dst", "n_src", "n_dst", "s_src", "s_dst").mapInPandas(tidied(run), "src long, dst long")


def linked(sets: list[np.ndarray], percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that span the components of sets whose similarity is ``percent`` or more: 100 * |a & b| >= percent * |a | b|.

    Exact: each set is counted against all earlier ones through an inverted index of the shingles. With ``split`` only
    pairs of one set before and one from place ``split`` on count. Pairs already connected are not linked again.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    posted: dict[int, list[int]] = {}
    out = []
    for i in order.tolist():
        mine = [c for c in codes[ends[i] - sizes[i] : ends[i]].tolist() if counts[c] > 1]
        before = [np.array(posted[c], dtype=np.int64) for c in mine if c in posted]
        if before:
            both = np.bincount(np.concatenate(before), minlength=len(sets))
            near = np.flatnonzero(100 * both >= percent * (sizes[i] + sizes - both))
            for j in near[both[near] > 0].tolist():
                if split is not None and (i < split) == (j < split):
                    continue
                a, b = find(i), find(j)
                if a != b:
                    parent[a] = b
                    out.append((i, j))
        for c in mine:
            posted.setdefault(c, []).append(i)
    return out


def _verified(members: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """Exact links (src, dst) that span the components within the loose groups of ``members(id, group, n_shingles, doc, text_hash, fp1)``,
    whose text is one with that key and hash.

    Groups are dealt to blocks of bounded size by their members' hashes. First each block is compared with itself and with the group's
    least member, which connects what is like that one. Only groups that still fall apart are then compared block by block. All
    texts are shuffled once, to pick the members'; where these are needed twice they are kept."""
    sizes = checkpointed(members.groupBy("group").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("n_blocks"), F.min("id").alias("lead"), F.count("*").alias("n")))
    hot = hot_keys(sizes, "group", "n")
    placed = hot_join(members.drop("n_shingles"), sizes.drop("n"), "group", hot).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    own = F.when(F.col("id") == F.col("lead"), F.transform(every, lambda o: pair(o, o))).otherwise(F.array(pair(F.col("block"), F.col("block"))))
    placed = placed.join(texts, ["doc", "text_hash"]).drop("doc", "text_hash")
    if sizes.where("n_blocks > 1").isEmpty():
        return _compared(placed.withColumn("m", own), k, percent)
    placed = written(placed, "near_dedup_members")
    links = checkpointed(_compared(placed.withColumn("m", own), k, percent))
    large = placed.where("n_blocks > 1")
    named = large.join(connected_components(links), F.col("id") == F.col("vertex"), "left").withColumn("c", F.coalesce("component", "id"))
    apart = named.groupBy("group").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("group")
    others = F.transform(F.filter(every, lambda o: o != F.col("block")), lambda o: pair(F.least(o, F.col("block")), F.greatest(o, F.col("block"))))
    return links.unionByName(_compared(hot_join(large, apart, "group", hot).withColumn("m", others), k, percent))


def _compared(placed: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the members of each pair of blocks in the arrays ``m``, each pair a task of its own."""
    work = placed.select("id", "fp1", "group", "block", "_text", F.explode("m").alias("m")).select("id", "fp1", "group", "block", "_text", F.col("m.a").alias("a"), F.col("m.b").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(rows: list[tuple[int, int, np.ndarray]], a: int, b: int) -> pd.DataFrame:
            rows.sort(key=lambda r: (r[1], r[0]))
            if len(rows) < 2:
                return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
            links = linked([r[2] for r in rows], percent)
            return pd.DataFrame([(rows[i][0], rows[j][0]) for i, j in links], columns=["src", "dst"], dtype="int64")

        last, rows, seen = None, [], set()
        for batch in batches:
            for g, a, b, i, fp1, block, t in zip(batch["group"], batch["a"], batch["b"], batch["id"], batch["fp1"], batch["block"], batch["_text"], strict=True):
                if (g, a, b) != last:
                    if len(rows) > 1:
                        yield solve(rows, *last[1:])
                    last, rows, seen = (g, a, b), [], set()
                if i not in seen:  # repeated rows come as often as they are there
                    shingles = shingle_set(t, k)
                    if fingerprint(shingles)[0] == fp1:
                        seen.add(i)
                        rows.append((int(i), int(block), shingles))
        if len(rows) > 1:
            yield solve(rows, *last[1:])

    tasks = work.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b")
    return tasks.select("group", "a", "b", "id", "fp1", "block", "_text").mapInPandas(tidied(run), "src long, dst long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Near-duplicate groups: ``(key, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Words are A-Z lower-cased runs without ASCII white space; a text's set is its distinct k-word shingles, of shorter
    texts the whole sequence. Texts are linked from ``percent`` % similarity on, whatever links them is a group, and its
    smallest key the ``component_id``; that row is ``kept``. Rows without words are linked with nothing. Keys are longs;
    rows with a null key are grouped by their text, kept only without a group (component_id null). Rows that share a key are
    grouped each by its own text, and each is kept whose group has that key as its smallest.

    1. Sketch every text in one pass; equal sets fold to one, known by the least key and text that has it, pre-aggregated.
    2. Band the registers. A bucket links each set to its least and to the next one, so links grow with sets, not pairs.
    3. Drop links whose likelihood estimate is more than LOOSE below the threshold, and label what hangs together: the loose groups.
       A pair that reaches the threshold is in one, but for those that share no band (MISS) or whose links are all dropped.
    4. Verify within loose groups on full sets: a block of bounded size is one task, larger groups meet their least set, and
       block by block only where that leaves them in parts.
    """
    bands, rows = bands_for(percent)
    facts = checkpointed(sketched(docs, key, text, k, bands, rows, seed).withColumn("doc", F.col(key).cast("long")))
    # what is linked are sets, whatever keys their rows have; a set is met by the least of its rows
    sets = facts.where("n_shingles > 0 AND doc IS NOT NULL").groupBy("fp1", "fp2").agg(F.min(F.struct("doc", "text_hash")).alias("least"), F.min("n_shingles").alias("n_shingles"))
    sets = sets.select("fp1", "fp2", "n_shingles", "least.*")
    owned = facts.select("doc", "text_hash", "fp1", "fp2", "sketch", "keys")
    reps = checkpointed(sets.join(owned, ["doc", "text_hash", "fp1", "fp2"]).dropDuplicates(["fp1", "fp2"]))
    # a set is named by its key, or by a number of its own where sets share keys; numbered once, when they are written
    shares = not reps.groupBy("doc").count().where("count > 1").isEmpty()
    reps = checkpointed(reps.withColumn("id", F.monotonically_increasing_id())) if shares else reps.withColumn("id", F.col("doc"))
    inside = reps.select("id", F.explode("keys").alias("key"))
    shared = checkpointed(inside.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    # a bucket may hold a third of all rows: its chain is made in parts, which all hang on its least set
    chained = hot_join(inside, shared, "key", hot_keys(shared, "key", "n")).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHAINED)))
    chained = chained.withColumn("before", F.lag("id").over(Window.partitionBy("key", "part").orderBy("id")))
    pairs = chained.select(F.explode(F.array(F.struct(F.col("id").alias("src"), F.col("hub").alias("dst")), F.struct(F.col("id").alias("src"), F.col("before").alias("dst")))).alias("p"))
    pairs = pairs.select("p.*").where("src > dst").distinct()
    loose = connected_components(_estimated(pairs, reps.select("id", "n_shingles", "sketch"), percent / 100 - LOOSE))
    members = loose.select(F.col("vertex").alias("id"), F.col("component").alias("group")).join(reps.select("id", "n_shingles", "doc", "text_hash", "fp1"), "id")
    groups = connected_components(_verified(members, docs, key, text, k, percent))
    grouped = groups.join(reps.select("id", "doc", F.col("fp1").alias("_f1"), F.col("fp2").alias("_f2")), F.col("vertex") == F.col("id"))
    if shares:
        least = checkpointed(grouped.groupBy("component").agg(F.min("doc").alias("_least"), F.count("*").alias("n")))
        grouped = hot_join(grouped, least.drop("n"), "component", hot_keys(least, "component", "n"))
    named = grouped.select("_f1", "_f2", F.col("_least" if shares else "component").alias("_least"))
    own = reps.select(F.col("fp1").alias("_f1"), F.col("fp2").alias("_f2"), "doc").join(named, ["_f1", "_f2"], "left").select("_f1", "_f2", F.coalesce("_least", "doc").alias("_c"))
    out = facts.select(key, F.col("doc").alias("_doc"), "n_shingles", "fp1", "fp2").join(own, (F.col("fp1") == F.col("_f1")) & (F.col("fp2") == F.col("_f2")), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("_doc")).otherwise(F.coalesce("_c", "_doc"))
    return out.select(key, "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))
