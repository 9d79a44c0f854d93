"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import checkpointed

#: A key is hot that has more rows than these, and more than this share of all.
HOT_ROWS, HOT_SHARE = 2000, 0.001


def hot_keys(counts: DataFrame, key: str, n: str, total: int | None = None) -> list:
    """The keys of ``counts(key, n)`` with very many rows: at most 1 / HOT_SHARE of them, so they fit a driver and a broadcast."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] if total is None else total
    return [r[0] for r in counts.where(F.col(n) > max(HOT_ROWS, int(total * HOT_SHARE))).select(key).collect()]


def hot_join(rows: DataFrame, one: DataFrame, key: str, hot: list, also: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with what ``one`` has for their key, a row for each key: by shuffle, but for the ``hot`` keys by broadcast of their
    few rows, so that no task gets all rows of such a key. Where ``key`` is a hash, ``also`` names the columns that it is of."""
    on = [key, *also]
    if not hot:
        return rows.join(one, on)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(one.where(~is_hot), on).unionByName(rows.where(is_hot).join(F.broadcast(one.where(is_hot)), on))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges(src, dst)`` with the smallest vertex that it reaches: ``(vertex, component)``.

    Alternates the large-star and small-star steps (Kiveris et al., SoCC 2014) until the edge set no longer changes.
    Minima are pre-aggregated per task and joined back, those of vertices with very many edges by broadcast, so none is held by one
    task; each round is checkpointed. Vertices are longs; loops and repeated edges do no harm; no edges give no rows.
    """

    def signature(df: DataFrame) -> tuple:
        h = F.xxhash64("src", "dst")
        return tuple(df.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(h)).first())

    def star(df: DataFrame, large: bool, n: int) -> DataFrame:
        both = df.unionByName(df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else df
        low = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
        # after a round edges point to centres, which only the large star, that turns edges round, groups by
        hot = hot_keys(df.groupBy("dst").agg(F.count("*").alias("n")), "dst", "n", n) if large else []
        linked = hot_join(both, low, "src", hot)
        if large:
            out = linked.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        else:
            out = linked.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.select("src", F.col("m").alias("dst")))
        return out.where("src <> dst").distinct()

    now = checkpointed(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct())
    seen = signature(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = checkpointed(star(star(now, True, seen[0]), False, seen[0]))
        was, seen = seen, signature(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("src").alias("vertex")).agg(F.min("dst").alias("component")).unionByName(
        now.select(F.col("dst").alias("vertex"), F.col("dst").alias("component")).distinct()
    )
