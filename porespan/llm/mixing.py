"""Mixing sources to target weights by Sainte-Lague apportionment (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, split_words, written

SEED = 20240607
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words that the mix takes, per 100 words of the corpus; and the most a source gives, as a multiple of its size.
PERCENT, MOST = 150, 2
#: About so many documents make a shard: the unit that one task orders.
SHARD_DOCS = 2000
#: So many neighbouring shards make a shelf: one task ranks the shelves of a source, or the shards of a shelf.
SHELF_SHARDS = 1000


def seeded(doc_id: Column, seed: int, salt: str) -> Column:
    """A number in [0, 2**32) drawn from the row key; the same in every engine that has MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """Per source: size, documents, weight and target, from ``sized(source, size)``.

    Targets share ``percent`` % of all words by weight; a source stops at ``most`` times its size and its excess is shared
    again by weight among the others (water filling, in closed form: sources sorted by cap over weight, prefix sums).
    One row per source; null is a source, the last one. A source without words has target 0.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    s = by.withColumn("weight", F.element_at(table, (rank % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    at = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "budget": F.sum("source_size").over(every).cast("double") * percent / 100,
        "full": F.coalesce(F.sum("cap").over(at), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(at), F.lit(0)),
    })
    # were all before this source full, and none from it on, each unit of weight would get so much
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    s = s.withColumn("nth", F.row_number().over(Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())))
    level = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("nth"))).over(every)
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))).select("source", "source_size", "n_docs", "weight", "target")


def sainte_lague(votes: DataFrame, group: list[str], key: str, votes_col: str, seats_col: str) -> DataFrame:
    """Give each group's ``seats_col`` seats to its keys by the highest quotients votes / (2 k + 1); adds ``seats``.

    Votes are doubles >= 0. A key's count of seats differs from its rounded share by no more than its part of the number of
    keys, so only quotients in that margin are ranked; the seats below it are its own already. Ties go to the smaller key.
    """
    g = Window.partitionBy(*group)
    v = votes.withColumns({"_all": F.sum(votes_col).over(g), "_keys": F.count("*").over(g)})
    v = v.withColumn("_fair", F.when(F.col("_all") > 0, F.col(votes_col) * F.col(seats_col) / F.col("_all")).otherwise(0.0))
    v = v.withColumn("_margin", F.ceil(F.when(F.col("_all") > 0, F.col("_keys") * F.col(votes_col) / F.col("_all")).otherwise(0.0)).cast("long") + 2)
    v = v.withColumn("_base", F.greatest(F.lit(0).cast("long"), F.round("_fair").cast("long") - F.col("_margin")))
    v = v.withColumn("_left", F.col(seats_col) - F.sum("_base").over(g))
    tries = v.select(*group, key, votes_col, "_left", F.explode(F.sequence(F.col("_base"), F.col("_base") + 2 * F.col("_margin"))).alias("_k")).where(F.col(votes_col) > 0)
    place = F.row_number().over(Window.partitionBy(*group).orderBy((F.col(votes_col) / (2 * F.col("_k") + 1)).desc(), F.col(key).asc_nulls_last(), "_k"))
    won = tries.withColumn("_p", place).where("_p <= _left").groupBy(*group, key).agg(F.count("*").alias("_won"))
    on = [F.col(f"v.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*group, key]]
    return v.alias("v").join(won.alias("w"), on, "left").select(*[F.col(f"v.{c}") for c in votes.columns], (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("seats"))


def apportion(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = SEED, shard_docs: int = SHARD_DOCS, shelf_shards: int = SHELF_SHARDS) -> DataFrame:
    """Decide how many words the mix takes from each row of ``sized(doc_id, source, size)``; no row is dropped.

    All targets are cut in equal blocks of words, and the blocks dealt to sources, then to the shelves of a source, then
    to the shards of a shelf, by Sainte-Lague. A shard orders its documents by a seeded hash and lays them end to end, in blocks; its quota takes the
    whole stream as often as it fits, and for the rest a run of blocks from a seeded start, wrapping round. So a document
    gives ``size`` times the passes, plus what the run covers of it: never more than ``most`` times its size.

    Output: doc_id, source and size (other columns don't come along), ``source_size``, ``target`` (its source's), ``taken``, and ``passes``, ``skip_to``,
    ``run``: of its words beyond the whole passes, the run takes ``run`` from word ``skip_to`` on (wrapping in the document
    where the run wraps in a one-document shard). Null doc_ids and repeated rows are documents like others; empty ones
    give 0. An empty table gives an empty result.
    """
    sized = sized.select("doc_id", "source", "size")
    targets = source_targets(sized, weights, percent, most)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    block = F.greatest(F.lit(1), F.least(F.lit(4096), F.floor(F.coalesce(smallest, F.lit(1.0)) / 500))).cast("long")
    src = targets.withColumns({"one": F.lit(1), "block": block})
    src = src.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / F.col("block")).cast("long"))
    src = sainte_lague(src, ["one"], "source", "target", "blocks").withColumnRenamed("seats", "source_blocks").drop("one", "blocks")
    src = src.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs)).cast("long"))

    # a row for each source, which the windows above have in one task; written, as the shards below read it several times
    plan = written(src.select(F.col("source").alias("_source"), "source_size", "target", "block", "source_blocks", "n_shards").coalesce(1), "targets")
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), F.col("size").cast("string")))  # rows without a key part too
    dealt = dealt.withColumns({"shard": F.pmod(seeded(name, seed, "shard"), F.col("n_shards")), "order": seeded(F.col("doc_id"), seed, "order")})
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"), F.first("block").alias("shard_block"))
    shards = shards.withColumns({"shelf": F.expr(f"shard div {int(shelf_shards)}"), "votes": F.col("shard_size").cast("double")})
    shelves = shards.groupBy("source", "shelf").agg(F.sum("votes").alias("votes"), F.first("source_blocks").alias("source_blocks"))
    shelves = sainte_lague(shelves, ["source", "source_blocks"], "shelf", "votes", "source_blocks").select(F.col("source").alias("_source"), F.col("shelf").alias("_shelf"), F.col("seats").alias("shelf_blocks"))
    shards = shards.join(shelves, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shelf") == F.col("_shelf"))).drop("_source", "_shelf", "source_blocks")
    quotas = sainte_lague(shards, ["source", "shelf", "shelf_blocks"], "shard", "votes", "shelf_blocks")
    quotas = quotas.withColumn("quota", F.least(F.col("seats") * F.col("shard_block"), F.col("shard_size") * most))
    quotas = quotas.withColumns({
        "passes": F.when(F.col("shard_size") > 0, F.expr("quota div shard_size")).otherwise(F.lit(0)).cast("long"),
        "rest": F.when(F.col("shard_size") > 0, F.col("quota") % F.col("shard_size")).otherwise(F.lit(0)).cast("long"),
    })
    start = seeded(F.concat_ws(":", F.coalesce("source", F.lit("")), F.col("shard").cast("string")), seed, "start")
    quotas = quotas.withColumn("start", F.when(F.col("shard_size") > 0, F.pmod(start, F.greatest(F.lit(1), F.expr("shard_size div shard_block"))) * F.col("shard_block")).otherwise(0))
    q = quotas.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "passes", "rest", "start")

    stream = Window.partitionBy("source", "shard").orderBy("order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("end", F.sum("size").over(stream)).withColumn("begin", F.col("end") - F.col("size"))
    out = laid.join(q, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))

    first = overlap(F.col("start"), F.least(F.col("start") + F.col("rest"), F.col("shard_size")))
    second = overlap(F.lit(0), F.greatest(F.lit(0), F.col("start") + F.col("rest") - F.col("shard_size")))
    out = out.withColumns({"run": first + second, "skip_to": F.when(second > 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("start") - F.col("begin")))})
    out = out.withColumn("skip_to", F.when((first > 0) & (second > 0), F.greatest(F.lit(0), F.col("start") - F.col("begin"))).otherwise(F.col("skip_to")))
    return out.withColumn("taken", (F.col("size") * F.col("passes") + F.col("run")).cast("long")).select(*sized.columns, "source_size", "target", "taken", "passes", F.col("skip_to").cast("long").alias("skip_to"), F.col("run").cast("long").alias("run"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)`` of every document, written once to the shared folder."""
    return written(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sizes")


def mix(docs: DataFrame, text: str = "text", **plan) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it whole, and once more with the words of a partial take.

    Rows keep the columns of ``docs``; of a partial row ``text`` has the words taken, joined by blanks, and ``n_chars``
    (where there is one) its length. Documents of which nothing is taken go. Rows that agree in doc_id, source and size
    are dealt its decisions in a fixed order; a null doc_id is one more key.
    """
    decided = apportion(sized_documents(docs), **plan)
    # rows that can't be told apart by their keys: deal the decisions out in the order of their texts' hashes
    nth = lambda keys, order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    slots = decided.withColumn("_mix_nth", nth(["doc_id", "source", "size"], F.col("taken")))
    slots = slots.select(*[F.col(c).alias(f"_mix_{c}") for c in ("doc_id", "source", "size", "passes", "run", "skip_to")], "_mix_nth")
    rows = docs.withColumn("_mix_words", count_words(F.col(text))).withColumn("_mix_mine", nth(["doc_id", "source", "_mix_words"], F.xxhash64(text)))
    on = [F.col(c).eqNullSafe(F.col(f"_mix_{c}")) for c in ("doc_id", "source")]
    both = rows.join(slots, [*on, F.col("_mix_words") == F.col("_mix_size"), F.col("_mix_mine") == F.col("_mix_nth")])
    whole = F.array_repeat(F.lit(True), F.col("_mix_passes").cast("int"))
    both = both.withColumn("_mix_whole", F.explode(F.concat(whole, F.when(F.col("_mix_run") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))))
    words = split_words(F.col(text))
    part = F.array_join(F.slice(F.concat(words, words), (F.col("_mix_skip_to") + 1).cast("int"), F.greatest(F.lit(1), F.col("_mix_run")).cast("int")), " ")
    out = both.withColumn(text, F.when(F.col("_mix_whole"), F.col(text)).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
