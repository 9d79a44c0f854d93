"""Ranked lexical search over term-bucketed postings, scored in integers (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, tidied, written

#: What parts terms: the ASCII characters other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Buckets of terms; bytes of texts that are split together; rows of query terms up to which they are broadcast.
BUCKETS, BYTES, SMALL = 256, 1 << 22, 500_000
TOP = 10


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, none for null."""
    return F.array_remove(F.array_distinct(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN)), "")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def parts(batch: pa.RecordBatch, column: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of text, a row at least. Parts are copies, as Arrow 23 misreads string slices that
    are cast to large strings: without nulls, or from a multiple of eight rows on."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.take(pa.array(np.arange(start, stop)))
        start = stop


def counted_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(row, id, term, tf, n)``: the terms of each document with their occurrences, and one row with an empty term for a document
    that has any. ``row`` numbers documents (task and place), n is a document's terms with repeats."""
    schema = f"row long, id {docs.schema[key].dataType.simpleString()}, term string, tf long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in parts(whole, 1):
                words = pc.split_pattern_regex(pc.ascii_lower(batch.column(1).cast(pa.large_string())), BETWEEN)
                term, doc = pc.list_flatten(words), pc.list_parent_indices(words)
                some = pc.not_equal(term, "")
                counts = pa.table({"doc": doc.filter(some), "term": term.filter(some)}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
                doc, tf = counts["doc"].to_numpy(), counts["count_all"].to_numpy()
                n = np.bincount(doc, weights=tf, minlength=len(batch)).astype(np.int64)
                has = np.flatnonzero(n)
                at = np.concatenate([doc, has])
                names = pa.concat_arrays([counts["term"].combine_chunks().cast(pa.string()), pa.array([""] * len(has), pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(row + at), batch.column(0).take(pa.array(at)), names, pa.array(np.concatenate([tf, n[has]])), pa.array(n[at])], ["row", "id", "term", "tf", "n"])
                row += len(batch)

    return docs.select(key, text).mapInArrow(tidied(run), schema)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """The index: ``(bucket, term, row, id, tf, n)``, written to the shared folder with each task's rows sorted by bucket and term, so that a
    search reads the row groups of its buckets. The empty term has one row for each document with any term.

    ``only(term)`` restricts the index to the terms that are going to be asked for, and the empty one."""
    found = counted_terms(docs, key, text)
    if only is not None:
        wanted = only.select("term").unionByName(only.sparkSession.createDataFrame([("",)], "term string")).distinct()
        found = found.join(bounded(wanted), "term", "left_semi")
    found = found.withColumn("bucket", bucket_of(F.col("term"))).select("bucket", "term", "row", "id", "tf", "n")
    return written(found.sortWithinPartitions("bucket", "term"), "postings")


def bounded(terms: DataFrame) -> DataFrame:
    """Query terms, broadcast if they are at most SMALL rows; more are left to a shuffle, whose skewed terms are split."""
    return F.broadcast(terms) if terms.limit(SMALL + 1).count() <= SMALL else terms


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, term)``, each pair once; rows that share a key are one item with the terms of all, null being a key as well."""
    return items.select(F.col(key).alias("item"), F.explode(terms_of(F.col(text))).alias("term")).distinct()


def search(index: DataFrame, wanted: DataFrame, top: int = TOP, k1: int = 1000, b: int = 90) -> DataFrame:
    """The ``top`` documents of each item by score: ``(item, rank, id, score)``, from ``postings`` and ``item_terms``.

    With N documents of L terms, a term in df of them weighs w = floor(1000 ln((2N+2)/(2df+1))); a document of n terms has
    m = 100 - b + b n N div L; an item's score is the sum of w (10^9 tf div (k1 tf + 8 m)). Scores of 0 are left out. Documents are
    rows: those that share an id are ranked one by one; equal scores go by id, null last.

    Postings are dealt by document once; items' weighted terms join them and scores are summed where they lie, so of all
    pairs of an item and a document only each task's best are shuffled. Where the items' terms are too many to broadcast, the join is by
    term, and the pairs are shuffled."""
    spark = index.sparkSession
    n_docs, n_terms = index.where("term = ''").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return spark.createDataFrame([], f"item {wanted.schema['item'].dataType.simpleString()}, rank int, id {index.schema['id'].dataType.simpleString()}, score long")
    wanted = wanted.withColumn("bucket", bucket_of(F.col("term")))
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
    found = index.where((F.col("term") != "") & F.col("bucket").isin(buckets)).select("term", "row", "id", "tf", "n")
    held = found.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = checkpointed(wanted.select("item", "term").join(held, "term").withColumn("w", weight).where("w > 0").select("term", "item", "w"))
    long_most = (2**63 - 1) // (b * n_docs)  # longer documents go by decimals, which hold the product
    length = F.when(F.col("n") <= long_most, F.expr(f"(n * {b * n_docs}L) DIV {n_terms}L")).otherwise(F.expr(f"CAST((CAST(n AS DECIMAL(20, 0)) * {b * n_docs}BD) DIV {n_terms}BD AS BIGINT)"))
    sized = found.withColumn("m", 100 - b + length).withColumn("part", F.expr(f"(1000000000L * tf) DIV ({k1}L * tf + 8 * m)")).select("term", "row", "id", "part")
    pairs = sized.repartition("row").join(bounded(weighted), "term")
    scores = pairs.groupBy("item", "row", "id").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item", "rank", "id", "score")


def ranked(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """``(item_key, rank, doc_key, score)``: the best documents for every item, as ``search`` has them. Items or documents without terms,
    null texts and empty tables have no rows."""
    wanted = item_terms(items, item_key, text)
    found = search(postings(docs, doc_key, text, wanted), wanted, top)
    return found.withColumnsRenamed({"item": item_key, "id": doc_key})
