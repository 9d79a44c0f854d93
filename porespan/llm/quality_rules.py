"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 9, DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, split_words, written

#: Relative accuracy of the sketch: a value's bucket is off by at most 2 %.
GAMMA = 1.04
#: A group's own sketch is used from so many documents on; smaller groups use the language's, then the whole corpus's.
LEAST_GROUP = 200
#: A document fails where a rate lies above the upper quartile by more than FENCE times the spread of its group.
FENCE = 6
#: Rates are integers per 10,000 words, so that every engine computes the same numbers. With each rate, the least that one
#: more occurrence adds to its count (two windows without a word in common; one long word): no spread is finer than that.
METRICS = {"symbol_rate": 1, "dup_line_rate": 1, "repeat_rate": 6, "long_word_rate": 10}
#: Sketched beside the rates: the length that says how coarse the rates of a group are.
LENGTH = "n_words"
#: Places that the documents of a group are spread over when they meet its fences.
SALT = 32


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of a text. Null, empty and blank texts have 0 in each; a repeated row is counted like any other.

    word_chars: code points in words. n_symbols: characters of ``[#*$%&|<>]``. n_dup_lines: lines with a word equal to an
    earlier line. n_repeat_words: words in 3-word windows that the text has twice or more. Windows are compared by
    64-bit hash; only texts that repeat one sort their windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    one = docs.select("*", t.alias("_t"), split_words(F.col(text)).alias("_w"), lines.alias("_l"))
    windows = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.slice("_w", i, 3)))).otherwise(F.array().cast("array<bigint>"))
    two = one.select("*", windows.alias("_h"))
    ranked = two.select(
        "*",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_s"),
    )
    placed = ranked.select("_t", "_l", F.size("_w").alias("_n"), F.array_sort(_repeated("_s")).alias("_p"), *docs.columns)
    return placed.select(
        *docs.columns,
        F.col("_n").cast("long").alias("n_words"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[^\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered("_p"), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _repeated(name: str) -> Column:
    """Positions of the windows whose hash a neighbour in the sorted array shares."""
    s = F.col(name)
    same = lambda x, j: (j >= 0) & (j < F.size(s)) & (F.get(s, j)["h"] == x["h"])
    return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])


def _covered(name: str) -> Column:
    """Words in the 3-word windows at these ascending positions."""
    p = F.col(name)
    step = lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last"))
    return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step)["n"]


def rates(df: DataFrame) -> DataFrame:
    per = lambda c: F.floor(F.col(c) * 10_000 / F.greatest(F.col("n_words"), F.lit(1))).cast("long")
    return df.withColumns({"symbol_rate": per("n_symbols"), "dup_line_rate": per("n_dup_lines"), "repeat_rate": per("n_repeat_words"), "long_word_rate": per("word_chars")})


def bucket(value: Column) -> Column:
    """Bucket of a non-negative integer in a sketch with relative error: 0 for 0, else 1 + ceil(log_GAMMA(value))."""
    return F.when(value <= 0, F.lit(0)).otherwise(1 + F.ceil(F.log(value.cast("double")) / F.lit(math.log(GAMMA)))).cast("long")


def sketches(df: DataFrame, keys: list[str], out: Column | None = None) -> DataFrame:
    """Bucket counts of every metric per group, without the rows for which ``out`` holds. Counts add up, so sketches of
    parts merge by summation.

    ``out`` is no filter: one would be pushed below the counts, and make them again inside every lambda."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in (*METRICS, LENGTH)])
    pairs = F.explode(pairs if out is None else F.when(~out, pairs))
    return df.select(*keys, pairs.alias("p")).groupBy(*keys, "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Upper fence of each group and rate: values above it fail. Needs the sketch alone.

    The spread of a rate is its interquartile range, or what one occurrence adds to a text of the lower-quartile length of the
    group where that is more, as where most texts have none."""
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    g = sketch.groupBy(*keys, "metric").agg(F.sum("n").alias("size"), ordered.alias("b"))

    def quantile(q: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("long").alias("at"))
        need = F.ceil(F.col("size") * q)
        step = lambda a, x: F.struct((a["cum"] + x["n"]).alias("cum"), F.coalesce(a["at"], F.when(a["cum"] + x["n"] >= need, x["bucket"])).alias("at"))
        return F.aggregate("b", start, step)["at"]

    value = lambda b: F.when(b == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), (b - 1).cast("double")))
    events = F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, 10_000.0 * v)])
    q = g.select(*keys, "metric", "size", value(quantile(0.25)).alias("q1"), value(quantile(0.75)).alias("q3"))
    length = F.greatest(F.lit(1.0), F.max(F.when(F.col("metric") == LENGTH, F.col("q1")))).alias("length")
    both = q.groupBy(*keys).agg(F.max("size").alias("size"), length, F.collect_list(F.struct("metric", "q1", "q3")).alias("m")).select(*keys, "size", "length", F.inline("m")).where(F.col("metric") != LENGTH)
    spread = F.greatest(F.col("q3") - F.col("q1"), F.element_at(events, F.col("metric")) / F.col("length"))
    return both.select(*keys, "metric", "size", F.floor(F.col("q3") + FENCE * spread).cast("long").alias("fence"))


def adaptive_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None, least_group: int = LEAST_GROUP) -> DataFrame:
    """Judge every document by base rules and by thresholds learned from the corpus; rows are flagged, never dropped.

    A sketch of each rate per (lang, source) gives the fences; nulls in either are a group of their own. Groups under
    ``least_group`` documents take the fences of their language, languages under it those of the corpus. Texts with fewer
    than 50 words fail the base rule and enter no sketch. Output: the columns ``carry`` of ``docs`` (all, unless given;
    columns named like an output give way to it), the counts, ``base_failed`` and ``kept``. Without the text among them the
    counts are written once to the shared folder instead of being made twice. An empty table gives an empty result.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    own = [c for c in (carry or docs.columns) if c not in made and c not in METRICS]
    need = [c for c in dict.fromkeys([*own, text, lang, source]) if c not in made and c not in METRICS]
    counted = rates(base_counts(docs.select(*need), text)).withColumns({"_lang": F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")), "_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))})
    judged = counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).select(*own, *made[:-1], "_lang", "_source", *METRICS)
    return apply_fences(judged if text in own else written(judged, "quality"), least_group).select(*own, *made)


def apply_fences(judged: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    fine = sketches(judged, ["_lang", "_source"], F.col("base_failed"))  # one exchange, which the three levels share
    by_lang = fine.groupBy("_lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    a, b, c = fences(fine, ["_lang", "_source"]), fences(by_lang, ["_lang"]), fences(whole, [])
    chosen = (
        a.join(b.select("_lang", "metric", F.col("size").alias("lang_size"), F.col("fence").alias("lang_fence")), ["_lang", "metric"])
        .join(c.select("metric", F.col("fence").alias("all_fence")), "metric")
        .withColumn("fence", F.when(F.col("size") >= least_group, F.col("fence")).when(F.col("lang_size") >= least_group, F.col("lang_fence")).otherwise(F.col("all_fence")))
        .groupBy("_lang", "_source")
        .agg(*[F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"max_{m}") for m in METRICS])
    )
    passed = F.lit(True)
    for m in METRICS:
        passed &= F.coalesce(F.col(m) <= F.col(f"max_{m}"), F.lit(True))
    # a group may hold a third of all rows: its one row of fences goes to SALT places, over which its documents are spread
    chosen = chosen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    spread = judged.withColumn("_salt", F.pmod(F.xxhash64(*[f.name for f in judged.schema if isinstance(f.dataType, T.AtomicType)]), F.lit(SALT)).cast("int"))
    return spread.join(chosen, ["_lang", "_source", "_salt"], "left").withColumn("kept", ~F.col("base_failed") & passed)
