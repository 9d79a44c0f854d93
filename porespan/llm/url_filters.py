"""URL filters from a path-template tree per host (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import hot_join, hot_keys
from .common import written

#: (action, host suffix, path prefix); a rule is written as host/path, the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Of a branch with more distinct children than this, those that hold less than this share of its rows are variable.
MANY, SHARE = 12, 0.25
#: Siblings merge where the shares of their child shapes differ by at most this total variation, and their labels agree.
ALIKE = 0.25
#: Segments left from which chains without a fork are skipped; templates don't depend on it.
SKIP = 6
#: Pseudo-labels that a template borrows from the templates above it, and the purity from which it is rejected.
SMOOTH, REJECT = 4.0, 0.5


def parse_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``: the host follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; the path
    goes on up to ``? #`` or the end. Null urls and urls without ``://`` have both empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its action; nulls where none fits."""
    fits = [(a, h, p, ((host == h) | host.endswith("." + h)) & path.startswith(p)) for a, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a, h, p, hit in reversed(fits):
        rule, action = F.when(hit, h + p).otherwise(rule), F.when(hit, a).otherwise(action)
    return rule, action


def shape(segment: Column) -> Column:
    """What kind of segment it is: digits become ``9``, letter-digit mixtures ``x9``, with the extension kept."""
    ext = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return F.when(stem.rlike(r"^[0-9]+$"), F.concat(F.lit("{9}"), ext)).when(stem.rlike(r"^(?=.*[0-9])[0-9A-Za-z_-]{6,}$"), F.concat(F.lit("{x9}"), ext)).otherwise(segment)


def skipped_chains(rows: DataFrame) -> DataFrame:
    """``rows`` with the segments ``_s`` that all urls of a branch share up to its first fork moved to their template.

    The greatest rest of a branch is compared with the others: the least place at which one has another segment is the fork.
    A url that ends before it gets there whole. What a branch shares has an only child at every step, which keeps its name."""
    of = F.xxhash64("host", "template").alias("_branch")
    left = rows.where(F.size("_s") > 0).select("*", of)
    most = left.groupBy("_branch", "host", "template").agg(F.max("_s").alias("_most"), F.count("*").alias("_n"))
    hot = hot_keys(most, "_branch", "_n")
    differs = F.array_position(F.zip_with(F.col("_s"), F.slice("_most", 1, F.size("_s")), lambda x, y: x == y), False).cast("int")
    forks = hot_join(left, most.drop("_n"), "_branch", hot, ("host", "template")).groupBy("_branch", "host", "template").agg(F.min(F.when(differs > 0, differs - 1)).alias("_fork"))
    met = hot_join(left, forks, "_branch", hot, ("host", "template"))
    take = F.least(F.coalesce("_fork", F.size("_s")), F.size("_s"))
    name = F.when(take > 0, F.concat("template", F.lit("/"), F.array_join(F.slice("_s", F.lit(1), take), "/"))).otherwise(F.col("template"))
    moved = met.withColumns({"template": name, "_s": F.slice("_s", take + 1, F.greatest(F.size("_s"), F.lit(1)))})
    return written(moved.select(*rows.columns).unionByName(rows.where(F.size("_s") == 0)), "chains")


def path_templates(urls: DataFrame, many: int = MANY, share: float = SHARE, alike: float = ALIKE, skip: int = SKIP) -> DataFrame:
    """Template of every distinct ``(host, path)`` of ``urls(host, path, n, n_label, n_block)``, a table of counts.

    Step by step, a branch is a host with the template so far. Its children are the next segments, by shape; where
    there are more than ``many``, those with less than ``share`` of the rows become ``*``. Siblings whose own children
    have like shapes (total variation to the pooled siblings at most ``alike``) and whose blocked labels agree (both
    unlabelled, or rates within 0.25 after smoothing) merge into ``~``. Adds ``template``.

    Each step is a pre-aggregated count and a join on the branch, and its result is written and read back, so plans don't
    grow. Steps go on while a branch has two urls with segments left; an only one keeps its segments as they are. Where more than
    ``skip`` segments are left, chains without a fork are skipped first, so steps go by the forks of a path, not by its length."""
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = written(urls.withColumns({"_s": F.transform(segs, shape), "template": F.lit("")}), "segments")
    columns = rows.columns
    while deepest := rows.agg(F.max(F.size("_s"))).first()[0]:
        left = rows.where(F.size("_s") > 0)
        if left.groupBy("host", "template").count().where("count > 1").isEmpty():
            whole = F.concat("template", F.lit("/"), F.array_join("_s", "/"))
            rows = rows.withColumn("template", F.when(F.size("_s") > 0, whole).otherwise(F.col("template")))
            break
        if deepest > skip:
            rows = skipped_chains(rows)
        rows = rows.withColumn("_c", F.get(F.col("_s"), F.lit(0)))
        below = F.coalesce(F.get(F.col("_s"), F.lit(1)), F.lit(""))
        kind = F.when(below == "", "end").when(below.startswith("{9}"), "number").when(below.startswith("{x9}"), "code").otherwise("word")
        kinds = ("end", "number", "code", "word")
        sums = lambda names: [F.sum(c).alias(c) for c in names]
        shares = [F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds]
        of = lambda *c: F.xxhash64(*c)
        child = rows.where("_c IS NOT NULL").groupBy("host", "template", "_c").agg(*sums(("n", "n_label", "n_block")), F.count("*").alias("n_urls"), *shares)
        child = written(child.select("*", of("host", "template").alias("_branch"), of("host", "template", "_c").alias("_child")), "children")
        # a branch may hold a third of all urls: its totals are pre-aggregated and meet its children by hot_join
        totals = [F.sum(c).alias(f"all_{c}") for c in ("n", "n_label", "n_block", *kinds)]
        branch = child.groupBy("_branch").agg(F.count("*").alias("kids"), *totals)
        one = hot_join(child, branch, "_branch", hot_keys(branch, "_branch", "kids"))
        apart = [F.abs(F.col(k) / F.col("n") - F.col(f"all_{k}") / F.col("all_n")) for k in kinds]
        one = one.withColumn("tv", (apart[0] + apart[1] + apart[2] + apart[3]) / 2)
        rate = lambda b, n: (F.col(b) + 1) / (F.col(n) + 2)
        merged = (F.col("kids") > 1) & (F.col("tv") <= alike) & (((F.col("n_label") == 0) & (F.col("all_n_label") == 0)) | ((F.col("n_label") > 0) & (F.abs(rate("n_block", "n_label") - rate("all_n_block", "all_n_label")) <= 0.25)))
        name = F.when((F.col("kids") > many) & (F.col("n") < share * F.col("all_n")), F.lit("*")).when(merged & ~F.col("_c").startswith("{"), F.lit("~")).otherwise(F.col("_c"))
        one = one.select("_child", name.alias("_name"))
        deep = rows.where("_c IS NOT NULL").withColumn("_child", of("host", "template", "_c"))
        named = hot_join(deep, one, "_child", hot_keys(child, "_child", "n_urls")).withColumns({"template": F.concat("template", F.lit("/"), F.col("_name")), "_s": F.slice("_s", F.lit(2), F.greatest(F.size("_s"), F.lit(1)))})
        rows = written(named.select(*columns).unionByName(rows.where("_c IS NULL").select(*columns)), "level")
    return rows.drop("_s")


def url_verdicts(pages: DataFrame, rules=RULES, smooth: float = SMOOTH, reject: float = REJECT) -> DataFrame:
    """Judge every row by its url; the columns of ``pages`` (but those named like an output) stay.

    Rule hits decide, and label the distinct urls for the method: a template's purity is its share of blocked labels,
    smoothed towards the same template over all hosts, that one towards the whole corpus, each with ``smooth``
    pseudo-labels; from ``reject`` on its urls are blocked. A corpus without labels has purity 0. Rows with an empty host
    and path form the empty template. Output: host, path, rule, template, purity, verdict. Equal urls get equal verdicts.
    """
    made = ["host", "path", "rule", "template", "purity", "verdict"]
    own = [c for c in pages.columns if c not in made]
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    parsed = parse_urls(pages.select(*own)).withColumns({"rule": rule, "_action": action})
    urls = parsed.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_action").isNotNull(), 1).otherwise(0)).alias("n_label"), F.sum(F.when(F.col("_action") == "block", 1).otherwise(0)).alias("n_block"))
    tree = path_templates(urls)
    whole = tree.agg(F.sum("n_block").alias("gb"), F.sum("n_label").alias("gl"))
    prior = F.when(F.col("gl") > 0, F.col("gb") / F.col("gl")).otherwise(0.0)
    shared = tree.groupBy(F.col("template").alias("_t")).agg(F.sum("n_block").alias("tb"), F.sum("n_label").alias("tl"))
    own_t = tree.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t2")).agg(F.sum("n_block").alias("hb"), F.sum("n_label").alias("hl"))
    judged = own_t.join(shared, F.col("_t2") == F.col("_t")).join(F.broadcast(whole))  # one row
    middle = (F.col("tb") + smooth * prior) / (F.col("tl") + smooth)
    judged = judged.withColumn("purity", (F.col("hb") + smooth * middle) / (F.col("hl") + smooth)).select("_h", F.col("_t2"), "purity")
    template_of, url_of = F.xxhash64("host", "template"), F.xxhash64("host", "path")
    hot = hot_keys(tree.groupBy(template_of.alias("_template")).agg(F.count("*").alias("_rows")), "_template", "_rows")
    by_url = hot_join(tree.withColumn("_template", template_of), judged.select(F.xxhash64("_h", "_t2").alias("_template"), F.col("_h").alias("host"), F.col("_t2").alias("template"), "purity"), "_template", hot, ("host", "template"))
    by_url = by_url.select(url_of.alias("_url"), "host", "path", "template", "purity")
    # one url, as that of rows without any, may be a third of all rows
    out = hot_join(parsed.withColumn("_url", url_of), by_url, "_url", hot_keys(tree.select(url_of.alias("_url"), "n"), "_url", "n"), ("host", "path"))
    return out.withColumn("verdict", F.coalesce("_action", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))).select(*own, *made)
