"""The corpus pipeline, stage by stage, and its registered queries' oracles."""

import duckdb
import pytest

import corpus_pipeline
from porespan.llm import near_dedup, queries, substring_dedup, toxicity
from porespan.llm.common import table
from tests.test_queries import canonical


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).persist()
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, table(spark, sf, "labels")).collect()}
            assert ids(out) == {d for d, p in scores.items() if not p}
        if name == "near_dedup":
            groups = near_dedup.near_duplicates(docs).collect()
            assert ids(out) == {r.component_id for r in groups}
        if name == "substring_dedup":
            assert substring_dedup.passages(out).count() <= 0.1 * substring_dedup.passages(docs).count() + 1
            assert ids(out) <= ids(docs)
        if name == "mixing":
            assert ids(out) <= ids(docs)
        if name != "segmentation":
            assert out.columns == columns
        else:
            assert ids(out) == ids(docs) and out.where("ids IS NULL").count() == 0
        docs = out


def test_near_dedup_judges_rows_without_a_key_of_their_own(spark, sf):
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    near = text("d").replace("d39", "other")
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (3, text("c")), (3, text("e")), (1, text("c")), (5, text("d")), (None, near), (7, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {(None, text("a")), (None, text("b")), (3, text("e")), (1, text("c")), (5, text("d")), (7, None), (None, None)}
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one(spark, df, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_cut_repeats_by_key_and_text(spark, sf):
    """A row's passages are cut from that row alone: another text under the same key, and rows without a key, stay as they are."""
    word = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    passage = word("p", 70)
    rows = [(1, passage + " " + word("a", 20)), (2, word("b", 9) + " " + passage), (2, word("c", 100)), (None, passage), (None, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.cut_repeats(spark, df, sf).collect()), key=str)
    # of the two texts under key 2 the one with the least hash is searched
    searched = min([rows[1][1], rows[2][1]], key=lambda t: spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t)").first()[0])
    want = [(d, word("b", 9) + " " if t == rows[1][1] and searched == t else t) for d, t in rows]
    assert got == sorted(want, key=str)


def test_stages_on_awkward_rows(spark, sf):
    """Nulls in any column, empty and long texts, repeated rows, repeated keys and an empty table pass through every stage."""
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "lonely words " * 30, "en", None, 3), (None, None, None, None, None), (5, long, "en", "a", 9), (5, long, "en", "a", 9), (5, "another text", "de", "b", 12), (7, " \n ", "en", "b", 3), (8, "x" * 3000, "en", "c", 3000)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), table(spark, sf, "documents").limit(0)):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = out.collect()
            if not df.head(1):
                assert not got
            elif name in ("near_dedup", "substring_dedup"):
                assert {(r.doc_id, r.text) for r in got} == {r[:2] for r in rows}
            if name != "segmentation":
                assert out.columns == df.columns
                docs = spark.createDataFrame(got, df.schema)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), columns)
