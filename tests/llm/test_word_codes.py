"""Word codes that no rule makes alike, and what depends on them."""

import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from porespan.llm import near_dedup, pieces, substring_dedup, words
from porespan.llm.common import table

#: Words whose polynomials modulo 2**64 are equal whatever the base: the Thue-Morse word and its complement.
ONE, OTHER = ("".join("ab"[i.bit_count() % 2 ^ flip] for i in range(1024)) for flip in (0, 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aAbBé漢 \t\n\x1c z", max_size=40), max_size=12), st.integers(1, 40))
def test_equal_codes_are_equal_words(parts, repeat):
    text = " ".join(p * repeat for p in parts)
    lower = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    codes = words.word_codes(text).tolist()
    assert len(codes) == len(found)
    assert len(set(codes)) == len(set(found)) and len(set(zip(codes, found, strict=True))) == len(set(found))


def test_codes_of_all_documents_are_apart(spark, sf):
    names = {}
    for r in table(spark, sf, "documents").collect():
        for w, c in zip([w for w in (r.text or "").encode().lower().split()], words.word_codes(r.text).tolist(), strict=True):
            assert names.setdefault(c, w) == w
    assert len(names) > 1000


def test_windows_of_codes():
    codes = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2, 3], dtype=np.uint64)
    for n in (1, 2, 3, 5):
        h = words.windows(codes, n)
        same = [[(codes[i : i + n] == codes[j : j + n]).all() for j in range(len(h))] for i in range(len(h))]
        assert ((h[:, None] == h[None, :]) == np.array(same)).all()
    assert not len(words.windows(codes, 11))
    a, b = words.codes_of(words.as_bytes(" ".join(ONE))), words.codes_of(words.as_bytes(" ".join(OTHER)))
    assert words.windows(a, 1024)[0] != words.windows(b, 1024)[0]


def test_unlike_texts_of_alike_words(spark):
    """Neither linked nor taken for one another."""
    assert words.word_codes(ONE) != words.word_codes(OTHER)
    rows = [(1, f"{ONE} first second"), (2, f"{OTHER} first second"), (3, ONE), (4, OTHER), (5, " ".join(f"{ONE}{i}" for i in range(60))), (6, " ".join(f"{OTHER}{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, k=3, percent=85).collect()} == {i: i for i, _ in rows}
    assert substring_dedup.passages(docs).count() == 0
    drawn = pieces.sample_segmentations(docs.coalesce(1), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id for r in drawn} == {i for i, _ in rows} and all(r.decoded == dict(rows)[r.doc_id] for r in drawn)


def test_rows_that_share_a_key_are_linked_by_their_own_sets(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    x, y = some(200), some(200)
    rows = [(1, x), (3, y), (7, f"{x} q"), (7, f"{y} q"), (7, f"{y} q"), (None, f"{y} q"), (7, some(50)), (9, some(50))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    by_text = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, k=3, percent=85).collect())
    assert by_text == [(0, 3, False), (1, 1, True), (3, 3, True), (7, 1, False), (7, 3, False), (7, 3, False), (7, 7, True), (9, 9, True)]


def test_one_key_for_all_rows(spark):
    """Every set is its own vertex, so a key that all rows share brings no more work than others."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(5, t) for t in texts] * 2, "doc_id bigint, text string")
    got = near_dedup.near_duplicates(df, k=3, percent=85).collect()
    assert len(got) == 600 and all(r.component_id == 5 and r.kept for r in got)


def test_sets_stay_exact_beside_rows_without_words(spark):
    """Null numbers in a batch don't round the long ones beside them, keys included."""
    text = " ".join(f"w{i}" for i in range(40))
    big = 2**62 + 1
    rows = [(big, text), (None, ""), (big + 2, text.replace("w39", "x")), (big + 4, None), (big + 6, text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = sorted((r.doc_id or 0, r.component_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, None), (big, big), (big + 2, big), (big + 4, big + 4), (big + 6, big)]
    loose = near_dedup.sketched(df, "doc_id", "text", 5, 10, 5).where("n_shingles = 36").select("fp1").distinct().count()
    assert loose == 2
