"""Operators 11 to 13 against brute force, on small tables and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from porespan.llm import lexical, packing, queries, vector_codes
from porespan.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTE_BPE)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- 11: vector codes


def brute_nearest(p, book):
    d = [sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in book]
    return d.index(min(d)), min(d)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 4, 16, 64]), st.sampled_from([3, 1 << 10, 1 << 20, 1 << 24]))
def test_nearest_is_exact(seed, width, size):
    """Also where float32 can't tell entries apart: neighbours of one far point, ties and repeated entries."""
    rng = np.random.default_rng(seed)
    book = rng.integers(-size, size + 1, (20, width))
    book[5:10] = np.clip(book[4] + rng.integers(-1, 2, (5, width)), -size, size)
    book[10] = book[3]
    points = np.concatenate([rng.integers(-size, size + 1, (20, width)), np.clip(book + rng.integers(-1, 2, book.shape), -size, size), book])
    index, distance = vector_codes.nearest(points, book)
    assert [(i, d) for i, d in zip(index.tolist(), distance.tolist(), strict=True)] == [brute_nearest(p, book) for p in points]


def test_float32_alone_would_be_wrong():
    rng = np.random.default_rng(3)
    book = np.repeat(rng.integers(-(1 << 24), 1 << 24, (1, 16)), 64, axis=0) + rng.integers(-2, 3, (64, 16))
    book = book.clip(-(1 << 24), 1 << 24)
    plain = ((book.astype(np.float32) ** 2).sum(1) - 2 * (book.astype(np.float32) @ book.astype(np.float32).T)).argmin(1)
    index, _ = vector_codes.nearest(book, book)
    want = np.array([brute_nearest(p, book)[0] for p in book])
    assert (index == want).all() and (plain != want).any()


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(k, [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(k, v + [0] * (parts * width - len(v)), lab) for k, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[brute_nearest(cut(v, p), books[p])[0]].append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for k, v, lab in kept:
        found = [brute_nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((k, lab, "".join(f"{i:02x}" for i, _ in found), sum(d for _, d in found)))
    sums = Counter()
    for _, lab, _, d in out:
        sums[lab] += d
    return Counter((k, code, d, sums[lab], sha) for k, lab, code, d in out)


VECTORS = "vec_id bigint, embedding array<float>, label int, id string, code int, v int"


def codes(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect())


def test_codes_equal_brute_force(spark, sf):
    t = table(spark, sf, "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in t.collect()]
    got = Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in queries.op11_vector_codes(spark, sf).collect())
    assert got == brute_codes(rows)
    assert codes(t.repartition(7).selectExpr("*", "'x' AS id", "1 AS code", "2 AS v")) == got


def test_codes_of_awkward_rows(spark):
    """Null vectors and components, NaN, infinities, huge values, short and empty vectors, ties, repeats, null keys and labels."""
    rng = random.Random(5)
    v = lambda n=20: [rng.uniform(-1, 1) for _ in range(n)]
    same = [0.25] * 20
    rows = [(1, None, 1), (2, [], 1), (3, [None, 1.0], 2), (4, [float("nan")] * 20, 2), (5, [float("inf")] * 20, None), (6, [3e38] * 20, None), (7, [-3e38, 0.5], None), (None, v(), 3), (8, same, 3), (8, same, 3), (8, v(), None), (9, v(3), 1)]
    rows += [(10 + i, v(), i % 3) for i in range(90)]
    f32 = lambda r: (r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], r[2])
    df = spark.createDataFrame([(*r, "x", 5, 6) for r in rows], VECTORS)
    assert codes(df) == brute_codes([f32(r) for r in rows])
    assert codes(df.limit(3)) == brute_codes(rows[:3]) and vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(df.where("vec_id IN (4, 5)")).count() == 0


# -- 12: packing


def packed(df, **kw):
    return packing.pack(df, BYTE_BPE, **kw).collect()


def assert_packed(rows, texts, capacity=1024):
    """Pieces cover the ids of the documents, as the library has them, and lie gapless in their sequences; the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(Counter)
    for k, t in texts:
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        for p, (a, b) in enumerate([(0, first), *((s, s + capacity) for s in range(first, len(ids), capacity))]):
            want[k][p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert {k: Counter((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in by_doc.items()} == want
    for v in by_sequence.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_all_documents(spark, sf):
    docs = table(spark, sf, "documents")
    got = queries.op12_packing(spark, sf).collect()
    n = assert_packed(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.03 * math.ceil(sum(r.length for r in got) / 1024) + 1
    again = packed(docs.repartition(9))
    assert len({r.sequence_id for r in again}) == n


def test_packing_of_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a <|endoftext|> b"), (5, long), (5, long), (None, "no key"), (6, "x" * 20000), (7, "é́ 你好 😀 " * 400), (8, "same"), (8, "same")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, piece int, part int, place int")
    assert_packed(packed(df), rows)
    assert packing.pack(df.limit(0), BYTE_BPE).count() == 0


def test_ids_are_the_librarys():
    """Over all assigned planes, each character in several surroundings; and texts cut in chunks anywhere that is allowed."""
    points = [c for c in (*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x30000, 7), 0xE0001, 0xE0100, 0x10FFFD)]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}. {chr(c)}{chr(c)} x" for c in points[at : at + 20_000]]
        encode = packing.encoder(BYTE_BPE)
        assert [encode(t).tolist() for t in texts] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", " ", "  ", "\n", "1", ".", "'s", "é", "<|endoftext|>", " the", "漢"]) for _ in range(60))
        assert packing.token_ids(t, BYTE_BPE, size=5).tolist() == [*LIBRARY.encode(t, add_special_tokens=False).ids, 2]


def least_sequences(lengths, capacity):
    """Fewest bins by search over all placements."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in {v: k for k, v in enumerate(bins)}.values():
            if bins[b] >= lengths[i]:
                go(i + 1, [*bins[:b], bins[b] - lengths[i], *bins[b + 1 :]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=9), st.sampled_from([4, 100]))
def test_plans_against_all_placements(lengths, groups):
    lengths.sort(reverse=True)
    slots, n = packing.plan(dict(Counter(lengths)), 32, groups)
    assert least_sequences(lengths, 32) <= n <= 1.5 * least_sequences(lengths, 32) + 1
    check_slots(slots, Counter(lengths), n, 32)


def check_slots(slots, lengths, n, capacity):
    placed, found = defaultdict(list), Counter()
    for length, first, number, per, sequence, offset in slots.tolist():
        found.update((length, first + i) for i in range(number))
        for i in range(number):
            placed[sequence + i // per].append((offset + i % per * length, length))
    assert found == Counter((k, i) for k, m in lengths.items() for i in range(m))
    assert set(placed) == set(range(n))
    for v in placed.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("groups", [8, 192])
def test_plans_of_many_documents(groups):
    rng = np.random.default_rng(4)
    lengths = Counter(rng.integers(1, 1025, 20_000).tolist())
    slots, n = packing.plan(dict(lengths), 1024, groups)
    check_slots(slots, lengths, n, 1024)
    least = math.ceil(sum(k * v for k, v in lengths.items()) / 1024)
    assert n <= (1.21 if groups == 8 else 1.012) * least
    hundred, m = packing.plan({k: 100 * v for k, v in lengths.items()}, 1024, groups)
    assert len(hundred) < 2 * len(slots) and m <= 100 * n  # the plan doesn't grow with the documents


def test_configurations_reach_the_linear_bound():
    found = packing.configurations([6, 5, 4, 3], [300, 300, 300, 300], 10)
    used = [sum(o[i] * n for o, n in found) for i in range(4)]
    assert all(sum(s * k for s, k in zip((6, 5, 4, 3), o, strict=True)) <= 10 for o, _ in found)
    assert all(u <= 300 for u in used) and sum(n for _, n in found) <= 550 and sum(300 - u for u in used) <= 12


# -- 13: lexical search


def brute_search(items, docs, top=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    counts = [(k, Counter(terms(t))) for k, t in docs if terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = defaultdict(set)
    for k, t in items:
        asked[k] |= set(terms(t))
    out = set()
    for item, words in asked.items():
        scored = []
        for k, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                scored.append((-score, k is None, k or 0, k))
        out |= {(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top], 1)}
    return out


def found(df):
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()}


def test_search_equals_brute_force(spark, sf, monkeypatch):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute_search([tuple(r) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    assert found(queries.op13_lexical_search(spark, sf)) == want
    monkeypatch.setattr(lexical, "SMALL", 0)  # nothing is broadcast
    assert found(lexical.ranked(docs.repartition(5), items)) == want


def test_search_of_a_whole_index(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = lexical.search(lexical.postings(docs), lexical.item_terms(items), 3)
    want = brute_search([tuple(r) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()], 3)
    assert {tuple(r) for r in got.collect()} == want


def test_search_of_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,!"), (4, "Alpha beta-gamma"), (5, "alpha beta gamma"), (5, "alpha beta gamma"), (None, "ALPHA É ñ \x00 beta"), (6, "w " * 50_000 + "alpha"), (7, "É ñ 你好 😀"), (8, "x_y z'0")]
    items = [(1, "alpha"), (1, "BETA, gamma"), (None, "é É"), (2, None), (3, "?!"), (4, "nothing here"), (5, "x y z 0"), (6, "你好 😀")]
    d = spark.createDataFrame([(*r, 1, "t", 3, 4) for r in docs], "doc_id bigint, text string, row int, term string, n int, score int")
    i = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id bigint, text string, rank int, item int")
    assert found(lexical.ranked(d, i)) == brute_search(items, docs)
    assert lexical.ranked(d.limit(0), i).count() == 0 and lexical.ranked(d, i.limit(0)).count() == 0 and lexical.ranked(d.where("doc_id < 4"), i).count() == 0


def test_search_of_parts_of_a_batch(spark):
    """Texts that fill several parts of a batch, among null ones: parts that begin at a multiple of eight rows are read as they are."""
    size = lexical.BYTES // 8
    docs = [(k, None if k % 16 == 3 else f"Alpha{k % 7} beta{k} ".ljust(size) if k % 16 < 9 else "gamma") for k in range(48)]
    items = [(1, "alpha1 gamma"), (2, "alpha2 beta9 beta17"), (3, "beta32 beta40 alpha5")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(lexical.ranked(d, i)) == brute_search(items, docs)


def test_long_documents_dont_overflow(spark):
    """Where 90 n N is beyond 63 bits the lengths go by decimals; the same numbers come out."""
    index = spark.createDataFrame([(lexical.BUCKETS, "", 1, 1, 10**18, 10**18), (0, "", 2, 2, 5, 5), (0, "a", 1, 1, 4, 10**18), (0, "a", 2, 2, 1, 5)], "bucket int, term string, row long, id long, tf long, n long")
    index = index.withColumn("bucket", lexical.bucket_of(index.term))
    wanted = spark.createDataFrame([(1, "a")], "item long, term string")
    w = math.floor(1000 * math.log(6 / 5))
    part = lambda tf, n: w * (10**9 * tf // (1000 * tf + 8 * (10 + 90 * n * 2 // (10**18 + 5))))
    assert {(r.id, r.score) for r in lexical.search(index, wanted).collect()} == {(1, part(4, 10**18)), (2, part(1, 5))}
