import random

import numpy as np
import pytest

from voltloom.llm import bpe, pack, plans, sizes, split
from voltloom.sources.tables import cut

PATH = bpe.tokenizer_path("byte_bpe_50k")
TEXTS = [
    None, "", " ", "a", "Hello, world's end!\r\n\r\n  two", "日本語の文。次の文！\n\nÅngström ﬁ 🤖🤖 é", "<|endoftext|> is text", "x" * 700 + " " + "=" * 400, "   a　b\t\t\n \n", "\x00\x01﻿​",
    " ".join(f"w{i}zq{i * 7919 % 997}" for i in range(6000)), "Hello, world's end!\r\n\r\n  two", "0123456789 " * 50, "don't we'll I'M", "ab\u0000cd \u0000",
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, "a", "x", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, Text_ string, id int")


def expected(text):
    return sizes.encoding(PATH).encode_ordinary(text or "")


@pytest.mark.parametrize("cache, words", [(True, 16_384), (False, 16_384), (False, 100)])
def test_encode(documents, monkeypatch, cache, words):
    monkeypatch.setattr(bpe, "FLAT_WORDS", words)
    got = bpe.encode(documents, PATH, cache=cache).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert list(r.ids) == expected(TEXTS[r.doc_id]), r.doc_id


def test_round_trip_and_odd_ids(spark, documents):
    got = bpe.decode(bpe.encode(documents, PATH), PATH).collect()
    assert {r.doc_id: r.text for r in got} == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([([31373, -1, None, 999_999],), ([],), (None,)], "ids array<int>")
    assert [r.text for r in bpe.decode(odd, PATH).collect()] == ["hello", "", None]


def test_heap_is_the_fold():
    b = bpe.tables(PATH)
    rng = random.Random(0)
    for n in (1, 2, 5, 40, 600):
        for alphabet in ("a", "ab", "etaoin shr", "結果のé"):
            w = "".join(rng.choice(alphabet) for _ in range(n))
            assert bpe.heap_encode(w.encode(), b.byte_ids, b.pairs) == sizes.encoding(PATH)._core_bpe.encode_single_piece(w.encode())


def test_fold_of_many_words_is_the_heap():
    b = bpe.tables(PATH)
    rng = random.Random(1)
    words = [bytes(rng.choice(s) for _ in range(rng.randrange(1, n))) for n in (2, 9, 257) for s in (b"a", b"ab =", b"0123456789abcdef", range(256)) for _ in range(60)]
    for some in (words, words[:1], words[-7:], []):
        ids, counts = b.merges.fold(some)
        one = [bpe.heap_encode(w, b.byte_ids, b.pairs) for w in some]
        assert counts.tolist() == list(map(len, one)) and ids.tolist() == sum(one, [])
    assert b.merges.pairs() == b.pairs


@pytest.mark.parametrize("at_once, remember", [(3, 5), (3, 0), (16_384, 4), (1, 50_000)])
def test_words_are_remembered_over_batches(spark, monkeypatch, at_once, remember):
    monkeypatch.setattr(bpe, "FLAT_WORDS", at_once)
    monkeypatch.setattr(bpe, "CACHE_WORDS", remember)
    rng = random.Random(2)
    texts = [" ".join(f"zq{rng.randrange(30)}xv{'k' * rng.choice([1, 300])}" for _ in range(rng.randrange(6))) for _ in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), PATH).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: list(r.ids) for r in got} == {i: expected(t) for i, t in enumerate(texts)}


def test_unknown_words_cost_little(spark):
    """CPU seconds of the ids of texts of words that are no tokens, against those of their words alone."""
    import psutil

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("bcdfghjkqvwxz", k=14)) for _ in range(800)) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4).localCheckpoint()

    def cost(x):
        used = lambda: sum(sum(p.cpu_times()[:2]) for p in psutil.Process().children(recursive=True))
        began = used()
        x.write.format("noop").mode("overwrite").save()
        return used() - began

    split, encoded = df.select(bpe._words(df.text)), bpe.encode(df, PATH)
    cost(split), cost(encoded)
    alone, all_of_it = max(cost(split) for _ in range(2)), min(cost(encoded) for _ in range(2))
    assert all_of_it < 12 * alone, (all_of_it, alone)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(none, PATH).count() == 0
    assert sizes.sizes(none, PATH).count() == 0
    assert pack.pack(sizes.sizes(none, PATH), {1: 10}, cut).count() == 0
    assert split.split(none, PATH, [(1, 10, 2)]).count() == 0


def test_sizes(documents):
    assert {r.id: r.n for r in sizes.sizes(documents, PATH).collect()} == {i: len(expected(t)) for i, t in enumerate(TEXTS)}


def test_lower_bound_and_packing():
    assert pack.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert pack.lower_bound(np.array([5] * 4), 10) == 2
    assert pack.lower_bound(np.array([4, 4, 4, 4]), 10) == 2
    rng = np.random.default_rng(1)
    for capacity in (1, 2, 7, 100, 513):
        s = np.sort(rng.integers(1, capacity + 1, 300))[::-1]
        bins = pack.best_fit_decreasing(s, capacity)
        fill = np.bincount(bins, weights=s)
        assert fill.max() <= capacity and (fill > 0).all()
        assert max(-(-s.sum() // capacity), (s > capacity / 2).sum()) <= pack.lower_bound(s, capacity) <= len(fill)


@pytest.mark.parametrize("per_group", [30, 10_000])
def test_containers(spark, per_group):
    rng = random.Random(per_group)
    n = {i: rng.choice([0, 1, 5, 99, 100, 101, 250, rng.randrange(1, 90)]) for i in range(400)}
    items = spark.createDataFrame(list(n.items()), "id bigint, n bigint")
    rows = pack.pack(items, {1: 100, 2: 33}, cut, per_group=per_group).collect()
    for limit, capacity in ((1, 100), (2, 33)):
        own = [r for r in rows if r.limit_id == limit]
        fill, parts = {}, {}
        for r in own:
            fill[r.container] = fill.get(r.container, 0) + r.n
            parts.setdefault(r.id, []).append((r.start, r.n))
        assert max(fill.values()) <= capacity
        assert set(parts) == {i for i, x in n.items() if x}
        for i, p in parts.items():
            p.sort()
            assert p[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(p, p[1:])) and sum(b for _, b in p) == n[i]
            assert len(p) == 1 or n[i] > capacity
        assert len(fill) <= 1.1 * sum(n.values()) / capacity + 400 // per_group + 2


def test_pieces(spark, documents):
    limits = [(1, 20, 5), (2, 64, 0), (3, 12, 4)]
    rows = split.split(documents.where("doc_id < 100"), PATH, limits).collect()
    by = {}
    for r in rows:
        by.setdefault((r.limit_id, r.id), []).append(r)
    count = lambda t: len(expected(t))
    for limit, capacity, overlap in limits:
        assert {i for l, i in by if l == limit} == {i for i, t in enumerate(TEXTS) if t and count(t) > capacity}
        for (l, i), ps in by.items():
            if l != limit:
                continue
            ps.sort(key=lambda r: r.piece)
            text, end = TEXTS[i], 0
            assert [p.piece for p in ps] == list(range(len(ps)))
            for p in ps:
                assert text[p.start_char : p.start_char + p.n_chars] == p.text and count(p.text) <= capacity and p.n_tokens <= capacity
                assert p.start_char <= end < p.start_char + p.n_chars
                if p.piece:
                    assert overlap <= p.overlap_tokens <= overlap + 4
                end = p.start_char + p.n_chars
            assert end == len(text)
    with pytest.raises(ValueError):
        split.split(documents, PATH, [(1, 5, 5)])


def test_impossible_limits(spark):
    df = spark.createDataFrame([(1, "日本語🤖🤖" * 3), (2, "abc def ghi " * 4)], "doc_id bigint, text string")
    for capacity, overlap in ((7, 6), (1, 0)):
        rows = split.split(df, PATH, [(1, capacity, overlap)]).orderBy("id", "piece").collect()
        for i in (1, 2):
            own, end, text = [r for r in rows if r.id == i], 0, df.where(f"doc_id = {i}").first().text
            for r in own:
                assert r.start_char <= end and text[r.start_char : r.start_char + r.n_chars] == r.text
                assert len(expected(r.text)) <= capacity or r.n_chars == 1
                end = r.start_char + r.n_chars
            assert end == len(text)


def test_cuts_prefer_natural_boundaries():
    text = ("word " * 30 + "\n\n") * 3
    enc = sizes.encoding(PATH)
    ids = np.array(enc.encode_ordinary(text))
    ends = np.concatenate([[0], np.cumsum([len(enc.decode_single_token_bytes(i)) for i in ids])])
    strong = split.strengths(text.encode(), ends)
    cut_at = split.cuts(len(ids), 40, 0, strong, lambda s, e: e - s <= 40)
    assert all(strong[e] >= 3 for _, e in cut_at)


def test_search_for_cuts_is_short():
    calls = []

    def fits(s, e):
        calls.append((s, e))
        return e < n or e - s <= 1

    for n in (2_000, 8_000):
        calls.clear()
        found = split.cuts(n, 64, 16, np.zeros(n + 1, np.int8), fits)
        assert (found is None or found[-1][1] == n) and len(calls) < 40 * n


def test_overlap_short_is_marked(spark):
    df = spark.createDataFrame([(1, "abc def ghi " * 40)], "doc_id bigint, text string")
    rows = split.split(df, PATH, [(1, 20, 5)]).collect()
    assert not any(r.overlap_short for r in rows) and all(r.overlap_tokens >= 5 for r in rows if r.piece)
    df = spark.createDataFrame([(1, "日本語🤖🤖" * 3)], "doc_id bigint, text string")
    rows = split.split(df, PATH, [(1, 7, 6)]).collect()
    assert all(r.overlap_short == (r.piece > 0 and r.overlap_tokens < 6) for r in rows) and any(r.overlap_short for r in rows)


@pytest.mark.parametrize("name", ["p6_sizes", "p7_holds", "p8_holds"])
def test_what_holds(spark, name):
    rows = plans.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.holds for r in rows)


def test_plans_are_registered():
    assert set(plans.oracle_sql()) <= set(plans.queries()) and "p6_ids" in plans.queries()
