"""Conversation trie, whitening and repeated windows against plain versions, with nulls, ties, copies and empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import CLASHES, SF, frame

TURNS = "conv_id long, turn long, role string, text string"


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def turns_frame(spark, rows):
    return spark.createDataFrame(rows, TURNS).repartition(3).withColumns(
        {c: F.lit("x") for c in [*CLASHES, "x", "d", "n", "key", "pos", "w", "_key", "conv", "depth"]})


# Conversation trie -------------------------------------------------------------------------------------------

def odd_conversations():
    """Copies, prefixes of each other, ties, repeated rows, nulls, negative ids and one long conversation."""
    rnd = random.Random(8)
    rows = [(None, 0, "user", "belongs nowhere"), (7, None, None, None), (7, None, None, None), (7, 0, "", ""), (7, 0, "user", "ä"),
            (-3, 1, "user", "x"), (-5, 1, "user", "x"), (-5, 0, None, "y"), (11, 0, "a", "b:c"), (12, 0, "a", "b:c"), (13, 0, "ab", ":c")]
    for c in range(20, 60):  # one sequence of turns, cut at many lengths
        rows += [(c, t, "user", f"common {t}") for t in range(rnd.randint(1, 14))]
    for c in range(60, 90):  # few choices a turn, so paths part everywhere
        rows += [(c, t, "user", rnd.choice("ab")) for t in range(rnd.randint(1, 12))]
    rows += [(95, t, "user", f"common {t}" if t < 300 else f"own {t}") for t in range(400)]
    return rows


def test_trie_of_odd_conversations(spark):
    from lendscope.llm.prefix_trie import shared_head_trie
    rows = odd_conversations()
    assert trie_rows(shared_head_trie(turns_frame(spark, rows))) == brute.trie(brute.rebuilt_conversations(rows))


def test_trie_in_small_blocks_and_without_heads(spark, monkeypatch):
    """Sums and ends of edges carried over blocks of 16 turns, fingerprints joined from rows; sequences as they are."""
    from lendscope.llm import prefix_trie
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "SHORT", 16)
    rows = odd_conversations()
    turns = prefix_trie.numbered_turns(turns_frame(spark, rows))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).unionByName(
        spark.createDataFrame([(1000, 0), (1001, 0)], "conv_id long, n long"))
    own = {c: v for c, v in _own(rows).items()} | {1000: [], 1001: []}
    assert trie_rows(prefix_trie.prefix_trie(turns.join(convs, "conv_id"), convs)) == brute.trie(own)


def _own(rows):
    """Turns in order without the families' heads."""
    heads, brute.head_turns = brute.head_turns, lambda c: 0
    try:
        return brute.rebuilt_conversations(rows)
    finally:
        brute.head_turns = heads


def test_trie_of_many_equal_conversations(spark):
    """An end node with more members than a piece of its list."""
    from lendscope.llm.prefix_trie import PIECE, shared_head_trie
    rows = [(c, t, "user", f"same {t}") for c in range(3 * PIECE) for t in range(9)]
    assert trie_rows(shared_head_trie(turns_frame(spark, rows))) == brute.trie(brute.rebuilt_conversations(rows))


def test_trie_of_turnless_conversations_and_of_nothing(spark):
    from lendscope.llm.prefix_trie import shared_head_trie
    assert trie_rows(shared_head_trie(turns_frame(spark, []))) == []
    rows = [(c, 0, "user", "t") for c in range(101, 140) if c % 5 and brute.head_turns(c)]
    want = brute.trie(brute.rebuilt_conversations(rows))
    assert len(want) == 1 and trie_rows(shared_head_trie(turns_frame(spark, rows))) == want


def test_two_fattest(spark):
    from lendscope.llm.prefix_trie import two_fattest
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)] + [(2 ** 40, 2 ** 40 + 5)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda i: (i & -i))


# Whitening ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["even", "steep", "ties", "rank", "scalar"])
@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_spectral_division(kind, n):
    from lendscope.llm.whitening import leading_eigenvectors
    rnd = np.random.default_rng(n)
    q = np.linalg.qr(rnd.standard_normal((n, n)))[0]
    e = {"even": rnd.random(n) * 100, "steep": 10.0 ** rnd.uniform(-9, 3, n), "ties": rnd.integers(1, 4, n).astype(float),
         "rank": np.r_[np.ones(n - n // 2), np.zeros(n // 2)], "scalar": np.full(n, 3.3)}[kind]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    k = min(16, n)
    values, vectors = leading_eigenvectors(v, k)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=0, atol=1e-13 * e.max())
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-12 * e.max())


def plain_whitening(x, fit):
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, s, (x - s / n) @ q[:, ::-1] / np.sqrt(e[::-1]), e[::-1] / np.trace(v), ((n * x - s) ** 2).sum(1)


def test_whitening_of_the_table(spark):
    from lendscope.llm.whitening import op12_qdwh_whitening
    got = op12_qdwh_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"], kind="stable")
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id", kind="stable")
    x = np.floor(64 * np.stack(e["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, _, white, explained, deviation = plain_whitening(x, np.unique(x, axis=0))
    assert list(got["component"][:16]) == list(range(1, 17)) and set(got["n"]) == {n}
    w = got["whitened"].to_numpy().reshape(-1, 16)
    sign = np.sign((w * white[:, :16]).sum(0))
    assert np.abs(w * sign - white[:, :16]).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy()[:16], explained[:16], rtol=1e-9)
    assert got["identity_error"].max() < 1e-10
    assert (got["deviation"].to_numpy().reshape(-1, 16)[:, 0] == deviation).all()


def test_whitening_of_odd_rows(spark):
    from lendscope.llm.whitening import whiten
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 5.0]), (8, [-1.0, 0.5]), (8, [-1.0, 0.501]), (9, [1e4, 3.0])]
    bad = [(3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, []), (7, [inf, 0.0]), (7, [0.0, -inf])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, n string, component int")
    x = np.floor(64 * np.array([v for _, v in good])).astype(int) + 1_000_000
    _, _, white, explained, _ = plain_whitening(x.astype(object).astype(float), np.unique(x, axis=0).astype(float))
    rows = whiten(df).collect()
    assert Counter(r.vec_id for r in rows) == {1: 4, None: 2, 8: 4, 9: 2} and {r.n for r in rows} == {4}
    fit, s = {tuple(v) for v in x.tolist()}, [sum(v[j] for v in {tuple(v) for v in x.tolist()}) for j in range(2)]
    exact = sorted(sum((len(fit) * v[j] - s[j]) ** 2 for j in range(2)) for v in x.tolist() for _ in range(2))
    assert sorted(int(r.deviation) for r in rows) == exact
    for c in (1, 2):
        got = sorted(abs(r.whitened) for r in rows if r.component == c)
        assert np.allclose(got, sorted(np.abs(white[:, c - 1])), atol=1e-6)
    assert whiten(df.limit(0)).collect() == [] and whiten(df.where("vec_id = 1")).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 4.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r.component for r in whiten(flat).collect()} == {1}
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


# Repeated windows --------------------------------------------------------------------------------------------

def passages(seed=4):
    """Shared passages in changing places, copies, edited copies, repeats inside a text, equal and null ids."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "ö", f"w{rnd.randrange(300)}"])
    some = lambda n: [word() for _ in range(n)]
    shared = [some(n) for n in (49, 50, 51, 64, 80, 130)]
    docs = []
    for i in range(120):
        ws = some(rnd.randint(0, 90))
        for _ in range(rnd.randint(0, 3)):
            ws += rnd.choice(shared) + some(rnd.randint(0, 40))
        docs.append((rnd.randrange(150), rnd.choice([" ", "\n", " \t "]).join(ws)))
    for i, t in rnd.sample(docs, 30):  # copies with a word changed
        ws = t.split()
        if ws:
            ws[rnd.randrange(len(ws))] = "other"
        docs.append((rnd.randrange(150), " ".join(ws)))
    twice = some(60)
    docs += [(500, " ".join(twice + some(7) + twice)), (500, " ".join(twice)), (500, " ".join(twice)), (None, " ".join(shared[5])),
             (None, " ".join(shared[5])), (None, None), (3, None), (4, ""), (5, " \n"), (600, " ".join(["same"] * 400)), (601, " ".join(["same"] * 49)),
             (602, " ".join(["same"] * 50)), (603, "x\xa0y " * 60), (604, "x\xa0y " * 60), (605, " ".join(shared[0]))]
    return docs


@pytest.mark.parametrize("window", [50, 21, 3, 1])
def test_repeated_windows(spark, window):
    from lendscope.llm.cover_dedup import remove_repeats
    docs = passages()
    df = frame(spark, [(i, t, None, None) for i, t in docs]).withColumns({c: F.lit(0) for c in ("chunk", "bucket", "keys", "n_words")})
    got = remove_repeats(df, window).collect()
    want = brute.without_repeated_windows(docs, window)
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_bytes).decode(), r.kept_sha256) for r in got) == \
        Counter((i, n, gone, kept, brute.sha(kept)) for (i, _), (n, gone, kept) in zip(docs, want, strict=True))
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_repeated_windows_of_nothing(spark, empty):
    from lendscope.llm.cover_dedup import remove_repeats
    assert remove_repeats(empty).collect() == []


def test_covers_hold_every_difference():
    from lendscope.llm.cover_dedup import COVERS, Cover
    for v, d in COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert [(Cover.of(w).period, Cover.of(w).anchor) for w in (50, 49, 21, 12, 11)] == [(31, 20), (13, 37), (13, 9), (7, 6), (1, 11)]
