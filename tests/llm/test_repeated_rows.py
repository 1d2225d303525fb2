"""Rows that repeat an id or have none, and words built so that simple hashes agree."""

from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import frame


@pytest.mark.parametrize("repeated", [5, None])
def test_mix_exchanges_one_row_of_many_equal_ones(spark, repeated):
    """Each source comes as near to its target as one exchange can bring it, whether its rows share an id or not."""
    from lendscope.llm.mixing import mix
    rows = []
    for s in range(30):
        rows += [(repeated, " ".join(["w"] * 20), f"s{s}", None)] * 8 + [(1000 + 10 * s + i, " ".join(["w"] * 47), f"s{s}", None) for i in range(6)]
    got = defaultdict(list)
    for r in mix(frame(spark, rows)).collect():
        got[r.source].append((r.target, r.taken, r.copies, r.size))
    assert sum(map(len, got.values())) == len(rows)
    for s in got.values():
        assert abs(s[0][0] - sum(x[1] for x in s)) <= 23.5  # half the longest document


def test_repeated_labelled_documents_are_one_trial(spark):
    """Two hundred clean documents certify nothing, and no more when each occurs ten times."""
    from lendscope.llm.quality import cutoffs, text_counts
    text = " ".join(f"word{i}" for i in range(80))
    junk = " ".join(["#" * 30 + f"x{i}" for i in range(80)])
    once = [(i, text, "s", "en") for i in range(200)] + [(1000 + i, junk, "s", "en") for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(50)], "doc_id long, quality int")
    for times in (1, 10):
        counts = text_counts(frame(spark, once * times))
        assert cutoffs(counts, labels).count() == 0
    many = [(i, text, "s", "en") for i in range(3000)] + [(10_000 + i, junk, "s", "en") for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(10_000 + i, 0) for i in range(50)], "doc_id long, quality int")
    found = cutoffs(text_counts(frame(spark, many + many[:500])), labels).collect()
    assert found and all(r.n_clean == 3000 for r in found)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_agree_under_power_sums_are_told_apart():
    from lendscope.llm.hashing import shingle_sets
    for n in (256, 1024, 2048):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        tokens, bounds = shingle_sets([x, y, f"one two {x} three four five", f"one two {y} three four five"], 5)
        sets = [set(tokens[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
        assert not sets[0] & sets[1] and not sets[2] & sets[3]


def test_long_words_link_nothing(spark):
    from lendscope.llm.parity_join import jaccard_components
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    rows = [(1, x, None, None), (2, y, None, None), (3, x, None, None)]
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_shingles_of_words_match_plain_sets():
    from lendscope.llm.hashing import shingle_sets
    texts = ["A b\tC\nd e f", "a B c d E F", "a b c", "", None, " \x0b\x0c ", "x\xa0y z", "a b c d e a b c d e"]
    tokens, bounds = shingle_sets(texts, 5)
    sizes = np.diff(bounds).tolist()
    assert sizes == [2, 2, 1, 0, 0, 0, 1, 5]
    assert set(tokens[:2].tolist()) == set(tokens[2:4].tolist())


def test_many_sources_of_one_row_spread_over_ranges(spark, monkeypatch):
    """All fractions are one half; the places are cut into several ranges all the same."""
    from lendscope.llm import sharding
    written = {}
    keep = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    df = frame(spark, [(i, f"t{i}", f"s{i}", None) for i in range(4000)])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = sharding.interleave(df).groupBy("shard").count().collect()
    finally:
        spark.conf.set(key, "true")
    assert {r["count"] for r in got} == {250} and len(got) == 16
    sizes = [r["count"] for r in written["shard-ranges"].groupBy("_range").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 3 * 4000 / len(sizes)
