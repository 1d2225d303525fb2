"""Stages decide by row: null and repeated ids, from a written table and from any other frame."""

import pytest

from tests.llm.conftest import SF, frame

LONG = " ".join(f"w{i}" for i in range(80))
NEAR = LONG + " end"


@pytest.fixture(params=["frame", "written"])
def docs_of(request, spark, tmp_path):
    def make(rows):
        df = frame(spark, rows)
        if request.param == "frame":
            return df
        df.write.parquet(str(tmp_path / "docs"))
        return spark.read.parquet(str(tmp_path / "docs"))
    return make


def ids_and_texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_stage_rejects_null_and_repeated_ids_by_row(spark, docs_of):
    from lendscope.llm.quality import quality_stage
    docs = docs_of([(None, LONG, None, None), (None, "short", None, None), (None, LONG, None, None),
                    (10**9, LONG, None, None), (10**9, "also short", None, None)])
    out = quality_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert ids_and_texts(out) == [(10**9, LONG), (None, LONG), (None, LONG)]


def test_dedup_stage_keeps_one_row_per_text(spark, docs_of):
    from lendscope.llm.mph_dedup import dedup_stage
    docs = docs_of([(None, "a", None, None), (9, "a", None, None), (None, "b", None, None), (None, "b", None, None),
                    (5, "x", None, None), (5, "y", None, None), (8, "x", None, None), (7, "z", "s", None), (7, "z", "t", None)])
    out = dedup_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert ids_and_texts(out) == [(5, "y"), (7, "z"), (8, "x"), (9, "a"), (None, "b")]


def test_near_dedup_stage_keeps_one_row_per_component(spark, docs_of):
    from lendscope.llm.parity_join import near_dedup_stage
    docs = docs_of([(None, LONG, None, None), (None, NEAR, None, None), (None, "q r s", None, None),
                    (4, "a b c d e f g h", None, None), (4, "i j k l m n", None, None), (2, "i j k l m n", None, None),
                    (6, "t u v", None, None), (6, "t u v", None, None)])
    out = near_dedup_stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = ids_and_texts(out)
    assert got[:3] == [(2, "i j k l m n"), (4, "a b c d e f g h"), (6, "t u v")]
    assert [t for i, t in got[3:] if t != "q r s"] in ([LONG], [NEAR]) and len(got) == 5


def test_mixing_stage_repeats_rows_by_their_own_copies(spark, docs_of):
    from lendscope.llm.mixing import mix, mixing_stage
    rows = [(None if i % 2 else 1, " ".join(["w"] * (3 + i)), "ab"[i % 3 % 2], None) for i in range(40)]
    docs = docs_of(rows)
    taken = sum(r.copies for r in mix(docs).collect())
    assert len(mixing_stage(spark, docs, SF).collect()) == taken


def test_row_keys_are_distinct_and_stay(spark, docs_of):
    from lendscope.llm.common import with_row_key
    keyed, key = with_row_key(docs_of([(None, "a", None, None)] * 50), "test-rows")
    first, again = ([r[key] for r in keyed.select(key).collect()] for _ in range(2))
    assert len(set(first)) == 50 and sorted(first) == sorted(again)
