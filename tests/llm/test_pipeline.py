"""The queries that SQL can express, and the pipeline against what each of its stages must do."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from factloom.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    from test_catalog import same

    same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as p
    from test_operators import encode, plain_fingerprint

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        assert k == len(p.STAGES) - 1 or docs.columns == columns, name
    ids = [[r.doc_id for r in rows] for rows in kept]
    assert set(ids[1]) <= set(ids[0]) and set(ids[2]) <= set(ids[1]) and set(ids[3]) <= set(ids[2]) and sorted(ids[3]) == sorted(ids[4])
    fps = [plain_fingerprint(r.text) for r in kept[1]]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[i + 1 :])
    text = {r.doc_id: r.text for r in kept[3]}
    for r in kept[4][:40]:
        assert r.ids_crc32 == zlib.crc32(np.array([*encode(text[r.doc_id]), 0], "<u4").tobytes())
    want = p.run(spark, SMALL).select("doc_id", "start").collect()
    assert sorted(want) == sorted((r.doc_id, r.start) for r in kept[4])


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls in any column, empty, long and repeated texts, repeated ids and clashing columns: no stage crashes or adds columns."""
    import corpus_pipeline as p
    from test_operators import none, odd

    for docs in (odd(spark), none(spark)):
        n, seen = docs.count(), {(r.doc_id, r.text) for r in docs.collect()}
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            rows = out.collect()
            assert out.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= seen, name
            assert name == "mix" or len(rows) <= n
            assert all((r.id, r.fp, r.u, r.size, r.row) == ("id", 1, 0.5, 2, "row") for r in rows), name
        got = p.STAGES[-1][1](spark, docs, SMALL)
        assert got.count() == n and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_near_dedup_keeps_one_of_each_group_whatever_the_ids(spark):
    import corpus_pipeline as p

    text = ["alpha beta gamma delta epsilon zeta", "some other text of more than four words", "and a third one that is like neither of them"]
    rows = [(1, text[0]), (None, text[0]), (1, text[1]), (None, text[2]), (None, text[2]), (2, text[1])]
    df = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in p.near_dedup(spark, df, SMALL).collect()) == sorted(text)
