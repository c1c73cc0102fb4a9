"""Findings of round 3: copies in any number, records of any size, what is written on the way."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factloom.operators.records import matrix_records
from factloom.plans import catalog, record_queries
from factloom.sources import corpora, ordered

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["candidate_scores", "canonical_entities", "correlation_metrics"])
def test_more_copies_than_the_limit_of_a_key_link(spark, tmp_path, name):
    """460 copies of a text make 105,570 pairs."""
    ids = list(range(500))
    pq.write_table(pa.table({"doc_id": ids, "text": [f"text {max(i - 459, 0)}" for i in ids], "source": ["s"] * 500}), tmp_path / "documents.parquet")
    got = catalog.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in got.collect())


def test_large_records_are_as_small_ones(spark):
    """Whichever way a record is gathered, by one task or by all, it is the same."""
    f, u = corpora.claims(spark, SMALL)
    few = F.pmod(F.xxhash64("group_key"), F.lit(10)) == 0
    ways = [matrix_records(f.where(few), u.where(few), record_queries.registry(spark), 2, hot=n) for n in (1 << 20, 2)]
    for table in ("records", "variants", "ids"):
        one, other = (getattr(w, table).select(F.to_json(F.struct("*")).alias("j")) for w in ways)
        assert one.count() > 0 and one.exceptAll(other).count() == other.exceptAll(one).count() == 0


def test_claims_are_worked_out_once(spark):
    """Every view of the records reads the claims that were written, not the tables below them."""
    full = matrix_records(*corpora.claims(spark, SMALL), record_queries.registry(spark), 2)
    for table in (full.records, full.variants, full.ids):
        assert not any("lineitem" in f for f in table.inputFiles())


def test_order_writes_rows_once(spark):
    """Keys and ties follow from the row, so the sorted table holds the row alone."""
    df = spark.createDataFrame([("b", "x" * 9), ("a", "y" * 9), ("a", "x" * 9), (None, "z")], "k string, t string")
    placed = ordered.numbered(df, ("k",))
    assert [(r.nth, r.row.k, r.row.t) for r in placed.orderBy("nth").collect()] == [(0, None, "z"), *[(1 + i, *x) for i, x in enumerate(sorted([("a", "x" * 9), ("a", "y" * 9)], key=lambda r: placed.where((F.col("row.k") == r[0]) & (F.col("row.t") == r[1])).first().nth))], (3, "b", "x" * 9)]
    stored = spark.read.parquet(*placed.inputFiles()).columns
    assert sorted(stored) == sorted(["k", "t", ordered._AT])


def test_indexes_hold_a_bounded_number_of_documents(spark, monkeypatch):
    """There are more indexes where there are more documents."""
    found = []
    monkeypatch.setattr(record_queries.scip, "documents", lambda indexes: found.append(indexes) or (_ for _ in ()).throw(KeyError))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        with pytest.raises(KeyError):
            record_queries.scip_protobuf(spark, SMALL)
        assert found[0].count() > 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
