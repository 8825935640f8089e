"""Queries over documents without text, without an id or with a negative one agree with their SQL."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from folioscan import plans
from folioscan.operators import inference

TEXTS = (None, "", " ", " \n\t", "  padded e  ", "some e text", "no such sign", " " * 1200, "x" * 1001, "e" * 5001)
IDS = (None, *range(-21, 61), 5, 2**60 + 1)


def differ(spark, path, name):
    """The rows that only the query and that only its SQL gives."""
    docs = [{"doc_id": d, "text": x, "lang": "en", "source": "src1", "n_chars": None} for d in IDS for x in TEXTS]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist(docs, schema=schema), f"{path}/documents.parquet")
    pq.write_table(pa.table({"n_nationkey": pa.array(range(25), pa.int32())}), f"{path}/nation.parquet")
    con = duckdb.connect()
    for table in ("documents", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    got = plans.QUERIES[name](spark, str(path))
    want = Counter(con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.SQL[name]})").fetchall())
    got = Counter(map(tuple, got.collect()))
    assert want.total() > 100
    return got - want, want - got


def test_admission(spark, tmp_path):
    assert differ(spark, tmp_path, "P15_admission") == (Counter(), Counter())


def test_extract_fields(spark, tmp_path):
    assert differ(spark, tmp_path, "UD4_extract_fields") == (Counter(), Counter())


def test_rows_without_text_fail_unless_told_otherwise(spark):
    rows = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "id long, text string")
    got = inference.extract_fields(rows, "text", inference.echo_provider, "id").collect()
    assert [(r.id, r.status, r.truncated, r.error) for r in got] == [(1, "SUCCESS", False, None), (2, "FAILED", False, "no text"), (3, "FAILED", False, "no text")]
    assert got[0].raw and not got[1].raw


def test_quarantined_calls(spark, tmp_path):
    assert differ(spark, tmp_path, "UD6_quarantined_calls") == (Counter(), Counter())
