import duckdb
import pytest

from redactry.llm import queries

COLUMNS = {
    "p1_found": [("scan_id", "bigint")], "p2_found": [("src", "string"), ("row_id", "bigint")], "p3_found": [("entity_id_a", "bigint"), ("entity_id_b", "bigint")],
    "p4_found": [("scan_id", "bigint"), ("span_start", "int"), ("span_end", "int"), ("pii_type", "string")], "p5_found": [("scan_id", "bigint"), ("lang", "string")],
    "p6_found": [("src", "string"), ("row_id", "bigint")], "p7_found": [("scan_id", "bigint")], "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert len(rows) > 0 or name in ("p7_found", "p7_pieces")
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)
    if name in queries.ORACLES:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW scan_requests AS SELECT * FROM '{sf}/scan_requests.parquet'")
        assert sorted(map(tuple, rows)) == sorted(con.execute(queries.ORACLES[name]).fetchall())
