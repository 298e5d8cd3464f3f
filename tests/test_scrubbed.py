"""Personal data beside letters of other alphabets: Spark and the SQL judge words alike."""

import duckdb
import pytest

from lodestone import catalog

TEXTS = ["am 12 Baum stück", "12 Baum st", "12 Baum st.ö", "é12 Oak rd.", "— 12 Oak rd—", "émy Ann", "my Ann ö_my Bo", "_ü_ 12 Oak st _—_ éé", "12\x0bOak\x0bst", "12 Oak ſt", "é555-123-4567",
         "555 123 4567ö 555.123.4567", "öa.b@example.orgö", "x́my Ann", None, "٣12 Oak st"]


@pytest.mark.parametrize("name", ["str13_scrubbed", "str28_privacy_scan"])
def test_words_of_other_alphabets(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "p_partkey long, p_name string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(repr, (tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    for t in ("documents", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(map(repr, con.execute(catalog.oracle_sql()[name]).fetchall()))
    if name == "str13_scrubbed":
        assert repr((-1, "am 12 Baum stück")) in got and repr((-2, "[redacted-address]")) in got and repr((-9, "[redacted-address]")) in got
