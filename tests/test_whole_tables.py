"""Queries reach every row and the whole of each text, beyond what their SQL's tables show."""

import duckdb

from lexloom import catalogue
from oracle import plain, spark_rows

QUERIES = catalogue.queries()


def rows_of_sql(name, sf_dir, *tables):
    """Sorted rows of a query's SQL over the tables named, columns by name."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    got = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in got.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted("|".join(plain(r[i]) for i in order) for r in got.fetchall())


def test_running_spend_goes_on_until_the_cap(spark, tmp_path):
    rows = [(i, 1, "click") for i in range(3500)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["spent"] for r in QUERIES["running_spend"](spark, str(tmp_path)).collect()}
    spent, want = 0.0, {}
    for i, user, _ in rows:
        spent += ((i % 5000) * 0.15 + user * 0.6) / 1e6
        if round(spent, 8) <= 1.0:
            want[i] = spent
    assert len(want) == 3500 and got.keys() == want.keys()
    assert all(abs(got[i] - s) < 1e-7 for i, s in want.items())


def test_citation_edges_reads_the_whole_text(spark, tmp_path):
    late = "word " * 60 + "See C v. Commissioner, T.C. Memo. 1999-77."
    spark.createDataFrame([(1, late), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["citation_edges"](spark, str(tmp_path)).collect()}
    assert ("T.C. Memo. 2010-2", "T.C. Memo. 1999-77") in got
    assert ("T.C. Memo. 2010-2", "T.C. Memo. 2010-1") in got
    assert ("T.C. Memo. 2010-2", "116 T.C. 432") in got


def test_provider_vectors_counts_capitals(spark, tmp_path):
    rows = [(1, "Eel, É, K and\nE"), (2, None), (3, "ABC" * 2000 + "e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_e"], r["n_letters"]) for r in QUERIES["provider_vectors"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 8), 2: (0, 0), 3: (1, 6001)}
    assert spark_rows(QUERIES["provider_vectors"](spark, str(tmp_path))) == rows_of_sql("provider_vectors", tmp_path, "documents")


def test_revision_labels_after_the_year_9999(spark, tmp_path):
    made = "CAST(d + k AS BIGINT) AS doc_id, CAST(100 AS INT) AS n_chars"
    spark.sql(f"SELECT {made} FROM VALUES (0), (79900), (500000), (5000000) t(d) CROSS JOIN (SELECT explode(sequence(0, 99)) AS k)").write.parquet(f"{tmp_path}/documents.parquet")
    assert spark_rows(QUERIES["revision_labels"](spark, str(tmp_path))) == rows_of_sql("revision_labels", tmp_path, "documents")
