"""Queries do the whole job: they agree with SQL over whole tables and texts, or with brute force."""

import duckdb

SF = "/root/testdata/sf0.001"


def agrees(spark, name):
    """Whether the query's rows are those of its SQL."""
    import __spark_entry__ as e

    sql = e.oracle_sql()[name]
    con = duckdb.connect()
    for t in ("events", "documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = e.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(sql)
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    return got and got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_fillers_of_whole_texts(spark):
    assert agrees(spark, "filler_drop")


def test_spawn_lines_beyond_the_third(spark):
    assert agrees(spark, "spawn_line_strip")


def test_signatures_of_every_document(spark):
    assert agrees(spark, "signature_mode")


def test_errors_of_every_conversation(spark):
    assert agrees(spark, "graphql_errors")


def test_fingerprints_of_whole_passages(spark):
    import __spark_entry__ as e

    def fnv(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return str(h)

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.item_id: (r.n_bytes, r.fnv) for r in e.queries()["fnv_fingerprint"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), fnv(t)) for i, t in texts.items()}
