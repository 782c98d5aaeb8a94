import duckdb
import pytest

import __spark_entry__ as entry

# What SQL cannot express: greedy sampling, k-means, mean shift, and round-wise mining.
ROWS_ONLY = {
    "sample_diverse", "sample_similar", "balanced_groups", "mean_shift_clusters", "parse_documents", "compare",
}


def test_every_query_has_sql_unless_listed():
    assert set(entry.QUERIES) - set(entry.ORACLE) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    got = entry.entry(spark)
    assert got.columns == ["event_id", "event_template", "occurrence"] and got.count() == 5


@pytest.mark.parametrize(
    "name", ["normalize_large", "match_templates", "token_key_fine", "similarity_tokens", "metrics_suite", "consensus_templates"]
)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    clean = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    ours = clean([tuple(r[c] for c in columns) for r in got.collect()])
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = con.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert ours == clean(theirs)
