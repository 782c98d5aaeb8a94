"""The registered queries: names, SQL beside Spark, and what SQL cannot say on the smallest tables."""

import inspect

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("log_templates.llm")

import __spark_entry__ as entry
from log_templates.llm import exact_dedup, mixing, quality_rules, url_rules
from log_templates.llm.oracle import ORACLE
from log_templates.llm.queries import QUERIES


def test_one_query_per_operator_and_the_pipeline():
    names = [n for n in entry.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit()]
    assert sorted(int(n.split("_")[0][2:]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(ORACLE) <= set(QUERIES)


def test_native_operators_have_no_python_on_the_main_path():
    for module in (exact_dedup, mixing, quality_rules, url_rules):
        source = inspect.getsource(module)
        assert not any(x in source for x in ("pandas_udf", "mapInArrow", "mapInPandas", "applyIn", ".rdd", "F.udf"))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    clean = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    ours = clean([tuple(r[c] for c in columns) for r in got.collect()])
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert ours == clean(con.execute(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_has_the_columns_of_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    told = con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()
    assert set(entry.queries()[name](spark, sf_dir).columns) == {row[0] for row in told}


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op1_rule_ensemble"](spark, sf_dir).where("held_out")
    both = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert both.where(F.col("predicted") == F.col("quality")).count() >= 0.95 * both.count()
