"""Physical plans of the relational queries stay JVM-side and prune their scans."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonMapInArrow", "FlatMapGroupsInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_relational_queries_have_no_python_stage(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert not any(n in plan for n in PYTHON_NODES), name


def test_flagship_scan_is_pruned_and_filtered(spark):
    df = E.queries()["nominal_cpue"](spark, SF)
    txt = df._jdf.queryExecution().toString()
    # line items: only the six used columns are read, with the join key not-null filter pushed
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_discount:double,l_tax:double," \
           "l_returnflag:string,l_linestatus:string>" in _explain(df)
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in _explain(df)
    assert "Exchange" in txt


def _explain(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
