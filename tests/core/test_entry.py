import __spark_entry__ as entry

from corpusloom.operators import select as P
from corpusloom.plans import registry


def test_queries_and_sql_agree_in_name():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 60


def test_core_does_not_import_the_optional_package():
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(registry.__file__)))
    for folder, _, files in os.walk(root):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as s:
                        assert "corpusloom.llm" not in s.read(), f


def test_limits_are_bounded_below(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(1,), (25,), (1800,)], "q int").withColumns(P.limits(F.col("q"))).collect()
    assert [(r["source_limit"], r["author_limit"], r["pair_limit"]) for r in got] == [(1, 1, 1), (11, 2, 2), (810, 144, 144)]
    assert got[2]["source_keep"] == 2610 and got[2]["author_keep"] == 1944 and got[2]["global_keep"] == 30348
