import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions.names import class_ref, class_ref_sql

CASES = {
    "a/b/C$D": "a/b/C$D", "a.b.C": "a/b/C", " a/b/C\t": "a/b/C", "[[La/b/C;": "a/b/C", "La.b.C;": "a/b/C", "[I": None, "[[J": None, "int[]": None,
    "a.B[]": "a/B", "": None, " ": None, "?": None, None: None, "L": "L", "Lx": "Lx", "I": "I", " a/B\n": "a/B",
}


def test_class_ref(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "s string")
    assert {r.s: r.v for r in df.select("s", class_ref(F.col("s")).alias("v")).collect()} == CASES


@pytest.mark.parametrize("name", list(CASES))
def test_the_same_in_sql(name):
    assert duckdb.execute(f"SELECT {class_ref_sql('s')} FROM (SELECT ?::VARCHAR AS s)", [name]).fetchone()[0] == CASES[name]
