import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")

from loomdex.session import builder  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = builder("tests", 4).config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def same_rows(spark_df, duck_relation):
    """Compare two results as multisets, columns by name, doubles on 6 places."""
    from collections import Counter

    names = sorted(spark_df.columns)
    assert names == sorted(duck_relation.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    left = Counter(tuple(plain(r[c]) for c in names) for r in spark_df.collect())
    at = [duck_relation.columns.index(c) for c in names]
    right = Counter(tuple(plain(r[i]) for i in at) for r in duck_relation.fetchall())
    assert left == right, (list((left - right).items())[:3], list((right - left).items())[:3])


def edge_tables(spark, folder, kind):
    """All driver tables without rows, or with two equal rows of nulls and columns whose names
    clash with those the operators use."""
    import os

    from pyspark.sql import functions as F

    for name in os.listdir(DATA):
        df = spark.read.parquet(f"{DATA}/{name}")
        made = df.limit(0)
        if kind == "null":
            made = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
            for extra in ("n", "row", "weight", "language", "_done", "total", "rank", "extra"):
                made = made if extra in made.columns else made.withColumn(extra, F.lit("x"))
        made.write.parquet(f"{folder}/{name}")
    return str(folder)
