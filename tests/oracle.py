"""Compare a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    names = sorted(df.columns)
    clean = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v)
    return names, sorted((tuple(clean(v) for v in r) for r in df[names].itertuples(index=False)), key=str)


def assert_same(spark, con, f, sql, sf_dir):
    assert rows(f(spark, sf_dir).toPandas()) == rows(con.sql(sql).df())
