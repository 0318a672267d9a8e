"""Compare a query with SQL that another engine runs on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    return round(v, 6) if isinstance(v, float) else v


def compare(spark, query, sql, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = sorted(str([value(r[c]) for c in names]) for r in df.collect())
    cursor = con.execute(sql)
    own = [d[0] for d in cursor.description]
    assert sorted(own) == names
    assert found == sorted(str([value(r[own.index(c)]) for c in names]) for r in cursor.fetchall())
