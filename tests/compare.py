"""Multiset comparison of a query's rows with those of its SQL."""

from pathlib import Path


def rows_of(frame, columns):
    def plain(v):
        if v is None or v != v:
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    kept = frame[columns].astype(object)
    return sorted(repr(tuple(plain(v) for v in row)) for row in kept.where(kept.notna(), None).itertuples(index=False, name=None))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def assert_same(spark, sf_dir, query, sql):
    got, wanted = query(spark, sf_dir).toPandas(), duck(sf_dir).execute(sql).df()
    columns = sorted(got.columns)
    assert sorted(wanted.columns) == columns
    assert rows_of(got, columns) == rows_of(wanted, columns)
