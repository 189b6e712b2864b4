"""Side-by-side comparison of a query and its SQL twin."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normalised(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    a, b = normalised(left), normalised(right)
    both = a.merge(b, how="outer", indicator=True)
    wrong = both[both["_merge"] != "both"]
    assert len(a) == len(b) and wrong.empty, wrong.head(10).to_string()
