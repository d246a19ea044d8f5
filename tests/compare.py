"""Query results against their SQL, as unordered rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v
    return sorted([tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False)], key=repr)


def oracle(sql: str, folder: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c.sql(sql).df()
