import duckdb
import pytest

import __spark_entry__ as entry
from quire.sources.tables import TABLES

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["feature", "kind", "h_score", "h_rank"]


def test_oracle_keys_subset():
    assert set(entry.oracle_sql()) <= set(entry.queries())


FAST = ["cohort_features", "split_assignment", "train_medians", "hellinger_ranking", "metrics_by_lang",
        "auc_with_ties", "average_rank_table", "borda_totals", "table_summary", "dense_codes"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    a = entry.queries()[name](spark, SF_SMALL).toPandas()
    b = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def canon(df):
        out = []
        for rec in df[cols].itertuples(index=False):
            out.append(tuple("NULL" if v is None or (isinstance(v, float) and v != v)
                             else (f"{float(v):.6f}" if isinstance(v, float) else str(v)) for v in rec))
        return sorted(out)
    assert canon(a) == canon(b)
