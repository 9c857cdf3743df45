import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"
#: The driver holds all of them against SQL at a larger size; these are quick.
QUICK = ["profile_segments", "status_fetched_by_state", "tiles_pending_limit_per_worker", "aoi_county", "spatial_join_grid", "log_insert_ignore", "name_prefix_lookup", "fips_lookup", "shapefile_round_trip", "optimal_hs", "local_variance", "connected_components"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry(spark):
    assert entry.entry(spark).count() == 9
