import duckdb
import pytest

from stratolith.plans import queries, workflow  # noqa: F401 (registers its queries)

DATA = "/root/testdata/sf0.001"
NAMES = [
    "local_variance_gaps", "optimal_params_gaps", "mosaic_masked", "mosaic_window", "overview_avg", "utm_round_trip", "utm_warp", "normalise_all", "normalise_pyramid", "spatial_join_edges",
    "aoi_polygon", "point_expand_polygon", "vectorise_gaps", "segment_metrics_mercator", "segment_of_area", "segments_loaded", "extract_place", "polygon_metrics", "semivariogram_gaps", "tile_table_round_trip",
    "catalogue_loaded", "census_ingested", "areas_dispatched", "states_first_seen", "log_kept", "status_lines", "profile_lines", "wkt_polygons", "crop_pixels", "crop_world", "variance_fit", "variance_series", "optimal_params_of_area",
]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("part", "supplier", "lineitem", "embeddings"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert rows(got.select(columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("here", [(1, 2, 19, 20), (1, 8, 19), (1, 9, 20), ()])
def test_parameters_where_the_middle_is_missing(spark, tmp_path, here):
    """Middles of no row of pixels, of two rows, of twelve; and no tile at all."""
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.1/embeddings.parquet'")
    con.execute("create table part as select i p_partkey, 'Brand#1' p_brand from range(60) t(i)")
    con.execute(f"create table lineitem as select unnest({[*here, 77]})::bigint l_partkey, 50.0::double l_quantity, 'O' l_linestatus")
    con.execute(f"create table supplier as select * from '{DATA}/supplier.parquet'")
    for table in ("part", "lineitem", "supplier", "embeddings"):
        con.execute(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
    name = "optimal_params_of_area"
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    assert [tuple(r) for r in got.select(columns).collect()] == want.fetchall()
    assert len(got.collect()) == (here == (1, 9, 20))
