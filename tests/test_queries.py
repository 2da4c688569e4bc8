"""Each registered query against its SQL on the smallest tables, and what the contract asks of the entry."""

import pytest

import __spark_entry__ as contract
from aerolattice import catalog
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
#: Queries with sums of many terms, ties of rounding or joins by place are compared on the larger tables too.
LARGER = ("filled_positions", "ground_truth_join", "sampled_heights", "keyframe_rule", "nearest_timestamps", "tile_bounds_from_names", "plane_segments", "anchored_trajectories", "interpolated_rotations", "mesh_folders", "located_frames", "view_motions", "raster_files", "scene_boxes", "height_offsets", "point_map_normals")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", LARGER)
def test_query_matches_sql_on_larger_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    assert difference(spark, connect(sf), sf, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


def test_no_query_is_empty(spark):
    """The SQL of each query, which gives the same rows, has some on the larger tables; a query without SQL itself."""
    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    for name, run in catalog.queries().items():
        sql = catalog.oracle_sql().get(name)
        assert con.sql(f"SELECT count(*) FROM ({sql}) q").fetchall()[0][0] if sql else run(spark, sf).first() is not None, name


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_joins_have_no_nested_loops(spark):
    for name in ("boxes_touching_tiles", "nearest_timestamps", "surviving_points", "sampled_heights", "ground_truth_join"):
        plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
