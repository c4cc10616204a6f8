"""Queries over tables that end within a time step or hold values that one axis lacks agree with their SQL."""

import duckdb
import pytest

from test_queries import same
from tidecube.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=[37, 137, 337])
def ragged(spark, tmp_path_factory, request):
    """A folder whose embeddings end request.param vectors into the second group of 500."""
    home = str(tmp_path_factory.mktemp("ragged"))
    duck = duckdb.connect()
    whole = f"SELECT (vec_id % 500) + 500 * g AS vec_id, embedding, label FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet'), range(2) AS r(g)"
    duck.execute(f"COPY (SELECT * FROM ({whole}) WHERE vec_id < {500 + request.param}) TO '{home}/embeddings.parquet' (FORMAT parquet)")
    duck.execute(f"COPY (SELECT * FROM read_parquet('{DATA}/customer.parquet')) TO '{home}/customer.parquet' (FORMAT parquet)")
    for name in ("embeddings", "customer"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{home}/{name}.parquet')")
    return home, duck


def agree(spark, ragged, name):
    home, duck = ragged
    df = registry.queries()[name](spark, home)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x) if isinstance(x, str) else x or 0) for x in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    bad = [(a, b) for a, b in zip(rows, want) if not all(map(same, a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", ["derivatives", "gradient_outputs", "lambda2", "okubo_weiss", "omega", "omega_modified", "q_criterion"])
def test_gradients(spark, ragged, name):
    agree(spark, ragged, name)


@pytest.mark.parametrize("name", ["compare_variables_max", "compare_variables_min"])
def test_comparisons(spark, ragged, name):
    agree(spark, ragged, name)


@pytest.mark.parametrize("name", ["gradient_any_grid", "gradient_any_grid_points", "profile_any_grid_points"])
def test_any_grid(spark, ragged, name):
    agree(spark, ragged, name)


def test_means_of_profiles(spark, ragged):
    agree(spark, ragged, "hovmoeller_from_profile")


def test_cells_from_profiles(spark, ragged):
    agree(spark, ragged, "stats_from_profile")


@pytest.mark.parametrize("name", ["spatial_stats_cells", "spatial_stats_tolerance", "spatial_stats_user_levels", "spatial_stats_volume", "stats_to_cells"])
def test_layers(spark, ragged, name):
    agree(spark, ragged, name)


def test_scatter_keeps_missing_values(spark, ragged):
    agree(spark, ragged, "scatter_to_grid")


def test_masks_of_missing_values(spark, ragged):
    agree(spark, ragged, "vortex_mask")
