"""vortex_components and vortex_mean_strengths take all cells faster than one deviation of their step."""

from pyspark.sql import functions as F

from test_queries import DATA
from tidecube.operators import vortex
from tidecube.plans import registry
from tidecube.plans.queries import _vortices


def test_no_fast_cell_is_left_out(spark):
    fast = vortex.with_sigma(_vortices(spark, DATA).drop("mask"), "speed").where(F.col("speed") > F.col("sigma")).select("t", "k", "j", "i").collect()
    fast = {tuple(r) for r in fast}
    found = {(r["t"], r["k"], r["j"], r["i"]) for r in registry.queries()["vortex_components"](spark, DATA).collect()}
    near = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
    left = fast - found
    # What is left out lies in groups of at most five cells.
    for cell in left:
        group = [cell]
        for t, k, j, i in group:
            group += [n for n in ((t, k + a, j + b, i + c) for a, b, c in near) if n in fast and n not in group]
        assert len(group) <= 5
    assert found <= fast
    assert registry.queries()["vortex_mean_strengths"](spark, DATA).count() == len({r["t"] for r in registry.queries()["vortex_components"](spark, DATA).select("t").distinct().collect()})
