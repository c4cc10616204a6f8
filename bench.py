"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds for each query."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "spatial_stats_layer", "weighted_percentiles", "spatial_stats_cells", "density_jmd94", "select_polygon", "time_average", "time_agg_monthly", "time_agg_weekly",
    "climatology_month", "hovmoeller", "derivatives", "grad_fv4", "okubo_weiss", "lambda2", "omega", "mixed_layer_depth", "rossby_radius", "vortex_properties",
)

#: Timed the same way, but not in the total, which goes on from earlier rounds.
MESH = ("gradient_any_grid", "gradient_any_grid_points", "profile_any_grid", "depth_levels", "mixed_layer_depth_positions", "scatter_nearest")

#: The text queries that BENCH_TEXT names, comma-separated; by default all of them.
TEXT = tuple(n for n in os.environ.get("BENCH_TEXT", "").split(",") if n)
#: Seconds after which no further text query is begun; those left out are named.
TEXT_SECONDS = float(os.environ.get("BENCH_TEXT_SECONDS", "480"))


def main() -> None:
    from tidecube.plans import registry
    from tidecube.session import local_session

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, max(cores, 4))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    for name in HEADLINE + MESH:
        runs = []
        for _ in range(2):  # the second run is without the compilation of the first
            start = time.perf_counter()
            queries[name](spark, directory).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    text, left_out, began = {}, [], time.perf_counter()
    if os.path.exists(os.path.join(ROOT, "tidecube", "llm", "registry.py")):  # not in the headline total
        from tidecube.llm.registry import queries as text_queries

        for name in TEXT or tuple(text_queries()):
            if time.perf_counter() - began > TEXT_SECONDS:
                left_out.append(name)
                continue
            start = time.perf_counter()
            text_queries()[name](spark, directory).write.format("noop").mode("overwrite").save()
            text[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    mesh = {name: seconds.pop(name) for name in MESH}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(directory.rstrip("/")), "cores": cores, "state": "warm", "mesh_queries": mesh, "text_queries_cold": text, "text_queries_left_out": left_out}))


if __name__ == "__main__":
    main()
