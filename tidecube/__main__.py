"""Command line: python -m tidecube project NAME LON LAT ... | catalog WORKDIR REFERENCE FAMILY=FORMAT ... [MESH:PROJECTION:MASK ...]"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    if len(args) >= 4 and args[0] == "project":
        from pyspark.sql import functions as F

        from .functions.projection import project
        from .session import local_session

        numbers = list(map(float, args[2:]))
        spark = local_session(1, 1, "1g")
        points = spark.createDataFrame(list(zip(numbers[0::2], numbers[1::2])), "lon double, lat double")
        x, y = project(args[1], F.col("lon"), F.col("lat"))
        for row in points.select("lon", "lat", x.alias("x"), y.alias("y")).collect():
            print(*row)
        spark.stop()
        return 0
    if len(args) >= 4 and args[0] == "catalog":
        from .sources import catalog

        formats = dict(a.split("=", 1) for a in args[3:] if "=" in a)
        meshes = [tuple(a.split(":")) for a in args[3:] if "=" not in a]
        print(catalog.render(catalog.generate(args[1], formats, meshes, args[2])), end="")
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
