"""python -m tessera --ihc FOLDER --dish FOLDER --output FOLDER [--tile N] [--overlap N] [--resume]
    [--segmenter M:F] [--nuclei M:F] [--core M:F] [--workers N] [--x N --y N | --test]

Analyses two folders of tiles named tile_x<X>_y<Y>. The segmenter is the package's threshold stand-in unless
--segmenter module:function names another: a function without arguments that returns a predictor. Likewise --nuclei for
the second slide and --core for the tissue mask, by default tessera.functions.kernels:stain_core. --workers N sets the
tasks that run at once on one machine, --x and --y pick a single tile, --test stops after the four first tiles.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable


def named(place: str) -> Callable:
    """The function of module:function."""
    module, function = place.split(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("--ihc", "--dish", "--output"):
        args.add_argument(name, required=True)
    args.add_argument("--tile", type=int, default=1024)
    args.add_argument("--overlap", type=int, default=256)
    args.add_argument("--segmenter", default="tessera.functions.kernels:threshold_segmenter")
    args.add_argument("--nuclei")
    args.add_argument("--core", default="tessera.functions.kernels:stain_core")
    args.add_argument("--resume", action="store_true")
    args.add_argument("--workers", type=int)
    args.add_argument("--x", type=int)
    args.add_argument("--y", type=int)
    args.add_argument("--test", action="store_true")
    a = args.parse_args(argv)
    if (a.x is None) != (a.y is None) or a.test and a.x is not None:
        args.error("give --x and --y together, without --test")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from . import pipeline
    from .config import Config
    from .operators import summary
    from .session import ready
    from .sources import images

    builder = SparkSession.builder.appName("tessera")
    if a.workers:
        builder = builder.master(f"local[{a.workers}]")
    spark = ready(builder.getOrCreate())
    cfg = Config(tile_size=a.tile, overlap=a.overlap)
    ihc, dish = images.scan(spark, a.ihc), images.scan(spark, a.dish)
    if a.x is not None:
        ihc = ihc.where((F.col("x") == a.x) & (F.col("y") == a.y)).withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
        dish = dish.where((F.col("x") == a.x) & (F.col("y") == a.y)).withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
    if a.test:
        few = images.first_tiles(ihc, cfg.tile_size, cfg.overlap)
        ihc, dish = ihc.join(few, ["x", "y"], "left_semi"), dish.join(few, ["x", "y"], "left_semi")
    cells = pipeline.run(ihc, dish, a.output, named(a.segmenter), cfg, a.resume, named(a.core), named(a.nuclei) if a.nuclei else None)
    print(summary.summary_text(cells, cfg))
    return 0


if __name__ == "__main__":
    sys.exit(main())
