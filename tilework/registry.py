"""Registry of the queries over the shared tables: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from tilework.plans import features, files, rasters, stores, streams, tiles

MODULES = (tiles, features, stores, rasters, streams, files)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
