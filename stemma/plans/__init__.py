"""Plan helpers: how tables are read, lineage is cut and broadcasts are guarded."""
