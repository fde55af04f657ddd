"""Column builders: projections, tiles, levels of detail, parsing, URLs.  No Python runs on the executors."""
