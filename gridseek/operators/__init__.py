"""Relational operators over grids, regions, rasters and vectors."""
