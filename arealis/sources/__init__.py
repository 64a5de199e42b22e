"""Readers and writers of observations, polygons and weights."""

from .files import read_csv, read_gal, read_geojson, read_table, write_table

__all__ = ["read_csv", "read_gal", "read_geojson", "read_table", "write_table"]
