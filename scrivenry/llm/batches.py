"""Bounded Arrow batches, which the rest of the package uses as well."""

from scrivenry.sources.batches import BATCH_BYTES, RECORDS, bound_batches, map_batches, map_rows, release, slices

__all__ = ["BATCH_BYTES", "RECORDS", "bound_batches", "map_batches", "map_rows", "release", "slices"]
