"""Sinks that apply change batches so that a repeated delivery does no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import changes
from ..plans.engine import ChangeBatch
from .manifest import Manifest, Store


class SnapshotTable:
    """A table kept as Parquet snapshots: each batch makes a new one, and the manifest then points to it. The sequence of
    the last batch is kept with it, so a batch that comes again is passed over."""

    def __init__(self, spark, home: str, name: str, keys: list[str], values: list[str]):
        self.store, self.name, self.keys, self.values = Store(spark, home), name, keys, values

    def read(self) -> DataFrame | None:
        return self.store.read(self.store.read_manifest().segments.get(self.name, []), "_op")

    def apply(self, batch: ChangeBatch) -> bool:
        """Apply a batch; False if it was applied before."""
        manifest = self.store.read_manifest()
        if batch.sequence < manifest.next_sequence:
            return False
        if (log := batch.tables.get(self.name)) is not None:
            held = self.read()
            held = log.select(*self.keys, *self.values).limit(0) if held is None else held
            segment = self.store.write(changes.apply(held, log, self.keys, self.values), self.name, f"{batch.sequence}")
            manifest = Manifest(**{**manifest.__dict__, "segments": {**manifest.segments, self.name: [segment]}})
        manifest.next_sequence = batch.sequence + 1
        self.store.write_manifest(manifest)
        return True
