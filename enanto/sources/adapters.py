"""Domain adapters: what a table means, as functions of DataFrames, found by the domain's name."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import datasets
from ..functions.scalars import finite


class DomainAdapter(Protocol):
    """Gives a dataset's samples their meaning; every method is lazy."""

    name: str

    def load(self, spark: SparkSession, path: str) -> datasets.Dataset: ...

    def mirror_map(self, data: datasets.Dataset) -> DataFrame: ...

    def observable(self, data: datasets.Dataset) -> DataFrame: ...

    def size_proxy(self, data: datasets.Dataset) -> DataFrame: ...

    def frequency_proxy(self, data: datasets.Dataset) -> DataFrame | None: ...

    def impedance_proxy(self, data: datasets.Dataset) -> DataFrame | None: ...


KEYS = ("case_id", "t", "L", "hand")


@dataclass
class TabularAdapter:
    """Adapter of datasets in canonical columns; domains that need no more differ by name only."""

    name: str
    units: dict[str, str] = field(default_factory=dict)

    def load(self, spark: SparkSession, path: str) -> datasets.Dataset:
        return datasets.load_dataset(spark, path)

    def mirror_map(self, data: datasets.Dataset) -> DataFrame:
        """Each reading's key with the hand of its mirror image and whether that is there; applied twice it is the identity."""
        x = data.samples.where(F.col("hand").isin("L", "R")).select(*KEYS).distinct()
        both = x.groupBy("case_id", "t", "L").agg(F.count("*").alias("n"))
        other = F.when(F.col("hand") == "L", "R").otherwise("L")
        return x.join(both, ["case_id", "t", "L"]).select(*KEYS, other.alias("mirror_hand"), (F.col("n") == 2).alias("has_mirror"))

    def observable(self, data: datasets.Dataset) -> DataFrame:
        return data.samples.select(*KEYS, F.col("O").alias("X"))

    def size_proxy(self, data: datasets.Dataset) -> DataFrame:
        """The sizes of each case, ascending, with their number of readings; what isn't finite and positive is left out."""
        x = data.samples.where(finite(F.col("L")) & (F.col("L") > 0))
        return x.groupBy("case_id", "L").agg(F.count("*").alias("n"))

    def _omega(self, data: datasets.Dataset) -> DataFrame | None:
        return data.samples if "omega" in data.samples.columns else None

    def frequency_proxy(self, data: datasets.Dataset) -> DataFrame | None:
        """Angular frequencies per reading, or None where the dataset has none."""
        x = self._omega(data)
        return None if x is None else x.where(finite(F.col("omega"))).select(*KEYS, "omega")

    def impedance_proxy(self, data: datasets.Dataset) -> DataFrame | None:
        """omega, L and the characteristic speed 30 of the impedance check, or None without frequencies."""
        x = self.frequency_proxy(data)
        return None if x is None else x.select("case_id", "t", "L", "omega", F.lit(30.0).alias("speed"))


class RegistryError(KeyError):
    """No adapter of that name."""


_ADAPTERS: dict[str, DomainAdapter] = {}


def register(adapter: DomainAdapter) -> None:
    name = adapter.name.strip().lower()
    if not name:
        raise RegistryError("an adapter needs a name")
    _ADAPTERS[name] = adapter


def adapter(name: str) -> DomainAdapter:
    key = name.strip().lower()
    if key not in _ADAPTERS:
        raise RegistryError(f"unknown domain {name!r}: {', '.join(domains())}")
    return _ADAPTERS[key]


def domains() -> list[str]:
    return sorted(_ADAPTERS)


for _name in ("weather", "josephson", "oam", "em_resonator", "plasma", "synthetic", "custom"):
    register(TabularAdapter(_name))


#: Names that a column naming the event of a row may have, the first that is there counts.
EVENT_COLUMNS = ("storm_id", "cyclone_id", "sid", "tc_id", "event_id")


def event_column(columns: list[str]) -> str | None:
    """The column that names a row's event, whatever its case."""
    found = {c.lower(): c for c in columns}
    return next((found[c] for c in EVENT_COLUMNS if c in found), None)
