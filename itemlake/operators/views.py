"""Typed views: fields of payloads, declared once, as columns that search filters push down to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.operators.search import Dialect

EARTH_M = 6371000.0


@dataclass(frozen=True)
class Field:
    """A field of a view: kind is text, number, boolean, tags, geo ("lon,lat") or vector, of `dim` members."""

    name: str
    kind: str
    path: str | None = None
    dim: int | None = None

    def column(self, cold: Dialect) -> Column:
        path = self.path or self.name
        if self.kind == "geo":
            parts = F.split(cold.text(path), ",")
            lon, lat = (F.get(parts, i).try_cast("double") for i in (0, 1))
            return F.when(lon.between(-180, 180) & lat.between(-90, 90), F.struct(lon.alias("lon"), lat.alias("lat")))
        if self.kind == "vector":
            vector = F.try_variant_get(F.try_parse_json("payload"), cold.path(path), "array<double>")
            return F.when(F.size(vector) == self.dim, vector)
        return getattr(cold, self.kind)(path)


class Typed(Dialect):
    """The cold dialect over a view's columns."""

    def text(self, field: str) -> Column:
        return F.col(field)

    number = boolean = tags = text


def typed(items: DataFrame, *fields: Field, root: str = "$") -> DataFrame:
    """object_id, updated_at and a column for each field; null where the payload lacks it or has it as another type."""
    return items.select("object_id", "updated_at", *(f.column(Dialect(root=root)).alias(f.name) for f in fields))


def metres(geo: Column, lon: float, lat: float) -> Column:
    """Distance on a sphere to a place."""
    there, here = F.radians(geo["lat"]), F.radians(F.lit(lat))
    h = F.pow(F.sin((there - here) / 2), 2) + F.cos(here) * F.cos(there) * F.pow(F.sin(F.radians(geo["lon"] - lon) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(h))
