"""City names to zone names: by rule from Spark's own list of zones, so there is no table to ship."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand for more than a city.
SPECIAL = {"UTC": "Etc/UTC", "GMT": "Etc/GMT", "Rel": "Etc/GMT"}


def city_map() -> dict[str, str]:
    """The last part of every zone's name; of several zones the first by name, links in plain areas last."""
    out: dict[str, str] = {}
    for zone in sorted(zoneinfo.available_timezones(), key=lambda z: (z.startswith(("posix/", "right/", "Etc/")), z)):
        out.setdefault(zone.rpartition("/")[2], zone)
    return out | SPECIAL


def zone_for(name: Column) -> Column:
    """A zone by its city or by its own full name; null if unknown."""
    cities = city_map()
    known = sorted(set(cities.values()))
    by_city = F.create_map(*[F.lit(x) for pair in cities.items() for x in pair])
    return F.coalesce(by_city[name], F.when(name.isin(known), name))
