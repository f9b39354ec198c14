"""Road classes and traffic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Importance of road classes (1 is the greatest), by use.
RANK = {"motorway": 1, "motorway_link": 1, "trunk": 2, "trunk_link": 2, "primary": 3, "primary_link": 3, "secondary": 4, "secondary_link": 4, "tertiary": 5, "tertiary_link": 5, "residential": 6, "living_street": 7, "unclassified": 8, "service": 9}
EXTRA_RANK = {"features": {"pedestrian": 10}, "analysis": {"pedestrian": 10, "cycleway": 10, "footway": 10, "path": 10}, "enforcement": {}}
UNKNOWN_RANK = {"features": 99, "analysis": 99, "enforcement": 6}
# Vehicles an hour and lane, and the usual load, by class.
CAPACITY = {"motorway": 2000, "motorway_link": 1800, "trunk": 1600, "trunk_link": 1400, "primary": 800, "primary_link": 700, "secondary": 600, "secondary_link": 500, "tertiary": 400, "tertiary_link": 350, "residential": 200, "living_street": 100, "unclassified": 300, "service": 150, "pedestrian": 0}
LOAD = {"motorway": 0.70, "motorway_link": 0.65, "trunk": 0.65, "trunk_link": 0.60, "primary": 0.60, "primary_link": 0.55, "secondary": 0.50, "secondary_link": 0.45, "tertiary": 0.40, "tertiary_link": 0.35, "residential": 0.30, "living_street": 0.20, "unclassified": 0.35, "service": 0.25, "pedestrian": 0.0}
# Capacities that the block score uses for its perimeter.
SCORE_CAPACITY = {"motorway": 2000, "trunk": 1800, "primary": 900, "secondary": 700, "tertiary": 500, "residential": 300, "living_street": 100, "unclassified": 250, "service": 150}
ARTERIAL = ("primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link")


def lookup(table: dict, key: Column, default) -> Column:
    """A value by key from a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def first_text(values: Column) -> Column:
    return F.get(values, F.lit(0))


def road_class(highway: Column) -> Column:
    """The first class; none or an empty one is unclassified."""
    return F.coalesce(F.nullif(first_text(highway), F.lit("")), F.lit("unclassified"))


def rank(name: Column, use: str = "features") -> Column:
    return lookup(RANK | EXTRA_RANK[use], name, UNKNOWN_RANK[use])


def best_rank(highway: Column) -> Column:
    """The most important of several classes; 99 for none."""
    return F.coalesce(F.array_min(F.transform(highway, lambda h: rank(h))), F.lit(99))


def lanes(values: Column) -> Column:
    """The first value as a number, 1 if it isn't one."""
    return F.coalesce(first_text(values).try_cast("int"), F.lit(1))


def oneway(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("yes", "true", "1"), F.lit(False))


def maxspeed(values: Column) -> Column:
    """The number before the first space, null if it isn't one; units aren't converted."""
    return F.get(F.split(F.trim(first_text(values)), r"\s+"), F.lit(0)).try_cast("int")


def positive_id(osmid: Column) -> Column:
    """The first positive id, else 0."""
    return F.coalesce(F.get(F.filter(osmid, lambda x: x > 0), F.lit(0)), F.lit(0))


def joined_name(names: Column) -> Column:
    """Different names in their order, joined by a slash; null for none."""
    return F.nullif(F.array_join(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))), " / "), F.lit(""))


def capacity(name: Column, lane_count: Column) -> Column:
    return lookup(CAPACITY, name, 200) * lane_count


def load(name: Column) -> Column:
    return lookup(LOAD, name, 0.3)


def volume(cap: Column, part: Column) -> Column:
    return (cap * part).cast("int")


def intensity(vehicles: Column) -> Column:
    """0 to 100; 1500 vehicles an hour are 100."""
    return F.least(F.lit(100), (vehicles / F.lit(1500.0) * 100).cast("int"))


def cut_cost(name: Column) -> Column:
    """Cost of closing a street: more for more important ones."""
    return F.lit(11) - rank(name, "enforcement")


#: A multiple of all speeds.
SPEEDS = 200


def speed(name: Column) -> Column:
    """Km an hour for travel times."""
    return F.when(name.isin(*ARTERIAL), 40.0).when(name == "residential", 25.0).otherwise(20.0)
