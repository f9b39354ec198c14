"""What a map view derives from the tables: bands, colours, progress, event text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 50, "ok").otherwise("poor")


def traffic_colour(intensity: Column) -> Column:
    """Red, green, blue and opacity."""
    r = F.least(F.lit(255), F.floor(intensity / 100 * 255))
    g = F.least(F.lit(255), F.floor((1 - intensity / 100) * 200))
    return F.concat_ws(",", r.cast("string"), g.cast("string"), F.lit("50"), F.lit("220"))


def clock(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.pmod(F.floor(seconds), F.lit(60)))


def remaining(elapsed: Column, percent: Column, guess: float) -> Column:
    """Seconds to go at the speed so far."""
    return F.when(percent <= 0, F.lit(guess)).otherwise(F.greatest(F.lit(0.0), elapsed / (percent / 100) - elapsed))


def event_text(events: DataFrame) -> DataFrame:
    """stage, percent, message -> one text in the format of server-sent events."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct("type", "stage", "percent", "message")), F.lit("\n\n")).alias("text"))


def parse_events(texts: DataFrame) -> DataFrame:
    """Events of texts, one row each."""
    parts = texts.select(F.explode(F.split("text", "\n\n")).alias("part")).where(F.col("part").startswith("data: "))
    return parts.select(F.from_json(F.regexp_replace("part", r"\Adata: ", ""), "type string, stage string, percent int, message string").alias("e")).select("e.*")


def impact(scored: DataFrame) -> DataFrame:
    """Total area, mean removed traffic, and what follows from it."""
    removed = F.least(F.lit(80.0), 0.8 * F.col("traffic"))
    t = scored.agg(F.sum("area_ha").alias("a"), F.avg(F.when(F.col("interior") > 0, removed).otherwise(F.col("total") * 0.6)).alias("r"), F.sum("interior").alias("i"))
    return t.select(F.round("a", 1).alias("area_ha"), F.round("r", 1).alias("traffic_removed"), F.round(F.col("r") * 0.8).alias("pollution"), F.round(F.col("i") * 0.05, 1).alias("pedestrian_km"))


def palette_index(order: Column, colours: int = 10) -> Column:
    return F.pmod(order, F.lit(colours)).cast("int")


def block_status(valid: Column, reachable: Column) -> Column:
    return F.when(valid & reachable, "green").when(valid, "yellow").otherwise("red")


def arrow_places(n: Column) -> Column:
    """Places along a line of n points where arrows stand: a quarter, half, three quarters."""
    return F.transform(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), lambda k: F.floor((n - 1) * k).cast("int"))


# Stages of an analysis in their order.
STAGES = ("network", "centrality", "detection", "scoring", "interventions", "complete")


def stage_number(stage: Column) -> Column:
    return F.coalesce(*[F.when(stage == s, F.lit(k)) for k, s in enumerate(STAGES, 1)], F.lit(0))


# Colour (red, green, blue, opacity) and width of roads by rank.
ROAD_STYLE = {
    1: ("139,0,0,255", 6.0), 2: ("220,20,60,255", 5.0), 3: ("255,69,0,255", 4.0), 4: ("255,140,0,255", 3.0), 5: ("255,215,0,255", 2.5),
    6: ("144,238,144,255", 2.0), 7: ("152,251,152,255", 1.5), 8: ("176,196,222,255", 1.5), 9: ("211,211,211,255", 1.0), 10: ("230,230,250,255", 1.0),
}
PLAIN_STYLE = ("128,128,128,200", 1.5)


def road_style(rank: Column) -> tuple[Column, Column]:
    """Colour and width of a road; plain ones for ranks without a style."""
    pick = lambda k: F.coalesce(*[F.when(rank == r, F.lit(s[k])) for r, s in ROAD_STYLE.items()], F.lit(PLAIN_STYLE[k]))
    return pick(0), pick(1)


def midpoint(line: Column) -> Column:
    """The point in the middle of a line's list of points."""
    return F.get(line, F.floor(F.size(line) / 2).cast("int"))


def line_of(geometry: Column, ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """A line's own points, or the straight line between its ends."""
    return F.coalesce(geometry, F.array(F.struct(ux.alias("x"), uy.alias("y")), F.struct(vx.alias("x"), vy.alias("y"))))


def coupled(low: Column, high: Column, gap: float, moved: str) -> tuple[Column, Column]:
    """Limits that keep a gap: the one that wasn't moved gives way."""
    return (low, F.greatest(low + gap, high)) if moved == "low" else (F.least(low, high - gap), high)


def arrows(line: Column) -> Column:
    """place, x, y and angle of the arrows of a line: degrees from east, from the point before to the one behind."""
    n = F.size(line)
    one = lambda k: F.struct(
        k.alias("place"), F.get(line, k)["x"].alias("x"), F.get(line, k)["y"].alias("y"),
        F.degrees(F.atan2(F.get(line, F.least(n - 1, k + 1))["y"] - F.get(line, F.greatest(F.lit(0), k - 1))["y"], F.get(line, F.least(n - 1, k + 1))["x"] - F.get(line, F.greatest(F.lit(0), k - 1))["x"])).alias("angle"),
    )
    return F.when(n >= 2, F.transform(arrow_places(n), one))


# Colours of interventions, of streets of a chosen block without one and of those outside, and of changes.
INTERVENTION_COLOURS = {"pedestrianize": "34,197,94,255", "one_way": "59,130,246,255", "modal_filter": "251,191,36,255", "local_access": "168,85,247,255", "no_change": "156,163,175,200"}
INNER_COLOUR, FADED_COLOUR = "100,100,100,180", "200,200,200,100"
CHANGE_COLOURS = {"modal_filter": "239,68,68,255", "one_way": "59,130,246,255", "full_closure": "124,58,237,255"}
OTHER_CHANGE = "251,191,36,255"


def street_colour(mode: Column, intensity: Column, chosen: Column, action: Column, role: Column, change: Column, rank: Column) -> Column:
    """Colour of a street by what the map shows: traffic; the interventions of a chosen block, its perimeter, its interior, other streets faded; changes; or the class.

    mode is traffic, interventions, partition or class; chosen tells whether there is a block to show.
    """
    named = lambda table, key, other: F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(other))
    traffic = F.concat_ws(",", F.least(F.lit(255), F.floor(intensity / 100 * 255)).cast("string"), F.least(F.lit(255), F.floor((1 - intensity / 100) * 200)).cast("string"), F.lit("50"), F.lit("220"))
    block = F.when(action.isNotNull(), named(INTERVENTION_COLOURS, action, PLAIN_STYLE[0])).when(role == "boundary", INTERVENTION_COLOURS["no_change"]).when(role == "interior", INNER_COLOUR).otherwise(FADED_COLOUR)
    style, _ = road_style(rank)
    return F.when(mode == "traffic", traffic).when((mode == "interventions") & chosen, block).when((mode == "partition") & change.isNotNull(), named(CHANGE_COLOURS, change, OTHER_CHANGE)).otherwise(style)
