"""Map layers as rows, and a small HTML page of them; styles and bounds."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions.arrays import sample_even
from lanewright.settings import DEFAULT, Settings

#: Colours of the driven track, of planned lanes (ordinary, of other types), of all lanes behind them, of the snap lines
#: (origin, destination) and the marks at both ends.
HISTORY, PLANNED, PLANNED_OTHER, NETWORK = "#1677ff", "#f5222d", "#fa8c16", "#98A2B3"
SNAPS, ENDS = ("#13c2c2", "#722ed1"), ("green", "blue")
#: The type of ordinary lanes; colours of lines on batch maps, of areas by their type, and of other areas.
ORDINARY, LINES, OTHER_AREA = 101, "#555555", "#3388ff"
AREA_COLOURS = {
    "HD换电站": "#1f77b4",
    "HD装料区": "#2ca02c",
    "HD装料位": "#2ca02c",
    "HD卸料位": "#ff7f0e",
    "HD排土场": "#9467bd",
    "HD均衡碾压区": "#d62728",
    "HD限速区": "#8c564b",
    "HD上下坡区": "#e377c2",
    "HD停车位": "#17becf",
}
#: Colours of tasks on batch maps, over again after the last; the mark at a task's end.
TASK_COLOURS = (
    "#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00", "#a65628", "#f781bf", "#666666", "#66c2a5", "#fc8d62",
    "#8da0cb", "#e78ac3", "#a6d854", "#d9a300", "#b3b3b3", "#1b9e77", "#d95f02", "#7570b3", "#e7298a", "#66a61e",
)
TASK_END = "red"
#: Rows of a map in the order they are drawn: by place of the layer, then item. raw_count is the number of points before sampling.
COLUMNS = ("place", "layer", "item", "kind", "coords", "colour", "weight", "opacity", "tooltip", "raw_count")


def lane_colour(type_id: Column) -> Column:
    return F.when(type_id == ORDINARY, PLANNED).otherwise(PLANNED_OTHER)


def task_colour(nth: Column) -> Column:
    """The colour of the nth task of a map, from 0."""
    return F.get(F.array(*[F.lit(c) for c in TASK_COLOURS]), F.pmod(nth, F.lit(len(TASK_COLOURS))).cast("int"))


def area_colour(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in AREA_COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(OTHER_AREA))


def lat_lon(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))


def shape(df: DataFrame, keys: list[str], place: Column | int, layer: Column | str, item: Column | int, kind: str, coords: Column, colour: Column | str, tooltip: Column, style: tuple[float, float], raw: Column | None = None) -> DataFrame:
    """Rows of COLUMNS, with the keys of their maps. style is weight (width or radius) and opacity."""
    plain = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (plain(place).cast("int"), plain(layer), plain(item).cast("long"), F.lit(kind), coords, plain(colour), F.lit(float(style[0])), F.lit(float(style[1])), tooltip, F.size(coords).cast("long") if raw is None else raw)
    return df.select(*keys, *(v.alias(c) for v, c in zip(values, COLUMNS, strict=True)))


def route_layers(planned: DataFrame, parts: DataFrame, tracks: DataFrame, lanes: DataFrame | None = None, settings: Settings = DEFAULT, keys: list[str] | None = None) -> DataFrame:
    """The layers of the maps of tasks (keys; none for one task): network (if given, for one task), driven track, planned lanes, marks
    and snap lines.

    planned has o_proj, d_proj and the ends of the track (origin and destination structs); parts the drawn lanes with type_id,
    name and length_m; tracks the points.
    """
    keys, points = keys or [], F.col("points")
    rows = shape(tracks, keys, 1, "history", 0, "line", lat_lon(sample_even(points, settings.max_history_points)), HISTORY, F.format_string("driven: %d points", F.size(points)), (5, 0.88), F.size(points).cast("long"))
    number = (F.col("pos") + 1).cast("int")
    tip = F.format_string("%d: %s, %s, %.1f m", number, F.col("uid"), F.coalesce("name", F.lit("")), F.col("length_m"))
    rows = rows.unionByName(shape(parts, keys, 2, "planned", F.col("pos"), "line", lat_lon(points), lane_colour(F.col("type_id")), tip, (7, 0.93)))
    for i, (side, proj) in enumerate((("origin", "o_proj"), ("destination", "d_proj"))):
        at = F.struct(F.col(f"{side}.lat").alias("lat"), F.col(f"{side}.lon").alias("lon"))
        on = F.struct(F.col(f"{proj}.projected_lat").alias("lat"), F.col(f"{proj}.projected_lon").alias("lon"))
        drawn = ((i, "mark", F.array(at), ENDS[i], side, (5, 1)), (2 + 2 * i, "mark", F.array(on), SNAPS[i], f"{side} on its lane", (6, 1)), (3 + 2 * i, "line", F.array(at, on), SNAPS[i], f"{side} snap", (3, 0.9)))
        for item, kind, coords, colour, tip, style in drawn:
            rows = rows.unionByName(shape(planned, keys, 3, "marks", item, kind, coords, colour, F.lit(tip), style))
    if lanes is not None:
        rows = rows.unionByName(shape(lanes, keys, 0, "network", F.col("lane_ord"), "line", lat_lon(sample_even(points, settings.max_lane_points)), NETWORK, F.concat_ws(" ", "name", "uid"), (1, 0.3), F.size(points).cast("long")))
    return rows


def batch_layers(routes: DataFrame, areas: DataFrame, lines: DataFrame) -> DataFrame:
    """The layers of the maps of all files (column file): one layer per task with marks at its ends, then lines, then areas.

    Tasks are numbered and coloured by their place among the drawn tasks of their file; lines and areas stand in the order of the
    resources (feature).
    """
    routes = routes.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1)
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    place, colour, points = F.col("nth"), task_colour(F.col("nth")), lat_lon(F.col("points"))
    name = F.concat(F.lit("Task "), (F.col("nth") + 1).cast("string"), F.lit(": "), none("task_id"), F.lit(" | "), none("start_time"))
    speed = F.when(F.col("max_speed").isNotNull(), F.concat(F.lit("at most "), F.col("max_speed").cast("string")))
    tip = F.concat_ws(", ", "task_id", "start_time", "end_time", F.format_string("%d points, %d drawn", "raw_count", F.size("points")), speed)
    rows = shape(routes, ["file"], place, name, 0, "line", points, colour, tip, (4, 0.9), F.col("raw_count"))
    for item, (at, what, own) in enumerate(((1, "start", colour), (-1, "end", F.lit(TASK_END)))):
        rows = rows.unionByName(shape(routes, ["file"], place, name, item + 1, "mark", F.array(F.element_at(points, at)), own, F.concat_ws(" ", F.lit(what), "task_id"), (4, 1)))
    behind = 1 << 30  # behind all tasks of any file
    in_order = F.row_number().over(Window.partitionBy("file").orderBy("feature")) - 1
    rows = rows.unionByName(shape(lines, ["file"], behind, "lanes", in_order, "line", points, LINES, F.col("tooltip"), (2, 0.35), F.col("raw_count")))
    return rows.unionByName(shape(areas, ["file"], behind + 1, "areas", in_order, "area", points, area_colour(F.col("type")), F.col("tooltip"), (2, 0.18)))


def bounds(parts: DataFrame, tracks: DataFrame, padding: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """South, west, north, east of the maps of tasks (keys; none for one), padded, and the mean of all coordinates as the centre.

    Of all points driven (tracks) and of the planned lanes (parts), also where route_layers() draws only some of them.
    """
    keys = keys or []
    lines = parts.select(*keys, lat_lon(F.col("points")).alias("coords")).unionByName(tracks.select(*keys, lat_lon(F.col("points")).alias("coords")))
    return lines.select(*keys, F.explode("coords").alias("p")).groupBy(*keys).agg(
        (F.min("p.lat") - padding).alias("south"), (F.min("p.lon") - padding).alias("west"), (F.max("p.lat") + padding).alias("north"), (F.max("p.lon") + padding).alias("east"),
        F.avg("p.lat").alias("centre_lat"), F.avg("p.lon").alias("centre_lon"),
    )


def page(layers: Iterable, title: str, box: tuple[float, float, float, float], legend: Iterable[str] = (), centre: tuple[float, float] | None = None) -> str:
    """A self-contained page that draws the rows of one map in their order as SVG within a box (south, west, north, east), a group per
    layer with a box to show or hide it, and a legend. What lies outside the box is cut off. The page states its centre (latitude,
    longitude), the middle of the box unless given."""
    south, west, north, east = box
    scale = 1000 / max(east - west, north - south, 1e-9)
    place = lambda c: f"{(c['lon'] - west) * scale:.2f},{(north - c['lat']) * scale:.2f}"
    groups: dict[str, list[str]] = {}
    middle = centre or ((south + north) / 2, (west + east) / 2)
    for r in sorted(layers, key=lambda x: (x["place"], x["item"])):
        tip, colour = f"<title>{html.escape(r['tooltip'] or '')}</title>", html.escape(r["colour"], quote=True)
        drawn = groups.setdefault(r["layer"], [])
        if r["kind"] == "mark":
            x, y = place(r["coords"][0]).split(",")
            drawn.append(f'<circle cx="{x}" cy="{y}" r="{r["weight"]:g}" fill="{colour}" opacity="{r["opacity"]:g}">{tip}</circle>')
        else:
            tag, fill = ("polygon", colour) if r["kind"] == "area" else ("polyline", "none")
            drawn.append(f'<{tag} points="{" ".join(map(place, r["coords"]))}" stroke="{colour}" stroke-width="{r["weight"]:g}" stroke-opacity="{1 if r["kind"] == "area" else r["opacity"]:g}" fill="{fill}" fill-opacity="{r["opacity"]:g}">{tip}</{tag}>')
    boxes = "".join(f'<label><input type="checkbox" checked onchange="document.getElementById(\'g{i}\').style.display=this.checked?\'\':\'none\'">{html.escape(name)}</label> ' for i, name in enumerate(groups))
    shapes = "".join(f'<g id="g{i}">{"".join(drawn)}</g>' for i, drawn in enumerate(groups.values()))
    told = "".join(f"<li>{html.escape(x)}</li>" for x in legend)
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><p>{boxes}</p><ul>{told}</ul><svg data-centre="{middle[0]:.6f},{middle[1]:.6f}" viewBox="0 0 {(east - west) * scale:.0f} {(north - south) * scale:.0f}">{shapes}</svg>'.replace("\n", " ")
