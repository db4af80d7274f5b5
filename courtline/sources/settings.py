"""Hand-made settings: hoops and court polygons, scoreboard regions, calibrations, kits and configurations, from JSON texts; label and tracker files."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HOOP = "struct<x:double,y:double,w:double,h:double>"
SCHEMAS = {
    "hoops": f"courtHoops array<{_HOOP}>, leftHoop {_HOOP}, rightHoop {_HOOP}, hoopRoi {_HOOP}, courtPolygon array<struct<x:double,y:double>>",
    "regions": "regions map<string,struct<x:double,y:double,w:double,h:double>>",
    "calibration": "court struct<length:double,width:double,unit:string,layout:string,preset:string>, points array<struct<court:struct<x:double,y:double>,pixel:struct<x:double,y:double>>>",
    "kits": "kits array<struct<name:string,color:string,samples:array<array<int>>>>",
}
METRES_TO_FEET = 3.28084


def parsed(documents: DataFrame, kind: str, document: str = "document") -> DataFrame:
    """Adds the fields of each JSON text; a text that is no such document gives nulls."""
    return documents.withColumn("__d", F.from_json(document, SCHEMAS[kind])).select(*documents.columns, "__d.*")


def marked_hoops() -> Column:
    """The listed hoops, else left and right, else the single one; by x. Null if none is marked."""
    sides = F.filter(F.array("leftHoop", "rightHoop"), lambda h: h.isNotNull())
    single = F.when(F.col("hoopRoi").isNotNull(), F.array("hoopRoi"))
    found = F.when(F.size("courtHoops") > 0, F.col("courtHoops")).when(F.size(sides) > 0, sides).otherwise(single)
    by_x = F.array_sort(F.transform(found, lambda h, k: F.struct(h["x"].alias("at"), k.alias("k"), h.alias("h"))))
    return F.transform(by_x, lambda s: s["h"])


def court_polygon() -> Column:
    return F.when(F.size("courtPolygon") >= 3, F.col("courtPolygon"))


def calibrated_court() -> dict[str, Column]:
    """Layout, sizes in feet and whether the calibration can be used: it needs four pairs of points. Half if under 20 long."""
    c = F.col("court")
    length, width = F.coalesce(c["length"], F.lit(28.0)), F.coalesce(c["width"], F.lit(15.0))
    metres = F.coalesce(c["unit"], F.lit("m")).isin("m", "meter", "meters")
    scale = F.when(metres, METRES_TO_FEET).otherwise(1.0)
    layout = F.when(c["layout"].isin("full", "half"), c["layout"]).when(length < 20, "half").otherwise("full")
    return {"layout": layout, "length_ft": length * scale, "width_ft": width * scale, "usable": F.coalesce(F.size("points") >= 4, F.lit(False))}


def kit_colours() -> Column:
    """Array of (name, r, g, b): the kit's own colour (#rrggbb) if it has one, else the median of its samples."""

    def channel(samples: Column, k: int) -> Column:
        return F.transform(samples, lambda s: F.try_element_at(s, F.lit(k + 1)))

    def one(kit: Column) -> Column:
        shown = [F.conv(F.substring(kit["color"], at, 2), 16, 10).cast("double") for at in (2, 4, 6)]
        place = ((F.size(kit["samples"]) + 1) / 2).cast("int")
        middle = [F.try_element_at(F.array_sort(channel(kit["samples"], k)), place).cast("double") for k in range(3)]
        given = kit["color"].rlike("^#[0-9a-fA-F]{6}$")
        return F.struct(kit["name"].alias("name"), *[F.when(given, a).otherwise(b).alias(n) for n, a, b in zip("rgb", shown, middle, strict=True)])

    return F.filter(F.transform("kits", one), lambda k: k["r"].isNotNull())


def configured(defaults, document: str | None = None, **flags):
    """A configuration (dataclass): defaults, then the file's values, then the flags that are given. Unknown names are an error."""
    known = {f.name for f in fields(defaults)}
    more = (json.loads(document) if document else {}) | {k: v for k, v in flags.items() if v is not None}
    if unknown := sorted(set(more) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(defaults, **more)


def tracker_lines(config) -> str:
    """A tracker's configuration as lines `name: value`."""
    return "".join(f"{k}: {v}\n" for k, v in asdict(config).items())


def dataset_lines(root: str, names: list[str]) -> str:
    """The description of a training set in `root`."""
    return f"path: {root}\ntrain: train/images\nval: valid/images\nnc: {len(names)}\nnames: {names}\n"


def first_available(wanted: str | None, available: list[str], allow_cpu: bool = True) -> str:
    """The wanted device if it is there, else the first of those there; the processor only where that is allowed."""
    usable = [d for d in available if allow_cpu or d != "cpu"]
    if wanted in usable:
        return wanted
    if wanted or not usable:
        raise ValueError(f"no device {wanted or ''} among {usable}")
    return usable[0]
