"""The engine's output documents with their own fields: a header and ordered rows as one JSON text a key, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark types of each document: header fields, then the array of rows.
SCHEMAS = {
    "detections": "video_id bigint, classCounts map<string,bigint>, detections array<struct<frame:int,idx:int,label:string,conf:double,x1:double,y1:double,x2:double,y2:double,cx:double,cy:double,foot_x:double,foot_y:double>>",
    "tracks": "label string, players array<struct<track_id:bigint,points:array<struct<frame:bigint,t:double,px:double,py:double,conf:double,missing:boolean>>>>",
    "court_tracks": "track_id bigint, onCourtFraction double, points array<struct<frame:bigint,t:double,x:double,y:double>>",
    "trajectories": "track_id bigint, trajectory array<struct<player_id:bigint,label:string,t:double,x:double,y:double,frame:bigint,interpolated:boolean>>",
    "ball_track": "track_id bigint, frameCount bigint, detectionRate double, frames array<struct<frame:bigint,tSec:double,x:double,y:double,confidence:double,predicted:boolean>>",
    "attempts": "track_id bigint, attemptCount bigint, attempts array<struct<frame:bigint,tSec:double,confidence:double,entrySpeed:double,ballPos:struct<x:double,y:double>,signalKind:string>>",
    "court_detect": "video_id bigint, best struct<frame:int,idx:int,conf:double>, frames array<struct<frame:int,idx:int,conf:double,keypoints:array<struct<x:double,y:double>>>>",
    "scoreboard": "video_id bigint, clockMap array<struct<gameClock:string,videoTimeSec:double>>, readings array<struct<videoTimeSec:double,gameClock:string,rawOcr:map<string,string>>>",
}


def ordered(order: list[str], item: Column) -> Column:
    """Aggregate: the items of a key in order; one document's rows meet in one task, as in the document."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))), lambda x: x["item"])


def counts_by(label: Column) -> Column:
    """Aggregate: how often each label occurs."""
    every = F.collect_list(label)
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(every)), lambda v: F.struct(v, F.size(F.filter(every, lambda x: x == v)).cast("bigint"))))


def write(rows: DataFrame, kind: str) -> DataFrame:
    """(document): `rows` with the columns of the kind's schema as JSON."""
    names = [p.split()[0] for p in _fields(SCHEMAS[kind])]
    return rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("document"))


def parse(documents: DataFrame, kind: str) -> DataFrame:
    """The header columns and the array of rows of each document."""
    return documents.select(F.from_json("document", f"{SCHEMAS[kind]}").alias("d")).select("d.*")


def _fields(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]
