"""Documents and shapes that a register names: fetched in tasks with their failures kept as rows, and feature collections as tables."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.sources.paged import Lane
from quarrystone.sources.patience import Patience, Reply, Unanswered, http

#: Headers that speak for the user, and go to no other host than the one that was asked.
SECRET = {"authorization", "cookie", "proxy-authorization"}


class Guarded(urllib.request.HTTPRedirectHandler):
    """Follows redirects; secret headers stay with the host (and port) that they were meant for."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None and urlsplit(newurl).netloc != urlsplit(req.full_url).netloc:
            for name in [h for h in (*new.headers, *new.unredirected_hdrs) if h.lower() in SECRET]:
                new.remove_header(name)
        return new


def guarded(request: urllib.request.Request, timeout: float):
    return urllib.request.build_opener(Guarded).open(request, timeout=timeout)


def fetched(index: DataFrame, url: str, headers: dict[str, str] | None = None, patience: Patience = Patience(), lanes: int = 8, rate: float = 0.0, ask: Callable[..., Reply] = http) -> DataFrame:  # noqa: B008
    """index with status, content (binary) and error: each document is asked for in a task, and one that fails is a row like others.

    All tasks together keep to ``rate`` calls a second. What is read again is fetched again: write the result before using it twice.
    """
    names = [f.name for f in index.schema]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in index.schema)}, status int, content binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = Lane(TaskContext.get().partitionId() % lanes, lanes, rate)

        def one(where: str) -> Reply:
            lane.wait()
            return ask(where, headers, opener=guarded)

        for batch in batches:
            for i, where in enumerate(batch.column(names.index(url)).to_pylist()):
                status, content, error = None, None, None
                if where is None:
                    error = "no url"
                else:
                    try:
                        reply = patience.settled(lambda w=where: one(w), where)
                        status = reply.status
                        content, error = (reply.body, None) if status < 400 else (None, f"status {status}")
                    except Unanswered as e:
                        error = str(e)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([status], pa.int32()), pa.array([content], pa.binary()), pa.array([error], pa.string())], [*names, "status", "content", "error"])

    return index.repartition(lanes).mapInArrow(run, schema)


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The properties (a struct's fields in DDL), kind and rings of every feature of GeoJSON files.

    rings: arrays of points (x, y); those of all polygons of a multipolygon one behind the other, lines and points as one ring each. Features without a shape have none.
    """
    geometry = "struct<type: string, coordinates: string>"
    schema = f"features array<struct<properties: struct<{properties}>, geometry: {geometry}>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    read = lambda depth: F.from_json(raw, "array<" * depth + "double" + ">" * depth)
    rings = (
        F.when(kind == "Point", F.array(F.array(read(1)))).when(kind.isin("MultiPoint", "LineString"), F.array(read(2)))
        .when(kind.isin("MultiLineString", "Polygon"), read(3)).when(kind == "MultiPolygon", F.flatten(read(4)))
    )
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return whole.select("f.properties.*", kind.alias("kind"), points.alias("rings"))


def bounds(shapes: DataFrame) -> DataFrame:
    """shapes with west, south, east, north of their rings."""
    of = lambda c: F.flatten(F.transform("rings", lambda ring: F.transform(ring, lambda p: p[c])))
    x, y = of("x"), of("y")
    return shapes.withColumns({"west": F.array_min(x), "south": F.array_min(y), "east": F.array_max(x), "north": F.array_max(y)})
