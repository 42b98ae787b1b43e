"""Geometry functions of the dialects: WKB values, Arrow-batched UDFs over the planar geometry module.

With the parameter GEO_MODE = GEOGRAPHY, areas, lengths and distances are in metres on the mean sphere. A value
may be WKB, WKT, hexadecimal WKB or GeoJSON wherever a geometry is asked for.
"""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import geometry as g

#: UDF name: (function, Spark type, how many leading arguments are geometries).
BOX = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
UDFS = {
    "geo_parse": (lambda x: x, "binary", 1), "geo_text": (g.to_wkt, "string", 1), "geo_json": (g.to_geojson, "string", 1), "geo_point": (lambda *c: ("POINT", tuple(map(float, c))), "binary", 0),
    "geo_area": (g.area, "double", 1), "geo_sphere_area": (g.sphere_area, "double", 1), "geo_length": (g.length, "double", 1), "geo_sphere_length": (lambda x: g.length(x, g.haversine), "double", 1), "geo_perimeter": (g.perimeter, "double", 1), "geo_sphere_perimeter": (lambda x: g.perimeter(x, g.haversine), "double", 1),
    "geo_distance": (g.distance, "double", 2), "geo_sphere_distance": (lambda a, b: g.distance(a, b, g.haversine), "double", 2), "geo_max_distance": (g.max_distance, "double", 2), "geo_sphere_max_distance": (lambda a, b: g.max_distance(a, b, g.haversine), "double", 2),
    "geo_closest": (lambda a, b: ("POINT", g.closest(a, b)[0]), "binary", 2), "geo_npoints": (lambda x: sum(1 for _ in g.points(x)), "int", 1), "geo_type": (lambda x: x[0], "string", 1), "geo_dimension": (g.dimension, "int", 1), "geo_ndims": (lambda x: len(next(g.points(x), (0, 0))), "int", 1),
    "geo_coordinate": (lambda x, k: x[1][k] if x[0] == "POINT" and x[1] and len(x[1]) > k else None, "double", 1), "geo_box": (lambda x: dict(zip(("xmin", "ymin", "xmax", "ymax"), g.box(x))), BOX, 1), "geo_envelope": (lambda x: g.rectangle(*g.box(x)), "binary", 1), "geo_rectangle": (lambda *c: g.rectangle(*map(float, c)), "binary", 0),
    "geo_buffer": (lambda x, by, *rest: g.buffer(x, float(by)), "binary", 1), "geo_centroid": (g.centroid, "binary", 1), "geo_hull": (g.hull, "binary", 1), "geo_boundary": (g.boundary, "binary", 1), "geo_simplify": (lambda x, by: g.mapped(x, lambda line: g.thinned(line, float(by))), "binary", 1), "geo_reverse": (lambda x: g.mapped(x, lambda line: line[::-1]), "binary", 1),
    "geo_polygon": (lambda x, *holes: ("POLYGON", [x[1], *(h[1] for h in holes)]), "binary", 1), "geo_force3d": (lambda x: g.mapped(x, lambda line: [(*p[:2], p[2] if len(p) > 2 else 0.0) for p in line]) if x[0] != "POINT" else ("POINT", (*x[1][:2], x[1][2] if len(x[1]) > 2 else 0.0)), "binary", 1),
    "geo_pair": (lambda a, b: g.collected([*g.singles(a), *g.singles(b)]), "binary", 2), "geo_union": (lambda a, b: g.union([a, b]), "binary", 2), "geo_intersection": (g.intersection, "binary", 2), "geo_difference": (g.difference, "binary", 2),
    "geo_start": (lambda x: ("POINT", x[1][0]) if x[0] == "LINESTRING" and x[1] else None, "binary", 1), "geo_end": (lambda x: ("POINT", x[1][-1]) if x[0] == "LINESTRING" and x[1] else None, "binary", 1), "geo_nth": (lambda x, n: ("POINT", x[1][n - 1 if n > 0 else n]) if x[0] == "LINESTRING" and 0 < abs(n) <= len(x[1]) else None, "binary", 1),
    "geo_points": (lambda x: ("MULTIPOINT", [("POINT", p) for p in g.points(x)]), "binary", 1), "geo_ring": (lambda x: ("LINESTRING", x[1][0]) if x[0] == "POLYGON" and x[1] else None, "binary", 1), "geo_holes": (lambda x: len(x[1]) - 1 if x[0] == "POLYGON" and x[1] else None, "int", 1), "geo_parts": (lambda x: len(x[1]) if x[0] in g.SINGLE or x[0] == "GEOMETRYCOLLECTION" else int(bool(x[1])), "int", 1),
    "geo_multi": (lambda x: x if x[0] in g.SINGLE or x[0] == "GEOMETRYCOLLECTION" else (f"MULTI{x[0]}", [x] if x[1] else []), "binary", 1), "geo_empty": (lambda x: not any(g.singles(x)), "boolean", 1), "geo_is_ring": (lambda x: x[0] == "LINESTRING" and len(x[1]) > 3 and x[1][0] == x[1][-1] and g.is_simple(x), "boolean", 1), "geo_simple": (g.is_simple, "boolean", 1), "geo_valid": (g.is_valid, "boolean", 1),
    "geo_contains": (g.contains, "boolean", 2), "geo_contains_properly": (g.contains_properly, "boolean", 2), "geo_covers": (g.covers, "boolean", 2), "geo_intersects": (g.intersects, "boolean", 2), "geo_touches": (g.touches, "boolean", 2), "geo_crosses": (g.crosses, "boolean", 2), "geo_equals": (g.equals, "boolean", 2),
}


#: Arguments in bytes or characters up to which a worker keeps a call's result, and how many results it keeps.
KEPT_SIZE, KEPT = 1024, 4096


def evaluate(name: str, args: tuple):
    """A function of geometries that are parsed, its result written."""
    function, kind, count = UDFS[name]
    found = function(*(g.parse(a) if k < count or isinstance(a, (bytes, bytearray)) else a for k, a in enumerate(args)))
    return g.to_wkb(found) if kind == "binary" and found is not None else found


@functools.lru_cache(KEPT, typed=True)
def remembered(name: str, *args):
    return evaluate(name, args)


def keepable(args: tuple) -> bool:
    """Whether the arguments are small, and those equal to them the same (0.0 and -0.0 aren't)."""
    size = 0
    for a in args:
        kind = type(a)
        if kind is bytes or kind is str:
            size += len(a)
        elif kind is bytearray or kind is not int and a == 0:
            return False
    return size <= KEPT_SIZE


def wrapped(name: str, safe: bool = False):
    """A UDF's body: NULL for any NULL. Columns often repeat geometries, so a worker keeps the last used results of small arguments."""
    keep = UDFS[name][1] != BOX  # a dict, which others could change

    def run(*args):
        if None in args:
            return None
        try:
            return remembered(name, *args) if keep and keepable(args) else evaluate(name, args)
        except (ValueError, KeyError, IndexError, StopIteration):
            if safe:
                return None
            raise

    return run


def from_list(function):
    def run(values):
        parts = [g.parse(v) for v in values or [] if v is not None]
        return g.to_wkb(function(parts)) if parts else None

    return run


def register(spark: SparkSession) -> None:
    for name, (_, kind, _) in UDFS.items():
        spark.udf.register(name, F.udf(wrapped(name), kind, useArrow=True))
    spark.udf.register("geo_try_parse", F.udf(wrapped("geo_parse", True), "binary", useArrow=True))
    spark.udf.register("geo_collect", F.udf(from_list(lambda parts: g.collected([x for p in parts for x in g.singles(p)])), "binary", useArrow=True))
    spark.udf.register("geo_union_list", F.udf(from_list(g.union), "binary", useArrow=True))
    spark.udf.register("geo_dump", F.udf(lambda x: None if x is None else [g.to_wkb(p) for p in g.singles(g.parse(x))], "array<binary>", useArrow=True))


def by_mode(flat: str, sphere: str):
    def build(e, node, a):
        name = sphere if e.params.get("GEO_MODE", "").upper() == "GEOGRAPHY" else flat
        return f"{name}({', '.join(a)})"

    return build


def first(name: str, n: int):
    """The function of the first n arguments: others are precisions and the like."""
    return lambda e, node, a: f"{name}({', '.join(a[:n])})"


def collect(e, node, a):
    from .registry import clauses

    return f"geo_pair({a[0]}, {a[1]})" if len(a) == 2 else f"geo_collect(collect_list({a[0]}){clauses(e, node)})"


def union(e, node, a):
    from .registry import clauses

    return f"geo_union({a[0]}, {a[1]})" if len(a) == 2 and node.name == "ST_UNION" else f"geo_union_list(collect_list({a[0]}){clauses(e, node)})"


def extent(e, node, a):
    """Minima and maxima of the boxes, so that partial results combine."""
    from .registry import clauses

    over = clauses(e, node)
    return "named_struct(" + ", ".join(f"'{k}', {k[1:]}(geo_box({a[0]}).{k}){over}" for k in ("xmin", "ymin", "xmax", "ymax")) + ")"


def within_distance(e, node, a):
    name = "geo_sphere_distance" if e.params.get("GEO_MODE", "").upper() == "GEOGRAPHY" else "geo_distance"
    return f"({name}({a[0]}, {a[1]}) <= {a[2]})"


READERS = """ST_GEOGFROMTEXT ST_GEOMFROMTEXT ST_GEOMETRYFROMTEXT ST_GEOMFROMWKT ST_GEOMETRYFROMWKT ST_GEOMFROMEWKT ST_GEOMETRYFROMEWKT ST_GEOGFROMWKT TO_GEOMETRY TO_GEOGRAPHY
ST_GEOGFROMWKB ST_GEOMFROMWKB ST_GEOMETRYFROMWKB ST_GEOMFROMEWKB ST_GEOMETRYFROMEWKB ST_GEOGFROMGEOJSON ST_GEOMFROMGEOJSON ST_GEOGFROM ST_ASBINARY ST_ASEWKB ST_ASWKB""".split()
CALLS = {
    **{n: first("geo_parse", 1) for n in READERS}, "TRY_TO_GEOMETRY": first("geo_try_parse", 1), "TRY_TO_GEOGRAPHY": first("geo_try_parse", 1),
    **{n: first("geo_text", 1) for n in ("ST_ASTEXT", "ST_ASEWKT", "ST_ASWKT")}, "ST_ASGEOJSON": first("geo_json", 1), "ST_ASHEXEWKB": "hex(geo_parse({0}))", "ST_ASHEXWKB": "hex(geo_parse({0}))",
    "ST_GEOGPOINT": "geo_point({*})", "ST_POINT": "geo_point({*})", "ST_MAKEPOINT": "geo_point({*})", "ST_X": "geo_coordinate({0}, 0)", "ST_Y": "geo_coordinate({0}, 1)", "ST_Z": "geo_coordinate({0}, 2)", "ST_M": "geo_coordinate({0}, 3)",
    "ST_AREA": lambda e, n, a: by_mode("geo_area", "geo_sphere_area")(e, n, a[:1]), "ST_LENGTH": lambda e, n, a: by_mode("geo_length", "geo_sphere_length")(e, n, a[:1]), "ST_PERIMETER": lambda e, n, a: by_mode("geo_perimeter", "geo_sphere_perimeter")(e, n, a[:1]), "ST_LENGTH2D": "geo_length({0})", "ST_PERIMETER2D": "geo_perimeter({0})", "ST_LENGTHSPHERE": "geo_sphere_length({0})",
    "ST_DISTANCE": lambda e, n, a: by_mode("geo_distance", "geo_sphere_distance")(e, n, a[:2]), "ST_DISTANCESPHERE": first("geo_sphere_distance", 2), "ST_MAXDISTANCE": lambda e, n, a: by_mode("geo_max_distance", "geo_sphere_max_distance")(e, n, a[:2]), "ST_DWITHIN": within_distance, "ST_CLOSESTPOINT": first("geo_closest", 2),
    "ST_NUMPOINTS": "geo_npoints({0})", "ST_NPOINTS": "geo_npoints({0})", "ST_BOUNDINGBOX": "geo_box({0})", "ST_EXTENT": extent, "ST_ENVELOPE": "geo_envelope({0})", "ST_MAKEENVELOPE": first("geo_rectangle", 4), "ST_BUFFER": "geo_buffer({*})", "ST_CENTROID": "geo_centroid({0})", "ST_CONVEXHULL": "geo_hull({0})", "ST_BOUNDARY": "geo_boundary({0})",
    "ST_SIMPLIFY": first("geo_simplify", 2), "ST_REVERSE": "geo_reverse({0})", "ST_MAKEPOLYGON": "geo_polygon({*})", "ST_POLYGON": first("geo_polygon", 1), "ST_FORCE3D": "geo_force3d({0})", "ST_COLLECT": collect, "ST_UNION": union, "ST_UNION_AGG": union, "ST_INTERSECTION": "geo_intersection({*})", "ST_DIFFERENCE": "geo_difference({*})",
    "ST_STARTPOINT": "geo_start({0})", "ST_ENDPOINT": "geo_end({0})", "ST_POINTN": "geo_nth({*})", "ST_POINTS": "geo_points({0})", "ST_EXTERIORRING": "geo_ring({0})", "ST_NUMINTERIORRINGS": "geo_holes({0})", "ST_NUMGEOMETRIES": "geo_parts({0})", "ST_MULTI": "geo_multi({0})", "ST_DUMP": "geo_dump({0})",
    "ST_ISEMPTY": "geo_empty({0})", "ST_ISRING": "geo_is_ring({0})", "ST_ISSIMPLE": "geo_simple({0})", "ST_ISVALID": "geo_valid({0})", "ST_DIMENSION": "geo_dimension({0})", "ST_NDIMS": "geo_ndims({0})", "GEOMETRYTYPE": "geo_type({0})", "ST_GEOMETRYTYPE": "concat('ST_', geo_type({0}))",
    "ST_CONTAINS": "geo_contains({*})", "ST_CONTAINSPROPERLY": "geo_contains_properly({*})", "ST_WITHIN": "geo_contains({1}, {0})", "ST_COVERS": "geo_covers({*})", "ST_COVEREDBY": "geo_covers({1}, {0})", "ST_INTERSECTS": "geo_intersects({*})", "ST_DISJOINT": "NOT geo_intersects({*})", "ST_TOUCHES": "geo_touches({*})", "ST_CROSSES": "geo_crosses({*})", "ST_EQUALS": "geo_equals({*})",
}
