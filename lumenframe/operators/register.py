"""Cross-session registration: centroids, pair distances, mutual nearest neighbours, conflict resolution.

Mappings are long: (meta..., mapping_id, session, unit_id); nodes are (session, unit_id) structs, so names may hold any character.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import near
from .cnmf import centroid
from .graph import connected_components
from .motion import _checkpoints


def fov_window(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, height, width): pixels that are absent (null or NaN) in the fewest sessions of their group."""
    absent = F.count_if(F.col("value").isNull() | F.isnan("value"))
    n = cells.groupBy(*by, "height", "width").agg(absent.alias("n"))
    least = n.groupBy(*by).agg(F.min("n").alias("least"))
    return (n.join(least, by) if by else n.crossJoin(F.broadcast(least))).where("n = least").select(*by, "height", "width")


def centroids_in(a: DataFrame, window: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """Centroids of footprints, counting the pixels of a window only."""
    return centroid(a.join(window, ["height", "width"], "left_semi"), by, height, width)


def _sides(cents: DataFrame, meta: list[str]) -> tuple[DataFrame, DataFrame]:
    side = lambda s: cents.select(*meta, F.col("session").alias(f"session_{s}"), F.col("unit_id").alias(f"unit_{s}"), F.col("height").alias(f"h_{s}"), F.col("width").alias(f"w_{s}"))
    return side("a"), side("b")


def _distance():
    dh, dw = F.col("h_a") - F.col("h_b"), F.col("w_a") - F.col("w_b")
    return F.sqrt(dh * dh + dw * dw)


def pair_distance(cents: DataFrame, radius: float, meta: list[str] | None = None) -> DataFrame:
    """(meta, session_a, unit_a, session_b, unit_b, distance) of all pairs of sessions' units less than radius apart: blocks of square cells meet their neighbours."""
    meta = meta or []
    rows = cents.select(*meta, "session", "unit_id", *[F.col(c).cast("double").alias(c) for c in ("height", "width")])
    blocks = near.pack(near.grid(rows, radius), [*meta, "ch", "cw"], ["session", "unit_id"])
    kinds = {c.name: c.dataType for c in cents.schema}

    def kernel(met):
        for x, y, a, b in met:
            sa, sb = near.numbers(a["session"]), near.numbers(b["session"])
            for i, j, distance in near.close(a, b, radius, True, x == y):
                on = sa[i] != sb[j]
                i, j = pa.array(i[on]), pa.array(j[on])
                yield [*[pa.repeat(a[c], len(i)) for c in meta], a["session"].take(i), a["unit_id"].take(i), b["session"].take(j), b["unit_id"].take(j), distance[on]]

    fields = [*[(c, kinds[c]) for c in meta], *[(f"{c}_{s}", kinds[k]) for s in "xy" for c, k in (("session", "session"), ("unit", "unit_id"))], ("distance", DoubleType())]
    out = near.meet(blocks, near.neighbours(blocks, meta), kernel, StructType([StructField(*f) for f in fields])).where("session_x != session_y")
    first = F.col("session_x") < F.col("session_y")
    pick = lambda c, a, b: F.when(first, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}"))
    return out.select(*meta, *[pick(c, a, b).alias(f"{c}_{n}") for n, a, b in (("a", "x", "y"), ("b", "y", "x")) for c in ("session", "unit")], "distance")


def _tiles_at(d: str, x, half: float):
    """Places of the tiles of dim d (columns n_, lo_ and span_ of it) that hold x."""
    n = F.col(f"n_{d}")
    gap = F.when(n > 1, F.col(f"span_{d}") / (n - 1)).otherwise(F.lit(0.0))

    def holds(i):
        centre = F.col(f"lo_{d}") + i * gap
        return (i < n) & x.between(centre - half, centre + half)

    return F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), holds)


def tile_pairs(cents: DataFrame, tile: tuple[float, float], meta: list[str] | None = None) -> DataFrame:
    """Pairs of sessions' units that share one of the overlapping tiles over both sessions' extent, with distance.

    Tiles per axis: ceil(extent * 2 / tile) centres from the least to the greatest coordinate, half a tile (rounded
    up) to either side; no extent, no tiles; one tile stands at the minimum.
    """
    meta = meta or []
    ends = cents.groupBy(*meta, "session").agg(*[f(d).alias(f"{n}_{d}") for d in ("height", "width") for n, f in (("lo", F.min), ("hi", F.max))])
    pick = lambda s: ends.select(*meta, F.col("session").alias(f"session_{s}"), *[F.col(f"{n}_{d}").alias(f"{n}_{d}_{s}") for d in ("height", "width") for n in ("lo", "hi")])
    both = pick("a").join(pick("b"), meta) if meta else pick("a").join(pick("b"), F.col("session_a") < F.col("session_b"))
    both = both.where("session_a < session_b")
    keys = [*meta, "session_a", "session_b"]
    for d, size in (("height", tile[0]), ("width", tile[1])):
        lo, hi = F.least(f"lo_{d}_a", f"lo_{d}_b"), F.greatest(f"hi_{d}_a", f"hi_{d}_b")
        both = both.withColumn(f"lo_{d}", lo).withColumn(f"span_{d}", hi - lo).withColumn(f"n_{d}", F.ceil(F.col(f"span_{d}") * 2 / size))

    lims = [f"{n}_{d}" for d in ("height", "width") for n in ("lo", "hi")]

    def tiles(units: DataFrame, s: str) -> DataFrame:
        """Blocks of units with the first and last tile that holds each, by axis: tiles that hold a place follow one another."""
        out = units.join(both.select(*keys, *[f"{n}_{d}" for d in ("height", "width") for n in ("lo", "span", "n")]), [*meta, f"session_{s}"])
        for d, x, size in (("height", f"h_{s}", tile[0]), ("width", f"w_{s}", tile[1])):
            out = out.withColumn(f"_{d}", _tiles_at(d, F.col(x), float(-(-size // 2))))
        out = out.where((F.size("_height") > 0) & (F.size("_width") > 0))
        out = out.withColumns({f"{n}_{d}": F.element_at(f"_{d}", i).cast("int") for d in ("height", "width") for n, i in (("lo", 1), ("hi", -1))})
        out = out.select(*keys, F.col(f"unit_{s}").alias("unit"), F.col(f"h_{s}").cast("double").alias("h"), F.col(f"w_{s}").cast("double").alias("w"), *lims)
        return near.pack(out, keys, ["lo_height", "lo_width", "unit"], spread=True)

    a, b = (tiles(x, s) for x, s in zip(_sides(cents, meta), "ab", strict=True))
    ends = {s: x.select(*keys, F.col("block").alias(s), *[f(c).alias(f"{c}_{s}") for c, f in zip(lims, (F.array_min, F.array_max) * 2, strict=True)]) for s, x in (("a", a), ("b", b))}
    meets = [F.col(f"lo_{d}_{s}") <= F.col(f"hi_{d}_{o}") for d in ("height", "width") for s, o in ("ab", "ba")]
    pairs = ends["a"].join(ends["b"], keys).where(meets[0] & meets[1] & meets[2] & meets[3]).select("a", "b")

    def kernel(met):
        for _, _, a, b in met:
            x, y = ({c: near.numbers(v[c]) for c in (*lims, "h", "w")} for v in (a, b))
            n = len(y["h"])
            step = max(1, near.AT_ONCE // n)
            for s in range(0, len(x["h"]), step):
                at = slice(s, s + step)
                hit = (x["lo_height"][at, None] <= y["hi_height"]) & (x["hi_height"][at, None] >= y["lo_height"])
                hit &= (x["lo_width"][at, None] <= y["hi_width"]) & (x["hi_width"][at, None] >= y["lo_width"])
                i, j = np.divmod(np.flatnonzero(hit), n)
                i += s
                dh, dw = x["h"][i] - y["h"][j], x["w"][i] - y["w"][j]
                yield [*[pa.repeat(a[c], len(i)) for c in keys], a["unit"].take(pa.array(i)), b["unit"].take(pa.array(j)), np.sqrt(dh * dh + dw * dw)]

    kinds = {c.name: c.dataType for c in cents.schema}
    fields = [(c, kinds["session"] if c.startswith("session_") else kinds[c]) for c in keys] + [("unit_a", kinds["unit_id"]), ("unit_b", kinds["unit_id"]), ("distance", DoubleType())]
    return near.meet(a, pairs, kernel, StructType([StructField(*f) for f in fields]), b)


def cartesian(*sides: DataFrame) -> DataFrame:
    """All combinations of small label lists: the call's own product, not a join of data."""
    out = sides[0]
    for s in sides[1:]:
        out = out.crossJoin(s)
    return out


def mutual_nearest(dist: DataFrame, meta: list[str] | None = None) -> DataFrame:
    """The pairs in which each unit is the other's nearest among its pair of sessions; ties go to the smaller unit."""
    keys = [*(meta or []), "session_a", "session_b"]
    left = dist.groupBy(*keys, "unit_a").agg(F.min(F.struct("distance", "unit_b")).alias("l"))
    right = dist.groupBy(*keys, "unit_b").agg(F.min(F.struct("distance", "unit_a")).alias("r"))
    l2 = left.select(*keys, "unit_a", F.col("l.unit_b").alias("unit_b"), F.col("l.distance").alias("distance"))
    r2 = right.select(*keys, F.col("r.unit_a").alias("unit_a"), "unit_b")
    return l2.join(r2, [*keys, "unit_a", "unit_b"]).select(*keys, "unit_a", "unit_b", "distance")


def mutual_pairs(cents: DataFrame, radius: float, meta: list[str] | None = None) -> DataFrame:
    """mutual_nearest of pair_distance; a session's units are unique. Each unit's nearest in each other session is found where blocks meet, so no table of pairs is made."""
    meta = meta or []
    rows = cents.select(*meta, "session", "unit_id", *[F.col(c).cast("double").alias(c) for c in ("height", "width")]).dropna(subset=["session", "unit_id"])
    blocks = near.pack(near.grid(rows, radius), [*meta, "ch", "cw"], ["session", "unit_id"])
    kinds = {c.name: c.dataType for c in cents.schema}

    def kernel(met):
        for _, run in groupby(met, key=lambda m: m[0]):
            best: dict = {}
            for _, _, a, b in run:
                ah, aw, bh, bw = (near.numbers(x[c]) for x in (a, b) for c in ("height", "width"))
                sb, ub, rows = near.numbers(b["session"]), near.numbers(b["unit_id"]), np.arange(len(ah))
                cuts = [0, *(np.flatnonzero(sb[1:] != sb[:-1]) + 1).tolist(), len(sb)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    other = b["session"][lo].as_py()
                    if other not in best:
                        best[other] = np.full(len(ah), np.inf), np.full(len(ah), ub[lo], ub.dtype)
                    least, unit = best[other]
                    step = max(1, near.AT_ONCE // (hi - lo))
                    for s in range(0, len(ah), step):
                        d, w = ah[s : s + step, None] - bh[lo:hi], aw[s : s + step, None] - bw[lo:hi]
                        d *= d
                        w *= w
                        d += w
                        np.sqrt(d, out=d)
                        k = d.argmin(1)  # the first: units are in order
                        d, u, at = d[rows[: len(k)], k], ub[lo + k], slice(s, s + step)
                        on = (d < least[at]) | ((d == least[at]) & (u < unit[at]))
                        least[at], unit[at] = np.where(on, d, least[at]), np.where(on, u, unit[at])
            sa = near.numbers(a["session"])
            for other, (least, unit) in best.items():
                on = np.flatnonzero((least < radius) & (sa != other))
                at = pa.array(on)
                yield [*[pa.repeat(a[c], len(on)) for c in meta], a["session"].take(at), a["unit_id"].take(at), pa.array([other] * len(on), a["session"].type), pa.array(unit[on], a["unit_id"].type), least[on]]

    fields = [*[(c, kinds[c]) for c in meta], ("session", kinds["session"]), ("unit_id", kinds["unit_id"]), ("other", kinds["session"]), ("unit", kinds["unit_id"]), ("distance", DoubleType())]
    found = near.meet(blocks, near.neighbours(blocks, meta, both=True), kernel, StructType([StructField(*f) for f in fields]), whole=True)
    first = F.col("session") < F.col("other")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    sides = found.select(*meta, pick("session", "other").alias("session_a"), pick("unit_id", "unit").alias("unit_a"), pick("other", "session").alias("session_b"), pick("unit", "unit_id").alias("unit_b"), "distance", first.alias("_first"))
    keys = [*meta, "session_a", "session_b", "unit_a", "unit_b"]
    both = sides.groupBy(*keys).agg(F.max("distance").alias("distance"), F.count_if("_first").alias("_l"), F.count_if(~F.col("_first")).alias("_r"))
    return both.where("_l > 0 AND _r > 0").select(*keys, "distance")


def group_sessions(mapping: DataFrame, by: list[str]) -> DataFrame:
    """(by, group): the sorted sessions of each mapping."""
    return mapping.groupBy(*by).agg(F.array_sort(F.collect_set("session")).alias("group"))


def resolve_mapping(pairs: DataFrame, mode: str = "majority", meta: list[str] | None = None) -> DataFrame:
    """Long mappings (meta, mapping_id, session, unit_id) of a pair table, without conflicts.

    Components of the pairs' graph may hold several units of a session. strict drops all of these; majority keeps
    the one of the highest degree if it is the only such. Pairs of dropped units go, and what is left maps by components.
    """
    if mode not in ("majority", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    meta = meta or []
    node = lambda s: F.struct(*meta, F.col(f"session_{s}").alias("session"), F.col(f"unit_{s}").alias("unit_id"))
    _checkpoints(pairs.sparkSession)
    edges = pairs.select(node("a").alias("src"), node("b").alias("dst")).checkpoint()  # read by each step below
    labels = connected_components(edges)
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("deg"))
    n = labels.join(degree, "node").withColumn("session", F.col("node.session"))
    rival = n.groupBy("label", "session").agg(F.count("*").alias("n"), F.max("deg").alias("top"))
    n = n.join(rival, ["label", "session"])
    tops = n.where("deg = top").groupBy("label", "session").agg(F.count("*").alias("n_top"))
    n = n.join(tops, ["label", "session"])
    lost = F.col("n") > 1
    if mode == "majority":
        lost = lost & ~((F.col("deg") == F.col("top")) & (F.col("n_top") == 1))
    gone = n.where(lost).select("node").checkpoint()
    left = edges.join(gone, edges.src == gone.node, "left_anti")
    left = left.join(gone, left.dst == gone.node, "left_anti")
    out = connected_components(left)
    first = out.select("label").distinct()
    ids = first.withColumn("mapping_id", F.xxhash64("label"))
    return out.join(ids, "label").select(*[F.col(f"node.{m}").alias(m) for m in meta], "mapping_id", F.col("node.session").alias("session"), F.col("node.unit_id").alias("unit_id"))


def fill_mapping(mapping: DataFrame, cents: DataFrame, meta: list[str] | None = None) -> DataFrame:
    """mapping with every unit of cents that it lacks, as a mapping of its own."""
    meta = meta or []
    keys = [*meta, "session", "unit_id"]
    alone = cents.select(*keys).join(mapping, keys, "left_anti").withColumn("mapping_id", F.xxhash64(*keys, F.lit("alone")))
    return mapping.select(*meta, "mapping_id", "session", "unit_id").unionByName(alone)


def pivot_mapping(mapping: DataFrame, sessions: list, meta: list[str] | None = None) -> DataFrame:
    """A column of unit ids for each session."""
    return mapping.groupBy(*(meta or []), "mapping_id").pivot("session", sessions).agg(F.first("unit_id"))


def mapping_counts(mapping: DataFrame, meta: list[str] | None = None) -> DataFrame:
    """(group, n): mappings by the sessions they hold."""
    return group_sessions(mapping, [*(meta or []), "mapping_id"]).groupBy("group").agg(F.count("*").alias("n"))


def nn_order(cents: DataFrame, by: list[str]) -> DataFrame:
    """cents with nn: the place on a greedy nearest-neighbour walk inside each group (sequential: a group's units are one task)."""
    from ..functions.stats import nearest_walk

    def walk(pdf):
        pdf = pdf.sort_values("unit_id").copy()
        pdf["nn"] = nearest_walk(pdf[["height", "width"]].to_numpy())
        return pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cents.schema)
    return cents.groupBy(*by).applyInPandas(walk, f"{kinds}, nn long")


def overlay_counts(mapping: DataFrame, a: DataFrame) -> DataFrame:
    """(session, height, width, matched, unmatched): units over each pixel whose mapping has other sessions, or none."""
    w = W.partitionBy("mapping_id")
    m = mapping.withColumn("_n", F.count("*").over(w)).select("session", "unit_id", (F.col("_n") > 1).alias("m"))
    j = a.join(m, ["session", "unit_id"])
    return j.groupBy("session", "height", "width").agg(F.count_if("m").alias("matched"), F.count_if(~F.col("m")).alias("unmatched"))


def unit_groups(order: DataFrame, size: int = 5) -> DataFrame:
    """Groups of consecutive units of an ordering nn."""
    return order.withColumn("unit_group", F.floor(F.col("nn") / size))


def apply_unit_labels(c: DataFrame, labels: DataFrame) -> DataFrame:
    """Manual curation: units of the same label become their mean, label -1 goes."""
    return c.join(labels.where("unit_label != -1"), "unit_id").groupBy(F.col("unit_label").alias("unit_id"), "frame").agg(F.avg("value").alias("value"))
