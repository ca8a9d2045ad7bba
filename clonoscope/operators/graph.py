"""Similarity graphs inside repertoires."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.sources import graph_cache
from clonoscope.sources.store import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit_vectors(x: Column) -> Column:
    """Vectors of length 1; the length is taken once a vector."""
    return F.get(F.transform(F.array(F.sqrt(dot(x, x))), lambda norm: F.transform(x, lambda v: v / norm)), F.lit(0))


#: Nodes of a block; two blocks' distances are one matrix product.
BLOCK = 1024


#: Nodes of repertoires of one block that one call holds, about.
PACK = 4096


def packed(nodes: DataFrame, *tables: DataFrame, block: int = BLOCK, pack: int = PACK) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The tables' rows of repertoires of one block, with the `pack` that holds some of these whole, and their rows of
    larger repertoires, or None where there are none."""
    sizes = stored(nodes.where("repertoire_id is not null").groupBy("repertoire_id").agg(F.count("*").alias("n_")))
    few = F.col("n_") <= block
    held, larger = sizes.agg(F.coalesce(F.sum(F.when(few, F.col("n_"))), F.lit(0)), F.count_if(~few)).first()
    key = F.pmod(F.xxhash64("repertoire_id"), F.lit(max(1, -(-held // pack)))).cast("int").alias("pack")
    if not larger:
        return [t.where("repertoire_id is not null").select(*t.columns, key) for t in tables], None
    sized = [t.join(sizes, "repertoire_id") for t in tables]
    return [t.where(few).select(*own.columns, key) for t, own in zip(sized, tables, strict=True)], [t.where(~few).select(*own.columns) for t, own in zip(sized, tables, strict=True)]


def _whole(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def coded(nodes: pa.Table, links: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of a pack, repertoire by repertoire; where each repertoire begins, and the end; and the links' ends as
    places among the nodes."""
    codes = lambda *parts: pa.concat_arrays(parts).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, m = nodes.num_rows, links.num_rows
    reps = codes(_whole(nodes, "repertoire_id"), _whole(links, "repertoire_id"))
    ids = codes(_whole(nodes, "node_id"), _whole(links, "src"), _whole(links, "dst"))
    width = int(ids.max(initial=0)) + 1
    keys = reps[:n] * width + ids[:n]
    order = np.argsort(keys, kind="stable")
    keys, reps_of = keys[order], reps[:n][order]
    begins = np.append(np.flatnonzero(np.diff(reps_of, prepend=-1)), n)
    ends = [reps[n:] * width + ids[n : n + m], reps[n:] * width + ids[n + m :]]
    places = [np.minimum(np.searchsorted(keys, e), max(n - 1, 0)) for e in ends]
    known = (keys[places[0]] == ends[0]) & (keys[places[1]] == ends[1]) if n else np.zeros(m, dtype=bool)
    return nodes.take(pa.array(order)), begins, places[0][known], places[1][known]


def vectors(rows: pa.Table, name: str = "x") -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    return _whole(rows, name).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.empty((0, 0))


def _first(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its first k columns by distance and place: all up to the k-th distance, ties included, and of those
    the first k."""
    least = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
    at, to = np.nonzero((d <= least) & np.isfinite(d))
    order = np.lexsort((to, d[at, to], at))
    at, to = at[order], to[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[kept], to[kept]


def _nearest_whole(k: int, metric: str) -> Callable[[pa.Table], pa.Table]:
    """The k nearest of each node of a pack of repertoires, each compared with itself, with their ranks."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("repertoire_id", "ascending"), ("node_id", "ascending")])
        reps, ids, x = (_whole(rows, c) for c in ("repertoire_id", "node_id", "x"))
        begins = np.append(np.flatnonzero(np.diff(reps.dictionary_encode().indices.to_numpy(zero_copy_only=False), prepend=-1)), rows.num_rows)
        names = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        values, cuts = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
        found = []
        for b, e in zip(begins, begins[1:], strict=False):
            a = values[cuts[b] : cuts[e]].reshape(e - b, -1)
            d = 1 - a @ a.copy().T if metric == "cosine" else np.sqrt(np.stack([((a - v) ** 2).sum(axis=1) for v in a]))
            d = np.round(d, 6)
            d[names[b:e, None] == names[None, b:e]] = np.inf
            at, to = _first(d, k)
            found.append((at + b, to + b, d[at, to], np.arange(len(at)) - np.searchsorted(at, at) + 1))
        at, to, distance, rank = (np.concatenate([f[i] for f in found]) for i in range(4))
        return pa.table({"repertoire_id": reps.take(pa.array(at)), "src": ids.take(pa.array(at)), "dst": ids.take(pa.array(to)), "distance": distance, "rank": pa.array(rank, pa.int32())})

    return run


def _nearest(k: int, metric: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The k nearest of one block for each node of another."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        src, dst = rows[rows["asks"]].sort_values("node_id"), rows[~rows["asks"]].sort_values("node_id")
        if not len(src) or not len(dst):
            return pd.DataFrame({"repertoire_id": rows["repertoire_id"][:0], "src": rows["node_id"][:0], "dst": rows["node_id"][:0], "distance": np.empty(0)})
        a, b = np.stack(src["x"].to_numpy()), np.stack(dst["x"].to_numpy())
        if metric == "cosine":
            d = 1 - a @ b.T
        else:
            d = np.sqrt(np.stack([((b - v) ** 2).sum(axis=1) for v in a]))
        d = np.round(d, 6)
        i, j = src["node_id"].to_numpy(), dst["node_id"].to_numpy()
        d[i[:, None] == j[None, :]] = np.inf
        at, to = _first(d, k)
        return pd.DataFrame({"repertoire_id": rows["repertoire_id"].iloc[0], "src": i[at], "dst": j[to], "distance": d[at, to]})

    return run


def knn(nodes: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """The k nearest other nodes of each node inside its repertoire, exact, with rank and distance (cosine or l2, to
    six places; ties by node).

    Repertoires of one block are compared by packs. A larger one's nodes are dealt into blocks of about `block`, and each
    pair of blocks is one task's matrix product, of which the k nearest are kept; so a node brings k rows for each block,
    and a task never holds a whole large repertoire."""
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    unit = nodes.select("repertoire_id", "node_id", (unit_vectors(F.col("x")) if metric == "cosine" else F.col("x")).cast("array<double>").alias("x"))
    kinds = dict(nodes.dtypes)
    schema = f"repertoire_id {kinds['repertoire_id']}, src {kinds['node_id']}, dst {kinds['node_id']}, distance double"
    (whole,), larger = packed(nodes, unit, block=block)
    near = whole.groupBy("pack").applyInArrow(_nearest_whole(k, metric), f"{schema}, rank int")
    if not larger:
        return near
    unit = larger[0]
    sizes = unit.groupBy("repertoire_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int")
    dealt = unit.join(sizes, "repertoire_id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("asks"), F.col("own").alias("i"), F.col("other").alias("j")), F.struct(F.lit(False).alias("asks"), F.col("other").alias("i"), F.col("own").alias("j"))))
    both = dealt.select("repertoire_id", "node_id", "x", sides.alias("s")).select("repertoire_id", "node_id", "x", "s.asks", "s.i", "s.j")
    far = both.groupBy("repertoire_id", "i", "j").applyInPandas(_nearest(k, metric), schema)
    return near.unionByName(far.withColumn("rank", F.row_number().over(Window.partitionBy("repertoire_id", "src").orderBy("distance", "dst"))).where(F.col("rank") <= k))


#: Nodes of a cell of the pruned search, about.
CELL = 256
#: Blocks of a repertoire, about, from which on the pruned search takes larger ones.
BLOCKS = 8


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((b - v) ** 2).sum(axis=1)) for v in a]) if len(a) else np.empty((0, len(b)))


def _vectors(rows: pd.DataFrame, column: str = "x") -> np.ndarray:
    return np.stack(rows[column].to_numpy()) if len(rows) else np.empty((0, 0))


def _to_pivots(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """The nearest pivot of each node of a block; its cell."""
    pivots = pivots.sort_values("pivot", ignore_index=True)
    d = _apart(_vectors(rows), _vectors(pivots, "px"))
    at = d.argmin(axis=1) if len(d) else np.empty(0, dtype=int)
    return rows.assign(cell=pivots["pivot"].to_numpy()[at], away=np.take_along_axis(d, at[:, None], axis=1).ravel())


def _bound(k: int, metric: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """How far from a node its k nearest are at most, by those of its own part; never less after rounding."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(rows)
        reach = np.full(len(rows), np.inf)
        if len(rows) > k:
            d = _apart(x, x)
            np.fill_diagonal(d, np.inf)
            reach = np.partition(d, k - 1, axis=1)[:, k - 1]
            reach = np.sqrt(reach**2 + 4e-6) if metric == "cosine" else reach + 2e-6
        return rows.assign(reach=reach * (1 + 1e-9))

    return run


def _to_parts(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """The parts that may hold one of a node's nearest, by the triangle inequality from their pivots."""
    i, j = np.nonzero(_apart(_vectors(rows), _vectors(parts, "px")) - parts["radius"].to_numpy() <= rows["reach"].to_numpy()[:, None])
    out = rows.iloc[i][["repertoire_id", "node_id", "x", "cell", "part"]].reset_index(drop=True)
    return out.assign(other_cell=parts["pivot"].to_numpy()[j], other_part=parts["other_part"].to_numpy()[j])


def pruned(nodes: DataFrame, k: int, metric: str = "cosine", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """What the pruned search compares: nodes that ask (asks) and nodes of the parts they ask, by both parts.

    Some nodes are pivots and a node belongs to the cell of its nearest one; cells are cut into parts of about
    `block`. Both sizes grow with a repertoire of more than BLOCKS blocks, up to blocks of BLOCK nodes, as a node's vector
    goes to every part that it asks. A node's own part bounds how far its k nearest can be, and a part whose pivot is farther than that and
    the part's radius holds none of them. Blocks of nodes are compared with pivots, never a repertoire with itself."""
    kinds = dict(nodes.dtypes)
    unit = nodes.select("repertoire_id", "node_id", (unit_vectors(F.col("x")) if metric == "cosine" else F.col("x")).cast("array<double>").alias("x"))
    scale = F.least(F.greatest(F.floor(F.count("*") / (BLOCKS * block)), F.lit(1)), F.lit(max(BLOCK // block, 1))).cast("int")
    sizes = stored(nodes.groupBy("repertoire_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("node_id")).alias("least"), scale.alias("scale")))
    hashed = F.xxhash64("node_id")
    sized = stored(unit.join(sizes, "repertoire_id").withColumn("block", F.pmod(F.xxhash64("node_id", F.lit(1)), F.ceil(F.col("n") / (block * F.col("scale")))).cast("int")))
    # the other side of a cogroup has names of its own
    pivots = sized.where((F.pmod(hashed, cell * F.col("scale")) == 0) | (hashed == F.col("least"))).select(F.col("repertoire_id").alias("r"), F.col("node_id").alias("pivot"), F.col("x").alias("px"))
    blocks = sized.select(F.col("repertoire_id").alias("r"), F.col("block").alias("b")).distinct()
    rows = sized.select("repertoire_id", "node_id", "x", "block")
    schema = f"repertoire_id {kinds['repertoire_id']}, node_id {kinds['node_id']}, x array<double>, block int"
    near = rows.groupBy("repertoire_id", "block").cogroup(pivots.join(blocks, "r").groupBy("r", "b")).applyInPandas(_to_pivots, f"{schema}, cell {kinds['node_id']}, away double")
    near = stored(near)
    held = near.groupBy("repertoire_id", "cell").agg(F.count("*").alias("held")).join(sizes, "repertoire_id").select("repertoire_id", "cell", F.ceil(F.col("held") / (block * F.col("scale"))).alias("parts"))
    dealt = near.join(held, ["repertoire_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("node_id", F.lit(2)), F.col("parts")).cast("int")).drop("parts")
    schema = f"{schema}, cell {kinds['node_id']}, away double, part int"
    bounded = stored(dealt.select(*[c.split()[0] for c in schema.split(", ")]).groupBy("repertoire_id", "cell", "part").applyInPandas(_bound(k, metric), f"{schema}, reach double"))
    parts = bounded.groupBy(F.col("repertoire_id").alias("r"), F.col("cell").alias("pivot"), F.col("part").alias("other_part")).agg(F.max("away").alias("radius"))
    told = parts.join(pivots, ["r", "pivot"]).join(blocks, "r")
    schema = f"repertoire_id {kinds['repertoire_id']}, node_id {kinds['node_id']}, x array<double>, cell {kinds['node_id']}, part int, other_cell {kinds['node_id']}, other_part int"
    asks = stored(bounded.groupBy("repertoire_id", "block").cogroup(told.groupBy("r", "b")).applyInPandas(_to_parts, schema))
    met = asks.select("repertoire_id", "cell", "part", "other_cell", "other_part").distinct()
    members = bounded.select("repertoire_id", "node_id", "x", F.col("cell").alias("other_cell"), F.col("part").alias("other_part")).join(met, ["repertoire_id", "other_cell", "other_part"])
    return asks.withColumn("asks", F.lit(True)).unionByName(members.withColumn("asks", F.lit(False)))


def knn_pruned(nodes: DataFrame, k: int, metric: str = "cosine", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """The rows of knn(), exact, with only those parts of a repertoire compared that can hold a nearest node."""
    kinds = dict(nodes.dtypes)
    schema = f"repertoire_id {kinds['repertoire_id']}, src {kinds['node_id']}, dst {kinds['node_id']}, distance double"
    near = pruned(nodes, k, metric, cell, block).groupBy("repertoire_id", "cell", "part", "other_cell", "other_part").applyInPandas(_nearest(k, metric), schema)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("repertoire_id", "src").orderBy("distance", "dst"))).where(F.col("rank") <= k)


def edges(neighbours: DataFrame) -> DataFrame:
    """Both directions of each neighbour pair, mutual neighbours twice; weight 1 / (1 + distance)."""
    w = (1 / (1 + F.col("distance"))).alias("weight")
    return neighbours.select("repertoire_id", "src", "dst", w).unionByName(neighbours.select("repertoire_id", F.col("dst").alias("src"), F.col("src").alias("dst"), w))


def degrees(nodes: DataFrame, links: DataFrame, halved: bool = False) -> DataFrame:
    """Multigraph degree and its share of the n - 1 others. `halved` counts an edge once for both of its ends, as for
    graphs of one neighbour or very many nodes."""
    n = nodes.groupBy("repertoire_id").agg(F.count("*").alias("n"))
    deg = links.groupBy("repertoire_id", F.col("src").alias("node_id")).agg((F.count("*") / 2 if halved else F.count("*")).alias("deg"))
    all_ = nodes.select("repertoire_id", "node_id").join(deg, ["repertoire_id", "node_id"], "left").na.fill(0, ["deg"])
    return all_.join(n, "repertoire_id").select("repertoire_id", "node_id", "deg", (F.col("deg") / F.greatest(F.col("n") - 1, F.lit(1))).alias("degree_centrality"))


def neighbour_density(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Mean degree of a node's neighbours over the n - 1 others."""
    deg = degrees(nodes, links)
    n = nodes.groupBy("repertoire_id").agg(F.count("*").alias("n"))
    other = deg.select("repertoire_id", F.col("node_id").alias("dst"), "deg")
    mean = links.join(other, ["repertoire_id", "dst"]).groupBy("repertoire_id", F.col("src").alias("node_id")).agg(F.avg("deg").alias("m"))
    return deg.join(mean, ["repertoire_id", "node_id"], "left").join(n, "repertoire_id").select("repertoire_id", "node_id", (F.coalesce("m", F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("density"))


def wedges(links: DataFrame) -> DataFrame:
    """Two edges from one node, (repertoire_id, x, y, z, m1, m2), each edge led from its end with fewer neighbours to the
    one with more (equals by node) and y before z: no node leads more than sqrt(2 E) edges, hubs fewest, so that there
    are at most E sqrt(2 E) of them. `links` has each edge both ways; parallel edges are counted in m."""
    a = links.where("src <> dst").groupBy("repertoire_id", "src", "dst").agg(F.count("*").alias("m"))
    deg = a.groupBy("repertoire_id", "src").agg(F.count("*").alias("d"))
    other = deg.select("repertoire_id", F.col("src").alias("dst"), F.col("d").alias("d2"))
    led = a.join(deg, ["repertoire_id", "src"]).join(other, ["repertoire_id", "dst"]).where(F.struct("d", "src") < F.struct(F.col("d2"), F.col("dst")))
    one = led.select("repertoire_id", F.col("src").alias("x"), F.col("dst").alias("y"), F.col("d2").alias("dy"), F.col("m").alias("m1"))
    two = led.select("repertoire_id", F.col("src").alias("x"), F.col("dst").alias("z"), F.col("d2").alias("dz"), F.col("m").alias("m2"))
    return one.join(two, ["repertoire_id", "x"]).where(F.struct(F.col("dy"), F.col("y")) < F.struct(F.col("dz"), F.col("z"))).select("repertoire_id", "x", "y", "z", "m1", "m2")


def triangles(links: DataFrame) -> DataFrame:
    """(repertoire_id, node_id, triangles) of nodes in triangles; multiplicities of their edges multiply."""
    closing = links.groupBy("repertoire_id", F.col("src").alias("y"), F.col("dst").alias("z")).agg(F.count("*").alias("m3"))
    each = wedges(links).join(closing, ["repertoire_id", "y", "z"]).withColumn("m", F.col("m1") * F.col("m2") * F.col("m3"))
    return each.select("repertoire_id", F.explode(F.array("x", "y", "z")).alias("node_id"), "m").groupBy("repertoire_id", "node_id").agg(F.sum("m").alias("triangles"))


def clustering(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """A node's triangles over d (d - 1) / 2 pairs of its edges; multiplicities multiply."""
    deg = degrees(nodes, links).join(triangles(links), ["repertoire_id", "node_id"], "left")
    pairs = F.col("deg") * (F.col("deg") - 1) / 2
    return deg.select("repertoire_id", "node_id", F.when(F.col("deg") > 1, F.coalesce("triangles", F.lit(0)) / F.nullif(pairs, F.lit(0))).otherwise(0.0).alias("clustering"))


def mean_pool(nodes: DataFrame) -> DataFrame:
    """The mean of each dimension over a repertoire's nodes."""
    return nodes.select("repertoire_id", F.posexplode("x").alias("dim", "v")).groupBy("repertoire_id", "dim").agg(F.avg("v").alias("mean"))


def propagated(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One step of message passing: the mean of a node's own and its neighbours' vectors, long by dimension."""
    sent = links.join(nodes.select("repertoire_id", F.col("node_id").alias("dst"), "x"), ["repertoire_id", "dst"]).select("repertoire_id", F.col("src").alias("node_id"), "x")
    every = sent.unionByName(nodes.select("repertoire_id", "node_id", "x"))
    return every.select("repertoire_id", "node_id", F.posexplode("x").alias("dim", "v")).groupBy("repertoire_id", "node_id", "dim").agg(F.avg("v").alias("mean"))


def convolved(nodes: DataFrame, links: DataFrame, how: str = "gcn") -> DataFrame:
    """One step of message passing, long by dimension, with each node its own neighbour too: `gcn` weighs a neighbour
    by 1 / sqrt(d d'), d being degrees with the node itself; `sum` adds; `mean` divides by d; `max` takes the largest."""
    loops = nodes.select("repertoire_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    whole = links.select("repertoire_id", "src", "dst").unionByName(loops)
    deg = whole.groupBy("repertoire_id", "src").agg(F.count("*").alias("d"))
    vectors = nodes.select("repertoire_id", F.col("node_id").alias("dst"), "x").join(deg.select("repertoire_id", F.col("src").alias("dst"), F.col("d").alias("d2")), ["repertoire_id", "dst"])
    sent = whole.join(vectors, ["repertoire_id", "dst"]).join(deg, ["repertoire_id", "src"])
    parts = sent.select("repertoire_id", F.col("src").alias("node_id"), "d", "d2", F.posexplode("x").alias("dim", "v"))
    value = {"gcn": F.sum(F.col("v") / F.sqrt(F.col("d") * F.col("d2"))), "sum": F.sum("v"), "mean": F.avg("v"), "max": F.max("v")}[how]
    return parts.groupBy("repertoire_id", "node_id", "dim").agg(value.alias("value"))


#: Neighbours of a node that one part of its attention holds.
HUB = 1024


def attended(nodes: DataFrame, links: DataFrame, own: list[float], other: list[float], slope: float = 0.2, hub: int = HUB) -> DataFrame:
    """One head of graph attention: a node's new vector is the mean of its neighbours' and its own, weighed by the softmax
    over them of leaky(own . x_i + other . x_j), parallel edges counting each.

    A node with many neighbours is dealt into parts of about `hub`; each part has its own maximum, sum and weighed
    vectors, which are brought to the node's maximum and added, so that exponents never overflow and no task holds a hub."""
    loops = nodes.select("repertoire_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    whole = links.select("repertoire_id", "src", "dst").unionByName(loops).groupBy("repertoire_id", "src", "dst").agg(F.count("*").alias("m"))
    score = lambda v: dot(F.col("x"), F.array(*map(F.lit, v)))
    parts = whole.groupBy("repertoire_id", "src").agg(F.ceil(F.count("*") / hub).alias("parts"))
    asks = nodes.select("repertoire_id", F.col("node_id").alias("src"), score(own).alias("s")).join(parts, ["repertoire_id", "src"])
    told = nodes.select("repertoire_id", F.col("node_id").alias("dst"), "x", score(other).alias("t"))
    met = whole.join(asks, ["repertoire_id", "src"]).join(told, ["repertoire_id", "dst"])
    raw = F.col("s") + F.col("t")
    met = met.select("repertoire_id", "src", "m", "x", F.when(raw > 0, raw).otherwise(slope * raw).alias("e"), F.pmod(F.xxhash64("dst"), F.col("parts")).alias("part"))
    met = met.withColumn("top", F.max("e").over(Window.partitionBy("repertoire_id", "src", "part")))
    # dimension 0 is the sum of weights
    long = met.select("repertoire_id", "src", "part", "top", (F.col("m") * F.exp(F.col("e") - F.col("top"))).alias("w"), F.posexplode(F.concat(F.array(F.lit(1.0)), "x")).alias("dim", "v"))
    some = long.groupBy("repertoire_id", "src", "dim", "part").agg(F.first("top").alias("top"), F.sum(F.col("w") * F.col("v")).alias("v"))
    most = F.max("top").over(Window.partitionBy("repertoire_id", "src", "dim"))
    summed = some.withColumn("v", F.col("v") * F.exp(F.col("top") - most)).groupBy("repertoire_id", F.col("src").alias("node_id"), "dim").agg(F.sum("v").alias("v"))
    x = as_nodes(summed, "v")
    return x.select("repertoire_id", "node_id", F.transform(F.slice("x", F.lit(2), F.size("x") - 1), lambda v: v / F.get("x", F.lit(0))).alias("x"))


def dense(x: Column, weights: list[list[float]], bias: list[float], relu: bool = False) -> Column:
    """A vector through one layer: `weights` has a list of inputs for each output."""
    out = F.zip_with(F.transform(F.array(*[F.array(*map(F.lit, w)) for w in weights]), lambda w: dot(x, w)), F.array(*map(F.lit, bias)), lambda a, b: a + b)
    return F.transform(out, lambda v: F.greatest(v, F.lit(0.0))) if relu else out


def isomorphic(nodes: DataFrame, links: DataFrame, eps: float, inner: tuple[list[list[float]], list[float]], outer: tuple[list[list[float]], list[float]]) -> DataFrame:
    """One step of a graph isomorphism network: (1 + eps) times a node's vector plus its neighbours', through two layers."""
    sums = as_nodes(convolved(nodes, links, "sum")).select("repertoire_id", "node_id", F.col("x").alias("sum"))
    both = sums.join(nodes.select("repertoire_id", "node_id", "x"), ["repertoire_id", "node_id"])
    mixed = F.zip_with("sum", "x", lambda a, b: a + eps * b)
    return both.select("repertoire_id", "node_id", dense(dense(mixed, *inner, relu=True), *outer).alias("x"))


def as_nodes(long: DataFrame, value: str = "value") -> DataFrame:
    """Long dimensions as vectors again."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", value)))
    return long.groupBy("repertoire_id", "node_id").agg(F.transform(ordered, lambda d: d[value]).alias("x"))


def node_features(nodes: DataFrame, links: DataFrame, clustering_below: int = 10, k: int = 30, block: int = BLOCK) -> DataFrame:
    """Per node one vector: share of its repertoire's rows, length, shares of the 20 amino acids, centralities (degree,
    two constants 0 that stand for eigenvector and page rank, clustering, which is 0 from `clustering_below` neighbours
    on), neighbour density and its embedding. `nodes` has junction_aa, cnt and x."""
    tight = k < clustering_below
    wanted = nodes.select("repertoire_id", "node_id", "junction_aa", "cnt", F.col("x").cast("array<double>").alias("x"))
    (own, ends), larger = packed(nodes, wanted, links.select("repertoire_id", "src", "dst"), block=block)
    schema = ", ".join(f"{c} {kind}" for c, kind in wanted.dtypes) + ", total long, degree_centrality double, density double, clustering double"
    whole = own.groupBy("pack").cogroup(ends.groupBy("pack")).applyInArrow(_central(tight), schema)
    if larger:
        nodes, links = larger
        deg = degrees(nodes, links).select("repertoire_id", "node_id", "degree_centrality")
        far = nodes.withColumn("total", F.sum("cnt").over(Window.partitionBy("repertoire_id"))).join(deg, ["repertoire_id", "node_id"]).join(neighbour_density(nodes, links), ["repertoire_id", "node_id"])
        far = far.join(clustering(nodes, links), ["repertoire_id", "node_id"]) if tight else far.withColumn("clustering", F.lit(0.0))
        whole = whole.unionByName(far.select(*whole.columns))
    s = F.col("junction_aa")
    base = F.array((F.col("cnt") / F.col("total")).cast("double"), F.length(s).cast("double"))
    letters = F.transform(S.letter_counts(s), lambda c: c / F.greatest(F.length(s), F.lit(1)))
    centrality = F.array("degree_centrality", F.lit(0.0), F.lit(0.0), "clustering")
    return whole.select("repertoire_id", "node_id", F.concat(base, letters, centrality, F.array("density"), "x").alias("x"))


def _central(tight: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What degrees(), neighbour_density() and, if asked, clustering() find, for the nodes of a pack, and the rows of
    each node's repertoire."""

    def run(nodes: pa.Table, links: pa.Table) -> pa.Table:
        nodes, begins, s, d = coded(nodes, links)
        n, sizes = nodes.num_rows, np.diff(begins)
        others = np.repeat(np.maximum(sizes - 1, 1), sizes)
        deg = np.bincount(s, minlength=n).astype(float)
        mean = np.bincount(s, weights=deg[d], minlength=n) / np.maximum(deg, 1)
        closed = np.zeros(n)
        if tight:
            at = np.searchsorted(begins, s, side="right") - 1
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(len(begins)))
            for i, (b, size) in enumerate(zip(begins, sizes, strict=False)):
                own = order[cuts[i] : cuts[i + 1]]
                a = np.bincount((s[own] - b) * size + d[own] - b, minlength=size * size).reshape(size, size).astype(float)
                np.fill_diagonal(a, 0)
                closed[b : b + size] = ((a @ a) * a).sum(axis=1) / 2
            closed = np.where(deg > 1, closed / np.maximum(deg * (deg - 1) / 2, 1), 0)
        cnt = nodes.column("cnt").to_numpy()
        total = np.repeat(np.add.reduceat(cnt, begins[:-1]), sizes) if n else cnt
        rows = nodes.select([c for c in nodes.column_names if c != "pack"])
        for name, values in (("total", total), ("degree_centrality", deg / others), ("density", mean / others), ("clustering", closed)):
            rows = rows.append_column(name, pa.array(values))
        return rows

    return run


#: Distinct sequences, at most, whose embeddings are made once and broadcast.
EMBEDDED = 10_000


def sequence_nodes(rep: DataFrame, embed: Callable[[Column], Column] = S.hashed_embedding) -> DataFrame:
    """Nodes of repertoires: each distinct sequence once, with its rows and its embedding. `embed` is any function of
    a sequence column, such as a pandas UDF around a trained model."""
    seqs = stored(rep.where(F.length("junction_aa") > 0).groupBy("repertoire_id", "junction_aa").agg(F.count("*").alias("cnt")))
    each = stored(seqs.select("junction_aa").distinct())
    if each.count() <= EMBEDDED:
        seqs, x = seqs.join(F.broadcast(stored(each.select("junction_aa", embed(F.col("junction_aa")).alias("x")))), "junction_aa"), F.col("x")
    else:
        x = embed(F.col("junction_aa")).alias("x")
    return seqs.select("repertoire_id", F.col("junction_aa").alias("node_id"), "junction_aa", "cnt", x)


def built(rep: DataFrame, k: int = 30, embed: Callable[[Column], Column] = S.hashed_embedding, folders: list[str] | None = None, name: str = "hashed") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each repertoire's similarity graph; repertoires without sequences have none. With `folders`,
    graphs of the same content, k and embedder (by its name) are found there, and others added to the first. Nodes and
    neighbours are stored, as what follows reads them many times."""

    def build(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        nodes = stored(sequence_nodes(some, embed))
        return nodes, edges(stored(knn(nodes.select("repertoire_id", "node_id", "x"), k)))

    return graph_cache.graphs(rep, folders, build, f"k={k}", name) if folders else build(rep)


def pooled(nodes: DataFrame, links: DataFrame, layers: int = 2, how: str = "gcn", block: int = BLOCK) -> DataFrame:
    """Per repertoire and dimension, the mean over nodes after so many steps of message passing: what a linear graph
    convolution hands to its classifier.

    All steps but `max` are linear, so that the mean weighs each node's own vector by one number. Those numbers go
    back along the edges, step by step, and vectors never do. Repertoires of one block are pooled by packs."""
    if how == "max":
        for _ in range(layers):
            nodes = as_nodes(convolved(nodes, links, how))
        return mean_pool(nodes)
    if how not in ("gcn", "sum", "mean"):
        raise ValueError(f"unknown step: {how}")
    kinds = dict(nodes.dtypes)
    wanted = nodes.select("repertoire_id", "node_id", F.col("x").cast("array<double>").alias("x"))
    (own, ends), larger = packed(nodes, wanted, links.select("repertoire_id", "src", "dst"), block=block)
    means = own.groupBy("pack").cogroup(ends.groupBy("pack")).applyInArrow(_pooled_whole(layers, how), f"repertoire_id {kinds['repertoire_id']}, dim int, mean double")
    if not larger:
        return means
    nodes, links = larger
    loops = nodes.select("repertoire_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    whole = links.unionByName(loops)
    whole = stored(whole) if layers else whole
    d = F.col("d").cast("double")
    give, take = {"gcn": (1 / F.sqrt(d), 1 / F.sqrt(d)), "sum": (F.lit(1.0), F.lit(1.0)), "mean": (1 / d, F.lit(1.0))}[how]
    shares = whole.groupBy("repertoire_id", F.col("src").alias("node_id")).agg(F.count("*").alias("d")).select("repertoire_id", "node_id", give.alias("give"), take.alias("take"))
    weights = shares.withColumn("w", F.lit(1.0))
    for _ in range(layers):
        given = weights.select("repertoire_id", F.col("node_id").alias("src"), (F.col("w") * F.col("give")).alias("g"))
        got = whole.join(given, ["repertoire_id", "src"]).groupBy("repertoire_id", F.col("dst").alias("node_id")).agg(F.sum("g").alias("g"))
        weights = shares.join(got, ["repertoire_id", "node_id"]).select("repertoire_id", "node_id", "give", "take", (F.col("g") * F.col("take")).alias("w"))
    weighed = nodes.select("repertoire_id", "node_id", "x").join(weights.select("repertoire_id", "node_id", "w"), ["repertoire_id", "node_id"])
    long = weighed.select("repertoire_id", "w", F.posexplode("x").alias("dim", "v"))
    return means.unionByName(long.groupBy("repertoire_id", "dim").agg((F.sum(F.col("w") * F.col("v")) / F.count("*")).alias("mean")))


def _pooled_whole(layers: int, how: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """pooled() of the repertoires of a pack."""

    def run(nodes: pa.Table, links: pa.Table) -> pa.Table:
        nodes, begins, s, d = coded(nodes, links)
        n, sizes = nodes.num_rows, np.diff(begins)
        if not n:
            return pa.table({"repertoire_id": _whole(nodes, "repertoire_id"), "dim": pa.array([], pa.int32()), "mean": pa.array([], pa.float64())})
        s, d = np.append(s, np.arange(n)), np.append(d, np.arange(n))
        deg = np.bincount(s, minlength=n).astype(float)
        give, take = {"gcn": (1 / np.sqrt(deg), 1 / np.sqrt(deg)), "sum": (np.ones(n), np.ones(n)), "mean": (1 / deg, np.ones(n))}[how]
        w = np.ones(n)
        for _ in range(layers):
            w = np.bincount(d, weights=(w * give)[s], minlength=n) * take
        means = np.add.reduceat(vectors(nodes) * w[:, None], begins[:-1], axis=0) / sizes[:, None]
        reps = _whole(nodes, "repertoire_id").take(pa.array(np.repeat(begins[:-1], means.shape[1])))
        return pa.table({"repertoire_id": reps, "dim": pa.array(np.tile(np.arange(means.shape[1]), len(means)), pa.int32()), "mean": means.ravel()})

    return run
