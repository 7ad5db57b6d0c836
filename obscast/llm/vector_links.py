"""Near-duplicate vectors: int8 tile products with error bounds, full precision where they leave it open.

Equal vectors are one class. Classes are dealt into blocks by hash; a block holds each unit
vector u as whole numbers q of eight bits with a scale s and the length r of what rounding left
out, u = s q + rest. Every two blocks of one dimension meet in one task, tile by tile. Products
of the whole numbers are exact (float32 holds sums below 2 ** 24), and
    |u.v - s_u s_v q_u.q_v| <= r_u + (1 + r_u) r_v,
so a pair whose product plus bound stays below the threshold is no link. All other pairs are
recomputed in double precision from the vectors themselves. A task returns counts of links per
class and a forest that spans its links, never the pairs, so a group of near copies costs rows
in proportion to its size.

All blocks meet each other: this is the exact comparison, quadratic in different vectors. The
number of blocks follows from the memory of a task, not from the data's groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obscast.llm.components import connected_components
from obscast.llm.shared import Scratch

THRESHOLD = 0.9
#: Rows and columns of a tile; whole numbers of a product that are added exactly in float32.
TILE, EXACT = 1024, 1040
#: Vectors and bytes of a block at most, and the least number of vectors that is worth a block.
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS = 1 << 17, 64 << 20, 1 << 12
#: Blocks that the vectors are dealt into while none is too large.
BLOCKS = 6
#: More than the rounding of double and float32 arithmetic can add to a bound.
SLACK = 1e-5
#: Parts of all rows from which a class is joined by broadcast, so at most as many such classes.
HOT = 1000
#: Pairs recomputed at once.
PAIRS = 1 << 16

PACKED = (
    "dim int, block long, node array<long>, least array<long>, size array<long>, k1 array<long>, k2 array<long>, "
    "whole binary, scale binary, rest binary, raw binary"
)
FOUND = "node long, least long, n long, to_node long, to_least long"


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero throughout."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; the largest entry goes first, so that nothing overflows."""
    rows = raw.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of eight bits, scale, and the length of the rest, of each row."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(unit - scale[:, None] * whole, axis=1)
    return whole, scale, rest


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers, as float32 or, beyond its reach, float64."""
    parts = [a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T for k in range(0, a.shape[1], EXACT)]
    return parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=np.float64)


def candidates(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two tiles (whole, scale, rest) that may reach the threshold."""
    product = tile_products(a[0], b[0])
    product *= a[1].astype(np.float32)[:, None]
    widest = a[2].max()
    # First a bound of the whole tile for each column, then each pair's own.
    i, j = np.nonzero(product >= ((threshold - SLACK - widest - (1 + widest) * b[2]) / b[1]).astype(np.float32)[None, :])
    near = product[i, j] * b[1][j] + a[2][i] + (1 + a[2][i]) * b[2][j] >= threshold - SLACK
    return i[near], j[near]


def exact(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose cosine in double precision reaches the threshold."""
    if not len(i):
        return i, j
    rows, at = np.unique(i, return_inverse=True)
    columns, to = np.unique(j, return_inverse=True)
    if 4 * len(i) >= len(rows) * len(columns):  # copies: nearly all pairs of some rows and columns
        good = (a[rows] @ b[columns].T)[at, to] >= threshold
    else:
        parts = [slice(k, k + PAIRS) for k in range(0, len(i), PAIRS)]
        good = np.concatenate([np.einsum("ij,ij->i", a[i[s]], b[j[s]]) for s in parts]) >= threshold
    return i[good], j[good]


class Forest:
    """Components of the links met so far; a tile's links are reduced to pairs of roots first."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if not len(a):
                return
            # Larger roots hang under the least root that they meet, then chains are cut short.
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (short := self.root[self.root] != self.root).any():
                self.root[short] = self.root[self.root[short]]


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: its classes' labels, whole numbers, scales, rests and vectors."""
    raw = np.stack(rows["vector"].to_list())
    whole, scale, rest = quantised(units(raw))
    dim, block = int(rows["dim"].iloc[0]), int(rows["block"].iloc[0])
    node = (dim << 48) + (block << 24) + np.arange(len(rows))
    out = {"dim": dim, "block": block, "node": node} | {c: rows[c].to_numpy() for c in ("least", "size", "k1", "k2")}
    out |= {"whole": whole.tobytes(), "scale": scale.tobytes(), "rest": rest.tobytes(), "raw": raw.tobytes()}
    return pd.DataFrame([out])


def _compare(threshold: float, kind: str):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for r in group.sort_values("block").itertuples():
            n = len(r.node)
            whole = np.frombuffer(r.whole, np.int8).reshape(n, -1)
            unit = units(np.frombuffer(r.raw, kind).reshape(n, -1))
            sides.append((whole, np.frombuffer(r.scale), np.frombuffer(r.rest), unit, r))
        a, b = sides[0], sides[-1]
        own, n, m = len(sides) == 1, len(a[3]), len(b[3])
        node, least, size = (np.concatenate([getattr(s[4], c) for s in sides]) for c in ("node", "least", "size"))
        shift = 0 if own else n
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))
        for x in range(0, n, TILE):
            for y in range(x if own else 0, m, TILE):
                i, j = candidates(tuple(s[x : x + TILE] for s in a[:3]), tuple(s[y : y + TILE] for s in b[:3]), threshold)
                i, j = exact(i, j, a[3][x : x + TILE], b[3][y : y + TILE], threshold)
                i, j = i + x, j + y + shift
                if own:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    links += np.bincount(i, size[j], len(node)).astype(np.int64) + np.bincount(j, size[i], len(node)).astype(np.int64)
                    forest.add(i, j)
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": node[at], "least": least[at], "n": links[at], "to_node": node[forest.root[at]], "to_least": least[forest.root[at]]})

    return compare


def link_components(rows: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Links: pairs of rows, of vectors of one length, whose cosine is `threshold` or more.
    n_links counts a row's linked rows, component_id is the smallest id reachable; kept marks
    the rows with that id. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. Rows of equal vectors link with each other, whether their
    ids are equal or not; null ids count as larger than all others, and a component of such
    rows has a null id and keeps them. Ids are whole numbers. An empty table gives no rows;
    other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "vector-links")
    kind = "f4" if isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else "f8"
    inner = "float" if kind == "f4" else "double"
    read = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{inner}>").alias("vector"))
    # Adding zero turns a negative zero into the positive one, which it equals.
    plain = F.when(usable(F.col("vector")), F.transform("vector", lambda x: x + F.lit(0.0).cast(inner)))
    read = read.withColumn("vector", plain).withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit("second"), "vector")})
    ids = scratch.cut(read.select("vec_id", "k1", "k2", F.col("vector").isNotNull().alias("usable")))
    largest = F.lit((1 << 63) - 1)
    classes = read.where("vector is not null").groupBy("k1", "k2", "vector").agg(F.min(F.coalesce("vec_id", largest)).alias("least"), F.count("*").alias("size"))
    classes = scratch.cut(classes.withColumn("dim", F.size("vector")))
    total = classes.agg(F.count("*"), F.max("dim"), F.sum("size")).first()
    if not total[0]:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    most = max(TILE, min(BLOCK_ROWS, BLOCK_BYTES // (5 * total[1])))
    blocks = max(-(-total[0] // most), min(BLOCKS, -(-total[0] // LEAST_ROWS)))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "k1", "k2"), F.lit(blocks)))
    packed = scratch.cut(dealt.groupBy("dim", "block").applyInPandas(_pack, PACKED))

    # A block goes once to each block that it meets: groups of two rows, or one for itself.
    other = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    other = other.drop("k1", "k2").withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    found = scratch.cut(other.groupBy("dim", "first", "second").applyInPandas(_compare(threshold, kind), FOUND))

    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("node <> to_node").select(F.struct("least", "node").alias("a"), F.struct(F.col("to_least").alias("least"), F.col("to_node").alias("node")).alias("b"))
    joined = connected_components(edges, scratch).select(F.col("node.node").alias("node"), F.col("component.least").alias("component_id"))
    names = packed.select(F.inline(F.arrays_zip("node", "k1", "k2", "least", "size")))
    result = names.join(links, "node", "left").join(joined, "node", "left").select(
        "k1", "k2", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    result = scratch.cut(result)
    # Rows of the few largest classes meet them by broadcast: at most HOT classes.
    hot = F.broadcast(result.where(F.col("size") * HOT >= total[2]))
    good = ids.where("usable").drop("usable")
    wanted = ["vec_id", "n_links", "component_id"]
    linked = good.join(hot, ["k1", "k2"]).select(*wanted)
    linked = linked.unionByName(
        good.join(hot.select("k1", "k2"), ["k1", "k2"], "left_anti").join(result.where(F.col("size") * HOT < total[2]), ["k1", "k2"]).select(*wanted)
    )
    linked = linked.withColumn("component_id", F.nullif("component_id", largest))
    alone = ids.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
