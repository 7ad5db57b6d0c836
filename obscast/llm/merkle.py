"""Merkle manifest of a dataset, with persistent versions by path copying.

The leaves of a group (a language) lie in the order of doc_id. Every aligned block of 1,024
consecutive nodes is one task's work: it builds the block's levels, notes each node's siblings
and, for a tampered leaf, copies the ancestors inside the block, sharing all other nodes. Block
roots are the next round's nodes, so a round has a thousandth of the rows of the one before.
The siblings above a block are the same for all of its leaves and come back down by a join on
the block; there the versions go on copying up to the root of all groups.

Nothing is gathered by group: places in the order come from ranges and their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscast.llm.shared import Scratch

#: Levels of an aligned block, so that it has 2 ** LEVELS nodes at most.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: An entry of a path: where the sibling lies, then its 32 bytes (zeros without one).
LONE, RIGHT, LEFT, WIDTH = 0, 1, 2, 33


def parent(*nodes: bytes) -> bytes:
    """The digest of one or two nodes, whose digests count as lowercase hex."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def leaf(values: dict[str, Column] | None = None) -> Column:
    """Lowercase hex of a row's leaf; `values` stand in for columns of the same names."""

    def field(name: str) -> Column:
        value = (values or {}).get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(f) for f in FIELDS]), 256)


def siblings(levels: list[list[bytes]], place: int) -> bytes:
    """The path of a leaf through the levels of a block, from the leaf up."""
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        if other >= len(level):
            out.append(bytes(WIDTH))
        else:
            out.append(bytes([LEFT if place & 1 else RIGHT]) + level[other])
        place >>= 1
    return b"".join(out)


def copies(node: bytes, path: bytes) -> list[bytes]:
    """A version's ancestors of `node`, copied one by one up a path of shared siblings."""
    out = []
    for at in range(0, len(path), WIDTH):
        side, other = path[at], path[at + 1 : at + WIDTH]
        node = parent(node) if side == LONE else parent(other, node) if side == LEFT else parent(node, other)
        out.append(node)
    return out


def _block_builder(levels: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = [[bytes(n) for n in rows["node"]]]
        # A group of one block ends at its only node, others climb all levels of every block.
        for _ in range(min(levels, int(rows["total"].iloc[0] - 1).bit_length())):
            below = tree[-1]
            tree.append([parent(*below[k : k + 2]) for k in range(0, len(below), 2)])
        first = int(rows["pos"].iloc[0])
        paths = [siblings(tree, int(p) - first) for p in rows["pos"]]
        made = [b"".join(copies(bytes(c), p)) if c is not None else None for c, p in zip(rows["changed"], paths, strict=True)]
        return rows.assign(path=paths, top=tree[-1][0], copied=made)

    return build


def _placed(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """`rows` with pos, the place in `order` within grp from 0, and total, the rows of grp."""
    from pyspark import TaskContext

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if len(b):
                place = b.groupby("grp", sort=False).cumcount() + (b["grp"] == last) * seen
                last, seen = b["grp"].iloc[-1], int(place.iloc[-1]) + 1
                yield b.assign(part=part, place=place)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, "grp", *order).sortWithinPartitions("grp", *order)
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    laid = scratch.cut(laid.mapInPandas(number, f"{kinds}, part int, place long"))
    # As many rows as ranges and groups together.
    counts = laid.groupBy("grp", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("grp"))).drop("n")
    return laid.join(counts, ["grp", "part"]).withColumn("pos", F.col("start") + F.col("place")).drop("part", "place", "start")


def _tree(nodes: DataFrame, scratch: Scratch, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with their paths inside a block; (grp, block, above) of each block; (grp, subroot).

    nodes: grp, pos, total, node, changed and columns that are kept.
    """
    kinds = ", ".join(f"`{c}` {k}" for c, k in nodes.dtypes) + ", block long, path binary, top binary, copied binary"
    floors, tops = [], None
    while True:
        rows = nodes.withColumn("block", F.shiftright("pos", levels))
        schema = kinds if not floors else "grp string, pos long, total long, node binary, changed binary, block long, path binary, top binary, copied binary"
        floors.append(scratch.cut(rows.groupBy("grp", "block").applyInPandas(_block_builder(levels), schema)))
        roots = floors[-1].where(F.col("pos") % (1 << levels) == 0)
        size = F.ceil(F.col("total") / F.lit(1 << levels)).cast("long")
        roots = roots.select("grp", F.col("block").alias("pos"), size.alias("total"), F.col("top").alias("node"), F.lit(None).cast("binary").alias("changed"))
        ended = roots.where("total = 1").select("grp", F.col("node").alias("subroot"))
        tops = ended if tops is None else tops.unionByName(ended)
        nodes = roots.where("total > 1")
        if nodes.isEmpty():
            break
    above = floors[0].where(F.col("pos") % (1 << levels) == 0).select("grp", "block")
    paths = None
    for floor in reversed(floors[1:]):
        own = floor.select("grp", "pos", "block", "path")
        if paths is not None:
            own = own.join(paths.select("grp", F.col("pos").alias("block"), F.col("path").alias("__up")), ["grp", "block"], "left")
            own = own.withColumn("path", F.concat("path", F.coalesce("__up", F.lit(bytearray()))))
        paths = own.select("grp", "pos", "path")
    if paths is None:
        above = above.withColumn("above", F.lit(bytearray()))
    else:
        above = above.join(paths.select("grp", F.col("pos").alias("block"), F.col("path").alias("above")), ["grp", "block"], "left")
        above = above.withColumn("above", F.coalesce("above", F.lit(bytearray())))
    return floors[0], above, tops


def manifest(docs: DataFrame, tampered: Column | None = None, edits: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, lang, pos, leaf, subroot, root, proof_sha256, folded_root, verified, copied) of each row.

    docs: doc_id, source, lang, n_chars, text; other columns are not read. Rows where
    `tampered` holds have the values of `edits` in a version of their own. copied: that
    version's nodes from the leaf to the root (null for untouched rows); all others are shared.

    Ties: rows of a doc_id lie in the order of their leaves, null ids first; a null `tampered`
    leaves a row alone. Equal rows are leaves of their own. An empty table gives no rows. A
    row's text is hashed by one task, whatever its length.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    changed = F.when(tampered, F.unhex(leaf(edits))) if tampered is not None else F.lit(None).cast("binary")
    kind = dict(docs.dtypes)["doc_id"]
    # Ids travel as text: pandas would turn whole numbers with nulls among them into floats.
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), "lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), F.unhex(leaf()).alias("node"), changed.alias("changed"),
        # Sets rows apart that are equal throughout, so that many of them fill many ranges.
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = scratch.cut(rows)
    placed = _placed(rows, [F.col("doc_id").cast(kind), F.col("node"), F.col("tie")], scratch).drop("tie")
    floor, above, tops = _tree(placed, scratch, levels)
    scratch.drop(rows)

    tops = scratch.cut(tops.select(F.col("grp").alias("named"), F.col("subroot").alias("node"), F.lit(None).cast("binary").alias("changed"), F.lit("").alias("grp")))
    top_floor, top_above, ends = _tree(_placed(tops, [F.col("named")], scratch), scratch, levels)
    groups = top_floor.join(top_above, ["grp", "block"]).join(ends, "grp")
    groups = groups.select(
        F.col("named").alias("grp"), F.col("node").alias("subroot"), F.concat("path", "above").alias("outer"), F.col("subroot").alias("root")
    )
    blocks = scratch.cut(above.join(groups, "grp").select("grp", "block", F.concat("above", "outer").alias("above"), "subroot", "root"))
    joined = floor.select("grp", "block", "doc_id", "lang", "pos", "node", "changed", "path", "copied").join(blocks, ["grp", "block"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            proofs, folded, made = [], [], []
            for node, changed, path, inside, above in zip(b["node"], b["changed"], b["path"], b["copied"], b["above"], strict=True):
                whole = path + above
                others = (whole[k + 1 : k + WIDTH] for k in range(0, len(whole), WIDTH) if whole[k] != LONE)
                proofs.append(parent(*others).hex())
                if changed is None:
                    made.append(None)
                    folded.append(([node] + copies(node, whole))[-1].hex())
                    continue
                # The version that the block began goes on through the levels above it.
                version = [changed] + [inside[k : k + 32] for k in range(0, len(inside), 32)]
                version += copies(version[-1], above)
                made.append([n.hex() for n in version])
                folded.append(version[-1].hex())
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "lang": b["lang"], "pos": b["pos"], "leaf": [n.hex() for n in b["node"]], "subroot": [n.hex() for n in b["subroot"]],
                "root": [n.hex() for n in b["root"]], "proof_sha256": proofs, "folded_root": folded, "copied": made,
            })

    schema = "doc_id string, lang string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>"
    found = joined.mapInPandas(finish, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def version_nodes(rows: DataFrame) -> DataFrame:
    """(lang, pos, level, at, node): the nodes that each version of `manifest` does not share.

    at: the node's place on its level, within the group up to the subroot's level.
    """
    made = rows.where("copied is not null").select("lang", "pos", F.posexplode("copied").alias("level", "node"))
    return made.select("lang", "pos", "level", F.expr("shiftright(pos, level)").alias("at"), "node")
