"""N-gram Jaccard join with a token-group matrix, to exact components of all links.

1. Texts with equal shingle sets form one class; only classes are compared.
2. Linked sets share at least `ceil(t * n)` shingles, so their first `n - ceil(t * n) + 1 + x`
   shingles by hash share `1 + x` (`first_tokens`). Only these columns of the matrix are
   shuffled, once; a class of which fewer are shared with any other class has no link.
   Then all shingles of the classes that are left are counted: those of which other classes
   do not hold `ceil(t * n)` are out, whatever passage they share with how many (`_covered`).
3. Classes that are left are put into groups of similar ones, by the least hashes that they
   share (`_runs`). A group is stored as its members and the union of their shingles, and
   its members are held against each other.
4. Which groups a class meets in the token-group matrix is told by its rarest shared shingles
   alone (`_ranked`): the first one that a pair shares, by one order of all shingles, bounds
   the overlap by the shingles behind it, and with the least size of its holders in a group
   the likeness to any of them. Only groups whose bound suffices are opened. There the bound
   against the whole union is taken, then the overlaps with its members.
5. Step 4 runs twice: first against one central group for each class, so that a large group
   of near copies becomes one component; then against the groups that hold a larger
   component than the class's own. No pair inside a component is looked at.

Null or empty texts and texts without words have no shingles, no links and their own doc_id
as component; the smallest doc_id of equal texts stands for them; rows with a null doc_id
come out with a null doc_id and link nothing; repeated rows are rows of one class; texts are
read whole; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obscast.llm.components import connected_components
from obscast.llm.packing import slices
from obscast.llm.shared import Scratch, stored
from obscast.llm.shingle_sets import mix, shingle_sets

WIDTH, PERCENT = 3, 90
#: Shingles in a hundred by which a class's columns exceed the fewest that have to meet.
EXTRA = 10
#: Most members and shingles of a group; a larger single set is a group of its own.
GROUP_MEMBERS, GROUP_TOKENS = 256, 100_000
#: Shingles of the queries that one task holds against one group at a time.
BLOCK_TOKENS = 200_000
#: How often classes without enough columns are taken out before groups are made.
PEELS = 2
#: Holders within one slice of a task from which a column is dealt out by class.
HOT_HOLDERS = 16

_GROUP = "grp long, cids array<long>, sizes array<int>, comps array<long>, tokens array<long>, members array<int>"
_LINKS = "a long, b long"


def first_tokens(n: int, percent: int) -> int:
    """How many of a set's n shingles, by hash, are columns of the matrix."""
    return min(n, n - -(-n * percent // 100) + 1 + n * EXTRA // 100)


def least_shared(n: int, percent: int) -> int:
    """How many columns a set of n shingles shares with any set it is linked with."""
    return 1 + -(-n * percent // 100) * EXTRA // 100


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = mix(np.add.reduce(mix(tokens ^ np.uint64(11))) + np.uint64(len(tokens)))
        b = mix(np.add.reduce(mix(tokens ^ np.uint64(29))) + np.uint64(len(tokens)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _deal(columns: list[np.ndarray], least: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each class's columns that have to be counted, and those known to be shared.

    A column with many holders in the slice is shared beyond doubt; two of its holders go on
    telling others so, the rest need not meet at one place.
    """
    if not columns:
        return [], []
    values, ends = np.concatenate(columns), np.cumsum([len(c) for c in columns])[:-1]
    _, which, holders = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values)) - np.repeat(np.cumsum(holders) - holders, holders)
    hot = (holders[which] >= least) & (place >= 2)
    masks = np.split(hot, ends)
    return [c[~m] for c, m in zip(columns, masks, strict=True)], [c[m] for c, m in zip(columns, masks, strict=True)]


def shingled(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per text: doc_id, n_shingles, a 128-bit hash (node, check) of its shingle set,
    and, once for a class and task, its columns of the matrix (counted, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        none = np.zeros(0, np.uint64)
        for batch in batches:
            ids = batch.column(0)
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            for part in slices([len(t) for t in texts], 2_000_000):
                sets = shingle_sets(texts[part], width)
                hashes = [_set_hash(s) for s in sets]
                counted, hot = [none] * len(sets), [none] * len(sets)
                new = []
                for k, (s, h) in enumerate(zip(sets, hashes, strict=True)):
                    if len(s) and h not in seen:
                        seen.add(h)
                        new.append(k)
                firsts = [sets[k][: first_tokens(len(sets[k]), percent)] for k in new]
                for k, c, h in zip(new, *_deal(firsts, HOT_HOLDERS), strict=True):
                    counted[k], hot[k] = c, h
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[part], pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()),
                        _lists(counted), _lists(hot),
                    ],
                    ["doc_id", "n_shingles", "node", "check", "counted", "hot"],
                )

    schema = "doc_id long, n_shingles long, node long, check long, counted array<long>, hot array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _token_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, check, tokens) of every text with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
            for part in slices([len(t) for t in texts], 2_000_000):
                sets = [s for s in shingle_sets(texts[part], width) if len(s)]
                hashes = [_set_hash(s) for s in sets]
                columns = [pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, _lists(sets)], ["node", "check", "tokens"])

    return docs.select("text").mapInArrow(run, "node long, check long, tokens array<long>")


def _met(columns: DataFrame) -> DataFrame:
    """The rows (node, token) whose token more than one node holds."""
    same = Window.partitionBy("token")
    met = columns.withColumns({"lo": F.min("node").over(same), "hi": F.max("node").over(same)}).where("lo < hi")
    return met.select("node", "token")


def _shared_columns(found: DataFrame) -> DataFrame:
    """(node, token) of the columns that more than one class holds; each row once."""
    columns = found.where(F.size("counted") > 0).select("node", F.explode("counted").alias("token"))
    hot = found.where(F.size("hot") > 0).select("node", F.explode("hot").alias("token"))
    return _met(columns).union(hot).distinct()


def _covered(sets: DataFrame, percent: int) -> DataFrame:
    """(cid) of the classes of `sets` that share as many of all their shingles as any link needs."""
    held = _met(sets.select(F.col("cid").alias("node"), F.explode("tokens").alias("token")))
    weight = held.groupBy(F.col("node").alias("cid")).agg(F.count("*").alias("held"))
    return weight.join(sets.select("cid", "n"), "cid").where(f"100 * held >= {percent} * n").select("cid")


def _ranked(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, token, n, w, lead, turn, rest): the rarest of the w shingles that a class shares.

    Shingles go by the number of their holders; of two linked classes the first one that both
    hold has `rest` shingles of each class from it on, which is at least `ceil(t * n)`.
    """
    whole, by_rarity = Window.partitionBy("cid"), Window.partitionBy("cid").orderBy("holders", "token")
    tokens = sets.select("cid", "n", F.explode("tokens").alias("token"))
    counted = tokens.withColumn("holders", F.count("*").over(Window.partitionBy("token"))).where("holders > 1")
    marks = {"w": F.count("*"), "lead": F.min("token"), "turn": F.min(F.xxhash64("token"))}
    found = counted.withColumns({c: f.over(whole) for c, f in marks.items()} | {"rank": F.row_number().over(by_rarity)})
    found = found.withColumn("rest", F.col("w") - F.col("rank") + 1).where(f"100 * rest >= {percent} * n")
    return found.select("cid", "token", "n", "w", "lead", "turn", "rest")


def _runs(classes: DataFrame) -> DataFrame:
    """(grp, cid): classes that follow each other by their least shared hashes, in bounded runs."""
    order = ("lead", "turn", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in order])
        members = tokens = 0
        grp, out = None, []
        for cid, n in zip(rows["cid"].to_pylist(), rows["n"].to_pylist(), strict=True):
            if grp is None or members == GROUP_MEMBERS or tokens + n > GROUP_TOKENS:
                grp, members, tokens = cid, 0, 0
            members, tokens = members + 1, tokens + n
            out.append(grp)
        found = [pa.array(out, pa.int64()), rows["cid"].combine_chunks()]
        yield pa.RecordBatch.from_arrays(found, ["grp", "cid"])

    # A task orders a range of some thousand rows of four numbers; ranges are joined to that
    # size first, so that their borders cut few groups short.
    parts = max(1, classes.count() // (16 * GROUP_MEMBERS))
    near = classes.select(*order, "n").repartitionByRange(*order).coalesce(parts)
    return near.mapInArrow(run, "grp long, cid long")


def _incidence(members: list[np.ndarray], width: int) -> np.ndarray:
    """Which token of the union (row) which member (column) holds."""
    held = np.zeros((width, len(members)), np.uint8)
    held[np.concatenate(members), np.repeat(np.arange(len(members)), [len(m) for m in members])] = 1
    return held


def _group_of(members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """One group's row: its members, the union of their shingles and its inner components."""
    members = members.sort_values("cid")
    sets = [np.asarray(t).view(np.uint64) for t in members["tokens"]]
    sizes = np.array([len(s) for s in sets])
    union, where = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(where, np.cumsum(sizes)[:-1])
    comp = np.arange(len(sets))
    if len(sets) > 1:
        held = _incidence(places, len(union))
        for k, at in enumerate(places[:-1]):
            if (comp == comp[k]).all():
                continue
            shared = held[at, k + 1 :].sum(axis=0, dtype=np.int64)
            near = 100 * shared >= percent * (sizes[k] + sizes[k + 1 :] - shared)
            for other in set(comp[k + 1 :][near].tolist()) - {comp[k]}:
                low, high = sorted((int(comp[k]), other))
                comp[comp == high] = low
    cids = members["cid"].to_numpy()
    row = {
        "grp": int(members["grp"].iloc[0]), "cids": cids, "sizes": sizes, "comps": cids[comp],
        "tokens": union.view(np.int64), "members": np.concatenate(places),
    }
    return pd.DataFrame([row])


def _open(queries: pd.DataFrame, group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) of queries to members of one group, one for each query and component."""
    a, b = [], []
    if len(queries) and len(group):
        row = group.iloc[0]
        union, sizes, cids = np.asarray(row["tokens"]).view(np.uint64), np.asarray(row["sizes"]), np.asarray(row["cids"])
        held = _incidence(np.split(np.asarray(row["members"]), np.cumsum(sizes)[:-1]), len(union))
        place = {p["cid"]: (p["comp_size"], p["comp"]) for p in row["places"]}
        weights, comps = (np.array([place[c][k] for c in cids.tolist()]) for k in (0, 1))
        asked = zip(*(queries[c] for c in ("cid", "comp", "comp_size", "tokens")), strict=True)
        for cid, comp, weight, tokens in asked:
            q = np.asarray(tokens).view(np.uint64)
            at = np.minimum(np.searchsorted(union, q), len(union) - 1)
            at = at[union[at] == q]
            if 100 * len(at) < percent * len(q):
                continue  # the bound against the whole union: no member can overlap enough
            above = (weights > weight) | ((weights == weight) & (comps > comp))
            shared = held[at].sum(axis=0, dtype=np.int64)
            linked = above & (100 * shared >= percent * (len(q) + sizes - shared))
            seen = set()
            for k in np.flatnonzero(linked).tolist():
                if comps[k] not in seen:
                    seen.add(comps[k])
                    a.append(cid)
                    b.append(int(cids[k]))
    return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})


def _links(
    pairs: DataFrame, asking: DataFrame, places: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, scratch: Scratch
) -> DataFrame:
    """Links of `pairs` (cid, grp) with the members of the groups that rank above.

    asking: cid, comp, comp_size; places: grp, cid, comp, comp_size of members. A group's
    queries are dealt into blocks of bounded size, so a group that very many classes query is
    spread over as many tasks as it needs.
    """
    blocks = pairs.join(sets.select("cid", "n"), "cid").groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    blocks = scratch.cut(blocks)  # stored tables tell their size, so small ones need no shuffle of the groups
    dealt = pairs.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    queries = scratch.cut(dealt.select("grp", "block", "cid").join(asking, "cid")).join(sets.select("cid", "tokens"), "cid")
    held = scratch.cut(places.groupBy("grp").agg(F.collect_list(F.struct("cid", "comp", "comp_size")).alias("places")))
    opened = groups.drop("comps").join(held, "grp").join(blocks, "grp")
    opened = opened.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(key, q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return _open(q, g, percent)

    return queries.groupBy("grp", "block").cogroup(opened.groupBy("grp", "block")).applyInPandas(run, _LINKS)


def class_links(
    docs: DataFrame, found: DataFrame, classes: DataFrame, width: int, percent: int,
    scratch: Scratch, trace: dict | None = None,
) -> DataFrame:
    """(node, check, comp): the classes that may have a link and their components, by number.

    found: the rows of `shingled`; classes: node, check, rep (a doc_id that has the set), n.
    trace, if given, is told how many classes were asked, and how many pairs of class and
    group were opened in each pass.
    """
    least = f"1 + ((least * {percent} + 99) div 100) * {EXTRA} div 100"
    sizes = classes.groupBy("node").agg(F.min("n").alias("least"))

    def enough(columns: DataFrame) -> DataFrame:
        """The classes that share as many columns as any link needs."""
        weight = columns.groupBy("node").agg(F.count("*").alias("w"))
        return weight.join(sizes, "node").where(f"w >= {least}").select("node")

    shared = scratch.cut(_shared_columns(found))
    scratch.drop(found)
    for _ in range(PEELS):  # columns shared with classes that are out do not count
        left = scratch.cut(enough(shared))  # stored tables tell their size: a small one is not shuffled
        before, shared = shared, scratch.cut(_met(shared.join(left, "node", "left_semi")))
        scratch.drop(before)
    active = scratch.cut(enough(shared))
    scratch.drop(shared)

    reps = classes.join(active, "node", "left_semi")
    texts = docs.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = _token_sets(texts, width).join(active, "node").dropDuplicates(["node", "check"])
    # From here on a class goes by its number; equal halves of two hashes are told apart.
    sets = scratch.cut(sets.withColumns({"cid": F.monotonically_increasing_id(), "n": F.size("tokens")}))
    # A passage that many classes hold does not make up for the rest of their texts.
    before, sets = sets, scratch.cut(sets.join(scratch.cut(_covered(sets, percent)), "cid", "left_semi"))
    scratch.drop(before)
    ranked = scratch.cut(_ranked(sets, percent))
    last = ranked.where("rest = w")  # one row for each class that is left
    runs = scratch.cut(_runs(last.select("cid", "n", "lead", "turn")))
    inside = sets.select("cid", "tokens").join(runs, "cid").groupBy("grp")
    groups = scratch.cut(inside.applyInPandas(lambda part: _group_of(part, percent), _GROUP))
    own = groups.select("grp", F.explode(F.arrays_zip("cids", "comps")).alias("m")).select(
        "grp", F.col("m.cids").alias("cid"), F.col("m.comps").alias("comp")
    )
    rows = ranked.select("token", "cid", "n", "rest", F.expr("w / n").alias("share")).join(runs, "cid")

    # A class with more of its shingles shared has fewer changes of its own: near copies that
    # lie in several groups meet in the group of the one they were made from.
    center = rows.groupBy("token").agg(
        F.max_by("grp", F.struct("share", "cid")).alias("center"), F.min("grp").alias("lo"), F.max("grp").alias("hi")
    )
    center = center.where("lo < hi").select("token", "center")
    met = rows.join(center, "token").where("grp <> center").groupBy("cid", F.col("center").alias("grp")).agg(F.count("*").alias("both"))
    first = scratch.cut(met.groupBy("cid").agg(F.max_by("grp", F.struct("both", "grp")).alias("grp")))
    alone = sets.select("cid", F.lit(-1).cast("long").alias("comp"), F.lit(-1).cast("long").alias("comp_size"))
    first_links = _links(first, alone, own.withColumn("comp_size", F.lit(0).cast("long")), groups, sets, percent, scratch)
    by_group = own.select("cid", "comp")
    a, b = (by_group.select(F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
    ends = scratch.cut(first_links.join(a, "a").join(b, "b").select("comp_a", "comp_b"))
    merged = connected_components(ends, scratch).toDF("comp", "whole")
    comps = by_group.join(merged, "comp", "left").select("cid", F.coalesce("whole", "comp").alias("comp"))
    comp_sizes = comps.groupBy("comp").agg(F.count("*").alias("comp_size"))
    comps = scratch.cut(comps.join(comp_sizes, "comp"))

    place = comps.select("cid", F.struct("comp_size", "comp").alias("place"))
    placed = rows.drop("share").join(place, "cid")
    mixed = placed.groupBy("token").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi")
    left = scratch.cut(placed.join(mixed.select("token"), "token"))
    top = left.groupBy("token", "grp").agg(F.max("place").alias("top"), F.min("n").alias("least"), F.max("n").alias("most"))
    likely = f"place < top and {100 + percent} * rest >= {percent} * (n + least) and 100 * most >= {percent} * n"
    second = left.join(top.withColumnRenamed("grp", "other"), "token").where(likely)
    second = second.select("cid", F.col("other").alias("grp")).distinct()
    second = scratch.cut(second.join(first, ["cid", "grp"], "left_anti"))
    links = _links(second, comps, runs.join(comps, "cid"), groups, sets, percent, scratch)
    a, b = (comps.select(F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
    ends = scratch.cut(links.join(a, "a").join(b, "b").select("comp_a", "comp_b"))
    merged = connected_components(ends, scratch).toDF("comp", "whole")
    whole = comps.join(merged, "comp", "left").select("cid", F.coalesce("whole", "comp").alias("comp"))
    if trace is not None:
        trace["classes"], trace["groups"] = last.count(), groups.count()
        trace["opened_central"], trace["opened_other"] = first.count(), second.count()
    return sets.select("node", "check", "cid").join(whole, "cid").select("node", "check", "comp")


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, trace: dict | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; linked when 100 * both >= percent * either."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    found = scratch.cut(shingled(docs, width, percent))
    digests = scratch.cut(found.select("doc_id", "n_shingles", "node", "check"))
    some = digests.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.cut(some.groupBy("node", "check").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    comps = class_links(docs, found, classes, width, percent, scratch, trace)
    labelled = scratch.cut(classes.join(comps, ["node", "check"]).select("node", "check", "rep", "comp"))
    least = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    linked = labelled.join(least, "comp").select("node", "check", "component_id")
    named = classes.join(linked, ["node", "check"], "left")
    named = named.select("node", "check", F.coalesce("component_id", "rep").alias("component_id"))
    labels = digests.join(named, ["node", "check"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    out = stored(labels.select("doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id")), "ngram-components")
    scratch.close()
    return out
