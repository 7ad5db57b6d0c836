"""Line dedup over levelled sorted runs of line hashes.

1. `line_keys` reads every text once: a row for each line whose key is long enough, with its
   place in the text and a 128-bit hash of the key; line texts go no further.
2. Documents come in batches, largest ids first, each twice as large as the one before, so
   that all readings of earlier runs together are no more than twice the lines (`shares`).
   A run is a table of (h1, h2, docs, top): a
   hash, how many documents of the batch hold it, and the largest doc_id of them, bucketed
   and sorted by hash. Each batch is merge-anti-joined with the keys that the runs have
   settled (in `min_docs` documents or more: count and largest id can no longer matter) and
   adds the others as a run of its own, so a line that very many documents hold is written
   in the first batches only. Runs and batches lie in equal buckets: neither is shuffled.
3. When a level holds `fanout` runs, they are compacted into one run of the next level.
4. Lines of settled keys are dropped by their places, but for the largest id's. The few keys
   that a thousandth of all documents hold are broadcast while they are no more than
   HEAVY_ROWS, and joined in parts beyond (`_lost`); the rest are joined.

Defined results: a null or empty text is one empty line; rows with a null doc_id keep all
lines and count nowhere; the rows of a repeated doc_id are one document to the counts and
each keep their own lines; equal lines inside one document count once and stay or go
together; an empty table gives no rows; other columns of the input are carried along, those
named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obscast.llm.shared import Scratch, remove, shared_path
from obscast.llm.text import SPACES, ascii_lower

MIN_CHARS, MIN_DOCS = 20, 3
#: Runs of a level that are compacted, fewest batches, and documents in the first batch of a large input.
FANOUT, BATCHES, BATCH_ROWS = 4, 4, 10_000_000
#: Hashes in a bucket of the runs, as far as there are shuffle partitions for them.
BUCKET_ROWS = 100_000
#: A key is broadcast if at least one in so many documents holds it: at most so many times the lines of a document.
HEAVY = 1000
#: Most keys that are broadcast (24 bytes each), and the parts into which more are dealt.
HEAVY_ROWS, HEAVY_PARTS = 1_000_000, 64
_HASH = ["h1", "h2"]
_RUN = "h1 long, h2 long, docs long, top long"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def key_hash(key: Column) -> list[Column]:
    """Two hashes; the second is seeded by a first value, so it does not follow from the first."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def line_keys(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line with a key long enough; row tells texts of one id apart."""
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = rows.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select("doc_id", "row", "pos", *key_hash(F.col("key")))


class LineRuns:
    """Levelled runs: partitions of one bucketed table in the shared folder, each sorted by hash."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT, min_docs: int = MIN_DOCS):
        self.spark, self.buckets, self.fanout, self.min_docs = spark, buckets, fanout, min_docs
        self.path, self.name = shared_path(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[int]] = [[]]
        self._made = 0

    def _table(self, rows: DataFrame, name: str, partition: str) -> None:
        """Rows, bucketed and sorted by hash, into a table; a bucket's runs are read by one task."""
        writer = rows.write.format("parquet").mode("append").partitionBy(partition).bucketBy(self.buckets, *_HASH)
        writer.sortBy(*_HASH).option("path", f"{self.path}/{name}").saveAsTable(f"{self.name}_{name}")

    def stage(self, batches: DataFrame) -> None:
        """Stores batches (batch, _RUN) in buckets like those of the runs."""
        self._table(batches.repartition(self.buckets, *_HASH), "batches", "batch")

    def batch(self, number: int) -> DataFrame:
        return self.spark.table(f"{self.name}_batches").where(F.col("batch") == number).drop("batch")

    def _write(self, rows: DataFrame) -> int:
        self._table(rows.select(*_HASH, "docs", "top", F.lit(self._made).alias("run")), "runs", "run")
        self._made += 1
        return self._made - 1

    def merged(self, runs: list[int] | None = None) -> DataFrame:
        """One row a key over the runs named, or over all; a key's rows lie in one bucket."""
        runs = [n for level in self.levels for n in level] if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], _RUN)
        rows = self.spark.table(f"{self.name}_runs").where(F.col("run").isin(runs))
        return rows.groupBy(*_HASH).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def settled(self) -> DataFrame:
        return self.merged().where(F.col("docs") >= self.min_docs)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a staged batch whose keys are not settled."""
        return batch.join(self.settled().select(*_HASH).hint("merge"), _HASH, "left_anti") if any(self.levels) else batch

    def add(self, number: int) -> None:
        """Adds the run of a staged batch, of documents with smaller ids than those before."""
        self.levels[0].append(self._write(self.fresh(self.batch(number))))
        self.compact()

    def compact(self) -> None:
        """Merges each level that is full into one run of the level above."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged = self._write(self.merged(self.levels[level]))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level] = []
                self.levels[level + 1].append(merged)
            level += 1

    def close(self) -> None:
        for name in ("batches", "runs"):
            self.spark.sql(f"drop table if exists {self.name}_{name}")
        remove(self.spark, self.path)


def shares(batches: int) -> list[float]:
    """Quantiles of doc_id between batches of which each is twice as large as the one before, largest ids first."""
    return [1.0 - (2**k - 1) / (2**batches - 1) for k in range(1, batches)]


def build_runs(keys: DataFrame, rows: int, batches: int | None = None, fanout: int = FANOUT, min_docs: int = MIN_DOCS) -> LineRuns:
    """Runs over all of `keys` (stored `line_keys` of `rows` documents), largest ids first."""
    spark = keys.sparkSession
    batches = batches or max(BATCHES, (rows // BATCH_ROWS + 1).bit_length())
    parts = F.array(*[F.lit(share) for share in shares(batches)] or [F.lit(0.0)])
    n, bounds = keys.agg(F.count("*"), F.percentile_approx("doc_id", parts, 10_000)).first()
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS)))
    runs = LineRuns(spark, buckets, fanout, min_docs)
    bounds = sorted(set(bounds or []))
    batch = reduce(Column.__add__, [(F.col("doc_id") <= b).cast("int") for b in bounds], F.lit(0))
    held = keys.select(batch.alias("batch"), *_HASH, "doc_id").distinct()
    counted = held.groupBy("batch", *_HASH).agg(F.count("*").alias("docs"), F.max("doc_id").alias("top"))
    runs.stage(counted)
    for k in range(len(bounds) + 1):
        runs.add(k)
    return runs


def _lost(keys: DataFrame, settled: DataFrame, rows: int) -> DataFrame:
    """(doc_id, row, gone): the places of the lines that go, by text."""
    often = F.col("docs") >= max(MIN_DOCS, rows // HEAVY)
    heavy = settled.where(often).select(*_HASH, F.col("top").alias("heavy_top"))
    if heavy.count() <= HEAVY_ROWS:
        marked = keys.join(F.broadcast(heavy), _HASH, "left")
    else:  # a key's lines are dealt into parts, its row goes to each
        heavy = heavy.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HEAVY_PARTS - 1))))
        dealt = keys.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(HEAVY_PARTS)).cast("int"))
        marked = dealt.join(heavy, [*_HASH, "part"], "left").drop("part")
    met = marked.where("heavy_top is null").drop("heavy_top").join(settled.where(~often).select(*_HASH, "top"), _HASH)
    met = met.union(marked.where("heavy_top is not null").select(*met.columns[:-1], F.col("heavy_top").alias("top")))
    return met.where("doc_id <> top").groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))


def dedup(docs: DataFrame, batches: int | None = None, fanout: int = FANOUT, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with repeated lines taken out of text, plus n_lines and n_dropped.

    A key in `min_docs` documents or more stays in the one of the largest doc_id only.
    """
    spark = docs.sparkSession
    scratch, result = Scratch(spark, "line-keys"), Scratch(spark, "lines-gone")
    keys, rows = scratch.cut(line_keys(docs, min_chars=min_chars)), docs.count()
    runs = build_runs(keys, rows, batches, fanout, min_docs)
    gone = result.cut(_lost(keys, scratch.cut(runs.settled()), rows))
    runs.close()
    scratch.close()
    gone = gone.select(F.struct("doc_id", "row").alias("of"), "gone")
    # Input columns travel inside one, so that none of their names can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    of = F.when(F.col("whole.doc_id").isNotNull(), F.struct(F.col("whole.doc_id"), F.xxhash64("whole.text").alias("row")))
    marked = whole.withColumn("of", of).join(gone, "of", "left")
    text = F.coalesce("whole.text", F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")
    made = {
        "text": F.when(F.col("gone").isNull(), text).otherwise(kept),
        "n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    names = [*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns]]
    return marked.select(*[made[c].alias(c) if c in made else F.col(f"whole.`{c}`").alias(c) for c in names])
