"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions only.

A sketch is the sorted array of the k smallest distinct 48-bit hashes of a text's word
shingles (ASCII lower case, five words; a shorter text is one shingle). Sketches of parts
merge into the sketch of the whole. Two sketches estimate resemblance and containment;
one estimates the number of distinct shingles. All three are exact for sets below k.

Defined results: null and empty texts and texts without words have the empty sketch; equal
sketches, the empty ones included, have resemblance 1, an empty and another one 0; a null
doc_id sorts last; repeated doc_ids are ordered by length, longest first, and hash of their
texts; an empty table gives no rows; of other columns none are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscast.llm.text import ascii_lower, words

K = 256
WIDTH = 5
_BITS = 48
#: Ranges of neighbours for each shuffle partition of the session, so that hashing evens them out.
RANGES_A_PARTITION = 4


def sketch(tokens: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest distinct shingle hashes of an array of words, ascending."""
    n = F.size(tokens)
    hashed = F.transform(
        tokens,
        lambda w, i: F.shiftrightunsigned(
            F.xxhash64(w, *[F.get(tokens, i + d) for d in range(1, width)]), 64 - _BITS
        ),
    )
    whole = F.slice(hashed, 1, F.least(n, F.greatest(F.lit(1), n - (width - 1))))
    return F.slice(F.sort_array(F.array_distinct(whole)), 1, k)


def text_words(text: Column) -> Column:
    return words(ascii_lower(text))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B| (1 for equal sketches, the empty ones included)."""
    union = F.sort_array(F.array_union(a, b))
    whole = (F.size(a) < k) & (F.size(b) < k)
    least = F.slice(union, 1, F.when(whole, F.greatest(F.size(union), F.lit(1))).otherwise(k))
    # In the k smallest of the union, those in both are the ones that both sketches show.
    shared = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(least))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.element_at(a, -1).cast("double") / float(1 << _BITS)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of A's shingles that B has (null for an empty A)."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    share = F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na))
    return F.when(F.size(a) > 0, share)


def merge(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts; each task keeps k hashes a key."""
    hashes = parts.select(key, F.explode_outer(column).alias("h")).distinct()
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.col("h").asc_nulls_last()))
    least = hashes.withColumn("r", order).where(F.col("r") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def encode(a: Column) -> Column:
    """A sketch as text: 12 hexadecimal digits for each hash, ascending."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 12, "0")), "")


def _range_of(place: Column, bounds: list) -> Column:
    """How many bounds but the first are at most `place`: a search in two steps.

    A bound is a tuple of whole numbers and compares with the struct `place` field by field.
    """
    step = max(1, int(len(bounds) ** 0.5))
    lits = [F.struct(*[F.lit(v).cast("long").alias(f) for v, f in zip(b, PLACE, strict=True)]) for b in bounds]
    count = lambda a: F.size(F.filter(a, lambda b: b <= place))
    run = F.greatest(count(F.array(*lits[::step])), F.lit(1)) - 1
    fine = F.slice(F.array(*lits), run * step + 1, F.lit(step))
    return run * step + F.greatest(count(fine), F.lit(1)) - 1


#: Fields of a row's place among all rows: id, length and hash of the text.
PLACE = ("id", "size", "tie")


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and place: later rows of the order have smaller places."""
    text = F.coalesce("text", F.lit(""))
    # The hash is turned round, so that ties in falling order have rising hashes.
    fields = (F.coalesce("doc_id", F.lit(-(1 << 63))), F.length("text"), F.bitwise_not(F.xxhash64("text")))
    place = F.struct(*[v.cast("long").alias(f) for v, f in zip(fields, PLACE, strict=True)])
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("place", place)


def with_neighbour(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, place, range, ghost): a range's rows follow each other by falling place.

    Spark cuts the places, never the texts, into ranges of like size, as many as the session's
    shuffle partitions ask for; rows of one doc_id are cut by length and hash. The driver holds
    the least and greatest place of each range. The first row of a range is repeated, as a
    ghost, behind the last of the range above (that of the top range behind the last of the
    bottom one), so that each row's next row is in its range. Rows equal in id and text have
    one place and so one range, where they are streamed.
    """
    spark = docs.sparkSession
    parts = RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _placed(docs)
    cut = rows.select("place").repartitionByRange(parts, "place").groupBy(F.spark_partition_id())
    ends = cut.agg(F.min("place").alias("least"), F.max("place").alias("top")).collect()
    # Partitions are disjoint ranges of places; an empty table is one range without rows.
    ends = sorted((tuple(e.least), tuple(e.top)) for e in ends) or [((0, 0, 0), (0, 0, 0))]
    own = _range_of(F.col("place"), [least for least, _ in ends])
    tops = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f) for v, f in zip(top, PLACE, strict=True)]) for _, top in ends])
    rows = rows.withColumn("own", own)
    spots = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("ghost")))
    above = F.struct(((F.col("own") + 1) % len(ends)).alias("range"), F.lit(True).alias("ghost"))
    first = F.col("place") == F.get(tops, F.col("own"))
    rows = rows.withColumn("spot", F.explode(F.when(first, F.array_append(spots, above)).otherwise(spots)))
    return rows.select("doc_id", "text", "place", "spot.range", "spot.ghost")


def edit_report(docs: DataFrame, k: int = K) -> DataFrame:
    """Each text's sketch, that of its edited text, and the likeness to that and to the next text.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or
    all) of the next document by descending doc_id; the last one's next is the first one.
    """
    rows = with_neighbour(docs).withColumn("n_chars", F.length("text"))
    # Both windows share one exchange and one sort.
    order = Window.partitionBy("range").orderBy("ghost", F.desc("place"), "text")
    half = (F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars") - half),
        F.coalesce(F.substring("next_text", F.lit(1), half), F.lit("")),
    )).drop("next_text")
    rows = rows.withColumns({"w": text_words(F.col("text")), "edited_w": text_words(F.col("edited"))})
    rows = rows.withColumns({"s": sketch(F.col("w"), k), "edited_s": sketch(F.col("edited_w"), k)})
    rows = rows.drop("w", "edited_w")
    rows = rows.withColumn("next_s", F.lead("s").over(order)).where(~F.col("ghost"))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long"), "edited",
        F.col("s").alias("sketch"), F.col("edited_s").alias("edited_sketch"),
        resemblance(F.col("s"), F.col("edited_s"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("next_s"), k).alias("near_next"),
    )
