"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Every rule is a row `(name, numerator, denominator, low, high)`: a document passes if
`low * denominator <= numerator <= high * denominator` (a missing bound is open), in
whole numbers of thousandths, so no rounding decides. `compile_rules` turns the table
into one boolean column per rule; a new rule is a new row.

Defined results: null or empty texts have no words and fail the base rule; a document
of any length is read whole; equal texts get equal verdicts; repeated doc_ids keep one
row each; columns of the input that share a name with a signal are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscast.llm.text import SPACES, shingles, words

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages, in alphabetical order by language.
STOP_WORDS = (
    "a and are as at be by for from in is it of on that the this to was with",
    "aus das dem den der des die ein eine für ist mit nicht sich und von wie zu",
    "au avec dans de des elle en est et il la le les pas pour que qui sur un une",
    "al como con de del el en es la las los no para por que se su un una y",
)

#: name, numerator, denominator, least and most ratio in thousandths (None: open).
RULES = (
    ("word_length", "word_chars", "n_words", 2000, 12000),
    ("symbols", "n_symbols", "n_words", None, 100),
    ("stop_words", "n_stop_words", "n_words", 20, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SIGNALS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines",
)


def compile_rules(rules=RULES) -> dict[str, Column]:
    """One boolean column (passed) for each row of the threshold table."""
    out = {}
    for name, num, den, low, high in rules:
        parts = []
        if low is not None:
            parts.append(F.col(num) * 1000 >= F.col(den) * low)
        if high is not None:
            parts.append(F.col(num) * 1000 <= F.col(den) * high)
        out[name] = reduce(lambda a, b: a & b, parts, F.lit(True))
    return out


def _covered(hashes: Column, width: int) -> Column:
    """Positions covered by windows whose hash occurs at least twice, each position once."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, k, d: F.coalesce(x["h"] == F.get(s, k + d)["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, k, -1) | same(x, k, 1))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def add(a: Column, i: Column) -> Column:
        more = i + width - F.greatest(a["end"], i)
        return F.struct((i + width).alias("end"), (a["n"] + more).alias("n"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    # The one-element array binds the sorted windows to a name, so they are sorted once.
    bound = F.transform(F.array(ordered), lambda s: F.aggregate(starts(s), zero, add)["n"])
    return F.get(bound, 0)


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with the SIGNALS added (same-named columns are replaced)."""
    body = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(F.translate(body, chars, ""))
    stop = sorted({w for line in STOP_WORDS for w in line.split()})
    w, l, h = (_unused(docs, name) for name in ("__words", "__lines", "__windows"))  # noqa: E741
    out = docs.withColumn(w, words(F.col(text))).withColumn(
        l, F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    )
    out = out.withColumn(h, F.when(F.size(w) >= 3, shingles(F.col(w), 3)))
    twice = F.size(F.array_distinct(h)) < F.size(h)
    return out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": without(SPACES).cast("long"),
            "n_symbols": (F.length(body) - without(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
            "n_repeat_words": F.when(twice, _covered(F.col(h), 3)).otherwise(0).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long"),
            "n_lines": F.size(l).cast("long"),
            "n_ellipsis_lines": F.size(
                F.filter(l, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))
            ).cast("long"),
            "n_bullet_lines": F.size(
                F.filter(l, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))
            ).cast("long"),
        }
    ).drop(w, l, h)


def base_failed() -> Column:
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    return (F.col("n_words") < MIN_WORDS) | repeats


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Signals, base_failed, failed_rules (names of the table's rules) and kept."""
    passed = compile_rules(rules)
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]))
    if not passed:
        failed = F.array().cast("array<string>")
    return (
        with_signals(docs, text)
        .withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with their own columns only."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    judged = judge(docs.select(own, F.col(text).alias("text")), rules)
    # A filter would be pushed below the signals and write each of them out once per rule.
    rows = judged.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row"))
    return rows.select("__row.*")
