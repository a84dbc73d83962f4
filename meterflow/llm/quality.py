"""Quality rules whose thresholds adapt to each language and source.

Counts per document come from DataFrame functions alone. Each (lang, source) group keeps one KLL
quantile sketch per signal; sketches merge upwards to the language and to the whole corpus, and a
group with fewer than ``min_group`` documents borrows the sketch above it. A document is rejected
when a signal lies further from its group's median than ``k`` spreads, the spread being the distance
from the 10th percentile to the median (so that a group may be nearly half junk and still measure
its clean part), or when the base rule of the contract fails.

Defined results: NULL text counts as no words (base rule fails); NULL lang or source form groups of
their own; repeated rows are judged alike, row by row; an empty table gives an empty table; extra
columns of ``docs`` are carried by ``filter_docs`` and ignored by ``verdicts``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, only, save

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Signal:
    """One adaptive rule. ``least`` is the smallest spread that is told from noise."""

    name: str
    k: float
    least: float
    both_sides: bool = False


SIGNALS = (
    Signal("symbol_ratio", 4.0, 0.01),
    Signal("dup_line_ratio", 4.0, 0.1),
    Signal("repeat_ratio", 4.0, 0.12),
    Signal("mean_word_chars", 6.0, 0.25, both_sides=True),
)
SKETCH_K = 4096
MIN_GROUP = 200
#: Threshold tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_lines`` and the five counts of the contract to every row of ``docs``."""
    # each select keeps one array, so that later lambdas read a column instead of computing it again
    words = docs.withColumn("_words", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), ""))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.when(
        F.size("_words") >= 3,
        F.transform(
            F.slice("_words", 1, F.size("_words") - 2),
            lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    step = words.select("*", grams.alias("_grams"), lines.alias("_lines"), F.array_join("_words", "").alias("_joined"))
    # windows found twice or more: sort them with their places and keep those equal to a neighbour
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    ranked = F.when(twice, F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    step = step.select("*", ranked.alias("_ranked"))
    again = F.filter(
        F.transform(
            "_ranked",
            lambda x, i: F.when(
                (x["g"] == F.get("_ranked", i - 1)["g"]) | (x["g"] == F.get("_ranked", i + 1)["g"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    step = step.select("*", again.alias("_again"))
    covered = F.size(
        F.array_distinct(
            F.concat("_again", F.transform("_again", lambda i: i + 1), F.transform("_again", lambda i: i + 2))
        )
    )
    return step.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        F.regexp_count("_joined", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def with_signals(counted: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumns(
        {
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            "mean_word_chars": ratio("word_chars", "n_words"),
            "base_failed": failed,
        }
    )


def thresholds(signals: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source): the lower and upper bound of each signal.

    Documents that fail the base rule do not shape the thresholds. Groups are aggregated to sketches
    map-side; only sketches (fixed size) are shuffled and merged.
    """
    usable = signals.where(~F.col("base_failed"))
    size = lambda s: F.kll_sketch_get_n_double(s)
    fine = usable.groupBy("lang", "source").agg(
        *[F.kll_sketch_agg_double(s.name, F.lit(SKETCH_K)).alias(s.name) for s in SIGNALS]
    )
    merged = [F.kll_merge_agg_double(s.name, F.lit(SKETCH_K)).alias(s.name) for s in SIGNALS]
    fine = save(fine, "sketches")
    by_lang = fine.groupBy("lang").agg(*merged)
    overall = fine.agg(*merged)
    first = SIGNALS[0].name

    def bounds(df: DataFrame, *keys: str) -> DataFrame:
        out = []
        for s in SIGNALS:
            q = F.kll_sketch_get_quantile_double(F.col(s.name), F.array(F.lit(0.1), F.lit(0.5)))
            spread = F.greatest(q[1] - q[0], F.lit(s.least))
            low = q[1] - s.k * spread if s.both_sides else F.lit(float("-inf"))
            out.append(F.struct(low.alias("low"), (q[1] + s.k * spread).alias("high")).alias(s.name))
        return df.where(F.col(first).isNotNull() & (size(F.col(first)) > 0)).select(
            *keys, F.struct(size(F.col(first)).alias("n"), *out).alias("b")
        )

    # three levels in one column: the finest level with enough documents wins
    groups = bounds(fine, "lang", "source")
    langs = bounds(by_lang, "lang").select(F.col("lang").alias("_lang"), F.col("b").alias("_lb"))
    whole = bounds(overall).select(F.col("b").alias("_gb")).first()
    top = F.lit(None) if whole is None else F.struct(
        F.lit(whole["_gb"]["n"]).alias("n"),
        *[
            F.struct(F.lit(whole["_gb"][s.name]["low"]).alias("low"), F.lit(whole["_gb"][s.name]["high"]).alias("high")).alias(s.name)
            for s in SIGNALS
        ],
    )
    joined = groups.join(langs, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    best = (
        F.when(F.col("b.n") >= min_group, F.col("b"))
        .when(F.col("_lb.n") >= min_group, F.col("_lb"))
        .otherwise(top)
    )
    return save(joined.select("lang", "source", best.alias("bounds")), "thresholds")


def judged(signals: DataFrame, limits: DataFrame) -> DataFrame:
    """Join every document with its group's bounds and add ``kept``."""
    side = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("bounds").alias("_bounds"))
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    inside = F.lit(True)
    for s in SIGNALS:
        v = F.col(s.name)
        inside = inside & (v <= F.col(f"_bounds.{s.name}.high")) & (v >= F.col(f"_bounds.{s.name}.low"))
    on = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return signals.join(side, on, "left").withColumn("kept", kept).drop("_l", "_s", "_bounds")


def verdicts(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` for every document."""
    base = only(docs, doc_id="long", text="string", lang="string", source="string")
    counted = save(with_counts(base).drop("text"), "quality-counts")
    signals = with_signals(counted)
    out = judged(signals, thresholds(signals, min_group))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", *[s.name for s in SIGNALS])


def filter_docs(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with the columns of ``docs``."""
    renamed = docs.select(F.struct("*").alias("_row"), F.col("`text`").alias("text"), F.col("`lang`").alias("lang"), F.col("`source`").alias("source"))
    counted = save(with_counts(renamed).drop("text"), "quality-docs")
    signals = with_signals(counted)
    limits = thresholds(signals, min_group)
    return judged(signals, limits).where("kept").select("_row.*")
