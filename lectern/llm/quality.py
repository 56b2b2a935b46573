"""Quality rules with risk-controlled thresholds (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, ln_gamma, materialize, words

#: Each rule rejects above a cutoff; cutoffs run from lenient to strict.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeats": (0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.06, 0.05),
    "word_length": (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0),
}
SYMBOLS = r"[^#*$%&|<>]+"  # everything but the symbols
WINDOW = 5


def _windows(w: Column) -> Column:
    """Hashes of the five-word windows."""
    n = F.size(w)
    return F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    A null text counts as empty: all zero.  Windows meet by 64-bit hashes
    within one text and count as equal only if their words are.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_w": words(F.col(text)), "_l": lines})
    df = df.withColumn("_h", _windows(F.col("_w")))
    df = df.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    window = lambda e: F.slice(F.col("_w"), e["i"] + 1, F.lit(WINDOW))
    meets = lambda e, o: F.coalesce(o["h"] == e["h"], F.lit(False))
    equal = lambda e, o: meets(e, o) & (window(o) == window(e))

    def same(e: Column, k: Column) -> Column:
        before, after = F.get(F.col("_s"), k - 1), F.get(F.col("_s"), k + 1)
        # Only where hashes meet and words do not is another window of that hash looked for.
        other = (meets(e, before) | meets(e, after)) & F.exists("_s", lambda o: (o["h"] == e["h"]) & (o["i"] != e["i"]) & (window(o) == window(e)))
        return equal(e, before) | equal(e, after) | other

    starts = F.array_sort(F.filter(F.transform("_s", lambda e, k: F.when(same(e, k), e["i"])), lambda x: x.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    long = lambda c: c.cast("bigint")
    return df.withColumns(
        {
            "n_words": long(F.size("_w")),
            "word_chars": long(F.length(F.array_join("_w", ""))),
            "n_symbols": long(F.length(F.regexp_replace(t, SYMBOLS, ""))),
            "n_lines": long(F.size("_l")),
            "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        }
    ).drop("_w", "_l", "_h", "_s")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """What each rule compares with its cutoff."""
    words_ = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words_,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words_,
        "word_length": F.col("word_chars") / words_,
    }


def most_rejections(n: Column, risk: float, level: Column) -> Column:
    """Largest k with P(Binomial(n, risk) <= k) <= level, or -1.

    At most k rejections among n good documents then show, at that level,
    that the true rate of false rejections is below `risk`.  Probabilities are
    summed in logarithms from twelve standard deviations below the mean, under
    which less than 1e-30 lies, so that n may be large.
    """
    n = n.cast("double")
    odds, centre = F.log(F.lit(risk / (1.0 - risk))), n * risk
    low = F.greatest(F.floor(centre - 12 * F.sqrt(centre) - 60), F.lit(0)).cast("bigint")
    first = ln_gamma(n + 1) - ln_gamma(low + 1.0) - ln_gamma(n - low + 1.0) + low * F.log(F.lit(risk)) + (n - low) * F.log(F.lit(1.0 - risk))
    start = F.struct(first.alias("log_p"), F.lit(0.0).alias("below"), (low - 1).cast("bigint").alias("k"))

    def step(acc: Column, j: Column) -> Column:
        p = F.when(j == low, acc["log_p"]).otherwise(acc["log_p"] + F.log((n - j + 1) / F.greatest(j, F.lit(1))) + odds)
        below = acc["below"] + F.exp(p)
        return F.struct(
            p.alias("log_p"), below.alias("below"), F.when(below <= level, j).otherwise(acc["k"]).cast("bigint").alias("k")
        )

    return F.aggregate(F.sequence(low, F.ceil(centre)), start, step, lambda acc: acc["k"])


def _choose(cuts: tuple[float, ...], good: Column, bad: Column, most: Column) -> Column:
    """The cutoff taken from the counts of good and bad documents that each one rejects."""
    steps = F.sequence(F.lit(0), F.lit(len(cuts) - 1))
    passed = F.aggregate(steps, F.lit(0), lambda acc, i: F.when((acc == i) & (F.get(good, i) <= most), i + 1).otherwise(acc))

    def better(acc: Column, i: Column) -> Column:
        gain = F.get(bad, i) - F.get(good, i)
        return F.when((i < passed) & (gain > acc["gain"]), F.struct(i.alias("i"), gain.alias("gain"))).otherwise(acc)

    none = F.struct(F.lit(-1).alias("i"), F.lit(0).cast("bigint").alias("gain"))
    return F.get(F.array(*[F.lit(c) for c in cuts]), F.aggregate(steps, none, better, lambda acc: acc["i"]))


def fit_cutoffs(labelled: DataFrame, stratum: str, good: Column, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """Cutoffs per stratum from labelled rows with text features: one row a stratum, columns cut_<rule>.

    Each rule gets an equal share of the risk.  Its cutoffs are tested from
    lenient to strict by exact binomial bounds and testing stops at the first
    that fails (fixed sequence); the level is divided by strata times rules
    (Bonferroni).  Of the certified cutoffs the one is taken that rejects most
    bad over good documents, the most lenient of equals; null if none gains.
    So with probability 1 - level every stratum's false rejections stay within
    `risk`.  Labels only enter through counts, which pre-aggregate.
    """
    share = risk / len(RULES)
    rows = labelled.where(~base_failed()).select(F.col(stratum), good.alias("_good"), *[m.alias(r) for r, m in metrics().items()])
    counts = rows.groupBy(stratum).agg(
        F.count_if("_good").alias("_n"),
        *[
            F.array(*[F.count_if((F.col("_good") == g) & (F.col(r) > c)) for c in cuts]).alias(f"_{name}_{r}")
            for r, cuts in RULES.items()
            for g, name in ((True, "good"), (False, "bad"))
        ],
    )
    strata = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    counts = counts.withColumn("_most", most_rejections(F.col("_n"), share, F.lit(level / len(RULES)) / strata))
    out = {f"cut_{r}": _choose(cuts, F.col(f"_good_{r}"), F.col(f"_bad_{r}"), F.col("_most")) for r, cuts in RULES.items()}
    return counts.select(stratum, *[c.alias(k) for k, c in out.items()])


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    risk: float = 0.05,
    level: float = 0.05,
) -> DataFrame:
    """Verdict for every row of docs: the text features, base_failed and kept.

    `labels` (doc_id, quality) is the labelled holdout; rows of it with a null
    label are ignored, a document labelled several times counts as often.  A
    document without a stratum belongs to the stratum null.  A text that is
    null or empty fails the base rules; texts of any length are read whole.
    Rows that repeat are judged one by one; a metric equal to its cutoff
    passes.  Without labels no cutoff is certified and only base rules reject;
    without rows the result is empty.  Further columns are not read.
    """
    feats, cuts = _fit(docs, labels, doc_id, text, stratum, risk, level)
    return _judged(feats, cuts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept"
    )


def _cutoffs(feats: DataFrame, labels: DataFrame, risk: float, level: float) -> DataFrame:
    """Cutoffs by `_of`, a stratum, from feats (doc_id, _stratum and text features) and labels."""
    holdout = labels.select(F.col("doc_id"), F.col("quality")).where("quality is not null")
    cuts = fit_cutoffs(feats.join(holdout, "doc_id"), "_stratum", F.col("quality") == 1, risk, level)
    return materialize(cuts.withColumnRenamed("_stratum", "_of"), "cutoffs")


def _fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, stratum: str, risk: float, level: float) -> tuple[DataFrame, DataFrame]:
    feats = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("_stratum"), F.col(text).alias("_text"))
    feats = materialize(text_features(feats, "_text").drop("_text"), "quality")
    return feats, _cutoffs(feats, labels, risk, level)


def _judged(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    df = join_small(feats, cuts, F.col("_stratum").eqNullSafe(F.col("_of")), "left")
    above = F.lit(False)
    for r, m in metrics().items():
        above = above | F.coalesce(m > F.col(f"cut_{r}"), F.lit(False))
    return df.withColumn("kept", ~base_failed() & ~above)


def keep_good(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.05, level: float = 0.05
) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their own columns.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and
    further columns are as in quality_rules; columns of any names stay.
    Features are computed once and written beside their rows; the fit reads
    back the features alone.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("doc_id"), F.col(stratum).alias("_stratum"), F.col(text).alias("_text"))
    feats = materialize(text_features(rows, "_text").drop("_text"), "quality-rows")
    judged = _judged(feats, _cutoffs(feats.drop("_row"), labels, risk, level))
    return judged.where("kept").select("_row.*")
