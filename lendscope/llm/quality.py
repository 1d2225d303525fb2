"""Quality rules whose cutoffs carry a guarantee on clean documents.

Every document gets a few shares (symbols, repeated lines, repeated words,
capitals, exclamation marks, word length).  For every stratum (language) and share, the
labelled documents test a fixed grid of cutoffs: with k of n clean documents
at or above the cutoff, the exact binomial tail P(Bin(n, alpha) <= k) is the
p-value of "this cutoff rejects more than alpha of the stratum's clean
documents".  A cutoff may be used only where that is refuted at level
delta / (strata * shares).  Bonferroni covers strata and shares; along the grid
the tests run from the loosest cutoff to the strictest, and as their p-values
only rise, stopping at the first that is not refuted needs no further
correction.  ``alpha`` is the stratum's limit divided by the number of shares,
so all rules together keep it.  Of the cutoffs allowed, the one with the best
balance of labelled junk over clean documents is taken, or none.

Only DataFrame functions: texts are turned into counts inside one scan, written
as a narrow table; labels join that table, and what is joined back to it is one
row per stratum (``join_hot_split``: a language may hold most rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot_split, materialize, table, with_row_key, word_array

# Fixed values of the base rules.
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SHARE_GRID = (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)
LENGTH_GRID = (8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 25.0, 30.0, 40.0, 60.0)
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": SHARE_GRID, "dup_line_share": SHARE_GRID, "repeat_share": SHARE_GRID,
    "upper_share": SHARE_GRID, "mark_share": SHARE_GRID, "mean_word_chars": LENGTH_GRID,
}
MAX_FALSE_REJECTION = 0.05  # of a stratum's clean documents, by all rules together
DELTA = 0.05  # probability that any stratum's limit is broken
CLEAN_PRICE = 20  # junk documents that one wrongly rejected clean document weighs as much as
TAIL_TERMS = 4000  # of the binomial tail; what is left out is bounded and added


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count_chars(t: Column, chars: str) -> Column:
    """Characters of a class; regexp_replace is several times faster than translate, which maps every character."""
    return F.length(t) - F.length(F.regexp_replace(t, chars, ""))


def _repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, on 64-bit window hashes."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(pairs, lambda s: _let(places(s), total)))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return _let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(windows(w), covered)))


def text_counts(docs: DataFrame, text: str = "text", stratum: str = "lang", row: str | None = None) -> DataFrame:
    """doc_id, stratum and the counts of each text, from one scan (and ``_row``, the column ``row``, if there is one)."""
    keys = ["_row"] if row else []
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    packed = docs.select(
        *[F.col(row).alias(k) for k in keys], F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("stratum"),
        _count_chars(t, SYMBOLS).cast("long").alias("n_symbols"),
        _count_chars(t, "[A-Z]").cast("long").alias("n_upper"), _count_chars(t, "[!?]").cast("long").alias("n_marks"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                       (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _let(word_array(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"),
                                               _repeated_words(w).cast("long").alias("rep"))).alias("words"))
    n, rep = F.col("words.n"), F.col("words.rep")
    return packed.select(
        *keys, "doc_id", "stratum", n.alias("n_words"), F.col("words.chars").alias("word_chars"), "n_symbols", F.col("lines.dup").alias("n_dup_lines"),
        rep.alias("n_repeat_words"), "n_upper", "n_marks", F.col("lines.n").alias("n_lines"),
        ((n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)).alias("base_failed"))


def shares() -> dict[str, Column]:
    def part(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": part("n_symbols", "word_chars"), "dup_line_share": part("n_dup_lines", "n_lines"),
        "repeat_share": part("n_repeat_words", "n_words"), "upper_share": part("n_upper", "word_chars"),
        "mark_share": part("n_marks", "word_chars"), "mean_word_chars": part("word_chars", "n_words"),
    }


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8."""
    y, down = x + 8, F.lit(0.0)
    for i in range(8):
        down = down + F.log(x + i)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - down  # ln(2 pi) / 2


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k), 1 where k reaches the mean; never below the true value.

    Terms are added from k downwards, where they fall faster than a geometric
    series; past TAIL_TERMS that series bounds the rest, so n may be any size.
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_top = (_log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1)
               + kd * F.log(p) + (nd - kd) * F.log(1 - p))

    def ratio(i: Column) -> Column:
        return i / (nd - i + 1) * ((1 - p) / p)

    steps = F.least(k, F.lit(TAIL_TERMS)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * ratio(kd - j)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    each = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    last = ratio(kd - steps)
    tail = F.aggregate(each, start, add, lambda a: a["total"] + F.when(
        k > TAIL_TERMS, a["term"] * last / (1 - last)).otherwise(F.lit(0.0)))
    return F.when(n <= 0, F.lit(1.0)).when(kd >= nd * p, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.exp(log_top + F.log(tail))))


def cutoffs(counts: DataFrame, labels: DataFrame, limit: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """One row per stratum and rule with an allowed cutoff: stratum, rule, cutoff and the evidence.

    Labels without quality or document are left out; a document labelled more
    than once counts with its best quality.  A labelled document is one trial of
    its stratum however many rows repeat its id: the greatest of their shares
    counts, so it is falsely rejected where any of its rows is.
    """
    marks = (labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("quality").alias("quality")))
    held = counts.join(marks, "doc_id").where(~F.col("base_failed") | (F.col("quality") > 0))
    # How many cutoffs of the grid a document reaches; counts at or above a cutoff are sums over that.
    reached = F.array(*[
        F.struct(F.lit(r).alias("rule"), sum(((F.col("_v")[r] >= c).cast("int") for c in grid), F.lit(0)).alias("level"))
        for r, grid in RULES.items()])
    trials = held.groupBy("stratum", "doc_id", "quality").agg(*[F.max(e).alias(r) for r, e in shares().items()])
    v = F.struct(*RULES)
    flat = (trials.withColumn("_v", v).select("stratum", "quality", F.explode(reached).alias("x"))
            .groupBy("stratum", "x.rule", "x.level")
            .agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"),
                 F.sum((F.col("quality") <= 0).cast("long")).alias("bad")))
    cell = Window.partitionBy("stratum", "rule")
    above = cell.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = F.create_map(*[x for r, g in RULES.items() for x in (F.lit(r), F.array(*[F.lit(float(c)) for c in g]))])
    tested = (flat.withColumn("n_clean", F.sum("good").over(cell))
              .withColumn("false_rejects", F.sum("good").over(above)).withColumn("junk", F.sum("bad").over(above))
              .where("level > 0").withColumn("cutoff", F.get(F.element_at(grid, F.col("rule")), F.col("level") - 1)))
    strata = flat.agg(F.count_distinct("stratum").alias("strata"))  # one row
    alpha = F.lit(limit / len(RULES))
    p = binomial_tail(F.col("false_rejects"), F.col("n_clean"), alpha)
    worth = F.col("junk") - CLEAN_PRICE * F.col("false_rejects")
    allowed = (tested.crossJoin(F.broadcast(strata)).withColumn("p_value", p)
               .where(F.col("p_value") <= F.lit(delta) / (F.col("strata") * len(RULES)))
               .withColumn("worth", worth).where("worth > 0"))
    best = F.max_by(F.struct("cutoff", "p_value", "false_rejects", "n_clean", "junk"), F.struct("worth", "cutoff"))
    return allowed.groupBy("stratum", "rule").agg(best.alias("b")).select("stratum", "rule", "b.*")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed and kept (false if base_failed or a cutoff is reached).

    Null and empty texts have no words and fail the base rule.  A stratum
    without enough labels has no cutoffs, so its documents stay unless the
    base rule rejects them; a null stratum is one of its own.  Empty labels
    leave the base rule alone; an empty table gives an empty result.
    ``row`` names a column that tells rows apart; it is given back as ``_row``.
    """
    counts = materialize(text_counts(docs, text, stratum, row), "quality-counts")
    chosen = (cutoffs(counts, labels).groupBy("stratum")
              .agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]))
    sizes = counts.groupBy("stratum").agg(F.count(F.lit(1)).alias("_rows"))
    per = materialize(sizes.join(chosen, "stratum", "left"), "quality-cutoffs")
    total = per.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    both = join_hot_split(counts, per, "stratum", "_rows", total)
    hit = F.lit(False)
    for r, e in shares().items():
        hit = hit | F.coalesce(e >= F.col(f"cut_{r}"), F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & ~hit)


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document, with cutoffs from all labels."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that the rules keep, whatever their ids."""
    keyed, key = with_row_key(docs, "quality-rows")
    kept = judge(keyed, table(spark, sf_dir, "labels"), row=key).where("kept").select(F.col("_row").alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)
