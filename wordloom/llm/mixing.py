"""Mixing sources to target weights by iterative proportional fitting. [native]

Documents fall into cells of source, language and topic; a cell weighs its tokens. Raking scales the
cells to the target share of each source, then of each language, then of each topic, and again, until
all marginals hold. A cell's fitted weight over its tokens, times one factor for all cells, is how often
each of its documents is wanted; up to 1 it is the probability with which it is drawn, by a hash of its id
and text. The factor is such that BUDGET of the tokens are drawn, or more where that leaves no cell short.
A cell whose documents are wanted more than once falls short: all of it is kept, nothing is repeated, and
`wanted` says by how much.

By default the targets are the present shares raised to the power SMOOTH and made to sum to one, which
lifts rare sources, languages and topics. Topic is what `topic_of` says of the text, for there is no
such column.

Defined results. Null in source or lang is a value like others. A text without words weighs nothing
and is dropped with probability 1 - that of its cell; in a cell without tokens none is kept. Targets
for values that don't occur are spread over those that do; values without a target get none. Repeated
rows are drawn alike. Extra columns are kept by sampled(); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, release

DIMENSIONS = ("source", "lang", "topic")
#: Power of the present shares that the default targets are; rounds, and the error that ends them.
SMOOTH, ROUNDS, CLOSE = 0.7, 30, 1e-6
#: Share of the tokens, of those that have a target, that is drawn at least.
BUDGET = 0.5
#: Most cells that are raked in one partition, and rounds that make one job there.
PART, AT_ONCE = 50_000, 5


def words_in(text: Column) -> Column:
    """How many runs of other characters than space and the controls from tab to carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """`listing` where lines are short, `figures` where digits are many, `symbols`, else `prose`."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    digits = F.length(F.translate(text, "0123456789", "")) - F.length(text)
    marks = F.length(F.translate(text, "|#$%&*<>{}[]=+~^_", "")) - F.length(text)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(-digits / size > 0.1, "figures").when(-marks / size > 0.02, "symbols").when(size / lines < 60, "listing").otherwise("prose")


def weighed(docs: DataFrame) -> DataFrame:
    """docs' cells: source, lang, topic, tokens; written down, so that texts are read once for all rounds."""
    cells = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic_of(F.col("text")).alias("topic"), words_in(F.col("text")).alias("tokens"))
    return durable(cells.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))


def default_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """For each dimension (value, share)."""
    out = {}
    for d in DIMENSIONS:
        power = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow("t", F.lit(SMOOTH)))
        out[d] = durable(power.crossJoin(F.broadcast(power.agg(F.sum("p").alias("all")))).select("value", (F.col("p") / F.col("all")).alias("share")))
    return out


def raked(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """cells with `fitted`, their share of the mixture.

    Up to PART cells, which is the rule, lie in one partition, where sums by window need no shuffle and
    several rounds make one job. More of them are raked by factors of values, whose sums are
    pre-aggregated.
    """
    cells = durable(cells.where("tokens > 0"))
    n = cells.count()
    for d in DIMENSIONS:
        present = cells.select(F.col(d).alias("of")).distinct()
        goal = present.join(targets[d], present["of"].eqNullSafe(targets[d]["value"]), "left").select("of", F.coalesce("share", F.lit(0.0)).alias("share"))
        goal = goal.crossJoin(F.broadcast(goal.agg(F.sum("share").alias("all")))).select("of", F.when(F.col("all") > 0, F.col("share") / F.col("all")).otherwise(0.0).alias(f"goal_{d}"))
        cells = durable(cells.join(goal, cells[d].eqNullSafe(goal["of"])).drop("of"))
    fit = cells.withColumn("fitted", F.col("tokens").cast("double"))
    if n:
        fit = _raked_together(fit) if n <= PART else _raked_by_factors(fit)
    return fit.drop(*[f"goal_{d}" for d in DIMENSIONS])


def _step(goal: Column, now: Column) -> Column:
    return F.when(now > 0, goal / now).otherwise(0.0)


def _raked_together(fit: DataFrame) -> DataFrame:
    for _ in range(0, ROUNDS, AT_ONCE):
        fit = fit.coalesce(1)
        for _ in range(AT_ONCE):
            off = F.lit(0.0)
            for d in DIMENSIONS:
                fit = fit.withColumn(f"by_{d}", F.sum("fitted").over(W.partitionBy(d))).withColumn(f"by_{d}", _step(F.col(f"goal_{d}"), F.col(f"by_{d}")))
                fit = fit.withColumn("fitted", F.col("fitted") * F.col(f"by_{d}"))
                off = F.greatest(off, F.when(F.col("fitted") > 0, F.abs(F.col(f"by_{d}") - 1)).otherwise(0.0))
        fit = durable(fit.withColumn("off", off).drop(*[f"by_{d}" for d in DIMENSIONS]))
        worst = fit.agg(F.max("off")).first()[0]
        fit = fit.drop("off")
        if worst < CLOSE:
            break
    return fit


def _raked_by_factors(fit: DataFrame) -> DataFrame:
    """A value's factor is its target over the sum of its cells' tokens times their factors in the other
    dimensions. Each step writes the factors of one dimension, by a plan that doesn't grow."""
    factors = {d: durable(fit.groupBy(F.col(d).alias("value")).agg(F.max(f"goal_{d}").alias("goal"), F.lit(1.0).alias("by"))) for d in DIMENSIONS}

    def times(rows: DataFrame, d: str) -> DataFrame:
        by = factors[d].select("value", "by")
        return rows.join(by, rows[d].eqNullSafe(by["value"])).withColumn("fitted", F.col("fitted") * F.col("by")).drop("value", "by")

    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            rows = fit
            for other in DIMENSIONS:
                rows = rows if other == d else times(rows, other)
            now = rows.groupBy(F.col(d).alias("of")).agg(F.sum("fitted").alias("now"))
            now = factors[d].join(now, F.col("value").eqNullSafe(F.col("of"))).withColumn("step", _step(F.col("goal"), F.col("now")))
            off = F.when((F.col("step") > 0) & (F.col("by") > 0), F.abs(F.col("step") / F.col("by") - 1)).otherwise(0.0)
            found = durable(now.select("value", "goal", F.col("step").alias("by"), off.alias("off")))
            worst = max(worst, found.agg(F.max("off")).first()[0])
            factors[d] = found.drop("off")
        release(fit.sparkSession)
        if worst < CLOSE:
            break
    for d in DIMENSIONS:
        fit = times(fit, d)
    return durable(fit)


def _factor(fit: DataFrame, budget: float) -> float:
    """The factor of fitted with which min(tokens, factor * fitted) sums to the budget, or the one that fills
    the first cell, if larger.

    The sum is concave and piecewise linear in the factor: Newton's steps come from below and end on it.
    """
    first = fit.where("fitted > 0").agg(F.min(F.col("tokens") / F.col("fitted")).alias("factor"), F.sum("tokens").alias("tokens")).first()
    if first.factor is None:
        return 0.0
    factor, goal = first.factor, budget * first.tokens
    while True:
        full = F.col("fitted") * factor >= F.col("tokens")
        now = fit.where("fitted > 0").agg(F.sum(F.when(full, F.col("tokens")).otherwise(F.col("fitted") * factor)).alias("sum"), F.sum(F.when(~full, F.col("fitted"))).alias("slope")).first()
        if not now.slope or now.sum >= goal * (1 - CLOSE):
            return factor
        factor += (goal - now.sum) / now.slope


def rates(cells: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """cells with `fitted`, `wanted`, how often a document of the cell is wanted, and `rate`, the probability
    with which it is drawn."""
    fit = raked(cells, targets or default_targets(cells))
    wanted = F.col("fitted") / F.col("tokens") * F.lit(_factor(fit, budget))
    full = wanted >= 1 - 1e-12
    return durable(fit.withColumn("wanted", wanted).withColumn("rate", F.when(full, 1.0).otherwise(wanted)))


def drawn(docs: DataFrame, cells: DataFrame, seed: int = 1) -> DataFrame:
    """docs with topic, tokens, wanted, rate and kept."""
    out = docs.withColumn("topic", topic_of(F.col("text"))).withColumn("tokens", words_in(F.col("text")))
    r = F.broadcast(cells.select(*[F.col(d).alias(f"of_{d}") for d in DIMENSIONS], "wanted", "rate")) if cells.count() <= 100_000 else cells.select(*[F.col(d).alias(f"of_{d}") for d in DIMENSIONS], "wanted", "rate")
    on = [F.col(d).cast("string").eqNullSafe(F.col(f"of_{d}")) for d in DIMENSIONS]
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) / F.lit(float(1 << 53))
    out = out.join(r, on[0] & on[1] & on[2], "left").drop(*[f"of_{d}" for d in DIMENSIONS])
    return out.fillna(0.0, ["wanted", "rate"]).withColumn("kept", chance < F.col("rate"))


def mixture(docs: DataFrame, seed: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, wanted, rate, kept."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    return drawn(slim, rates(weighed(docs)), seed).select("doc_id", "source", "lang", "topic", "tokens", "wanted", "rate", "kept")


def sampled(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The drawn rows of docs, all columns kept."""
    whole = docs.select("doc_id", "text", "source", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return drawn(whole, rates(weighed(docs)), seed).where("kept").select("doc.*")
