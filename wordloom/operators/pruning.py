"""Pruning of n-gram tables: by count, or by what an n-gram's probability adds to that of the order below."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.language import NONE
from wordloom.session import durable

from .ngrams import ORDER, backed_off, discounts, modelled


def by_count(grams: DataFrame, least: dict[int, int], order: int = ORDER) -> DataFrame:
    """grams without those seen less than least[n] times that no longer n-gram starts with.

    From the longest on: an n-gram stays if it is frequent or some longer one that stays begins with it,
    so one equi-join for each order suffices. Unigrams stay.
    """
    kept = grams.where((F.col("n") == order) & (F.col("cnt") >= least.get(order, 0)))
    out = [kept]
    for n in range(order - 1, 1, -1):
        words = [f"w{k}" for k in range(1, n + 1)]
        heads = kept.select(*words).distinct().withColumn("goes_on", F.lit(True))
        kept = durable(grams.where(F.col("n") == n).join(heads, words, "left").where((F.col("cnt") >= least.get(n, 0)) | F.col("goes_on")).select(*grams.columns))
        out.append(kept)
    return reduce(DataFrame.unionByName, [*out, grams.where("n = 1")] if order > 1 else out)


def by_difference(grams: DataFrame, threshold: float, raw: bool = False, order: int = ORDER, fixed: float | None = None) -> DataFrame:
    """grams without those for which p * (ln p - ln q) is at most the threshold, and what begins with them.

    p and q are the probabilities of an n-gram and of its last n - 1 words: back-off ones, or shares of one
    order if raw. Orders are pruned from the longest on, discounts and probabilities as of what is left then:
    as those of an order don't depend on longer n-grams, they are found once.
    """
    if threshold <= 0:
        return grams
    freq, of = modelled(grams, durable(discounts(grams, fixed=fixed)), order)
    if raw:
        rows = freq.withColumn("p", F.col("prob"))
    else:
        rows = backed_off(freq, of, order)
    worth, gone = F.col("p") * (F.log("p") - F.log("q")), {}
    for n in range(2, order + 1):
        words = [f"w{k}" for k in range(1, n + 1)]
        own = rows.where(F.col("n") == n)
        # All orders are whole, so the last n - 1 words are an n-gram of their own, whose p is at hand if backed off.
        if raw:
            low = rows.where(F.col("n") == n - 1).select(*[F.col(f"w{k}").alias(f"w{k + 1}") for k in range(1, n)], F.col("p").alias("q"))
            own = own.join(low, words[1:], "left")
        else:
            own = own.withColumn("q", F.col("low"))
        own = durable(own.select(*words, "cnt", F.coalesce(worth <= threshold, F.lit(False)).alias("gone")))
        gone[n] = own
    # An n-gram goes if it or any of its beginnings of two words or more does.
    out = [grams.where("n = 1")]
    for n in range(2, order + 1):
        left = gone[n].where("not gone")
        for k in range(n - 1, 1, -1):
            words = [f"w{i}" for i in range(1, k + 1)]
            left = left.join(gone[k].where("gone").select(*words), words, "left_anti")
        left = left.select(F.lit(n).cast(grams.schema["n"].dataType).alias("n"), *[F.col(f"w{k}") if k <= n else F.lit(NONE).alias(f"w{k}") for k in range(1, order + 1)], "cnt")
        out.append(left.select(*grams.columns))
    return durable(reduce(DataFrame.unionByName, out))
