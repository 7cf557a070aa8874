"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its target share of the output over its size.  A
document's number of copies is the Poisson distribution of that rate, inverted at a uniform
number hashed from (seed, document id): no state, no order, the same for any partitioning.
Documents are exploded by their count and every copy is dealt by a hash of its own, so the
output is a global random order: a random partition, and a random place inside it.

Sizes are counted in characters of the whole texts.  Target weights are given per source or,
by default, are size to the power ``alpha`` (below 1 lifts small sources).  ``target`` is the
expected size of the output in characters (default: that of the input).

Cases: a null source is a source of its own; a null or empty text has size 0; a source that
holds no characters has no rate and keeps each document once.  Null ids share one random
number; repeated rows get equal counts.  A source without a given weight gets none and is left
out (its rate is 0).  An empty table gives no rows.  All columns are kept; ``copy``,
``copies`` and ``shuffle_key`` are added (an input column of that name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, materialise

MAX_BROADCAST_SOURCES = 100_000


def hashed_hex(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def uniform(*parts) -> Column:
    """A number in [0, 1) with 52 random bits."""
    return F.conv(F.substring(hashed_hex(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until what is left is below a double's precision.  Terms are
    kept as logarithms, so large rates do not underflow."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("t"), F.exp(-rate).alias("s"), F.array(F.exp(-rate)).alias("cdf"))

    def step(a, k):
        t = a["t"] + F.log(rate / k)
        s = a["s"] + F.exp(t)
        return F.struct(t.alias("t"), s.alias("s"), F.array_append(a["cdf"], s).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"])).otherwise(
        F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict | None = None,
                 alpha: float = 0.7, target: float | None = None) -> DataFrame:
    """(source, size, rate): one row per source, written once."""
    size = F.char_length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    sizes = materialise(docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum(size).alias("size")), "sizes")
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weight = F.when(F.col("size") > 0, weight).otherwise(0.0)
    whole = sizes.agg(F.sum(weight), F.sum("size")).first()
    total, goal = whole[0] or 1.0, float(target if target is not None else whole[1] or 0)
    rate = F.when(F.col("size") > 0, goal * (weight / total) / F.col("size")).otherwise(1.0)
    return sizes.withColumn("rate", rate)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: dict | None = None, alpha: float = 0.7, target: float | None = None, seed: int = 42,
        names: tuple[str, str, str] = ("copy", "copies", "shuffle_key")) -> DataFrame:
    """The copies of every document, globally shuffled, with copy (from 1), copies and shuffle_key; ``names``
    gives these columns other names (they replace columns of ``docs`` that have the same)."""
    rates = materialise(source_rates(docs, source_col, text_col, weights, alpha, target)
                        .select(F.col("source").alias("__source"), F.col("size").alias("__size"),
                                poisson_cdf(F.col("rate")).alias("__cdf")), "rates")
    copy, copies, shuffle_key = names
    own = [c for c in docs.columns if c not in names]
    u = uniform(F.lit(seed), F.col(f"`{id_col}`"))
    counted = (docs.join(broadcast_if_small(rates, MAX_BROADCAST_SOURCES),
                         F.col(f"`{source_col}`").eqNullSafe(F.col("__source")))
               .withColumn("__u", u)
               .withColumn(copies, F.when(F.col("__size") == 0, 1).otherwise(
                   F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))))))
    each = counted.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return (each.select(*[F.col(f"`{c}`") for c in own], copy, copies,
                        hashed_hex(F.lit(seed), F.col(f"`{id_col}`"), F.col(copy)).alias(shuffle_key))
            .repartition(shuffle_key).sortWithinPartitions(shuffle_key))
