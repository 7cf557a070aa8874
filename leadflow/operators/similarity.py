"""Fuzzy name matching as an exact, prefix-filtered similarity join.

Score (see ``functions.text``): greatest(character score, token score) >= cutoff.
A pair can pass in two ways, and each has a classic filter with a proof of exactness:

* character path - ``100 * (1 - d / L) >= c`` with L the longer length, so the edit
  distance d is at most ``slack * L`` (slack = 1 - c/100) and the lengths differ by at most
  d.  Two strings within distance d share at least ``L + 2 - 3d`` padded trigrams (counted
  with multiplicity: each edit touches at most three).  By the prefix-filter lemma, with all
  trigrams in one global order, two sets sharing >= a elements meet within their first
  ``|set| - a + 1`` elements, which is at most ``3 * floor(slack * len / (1 - slack)) + 1``
  for a string of length ``len``.
* token path - containment (the words of one name all in the other) or word Jaccard >= c/100.
  Containment means the contained name's rarest word is in the other name; Jaccard >= t means
  the two ``|W| - ceil(t |W|) + 1`` rarest-word prefixes meet.

Tokens are ordered rare-first by their frequency among the known names (the pool), so a
token shared by many names (a common word, the trigram '##r') is almost never in a prefix:
each string joins on a handful of rare tokens, and no group emits all its pairs.  Query
tokens that no name has cannot be shared; they drop out and shorten the query's prefixes
by their count.  The exact score is computed only on the surviving candidate pairs.

The result itself is bounded only by the score rule: containment scores 100, so a one-word
name pairs with every query that holds the word, and a one-word query with every such name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import written
from .masking import keep_policies, open_column

EPS = 1e-9


def _tokens(df: DataFrame, id_col: str, norm_col: str) -> DataFrame:
    """(id, s, len, n_all, kind, tok): every token of every string; ``n_all`` is the
    string's number of tokens of that kind before any are dropped."""
    base = df.select(F.col(id_col).alias("id"), F.col(norm_col).alias("s"),
                     TX.padded_grams(F.col(norm_col)).alias("grams"), TX.word_tokens(F.col(norm_col)).alias("wt"))
    toks = F.concat(TX.numbered_grams("grams"), F.col("wt"))
    return (base.select("id", "s", F.length("s").alias("len"), F.size("grams").alias("n_g"),
                        F.size("wt").alias("n_w"), F.explode(toks).alias("tok"))
            .withColumn("kind", F.substring("tok", 1, 1))
            .withColumn("n_all", F.when(F.col("kind") == "g", F.col("n_g")).otherwise(F.col("n_w")))
            .drop("n_g", "n_w"))


def _roles(tokens: DataFrame, freq: DataFrame, side: str, grow: float, t: float) -> DataFrame:
    """Each token row tagged with the join roles it plays; one row per (token, role).

    A: query's rarest word  <-> any word of the name       (query contained in the name)
    B: any word of the query <-> name's rarest word        (name contained in the query)
    C: Jaccard prefix words on both sides
    D: trigram prefixes on both sides (with the length band in the join condition)
    Ranks follow the global rare-first order (frequency, then token).  Tokens missing from
    ``freq`` (a query token no name has) drop out; ``dropped`` counts them, and since they
    can never be shared every bound below is reduced by it: a query with a dropped word
    cannot be contained in any name (no role A), and its prefixes shrink accordingly."""
    w = Window.partitionBy("id", "kind")
    r = (tokens.join(freq, "tok")
         .withColumn("rk", F.row_number().over(w.orderBy("n", "tok")))
         .withColumn("dropped", F.col("n_all") - F.count(F.lit(1)).over(w)))
    is_w, is_g = F.col("kind") == "w", F.col("kind") == "g"
    rk, n_all, dropped = F.col("rk"), F.col("n_all"), F.col("dropped")
    first = is_w & (rk == 1)
    whole_first = first & (dropped == 0)
    jpref = is_w & (rk <= n_all - F.ceil(n_all * F.lit(t) - F.lit(EPS)) + 1 - dropped)
    gpref = is_g & (rk <= F.floor(F.col("len") * F.lit(grow) + F.lit(EPS)) * 3 + 1 - dropped)
    a, b = (whole_first, is_w) if side == "q" else (is_w, first)
    roles = F.array(F.when(a, F.lit("A")), F.when(b, F.lit("B")), F.when(jpref, F.lit("C")), F.when(gpref, F.lit("D")))
    return r.select(F.col("tok"), F.col("id").alias(f"{side}_id"), F.col("s").alias(f"{side}_s"),
                    F.col("len").alias(f"{side}_len"),
                    F.explode(F.filter(roles, lambda x: x.isNotNull())).alias("role"))


def candidate_pairs(queries: DataFrame, pool: DataFrame, cutoff: float) -> DataFrame:
    """Distinct (q_id, q_norm, name, p_norm) pairs that survive the prefix filters: a
    superset of the pairs scoring >= cutoff (cutoff from 67 to 100).

    The character-path bound needs ``L + 2 - 3d >= 1``, which holds for every accepted
    pair when cutoff >= 67 (slack <= 1/3); lower cut-offs are refused."""
    if not 67 <= cutoff <= 100:
        raise ValueError("the prefix filter is exact for cut-offs from 67 to 100")
    slack = 1.0 - float(cutoff) / 100.0
    grow = slack / (1.0 - slack)
    t = float(cutoff) / 100.0

    qt = _tokens(queries, "q_id", "q_norm")
    # the pool is made and tokenised once; frequencies and roles read the written tokens
    pt = written(keep_policies(_tokens(pool, "name", "p_norm")), "pool_tokens")
    # Token frequencies over the pool (partial aggregation; one row per distinct token) give
    # the global order; query tokens the pool lacks drop out in the inner join of _roles.
    freq = pt.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    q = _roles(qt, freq, "q", grow, t)
    p = _roles(pt, freq, "p", grow, t)
    band = F.abs(q["q_len"] - p["p_len"]) <= F.lit(slack) * F.greatest(q["q_len"], p["p_len"]) + F.lit(EPS)
    cond = (q["tok"] == p["tok"]) & (q["role"] == p["role"]) & ((q["role"] != F.lit("D")) | band)
    return (q.join(p, cond)
            .select(F.col("q_id"), F.col("q_s").alias("q_norm"), F.col("p_id").alias("name"),
                    F.col("p_s").alias("p_norm"))
            .distinct())


def fuzzy_pairs(queries: DataFrame, pool: DataFrame, cutoff: float) -> DataFrame:
    """All pairs with ``similarity >= cutoff`` (cutoff from 67 to 100).

    ``queries``: (q_id, q_norm); ``pool``: (name, p_norm).  Returns
    (q_id, q_norm, name, p_norm, score)."""
    pairs = candidate_pairs(queries, pool, cutoff)
    with_words = pairs.select("*", TX.words("q_norm").alias("_qw"), TX.words("p_norm").alias("_pw"))
    scored = with_words.select("q_id", "q_norm", "name", "p_norm",
                               open_column(TX.similarity("q_norm", "p_norm", "_qw", "_pw"), "score"))
    return scored.where(F.col("score") >= F.lit(float(cutoff)))


def with_guard_columns(pairs: DataFrame) -> DataFrame:
    """Adds the trigram and word arrays the guards read, computed once per pair."""
    return pairs.select("*", TX.trigrams("q_norm").alias("_qtri"), TX.trigrams("p_norm").alias("_ptri"),
                        TX.words("q_norm").alias("_qwords"))


def trigram_guard(q_norm: str = "q_norm", p_norm: str = "p_norm"):
    """Queries of 5+ letters whose first letter differs from the name's need a shared trigram.
    Reads the ``_qtri`` / ``_ptri`` columns of ``with_guard_columns``."""
    q, p = F.col(q_norm), F.col(p_norm)
    qt, pt = F.col("_qtri"), F.col("_ptri")
    needs = (F.length(q) >= 5) & (F.substring(p, 1, 1) != F.substring(q, 1, 1))
    shares = (F.size(qt) > 0) & (F.size(F.array_intersect(qt, pt)) > 0)
    return ~needs | shares


def single_word_guard(q_norm: str = "q_norm", p_norm: str = "p_norm"):
    """A one-word query must be contained in the name.  Reads ``_qwords``."""
    q, p = F.col(q_norm), F.col(p_norm)
    return (F.size(F.col("_qwords")) != 1) | p.contains(q)
