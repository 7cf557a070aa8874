"""Quality rules: cutoffs with a guaranteed bound on false rejections per stratum.

Each rule rejects a document when a rate (symbols, repeated lines, ...) lies above a cutoff.
The cutoffs are chosen on a labelled holdout of good documents, per stratum: a (stratum,
rule, cutoff) triple with k rejections among n good documents is certified when the exact
binomial tail P(Bin(n, share) <= k) is at most ``delta`` over the number of triples tested
(Bonferroni), and the smallest certified cutoff of each rule is used.  ``share`` is ``alpha``
over the number of rules, so with probability 1 - ``delta`` the rules together reject at most
a share ``alpha`` of the good documents of every stratum.  A stratum with too few labelled
documents gets no cutoff and loses nothing by these rules.

Built from DataFrame functions alone.  Text metrics stay inside a row (no shuffle); only
counts per (stratum, rule, cutoff) and one row per stratum are gathered.

Cases: a null or empty text has no words and fails the base rule.  A null stratum is a stratum
of its own.  A document labelled more than once is good only if all its ratings say so; null
ratings and null ids do not count.  Repeated rows are judged alike.  Without labels only the
base rule acts.  ``judge`` keeps all columns of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_RUN, broadcast_if_small, materialise

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Rates and the fixed grid of cutoffs tried for each, smallest first.
RULES = {
    "symbol_rate": (0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "dup_line_rate": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_word_rate": (0.02, 0.05, 0.1, 0.15),
    "upper_rate": (0.1, 0.2, 0.3, 0.5, 0.7),
}
MAX_BROADCAST_STRATA = 100_000
MAX_BROADCAST_LABELS = 1_000_000


def text_metrics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` plus one struct ``m`` of counts and rates of the text."""
    text = F.coalesce(F.col("__t"), F.lit(""))
    get = F.get
    steps = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)],
                        F.col(f"`{text_col}`").alias("__t"))
    steps = steps.withColumn("__w", F.array_remove(F.split(text, SPACE_RUN), ""))
    n = F.size("__w")
    steps = steps.withColumn("__win", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[get("__w", i + d) for d in range(WINDOW)]))))
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    steps = steps.withColumn("__pairs", F.when(repeats, F.sort_array(F.transform(
        "__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda p, j: F.coalesce(get("__pairs", j)["h"] == p["h"], F.lit(False))
    steps = steps.withColumn("__pos", F.sort_array(F.transform(
        F.filter("__pairs", lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"])))
    covered = F.aggregate(F.transform("__pos", lambda p, j: F.least(
        F.lit(WINDOW), F.coalesce(get("__pos", j + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    steps = steps.withColumn("__lines", F.filter(F.split(text, "\n", -1),
                                                 lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0))
    steps = steps.withColumn("__c", F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper")))
    c = F.col("__c")
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    rate = lambda a, b: c[a] / F.greatest(c[b], F.lit(1))
    m = F.struct(*[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                 failed.alias("base_failed"), rate("n_symbols", "word_chars").alias("symbol_rate"),
                 rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
                 rate("n_repeat_words", "n_words").alias("repeat_word_rate"),
                 rate("n_upper", "word_chars").alias("upper_rate"))
    # A generated column: a filter on it is not pushed below, where it would repeat all the steps.
    return steps.withColumn("m", F.explode(F.array(m))).drop("__t", "__w", "__win", "__pairs", "__pos", "__lines", "__c")


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(Bin(n, share) <= k), exact up to rounding; 1 where k lies above the mean (there the
    tail is no small number), so the summation is no longer than n * share terms."""
    odds = F.log(F.lit(share / (1 - share)))
    start = F.struct((n * F.log(F.lit(1 - share))).alias("t"), F.exp(n * F.log(F.lit(1 - share))).alias("s"))

    def step(a, i):
        t = a["t"] + F.log((n - i + 1) / i.cast("double")) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * share, F.lit(1.0)).otherwise(F.aggregate(terms, start, step, lambda a: a["s"]))


def good_ids(labels: DataFrame) -> DataFrame:
    """``__id`` of the documents that all their ratings call good."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
            .groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("q")).where("q = 1").select("__id"))


def certified_cutoffs(metrics: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang",
                      alpha: float = 0.05, delta: float = 0.05, rules: dict | None = None) -> DataFrame:
    """(stratum, cutoffs): for each stratum a map from rule to its smallest certified cutoff.

    ``metrics`` has ``id_col``, ``stratum`` and the struct ``m``; ``labels`` has doc_id and
    quality (1 is good).  Documents that fail the base rule are outside the guarantee."""
    rules = rules or RULES
    good = good_ids(labels)
    held = (metrics.where(~F.col("m.base_failed"))
            .select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{stratum}`").alias("stratum"),
                    *[F.col("m")[r].alias(r) for r in rules]).join(good, "__id"))
    counts = materialise(held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col(r) > c).cast("long")).alias(f"{r}>{c}") for r, cs in rules.items() for c in cs]), "counts")
    tests = counts.select("stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"`{r}>{c}`").alias("k"))
        for r, cs in rules.items() for c in cs])).alias("t")).select("stratum", "n", "t.*")
    n_tests = counts.count() * sum(map(len, rules.values()))
    share = alpha / len(rules)
    passed = (tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), share))
              .where(F.col("p") * n_tests <= delta))
    best = passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(metrics: DataFrame, cutoffs: DataFrame, stratum: str = "lang", rules: dict | None = None) -> DataFrame:
    """``metrics`` with ``kept``: false where the base rule fails or a rate lies above its
    stratum's cutoff."""
    cut = cutoffs.select(F.col("stratum").alias("__stratum"), F.col("cutoffs").alias("__cut"))
    out = metrics.join(cut, F.col(f"`{stratum}`").eqNullSafe(F.col("__stratum")), "left")
    over = [F.coalesce(F.col("m")[r] > F.try_element_at("__cut", F.lit(r)), F.lit(False)) for r in (rules or RULES)]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return out.withColumn("kept", ~F.col("m.base_failed") & ~rejected).drop("__stratum", "__cut")


def cutoffs_of(metrics: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The certified cutoffs, written once (one row per stratum) and broadcast if few."""
    return broadcast_if_small(materialise(certified_cutoffs(metrics, labels, **how), "cutoffs"), MAX_BROADCAST_STRATA)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    metrics = materialise(text_metrics(docs.select("doc_id", "lang", "text"), keep=["doc_id", "lang"]), "metrics")
    return judge(metrics, cutoffs_of(metrics, labels)).select(
        "doc_id", *[F.col("m")[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                     "n_repeat_words", "base_failed")], "kept")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged.  The cutoffs come from the texts of
    the good labelled documents alone; the verdict is taken beside the text, so no other text moves."""
    good = broadcast_if_small(materialise(good_ids(labels), "good"), MAX_BROADCAST_LABELS)
    held = docs.select("doc_id", "lang", "text").join(good, F.col("doc_id") == F.col("__id"), "left_semi")
    cutoffs = cutoffs_of(materialise(text_metrics(held, keep=["doc_id", "lang"]), "metrics"), labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.text").alias("text"), F.col("row.lang").alias("lang"))
    return judge(text_metrics(rows, keep=["row", "lang"]), cutoffs).where("kept").select("row.*")
