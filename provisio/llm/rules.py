"""Quality rules with risk-controlled thresholds, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Separators of words, and symbols that count.
SEPARATORS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"

#: Rejecting RISK or more of a stratum's good documents, by all rules together, is what certified cutoffs rule out, with CONFIDENCE over all strata.
RISK, CONFIDENCE = 0.02, 0.95
#: A share of good documents lost weighs so many times a share of bad ones caught when cutoffs are chosen.
COST = 5
#: Shares of good documents that a single rule may lose, in the half of the labels that proposes cutoffs: from the mildest to the strictest proposal.
LEVELS = (0.0, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02)
#: A table of so many strata is broadcast; a larger one is joined.
BROADCAST_STRATA = 10_000
#: Capital letters that count: fixed values.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u00c0\u00c1\u00c2\u00c3\u00c4\u00c5\u00c6\u00c7\u00c8\u00c9\u00ca\u00cb\u00cc\u00cd\u00ce\u00cf\u00d0\u00d1\u00d2\u00d3\u00d4\u00d5\u00d6\u00d8\u00d9\u00da\u00db\u00dc\u00dd\u00de\u1e9e"
#: A rule rejects where its value is over the cutoff; these cutoffs are tried. Values are parts in a thousand, integers so that they are exact.
GRID = (5, 10, 20, 30, 40, 50, 60, 80, 100, 120, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900, 950)
#: value name: expression over the base counts.
RULES = {
    "symbols": "1000 * n_symbols DIV greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines DIV greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words DIV greatest(n_words, 1)",
    "upper": "1000 * n_upper DIV greatest(word_chars, 1)",
    "marks": "1000 * n_marks DIV greatest(n_words, 1)",
}


def _windows(words: Column, size: int) -> Column:
    """64-bit hashes of the windows of that many words, in order."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def base_counts(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """All columns of docs with the counts that rules use; nothing is shuffled. A null text counts as empty; columns of the same names are replaced.

    Words in windows found twice or more: hashes of the windows are sorted with their places, so that equal ones stand side by
    side (only in texts that have any); the places found, sorted again, cover runs of words. That is n log n for any text.
    """
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_w", F.filter(F.split("_t", WORD_SPLIT), lambda w: w != ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0))
    d = d.withColumn("_h", _windows(F.col("_w"), window))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = F.filter("_s", lambda x, k: F.coalesce(F.get(F.col("_s"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("_s"), k + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("_p", F.array_sort(F.transform(twin, lambda x: x["i"])))
    gaps = F.transform("_p", lambda x, k: F.least(F.lit(window), F.coalesce(F.get(F.col("_p"), k + 1) - x, F.lit(window))))
    length = F.length("_t")
    return (
        d.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.translate("_t", SEPARATORS, "")).cast("long"))
        .withColumn("n_symbols", (length - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_l").cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
        .withColumn("n_marks", (length - F.length(F.translate("_t", "!?|", ""))).cast("long"))
        .withColumn("n_upper", (length - F.length(F.translate("_t", CAPITALS, ""))).cast("long"))
        .withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
        .drop("_t", "_w", "_l", "_h", "_s", "_p")
    )


def _certified(k: Column, n: Column, tests: Column) -> Column:
    """Whether P(Binomial(n, RISK) <= k), the exact level at which 'the rate is RISK or more' is rejected, is within the corrected error."""
    odds = F.log(F.lit(RISK / (1 - RISK)))
    first = n * F.log(F.lit(1 - RISK))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_p = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda a: a["total"])
    return F.when((n == 0) | (k >= n * RISK), False).otherwise(log_p <= F.log(F.lit(1 - CONFIDENCE) / tests))


def _over(cutoffs: Column) -> list[Column]:
    """By rule, whether the value is over its cutoff (no cutoff: not)."""
    return [F.coalesce(F.col(name) > cutoffs[name], F.lit(False)) for name in RULES]


def _with_strata(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with a table of one row a stratum, which is broadcast if its size allows."""
    small = table.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    return rows.join(F.broadcast(table) if small else table, "stratum", "left")


def proposals(own: DataFrame) -> DataFrame:
    """stratum, proposed: for each of LEVELS the cutoffs by rule, from labelled rows (stratum, good, RULES' columns).

    Of the cutoffs with which the rule alone loses no more than that share of good documents, the one that separates best; none where no
    cutoff catches enough bad ones.
    """
    long = own.select("stratum", "good", F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "value"))
    at_least = F.size(F.filter(F.array(*map(F.lit, GRID)), lambda c: F.col("value") > c))  # value is over the first so many cutoffs
    grouped = long.groupBy("stratum", "rule", at_least.alias("over")).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    # a few numbers for each stratum and rule from here on: len(GRID) + 1 rows at most
    each = grouped.groupBy("stratum", "rule").agg(F.collect_list(F.struct("over", "good", "bad")).alias("rows"), F.greatest(F.sum("good"), F.lit(1)).alias("n_good"), F.greatest(F.sum("bad"), F.lit(1)).alias("n_bad"))
    total = lambda name, i: F.aggregate(F.filter("rows", lambda r: r["over"] > i), F.lit(0).cast("long"), lambda a, r: a + r[name])
    cuts = F.transform(F.sequence(F.lit(0), F.lit(len(GRID) - 1)), lambda i: F.struct((total("bad", i) / F.col("n_bad") - COST * total("good", i) / F.col("n_good")).alias("gain"), F.element_at(F.array(*map(F.lit, GRID)), i + 1).alias("cutoff"), (total("good", i) / F.col("n_good")).alias("lost")))
    each = each.withColumn("cuts", F.filter(cuts, lambda c: c["gain"] > 0))
    within = lambda share: F.filter("cuts", lambda c: c["lost"] <= share)
    best = F.array(*[F.array_max(within(share))["cutoff"] for share in LEVELS])
    by_level = each.select("stratum", "rule", F.posexplode(best).alias("level", "cutoff")).groupBy("stratum", "level").agg(F.struct(*[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(name) for name in RULES]).alias("cutoffs"))
    return by_level.groupBy("stratum").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "cutoffs"))), lambda x: x["cutoffs"]).alias("proposed"))


def thresholds(values: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, cutoffs (by rule), false_rejections, n_good, caught, n_bad: of the certified proposals, the one that separates best.

    values has doc_id, stratum and RULES' columns. Half of the labelled documents propose cutoffs of all rules at once, from mild to strict;
    on the other half each proposal is tested, in that order, until one fails: an exact binomial test of the share of good documents that
    any of the rules rejects. The order was fixed before, so the sequence needs no correction; among strata the error is divided
    (Bonferroni). So with CONFIDENCE over all strata, no certified verdict rejects RISK or more of its stratum's good documents. Strata with too few labels
    get no cutoffs, hence no rejection. Contradicting labels of a document count as bad.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("good"))
    own = staged(values.select("doc_id", "stratum", *RULES).join(known, F.col("doc_id") == F.col("_id")).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))), "labelled")
    tested = _with_strata(own.where("half = 1"), proposals(own.where("half = 0"))).where("proposed IS NOT NULL")
    hit = [F.reduce(F.array(*_over(F.get("proposed", F.lit(i)))), F.lit(False), lambda a, x: a | x) for i in range(len(LEVELS))]
    sums = [F.sum(F.when(h, F.col("good")).otherwise(0)).alias(f"k{i}") for i, h in enumerate(hit)] + [F.sum(F.when(h, 1 - F.col("good")).otherwise(0)).alias(f"c{i}") for i, h in enumerate(hit)]
    each = tested.groupBy("stratum").agg(F.first("proposed").alias("proposed"), F.sum("good").alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad"), *sums)
    strata = own.select("stratum").distinct().count()
    steps = F.array(*[F.struct(F.col(f"k{i}").alias("k"), F.col(f"c{i}").alias("caught"), F.get("proposed", F.lit(i)).alias("cutoffs")) for i in range(len(LEVELS))])
    cut = each.select("stratum", "n_good", "n_bad", F.posexplode(steps).alias("i", "c"))
    judged = cut.withColumn("pass", _certified(F.col("c.k"), F.col("n_good"), F.lit(float(max(strata, 1)))))
    failed = F.coalesce(F.min(F.when(~F.col("pass"), F.col("i"))).over(Window.partitionBy("stratum")), F.lit(len(LEVELS)))
    gain = F.col("c.caught") / F.greatest(F.col("n_bad"), F.lit(1)) - COST * F.col("c.k") / F.greatest(F.col("n_good"), F.lit(1))
    best = judged.withColumn("failed", failed).where("i < failed").groupBy("stratum", "n_good", "n_bad").agg(F.max_by("c", F.struct(gain, -F.col("i"))).alias("b"))
    return best.select("stratum", "b.cutoffs", F.col("b.k").alias("false_rejections"), "n_good", "b.caught", "n_bad")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed, failed_rules and kept for every row of docs.

    A null or missing stratum is one of its own. Empty texts fail the base rule, which is fixed and no part of the certified risk. Repeated rows give repeated results.
    """
    where = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    counted = base_counts(docs.select("doc_id", "text", where.alias("stratum"))).drop("text")
    values = staged(counted.select("*", *[F.expr(e).alias(name) for name, e in RULES.items()]), "rules")
    cutoffs = staged(thresholds(values, labels).select("stratum", "cutoffs"), "cutoffs")
    over = [F.when(o, F.lit(name)) for name, o in zip(RULES, _over(F.col("cutoffs")), strict=True)]
    judged = _with_strata(values, cutoffs).withColumn("failed_rules", F.array_compact(F.array(*over)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("cutoffs")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, with cutoffs certified per language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return apply_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
