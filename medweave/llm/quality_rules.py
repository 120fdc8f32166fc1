"""Quality rules: statistics of whole texts, and a decision list learned from labelled statistics.

Everything on the way of the documents is a built-in expression. The list is learned by sequential covering:
a rule starts empty, takes the threshold on one statistic that gains most (FOIL's measure) again and again, is
then cut back to the prefix that does best on rows kept apart, and the rows it covers are taken out. All labelled
rows count at every step; a step brings one number per statistic and bin to the driver.

NULL and empty texts have no words and fail the base rule. Labels that are NULL, or for documents that are not
there, are not used; several labels of one document count each. Without labels the list is empty and keeps everything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from medweave.llm.common import SPACES, query, settle_texts, table, unused
from medweave.session import settle

GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# What thresholds are set on; no counts that grow with the text alone, but for its length in words.
FEATURES = (
    "n_words", "word_length", "symbol_share", "repeat_share", "dup_line_share", "line_words",
    "upper_share", "digit_share", "mark_share", "bar_share", "distinct_share",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is named in it."""
    return F.transform(F.array(value), body)[0]


def repeated(hashes: Column) -> Column:
    """Words in windows found at least twice, from the hash of each window in text order."""

    def covered(sorted_windows: Column) -> Column:
        def same(k: Column, d: int) -> Column:
            return F.coalesce(F.get(sorted_windows, k)["h"] == F.get(sorted_windows, k + d)["h"], F.lit(False))

        twice = F.filter(F.sequence(F.lit(0), F.size(sorted_windows) - 1), lambda k: same(k, -1) | same(k, 1))
        places = F.sort_array(F.transform(twice, lambda k: F.get(sorted_windows, k)["at"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
        step = lambda done, at: F.struct((done["n"] + F.least(F.lit(3).cast("long"), at - done["last"])).alias("n"), at.alias("last"))
        return F.aggregate(places, start, step, lambda done: done["n"])

    numbered = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.cast("long").alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(numbered, covered))


def text_statistics(text: Column) -> Column:
    """Struct of the counts of ``COUNTS`` and what ``FEATURES`` are made from."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    body = F.btrim(own, F.lit(SPACES))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, GAP))
    lines = F.filter(F.split(own, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    number = lambda c: c.cast("long")

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda k: F.xxhash64(F.get(w, k), F.get(w, k + 1), F.get(w, k + 2)))
        return F.struct(
            number(F.size(w)).alias("n_words"),
            F.array_join(w, "").alias("joined"),
            F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(windows, repeated)).alias("n_repeat_words"),
            number(F.size(F.array_distinct(w))).alias("n_distinct"),
        )

    def of_joined(w: Column) -> Column:
        count = lambda pattern: number(F.regexp_count(w["joined"], F.lit(pattern)))
        return F.struct(
            w["n_words"].alias("n_words"), number(F.char_length(w["joined"])).alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"),
            w["n_repeat_words"].alias("n_repeat_words"), w["n_distinct"].alias("n_distinct"),
            count(r"\p{Lu}").alias("n_upper"), count(r"\d").alias("n_digits"), count(r"[!?]").alias("n_marks"), count(r"\|").alias("n_bars"),
        )

    def of_lines(x: Column) -> Column:
        n = number(F.size(x))
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    return F.struct(let(let(words, of_words), of_joined).alias("w"), let(lines, of_lines).alias("x"))


def statistics(df: DataFrame, text: str = "text", result: str = "stats") -> DataFrame:
    """``df`` with the struct ``result`` of statistics and features of ``text``."""
    (own,) = unused(df, "_stats")
    df = df.withColumn(own, text_statistics(F.col(text)))
    w, x = F.col(own)["w"], F.col(own)["x"]
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    features = {
        "word_length": share(w["word_chars"], w["n_words"]), "symbol_share": share(w["n_symbols"], w["word_chars"]),
        "repeat_share": share(w["n_repeat_words"], w["n_words"]), "dup_line_share": share(x["n_dup_lines"], x["n_lines"]),
        "line_words": share(w["n_words"], x["n_lines"]), "upper_share": share(w["n_upper"], w["word_chars"]),
        "digit_share": share(w["n_digits"], w["word_chars"]), "mark_share": share(w["n_marks"], w["n_words"]),
        "bar_share": share(w["n_bars"], w["n_words"]), "distinct_share": share(w["n_distinct"], w["n_words"]),
    }
    fields = [w[c].alias(c) for c in COUNTS if c != "n_dup_lines"] + [x["n_dup_lines"].alias("n_dup_lines")]
    return df.withColumn(result, F.struct(*fields, *[v.alias(k) for k, v in features.items()])).drop(own)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, or else feature <= threshold
    threshold: float

    def on(self, stats: Column) -> Column:
        value = stats[self.feature].cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, stats: Column) -> Column:
    return reduce(Column.__and__, [c.on(stats) for c in rule])


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The ordered list as one expression: the first rule that holds rejects, the last word is to keep."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(holds(rule, stats), F.lit(False)).otherwise(kept)
    return kept


def gain(bad: float, good: float, bad_before: float, good_before: float) -> float:
    if not bad:
        return 0.0
    return bad * (log2(bad / (bad + good)) - log2(bad_before / (bad_before + good_before)))


def best_condition(counts: dict[tuple[str, int], tuple[int, int]], cuts: dict[str, list[float]]) -> Condition | None:
    """The threshold that gains most, from bad and good rows per feature and bin."""
    best, most = None, 1e-9
    for feature, bounds in cuts.items():
        bins = [counts.get((feature, k), (0, 0)) for k in range(len(bounds) + 1)]
        bad_all, good_all = (sum(b[i] for b in bins) for i in (0, 1))
        bad = good = 0
        for k, bound in enumerate(bounds):
            bad, good = bad + bins[k][0], good + bins[k][1]
            for above, p, n in ((False, bad, good), (True, bad_all - bad, good_all - good)):
                if p + n < bad_all + good_all and (g := gain(p, n, bad_all, good_all)) > most:
                    best, most = Condition(feature, above, bound), g
    return best


def pure(counts: dict[tuple[str, int], tuple[int, int]], cuts: dict[str, list[float]], condition: Condition) -> bool:
    """Whether ``condition`` leaves no good row."""
    at = cuts[condition.feature].index(condition.threshold)
    return not any(good for (f, k), (_, good) in counts.items() if f == condition.feature and (k > at) == condition.above)


def learn(
    labelled: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.95, least: int = 5
) -> list[Rule]:
    """Rules for bad rows of ``labelled`` (columns ``bad``, ``grow`` and the struct ``stats``).

    A rule counts only with ``least`` bad rows and ``precision`` among all rows it covers, and among those kept apart.
    """
    exact = {f: F.percentile_approx(F.col("stats")[f].cast("double"), [k / bins for k in range(1, bins)], 10_000).alias(f) for f in FEATURES}
    # quantiles of the bad rows and of all rows: at most 2 * bins thresholds per feature
    both = [labelled.where(rows).agg(*exact.values()).first() for rows in (F.lit(True), F.col("bad"))]
    cuts = {f: sorted({v for row in both for v in row[f] or []}) for f in FEATURES}
    binned = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.size(F.filter(F.array(*[F.lit(float(b)) for b in cuts[f]]).cast("array<double>"), _below(f))).alias("bin"))
        for f in FEATURES
    ])
    rows = settle(labelled.select("bad", "grow", "stats", binned.alias("binned")))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where(verdict(rules, F.col("stats")))
        rule: Rule = ()
        while len(rule) < max_conditions:
            inside = left.where(F.col("grow") & (holds(rule, F.col("stats")) if rule else F.lit(True)))
            found = inside.select("bad", F.explode("binned").alias("b")).groupBy("b.feature", "b.bin").agg(
                F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good")
            ).collect()  # bounded: features times bins
            counts = {(r["feature"], r["bin"]): (r["n_bad"], r["n_good"]) for r in found}
            condition = best_condition(counts, cuts)
            if condition is None:
                break
            rule += (condition,)
            if pure(counts, cuts, condition):
                break
        rule = prune(left, rule, precision, least)
        if not rule:
            break
        rules.append(rule)
    return rules


def _below(feature: str) -> Callable[[Column], Column]:
    return lambda bound: bound < F.col("stats")[feature].cast("double")


def prune(left: DataFrame, rule: Rule, precision: float, least: int) -> Rule:
    """The prefix of ``rule`` that does best on the rows kept apart; none if no prefix is precise enough."""
    if not rule:
        return ()
    covers = [holds(rule[: k + 1], F.col("stats")) for k in range(len(rule))]
    sums = [
        F.count_if(c & (F.col("bad") == b) & (F.col("grow") == g)).alias(f"c{k}_{b}_{g}")
        for k, c in enumerate(covers) for b in (True, False) for g in (True, False)
    ]
    got, best, most = left.agg(*sums).first(), (), -1.0
    for k in range(len(rule)):
        bad, good = (got[f"c{k}_{b}_True"] + got[f"c{k}_{b}_False"] for b in (True, False))
        apart_bad, apart_good = (got[f"c{k}_{b}_False"] for b in (True, False))
        if bad < least or bad < precision * (bad + good) or apart_bad < precision * (apart_bad + apart_good):
            continue
        worth = (apart_bad - apart_good) / max(1, apart_bad + apart_good) + 1e-9 * apart_bad
        if worth > most:
            best, most = rule[: k + 1], worth
    return best


def labelled_rows(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``bad``, ``grow`` (two thirds, by a hash of the doc_id) and ``stats`` of labelled documents the base rule keeps."""
    marks = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 0).alias("bad"))
    known = scored.where(~base_failed(F.col("stats")))
    joined = known.join(marks, known["doc_id"].cast("long") == marks["_id"])
    return joined.select("bad", (F.pmod(F.xxhash64(F.lit("grow"), "_id"), F.lit(3)) != 0).alias("grow"), "stats")


def rule_verdicts(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, list[Rule]]:
    """``doc_id``, ``stats``, ``base_failed`` and ``kept`` of every document, and the rules."""
    scored = settle(statistics(docs.select(F.col("doc_id").cast("long"), "text")).drop("text"))
    rules = learn(labelled_rows(scored, labels), **options)
    failed = base_failed(F.col("stats"))
    return scored.select("doc_id", "stats", failed.alias("base_failed"), (~failed & verdict(rules, F.col("stats"))).alias("kept")), rules


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that neither the base rule nor the list rejects, with the columns they have.

    Statistics cost far more than writing: they are taken once and written with the documents before anything asks for
    them, since Spark would work them out anew in a filter next to them.
    """
    (own,) = unused(docs, "_quality")
    marked = settle_texts(statistics(docs, result=own))
    rules = learn(labelled_rows(marked.select("doc_id", F.col(own).alias("stats")), labels), **options)
    return marked.where(~base_failed(F.col(own)) & verdict(rules, F.col(own))).drop(own)


@query("op6_quality_rules")
def op6(spark, folder):
    verdicts, _ = rule_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return verdicts.select("doc_id", *[F.col("stats")[c].alias(c) for c in COUNTS], "base_failed", "kept")
