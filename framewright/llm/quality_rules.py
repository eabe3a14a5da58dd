"""Quality rules whose cutoffs are chosen under a bound on false rejections (DataFrame functions only).

Each rule is a ratio of counts of one text and rejects what lies at or above its cutoff. The labelled documents are the
holdout: no rule learns anything else from them. For a stratum (language), a rule and a candidate cutoff let n be the
good holdout documents that the base rule keeps, k those of them that the rule would reject. The exact upper bound
(Clopper-Pearson) on the false rejection rate is below ``alpha`` with confidence 1 - d just when
P(Binomial(n, alpha) <= k) <= d. With d = delta divided by the number of all hypotheses (strata x rules x candidates,
Bonferroni) all bounds hold together with confidence 1 - delta. Each rule gets alpha / number of rules, so a stratum's
union of rules stays under alpha. The lowest cutoff that passes is used; where none passes, the rule rejects nothing in
that stratum.

Unknown and null languages share the pooled stratum, calibrated on the whole holdout. So do strata with fewer than
``min_stratum`` holdout documents and those whose size can't pass any cutoff, even without a false rejection
(P(Binomial(n, alpha) <= 0) > d; about 1,630 documents for four languages). The table of cutoffs has at most
(labelled rows / min_stratum + 1) x rules rows; it is measured before use and becomes literals of the plan under
``max_literal_rows``, else it is joined.

Edge cases: a null text has no words (n_words 0, base_failed true); empty texts alike. Repeated rows are judged each
on its own; in the holdout rows that share a doc_id are one trial, rejected if any of them is (its language is the least
of theirs). Labels without doc_id or quality are ignored, contradicting ones count by majority (ties: good). Without
usable labels only the base rule rejects. Ties at a cutoff are rejected. Very long texts are measured whole. An empty
table gives an empty result. Further columns are ignored, and kept by ``keep_passing``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize


@dataclass(frozen=True)
class Params:
    alpha: float = 0.02
    delta: float = 0.05
    min_stratum: int = 400
    max_literal_rows: int = 2000
    candidates: tuple[float, ...] = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0)


#: name -> (numerator, denominator); the ratio is 0 where the denominator is.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "long_words": ("word_chars", "n_words_x20"),
}
POOLED = "*"


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    A text whose windows have distinct 64-bit hashes, as most have, needs no more. For the others one number holds a
    window's hash (its high bits) and its position (as many low bits as the length asks for); sorted, equal windows
    lie side by side. All neighbours of equal hash are then compared word by word: if any two differ, which a
    collision alone can bring about, that text is sorted by the windows themselves. n log n in the length of the text.
    """

    def total(positions: Column) -> Column:
        return F.aggregate(
            positions,
            F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")),
            lambda a: a["n"],
        )

    def neighbours(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))

    def by_window(ws: Column, n: Column) -> Column:
        trios = F.arrays_zip(F.slice(ws, 1, n).alias("a"), F.slice(ws, 2, n).alias("b"), F.slice(ws, 3, n).alias("c"), F.sequence(F.lit(0), n - 1).alias("i"))
        return let(
            F.sort_array(trios),
            lambda s: total(F.sort_array(F.transform(neighbours(s, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])), lambda x: x["i"]))),
        )

    def by_hash(ws: Column, n: Column, hashes: Column) -> Column:
        def packed(bits: Column) -> Column:
            def found(hit: Column) -> Column:
                place = lambda x: F.call_function("shiftleft", x, F.lit(64) - bits)
                at = lambda x: F.call_function("shiftrightunsigned", place(x), F.lit(64) - bits).cast("int")

                def differ(k: Column) -> Column:
                    x, y = F.get(hit, k), F.get(hit, k + 1)
                    alike = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
                    unlike = F.lit(False)
                    for j in range(3):
                        unlike = unlike | (F.get(ws, at(x) + j) != F.get(ws, at(y) + j))
                    return alike & unlike

                collision = F.exists(F.sequence(F.lit(0), F.size(hit) - 1), differ)
                return F.when(F.size(hit) == 0, F.lit(0)).when(F.coalesce(collision, F.lit(False)), by_window(ws, n)).otherwise(total(F.sort_array(F.transform(hit, at))))

            keys = F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))
            head = lambda x: F.call_function("shiftright", x, bits)
            return let(F.sort_array(keys), lambda s: let(neighbours(s, lambda x, y: head(x) == head(y)), found))

        return let(F.length(F.bin(n.cast("long"))), packed)

    def hashed(ws: Column) -> Column:
        n = F.size(ws) - 2
        trios = F.arrays_zip(F.slice(ws, 1, n), F.slice(ws, 2, n), F.slice(ws, 3, n))
        return let(
            F.transform(trios, lambda x: F.xxhash64(x)),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(by_hash(ws, n, h)),
        )

    return F.when(F.size(words) >= 3, hashed(words)).otherwise(F.lit(0))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts of each whole text; the text itself is dropped unless kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = let(
        F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0),
        lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
    )
    return docs.select(
        *keep,
        measured.alias("__m"),
        lines.alias("__l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    ).select(
        *keep,
        F.col("__m.n_words").alias("n_words"),
        F.col("__m.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("__l.dup").alias("n_dup_lines"),
        F.col("__m.n_repeat_words").alias("n_repeat_words"),
        F.col("__l.n").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(rule: str) -> Column:
    top, bottom = RULES[rule]
    under = F.col("n_words") * 20 if bottom == "n_words_x20" else F.col(bottom)
    return F.when(under > 0, F.col(top) / under).otherwise(F.lit(0.0))


def tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms; 1 where n is 0."""
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct(first.alias("term"), F.exp(first).alias("sum")),
        lambda a, i: F.when(i > k, a).otherwise(
            let(
                a["term"] + F.log((n - i + 1) / i * odds),
                lambda t: F.struct(t.alias("term"), (a["sum"] + F.exp(t)).alias("sum")),
            )
        ),
        lambda a: a["sum"],
    )
    return F.when((n <= 0) | (k >= n), F.lit(1.0)).otherwise(total)


def trials(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Per good holdout document that the base rule keeps: doc_id, lang and the greatest ratio of each rule."""
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
        .where("good").select("doc_id")
    )
    return measured.where(~base_failed()).join(good, "doc_id").groupBy("doc_id").agg(F.min("lang").alias("lang"), *[F.max(ratio(r)).alias(r) for r in RULES])


def calibrate(tried: DataFrame, p: Params | None = None) -> tuple[DataFrame, DataFrame]:
    """From ``trials``: the passing cutoffs (stratum, rule, cutoff), and the strata that have cutoffs of their own."""
    p = p or Params()
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (F.col(r) >= c).alias("hit")) for r in RULES for c in p.candidates]))
    counted = (
        tried.select("lang", grid.alias("g")).groupBy("lang", "g.rule", "g.cutoff")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g.hit")).alias("k"))
    )
    own = counted.where(F.col("lang").isNotNull() & (F.col("n") >= p.min_stratum)).withColumnRenamed("lang", "stratum")
    pooled = counted.groupBy("rule", "cutoff").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(F.lit(POOLED).alias("stratum"), "rule", "cutoff", "n", "k")
    tests = materialize(own.unionByName(pooled), "quality-tests")
    level = F.lit(p.delta) / F.lit(max(1, tests.count()))
    share = p.alpha / len(RULES)
    passing = tests.where(tail(F.col("n"), F.col("k"), share) <= level).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    able = tests.where((F.col("stratum") != POOLED) & (tail(F.col("n"), F.lit(0).cast("long"), share) <= level)).select("stratum").distinct()
    return passing.join(able.unionByName(tests.sparkSession.createDataFrame([(POOLED,)], "stratum string")), "stratum", "left_semi"), able


def apply_rules(measured: DataFrame, cutoffs: DataFrame, strata: DataFrame, p: Params | None = None) -> DataFrame:
    """Add base_failed, rejected_by (the first rule that rejects, or null) and kept."""
    p = p or Params()
    got = cutoffs.limit(p.max_literal_rows + 1).collect()
    own = [r.stratum for r in strata.limit(p.max_literal_rows + 1).collect()]
    if max(len(got), len(own)) > p.max_literal_rows:
        return _joined(measured, cutoffs, strata)
    stratum = F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit(POOLED)) if own else F.lit(POOLED)
    reject = F.lit(None).cast("string")
    for r in reversed(list(RULES)):
        hit = F.lit(False)
        for c in sorted(x for x in got if x.rule == r):
            hit = hit | ((stratum == c.stratum) & (ratio(r) >= c.cutoff))
        reject = F.when(hit, F.lit(r)).otherwise(reject)
    return _verdict(measured.withColumn("rejected_by", reject))


def _joined(measured: DataFrame, cutoffs: DataFrame, strata: DataFrame) -> DataFrame:
    limits = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut"))
    wide = strata.join(limits, "stratum", "left").withColumn("__known", F.lit(True))
    pooled = {r.rule: r.cutoff for r in cutoffs.where(F.col("stratum") == POOLED).collect()}
    out = measured.join(wide, F.col("lang") == F.col("stratum"), "left")
    reject = F.lit(None).cast("string")
    for r in reversed(list(RULES)):
        limit = F.when(F.col("__known"), F.col("__cut")[r]).otherwise(F.lit(pooled.get(r)))
        reject = F.when(ratio(r) >= limit, F.lit(r)).otherwise(reject)
    return _verdict(out.withColumn("rejected_by", reject).drop("stratum", "__cut", "__known"))


def _verdict(df: DataFrame) -> DataFrame:
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def judge(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> DataFrame:
    """Per document: doc_id, lang, the counts, base_failed, rejected_by, kept. The counts are computed once and kept as a narrow table."""
    p = p or Params()
    measured = materialize(features(docs, "doc_id", "lang"), "quality-features")
    return apply_rules(measured, *calibrate(trials(measured, labels), p), p)


def keep_passing(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> DataFrame:
    """The documents that pass, with all their columns. Texts are measured a second time rather than shuffled or kept."""
    p = p or Params()
    cutoffs, strata = calibrate(trials(features(docs, "doc_id", "lang"), labels), p)
    packed = docs.columns
    whole = features(docs.select(F.struct(*[F.col(f"`{c}`") for c in packed]).alias("__row"), "lang", "text"), "__row", "lang")
    return apply_rules(whole, cutoffs, strata, p).where("kept").select(*[F.col("__row")[c].alias(c) for c in packed])
