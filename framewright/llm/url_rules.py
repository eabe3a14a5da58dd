"""URL filters: association rules mined by FP-growth, matched by an inverted index, under a table of fixed rules.

A url becomes a set of tokens: the labels of its host, their parts between hyphens, and the segments of its path
(numbers become ``path:#``). FP-growth (Spark) finds token combinations that are frequent among labelled urls; with
the class as one more item, its rules {up to ``max_items`` tokens} -> block are kept at or above ``min_confidence`` and a
support of ``min_support`` of the labelled urls and of ``min_count`` of them at least; a rule is dropped if a smaller rule
with at least its confidence is inside it. Each rule is indexed under its rarest token; a url looks up its tokens, and a
rule whose tokens are all there matches. A url with a match is blocked.

FP-growth enumerates all sizes of itemsets, 2^t for t tokens that come together often enough. So only frequent tokens
enter, and of tokens that occur in exactly the same urls one stands for all (they are interchangeable in any rule, the
first in order is named). If a basket still has more than ``max_tokens`` items, the itemsets of up to ``max_items``
tokens are counted directly instead, with the same result; no token is left out either way.

Up to ``max_rules`` rules (counted first) go to the executors as an index; more are joined by the token they are indexed
under.

Fixed rules (host suffix, path prefix, verdict) go first; of several that fit the longest decides.

Edge cases: null and malformed urls have empty host, path and tokens, and are allowed. Repeated urls are judged each;
among labelled urls each row counts. Of several rules that match, the first by size and tokens is reported. Without
labels nothing is mined; an empty table gives an empty result. Very long urls keep all tokens. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

BLOCK_ITEM = "class:block"


@dataclass(frozen=True)
class Params:
    min_support: float = 0.0005
    min_count: int = 20
    min_confidence: float = 0.5
    max_items: int = 3
    max_tokens: int = 16
    max_rules: int = 50_000


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url, sorted."""
    labels = F.split(host_of(url), r"\.")
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != "")
    segments = F.transform(F.split(path_of(url), "/"), lambda x: F.regexp_replace(F.lower(x), r"^\d+(\.\w+)?$", "#"))
    found = F.concat(
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("part:"), x)),
        F.transform(F.filter(segments, lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x)),
    )
    return F.array_sort(F.array_distinct(found))


def baskets_of(labelled: DataFrame, p: Params) -> tuple[DataFrame, int]:
    """(items array<string>, blocked) of the labelled urls, with frequent tokens alone and one for all that occur in the same urls; and the count a set must reach."""
    rows = labelled.select(F.col("url").alias("url"), F.col("blocked").alias("blocked")).where("url is not null and blocked is not null")
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("id"), tokens_of(F.col("url")).alias("tokens"), "blocked"), "baskets")
    least = max(p.min_count, -int(-p.min_support * rows.count() // 1))
    each = rows.select("id", "blocked", F.explode("tokens").alias("token"))
    where = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))  # of the urls that hold it
    frequent = each.groupBy("token").agg(where.alias("where")).where(F.col("where.n") >= least)
    names = materialize(frequent.groupBy("where").agg(F.min("token").alias("token")).select("token"), "url-tokens")
    small = each.join(names, "token").groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("items"))
    return rows.select("id", "blocked").join(small, "id", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "blocked"), least


def mine(labelled: DataFrame, p: Params | None = None) -> DataFrame:
    """Rules (tokens array<string>, confidence, support) from the columns url and blocked (boolean), without those that hold a smaller one of no less confidence."""
    p = p or Params()
    baskets, least = baskets_of(labelled, p)
    baskets = materialize(baskets, "items")
    seen = baskets.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("items")).alias("longest")).first()
    if not seen.n:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    rules = _grown(baskets, least, seen.n, p) if seen.longest < p.max_tokens else _counted(baskets, least, seen.n, p)
    return prune(materialize(rules, "rules"), p)


def _grown(baskets: DataFrame, least: int, n: int, p: Params) -> DataFrame:
    from pyspark.ml.fpm import FPGrowth

    items = F.concat("items", F.when(F.col("blocked"), F.array(F.lit(BLOCK_ITEM))).otherwise(F.array().cast("array<string>")))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=p.min_confidence).fit(baskets.select(items.alias("items")))
    return (
        model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK_ITEM) & (F.size("antecedent") <= p.max_items))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    )


def _counted(baskets: DataFrame, least: int, n: int, p: Params) -> DataFrame:
    """The same rules by counting all sets of up to max_items items: polynomial in a basket's length."""
    sets = F.transform("items", lambda x: F.array(x))
    level = sets
    for _ in range(p.max_items - 1):
        level = F.flatten(F.transform(level, lambda s: F.transform(F.filter("items", lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))))
        sets = F.concat(sets, level)
    counted = baskets.select(F.explode(sets).alias("tokens"), "blocked").groupBy("tokens").agg(F.count(F.lit(1)).alias("all"), F.count_if("blocked").alias("hit"))
    return counted.where((F.col("hit") >= least) & (F.col("hit") / F.col("all") >= p.min_confidence)).select("tokens", (F.col("hit") / F.col("all")).alias("confidence"), (F.col("hit") / F.lit(n)).alias("support"))


def prune(rules: DataFrame, p: Params) -> DataFrame:
    """Without the rules that hold a smaller one of no less confidence."""
    places = [c for k in range(1, p.max_items) for c in combinations(range(p.max_items), k)]
    subsets = F.filter(F.array(*[F.array(*[F.get("tokens", F.lit(i)) for i in c]) for c in places]), lambda s: (F.size(s) < F.size("tokens")) & ~F.exists(s, lambda x: x.isNull()))
    inner = rules.select("tokens", "confidence", F.explode(F.array_distinct(subsets)).alias("inner"))
    smaller = rules.select(F.col("tokens").alias("inner"), F.col("confidence").alias("other"))
    out = inner.join(smaller, "inner").where(F.col("other") >= F.col("confidence")).select("tokens").distinct()
    return rules.join(out, "tokens", "left_anti")


class RuleIndex:
    """token -> the rules that are indexed under it, each with its other tokens. A rule is under the token that the fewest rules hold."""

    def __init__(self, rules: list[tuple[str, ...]]) -> None:
        self.rules = sorted(rules, key=lambda t: (len(t), t))
        held: dict[str, int] = {}
        for t in self.rules:
            for x in t:
                held[x] = held.get(x, 0) + 1
        self.index: dict[str, list[int]] = {}
        for i, t in enumerate(self.rules):
            self.index.setdefault(min(t, key=lambda x: (held[x], x)), []).append(i)

    def match(self, tokens: list[str]) -> int | None:
        """The first rule all of whose tokens are there."""
        have = set(tokens)
        return min((i for t in have for i in self.index.get(t, ()) if have.issuperset(self.rules[i])), default=None)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of (verdict, "host/path") that fits, as struct(rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labelled: DataFrame, fixed: list[tuple[str, str]], p: Params | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, mined (tokens of the mined rule that matched, or null)."""
    p = p or Params()
    mined = materialize(mine(labelled, p), "mined")
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens"))
    if mined.count() <= p.max_rules:
        matched = _indexed(base, [tuple(r.tokens) for r in mined.collect()])
    else:
        matched = _looked_up(base, mined)
    fix = fixed_rule(F.col("host"), F.col("path"), fixed)
    return matched.withColumn("__fix", fix).select(
        "page_id",
        "host",
        "path",
        F.col("__fix.rule").alias("rule"),
        F.coalesce(F.col("__fix.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined",
    )


def _indexed(base: DataFrame, rules: list[tuple[str, ...]]) -> DataFrame:
    kind = dict(base.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules)
        names = [" ".join(t) for t in index.rules]
        for b in batches:
            found = [index.match(t or []) for t in b.column(3).to_pylist()]
            got = pa.array([None if i is None else names[i] for i in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), got], names=["page_id", "host", "path", "mined"])

    return map_arrow(base, run, f"page_id {kind}, host string, path string, mined string")


def _looked_up(base: DataFrame, mined: DataFrame) -> DataFrame:
    """The same by a join of the urls' tokens with the token of each rule that the fewest rules hold."""
    held = mined.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    least = mined.select("tokens", F.explode("tokens").alias("token")).join(held, "token").groupBy("tokens").agg(F.min(F.struct("held", "token"))["token"].alias("token"))
    numbered = materialize(base.withColumn("__row", F.monotonically_increasing_id()), "pages")
    hits = numbered.select("__row", F.col("tokens").alias("have"), F.explode("tokens").alias("token")).join(least, "token").where(F.size(F.array_except("tokens", "have")) == 0)
    best = hits.groupBy("__row").agg(F.min(F.struct(F.size("tokens").alias("n"), "tokens"))["tokens"].alias("tokens")).select("__row", F.array_join("tokens", " ").alias("mined"))
    return numbered.drop("tokens").join(best, "__row", "left").drop("__row")
