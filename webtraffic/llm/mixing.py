"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words (``WORD``). Sources, by code point with null last, weigh
5, 2, 1, 5, 2, 1, ... and share ``SHARE`` times all words. No source gets more than twice its own
words; what it cannot take goes to the others by weight (``source_targets``).

A source whose target is at least its words is taken whole first. The words still missing are
fitted by ``fit_budget``: documents are counted by exact size, every size gives its proportional
part, and a bounded-knapsack dynamic program over sizes settles the rest to the word where some
subset does. Of each size, the plan's number of documents is then selected by a seeded hash: the
hash space is cut into buckets, whole buckets below the threshold are taken and only the bucket at
the threshold is ranked, so a size that holds a third of all documents is not ranked by one task.

What reaches one task is a source's sizes and counts, never its documents. Null texts have size 0
and are never taken. Rows equal in doc_id and text are separate documents; which of them is taken
does not show in the rows. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtraffic.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2           #: times its own words that a source or document is taken at most
SEED = 20
BUCKETS = 1024     #: of the selection hash, per size
BUDGET = 4096      #: words that the dynamic program settles, at least


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and tells a null source from any string."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(skey, source_size, target) of each source.

    Sharing by weight with a ceiling has one solution: with the ratios ceiling / weight in
    ascending order, the sources below some ratio get their ceiling and the others the same
    multiple of their weight. Windows run over one row per source.
    """
    s = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(x) for x in weights)), (order % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    below = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    s = (
        s.withColumn("left", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
        .withColumn("weight", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0)))
        .withColumn("open", F.col("ratio") >= F.col("left") / F.col("weight"))
    )
    level = F.min(F.when(F.col("open"), F.struct("ratio", "skey", (F.col("left") / F.col("weight")).alias("x")))).over(whole)["x"]
    s = s.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return s.select("skey", "source_size", target.alias("target"))


def bounded_subset(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take so that their sum is the largest one up to ``budget``.

    Bounded knapsack over sums: counts are split into powers of two, and the set of reachable sums
    is one integer's bits.
    """
    full = (1 << (budget + 1)) - 1
    reach, items = [1], []
    for k, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        count = min(count, budget // size) if size > 0 else 0
        part = 1
        while count > 0 and not reach[-1] >> budget & 1:
            part = min(part, count)
            reach.append((reach[-1] | reach[-1] << (part * size)) & full)
            items.append((k, part, part * size))
            count -= part
            part *= 2
    out, rest = [0] * len(sizes), reach[-1].bit_length() - 1
    for i in range(len(items) - 1, -1, -1):
        k, part, words = items[i]
        if not reach[i] >> rest & 1:
            out[k] += part
            rest -= words
    return out


def fit_budget(sizes: np.ndarray, counts: np.ndarray, words: int, budget: int = BUDGET) -> np.ndarray:
    """How many documents of each size to take for about ``words`` words, never more.

    Every size gives its proportional part, with the rounding carried from large sizes to small
    ones. The rest, and some of the smallest documents handed back, go to the dynamic program.
    """
    o = np.argsort(-sizes, kind="stable")
    size, count = sizes[o].tolist(), counts[o].tolist()
    total = sum(s * c for s, c in zip(size, count, strict=True))
    words = max(0, min(int(words), total))
    take, due, used = [0] * len(size), 0, 0
    for k, (s, c) in enumerate(zip(size, count, strict=True)):
        due += s * c
        if s > 0:
            take[k] = max(0, min(c, (due * words // total - used) // s))
            used += take[k] * s
    rest = words - used
    for k in range(len(size) - 1, -1, -1):
        if rest >= budget or not size[k] or size[k] > budget:
            continue
        back = min(take[k], -(-(budget - rest) // size[k]))
        take[k] -= back
        rest += back * size[k]
    # sizes too large for the program: as many as fit, largest first
    for k, s in enumerate(size):
        if s and rest > 4 * budget:
            more = min(count[k] - take[k], (rest - 4 * budget) // s)
            take[k] += more
            rest -= more * s
    fit = [k for k, s in enumerate(size) if 0 < s <= rest and count[k] > take[k]]
    if fit and rest <= 16 * budget:
        for k, n in zip(fit, bounded_subset([size[k] for k in fit], [count[k] - take[k] for k in fit], rest), strict=True):
            take[k] += n
    out = np.zeros(len(sizes), np.int64)
    out[o] = take
    return out


def _fit(table: pa.Table) -> pa.Table:
    size, count = table.column("size").to_numpy(), table.column("n").to_numpy()
    target, whole = table.column("target")[0].as_py(), table.column("source_size")[0].as_py()
    times = int(target // whole) if whole else 0
    take = fit_budget(size, count, round(target - times * whole)) if whole else np.zeros(len(size), np.int64)
    return table.select(["skey", "size", "source_size", "target"]).append_column(
        "times", pa.array(np.full(len(size), times), pa.int64())
    ).append_column("take", pa.array(take, pa.int64()))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with a struct ``mix`` of what the selection needs: size, source key, bucket, hash."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn(
        "mix",
        F.struct(
            word_count(F.col("text")).alias("size"), source_key(F.col("source")).alias("skey"),
            F.pmod(F.shiftright(h, 20), F.lit(BUCKETS)).alias("bucket"), h.alias("h"),
        ),
    )


def mixed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of ``sized(docs)``, with ``mix`` holding size, source_size, target, copies.

    ``copies`` is how often the mix takes the document (0, 1 or 2).
    """
    base = docs.select(*columns, F.col("mix"))
    slim = docs.select("mix.*", "source")
    targets = staged(source_targets(slim), "targets")
    counts = staged(slim.groupBy("skey", "size", "bucket").agg(F.count("*").alias("n")), "counts")
    by_size = counts.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(targets, "skey")
    plan = staged(
        by_size.groupBy("skey").applyInArrow(
            _fit, "skey string, size long, source_size long, target double, times long, take long"
        ),
        "plan",
    )
    before = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = staged(
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(plan, ["skey", "size"])
        .withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - F.col("before"))))
        .select("skey", "size", "bucket", "source_size", "target", "times", "quota"),
        "quota",
    )
    key = ["__skey", "__size", "__bucket"]
    quota = quota.select(*(F.col(k[2:]).alias(k) for k in key), F.struct("source_size", "target", "times", "quota").alias("__quota"))
    keyed = base.select("*", *(F.col(f"mix.{k[2:]}").alias(k) for k in key))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("mix.h"))
    out = keyed.join(quota, key).withColumn("__rank", rank)
    copies = F.col("__quota.times") + (F.col("__rank") <= F.col("__quota.quota")).cast("long")
    return out.select(
        *columns,
        F.struct(
            F.col("mix.size"), F.col("__quota.source_size"), F.col("__quota.target"),
            F.when(F.col("mix.size") > 0, copies).otherwise(0).alias("copies"),
        ).alias("mix"),
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    slim = staged(sized(docs).select("doc_id", "source", "mix"), "sized")
    m = mixed(slim, ["doc_id"])
    return m.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target",
        (F.col("mix.size") * F.col("mix.copies")).alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: rows left out, or repeated as often as taken."""
    names = docs.columns
    rows = sized(docs.select(F.struct(*names).alias("row"), "doc_id", "text", "source"))
    m = mixed(rows, ["row"])
    again = F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int")))
    return m.where("mix.copies > 0").withColumn("copy", again).select("row.*")
