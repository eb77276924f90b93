"""Activity statistics and previews: exact counts, bounded samples, patterns of change."""

from __future__ import annotations

import functools
import operator
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.session import scratch, stored


def conditional_counts(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """One pass: each measure counts the rows where its condition holds."""
    return df.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in measures.items()))


def remainder(total: Column, part: Column) -> Column:
    """How many are left, never below 0."""
    return F.greatest(total - part, F.lit(0))


def count_map(df: DataFrame, by: list[str], dimension: str, name: str = "counts") -> DataFrame:
    """by, and a map of the dimension's values to their counts; the dimension has few values."""
    each = df.groupBy(*by, dimension).agg(F.count("*").alias("_n")).filter(F.col(dimension).isNotNull())
    entries = F.sort_array(F.collect_list(F.struct(dimension, "_n")))
    return each.groupBy(*by).agg(F.map_from_entries(entries).alias(name))


def add_counters(stored: DataFrame, new: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Stored counters with the new ones added."""
    return stored.unionByName(new).groupBy(*by).agg(*(F.sum(c).alias(c) for c in counters))


def latest_of(a: DataFrame, b: DataFrame, at: str) -> DataFrame:
    """The latest moment of two tables; null only if both have none."""
    m = a.agg(F.max(at).alias("x")).crossJoin(b.agg(F.max(at).alias("y")))  # two rows of one value
    return m.select(F.greatest("x", "y").alias("latest"))


def options(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).filter(F.col(c).isNotNull()).distinct()


def preview_summary(changes: DataFrame, coarse: list[str], pair: tuple[str, str], most_pairs: int = 10) -> tuple[DataFrame, DataFrame]:
    """(coarse groups with counts and number of distinct pairs, pairs with counts).

    Counts are always exact; a group with more than most_pairs distinct (old, new) pairs shows none of them.
    """
    pairs = changes.groupBy(*coarse, *pair).agg(F.count("*").alias("n"))
    groups = pairs.groupBy(*coarse).agg(F.sum("n").alias("n"), F.count("*").alias("pairs"))
    groups = groups.withColumn("collapsed", F.col("pairs") > most_pairs)
    shown = groups.filter("not collapsed").select(*coarse)
    same = [pairs[c].eqNullSafe(shown[c]) for c in coarse]
    return groups, pairs.join(shown, functools.reduce(operator.and_, same), "left_semi")


def capped_samples(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows a group, the first by a total order; Spark keeps only that many rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def within_budget(df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], seconds: float, at: str, slices: int = 16, clock: Callable[[], float] = time.monotonic) -> tuple[DataFrame, int]:
    """(what `work` gives for hash slices of df's objects, one after the other until the time is up; how many slices it did).

    The first slice is always done. What a slice gives is written once, so a preview that ran out of time keeps what it has;
    it is of a random share (slices done of all) of the objects. Objects with one key are never parted.
    """
    if not 0 < slices:
        raise ValueError("no slices")
    end, done = clock() + seconds, 0
    while done < slices and (not done or clock() < end):
        work(df.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == done)).write.parquet(f"{at}/slice={done}")
        done += 1
    return df.sparkSession.read.option("basePath", at).parquet(*(f"{at}/slice={n}" for n in range(done))).drop("slice"), done


def ranges(df: DataFrame, by: list[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The least and greatest value of each column by group, under the two names it is given."""
    return df.groupBy(*by).agg(*(f(c).alias(n) for c, names in columns.items() for f, n in zip((F.min, F.max), names, strict=True)))


def category_counts(df: DataFrame, category: str, order: str, most: int, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(exact counts by category, sample rows): at most `most` rows a category, the first by `order`, and at most `budget` in all.

    The counts never depend on the caps.
    """
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    samples = capped_samples(df, [category], [order], most)
    return counts, samples if budget is None else samples.orderBy(category, order).limit(budget)


def casing_only(old: Column, new: Column) -> Column:
    return F.when((old != new) & (F.lower(old) == F.lower(new)), "casing")


def affix(old: Column, new: Column) -> Column:
    """prefix+x, prefix-x, suffix+x or suffix-x when the only difference is something added or taken at one end."""
    grown = F.length(new) > F.length(old)
    long, short = F.when(grown, new).otherwise(old), F.when(grown, old).otherwise(new)
    n = F.length(long) - F.length(short)
    sign = F.when(grown, "+").otherwise("-")
    ok = (n > 0) & (F.length(short) > 0)
    return (
        F.when(ok & F.endswith(long, short), F.concat(F.lit("prefix"), sign, F.left(long, n)))
        .when(ok & F.startswith(long, short), F.concat(F.lit("suffix"), sign, F.right(long, n)))
    )


def container_move(old: Column, new: Column, separator: str = ",") -> Column:
    """The new parent, when the leaf of a path stays and its parent changes."""
    leaf = lambda c: F.substring_index(c, separator, 1)
    parent = lambda c: F.substr(c, F.length(leaf(c)) + F.length(F.lit(separator)) + 1)
    moved = (leaf(old) == leaf(new)) & (parent(old) != parent(new)) & (parent(new) != "")
    return F.when(moved, F.concat(F.lit("move to "), parent(new)))


def email_domain(old: Column, new: Column) -> Column:
    user, domain = (lambda c: F.substring_index(c, "@", 1)), (lambda c: F.substring_index(c, "@", -1))
    ok = F.contains(old, F.lit("@")) & F.contains(new, F.lit("@")) & (user(old) == user(new)) & (domain(old) != domain(new))
    return F.when(ok, F.concat(domain(old), F.lit(" to "), domain(new)))


def group_pattern(changes: DataFrame, by: list[str], old: str = "old", new: str = "new") -> DataFrame:
    """by and the pattern that all of a group's changes agree on, null if they don't."""
    a, b = F.col(old), F.col(new)
    found = F.coalesce(casing_only(a, b), email_domain(a, b), container_move(a, b), affix(a, b))
    rows = changes.select(*by, found.alias("_p"))
    agree = (F.min("_p") == F.max("_p")) & (F.count("_p") == F.count("*"))
    return rows.groupBy(*by).agg(F.when(agree, F.min("_p")).alias("pattern"))


def throughput(n: Column, seconds: Column, remaining: Column) -> tuple[Column, Column]:
    """(objects a second, seconds to go); null before any time has passed or anything is done."""
    rate = F.when(seconds > 0, n / seconds)
    return rate, F.when(rate > 0, remaining / rate)


def causal_chain(edges: DataFrame, effects: DataFrame, depth: int = 20) -> DataFrame:
    """(start, node, steps): causes of effects along edges (effect, cause), by the fewest steps; a table.

    Walked by doubling: from what is up to k steps away, on from the nodes that are k away by up to k more. A node that was
    met before keeps its fewer steps, so paths that meet go on as one and cycles end. A node that takes more than `depth`
    steps is an error, not a shorter chain.
    """
    at, k = scratch(effects.sparkSession), 1
    starts = effects.select(F.col("id").alias("start")).filter("start is not null").distinct()
    kind = starts.schema["start"].dataType
    hops = edges.select(F.col("effect").cast(kind).alias("start"), F.col("cause").cast(kind).alias("node")).filter("start <> node").distinct()
    hops = stored(hops.withColumn("steps", F.lit(1)), at, "hops-1")
    own = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("steps"))
    found = stored(own.union(hops.join(starts, "start", "left_semi")), at, "chain-1")
    while k <= depth and not found.filter(F.col("steps") == k).isEmpty():
        longer = stored(_twice_as_far(found, hops, k), at, f"chain-{2 * k}")
        # from here on walks go on only from nodes that are 2 k away from something, and these are k away from another such
        on = hops.filter(F.col("steps") == k).select(F.col("node").alias("start")).distinct()
        hops = stored(_twice_as_far(hops.join(on, "start", "left_semi"), hops, k), at, f"hops-{2 * k}")
        found, k = longer, 2 * k
    if not found.filter(F.col("steps") > depth).isEmpty():
        raise ValueError(f"a chain has more than {depth} steps")
    return found


def _twice_as_far(walk: DataFrame, hops: DataFrame, k: int) -> DataFrame:
    """walk (start, node, steps up to k) with all that is up to k hops from the nodes k steps away."""
    far = walk.filter(F.col("steps") == k).select("start", F.col("node").alias("via"))
    more = far.join(hops.select(F.col("start").alias("via"), "node", F.col("steps").alias("on")), "via")
    more = more.filter("start <> node").select("start", "node", (F.col("on") + k).alias("steps"))
    return walk.union(more).groupBy("start", "node").agg(F.min("steps").alias("steps"))
