"""Matching within a run: new objects meet the entities that were there, and those that earlier objects of the run project.

Taken one by one in their order, an object joins the entity that the first hitting rule names, is ambiguous if that rule
names several, and projects an entity of its own if none does. Here the same is found by rounds over whole tables. An
object that matches nothing from before is open; it projects once no earlier open object could give it a match, and
won't once an earlier projected one does. The first open object is always decided, equal keys are all decided in two rounds
however many there are, and chains (a like b by one rule, b like c by another) take a round a link.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators.match import MatchRule
from rillstone.operators.skew import with_answers
from rillstone.session import stored

_KEY = ["space", "key"]


def seeks(rows: DataFrame, rules: list[MatchRule], ord_: Column) -> DataFrame:
    """ord, rank (order of the rule, place of the source), space, key: what rows look for."""
    found = []
    for r in rules:
        for n, source in enumerate(r.sources):
            rank = F.struct(F.lit(r.order).alias("rule"), F.lit(n).alias("n"))
            found.append(r.keyed(rows, source, ord_.alias("ord"), rank.alias("rank"), F.lit(r.space).alias("space")).withColumnRenamed("_k", "key"))
    return functools.reduce(DataFrame.union, found)


def gives(rows: DataFrame, rules: list[MatchRule], value_of: dict[str, str], ord_: Column) -> DataFrame | None:
    """ord, space, key: what entities projected from rows are found by. value_of: the column that flows into a target."""
    spaces = {r.space: r for r in rules if r.target in value_of}
    found = [r.keyed(rows, value_of[r.target], ord_.alias("ord"), F.lit(space).alias("space")).withColumnRenamed("_k", "key") for space, r in spaces.items()]
    return functools.reduce(DataFrame.union, found) if found else None


def known_keys(canonical_rows: DataFrame, rules: list[MatchRule], entity: str) -> DataFrame:
    """space, key, lo, hi: the least and greatest entity that a key finds. Targets that entities have no column for find none."""
    spaces = {r.space: r for r in rules if r.target in canonical_rows.columns}
    found = [r.keyed(canonical_rows, r.target, F.col(entity).alias("entity"), F.lit(space).alias("space")).withColumnRenamed("_k", "key") for space, r in spaces.items()]
    none = canonical_rows.sparkSession.createDataFrame([], "entity long, space string, key string")
    rows = functools.reduce(DataFrame.union, found, none)
    return rows.groupBy(*_KEY).agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))


def _first(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(*_KEY).agg(F.min("ord").alias(name))


def _earlier(seek: DataFrame, first: DataFrame, name: str) -> DataFrame:
    """seek's ords that a key of an earlier object answers."""
    return with_answers(seek, _KEY, first, "ord", "inner").filter(F.col(name) < F.col("ord")).select("ord").distinct()


def projecting(seek: DataFrame, give: DataFrame, at: str) -> DataFrame:
    """ord of those open objects that do not project. seek, give: what open objects look for and would be found by."""
    contested = stored(_earlier(seek, _first(give, "first"), "first"), at, "contested")
    if contested.isEmpty():
        return contested
    seek = stored(seek.join(contested, "ord", "left_semi").select("ord", *_KEY).distinct(), at, "seek")
    give = stored(give.join(seek.select(*_KEY).distinct(), _KEY, "left_semi"), at, "give")
    first = stored(_first(give.join(contested, "ord", "left_anti"), "first"), at, "first-0")
    left, turn, made = contested, 0, []
    while not left.isEmpty():
        turn += 1
        ask = seek.join(left, "ord", "left_semi")
        rest = stored(left.join(_earlier(ask, first, "first"), "ord", "left_anti"), at, f"rest-{turn}")
        waits = _earlier(ask.join(rest, "ord", "left_semi"), _first(give.join(rest, "ord", "left_semi"), "open"), "open")
        left = stored(waits, at, f"left-{turn}")
        made.append(stored(rest.join(left, "ord", "left_anti"), at, f"made-{turn}"))
        first = stored(_first(give.join(made[-1], "ord", "left_semi"), "first").union(first).groupBy(*_KEY).agg(F.min("first").alias("first")), at, f"first-{turn}")
    return contested.join(functools.reduce(DataFrame.union, made), "ord", "left_anti")


def run_matches(objects: DataFrame, seek: DataFrame, give: DataFrame | None, known: DataFrame, at: str) -> DataFrame:
    """ord, outcome (joined, ambiguous, none), rule, entity, via of every object.

    objects: ord (unique, orders them), projects. A joined object has the entity from before, or the ord of the object that
    projects it (via). An object that projects has outcome none and its own ord as via.
    """
    before = stored(with_answers(seek, _KEY, known, "ord", "inner").select("ord", "rank", "lo", "hi"), at, "before")
    hits = before.select("ord", "rank", "lo", "hi", F.lit(None).cast(objects.schema["ord"].dataType).alias("p"), F.lit(None).cast(objects.schema["ord"].dataType).alias("q"))
    opened = objects.filter("projects").join(before.select("ord").distinct(), "ord", "left_anti").select("ord")
    if give is not None:
        opened = stored(opened, at, "open")
        give = give.join(opened, "ord", "left_semi")
        gone = projecting(seek.join(opened, "ord", "left_semi"), give, at)
        opened = stored(opened.join(gone, "ord", "left_anti"), at, "projecting")
        give = give.join(gone, "ord", "left_anti").distinct()
        p = _first(give, "p")  # of a key's projected entities the first two tell one from several
        q = _first(with_answers(give, _KEY, p, "ord", "inner").filter("ord > p"), "q")
        made = with_answers(seek, _KEY, p.join(q, _KEY, "left"), "ord", "inner").filter("p < ord")
        none = F.lit(None).cast("long")
        hits = hits.union(made.select("ord", "rank", none, none, "p", F.when(F.col("q") < F.col("ord"), F.col("q")).otherwise(F.col("p"))))
    each = hits.groupBy("ord", "rank").agg(*(f(c).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"), (F.min, "p"), (F.max, "q"))))
    one = each.groupBy("ord").agg(F.min_by(F.struct("rank", "lo", "hi", "p", "q"), "rank").alias("f")).select("ord", "f.*")
    several = (F.col("lo") < F.col("hi")) | (F.col("p") < F.col("q")) | (F.col("lo").isNotNull() & F.col("p").isNotNull())
    out = objects.select("ord").join(one, "ord", "left").join(opened.withColumn("_own", F.lit(True)), "ord", "left")
    outcome = F.when(F.col("rank").isNull(), "none").when(F.coalesce(several, F.lit(False)), "ambiguous").otherwise("joined")
    joined = F.col("outcome") == "joined"
    out = out.withColumn("outcome", outcome)
    via = F.when(joined, F.col("p")).when(F.col("_own"), F.col("ord"))
    return out.select("ord", "outcome", F.col("rank.rule").alias("rule"), F.when(joined, F.col("lo")).alias("entity"), via.alias("via"))


def new_ids(rows: DataFrame, keys: list[str], taken: DataFrame, at: str, name=F.xxhash64) -> DataFrame:
    """rows with `entity`: a hash of the keys, which name a row; another one where that is taken, or another row's too.

    taken: entity. What a row gets depends on its keys and on what is taken only, so a run that is done again gives it again.
    """
    made, turn = rows.withColumn("entity", name(*keys)), 0
    used = taken.select("entity").distinct().withColumn("_taken", F.lit(True))
    while True:
        own = F.struct(*keys)
        clash = made.groupBy("entity").agg(F.min(own).alias("_first"), F.count("*").alias("_n")).join(used, "entity", "left").filter("_n > 1 or _taken")
        if clash.isEmpty():  # as nearly always: nothing is written
            return made
        turn += 1
        late = F.col("_taken") | (own > F.col("_first"))
        made = made.join(stored(clash, at, f"clashes-{turn}"), "entity", "left").withColumn("entity", F.when(late, name(*keys, F.lit(turn))).otherwise(F.col("entity")))
        made = stored(made.drop("_first", "_n", "_taken"), at, f"ids-{turn}")
