"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's mean repetition rate brings it to its target share. A document's number of copies is the inverse of
the Poisson distribution with that mean at a uniform number hashed from a seed and the document's id, so it is
the same in every run. Documents are exploded by their counts and dealt out by a hash of each copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import SALTS

#: Means above this are sums of several equal, independent Poisson numbers.
LARGEST_MEAN = 32.0
#: Up to this many sources, their rates are broadcast.
BROADCAST_SOURCES = 50_000
#: Up to this many ids that several rows share, they are broadcast.
BROADCAST_IDS = 500_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts as text."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, source_col: str = "source"
) -> DataFrame:
    """_source, _pieces, _mean and _cdf by source: its rate is _pieces x _mean, and _cdf the distribution for _mean.

    weights: target share of each source (any scale; a source that isn't named has none). Without them the
    target is the source's number of documents to the power of `temperature`. The expected number of copies in
    all is epochs times the number of documents. A null source is a source like any other, named only by None.
    """
    sizes = docs.select(F.col(source_col).alias("_source")).groupBy("_source").agg(F.count("*").cast("double").alias("_n"))
    if weights is None:
        sizes = sizes.withColumn("_w", F.pow("_n", F.lit(float(temperature))))
    else:
        named = F.lit(0.0)
        if rows := [(k, float(v)) for k, v in weights.items() if k is not None]:
            table = F.create_map(*(F.lit(x) for kv in rows for x in kv))
            named = F.coalesce(F.try_element_at(table, F.col("_source")), named)
        sizes = sizes.withColumn("_w", F.when(F.col("_source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(named))
    total = sizes.agg(F.sum("_n").alias("_all"), F.sum("_w").alias("_weight"))
    rate = F.when(F.col("_weight") > 0, F.col("_w") / F.col("_weight") * F.col("_all") * F.lit(float(epochs)) / F.col("_n"))
    rates = sizes.join(F.broadcast(total)).withColumn("_rate", F.coalesce(rate, F.lit(0.0)))
    pieces = F.greatest(F.ceil(F.col("_rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    rates = rates.withColumn("_pieces", pieces).withColumn("_mean", F.col("_rate") / F.col("_pieces"))
    # p(k) = p(k - 1) x mean / k, summed; beyond the last place lies less than the hash can resolve
    last = F.ceil(F.col("_mean") + 12 * F.sqrt("_mean") + 24).cast("int")
    begin = F.struct(F.exp(-F.col("_mean")).alias("p"), F.array(F.exp(-F.col("_mean"))).alias("c"))

    def grow(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("_mean") / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return rates.select("_source", "_pieces", F.aggregate(F.sequence(F.lit(1), last), begin, grow)["c"].alias("_cdf"), "_mean")


def _named(rows: DataFrame, own: Column) -> DataFrame:
    """rows with `_name`: the id where it is the row's own, else the id and the row's place in the table."""
    place = F.concat_ws("@", F.coalesce(own.cast("string"), F.lit("null")), F.monotonically_increasing_id())
    ids = rows.select(own.alias("_shared")).filter("_shared is not null")
    shared = ids.groupBy("_shared").agg(F.count("*").alias("_n")).filter("_n > 1").select("_shared")
    rows = rows.withColumn("_place", place)
    if not (n := shared.count()):
        return rows.withColumn("_name", F.coalesce(own.cast("string"), F.col("_place"))).drop("_place")
    if n <= BROADCAST_IDS:
        marked = rows.join(F.broadcast(shared), own == F.col("_shared"), "left")
    else:  # an id may have any share of the rows: it goes once to each of its salts
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_place"), F.lit(SALTS)).cast("int"))
        spread = shared.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = salted.join(spread, (own == F.col("_shared")) & (F.col("_salt") == F.col("_at")), "left").drop("_salt", "_at")
    return marked.withColumn("_name", F.when(F.col("_shared").isNull() & own.isNotNull(), own.cast("string")).otherwise(F.col("_place"))).drop("_place", "_shared")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs' rows, each as often as its Poisson number says, with copy_no (from 1) and shuffle_key, in random order.

    Partitions hold random shares of the copies, ascending by shuffle_key (an md5). A row with an id of its own has the
    same number in every run. Rows without an id, or that share one, each have a number by their place in the table, so
    that their source meets its share and their copies lie in all partitions too. Columns of docs named copy_no or
    shuffle_key are replaced; all others stay as they are, whatever their names. An empty table, or weights that name no
    source of it, give no rows. Texts are not looked at, so null, empty and long ones are rows like any others.
    """
    # docs' own columns go by number meanwhile, so that no name of theirs meets one used here
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own, source = F.col(f"c{docs.columns.index(id_col)}"), F.col(f"c{docs.columns.index(source_col)}")
    columns = [f"c{i}" for i, c in enumerate(docs.columns) if c not in ("copy_no", "shuffle_key")]
    plain = _named(plain, own)
    rates = source_rates(docs, weights, temperature, epochs, source_col)
    if rates.count() <= BROADCAST_SOURCES:
        rows = plain.join(F.broadcast(rates), source.eqNullSafe(F.col("_source")))
    else:  # a source may hold any share of the rows: spread each over salts
        salt = F.pmod(F.xxhash64("_name"), F.lit(SALTS)).cast("int")
        spread = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = plain.withColumn("_at", salt).join(spread, source.eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_salt")))

    def drawn(k: Column) -> Column:
        u = uniform(F.lit(seed), F.col("_name"), k)
        return F.size(F.filter("_cdf", lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_pieces")), F.lit(0), lambda acc, k: acc + drawn(k))
    rows = rows.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    rows = rows.select(*columns, "_name", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy_no"))
    key = F.concat_ws("|", F.lit("order"), F.lit(seed), "_name", "copy_no")
    rows = rows.withColumn("shuffle_key", F.md5(key.cast("binary"))).drop("_name")
    rows = rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return rows.toDF(*(docs.columns[int(c[1:])] for c in columns), "copy_no", "shuffle_key")
