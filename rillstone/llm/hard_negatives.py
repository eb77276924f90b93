"""Hard negatives by a vector-approximation file.

Every component of an integer vector is quantised into one of at most 256 cells of its dimension; a row's cells are its
approximation. For a block of rows, two table lookups give the least and the greatest value of each component's cell, and
with them the least and the greatest score that a row can have with an anchor. Only rows whose bounds let them enter an
anchor's list, or a window of scores, are scored by their vectors. What the cells are decides how many those are, never
which rows are found.

Anchors are taken in groups of bounded size; a group goes to all tasks, which read the index once for its positives and
once for its windows, and send at most k rows for each list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.common import forget, release, stored, work_dir

#: Cells of a dimension.
CELLS = 256
#: Largest magnitude of a scaled component: products of it stay exact in 64 bits up to 1,024 dimensions.
LARGEST = 1 << 26
#: Anchors of a group, and those whose bounds are held at once.
GROUP = 16_384
_AT_ONCE = 256
_ROWS = 4_096

_INDEX = "uid long, id long, label long, anchor boolean, v array<int>, code array<tinyint>"


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column, scale: int) -> DataFrame:
    """id, label, anchor, v (floor(scale * x) of each component) of the rows that take part."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    v = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    some = rows.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).filter(whole)
    return some.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("v"))


@dataclass
class Cells:
    """lo and hi: the least and greatest value of each cell, a row of CELLS for each dimension; starts: where cells begin."""

    lo: np.ndarray
    hi: np.ndarray
    starts: list[np.ndarray]

    def code(self, v: np.ndarray) -> np.ndarray:
        out = np.empty(v.shape, np.int64)
        for d, s in enumerate(self.starts):
            out[:, d] = np.searchsorted(s, v[:, d], "right") - 1
        return out

    def bounds(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tables' values for rows' cells: least and greatest components."""
        dim = np.arange(len(self.starts))
        return self.lo[dim, code], self.hi[dim, code]


def fit_cells(vectors: DataFrame, cells: int = CELLS) -> Cells:
    """Cells of about equally many values, from the quantiles, least and greatest values of all rows; nothing is sampled."""
    share = [k / cells for k in range(1, cells)]
    found = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("a"), F.max("x").alias("z"), F.percentile_approx("x", share).alias("q"))
    starts, lo, hi = [], [], []
    for r in sorted(found.collect(), key=lambda r: r["dim"]):
        s = np.unique(np.array([r["a"], *r["q"]], np.int64))
        starts.append(s)
        lo.append(np.pad(s, (0, cells - len(s)), mode="edge"))
        hi.append(np.pad(np.append(s[1:] - 1, r["z"]), (0, cells - len(s)), mode="edge"))
    return Cells(np.array(lo).reshape(len(starts), cells), np.array(hi).reshape(len(starts), cells), starts)


def approximation_file(vectors: DataFrame, cells: Cells, at: str) -> DataFrame:
    """The index, a table: uid (a number for each row), id, label, anchor, v and the code of v's cells, less 128."""
    spread = vectors.sparkSession.sparkContext.broadcast(cells)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                code = (spread.value.code(v) - 128).astype(np.int8)
                offsets = np.arange(0, code.size + 1, max(code.shape[1], 1), dtype=np.int32) if code.size else np.zeros(b.num_rows + 1, np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(code.ravel()))], names=[*b.schema.names, "code"])
        release()

    wide = len(cells.starts)
    padded = vectors.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "anchor", F.slice(F.concat("v", F.array_repeat(F.lit(0), wide)), 1, wide).alias("v"))
    return stored(padded.mapInArrow(encode, _INDEX), at, "index")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1)).astype(np.int64)


def _cut(n: int) -> Iterator[slice]:
    return (slice(i, i + _AT_ONCE) for i in range(0, n, _AT_ONCE))


class Rows:
    """Rows of a batch, or a group of anchors. Ids that are null have the greatest number, and a mark."""

    def __init__(self, b: pa.RecordBatch | pa.Table):
        column = (lambda n: b.column(n).combine_chunks()) if isinstance(b, pa.Table) else b.column
        self.uid, self.label = column("uid").to_numpy(), column("label").to_numpy()
        self.no_id = column("id").is_null().to_numpy(zero_copy_only=False)
        self.id = column("id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.v = _matrix(column("v"))

    def __len__(self) -> int:
        return len(self.uid)


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rows, np.ndarray]]:
    for whole in batches:
        for i in range(0, whole.num_rows, _ROWS):
            b = whole.slice(i, _ROWS)
            yield Rows(b), _matrix(b.column("code")) + 128


def score_bounds(anchors: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score of every row with every anchor: a component counts with the end of its cell that
    the sign of the anchor's component says."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ least.T + down @ greatest.T, up @ greatest.T + down @ least.T


class Best:
    """The k best (score, id, uid) of each list so far; higher scores first, then smaller ids."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.floor = np.full(lists, np.iinfo(np.int64).min)
        self.held = [np.empty((4, 0), np.int64)] * lists  # score, no id, id, uid

    def add(self, n: int, score: np.ndarray, rows: Rows, who: np.ndarray) -> None:
        if not len(who):
            return
        held = np.concatenate([self.held[n], np.stack([score, rows.no_id[who], rows.id[who], rows.uid[who]])], 1)
        held = held[:, np.lexsort((held[3], held[2], held[1], -held[0]))[: self.k]]
        self.held[n] = held
        if held.shape[1] == self.k:
            self.floor[n] = held[0, -1]

    def sure(self, n: int, least: np.ndarray) -> int:
        """What the k-th best score is at least, given also the least scores of rows that will be on the list."""
        return max(self.floor[n], np.partition(least, -self.k)[-self.k]) if len(least) >= self.k else self.floor[n]

    def batch(self, names: pa.Schema, own: list[tuple]) -> pa.RecordBatch:
        """A row for each row held: the list's own values, then score, id, uid."""
        size = [h.shape[1] for h in self.held]
        score, no_id, ids, uid = np.concatenate(self.held, 1) if self.held else np.empty((4, 0), np.int64)
        keys = [pa.array(np.repeat(np.arange(len(own)), size))]
        first = [pa.array([x[i] for x in own], f.type).take(keys[0]) for i, f in enumerate(names) if i < len(names) - 3]
        return pa.RecordBatch.from_arrays([*first, pa.array(score), pa.array(ids, mask=no_id.astype(bool)), pa.array(uid)], schema=names)


def _number(x: np.ndarray, peak: int) -> np.ndarray:
    """Doubles where all products of components stay exact in them (matrix products are fast then), or else integers."""
    return x.astype(np.float64) if peak * peak * max(x.shape[1], 1) < 1 << 53 else x


_POSITIVES = pa.schema([("a", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("uid", pa.int64())])
_NEGATIVES = pa.schema([("a", pa.int64()), ("p", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("uid", pa.int64())])


def _positives(index: DataFrame, anchors: Rows, cells: Cells, peak: int, k: int) -> DataFrame:
    """a (anchor's uid), score, id, uid: each task's k best rows of the same label."""
    spread = index.sparkSession.sparkContext.broadcast((anchors, cells))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        anchors, cells = spread.value
        best, vectors = Best(len(anchors), k), _number(anchors.v, peak)
        for rows, code in _in_slices(batches):
            least, greatest = (_number(x, peak) for x in cells.bounds(code))
            for label in np.intersect1d(anchors.label, rows.label):
                same, mine = np.flatnonzero(rows.label == label), np.flatnonzero(anchors.label == label)
                for cut in _cut(len(mine)):
                    lower, upper = score_bounds(vectors[mine[cut]], least[same], greatest[same])
                    for n, low, high in zip(mine[cut], lower, upper, strict=True):
                        others = rows.uid[same] != anchors.uid[n]
                        who = same[others & (high >= best.sure(n, low[others]))]
                        best.add(n, rows.v[who] @ anchors.v[n], rows, who)
        yield best.batch(_POSITIVES, [(u,) for u in anchors.uid.tolist()])
        release()

    return index.mapInArrow(scan, "a long, score long, id long, uid long")


@dataclass
class Windows:
    """Each anchor's windows: first[n] to first[n + 1] are those of anchor n."""

    first: np.ndarray
    own: list[tuple]  # anchor's uid, positive's uid, anchor's id, positive's id, positive's score
    lo: np.ndarray
    hi: np.ndarray


def _windows(anchors: Rows, positives: list, low: int, high: int) -> Windows:
    by: dict[int, list] = {}
    for r in positives:
        by.setdefault(r["a"], []).append(r)
    own, first = [], [0]
    for n, a in enumerate(anchors.uid.tolist()):
        name = None if anchors.no_id[n] else int(anchors.id[n])
        own += [(a, r["uid"], name, r["id"], r["score"]) for r in by.get(a, [])]
        first.append(len(own))
    scores = [x[4] for x in own]
    lo = np.array([-(-low * s // 100) for s in scores], np.int64)
    return Windows(np.array(first), own, lo, np.array([high * s // 100 for s in scores], np.int64))


def _negatives(index: DataFrame, anchors: Rows, windows: Windows, cells: Cells, peak: int, k: int) -> DataFrame:
    """Each task's k best rows of another label for each window."""
    spread = index.sparkSession.sparkContext.broadcast((anchors, windows, cells))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        anchors, windows, cells = spread.value
        best, vectors = Best(len(windows.own), k), _number(anchors.v, peak)
        for rows, code in _in_slices(batches):
            least, greatest = (_number(x, peak) for x in cells.bounds(code))
            for cut in _cut(len(anchors)):
                for n, low, high in zip(range(len(anchors))[cut], *score_bounds(vectors[cut], least, greatest), strict=True):
                    span = range(windows.first[n], windows.first[n + 1])
                    other = rows.label != anchors.label[n]
                    may = []
                    for w in span:
                        lo, hi = windows.lo[w], windows.hi[w]
                        floor = best.sure(w, low[other & (low >= lo) & (high <= hi)])
                        may.append(other & (high >= lo) & (low <= hi) & (high >= floor))
                    if not (who := np.flatnonzero(np.logical_or.reduce(may)) if may else np.empty(0, np.int64)).size:
                        continue
                    score = rows.v[who] @ anchors.v[n]
                    for w, own in zip(span, may, strict=True):
                        good = own[who] & (score >= windows.lo[w]) & (score <= windows.hi[w]) & (score >= best.floor[w])
                        best.add(w, score[good], rows, who[good])
        yield best.batch(_NEGATIVES, windows.own)
        release()

    return index.mapInArrow(scan, "a long, p long, anchor_id long, positive_id long, positive_score long, score long, id long, uid long")


def _first(rows: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The first k rows of each list, of the at most k that each task has sent."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    return rows.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def mine(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `anchor` holds; positives are an anchor's best other rows of its label; negatives the
    best rows of other labels whose scores are low to high hundredths of the positive's. Scores are inner products of
    floor(scale * x), higher ones first, ties by smaller id. All rows are indexed and results are exact.

    Rows with a null label or vector or with a null, NaN or infinite component take no part. Scaled components beyond
    LARGEST count as LARGEST; shorter vectors end in zeros, empty ones are all zeros. Rows that share an id are different
    rows, repeated ones too: each repeated anchor has its own results, and the repeats are positives of one another. A null
    id stays null and comes last among equal scores. A positive of negative score has no negatives (no score lies in the
    window). Other columns, of any name, are not read. No rows give none.
    """
    spark, at = rows.sparkSession, work_dir(rows.sparkSession)
    vectors = stored(integer_vectors(rows, id_col, vector_col, label_col, anchor, scale), at, "vectors")
    cells = fit_cells(vectors)
    peak = int(max(np.abs(cells.lo).max(), np.abs(cells.hi).max())) if cells.starts else 0
    index = approximation_file(vectors, cells, at)
    groups = max(1, -(-index.filter("anchor").count() // GROUP))
    found = []
    for g in range(groups):
        mine_ = index.filter("anchor").filter(F.pmod(F.xxhash64("uid"), F.lit(groups)) == g)
        anchors = Rows(mine_.select("uid", "id", "label", "v").toArrow())
        best = _first(_positives(index, anchors, cells, peak, positives), ["a"], positives, "n")
        windows = _windows(anchors, best.collect(), low, high)
        found.append(stored(_first(_negatives(index, anchors, windows, cells, peak, negatives), ["a", "p"], negatives, "rank"), at, f"negatives-{g}"))
    every = spark.read.schema(found[0].schema).parquet(*(f"{at}/negatives-{g}" for g in range(groups)))
    return every.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
