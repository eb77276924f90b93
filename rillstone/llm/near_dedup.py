"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: term frequency times a smoothed inverse document
frequency, from exact counts of all shingles. Consistent weighted samples agree between two sets with the probability
of their weighted Jaccard similarity; bands of samples name candidate groups, and each candidate link is verified by
the exact weighted Jaccard similarity of the whole texts.

Shingles are counted by ranges of their hashes, where they meet as packed lists, one for each block of documents and
range. What a range found goes back in the order of each list, a byte a shingle, and meets the block's texts again.

Groups are never expanded into pairs. The members of a band's group are first compared with the group's least
document. Where the others are then still of several classes, the group is cut into blocks, and every two blocks
are compared by products of sparse matrices in one task, which gives only the links that join classes. So every
two members of a group either have been compared or are joined by others.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import counted, forget, map_rows, mix, release, shingles_of, shuffles_freed, stored, with_group_min, word_hashes, work_dir

#: idf runs from 1 (in all texts) to 1 + this (in one). Small, so that what thousands of near copies share still outweighs
#: their edits.
IDF_SPAN = 0.25
#: Steps of the idf: few weights, so that samples come from tables.
IDF_STEPS = 16
IDF = 1 + IDF_SPAN * np.arange(IDF_STEPS + 1) / IDF_STEPS
#: Bytes of text of a block of documents, unless one document has more, and those whose shingles are counted in one place.
BLOCK_BYTES, RANGE_BYTES = 1 << 23, 1 << 24
_GRAIN_BITS = 16
_GRAIN = 1 << _GRAIN_BITS


def idf_steps(df: np.ndarray, total: int) -> np.ndarray:
    """The logarithm of total / df in steps: 0 for shingles of all texts, IDF_STEPS for those of one."""
    return np.rint(np.log(total / df) / max(math.log(total), 1e-9) * IDF_STEPS).astype(np.uint8)


def frequent_shingles(docs: DataFrame, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of two texts or more, their document frequencies, and the number of texts, of a small table: they are
    collected here. near_duplicates counts where the shingles are (shingle_steps)."""

    def name(x: dict) -> Iterator[dict]:
        for h in word_hashes(x["t"]):
            yield {"s": counted(shingles_of(h, n))[0].view(np.int64)}

    each = map_rows(docs.select(F.col(text_col).alias("t")), name, "s long", pa.schema([("s", pa.int64())]))
    found = each.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").toPandas()
    keys = found["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy(np.int64)[order], docs.count()


class Weights:
    """Weighted shingle sets of texts, from what frequent_shingles gives."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, total: int, n: int):
        self.keys, self.n, self.steps = keys, n, idf_steps(df, total)
        self.rare = idf_steps(np.ones(1), total)[0]

    def of_text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        s, tf = counted(shingles_of(word_hashes([text])[0], self.n))
        steps = np.full(len(s), self.rare)
        if len(self.keys) and len(s):
            at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
            hit = self.keys[at] == s
            steps[hit] = self.steps[at[hit]]
        return s, tf * IDF[steps]


def weighted(hashes: np.ndarray, steps: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, ascending, and their weights, of a text given by its words' hashes and its shingles' idf."""
    s, tf = counted(shingles_of(hashes, n))
    return s, tf * IDF[np.frombuffer(steps, np.uint8)]


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, place, size, doc_id, t): rows in blocks of some bytes of text, numbered in each from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        block, place, held = TaskContext.get().partitionId() << 33, 0, 0
        for b in batches:
            sizes, blocks, at = pc.fill_null(pc.binary_length(b.column("t")), 0).to_pylist(), [], []
            for size in sizes:
                if place == 0xFFFF or place and held + size > BLOCK_BYTES:
                    block, place, held = block + 1, 0, 0
                blocks.append(block)
                at.append(place)
                place, held = place + 1, held + size
            columns = [pa.array(v, f.type) for v, f in zip((blocks, at, sizes), out, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, b.column("doc_id"), b.column("t")], names=out.names)

    out = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("size", pa.int64()), ("doc_id", pa.int64()), ("t", pa.string())])
    return docs.select("doc_id", "t").mapInArrow(run, "block long, place int, size long, doc_id long, t string")


def packed(keys: np.ndarray, df: np.ndarray) -> bytes:
    """Ascending keys as differences, and counts below 2^16, byte by byte of all: most high bytes are zeros, which compress."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes() + df.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(10, -1)
    keys = np.ascontiguousarray(planes[:8].T).view("<u8").ravel()
    return np.cumsum(keys, dtype=np.uint64), np.ascontiguousarray(planes[8:].T).view("<u2").ravel()


def shingle_steps(rows: DataFrame, n: int, total: int, ranges: int) -> DataFrame:
    """(block, lo, range, steps): idf_steps of the exact document frequencies of all shingles of the texts in blocks.

    steps has a byte for each distinct shingle, ascending, of the range in the rows of the block from place lo to the next lo."""
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sets, at = [], None

        def closed() -> pa.RecordBatch:
            keys, df = counted(np.concatenate(sets))
            cuts = np.r_[0, np.searchsorted(keys, edges), len(keys)]
            some = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
            data = [packed(keys[cuts[r] : cuts[r + 1]], df[cuts[r] : cuts[r + 1]]) for r in some]
            columns = [some, [at[0]] * len(some), [at[1]] * len(some), data]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, out, strict=True)], schema=out)

        for b in batches:
            blocks, places, texts = (b.column(c).to_pylist() for c in ("block", "place", "t"))
            for i in range(0, len(texts), SOME):
                for block, place, h in zip(blocks[i : i + SOME], places[i : i + SOME], word_hashes(texts[i : i + SOME]), strict=True):
                    # rows of one block may lie in several tasks
                    if at and (block != at[0] or place != at[1] + len(sets)):
                        yield closed()
                        at = None
                    if at is None:
                        sets, at = [], (block, place)
                    sets.append(counted(shingles_of(h, n))[0])
        if at:
            yield closed()
        release()

    def weigh(pdf):
        import pandas as pd

        lists = [unpacked(x) for x in pdf.pop("payload")]
        sizes = [len(k) for k, _ in lists]
        keys, df = (np.concatenate(x) for x in zip(*lists, strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        found = idf_steps(np.add.reduceat(df[order].astype(np.int64), first), total)
        steps = np.empty(len(keys), np.uint8)
        steps[order] = np.repeat(found, np.diff(first, append=len(keys)))
        each = [x.tobytes() for x in np.split(steps, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"block": pdf["block"], "lo": pdf["lo"], "range": pdf["range"], "steps": each})

    out = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("lo", pa.int32()), ("payload", pa.binary())])
    lists = rows.select("block", "place", "t").mapInArrow(count, "range int, block long, lo int, payload binary")
    return lists.groupBy("range").applyInPandas(weigh, "block long, lo int, range int, steps binary")


#: Texts that are hashed at once.
SOME = 256


def steps_of_rows(sets: list[np.ndarray], answers: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The idf steps of a block's rows, given their shingles and what shingle_steps says of the block: (lo, range, steps)."""
    found = [np.empty(0, np.uint8)] * len(sets)
    answers = sorted(answers)
    los = sorted({a[0] for a in answers})
    for lo, hi in zip(los, [*los[1:], len(sets)], strict=False):
        keys = counted(np.concatenate(sets[lo:hi]))[0]
        steps = np.frombuffer(b"".join(x for k, _, x in answers if k == lo), np.uint8)
        if len(steps) != len(keys):
            raise ValueError("a block's shingles aren't those that were counted")
        for i in range(lo, hi):
            found[i] = steps[np.searchsorted(keys, sets[i])]
    return found


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][x], b[1][y]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both) if both else 0.0


class Sampler:
    """Improved consistent weighted samples, bands x rows of them, and the hash of each band.

    A sample of a shingle takes its draws (r, c ~ Gamma(2, 1), b ~ U(0, 1)) from one of _GRAIN places, by a hash of the
    shingle for that sample. Of shingles at the same place with the same level, the least hash goes first, in all texts
    alike. Most shingles of a text have the same few weights: their places' values are tables, made once by weight.
    """

    CHUNK = 1_024
    TABLES = 64

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng([seed, bands, rows])
        self.bands, self.rows, k = bands, rows, bands * rows
        self.mul = rng.integers(0, 2**31, k, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]
        self.r = rng.gamma(2.0, 1.0, _GRAIN).astype(np.float32)
        self.inv = (1 / self.r).astype(np.float32)
        self.b = rng.random(_GRAIN, np.float32)
        self.c = np.log(rng.gamma(2.0, 1.0, _GRAIN)).astype(np.float32)
        self.rows_of: dict[float, int] = {}
        self.tables = np.empty(0, np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows_of": {}, "tables": np.empty(0, np.float32)}

    def level(self, log_weight: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.floor(log_weight * self.inv[at] + self.b[at])

    def value(self, log_weight: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.c[at] - self.r[at] * (self.level(log_weight, at) - self.b[at] + np.float32(1))

    def table_of(self, weight: float) -> int:
        """Where the values of a weight begin: in tables for the first weights met, there are few common ones, or -1."""
        if (row := self.rows_of.get(weight)) is None:
            if len(self.rows_of) >= self.TABLES:
                return -1
            row = self.rows_of[weight] = len(self.tables)
            self.tables = np.r_[self.tables, self.value(np.float32(np.log(weight)), np.arange(_GRAIN))]
        return row

    def samples(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit name of the sampled (shingle, level) for each of the bands x rows samples. keys ascend."""
        least = np.full(len(self.mul), np.inf, np.float32)
        key, name, row = np.full(len(self.mul), 2**64 - 1, np.uint64), np.zeros(len(self.mul), np.uint64), np.arange(len(self.mul))
        kinds = counted(weights)[0]
        tables = np.array([self.table_of(w) for w in kinds.tolist()])[np.searchsorted(kinds, weights)]
        logs = np.log(weights).astype(np.float32)
        short = (keys ^ (keys >> np.uint64(32))).astype(np.uint32)
        for i in range(0, len(keys), self.CHUNK):
            s, log, table = (x[i : i + self.CHUNK] for x in (keys, logs, tables))
            h = short[i : i + self.CHUNK] * self.mul
            h += self.add
            h >>= np.uint32(32 - _GRAIN_BITS)
            at = h.astype(np.int64)
            at += table
            a = self.tables.take(at, mode="clip")
            if (other := np.flatnonzero(table < 0)).size:
                a[:, other] = self.value(log[other], h[:, other])
            best = a.argmin(1)
            low, new = a[row, best], s[best]
            win = np.flatnonzero((low < least) | ((low == least) & (new < key)))
            least[win], key[win] = low[win], new[win]
            level = self.level(log[best[win]], h[win, best[win]]).astype(np.int64).view(np.uint64)
            name[win] = mix(key[win] + level * np.uint64(0x9E3779B97F4A7C15))
        return name

    def band_keys(self, keys: np.ndarray, weights: np.ndarray) -> list[int]:
        got = self.samples(keys, weights).reshape(self.bands, self.rows)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + got[:, i])
        return acc.view(np.int64).tolist()


def _signed(rows: DataFrame, steps: DataFrame, n: int, sampler: Sampler) -> DataFrame:
    """(block, place, doc_id, key, bands, steps): key names the word sequence; key and bands are null without words."""
    spread = rows.sparkSession.sparkContext.broadcast(sampler)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.sort_by("place")
        hashes = word_hashes(texts["t"].to_pylist())
        sets = [counted(shingles_of(h, n)) for h in hashes]
        found = steps_of_rows([s for s, _ in sets], [*zip(*(answers[c].to_pylist() for c in ("lo", "range", "steps")), strict=True)])
        keys = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in hashes]
        bands = [spread.value.band_keys(s, tf * IDF[x]) if len(s) else None for (s, tf), x in zip(sets, found, strict=True)]
        columns = [keys, bands, [x.tobytes() for x in found]]
        columns = [pa.array(v, out.field(k + 3).type) for k, v in enumerate(columns)]
        return pa.Table.from_arrays([*texts.select(["block", "place", "doc_id"]).columns, *columns], names=out.names)

    out = pa.schema(
        [("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("steps", pa.binary())]
    )
    schema = "block long, place int, doc_id long, key binary, bands array<long>, steps binary"
    texts = rows.select("block", "place", "doc_id", "t").groupBy("block")
    return texts.cogroup(steps.groupBy("block")).applyInArrow(run, schema)


def _verified(edges: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, similarity, linked) of each candidate edge (a, b), from the whole texts."""

    def run(x: dict) -> Iterator[dict]:
        weigh = functools.lru_cache(256)(lambda t, steps: weighted(word_hashes([t])[0], steps, n))
        sides = zip(x["p"], x["p_steps"], x["q"], x["q_steps"], strict=True)
        sim = [weighted_jaccard(weigh(p, i), weigh(q, j)) for p, i, q, j in sides]
        yield {"a": x["a"], "b": x["b"], "similarity": sim, "linked": [s >= threshold for s in sim]}

    def side(node: str, name: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(node), F.col("t").alias(name), F.col("steps").alias(f"{name}_steps"))

    # the least of a large group is in very many edges: its text goes out once for every HUB of them, and they meet there
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("group_rows") / HUB)).alias("salt")
    edges = with_group_min(edges, ["a"], "b", "b").select("a", "b", salt)
    hubs = edges.select("a", "salt").distinct().join(side("a", "p"), "a")
    sides = edges.join(side("b", "q"), "b").join(hubs, ["a", "salt"])
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64()), ("linked", pa.bool_())])
    schema = "a long, b long, similarity double, linked boolean"
    return map_rows(sides.select("a", "b", "p", "p_steps", "q", "q_steps"), run, schema, out)


def components(links: DataFrame, at: str) -> DataFrame:
    """(node, class_id): the least node reachable over links (a, b), for every node that has a link.

    Alternating large-star and small-star steps; each is a few shuffles of the edges, and an edge table is
    written after each round, so that neither lineage nor any single node's neighbours pile up.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, turn, before = stored(edges, at, "edges-0"), 0, None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, turn = state, turn + 1
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        large = with_group_min(both, ["u"], "v", "v").withColumn("m", F.least("u", "group_min"))
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_group_min(large, ["u"], "v", "v")
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("group_min").alias("v")).filter("u > v")
        edges = stored(small.distinct(), at, f"edges-{turn}")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("class_id")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class_id")).union(roots)


#: Edges of one document that are compared in one place.
HUB = 512
#: Documents of a block in the comparison of a group whose members are of several classes.
BLOCK = 256
_COLUMNS = 4_096


def spanning_links(nodes: list[int], classes: list[int], sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links between nodes that are similar enough, as many as join their classes and no more.

    sets: shingles, frequencies in the text and idf. A shingle of frequency k counts as k items of its idf, so that the least common frequency is the number of
    common items and a product of matrices gives all intersections exactly.
    """
    n = len(nodes)
    owner = np.repeat(np.arange(n), [len(s) for s, _, _ in sets])
    key, tf, idf = (np.concatenate(x) for x in zip(*sets, strict=True)) if n else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))
    layer = np.concatenate([np.arange(t) for t in tf]) if len(tf) else np.empty(0, np.int64)
    item = mix(np.repeat(key, tf) + layer.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    owner, idf = np.repeat(owner, tf), np.repeat(idf, tf)
    total = np.bincount(owner, idf, n)
    names, at, times = np.unique(item, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    owner, idf = owner[shared], idf[shared]
    at = (np.cumsum(times > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, idf, at = owner[order], idf[order], at[order]
    both = np.zeros((n, n))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
        i, j = np.searchsorted(at, [lo, lo + _COLUMNS])
        x = np.zeros((n, _COLUMNS), np.float64)
        x[owner[i:j], at[i:j] - lo] = np.sqrt(idf[i:j])
        both += x @ x.T
    sim = both / np.maximum(total[:, None] + total[None, :] - both, 1e-12)
    root = {c: c for c in classes}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    for p, q in zip(*np.nonzero(np.triu(sim >= threshold - 1e-9, 1)), strict=True):
        a, b = find(classes[p]), find(classes[q])
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((nodes[p], nodes[q]))
    return links


def _open_groups(groups: DataFrame, of: DataFrame) -> DataFrame:
    """(bucket, node, class, n): members but the least of groups in which these are of several classes."""
    rest = groups.filter("a < b and group_rows > 2").select("bucket", F.col("b").alias("node"))
    rest = rest.join(of, "node", "left").select("bucket", "node", F.coalesce("class_id", "node").alias("class"))
    rest = with_group_min(rest, ["bucket"], "class", "node", least=2)
    return rest.filter("group_min < group_max").select("bucket", "node", "class", F.col("group_rows").alias("n"))


def _block_links(members: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b) of verified links between members of groups, block by block; a task holds two blocks of one group."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = members.select("bucket", "node", "class", own.alias("x"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("y"))
    each = other.select("bucket", "node", "class", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    each = each.join(texts.select(F.col("doc_id").alias("node"), "t", "steps"), "node")

    def compare(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["node", "t"])
        nodes, classes = pdf["node"].tolist(), pdf["class"].tolist()
        sets = [counted(shingles_of(h, n)) for h in word_hashes(pdf["t"].tolist())]
        sets = [(s, tf, IDF[np.frombuffer(x, np.uint8)]) for (s, tf), x in zip(sets, pdf["steps"], strict=True)]
        links = spanning_links(nodes, classes, sets, threshold)
        return pd.DataFrame({"a": [min(x) for x in links], "b": [max(x) for x in links]}, dtype="int64")

    return each.groupBy("bucket", "x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    n: int = 5,
    bands: int = 16,
    rows: int = 4,
    seed: int = 7,
) -> DataFrame:
    """doc_id, class_id (the class's least id) and n_links, a row per row of docs.

    Words are runs of letters and digits with A-Z in lower case; texts of fewer than n words are one shingle.
    At similarity 0.8 a pair of different texts shares a band with probability 1 - (1 - 0.8^rows)^bands =
    0.9998. n_links counts the verified links of a document's text to other texts, as far as they were
    needed to join the class. Equal word sequences are one node. A document without words (null, empty,
    only punctuation) is a class of its own; a null id has a null class; rows that share an id are one document. Texts of
    any length are read whole; an empty table gives no rows; other columns, of any name, are not read.
    """
    at = work_dir(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    with shuffles_freed(docs.sparkSession):
        docs = stored(in_blocks(docs), at, "docs", compression="zstd")
        total, size = docs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        steps = stored(shingle_steps(docs, n, total, 1 + size // RANGE_BYTES), at, "steps")
        signed = stored(_signed(docs, steps, n, Sampler(bands, rows, seed)), at, "signed")
        members = with_group_min(signed.filter("key is not null").select("key", "doc_id"), ["key"], "doc_id", "doc_id")
        members = stored(members.select("doc_id", F.col("group_min").alias("node")).distinct(), at, "members")
        nodes = signed.join(members.filter("doc_id = node").select("doc_id"), "doc_id", "left_semi")
        buckets = nodes.select(F.col("doc_id").alias("b"), F.explode("bands").alias("bucket")).distinct()
        groups = with_group_min(buckets, ["bucket"], "b", "b", least=2)
        groups = stored(groups.select("bucket", "b", F.col("group_min").alias("a"), "group_rows"), at, "groups")
        met = signed.join(groups.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi").select("block", "place", "steps")
        texts = docs.join(met.select("block", "place"), ["block", "place"], "left_semi").join(met, ["block", "place"])
        texts = stored(texts.select("doc_id", "t", "steps"), at, "texts")
        seen = _verified(groups.filter("a < b").select("a", "b").distinct(), texts, n, threshold)
        links = stored(seen.filter("linked").select("a", "b").distinct(), at, "links")
        rest = stored(_open_groups(groups, components(links, f"{at}/first")), at, "open")
        more = _block_links(rest, texts, n, threshold)
        links = stored(links.union(more).distinct(), at, "all-links")
        count = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        of = stored(components(links, f"{at}/all").join(count, "node"), at, "classes")
    found = members.join(of, "node", "left").select(
        "doc_id", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    found = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    out = signed.select("doc_id").join(found, "doc_id", "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
