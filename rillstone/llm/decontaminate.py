"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment holds some whole documents: its terms, and for each term the
ascending positions of its occurrences, delta-coded. Positions run through the segment's documents with a gap
after each, so no phrase crosses two documents. Phrases are found by intersection of offset-adjusted posting
lists, from a window's rarest term (by frequency in the whole corpus) to its commonest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import SLICE, encode, forget, map_rows, release, stored, words_of, work_dir

#: A segment is closed when it has this many words; a longer document is a segment by itself.
SEGMENT_WORDS = 400_000
#: Query phrases are broadcast in blocks of at most this many words (or one longer phrase).
BLOCK_WORDS = 1_000_000
#: Candidate positions examined at once.
CHUNK = 1 << 20

_INDEX = "segment string, ids array<long>, digests array<binary>, sizes array<long>, terms array<binary>, counts array<int>, postings binary"
_INDEX_ARROW = pa.schema(
    [
        ("segment", pa.string()),
        ("ids", pa.list_(pa.int64())),
        ("digests", pa.list_(pa.binary())),
        ("sizes", pa.list_(pa.int64())),
        ("terms", pa.list_(pa.binary())),
        ("counts", pa.list_(pa.int32())),
        ("postings", pa.binary()),
    ]
)


def pack(deltas: np.ndarray) -> bytes:
    """Byte planes of 64-bit deltas, compressed."""
    planes = np.ascontiguousarray(deltas.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def segment_of(name: str, ids: list, words: list[list[bytes]], digests: list[bytes]) -> dict:
    """The columns of one index row."""
    names: dict[bytes, int] = {}
    sizes = [len(w) for w in words]
    term = np.fromiter((names.setdefault(w, len(names)) for ws in words for w in ws), np.int64, sum(sizes))
    at = np.arange(len(term)) + np.repeat(np.arange(len(words)), sizes)
    order = np.argsort(term, kind="stable")
    counts = np.bincount(term, minlength=len(names))
    deltas = np.diff(at[order], prepend=0)
    first = np.cumsum(counts) - counts
    deltas[first] = at[order][first]
    return {
        "segment": [name],
        "ids": [ids],
        "digests": [digests],
        "sizes": [sizes],
        "terms": [[*names]],
        "counts": [counts.astype(np.int32)],
        "postings": [pack(deltas)],
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs' whole texts, a row per segment. A document without words is in it with size 0.

    A segment is named by its task and its place there, so segments are distinct also where rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        part, seq = TaskContext.get().partitionId(), 0
        ids, words, digests, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            row = segment_of(f"{part}-{seq}", ids, words, digests)
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in _INDEX_ARROW], schema=_INDEX_ARROW)

        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    words.append(words_of(t))
                    digests.append(text_digest(t))
                    size += len(words[-1]) + 1
                    if size >= SEGMENT_WORDS:
                        yield closed()
                        seq, ids, words, digests, size = seq + 1, [], [], [], 0
        if ids:
            yield closed()
        release()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, _INDEX)


def text_digest(text: str | None) -> bytes:
    """The md5 of a text; null is empty."""
    return hashlib.md5(encode(text), usedforsecurity=False).digest()


def digest_of(text_col: str) -> Column:
    """text_digest as a column."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))


@dataclass
class Block:
    """Query windows: `terms` (a row per window, -1 beyond its size), the `item` each is of, the vocabulary, and `whole`:
    each item's distinct terms and its number of words."""

    items: list
    vocabulary: dict[bytes, int]
    terms: np.ndarray
    item: np.ndarray
    size: np.ndarray
    whole: list[tuple[np.ndarray, int]]
    rank: np.ndarray | None = None


def blocks_of(items: Iterable[tuple], window: int) -> Iterator[Block]:
    """Blocks of the windows of (item_id, text); a text of fewer words, but not none, is one window."""
    names, vocabulary, rows, owner, whole, total = [], {}, [], [], [], 0

    def closed() -> Block:
        terms = np.full((len(rows), window), -1, np.int64)
        for k, r in enumerate(rows):
            terms[k, : len(r)] = r
        return Block(names, vocabulary, terms, np.array(owner, np.int64), (terms >= 0).sum(1), whole)

    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        if item is None or not ids:
            continue
        for s in range(max(1, len(ids) - window + 1)):
            rows.append(ids[s : s + window])
            owner.append(len(names))
        names.append(item)
        whole.append((np.unique(ids), len(ids)))
        total += len(ids)
        if total >= BLOCK_WORDS:
            yield closed()
            names, vocabulary, rows, owner, whole, total = [], {}, [], [], [], 0
    if rows:
        yield closed()


def term_counts(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Occurrences in the whole corpus of each term of a vocabulary that fits in a block."""
    spread = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(x: dict) -> Iterator[dict]:
        total = np.zeros(len(spread.value), np.int64)
        for terms, counts in zip(x["terms"], x["counts"], strict=True):
            at = np.fromiter((spread.value.get(t, -1) for t in terms), np.int64, len(terms))
            total[at[at >= 0]] += np.array(counts, np.int64)[at >= 0]
        hit = np.flatnonzero(total)
        yield {"term": hit, "n": total[hit]}

    out = pa.schema([("term", pa.int64()), ("n", pa.int64())])
    found = map_rows(index.select("terms", "counts"), run, "term long, n long", out).groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(vocabulary), np.int64)
    for term, n in found.toLocalIterator():
        counts[term] = n
    return counts


class Segment:
    """A decoded index row: the postings of a vocabulary as ascending keys, term << 40 | position."""

    def __init__(self, ids, sizes, terms, counts, postings, vocabulary: dict[bytes, int]):
        self.ids, self.sizes = ids, np.array(sizes, np.int64)
        self.base = np.cumsum(self.sizes + 1) - self.sizes - 1
        counts = np.array(counts, np.int64)
        deltas = unpack(postings)
        first = np.cumsum(counts) - counts
        run = np.cumsum(deltas)
        at = run - np.repeat(run[first] - deltas[first], counts) if len(deltas) else deltas
        term = np.repeat(np.fromiter((vocabulary.get(t, -1) for t in terms), np.int64, len(terms)), counts)
        known = term >= 0
        self.keys = np.sort((term[known] << 40) | at[known])

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        want = (term << 40) | at
        i = np.searchsorted(self.keys, want)
        return (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] == want) & (at >= 0)

    def phrases(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window, start position) of every occurrence of a window of the block."""
        empty = np.empty(0, np.int64)
        if not len(self.keys):
            return empty, empty
        rarest = b.rank[:, 0]
        term = b.terms[np.arange(len(b.terms)), rarest]
        lo, hi = np.searchsorted(self.keys, term << 40), np.searchsorted(self.keys, (term + 1) << 40)
        found = [(empty, empty)]
        step, n = 0, np.cumsum(hi - lo)
        while step < len(n):
            # windows whose rarest terms have up to CHUNK postings here, at least one window
            end = max(step + 1, int(np.searchsorted(n, (n[step - 1] if step else 0) + CHUNK, "right")))
            size = (hi - lo)[step:end]
            window = np.repeat(np.arange(step, end), size)
            within = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
            start = (self.keys[lo[window] + within] & ((1 << 40) - 1)) - rarest[window]
            for k in range(1, b.terms.shape[1]):
                off = b.rank[window, k]
                want = b.terms[window, off]
                ok = (want < 0) | self.has(want, start + off)
                window, start = window[ok], start[ok]
                if not len(window):
                    break
            found.append((window, start))
            step = end
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, "right") - 1

    def spans(self, terms: np.ndarray, within: int) -> list[tuple[int, int]]:
        """First and last place of the least spans of at most `within` words of one document that hold all terms: lists are
        cut to what lies near the rarest term's places, then walked once."""
        lo, hi = np.searchsorted(self.keys, terms << 40), np.searchsorted(self.keys, (terms + 1) << 40)
        if not len(terms) or (lo == hi).any():
            return []
        lists = [self.keys[i:j] & ((1 << 40) - 1) for i, j in zip(lo, hi, strict=True)]
        rare, near = min(lists, key=len), []
        for at in sorted(lists, key=len):  # rarest first: an empty one ends it
            i = np.minimum(np.searchsorted(rare, at), len(rare) - 1)
            gap = np.minimum(abs(rare[i] - at), abs(rare[np.maximum(i - 1, 0)] - at))
            near.append(at[gap < within])
            if not len(near[-1]):
                return []
        places = np.concatenate(near)
        owner = np.repeat(np.arange(len(near)), [len(x) for x in near])
        order = np.argsort(places, kind="stable")
        last, found = [-(1 << 41)] * len(near), []
        for p, k in zip(places[order].tolist(), owner[order].tolist(), strict=True):
            last[k] = p
            first = min(last)
            if p - first < within:
                d = self.doc_of(np.array([first, p]))
                if d[0] == d[1] and (not found or first > found[-1][0]):
                    found.append((first, p))
        return found

    def scattered(self, b: Block) -> np.ndarray:
        """For each document, of how many items it holds all words, in any order, within twice as many words."""
        n = np.zeros(len(self.ids), np.int64)
        for terms, size in b.whole:
            if spans := self.spans(terms, 2 * size):
                n[np.unique(self.doc_of(np.array([first for first, _ in spans])))] += 1
        return n


_MATCH = "segment string, ord int, doc_id long, digest binary, n_words long, starts array<long>, ends array<long>, items array<long>, near long"
_MATCH_ARROW = pa.schema(
    [
        ("segment", pa.string()),
        ("ord", pa.int32()),
        ("doc_id", pa.int64()),
        ("digest", pa.binary()),
        ("n_words", pa.int64()),
        ("starts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("items", pa.list_(pa.int64())),
        ("near", pa.int64()),
    ]
)


def _match_block(index: DataFrame, block: Block, near: bool) -> DataFrame:
    n = term_counts(index, block.vocabulary)
    frequency = np.where(block.terms >= 0, n[block.terms], np.iinfo(np.int64).max)
    block.rank = np.argsort(frequency, axis=1, kind="stable")
    spread = index.sparkSession.sparkContext.broadcast(block)

    def run(x: dict) -> Iterator[dict]:
        b = spread.value
        for row in zip(*(x[k] for k in ("segment", "digests", "ids", "sizes", "terms", "counts", "postings")), strict=True):
            seg = Segment(*row[2:], b.vocabulary)
            window, start = seg.phrases(b)
            doc = seg.doc_of(start)
            order = np.lexsort((start, doc))
            window, start, doc = window[order], start[order], doc[order]
            cut = np.searchsorted(doc, np.arange(len(seg.ids) + 1))
            out: dict[str, list] = {k: [] for k in ("starts", "ends", "items")}
            for d in range(len(seg.ids)):
                w, s = window[cut[d] : cut[d + 1]], start[cut[d] : cut[d + 1]] - seg.base[d]
                first, last = merged(s, s + b.size[w])
                out["starts"].append(first)
                out["ends"].append(last)
                out["items"].append(sorted({b.items[i] for i in np.unique(b.item[w])}))
            ords = [*range(len(seg.ids))]
            out["near"] = seg.scattered(b) if near else [0] * len(ords)
            yield {"segment": [row[0]] * len(ords), "ord": ords, "doc_id": seg.ids, "digest": row[1], "n_words": seg.sizes} | out

    return map_rows(index, run, _MATCH, _MATCH_ARROW)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same places as spans in order of their starts."""
    if not len(start):
        return start, end
    far = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > far[:-1]]
    return start[new], far[np.r_[new[1:], True]]


def matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, near: bool = False) -> DataFrame:
    """Exact phrase matches, a row per indexed document: its words, merged spans (starts, ends in words), and item ids; and
    with `near`, of how many items the words lie close together, in any order (within twice as many words).


    The items are the query set: they are streamed through the driver in blocks of BLOCK_WORDS words, each block
    meets all segments, and the blocks' spans and items are united per document.
    """
    index = stored(index, work_dir(index.sparkSession), "index")
    rows = items.select(F.col(id_col).cast("long"), text_col).toLocalIterator()
    found, many = None, False
    for k, block in enumerate(blocks_of(rows, window)):
        part = _match_block(index, block, near)
        found = part if found is None else found.union(part)
        many = k > 0
    if found is None:
        none = F.array().cast("array<long>")
        docs = index.select("segment", F.posexplode(F.arrays_zip("ids", "digests", "sizes")).alias("ord", "d"))
        return docs.select(
            "segment", "ord", F.col("d.ids").alias("doc_id"), F.col("d.digests").alias("digest"), F.col("d.sizes").alias("n_words"),
            none.alias("starts"), none.alias("ends"), none.alias("items"), F.lit(0).cast("long").alias("near"),
        )
    if not many:
        return found

    def unite(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("starts", "ends", "items")}
        for s, e, i in zip(x["starts"], x["ends"], x["items"], strict=True):
            s, e = (np.concatenate([np.array(y, np.int64) for y in z]) for z in (s, e))
            order = np.argsort(s, kind="stable")
            first, last = merged(s[order], e[order])
            out["starts"].append(first)
            out["ends"].append(last)
            out["items"].append(sorted({y for z in i for y in z}))
        yield {k: x[k] for k in (*keys, "near")} | out

    keys = ["segment", "ord", "doc_id", "digest", "n_words"]
    # an item is in one block, so what blocks have found is added up
    by = found.groupBy(*keys).agg(*(F.collect_list(c).alias(c) for c in ("starts", "ends", "items")), F.sum("near").alias("near"))
    return map_rows(by, unite, _MATCH, _MATCH_ARROW)


def proximity(index: DataFrame, queries: list[tuple[str, list[str]]] | list[tuple[str, list[str], int]], within: int = 0) -> DataFrame:
    """(query, doc_id, start, end): least spans of at most `within` words that hold all words of a query, in any order.

    queries: (name, words) or (name, words, within), broadcast. A span is least when no shorter span inside it holds all the words. A word that
    repeats counts once; a query without words finds nothing; documents without words, repeated ones and null ids are
    treated like all others; an empty index gives no rows.
    """
    asked = [(name, sorted({w for t in words for w in words_of(t)}), *(own or [within])) for name, words, *own in queries]
    spread = index.sparkSession.sparkContext.broadcast(asked)

    def run(x: dict) -> Iterator[dict]:
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws, _ in spread.value for w in ws}))}
        for row in zip(*(x[k] for k in ("ids", "sizes", "terms", "counts", "postings")), strict=True):
            seg = Segment(*row, vocabulary)
            out: dict[str, list] = {k: [] for k in ("query", "doc_id", "start", "end")}
            for name, words, within in spread.value:
                for first, p in seg.spans(np.array([vocabulary[w] for w in words], np.int64), within):
                    d = int(seg.doc_of(np.array([first]))[0])
                    for c, v in zip(out, (name, seg.ids[d], first - int(seg.base[d]), p + 1 - int(seg.base[d])), strict=True):
                        out[c].append(v)
            yield out

    out = pa.schema([("query", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    return map_rows(index, run, "query string, doc_id long, start long, end long", out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, near: bool = False) -> DataFrame:
    """A row per document: doc_id, digest, n_words, n_hit (words inside an occurrence of a window), n_items, items, contaminated.

    digest is the text's md5, by which a verdict finds its rows also where ids are null or shared. Null, empty and
    wordless texts have no words and are clean; a benchmark item without words or id names nothing. Repeated rows
    each get their row, however many blocks the benchmark takes; items of equal text are all named. Texts are indexed
    whole; an empty table gives no rows, an empty benchmark no hits. Only the id and the text of docs are read. With `near`
    there is n_near too: the items whose words all lie close together in the document (see matches).
    """
    found = matches(build_index(docs), benchmark, window=window, near=near)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    out = ["doc_id", "digest", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (hit > 0).alias("contaminated")]
    return found.select(*out, *([F.col("near").alias("n_near")] if near else []))
