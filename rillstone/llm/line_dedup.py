"""Line de-duplication: which lines of which documents repeat, as compressed keep bitmaps.

Hashes of lines are range-partitioned together with document and position, so that a line that very many
documents share is split over partitions too, and sorted with the greatest document first. Each partition is
streamed once: runs of one hash that lie inside it are decided there; for the run at either edge, which other
partitions may hold more of, a bounded summary per partition decides afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import ascii_lower, encode, map_rows, stored, work_dir

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """A line as it is compared: without white space of ASCII at its ends; its A-Z count as lower case."""
    return line.strip(SPACE)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id, row, pos) of every line of at least min_chars code points; `row` tells rows of one id apart."""

    def run(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("key", "doc_id", "row", "pos")}
        for d, row, text in zip(x["doc_id"], x["row"], x["t"], strict=True):
            for pos, line in enumerate(text.split("\n") if text else ()):
                if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                    out["key"].append(xxhash.xxh3_128_digest(ascii_lower(encode(key))))
                    out["doc_id"].append(d)
                    out["row"].append(row)
                    out["pos"].append(pos)
        yield out

    out = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])
    return map_rows(docs.filter("doc_id is not null"), run, "key binary, doc_id long, row long, pos int", out)


_FOUND = "kind string, key binary, doc_id long, row long, pos int, n int"


def _streamed(lines: DataFrame, min_docs: int) -> DataFrame:
    """Rows of kind `drop`, decided; `open`, of a run at a partition's edge; `run`, a decided run at its end."""
    out = pa.schema(
        [("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first_run, top, doc, n, held = None, True, None, None, 0, []
        for b in batches:
            rows: list[tuple] = []
            for k, d, row, pos in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    first_run = key is None
                    key, top, doc, n, held = k, d, d, 1, []
                elif d != doc:
                    doc, n = d, n + 1
                if first_run:
                    rows.append(("open", k, d, row, pos, 0))
                elif d == top:
                    if n < min_docs:  # the run may go on in the next partition, so its greatest document counts there
                        held.append(("open", k, d, row, pos, 0))
                elif n < min_docs:
                    held.append(("open", k, d, row, pos, 0))
                else:
                    rows += (("drop", *h[1:]) for h in held if h[2] != top)
                    held = []
                    rows.append(("drop", k, d, row, pos, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out, strict=True)], schema=out)
        if key is not None and not first_run:
            last = [("run", key, top, None, None, n)] if n >= min_docs else held
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), out, strict=True)], schema=out)

    return lines.select("key", "doc_id", "row", "pos").mapInArrow(run, _FOUND)


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, at: str) -> DataFrame:
    """(doc_id, row, pos) of the lines to drop."""
    lines = stored(line_hashes(docs, min_chars), at, "lines")
    order = [F.col("key"), F.col("doc_id").desc(), F.col("row"), F.col("pos")]
    found = stored(_streamed(lines.repartitionByRange(*order).sortWithinPartitions(*order), min_docs), at, "found")
    edge = found.filter("kind <> 'drop'").groupBy("key", "doc_id").agg(F.max("n").alias("n"))
    # at most two keys a partition
    edge = edge.groupBy("key").agg(F.max("doc_id").alias("top"), (F.count("*") + F.max("n")).alias("n_docs"))
    edge = edge.filter(F.col("n_docs") >= min_docs).select("key", "top")
    late = found.filter("kind = 'open'").join(F.broadcast(edge), "key").filter("doc_id < top")
    return found.filter("kind = 'drop'").select("doc_id", "row", "pos").union(late.select("doc_id", "row", "pos"))


def bitmap(n: int, dropped: list[int]) -> bytes:
    bits = np.ones(n, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def kept_lines(text: str | None, keep: bytes) -> str:
    """The text that a bitmap leaves."""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([x for x, b in zip(lines, bits.tolist(), strict=True) if b])


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, with_text: bool = False
) -> DataFrame:
    """doc_id, n_lines, n_dropped and keep, a row per row of docs; keep is a compressed bitmap of the lines (1: keep).

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least min_chars
    code points in at least min_docs documents lose all their lines but those in the greatest document that holds
    them. Null and empty texts are one empty line. Rows that share an id are one document in the counts; rows with
    a null id are not counted and keep all lines. Texts and lines of any length are read whole; an empty table gives no
    rows; other columns, of any name, are not read. with_text adds the text, for reading the bitmap.
    """
    at = work_dir(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("t"))
    gone = repeated_lines(docs, min_chars, min_docs, at)
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    joined = docs.join(gone.hint("shuffle_hash"), ["doc_id", "row"], "left")
    columns = [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())]

    def run(x: dict) -> Iterator[dict]:
        sizes = [1 + (t or "").count("\n") for t in x["t"]]
        gone = [g or [] for g in x["gone"]]
        keep = [bitmap(n, g) for n, g in zip(sizes, gone, strict=True)]
        yield {"doc_id": x["doc_id"], "n_lines": sizes, "n_dropped": [len(g) for g in gone], "keep": keep, "text": x["t"]}

    out = pa.schema([*columns, ("text", pa.string())] if with_text else columns)
    schema = "doc_id long, n_lines long, n_dropped long, keep binary" + ", text string" * with_text
    return map_rows(joined.select("doc_id", "t", "gone"), run, schema, out)
