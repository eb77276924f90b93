"""Token-id output: documents to ids of a public tokenizer, written in range-coded chunks, and read back.

A written table is a folder of Parquet files, a row per chunk: `part` and `seq` give the order, `before` the
ids of the same part before the chunk, and `payload` the chunk in the file format: a directory of its whole
documents, then range-coded blocks (see range_coder). Parts hold ascending ranges of document ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm.common import forget, release, remembered, work_dir
from rillstone.llm.range_coder import decode_ids, encode_ids

#: A chunk is closed when it has this many ids; a document is never cut.
CHUNK_IDS = 1 << 22
#: Texts of about this size are cut and looked up at once.
TEXT_BYTES = 1 << 22
#: Places where the byte-level pre-tokenizer always parts tokens: before one space between two other characters than
#: white space, around one line feed between such, and where letters or digits end before a mark (not an apostrophe).
_PARTS = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=[^\W_])(?=[!-&(-/:-@\[-^`{-~])")
#: White space other than the space and the line feed.
_ODD_SPACE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]


def byte_units() -> dict[int, str]:
    """The characters by which byte-level tokenizers write bytes: printable ones stand for themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_UNITS = byte_units()


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def even(text: str) -> bool:
    """White space is single spaces and line feeds between other characters."""
    flat = text.replace("\n", " ")
    return "  " not in flat and flat[0] != " " and flat[-1] != " " and "\0" not in text and not any(c in text for c in _ODD_SPACE)


class Known(dict):
    """Ids of pieces, as bytes; one that isn't there is taken from the old ones, or encoded."""

    def __init__(self, old: dict[str, bytes], encode: Callable[[str], bytes]):
        super().__init__()
        self.old, self.encode = old, encode

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.old.pop(piece, b"") or self.encode(piece)
        return ids


class Ids:
    """Ids of texts by a byte-level BPE of the tokenizers library. Pieces of texts are encoded once per worker and
    remembered while they fit: the latest LIMIT, and those before that were asked for again."""

    LIMIT = 600_000

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end]).astype("<u4").tobytes()
        form = json.loads(self.tokenizer.to_str())
        before = form["pre_tokenizer"] or {}
        self.plain = (
            form["normalizer"] is None and form["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space") and before.get("use_regex", True)
        )
        self.size = max(self.tokenizer.get_vocab_size(), end + 1)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known({}, self.encode)

    @property
    def old(self) -> dict[str, bytes]:
        return self.known.old

    def cut(self, text: str | None) -> list[str]:
        """The text cut at places where tokens always part."""
        if not text:
            return []
        # tokens that the tokenizer finds before all else aren't to be cut
        return [text] if any(t in text for t in self.added) else _PARTS.split(text)

    def encode(self, piece: str) -> bytes:
        if not piece:
            return b""
        if self.plain and (piece[1:] if piece[0] == " " else piece).isalpha():
            # all letters: one pre-token, which needs no more than the model
            if piece.isascii():
                units = piece.replace(" ", BYTE_UNITS[32])
            else:
                units = piece.encode().decode("latin-1").translate(BYTE_UNITS)
            ids = [t.id for t in self.tokenizer.model.tokenize(units)]
        else:
            ids = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids
        return array("I", ids).tobytes()

    def of_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text, and the end id."""
        if len(self.known) > self.LIMIT:  # what isn't asked for again is forgotten, what is stays
            self.known.old = {}
            self.known = Known(self.known, self.encode)
        plain = [k for k, t in enumerate(texts) if t and even(t) and not any(a in t for a in self.added)]
        found = dict(zip(plain, self.of_even([texts[k] for k in plain]), strict=True))
        for k, t in enumerate(texts):
            if (ids := found.pop(k, None)) is None:
                ids = np.frombuffer(b"".join([*map(self.known.__getitem__, self.cut(t)), self.end]), "<u4")
            yield ids

    def of_even(self, texts: list[str]) -> list[np.ndarray | None]:
        """Of even texts, all at once: each distinct piece is looked up once. None for a text in which stops stand apart,
        where it can't be cut before them."""
        if not texts:
            return []
        marked = pa.array(texts, pa.large_string())
        for mark in (" ", ".", ","):
            marked = pc.replace_substring(marked, mark, "\0" + mark)
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", "\0\n\0"), "\0")
        cut = lists.values.dictionary_encode()
        pieces, codes, ends = cut.dictionary.to_numpy(zero_copy_only=False).tolist(), cut.indices.to_numpy(), lists.offsets.to_numpy()[1:]
        stops = pc.or_(pc.starts_with(cut.dictionary, "."), pc.starts_with(cut.dictionary, ",")).to_numpy(zero_copy_only=False)
        at = stops[codes[1:]].nonzero()[0]  # pieces before stops; of a text that begins with one, an empty piece
        open_ = np.zeros(len(pieces), bool)
        open_[codes[at]] = True
        for k in open_.nonzero()[0]:
            open_[k] = not pieces[k][-1:].isalnum()
        loose = at[open_[codes[at]]]
        ids = [*map(self.known.__getitem__, pieces), self.end]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        codes = np.insert(codes, ends, len(pieces))
        each, first = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        upto = np.cumsum(each)
        flat = np.frombuffer(b"".join(ids), "<u4")
        out = flat[np.arange(upto[-1]) + np.repeat(first - upto + each, each)]
        found = np.split(out, upto[ends + np.arange(len(ends))][:-1])
        for k in np.unique(np.searchsorted(ends, loose, "right")):
            found[k] = None
        return found


def worker_ids(path: str, end: int) -> Ids:
    """This worker's tokenizer, which keeps what it remembers for later tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return remembered(f"ids {end} {path}", lambda: Ids(path, end))


def chunk_bytes(docs: list[int | None], sizes: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """The directory (number of documents, then flag, id and size of each, and its crc32), then the ids."""
    table = b"".join(struct.pack("<BqI", d is not None, d or 0, n) for d, n in zip(docs, sizes, strict=True))
    return struct.pack("<II", len(docs), zlib.crc32(table)) + table + encode_ids(ids, vocabulary)


def read_chunk(data: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    n, crc = struct.unpack_from("<II", data)
    table = data[8 : 8 + 13 * n]
    if zlib.crc32(table) != crc:
        raise ValueError("the checksum of a chunk's directory doesn't hold")
    rows = [*struct.iter_unpack("<BqI", table)]
    return [d if f else None for f, d, _ in rows], [x for _, _, x in rows], decode_ids(data[8 + 13 * n :])


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
) -> None:
    """Write docs' ids to the folder `path`, in ascending order of document ids (null first).

    Rows of one id are in the order of a hash of their texts, equal ones of their places, so that ranges can part them."""
    at = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = worker_ids(at, end_id)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names, ids, held = [], [], 0

        def closed() -> pa.RecordBatch:
            sizes, whole = [len(x) for x in ids], np.concatenate(ids)
            ids.clear()
            data = chunk_bytes(names, sizes, whole, known.size)
            row = [[part], [seq], [before], [held], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, out, strict=True)], schema=out)

        for whole in batches:
            bytes_to = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            starts = np.flatnonzero(np.diff(bytes_to // TEXT_BYTES, prepend=-1))
            for i, j in zip(starts, np.r_[starts, whole.num_rows][1:], strict=True):  # no rows, no slices
                b = whole.slice(i, j - i)
                for d, x in zip(b.column(0).to_pylist(), known.of_all(b.column(1).to_pylist()), strict=True):
                    names.append(d)
                    ids.append(x)
                    held += len(x)
                    if held >= CHUNK_IDS:
                        yield closed()
                        seq, before = seq + 1, before + held
                        names, ids, held = [], [], 0
        if names:
            yield closed()
        names, ids = [], []
        release()

    out = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    order = ["doc_id", "h", "place"]
    rows = rows.withColumns({"h": F.xxhash64("t"), "place": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "t")
    schema = "part int, seq int, before long, n_ids long, payload binary"
    ordered.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit): the documents of a written folder, checksums verified.

    The offsets of parts come from one count per part.
    """
    chunks = spark.read.parquet(path)
    sums = dict(chunks.groupBy("part").agg(F.sum("n_ids")).collect())
    offsets, total = {}, 0
    for part in sorted(sums):
        offsets[part] = total
        total += sums[part]
    spread = spark.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for i in range(b.num_rows):
                part, before, payload = (c[i].as_py() for c in b.columns)
                docs, sizes, ids = read_chunk(payload)
                ends = np.cumsum(sizes, dtype=np.int64)
                start = ends - sizes + before + spread.value[part]
                bounds = pa.array(np.r_[0, 4 * ends], pa.int32()).buffers()[1]  # an error beyond 2 GB
                data = pa.Array.from_buffers(pa.binary(), len(docs), [None, bounds, pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(sizes, pa.int64()), data], schema=out)
        release()

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    schema = "doc_id long, start long, n_tokens long, ids binary"
    return chunks.select("part", "before", "payload").mapInArrow(run, schema)


def token_output(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write docs' tokens to path (a new folder in the shared one by default), read them back, and return per
    document doc_id, start, n_tokens and ids_crc32.

    Null and empty texts are the end id alone; rows with equal ids, and those without, follow each other in
    the order of a hash of their texts, each with its own start. Texts of any length are encoded whole. Other columns, of
    any name, are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or f"{work_dir(spark)}/tokens"
    write_tokens(docs, path, **options)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
