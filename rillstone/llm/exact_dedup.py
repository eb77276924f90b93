"""Exact de-duplication with Patricia tries that know the owner of every text.

Every task first owns what it reads: it inserts whole normalised byte strings into a compressed radix trie
whose terminal nodes keep the text's owner and members. Only one row per distinct text of a task goes on, to
the partition of its length and content hash, where one trie holds all texts of that partition and settles their
owners. A trie that outgrows its memory gives up its largest subtree, whose terminals are passed on and forgotten; a
text that comes again after that has several answers, which are put together by its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import ascii_lower, encode, stored, work_dir

#: Bytes of labels and members that a trie holds.
TRIE_BYTES = 48 << 20
#: A text of more tasks' rows than this is wide; so many wide texts' answers are broadcast (about 100 bytes each).
MANY_TASKS, MOST_WIDE = 256, 100_000


class Node:
    __slots__ = ("edges", "label", "owner", "count", "members", "name", "tasks")

    def __init__(self, label: bytes):
        self.label, self.edges, self.owner, self.count, self.members, self.name = label, {}, None, 0, None, None
        self.tasks = 0


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 32:  # halve while slices compare fast
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo + len(commonprefix([a[lo:n], b[lo:n]]))


class PatriciaTrie:
    """Whole byte strings, path-compressed; terminals keep an owner, a count and members."""

    def __init__(self, largest: bool):
        self.root, self.prefer, self.bytes = Node(b""), max if largest else min, 0

    def insert(self, key: bytes, owner: int | None, count: int = 1, member: int | None = None, listed: bool = False) -> Node:
        node, at = self.root, 0
        while at < len(key):
            child = node.edges.get(key[at])
            if child is None:
                node.edges[key[at]] = child = Node(key[at:])
                self.bytes += len(key) - at + 300
                node, at = child, len(key)
                break
            rest = key[at : at + len(child.label)]
            n = shared(child.label, rest)
            if n < len(child.label):  # split the edge
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.edges[child.label[0]] = child
                node.edges[key[at]] = child = upper
                self.bytes += 300
            node, at = child, at + n
        if owner is not None:
            node.owner = owner if node.owner is None else self.prefer(node.owner, owner)
        node.count += count
        if listed:
            node.members = node.members or []
            node.members.append(member)
            self.bytes += 40
        return node

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        stack = [(node or self.root, prefix)]
        while stack:
            x, before = stack.pop()
            text = before + x.label
            if x.count:
                yield text, x
            stack += ((c, text) for c in x.edges.values())

    def spill(self) -> Iterator[tuple[bytes, Node]]:
        """The terminals of the largest subtree below the root, and of the root; both are forgotten."""

        def weight(top: Node) -> int:
            total, stack = 0, [top]
            while stack:
                x = stack.pop()
                total += len(x.label) + 300 + 40 * len(x.members or ())
                stack += x.edges.values()
            return total

        if self.root.count:
            yield b"", self.root
            self.bytes -= 40 * len(self.root.members or ())
            self.root.owner, self.root.count, self.root.members, self.root.tasks = None, 0, None, 0
        if self.root.edges:
            sizes = {k: weight(c) for k, c in self.root.edges.items()}
            k = max(sizes, key=sizes.get)
            yield from self.terminals(self.root.edges.pop(k))
            self.bytes -= sizes[k]


_LOCAL = "name string, length long, hash long, body binary, owner long, n long, members array<long>"
_LOCAL_ARROW = pa.schema(
    [
        ("name", pa.string()),
        ("length", pa.int64()),
        ("hash", pa.int64()),
        ("body", pa.binary()),
        ("owner", pa.int64()),
        ("n", pa.int64()),
        ("members", pa.list_(pa.int64())),
    ]
)


def local_owners(docs: DataFrame, largest: bool) -> DataFrame:
    """A row per distinct text of a task (or of a spilled subtree), with the ids of the rows that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)

        def batch(found: Iterator[tuple[bytes, Node]]) -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[] for _ in _LOCAL_ARROW]
            size = 0
            for body, x in found:
                digest = hashlib.sha256(body)
                row = (digest.hexdigest(), len(body), int.from_bytes(digest.digest()[:8], "big", signed=True), body, x.owner, x.count, x.members)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                size += len(body)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LOCAL_ARROW, strict=True)], schema=_LOCAL_ARROW)
                    cols, size = [[] for _ in _LOCAL_ARROW], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LOCAL_ARROW, strict=True)], schema=_LOCAL_ARROW)

        for b in batches:
            for d, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                trie.insert(ascii_lower(encode(t)), d, member=d, listed=True)
                while trie.bytes > TRIE_BYTES and (trie.root.edges or trie.root.count):
                    yield from batch(trie.spill())
        yield from batch(trie.terminals())

    return docs.select("doc_id", "t").mapInArrow(run, _LOCAL)


_OWNERS = pa.schema([("name", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("tasks", pa.int64())])


def owners(local: DataFrame, largest: bool) -> DataFrame:
    """(name, keep_id, group_size, tasks) of every distinct text, from the tasks' rows; tasks: how many of these it has.

    Equal texts meet in the partition of their length and hash, in its one trie, as whole byte strings. What is spilled is
    an answer for the rows so far, so answers of one name are summed up: a row each, without texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)

        def batch(found: Iterator[tuple[bytes, Node]]) -> pa.RecordBatch:
            rows = [(x.name, x.owner, x.count, x.tasks) for _, x in found]
            cols = zip(*rows, strict=True) if rows else [()] * len(_OWNERS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OWNERS, strict=True)], schema=_OWNERS)

        for b in batches:
            for name, body, owner, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                node = trie.insert(body, owner, n)
                node.name, node.tasks = name, node.tasks + 1
                while trie.bytes > TRIE_BYTES and (trie.root.edges or trie.root.count):
                    yield batch(trie.spill())
        yield batch(trie.terminals())

    rows = local.repartition("length", "hash").select("name", "body", "owner", "n")
    found = rows.mapInArrow(run, "name string, keep_id long, group_size long, tasks long")
    best = F.max("keep_id") if largest else F.min("keep_id")
    return found.groupBy("name").agg(best.alias("keep_id"), F.sum("group_size").alias("group_size"), F.sum("tasks").alias("tasks"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text), a row per row of docs.

    Texts are equal when the same after lower-casing A-Z; null is empty. Of equal texts the row with the least id
    stays, or the greatest if `largest`; rows that repeat that id stay together. Null ids never own a text that
    another row has; a text that only rows without id have keeps them, with a null keep_id. Texts of any length are held
    whole, in tries of bounded size. Other columns, of any name, are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    at = work_dir(docs.sparkSession)
    local = stored(local_owners(docs, largest), at, "local")
    # a text has a row per task in `local`, however often it occurs. What the rows of one text carry are all its ids,
    # so they don't meet under its name: the few texts that very many tasks have go out to every task instead
    answers = stored(owners(local, largest), at, "owners")
    wide = answers.filter(F.col("tasks") > MANY_TASKS).limit(MOST_WIDE + 1)
    if 0 < wide.count() <= MOST_WIDE:
        rest = answers.filter(F.col("tasks") <= MANY_TASKS)
        own = local.select("name", "members").join(F.broadcast(wide), "name")
        found = own.unionByName(local.select("name", "members").join(F.broadcast(wide.select("name")), "name", "left_anti").join(rest, "name"))
    else:
        found = local.select("name", "members").join(answers, "name")
    rows = found.select(F.explode("members").alias("doc_id"), "keep_id", "group_size", F.col("name").alias("text_sha256"))
    kept = F.when(F.col("keep_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
