"""Repair of conversation structure: the cheapest edits to alternating turns, by dynamic programming over a trie.

A row's role and first fault are one letter, a conversation's letters its signature. Distinct signatures are sorted and
inserted into a prefix trie, range by range; the layer of the program that a node needs depends on its prefix alone, so it
is computed once for all signatures that share it, and a signature's answer is read at its terminal node.

Rows are sorted over all tasks by conversation and turn, so that a long conversation lies in several of them; each gives a
piece of its signature. Only signatures and plans, a few bytes a row, are ever whole. Edits go back to rows by their place.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import encode, forget, joined_salted, release, stored, work_dir

#: White space of a blank row and after a sentence's end; marks that end one.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# What the repaired rows may have come to.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Rows a repaired conversation may end after, or it is empty.
_COMPLETE = (_START, _ASSISTANT)
#: A plan's letters: K keep, U and A rerole to user and assistant, D delete, u and a insert. An audit has edits' initials.
_INITIALS = str.maketrans("UAua", "RRII")

Layer = tuple[tuple[int, int] | None, ...]


def audit_of(plan: str) -> str:
    return plan.translate(_INITIALS)


def _inserts(state: int) -> Iterator[tuple[int, str]]:
    """State and letters after inserting 0, 1 and 2 rows; a third would be where the first was."""
    letters = ""
    for _ in range(3):
        yield state, letters
        letters += "a" if state == _USER else "u"
        state = _ASSISTANT if state == _USER else _USER


def _edits(state: int, symbol: str) -> Iterator[tuple[str, int, int]]:
    """(letter, state after, cost) of what may become of a row. Symbols: x must go; else the role's s, u, a or o (any
    other), a capital where the row is truncated."""
    yield "D", state, DELETE
    if symbol == "x":
        return
    more, role = TRUNCATED * symbol.isupper(), symbol.lower()
    if role == "s" and state == _START:
        yield "K", _SYSTEM, KEEP + more
    if role == "u" and state != _USER:
        yield "K", _USER, KEEP + more
    if role == "a" and state == _USER:
        yield "K", _ASSISTANT, KEEP + more
    yield ("A", _ASSISTANT, REROLE + more) if state == _USER else ("U", _USER, REROLE + more)


@functools.lru_cache(65_536)
def advance(layer: Layer, symbol: str) -> tuple[Layer, int, tuple]:
    """(next layer, what was taken from all its costs, (state before, letters) of each state).

    A layer has (cost, rank) of each state after a row, ranks by the audits that led there. All of them end in the edit of
    that row, so none is the beginning of another, and two audits compare as their ranks or, where these are one, as what
    was added since.
    """
    best: list[tuple | None] = [None] * 4
    for before, held in enumerate(layer):
        if held is None:
            continue
        for state, added in _inserts(before):
            for letter, after, cost in _edits(state, symbol):
                plan = added + letter
                found = (held[0] + INSERT * len(added) + cost, held[1], audit_of(plan), before, plan)
                if best[after] is None or found < best[after]:
                    best[after] = found
    least = min(b[0] for b in best if b)
    order = sorted((b[1:3], state) for state, b in enumerate(best) if b)
    rank = {state: n for n, (_, state) in enumerate(order)}
    return tuple(b and (b[0] - least, rank[n]) for n, b in enumerate(best)), least, tuple(b and b[3:] for b in best)


def finish(layer: Layer) -> tuple[int, int, str]:
    """(cost, state, inserted letters) of the best end."""
    ends = [(cost + INSERT * len(added), rank, audit_of(added), state, added) for state, held in enumerate(layer) if held for cost, rank in [held] for at, added in _inserts(state) if at in _COMPLETE]
    cost, _, _, state, added = min(ends)
    return cost, state, added


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def solve(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, plan) of each; signatures ascend, and the trie is kept as the path to the last one's node."""
    path: list[tuple[Layer, int, tuple]] = [(((0, 0), None, None, None), 0, ())]  # layer, costs taken so far, ways here
    last = ""
    for signature in signatures:
        del path[_shared(last, signature) + 1 :]
        for symbol in signature[len(path) - 1 :]:
            layer, least, ways = advance(path[-1][0], symbol)
            path.append((layer, path[-1][1] + least, ways))
        cost, state, plan = finish(path[-1][0])
        parts = [plan]
        for _, _, ways in reversed(path[1:]):
            state, letters = ways[state]
            parts.append(letters)
        yield signature, path[-1][1] + cost, "".join(reversed(parts))
        last = signature


def solve_all(signatures: DataFrame) -> DataFrame:
    """sig, cost, plan of each distinct signature: a trie for each range of them."""
    names = pa.schema([("sig", pa.string()), ("cost", pa.int64()), ("plan", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found: list[tuple] = []
        for row in solve(s for b in batches for s in b.column("sig").to_pylist()):
            found.append(row)
            if len(found) == 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), names, strict=True)], schema=names)
                found.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), names, strict=True)], schema=names)
        release()

    spread = signatures.select("sig").distinct().repartitionByRange("sig").sortWithinPartitions("sig")
    return spread.mapInArrow(run, "sig string, cost long, plan string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults that a checksum of conversation and turn deals out: a twentieth of the rows
    each is dropped, emptied, loses its sentence ends, is repeated, or is given to the user. Nulls count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    each = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return each.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def _in_order(rows: DataFrame, conv: str, turn: str, role: str, text: str, at: str) -> DataFrame:
    """conv, turn, role, text and pos, a number that ascends by conversation and turn (nulls first), then role and text.

    A table: rows are dealt by ranges, of which a long conversation has several."""
    space = F.lit(" ")
    plain = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"))
    spread = plain.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    return stored(spread.withColumn("pos", F.monotonically_increasing_id()), at, "rows")


def _symbols(rows: DataFrame) -> DataFrame:
    """conv, turn, pos, initial, fault (blank, duplicate, truncated or null) and symbol of each row."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    first = rows.groupBy("conv", "role", F.md5(F.col("text").cast("binary")).alias("_h")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    light = rows.select("conv", "turn", "pos", F.left("role", F.lit(1)).alias("initial"), (trimmed == "").alias("_blank"), (~F.right(trimmed, F.lit(1)).isin(*ENDS)).alias("_cut"))
    light = light.join(first, "pos", "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    rows = light.select("conv", "turn", "pos", initial.alias("initial"), fault.alias("fault"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return rows.withColumn("symbol", symbol)


def _joined(parts: Column, field: str) -> Column:
    return F.array_join(F.transform(parts, lambda p: p[field]), "")


def _signatures(symbols: DataFrame) -> DataFrame:
    """A row a conversation: conv, pieces (first, n of each run of its rows in one range), sig and the counts of faults."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "symbol", "initial")))
    is_ = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    counts = ("blank", "duplicate", "truncated")
    runs = symbols.groupBy("conv", F.shiftright("pos", 33).alias("_range")).agg(ordered.alias("_o"), F.min("turn").alias("_min"), F.max("turn").alias("_max"), *map(is_, counts))
    runs = runs.select("conv", F.struct(F.col("_o")[0]["pos"].alias("first"), F.size("_o").alias("n"), _joined(F.col("_o"), "symbol").alias("sig"), _joined(F.col("_o"), "initial").alias("initials")).alias("run"), "_min", "_max", *counts)
    whole = runs.groupBy("conv").agg(F.array_sort(F.collect_list("run")).alias("_r"), F.min("_min").alias("_min"), F.max("_max").alias("_max"), *(F.sum(c).alias(c) for c in counts))
    turns = symbols.filter("turn is not null").select("conv", "turn").distinct().groupBy(F.col("conv").alias("_conv")).agg(F.count("*").alias("_turns"))
    whole = whole.join(turns, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    initials = _joined(F.col("_r"), "initials")
    legal = F.regexp_count(initials, F.lit("(?=su|ua|au)"))  # pairs overlap
    gaps = F.coalesce(F.col("_max") - F.col("_min") + 1 - F.col("_turns"), F.lit(0))
    pieces = F.transform("_r", lambda r: F.struct(r["first"].alias("first"), r["n"].alias("n")))
    return whole.select("conv", pieces.alias("pieces"), _joined(F.col("_r"), "sig").alias("sig"), gaps.alias("gaps"), *counts, (F.length(initials) - 1 - legal).cast("long").alias("illegal"))


def _placed(solved: DataFrame) -> DataFrame:
    """pos, edits: what happens at a row: letters of a plan, inserts first (after the row only where it is the last)."""
    tokens = F.regexp_extract_all("plan", F.lit("[ua]*[KUAD](?:[ua]*$)?"), F.lit(0))
    start = F.aggregate(F.slice("pieces", 1, F.col("i")), F.lit(0), lambda s, p: s + p["n"])
    runs = solved.select("conv", "pieces", tokens.alias("tokens"), F.posexplode("pieces").alias("i", "piece"))
    each = runs.select("conv", F.col("piece")["first"].alias("first"), F.posexplode(F.slice("tokens", start + 1, F.col("piece")["n"])).alias("k", "edits"))
    return each.select((F.col("first") + F.col("k")).alias("pos"), "edits")


def _repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """conv, pos, sub, edit (K, R, I), turn, role, text of the rows after repair, ordered by pos and sub."""
    each = rows.join(_placed(solved), "pos").select("conv", "pos", "turn", "role", "text", F.posexplode(F.split("edits", "(?<=.)(?=.)")).alias("sub", "letter"))
    letter, own = F.col("letter"), F.col("letter").isin("K", "U", "A")
    role = F.when(letter == "K", F.col("role")).when(F.lower(letter) == "u", "user").otherwise("assistant")
    edit = F.when(letter == "K", "K").when(own, "R").otherwise("I")
    return each.filter(letter != "D").select("conv", "pos", "sub", edit.alias("edit"), F.when(own, F.col("turn")).alias("turn"), role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired): conv, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation; and conv, pos,
    sub, edit, turn, role, text of the rows of all repaired ones, in the order of pos and sub.

    Repaired roles are nothing, or a system row or none and then user and assistant in turn, one pair at least. Rows keep
    their place (K, no cost), get the role of user or assistant (R, 2), go (D, 3; blank rows and those whose role and text
    were seen earlier must), and rows without text come in between (I, 2); a truncated row that stays costs 1. Of the
    cheapest ways the one with the least audit is taken. A row's first fault counts: blank, duplicate, truncated.

    Rows are taken by turn, null ones first, equal ones by role and text. Null roles and texts are one space, null
    conversations are one conversation; roles of any other initial can't be kept. A conversation may have any number of
    rows; its signature and its plan, a few bytes a row, are one value. Rows of no length limit; other columns, of any
    name, are not read. No rows give none.
    """
    at = work_dir(rows.sparkSession)
    ordered = _in_order(rows, conv_col, turn_col, role_col, text_col, at)
    known = stored(_signatures(_symbols(ordered)), at, "signatures")
    solved = stored(joined_salted(known, "sig", solve_all(known), "conv"), at, "solved")
    report = solved.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.translate("plan", "UAua", "RRII").alias("audit"))
    return report, _repaired(ordered, solved)


def text_digests(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the rows `role:text` joined by newlines: one stream a conversation, a row at a time."""
    names = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        last, sha = None, None
        for b in batches:
            found: dict[str, list] = {"conv": [], "repaired_sha256": []}
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if sha is None or conv != last:
                    if sha is not None:
                        found["conv"].append(last)
                        found["repaired_sha256"].append(sha.hexdigest())
                    last, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(encode(role) + b":" + encode(text))
            yield pa.RecordBatch.from_pydict(found, names)
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"conv": [last], "repaired_sha256": [sha.hexdigest()]}, names)
        release()

    spread = repaired.select("conv", "pos", "sub", "role", "text").repartition("conv").sortWithinPartitions("conv", "pos", "sub")
    return spread.mapInArrow(run, "conv long, repaired_sha256 string")
