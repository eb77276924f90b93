"""Secret scan with corpus-wide ownership frequency.

Fixed patterns find base spans. Every candidate value, those of the base spans and any other token that looks
like a key, is hashed; hashes are counted by distinct repositories and owners over the whole corpus. A value
that many owners share is a copied example; one that few owners have and that looks random is a live-looking
credential. Live-looking tokens that no pattern covers add spans of kind `generic`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import SALTS, map_rows, stored, work_dir

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "generic")
# "letters in either case" is meant for ASCII letters, hence re.ASCII
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
# greedy runs that are too short hold no long enough one, so the least length can stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GENERIC = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_CLASSES = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]


def entropy(value: str) -> float:
    """Bits a character, from the value's own character frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order; kind as an index of KINDS, in code points, end exclusive."""
    spans = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(spans)


def generic_spans(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, int, str]]:
    """Tokens that look like keys: lower and upper case and digits, random, and apart from all base spans."""
    at, far = 0, -1
    for m in _GENERIC.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            far = max(far, base[at][2])
            at += 1
        if far <= m.start() and all(c.search(m[0]) for c in _CLASSES) and entropy(m[0]) >= 3.5:
            yield m.start(), 3, m.end(), m[0]


def named(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, repo, owner, n_assign, n_access, n_hex, base_sha256, found): found are all candidate spans, each
    with its value's hash and whether the value looks random."""

    def run(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
        for text in x["t"]:
            base = base_spans(text) if text else []
            kinds = Counter(k for _, k, _, _ in base)
            for k in (0, 1, 2):
                out[f"n_{KINDS[k]}"].append(kinds[k])
            out["base_sha256"].append(hashlib.sha256(named(base).encode()).hexdigest())
            spans = base + [*generic_spans(text, base)] if text else []
            out["found"].append(
                [
                    {"start": s, "kind": k, "end": e, "value": xxhash.xxh3_128_digest(v.encode()), "random": entropy(v) >= 2.5}
                    for s, k, e, v in spans
                ]
            )
        yield {c: x[c] for c in ("doc_id", "repo", "owner")} | out

    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary()), ("random", pa.bool_())])
    out = pa.schema(
        [("doc_id", pa.int64()), ("repo", pa.string()), ("owner", pa.string())]
        + [(f"n_{k}", pa.int64()) for k in KINDS[:3]]
        + [("base_sha256", pa.string()), ("found", pa.list_(span))]
    )
    schema = (
        "doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "found array<struct<start:long, kind:int, end:long, value:binary, random:boolean>>"
    )
    return map_rows(docs, run, schema, out)


def ownership(occurrences: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners): distinct repositories and owners of each value, counted by pairs first."""
    pairs = occurrences.groupBy("value", "repo", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("value").agg(
        F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("n")
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    live_owners: int = 2,
    live_repos: int = 50,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, span_repos, span_owners, n_live and n_examples, a row per
    row of docs.

    Every candidate's value is counted over the whole corpus: by distinct repositories and by distinct owners (the
    columns named; a table without repositories has each document as one). It is an example when more than live_owners
    owners or more than live_repos repositories have it, and live-looking when it isn't and looks random. Base spans
    are reported either way; a generic one only if live-looking. span_repos and span_owners have both counts of each
    span, in the spans' order. Null and empty texts have no spans; long ones are read whole; repeated rows each have
    their row and count as one repository; rows without a repository or owner count as one without name; spans that
    start together go by kind. An empty table gives no rows. Only the columns named are read, so others may have any name.
    """
    spark = docs.sparkSession
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), name(repo_col).alias("repo"), name(owner_col).alias("owner"))
    found = candidates(rows).withColumn("uid", F.monotonically_increasing_id())
    found = stored(found, work_dir(spark), "candidates")
    each = found.select("uid", "repo", "owner", F.explode("found").alias("f")).select("uid", "repo", "owner", "f.*")
    # a value may occur in any share of the documents: its answer goes out by value and salt
    each = each.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    counts = each.groupBy("value", "salt", "repo", "owner").agg(F.count("*").alias("n"))
    answers = counts.groupBy("value", "salt").agg(F.sum("n").alias("n")).drop("n").join(ownership(counts), "value")
    told = each.join(answers.select("value", "salt", "n_repos", "n_owners"), ["value", "salt"])
    example = (F.col("n_owners") > live_owners) | (F.col("n_repos") > live_repos)
    told = told.withColumn("example", example).withColumn("live", ~F.col("example") & F.col("random"))
    by = told.groupBy("uid").agg(
        F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "end", "n_repos", "n_owners"))).alias("shown"),
        F.count_if("live").alias("n_live"),
        F.count_if("example").alias("n_examples"),
    ).withColumn("shown", F.array_sort("shown"))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.transform("shown", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]))
    none = F.array().cast("array<long>")
    out = found.drop("found", "repo", "owner").join(by, "uid", "left")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(text, ","), F.lit("")).alias("spans"),
        F.coalesce("shown.n_repos", none).alias("span_repos"),
        F.coalesce("shown.n_owners", none).alias("span_owners"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
    )
