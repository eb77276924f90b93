"""Operators 11 to 13 against brute force on small tables with nulls, empty and long values, ties, repeats and clashing columns."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone.llm import conversations, hard_negatives, queries, simhash
from rillstone.llm.common import joined_salted

CLASHING = "uid long, cell long, fp string, v string, n int, rank string, pos string, sub int, conv string"


def as_table(df, tmp_path, name):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def with_clashing(df):
    names = [x.split() for x in CLASHING.split(", ")]
    return df.withColumns({n: F.lit(1).cast(t) for n, t in names if n not in df.columns})


def test_answers_meet_a_hot_key(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    got = joined_salted(rows, "k", spark.createDataFrame([(-1, "hot"), (3, "three")], "k long, a string"), "id").collect()
    assert len(got) == 1000
    assert all(r["a"] == ("hot" if r["k"] == -1 else "three" if r["k"] == 3 else None) for r in got)


# --- 11 ---


def negatives_by_brute_force(rows, anchor, k_pos=5, k_neg=10):
    """rows: id, vector or None, label or None."""
    part = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [int(np.floor(min(max(256.0 * float(np.float32(x)), -hard_negatives.LARGEST), hard_negatives.LARGEST))) for x in v]
        part.append((i, v, label))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for n, (a, va, la) in enumerate(part):
        if a is None or not anchor(a):
            continue
        scored = [(sum(p * q for p, q in zip(va, v)), i, label) for m, (i, v, label) in enumerate(part) if m != n]
        for ps, p, _ in sorted((x for x in scored if x[2] == la), key=order)[:k_pos]:
            window = sorted((x for x in scored if x[2] != la and 30 * ps <= 100 * x[0] <= 90 * ps), key=order)[:k_neg]
            out += [(a, p, rank + 1, i, ps, s) for rank, (s, i, _) in enumerate(window)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [hard_negatives.GROUP, 3])
def test_hard_negatives(spark, monkeypatch, group):
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    rng = np.random.default_rng(5)
    some = rng.normal(0, 0.3, (40, 6)).astype(np.float32)
    rows = [(i, some[i % 40].tolist(), int(rng.integers(0, 3))) for i in range(120)]  # each vector three times: ties
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (210, [0.1] * 6, None), (220, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (230, [nan] * 6, 1), (240, [inf] + [0.1] * 5, 2)]
    rows += [(None, some[1].tolist(), 0), (250, [], 1), (260, [0.4, 0.2], 0), (270, [3e38] + [0.0] * 5, 0), (271, [2e38] + [0.0] * 5, 1)]
    rows += [rows[10], rows[10], rows[20]]  # repeated rows, anchors among them
    df = with_clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).repartition(5)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()]
    want = negatives_by_brute_force([(i, v, x) for i, v, x in rows], lambda i: i % 10 == 0)
    assert len(want) > 300
    assert sorted(got, key=repr) == want


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(none, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(0, [0.5], 1), (10, [], 2), (7, None, None)], none.schema)
    assert hard_negatives.mine(alone, F.col("vec_id") % 10 == 0).collect() == []
    empty = spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], none.schema)  # all scores are zero
    assert [tuple(r) for r in hard_negatives.mine(empty, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 0, 0)]


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-100, 100, (400, 8))
    df = spark.createDataFrame([(x.tolist(),) for x in v], "v array<int>")
    cells = hard_negatives.fit_cells(df, 16)
    code = cells.code(v)
    assert code.min() == 0 and code.max() <= 15
    least, greatest = cells.bounds(code)
    assert (least <= v).all() and (v <= greatest).all()
    anchors = rng.integers(-100, 100, (20, 8))
    low, high = hard_negatives.score_bounds(anchors, least, greatest)
    exact = anchors @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    tenth = np.sort(low, 1)[:, -10]
    assert (high >= tenth[:, None]).mean() < 0.5  # less than half of the rows could enter a list of ten


# --- 12 ---

LETTERS = "xsuaoSUAO"


def best_by_brute_force(symbols):
    """(cost, audit, plan) over all ways, state by state; whole audits are compared."""
    start = {"": [(0, "", "")]}
    ok = re.compile("s?(ua)*u?$")

    def put(table, out, way):
        if ok.match(out):
            key = "" if not out else "s" if out == "s" else out[-1]
            if key not in table or way < table[key][0]:
                table[key] = [way]
                return True
        return False

    def inserted(table):
        for _ in range(4):
            for key in list(table):
                cost, audit, plan = table[key][0]
                new = "a" if key == "u" else "u"
                put(table, {"": "u", "s": "su", "u": "ua", "a": "uau"}[key], (cost + 2, audit + "I", plan + new))
        return table

    table = inserted(dict(start))
    for c in symbols:
        after = {}
        for key, [(cost, audit, plan)] in table.items():
            out = {"": "", "s": "s", "u": "u", "a": "ua"}[key]
            put(after, out, (cost + 3, audit + "D", plan + "D"))
            if c != "x":
                more = int(c.isupper())
                for letter, new, price in (("K", c.lower(), 0), ("U", "u", 2), ("A", "a", 2)):
                    if new in "sua":
                        put(after, out + new, (cost + price + more, audit + conversations.audit_of(letter), plan + letter))
        table = inserted(after)
    return min(table[k][0] for k in ("", "a") if k in table)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=9), max_size=12))
def test_trie_gives_the_cheapest_edits(signatures):
    signatures = sorted(set(signatures))
    got = list(conversations.solve(iter(signatures)))
    assert [s for s, _, _ in got] == signatures
    for s, cost, plan in got:
        assert (cost, conversations.audit_of(plan), plan) == best_by_brute_force(s)


def test_cheapest_edits_among_all():
    """Every sequence of edits, with up to two inserts between rows."""
    for s in map("".join, itertools.product("xsuaU", repeat=3)):
        best = None
        gaps = ["", "u", "a", "ua", "au"]
        for ins in itertools.product(gaps, repeat=4):
            for own in itertools.product("KUAD", repeat=3):
                plan = "".join(i + o for i, o in zip(ins, own)) + ins[3]
                out, cost, good = "", 0, True
                rows = iter(s)
                for letter in plan:
                    c = next(rows) if letter in "KUAD" else None
                    if c == "x" and letter != "D":
                        good = False
                        break
                    out += {"K": (c or "").lower(), "U": "u", "A": "a", "D": ""}.get(letter, letter)
                    cost += {"K": 0, "U": 2, "A": 2, "D": 3}.get(letter, 2) + (c is not None and c.isupper() and letter != "D")
                if good and re.fullmatch("(s?(ua)+)?", out):
                    best = min(x for x in (best, (cost, conversations.audit_of(plan))) if x)
        [(_, cost, plan)] = conversations.solve(iter([s]))
        assert (cost, conversations.audit_of(plan)) == best


def test_shared_prefixes_are_computed_once():
    conversations.advance.cache_clear()
    made = []
    real = conversations.advance
    try:
        conversations.advance = lambda *a: made.append(a) or real(*a)
        found = list(conversations.solve(iter(["suaua" * 50 + x for x in "asux"])))
    finally:
        conversations.advance = real
    assert len(found) == 4 and len(made) == 250 + 4


def conversations_by_brute_force(rows):
    by = defaultdict(list)
    convs = {r[0] for r in rows}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv in convs:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            marks = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            c = role[0] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        cost, audit, plan = best_by_brute_force(symbols)
        lines, rest = [], iter(own)
        for letter in plan:
            if letter in "KUAD":
                _, role, text = next(rest)
                if letter != "D":
                    lines.append({"K": role, "U": "user", "A": "assistant"}[letter] + ":" + text)
            else:
                lines.append({"u": "user:", "a": "assistant:"}[letter])
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_conversations():
    rng = np.random.default_rng(3)
    roles = ["user", "assistant", "system", None, "tool", "", "User"]
    texts = ["Hello.", "hi", "", None, "\t\n", "é?\x0b ", "a.b", "Yes!", "z "]
    rows = [(int(c), None if rng.random() < 0.1 else int(rng.integers(0, 9)), roles[rng.integers(0, 7)], texts[rng.integers(0, 9)]) for c in rng.integers(0, 60, 500)]
    rows += [(None, 3, "user", "no conversation"), (None, None, None, None), (77, 10**12, "user", "x."), (77, -5, "system", "y.")]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3_000)]  # a long one
    rows += [(101, t, ("user", "assistant")[t % 2], "long " * 100_000) for t in range(3)]
    rows += [(102, t, "user", "Same.") for t in (1, 1, 1, 2)]
    rows += [(c, 0, "user", "dropped?") for c in range(1000, 1080)]
    return rows


@pytest.mark.parametrize("partitions", [4, 23])
def test_conversations(spark, tmp_path, partitions):
    rows = odd_conversations()
    df = with_clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    d = as_table(df, tmp_path, "conversations")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == 4)
        got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    want = conversations_by_brute_force(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert any(v[6] == "" and v[5] == 0 for v in want.values())  # some lost all rows


def test_repaired_rows(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hello."), (1, 3, "assistant", "Hello."), (1, 4, "user", "whole."), (2, 1, "tool", "Done.")]
    df = spark.createDataFrame(rows, "c long, t long, r string, x string")
    report, repaired = conversations.repair(df, "c", "t", "r", "x")
    assert {r["conv"]: (r["cost"], r["audit"]) for r in report.collect()} == {1: (7, "KIKDKI"), 2: (3, "D")}
    lines = [(r["conv"], r["edit"], r["turn"], r["role"], r["text"]) for r in repaired.orderBy("conv", "pos", "sub").collect()]
    assert lines == [(1, "K", 1, "system", "Be kind."), (1, "I", None, "user", ""), (1, "K", 2, "assistant", "Hello."), (1, "K", 4, "user", "whole."), (1, "I", None, "assistant", "")]


def test_no_conversations(spark, tmp_path):
    d = as_table(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    assert queries.op12_conversation_repair(spark, d).collect() == []


# --- 13 ---


def fingerprint_by_brute_force(text, n=3):
    data = (text or "").encode("utf-8", "surrogatepass")
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in data))
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_brute_force(rows):
    """rows: (id or None, fingerprint) -> component id of each."""
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 2 or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
            group[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aB é\t\x0b 中"), max_size=60), st.sampled_from([1, 3, 7, 1 << 20]))
def test_fingerprints(text, piece):
    before = simhash.PIECE
    try:
        simhash.PIECE = piece
        assert simhash.fingerprint(text) == fingerprint_by_brute_force(text)
    finally:
        simhash.PIECE = before


def test_fingerprint_of_long_and_missing_texts():
    long = " ".join(f"Word{i % 977}" for i in range(300_000))
    assert simhash.fingerprint(long) == fingerprint_by_brute_force(long)
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \t\n") == 0


def test_bit_counts():
    h = np.random.default_rng(0).integers(0, 2**64, 70_000, dtype=np.uint64)
    want = [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    assert simhash.bit_counts(h).tolist() == want and not simhash.bit_counts(h[:0]).any()


def near_fingerprints():
    """Clusters within a few bits, chains of two-bit steps, one dense cluster, and the all-zero and all-one values."""
    rng = np.random.default_rng(9)
    out = {0, 3, 2**64 - 1, 2**64 - 4, 1 << 63, 7 << 61}
    for _ in range(60):
        base = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(6):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            out.add(x)
    x = int(rng.integers(0, 2**64, dtype=np.uint64))
    for _ in range(30):  # a chain
        x ^= (1 << int(rng.integers(0, 64))) | (1 << int(rng.integers(0, 64)))
        out.add(x)
    dense = int(rng.integers(0, 2**64, dtype=np.uint64))
    out |= {dense ^ (i & 3) ^ (i >> 2 & 3) << 4 ^ (i >> 4 & 3) << 8 ^ (i >> 6 & 3) << 12 for i in range(256)}
    return sorted(out)


@pytest.mark.parametrize("crowd", [0, 3, simhash.CROWD])
def test_links_join_all_that_are_close(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    fps = near_fingerprints()
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.links_between(nodes, str(tmp_path)).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    got = {f: f for f in signed}

    def find(f):
        while got[f] != f:
            f = got[f]
        return f

    for a, b in links:
        got[find(a)] = find(b)
    want = components_by_brute_force([(i, f) for i, f in enumerate(fps)])
    classes = {}
    for f, w in zip(signed, want, strict=True):
        assert classes.setdefault(find(f), w) == w
    assert len(classes) == len(set(want))


def simhash_rows():
    base = "the quick brown fox jumps over the lazy dog while the slow red hen sleeps under an old tree by the river and dreams of corn " * 40
    rows = [(i, base + f" end{i}") for i in range(40)]  # near copies of a long text
    rows += [(50, base), (51, base.upper()), (52, base), (60, None), (61, ""), (62, " \n"), (63, "one"), (64, "ONE"), (65, "one two")]
    rows += [(70, "É é ß"), (71, "é é ß"), (None, base), (None, "nobody here at all"), (80, "left text of two"), (80, "right words that differ"), (80, "left text of two")]
    return rows


def test_simhash(spark, tmp_path):
    rows = simhash_rows()
    docs = with_clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("component_id", F.lit("x")).repartition(4)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    fps = [fingerprint_by_brute_force(t) for _, t in rows]
    of = components_by_brute_force([(d, f) for (d, _), f in zip(rows, fps, strict=True)])
    assert got == sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, of, strict=True)), key=repr)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_simhash_of_a_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    fps = [fingerprint_by_brute_force(t) for _, t in rows]
    of = components_by_brute_force([(d, f) for (d, _), f in zip(rows, fps, strict=True)])
    got = sorted(tuple(r) for r in queries.op13_simhash(spark, d).collect())
    assert got == sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, of, strict=True))
