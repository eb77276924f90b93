"""What the third round's findings were about."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"

# --- databases ---

ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
at, data = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false",
    "spark.checkpoint.dir": f"file://{at}/shared", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("ROWS", *(__spark_entry__.queries()[n](spark, data).count() for n in ("jdbc_scan", "jdbc_page")))
spark.stop()
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_database_is_read_by_executors_of_their_own(tmp_path):
    import duckdb

    from rillstone.plans import catalog, catalog_runs  # noqa: F401

    (tmp_path / "run.py").write_text(ON_A_CLUSTER)
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"PYTHONPATH": str(REPO), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "run.py", str(tmp_path), DATA], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{DATA}/customer.parquet'")
    want = [str(len(con.execute(catalog.SQL[n]).fetchall())) for n in ("jdbc_scan", "jdbc_page")]
    assert [line.split()[1:] for line in run.stdout.splitlines() if line.startswith("ROWS")] == [want], run.stderr[-3000:]


# --- ancestors ---


def test_the_walk_goes_to_the_top(spark):
    from pyspark.sql import functions as F

    from rillstone.operators import query

    line = spark.range(200).select(F.col("id").alias("n"), F.when(F.col("id") % 100 > 0, F.col("id") - 1).alias("p"))
    assert all(r["root"] == r["node"] // 100 * 100 for r in query.ancestors(line, "n", "p", None).collect())
    with pytest.raises(ValueError, match="cycle"):
        query.ancestors(spark.createDataFrame([(0, None), (1, 2), (2, 1)], "n int, p int"), "n", "p", None)
    outside = spark.createDataFrame([(1, 7), (2, 1)], "n int, p int")  # a parent that is no node is a top
    assert {(r["node"], r["root"]) for r in query.ancestors(outside, "n", "p", None).collect()} == {(1, 7), (2, 7)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_nations_end_at_the_one_without_a_parent(spark):
    from rillstone.plans import catalog

    assert {r["root"] for r in catalog.QUERIES["ancestor_walk"](spark, DATA).collect()} == {0}


# --- chains ---


def test_a_cycle_is_not_walked_again_and_again(spark, monkeypatch):
    """A cycle that every start comes to: no step makes more rows than a few times those of the result."""
    from rillstone.operators import summarise

    edges = spark.createDataFrame([*((i, i // 2) for i in range(1, 256)), (0, 2), (1, 2)], "effect long, cause long")
    made, store = [], summarise.stored
    monkeypatch.setattr(summarise, "stored", lambda df, *a: made.append(store(df, *a)) or made[-1])
    got = summarise.causal_chain(edges, edges.selectExpr("effect as id"), 40)
    want = {}
    cause = {}
    for e, c in [(r["effect"], r["cause"]) for r in edges.collect()]:
        cause.setdefault(e, []).append(c)
    for s in cause:
        level, n = {s}, 0
        while level:
            want |= {(s, x): n for x in level}
            level, n = {c for x in level for c in cause[x] if (s, c) not in want}, n + 1
    assert {(r["start"], r["node"]): r["steps"] for r in got.collect()} == want
    chains = [df.count() for df in made]
    assert len(chains) < 12 and max(chains) <= len(want)


# --- inference ---


def test_types_are_those_of_all_values_but_ruled_out_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from rillstone.schema import Kind
    from rillstone.sources import files

    k = F.col("id")
    odd = {"late": ("17", "x"), "wide": ("17", "3000000000"), "exp": ("1.5", "-2E3"), "huge": ("1", "9" * 29), "none": (None, None), "blank": (" ", None), "flag": ("true", "FALSE"), "day": ("2020-01-02", "2020-1-3 04:05:06"), "words": ("x", "7")}
    df = spark.range(3_000).coalesce(1).select(*(F.when(k == 2_999, F.lit(last)).otherwise(F.lit(first)).alias(n) for n, (first, last) in odd.items()))
    tried, parse = [], files.parsed
    monkeypatch.setattr(files, "parsed", lambda c, kind: tried.append(kind) or parse(c, kind))
    found = {a.name: a.kind for a in files.infer(df)}
    assert found == {
        "late": Kind.TEXT, "wide": Kind.LONG, "exp": Kind.DECIMAL, "huge": Kind.TEXT, "none": Kind.TEXT, "blank": Kind.TEXT, "flag": Kind.BOOLEAN, "day": Kind.DATETIME,
        "words": Kind.TEXT,
    }
    # two columns without a value try all types again, the others only what their first rows leave
    assert len(tried) == 9 * 6 + 2 * 6 + 3 * 3 + 3
    assert all(a.kind is Kind.TEXT for a in files.infer(df.limit(0)))


# --- quality ---


def test_features_are_not_dealt_out_to_meet_labels(spark, monkeypatch):
    from rillstone.llm import quality

    words = ["good " * 6 + "tidy", "bad " * 6 + "rough"]
    docs = spark.createDataFrame([(i, f"{words[i % 2]} {i % 13} w{i % 7}", "s", "en", i % 9) for i in range(400)] + [(None, "good", "s", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(0, 120)], "doc_id long, quality int, toxic int")
    plans, store = {}, quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, at, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and store(df, at, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["keep"] for r in quality.classify_quality(docs, labels, per_class=20).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "MapInArrow" in plans["features"] and "Exchange" not in plans["features"]
    assert len(got) == 401 and got[399] is False and got[398] is True and got[None] is True


# --- near duplicates ---


def test_shingles_of_a_few_texts_weigh_less_than_those_of_one(spark):
    """The common part of seven texts of 400 is over 0.8 of two of them where it weighs like the rest, and under by its idf."""
    from rillstone.llm import near_dedup

    common = " ".join(f"c{k}" for k in range(169))  # 165 shingles, and 20 more of each text's own
    rows = [(i, f"{common} " + " ".join(f"t{i}x{k}" for k in range(20))) for i in range(7)]
    rows += [(i, " ".join(f"o{i}x{k}" for k in range(12))) for i in range(7, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: i for i, _ in rows}


@pytest.mark.parametrize("size", [1 << 23, 4_000, 1])
def test_document_frequencies_of_all_shingles(spark, tmp_path, monkeypatch, size):
    """Counted by ranges and blocks, with rows of a block in several tasks, as in a plain count."""
    import numpy as np
    from pyspark.sql import functions as F

    from rillstone.llm import near_dedup
    from rillstone.llm.common import stored

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], rng.integers(0, 60))) for _ in range(300)] + ["", None, "x"] * 3 + ["y " * 40] * 12
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string").repartition(3)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
    rows = stored(near_dedup.in_blocks(df), str(tmp_path), "docs")
    steps = stored(near_dedup.shingle_steps(rows.filter("place % 50 < 30").union(rows.filter("place % 50 >= 30")), 5, len(texts), 7), str(tmp_path), "steps")
    got = near_dedup._signed(rows, steps, 5, near_dedup.Sampler(2, 2, 1)).join(df, "doc_id").collect()
    w = near_dedup.Weights(*near_dedup.frequent_shingles(df, "t", 5), 5)
    assert len(got) == len(texts)
    for r in got:
        s, weights = near_dedup.weighted(near_dedup.word_hashes([r["t"]])[0], r["steps"], 5)
        want = w.of_text(r["t"])
        assert (s == want[0]).all() and (weights == want[1]).all()
    kinds = rows.groupBy("block").agg(F.count("*").alias("n"), F.max("place").alias("top")).filter("n <> top + 1")
    assert kinds.count() == 0


# --- token output ---


def test_pieces_that_recur_after_very_many_others_are_not_encoded_again():
    from rillstone.llm import token_output

    known = token_output.Ids(token_output.tokenizer_path(), 2)
    texts = [" ".join(f"{k:05x}" for k in range(a, a + 1_000)) for a in range(0, 280_000, 1_000)]
    first = [x.tolist() for x in known.of_all(texts)]
    held = sum(map(len, (known.known, known.old)))
    asked = []

    class Watched:
        def __init__(self, inner):
            self.model = inner.model
            self.encode_batch_fast = lambda new, **o: asked.extend(new) or inner.encode_batch_fast(new, **o)

    inner, known.tokenizer, known.plain = known.tokenizer, Watched(known.tokenizer), False
    assert [x.tolist() for x in known.of_all(texts[:5])] == first[:5] and not asked and held >= 250_000
    assert first[3] == [*inner.encode(texts[3], add_special_tokens=False).ids, 2]


def test_coding_takes_few_steps_whatever_the_lanes():
    """A step of Python and numpy calls serves very many ids: what is called, counted, is a small part of the ids."""
    import sys

    import numpy as np

    from rillstone.llm import range_coder

    ids = np.minimum(np.random.default_rng(0).zipf(1.3, 1 << 20), 50_256)
    data, calls = range_coder.encode_ids(ids, 50_257), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = range_coder.decode_ids(data)
    finally:
        sys.setprofile(None)
    assert (got == ids).all() and calls < len(ids) / 20


def test_lanes_of_a_block_share_its_model_and_words():
    """Blocks that end within a lane, at its end and after one; a block whose words are cut off fails by its checksum."""
    import struct

    import numpy as np

    from rillstone.llm import range_coder

    rng = np.random.default_rng(1)
    for n in (511, 512, 513, 1_024, 1_025, 9_000, 70_001):
        ids = rng.integers(0, 200, n) ** 2 // 60
        data = range_coder.encode_ids(ids, 700, 40_000)
        assert (range_coder.decode_ids(data) == ids).all()
        (size,) = struct.unpack_from("<I", data, 25)
        with pytest.raises(ValueError, match="checksum"):
            range_coder.decode_ids(data[: 29 + size // 2])


def test_texts_cut_at_once_have_the_ids_of_the_tokenizer(monkeypatch):
    """Stops that stand apart, odd white space and added tokens beside even texts, in calls of several sizes; a piece of all
    texts of a call is looked up once."""
    from tokenizers import Tokenizer

    from rillstone.llm import token_output

    at = token_output.tokenizer_path()
    t = Tokenizer.from_file(at)
    texts = ["a.b", "x .y", ".x y", "é. ñ", "a_. b", "a, b.\nC d. e", "a..b", ",", ".", "a", "", None, "²! x, y", "<|endoftext|>.a", "a b", "it's. 'x'", "wort###, b", "a.\n.b", "\0. a", "x\n.y z", "日本. 語"]
    texts += [f"word{k % 9} the, Of. And\nso" for k in range(200)]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    for size in (len(texts), 7, 1):
        known = token_output.Ids(at, 2)
        assert [x.tolist() for i in range(0, len(texts), size) for x in known.of_all(texts[i : i + size])] == want
    asked = []
    monkeypatch.setattr(token_output.Known, "__getitem__", lambda self, k: asked.append(k) or dict.__getitem__(self, k), raising=False)
    assert [x.tolist() for x in known.of_all(texts[-200:])] == want[-200:] and len(asked) == len({*asked}) < 20
