"""Quality classifier by co-training of a text-content view and a page-metadata view.

Each view is a logistic regression over hashed binary features. They start from a bounded sample of labelled
documents; in each round either view scores all unlabelled documents and hands the ones it is surest of, with
its labels, to the other view. In the end both views are calibrated on labelled documents they never learnt
from, and the combined score is given for every document. Toxicity is learnt in the same way.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.common import SALTS, SLICE, WordHashes, encode, map_rows, stored, words_of, work_dir

WORDS, SHAPES, META = 60_000, 256, 1 << 11
VIEWS = {"text": WORDS + SHAPES, "meta": META}
_hashes = WordHashes()
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def level(x: float, top: int = 15) -> int:
    """0 for 0, then by powers of the square root of 2 up from 1/128."""
    return 0 if x <= 0 else min(top, max(1, int(2 * math.log2(x * 128)) + 1))


def text_features(text: str | None) -> np.ndarray:
    """Hashed words, and levels of a dozen ratios that tell prose from noise."""
    data, words = encode(text), words_of(text)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    found = np.unique((h % np.uint64(WORDS)).astype(np.uint16))
    n = max(len(data), 1)
    share = lambda which: (len(data) - len(data.translate(None, which))) / n
    lines = data.split(b"\n")
    ratios = (
        share(_UPPER),
        share(_LOWER),
        share(_DIGIT),
        share(_MARK),
        share(b"|"),
        share(b"!"),
        share(b".,"),
        share(b"\n"),
        len(set(words)) / max(len(words), 1),
        len(set(lines)) / len(lines),
        n / 1e4,
        sum(map(len, words)) / max(len(words), 1) / 32,
    )
    shape = [WORDS + 16 * k + level(r) for k, r in enumerate(ratios)]
    return np.concatenate([found, np.array(shape, np.uint16)])


def meta_features(parts: list) -> np.ndarray:
    """Each metadata column's value (numbers by their size), hashed with the column's place; null is a value."""
    named = [f"{k}={int(2 * math.log2(abs(v) + 1)) if isinstance(v, int | float) else v}" for k, v in enumerate(parts)]
    both = [*named, *(f"{a}&{b}" for i, a in enumerate(named) for b in named[:i])]
    return np.unique(np.array([_hashes[x.encode()] >> 53 for x in both], np.uint16))


#: Log-odds beyond which a view is sure enough to teach the other.
SURE = 1.0


@dataclass
class Rows:
    """Feature rows of one view: concatenated indices, and where each row starts."""

    at: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, rows: list[bytes]) -> Rows:
        return cls(np.frombuffer(b"".join(rows), "<u2").astype(np.int64), np.array([len(r) // 2 for r in rows], np.int64))

    def dot(self, w: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.size)
        run = np.r_[0.0, np.cumsum(w[self.at])]
        return run[ends] - run[ends - self.size]


@dataclass
class Logistic:
    """Weights of a view, its bias, and the calibration p = sigmoid(a x + b)."""

    w: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: Rows) -> np.ndarray:
        return x.dot(self.w) + self.bias

    def logit(self, x: Rows) -> np.ndarray:
        return self.a * self.raw(x) + self.b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def evidence(x: Rows, y: np.ndarray, size: int) -> np.ndarray:
    """Log-odds of each feature between the classes, less twice their standard error; 0 for what may be chance."""
    row = np.repeat(y, x.size)
    one, none = (np.bincount(x.at[row == c], minlength=size) for c in (1, 0))
    odds = np.log((one + 1) / (y.sum() + 2)) - np.log((none + 1) / ((1 - y).sum() + 2))
    return np.sign(odds) * np.maximum(np.abs(odds) - 2 * np.sqrt(1 / (one + 1) + 1 / (none + 1)), 0)


def fit_logistic(x: Rows, y: np.ndarray, size: int, steps: int = 120, l2: float = 1e-3) -> Logistic:
    """Full-batch Adam over features scaled by their evidence; both classes weigh the same."""
    n, scale = len(y), evidence(x, y, size)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    row = np.repeat(np.arange(n), x.size)
    p, m, v = np.r_[np.full(size, 0.2), 0.0], np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = (sigmoid(x.dot(p[:-1] * scale) + p[-1]) - y) * weight
        grad = np.r_[np.bincount(x.at, g[row], size) * scale + l2 * p[:-1], g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Logistic(p[:-1] * scale, float(p[-1]))


def fit_line(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients (one a column, then a bias) of a logistic regression on few columns, by Newton steps that are
    halved until they help."""
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / std, np.ones(len(y))]
    p = np.zeros(z.shape[1])

    def loss(p: np.ndarray) -> float:
        s = z @ p
        return float(np.logaddexp(0, np.where(y > 0, -s, s)).sum() + 0.5 * p[:-1] @ p[:-1])

    ridge = np.diag(np.r_[np.ones(len(p) - 1), 1e-6])
    for _ in range(steps):
        q = sigmoid(z @ p)
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge, z.T @ (q - y) + ridge @ p)
        size = 1.0
        while size > 1e-4 and loss(p - size * step) > loss(p):
            size /= 2
        if size <= 1e-4 or np.abs(step).max() < 1e-6:
            break
        p = p - size * step
    return np.r_[p[:-1] / std, p[-1] - (p[:-1] * mean / std).sum()]


@dataclass
class CoTrained:
    views: dict[str, Logistic]
    mix: np.ndarray  # coefficients of the calibrated views, and a bias

    def scores(self, x: dict[str, Rows]) -> dict[str, np.ndarray]:
        logits = {v: m.logit(x[v]) for v, m in self.views.items()}
        whole = sum(c * logits[v] for c, v in zip(self.mix, VIEWS, strict=False)) + self.mix[-1]
        return {v: sigmoid(s) for v, s in logits.items()} | {"both": sigmoid(whole)}


def featured(docs: DataFrame, id_col: str, text_col: str, meta_cols: list[str]) -> DataFrame:
    """(doc_id, text, meta, key): little-endian 16-bit feature indices of both views, and a hash of them."""

    def run(x: dict) -> Iterator[dict]:
        meta = zip(*(x[f"m{k}"] for k in range(len(meta_cols))), strict=True) if meta_cols else [()] * len(x["t"])
        yield {
            "doc_id": x["doc_id"],
            "text": [text_features(t).astype("<u2").tobytes() for t in x["t"]],
            "meta": [meta_features([*m]).astype("<u2").tobytes() for m in meta],
        }

    out = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("meta", pa.binary())])
    cols = [F.col(c).alias(f"m{k}") for k, c in enumerate(meta_cols)]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), *cols)
    found = map_rows(source, run, "doc_id long, text binary, meta binary", out, SLICE)
    return found.withColumn("key", F.xxhash64(*VIEWS))


def surest(scored: DataFrame, per_class: int) -> DataFrame:
    """(key, view, label): for each view and class the per_class distinct feature rows that the view is surest of.

    scored: key (a hash of both views' features), s_text, s_meta. A row that the views are both sure of, with different
    labels, teaches nothing. Equal rows count as one, ties go by the key. The best of each of SALTS parts come first, then
    the best of these, so what meets in a task doesn't grow with the corpus.
    """
    sure = {v: F.abs(f"s_{v}") > SURE for v in VIEWS}
    agreed = scored.filter(~(sure["text"] & sure["meta"] & ((F.col("s_text") > 0) != (F.col("s_meta") > 0))))
    each = agreed.select("key", F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(f"s_{v}").alias("s")) for v in VIEWS))).alias("x"))
    each = each.select("key", "x.view", F.when(F.col("x.s") > 0, 1).otherwise(0).alias("label"), F.abs("x.s").alias("s"))
    each = each.filter(F.col("s") > SURE).distinct().withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    best = F.row_number().over(Window.partitionBy("view", "label", "salt").orderBy(F.desc("s"), "key"))
    first = each.withColumn("n", best).filter(F.col("n") <= per_class)
    last = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("s"), "key"))
    return first.withColumn("n", last).filter(F.col("n") <= per_class).select("key", "view", "label")


def _exchanged(pool: DataFrame, models: dict[str, Logistic], per_class: int, taught: set[int], named: DataFrame | None = None) -> list:
    """The rows that the views are surest of and that weren't taught before, with their features: at most 4 x per_class.

    Rows whose doc_id is in named aren't of the pool: scores, not features, are joined to find them. The keys of those taken
    are added to taught: a row leaves the pool with the first round that takes it."""
    spread = pool.sparkSession.sparkContext.broadcast((models, np.array(sorted(taught), np.int64)))

    ids = [] if named is None else ["doc_id"]

    def run(x: dict) -> Iterator[dict]:
        models, gone = spread.value
        key = np.array(x["key"], np.int64)
        left = ~np.isin(key, gone)
        # rounded: equal rows have equal scores, wherever in a batch they stand
        scores = {f"s_{v}": np.round(m.logit(Rows.of(x[v])), 6)[left] for v, m in models.items()}
        yield {**{c: [i for i, ok in zip(x[c], left, strict=True) if ok] for c in ids}, "key": key[left], **scores}

    out = pa.schema([*((c, pa.int64()) for c in [*ids, "key"]), *((f"s_{v}", pa.float64()) for v in VIEWS)])
    schema = ", ".join([*(f"{c} long" for c in [*ids, "key"]), *(f"s_{v} double" for v in VIEWS)])
    scored = map_rows(pool.select(*ids, "key", *VIEWS), run, schema, out)
    if named is not None:
        sure = functools.reduce(operator.or_, (F.abs(f"s_{v}") > SURE for v in VIEWS))
        scored = scored.filter(sure).join(named.select("doc_id"), "doc_id", "left_anti")
    chosen = sorted((r["view"], r["label"], r["key"]) for r in surest(scored, per_class).collect())
    if not chosen:
        return []
    keys = sorted({k for _, _, k in chosen})
    taught.update(keys)
    rows = pool.filter(F.col("key").isin(keys)).groupBy("key").agg(*(F.min(v).alias(v) for v in VIEWS)).collect()
    by = {r["key"]: r for r in rows}
    return [(by[k]["text"], by[k]["meta"], v, label) for v, label, k in chosen]


def co_train(labelled: list[tuple], pool: DataFrame, rounds: int, per_class: int, named: DataFrame | None = None) -> CoTrained | None:
    """labelled: (text, meta, label). A fifth of them is kept for calibration. The pool's rows with a doc_id in named are left
    out. None without both classes."""
    held, seen = labelled[::5], [r for k, r in enumerate(labelled) if k % 5]
    if len({r[2] for r in seen}) < 2 or len({r[2] for r in held}) < 2:
        return None
    train = {v: [(r[k], r[2]) for r in seen] for k, v in enumerate(VIEWS)}
    check = {v: Rows.of([r[k] for r in held]) for k, v in enumerate(VIEWS)}
    y, taught = np.array([r[2] for r in held], float), set()
    for turn in range(rounds + 1):
        models = {}
        for v, size in VIEWS.items():
            m = fit_logistic(Rows.of([r for r, _ in train[v]]), np.array([z for _, z in train[v]], float), size)
            m.a, m.b = fit_line(m.raw(check[v])[:, None], y)
            models[v] = m
        if turn < rounds:
            for text, meta, view, label in _exchanged(pool, models, per_class, taught, named):
                other = "meta" if view == "text" else "text"
                train[other].append((meta if view == "text" else text, label))
    return CoTrained(models, fit_line(np.c_[tuple(models[v].logit(check[v]) for v in VIEWS)], y))


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"),
    max_labelled: int = 6_000,
    rounds: int = 2,
    per_class: int = 200,
    share: float = 0.01,
    most_taught: int = 1_000,
) -> DataFrame:
    """doc_id, text_score, meta_score, quality, toxicity and keep, a row per row of docs.

    max_labelled bounds the labelled rows that are learnt from (those with the least hash of their id). In each of the
    rounds all unlabelled documents are scored, and each view's surest distinct feature rows of a class are given to the
    other: `share` of the unlabelled rows, but per_class at least and most_taught at most, a bound on what is fitted. A row
    is taken once. keep: quality is at least a half and toxicity below a half. A label that is missing or of one class only teaches nothing: its score is null, and it rejects nothing.
    Null texts are empty, long ones are read whole; rows that share an id share its label, equal rows have equal scores,
    and among equally sure rows the one with the least hash of its features teaches first;
    an empty table gives no rows. Columns of docs other than those named aren't read and may have any name.
    """
    meta = [c for c in meta_cols if c in docs.columns]
    named = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    named = named.agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # features stay where they are made: labels are joined to ids and scores, and the few labels learnt from go to all tasks
    at = work_dir(docs.sparkSession)
    named, rows = stored(named, at, "named"), stored(featured(docs, id_col, text_col, meta), at, "features")
    unlabelled = rows.select("doc_id").join(named, "doc_id", "left_anti")
    share = min(1.0, max_labelled / max(named.count(), 1))
    few = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    sample = rows.join(F.broadcast(few), "doc_id")
    sample = sample.orderBy(F.xxhash64("doc_id"), "text").limit(2 * max_labelled)
    sample = sample.select("text", "meta", "quality", "toxic").collect()
    models, taught = {}, max(per_class, min(most_taught, math.ceil(share * unlabelled.count())))
    for target in ("quality", "toxic"):
        known = [(r["text"], r["meta"], int(r[target] > 0)) for r in sample if r[target] is not None]
        models[target] = co_train(known, rows, rounds, taught, named)
    spread = docs.sparkSession.sparkContext.broadcast(models)

    def run(x: dict) -> Iterator[dict]:
        views = {v: Rows.of(x[v]) for v in VIEWS}
        none = [None] * len(x["doc_id"])
        found = {k: m.scores(views) if m else dict.fromkeys((*VIEWS, "both"), none) for k, m in spread.value.items()}
        q, t = found["quality"]["both"], found["toxic"]["both"]
        keep = [(a is None or a >= 0.5) and (b is None or b < 0.5) for a, b in zip(q, t, strict=True)]
        yield {
            "doc_id": x["doc_id"], "text_score": found["quality"]["text"], "meta_score": found["quality"]["meta"],
            "quality": q, "toxicity": t, "keep": keep,
        }

    names = ("text_score", "meta_score", "quality", "toxicity")
    out = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in names), ("keep", pa.bool_())])
    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", keep boolean"
    return map_rows(rows.select("doc_id", "text", "meta"), run, schema, out)
