"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. The likelihood of a word is
the sum over all its segmentations into pieces, by the forward algorithm; pieces never cross words, so a
text's log-likelihood is the sum over its words. Piece probabilities are fitted by expectation-maximisation:
expected piece counts by forward-backward over the distinct words of each language, summed by Spark.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.llm.common import SLICE, map_rows, release, remembered, stored, words_of, work_dir

#: What a character that is no piece counts against the floor of the seen ones.
UNKNOWN = 1e-2
MAX_LANGUAGES = 512
#: Hashes of rows are compared modulo this.
HASHES = 1 << 40
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str | None = None) -> list[str]:
    """The vocabulary's ordinary pieces; a word starts with U+2581 there. Byte and control pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(path))
    n = sp.get_piece_size()
    return [sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


def spelled(word: bytes) -> str:
    return "▁" + word.decode("utf-8", "replace")


#: Words of up to this many characters are summed as they are, times GAIN to the number of characters so that sums
#: neither vanish nor overflow; longer ones by logarithms of the sums.
PLAIN = 40
GAIN = 1e5
#: Characters of long words that are summed in step.
CELLS = 1 << 18
_STEP, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class PieceIndex:
    """Numbers of pieces by a hash of their characters, for arrays of hashes at once."""

    def __init__(self, pieces: list[str], bits: int = 20):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for i, p in enumerate(pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    h = h * _STEP + np.uint64(ord(c) + 1)
                at = int(h * _SPREAD >> self.shift)
            while self.ids[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.ids[at] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        at = (h * _SPREAD >> self.shift).astype(np.int64)
        found = np.where(self.keys[at] == h, self.ids[at], -1)
        open_ = np.flatnonzero((found < 0) & (self.ids[at] >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            here = at[open_]
            found[open_] = np.where(self.keys[here] == h[open_], self.ids[here], -1)
            open_ = open_[(found[open_] < 0) & (self.ids[here] >= 0)]
        return found


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers of the words, code points) of the words up to PLAIN, those of one length together, a row each."""
    by: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        if len(w) <= PLAIN:
            by[len(w)].append(k)
    for n, rows in by.items():
        for i in range(0, len(rows), 4096):
            codes = np.frombuffer("".join(words[k] for k in rows[i : i + 4096]).encode("utf-32-le", "surrogatepass"), "<u4")
            yield n, np.array(rows[i : i + 4096]), codes.reshape(-1, n)


def long_words(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the words, lengths, code points, 0 behind the end) of the words beyond PLAIN, of like lengths together."""
    rows = sorted((k for k, w in enumerate(words) if len(w) > PLAIN), key=lambda k: -len(words[k]))
    while rows:
        n = len(words[rows[0]])
        some, rows = rows[: max(1, CELLS // n)], rows[max(1, CELLS // n) :]
        codes = np.zeros((len(some), n), np.uint32)
        for k, w in enumerate(some):
            codes[k, : len(words[w])] = np.frombuffer(words[w].encode("utf-32-le", "surrogatepass"), "<u4")
        yield np.array(some), np.array([len(words[k]) for k in some]), codes


def ends(codes: np.ndarray, model: LanguageModel) -> Iterator[np.ndarray]:
    """For each place, the pieces that end there, a row for each length from 1 on: -1 is none, or an unknown character."""
    h = np.zeros((model.longest + 1, len(codes)), np.uint64)
    for i in range(codes.shape[1]):
        h[1:] = h[:-1] * _STEP + (codes[:, i].astype(np.uint64) + np.uint64(1))
        ids = model.index.find(h[1:].ravel()).reshape(model.longest, -1)
        ids[i + 1 :] = -1
        yield ids


def arcs(codes: np.ndarray, index: PieceIndex, longest: int) -> dict[tuple[int, int], np.ndarray]:
    """(start, end) -> the piece that stands there in each row, or -1."""
    found, n = {}, codes.shape[1]
    c = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros_like(c)
    for size in range(1, min(longest, n) + 1):
        h = h[:, : n - size + 1] * _STEP + c[:, size - 1 :]
        ids = index.find(h.ravel()).reshape(h.shape)
        for j in range(n - size + 1):
            if size == 1 or (ids[:, j] >= 0).any():
                found[j, j + size] = ids[:, j]
    return found


def forward(words: list[str], model: LanguageModel) -> np.ndarray:
    """ln of the sum over all segmentations of each word of the product of its pieces' probabilities, a column a language."""
    out = np.zeros((len(words), len(model.languages)))
    for n, rows, codes in by_length(words):
        sums = np.zeros((n + 1, len(rows), len(model.languages)))
        sums[0] = 1.0
        spans = arcs(codes, model.index, model.longest)
        for (j, i), ids in sorted(spans.items(), key=lambda x: x[0][1]):
            if i == j + 1:  # a character that is no piece is an unknown one
                sums[i] += sums[j] * np.where(ids[:, None] >= 0, model.prob[ids], model.unknown) * GAIN
            else:
                on = np.flatnonzero(ids >= 0)
                sums[i, on] += sums[j, on] * model.prob[ids[on]] * GAIN ** (i - j)
        out[rows] = np.log(sums[n]) - n * math.log(GAIN)
    for rows, sizes, codes in long_words(words):
        # ln of the sums of the last places, the latest first
        ring = np.full((model.longest, len(rows), len(model.languages)), -np.inf)
        ring[0] = 0.0
        for i, ids in enumerate(ends(codes, model)):
            prob = np.where(ids[:, :, None] >= 0, model.prob[ids], 0.0)
            prob[0] = np.where(ids[0, :, None] >= 0, prob[0], model.unknown)
            new = ring[0] + np.log((np.exp(ring - ring[0]) * prob).sum(0))
            ring = np.roll(ring, 1, 0)
            ring[0] = new
            done = sizes == i + 1
            out[rows[done]] = new[done]
    return out


def expected_counts(words: list[str], lang: np.ndarray, n_words: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Expected number of uses of each piece (a row) by each language (a column) over all segmentations of its words."""
    total = np.zeros((len(model.prob), len(model.languages)))
    for n, rows, codes in by_length(words):
        of, times = lang[rows], n_words[rows]
        spans = sorted(arcs(codes, model.index, model.longest).items(), key=lambda x: x[0][1])
        prob = {k: np.where(ids >= 0, model.prob[ids, of], model.unknown[of] if k[1] == k[0] + 1 else 0.0) * GAIN ** (k[1] - k[0]) for k, ids in spans}
        ahead, back = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
        ahead[0] = 1.0
        for (j, i), _ in spans:
            ahead[i] += ahead[j] * prob[j, i]
        back[n] = times / ahead[n]
        for (j, i), ids in reversed(spans):
            use = prob[j, i] * back[i]
            back[j] += use
            np.add.at(total, (ids[ids >= 0], of[ids >= 0]), (ahead[j] * use)[ids >= 0])
    for rows, sizes, codes in long_words(words):
        of, times, n = lang[rows], n_words[rows], codes.shape[1]
        found = np.array([*ends(codes, model)])
        with np.errstate(divide="ignore"):
            log = np.where(found >= 0, np.log(model.prob[found, of]), -np.inf)
        log[:, 0] = np.where(found[:, 0] >= 0, log[:, 0], np.log(model.unknown[of]))
        ahead, back = np.full((n + 1, len(rows)), -np.inf), np.full((n + 1, len(rows)), -np.inf)
        ahead[0] = 0.0
        for i in range(1, n + 1):
            m = min(i, model.longest)
            ahead[i] = np.logaddexp.reduce(ahead[i - m : i][::-1] + log[i - 1, :m], 0)
        back[sizes, np.arange(len(rows))] = 0.0
        whole = ahead[sizes, np.arange(len(rows))]
        for i in range(n, 0, -1):
            m = min(i, model.longest)
            on = log[i - 1, :m] + back[i]
            use = np.exp(ahead[i - m : i][::-1] + on - whole) * times
            hit = (found[i - 1, :m] >= 0) & (sizes >= i)
            np.add.at(total, (found[i - 1, :m][hit], np.broadcast_to(of, hit.shape)[hit]), use[hit])
            back[i - m : i] = np.logaddexp(back[i - m : i], on[::-1])
    return total


class LanguageModel:
    """Piece probabilities by language."""

    FLOOR = 0.1

    def __init__(self, languages: list[str], priors: list[float], counts: np.ndarray, pieces: list[str]):
        """counts: expected uses of each piece (a row) by each language (a column)."""
        self.name = uuid.uuid4().hex
        self.languages, self.pieces = languages, pieces
        self.log_prior = np.log(np.array(priors, float) / max(sum(priors), 1e-9))
        self.longest = max(map(len, pieces), default=1)
        total = counts.sum(0) + self.FLOOR * len(pieces)
        self.prob = (counts + self.FLOOR) / total
        self.unknown = self.FLOOR / total * UNKNOWN

    @functools.cached_property
    def index(self) -> PieceIndex:
        return PieceIndex(self.pieces)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter, as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                yield b.filter(pa.array([has_letter(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n): how often each language's texts hold each word, counted in tasks first."""

    def count(x: dict) -> Iterator[dict]:
        by: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(x["t"], x["l"], strict=True):
            by[lang].update(words_of(text))
        for lang, c in by.items():
            yield {"lang": [lang] * len(c), "word": [*c], "n": [*c.values()]}

    out = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
    rows = map_rows(
        docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")), count, "lang string, word binary, n long", out
    )
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def largest_share(sizes: list[int], room: int) -> int:
    """The most rows that every class may give so that all give at most `room`: rare classes give all they have."""
    left = max(room, len(sizes))  # a row of each class at least
    for k, n in enumerate(sorted(sizes)):
        if n > (most := left // (len(sizes) - k)):
            return most
        left -= n
    return max(sizes, default=0)


def learning_sample(docs: DataFrame, sizes: dict[str, int], lang_col: str, order_by: str, max_docs: int) -> DataFrame:
    """Of each language about equally many rows, those whose hash of `order_by` is least; of rare ones all."""
    most = largest_share([*sizes.values()], max_docs)
    bounds = [F.lit(x) for lang, n in sizes.items() if n > most for x in (lang, math.ceil(HASHES * most / n))]
    if not bounds:
        return docs
    bound = F.coalesce(F.create_map(*bounds)[F.col(lang_col)], F.lit(HASHES))
    return docs.filter(F.pmod(F.xxhash64(order_by), F.lit(HASHES)) < bound)


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    order_by: str = "doc_id",
    max_docs: int = 12_000,
    rounds: int = 2,
    vocabulary: str | None = None,
) -> LanguageModel:
    """Fit piece probabilities on a bounded sample of labelled rows.

    max_docs bounds the sample. Languages and priors come from a count of all labelled rows; each language has the
    same share of the sample, a rarer one all its rows, so none is lost as the corpus grows. Within a language the
    rows whose hash of `order_by` is least are learnt from. More than MAX_LANGUAGES languages are an error. rounds:
    expectation-maximisation steps, from uniform probabilities. Rows with a null language are not learnt from;
    with no labelled row the model has no language and answers `und`.
    """
    docs = docs.filter(F.col(lang_col).isNotNull())
    priors = {r[0]: r[1] for r in docs.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(priors) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sample = learning_sample(docs, priors, lang_col, order_by, max_docs)
    at = work_dir(docs.sparkSession)
    words = stored(word_counts(sample, text_col, lang_col), at, "words")
    pieces = load_pieces(vocabulary)
    languages = sorted(priors)
    counts = np.zeros((len(pieces), len(languages)))
    for _ in range(rounds if languages else 0):
        spread = docs.sparkSession.sparkContext.broadcast(LanguageModel(languages, [priors[x] for x in languages], counts, pieces))

        def expect(x: dict, spread=spread) -> Iterator[dict]:
            m = spread.value
            at = {v: k for k, v in enumerate(m.languages)}
            lang = np.array([at[v] for v in x["lang"]], np.int64)
            found = expected_counts([*map(spelled, x["word"])], lang, np.array(x["n"], float), m)
            piece, k = np.nonzero(found > 1e-6)
            yield {"piece": piece, "lang": k, "n": found[piece, k]}

        out = pa.schema([("piece", pa.int32()), ("lang", pa.int32()), ("n", pa.float64())])
        found = map_rows(words, expect, "piece int, lang int, n double", out)
        counts = np.zeros_like(counts)
        # at most vocabulary x MAX_LANGUAGES rows, whatever the corpus
        for piece, k, n in found.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[piece, k] = n
    return LanguageModel(languages, [priors[x] for x in languages], counts, pieces)


class WordScores:
    """Log-likelihoods of words, each computed once per worker while they fit in memory."""

    LIMIT = 200_000

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows = np.empty((4096, len(model.languages)))
        self.at: dict[bytes, int] = {}
        self.limit = min(self.LIMIT, 64_000_000 // (8 * max(len(model.languages), 1)))

    def meet(self, words: set[bytes]) -> None:
        """Score words not met yet; before that, forget all where they would be too many."""
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.limit:
            self.at.clear()
            new = [*words]
        n = len(self.at)
        if n + len(new) > len(self.rows):
            grown = np.empty((max(2 * len(self.rows), n + len(new)), self.rows.shape[1]))
            grown[:n] = self.rows[:n]
            self.rows = grown
        for i in range(0, len(new), 16_384):
            some = new[i : i + 16_384]
            self.rows[n + i : n + i + len(some)] = forward([*map(spelled, some)], self.model)
        self.at.update((w, n + k) for k, w in enumerate(new))

    def of(self, words: list[bytes]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0)


def judged(texts: list[str | None], scores: WordScores) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    m, langs, sure = scores.model, [], []
    each = [words_of(t) if m.languages and has_letter(t) else [] for t in texts]
    scores.meet(set().union(*each))
    for words in each:
        if not words:
            langs.append("und")
            sure.append(0.0)
            continue
        x = scores.of(words) + m.log_prior
        best = int(x.argmax())
        langs.append(m.languages[best])
        sure.append(float(1 / np.exp(x - x[best]).sum()))
    return langs, sure


def predict(
    docs: DataFrame,
    model: LanguageModel,
    text_col: str = "text",
    keep: list[str] | None = None,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """keep's columns, then the language and its score (called `names`), a row per row of docs.

    A text that is null, empty or has no letter, or any text under a model without languages, is `und` with score 0.
    The score is the posterior probability of the language given. Ties go to the first language in order; equal texts
    have equal answers; an empty table gives none. Long texts and long words are summed whole. Where docs has columns
    with these names itself and they are kept, choose others by `names`.
    """
    keep = docs.columns if keep is None else keep
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at, extra = [*keep, text_col].index(text_col), [] if text_col in keep else [F.col(f"`{text_col}`")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *extra)
    fields = source.schema.fields[: len(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        scores = remembered(m.name, lambda: WordScores(m))
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):  # only a slice's words are held at once
                b = whole.slice(i, SLICE)
                langs, sure = judged(b.column(at).to_pylist(), scores)
                cols = b.columns[: len(fields)] + [pa.array(langs, pa.string()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in fields), *names])
        release()

    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for rows kept from learning: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", **fitting) -> DataFrame:
    """Learn from the rows of docs that are not held out, and predict all: id, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out(id_col)), order_by=id_col, **fitting)
    flagged = docs.select(id_col, "text", held_out(id_col).alias("held_out"))
    return predict(flagged, model, keep=[id_col, "held_out"])  # no other column goes to Python
