"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a sequence of words and tags. A word scores by the features of its block: the elements around it, words of
their classes, ids and roles, links, length and punctuation, and whether the page has its main text marked elsewhere.
Tags score negative by their names. All weights are learnt from labelled pages (html_templates): those of features by
logistic regression, those of tags by counts. A linear scan finds the contiguous run with the greatest sum. Elements that
then score negative as a whole are taken out of the page, which leaves a gap that costs a little, and the same scan over
what is left finds the run that is the main text.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import SLICE, map_rows
from rillstone.llm.html_templates import labelled_pages

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)>|(?P<text>[^<]++|<)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Element names of HTML
RAW = frozenset("script style template noscript textarea title iframe svg select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup html hr legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head"}
#: What a run loses by a block inside it that is left out.
APART = -0.5
#: Elements whose text is a block of its own; the features of classes of these and of other block elements are apart.
LEAVES = frozenset("address blockquote caption center dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@functools.lru_cache(4096)
def own_features(name: str, attrs: str) -> frozenset[str]:
    """Features of an element's tag: its name, words of its class, id and role, and whether it is hidden."""
    if name not in BLOCK and name not in ("button", "label", "dialog"):
        return frozenset()
    kind = "leaf" if name in LEAVES else "box"
    found = {name}
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            found.update(f"{kind} {w.lower()}" for w in _WORDS.findall(value))
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I) or key == "aria-hidden" and value.lower() == "true":
            found.add("hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|=|/?$)", attrs):
        found.add("hidden")
    return frozenset(found)


class Element:
    __slots__ = ("name", "parent", "features", "link", "main", "out")

    def __init__(self, name: str, parent: Element | None, attrs: str):
        self.name, self.parent, self.out = name, parent, None
        own = own_features(name, attrs)
        self.features = united(parent.features, own) if parent else own
        self.link = name == "a" or bool(parent and parent.link)
        self.main = bool({"article", "main", "box main"} & own) or bool(parent and parent.main)


    def line(self) -> list[Element]:
        """The block elements from here out: few, however deep inline elements are."""
        if self.out is None:
            x, self.out = self, []
            while x is not None:
                if x.name in BLOCK or x.parent is None:
                    self.out.append(x)
                x = x.parent
        return self.out


@functools.lru_cache(65_536)
def united(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return a | b if b - a else a


def tokens(page: str) -> Iterator[tuple[str, str, Element]]:
    """(kind, value, element): kind is `text` (decoded), `open` or `close` (a tag's name). Content of scripts, styles
    and the like, comments and declarations are left out; unclosed elements end where HTML ends them, or at the end."""
    here = root = Element("", None, "")
    at, opened = 0, Counter()
    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        if (text := m["text"] or m["cdata"]) is not None:
            yield "text", entities.unescape(text) if m["text"] else text, here
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            x = here
            while opened[name] and x is not root and x.name != name:
                x = x.parent
            if x.name == name:
                yield "close", name, here
                while here is not x.parent:
                    opened[here.name] -= 1
                    here = here.parent
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in CLOSES_P or name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            over = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
            x, ends = here, ("p", *over.get(name, ()))
            while x is not root and (x.name not in BLOCK or x.name in ends):
                if x.name in ends:
                    while here is not x.parent:
                        opened[here.name] -= 1
                        here = here.parent
                x = x.parent
        x = Element(name, here, attrs)
        yield "open", name, x
        if name not in VOID and not attrs.endswith("/"):
            here = x
            opened[name] += 1


@dataclass
class Block:
    """Text between two block tags: the innermost block element around it, its words, and how many are links."""

    at: Element
    text: str
    n: int
    links: int

    def features(self, marked: bool) -> Iterable[str]:
        """Names of what is true of the block; marked: the page marks its main text."""
        share = self.links / self.n
        yield f"words {min(self.n, 40).bit_length()}"
        yield "linked all" if share > 0.8 else "linked half" if share > 0.3 else "linked little"
        if self.text[-1] in ".!?:;,\u2026\u3002\"'\u201d)":
            yield "ends"
        yield f"at {self.at.name}"
        if marked:
            yield f"inside {self.at.name}" if self.at.main else "outside"
        yield from self.at.features


def parts(page: str) -> list[str | tuple[Block, list[Element]]]:
    """The page in order: names of tags, and blocks with the elements that hold their text."""
    out: list = []
    words: list[tuple[str, Element]] = []

    def flush() -> None:
        text = " ".join("".join(w for w, _ in words).split())
        if text:
            x = next(e for w, e in words if w.strip())
            while x.parent is not None and x.name not in BLOCK and x.name not in ("button", "label"):
                x = x.parent
            links = sum(len(w.split()) for w, e in words if e.link)
            out.append(Block(x, text, max(len(text.split()), 1), links))
        words.clear()

    for kind, value, x in tokens(page):
        if kind == "text":
            words.append((value, x))
        elif value in BLOCK or value in ("button", "label"):
            flush()
            out.append(value)
        elif value == "br":
            words.append((" ", x))
    flush()
    return out


@dataclass
class Weights:
    """What a word scores by its block's features, and a tag by its name."""

    bias: float
    feature: dict[str, float]
    tag: dict[str, float]
    other_tag: float

    def of(self, block: Block, marked: bool) -> float:
        get = self.feature.get
        return self.bias + sum(get(f, 0.0) for f in block.features(marked))


def fit(pages: Iterable[tuple[str, set[str]]], decay: float = 0.25, rounds: int = 6, least: int = 8) -> Weights:
    """Weights from (page, texts of the blocks of its main text), by Newton's steps.

    decay: the ridge on the weights; least: blocks that must have a feature for it to count.
    """
    rows, label, weight, tags = [], [], [], {True: Counter(), False: Counter()}
    for page, main in pages:
        seen = parts(page)
        marked = any(isinstance(x, Block) and x.at.main for x in seen)
        last = False
        for x in seen:
            if isinstance(x, Block):
                last = x.text in main
                rows.append([*x.features(marked)])
                label.append(last)
                weight.append((2 + min(x.n, 8)) / 10)
            else:
                tags[last][x] += 1
    often = Counter(f for r in rows for f in r)
    names = {f: k for k, f in enumerate(sorted(f for f, n in often.items() if n >= least))}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1.0
    for k, r in enumerate(rows):
        x[k, [names[f] for f in r if f in names]] = 1.0
    y, w, ridge = np.array(label, float), np.array(weight), np.full(len(names) + 1, decay)
    ridge[-1] = 1e-3
    beta = np.zeros(len(ridge))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = w * np.maximum(p * (1 - p), 1e-4)
        beta += np.linalg.solve((x * curve[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * beta)
    n, m = sum(tags[True].values()) + 1, sum(tags[False].values()) + 1
    odds = {t: min(math.log((tags[True][t] + 0.5) / n) - math.log((tags[False][t] + 0.5) / m), 0.0) - 0.1 for t in {*tags[True], *tags[False]}}
    return Weights(float(beta[-1]), {f: float(beta[k]) for f, k in names.items()}, odds, -0.1)


@functools.cache
def weights() -> Weights:
    """Learnt from the labelled pages of html_templates."""
    return fit(labelled_pages())


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run with the greatest sum, the first and longest such; (0, 0) if none is above 0."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run < 0 or run == 0 and s > 0 and i == start:
            run, start = 0.0, i
        run += s
        if run > best or run == best and found[0] == start and found[1]:
            best, found = run, (start, i + 1)
    return found


def main_text(page: str | None, w: Weights | None = None, scan: bool = True) -> str:
    """The main text: blocks joined by a line feed, white space inside a block one space. Empty if there is none.

    scan: whether the run is sought; without it all of the page is the run (to see what the scan does).
    """
    if not page:
        return ""
    w = w or weights()
    seen = parts(page)
    marked = any(isinstance(x, Block) and x.at.main for x in seen)
    each = [w.of(x, marked) if isinstance(x, Block) else w.tag.get(x, w.other_tag) for x in seen]
    start, end = best_run([counted(x, s) for x, s in zip(seen, each, strict=True)])
    around = holding([x for x in seen[start:end] if isinstance(x, Block)])
    if around is None:
        return ""
    own, apart = folded(seen, each, around)
    start, end = best_run(own) if scan else (0, len(own))
    return "\n".join(x.text for k, x in enumerate(seen[start:end], start) if isinstance(x, Block) and k not in apart)


def counted(x: Block | str, score: float) -> float:
    """What a block or a tag adds to a run: a word counts from -1 to 1, so that a long advert doesn't outweigh what follows
    it; a tag a tenth of its odds."""
    return math.tanh(score / 2) * x.n if isinstance(x, Block) else score / 10


def holding(blocks: list[Block]) -> set[Element] | None:
    """The block elements that hold all of some blocks; None without blocks."""
    return set.intersection(*(set(x.at.line()) for x in blocks)) if blocks else None


def folded(seen: list[Block | str], each: list[float], around: set[Element]) -> tuple[list[float], set[int]]:
    """(what everything adds to the run once elements are seen as a whole, places of blocks that no run takes in).

    The words of an element that scores negative in all, unless it is one `around`, are left out of a run that goes on behind
    them; each block of them counts APART, so that a run doesn't go on behind many for little. Words next to others count
    as their element where that is better."""
    total: dict[Element, float] = defaultdict(float)
    words: dict[Element, int] = defaultdict(int)
    for x, s in zip(seen, each, strict=True):
        if isinstance(x, Block):
            for at in x.at.line():
                total[at] += s * x.n
                words[at] += x.n

    out, apart = [], set()
    for k, (x, s) in enumerate(zip(seen, each, strict=True)):
        if isinstance(x, Block):
            worst = min((total[at] / words[at] for at in x.at.line() if at not in around), default=0.0)
            if worst < 0:
                apart.add(k)
            elif s < 0 and words.get(x.at.parent):
                s = max(s, total[x.at.parent] / words[x.at.parent])
        out.append(APART if k in apart else counted(x, s))
    return out, apart


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points), a row per row of pages.

    Null and empty pages, and those without a word that scores above 0, have the empty text. Long pages are read whole;
    repeated rows have equal answers; an empty table gives none. Only the three columns are read, so others may have
    any name. The weights are learnt on the driver, once, from the labelled pages that this package makes.
    """
    spread = pages.sparkSession.sparkContext.broadcast(weights())

    def run(x: dict) -> Iterator[dict]:
        text = [main_text(h, spread.value) for h in x["html"]]
        yield {"page_id": x["page_id"], "url": x["url"], "text": text, "n_chars": [len(t) for t in text]}

    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(source, run, "page_id long, url string, text string, n_chars long", out, SLICE)
