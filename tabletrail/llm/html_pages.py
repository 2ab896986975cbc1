"""HTML extraction by a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text between block-level tags. Each
block has a vector of its tag path (tags, class and id words, hashed), of its words
(hashed), and of its length and share of links. A bidirectional LSTM in numpy reads the
whole sequence and labels every block as main text or not.

The network is trained on ``TRAIN_PAGES`` seeded layouts, drawn from common ways to mark
up articles and what surrounds them. Nothing of the pages to extract is learned from.

Markup, comments, scripts and styles never become blocks. Nor does what stands in a closed
``UNSEEN`` element; one without an end tag hides nothing. Text in ``<math>`` is text. Character references are
decoded, white space in a block becomes one space, kept blocks join by a line break.

Edge cases: null or empty html, and pages without main text, give an empty text;
unclosed and stray tags are read as browsers do in the common cases; repeated rows and
equal ids each get a row; null ids and urls stay. Empty tables give no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read

PATH_DIM, WORD_DIM, HIDDEN = 192, 32, 16
DIM = PATH_DIM + WORD_DIM + 4
TRAIN_PAGES, EPOCHS, RATE, SEED = 1000, 8, 0.01, 11
STEP_ROOM = 1 << 14  # blocks of a padded batch; a longer page is a batch of its own

# Elements of HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "iframe", "noembed", "noframes")
FOREIGN = {"svg", "math"}
UNSEEN = {"template", "svg", "object", "canvas", "audio", "video"}  # what they hold is not shown as text
LEAVES = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
RETURNS = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = {"object", "template"}
WALLS = {"ul", "ol", "dl", "table", "select"} | SCOPES

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']|"[^"]*"|'[^']*')*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], tuple | None]] = []  # the last says what was there before an embedded element
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked, parts
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, tuple(word for _, words, _ in stack for word in words), linked))
            parts = []  # a mark may hold the old ones
        linked = 0

    def close(names: tuple[str, ...], walls: set[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in walls:
                return

    foreign = False
    while True:
        token = _TOKEN.search(html, at)
        piece = html[at:token.start() if token else len(html)]
        if piece:
            parts.append(piece)
            if any(tag == "a" for tag, *_ in stack):
                linked += len(piece)
        if not token:
            break
        at = token.end()
        ends, tag, rest = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        outer = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in FOREIGN), None) if foreign else None
        if ends:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in UNSEEN:
                if depth is not None:
                    size, parts, length, linked = stack[depth][2]
                    del out[size:], parts[length:], stack[depth:]
                continue
            if tag not in INLINE and tag not in FOREIGN and (outer is None or depth is None or depth < outer):
                flush()
            if depth is not None:
                if tag in INLINE and any(t not in INLINE for t, *_ in stack[depth + 1:]):
                    del stack[depth]
                else:
                    del stack[depth:]
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>?", re.I).search(html, at)
            if not rest.endswith("/"):
                at = stop.end() if stop else len(html)
            continue
        if outer is not None and not any(t in RETURNS for t, *_ in stack[outer + 1:]):
            if tag in LEAVES:
                del stack[outer:]
            else:
                if not rest.endswith("/"):
                    stack.append((tag, (), (len(out), parts, len(parts), linked)))
                continue
        if tag in UNSEEN or tag in FOREIGN:
            if not rest.endswith("/"):
                stack.append((tag, (), (len(out), parts, len(parts), linked)))
                foreign |= tag in FOREIGN
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES:
                close(CLOSES[tag], WALLS)
            else:
                close(("p",), SCOPES)
        if tag in VOID:
            continue
        words = [tag]
        for found in _NAME.finditer(rest) if rest else ():
            words += [f".{w}" for w in _PARTS.findall((found[1] or found[2] or found[3] or "").lower())]
        stack.append((tag, tuple(words), None))
    flush()
    return out


def _slot(word: str, size: int, _known: dict = {}) -> int:  # noqa: B006 a cache of hashes of names
    key = (word, size)
    if key not in _known:
        if len(_known) > 100_000:
            _known.clear()
        _known[key] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % size
    return _known[key]


def features(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), DIM), np.float32)
    for row, block in zip(out, page):
        for word in block.path:
            if word not in ("html", "body"):
                row[_slot(word, PATH_DIM)] = 1
        words = block.text.lower().split()
        slots = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIM for w in words], minlength=WORD_DIM)
        row[PATH_DIM:PATH_DIM + WORD_DIM] = slots / max(len(words), 1)
        row[-4:] = np.log1p(len(words)) / 5, min(block.linked / len(block.text), 1), len(words) < 4, 1
    return out


class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.params = {}
        for side in "fb":
            self.params["x" + side] = rng.normal(0, 0.1, (DIM, 4 * HIDDEN)).astype(np.float32)
            self.params["h" + side] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.params["o" + side] = rng.normal(0, 0.1, HIDDEN).astype(np.float32)
        self.params["ox"] = np.zeros(DIM, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str):
        """States of one direction; ``x`` is steps by pages by features."""
        steps, pages, _ = x.shape
        inputs = x @ self.params["x" + side]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        states, kept = np.zeros((steps, pages, HIDDEN), np.float32), [None] * steps
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = inputs[t] + h @ self.params["h" + side]
            i, f, o = (1 / (1 + np.exp(-g)) for g in (gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN] + 1, gates[:, 2 * HIDDEN:3 * HIDDEN]))
            g = np.tanh(gates[:, 3 * HIDDEN:])
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            kept[t] = (h, c, i, f, o, g, tanh_c)
            m = mask[t][:, None]
            h, c = m * o * tanh_c + (1 - m) * h, m * c_new + (1 - m) * c
            states[t] = h
        return states, kept

    def scores(self, x: np.ndarray, mask: np.ndarray):
        both = {side: self._run(x, mask, side) for side in "fb"}
        logits = x @ self.params["ox"] + sum(both[side][0] @ self.params["o" + side] for side in "fb")
        return logits, both

    def gradients(self, x: np.ndarray, mask: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        logits, both = self.scores(x, mask)
        d_logit = ((1 / (1 + np.exp(-logits)) - wanted) * mask / mask.sum()).astype(np.float32)
        out = {"ox": np.einsum("tb,tbd->d", d_logit, x)}
        for side in "fb":
            states, kept = both[side]
            out["o" + side] = np.einsum("tb,tbh->h", d_logit, states)
            d_gates = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            w_h = np.zeros_like(self.params["h" + side])
            d_h = d_c = np.zeros((x.shape[1], HIDDEN), np.float32)
            steps = range(len(x))
            for t in reversed(steps) if side == "f" else steps:
                h, c, i, f, o, g, tanh_c = kept[t]
                m = mask[t][:, None]
                d_h = d_h + d_logit[t][:, None] * self.params["o" + side]
                here = d_h * m
                d_new = here * o * (1 - tanh_c**2) + d_c * m
                d_gates[t] = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), here * tanh_c * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
                w_h += h.T @ d_gates[t]
                d_h = d_gates[t] @ self.params["h" + side].T + d_h * (1 - m)
                d_c = d_new * f + d_c * (1 - m)
            out["h" + side] = w_h
            out["x" + side] = np.einsum("tbd,tbg->dg", x, d_gates, optimize=True)
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, size: int = 32, seed: int = SEED) -> Labeller:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), size):
                chosen = [pages[i] for i in order[at:at + size]]
                x, mask = padded([p[0] for p in chosen])
                wanted = np.zeros(mask.shape, np.float32)
                for i, (_, y) in enumerate(chosen):
                    wanted[:len(y), i] = y
                step += 1
                for k, g in self.gradients(x, mask, wanted).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def main_text(self, pages: list[list[Block]]) -> list[str]:
        """The main text of each page."""
        out = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            count = max(1, min(len(order), STEP_ROOM // len(pages[order[-1]])))
            batch, order = order[-count:], order[:-count]
            x, mask = padded([features(pages[i]) for i in batch])
            kept = self.scores(x, mask)[0] > 0
            for column, i in enumerate(batch):
                out[i] = "\n".join(b.text for b, k in zip(pages[i], kept[:, column]) if k)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), DIM), np.float32), np.zeros((steps, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[:len(p), i], mask[:len(p), i] = p, 1
    return x, mask


# Names that pages give to their parts, and words of their surroundings.
MAIN_NAMES = "article content post entry story main body text article-body post-content entry-content story-body page-content".split()
SIDE_PARTS = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu links toc pagination".split(),
    "header": "header site-header masthead top banner branding logo".split(),
    "footer": "footer site-footer copyright legal bottom colophon".split(),
    "aside": "sidebar side widget rail secondary related popular trending recommended more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adbox".split(),
    "notice": "cookie cookies notice consent gdpr banner alert popup modal newsletter subscribe message".split(),
    "comments": "comments comment comment-list discussion replies reply responses user-comments disqus".split(),
    "form": "form search login signup contact subscribe-form search-form".split(),
    "share": "share social sharing follow tags meta byline-tools print".split(),
}
SIDE_WORDS = "cookie accept subscribe newsletter login search share follow copyright rights reserved privacy terms contact about home menu comment reply advertisement sponsored read more related".split()
MARK = "\x01"


def layout(rng: random.Random) -> str:
    """A page of made-up words; blocks of main text begin with ``MARK``."""
    syllables = ["th", "an", "er", "in", "on", "re", "st", "en", "la", "de", "ou", "ti", "che", "ung", "os", "ra", "mi"]

    def say(low: int, high: int, side: bool = False) -> str:
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        if side and rng.random() < 0.6:
            words[rng.randrange(len(words))] = rng.choice(SIDE_WORDS)
        return " ".join(words)

    def items(low: int, high: int, link: bool = True) -> str:
        made = "".join(f"<li>{f'<a href=x>{say(1, 4, True)}</a>' if link else say(1, 20, True)}</li>" for _ in range(rng.randint(low, high)))
        return f"<ul>{made}</ul>"

    def named(kind: str) -> str:
        name, how = rng.choice(SIDE_PARTS[kind]), rng.random()
        return f' class="{name}"' if how < 0.6 else f' id="{name}"' if how < 0.8 else f' class="{name} {rng.choice(["wrap", "box", "inner", "block"])}"'

    def side(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        plain = tag not in ("div", "section") and rng.random() < 0.5
        tag = tag if plain or rng.random() < 0.4 else "div"
        open_tag = f"<{tag}{'' if plain else named(kind)}>"
        if kind == "nav":
            inner = items(2, 9) if rng.random() < 0.8 else " ".join(f"<a href=x>{say(1, 2)}</a>" for _ in range(4))
        elif kind == "comments":
            who = rng.choice(["comment", "reply", "comment-body"])
            inner = f"<h3>{say(1, 3, True)}</h3>" + "".join(f'<{rng.choice(["div", "article", "li"])} class="{who}"><p>{say(2, 60)}</p></div>' for _ in range(rng.randint(1, 5)))
            inner = inner.replace("</div>", "</div></article></li>") if rng.random() < 0.1 else inner
        elif kind == "form":
            inner = f"<label>{say(1, 3, True)}</label><input><select><option>{say(1, 2)}<option>{say(1, 2)}</select><button>{say(1, 2, True)}</button>"
        elif kind == "aside":
            inner = f"<h3>{say(1, 4, True)}</h3>" + (items(2, 7) if rng.random() < 0.6 else f"<p>{say(3, 50, True)}</p>")
        elif kind == "header":
            inner = f"<a href=x>{say(1, 3)}</a>" + (f"<h2>{say(1, 6)}</h2>" if rng.random() < 0.5 else f"<p>{say(2, 12)}</p>")
        else:
            body = say(2, 45, True)
            inner = rng.choice([body, f"<p>{body}</p>", f"<p>{body}</p><button>{say(1, 2, True)}</button>", f"&copy; {body}", f"<span>{body}</span>"])
        return f"{open_tag}{inner}</{tag}>"

    def text() -> str:
        long = say(30, 120) if rng.random() < 0.7 else say(1, 12)
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{MARK}{long}</p>" if rng.random() < 0.8 else f"<p><b>{MARK}{long}<br>"
        if kind < 0.8:
            return f"<h2>{MARK}{say(1, 10)}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{MARK}{say(1, 25)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        return rng.choice([f"<blockquote>{MARK}{long}</blockquote>", f"<pre>{MARK}{long}</pre>", f"<table><tr><td>{MARK}{say(1, 9)}<td>{MARK}{say(1, 9)}</table>", f"<div>{MARK}{long}</div>", f"<section><p>{MARK}{long}</p></section>"])

    tag, attributes = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", f' class="{rng.choice(MAIN_NAMES)}"'), ("div", f' id="{rng.choice(MAIN_NAMES)}"'), ("section", f' class="{rng.choice(MAIN_NAMES)}"')])
    body = [text() for _ in range(rng.randint(1, rng.choice([3, 14])))]
    for kind in rng.sample(["ad", "aside", "form", "share", "notice", "nav"], k=rng.choice([0, 0, 0, 1, 2])):
        body.insert(rng.randint(0, len(body)), side(kind))
    heading = f"<h1>{MARK}{say(1, rng.choice([3, 14]))}</h1>" if rng.random() < 0.85 else ""
    article = f"<{tag}{attributes}>{heading}{''.join(body)}</{tag}>"
    if tag == "article" and rng.random() < 0.3:
        article = f'<main class="{rng.choice(MAIN_NAMES)}">{article}</main>'
    before = [side(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5]
    after = [side(k) for k in ("share", "comments", "aside", "ad", "form", "footer", "notice") if rng.random() < 0.5]
    rng.shuffle(before)
    if rng.random() < 0.3:
        rng.shuffle(after)
    return f"<html><head><title>{say(2, 10)}</title><script>{say(1, 4)}</script></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Labeller:
    rng, made = random.Random(seed), []
    for _ in range(pages):
        found = blocks(layout(rng))
        wanted = np.array([b.text.startswith(MARK) for b in found], np.float32)
        made.append((features([b._replace(text=b.text.lstrip(MARK).strip() or "x") for b in found]), wanted))
    return Labeller(seed).fit(made)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                texts = model.main_text([blocks(h) for h in part["html"]])
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64").to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op6_html_labeller(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, folder, "pages"), trained())


QUERIES = {"op6_html_labeller": op6_html_labeller}
SQL: dict = {}
