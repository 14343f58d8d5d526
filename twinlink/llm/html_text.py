"""Main text of web pages: a bidirectional LSTM in numpy labels every block of a page in the context of all others."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags inside a block; every other tag ends the block before it.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text, and elements whose text belongs to no page body.
RAW = frozenset("script style textarea title noscript template svg iframe select option button head".split())
#: An opening tag of these ends an open paragraph or item of its kind.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

PATH_SIZE, WORD_SIZE, PLAIN = 96, 32, 6
FEATURES = PATH_SIZE + WORD_SIZE + PLAIN
HIDDEN = 16
SEED = 7
#: Pages that the training texts are taken from, and pages drawn up from them.
SAMPLE_PAGES = 200
TRAINING_PAGES = 1000


@dataclass
class Block:
    """A stretch of text between block tags, the tags above it with the words of their names, and its linked share."""

    text: str
    path: tuple[str, ...]
    linked: float


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Comments, scripts, styles, titles and form controls hold no blocks; character
    references are decoded and white space becomes one space. Tags may be unclosed and the page may end anywhere."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = [0, 0]

    def end() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            path = tuple(x for _, names in stack for x in names)
            out.append(Block(joined, path, linked[0] / max(linked[1], 1)))
        text.clear()
        linked[:] = 0, 0

    at, size = 0, len(page)
    depth_a = 0
    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            linked[1] += len(piece)
            linked[0] += len(piece) if depth_a else 0
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                depth_a = max(depth_a - 1, 0)
            if tag in INLINE:
                continue
            end()
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in INLINE:
            depth_a += tag == "a"
            if tag == "br":
                text.append(" ")
            continue
        end()
        depth_a = 0
        if tag in RAW and not m[3].endswith("/"):
            if tag != "head":
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else (size if tag in ("script", "style") else at)
                continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        for other in CLOSES.get(tag, ()):
            if stack and stack[-1][0] == other:
                stack.pop()
        names = [tag]
        if m[3]:
            for found in _NAMES.findall(m[3]):
                names += [f".{w}" for w in _SPLIT.split("".join(found).lower()) if w]
            if _HIDDEN.search(m[3]):
                names.append(".hidden")
        stack.append((tag, tuple(names)))
    end()
    return out


def features(page: list[Block]) -> np.ndarray:
    """A row for each block: hashed tag path, hashed words, and a few plain numbers."""
    out = np.zeros((len(page), FEATURES), dtype=np.float32)
    for row, block in zip(out, page):
        for k, name in enumerate(reversed(block.path)):
            h = zlib.crc32(name.encode())
            row[h % PATH_SIZE] += 1.0 if h >> 20 & 1 else -1.0
            if k < 2:
                h = zlib.crc32(f"{k}{name}".encode())
                row[h % PATH_SIZE] += 0.5 if h >> 20 & 1 else -0.5
        words = block.text.lower().split()
        different = set(words)
        for word in different:
            h = zlib.crc32(word.encode())
            row[PATH_SIZE + h % WORD_SIZE] += (1.0 if h >> 20 & 1 else -1.0) / np.sqrt(len(different))
        size = len(block.text)
        row[PATH_SIZE + WORD_SIZE :] = (
            np.log1p(size) / 5, block.linked, block.text[-1] in ".!?…\"”", min(len(words), 50) / 50,
            sum(map(str.isdigit, block.text)) / size, len(block.path) / 10,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one from each end of the page, and a logistic output for each block."""

    def __init__(self, rng: np.random.Generator):
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {d: scale(FEATURES + HIDDEN, 4 * HIDDEN) for d in "fb"}
        self.b = {d: np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32) for d in "fb"}
        self.out, self.bias = scale(2 * HIDDEN, 1)[:, 0], np.zeros(1, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.w["f"], self.w["b"], self.b["f"], self.b["b"], self.out, self.bias]

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (time x pages x hidden); pages shorter than the longest hold their state where ``mask`` is zero."""
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
        states, tape = np.zeros((steps, pages, HIDDEN), dtype=np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = np.concatenate([x[t], h], axis=1)
            gates = z @ self.w[d] + self.b[d]
            f, i, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            tape.append((t, z, f, i, o, g, c, tanh, m))
            c, h = m * new + (1 - m) * c, m * o * tanh + (1 - m) * h
            states[t] = h
        return states, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        states, tapes = zip(*[self._pass(x, mask, d) for d in "fb"])
        both = np.concatenate(states, axis=2)
        return both @ self.out + self.bias, [both, tapes]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over the blocks of a batch, by back-propagation through time."""
        logits, (both, tapes) = self.logits(x, mask)
        delta = (_sigmoid(logits) - y) * mask / max(mask.sum(), 1)
        grads = {d: (np.zeros_like(self.w[d]), np.zeros_like(self.b[d])) for d in "fb"}
        for k, d in enumerate("fb"):
            into = delta[:, :, None] * self.out[k * HIDDEN : (k + 1) * HIDDEN]
            dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            for t, z, f, i, o, g, c, tanh, m in reversed(tapes[k]):
                dh = dh + into[t]
                dnew = m * (dc + dh * o * (1 - tanh * tanh))
                gates = np.concatenate([dnew * c * f * (1 - f), dnew * g * i * (1 - i), m * dh * tanh * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                grads[d][0][...] += z.T @ gates
                grads[d][1][...] += gates.sum(axis=0)
                dh = (1 - m) * dh + (gates @ self.w[d].T)[:, FEATURES:]
                dc = (1 - m) * dc + dnew * f
        flat = both.reshape(-1, 2 * HIDDEN)
        return [grads["f"][0], grads["b"][0], grads["f"][1], grads["b"][1], flat.T @ delta.reshape(-1), delta.sum(keepdims=True).reshape(1)]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page which blocks are main text; pages of about the same length are passed together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        start = 0
        while start < len(order):
            longest = len(pages[order[min(start + 127, len(order) - 1)]])
            own = order[start : start + max(1, min(128, 20_000 // longest))]
            start += len(own)
            x, mask = _padded([pages[i] for i in own])
            logits, _ = self.logits(x, mask)
            for k, i in enumerate(own):
                out[i] = logits[: len(pages[i]), k] > 0
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), FEATURES), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


# Names that public page templates use for their parts; fixed values of the training pages below.
MAIN_NAMES = "content main article post entry story body text page-content post-body article-body entry-content main-content".split()
OTHER_PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs top-menu toc pagination",
    "header": "header masthead site-header banner topbar logo",
    "footer": "footer site-footer copyright bottom colophon legal",
    "aside": "sidebar side widget related recommended trending popular newsletter share social tags author-box",
    "div": "ad ads advert advertisement promo sponsored sponsor cookie cookie-notice notice alert consent popup modal subscribe gdpr",
    "section": "comments comment-list comment reply replies discussion reader-comments responses",
    "form": "search login signup subscribe contact comment-form",
}


def training_page(rng: np.random.Generator, paragraphs: list[str]) -> tuple[str, list[bool]]:
    """A page in a random template, and for each of its blocks whether it is main text."""
    parts: list[tuple[str, list[bool]]] = []
    pick = lambda options: options[rng.integers(len(options))]
    some = lambda: html.escape(pick(paragraphs))
    short = lambda: " ".join(some().split()[: rng.integers(1, 9)]) or "x"

    def names(words: str) -> str:
        kind = rng.integers(4)
        word = pick(words.split())
        return "" if kind == 0 else f' {pick(["class", "id"])}="{word}"' if kind < 3 else f' class="{pick(["c", "box", "wrap", "col"])} {word}"'

    def other(kind: str) -> tuple[str, list[bool]]:
        tag = kind if rng.random() < 0.6 or kind == "div" else "div"
        attributes = names(OTHER_PARTS[kind])
        if tag == "div" and not attributes:
            attributes = f' class="{pick(OTHER_PARTS[kind].split())}"'
        if kind == "nav" or (kind in ("aside", "footer", "header") and rng.random() < 0.4):
            n = int(rng.integers(2, 9))
            return f"<{tag}{attributes}><ul>" + "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(n)) + f"</ul></{tag}>", [False] * n
        if kind == "form":
            return f'<form{attributes}><label>{short()}</label><input type="text"><p>{short()}</p></form>', [False] * 2
        n = int(rng.integers(1, 5)) if kind in ("section", "aside") else 1
        inner = "".join(f"<{t}>{some() if rng.random() < 0.6 else short()}</{t}>" for t in (pick(["p", "div", "p"]) for _ in range(n)))
        if n == 1 and rng.random() < 0.6:
            inner = some()
        return f"<{tag}{attributes}>{inner}</{tag}>", [False] * n

    def article() -> list[tuple[str, list[bool]]]:
        n = int(rng.integers(1, 14))
        out = [(f"<h1>{short()}</h1>", [True])] if rng.random() < 0.8 else []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.8:
                out.append((f"<p>{'<b>' * (rng.random() < 0.1)}{some()}" + "</p>" * (rng.random() < 0.9), [True]))
            elif kind < 0.87:
                out.append((f"<h2>{short()}</h2>", [True]))
            elif kind < 0.92:
                k = int(rng.integers(1, 5))
                out.append(("<ul>" + "".join(f"<li>{some()}</li>" for _ in range(k)) + "</ul>", [True] * k))
            elif kind < 0.95:
                out.append((f"<blockquote>{some()}</blockquote>", [True]))
            elif kind < 0.97:
                out.append((f"<pre>{some()}</pre>", [True]))
            else:
                out.append(other(pick(["div", "aside"])))
        return out

    for kind in ("header", "nav", "div", "form"):
        if rng.random() < (0.7 if kind == "nav" else 0.4):
            parts.append(other(kind))
    style = rng.integers(4)
    if style == 0:
        opened, closed = f"<article{names('post entry story')}>", "</article>"
    elif style == 1:
        opened, closed = f"<main{names('content main')}>", "</main>"
    elif style == 2:
        opened, closed = f'<div {pick(["class", "id"])}="{pick(MAIN_NAMES)}">', "</div>"
    else:
        opened, closed = f'<div id="main"><article class="{pick(MAIN_NAMES)}">', "</article></div>"
    parts += [(opened, []), *article()]
    late = other("section") if rng.random() < 0.2 else None
    parts += [late] * bool(late) + [(closed, [])]
    for kind in ("aside", "section", "div", "form", "footer"):
        if rng.random() < (0.8 if kind == "footer" else 0.35):
            parts.append(other(kind))
    body = "".join(p for p, _ in parts)
    return f"<html><head><title>{short()}</title></head><body>{body}</body></html>", [x for _, labels in parts for x in labels]


def train(paragraphs: list[str], pages: int = TRAINING_PAGES, epochs: int = 6) -> Labeller:
    """A labeller fitted to pages drawn up from the given texts in random templates, always the same for the same texts."""
    rng = np.random.default_rng(SEED)
    usable = [" ".join(p.split()) for p in paragraphs if p.split()] or ["text"]
    data = []
    for _ in range(pages):
        page, labels = training_page(rng, usable)
        found = blocks(page)
        if len(found) == len(labels) and found:
            data.append((features(found), np.array(labels, dtype=np.float32)))
    model = Labeller(rng)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for start in range(0, len(order), 16):
            own = [data[i] for i in order[start : start + 16]]
            x, mask = _padded([f for f, _ in own])
            y = np.zeros_like(mask)
            for k, (_, labels) in enumerate(own):
                y[: len(labels), k] = labels
            step += 1
            rate = 0.01 if epoch < epochs - 2 else 0.002
            for p, g, (m, v) in zip(model.parameters(), model.gradients(x, mask, y), moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> Labeller:
    """A labeller whose training pages are made of the texts of at most ``SAMPLE_PAGES`` pages, those with the least hash of their id."""
    ids = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PAGES)
    chosen = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).join(F.broadcast(ids), "id")
    rows = chosen.where("html is not null").orderBy("id", "html").limit(2 * SAMPLE_PAGES).collect()
    return train([b.text for r in rows for b in blocks(r["html"])])


def main_text(pages: DataFrame, model: Labeller, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_blocks`` (blocks of the page) of every row: the main blocks in page order, joined by one space.

    A null page is an empty one; a page without a main block has an empty text.
    """
    source = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [blocks(p.as_py() or "") for p in part.column("__html")]
                labels = model.label([features(b) for b in found])
                texts = [" ".join(b.text for b, main in zip(page, own.tolist()) if main) for page, own in zip(found, labels)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(texts, type=pa.string()), pa.array([len(b) for b in found], type=pa.int64())],
                    [*keep, "text", "n_blocks"],
                )

    return source.mapInArrow(run, f"{kinds}, text string, n_blocks long")
