"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, each with the tags and classes above it.  Features of those
and of the block's text are scored by a two-label chain (article or not), trained by maximum
likelihood on labelled pages, and Viterbi finds the best labelling of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitfactors.llm.common import whole
from pitfactors.llm.html_pages import labelled_pages

#: Fixed values of HTML: elements inside a line of text, elements without content, elements whose content is no page text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose mfenced mmultiscripts mprescripts merror semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object select textarea canvas audio video".split())
RAW = frozenset("script style iframe textarea title".split())  # up to the first end tag, whatever stands before it
IN_HEAD = frozenset("head title meta link base basefont bgsound script style noscript template".split())
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
STRUCTURE = frozenset("article main section nav header footer aside form ul ol dl table figure blockquote dialog".split())
#: Class and id words by what they tell about a part of a page.
HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "side": "sidebar side aside related widget recommended recommendation recommendations popular trending more",
    "comment": "comment comments reply replies respond disqus discussion feedback reviews",
    "notice": "cookie cookies consent gdpr notice notification alert newsletter subscribe signup popup modal overlay paywall",
    "social": "share sharing social follow",
    "head": "header masthead topbar logo tagline branding",
    "foot": "footer bottom copyright legal colophon disclaimer",
    "form": "form search login contact",
    "text": "content article post entry story body text main page prose",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CLOSERS: dict[str, re.Pattern] = {}


@dataclass
class Block:
    text: str
    tag: str
    tags: frozenset[str]
    hints: frozenset[str]
    linked: float  # share of the text inside links


class _Closers:
    """Ends of the elements of a page that are skipped; each name is looked for once."""

    def __init__(self, page: str):
        self.page, self._pairs, self._raw = page, {}, {}

    def end(self, name: str, start: int, at: int) -> int | None:
        """Where the element whose start tag spans ``start`` to ``at`` ends; None if its end tag is missing."""
        if name in RAW:
            if self._raw.get(name, at) is None:
                return None
            closer = _CLOSERS.setdefault(name, re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I))
            found = closer.search(self.page, at)
            self._raw[name] = found.end() if found else None
            return self._raw[name]
        if name not in self._pairs:
            tag = _CLOSERS.setdefault(name, re.compile(rf"<!--.*?(?:-->|\Z)|<(/?){name}(?![\w:-])([^>]*)(?:>|\Z)", re.I | re.S))
            pairs, opened = {}, []
            for m in tag.finditer(self.page):
                if m.group(1):
                    if opened:
                        pairs[opened.pop()] = m.end()
                elif m.group(2) is not None and not m.group(2).endswith("/"):
                    opened.append(m.start())
            self._pairs[name] = pairs
        return self._pairs[name].get(start)

    def head_end(self, at: int) -> int:
        """Where a head that begins before ``at`` ends: behind its end tag, or else where the first thing stands that no head holds."""
        text = None
        while m := _TAG.search(self.page, at):
            if text is None and self.page[at : m.start()].strip():
                text = at
            at, name = m.end(), (m.group(2) or "").lower()
            if m.group(1):
                if name == "head":
                    return at
                if name in ("body", "html"):
                    break
            elif name and (name not in IN_HEAD or name == "head"):
                return m.start() if text is None else text
            elif name in RAW or name in SILENT:
                at = self.end(name, m.start(), at) or at
        if text is None and self.page[at:].strip() and not m:
            text = at
        return at if text is None else text


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text between block-level tags, references decoded, white space single.

    A skipped element whose end tag is missing does not take the page with it: reading goes on
    behind its start tag, behind the code of a script or style at the next tag.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], frozenset[str]]] = [("body", frozenset(), frozenset())]
    buffer: list[str] = []
    link_at = -1  # depth of the open link
    linked = 0
    at = 0
    closers = _Closers(page)

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = next(s for s in reversed(stack) if s[0] not in INLINE)
                out.append(Block(text, top[0], top[1], top[2], min(1.0, linked / max(1, len(raw)))))
            buffer.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal link_at
        del stack[depth:]
        if link_at >= depth:
            link_at = -1

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if link_at >= 0:
            linked += len(text)

    while True:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):  # end tag
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if name not in INLINE:
                flush()
            if depth and (name not in INLINE or all(s[0] in INLINE for s in stack[depth:])):
                close(depth)
            continue
        if name == "head":
            flush()
            at = closers.head_end(at)
            continue
        if name in SILENT:
            if name != "svg":
                flush()
            if not m.group(3).endswith("/>"):
                end = closers.end(name, m.start(), at)
                if end is None and name in ("script", "style"):  # code up to the next tag
                    following = _TAG.search(page, at)
                    end = following.start() if following else len(page)
                at = end or at
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                add("" if name == "wbr" else " ")
            else:
                stack.append((name, *stack[-1][1:]))
                if name == "a" and link_at < 0:
                    link_at = len(stack) - 1
            continue
        flush()
        if name in ENDS_P or name in ("li", "td", "th", "tr", "dt", "dd"):
            stop = ("ul", "ol", "table", "dl", "body")
            same = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, ("p", "h1", "h2", "h3", "h4", "h5", "h6") if name != "p" else ("p",))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in same:
                    close(i)
                    break
                if stack[i][0] in stop or (stack[i][0] not in INLINE and stack[i][0] not in ("p", "div") and name not in ("li", "td", "th", "tr", "dt", "dd")) or (stack[i][0] == "div"):
                    break
        if name in VOID:
            continue
        _, tags, hints = stack[-1]
        if name in STRUCTURE and name not in tags:
            tags = tags | {name}
        found = {_HINT[w] for group in _NAMES.findall(m.group(3)) for w in _WORD.findall("".join(group).lower()) if w in _HINT} if "=" in m.group(3) else set()
        stack.append((name, tags, hints | found if found else hints))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def features(b: Block) -> tuple[str, ...]:
    n = b.text.count(" ") + 1
    size = "1" if n < 3 else "3" if n < 8 else "8" if n < 20 else "20" if n < 60 else "60"
    link = "0" if b.linked < 0.05 else "some" if b.linked < 0.6 else "all"
    out = ["all", f"tag {b.tag}", f"words {size}", f"link {link}", f"ends {b.text[-1] in '.!?…»”'}"]
    out += [f"in {t}" for t in sorted(b.tags)] + [f"hint {h}" for h in sorted(b.hints)]
    if "©" in b.text[:40] or "rights reserved" in b.text.lower()[-200:]:
        out.append("copyright")
    if not b.tags & {"article", "main"} and "text" not in b.hints:
        out.append("no article above")
    return tuple(out)


class Chain:
    """Two-label chain: a weight per feature for label 1, and start and transition weights."""

    CACHE = 100_000

    def __init__(self, weights: dict[str, float], start: np.ndarray, move: np.ndarray):
        self.weights, self.start, self.move = weights, start.tolist(), move.tolist()
        self._known: dict[tuple, float] = {}

    @classmethod
    def train(cls, pages: list[tuple[str, list[bool]]], ridge: float = 0.5, steps: int = 150) -> Chain:
        """Maximum conditional likelihood by adaptive gradient steps over all pages at once."""
        rows, gold = [], []
        for page, labels in pages:
            found = [features(b) for b in blocks(page)]
            if len(found) != len(labels):
                raise ValueError(f"page has {len(found)} blocks and {len(labels)} labels")
            rows.append(found)
            gold.append([int(x) for x in labels])
        names = {f: i for i, f in enumerate(sorted({f for page in rows for b in page for f in b}))}
        n, longest = len(rows), max(map(len, rows))
        x = np.zeros((n, longest, len(names)), np.float32)
        y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (page, labels) in enumerate(zip(rows, gold)):
            for t, b in enumerate(page):
                x[i, t, [names[f] for f in b]] = 1
            y[i, : len(labels)], mask[i, : len(labels)] = labels, True
        w, start, move = np.zeros(len(names)), np.zeros(2), np.zeros((2, 2))
        size = [np.zeros_like(p) + 1e-8 for p in (w, start, move)]
        last = mask.sum(axis=1) - 1
        for _ in range(steps):
            emit = np.stack([np.zeros((n, longest)), x @ w], axis=2)
            alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            alpha[:, 0] = start + emit[:, 0]
            for t in range(1, longest):
                alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + emit[:, t]
            for t in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
            z = np.logaddexp.reduce(alpha[np.arange(n), last], axis=1)
            p = np.exp(alpha + beta - z[:, None, None])[:, :, 1] * mask
            pair = np.exp(alpha[:, :-1, :, None] + move + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            want = np.zeros((n, 2))
            want[np.arange(n), y[:, 0]] = 1
            both = np.zeros((2, 2))
            np.add.at(both, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
            first = np.exp(alpha[:, 0] + beta[:, 0] - z[:, None])
            grads = [np.einsum("nt,ntf->f", (y - p) * mask, x) - ridge * w, (want - first).sum(axis=0) - ridge * start, both - pair.sum(axis=(0, 1)) - ridge * move]
            for value, grad, total in zip((w, start, move), grads, size):
                total += grad**2
                value += 0.5 * grad / np.sqrt(total)
        return cls(dict(zip(names, w.tolist())), start, move)

    def _emit(self, b: Block) -> float:
        key = features(b)
        found = self._known.get(key)
        if found is None:
            if len(self._known) >= self.CACHE:
                self._known.clear()
            found = self._known[key] = sum(self.weights.get(f, 0.0) for f in key)
        return found

    def label(self, page: list[Block]) -> list[int]:
        """Viterbi labels of the blocks; a tie leaves a block out."""
        if not page:
            return []
        back: list[tuple[int, int]] = []
        best = (self.start[0], self.start[1] + self._emit(page[0]))
        move = self.move
        for b in page[1:]:
            e = self._emit(b)
            to0, to1 = (best[0] + move[0][0], best[1] + move[1][0]), (best[0] + move[0][1], best[1] + move[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            best = (max(to0), max(to1) + e)
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def text(self, page: str) -> str:
        found = blocks(page)
        return "\n\n".join(b.text for b, keep in zip(found, self.label(found)) if keep)


def _extract(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [chain.text(p.as_py()) for p in batch.column("html")]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text (blocks joined by a blank line), n_chars (code points).

    Null or empty html, and pages without article blocks, give an empty text.  Broken and cut
    markup is read as far as it goes.  Repeated rows are extracted one by one, null ids and
    URLs are passed on, other columns are ignored, an empty table gives an empty result.
    """
    chain = chain or Chain.train(labelled_pages())
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), whole(html_col).alias("html"))
    return rows.mapInArrow(_extract(chain), "page_id long, url string, text string, n_chars long")
