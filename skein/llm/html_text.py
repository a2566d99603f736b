"""Main-text extraction from HTML by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks in page order: runs of text that no block element breaks, with the
elements they stand in. Features are ancestor tags and words of their class and id, and measures of
the text and its links. The field has two labels, text and rest; it is trained on labelled pages made
here from varied layouts, and Viterbi finds the best labelling of a page.

Defined cases: a null page is empty; a page without main text gives an empty string; broken, unclosed
and cut-off markup is read as far as it goes; markup of any size and depth is read whole, in a loop
without recursion; script, style and other raw elements never give blocks; a reference that is not
complete stays as written; repeated rows each give a row.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that do not break a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content, and elements whose content is not markup or not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas audio video noframes".split())
#: An open element of the first kind ends when one of the second kind begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"(?:\b(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))|\b(hidden)\b", re.I)
_NAME = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…][\"'”»)]*(?:\s|$)")


@dataclass
class Block:
    text: str
    features: tuple[str, ...]


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role."""
    if "=" not in attributes and "hidden" not in attributes:
        return ()
    words: list[str] = []
    for m in _ATTR.finditer(attributes):
        words += ["hidden"] if m[3] else _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2]).lower())
    return tuple(words)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: dict[str, int] = {}  # features of the open elements, and how many of them have each
    places: dict[str, list[int]] = {}  # of every open tag, where it stands on the stack
    run: list[str] = []
    linked = links = depth_a = 0

    def marks(tag: str, names: tuple[str, ...]) -> list[str]:
        return ["in=" + tag, *("name=" + n for n in names)]

    def push(tag: str, names: tuple[str, ...]) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, names))
        for f in marks(tag, names):
            held[f] = held.get(f, 0) + 1

    def cut(size: int) -> None:
        while len(stack) > size:
            tag, names = stack.pop()
            places[tag].pop()
            for f in marks(tag, names):
                held[f] -= 1
                if not held[f]:
                    del held[f]

    def close() -> None:
        nonlocal linked, links
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                out.append(Block(text, _features(stack, held, text, linked, links)))
            run.clear()
        linked = links = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:  # an opening bracket that never becomes a tag
            run.append(page[at])
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            run.append(m[4])
            if depth_a:
                linked += len(m[4].strip())
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if tag == "a" and depth_a:
                    depth_a -= 1
                elif tag == "br":
                    run.append(" ")
                continue
            if tag == "body" or tag == "html":  # what follows still belongs to the page
                close()
                continue
            if places.get(tag):
                close()
                cut(places[tag][-1])
            continue
        if tag in INLINE:
            if tag == "a":
                depth_a, links = 1, links + 1
            elif tag in ("br", "img", "wbr"):
                run.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            if tag not in ("script", "style", "svg"):
                close()
            continue
        close()
        depth_a = 0
        while stack and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in CLOSES:
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0] in CLOSES[tag] and tag in CLOSES.get(stack[i][0], ()):
                    cut(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "dl", "nav", "div"):
                    break
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            push(tag, _names(m[3]))
    close()
    return out


def _features(stack: list[tuple[str, tuple[str, ...]]], held: dict[str, int], text: str, linked: int, links: int) -> tuple[str, ...]:
    found = {"bias", *held}
    if stack:
        found.add("own=" + stack[-1][0])
        if len(stack) > 1:
            found.add("pair=" + stack[-2][0] + ">" + stack[-1][0])
    words = text.count(" ") + 1
    found.add("words=%d" % min(6, int(math.log2(words))))
    share = linked / max(1, len(text))
    found.add("linked=%d" % min(4, int(share * 4.99)))
    found.add("links=%d" % min(3, links))
    found.add("stops=%d" % sum(1 for _ in islice(_SENTENCE.finditer(text), 3)))
    if "©" in text:
        found.add("copyright")
    return tuple(sorted(found))


class Field:
    """Two labels: 0 for the rest, 1 for main text. weights: by feature, of label 1 against label 0."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.move = [[0.0, 0.0], [0.0, 0.0]]

    def emit(self, blocks: list[tuple[str, ...]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in b) for b in blocks]

    def viterbi(self, blocks: list[tuple[str, ...]]) -> list[int]:
        if not blocks:
            return []
        scores, back = self.emit(blocks), []
        best = [0.0, scores[0]]
        for s in scores[1:]:
            here = [max((best[a] + self.move[a][b], a) for a in (0, 1)) for b in (0, 1)]
            back.append((here[0][1], here[1][1]))
            best = [here[0][0], here[1][0] + s]
        label = int(best[1] > best[0])
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]

    def _expect(self, scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """Chance of label 1 of each block, and expected counts of neighbouring labels (forward-backward)."""
        m = [[math.exp(x) for x in row] for row in self.move]
        e = [math.exp(max(-30.0, min(30.0, s))) for s in scores]
        alpha = [[1 / (1 + e[0]), e[0] / (1 + e[0])]]
        for x in e[1:]:
            a = alpha[-1]
            f0, f1 = a[0] * m[0][0] + a[1] * m[1][0], (a[0] * m[0][1] + a[1] * m[1][1]) * x
            alpha.append([f0 / (f0 + f1), f1 / (f0 + f1)])
        beta, pairs, chance = [1.0, 1.0], [[0.0, 0.0], [0.0, 0.0]], [alpha[-1][1]]
        for t in range(len(e) - 2, -1, -1):
            nxt = (beta[0], beta[1] * e[t + 1])
            joint = [[alpha[t][a] * m[a][b] * nxt[b] for b in (0, 1)] for a in (0, 1)]
            z = sum(map(sum, joint))
            for a in (0, 1):
                for b in (0, 1):
                    pairs[a][b] += joint[a][b] / z
            chance.append(sum(joint[1]) / z)
            f = [m[a][0] * nxt[0] + m[a][1] * nxt[1] for a in (0, 1)]
            beta = [f[0] / (f[0] + f[1]), f[1] / (f[0] + f[1])]
        return chance[::-1], pairs

    def fit(self, pages: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 6, step: float = 0.3) -> Field:
        """Stochastic ascent of the likelihood with adaptive steps and a small pull to zero."""
        speed: dict[str, float] = {}
        move_speed = [[1e-2, 1e-2], [1e-2, 1e-2]]
        rng = random.Random(3)
        for _ in range(rounds):
            rng.shuffle(pages)
            for blocks, labels in pages:
                if not blocks:
                    continue
                chance, pairs = self._expect(self.emit(blocks))
                grad: dict[str, float] = {}
                for b, y, p in zip(blocks, labels, chance, strict=True):
                    if abs(y - p) > 1e-4:
                        for f in b:
                            grad[f] = grad.get(f, 0.0) + y - p
                for f, g in grad.items():
                    g -= 1e-3 * self.weights.get(f, 0.0)
                    speed[f] = speed.get(f, 1e-2) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + step * g / math.sqrt(speed[f])
                for a, b in zip(labels, labels[1:], strict=False):
                    pairs[a][b] -= 1
                for a in (0, 1):
                    for b in (0, 1):
                        g = -pairs[a][b]
                        move_speed[a][b] += g * g
                        self.move[a][b] += step * g / math.sqrt(move_speed[a][b])
        return self


#: Names of containers of each kind in the pages that the field is trained on.
MAIN_NAMES = ["content", "post", "post body", "entry content", "article body", "main", "story", "text", "page content", "main content", "article", "body copy"]
REST = {
    "nav": ["nav", "menu", "main menu", "navbar", "breadcrumb", "breadcrumbs", "top nav", "navigation", "pagination", "toc"],
    "header": ["header", "site header", "masthead", "topbar", "banner", "branding"],
    "footer": ["footer", "site footer", "copyright", "colophon", "bottom", "legal"],
    "aside": ["sidebar", "side", "related", "widget", "recommended", "more", "trending", "tags", "share", "social"],
    "notice": ["cookie", "cookie notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "banner", "newsletter", "message", "warning", "paywall"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adbox", "banner ad"],
    "form": ["form", "search", "login", "subscribe", "signup", "newsletter", "contact form"],
    "comments": ["comment", "comments", "comment list", "reply", "discussion", "disqus", "reader comments", "responses", "feedback"],
}


def labelled_page(rng: random.Random) -> tuple[list[tuple[str, ...]], list[int]]:
    """One made-up page: blocks' features and labels. Main text is marked in the page by a private character."""
    mark = "\ue000"
    syllables = ["la", "ne", "tor", "mi", "sche", "ung", "que", "ion", "the", "and", "or", "es", "ra", "do", "ü", "é", "ñ"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda: " ".join(words(2, 16).capitalize() + rng.choice([".", ".", ".", ", ", "!", "?"]) for _ in range(rng.randint(1, 9)))
    link = lambda t: f'<a href="/{word()}">{t}</a>'

    def named(kind: str) -> str:
        name = rng.choice(REST[kind])
        return rng.choice([f'class="{name}"', f'id="{name.replace(" ", "-")}"', f'class="{name.replace(" ", "-")} {word()}"', f'class="{name.replace(" ", "_")}"'])

    def any_text() -> str:
        return rng.choice([prose, prose, lambda: words(1, 8), lambda: link(words(1, 5)), lambda: words(2, 6) + " " + link(words(1, 3))])()

    def rest(kind: str) -> str:
        plain = rng.random() < 0.6
        if kind == "nav":
            items = "".join(rng.choice([f"<li>{link(words(1, 3))}</li>", f"<li>{link(words(1, 2))}"]) for _ in range(rng.randint(2, 8)))
            inner = rng.choice([f"<ul>{items}</ul>", f"<ul>{items}</ul>", " | ".join(link(word()) for _ in range(4))])
            return f"<nav>{inner}</nav>" if plain else f"<div {named(kind)}>{inner}</div>"
        if kind == "header":
            inner = rng.choice([f"<h1>{words(1, 5)}</h1><p>{any_text()}</p>", f"<div>{link(words(1, 3))}</div>", f"<p>{prose()}</p>", any_text()])
            return f"<header>{inner}</header>" if plain else f"<div {named(kind)}>{inner}</div>"
        if kind == "footer":
            inner = rng.choice([f"&copy; {words(1, 4)}", f"<p>&copy; {words(1, 3)} &middot; {prose()}</p>", any_text(), f"<p>{prose()}</p><ul><li>{link(word())}</li></ul>"])
            return f"<footer>{inner}</footer>" if plain else f"<div {named(kind)}>{inner}</div>"
        if kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=q><button>{words(1, 2)}</button>" + rng.choice(["", f"<p>{prose()}</p>"])
            return f"<form {named(kind) if not plain else ''}>{inner}</form>"
        if kind == "comments":
            inner = "".join(rng.choice([f"<div class='comment'><b>{word()}</b><p>{prose()}</p></div>", f"<li>{words(1, 2)}: {prose()}</li>", f"<article class='comment'><p>{prose()}</p></article>", f"<p>{prose()}</p>"]) for _ in range(rng.randint(1, 5)))
            return f"<{(t := rng.choice(['section', 'div', 'ol', 'div', 'ul']))} {named(kind)}>{rng.choice(['', '<h2>' + words(1, 2) + '</h2>'])}{inner}</{t}>"
        inner = "".join(rng.choice([f"<p>{any_text()}</p>", any_text(), f"<h3>{words(1, 4)}</h3><ul><li>{link(words(1, 6))}</li><li>{link(words(1, 6))}</li></ul>"]) for _ in range(rng.randint(1, 2)))
        tag = "aside" if kind == "aside" and plain else rng.choice(["div", "div", "section", "aside"])
        return f"<{tag} {'' if tag == 'aside' and plain else named(kind)}>{inner}</{tag}>"

    def main() -> str:
        out = []
        if rng.random() < 0.8:
            out.append(f"<h1>{mark}{words(1, 9)}</h1>")
        for _ in range(rng.randint(1, 9)):
            out.append(rng.choices([
                lambda: f"<p>{mark}{prose()}</p>", lambda: f"<p>{mark}{prose()}", lambda: f"<p><b>{mark}{prose()}<br>", lambda: f"<p>{mark}{words(1, 6)}</p>",
                lambda: f"<h2>{mark}{words(1, 7)}</h2>", lambda: "<ul>" + "".join(f"<li>{mark}{words(1, 15)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>",
                lambda: f"<blockquote>{rng.choice(['', '<p>'])}{mark}{prose()}</blockquote>", lambda: f"<pre>{mark}{words(3, 20)}</pre>", lambda: f"<p>{mark}{prose()} {link(words(1, 4))} {prose()}</p>",
                lambda: f"<table><tr><td>{mark}{words(1, 4)}</td><td>{mark}{words(1, 4)}</td></tr></table>", lambda: f"<div>{mark}{prose()}</div>", lambda: f"<figure><figcaption>{mark}{words(3, 12)}</figcaption></figure>",
                lambda: rest(rng.choice(["ad", "notice", "aside", "form", "nav"])),
            ], weights=[30, 10, 6, 8, 6, 4, 3, 2, 6, 1, 5, 1, 7])[0]())
        inner = "".join(out)
        name = rng.choice(MAIN_NAMES)
        named_ = rng.choice([f'class="{name}"', f'id="{name.replace(" ", "-")}"', f'class="{name.replace(" ", "-")}"'])
        return rng.choices([f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article {named_}>{inner}</article></main>", f"<div {named_}>{inner}</div>", f"<section {named_}>{inner}</section>", inner], weights=[8, 4, 3, 6, 2, 1])[0]

    kinds = ["nav", "header", "ad", "notice", "aside", "form"]
    before = [rest(rng.choice(kinds)) for _ in range(rng.randint(0, 4))]
    after = [rest(rng.choice(["footer", "aside", "comments", "ad", "notice", "nav", "form", "footer"])) for _ in range(rng.randint(0, 4))]
    page = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>x</script></head><body>{''.join(before)}{main()}{''.join(after)}</body></html>"
    if rng.random() < 0.1:
        page = page[: rng.randint(len(page) // 2, len(page))]
    found = blocks_of(page)
    marked = [mark in b.text for b in found]
    return [b.features for b in found], [int(m) for m in marked]


#: Labelled pages that the field is trained on.
PAGES = 700


def trained(pages: int = PAGES) -> Field:
    """The field, fitted to labelled pages; the same every time."""
    rng = random.Random(20)
    return Field().fit([labelled_page(rng) for _ in range(pages)])


def main_text(page: str | None, field: Field) -> str:
    """The main text of one page: its blocks in order, one to a line."""
    found = blocks_of(page or "")
    return "\n".join(b.text for b, y in zip(found, field.viterbi([b.features for b in found]), strict=True) if y)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """One row a page: id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())
    schema = pa.schema([(id_col, pa.int64()), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x.as_py(), shared.value) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
