"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header
    hr html legend li main menu nav ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul""".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg iframe object canvas head select textarea button".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element that begins closes these, if they are open within the same container.
CLOSES = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), {"p"}),
    "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"},
    "tbody": {"p", "td", "th", "tr", "thead", "tbody"}, "option": {"option"}, "body": {"p", "head"},
}
_HOLDS = frozenset("article aside blockquote body div fieldset figure footer form header main nav ol section table ul dl".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TO_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A leaf block: its text, and what the field sees of it."""

    text: str
    features: list[str]


class Tags:
    """Reads a page's tags in order, in time that grows with its length whatever its markup is.

    A tag ends at the first > outside quotes. Once no such > follows, quotes no longer count for the rest of the page; once
    no > follows at all, the rest is text.
    """

    def __init__(self, page: str) -> None:
        self.page, self.quoted, self.ended = page, True, False

    def after(self, at: int) -> tuple[int, int, str, str]:
        """Start and end of the next tag or comment, its name (with / before that of an end tag; empty for a comment) and its attributes."""
        page, n = self.page, len(self.page)
        while not self.ended:
            start = page.find("<", at)
            if start < 0 or start + 1 == n:
                break
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, n if end < 0 else end + 3, "", ""
            name = _NAME.match(page, start + 1)
            if not name and page[start + 1] not in "!?":
                at = start + 1
                continue
            end = -1
            if name and self.quoted:
                found = _TO_END.match(page, name.end())
                self.quoted = found is not None
                end = found.end() - 1 if found else -1
            if end < 0:
                end = page.find(">", name.end() if name else start)
            if end < 0:
                self.ended = True
                break
            return start, end + 1, name[0].lower() if name else "", page[name.end() : end] if name else ""
        return n, n, "", ""


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page with text of their own, in page order. Broken and unclosed markup closes where its container does."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    out: list[Block] = []
    linked = silent = link_chars = 0
    at, tags, n = 0, Tags(page), len(page)

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, [*stack[-1][1], f"leaf:{stack[-1][0]}", *text_features(text, link_chars)]))
            parts.clear()
        link_chars = 0

    def push(tag: str, features: tuple[str, ...]) -> None:
        nonlocal silent
        stack.append((tag, features))
        opened[tag] += 1
        silent += tag in SILENT

    def pop(depth: int) -> None:
        nonlocal silent
        while len(stack) > depth:
            tag = stack.pop()[0]
            opened[tag] -= 1
            silent -= tag in SILENT

    while at < n:
        begin, end, name, attributes = tags.after(at)
        if begin > at and not silent:
            # references are decoded run by run, so that none comes together across a tag
            run = html.unescape(page[at:begin])
            parts.append(run)
            if linked:
                link_chars += len(run)
        at = end
        if not name:
            continue
        tag = name.lstrip("/")
        if name == tag:
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
                if tag in BLOCKS:
                    flush()
                continue
            if tag == "br":
                parts.append("\n")
            elif tag == "a":
                linked = 1
            elif tag in BLOCKS:
                flush()
                closing = CLOSES.get(tag, ())
                i = len(stack) - 1
                while any(opened[c] for c in closing) and stack[i][0] not in _HOLDS and i:
                    if stack[i][0] in closing:
                        pop(i)
                    i -= 1
                if tag not in VOID and not attributes.endswith("/"):
                    push(tag, element_features(stack[-1][1], tag, attributes))
            elif tag in SILENT and not attributes.endswith("/"):
                push(tag, stack[-1][1])
        elif tag == "a":
            linked = 0
        elif tag in BLOCKS or tag in SILENT:
            flush()
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
    flush()
    if out:
        out[0].features.append("first")
        out[-1].features.append("last")
    return out


def element_features(above: tuple[str, ...], tag: str, attributes: str) -> tuple[str, ...]:
    """The features of the ancestors and of this one: its tag, and the words of its class, id and role."""
    more = [f"in:{tag}"]
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            more += [f"named:{w.lower()}" for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", m[2])]
    return above + tuple(x for x in dict.fromkeys(more) if x not in above)


def text_features(text: str, link_chars: int) -> list[str]:
    words = text.count(" ") + 1
    out = [f"words:{min(7, words.bit_length())}", f"linked:{min(3, 4 * link_chars // max(1, len(text)))}"]
    if text[-1] in ".!?…\"”’":
        out.append("sentence")
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if text.count("|") + text.count("»") + text.count("·") > 1:
        out.append("separators")
    return out


class Field:
    """Two labels, 1 for main text. The score of a labelling is the sum of its blocks' feature weights (for label 1) and of its transitions."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = defaultdict(float)
        self.transition = [[0.0, 0.0], [0.0, 0.0]]

    def emissions(self, blocks: list[Block]) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in b.features]) for b in blocks]

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The labelling of the highest score; label 0 wins ties."""
        (a00, a01), (a10, a11) = self.transition
        best0, best1, back = 0.0, 0.0, []
        for i, e in enumerate(self.emissions(blocks)):
            if i:
                from0, from1 = int(best1 + a10 > best0 + a00), int(best1 + a11 > best0 + a01)
                best0, best1 = max(best0 + a00, best1 + a10), max(best0 + a01, best1 + a11) + e
                back.append((from0, from1))
            else:
                best1 = e
        if not blocks:
            return []
        out = [int(best1 > best0)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def marginals(self, blocks: list[Block]) -> tuple[list[float], list[list[float]]]:
        """The probability of label 1 for each block, and the expected number of each transition, by forward and backward sums."""
        e, a, n = self.emissions(blocks), self.transition, len(blocks)
        both = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        ahead = [(0.0, e[0])]
        for i in range(1, n):
            x, y = ahead[-1]
            ahead.append((both(x + a[0][0], y + a[1][0]), both(x + a[0][1], y + a[1][1]) + e[i]))
        behind = [(0.0, 0.0)]
        for i in range(n - 1, 0, -1):
            x, y = behind[-1]
            behind.append((both(a[0][0] + x, a[0][1] + e[i] + y), both(a[1][0] + x, a[1][1] + e[i] + y)))
        behind.reverse()
        z = both(*ahead[-1])
        count = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(1, n):
            for p in (0, 1):
                for q in (0, 1):
                    count[p][q] += math.exp(ahead[i - 1][p] + a[p][q] + q * e[i] + behind[i][q] - z)
        return [math.exp(ahead[i][1] + behind[i][1] - z) for i in range(n)], count


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 14, rate: float = 0.25, decay: float = 2e-4) -> Field:
    """Maximises the likelihood of the labels by AdaGrad, a page at a time, with a quadratic penalty."""
    field, square = Field(), defaultdict(lambda: 1e-2)
    order = random.Random(4)
    pages = [p for p in pages if p[0]]
    for _ in range(epochs):
        for i in order.sample(range(len(pages)), len(pages)):
            blocks, labels = pages[i]
            p, count = field.marginals(blocks)
            grad: dict[str, float] = defaultdict(float)
            for b, y, q in zip(blocks, labels, p, strict=True):
                for f in b.features:
                    grad[f] += y - q
            for f, g in grad.items():
                g -= decay * field.weight[f]
                square[f] += g * g
                field.weight[f] += rate * g / math.sqrt(square[f])
            for x in (0, 1):
                for y in (0, 1):
                    g = sum(u == x and v == y for u, v in zip(labels, labels[1:], strict=False)) - count[x][y]
                    square[x, y] += g * g
                    field.transition[x][y] += rate * g / math.sqrt(square[x, y])
    field.weight = dict(field.weight)
    return field


# ---- labelled pages ----------------------------------------------------------------------------------------------------

#: Names that pages give to their parts.
NAMES = {
    "main": "content main article post entry story body text page single prose markdown document detail maincontent articlebody".split(),
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs topnav links toc pagination pager".split(),
    "head": "header masthead banner topbar logo branding site tagline hero".split(),
    "foot": "footer foot bottom colophon copyright legal imprint credits".split(),
    "side": "sidebar side aside widget related recommended popular trending secondary rail teaser more".split(),
    "notice": "cookie cookies notice consent gdpr alert warning newsletter subscribe popup modal overlay disclaimer paywall message".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsbygoogle banner dfp commercial".split(),
    "form": "search login signup contact form subscribe newsletter feedback".split(),
    "comments": "comments comment discussion replies reply respond disqus reviews commentlist thread responses".split(),
    "share": "share social sharing tags meta byline author buttons follow".split(),
}


def labelled_page(seed: int) -> str:
    """An invented page; what belongs to the main text carries the mark \x01 before it."""
    r = random.Random(seed)
    syllables = "th an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(r.choices(syllables, k=r.choice((1, 1, 2, 2, 3))))
    words = lambda n: " ".join(word() for _ in range(n))
    prose = lambda: " ".join(words(r.randint(1, 14)).capitalize() + r.choice(".....!?") for _ in range(r.choice((1, 1, 1, 2, 3, 5, 8))))
    text = lambda: r.choice((prose, prose, prose, lambda: words(r.randint(1, 6)).capitalize()))()

    def name(kind: str) -> str:
        some = r.sample(NAMES[kind], r.choice((1, 1, 2)))
        value = r.choice(("-", "_", " ")).join([*some, *([word()] if r.random() < 0.3 else [])])
        return f' {r.choice(("class", "class", "id"))}="{value}"' if r.random() < 0.9 else f' class={some[0]}'

    def part(kind: str, inner: str, tag: str = "") -> str:
        """With the element that stands for the kind, or a division with a name of it."""
        if tag and r.random() < 0.5:
            return f"<{tag}{name(kind) if r.random() < 0.3 else ''}>{inner}</{tag}>"
        tag = r.choice(("div", "div", "section", "ul" if "<li>" in inner else "div"))
        return f"<{tag}{name(kind)}>{inner}</{tag}>"

    def items(n: int, linked: float) -> str:
        return "".join(f'<li><a href="/{word()}">{words(r.randint(1, 3))}</a></li>' if r.random() < linked else f"<li>{text()}</li>" for _ in range(n))

    def paragraphs(n: int) -> str:
        return "".join(r.choice((f"<p>{text()}</p>", f"<p>{text()}</p>", f"<div>{text()}</div>", text())) for _ in range(n))

    def boilerplate(kind: str) -> str:
        if kind == "nav":
            return part("nav", r.choice((f"<ul>{items(r.randint(2, 8), 1)}</ul>", " | ".join(f'<a href="/">{words(1)}</a>' for _ in range(4)))), "nav")
        if kind == "head":
            return part("head", r.choice((f"<h1>{words(2)}</h1><p>{text()}</p>", f'<a href="/">{words(2)}</a>', f"<p>{text()}</p>", f"<div>{text()}</div>")), "header")
        if kind == "foot":
            return part("foot", r.choice((f"&copy; {words(2)} &middot; {text()}", f"<p>{text()}</p>", f"<p>&copy; 2020 {words(2)}</p><ul>{items(3, 1)}</ul>", text())), "footer")
        if kind == "side":
            return part("side", r.choice((f"<h3>{words(2)}</h3><ul>{items(4, 0.8)}</ul>", f"<h2>{words(2)}</h2>{paragraphs(2)}", paragraphs(1))), "aside")
        if kind == "form":
            return part("form", f'<label>{words(2)}</label><input name="q"><p>{text()}</p><button>{words(1)}</button>', "form")
        if kind == "comments":
            one = lambda: f'<{x}{name("comments")}><p>{text()}</p></{x}>' if (x := r.choice(("div", "li", "article"))) else ""
            return part("comments", f"<h3>{words(2)}</h3>" * (r.random() < 0.7) + "".join(r.choice((one(), f"<p>{text()}</p>")) for _ in range(r.randint(1, 4))))
        return part(kind, r.choice((text(), f"<p>{text()}</p>", f'<p>{text()} <a href="/x">{words(1)}</a></p>')))

    def main_block() -> str:
        k = r.random()
        if k < 0.7:
            return f"<p>\x01{text()}" + "</p>" * (r.random() < 0.9)
        if k < 0.76:
            return f"<h{(h := r.choice((2, 3, 4)))}>\x01{words(r.randint(1, 6)).capitalize()}</h{h}>"
        if k < 0.82:
            return f"<ul>{''.join(f'<li>\x01{text()}</li>' for _ in range(r.randint(1, 4)))}</ul>"
        if k < 0.86:
            return f"<blockquote>\x01{text()}</blockquote>"
        if k < 0.9:
            return f"<table><tr><td>\x01{words(2)}</td><td>\x01{words(1)}</td></tr></table>"
        if k < 0.93:
            return f"<pre>\x01{text()}</pre>"
        if k < 0.96:
            return f"<figure><figcaption>\x01{text()}</figcaption></figure>"
        return f'<p>\x01{text()} <a href="/{word()}">{words(2)}</a> {text()}</p>'

    title = f"<h1>\x01{words(r.randint(1, 9)).capitalize()}</h1>" * (r.random() < 0.85)
    body = title + "".join(main_block() + (boilerplate(r.choice(("ad", "share", "notice", "side", "form"))) if r.random() < 0.05 else "") for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14))))
    wrap = r.random()
    if wrap < 0.5:
        body = f"<article{name('main') if r.random() < 0.3 else ''}>{body}</article>"
    elif wrap < 0.7:
        body = f"<main>{body}</main>"
    else:
        body = f"<div{name('main')}>{body}</div>"
    if r.random() < 0.25:
        body = f"<{(x := r.choice(('main', 'div', 'section')))}{name('main')}>{body}</{x}>"
    # one page in five is nothing but its text
    bare = r.random() < 0.2
    ahead = [boilerplate(k) for k in ("notice", "head", "nav", "form", "ad") if not bare and r.random() < 0.5]
    after = [boilerplate(k) for k in ("share", "ad", "comments", "side", "form", "foot") if not bare and r.random() < 0.5]
    if r.random() < 0.3 and after:
        body = f"<div{name('main') if r.random() < 0.5 else ' class=wrapper'}>{body}{''.join(after[:-1])}</div>"
        after = after[-1:]
    r.shuffle(ahead)
    body = f"{''.join(ahead)}{body}{''.join(after)}"
    return body if bare and r.random() < 0.5 else f"<html><head><title>{words(3)}</title></head><body>{body}</body></html>"


def labelled_blocks(seed: int) -> tuple[list[Block], list[int]]:
    blocks = leaf_blocks(labelled_page(seed))
    labels = [int("\x01" in b.text) for b in blocks]
    for b in blocks:
        b.text = b.text.replace("\x01", "")
    return blocks, labels


@lru_cache(maxsize=1)
def trained_field(pages: int = 700) -> Field:
    """The field fitted to invented labelled pages: layouts with the elements, names and orders that pages have."""
    return fit([labelled_blocks(i) for i in range(pages)])


def extract(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, field.viterbi(blocks), strict=True) if y)


def text_column(page: Column, field: Field | None = None) -> Column:
    """The main text of each page; empty for null and empty pages, and where no block is main text."""
    field = field or trained_field()

    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([extract(p, field) for p in part], dtype=object)

    return extracted(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars. An empty table gives an empty result; repeated rows repeat.

    A null or empty page, and one without main text, has an empty text. Null ids and addresses stay null. Time grows with a
    page's length whatever its markup is: unclosed tags, quotes and comments end with the page. Of labellings that score
    alike, the one with less text is taken. Other columns are not read.
    """
    out = pages.select("page_id", "url", text_column(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
