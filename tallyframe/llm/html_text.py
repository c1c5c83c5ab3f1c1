"""Main text of web pages from a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import named, text_batches, tidy
from tallyframe.llm.crf import Crf, best_labels, fit

TRAIN_PAGES = 400
SEED = 7
REST, MAIN = 0, 1

_SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "textarea", "select", "math", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
_OWN_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "blockquote", "figcaption", "dt", "dd", "div", "section", "article", "main", "button", "body", "")
_ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "table", "ul", "ol", "figure", "blockquote", "button", "dialog", "details")
#: What words in class, id and role of an element hint at.
_HINTS = tuple((name, re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)) for name, words in (
    ("advert", r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|advertisement"),
    ("comment", r"comments?|respond|replies|reply|disqus|discussion|commentlist"),
    ("notice", r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|paywall|subscribe|newsletter|signup|overlay|disclaimer|toast"),
    ("menu", r"nav\w*|menus?|breadcrumbs?|toc|pagination|pager|tabs?|skip|toolbar|navigation"),
    ("side", r"sidebar|side|aside|widgets?|rail|related|recommended|trending|share|social|sharing|tags?|meta|byline|author\w*|complementary"),
    ("ends", r"header|head|masthead|footer|foot|bottom|top|copyright|legal|contentinfo|logo|brand"),
    ("content", r"content|article\w*|post\w*|entry\w*|story\w*|body|text|main\w*|prose"),
    ("form", r"search\w*|login|form|contact|poll|survey"),
))
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile("[>\"']")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)>?")


@dataclass
class Block:
    text: str
    tag: str
    above: frozenset[str]  # names of elements above, and "." hints
    linked: int  # characters inside links


class _TagEnds:
    """Where tags of a page end: at the first > outside quotes.

    Quotes from which no such end follows are kept, and so is the next special character, so a page of
    unclosed tags or quotes is not read again for each of them. Asked for rising places.
    """

    def __init__(self, page: str):
        self.page = page
        self.dead: set[int] = set()
        self.next = -1

    def after(self, at: int) -> int:
        """The place behind the tag whose name ends at `at`; -1 if it has no end."""
        if self.next < at:
            found = _SPECIAL.search(self.page, at)
            self.next = found.start() if found else len(self.page)
        place, passed = self.next, []
        while place < len(self.page) and place not in self.dead:
            if self.page[place] == ">":
                return place + 1
            passed.append(place)
            closed = self.page.find(self.page[place], place + 1)
            found = _SPECIAL.search(self.page, closed + 1) if closed >= 0 else None
            place = found.start() if found else len(self.page)
        self.dead.update(passed)
        return -1


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order: runs of text and inline elements between block elements.

    Character references are decoded and white space becomes one space; scripts, styles, comments and
    the like are left out, to the end of the page where they are not closed. Linear in the page.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_: Counter[str] = Counter()
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0
    ends = _TagEnds(page)
    lower = page.lower() if len(page.lower()) == len(page) else None

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            own = next((t for t, _ in reversed(stack[-8:])), "")
            blocks.append(Block(text, own, frozenset(k for k, n in open_.items() if n), linked))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text)

    def pop() -> str:
        tag, hints = stack.pop()
        open_.subtract((tag, *hints))
        return tag

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
            continue
        found = _NAME.match(page, start)
        if not found:
            add("<")
            at = start + 1
            continue
        closing, tag, after = found[1], found[2].lower(), ends.after(found.end())
        if after < 0:
            loose = _LOOSE_TAG.match(page, start)
            rest, at = loose[3], loose.end()
        else:
            rest, at = page[found.end() : after - 1], after
        if tag in _SKIPPED and not closing and not rest.endswith("/"):
            if tag == "head":  # its children are skipped one by one; it ends where the body begins
                flush()
                continue
            ending = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if lower is None else None
            end = lower.find(f"</{tag}", at) if lower is not None else (ending.start() if ending else -1)
            at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
        elif tag in _VOID:
            if tag == "hr":
                flush()
        elif closing:
            if open_[tag]:
                flush()
                while pop() != tag:
                    pass
            elif tag == "p":
                flush()
        else:
            flush()
            in_link = 0
            if tag in _ENDS_P and open_["p"]:
                while pop() != "p":
                    pass
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                pop()
            hints = {f".{name}" for a in _ATTRIBUTE.findall(rest) for name, words in _HINTS if words.search("".join(a))} if "=" in rest else ()
            stack.append((tag, tuple(hints)))
            open_.update((tag, *hints))
    flush()
    return blocks


_WORD_ENDS = (0, 2, 5, 10, 20, 40)
_LINK_ENDS = (0.0, 0.2, 0.5, 0.9)
_FLAGS = (*_ABOVE, *(f".{name}" for name, _ in _HINTS))
_SLOTS = (len(_OWN_TAGS), *[2] * len(_FLAGS), len(_WORD_ENDS) + 1, len(_LINK_ENDS) + 1, 2, 2, 2, 4, 1)
_STARTS = tuple(int(s) for s in np.cumsum(_SLOTS) - np.array(_SLOTS))
N_FEATURES = int(sum(_SLOTS))
_OWN = {t: i for i, t in enumerate(_OWN_TAGS)}


def block_features(blocks: list[Block]) -> np.ndarray:
    """The numbers of the features of each block of a page: own and ancestor tags, hints, and text measures."""
    out = np.empty((len(blocks), len(_SLOTS)), np.int64)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        out[i] = (
            _OWN.get(b.tag, _OWN[""]), *(f in b.above for f in _FLAGS), sum(words > e for e in _WORD_ENDS),
            sum(b.linked / len(b.text) > e for e in _LINK_ENDS), b.text[-1] in ".!?:…”\"", "©" in b.text,
            b.text[:1].isupper(), min(3, 4 * i // len(blocks)), 0,
        )
    return out + np.array(_STARTS)


def labelled_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> Iterator[tuple[str, dict[str, int]]]:
    """Pages made for training, each with the label of every block's text.

    Layouts vary: the article in <article>, <main> or a <div> of a telling class; menus, headers,
    footers, sidebars, notices, adverts, forms and reader comments around and inside it, as elements
    of their own or as <div>s; closing tags left out; blocks of any length on either side.
    """
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]

    def words(low: int, high: int, stop: str = ".") -> str:
        text = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))
        return text.capitalize() + stop

    for _ in range(count):
        labels: dict[str, int] = {}

        def leaf(tag: str, text: str, label: int, inner: str = "{}", close: bool = True) -> str:
            labels[text] = label
            return f"<{tag}>{inner.format(html.escape(text))}" + (f"</{tag}>" if close else "")

        def links(n: int) -> str:
            return "<ul>" + "".join(leaf("li", words(1, 3, rng.choice(("", "", ".", ","))), REST, '<a href="/x">{}</a>') for _ in range(n)) + "</ul>"

        def rest(kind: str) -> str:
            text = lambda low=1, high=25: words(low, high, rng.choice((".", ".", "")))
            div = lambda names, body: f'<div {rng.choice(("class", "id"))}="{rng.choice(names)}">{body}</div>'
            if kind == "nav":
                return rng.choice((f"<nav>{links(rng.randint(2, 8))}</nav>", div(("menu", "navbar", "main-nav", "breadcrumb"), links(rng.randint(2, 8)))))
            if kind == "header":
                return f"<header>{leaf(rng.choice(('h1', 'p', 'div')), text(1, 8), REST)}{links(2) if rng.random() < 0.5 else ''}</header>"
            if kind == "footer":
                body = leaf(rng.choice(("p", "div")), f"© {text(1, 20)}" if rng.random() < 0.6 else text(1, 20), REST)
                return rng.choice((f"<footer>{body}</footer>", div(("footer", "page-footer", "copyright"), body)))
            if kind == "aside":
                body = "".join(leaf(rng.choice(("p", "h3", "li")), text(), REST) for _ in range(rng.randint(1, 4)))
                return rng.choice((f"<aside>{body}</aside>", div(("sidebar", "related", "widget", "share"), body)))
            if kind == "form":
                return f"<form>{leaf('p', text(1, 10), REST)}<label>x</label><input></form>".replace("<label>x</label>", "") if rng.random() < 0.7 else div(("search-box", "login"), leaf("p", text(1, 8), REST))
            if kind == "comments":
                body = leaf("h3", text(1, 3), REST) + "".join(leaf(rng.choice(("p", "li")), text(3, 50), REST) for _ in range(rng.randint(1, 5)))
                return rng.choice((div(("comments", "comment-list", "replies"), body), f'<section class="comments">{body}</section>'))
            names = {"advert": ("ad", "ads", "advert", "sponsored", "promo", "ad-banner"), "notice": ("cookie-notice", "notice", "consent", "newsletter", "alert", "popup")}[kind]
            return div(names, leaf("p", text(3, 30), REST) if rng.random() < 0.5 else _bare(text(3, 30)))

        def _bare(text: str) -> str:
            labels[text] = REST
            return html.escape(text)

        kinds = ("nav", "header", "footer", "aside", "form", "comments", "advert", "notice")
        body = [leaf("h1", words(3, 14, rng.choice(("", "."))), MAIN)]
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.72:
                body.append(leaf("p", words(1, 90), MAIN, rng.choice(("{}", "{}", "<b>{}", "{}<br>", '<a href="/y">{}</a>' if rng.random() < 0.2 else "{}")), rng.random() < 0.8))
            elif r < 0.8:
                body.append(leaf(rng.choice(("h2", "h3")), words(1, 8, ""), MAIN))
            elif r < 0.88:
                body.append("<ul>" + "".join(leaf("li", words(2, 25, rng.choice((".", ""))), MAIN) for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.93:
                body.append("<blockquote>" + leaf("p", words(5, 40), MAIN) + "</blockquote>")
            elif r < 0.96:
                body.append(leaf("pre", words(3, 20), MAIN))
            else:
                body.append("<table><tr>" + "".join(leaf("td", words(1, 5, ""), MAIN) for _ in range(3)) + "</tr></table>")
            if rng.random() < 0.12:
                body.append(rest(rng.choice(("advert", "notice", "aside", "form", "nav"))))
        inside = rest(rng.choice(("comments", "footer"))) if rng.random() < 0.2 else ""
        opening, closing = rng.choice((("<article>", "</article>"),) * 4 + (
            ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ('<main><article class="post">', "</article></main>"), ("<article><section>", "</section></article>")))
        if rng.random() < 0.12 and closing == "</article>":
            closing = ""
        before = "".join(rest(k) for k in rng.sample(kinds, rng.randint(1, 4)) if k not in ("comments",))
        after = "".join(rest(k) for k in rng.sample(kinds, rng.randint(1, 4)) if k != "header" and (closing or k == "footer"))
        yield f"<!DOCTYPE html><html><head><title>{words(3, 9)}</title><script>var t='</p>';</script></head><body>{before}{opening}{''.join(body)}{inside}{closing}{after}</body></html>", labels


def train(count: int = TRAIN_PAGES, seed: int = SEED) -> Crf:
    """A field fitted on `labelled_pages`."""
    features, labels, lengths = [], [], []
    for page, truth in labelled_pages(count, seed):
        blocks = [b for b in leaf_blocks(page) if b.text in truth]
        features.append(block_features(blocks))
        labels += [truth[b.text] for b in blocks]
        lengths.append(len(blocks))
    return fit(np.concatenate(features), np.array(labels), np.array(lengths), N_FEATURES, 2, rounds=120)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", model: Crf | None = None) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every row.

    The blocks that the field labels as main text, by Viterbi over the whole page, joined by one line
    break. Null and empty pages give an empty text; broken markup is read as far as it goes; repeated
    rows give a row each; no rows give no rows; other columns are ignored. No shuffle.
    """
    text_batches(pages.sparkSession)
    field = model or train()
    chosen = pages.select(named(page_id).alias("page_id"), named(url).alias("url"), named(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [leaf_blocks(p or "") for p in batch.column(2).to_pylist()]
            lengths = np.array([len(b) for b in blocks], np.int64)
            labels = best_labels(field, np.concatenate([block_features(b) for b in blocks]), lengths) if lengths.sum() else np.empty(0, np.int64)
            texts, at = [], 0
            for own in blocks:
                texts.append("\n".join(b.text for b, label in zip(own, labels[at : at + len(own)]) if label == MAIN))
                at += len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    shape = f"page_id {chosen.schema['page_id'].dataType.simpleString()}, url {chosen.schema['url'].dataType.simpleString()}, text string"
    return chosen.mapInArrow(tidy(run), shape).withColumn("n_chars", F.length("text").cast("long"))
