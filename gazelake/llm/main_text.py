"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is one row of tokens. Words have a score by where they stand, tags cost
something; the scores are learned from pages that mark their article themselves. One
linear scan finds the contiguous region of the largest sum. Parts of the region
that are boilerplate by name (adverts, forms, notices, comments) are left out.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table

#: Labelled pages that are learned from, at most.
PAGES = 400
#: A quote counts only behind an equals sign; ``<!-->`` and ``<!--->`` are whole comments.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*))>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I)
#: A tag with a quote that is never closed ends at the next bracket.
PLAIN_TAG = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>[^>]*)>(?P<text>$^)?")
TO_END = re.compile(r"<!--|<!\[CDATA\[", re.I)
REST = re.compile(r"(?P<text>.+)(?P<tag>$^)?(?P<close>$^)?", re.S)
#: Elements whose content is no markup and ends with the next closing tag, and elements that are left out whole if they are closed.
RAW = frozenset("script style noscript template iframe textarea title".split())
WHOLE = frozenset("svg select canvas object audio video".split())
#: Raw elements that hold code: one that is not closed ends with its parent; of other elements that are not closed nothing is left out.
CODE = frozenset(("script", "style"))
CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary "
                  "table tbody td tfoot th thead tr ul".split())
CLOSED_BY_BLOCK = frozenset(("p",))
CLOSED_BY_ITSELF = frozenset("li dt dd tr td th option".split())
APART = frozenset("nav aside footer form button dialog menu head fieldset".split())
#: Elements that their names may set apart; a heading, a paragraph or a word inside a sentence is text whatever it is called.
NAMED = frozenset("div section ul ol dl table header details figure center iframe".split())
#: Words of a name that is a phrase of its own.
PHRASE = frozenset("of on for to the and in with from".split())
ARTICLE = frozenset(("article", "main"))
#: Names that parts around an article go by.
NAMES = re.compile(
    r"^(nav\w*|menu\w*|header|masthead|topbar|footer|bottom|sidebar\w*|aside|rail|ad|ads|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|"
    r"cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe\w*|subscription|signup|login|search\w*|"
    r"form|comment\w*|respond|repl(y|ies)|discuss\w*|disqus|shar(e|ing)|social|related|recommend\w*|breadcrumb\w*|pagination|pager|"
    r"widget\w*|toolbar|copyright|legal|skip|hidden|toc|teaser|contentinfo|complementary|navigation|alertdialog)$")
CONTENT_NAMES = re.compile(r"^(article|post|entry|story|content|main)$")
#: Scores of words and tags that no labelled page tells anything of.
WORD, LINKED, OUTSIDE = 1.0, -1.0, -2.0
TAG, INLINE = -0.6, -0.2
APART_WORD, APART_MOST = -0.3, -3.0


def named_apart(tag: str, attributes: str) -> bool:
    """Whether an element is boilerplate by its own names."""
    if tag in ("html", "body") or tag in ARTICLE:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "").lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none", value):
                return True
            continue
        if tag not in NAMED:
            continue
        for one in value.split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", one)) if w]
            if not words or words[0] in ("has", "with", "no", "without") or not PHRASE.isdisjoint(words[1:]):
                continue
            if CONTENT_NAMES.match(words[0]) and words[-1] in ("header", "body", "main", "content"):
                continue
            if NAMES.match(words[0]) or NAMES.match(words[-1]):
                return True
    return False


def split(source: str) -> list[re.Match[str]]:
    """Texts and tags of a page, without raw elements that are closed."""
    out, at, unclosed, last = [], 0, set(), source.rfind(">")
    while at < len(source):
        # behind the last bracket no tag is closed any more; comments and code go to the end anyway
        if at > last:
            to_end = TO_END.search(source, at)
            stop = to_end.start() if to_end else len(source)
            if stop > at:
                out.append(REST.match(source, at, stop))
                at = stop
                continue
        m = TOKEN.match(source, at)
        if m["text"] == "<":
            m = PLAIN_TAG.match(source, at) or m
        at = m.end()
        tag = m["tag"].lower() if m["tag"] else ""
        if tag in RAW and not m["close"]:
            end = None if tag in unclosed else CLOSING[tag].search(source, at)
            if end:
                at = end.end()
                continue
            unclosed.add(tag)
        out.append(m)
    return out


def left_out(parts: list[re.Match[str]]) -> dict[int, int]:
    """Where elements that are left out whole start, and the first place behind them."""
    names = [m["tag"].lower() if m["tag"] else "" for m in parts]
    ends: dict[int, int] = {}
    if not any(n in WHOLE or n in CODE for n in names):
        return ends
    stack: list[int] = []
    opened = Counter()
    for i, (m, tag) in enumerate(zip(parts, names)):
        if not tag or tag in VOID:
            continue
        if not m["close"]:
            if not m["attributes"].endswith("/"):
                stack.append(i)
                opened[tag] += 1
        elif opened[tag]:
            while True:
                k = stack.pop()
                opened[names[k]] -= 1
                if names[k] in CODE:
                    ends[k] = i
                if names[k] == tag:
                    if tag in WHOLE:
                        ends[k] = i + 1
                    break
    ends.update((k, len(parts)) for k in stack if names[k] in CODE)
    return ends


class Page:
    """The tokens of a page: (kind, feature, words, text, apart, block)."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str, int, str, bool, int]] = []
        stack: list[tuple[str, bool]] = []
        blocks: list[str] = []
        opened: Counter[str] = Counter()
        apart = links = inside = block = 0
        self.marked: list[bool] = []

        def pop() -> None:
            nonlocal apart, links, inside
            tag, was_apart = stack.pop()
            opened[tag] -= 1
            if tag in BLOCK:
                blocks.pop()
            apart -= was_apart
            links -= tag == "a"
            inside -= tag in ARTICLE

        parts = split(source)
        ends, behind = left_out(parts), 0
        for i, m in enumerate(parts):
            if i < behind:
                continue
            tag, text = m["tag"], m["text"]
            if text is not None:
                words = len(text.split())
                if not words and not text.isspace():
                    continue
                where = blocks[-1] if blocks else ""
                feature = f"{where} {min(links, 1)} {min(apart, 1)}"
                self.tokens.append(("word", feature, words, text, apart > 0, block))
                self.marked.append(inside > 0)
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW or tag in WHOLE:
                if not m["close"]:
                    behind = ends.get(i, behind)
                continue
            if tag in BLOCK:
                block += 1
            if m["close"]:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    self.tokens.append(("tag", f"/{tag}", 0, "", apart > 0, block))
                    self.marked.append(inside > 0)
                    pop()
                continue
            if tag in BLOCK and tag != "br":
                while stack and stack[-1][0] in CLOSED_BY_BLOCK:
                    pop()
                # an inline element that was never closed ends with its paragraph
                if blocks and blocks[-1] in CLOSED_BY_BLOCK:
                    ended = blocks[-1]
                    while stack[-1][0] != ended:
                        pop()
                    pop()
            if tag in CLOSED_BY_ITSELF and stack and stack[-1][0] == tag:
                pop()
            is_apart = tag in APART or (tag == "header" and not inside) or named_apart(tag, m["attributes"])
            if tag not in VOID and not m["attributes"].endswith("/"):
                stack.append((tag, is_apart))
                opened[tag] += 1
                if tag in BLOCK:
                    blocks.append(tag)
                apart += is_apart
                links += tag == "a"
                inside += tag in ARTICLE
            self.tokens.append(("tag", tag, 0, "", apart > 0, block))
            self.marked.append(inside > 0)


def page_counts(source: str) -> Counter[tuple[str, str, bool]]:
    """Words and tags of a page that marks its article, by place and side; none of other pages."""
    page, counts = Page(source), Counter()
    if any(page.marked):
        for (kind, feature, words, _, apart, _), inside in zip(page.tokens, page.marked):
            if not apart:
                counts[kind, feature, inside] += words if kind == "word" else 1
    return counts


def scores(counts: Counter[tuple[str, str, bool]]) -> dict[str, float]:
    """Scores of word places and tags: logarithms of odds, bounded."""
    out = {}
    for kind, feature in {(kind, feature) for kind, feature, _ in counts}:
        odds = math.log((counts[kind, feature, True] + 1) / (counts[kind, feature, False] + 1))
        # tags never add to a region; words behind tags that say nothing are text
        out[f"{kind} {feature}"] = min(max(odds / 2, -3.0), 0.0) + TAG / 4 if kind == "tag" else min(max(odds, OUTSIDE), WORD)
    return out


def train_pages(pages: list[str]) -> dict[str, float]:
    return scores(sum((page_counts(p) for p in pages), Counter()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            counts = sum((page_counts(h) for h in part.column("html").to_pylist()), Counter())
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([k for k, _, _ in counts], pa.string()), "feature": pa.array([f for _, f, _ in counts], pa.string()),
                "inside": pa.array([i for _, _, i in counts], pa.bool_()), "n": pa.array(list(counts.values()), pa.int64())})


def _score(weights: dict[str, float], token) -> float:
    kind, feature, words, _, apart, _ = token
    learned = weights.get(f"{kind} {feature}")
    if apart:
        # such parts are left out anyway: they part regions, but a long one must not cut an article in two
        return max(APART_WORD * words, APART_MOST) if kind == "word" else INLINE
    if kind == "tag":
        return learned if learned is not None else TAG if feature.lstrip("/") in BLOCK else INLINE
    if learned is None:
        learned = LINKED if " 1 " in feature else WORD
    return learned * words


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The text of the best region, a line for each block; empty if no region has a positive score."""
    page = Page(source or "")
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, token in enumerate(page.tokens):
        if total <= 0:
            total, start = 0.0, i
        total += _score(weights, token)
        if total > best:
            best, best_at = total, (start, i + 1)
    lines: list[str] = []
    block = None
    for kind, _, _, text, apart, number in page.tokens[slice(*best_at)]:
        if kind != "word" or apart:
            continue
        if number != block:
            lines.append("")
            block = number
        lines[-1] += text
    clean = (" ".join(html.unescape(line).split()) for line in lines)
    return "\n".join(line for line in clean if line)


def train(pages: DataFrame, most: int = PAGES) -> dict[str, float]:
    """Learn from at most ``most`` of the pages that mark an article, those of lowest hash, whole.

    Ids are chosen without the pages, and the chosen pages are counted where they are: only sums of
    places and tags come to the driver. Rows that share a chosen id are all counted.
    """
    marked = pages.filter(F.lower("html").rlike(r"<(article|main)[\s>]")).select("page_id", "html")
    order = F.xxhash64("page_id")
    known = marked.select("page_id").filter("page_id is not null")
    n = known.count()
    low = known.filter((order / F.lit(2.0 ** 64) + 0.5) * n <= 2 * most + 100).distinct()
    chosen = low.orderBy(order, "page_id").limit(most)
    # the sample is small by its parameter
    counted = marked.join(F.broadcast(chosen), "page_id").mapInArrow(_counted, "kind string, feature string, inside boolean, n long")
    rows = counted.groupBy("kind", "feature", "inside").agg(F.sum("n").alias("n")).collect()
    return scores(Counter({(r["kind"], r["feature"], r["inside"]): r["n"] for r in rows}))


@functools.lru_cache(maxsize=2)
def _weights(items: tuple[tuple[str, float], ...]) -> dict[str, float]:
    return dict(items)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Main text of each page: page_id, url, text and n_chars.

    Takes page_id, url and html; other columns are not read. A null html is empty, and
    a page without text has an empty one. Rows are kept one for one, null and repeated
    ids too. Without labelled pages the stated scores hold.
    """
    items = tuple(sorted(weights.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _weights(items)
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, known) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
