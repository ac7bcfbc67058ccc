"""Main text of web pages from flat blocks.

A page becomes a flat list of text blocks, cut at block-level tags.  Each block
is described by its words and link density, those of its neighbours, and what
it stands in; a decision tree trained on a small labelled table keeps or drops
it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._text import free_name

#: HTML's elements by their part in cutting blocks; all others stand within a block.
RAW = frozenset("script style textarea title iframe noframes xmp".split())
SKIPPED = frozenset("template noscript svg head select datalist button object canvas audio video map".split())
HEAD = frozenset("base link meta script style title noscript template head html".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav aside footer menu dialog fieldset search".split())
#: What an opening tag ends without a closing one, and where that stops.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tr": ("tr", "tbody thead tfoot table"),
    "tbody": ("tbody thead tfoot", "table"),
    "thead": ("tbody thead tfoot", "table"),
    "tfoot": ("tbody thead tfoot", "table"),
}
#: Words in class, id or role that tell of what isn't the article, and of what is; and those that only say how a page is laid out.
_OUTSIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|aside|menu|nav\w*|breadcrumbs?|footer|footnote-bar|site-?header|page-?header|masthead|top-?bar|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|search\w*|comments?|comment-?list|replies|disqus|respond|related|recommended|share|sharing|social|widget|toolbar|pagination|pager|legal|copyright|skip|tags?|meta|contentinfo|complementary|dialog)(?:$|[\s_-])", re.I)
_ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|text|body|articlebody)(?:$|[\s_-])", re.I)
_LAYOUT_NAMES = re.compile(r"\b(?:has|with|without|no|hide|show|left|right|two|one)[-_][\w-]+", re.I)
#: Fixed value: what the last line of a site says.
_LEGAL = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"[^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+>")
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in RAW}
_SPACE = re.compile(r"\s+")

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "outside", "article", "heading", "legal")


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, closing, attributes) of each tag, in one pass; a last one without a name has the text that is left.

    Comments, declarations and the contents of scripts, styles and the like are
    gone; a quote that never ends doesn't reach beyond its tag's first ``>``.
    """
    at = text_from = 0
    parts: list[str] = []
    plain_until = -1
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        end = None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
        if end is not None:
            parts.append(page[text_from:at])
            at = text_from = end
            continue
        m = _TAG.match(page, at)
        if not m:
            at += 1
            continue
        whole = _ATTRIBUTES.match(page, m.end()) if at > plain_until else None
        if whole:
            end = whole.end()
        else:
            end = page.find(">", m.end()) + 1
            if not end:  # a tag that never ends hides what is left
                yield "".join(parts) + page[text_from:at], "", False, ""
                return
            if at > plain_until:  # some quote never ends: its place is where the last one stands
                plain_until = max(page.rfind('"'), page.rfind("'"))
        parts.append(page[text_from:at])
        name, closing = m[2].lower(), bool(m[1])
        yield "".join(parts), name, closing, page[m.end() : end - 1]
        parts.clear()
        at = text_from = end
        if name in RAW and not closing:
            stop = _RAW_END[name].search(page, end)
            at = text_from = stop.end() if stop else len(page)
            if name in ("textarea", "iframe"):
                parts.append(" ")
    yield "".join(parts) + page[text_from:], "", False, ""


class _Open:
    """The element that a block stands in, and what changes back when it ends."""

    __slots__ = ("name", "outside", "article", "heading")

    def __init__(self, name: str, outside: int, article: int, heading: int):
        self.name, self.outside, self.article, self.heading = name, outside, article, heading


def blocks(page: str) -> list[tuple[str, tuple[float, ...]]]:
    """(text, features) of each block in page order."""
    found: list[list] = []  # text, words, linked words, outside, article, heading
    parts: list[str] = []
    linked: list[str] = []
    stack: list[_Open] = []
    is_open: Counter[str] = Counter()
    skipping: list[tuple[str, int]] = []  # name, and how many elements were open
    outside = article = heading = 0  # outside: 1 in a form, 2 elsewhere; article: 1 by name, 2 main, 3 article
    link: int | None = None  # how many elements were open when a link began
    every = list(tokens(page))
    last_end = {name: i for i, (_, name, closing, _) in enumerate(every) if closing}

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                n = len(text.split(" "))
                found.append([text, n, min(n, len(html.unescape(" ".join(linked)).split())), outside, article, heading])
            linked.clear()

    def shut(depth: int) -> None:
        nonlocal outside, article, heading, link
        if depth < len(stack):
            own = stack[depth]
            outside, article, heading = own.outside, own.article, own.heading
            is_open.subtract(x.name for x in stack[depth:])
            del stack[depth:]
            while skipping and skipping[-1][1] > depth:
                skipping.pop()
            if link is not None and link > depth:
                link = None

    def innermost(names: str, stops: str = "") -> int | None:
        wanted, ends = names.split(" "), stops.split(" ")
        if any(is_open[x] > 0 for x in wanted):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in wanted:
                    return i
                if stack[i].name in ends:
                    return None
        return None

    for i, (text, name, closing, attributes) in enumerate(every):
        if skipping and skipping[-1][0] == "head" and (text.strip() or name and name not in HEAD):
            skipping.pop()
        if text and not skipping:
            parts.append(text)
            if link is not None:
                linked.append(text)
        if not name:
            continue
        if name in SKIPPED:
            if closing:
                names = [x for x, _ in skipping]
                if name in names:
                    del skipping[names.index(name) :]
            elif not attributes.endswith("/") and (last_end.get(name, -1) > i or name == "head"):
                skipping.append((name, len(stack)))  # one that is never closed skips nothing
            if not skipping or name != "head":
                parts.append(" ")
            continue
        if name not in BLOCK:
            if skipping:
                continue
            if name == "a":
                link = None if closing else len(stack)
            elif name in ("br", "img", "input"):
                parts.append(" ")
            continue
        if closing:
            depth = innermost(name if name not in ("h1", "h2", "h3", "h4", "h5", "h6") else "h1 h2 h3 h4 h5 h6")
            if skipping and (depth is None or depth >= skipping[-1][1]):
                continue  # inside what is skipped; the end of an outer element ends that too
            flush()
            if depth is not None:
                shut(depth)
            continue
        if skipping:
            continue
        flush()
        if name == "hr":
            continue
        if stack and stack[-1].name == "p":
            shut(len(stack) - 1)
        if name in ENDS:
            depth = innermost(*ENDS[name])
            if depth is not None:
                shut(depth)
        stack.append(_Open(name, outside, article, heading))
        is_open[name] += 1
        if name[0] == "h" and name[1:].isdigit():
            heading = 2 if name == "h1" else 1
        names = _LAYOUT_NAMES.sub(" ", " ".join(x or y or z for _, x, y, z in _NAMES.findall(attributes))) if attributes and name not in ("body", "html") else ""
        own = 3 if name == "article" else 2 if name == "main" else 1 if names and _ARTICLE_NAMES.search(names) else 0
        if name in ("article", "main") and outside == 1:
            outside = 0  # a form around the whole page
        if name in OUTSIDE or name == "header" and article < 2 or attributes and _HIDDEN.search(attributes) or names and (name != "main") and _OUTSIDE_NAMES.search(names):
            outside = 2
        elif name == "form":
            outside = max(outside, 1)
        article = max(article, own)
    flush()
    # the best kind of frame that the page has; blocks outside it stand elsewhere
    best = max((b[4] for b in found if not b[3] and b[4] > 1), default=0)
    out = []
    for i, (text, n, k, o, a, h) in enumerate(found):
        before = found[i - 1] if i else ("", 0, 0)
        after = found[i + 1] if i + 1 < len(found) else ("", 0, 0)
        place = (2 if a >= best else 0) if best else 1
        out.append((text, (n, k / n, before[1], before[2] / max(1, before[1]), after[1], after[2] / max(1, after[1]), min(o, 1), place, h, int(n <= 20 and bool(_LEGAL.search(text))))))
    return out


_MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li><li><a href="/c">Contact</a></li></ul></nav>'
_LONG = "Long running text of a paragraph that goes on for many words about one thing and another, so that nobody would take it for a label."
#: What stands before an article, articles (what stands in ``[[ ]]`` is article), and what stands after them.
_BEFORE = (
    "",
    f"{_MENU}<div class='ad'>Buy now, cheap and good.</div>",
    f"<header><h2>The site</h2><p>A motto that is longer than most of them are, for once and all.</p></header>{_MENU}",
    "<div id='menu'><a href='a'>One</a> <a href='b'>Two</a></div><div class='cookie-notice'><p>We use cookies to make this site better for everyone who comes here, as you know.</p></div>",
    "<p><a href='a'>Start</a> <a href='b'>Archive</a> <a href='c'>About us</a></p>",
    "<table><tr><td><a href='1'>Links</a></td><td><a href='2'>More links here</a></td></tr></table>",
)
_BODIES = (
    f"<h1>[[A title here]]</h1><p>[[{_LONG}]]</p><p>[[Short.]]</p><p>[[{_LONG} {_LONG}]]</p>",
    f"<h1>[[Another title]]</h1><p>[[{_LONG}]]</p><ul><li>[[first point]]</li><li>[[second point with more words]]</li></ul><p>[[See <a href='x'>this page</a> for more on it.]]</p>",
    f"<p>[[{_LONG}]]</p><p>[[Then came the end of it.]]</p>",
    f"<h2>[[Part one]]</h2><p>[[{_LONG}]]</p><div class='advert'><p>{_LONG}</p></div><p>[[So it is.]]</p><h2>[[Part two]]</h2><p>[[{_LONG}]]</p><p>[[{_LONG}]]</p>",
    "<p>[[One]]</p>",
    f"<p>[[x y]]</p><p>[[{_LONG}]]</p><blockquote><p>[[A quoted line.]]</p></blockquote><p>[[Yes, no.]]</p><div class='share'>Share this with your friends and family</div>",
    f"[[{_LONG}]]<br><br>",
)
_FRAMES = ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "{}", "<section id='main'><article>{}</article></section>")
_AFTER = (
    "",
    "<footer>(c) site, all rights reserved</footer>",
    f"<aside><p>{_LONG}</p><a href='y'>More</a></aside><div class='footer'>Imprint</div>",
    "<div class='comments'><p>I like what you wrote in the second paragraph, it is a good point and well said by all.</p><p>Me too</p></div>",
    "<p><a href='d'>Next page of the archive</a></p><form><p>Enter your name and address here, please, and press the button below it.</p></form>",
    "<div><a href='e'>Terms</a> <a href='f'>Privacy</a></div><p>All rights reserved</p>",
    "<section class='newsletter'><p>Subscribe to our letter and never miss a thing again, for free.</p></section>",
)
#: Pages in which a block of an article is all link, or something unnamed stands beside an article.
_OTHERS = (
    f"<article><header><h1>[[Headline in the article]]</h1></header><p>[[{_LONG}]]</p><p>[[<a href='z'>A linked sentence that is part of it</a>]]</p><p>[[{_LONG}]]</p></article><div><p>{_LONG}</p></div>",
    f"<div><p>{_LONG}</p></div><h1>[[A title before its article]]</h1><article><p>[[{_LONG}]]</p><a href='z'><p>[[A linked block of it]]</p></a><p>[[{_LONG}]]</p></article><div>Popular</div><div><a href='q'>Ten things</a></div><h3>More for you</h3>",
    f"<article><h1>[[Title]]</h1><p>[[{_LONG}]]</p><p>[[All rights reserved.]]</p></article><footer>(c) site</footer>",
    f"<main><p>[[{_LONG}]]</p><p>[[Copyright is what it is about.]]</p><p>[[{_LONG}]]</p></main>",
    f"<main><h1>[[Title]]</h1><p>[[{_LONG}]]</p></main><div><p>{_LONG}</p><p>Some words beside it</p></div>",
    f"<article><p>[[{_LONG}]]</p><section class='comments'><h3>Comments</h3><article class='comment'><p>{_LONG}</p></article></section></article>",
)
LABELLED = (*(f"<body>{b}{f.format(t)}{a}</body>" for b, t, f, a in product(_BEFORE, _BODIES, _FRAMES, _AFTER)), *(f"<body>{x}</body>" for x in _OTHERS for _ in range(20)))


def labelled_rows() -> list[tuple[float, ...]]:
    """The labelled table: features and label of each block of the labelled pages."""
    out = []
    for page in LABELLED:
        for text, features in blocks(page):
            out.append((*(float(x) for x in features), float("[[" in text)))
    return out


def trained(spark: SparkSession, depth: int = 6) -> tuple:
    """The decision tree as nested tuples (feature, threshold, at most, above) with 0.0 or 1.0 as leaves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame(labelled_rows(), [*FEATURES, "label"])
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInfoGain=0.0, seed=1).fit(table)

    def nested(node) -> tuple | float:
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        return node.split().featureIndex(), node.split().threshold(), nested(node.leftChild()), nested(node.rightChild())

    return nested(model._java_obj.rootNode())


def kept(tree: tuple | float, features: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(tree: tuple | float, page: str | None) -> str:
    return "\n\n".join(text for text, features in blocks(page or "") if kept(tree, features))


def extract(pages: DataFrame, source: str = "html", keep: list[str] | None = None, name: str = "text") -> tuple[DataFrame, str]:
    """The kept columns of each page and its main text (empty if it has none).

    A null or empty page has no text.  Pages are read whole and one by one, so
    repeated rows agree.  The new column gets underscores where its name clashes.
    """
    keep = list(keep if keep is not None else pages.columns)
    name = free_name(name, [*keep, source])
    tree = trained(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.names
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                texts = [main_text(tree, x) for x in part.column(where.index(source)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(where.index(c)) for c in keep], pa.array(texts, pa.string())], names=[*keep, name])

    carried = [c for c in keep if c != source]
    return pages.select(*carried, source).mapInArrow(run, T.StructType([*[pages.schema[c] for c in keep], T.StructField(name, T.StringType())])), name


def digest(pages: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    out, name = extract(pages, keep=["page_id", "url"])
    return out.select("page_id", "url", F.col(name).alias("text"), F.char_length(name).cast("long").alias("n_chars"))
