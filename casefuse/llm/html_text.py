"""Main text of web pages: flat blocks, classified by a decision tree over neighbouring blocks.

A page becomes a flat list of text blocks. Each is described by its words and link density, those of
the blocks before and after it, by the landmark element around it, and weakly by class names. A
decision tree trained on a small labelled table decides which blocks are main text.
"""

import html
import re

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefuse.llm.html_labels import LABELLED

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after",
            "landmark", "named", "heading"]

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)"""
    r"""|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z))""",
    re.DOTALL)
_ATTRIBUTE = re.compile(
    r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
# Elements whose content is no text of the page: those read as raw text up to their end tag (or the
# end of the page), and those that are passed over only where they are closed.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_PASSED = frozenset(
    "noscript template svg math object canvas audio video select button datalist".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An element of these names is closed by the next one of the group, unless the border is between.
_SIBLINGS = {n: (frozenset(g.split()), frozenset(b.split())) for g, b in (
    ("li", "ul ol menu"), ("dt dd", "dl"), ("td th", "tr table"), ("tr", "table tbody thead tfoot"))
    for n in g.split()}
# Landmarks beside the main text; the second kind gives way to an article or main element inside.
_ASIDE, _ASIDE_OUTSIDE = frozenset("nav footer aside dialog".split()), frozenset(
    "header form menu fieldset".split())
# Names of parts beside the main text; the second kind likewise.
_CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored "
    "sponsors comment comments commentlist disqus respond replies cookie cookies consent gdpr "
    "newsletter subscribe subscription popup modal share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs pagination pager".split())
_CHROME_OUTSIDE = frozenset(
    "nav navbar navigation menu sidebar rail header masthead topbar footer foot banner toolbar widget "
    "widgets notice notices alert alerts login signin signup search copyright legal disclaimer skip "
    "teaser tags meta byline contentinfo complementary".split())
_CONTENT, _WEAK_CONTENT = frozenset("article post entry story".split()), frozenset(
    "content main body text".split())
# Words that say nothing about a part. A name counts only where all its words are known; the last
# one of the sets above decides.
_NEUTRAL = frozenset(
    "site page section block box list wrapper wrap container inner outer area bar row col column left "
    "right top bottom links items item buttons button media form panel group layout primary secondary "
    "global id js mobile desktop sticky fixed floating slot unit".split())


_KINDS = {w: k for k, words in ((0, _NEUTRAL), (0.5, _WEAK_CONTENT), (1, _CONTENT), (-1, _CHROME_OUTSIDE),
                                (-2, _CHROME)) for w in words}


def _named(attributes: str) -> tuple[int, bool]:
    """(1 content, -1 chrome, -2 chrome also around an article, 0 neither; is a main landmark)."""
    said, landmark = 0, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            for word in (a or b or c).split():
                landmark |= name == "role" and word.lower() in ("main", "article")
                kinds = [_KINDS.get(t.lower()) for t in _TOKEN.findall(word) if not t.isdigit()]
                if kinds and None not in kinds:
                    kind = next((k for k in reversed(kinds) if k in (-2, -1, 1)), None)
                    if kind is None:
                        kind = 1 if 0.5 in kinds else 0
                    said = min(said, kind) if kind < 0 else said or kind
    return said, landmark


def _hidden(attributes: str) -> bool:
    low = attributes.lower()
    return ("hidden" in low and re.search(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true",
                                          low) is not None) or (
        "display" in low and re.search(r"display\s*:\s*none", low) is not None)


def _said(tag: str, attributes: str, above: tuple) -> tuple:
    """(landmark, named, hidden) of an element below one with `above`; -2 holds whatever follows."""
    landmark, named, hidden = above
    own, is_main = (0, False) if "=" not in attributes or tag in ("html", "body") else _named(
        attributes)
    if tag in ("article", "main") or is_main:
        landmark, named = 1 if landmark > -2 else -2, -2 if named == -2 else 0
    elif tag in _ASIDE:
        landmark = -2
    elif tag in _ASIDE_OUTSIDE and not (landmark == 1 and tag == "header"):
        landmark = min(landmark, -1)
    if own < 0 and not (tag in ("article", "main") or is_main):
        named = min(named, own)
    elif own > 0 and named == 0:
        named = 1
    return landmark, named, hidden or ("d" in attributes and _hidden(attributes))


def blocks(page: str):
    """(text, words, words in links, landmark, named, heading, attributes) of each text block.

    White space inside a block is one space; `attributes` are those of the block's own element. A
    link ends with its block at the latest. An element that is passed over but never closed loses
    its tag only; raw text that is never closed lasts to the end of the page, as browsers have it.
    """
    out, stack, text, linked = [], [], [], []
    state, in_link, at, tag_now, own, unclosed = (0, 0, False), False, 0, "", "", set()

    def flush():
        words = "".join(text).split()
        if words and not state[2]:
            links = sum(len(s.split()) for s in linked)
            out.append((" ".join(words), len(words), min(links, len(words)),
                        float(max(-1, state[0])), float(max(-1, state[1])),
                        float(tag_now in _HEADINGS), own))
        text.clear()
        linked.clear()

    def said(s):
        if s:
            s = html.unescape(s)
            text.append(s)
            if in_link:
                linked.append(s)

    def top():
        nonlocal state, tag_now, own
        tag_now, own, state = stack[-1] if stack else ("", "", (0, 0, False))

    while True:
        m = _TAG.search(page, at)
        if m is None:
            said(page[at:])
            flush()
            return out
        said(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                in_link = False
            elif tag in _BLOCKS:
                flush()
                in_link = False
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                top()
        elif tag == "a":
            in_link = "href" in m.group(3).lower()
        elif tag == "br":
            text.append(" ")
        elif tag in _RAW or tag in _PASSED:
            if tag in _RAW or tag not in unclosed and not m.group(3).endswith("/"):
                end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                if end is not None:
                    at = end.start()
                elif tag in _RAW:
                    at = len(page)
                else:
                    unclosed.add(tag)
        elif tag in _BLOCKS:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
                in_link = False
            if tag in _SIBLINGS:
                group, border = _SIBLINGS[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in border:
                        break
                    if stack[i][0] in group:
                        del stack[i:]
                        break
            top()
            if tag not in _VOID:
                stack.append((tag, m.group(3), _said(tag, m.group(3), state)))
                top()


def described(found: list) -> list:
    """FEATURES of every block of a page."""
    rows, n = [], len(found)
    share = [b[2] / b[1] for b in found]
    for i, b in enumerate(found):
        rows.append((b[1], share[i], found[i - 1][1] if i else 0, share[i - 1] if i else 0.0,
                     found[i + 1][1] if i + 1 < n else 0, share[i + 1] if i + 1 < n else 0.0,
                     b[3], b[4], b[5]))
    return rows


def labelled_table(spark: SparkSession, pages=LABELLED) -> DataFrame:
    """`label, features` of every block of labelled pages (main blocks carry `data-main`)."""
    rows = []
    for page in pages:
        found = blocks(page)
        rows += [(float("data-main" in b[6]), Vectors.dense(f))
                 for b, f in zip(found, described(found))]
    return spark.createDataFrame(rows, ["label", "features"])


def train(table: DataFrame, depth: int = 10, least: int = 2):
    """A decision tree as nested (feature, limit, low, high) tuples with boolean leaves."""
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, maxBins=512,
                                   seed=1).fit(table)

    def plain(node):
        if node.numDescendants() == 0:
            return node.prediction() == 1.0
        split = node.split()
        return (split.featureIndex(), split.threshold(),
                plain(node.leftChild()), plain(node.rightChild()))
    return plain(model._java_obj.rootNode())


def decide(tree, row) -> bool:
    """The tree's verdict on one block."""
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree) -> str:
    """Main blocks of a page in order, joined by an empty line."""
    found = blocks(page)
    return "\n\n".join(b[0] for b, row in zip(found, described(found)) if decide(tree, row))


def main_text_column(page: Column, tree) -> Column:
    """The main text of a page, empty where there is none."""
    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p, tree) if p else "" for p in pages.to_pylist()], pa.string())
    return extracted(page)


def extract_pages(pages: DataFrame, labelled: DataFrame = None, html_col: str = "html",
                  id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`page_id, url, text, n_chars` of every page.

    Character references are decoded; nothing is cut. A null or empty page and a page without main
    text give an empty text. Repeated rows each give a row, an empty table none, further columns are
    ignored. `labelled` replaces the training table that comes with the package.
    """
    spark = pages.sparkSession
    tree = train(labelled_table(spark) if labelled is None else labelled)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        main_text_column(F.col(html_col), tree).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
