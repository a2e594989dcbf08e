"""Main text of web pages by two passes of block rules.

The first pass classifies every block by the share of stop words, its length
and the share of its text inside links; ambiguous blocks, short ones above all,
are left open.  The second pass gives each open block the label of its nearest
decided neighbours.  (After Pomikálek, "Removing Boilerplate and Duplicate
Content from Web Corpora", 2011.)

Structure is a feature beside these.  What stands in navigation, footers,
forms and the like is left out, as scripts are.  Names of classes count only as
whole names, on containers, and only if the container does not hold the page's
prose.  An <article> counts where it holds most of the page's prose: then its
open blocks look at neighbours in it alone, and text outside it has to be long
and dense to be open at all.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her him his
    how i if in into is it its just like may me more most my no not of on one only or other our out over she so some such
    than that the their them then there these they this to up us was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch durch ein eine einem einen einer eines er
    es für hat hatte ich ihr im in ist ja kann man mein mich mit nach nicht noch nur oder schon sein sich sie sind so über
    um und uns unter vom von vor war was wenn wer werden wie wir wird zu zum zur
    à au aux avec ce ces cette dans de des du elle elles en est et eu il ils je la le les leur leurs lui mais me même mes
    moi mon ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur ta te tu un une vous
    al como con cuando del desde donde el ella ellos entre era es esa ese eso esta este esto fue ha hay la las lo los más
    me mi muy no nos o para pero por porque qué quien se ser si sin sobre son su sus también te tiene todo un una uno y ya
    yo""".split()
)
#: Blocks begin and end at these; their text is never joined with a neighbour's.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
    section select summary table tbody td tfoot th thead title tr ul""".split()
)
#: What these hold is not text of a page.
HIDDEN_TAGS = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea button".split())
#: What these hold is never the article.
CHROME_TAGS = frozenset("nav footer aside form menu dialog".split())
ARTICLE_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class names for what is no article, and words that may stand beside them.
CHROME_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright
    discussion disqus footer gdpr legal masthead menu nav navbar navigation newsletter notice notices notification pager
    pagination popup modal promo promotion promoted related replies reply respond responses share sharing sidebar skip social sponsor
    sponsored subscribe subscription tagcloud teaser toolbar widget""".split()
)
NEUTRAL_WORDS = frozenset("site page main top bottom left right side box block bar wrap wrapper area section container inner outer list item items header links link btn button buttons group panel content text thread form policy and or the m s".split())
#: Elements whose names say nothing: text itself, and what holds a page.
UNNAMED_TAGS = frozenset("body html article main p h1 h2 h3 h4 h5 h6 blockquote pre td em strong b i span a".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
COMMENT_TYPE = re.compile(r"(?:comment|usercomments)", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:@][^\s=\"'>/]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
WORDS = re.compile(r"[^\W\d_]+")

#: Rules of the first pass.
MANY_LINKS = 0.33
SHORT, LONG = 70, 200
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.18, 0.3
#: Text in an article is open, and no longer bad, up to this share of links.
MOST_LINKS = 0.8


class Block:
    __slots__ = ("parts", "linked", "chrome", "named", "article", "heading", "listed", "stops", "links")

    def __init__(self, chrome: bool, named: tuple[int, ...], article: int, heading: bool, listed: bool):
        self.parts: list[str] = []
        self.linked = 0
        #: whether left out; containers whose names speak against it; number of its article, 0 for none
        self.chrome, self.named, self.article, self.heading, self.listed = chrome, named, article, heading, listed


def _chrome_name(value: str) -> bool:
    """Whether one of the names says that this is no article: all its words do, but for words that say nothing."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w not in NEUTRAL_WORDS]
        if words and all(w in CHROME_WORDS for w in words):
            return True
    return False


def _chrome(tag: str, attributes: str, article: bool) -> tuple[bool, bool]:
    """Whether an element is left out for what it is, and whether its name (or its being a form) speaks against it."""
    hard = tag in CHROME_TAGS and tag != "form" or tag == "header" and not article
    soft = tag == "form"
    if attributes and tag not in ("body", "html"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                soft = soft or tag not in UNNAMED_TAGS and _chrome_name(value)
            elif name == "role":
                hard = hard or value.lower() in CHROME_ROLES
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hard = True
            elif name in ("itemtype", "itemprop"):
                soft = soft or bool(COMMENT_TYPE.search(value))
    return hard, soft


def blocks(page: str) -> tuple[list[tuple[str, Block]], set[int]]:
    """The page's blocks that hold text, in order, with white space made even; and the named containers that hold an article."""
    out: list[Block] = []
    # open elements: name, whether left out, number of the named container, article before, link, heading
    stack: list[tuple[str, bool, int, int, bool, bool]] = []
    # how many elements of each name are open, for endings; a table or article hides what stands before it
    scopes: list[dict[str, int]] = [{}]
    barriers: dict[str, int] = {}
    block_at: list[int] = []  # places of block elements in the stack
    link_at: list[int] = []
    named: list[int] = []
    holds_article: set[int] = set()
    unclosed: set[str] = set()
    chrome = article = articles = links = headings = containers = 0
    current: Block | None = None
    at, n = 0, len(page)

    def text(raw: str) -> None:
        nonlocal current
        if current is None:
            if not raw.strip():
                return
            current = Block(chrome > 0, tuple(named), article, headings > 0, any(x[0] == "li" for x in stack[-3:]))
            out.append(current)
        plain = entities.unescape(raw) if "&" in raw else raw
        current.parts.append(plain)
        if links:
            current.linked += len("".join(plain.split()))

    def close(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal chrome, article, links, headings
        while len(stack) > k:
            tag, c, container, before, link, h = stack.pop()
            if tag in SCOPES:
                scopes.pop()
                barriers[tag] -= 1
            else:
                scopes[-1][tag] -= 1
            if block_at and block_at[-1] == len(stack):
                block_at.pop()
            if link:
                link_at.pop()
            chrome -= c
            if container:
                named.pop()
            article = before
            links -= link
            headings -= h

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ending, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if not ending and tag in HIDDEN_TAGS:
            if tag in BLOCK_TAGS:
                current = None
            if not attributes.endswith("/"):
                over = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if over:
                    at = over.end()
                else:
                    unclosed.add(tag)
                    if tag in ("script", "style", "textarea", "title", "template"):
                        at = n
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            current = None
        if ending:
            # an ending without its beginning closes nothing
            if barriers.get(tag) if tag in SCOPES else scopes[-1].get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        top = block_at[-1] if block_at else -1
        if tag in BLOCK_TAGS and top >= 0:  # a paragraph, and what stands open in it, ends where a block begins
            over = stack[top][0]
            if over == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option") and over == tag:
                close(top)
                top = block_at[-1] if block_at else -1
        link = tag == "a"
        if link and link_at and link_at[-1] > top:
            close(link_at[-1])
        hard, soft = _chrome(tag, attributes, article > 0)
        if soft:
            containers += 1
        stack.append((tag, hard, containers if soft else 0, article, link, tag in HEADINGS))
        if tag in SCOPES:
            scopes.append({})
            barriers[tag] = barriers.get(tag, 0) + 1
        else:
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
        if tag in BLOCK_TAGS:
            block_at.append(len(stack) - 1)
        if link:
            link_at.append(len(stack) - 1)
        if soft:
            named.append(containers)
        if tag in ARTICLE_TAGS and not article:
            articles += 1
            article = articles
            if not chrome:
                holds_article.update(named)
        chrome += hard
        links += link
        headings += tag in HEADINGS
    found = []
    for b in out:
        joined = " ".join("".join(b.parts).split())
        if joined:
            words = WORDS.findall(joined.lower())
            b.stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            b.links = b.linked / max(1, len(joined) - joined.count(" "))
            found.append((joined, b))
    return found, holds_article


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hide what is open before them from endings within.
SCOPES = frozenset("article main body html table".split())


def prose(text: str, b: Block) -> str:
    """good, bad or open by stop words, length and links alone."""
    if b.links > MANY_LINKS:
        return "bad"
    if len(text) < SHORT:
        return "open"
    if b.stops >= MANY_STOP_WORDS or b.stops >= FEW_STOP_WORDS and len(text) >= LONG:
        return "good"
    if b.stops >= FEW_STOP_WORDS:
        return "open"
    return "bad" if len(text) >= LONG else "open"


def first_pass(found: list[tuple[str, Block]], holds_article: set[int]) -> tuple[list[str], list[int]]:
    """A label for each block, good, bad or open; and the article each block counts to (0: none)."""
    labels = ["bad" if b.chrome else prose(t, b) for t, b in found]
    bulk = [len(t) if label == "good" else 0 for (t, _), label in zip(found, labels, strict=True)]
    total = sum(bulk)
    inside: dict[int, int] = {}
    for (_, b), k in zip(found, bulk, strict=True):
        for c in b.named:
            inside[c] = inside.get(c, 0) + k
    # a name does not outvote an article in its container, nor most of the prose of a page that has no article elsewhere
    elsewhere = any(b.article and not b.chrome and not b.named for _, b in found)
    refuted = {c for c, k in inside.items() if c in holds_article or 2 * k > total and not elsewhere}
    stands = [not b.chrome and all(c in refuted for c in b.named) for _, b in found]
    within = sum(k for (_, b), k, s in zip(found, bulk, stands, strict=True) if b.article and s)
    without = sum(k for (_, b), k, s in zip(found, bulk, stands, strict=True) if not b.article and s)
    has_article = any(b.article and s for (_, b), s in zip(found, stands, strict=True)) and within >= without
    home = [b.article if has_article and s else 0 for (_, b), s in zip(found, stands, strict=True)]
    for k, (t, b) in enumerate(found):
        if not stands[k]:
            labels[k] = "bad"
        elif home[k]:
            # in the article: what no rule speaks for is open, unless it is a long listing of links
            if labels[k] == "bad" and (b.links <= MOST_LINKS or len(t) < SHORT):
                labels[k] = "open"
        elif has_article:
            # beside it: only long, dense text is open
            labels[k] = "open" if labels[k] == "good" and len(t) >= LONG and b.stops >= MANY_STOP_WORDS else "bad"
        elif b.article and len(t) < LONG:
            labels[k] = "bad" if labels[k] != "good" or b.links > 0 or without > 2 * within else "good"  # cards beside the story
        elif t.startswith(("©", "Copyright", "copyright")):
            labels[k] = "bad"
    return labels, home


def second_pass(found: list[tuple[str, Block]], labels: list[str], home: list[int]) -> list[str]:
    """Open blocks take the label of their nearest decided neighbours; those of an article look at neighbours in it."""
    n = len(labels)

    def nearest(order: range) -> list:
        out: list = [None] * n
        last: dict[int, tuple[str, int]] = {}
        for k in order:
            out[k] = last.get(home[k]) if home[k] else last.get(0)
            if labels[k] != "open":
                last[0] = (labels[k], k)
                if home[k]:
                    last[home[k]] = (labels[k], k)
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for k, label in enumerate(labels):
        if label == "open":
            p, q = before[k], after[k]
            if p is None and q is None:
                # nothing is decided near it: short text stands for itself, longer text had its chance
                label = "good" if len(found[k][0]) < SHORT or found[k][1].links <= MANY_LINKS else "bad"
            elif p is None or q is None:
                label = (p or q)[0]
            elif p[0] == q[0]:
                label = p[0]
            elif found[k][1].heading:
                label = q[0]  # a heading belongs to what follows it
            else:
                label = p[0] if k - p[1] < q[1] - k else q[0] if q[1] - k < k - p[1] else "good" if home[k] else "bad"
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by one space."""
    if not page:
        return ""
    found, holds_article = blocks(page)
    labels, home = first_pass(found, holds_article)
    return " ".join(t for (t, _), label in zip(found, second_pass(found, labels, home), strict=True) if label == "good")


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Null or empty html, and pages without an article, give an empty text.
    Every row is handled for itself, so repeated rows stay, no row moves to
    another task, and other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                texts = [main_text(h) for h in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = dict(df.dtypes)[page_id]
    return df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
