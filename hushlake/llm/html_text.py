"""Main text of web pages by consensus of each host's pages.

Every page is parsed and its containers are scored by the text they hold that is
neither link nor boilerplate; a container whose parent holds a headline or a lead
beside it gives way to the parent. A container's path is generalised (tags with
their classes, digits taken out), and the best container votes for its path.
Votes are counted for each host in Spark. Then every page is extracted again from
the container at its host's winning path, or at another path with a fifth of the
host's votes if that holds more than twice the text (a rarer template); a page
that has neither uses its own best container.

Inside the container, menus, forms, adverts, notices, comments and the like
are left out by tag, role or class name. Within an article a word that is only part
of a class name (``related-work``) is not enough: its text must mostly be links too. Character references are decoded, white space
inside a block becomes one blank, blocks are joined by line feeds.

Null or empty html gives an empty text. A null url is a host of its own, the empty one.
Repeated rows count and come back as often as they occur, null ids stay null, an empty
table gives no row, other columns are not read. Of equal votes the first path by name wins. Pages are
parsed whole, in time and memory linear in their length, however deep they are nested.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noembed", "noframes"))
CONTAINERS = frozenset("body article main section div td center blockquote".split())
#: Tags that begin and end a block of text.
BLOCKS = CONTAINERS | frozenset(
    "html head title p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption pre hr form fieldset "
    "header footer nav aside figure figcaption address details summary dialog".split()
)
#: Tags that end when one of the second column begins before they are closed.
CLOSED_BY = {
    "p": BLOCKS,
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
#: An open tag of the first column is not sought beyond these.
SCOPES = {"p": frozenset(("td", "th", "table", "body")), "li": frozenset(("ul", "ol")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
TABLE_SCOPE = frozenset(("table",))
BOILERPLATE = frozenset(
    "nav footer aside form script style noscript template iframe object button select textarea input svg canvas audio video "
    "dialog menu head title header".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|nav|navbar|navigation|menu|"
    r"breadcrumbs?|sidebar|side|footer|masthead|cookies?|consent|notices?|banner|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|share|sharing|social|comments?|commentlist|replies|reply|respond|disqus|related|recommended|widget|login|"
    r"signup|search|toolbar|pagination|pager|skip|header)(?:$|[\s_-])"
)
#: Of these, the ones that say enough as part of a longer name too, in an article as elsewhere.
SURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|cookies?|consent|newsletter|subscribe|"
    r"comments?|commentlist|replies|reply|respond|disqus|pagination|pager|breadcrumbs?)(?:$|[\s_-])"
)
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))",
    re.S,
)
_ends = {tag: re.compile(f"</{tag}(?![a-z0-9])", re.I | re.A) for tag in RAW}
_attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_digits = re.compile(r"\d+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    step: str  # tag and classes, generalised
    left_out: bool
    link: bool
    unsure: bool = False  # left out if most of its text is links
    box: int = 0  # the nearest container, itself included
    end: int = 1 << 60
    first: int = 0  # its texts: from ``first`` to before ``last``
    last: int = 1 << 60


@dataclass
class Page:
    """Nodes in the order they begin; texts as (node, block, text), where ``block`` grows at every edge of a block."""

    nodes: list[Node] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _attribute.findall(raw):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def boilerplate(tag: str, named: dict[str, str], inside_article: bool) -> bool | None:
    """Whether a tag holds no main text; None if its name alone cannot tell. A header inside the article is its title and stays."""
    if tag in BOILERPLATE and not (tag == "header" and inside_article):
        return True
    if not named or tag in ("html", "body", "article", "main"):
        return False
    style = named.get("style", "").replace(" ", "").lower()
    if named.get("role", "").lower() in ROLES or "hidden" in named or named.get("aria-hidden") == "true":
        return True
    if "display:none" in style or "visibility:hidden" in style:
        return True
    named_as = f"{named.get('class', '')} {named.get('id', '')}".lower().strip()
    if inside_article and tag == "header" or not NAMES.search(named_as):
        return False
    if not inside_article or SURE.search(named_as) or any(NAMES.fullmatch(name) for name in named_as.split()):
        return True
    return None


def parse(raw: str) -> Page:
    """Nodes and texts; unclosed, stray and wrongly nested tags are taken as browsers do, roughly."""
    page = Page([Node("", 0, "", False, False)])
    nodes, stack, block, at, articles = page.nodes, [0], 0, 0, 0
    count: Counter[str] = Counter()

    def pop(to: int) -> None:
        nonlocal block, articles
        while len(stack) > to:
            node = nodes[stack.pop()]
            node.end, node.last = len(nodes), len(page.texts)
            block += node.tag in BLOCKS
            articles -= node.tag in ("article", "main")
            count[node.tag] -= 1

    def opened(tag: str, stop: frozenset) -> int:
        if not count[tag]:
            return 0
        for i in range(len(stack) - 1, 0, -1):
            name = nodes[stack[i]].tag
            if name == tag:
                return i
            if name in stop:
                break
        return 0

    def text(piece: str) -> None:
        if piece:
            page.texts.append((stack[-1], block, html.unescape(piece)))

    while found := _token.search(raw, at):
        text(raw[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                text(raw[found.start() + 9 : found.end() - 3])
            continue
        if found[1]:
            i = opened(tag, frozenset())
            if i:
                pop(i)
            elif tag in BLOCKS:
                block += 1
            continue
        for name in (nodes[stack[-1]].tag, "p", "li", "td", "th", "tr", "dt", "dd", "option"):
            if tag in CLOSED_BY.get(name, ()) and (i := opened(name, SCOPES.get(name, TABLE_SCOPE))):
                pop(i)
        named = attributes(found[3].rstrip(">")) if len(found[3]) > 2 else {}
        above = nodes[stack[-1]]
        block += tag in BLOCKS
        if tag == "br":
            text("\n")
        if tag in VOID:
            continue
        step = ""
        if tag in CONTAINERS:
            step = ".".join([tag, *sorted(_digits.sub("0", c.lower()) for c in named.get("class", "").split())])
        out = boilerplate(tag, named, articles > 0)
        node = Node(tag, stack[-1], step, above.left_out or out is True, above.link or tag == "a", out is None, first=len(page.texts))
        node.box = len(nodes) if tag in CONTAINERS else above.box
        nodes.append(node)
        count[tag] += 1
        articles += tag in ("article", "main")
        stack.append(len(nodes) - 1)
        if tag in RAW:
            close = _ends[tag].search(raw, at)
            at = close.start() if close else len(raw)
    text(raw[at:])
    pop(0)
    _leave_out_links(page)
    return page


def _leave_out_links(page: Page) -> None:
    """Settles the nodes whose name could not tell: out if half of their text or more is links, or if they have none."""
    if not any(node.unsure for node in page.nodes):
        return
    sizes, links = [0], [0]
    for at, _, piece in page.texts:
        size = len(piece.strip())
        sizes.append(sizes[-1] + size)
        links.append(links[-1] + size * page.nodes[at].link)
    until = 0
    for i, node in enumerate(page.nodes):
        if i < until:
            node.left_out = True
        elif node.unsure and 2 * (links[node.last] - links[node.first]) >= sizes[node.last] - sizes[node.first]:
            node.left_out, until = True, node.end


def path_of(page: Page, i: int) -> str:
    """The steps of a container and of those around it."""
    steps = []
    while i:
        if page.nodes[i].step:
            steps.append(page.nodes[i].step)
        i = page.nodes[i].parent
    return ">".join(steps[::-1])


def best_container(page: Page) -> int:
    """The container with the highest score: its share of the page's main text, less what links take up; the smallest of equals.

    Text straight below a container or in its paragraphs counts in full, text in containers below it by half for
    each level, and articles weigh more, so that the score falls off above and below the right one.
    """
    nodes = page.nodes
    score: dict[int, float] = {}
    for at, _, piece in page.texts:
        size = len(piece.strip())
        node = nodes[at]
        if not size or node.left_out:
            continue
        size = -size / 2 if node.link else size
        share, i = 1.0, node.box
        while i and share > 0.1:
            score[i] = score.get(i, 0.0) + size * share
            share, i = share / 2, nodes[nodes[i].parent].box
    if not score:
        return 0
    best = max(score, key=lambda i: (score[i] * (2.0 if nodes[i].tag in ("article", "main") else 1.0), -nodes[i].end, i))
    return _with_headline(page, best)


def _with_headline(page: Page, best: int) -> int:
    """The container, or the one around it as long as that adds text of its own and no text like a menu's.

    What stands straight in the outer one (a headline, a lead) decides; its
    other containers must hold less than half the text of the inner one, and links
    must not outweigh the rest.
    """
    nodes, texts = page.nodes, page.texts
    while best and nodes[best].tag not in ("article", "main", "body"):
        outer = nodes[nodes[best].parent].box
        if not outer or nodes[outer].left_out:
            break
        inner, own, other, links = 0, 0, 0, 0
        for place in range(nodes[outer].first, min(nodes[outer].last, len(texts))):
            at, _, piece = texts[place]
            size = len(piece.strip())
            if not size or nodes[at].left_out:
                continue
            if nodes[best].first <= place < nodes[best].last:
                inner += size
            elif nodes[at].link:
                links += size
            elif nodes[at].box == outer:
                own += size
            else:
                other += size
        if not own or links > own + other or 2 * other > inner:
            break
        best = outer
    return best


def text_of(page: Page, roots: list[int]) -> str:
    """The blocks below the containers, which are in page order and apart, in page order."""
    blocks: dict[int, list[str]] = {}
    for at, block, piece in page.texts:
        i = bisect_right(roots, at) - 1
        if i >= 0 and at < page.nodes[roots[i]].end and not page.nodes[at].left_out:
            blocks.setdefault(block, []).append(piece)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def at_path(page: Page, path: str) -> list[int]:
    """The containers at a path that are not left out, outermost only."""
    steps, nodes = path.split(">"), page.nodes
    # How many steps of the path a container and those around it are, in order; -1 where they leave it.
    agreed = [-1] * len(nodes)
    agreed[0] = 0
    found: list[int] = []
    for i, node in enumerate(nodes[1:], 1):
        if not node.step:
            continue
        above = agreed[nodes[node.parent].box]
        if 0 <= above < len(steps) and steps[above] == node.step:
            agreed[i] = above + 1
            if above + 1 == len(steps) and not node.left_out and not (found and i < nodes[found[-1]].end):
                found.append(i)
    return found


def extracted(page: Page, paths: list[str] | None) -> str:
    """The text at the first path, or at another one if that is more than twice as long; without any, the page's own best."""
    texts = [text_of(page, found) for path in paths or [] if (found := at_path(page, path))]
    texts = [text for text in texts if text]
    if not texts:
        best = best_container(page)
        return text_of(page, [best] if best else [0])
    longest = max(texts, key=len)
    return longest if len(longest) > 2 * len(texts[0]) else texts[0]


def host(url: str | Column) -> Column:
    """The host of an address in lower case, without user and port; empty where there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for raw in batch.column(1).to_pylist():
            page = parse(raw or "")
            paths.append(path_of(page, best_container(page)) or None)
        yield pa.record_batch([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])


#: Votes of a host that a path needs beside the winner's, as a share: there are few such paths.
TEMPLATE = 0.2


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the path with the most votes of a host's pages, then all others with a share of TEMPLATE; of equals the first by name."""
    rows = pages.select(host(pages["url"].cast("string")).alias("host"), pages["html"].cast("string").alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string").filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"))
    votes = written(votes, "votes")
    totals = votes.groupBy("host").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    some = votes.join(totals, "host").filter((F.col("n") == F.col("most")) | (F.col("n") >= TEMPLATE * F.col("total")))
    # Where every path has one vote, the first by name stands for them all.
    best = some.groupBy("host").agg(
        F.min(F.struct(-F.col("n"), "path")).alias("best"),
        F.collect_list(F.when(F.col("n") >= TEMPLATE * F.col("total"), F.struct((-F.col("n")).alias("n"), "path"))).alias("all"),
    )
    others = F.transform(F.array_sort("all"), lambda x: x["path"])
    return best.select("host", F.array_distinct(F.concat(F.array("best.path"), others)).alias("paths"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extracted(parse(raw or ""), paths) for raw, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    paths = written(winning_paths(pages), "paths")
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        pages["html"].cast("string").alias("html"), host(pages["url"].cast("string")).alias("host"),
    )
    known = rows.join(paths, "host", "left").select("page_id", "url", "html", "paths")
    texts = known.mapInArrow(_extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
