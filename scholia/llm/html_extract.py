"""Main text of web pages by site template removal.

Every element of a page gets a hash of its subtree (names and texts, children before parents). Spark counts on how many
pages of a host each hash occurs; subtrees found on many pages of their host are template and are deleted. Rules about
element names, roles and class names delete what is never main text, and where a page marks its article or main part, only
that part is kept; of it, only block elements that all pages of the host have are template. Pages are parsed twice, each time inside their task: for the
hashes, which are written once, and for the text. What is shuffled are hashes, and for deletion the template hashes of a page.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import cut, forget

#: The pages' template hashes are broadcast up to this many (counted first) and joined by shuffling pages beyond.
BROADCAST_HASHES = 500_000
#: A subtree is template from so many pages of its host and such a share of them; inside an article, from all of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.2
#: If more of an article's text than this would go, the page is a copy of others and nothing inside its article goes.
MOST_OF_ARTICLE = 0.3

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html caption dd dt legend option optgroup tbody td tfoot th thead tr li".split())
#: An opening tag ends open elements of these names, up to the nearest of the stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "tbody", "thead"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}

TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p dt li figcaption caption a span".split())
#: Parts of a sentence; a class of theirs says how they look or where they lead, so it drops nothing.
PHRASES = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())

#: Never main text.
DROP_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe svg canvas button select textarea dialog head title menu "
    "object embed audio video noembed noframes datalist input".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side footer cookie cookies cc consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social comment comments feedback disqus replies respond "
    "related recommended recommendations widget pagination pager toolbar skip".split()
)
#: With a word of the above, these make the name of a box (`related-posts`); others don't (`related-work`, `side-effects`).
BOX_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container content count div element feed field footer "
    "form group head header heading icon icons inner item items left link links list main menu module nav outer page pages panel "
    "post posts primary region right row section secondary site slot space stories story sub text thread title top unit user users view window wrap "
    "wrapper zone by on this and us our your".split()
)
#: Dropped only outside of the article, where they may hold its title.
DROP_OUTSIDE = frozenset(("header", "masthead", "topbar"))

# quotes open a value only after an equals sign
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "drop", "main", "inside", "children", "hash", "named")

    def __init__(self, tag, parent, drop, main, named=False):
        self.tag, self.parent, self.drop, self.main, self.named = tag, parent, drop, main, named
        self.inside = main > 0 or (parent is not None and parent.inside)
        self.children = []
        self.hash = 0


def _names_box(names: str, words: frozenset[str]) -> bool:
    """Whether one of some class names or ids is that of a box which words tell apart."""
    for name in names.split():
        parts = [w.lower() for w in _WORD.findall(name)]
        if words.intersection(parts) and all(w in words or w in BOX_WORDS or w.isdigit() for w in parts):
            return True
    return False


def _judge(tag: str, raw: str, inside: bool) -> tuple[bool, int, bool]:
    """Whether a rule drops the element; 2 for an article, 1 for another main part; whether it drops by class or id only."""
    main = 2 if tag == "article" else 1 if tag == "main" else 0
    if tag in DROP_TAGS or (tag in DROP_OUTSIDE and not inside):
        return True, 0, False
    if not raw.strip(" /"):
        return False, main, False
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    role = attrs.get("role", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or role in DROP_ROLES or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True, 0, False
    if tag not in PHRASES and tag not in ("html", "body"):
        # ids of headings and paragraphs are made from their words
        names = attrs.get("class", "") + ("" if tag in TEXT_TAGS else f" {attrs.get('id', '')}")
        if _names_box(names, DROP_WORDS if inside else DROP_WORDS | DROP_OUTSIDE):
            return True, 0, True
    if role == "main" and not main or attrs.get("itemprop") == "articleBody":
        main = 1
    return False, main, False


def parse(html: str) -> Node:
    """The tree of a page; children are nodes and strings, in page order."""
    root = at = Node("#", None, False, 0)
    pos, n = 0, len(html)

    def text(piece: str) -> None:
        if piece:
            at.children.append(unescape(piece))

    def close(names, stops=()) -> None:
        nonlocal at
        node = at
        while node is not root and node.tag not in names:
            if node.tag in stops:
                return
            node = node.parent
        if node is not root:
            at = node.parent

    while m := _TOKEN.search(html, pos):
        text(html[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                at.children.append(Node("br", at, False, 0))
            else:
                close((tag,))
            continue
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "table", "li", "article", "section", "div", "body", "button"))
        if tag in ENDS:
            names, stops = ENDS[tag]
            while True:
                before = at
                close(names, stops)
                if at is before:
                    break
        node = Node(tag, at, *_judge(tag, m[3], at.inside))
        at.children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(html, pos)
            if tag == "title":
                node.children.append(unescape(html[pos : end.start() if end else n]))
            pos = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            at = node
    text(html[pos:])
    return root


def hash_subtrees(root: Node) -> list[Node]:
    """Hash every element that holds text; all of them, children first."""
    found, stack = [], [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        h = xxhash.xxh64(node.tag)
        any_text = False
        for c in node.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little"))
                any_text |= c.hash & 1
            elif words := c.split():
                h.update(" ".join(words))
                any_text = True
        node.hash = h.intdigest() & ~1 | bool(any_text)  # the lowest bit says whether there is text
        if any_text and node is not root:
            found.append(node)
    return found


def blocks(start: list[Node], template: frozenset[int], inline: bool = True) -> list[str]:
    """Texts of the blocks under the given nodes, without dropped and template subtrees; inline: those of inline elements go, too."""
    out, open_block = [], []

    def end() -> None:
        if words := "".join(open_block).split():
            out.append(" ".join(words))
        open_block.clear()

    for top in start:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                open_block.append(x)
            elif not x.drop and (x.hash not in template or not inline and x.tag not in BLOCK):
                if x.tag in BLOCK:
                    end()
                    stack.append(None)
                stack += reversed(x.children)
        end()
    return out


def main_parts(root: Node, named: bool = False) -> list[Node]:
    """The outermost articles, else the outermost main parts, else the page; named: also those within what a class or id drops."""
    for least in (2, 1):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.drop and not (named and node.named):
                continue
            if node.main >= least:
                found.append(node)
            else:
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def subtree_hashes(html: str) -> set[int]:
    return {signed(x.hash) for x in hash_subtrees(parse(html or ""))}


def main_text(html: str, template=(), always=()) -> str:
    """Blocks of the main part, joined by line feeds; template, always: signed hashes of subtrees to delete, from a whole page
    and from its article."""
    root = parse(html or "")
    parts, texts = main_parts(root), []
    if len(template) or len(always):
        hash_subtrees(root)
    framed = main_parts(root, True) if parts[0] is root else []
    for own in (parts, framed) if len(framed) == 1 else (parts,):  # several are teasers
        article = own[0] is not root
        gone = frozenset(int(h) % (1 << 64) for h in (always if article else template))
        kept = "\n".join(blocks(own, gone, not article))
        if article and gone:
            all_of = "\n".join(blocks(own, frozenset()))
            kept = all_of if len(kept) < (1 - MOST_OF_ARTICLE) * len(all_of) else kept
        texts.append(kept)
    # a box whose class or id drops it may be the page's frame: then its article is longer than what is left around it
    return max(texts, key=len)


def template_of_pages(pages: DataFrame) -> DataFrame:
    """_p, _h, _template, _always: page, host, the hashes of each page that are template on its host, and those on all of its pages."""

    def emit(batches):
        for pdf in batches:
            yield pd.DataFrame({"_page": pdf["_page"], "_host": pdf["_host"], "_hashes": [[*subtree_hashes(h)] for h in pdf["html"]]})

    kind = pages.schema["_page"].dataType.simpleString()
    own = cut(pages.select("_page", "_host", "html").mapInPandas(emit, f"_page {kind}, _host string, _hashes array<long>"), "subtrees")
    seen = own.select("_page", "_host", F.explode("_hashes").alias("_hash"))
    sizes = own.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    common = seen.groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= LEAST_PAGES)
    common = common.join(sizes, "_host").filter(F.col("_n") >= LEAST_SHARE * F.col("_pages"))
    common = common.select("_host", "_hash", (F.col("_n") == F.col("_pages")).alias("_all"))
    hashes = [F.collect_set("_hash").alias("_template"), F.collect_set(F.when(F.col("_all"), F.col("_hash"))).alias("_always")]
    found = seen.join(common, ["_host", "_hash"]).groupBy("_page", "_host").agg(*hashes)
    found = cut(found.select(F.col("_page").alias("_p"), F.col("_host").alias("_h"), "_template", "_always"), "template")
    forget(own)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null and empty html give an empty text, as does a page without main text. Hosts are compared in lower case; pages with
    a null or odd url share the empty host. Rows of one id are extracted one by one; a null id is an id of its own. An empty
    table gives no rows; other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").alias("_page"),
        F.col("url").alias("_url"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("_host"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    found = template_of_pages(rows)
    hashes = found.agg(F.sum(F.size("_template") + F.size("_always") + 4).alias("n")).first()["n"] or 0
    found = F.broadcast(found) if hashes <= BROADCAST_HASHES else found
    rows = rows.join(found, F.col("_page").eqNullSafe(F.col("_p")) & (F.col("_host") == F.col("_h")), "left")

    def run(batches):
        for pdf in batches:
            known = ((() if t is None else t, () if a is None else a) for t, a in zip(pdf["_template"], pdf["_always"], strict=True))
            text = [main_text(h, *k) for h, k in zip(pdf["html"], known, strict=True)]
            yield pd.DataFrame({"page_id": pdf["_page"], "url": pdf["_url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("_page", "_url", "html", "_template", "_always").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
