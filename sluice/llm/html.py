"""HTML extraction by deducing the template that pages of one host share.

Every page is read into tokens: tags with their place in the page's tree, and pieces of text with theirs. Tokens of a
host with the same occurrence vector (as many times on the same pages) form an equivalence class; the vectors are
compared by order-free sums of hashes, so that no host's pages meet in one task, and pages of equal html count once. A class is valid if it
has enough support and tokens, if its tokens stand in one order on all its pages, and if it nests: its tokens lie in one
class, its parent, or in the class itself, but for the outermost class, which holds the root. The valid classes are the host's template, a tree by their parents. A piece of text is part of the
template if its class is valid and holds on most pages that have the element around it, which is asked of that element
and not of the host, as a host may have several layouts. All other text are the slots.

The main text are the slots of the page's article (or main) element, or, without one, all slots of the body, without
those in menus, headers, footers, sidebars, notices, adverts, forms, comments and the like, which tags and
names tell: no template can, since their text may differ from page to page. Names say nothing of the elements around the page's longest
article. If the template's text makes up more than half of an article, or all text of a page without one, pages are
copies of each other, and all of it counts as text.

The texts to take away are found for each page by joining its own tokens with the template, so that no list grows with a
host.

Edge cases: null and empty html give an empty text; a page alone on its host has no template, and its tags
decide; unclosed and unmatched tags are closed by what follows; repeated page_ids are ordinary rows; a null
url is a host of its own; an empty table gives an empty result; columns of other names are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import stored

#: Least pages of a class; least share of the pages with the element around it that have a template text; least tokens of a class.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 3, 0.8, 2
#: At most this many template texts on pages are broadcast; more are joined by page.
BROADCAST_TOKENS = 500_000

# The parts of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes template".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "body", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"article", "section", "div", "td", "th", "li", "main", "body"}}
OUTSIDE = set("nav footer aside head select menu datalist".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar status".split())
#: An element is outside if a name of its class or id consists of these words, beside those of AROUND and numbers.
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar sidebars footer "
    "comment comments disqus respond cookie cookies consent gdpr notice notices newsletter subscribe subscription signup share sharing social related "
    "breadcrumb breadcrumbs popup modal widget widgets pagination pager toolbar masthead skip login".split()
)
AROUND = set(
    "area bar block body bottom box button buttons col column container feed first form global group holder icon icons inner item items last left line link links list "
    "main media message panel post posts primary region right row secondary section site slot sticky text thread top unit wrap wrapper".split()
)
#: Words that hold for an element even if an article is inside it.
COMMENTS = set("comment comments disqus respond related".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

PART = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?=[/A-Za-z])[^<>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """An element. hard: it is outside in any case; soft: unless it is around the page's longest article. mixed: soft, but its names hold words for content too."""

    __slots__ = ("tag", "path", "above", "article", "header", "hard", "soft", "mixed", "comments", "outside")

    def __init__(self, tag: str, path: int, above: Node | None):
        self.tag, self.path, self.above = tag, path, above
        self.article = self.header = self.hard = self.soft = self.mixed = self.comments = self.outside = False


def _opened(tag: str, attributes: str, above: Node) -> Node:
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in NAMED.finditer(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "")
    node = Node(tag, xxhash.xxh3_64_intdigest(f"{tag}.{names.strip()}", above.path), above)
    roles, mixed = set(), True
    for name in names.split():
        words = {w for w in SPLIT.split(name) if w and not w.isdigit()}
        if words <= WORDS | AROUND and words & WORDS:
            roles |= words & WORDS
            mixed &= bool(words & AROUND)
    node.article = above.article or tag in ("article", "main") or role == "main" or found.get("itemprop") == "articlebody"
    node.header = above.header or tag == "header" or "header" in names.split() and not above.article
    node.hard = tag in OUTSIDE or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    node.soft = tag == "form" or role == "form" or bool(roles) and tag not in ("html", "body")
    node.mixed = node.soft and mixed and tag != "form"
    node.comments = above.comments or above.hard or node.hard or bool(roles & COMMENTS)
    return node


def _settled(nodes: list[Node], blocks: list[tuple[Node, str]]) -> None:
    """Which elements are outside. The longest article that is not itself a comment or the like is never so by names.

    On a page without article tags, an element whose names speak for content as well is not outside by them if most of the page's text lies in it.
    """
    sizes: dict[int, int] = {}
    roots: dict[int, Node] = {}
    for node, text in blocks:
        if node.article and not node.comments:
            while node.above.article:
                node = node.above
            sizes[id(node)] = sizes.get(id(node), 0) + len(text)
            roots[id(node)] = node
    line = set()
    if sizes:
        node = roots[max(sizes, key=sizes.__getitem__)]
        while node is not None:
            line.add(id(node))
            node = node.above
    elif any(node.mixed for node in nodes):
        line = _around_most(blocks)
    for node in nodes:
        node.outside = node.above.outside or node.hard or node.soft and id(node) not in line


def _around_most(blocks: list[tuple[Node, str]]) -> set[int]:
    """The soft elements that hold more than half of the text which is not outside in any case, from the outermost on, as long as their names are mixed."""
    held: dict[int, tuple[Node, int]] = {}
    total = 0
    for node, text in blocks:
        soft = []
        if node.comments:
            continue
        total += len(text)
        while node is not None:
            if node.soft:
                soft.append(node)
            node = node.above
        for x in soft:
            held[id(x)] = (x, held.get(id(x), (x, 0))[1] + len(text))
    return {i for i, (x, n) in held.items() if x.mixed and 2 * n > total}


def read_page(html: str) -> tuple[list[tuple[Node, str]], list[tuple[int, int, int]]]:
    """The blocks of text with the node that holds them, and all tokens in page order.

    A token is its number, the number of the tag around it, and the number of its block (-1: a tag).
    """
    root = Node("", 0, None)
    stack, nodes, blocks, tokens, text = [root], [], [], [], []
    at, n = 0, len(html)

    def flush() -> None:
        if text:
            joined = SPACE.sub(" ", unescape("".join(text))).strip()
            if joined:
                tokens.append((_text_token(stack[-1], joined), _signed(stack[-1].path), len(blocks)))
                blocks.append((stack[-1], joined))
            text.clear()

    def pop_to(names: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                flush()
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while at < n:
        m = PART.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            elif tag in ("td", "th"):
                text.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if stack[i].hard or stack[i].soft:
                        flush()
                    del stack[i:]
                    break
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in SIBLINGS:
            pop_to(SIBLINGS[tag], SCOPES[tag])
        if tag in CLOSES_P:
            pop_to({"p"}, SCOPES["p"])
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th", "wbr"):
            text.append("" if tag == "wbr" else " ")
        if tag in VOID:
            continue
        node = _opened(tag, m[3], stack[-1])
        if node.hard or node.soft:
            flush()
        tokens.append((_signed(node.path), _signed(stack[-1].path), -1))
        stack.append(node)
        nodes.append(node)
    flush()
    _settled(nodes, blocks)
    return blocks, tokens


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _text_token(node: Node, text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text, node.path))


def main_text(blocks: list[tuple[Node, str]], template: set[int]) -> str:
    """The slots that belong to the article, in page order."""
    inside = [(b, t) for b, t in blocks if b.article and not b.outside and (not b.header or b.tag in HEADINGS)]
    if not inside and not any(b.article and not b.outside for b, _ in blocks):
        inside = [(b, t) for b, t in blocks if not b.outside and not b.header]
    own = [_text_token(b, t) not in template for b, t in inside]
    slots = [t for (_, t), mine in zip(inside, own) if mine]
    # an article that opens with a text of the template, and has no heading of its own, is a copy of others; without headings, one whose own texts have no letters
    titles = [mine for (b, _), mine in zip(inside, own) if b.tag in HEADINGS]
    copied = not any(titles) and not own[0] if titles else not any(c.isalpha() for t in slots for c in t)
    return "\n\n".join([t for _, t in inside] if copied else slots)


def page_tokens(html: str) -> dict[int, list]:
    """Each token with how often it occurs, whether it is text, the tag around it, and its first place; of texts, only those inside."""
    blocks, tokens = read_page(html)
    found: dict[int, list] = {}
    for place, (token, parent, block) in enumerate(tokens):
        if block < 0 or not blocks[block][0].outside:
            found.setdefault(token, [0, block >= 0, parent, place])[0] += 1
    return found


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for host, page, html in zip(batch["host"].to_pylist(), batch["page"].to_pylist(), batch["html"].to_pylist()):
            rows.extend((host, page, token, *facts) for token, facts in page_tokens(html or "").items())
        if rows:
            columns = list(zip(*rows))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "page", "token", "times", "is_text", "parent", "place"])


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    return pages.select("page_id", "url", "html", host.alias("host")).withColumn("page", F.xxhash64("host", "html"))


def tokens_of(pages: DataFrame) -> DataFrame:
    """host, page (a hash of host and html), token, times, is_text, parent and place; pages of equal html on a host are one."""
    fields = "host string, page long, token long, times long, is_text boolean, parent long, place long"
    return _hosted(pages).select("host", "page", "html").mapInArrow(_tokens, fields).dropDuplicates(["host", "page", "token"])


def _half_sums(x: Column) -> Column:
    """Sums of the halves of 64-bit hashes: like a sum, the same in any order, but without overflow."""
    return F.struct(F.sum(F.shiftrightunsigned(x, 32)).alias("high"), F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))


def templates(tokens: DataFrame, *, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """host, class, inside, token, is_text, support, share and place of each token of a valid class.

    inside is the class that the class is nested in (null at the root), share that of the pages with the element around a text.
    """
    vectors = tokens.groupBy("host", "token").agg(
        _half_sums(F.xxhash64("page", "times")).alias("vector"), F.count("*").alias("support"), F.first("is_text").alias("is_text"), F.first("parent").alias("parent"), F.avg("place").alias("place")
    )
    vectors = stored(vectors.filter(F.col("support") >= least_pages).withColumn("class", F.xxhash64("host", "vector")).drop("vector"), "tokens")
    around = vectors.select("host", F.col("token").alias("parent"), F.col("class").alias("around"), F.col("support").alias("of"))
    placed = vectors.join(around.hint("merge"), ["host", "parent"], "left").withColumn("share", F.col("support") / F.coalesce("of", "support"))
    other = F.when(F.col("around") != F.col("class"), F.col("around"))
    # the outermost class has a token at the root; any other lies in one class besides itself
    outermost = F.count_if(F.col("around").isNull()) > 0
    classes = placed.groupBy("host", "class").agg(
        F.count("*").alias("n"), F.when(~outermost, F.min(other)).alias("inside"), (outermost | F.min(other).eqNullSafe(F.max(other))).alias("nested")
    )
    classes = stored(classes.filter((F.col("n") >= least_tokens) & F.col("nested")).select("host", "class", "inside"), "classes")
    members = placed.join(classes.hint("merge"), ["host", "class"])
    # in one order on all pages: the tokens of a class on a page are at most as many as the page has
    order = tokens.select("host", "token", "page", "place").withColumnRenamed("place", "at").join(members.select("host", "token", "class").hint("merge"), ["host", "token"])
    order = order.groupBy("class", "page").agg(F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])).alias("order"))
    ordered = order.groupBy("class").agg(F.min("order").alias("a"), F.max("order").alias("b")).filter("a = b").select("class")
    valid = members.join(ordered.hint("merge"), "class", "left_semi")
    return valid.select("host", "class", "inside", "token", "is_text", "support", "share", "place").filter(~F.col("is_text") | (F.col("share") >= least_share))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, slots = [], []
        for html, constant in zip(batch["html"].to_pylist(), batch["constant"].to_pylist()):
            blocks, _ = read_page(html or "")
            template = set(constant or ())
            texts.append(main_text(blocks, template))
            slots.append(sum(not b.outside and _text_token(b, t) not in template for b, t in blocks))
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(slots, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_slots"])


def extract(pages: DataFrame, **options) -> DataFrame:
    """Each page's main text, its code points and its number of slots."""
    pages = pages.select("page_id", "url", "html")
    tokens = stored(tokens_of(pages), "page-tokens")
    texts = templates(tokens, **options).filter("is_text").select("host", "token")
    mine = tokens.filter("is_text").select("host", "token", "page").join(texts.hint("merge"), ["host", "token"])
    # at most as many as a page has pieces of text
    constant = stored(mine.groupBy("page").agg(F.collect_list("token").alias("constant")), "template-texts")
    size = constant.agg(F.sum(F.size("constant")).alias("n")).first().n or 0
    rows = _hosted(pages).join(F.broadcast(constant) if size <= BROADCAST_TOKENS else constant.hint("merge"), "page", "left")
    id_type = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "constant").mapInArrow(_extracted, f"page_id {id_type}, url string, text string, n_chars long, n_slots long")
