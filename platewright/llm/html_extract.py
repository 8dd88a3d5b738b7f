"""Main text of web pages by site template removal.

Every page is parsed into elements; a subtree's hash covers its tag, attributes' names, text and
children.  Spark counts with how many different page contents of its host each subtree occurs, and
subtrees that recur across many of them are deleted.  Elements that are page furniture by their tag, role or
class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) go
whether or not they recur.  Of the rest the article is taken: the content of the outermost
`article` or `main` elements, or the whole body of a page that has none.  Names, roles and forms only
assist: where they would leave no article, elements around one stay, and an article keeps its own
headings whatever their element is called.  Inside an article a name counts only as a whole: a block
`share-price` is the article's own unless the counts say that it recurs on the host.

Paragraphs, headings and inline elements inside an article are never counted as template: pages
may quote or repeat each other.  Pages of a host with equal text but for furniture are copies and
count as one page, that of the least list of subtrees.  A subtree recurs when it is on at least
MIN_PAGES of these pages and on MIN_SHARE of them.

Defined results: null or empty html gives an empty text; a null or unreadable url is a host of its
own (the empty one); unclosed and misplaced tags are repaired as browsers do for paragraphs and
lists; a tag that is never closed is text, and a stray quote opens nothing; pages of any length are
taken whole; repeated rows give repeated results and count as one page; a page_id on several pages is no
page by itself: each row is judged by its own html and host.  An empty table gives no rows; columns
but the id, the url and the html are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm._shared import BROADCAST_BYTES, removed, written
from platewright.llm._text import slices

MIN_PAGES, MIN_SHARE = 5, 0.1

#: Attributes as a browser's tokeniser takes them: a quote opens a value only right behind the equals sign and if it is closed again.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_ATTRIBUTES = rf"(?:[\s/]++|=?[^\s/>=]++(?:{_VALUE})?+|=)*+"
#: Comments, marked sections, declarations and tags; a tag that never ends is text.
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>{_ATTRIBUTES})>", re.S)
ATTRIBUTE = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEVEL_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# What marks page furniture.
FURNITURE = set("nav header footer aside form script style noscript template iframe svg button select textarea input dialog menu head title object embed canvas audio video search".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar|side-?bar|footer|header|masthead|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|widget|skip-?links?|copyright|toolbar)(?:$|[-_\s])", re.I)
MAIN = {"article", "main"}
CONTENT = set("p h1 h2 h3 h4 h5 h6 b i em strong a span code q cite small sub sup u s mark time abbr blockquote pre li dt dd".split())


class Element:
    __slots__ = ("tag", "names", "drop", "soft", "children", "main")

    def __init__(self, tag: str, names: tuple = (), drop: bool = False, main: bool = False, soft: bool = False):
        self.tag, self.names, self.drop, self.soft, self.main, self.children = tag, names, drop, soft, main, []


#: Names that an article's own heading may have too.
HEADINGS = re.compile(r"(?:^|[-_\s])(?:header|masthead|banner|nav\w*)(?:$|[-_\s])", re.I)
#: Words beside a name that leave it furniture; with any other word (share-price) a block inside an article is its own.
BESIDE = set("area bar block blocks body box button buttons container content count form group holder icon icons inner item items link links list main outer panel post posts row section slot stories thread title tools top bottom unit wrap wrapper zone".split())


def named(name: str) -> bool:
    """Whether a class or id inside an article names furniture as a whole: all its parts are such names or words beside them."""
    for token in name.split():
        rest = HEADINGS.sub(" ", HEADINGS.sub(" ", token))
        parts = [p for p in re.split(r"[-_\s]+", rest.lower()) if p]
        known = [bool(NAMES.search(p)) for p in parts]
        if any(known) and all(k or p in BESIDE for k, p in zip(known, parts, strict=True)):
            return True
        if rest == token and NAMES.fullmatch(token):
            return True
    return False


def furniture(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether only a name, a role or a form says so."""
    if tag in FURNITURE:
        return not (tag == "header" and in_main), tag == "form"  # an article's own heading stays
    if tag in ("html", "body"):
        return False, False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True, False
    if attributes.get("role", "").lower() in ROLES:
        return True, True
    if "class" not in attributes and "id" not in attributes:
        return False, False
    name = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
    found = named(name) if in_main else bool(NAMES.search(name))
    return found, found


def parse(source: str) -> Element:
    """Element tree; text is kept as decoded strings among the children."""
    root = Element("html")
    stack, at = [root], 0
    opened, mains = Counter(), 0  # open elements by tag, and those that are main
    articles = hidden = False

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw))

    def close(tag: str, until: set = frozenset()) -> None:
        nonlocal mains
        if not opened[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                for e in stack[i:]:
                    opened[e.tag] -= 1
                    mains -= e.main
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    while m := MARKUP.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            stack[-1].children.append(m["cdata"])
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            close(tag, {"td", "th", "table"} if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "html", "body") else frozenset())
            continue
        if tag in CLOSES_P:
            close("p", {"td", "th", "button", "object"})
        for other in SAME_LEVEL.get(tag, ()):
            close(other, LEVEL_ENDS[tag])
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m["rest"])} if m["rest"].strip(" /\n\t") else {}
        drop, soft = furniture(tag, attributes, mains > 0)
        element = Element(tag, tuple(sorted(attributes)), drop, tag in MAIN or attributes.get("role", "").lower() == "main", soft)
        stack[-1].children.append(element)
        articles, hidden = articles or element.main, hidden or (drop and soft)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if tag in ("textarea", "title"):
                element.children.append(entities.unescape(source[at : end.start() if end else len(source)]))
            at = end.end() if end else len(source)
        elif tag not in VOID:
            stack.append(element)
            opened[tag] += 1
            mains += element.main
    text(source[at:])
    if articles and hidden:
        keep_around_articles(root)
    return root


def keep_around_articles(root: Element) -> None:
    """If names, roles and forms would leave no article, elements around one stay."""
    around, hidden = [], []  # soft elements around an article; articles that nothing hides
    stack: list[tuple[Element, Iterator, tuple[Element, ...], bool]] = [(root, iter(root.children), (), False)]
    while stack:
        _, children, soft, hard = stack[-1]
        for c in children:
            if isinstance(c, str):
                continue
            own = (*soft, c) if c.drop and c.soft else soft
            gone = hard or (c.drop and not c.soft)
            if c.main and not gone:
                (around if own else hidden).append((c, own))
            stack.append((c, iter(c.children), own, gone))
            break
        else:
            stack.pop()
    if not hidden:
        for _, own in around:
            for e in own:
                e.drop = False


def squeeze(s: str) -> str:
    return " ".join(s.split())


def hashes(root: Element) -> dict[int, int]:
    """Hash of each subtree that may be template, by element id; subtrees without text have none."""
    out: dict[int, int] = {}

    # elements under way: what is left of their children, these children's digests, whether they have text, whether in main
    stack = [(root, iter(root.children), [], [False], root.main)]
    while stack:
        e, children, held, some, inside = stack[-1]
        for c in children:
            if isinstance(c, str):
                s = squeeze(c)
                some[0] = some[0] or bool(s)
                held.append(s.encode())
            else:
                stack.append((c, iter(c.children), [], [False], inside or c.main))
                break
        else:
            stack.pop()
            digest = blake2b(b"\0".join([e.tag.encode(), *(p.encode() for p in e.names), b"", *held]), digest_size=8).digest()
            if some[0] and not e.main and e.tag not in ("html", "body") and not (inside and e.tag in CONTENT) and e.tag not in RAW:
                out[id(e)] = int.from_bytes(digest, "little", signed=True)
            if stack:
                stack[-1][2].append(digest)
                stack[-1][3][0] = stack[-1][3][0] or some[0]
    return out


def subtrees(source: str | None) -> tuple[list[int], bytes]:
    """Subtrees that may be template, and the digest of the text without furniture."""
    root = parse(source or "")
    return sorted(set(hashes(root).values())), blake2b(text_of(root, set()).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def main_text(source: str | None, template: set[int]) -> str:
    """Blocks of the article, without furniture and without subtrees in `template`."""
    return text_of(parse(source), template) if source else ""


def text_of(root: Element, template: set[int]) -> str:
    mark = hashes(root) if template else {}
    gone = lambda e: e.drop or mark.get(id(e)) in template if template else e.drop

    def mains(e: Element) -> list[Element]:
        found, left = [], [e]
        while left:
            here = left.pop()
            if here.main and here is not e:
                found.append(here)
            else:
                left += [c for c in reversed(here.children) if not isinstance(c, str) and not gone(c)]
        return found

    blocks, line = [], []

    def end() -> None:
        if s := squeeze("".join(line)):
            blocks.append(s)
        line.clear()

    def walk(e: Element) -> None:
        left = [(e, iter(e.children))]
        while left:
            here, children = left[-1]
            for c in children:
                if isinstance(c, str):
                    line.append(c)
                    continue
                if c.tag in BLOCKS:
                    end()
                if not gone(c):
                    left.append((c, iter(c.children)))
                    break
            else:
                left.pop()
                if left and here.tag in BLOCKS:
                    end()

    for e in mains(root) or [root]:
        walk(e)
        end()
    return "\n".join(blocks)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """`key`, `url` and text of every row of `pages`."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    kind, url_kind = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    base = pages.select(F.col(key), F.col(url), F.col(html), host.alias("host"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                found, content = zip(*map(subtrees, part.column(html).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("host"), pa.array(content, pa.binary()), pa.array(found, pa.list_(pa.int64()))], [key, "host", "content", "subtrees"])

    # read three times: pages are parsed once for it
    parsed, path = written(base.select(key, "host", html).mapInArrow(seen, f"`{key}` {kind}, host string, content binary, subtrees array<long>"), "subtrees")
    counted = parsed.groupBy("host", "content").agg(F.min("subtrees").alias("subtrees")).select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("on")).where(F.col("on") >= min_pages)
    sizes = parsed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("size"))
    recurring = counted.join(sizes, "host").where(F.col("on") >= min_share * F.col("size")).select("host", "subtree")
    # subtrees recur on a tenth of a host's pages, so a host has ten times those of a page at most
    if recurring.count() * 40 <= BROADCAST_BYTES:
        known: dict[str, set[int]] = {}
        for row in recurring.toLocalIterator():
            known.setdefault(row["host"], set()).add(row["subtree"])
        removed(pages.sparkSession, path)
        template = pages.sparkSession.sparkContext.broadcast(known)
        joined = base.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        template = None
        each = parsed.select(key, "host", F.explode("subtrees").alias("subtree"))
        mine = each.join(recurring, ["host", "subtree"]).groupBy(F.col(key).alias("_key"), F.col("host").alias("_host")).agg(F.collect_set("subtree").alias("template"))
        joined = base.join(mine, F.col(key).eqNullSafe(F.col("_key")) & (F.col("host") == F.col("_host")), "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                hosts, own = part.column("host").to_pylist(), part.column("template").to_pylist()
                found = [template.value.get(h, set()) for h in hosts] if template else [set(t or ()) for t in own]
                texts = [main_text(s, t) for s, t in zip(part.column(html).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column(url), pa.array(texts, pa.string())], [key, url, "text"])

    return joined.select(key, url, html, "host", "template").mapInArrow(take, f"`{key}` {kind}, `{url}` {url_kind}, text string")
