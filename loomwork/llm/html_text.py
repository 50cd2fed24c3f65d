"""Main-text extraction by consensus host paths.

Each page is parsed once to score its containers: text blocks give points for length and commas, less for links, to
their container and half of it to the one above, and all points inside an article element are its own. Spark sums the
points by host and generalised path (tags with their classes, digits as #) and the path with the most points wins the
host. Pages are then read again: the text below the winning path is the article, or below the page's own best container
where the host's path does not occur.

Tags, roles and names of elements tell menus, headers, adverts, comments and the like. Only what says so as a whole
("sidebar", "comment-list") is dropped outright, and not where the page's only article stands in it; where a noise word
stands beside others ("share-story", "search-page"), what the element holds decides: see name_doubt and _decide.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, beside, frees, table
from .url_rules import host_of

#: Elements that end a block of text where they start and where they end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text to read.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object video audio canvas select button".split())
NOISE_TAGS = frozenset("nav footer aside head dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of classes and ids that mark what is no article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner banners sponsor sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist disqus reply replies respond related recommended pagination pager toolbar login search".split()
)
#: These mark what is no article unless an article holds them.
OUTER_WORDS = frozenset("header headers top topbar".split())
#: Words that name a part of a page or its place, and so leave the noise word beside them what it is.
PARTS = frozenset("box slot section area wrap wrapper container block list item items panel inner outer bar buttons button icons icon link links unit left right bottom center column col row rail zone group holder region module posts articles primary secondary body text title heading form small wide fixed sticky depth odd even thread author meta".split())
#: Words that say that what follows or precedes is not there, or is but a state.
DENIALS = frozenset("no not non without with has have free off on open opened closed enabled disabled allowed status hide show active".split())
#: Names of what holds an article.
CONTENT = frozenset("content article story post entry main body text main-content article-body post-content entry-content story-body article-content post-body hentry".split())
FORMAT = frozenset("b i em strong u s small big font mark sub sup code tt strike cite q abbr a kbd samp var dfn ins del time bdi bdo ruby rt rp nobr acronym br".split())
#: An open element on the left ends where one on the right starts.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_SHOW = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD, _DIGITS, _CAMEL = re.compile(r"[a-z0-9]+"), re.compile(r"[0-9]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements whose own text is read as it stands: of these only names that are noise as a whole count.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figure figcaption table tr tbody ul ol dl".split())

LONG_PATH = 2000

SOUND, DOUBTFUL, SUSPECT, NOISE = 0, 1, 2, 3


class Element:
    """An open or closed element: `doubt` is what its own tag and names say, `noise` what has been decided of it and what holds it."""

    __slots__ = ("tag", "path", "doubt", "noise", "inside", "parent", "own", "size", "score", "full", "first")

    def __init__(self, tag, path, doubt, hidden, inside, parent):
        self.tag, self.path, self.doubt, self.noise, self.inside, self.parent = tag, path, doubt, hidden, inside, parent
        self.own, self.size, self.score, self.full, self.first = 0, 0, 0.0, 0.0, None


def name_doubt(names: str, words: frozenset = NOISE_WORDS) -> int:
    """What the names in a class or id say: noise if one of them consists of noise words and of words for parts of a page, suspect if it ends with a noise word ("post-comments"), doubtful if noise words stand beside others ("share-story"), else nothing ("comments-open")."""
    worst = SOUND
    for name in names.split():
        parts = _WORD.findall(_CAMEL.sub("-", name).lower())
        if not any(p in words for p in parts) or any(p in DENIALS for p in parts):
            continue
        if all(p in words or p in PARTS or p.isdigit() for p in parts):
            return NOISE
        worst = max(worst, SUSPECT if parts[-1] in words else DOUBTFUL)
    return worst


def _attributes(attrs: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs else {}


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_NO_SHOW.search(found.get("style", "")))


def _open(tag: str, found: dict[str, str], parent: Element) -> Element:
    classes = sorted({_DIGITS.sub("#", c) for c in found.get("class", "").lower().split()})
    hidden = parent.noise or tag not in ("html", "body") and _hidden(found)
    doubt = SOUND
    if tag not in ("html", "body", "main"):
        names = f"{found.get('class', '')} {found.get('id', '')}"
        doubt = max(name_doubt(names), SOUND if parent.inside else name_doubt(names, OUTER_WORDS))
        if doubt and doubt < NOISE and (tag == "article" or tag in LEAVES):
            doubt = SOUND
        elif doubt and any(n.lower() in CONTENT for n in names.split()):
            doubt = DOUBTFUL
        if tag in NOISE_TAGS or found.get("role", "").lower() in NOISE_ROLES or tag == "header" and not parent.inside:
            doubt = NOISE
        if tag in ("form", "fieldset"):  # one round the whole page is none
            doubt = max(doubt, DOUBTFUL)
    inside = parent.inside or tag in ("article", "main") and doubt == SOUND
    path = f"{parent.path}>{tag}" + "".join(f".{c}" for c in classes)
    if len(path) > LONG_PATH:  # deep pages must not hold long paths at each level: the path so far is replaced by its hash
        path = f"#{xxhash.xxh3_128_hexdigest(path.encode('utf-8', 'surrogatepass'))}"
    return Element(tag, path, doubt, hidden, inside, parent)


def _above(elements) -> set[int]:
    """The identities of the elements and of all that hold them."""
    seen: set[int] = set()
    for e in elements:
        while e is not None and id(e) not in seen:
            seen.add(id(e))
            e = e.parent
    return seen


def _decide(elements: list[Element]) -> None:
    """Sets noise. Elements stand in page order, so a parent comes before what it holds.

    What is called noise is noise, unless the page has articles and all of them stand inside such elements: then those
    that hold one are sound. What is suspect is noise if it holds no article and no h1; what is doubtful is so if it
    holds no article and no more than half of the text that is not noise. A form is also noise where the page's h1 stands
    outside it.
    """
    articles = [e for e in elements if e.tag in ("article", "main") and e.doubt == SOUND and not e.noise]
    holds = _above(articles)
    called = set()
    for e in elements:
        if e.doubt == NOISE or e.parent is not None and id(e.parent) in called:
            called.add(id(e))
    titled = _above(e for e in elements if e.tag == "h1" and not e.noise and id(e) not in called)
    free = bool(articles) and all(id(e) in called for e in articles)
    for e in elements:
        e.noise = e.noise or e.parent is not None and e.parent.noise or e.doubt == NOISE and not (free and id(e) in holds)
    for e in reversed(elements):
        e.size += 0 if e.noise else e.own
        if e.parent is not None:
            e.parent.size += e.size
    whole = elements[0].size
    for e in elements:
        if e.noise or id(e) in holds:
            e.noise = e.noise or e.parent is not None and e.parent.noise
        else:
            e.noise = e.parent is not None and e.parent.noise or (e.doubt == SUSPECT or e.tag == "form" and bool(titled)) and id(e) not in titled or e.doubt == DOUBTFUL and 2 * e.size <= whole


def _read(html: str) -> tuple[list[Element], list[list[tuple[str, Element, bool]]]]:
    """(elements in page order, blocks): a block is its pieces of text, each with the element that holds it and whether it is a link's."""
    root = Element("", "", SOUND, False, False, None)
    stack, elements, out, text, link, at = [root], [root], [], [], False, 0
    size, last, opened = len(html), html.rfind(">"), Counter()

    def pop(k):
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def flush():
        nonlocal text
        if text:
            out.append(text)
            text = []

    while at < size:
        lt = html.find("<", at)
        end = size if lt < 0 else lt
        if end > at and not stack[-1].noise:
            text.append((html[at:end], stack[-1], link))
            stack[-1].own += end - at
        if lt < 0:
            break
        m = _TOKEN.match(html, lt) if lt < last or html.startswith("<!--", lt) else None
        if m is None:  # no tag: the sign itself
            if not stack[-1].noise:
                text.append(("<", stack[-1], link))
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            text.append((" ", stack[-1], False))
            continue
        if tag == "a":
            link = not closing
        if tag in BLOCKS:
            flush()
            link = False
        if closing:
            if tag in FORMAT and stack[-1].tag not in FORMAT:
                continue
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    pop(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break  # the end of an inline element does not reach beyond its block
            continue
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            at = size if close is None else (html.find(">", close.end()) + 1 or size)
            continue
        for k in range(len(stack) - 1, 0, -1):
            if tag in CLOSES.get(stack[k].tag, ()):
                pop(k)
            elif stack[k].tag in SCOPES.get(tag, ()) or tag not in SCOPES or tag not in CLOSES:
                break
        if tag in VOID or attrs.endswith("/") or tag in FORMAT and not attrs:
            continue
        e = _open(tag, _attributes(attrs), stack[-1])
        if tag in FORMAT and e.doubt == SOUND and e.noise == stack[-1].noise:
            continue
        elements.append(e)
        stack.append(e)
        opened[tag] += 1
    flush()
    return elements, out


#: Elements whose text counts for what holds them.
_INNER = FORMAT | frozenset("p h1 h2 h3 h4 h5 h6 li span pre blockquote td dd dt".split())


def blocks(html: str) -> tuple[list[Element], list[tuple[str, Element]]]:
    """(elements, (text, container) of each block outside noise, in page order); points are added to the containers."""
    elements, raw = _read(html)
    _decide(elements)
    out = []
    for pieces in raw:
        kept = [x for x in pieces if not x[1].noise]
        if not (kept and (joined := " ".join(unescape("".join(x[0] for x in kept)).split()))):
            continue
        holder = e = kept[0][1]
        while e.parent is not None and e.tag in _INNER:
            e = e.parent
        out.append((joined, holder))
        linked = sum(len(x[0]) for x in kept if x[2])
        points = (1 + joined.count(",") + min(len(joined) / 100, 30)) * max(0.0, 1 - linked / len(joined))
        e.score += points
        e.full += points
        if e.parent is not None:
            e.parent.score += points / 2
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.full += e.full
    return elements, out


def container_scores(html: str) -> tuple[list, dict[str, float], Element | None, list[Element]]:
    """(blocks, points by path, the best container, elements).

    An article has one and a half times the points of all that it holds, a main element all of them, other elements those of their own
    blocks and half of those one below: so what stands beside an article's inner wrapper is not lost.
    """
    elements, found = blocks(html)
    best = None
    points: dict[str, float] = {}
    for e in elements:
        if e.parent is None or e.noise:
            continue
        s = 1.5 * e.full if e.tag == "article" else max(e.full, e.score) if e.tag == "main" else e.score
        if s <= 0:
            continue
        points[e.path] = points.get(e.path, 0.0) + s
        if best is None or (s, e.path) > best[0]:
            best = ((s, e.path), e)
    return found, points, best and best[1], elements


def _whole(e: Element, titled: set[int]) -> Element:
    """The article or main element that holds a container; without one, the container, or what holds it and a page heading and little else."""
    up = e
    while up.parent is not None:
        if up.tag in ("article", "main"):
            return up
        up = up.parent
    up = e
    while id(up) not in titled and up.parent is not None and up.parent.tag not in ("", "html", "body") and up.parent.full <= 1.3 * e.full:
        up = up.parent
    return up if id(up) in titled else e


def extract(html: str | None, path: str | None = None) -> str:
    """The article below the containers with the path, else below the page's best container, else all that is no noise."""
    found, _, best, elements = container_scores(html or "")
    won = [e for e in elements if e.path == path and not e.noise and e.full > 0] if path else []
    won = won or ([best] if best is not None else [])
    titled = _above(e for e in elements if e.tag == "h1" and not e.noise)
    below = {id(_whole(e, titled)) for e in won}
    for e in elements:
        if e.parent is not None and id(e.parent) in below:
            below.add(id(e))
    kept = [t for t, e in found if id(e) in below]
    return "\n\n".join(kept or [t for t, _ in found])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the most points over all pages of the host; ties go to the longer, then the greater path."""

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, s in container_scores(html or "")[1].items():
                    # whole thousandths, so that the order of addition does not matter
                    sums[host, path] = sums.get((host, path), 0) + round(s * 1000)
            if len(sums) > 100_000:
                yield pa.RecordBatch.from_pylist([{"host": h, "path": p, "points": s} for (h, p), s in sums.items()])
                sums = {}
        if sums:
            yield pa.RecordBatch.from_pylist([{"host": h, "path": p, "points": s} for (h, p), s in sums.items()])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = rows.mapInArrow(frees(run), "host string, path string, points long").groupBy("host", "path").agg(F.sum("points").alias("points"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("points", F.length("path"), "path")).alias("path"))


def article_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (the article's blocks, joined by two line ends; empty if none) and n_chars.

    A null page is empty; a null url, or one without "://", belongs to the host "". Rows are read one by one, so repeated
    ids and rows are as good as others, though each votes; of paths with equal points the longer, then the greater wins. An
    empty table gives an empty result. Other columns are ignored, whatever their names. A page is read in time and memory
    in proportion to its length, however deep.
    """
    scratch = Scratch(pages.sparkSession, "html")
    paths = beside(scratch.keep(host_paths(pages, url_col, html_col).withColumnRenamed("host", "_host").withColumnRenamed("path", "_path"), "paths"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("_host"))
    rows = rows.join(paths, "_host", "left").select("page_id", "url", "html", "_path")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [extract(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("_path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(frees(run), schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_texts(table(spark, sf_dir, "pages"))
