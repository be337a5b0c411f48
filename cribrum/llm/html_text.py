"""HTML extraction: tag-path ratios choose the content blocks of a page."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

OPENING = re.compile(r"</?([a-zA-Z][\w:-]*)|<[!?]")
#: What may end a tag, or open a quoted value in it.
IN_TAG = re.compile(r"=\s*([\"'])|[<>]")
ATTRIBUTE = re.compile(r"([\w-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

# Elements of the HTML standard by what they do to text.
#: Content of these is text up to their end tag, whatever it looks like.
UNPARSED = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Where the search for an open element of one's own kind ends.
LISTS = ("ul", "ol", "dl", "table", "tbody", "select")
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
APART = frozenset("nav footer aside form button select menu dialog head".split())
BODY_OF = frozenset("article main".split())
#: Text in these belongs to the container around them; every other block element is a container of its own.
FLOW = HEADINGS | frozenset("p ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th figure figcaption blockquote pre address details summary hgroup center".split())

# Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "header masthead footer sidebar aside widget related recommended share sharing social newsletter subscribe subscription signup login cookie cookies consent "
    "notice notices alert popup modal overlay comment comments discussion replies reply disqus respond form search complementary contentinfo".split()
)
#: Those of them that also set an article element apart: readers' comments and teasers are often articles.
ARTICLE_MARKS = frozenset("ad ads advert promo sponsored related recommended sidebar comment comments reply replies".split())
#: A container is content from this share of the best score.
CUT = 0.4
#: Priors: what the score of a path counts for that tags or class words set apart, inside an article element, and of a heading in it.
APART_PRIOR, ARTICLE_PRIOR, HEADING_PRIOR = 0.005, 2.0, 2.0
#: A container of so many blocks, of fewer characters each and without punctuation, is a menu, which nothing around it lifts.
MENU_BLOCKS, MENU_CHARS = 3, 8
#: What lifts nothing in it: the page as a whole.
WHOLE = frozenset(["", "html", "body"])


@dataclass
class Block:
    """A run of text: the number of its tag path, the path's last tag, and what priors and containers go by.

    ``box`` is the number of the nearest container.
    """

    path: int
    tag: str
    box: int
    apart: bool
    parts: list[str] = field(default_factory=list)


def _marked(attributes: str, marks: frozenset[str] = MARKS) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value:
            return True
        if name in ("class", "id", "role") and marks & set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _signature(tag: str, attributes: str) -> str:
    found = re.search(r"\bclass\s*=\s*[\"']?([\w-]+)", attributes)
    return f"{tag}.{found[1]}" if found else tag


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """Text as ("", text, False), tags as (name, attributes, whether it ends an element); comments and raw text are left out.

    In linear time: no search starts over what an earlier one has seen in vain.
    A quote opens a value only behind "=", and only if it is closed somewhere.
    """
    at, n = 0, len(page)
    unclosed = {"'": n, '"': n}
    while at < n:
        lt = page.find("<", at)
        lt = n if lt < 0 else lt
        found = OPENING.match(page, lt)
        if lt > at or not found:
            # A "<" that opens nothing is text.
            stop = lt if found or lt == n else lt + 1
            yield "", page[at:stop], False
            at = stop
            continue
        if not found[1]:
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", found.end())
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        stop = found.end()
        while True:
            mark = IN_TAG.search(page, stop)
            if not mark:
                at = stop = n
                break
            if not mark[1]:
                stop, at = mark.start(), mark.end() - (mark[0] == "<")
                break
            stop = mark.end()
            if stop < unclosed[mark[1]]:
                close = page.find(mark[1], stop)
                if close < 0:
                    unclosed[mark[1]] = stop
                else:
                    stop = close + 1
        tag, attributes = found[1].lower(), page[found.end() : stop]
        ends = page[lt + 1] == "/"
        if tag in UNPARSED and not ends and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        yield tag, attributes, ends


@dataclass
class Box:
    """A container element: the one around it (0: none), its tag, and the nearest article element (0: none)."""

    around: int
    tag: str
    article: int


@dataclass
class _Frame:
    tag: str
    path: int
    last: str
    box: int
    article: int
    apart: bool


class _Open:
    """The elements that are open, outermost first; finding the innermost of a name takes constant time."""

    def __init__(self):
        self.frames: list[_Frame] = []
        self.where: dict[str, list[int]] = {}
        self.paths: dict[tuple[int, str], int] = {}
        #: In page order, so outer ones first; the first stands for the page.
        self.boxes = [Box(0, "", 0)]

    def top(self) -> _Frame:
        return self.frames[-1] if self.frames else _Frame("", 0, "", 0, 0, False)

    def innermost(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def push(self, tag: str, signature: str, apart: bool) -> None:
        around = self.top()
        path, last, box, article = around.path, around.last, around.box, around.article
        if tag not in INLINE:
            path, last = self.paths.setdefault((path, signature), len(self.paths) + 1), tag
            if tag not in FLOW:
                article = len(self.boxes) if tag in BODY_OF else article
                self.boxes.append(Box(box, tag, article))
                box = len(self.boxes) - 1
        self.where.setdefault(tag, []).append(len(self.frames))
        self.frames.append(_Frame(tag, path, last, box, article, apart))

    def close(self, index: int) -> bool:
        """Close the elements from ``index`` on; whether any of them was a block."""
        wide = False
        while len(self.frames) > index >= 0:
            tag = self.frames.pop().tag
            self.where[tag].pop()
            wide |= tag not in INLINE
        return wide


def blocks(page: str) -> tuple[list[Block], list[Box]]:
    """The page's blocks of text in order, each with its root-to-leaf tag path, and the containers."""
    out: list[Block] = []
    stack = _Open()
    skip, depth, fresh = "", 0, True
    for tag, text, ends in tokens(page):
        if skip:
            if tag == skip:
                depth += -1 if ends else not text.rstrip().endswith("/")
                skip = skip if depth else ""
            continue
        if not tag:
            if stack.innermost("head") < 0:
                top = stack.top()
                # An inline element that is set apart (a marked span) is a block of its own.
                if fresh or not out or out[-1].apart != top.apart:
                    out.append(Block(top.path, top.last, top.box, top.apart))
                    fresh = False
                out[-1].parts.append(text)
            continue
        if ends:
            fresh |= stack.close(stack.innermost(tag))
            continue
        if tag in RAW:
            if not text.rstrip().endswith("/"):
                skip, depth = tag, 1
            continue
        if tag == "br":
            if out and not fresh:
                out[-1].parts.append(" ")
            continue
        if tag in VOID:
            fresh |= tag == "hr"
            continue
        if tag == "body":
            stack.close(stack.innermost("head"))
        if tag in ENDS_P:
            stack.close(stack.innermost("p"))
        if tag in OWN_KIND:
            own = stack.innermost(*OWN_KIND[tag])
            if own > stack.innermost(*LISTS):
                stack.close(own)
        inside, apart = stack.top().article > 0 or tag in BODY_OF, stack.top().apart
        if tag in BODY_OF:
            apart |= _marked(text, ARTICLE_MARKS)
        elif tag not in ("html", "body"):
            # Inside an article a "header" is its headline.
            apart |= tag in APART or _marked(text, MARKS - {"header", "masthead"} if inside else MARKS)
        # The header of an article holds its headline; other headers are the site's.
        if tag == "header":
            apart |= not inside
        stack.push(tag, _signature(tag, text), apart)
        fresh |= tag not in INLINE
    return out, stack.boxes


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _smooth(x: list[float], of: list[int]) -> list[float]:
    """Each value with its neighbours, as far as these belong to the same; values at an end count for the missing one."""
    n = len(x)
    sides = [[x[j] if 0 <= j < n and of[j] == of[i] else x[i] for j in (i - 1, i + 1)] for i in range(n)]
    return [0.5 * own + 0.25 * sum(two) for own, two in zip(x, sides)]


def extract(page: str) -> str:
    """The main text of one page.

    For each tag path the ratios text length / blocks and punctuation / blocks are
    smoothed over neighbouring paths, in page order, that begin in one container, and
    fused.  The score of a path is that times a prior: tags and class words that set
    text apart from the article (navigation, forms, adverts, comments) count little,
    an article element and the headings in it more.  The score of a container is the
    mean of its paths' by their text; containers in it, or in one article element, that
    are not set apart or menus are lifted to it.  Containers are content from a share
    of the best score, with all of their blocks.
    """
    all_blocks, boxes = blocks(page)
    found = [(b, t) for b in all_blocks if (t := _clean(b.parts))]
    if not found:
        return ""

    def path_of(b: Block) -> tuple[int, str, bool, bool]:
        return b.path, b.tag, boxes[b.box].article > 0, b.apart

    # Text, punctuation and blocks by path, and the container in which the path begins.
    paths: dict[tuple[int, str, bool, bool], list[int]] = {}
    for b, t in found:
        row = paths.setdefault(path_of(b), [0, 0, 0, b.box])
        row[0] += len(t)
        row[1] += sum(map(t.count, ".,;:!?"))
        row[2] += 1
    has_article = any(inside and not apart for *_, inside, apart in paths)

    def prior(tag: str, inside: bool, apart: bool) -> float:
        if apart:
            return APART_PRIOR
        heading = tag in HEADINGS and (inside or not has_article)
        return (ARTICLE_PRIOR if inside else 1.0) * (HEADING_PRIOR if heading else 1.0)

    begins = [row[3] for row in paths.values()]
    length = _smooth([chars / n for chars, _, n, _ in paths.values()], begins)
    points = _smooth([marks / n for _, marks, n, _ in paths.values()], begins)
    score = {key: a * (1 + b) * prior(*key[1:]) for key, a, b in zip(paths, length, points)}

    # Fused by container and whether it is set apart, and by article element: weighted scores, text, blocks, punctuation.
    fused: dict[tuple[int, bool], list[float]] = {}
    articles: dict[int, list[float]] = {}
    for b, t in found:
        sums = [fused.setdefault((b.box, b.apart), [0.0, 0, 0, 0])]
        if not b.apart and boxes[b.box].article:
            sums.append(articles.setdefault(boxes[b.box].article, [0.0, 0, 0, 0]))
        for row in sums:
            for i, x in enumerate((score[path_of(b)] * len(t), len(t), 1, sum(map(t.count, ".,;:!?")))):
                row[i] += x

    # What is not set apart is lifted by the container around it and by its article element.
    lifted: list[float] = []
    menus: set[int] = set()
    for at, box in enumerate(boxes):
        total, chars, n, marks = fused.get((at, False), (0.0, 0, 0, 0))
        own = total / max(1, chars)
        if box.tag not in BODY_OF and (box.around in menus or n >= MENU_BLOCKS and chars < MENU_CHARS * n and not marks):
            menus.add(at)
            lifted.append(own)
            continue
        total, chars, *_ = articles.get(box.article, (0.0, 0))
        whole = not at or box.tag in BODY_OF or boxes[box.around].tag in WHOLE
        lifted.append(max(own, total / max(1, chars), 0.0 if whole else lifted[box.around]))
    least = CUT * max(total / chars for total, chars, *_ in fused.values())

    def value(b: Block) -> float:
        total, chars, *_ = fused[b.box, b.apart]
        return total / chars if b.apart else lifted[b.box]

    return " ".join(t for b, t in found if value(b) >= least)


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (main text, empty if none), n_chars (its code points).

    The whole html is read, however long, in linear time; null and empty pages have
    empty text.  Blocks are joined by one space in page order, white space within a
    block becomes one space, and character references are decoded.  Rows that
    repeat stay, null page_id and url too; other columns are not read, and an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [extract(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``main_text`` of pages; edge cases as there."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
