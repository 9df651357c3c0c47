"""Main text of pages by equivalence classes of tokens.

A page's tokens are its elements, by path, and its text blocks, by path and text. On each host, tokens that occur the
same number of times on the same pages have one occurrence vector; it is kept as sums over pages (pages, count, and
count times each of two hashes of the page), so classes come from a plain aggregation and no host's pages are gathered.
Copies, pages of a host whose article blocks differ in digits alone (a print view, say), count as one page. Classes on at least SHARE of the host's pages
that aren't empty are candidates, whatever their counts. They nest by support: a token stands in the slot between the
nearest tokens, elements or texts, that are once a page in classes of more pages (or as many, if it is not once a page
itself). Where it stands (slot, and its number among the tokens of its class there) is counted over pages; a token is
the template's at the places where it stands on SHARE of the pages. So a class is taken apart by slots, and what is out
of order or strays over slots isn't template.

What the template leaves are the slots' texts. Those of the article are kept: in a main or article element if the page
has one, and not in an element that is marked as a menu, header, footer, sidebar, notice, advert, form or comment.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_side
from .urlfilter import host_path

#: Distinct pages that a host must have for a template: what two pages share may as well be a passage of both articles.
MIN_PAGES = 3
#: Part of a host's pages that a class, and a place of a token, must be on.
SHARE = 0.5
#: Fixed values of HTML: elements that break text into blocks, that have no content, whose content is no markup and not for readers.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
BLOCKS_BUT_P = BLOCKS - {"p"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "iframe", "textarea", "title", "noembed", "noframes")
#: Elements, roles and words in class or id that mark what isn't the article.
OUTSIDE = frozenset("nav footer aside form button dialog menu label fieldset select svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe comment comments "
    "commentlist reply replies respond disqus discussion share sharing social related recommended widget toolbar pagination pager login signup".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies".split())
ROOTS = frozenset("html body main article".split())
#: In a class or id: what says that a page has, or hasn't, the thing named behind it or before it.
BEFORE, AFTER = frozenset("has no not with without".split()), frozenset("enabled disabled on off open closed visible hidden".split())
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.DOTALL,
)
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORD, DIGITS = re.compile(r"[a-z]+"), re.compile("[0-9]+")


def _names(value: str) -> list[str]:
    """Words by which a class or id says what its element is: 'has-sidebar' and 'share-enabled' say what the page has."""
    words = WORD.findall(value)
    for i, w in enumerate(words):
        if w in BEFORE:
            del words[i:]
            break
    if len(words) > 1 and words[-1] in AFTER:
        del words[-2:]
    return [w for i, w in enumerate(words) if w != "widget" or i in (0, len(words) - 1)]


def _marks(tag: str, attributes: str) -> tuple[bool, str, bool, str]:
    """Whether an element is outside the article by its tag, role or style, or by its words ("words", "comment", or ""), whether it is only so outside an article, and its name in paths."""
    outside, names = tag in OUTSIDE, []
    words: set[str] = set()
    if attributes.strip():
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                for name in value.split():
                    words.update(_names(name))
                if key == "class":
                    names = sorted(value.split())
            elif key == "role":
                outside |= value in ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                outside = True
    by = "" if tag in ("html", "body") else "comment" if words & COMMENT_WORDS else "words" if tag not in ROOTS and words & WORDS else ""
    return outside, by, tag == "header" or "header" in words and tag not in ROOTS, ".".join([tag, *names])


Block = tuple[int, str, bool, int]
#: Elements within a line: one outside the article, whose text is passed over, and one marked by words, a block of its own.
MUTED, APART = 1, 2


def parse(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """A page's text blocks in order: (path, text, outside, depth of article 0, main 1, body 2); and its elements: (number of text blocks before, path).

    Paths are hashes of the elements from the root on. End tags may be left out: a block ends an open p, list items and
    cells end their like, and an element's end closes what is open in it. Content of RAW elements is passed over up to
    their end tag; without one, a script or style takes the rest of the page and others take nothing. An element ended
    by /> has no content, blocks excepted. A mark by words alone doesn't hold for an element that has the page's article:
    an article or main, or without any an h1, with more than half of the text.
    """
    out: list[tuple[int, str, bool, int, tuple[int, ...], tuple[int, ...]]] = []
    stack: list[tuple[str, int, bool, int, tuple[int, ...], tuple[int, ...], int]] = [("", 0, False, 2, (), (), 0)]
    marked: list[bool] = []  # of the elements marked by words: whether one has a heading
    roots: list[tuple[int, ...]] = []  # of the articles and mains: the marked elements around one
    held: list[str] = []
    elements: list[tuple[int, int]] = []
    endless: set[str] = set()

    def flush():
        text = " ".join(markup.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            top = stack[-1]
            out.append((top[1], text, *top[2:6]))

    def pop_to(tag: str, stop) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at = 0
    while m := PIECE.search(page, at):
        if m.start() > at and stack[-1][6] != MUTED:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, close, attributes = tag.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if tag == "br":
            held.append(" ")
            continue
        empty = attributes.rstrip().endswith("/")
        if tag in ENDS:
            held.append(" ")
            if not close and (tag in ("script", "style") or not empty):
                end = None if tag in endless else ENDS[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if close:
            if stack[-1][0] == tag:
                if stack[-1][6] == APART:
                    flush()
                stack.pop()
            else:
                pop_to(tag, ("article", "body") if tag not in ("body", "html", "article") else ())
            continue
        if tag in VOID or empty and not block:
            continue
        if block:
            pop_to("p", BLOCKS_BUT_P)
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                pop_to(tag, ("ul", "ol", "dl", "table"))
        above = stack[-1]
        outside, by, outer, name = _marks(tag, attributes)
        kind = 0 if tag == "article" else min(above[3], 1) if tag == "main" else above[3]
        if not block and not by:
            stack.append((tag, *above[1:6], MUTED if outside or above[6] == MUTED else 0))
            continue
        if not block:
            flush()
        outside = above[2] or outside or above[6] == MUTED or by == "comment" or (outer and above[3] == 2)
        around, within = above[4], above[5]
        if tag in ("article", "main") and not outside:
            within = (*within, len(roots))
            roots.append(around)
        if by == "words":
            around = (*around, len(marked))
            marked.append(False)
        if tag == "h1":
            for i in around:
                marked[i] = True
        path = xxhash.xxh64_intdigest(f"{above[1]} {name}")
        stack.append((tag, path, outside, kind, around, within, 0 if block else APART))
        elements.append((len(out), path))
    if stack[-1][6] != MUTED:
        held.append(page[at:])
    flush()
    if not marked:
        return [b[:4] for b in out], elements
    held_by, held_in, total = [0] * len(marked), [0] * len(roots), 0
    for _, text, outside, _, around, within in out:
        if not outside:
            total += len(text)
            for i in around:
                held_by[i] += len(text)
            for i in within:
                held_in[i] += len(text)
    real = {i for around, n in zip(roots, held_in) if 2 * n > total for i in around}
    if not roots:
        real = {i for i, n in enumerate(held_by) if marked[i] and 2 * n > total}
    return [(path, text, outside or not real.issuperset(around), kind) for path, text, outside, kind, around, _ in out], elements


def _token(path: int, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}") >> 1


def events(blocks: list[Block], elements: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens of a page in order, each with the number of its text block, or -1 for an element."""
    out, at = [], 0
    for before, path in [*elements, (len(blocks), 0)]:
        out += [(_token(blocks[i][0], blocks[i][1]), i) for i in range(at, before)]
        at = before
        out.append((_token(path), -1))
    return out[:-1]


def places(page: Iterable[tuple[int, int]], classes: dict[int, tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """For each occurrence of a class's token on a page: a hash of the token and where it stands, and its text block.

    classes: by token, its class, the pages it is on, and whether it is once on each.
    """
    known = [(t, block, *classes[t]) for t, block in page if t in classes]
    bounds: dict[tuple[int, bool], list[list[int]]] = {}
    for level, single in {k[3:] for k in known}:
        sides = []
        for way in (known, known[::-1]):
            near, side = 0, []
            for t, _, _, pages, once in way:
                side.append(near)
                if once and (pages > level or pages == level and not single):
                    near = t
            sides.append(side)
        bounds[level, single] = [sides[0], sides[1][::-1]]
    ranks: dict[tuple[int, int, int], dict[int, int]] = {}
    out = []
    for i, (t, block, kind, *level) in enumerate(known):
        left, right = (side[i] for side in bounds[tuple(level)])
        seen = ranks.setdefault((kind, left, right), {})
        out.append((xxhash.xxh64_intdigest(f"{t} {left} {right} {seen.setdefault(t, len(seen))}") >> 1, block))
    return out


def article(blocks: list[Block]) -> list[int]:
    """Numbers of the article's blocks: those of articles and main, if the page has such an element with text, else of the body."""
    inside = [i for i, b in enumerate(blocks) if not b[2]]
    return [i for i in inside if blocks[i][3] < 2] or inside


def main_text(page: str) -> str:
    """The article of a page without a template."""
    blocks, _ = parse(page)
    return "\n".join(blocks[i][1] for i in article(blocks))


#: Place of the bytes among the columns to be parsed.
RAW_AT = 5
PARSED = "like bigint, tokens array<bigint>, blocks array<int>, numbers array<int>, texts array<string>, cost bigint"


def _parsed_rows(batches):
    """Rows with the last column, html in bytes, parsed: a hash of the article with its digits alike, the page's tokens and their blocks, the article's blocks by number and text, and the bytes that all take."""
    for b in slices(batches, RAW_AT):
        cols: list[list] = [[], [], [], [], [], []]
        for data in b.column(b.num_columns - 1).to_pylist():
            blocks, elements = parse(data.decode("utf-8", "replace"))
            page, kept = events(blocks, elements), article(blocks)
            texts = [blocks[i][1] for i in kept]
            like = xxhash.xxh64_intdigest(DIGITS.sub("0", "\n".join(texts))) >> 1
            for col, x in zip(cols, (like, [t for t, _ in page], [i for _, i in page], kept, texts, 12 * len(page) + sum(map(len, texts)))):
                col.append(x)
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64()]
        cols = [*b.columns[:-1], *map(pa.array, cols, types)]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "like", "tokens", "blocks", "numbers", "texts", "cost"])


def _token_rows(batches):
    """Sums for each host and token of a batch."""
    for b in slices(batches, 4):
        sums: dict[tuple[str, int], list[int]] = {}
        for host, one, two, tokens in zip(*(c.to_pylist() for c in b.columns[:4])):
            counts: dict[int, int] = {}
            for t in tokens:
                counts[t] = counts.get(t, 0) + 1
            if counts:
                counts[0] = 1  # the page itself
            for t, n in counts.items():
                s = sums.setdefault((host, t), [0, 0, 0, 0])
                s[0] += 1
                s[1] += n
                s[2] = (s[2] + n * (one & (2**40 - 1))) % 2**61
                s[3] = (s[3] + n * (two & (2**40 - 1))) % 2**61
        keys = list(sums)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(4))]
        yield pa.RecordBatch.from_arrays(cols, names=["host", "token", "pages", "count", "one", "two"])


def _classes(tokens, kinds, pages, counts) -> dict[int, tuple[int, int, bool]]:
    return {t: (k, p, n == p) for t, k, p, n in zip(tokens, kinds, pages, counts)}


def _place_rows(batches):
    """Pages for each host and place of a batch."""
    for b in slices(batches, 3):
        sums: dict[tuple[str, int], int] = {}
        last = classes = None
        for host, tokens, blocks, _, *arrays in zip(*(c.to_pylist() for c in b.columns)):
            if host != last:
                last, classes = host, _classes(*arrays)
            for place in {x for x, _ in places(zip(tokens, blocks), classes)}:
                sums[host, place] = sums.get((host, place), 0) + 1
        cols = [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["host", "place", "pages"])


ARRAYS = ["members", "kinds", "pages", "counts"]


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Parsed pages without those whose article differs from that of one of smaller page_id on their host in digits alone."""
    groups = pages.groupBy(F.col("host").alias("on"), F.col("like").alias("as")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    again = small_side(materialize(groups.where("n > 1 and first is not null").drop("n")), "on")
    rows = pages.join(again, (F.col("host") == F.col("on")) & (F.col("like") == F.col("as")), "left")
    return rows.where("first is null or page_id = first").select(pages.columns)


def parsed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) parsed once and written: with host, hashes of page and html, and the columns PARSED."""
    rows = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        host_path(F.col("url"))[0].alias("host"),
        F.xxhash64("page_id", "html").alias("one"),
        F.xxhash64(F.lit(1), "page_id", "html").alias("two"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("raw"),
    )
    known = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, one bigint, two bigint"
    return materialize(rows.mapInArrow(_parsed_rows, f"{known}, {PARSED}"), "zstd")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, members, kinds, pages, counts, places), arrays: for each host of at least min_pages parsed pages that aren't empty, its classes and the places of its template.

    What is on a share of the pages is no more than a page's tokens divided by the share, so a host's row is small
    however many pages it has. Rows that repeat an id and its html count each.
    """
    pages = distinct_pages(pages)
    sums = pages.select("host", "one", "two", "tokens", "cost").mapInArrow(_token_rows, "host string, token bigint, pages bigint, count bigint, one bigint, two bigint")
    total = lambda c: F.pmod(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(2**61).cast("decimal(38,0)")).cast("bigint").alias(c)
    sums = materialize(sums.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("count").alias("count"), total("one"), total("two")))
    least = sums.where("token = 0").where(F.col("pages") >= min_pages).select("host", F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * share)).alias("least"))
    often = sums.where("token <> 0").join(least, "host").where("pages >= least")
    each = F.collect_list(F.struct("token", F.xxhash64("pages", "count", "one", "two").alias("kind"), "pages", "count"))
    classes = materialize(often.groupBy("host", "least").agg(each.alias("l")).select("host", "least", *(F.col(f"l.{field}").alias(a) for a, field in zip(ARRAYS, ("token", "kind", "pages", "count")))))
    kept = pages.select("host", "tokens", "blocks", "cost").join(small_side(classes, "host", *ARRAYS), "host")
    kept = kept.select("host", "tokens", "blocks", "cost", *ARRAYS)
    found = kept.mapInArrow(_place_rows, "host string, place bigint, pages bigint").groupBy("host", "place").agg(F.sum("pages").alias("n"))
    valid = found.join(classes.select("host", "least"), "host").where("n >= least").groupBy("host").agg(F.collect_list("place").alias("places"))
    return classes.drop("least").join(valid, "host")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of pages (page_id, url, html).

    Null or empty html gives an empty text, html of any length is read whole; a null url, or one without ://, has the
    empty host, whose pages form a host. A host with fewer than min_pages distinct pages has no template, and its pages
    keep all blocks of the article; so does a page of which the template would leave nothing. A page with a main or
    article element loses what text stands beside it. Ids may be null or repeat; of equal pages with different ids one shapes the template and all
    get their text. Other columns are ignored. No rows in, none out.
    """
    rows = parsed(pages)
    known = small_side(materialize(templates(rows, min_pages)), "host", *ARRAYS, "places")

    def run(batches):
        for b in slices(batches, 7):
            out, last, classes, valid = [], None, {}, frozenset()
            has = b.column(8).is_valid().to_pylist()
            for r, (host, tokens, blocks, numbers, texts) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:7]))):
                if has[r] and host != last:  # a host's arrays are the same on all its rows
                    found, *arrays = (b.column(k)[r].as_py() for k in range(8, 13))
                    last, classes, valid = host, _classes(*arrays), frozenset(found)
                constant = {i for x, i in places(zip(tokens, blocks), classes) if x in valid} if has[r] else frozenset()
                left = [t for i, t in zip(numbers, texts) if i not in constant]
                out.append("\n".join(left or texts))  # a page that is all template is the article that it repeats
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = rows.join(known, "host", "left").select("page_id", "url", "host", "tokens", "blocks", "numbers", "texts", "cost", "places", *ARRAYS)
    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
