"""Main text of web pages: nearest-URL page differencing.

Pages of a host are sorted by their URL's path. Each is aligned, by a longest common subsequence of text lines, with
the nearest pages of other content, and lines that it shares with them go: what pages of a site have in common is the
site's. Outside <article> and <main> one page that has the line is enough; inside it takes the two nearest and two far
pages of the host, since articles quote one another and repeat a licence's sentence. A neighbour that is a copy of the same
article is passed over; copies are told by the lines that the far pages lack. Elements and their class names only add to that: they take out what differs from page to page
and still isn't the article (menus of links, adverts, comments).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, running_totals, trimmed, written

#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select".split())
#: Elements that hold a site's furniture, wherever they are; a form may hold a whole page.
FURNITURE = frozenset("nav footer aside button menu dialog".split())
#: Elements that begin and end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an open one of the same name ends before, and those that keep it from doing so.
ENDED = frozenset("p li td th tr dt dd option".split())
KEEPERS = frozenset("ul ol table dl div article main section body blockquote aside nav header footer form select".split())
#: Words of class, id and role that name adverts, menus and readers' comments.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsored sponsor promo promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar topbar toolbar share sharing social related recommended trending widget"
    " comment comments commentlist respond replies reply disqus complementary contentinfo copyright".split()
)
#: Words that may as well name a part of an article.
WEAK = frozenset("banner notice notices alert aside footer header masthead skip popular search discussion legal disclaimer tags".split())
#: With one of these beside it, a word says what a page has or lacks.
MODIFIERS = frozenset("has no with without not non free is".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/][^\s=>/]*)?(\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
#: Share of its own lines' text that a page has in common with a neighbour from which on they are copies.
COPY = 0.7
TEXT, MAIN, SOFT, DOUBT, SITE = range(5)


def named(value: str) -> int:
    """2 if a word of a class, id or role is of STRONG, 1 if one is of WEAK, else 0."""
    found = 0
    for token in value.lower().split():
        parts = re.split(r"[-_:]+", token)
        if not MODIFIERS.intersection(parts):
            found = max(found, 2 * bool(STRONG.intersection(parts)), bool(WEAK.intersection(parts)))
    return found


class Scanner:
    """Parts of a page in order, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Of the tag whose name ends at `at`: its attributes, and where it ends (beyond the page if it doesn't)."""
        page, found = self.page, {}
        while at < len(page):
            m = ATTRIBUTE.match(page, at)
            at = m.end()
            if at >= len(page):
                break
            name, value = (m[1] or "").lower(), ""
            if m[2]:
                quote = page[at]
                if quote in self.last and at < self.last[quote]:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            if name:
                found.setdefault(name, value)
            if page.startswith(">", at):
                return found, at + 1
            if not name and not m[2]:
                at += 1
        return found, len(page) + 1

    def parts(self):
        """("text", text), ("open", tag, attributes) and ("close", tag)."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            start = page.find("<", at)
            if start < 0:
                yield "text", page[at:], None
                return
            if start > at:
                yield "text", page[at:start], None
            at = start + 1
            if page.startswith("!--", at):
                end = page.find("-->", at + 1)
                at = n if end < 0 else end + 3
            elif page.startswith("![CDATA[", at):
                end = page.find("]]>", at)
                yield "text", html.escape(page[at + 8 : end if end >= 0 else n]), None
                at = n if end < 0 else end + 3
            elif page[at : at + 1] in ("!", "?"):
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            else:
                closing = page.startswith("/", at)
                m = NAME.match(page, at + closing)
                if not m:
                    if closing and at + 1 < n:  # no tag, and no text either
                        end = page.find(">", at)
                        at = n if end < 0 else end + 1
                    else:
                        yield "text", "&lt;", None
                    continue
                tag = m[0].lower()
                attributes, at = self.attributes(m.end())
                if at > n:
                    return  # a tag that the page ends in
                yield "close" if closing else "open", tag, attributes
                if not closing and tag in RAW:
                    stop = RAW[tag].search(page, at)
                    at = stop.start() if stop else n


def lines(page: str) -> list[tuple[str, int]]:
    """The page's lines of text in order, without those of the site's furniture (SITE).

    MAIN: inside an <article> or <main>; DOUBT: there, in an element of a WEAK name, or mostly links; TEXT: outside;
    SOFT: outside, in an element of a WEAK name, a form or a header.
    """
    out: list[tuple[str, int]] = []
    held: list[str] = []
    size = linked = 0  # characters of the line, and those that are a link's
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, and with all above: furniture by tag, by name, weakly, main
    count: Counter[str] = Counter()

    def close_line() -> None:
        nonlocal size, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            hard, strong, weak, main = stack[-1][1:] if stack else (False,) * 4
            if text and not (hard or strong):
                doubt = weak or main and 2 * linked > size and size == linked and len(stack) > 1 and stack[-1][0] == "li"
                out.append((text, (DOUBT if doubt else MAIN) if main else SOFT if weak else TEXT))
            held.clear()
        size = linked = 0

    def drop(k: int) -> None:
        for x in stack[k:]:
            count[x[0]] -= 1
        del stack[k:]

    for kind, tag, attributes in Scanner(page).parts():
        if kind == "text":
            held.append(tag)
            size += len(tag.strip())
            linked += len(tag.strip()) if count["a"] else 0
            continue
        if tag in BLOCKS:
            close_line()
        if kind == "close":
            if count[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if tag not in BLOCKS and stack[k][1:] != (stack[k - 1][1:] if k else (False,) * 4):
                    close_line()
                drop(k)
            continue
        if tag in EMPTY:
            continue
        if tag in ENDED and count[tag]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in KEEPERS:
                    break
                if stack[k][0] == tag:
                    drop(k)
                    break
        before = stack[-1][1:] if stack else (False,) * 4
        hard, strong, weak, main = before
        value = " ".join(attributes.get(x, "") for x in ("class", "id", "role"))
        name = named(value) if value.strip() and tag not in ("html", "body") else 0
        if tag in ("article", "main"):
            strong, weak, main = name == 2, False, True  # what is around it doesn't hide it
        else:
            strong, weak = strong or name == 2, weak or name == 1 or tag == "form" or tag == "header" and not main
        hard = hard or tag in HIDDEN or tag in FURNITURE or tag == "form" and main or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        after = (hard, strong, weak, main)
        if after != before and tag not in BLOCKS:
            close_line()
        stack.append((tag, *after))
        count[tag] += 1
    close_line()
    return out


def shared(a: list[int], b: list[int]) -> np.ndarray:
    """Which of a's lines are in a longest common subsequence of a and b (bit-parallel; halved where that takes much memory)."""
    out = np.zeros(len(a), bool)

    def rows(x: list[int], y: list[int]) -> list[int]:
        """After each line of x, the columns (bits, 0: a step) at which the length of the common subsequence grows."""
        places: dict[int, int] = {}
        for j, v in enumerate(y):
            places[v] = places.get(v, 0) | 1 << j
        full, v, found = (1 << len(y)) - 1, (1 << len(y)) - 1, []
        for item in x:
            u = v & places.get(item, 0)
            v = ((v + u) | (v - u)) & full
            found.append(v)
        return found

    def lengths(x: list[int], y: list[int]) -> np.ndarray:
        """The common length of x with each start of y."""
        if not x:
            return np.zeros(len(y) + 1, np.int64)
        full = (1 << len(y)) - 1
        places: dict[int, int] = {}
        for j, v in enumerate(y):
            places[v] = places.get(v, 0) | 1 << j
        v = full
        for item in x:
            u = v & places.get(item, 0)
            v = ((v + u) | (v - u)) & full
        steps = np.unpackbits(np.frombuffer((v ^ full).to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
        return np.append(0, np.cumsum(steps, dtype=np.int64))

    work = [(0, len(a), 0, len(b))]
    while work:
        i0, i1, j0, j1 = work.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out[i0] = True
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            out[i1 - 1] = True
            i1, j1 = i1 - 1, j1 - 1
        if i0 == i1 or j0 == j1:
            continue
        x, y = a[i0:i1], b[j0:j1]
        if len(x) * len(y) > 1 << 27 and len(x) > 1:
            half = len(x) // 2
            cut = int(np.argmax(lengths(x[:half], y) + lengths(x[half:][::-1], y[::-1])[::-1]))
            work += [(i0, i0 + half, j0, j0 + cut), (i0 + half, i1, j0 + cut, j1)]
            continue
        found, j = rows(x, y), len(y) - 1
        for i in range(len(x) - 1, -1, -1):
            # go left while the last step is elsewhere; a step that the line before lacks is this line's match
            while j >= 0 and found[i] >> j & 1:
                j -= 1
            if j < 0:
                break
            if i == 0 or found[i - 1] >> j & 1:
                out[i0 + i] = True
                j -= 1
    return out


def main_text(page: list[tuple[str, int]], neighbours: list[list[int]], far: list[int]) -> str:
    """The page's text without lines shared with the nearest pages that are no copies of it.

    neighbours: lines of pages of other content, the nearest first; far: lines that far pages of the host have in common.
    """
    texts, kinds, hashes = [t for t, _ in page], np.array([k for _, k in page], np.int64), line_hashes(page)
    sizes, everywhere = np.array(list(map(len, texts)), np.float64), set(far)
    own = np.array([h not in everywhere for h in hashes], bool)
    gone: list[np.ndarray] = []
    for other in neighbours:
        both = shared(hashes, other)
        if sizes[both & own].sum() < COPY * sizes[own].sum():
            gone.append(both)
            if len(gone) == 2:
                break
    one = gone[0] if gone else np.zeros(len(texts), bool)
    two = one & gone[1] & ~own if len(gone) == 2 else np.zeros(len(texts), bool)
    if (kinds == MAIN).any():
        keep = (kinds == MAIN) & ~two | (kinds == DOUBT) & ~one
    else:
        keep = (kinds == TEXT) & ~one
        if not keep.any():
            keep = ((kinds == SOFT) | (kinds == DOUBT)) & ~one
    return " ".join(t for t, k in zip(texts, keep.tolist()) if k)


def line_hashes(page: list[tuple[str, int]]) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(t) - (1 << 63) for t, _ in page]


def parsed(pages: DataFrame, pack: bool) -> DataFrame:
    """page_id, url, content (a hash of all lines), and packed (the lines and their kinds) or else hashes (of each line)."""

    def scan(batches):
        from xxhash import xxh64_intdigest
        from zstandard import ZstdCompressor

        zip_ = ZstdCompressor(level=6)
        for batch in batches:
            content, last = [], []
            for x in batch.column(2):
                page = lines(x.as_py() or "")
                hashes = np.array(line_hashes(page), np.int64)
                content.append(xxh64_intdigest(hashes.tobytes()) - (1 << 63))
                last.append(zip_.compress("\n".join([*(t for t, _ in page), "".join(str(k) for _, k in page)]).encode("utf-8", "surrogatepass")) if pack else hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(content, pa.int64()), pa.array(last, pa.binary() if pack else pa.list_(pa.int64()))],
                names=["page_id", "url", "content", "last"],
            )

    kind = "packed binary" if pack else "hashes array<long>"
    return pages.select("page_id", "url", "html").mapInArrow(trimmed(scan), f"page_id long, url string, content long, {kind}")


def place(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1)), F.regexp_replace(url, r"^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*", "")


def nearest_pages(rows: DataFrame) -> DataFrame:
    """host, content, near (up to four contents' hashes, the nearest first) and far (lines that two of four other pages of the host have).

    Pages of one content on a host are one, at the first of their paths. Neighbours are the two before and the two after in the
    order of host, path and content; nearer is one with more leading parts of the path in common. Rows are dealt by range, so that a
    host of very many pages is spread like others.
    """
    host, path = place(F.col("url"))
    rows = rows.where(F.size("hashes") > 0)  # a page without text tells nothing
    pages = rows.select(host.alias("host"), path.alias("path"), "content", "hashes").groupBy("host", "content").agg(F.min("path").alias("path"), F.min("hashes").alias("hashes"))
    pages = written(pages)
    ranked = written(running_totals(pages.select("host", "path", "content", F.lit(1).alias("one")), ["host", "path", "content"], "one", "rank"))

    def common(a: Column, b: Column) -> Column:
        """Leading parts that are alike."""
        same = F.zip_with(F.split(a, "[/?&#]"), F.split(b, "[/?&#]"), lambda x, y: x.eqNullSafe(y))
        return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])

    step = F.explode(F.array(*map(F.lit, (-1, 1, -2, 2))))
    asked = ranked.withColumn("step", step).withColumn("at", F.col("rank") + F.col("step"))
    there = ranked.select(F.col("rank").alias("at"), F.col("host").alias("its_host"), F.col("path").alias("its_path"), F.col("content").alias("its"))
    met = asked.join(there, "at").where("host = its_host")
    met = met.select("host", "content", F.struct((-common(F.col("path"), F.col("its_path"))).alias("far"), F.abs("step").alias("steps"), F.col("step").alias("step")).alias("order"), "its")
    known = pages.select(F.col("host").alias("h"), F.col("content").alias("its"), "hashes")
    met = met.join(known, (met["host"] == known["h"]) & (met["its"] == known["its"])).select("host", "content", "order", "hashes")
    near = met.groupBy("host", "content").agg(F.array_sort(F.collect_list(F.struct("order", "hashes"))).alias("near"))  # up to four
    picked = [f(F.struct(order.alias("o"), "content", "hashes")).alias(f"p{k}") for k, (f, order) in enumerate((f, o) for f in (F.min, F.max) for o in (F.col("content"), F.xxhash64("content")))]
    ends = pages.groupBy("host").agg(*picked)
    both = [F.when(F.col(f"{a}.content") != F.col(f"{b}.content"), F.array_intersect(f"{a}.hashes", f"{b}.hashes")) for a, b in combinations(("p0", "p1", "p2", "p3"), 2)]
    ends = ends.select("host", F.array_distinct(F.flatten(F.filter(F.array(*both), lambda x: x.isNotNull()))).alias("far"))
    found = written(near.join(ends, "host", "left").select("host", "content", F.col("near.hashes").alias("near"), "far"))
    discard(pages)
    discard(ranked)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars for every row of pages, from its whole html (null: empty).

    Each line's white space is one space, lines are joined by one space in page order, character references are
    decoded. Tags may be malformed; one that the page ends in is dropped, as is what an unended comment holds. A page alone on its
    host is told by its elements alone; pages without url are of one host, the empty one. Rows of equal lines are one page
    for the pairing and all returned; an empty table gives an empty one; other columns play no part.
    """

    def texts(batches):
        from zstandard import ZstdDecompressor

        unzip = ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.slice(at, 256), []
                for packed, near, far in zip(*(part.column(k).to_pylist() for k in ("packed", "near", "far"))):
                    *page, kinds = unzip.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
                    page = list(zip(page, map(int, kinds)))
                    out.append(main_text(page, near or [], far or []))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    near = nearest_pages(parsed(pages, pack=False)).withColumnsRenamed({"host": "h", "content": "c"})
    rows = parsed(pages, pack=True)  # once more, as a table of all lines takes more room than parsing takes time
    joined = rows.join(near, (place(rows["url"])[0] == near["h"]) & (rows["content"] == near["c"]), "left")
    return joined.select("page_id", "url", "packed", "near", "far").mapInArrow(trimmed(texts), "page_id long, url string, text string, n_chars long")
