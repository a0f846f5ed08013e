"""Main text of web pages by composite text density.

The page becomes a tree of elements; scripts, styles, navigation, forms, footers,
asides, adverts, notices, comments and hidden parts (by tag, role or the words of
class and id) are left out.  For every node the composite density is

    C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

with characters C, tags T, characters LC and tags LT in links (1 where 0) and b
for the body.  A node's density sum adds those of its children; inline elements, which
are parts of a block's text, add none.  The node with the largest sum is the kernel; the smallest density on its path to the body is
the threshold.  If the kernel lies in an article or main element, it is widened to
that element; else the text is the kernel and those nodes beside its path whose
density reaches the threshold.  Marked parts (comments, sidebars, adverts) go
whatever they hold, unless the page's title is in them.

Blocks are runs of text between starts and ends of block elements.  Character
references are decoded, white space in a block becomes one space, blocks are
joined by a line feed; nothing is capped.

Defined results: null, empty and tagless html work (no tags: the text itself is
one block); unclosed, stray and badly nested tags, missing body and unclosed
quotes are repaired (but an unclosed script, style, title or textarea takes the rest
of the page, as in browsers); any depth works, since nothing recurs and the time is
linear in it; repeated rows stay; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.scratch import tables
from kinlink.llm.words import tidy

OPEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?/])")
REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
MARKS = re.compile(r"""(?i)\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element classes of HTML and the names that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left out with all that is in them; of these, TEXTS hold no tags and go on to the
#: page's end if unclosed, as in browsers.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math object canvas audio video".split())
TEXTS = frozenset("script style textarea title xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "legend", "caption", "tbody", "tfoot", "thead", "tr", "td", "th"}
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("table ul ol dl select article section main aside nav body html".split())
JUNK_TAGS = frozenset("nav aside footer form button select fieldset dialog menu label datalist".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
JUNK_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice notices notification alert sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead
share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay comment comments
disqus replies respond widget toolbar pagination pager copyright disclaimer skip sr outbrain taboola""".split())
JUNK_PARTS = re.compile(r"side[-_ ]?bar|comment|advert|breadcrumb|newsletter|cookie|sponsor|pagination|nav[-_]?bar|masthead|disclaimer|subscri", re.I)
#: Names of parts that are never the article, whatever they hold; with a word like
#: "has" before them they tell of a page's layout instead.
PART_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sidebar sidenav cookie cookies consent
gdpr breadcrumb breadcrumbs newsletter comment comments disqus replies respond outbrain taboola""".split())
LAYOUT_WORDS = frozenset("has with without no not is page layout".split())
CONTENT_WORDS = frozenset("article entry post content story page title main".split())
ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
SAFE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
#: How surely an element is boilerplate. LIKELY ones stay if they hold most of the
#: page's text: whole pages in a form, or content that is "with-sidebar". PART ones
#: stay only if they hold the page's title: then they wrap the page.
LIKELY, PART, SURELY = 1, 2, 3
TITLES = frozenset("h1 main".split())


def is_junk(tag: str, attrs: str) -> int:
    found = 0
    if tag in JUNK_TAGS:
        found = LIKELY if tag in ("form", "fieldset") else SURELY
    if found == SURELY or "=" not in attrs and "hidden" not in attrs:
        return found
    for m in MARKS.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 0 if tag in SAFE else SURELY
        if key == "role" and value.lower() in JUNK_ROLES:
            found = max(found, LIKELY if value.lower() == "form" else SURELY)
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0 if tag in SAFE else SURELY
        if key in ("class", "id") and tag not in ("html", "body", "main"):
            words = {w.lower() for w in TOKENS.findall(value)}
            named = bool(words & JUNK_WORDS) or JUNK_PARTS.search(value) is not None or "header" in words and not words & CONTENT_WORDS
            if tag == "article":
                named = bool(words & {"comment", "comments", "ad", "related"})
            found = max(found, LIKELY * named)
            for name in value.split() if named else ():
                own = [w.lower() for w in TOKENS.findall(name)]
                if own and own[0] not in LAYOUT_WORDS and not PART_WORDS.isdisjoint(own):
                    found = max(found, PART)
    return found


class Page:
    """Elements of a page in document order, with their own texts."""

    def __init__(self, html: str):
        self.tag, self.parent, self.junk = ["#root"], [-1], [0]
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self._parse(html)
        self._judge()

    def _judge(self) -> None:
        """Boilerplate is inherited; what is only likely goes if it is the lesser part."""
        size, titled = [0] * len(self.tag), [t in TITLES for t in self.tag]
        for node, _, text in self.texts:
            size[node] += len(text.strip())
        for k in range(len(self.tag) - 1, 0, -1):
            size[self.parent[k]] += size[k]
            titled[self.parent[k]] |= titled[k]
        for k in range(1, len(self.tag)):
            how = self.junk[k]
            own = how == SURELY or how == PART and not titled[k] or how == LIKELY and 2 * size[k] <= size[0]
            self.junk[k] = bool(self.junk[self.parent[k]]) or own

    def _parse(self, html: str) -> None:
        stack, block, at, n = [0], 0, 0, len(html)
        tag, parent, junk, texts = self.tag, self.parent, self.junk, self.texts
        held = Counter()  # open elements by name: no search for one that isn't there
        inside, unclosed = [False], set()  # nodes in an article; raw names that close no more

        def close(k: int) -> None:
            held.subtract(tag[x] for x in stack[k:])
            del stack[k:]

        def close_nearest(names: Collection[str], fences: Collection[str]) -> None:
            if any(held[x] for x in names):
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] in names:
                        close(k)
                        break
                    if tag[stack[k]] in fences:
                        break

        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            m = OPEN.match(html, lt) if lt < n else None
            if m is None and lt < n:  # a bare sign
                texts.append((stack[-1], block, html[at:lt + 1]))
                at = lt + 1
                continue
            if lt > at:
                texts.append((stack[-1], block, html[at:lt]))
            if lt == n:
                break
            if m[3]:
                end = html.find("-->", m.end())
                at = n if end < 0 else end + 3
                continue
            rest = REST.match(html, m.end())
            end = rest.end() if rest else html.find(">", m.end()) + 1 or n
            name, at = (m[2] or "").lower(), end
            if not name:
                continue
            if m[1]:
                if name in BLOCK:
                    block += 1
                close_nearest((name,), FENCES if name in PEERS else ())
                continue
            attrs = html[m.end():end - 1]
            if name in RAW:
                if not attrs.endswith("/") and name not in unclosed:
                    last = ENDS[name].search(html, end)
                    if last is not None:
                        at = last.end()
                    elif name in TEXTS:
                        at = n
                    else:  # never closed: only the tag goes
                        unclosed.add(name)
                if name not in ("svg", "math"):
                    block += name not in ("script", "template")
                continue
            if name == "br":
                texts.append((stack[-1], block, " "))
            if name in BLOCK:
                block += 1
                if name in CLOSES_P:
                    close_nearest(("p",), BLOCK)
                if name in PEERS:
                    close_nearest(PEERS[name], FENCES)
            if name in ("html", "body") and held[name]:
                continue
            up = stack[-1]
            tag.append(name)
            parent.append(up)
            bad, here = is_junk(name, attrs), inside[up]
            inside.append(here or name in ("article", "main"))
            if name == "header":  # a page's header, not an article's
                bad = bad if bad == SURELY or here else max(bad, LIKELY)
            junk.append(bad)
            if name not in VOID and not attrs.endswith("/"):
                stack.append(len(tag) - 1)
                held[name] += 1
            elif name not in VOID and name in BLOCK:
                block += 1

    def chosen(self) -> list[bool]:
        """For each node, whether its own text belongs to the main text."""
        tag, parent, junk = self.tag, self.parent, self.junk
        n = len(tag)
        link = [False] * n
        chars, tags, lchars, ltags = [0] * n, [0] * n, [0] * n, [0] * n
        for k in range(1, n):
            link[k] = link[parent[k]] or tag[k] == "a"
        for node, _, text in self.texts:
            if not junk[node]:
                size = len(text.strip())
                chars[node] += size
                if link[node]:
                    lchars[node] += size
        for k in range(n - 1, 0, -1):
            if not junk[k]:
                p = parent[k]
                chars[p] += chars[k]
                lchars[p] += lchars[k]
                tags[p] += tags[k] + 1
                ltags[p] += ltags[k] + (tag[k] == "a")
        body = next((k for k in range(n) if tag[k] == "body"), 0)
        ratio = lchars[body] / max(1, chars[body])

        def density(k: int) -> float:
            c, t, lc, lt = chars[k], max(1, tags[k]), lchars[k], ltags[k]
            if not c:
                return 0.0
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            return c / t * math.log(max(c / max(1, lc) * t / max(1, lt), 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1.0 else c / t * math.log(max(c * t, 1))

        dens = [0.0 if junk[k] else density(k) for k in range(n)]
        sums = [0.0] * n
        for k in range(1, n):
            if tag[k] in BLOCK:
                sums[parent[k]] += dens[k]
        kernel = max((k for k in range(n) if not junk[k]), key=lambda k: (sums[k], k == body, -k))
        if sums[kernel] <= 0.0:
            kernel = body
        path, k = [], kernel
        while k >= 0:
            path.append(k)
            if k == body:
                break
            k = parent[k]
        least = min(dens[k] for k in path)
        home = next((k for k in path if tag[k] in ("article", "main")), None)
        keep = [False] * n
        on_path = set(path)
        between = on_path - {kernel, home}
        for k in range(n):
            if junk[k]:
                continue
            if k == (kernel if home is None else home):
                keep[k] = True
            elif k and keep[parent[k]] and parent[k] not in between:
                keep[k] = True
            elif home is None and k in on_path:
                keep[k] = True  # own text of the path: not in any child
            elif home is None and k and parent[k] in on_path and 2 * lchars[k] <= chars[k]:
                # Beside the path: as dense as the path, or a heading before the kernel.
                keep[k] = dens[k] >= least or tag[k] in HEADINGS and k < kernel
        return keep

    def text(self) -> str:
        keep, out, now, parts = self.chosen(), [], -1, []

        def flush() -> None:
            line = " ".join("".join(parts).split())
            if line:
                out.append(line)
            parts.clear()

        for node, block, text in self.texts:
            if keep[node]:
                if block != now:
                    flush()
                    now = block
                parts.append(unescape(text) if "&" in text else text)
        flush()
        return "\n".join(out)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


@tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")\
        .mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(tables(spark, sf_dir, "pages"))
