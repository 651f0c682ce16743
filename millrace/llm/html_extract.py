"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block tags; script, style, forms, comments of the
markup and regions marked as navigation, header, footer, sidebar, notice,
advert or reader comments are left out. A region that encloses an article or
main element stays, without the text around that element; only articles below
such a mark beside other main text (reader comments, teasers) go with it. First pass, block by block: link
density, length and stop-word density say good, bad, or undecided (short, or
with few stop words). Second pass: an undecided block takes the label of the
nearest decided blocks before and after it; where they disagree the nearer
one counts, on a tie the good one; a heading takes the label of the decided block behind it. Where a page has an article or main
element, all its blocks are good, and text
outside of it is bad; inside of it a class or id counts as a mark only if all parts of its name say so (``share-buttons``, not ``share-price``). Stop words say nothing about a page in none of the four
languages, or a block in another script: there length in bytes and link density
say good, and what is left is undecided, or good if no block of the page is.

Defined results: null or empty html and pages without main text give an empty
text and 0; text that ends inside a tag or comment ends there; all rows are
kept, repeated ones too; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.IGNORECASE)

# Names of the markup and of usual page furniture.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg".split())
FURNITURE_TAGS = frozenset("nav header footer aside form dialog menu button select".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer"
    " disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager paywall popup promo"
    " promoted promotion recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
# parts of names that say what the furniture is made of
CONTAINER_WORDS = frozenset(
    "area articles bar block box button buttons container form icons inner item items link links list outer panel posts section slot stories"
    " title top bottom left right unit wrap wrapper".split()
)
# "no-sidebar", "content-with-sidebar": names of what stands beside the furniture
LAYOUT_WORDS = frozenset("no not without with has have".split())
# elements that pages wrap around everything
WRAPPER_TAGS = frozenset(["form", "header"])
MAIN_TAGS = frozenset(["article", "main"])
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Frequent words of the page languages.
STOP_LISTS = [
    frozenset(words.split())
    for words in (
        "the of and to in a is that it for was on are as with be by this at from or an not but have had his her they which you we",
        "der die das und in zu den von mit ist im für auf des dem ein eine einer nicht sich als auch es an werden aus er hat dass sie nach bei",
        "le la les de des du et en un une que qui dans pour par sur au aux est pas plus avec ce il elle ne se son sa",
        "el los las y del que en un una por con no para su al lo como más o pero sus se es de la a",
    )
]
STOP_WORDS = frozenset().union(*STOP_LISTS)

SHORT, LONG = 70, 200
MANY_STOPS, SOME_STOPS, MANY_LINKS, FEW_LINKS = 0.32, 0.2, 0.5, 0.2
GOOD, BAD, OPEN = "good", "bad", "open"


Block = tuple[str, int, bool, bool]


def marks(tag: str, attributes: str, in_main: bool = False) -> tuple[bool, bool]:
    """Whether the element is marked as furniture, and whether by more than a part of a longer class or id.

    Inside of main text a part of a name is no mark beside parts that name something else.
    """
    if tag in ("html", "body", *MAIN_TAGS):
        return False, False
    marked, clear = tag in FURNITURE_TAGS, tag in FURNITURE_TAGS and tag not in WRAPPER_TAGS
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip() in FURNITURE_ROLES:
            return True, True
        if name in ("class", "id"):
            for given in value.split():
                parts = re.split(r"[_-]+", given)
                found = next((k for k, part in enumerate(parts) if part in FURNITURE_WORDS), None)
                if found is not None and in_main and not all(part in FURNITURE_WORDS or part in CONTAINER_WORDS for part in parts):
                    continue
                if found is not None and LAYOUT_WORDS.isdisjoint(parts[:found]):
                    marked, clear = True, clear or given in FURNITURE_WORDS
    return marked, clear


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """``("text", text, "")``, ``("open", tag, attributes)`` and ``("close", tag, "")`` in page order."""
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        following = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            if stop < 0:
                return
            at = stop + 3
        elif following in ("!", "?"):
            stop = page.find(">", lt)
            if stop < 0:
                return
            at = stop + 1
        elif m := TAG.match(page, lt) or LOOSE_TAG.match(page, lt):
            tag, at = m[2].lower(), m.end()
            if m[1]:
                yield "close", tag, ""
            elif tag in RAW_TAGS and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
            else:
                yield "open", tag, m[3]
        elif following.isalpha() or following == "/" and page[lt + 2 : lt + 3].isalpha():
            return
        elif following == "/":
            stop = page.find(">", lt)
            at = stop + 1 if stop >= 0 else end
        else:
            yield "text", "<", ""
            at = lt + 1


def _closings(items: list[tuple[str, str, str]]) -> dict[int, int]:
    """Place of the matching close of each opening tag that has one."""
    open_at: dict[str, list[int]] = {}
    found = {}
    for i, (kind, tag, _) in enumerate(items):
        if kind == "open" and tag not in VOID_TAGS:
            open_at.setdefault(tag, []).append(i)
        elif kind == "close" and open_at.get(tag):
            found[open_at[tag].pop()] = i
    return found


def blocks_of(page: str) -> list[Block]:
    """Text, characters inside links, whether it stands in an article or main element, and whether it is a heading, of each block outside furniture."""
    items = list(pieces(page))
    closings = _closings(items)
    mains = [i for i, (kind, tag, _) in enumerate(items) if kind == "open" and tag in MAIN_TAGS]
    only_mains = [i for i in mains if items[i][1] == "main"]
    article_starts = [i for i in mains if items[i][1] == "article"]
    blocks: list[Block] = []
    parts: list[str] = []
    links = inside = main = breaks = 0
    heading = False
    skip_to = -1

    def goes(at: int, end: int, clear: bool) -> bool:
        """Whether the marked region is left out; one around main text only if it is clearly marked and other main text is left."""
        first, after = bisect_left(mains, at), bisect_left(mains, end)
        if first == after:
            return True
        if not clear or bisect_left(only_mains, at) < bisect_left(only_mains, end):
            return False
        before = bisect_left(article_starts, at)
        # an article that encloses the region or stands before it, or one after it
        return before > 0 or bisect_left(article_starts, end) < len(article_starts)

    def flush() -> None:
        nonlocal links, breaks, heading
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((text, min(links, len(text)), main > 0, heading))
        parts.clear()
        links = breaks = 0
        heading = False

    for i, (kind, value, attributes) in enumerate(items):
        if i <= skip_to:
            continue
        if kind == "text":
            text = html.unescape(value)
            parts.append(text)
            if text.strip():
                breaks = 0
            if inside:
                links += len(" ".join(text.split()))
            continue
        if kind == "open" and value not in VOID_TAGS:
            marked, clear = marks(value, attributes, main > 0)
            if marked:
                # an unclosed region ends where the next article or main element begins
                following = bisect_left(mains, i)
                end = closings.get(i, mains[following] - 1 if following < len(mains) else len(items))
                if goes(i, end, clear):
                    flush()
                    skip_to = end
                    continue
        if value == "br":
            breaks += 1
            flush() if breaks > 1 else parts.append(" ")
        elif value in BLOCK_TAGS:
            flush()
            heading = kind == "open" and value in HEADING_TAGS
        if value == "a":
            inside = kind == "open"
        elif value in MAIN_TAGS:
            main = max(0, main + (1 if kind == "open" else -1))
    flush()
    return blocks


def is_latin(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c < "\u0250" or "\u1e00" <= c < "\u1f00" for c in letters) >= len(letters)


def listed_language(blocks: list[Block]) -> bool:
    """Whether most words of the page's longer blocks stand in blocks with enough stop words of one of the four languages."""
    balance = 0
    for text, links, _, _ in blocks:
        if len(text) >= SHORT and links <= MANY_LINKS * len(text):
            words = [w.strip(".,;:!?\"'()") for w in text.lower().split()]
            enough = max(sum(w in stops for w in words) for stops in STOP_LISTS) >= SOME_STOPS * len(words)
            balance += len(words) if enough else -len(words)
    return balance >= 0


def classify(blocks: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    has_main = any(main for _, _, main, _ in blocks)
    listed = has_main or listed_language(blocks)
    labels = []
    unlisted = []
    for i, (text, links, main, _) in enumerate(blocks):
        density = links / len(text)
        words = text.lower().split()
        stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        if main:
            labels.append(GOOD)
        elif density > MANY_LINKS or has_main:
            labels.append(BAD)
        elif not (listed and is_latin(text)) and len(text.encode("utf-8", "replace")) >= SHORT:
            unlisted.append(i)
            labels.append(GOOD if density <= FEW_LINKS and len(text.encode("utf-8", "replace")) >= LONG else OPEN)
        elif len(text) < SHORT:
            labels.append(OPEN if density == 0 else BAD)
        elif stops >= MANY_STOPS and len(text) >= LONG:
            labels.append(GOOD)
        elif stops >= SOME_STOPS:
            labels.append(OPEN)
        else:
            labels.append(BAD)
    if GOOD not in labels:
        for i in unlisted:
            labels[i] = GOOD
    decided = [i for i, label in enumerate(labels) if label != OPEN]
    out = []
    for i, label in enumerate(labels):
        if label == OPEN:
            k = bisect_left(decided, i)
            before = decided[k - 1] if k else None
            after = decided[k] if k < len(decided) else None
            if before is None or after is None:
                near = after if before is None else before
            elif blocks[i][3] or after - i < i - before or after - i == i - before and labels[after] == GOOD:
                near = after
            else:
                near = before
            label = labels[near] if near is not None else GOOD
        out.append(label == GOOD)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(text for (text, *_), kept in zip(blocks, classify(blocks)) if kept)


def _extract_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    texts = [main_text(x) for x in batch.column("html").to_pylist()]
    yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page; no shuffle."""
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_batches(picked, _extract_batch, "page_id long, url string, text string, n_chars long")
