"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from rillwave.llm.common import schema_of
from rillwave.plans.workers import importable

# Common function words of some languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its
    just like me more my no not of on one only or other our out she so some than that the their them then there these they this to up was we were
    what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in
    ist ja kann mehr mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se
    ses son sont sur un une vous y été
    al como con de del el ella en entre era es esta este ha hay la las lo los más me mi muy no nos o para pero por que se ser sin sobre su sus también
    un una y ya
    che di e il è non per sono una gli della dei nel alla em não os uma dos het een van dat niet zijn op te
    """.split()
)
#: Elements whose content is never text of the page.
RAW = ("script", "style", "textarea", "title")
SKIPPED = frozenset("head script style noscript template iframe object svg math canvas select option button textarea nav footer aside form dialog menu".split())
#: Words in class, id or role that mark a part of the page as not its article.
MARKS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies
    copyright cta disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager
    pagination popup promo promotion related recommended search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe
    subscription tags teaser toolbar warning widget complementary contentinfo alert
    """.split()
)
#: Values of class, id, role and itemprop, in lower case without - and _, that mark the article of a page.
MAINS = frozenset("article articlebody articlecontent content entry entrycontent main maincontent post postbody postcontent story storybody".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul
    """.split()
)
#: Elements that are tracked until they are closed; the rest of the blocks only separate.
CONTAINERS = SKIPPED | frozenset("article blockquote body center details div dl fieldset figure header main ol section table td th tr ul li".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Characters from which a block can be decided, and from which it is long.
SHORT, LONG = 70, 200
LINKS, FEW_STOPS, MANY_STOPS = 0.33, 0.15, 0.30

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    tag: str
    links: int
    outside: bool
    section: int
    label: str = ""


def _marked(attributes: str) -> bool:
    if not attributes or "=" not in attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            if any(p.lower() in MARKS for p in _PARTS.findall("".join(values))):
                return True
    return False


def _main(attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        if name.lower() in ("class", "id", "role", "itemprop"):
            if any(re.sub("[-_]", "", v).lower() in MAINS for v in "".join(values).split()):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. section counts the article or main element around a block, 0 for none."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, not text, not the article, section
    open_tags: Counter[str] = Counter()  # of the stack: an end tag that nothing opened is passed over without a walk
    parts: list[str] = []
    linked, in_link, sections, tag_of, at = 0, 0, 0, "", 0

    def state():
        return stack[-1][1:] if stack else (False, False, 0)

    def close():
        nonlocal linked, parts
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            _, outside, section = state()
            out.append(Block(text, tag_of, linked, outside, section))
        parts, linked = [], 0

    def take(piece: str):
        nonlocal linked
        if piece and not state()[0]:
            piece = html.unescape(piece)
            parts.append(piece)
            if in_link:
                linked += len(_SPACE.sub(" ", piece))

    m = _TAG.search(page)
    while m:
        take(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag, ending = m[2].lower(), bool(m[1])
            if tag in BLOCKS:
                close()
                tag_of = "" if ending else tag
            elif tag in ("br", "td", "th"):
                take(" ")
            if tag == "a":
                in_link = 0 if ending else 1
            if tag in CONTAINERS or tag in RAW:
                if ending:
                    while open_tags[tag]:
                        left = stack.pop()[0]
                        open_tags[left] -= 1
                        if left == tag:
                            break
                elif not m[3].endswith("/"):
                    hidden, outside, section = state()
                    if tag == "body":
                        stack.clear()
                        open_tags.clear()
                        hidden, outside, section = False, False, 0
                    if tag in ("article", "main") or tag in ("div", "section") and not outside and not _marked(m[3]) and _main(m[3]):
                        sections += 1
                        section = section or sections
                    marked = tag != "body" and (tag == "header" and not section or _marked(m[3]))
                    hidden = hidden or tag in SKIPPED or tag in RAW
                    stack.append((tag, hidden, outside or marked, section))
                    open_tags[tag] += 1
                    if tag in RAW:
                        end = re.compile(rf"</{tag}\b", re.IGNORECASE).search(page, at)
                        at = end.start() if end else len(page)
        m = _TAG.search(page, at)
    take(page[at:])
    close()
    return out


def classify(found: list[Block]) -> list[Block]:
    """Labels each block good or bad.

    First pass: blocks of marked parts are bad, as are those of much link text; outside the articles of a page that
    has any, all are. Of the rest, long ones with stop words, and those with many, are good; long ones with hardly
    any stay open, as short ones do. Second pass: an open block takes the label of the nearest decided block of its
    article on either side; a heading looks ahead only. With none on either side it counts as good inside an article.
    """
    articles = any(b.section and not b.outside for b in found)
    for b in found:
        words = _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if b.outside or articles and not b.section or b.links > LINKS * len(b.text):
            b.label = "bad"
        elif len(b.text) >= SHORT and stops >= MANY_STOPS or len(b.text) >= LONG and stops >= FEW_STOPS:
            b.label = "good"
    n = len(found)
    ahead: list[tuple[int, str]] = [(n, "")] * (n + 1)  # nearest decided at or after i
    for i in range(n - 1, -1, -1):
        b = found[i]
        if b.label:
            ahead[i] = (i, b.label)
        elif i + 1 < n and found[i + 1].section == b.section:
            ahead[i] = ahead[i + 1]
    decided: list[str] = []
    last = (-1, "")
    for i, b in enumerate(found):
        if i and found[i - 1].section != b.section:
            last = (-1, "")
        if b.label:
            last = (i, b.label)
            decided.append(b.label)
            continue
        before, after = last, ahead[i]
        if b.section and before[1] == "bad" and after[1] != "bad":
            before = (-1, "")
        if re.fullmatch("h[1-6]", b.tag) and after[1]:
            decided.append(after[1])
        elif before[1] and after[1]:
            same = before[1] == after[1]
            decided.append(before[1] if same or i - before[0] <= after[0] - i else after[1])
        else:
            decided.append(before[1] or after[1] or ("good" if b.section else "bad"))
    for b, label in zip(found, decided, strict=True):
        b.label = label
    return found


def main_text(page: str | None) -> tuple[str, int]:
    """The good blocks joined by newlines, and the number of blocks of the page."""
    found = classify(blocks(page or ""))
    return "\n".join(b.text for b in found if b.label == "good"), len(found)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks.

    The whole html is read, of very long pages too, in time in proportion to its length; null counts as empty, and a
    page without any article text has an empty text. Null page_id and url pass through, ties and repeated rows are
    extracted alike, other columns are ignored, an empty table gives an empty result. Each page is treated by itself, in
    slices of a batch, so memory holds one slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array([t for t, _ in texts], pa.string()),
                        pa.array([len(t) for t, _ in texts], pa.int64()),
                        pa.array([n for _, n in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars", "n_blocks"],
                )

    importable(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, schema_of(pages, ["page_id", "url"], "text string, n_chars bigint, n_blocks bigint"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
