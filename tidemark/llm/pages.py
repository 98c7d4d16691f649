"""HTML extraction by two passes of block rules.

Method: a page is cut into blocks at block-level tags; what stands in scripts, styles, forms, menus, headers, footers,
sidebars and elements whose class, id or role names a notice, an advert or comments is boilerplate from the start. Names
are whole words of a class or id, at its end or before a word for a container; those of a page's layout never sink an
article or main element inside, nor paragraphs and headings of one. The first pass classifies each other block by its
length, the share of its characters in links and its density of stop words: good, bad, short or near-good. In the second
pass near-good and short blocks inherit the label of the nearest decided blocks before and after them: good if both are,
or for near-good ones if one is. Headings of good blocks stay. An article or main element is evidence of its own: in it,
near-good blocks are good, one good neighbour is enough, blocks without a decided neighbour are good, and boilerplate by
place or name decides nothing about its neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import kernel

#: Function words of the languages known here; a block's share of them is its stop-word density.
STOP_WORDS = frozenset(
    """
    a about all also an and are as at be because been but by can for from had has have he her his i if in into is it its more
    not of on one or our she so some than that the their them there these they this to was we were what when which who will
    with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer er es für hat
    ich ihr im in ist kann mit nach nicht noch nur oder sich sie sind so über um und uns unter von vor war was wenn wer wie
    wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas
    plus pour qu que qui sa se ses son sont sur un une vous y
    al como con cuando de del donde el ella en era es esta este ha hay la las le lo los más me muy no nos o para pero por
    porque que se ser si sin sobre son su sus también tu un una y ya yo
    che da dei del della di e gli il nel non per più sono una
    as com da do dos e em mais na nas no nos não o os para por que se sua um uma
    aan dat de een en het in is met niet op te van voor zijn
    """.split()
)
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, MOST_LINKS, LONG_HEADING = 40, 140, 0.12, 0.22, 0.33, 200

_BLOCK = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
_DROP = frozenset("nav header footer aside form menu select button textarea noscript iframe object svg canvas dialog template head title fieldset".split())
#: What is not shown, whichever begins first: comments, declarations, and elements whose content is not markup.
_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)", re.I | re.S
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""")
_NAME = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Names of what readers and other pages say: all inside goes.
_OTHERS = frozenset("comment comments commentlist commentary respond replies reply disqus discussion related recommended recommendation recommendations".split())
#: Names of what stands around a text.
_AROUND = frozenset(
    """
    ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice
    notices alert alerts popup modal newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer masthead
    header toolbar pagination pager share sharing social widget widgets tags search copyright legal complementary contentinfo
    """.split()
)
#: Words for containers, which may follow a name, and words before a name that make it say something else.
_CONTAINERS = frozenset("area bar block body bottom box button buttons container content form group inner item items left link links list panel right row section slot text thread title top unit wrap wrapper".split())
_ELSE = frozenset("no non not has have with without is category tag topic type format".split())
_KEEP = frozenset(("html", "body", "main"))
_HOLD = frozenset(("article", "main"))
#: Elements that go unless they hold an article or main element.
_SOFT = frozenset(("header", "form"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_HEADING = re.compile(r"h[1-6]")
_WORD = re.compile(r"[^\W\d_]+")
_WHITE = re.compile(r"\s+")
_COMMENT = re.compile(r"(?:^|\s)(?:comment|reply)(?:-body|-content)?(?:\s|$)", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(1 << 14)
def _named(words: str) -> int:
    """2 if a class, id or role names what others say, 1 if it names what stands around a text, else 0."""
    most = 0
    for word in words.split():
        parts = [x.lower() for x in _PARTS.split(word) if x]
        if not parts or len(parts) > 1 and parts[0] in _ELSE:
            continue
        while len(parts) > 1 and (parts[-1] in _CONTAINERS or parts[-1].isdigit()):
            parts.pop()
        most = max(most, 2 if parts[-1] in _OTHERS else 1 if parts[-1] in _AROUND else 0)
    return most


def blocks(page: str) -> list[tuple[str, str, bool, int, bool]]:
    """(tag, text, boilerplate, characters in links, in an article or main element) of a page's blocks in order, with references decoded."""
    page = _HIDDEN.sub(" ", page)
    out: list[tuple[str, str, bool, int, bool]] = []
    #: open elements: name, what of hard and soft they add, and the soft count that an article or main set aside
    stack: list[tuple[str, int, int, int]] = []
    hard = soft = links = held = 0
    parts: list[str] = []
    linked = 0
    kind = "body"

    def flush() -> None:
        nonlocal parts, linked
        text = _WHITE.sub(" ", "".join(parts)).strip()
        if text:
            spared = held > 0 and (kind == "p" or _HEADING.fullmatch(kind) is not None)
            out.append((kind, text, hard > 0 or soft > 0 and not spared, linked, held > 0))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(_WHITE.sub(" ", text).strip())

    def close() -> None:
        nonlocal hard, soft, held
        name, h, s, aside = stack.pop()
        hard -= h
        soft -= s
        if name in _HOLD:
            held -= 1
            soft = aside

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2].lower()
        block = name in _BLOCK or name in _DROP
        if block:
            flush()
        if not m[1]:
            if name in _VOID or m[3].endswith("/"):
                continue
            if block:
                for last in _CLOSES.get(name, "").split():
                    if stack and stack[-1][0] == last:
                        close()
            names = " ".join(x or y or z for x, y, z in _NAME.findall(m[3])) if m[3] and name not in _KEEP else ""
            level = _named(names) if names else 0
            if name == "article":  # a reader's comment may be one
                level = 2 if level == 2 and _COMMENT.search(names) else 0
            h = int(name in _DROP and name not in _SOFT or level == 2)
            s = int(not h and (name in _SOFT or level == 1))
            if name == "a":
                links += 1
            if block or h or s:
                aside = 0
                if name in _HOLD:
                    held += 1
                    aside, soft = soft, 0
                stack.append((name, h, s, aside))
                hard += h
                soft += s
                kind = name
        else:
            if name == "a":
                links = max(0, links - 1)
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                flush()
                while len(stack) > depth:
                    close()
                kind = stack[-1][0] if stack else "body"
    if at < len(page):
        add(page[at:])
    flush()
    return out


def first_pass(block: tuple[str, str, bool, int, bool]) -> str:
    """noise, bad, heading, short, near or good, by the block alone."""
    tag, text, noise, linked, _ = block
    if noise:
        return "noise"
    words = _WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if linked > MOST_LINKS * len(text):
        return "bad"
    if _HEADING.fullmatch(tag) and len(text) <= LONG_HEADING:
        return "heading"
    if len(text) < LENGTH_LOW:
        return "short"
    if density >= STOP_HIGH and len(text) >= LENGTH_HIGH:
        return "good"
    return "near" if density >= STOP_LOW or len(text) >= LENGTH_HIGH else "short"


def classify(found: list[tuple[str, str, bool, int, bool]]) -> list[bool]:
    """Whether each block is main text.

    Blocks in an article or main element only look at neighbours in such an element; where none is decided they are good.
    """
    first = [first_pass(block) for block in found]
    inside = [block[4] for block in found]
    near = ["good" if x == "near" and ("good" in (a, b) or inside[k] or len(found[k][1]) >= LENGTH_HIGH) else x for k, (x, (a, b)) in enumerate(zip(first, _decided(first, inside), strict=True))]
    out = []
    for x, within, (a, b) in zip(near, inside, _decided(near, inside), strict=True):
        if x in ("good", "bad", "noise"):
            out.append(x == "good")
        elif within:
            out.append("good" in (a, b) or a == b == "none")
        elif x == "heading":
            out.append(b == "good")
        else:
            out.append(a == b == "good")
    return out


def _decided(labels: list[str], inside: list[bool]) -> list[tuple[str, str]]:
    """The labels of the nearest decided blocks before and after each one; "none" where there is none.

    Noise counts as bad, but not for blocks in an article or main element.
    """

    def sweep(order: range) -> list[str]:
        seen, within, anywhere = ["none"] * len(labels), "none", "none"
        for k in order:
            seen[k] = within if inside[k] else anywhere
            if labels[k] in ("good", "bad"):
                anywhere = labels[k]
                within = labels[k] if inside[k] else within
            elif labels[k] == "noise":
                anywhere = "bad"
        return seen

    return list(zip(sweep(range(len(labels))), sweep(range(len(labels) - 1, -1, -1)), strict=True))


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(block[1] for block, good in zip(found, classify(found), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (html and any others) with ``text``, the main text, and ``n_chars``, its code points, in place of html.

    Null, empty and text-free pages have an empty text. Each row is read alone and whole; columns named text or n_chars
    are replaced.
    """
    pages = pages.drop("text", "n_chars")
    rest = [c for c in pages.columns if c != "html"]
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            texts = [main_text(x) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    return pages.mapInArrow(run, T.StructType([*(pages.schema[c] for c in rest), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
