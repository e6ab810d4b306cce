"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags.  Tags score negative; words score
positive, or negative where they stand in an element that pages keep beside
their content.  How much follows from labelled pages: those whose content is
marked by exactly one ``article`` or ``main`` element.  One linear scan finds
the contiguous region with the largest sum; its blocks, without what scores
negative inside, are the main text.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes

# Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "audio", "video", "canvas", "select", "title", "xmp", "noframes")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BESIDE = frozenset("nav header footer aside form button menu dialog fieldset head label".split())
CONTENT = frozenset("article main".split())
# Words of class, id and role attributes that mark what stands beside the content.
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner billboard sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer bottombar copyright legal "
    "sidebar aside complementary widget widgets related recommended recommendations more trending popular "
    "notice notices cookie cookies consent gdpr banner alert popup modal overlay paywall "
    "form newsletter subscribe subscription signup login search searchbox "
    "comment comments commentlist disqus discussion replies reply respond "
    "share sharing social toolbar hidden skip contentinfo".split()
)
#: Last words of compound names that mark content, whatever comes before them.
NOUNS = frozenset("article body content entry heading post results story text title".split())
#: In a heading or paragraph only these mark something beside the content.
IN_TEXT = HINTS - frozenset("header masthead banner more popular trending search social legal alert related recommended".split())
PHRASING = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Open elements that end where an element of the name begins.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
UNPAIRED = 50  # tags of a page with unpaired quotes; later ones end at the next ">" whatever the quotes


def hints_of(name: str, value: str) -> set[str]:
    """The hints in a class, id or role of an element.  A compound name such as
    ``comment-list`` is one thing: its last word says what it is, or its first
    one if the last is neutral."""
    found = set()
    for token in value.strip("\"'").lower().split():
        parts = _PART.findall(token)
        if not parts:
            continue
        if len(parts) == 1 or name not in PHRASING:
            kinds = IN_TEXT if name in PHRASING else HINTS
            if parts[-1] in kinds:
                found.add(parts[-1])
            elif parts[0] in kinds and parts[-1] not in NOUNS:
                found.add(parts[0])
    return found


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    marks = [f"tag:{name}"] if name in BESIDE or name in CONTENT else []
    if attributes:
        if name not in ("body", "html", "article", "main"):
            marks += sorted(f"hint:{w}" for w in set().union(*(hints_of(name, x) for x in _MARKS.findall(attributes))))
        if _HIDDEN.search(_MARKS.sub("", attributes)):
            marks.append("hint:hidden")
    return tuple(marks)


def tokens(page: str):
    """``(kind, value, marks)``: kind 0 text (character references undecoded),
    1 opening tag, 2 closing tag.  Comments, scripts, styles and the like give
    nothing.  One scan from left to right; what looks like a tag but never
    closes is text."""
    at = start = unpaired = 0
    while (lt := page.find("<", at)) >= 0:
        name = None
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = len(page) if end < 0 else end + 3
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt) + 1
            if not end:
                break
        elif name := _NAME.match(page, lt):
            rest = _REST.match(page, name.end()) if unpaired < UNPAIRED else None
            if rest:
                end = rest.end()
            else:
                unpaired += 1
                end = page.find(">", name.end()) + 1
                if not end:
                    break
        else:
            at = lt + 1
            continue
        if lt > start:
            yield 0, page[start:lt], ()
        if name:
            tag, closing = name[1].lower(), page[lt + 1] == "/"
            if tag in _RAW_END:
                if not closing and page[end - 2] != "/":
                    over = _RAW_END[tag].search(page, end)
                    end = over.end() if over else len(page)
            elif closing:
                yield 2, tag, ()
            else:
                yield 1, tag, _marks(tag, page[name.end() : end - 1])
        at = start = end
    if start < len(page):
        yield 0, page[start:], ()


def walk(page: str):
    """``(block, text or None, marks, tag)`` in page order: ``block`` counts
    the blocks, ``marks`` is the set of all open elements' marks.

    Linear in the page: each block element holds the inline elements open in
    it, and every element the union of the marks around it (a small fixed set).
    """
    nothing = frozenset()
    frames: list[tuple[str, frozenset, list, dict]] = [("", nothing, [], {})]  # block, marks, inline elements in it, how many of each
    blocks: dict[str, int] = {}
    block = 0

    def around():
        _, marks, inline, _ = frames[-1]
        return inline[-1][1] if inline else marks

    def close():
        blocks[frames.pop()[0]] -= 1

    for kind, value, own in tokens(page):
        if kind == 0:
            yield block, value, around(), None
            continue
        if value in BLOCK:
            block += 1
        if kind == 1:
            if value in BLOCK:
                if frames[-1][0] == "p":  # an open paragraph ends here
                    close()
                while frames[-1][0] in ENDS.get(value, ()):
                    close()
            yield block, None, around(), value
            marks = around().union(own) if own else around()
            if value in BLOCK:
                if value not in VOID:
                    frames.append((value, marks, [], {}))
                    blocks[value] = blocks.get(value, 0) + 1
            elif value not in VOID:
                frames[-1][2].append((value, marks))
                frames[-1][3][value] = frames[-1][3].get(value, 0) + 1
        else:
            if value in BLOCK:
                if blocks.get(value):
                    while frames[-1][0] != value:
                        close()
                    close()
            elif frames[-1][3].get(value):  # an inline element's end doesn't close blocks around it
                _, _, inline, many = frames[-1]
                while True:
                    last = inline.pop()[0]
                    many[last] -= 1
                    if last == value:
                        break
            yield block, None, around(), value


def counts(page: str) -> dict[str, tuple[int, int]]:
    """Of a labelled page: feature -> its words inside and outside the content;
    ``tag:*`` for tags, ``word`` for all words.  Of other pages nothing."""
    found: dict[str, list[int]] = {}
    steps = list(walk(page))
    if sum(1 for kind, value, _ in tokens(page) if kind == 1 and value in CONTENT) != 1:
        return {}
    for _, text, marks, tag in steps:
        inside = "tag:article" in marks or "tag:main" in marks
        if text is None:
            names, n = (f"open:{tag}",) if tag in BLOCK or tag == "a" else (), 1
        else:
            n = len(text.split())
            names = ("word", *marks)
        for f in names:
            found.setdefault(f, [0, 0])[not inside] += n
    return {k: (a, b) for k, (a, b) in found.items()}


def learn(pages: DataFrame, *, text: str = "html") -> dict[str, float]:
    """Weights from all labelled pages of ``pages``.

    For each feature the logarithm of how much likelier its words stand inside
    the content than outside, with prior counts from the element's role, so
    that features no labelled page shows keep a sensible sign.  The features
    are a fixed set of tags and hints: the result is small whatever the input.
    """

    def run(batches):
        import pyarrow as pa

        total: dict[str, list[int]] = {}
        for batch in batches:
            for page in column_bytes(batch, "_html"):
                for k, (a, b) in counts((page or b"").decode("utf-8", "replace")).items():
                    own = total.setdefault(k, [0, 0])
                    own[0] += a
                    own[1] += b
        if total:
            yield pa.record_batch([pa.array(list(total)), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1] for x in total.values()], pa.int64())], ["feature", "inside", "outside"])

    rows = pages.select(F.col(text).alias("_html")).mapInArrow(run, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    seen = {r["feature"]: (r["i"], r["o"]) for r in rows}
    all_in, all_out = seen.get("word", (0, 0))
    base = math.log((all_in + 100) / (all_out + 100))
    weights = {}
    for f in [*(f"tag:{t}" for t in sorted(BESIDE | CONTENT)), *(f"hint:{h}" for h in sorted(HINTS))]:
        a, b = seen.get(f, (0, 0))
        prior = (40, 1) if f[4:] in CONTENT else (1, 40)
        weights[f] = max(-4.0, min(4.0, math.log((a + prior[0]) / (b + prior[1])) - base * (a + b > 0)))
    for t in sorted(BLOCK | {"a"}):
        a, b = seen.get(f"open:{t}", (0, 0))
        weights[f"open:{t}"] = -max(0.05, min(1.5, math.log((b + 2) / (a + 2)) + 0.3))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """``[a, b)`` of the contiguous run with the largest sum (the first of
    equal ones, the shortest of those that begin alike); empty if none is
    positive."""
    best = run = 0.0
    start = a = b = 0
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, a, b = run, start, i + 1
    return a, b


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best region of one page."""
    texts, scores, blocks = [], [], []  # one entry a run of text or a tag
    steps = list(walk(page))
    rooted = any(tag in CONTENT for _, text, _, tag in steps if text is None)
    judged: dict[frozenset, tuple[float, float]] = {}  # the lowest and highest weight around
    for block, text, marks, tag in steps:
        if text is None:
            scores.append(weights.get(f"open:{tag}", -0.02))
            texts.append("\n" if tag == "br" else None)
        else:
            if marks not in judged:
                own = [weights[f] for f in marks if f in weights]
                low = min(own, default=0.0)
                if rooted and "tag:article" not in marks and "tag:main" not in marks:
                    low = min(low, -0.5)  # the page marks its content, and this isn't in it
                judged[marks] = low, max(own, default=0.0)
            low, high = judged[marks]
            # the most telling element around decides: beside the content, or the content itself, or neither
            scores.append(len(text.split()) * (max(low, -0.5) if low < 0 else 1.0 + high / 4))
            texts.append(text if low >= 0 else None)
        blocks.append(block)
    a, b = best_region(scores)
    out: list[list[str]] = []
    last = None
    for i in range(a, b):
        if texts[i] is None:
            continue
        if blocks[i] != last:
            out.append([])
            last = blocks[i]
        out[-1].append(texts[i])
    lines = (" ".join(html.unescape("".join(x)).split()) for x in out)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, *, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page; ``weights`` are learned from
    the pages themselves if none are given.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed.  A null or wordless page, or one
    whose words all stand beside the content, has the empty text.  Markup that
    never closes is read to the end of the page.  Repeated rows each come back;
    an empty table gives an empty result.
    """
    weights = learn(pages, text=text) if weights is None else weights
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [main_text((p or b"").decode("utf-8", "replace"), weights) for p in column_bytes(batch, "_html")]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], ["_key", "_url", "text", "n_chars"])

    out = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(text).alias("_html")).mapInArrow(run, f"_key {kinds[key]}, _url {kinds[url]}, text string, n_chars long")
    return out.withColumnsRenamed({"_key": key, "_url": url})
