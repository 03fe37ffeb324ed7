"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks from
what they are: blocks in menus, headers, footers, side bars, notices, adverts,
forms or comments (by element, role, class or id) and blocks made of links are
boilerplate; long blocks with the stop-word density of running text are content,
and if a page has none of these, as in a language without stop words here, all
other long blocks are. A class or id is evidence, not a verdict: on a page with no
content otherwise, the long blocks of running text that only such a name speaks against are it.
The second pass gives every block left, mostly short ones, the label of its
nearest decided neighbours: if the two differ, the neighbour in the closer
common container wins, then the nearer one, and a heading goes with what
follows. If a page has ``article`` or ``main`` elements with content, only blocks in
them can be content; in such an element an undecided block is content unless
both neighbours are boilerplate by their own links.

Markup is read by one linear scan that copes with missing end tags, unquoted
attributes, unclosed comments and raw-text elements. Character references are
decoded, white space in a block becomes one space, blocks are joined by line
feeds in page order. Nothing is cut or capped.

Rows: null or empty pages, and pages without content, give an empty text.
Repeated rows give equal texts. Columns pass unchanged, the added one replaces a
column of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import output_schema, replace_column

LONG = 70
STOP_DENSITY = 0.2
LINK_DENSITY = 0.5
NESTING = 512  # sections nested deeper count as the one at this depth, as in browsers

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+(?:>|\Z)|[^<]+|<",
    re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {name: re.compile(rf"</{name}", re.IGNORECASE) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
SECTIONS = CONTENT | frozenset("body section div td blockquote".split())
BAD_ELEMENTS = frozenset(
    "nav footer aside form button select menu dialog noscript svg canvas object template video audio fieldset label".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner cookie "
    "cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup popup modal overlay "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar "
    "comment comments disqus reply replies respond share sharing social related recommended recommendations widget "
    "login search copyright legal disclaimer hidden".split())
# What an open tag closes first: these elements, up to the nearest of the others.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])), "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

# -- frequent function words of some languages ---------------------------------------
STOP_WORDS = frozenset(
    "a an and are as at be been but by can could did do does for from had has have he her his i if in into is it its more no "
    "not of on or our she so than that the their them then there these they this to was we were what when which who will "
    "with would you "
    "aber als am an auch auf aus bei bin bis das dem den der des die durch ein eine einem einen einer er es für hat ich im in "
    "ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir wird zu zum zur "
    "al como con de del desde donde dos el ella en entre era es esta este está fue ha hay la las le lo los más me mi muy no nos "
    "o para pero por porque que se si sin sobre son su sus también un una y ya "
    "au aux avec ce ces cette dans des du elle en est et eux il ils je leur leurs lui mais même nous on ou où par pas plus pour "
    "qu que qui sa ses son sont sur te tout très une vous "
    "che di e gli nel non per piu sono della delle um uma não com os as dos het een van niet op te zijn".split())


NAMED, SURE = 1, 2  # boilerplate by class or id only; by element, role or style


class Block:
    __slots__ = ("pieces", "linked", "bad", "named", "path", "heading", "text", "label")

    def __init__(self, bad: int, path: tuple[int, ...], heading: bool):
        self.pieces: list[str] = []
        self.linked = 0
        self.bad, self.named = bad > 0, bad == NAMED
        self.path, self.heading = path, heading
        self.text, self.label = "", None


def _is_bad(name: str, attributes: str, in_content: bool) -> int:
    if name in BAD_ELEMENTS or (name == "header" and not in_content):
        return SURE
    if not attributes or name in ("html", "body", *CONTENT):
        if "comment" not in attributes:
            return 0
    named = 0
    for match in ATTRIBUTE.finditer(attributes):
        key, value = match.group(1).lower(), match.group(2) or match.group(3) or match.group(4) or ""
        if key in ("class", "id"):
            if not BAD_NAMES.isdisjoint(part.lower() for part in NAME_PART.findall(value)):
                named = NAMED
        elif key == "role":
            if value.strip().lower() in BAD_ROLES:
                return SURE
        elif key == "style":
            if "display:none" in value.replace(" ", "").lower():
                return SURE
        elif key == "hidden" or value == "true":
            return SURE
    return named


def blocks(page: str) -> list[Block]:
    """Non-empty blocks in page order. The stack holds (element, bad, in a link, in content, path of sections)."""
    found: list[Block] = []
    root = ("", 0, False, False, ())
    stack: list[tuple[str, int, bool, bool, tuple[int, ...]]] = [root]
    opened: Counter[str] = Counter()
    current: Block | None = None
    sections, at, end = 0, 0, len(page)

    def pop_to(index: int) -> None:
        nonlocal current
        for name, bad, *_ in stack[index:]:
            opened[name] -= 1
            if name in BLOCKS or bad != stack[index - 1][1]:
                current = None
        del stack[index:]

    while at < end:
        match = TOKEN.match(page, at)
        at = match.end()
        name = match.group(2)
        if name is None:
            text = match.group()
            if text[0] == "<" and len(text) > 1 or current is None and text.isspace():
                continue
            _, bad, linked, _, path = stack[-1]
            if current is None:
                current = Block(bad, path, any(s[0] in HEADINGS for s in stack[-4:]))
                found.append(current)
            current.pieces.append(text)
            if linked:
                current.linked += len(text.strip())
            continue
        name = name.lower()
        if match.group(1):
            if opened[name] > 0:
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            if name in BLOCKS:
                current = None
            continue
        if name in RAW:
            close = RAW_END[name].search(page, at)
            at = close.start() if close else end
            if name == "textarea":
                current = None
            continue
        if name in BLOCKS:
            current = None
            if opened["p"] > 0:  # a block ends an open paragraph
                for index in range(len(stack) - 1, 0, -1):
                    if stack[index][0] == "p":
                        pop_to(index)
                        break
                    if stack[index][0] in BLOCKS or stack[index][0] == "button":
                        break
            if name in IMPLIED and any(opened[x] > 0 for x in IMPLIED[name][0]):
                closed, stop = IMPLIED[name]
                index, cut = len(stack) - 1, None
                while index > 0 and stack[index][0] not in stop:
                    cut = index if stack[index][0] in closed else cut
                    index -= 1
                if cut is not None:
                    pop_to(cut)
        if name in VOID:
            if current is not None and name == "br":
                current.pieces.append(" ")
            continue
        attributes = match.group(3)
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        _, bad, linked, content, path = stack[-1]
        own = bad if bad == SURE else max(bad, _is_bad(name, attributes, content))
        if own != bad:
            current = None
        if name in SECTIONS and len(path) < NESTING:
            sections += 1
            path += (-sections if name in CONTENT else sections,)
        stack.append((name, own, linked or name == "a", content or name in CONTENT, path))
        opened[name] += 1
    for block in found:
        block.text = " ".join(references.unescape("".join(block.pieces)).split())
    return [b for b in found if b.text]


def stop_density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(found: list[Block]) -> None:
    sparse = []
    for block in found:
        size = len(block.text)
        if block.bad or block.linked > LINK_DENSITY * size:
            block.label = False
        elif size >= LONG:
            if stop_density(block.text) >= STOP_DENSITY:
                block.label = True
            elif not any(p < 0 for p in block.path):
                block.label = False
                sparse.append(block)
    if any(block.label for block in found):
        return
    for block in sparse:  # the stop words don't tell on this page
        block.label = True
    if not sparse and not any(p < 0 for b in found if not b.bad for p in b.path):
        for block in found:
            size = len(block.text)
            if block.named and size >= LONG and block.linked <= LINK_DENSITY * size and (
                    stop_density(block.text) >= STOP_DENSITY):
                block.bad, block.label = False, True


def _closeness(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    depth = 0
    for x, y in zip(a, b):
        if x != y:
            break
        depth += 1
    return depth


def second_pass(found: list[Block]) -> list[bool]:
    """Labels of all blocks; undecided ones look at decided neighbours of the first pass."""
    contents = {p for b in found if not b.bad for p in b.path if p < 0}
    before: list[int | None] = []
    last: dict[int, int | None] = {}
    n = len(found)

    def group(block: Block) -> int:
        return min((p for p in block.path if p < 0), default=0)

    def usable(block: Block) -> bool:
        return block.label is not None and not (block.bad and group(block))

    for i, block in enumerate(found):
        before.append(last.get(group(block)))
        if usable(block):
            last[group(block)] = i
    after: list[int | None] = [None] * n
    last = {}
    for i in range(n - 1, -1, -1):
        after[i] = last.get(group(found[i]))
        if usable(found[i]):
            last[group(found[i])] = i
    labels = []
    for i, block in enumerate(found):
        if block.label is not None:
            labels.append(block.label)
            continue
        left, right = before[i], after[i]
        sides = [found[j].label for j in (left, right) if j is not None]
        if group(block):
            labels.append(len(sides) < 2 or any(sides))
        elif not sides:
            labels.append(False)
        elif len(sides) == 1 or sides[0] == sides[1]:
            labels.append(sides[0])
        elif block.heading:
            labels.append(found[right].label)
        else:
            near = [(_closeness(block.path, found[j].path), -abs(i - j), found[j].label) for j in (left, right)]
            labels.append(max(near)[2])
    if contents and any(label and group(b) for label, b in zip(labels, found)):
        labels = [label and bool(group(b)) for label, b in zip(labels, found)]
    elif not any(labels):  # nothing decided: short blocks that are no boilerplate are all there is
        labels = [b.label is None for b in found]
    return labels


def main_text(page: str) -> str:
    found = blocks(page)
    first_pass(found)
    return "\n".join(b.text for b, keep in zip(found, second_pass(found)) if keep)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of each whole page."""
    schema = output_schema(pages, {text: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [main_text(page.as_py() or "") for page in batch.column(html)]
            yield replace_column(batch, {text: pa.array(found, pa.string())})

    return pages.mapInArrow(run, schema)
