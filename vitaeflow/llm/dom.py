"""Web pages as trees of block elements with text runs as leaves.

The reader keeps what a content model needs: block elements with their cues,
and between two block boundaries one run of text with the share of it that is
linked. Inline markup vanishes, ``br`` is white space, formulas keep their text, scripts and
other unseen elements go with their content, unclosed and stray tags are mended the way browsers do it
for the common cases. It is linear in the length of the page.
"""

import html
import re

# HTML's element kinds.
BLOCKS = frozenset("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
summary table tbody td tfoot th thead tr ul""".split())
UNSEEN = frozenset("head script style template noscript title textarea iframe object svg canvas audio video".split())
_EMPTY = frozenset("hr".split())
#: A new one of these ends an open one of the named kinds in the same container.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "tr": {"tr", "td", "th"},
         "td": {"td", "th"}, "th": {"td", "th"}}
_CONTAINERS = frozenset("ul ol dl menu select table article section div body main nav footer aside header form td th".split())

# Cues in class, id, role and aria-label.
_AGAINST = re.compile(
    r"(?<![a-z])(?:ads?|adv|advert\w*|banner|bread\w*|byline|comment\w*|consent|cookie\w*|discuss\w*|disqus|footer|foot|gdpr|header|hidden|"
    r"legal|login|masthead|menu\w*|meta|modal|nav\w*|newsletter|notice\w*|pager|pagination|popup|promo\w*|related|reply|replies|"
    r"respond|search|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscri\w*|tags?|toolbar|widget\w*|warning|alert)(?![a-z])")
_FOR = re.compile(r"(?<![a-z])(?:article\w*|body|content|entry|main|post|story|text)(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)

#: Where a drawing ends that has no end tag: at the next block.
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?![a-z0-9-])", re.IGNORECASE)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_CLOSE = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")

#: Features by bit.
FEATURES = (
    "element", "against_tag", "for_tag", "heading", "paragraph", "list", "item", "table", "box", "against_cue", "for_cue", "hidden",
    "root", "leaf", "tiny", "short", "medium", "long", "linked", "part_linked", "sentence", "under_heading", "under_paragraph", "under_item",
)
BIT = {name: 1 << i for i, name in enumerate(FEATURES)}
_TAG_BITS = {
    **dict.fromkeys("nav footer aside header form menu dialog button select option optgroup search fieldset legend".split(), BIT["against_tag"]),
    **dict.fromkeys("article main".split(), BIT["for_tag"]),
    **dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), BIT["heading"]),
    **dict.fromkeys("p pre blockquote figcaption".split(), BIT["paragraph"]),
    **dict.fromkeys("ul ol dl dir".split(), BIT["list"]),
    **dict.fromkeys("li dt dd".split(), BIT["item"]),
    **dict.fromkeys("table tbody thead tfoot tr td th".split(), BIT["table"]),
    **dict.fromkeys("html body".split(), BIT["root"]),
}


class Page:
    """``parent``, ``bits`` and ``tag`` of every node, parents first; ``texts`` of the leaves by node number."""

    def __init__(self):
        self.parent, self.bits, self.tag, self.depth = [-1], [BIT["element"] | BIT["root"]], ["#page"], [0]
        self.texts: dict[int, str] = {}

    def add(self, parent: int, bits: int, tag: str) -> int:
        self.parent.append(parent)
        self.bits.append(bits)
        self.tag.append(tag)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1


def _element_bits(tag: str, attributes: str) -> int:
    bits = BIT["element"] | _TAG_BITS.get(tag, BIT["box"])
    if attributes:
        marks = " ".join(_MARKS.findall(attributes)).lower().replace("_", "-")
        if marks:
            bits |= BIT["against_cue"] if _AGAINST.search(marks) else 0
            bits |= BIT["for_cue"] if _FOR.search(marks) else 0
        low = attributes.lower()
        if _HIDDEN.search(attributes) or re.search(r"(?:^|\s)hidden(?:\s|=|$)", low):
            bits |= BIT["hidden"]
    return bits


def _leaf_bits(text: str, linked: int, above: int) -> int:
    n = len(text)
    bits = BIT["leaf"] | BIT["tiny" if n < 15 else "short" if n < 60 else "medium" if n < 200 else "long"]
    bits |= BIT["linked"] if 2 * linked >= n else BIT["part_linked"] if 10 * linked >= n else 0
    bits |= BIT["sentence"] if text[-1] in ".!?…:;\"”»" else 0
    bits |= BIT["under_heading"] if above & BIT["heading"] else 0
    bits |= BIT["under_paragraph"] if above & BIT["paragraph"] else 0
    bits |= BIT["under_item"] if above & BIT["item"] else 0
    return bits


def read_page(source: str | None) -> Page:
    """The tree of a page; a null or empty page is a root alone."""
    page = Page()
    if not source:
        return page
    stack: list[tuple[str, int]] = [("#page", 0)]
    run: list[str] = []
    in_link = linked = 0
    at, plain = 0, False
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                above = stack[-1][1]
                page.texts[page.add(above, _leaf_bits(text, min(linked, len(text)), page.bits[above]), "#text")] = text
            run.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        run.append(text)
        if in_link:
            linked += len(text)

    while True:
        mark = source.find("<", at)
        if mark < 0:
            put(source[at:])
            break
        if mark > at:
            put(source[at:mark])
        if source.startswith("<!--", mark):
            end = source.find("-->", mark + 4)
            at = len(source) if end < 0 else end + 3
        elif source[mark + 1 : mark + 2] in ("!", "?"):
            end = source.find(">", mark)
            at = len(source) if end < 0 else end + 1
        elif not (name := _NAME.match(source, mark + 1)):
            put("<")
            at = mark + 1
        else:
            # quoted > do not end a tag, unless a quote of this page was found open
            close = None if plain else _CLOSE.match(source, name.end())
            if close is None:
                plain = True
                end = source.find(">", name.end())
                if end < 0:
                    break  # the page ends inside a tag
                end += 1
            else:
                end = close.end()
            tag, at = name[2].lower(), end
            if tag == "a":
                in_link = 0 if name[1] else 1
            elif tag == "br":
                put(" ")
            elif tag in UNSEEN:
                if not name[1] and source[end - 2] != "/":
                    at = _behind(source, tag, end, endless)
            elif tag in BLOCKS:
                flush()
                if name[1]:
                    _closed(stack, tag)
                else:
                    _opened(page, stack, tag, source[name.end() : end - 1])
    flush()
    return page


def _behind(source: str, tag: str, at: int, endless: set[str]) -> int:
    """Behind the end of an unseen element. Where it has none: behind its start tag for ``head``, at the next block for
    ``svg``, else at the page's end. ``endless`` are the tags that have no end in the rest of the page.
    """
    end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(source, at)
    if end:
        return end.end()
    endless.add(tag)
    if tag == "svg":
        block = _BLOCK_TAG.search(source, at)
        return block.start() if block else len(source)
    return at if tag == "head" else len(source)


def _opened(page: Page, stack: list[tuple[str, int]], tag: str, attributes: str) -> None:
    ends = _ENDS.get(tag, set())
    # a paragraph ends where a block begins; items and cells end their like up to the container
    while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in ends):
        stack.pop()
    if tag in ends:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                del stack[i:]
                break
            if stack[i][0] in _CONTAINERS:
                break
    if tag in ("html", "body") and any(open_tag == tag for open_tag, _ in stack):
        return
    if tag not in _EMPTY:
        stack.append((tag, page.add(stack[-1][1], _element_bits(tag, attributes), tag)))


def _closed(stack: list[tuple[str, int]], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] == tag:
            del stack[i:]
            return
