"""Operator 7: main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. A block is described by its number of words and the share of them inside links, the
same of the block before and after it, and a mark from the elements around it: 2 in a content element by tag, 1 by a word of
its class, id or role, 0 if none says anything, -1 in boilerplate by such a word, -2 by tag or among readers' comments. A
decision tree, grown from the labelled table below, classifies blocks; the text of a page is that of its content blocks. Where a
mark rests on words alone the table has rows of either class: words, links and neighbours decide. One pass over Arrow
batches, no shuffle; the tree is all that is sent.

The nearest element that says something decides, with these bounds. A name doesn't make content of what is inside boilerplate
or comments; an article or main element does, if no other came before. A name that says boilerplate counts for nothing on an
element that holds most of the page's words and its main heading, nor where it names the layout of a wrapper.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import common

#: Labelled blocks: words and link share, of the block itself, of the one before and of the one after, and the mark; 1 if the
#: block is main text. Written by hand from common page layouts.
LABELLED: list[tuple[tuple[float, ...], int]] = [
    # no marks: paragraphs among others, after a heading, with some links, before lists of links or a footer
    ((60, 0.0, 3, 0.0, 45, 0.0, 0), 1), ((25, 0.05, 60, 0.0, 30, 0.0, 0), 1), ((100, 0.0, 2, 1.0, 3, 1.0, 0), 1), ((18, 0.0, 40, 0.0, 2, 1.0, 0), 1), ((40, 0.2, 25, 0.0, 70, 0.1, 0), 1),
    ((55, 0.0, 7, 0.0, 12, 0.0, 0), 1), ((130, 0.0, 8, 0.0, 9, 0.1, 0), 1), ((32, 0.0, 80, 0.0, 10, 0.0, 0), 1), ((24, 0.0, 110, 0.0, 8, 0.3, 0), 1), ((75, 0.1, 14, 0.0, 20, 0.0, 0), 1),
    ((45, 0.0, 12, 0.0, 0, 0.0, 0), 1), ((90, 0.0, 0, 0.0, 0, 0.0, 0), 1), ((200, 0.03, 5, 0.0, 6, 1.0, 0), 1), ((28, 0.15, 33, 0.0, 41, 0.2, 0), 1), ((60, 0.3, 50, 0.1, 45, 0.0, 0), 1),
    ((22, 0.0, 21, 0.0, 70, 0.0, 0), 1), ((16, 0.0, 17, 0.0, 18, 0.0, 0), 1), ((35, 0.0, 4, 0.0, 3, 0.0, 0), 1), ((50, 0.0, 10, 0.0, 14, 0.0, 0), 1), ((300, 0.0, 90, 0.0, 11, 0.0, 0), 1),
    # no marks: headings and short paragraphs before or between paragraphs, a paragraph's last short line
    ((8, 0.0, 30, 0.0, 45, 0.0, 0), 1), ((3, 0.0, 50, 0.0, 60, 0.0, 0), 1), ((6, 0.0, 90, 0.0, 35, 0.0, 0), 1), ((9, 0.0, 12, 0.0, 60, 0.0, 0), 1), ((7, 0.0, 10, 0.0, 85, 0.0, 0), 1),
    ((12, 0.0, 15, 0.0, 120, 0.0, 0), 1), ((4, 0.0, 14, 0.0, 40, 0.0, 0), 1), ((1, 0.0, 70, 0.0, 55, 0.0, 0), 1), ((2, 0.0, 40, 0.0, 33, 0.0, 0), 1), ((14, 0.0, 60, 0.0, 25, 0.1, 0), 1),
    ((5, 0.0, 45, 0.0, 11, 0.0, 0), 1), ((8, 0.0, 70, 0.0, 9, 0.0, 0), 1), ((11, 0.0, 38, 0.0, 7, 0.0, 0), 1), ((6, 0.0, 9, 0.0, 30, 0.0, 0), 1), ((10, 0.0, 8, 0.0, 50, 0.0, 0), 1), ((3, 0.0, 5, 0.0, 90, 0.0, 0), 1),
    ((13, 0.1, 55, 0.0, 70, 0.0, 0), 1), ((2, 0.0, 6, 0.0, 60, 0.0, 0), 1), ((9, 0.0, 95, 0.0, 16, 0.0, 0), 1), ((4, 0.0, 30, 0.0, 100, 0.0, 0), 1),
    # no marks: a first paragraph or heading right after a menu
    ((40, 0.0, 1, 1.0, 0, 0.0, 0), 1), ((55, 0.0, 3, 1.0, 60, 0.0, 0), 1), ((80, 0.05, 2, 1.0, 45, 0.0, 0), 1), ((28, 0.0, 2, 1.0, 70, 0.0, 0), 1), ((9, 0.0, 1, 1.0, 60, 0.0, 0), 1), ((6, 0.0, 1, 1.0, 90, 0.0, 0), 1), ((4, 0.0, 2, 1.0, 45, 0.0, 0), 1), ((120, 0.0, 1, 1.0, 30, 0.0, 0), 1),
    # no marks: menus, lists of links, lines beside menus, adverts between a menu and a heading, footers
    ((5, 0.0, 1, 1.0, 2, 1.0, 0), 0), ((2, 1.0, 2, 1.0, 2, 1.0, 0), 0), ((1, 1.0, 1, 1.0, 1, 1.0, 0), 0), ((1, 1.0, 0, 0.0, 1, 1.0, 0), 0), ((1, 1.0, 1, 1.0, 9, 0.0, 0), 0), ((9, 0.0, 1, 1.0, 6, 0.0, 0), 0),
    ((12, 0.0, 1, 1.0, 10, 0.0, 0), 0), ((7, 0.0, 2, 1.0, 12, 0.0, 0), 0), ((15, 0.0, 1, 1.0, 8, 0.0, 0), 0), ((19, 0.0, 1, 1.0, 4, 0.0, 0), 0), ((5, 0.0, 1, 1.0, 11, 0.0, 0), 0), ((11, 0.0, 3, 1.0, 3, 0.0, 0), 0),
    ((4, 0.0, 40, 0.0, 0, 0.0, 0), 0), ((9, 0.0, 60, 0.0, 0, 0.0, 0), 0), ((12, 0.0, 110, 0.0, 0, 0.0, 0), 0), ((15, 0.0, 8, 0.0, 0, 0.0, 0), 0), ((7, 0.0, 25, 0.0, 0, 0.0, 0), 0), ((18, 0.0, 5, 0.0, 0, 0.0, 0), 0),
    ((7, 0.2, 60, 0.0, 3, 1.0, 0), 0), ((3, 1.0, 2, 1.0, 60, 0.0, 0), 0), ((10, 0.8, 0, 0.0, 80, 0.0, 0), 0), ((20, 0.9, 6, 1.0, 50, 0.0, 0), 0), ((5, 0.8, 40, 0.0, 45, 0.1, 0), 0), ((1, 1.0, 0, 0.0, 30, 0.0, 0), 0),
    ((30, 0.9, 5, 1.0, 6, 1.0, 0), 0), ((12, 0.6, 4, 0.5, 4, 1.0, 0), 0), ((6, 0.0, 3, 0.0, 2, 0.0, 0), 0), ((3, 0.0, 0, 0.0, 5, 0.0, 0), 0), ((20, 0.7, 50, 0.0, 10, 0.9, 0), 0), ((2, 1.0, 70, 0.0, 3, 1.0, 0), 0),
    ((4, 0.5, 6, 1.0, 2, 1.0, 0), 0), ((2, 0.0, 2, 1.0, 1, 1.0, 0), 0), ((8, 1.0, 8, 1.0, 0, 0.0, 0), 0), ((14, 0.9, 90, 0.0, 16, 1.0, 0), 0), ((6, 0.3, 12, 0.9, 0, 0.0, 0), 0), ((3, 0.0, 4, 1.0, 0, 0.0, 0), 0),
    # inside an element that names say is boilerplate: menus, adverts, notices, sidebars; long paragraphs among others are text
    ((1, 1.0, 1, 1.0, 1, 1.0, -1), 0), ((8, 0.0, 1, 1.0, 9, 0.0, -1), 0), ((25, 0.0, 6, 1.0, 5, 0.0, -1), 0), ((9, 0.1, 70, 0.0, 0, 0.0, -1), 0), ((60, 0.0, 3, 0.0, 40, 0.0, -1), 0), ((40, 0.2, 10, 0.5, 10, 0.5, -1), 0),
    ((90, 0.0, 1, 1.0, 20, 0.0, -1), 0), ((30, 0.0, 4, 0.0, 25, 0.0, -1), 0), ((3, 1.0, 60, 0.0, 2, 1.0, -1), 0), ((80, 0.0, 3, 0.0, 50, 0.0, -1), 0), ((6, 0.0, 90, 0.0, 40, 0.0, -1), 0), ((15, 0.0, 15, 0.0, 0, 0.0, -1), 0),
    ((45, 0.0, 2, 1.0, 60, 0.0, -1), 0), ((70, 0.0, 1, 1.0, 3, 1.0, -1), 0), ((50, 0.0, 60, 0.0, 55, 0.0, -1), 0), ((9, 0.0, 1, 1.0, 60, 0.0, -1), 0), ((110, 0.0, 2, 1.0, 2, 1.0, -1), 0), ((130, 0.4, 20, 0.6, 3, 1.0, -1), 0),
    ((180, 0.0, 60, 0.0, 80, 0.0, -1), 1), ((220, 0.02, 90, 0.0, 45, 0.0, -1), 1), ((160, 0.0, 45, 0.0, 120, 0.0, -1), 1), ((300, 0.0, 70, 0.0, 60, 0.0, -1), 1), ((250, 0.05, 110, 0.0, 75, 0.0, -1), 1),
    # inside an element that names say is content: as inside a content element, but lists of nothing but links
    ((60, 0.0, 8, 0.0, 45, 0.0, 1), 1), ((8, 0.0, 9, 0.0, 60, 0.0, 1), 1), ((1, 0.0, 80, 0.0, 70, 0.0, 1), 1), ((2, 0.0, 1, 0.0, 40, 0.0, 1), 1), ((35, 0.1, 50, 0.0, 20, 0.0, 1), 1), ((12, 0.0, 12, 0.0, 12, 0.0, 1), 1),
    ((4, 1.0, 40, 0.0, 40, 0.0, 1), 1), ((10, 0.4, 70, 0.0, 60, 0.0, 1), 1), ((9, 0.0, 1, 1.0, 12, 0.0, 1), 1), ((6, 0.0, 1, 1.0, 20, 0.0, 1), 1), ((2, 0.0, 0, 0.0, 0, 0.0, 1), 1), ((15, 0.0, 2, 1.0, 2, 0.0, 1), 1), ((9, 0.0, 30, 0.0, 4, 1.0, 1), 1),
    ((2, 1.0, 3, 1.0, 2, 1.0, 1), 0), ((5, 1.0, 6, 1.0, 4, 1.0, 1), 0), ((3, 1.0, 9, 1.0, 5, 1.0, 1), 0), ((8, 1.0, 2, 1.0, 7, 1.0, 1), 0), ((1, 1.0, 1, 1.0, 1, 1.0, 1), 0),
    # a page of one block
    ((4, 0.0, 0, 0.0, 0, 0.0, 0), 1), ((9, 0.0, 0, 0.0, 0, 0.0, 0), 1), ((15, 0.1, 0, 0.0, 0, 0.0, 0), 1), ((20, 0.0, 0, 0.0, 0, 0.0, 0), 1), ((2, 0.0, 0, 0.0, 0, 0.0, 0), 1),
    # inside a content element: paragraphs, headings, one-word paragraphs, lists, lines of links
    ((60, 0.0, 8, 0.0, 45, 0.0, 2), 1), ((8, 0.0, 9, 0.0, 60, 0.0, 2), 1), ((1, 0.0, 80, 0.0, 70, 0.0, 2), 1), ((2, 0.0, 1, 0.0, 40, 0.0, 2), 1), ((35, 0.1, 50, 0.0, 20, 0.0, 2), 1), ((12, 0.0, 12, 0.0, 12, 0.0, 2), 1),
    ((90, 0.0, 30, 0.0, 11, 0.3, 2), 1), ((5, 0.0, 1, 1.0, 90, 0.0, 2), 1), ((3, 0.0, 25, 0.0, 9, 0.1, 2), 1), ((10, 0.4, 70, 0.0, 60, 0.0, 2), 1), ((4, 1.0, 40, 0.0, 40, 0.0, 2), 1), ((2, 1.0, 3, 1.0, 2, 1.0, 2), 1),
    ((2, 0.0, 0, 0.0, 0, 0.0, 2), 1), ((6, 0.5, 2, 1.0, 5, 0.2, 2), 1), ((9, 0.0, 1, 1.0, 3, 0.0, 2), 1), ((12, 0.0, 5, 1.0, 0, 0.0, 2), 1), ((7, 0.0, 9, 0.1, 1, 1.0, 2), 1), ((400, 0.0, 5, 0.0, 6, 1.0, 2), 1),
    ((9, 0.0, 1, 1.0, 12, 0.0, 2), 1), ((12, 0.0, 1, 1.0, 18, 0.0, 2), 1), ((8, 0.0, 2, 1.0, 10, 0.0, 2), 1), ((6, 0.0, 1, 1.0, 20, 0.0, 2), 1), ((4, 0.0, 1, 1.0, 5, 0.0, 2), 1), ((15, 0.0, 2, 1.0, 2, 0.0, 2), 1),
    # inside a boilerplate element or comments: menus, adverts, notices, sidebars, footers, comments, related links
    ((1, 1.0, 1, 1.0, 1, 1.0, -2), 0), ((8, 0.0, 1, 1.0, 9, 0.0, -2), 0), ((25, 0.0, 6, 1.0, 5, 0.0, -2), 0), ((9, 0.1, 70, 0.0, 0, 0.0, -2), 0), ((60, 0.0, 3, 0.0, 40, 0.0, -2), 0), ((40, 0.2, 10, 0.5, 10, 0.5, -2), 0),
    ((120, 0.0, 30, 0.0, 20, 0.0, -2), 0), ((30, 0.0, 4, 0.0, 25, 0.0, -2), 0), ((3, 1.0, 60, 0.0, 2, 1.0, -2), 0), ((80, 0.0, 3, 0.0, 50, 0.0, -2), 0), ((6, 0.0, 90, 0.0, 40, 0.0, -2), 0), ((15, 0.0, 15, 0.0, 0, 0.0, -2), 0),
    ((45, 0.0, 2, 1.0, 60, 0.0, -2), 0), ((70, 0.0, 1, 1.0, 3, 1.0, -2), 0), ((50, 0.0, 60, 0.0, 55, 0.0, -2), 0), ((9, 0.0, 1, 1.0, 60, 0.0, -2), 0),
]

#: Tags by role (fixed values).
_BREAKING = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_UNREAD = set("script style noscript template iframe svg math canvas object head title textarea select button audio video map".split())
_RAW = set("script style textarea title iframe noscript".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CONTENT = {"article", "main"}
_BOILERPLATE = set("nav footer aside form menu dialog".split())
#: Words of a class, id or role that mark boilerplate and content (fixed values).
_BAD_WORD = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|footer|foot|masthead|ad|ads|adv|advert|advertisement|advertising|promo|promotion|sponsor|sponsored|banner|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|search|comment|comments|disqus|respond|reply|replies|related|recommended|share|sharing|social|breadcrumb|breadcrumbs|widget|toolbar|pagination|pager|contentinfo|complementary)(?:$|[\s_-])"
)
#: Names that begin so say what else the page has, not what the element is: has-sidebar, with-sidebar, no-ads (fixed values).
_STATES = set("has with no without is not in show hide hidden js".split())
#: Inside content such a word counts only where it is a whole class, or where all else in a name like related-posts or
#: ad-slot-1 is such a word or one of these (fixed values): names like side-effects or related-work are of the text.
_FRAME_WORDS = set(
    "area article articles author bar block blog body bottom box btn button buttons content container count entry field form frame global group header heading icon icons inline inner input item items js label left link links list main message "
    "meta mobile module more news outer page panel post posts reading right row section site slot sticky stories story tag tags text thread title top topics unit up view wp wrap wrapper you your".split()
)
#: Words that are the topic of a section as well: as an id inside content, one alone doesn't count.
_TOPICS = set("navigation menu side foot ad ads promotion sponsor banner cookie cookies consent gdpr notice alert popup modal overlay subscription login signup search comment respond reply replies related share sharing social widget toolbar pagination advertising advertisement pager".split())
#: Words of readers' comments (fixed values).
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|disqus|respond|reply|replies|feedback|discussion|guestbook)(?:$|[\s_-])")
#: Words that name a wrapper and those that say where its columns are (fixed values).
_WRAPPERS = set("page site wrapper wrap container layout body content main grid row columns outer inner".split())
_SIDES = set("left right both none layout first second col cols column columns one two".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_GOOD_WORD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|article-body|post-content|entry-content)(?:$|[\s_-])")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][\w:.-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*+|[^>]*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    #: While a page is read the number of the element around the block.
    mark: int


def _bad_inside(kind: str, value: str) -> bool:
    """Whether a class, id or role marks boilerplate inside content."""
    for token in value.split():
        if _BAD_WORD.fullmatch(token):
            if kind != "id" or token not in _TOPICS:
                return True
            continue
        words = [w for w in re.split("[_-]+", token) if len(w) > 1 and not w.isdigit()]
        bad = [bool(_BAD_WORD.fullmatch(w)) for w in words]
        if any(bad) and all(b or w in _FRAME_WORDS for b, w in zip(bad, words, strict=True)):
            return True
    return False


def _tokens(value: str) -> str:
    """A class, id or role without the names that tell of other elements."""
    return " ".join(t for t in value.split() if re.split("[_-]", t, maxsplit=1)[0] not in _STATES or not re.search("[_-]", t))


#: Grades of marks: by a tag, by a name, among comments.
_TAG_MARK, _NAME_MARK, _COMMENTS = 2, 1, -3


def _is_layout(words: str) -> bool:
    """Whether a class names a wrapper and the sides of its columns, as in `page sidebar-left`."""
    tokens = words.split()
    return any(t in _WRAPPERS for t in tokens) and all(t in _WRAPPERS or not _BAD_WORD.search(t) or len(_SIDES.intersection(re.split("[_-]", t))) > 0 for t in tokens)


def _mark(name: str, attrs: str, inside_content: bool) -> int:
    """What an element says of itself: 2 or -2 by its tag, 1 or -1 by a name, -3 for comments, 0 if it says neither or both.

    Tags come first, but an article of readers' comments. A header inside content is the article's own. The id of a heading is
    made from its text and says nothing.
    """
    if name in _BOILERPLATE or (name == "header" and not inside_content):
        return -_TAG_MARK
    found = 0
    if attrs and name not in ("html", "body"):
        good = bad = comments = False
        for m in _ATTR.finditer(attrs):
            kind, words = m[1].lower(), _tokens((m[2] or m[3] or m[4] or "").lower())
            if (kind == "id" and name in _HEADINGS) or (kind == "class" and _is_layout(words)):
                continue
            for token in words.split():
                b = _bad_inside(kind, token) if inside_content else bool(_BAD_WORD.search(token)) or (kind != "role" and "header" in re.split("[_-]", token))
                said = bool(_COMMENT.search(token))
                if said and not b:  # such words of comments as the list of boilerplate lacks
                    b = not inside_content or _COMMENT.fullmatch(token) is not None or token.split("-")[0] in ("reader", "readers", "user")
                g = bool(_GOOD_WORD.search(token))
                if g and b:  # the last word says what it is: a social-post is a post, a post__share isn't
                    g = bool(_GOOD_WORD.fullmatch(re.split("[_-]", token)[-1]))
                    b = not g
                good, bad, comments = good or g, bad or b, comments or (said and b)
        found = _COMMENTS if comments and not (good and name not in _CONTENT) else int(good) - int(bad)
    if name in _CONTENT:
        return _COMMENTS if found == _COMMENTS else _TAG_MARK
    return found


@dataclass
class _Element:
    name: str
    attrs: str
    parent: int
    unread: bool
    words: int = 0
    heading: bool = False


def _marks(elements: list[_Element]) -> list[int]:
    """The mark of each element, in the order in which they begin: its own or that of what is around it."""
    for e in reversed(elements[1:]):
        around = elements[e.parent]
        around.words += e.words
        around.heading |= e.heading
    out: list[int] = [0]
    content: set[int] = set()

    def elsewhere(e: _Element) -> bool:
        """Whether content began before, in an element that isn't around this one."""
        at, around = e.parent, 0
        while at:
            around += at in content
            at = elements[at].parent
        return len(content) > around

    for i, e in enumerate(elements[1:], 1):
        around = out[e.parent]
        own = _mark(e.name, e.attrs, around > 0)
        if own == -_NAME_MARK and e.heading and 5 * e.words > 3 * elements[0].words:
            own = 0  # most of the page with its main heading
        if own == _TAG_MARK and around < 0 and elsewhere(e):
            own = 0
        elif own == _NAME_MARK and around < 0:
            own = 0
        if own == _TAG_MARK or (own == _NAME_MARK and e.heading and e.words >= 20):
            content.add(i)
        out.append(own or around)
    return [max(m, -_TAG_MARK) for m in out]


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in their order, markup, scripts, styles and form fields left out."""
    out: list[Block] = []
    elements = [_Element("", "", 0, False)]
    stack = [0]  # open elements
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
        linked = sum(len(html.unescape(t).split()) for t, in_link in parts if in_link)
        parts.clear()
        if text:
            n = text.count(" ") + 1
            out.append(Block(text, n, min(n, linked), stack[-1]))
            elements[stack[-1]].words += n - min(n, linked)

    def say(text: str) -> None:
        if text and not elements[stack[-1]].unread:
            parts.append((text, links > 0))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(html.escape(m["cdata"]))
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in _BREAKING:
            flush()
        elif name == "br":
            parts.append((" ", False))
        if name == "a":
            links = 0 if m["end"] else 1
        if name in _VOID or name in ("a", "p"):
            continue
        if m["end"]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].name == name), None)
            if k is not None:
                if name in _UNREAD:
                    parts.append((" ", False))
                del stack[k:]
        elif name in _BREAKING or name in _UNREAD:
            if not m["attrs"].endswith("/"):
                around = stack[-1]
                stack.append(len(elements))
                elements.append(_Element(name, m["attrs"], around, elements[around].unread or name in _UNREAD, 0, name == "h1"))
            if name in _RAW:
                close = re.compile(f"</{name}\\b", re.I).search(page, at)
                at = close.start() if close else end
    flush()
    marks = _marks(elements)
    for b in out:
        b.mark = marks[b.mark]
    return out


def features(found: list[Block]) -> list[tuple[float, ...]]:
    pair = [(b.words, b.linked / b.words) for b in found]
    around = [(0, 0.0), *pair, (0, 0.0)]
    return [(*around[i + 1], *around[i], *around[i + 2], float(b.mark)) for i, b in enumerate(found)]


Tree = float | tuple  # a leaf's share of content, or (feature, threshold, tree below, tree above)


def grown(rows: list[tuple[tuple[float, ...], int]], depth: int = 8, least: int = 2) -> Tree:
    """A decision tree by Gini impurity: the split with the least weighted impurity, the first feature winning ties."""
    share = sum(y for _, y in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0) or len(rows) < 2 * least:
        return share

    def impurity(part: list) -> float:
        p = sum(y for _, y in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            sides = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
            if min(map(len, sides)) >= least:
                cost = sum(map(impurity, sides))
                if best is None or cost < best[0] - 1e-12:
                    best = cost, f, cut, sides
    if best is None or best[0] >= impurity(rows) - 1e-12:
        return share
    return best[1], best[2], grown(best[3][0], depth - 1, least), grown(best[3][1], depth - 1, least)


def classified(tree: Tree, x: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    return " ".join(b.text for b, x in zip(found, features(found), strict=True) if classified(tree, x))


def extracted(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labelled: list[tuple[tuple[float, ...], int]] = LABELLED) -> DataFrame:
    """Columns `keep`, text (empty if there is none) and n_chars, its code points.

    A null or empty page has no text. Rows keep null ids; repeated rows each give a row; other columns are ignored.
    """
    tree = grown(labelled)
    df = df.select(*keep, df[html_col].alias("_html"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "_html"):
            text = [main_text(t, tree) if t else "" for t in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=[*keep, "text", "n_chars"])

    return common.mapped(df, run, f"{kinds}text string, n_chars bigint")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))
