"""A tolerant reading of an HTML page: its elements, their roles and their text."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b
from html import unescape

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("applet button caption html marquee object table td template th".split())
#: Open elements that a new one of a kind ends, and those at which the search for them stops.
ENDED_BY = {
    "li": ({"li"}, {"ol", "ul", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}

# What is never part of an article: by tag, and by the words of a class, an id or a role.
FURNITURE_TAGS = frozenset("aside button canvas datalist dialog embed footer form head header iframe menu nav noembed noframes noscript object script search select style svg template textarea title xmp".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts alert alerts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog discussion disqus footer "
    "gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|([!?]))")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[^\W_]+")
#: Numbers in a class or an id that tell pages or posts apart.
_CLASS_NUMBER, _ID_NUMBER = re.compile(r"\d{2,}"), re.compile(r"(?<=[-_])\d+|\d{2,}")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def role_of(*parts) -> int:
    """A 63-bit name of an element's place: the same in every process."""
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


_role = lru_cache(maxsize=1 << 16)(role_of)


@lru_cache(maxsize=1 << 14)
def _kind(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(signature, furniture words: 0 none, 1 only 'header', 2 others; is an article by its attributes) of a tag with attributes. Numbers that tell posts apart count as one."""
    found = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), unescape(value.strip("\"'")).lower())
    words = {w for name in ("class", "id", "role") for w in _WORDS.findall(found.get(name, "").replace("_", " "))}
    classes = sorted({_CLASS_NUMBER.sub("0", c) for c in found.get("class", "").split()})
    signature = "".join([tag, *("." + c for c in classes), "#" + _ID_NUMBER.sub("0", found["id"]) if found.get("id") else ""])
    words &= FURNITURE_WORDS
    return signature, 0 if not words else 1 if words == {"header"} else 2, found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"


class Page:
    """Elements in page order, as parallel lists, and the texts between the tags.

    Element 0 is the page itself. ``parent`` is the enclosing element, ``block`` the nearest block
    element (itself, if it is one), ``role`` the place of a block in terms of the signatures of the blocks
    around it, ``open`` and ``close`` the numbers of the tags. ``texts`` has (element, text, inside a link), ``None``
    as a text being a break between blocks. ``hidden`` tells elements inside furniture.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.block, self.role = ["#page"], [-1], [0], [_role("#page")]
        self.open, self.close = [0], [0]
        self.furniture, self.worded, self.article = [False], [0], [False]
        self.texts: list[tuple[int, str | None, bool]] = []
        self._read(html)
        self._hide()

    def _read(self, html: str) -> None:
        stack, count, links = [0], {}, 0
        tags, texts = self.tag, self.texts
        at, events, no_quote = 0, 1, {}

        def leave(depth: int) -> None:
            """Close all open elements from this place of the stack on."""
            nonlocal links
            for e in stack[depth:]:
                self.close[e] = events
                count[tags[e]] -= 1
                links -= tags[e] == "a"
            del stack[depth:]

        def ending(names, stops) -> int | None:
            """Place on the stack of the nearest open element of these names, unless one of ``stops`` lies between."""
            if not any(count.get(n) for n in names):
                return None
            for depth in range(len(stack) - 1, 0, -1):
                name = tags[stack[depth]]
                if name in names:
                    return depth
                if name in stops:
                    return None
            return None

        while True:
            m = _OPEN.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text:
                texts.append((stack[-1], text, links > 0))
            if not m:
                break
            slash, name, comment, other = m.groups()
            if comment:
                end = html.find("-->", m.end() - 2)
                at = len(html) if end < 0 else end + 3
                continue
            if other:
                end = html.find(">", m.end())
                at = len(html) if end < 0 else end + 1
                continue
            end = m.end()
            while True:
                stop = _STOP.search(html, end)
                if stop is None or stop[1] is None:
                    break
                quote = stop[1]
                other_end = -1 if quote in no_quote else html.find(quote, stop.end())
                if other_end < 0:
                    no_quote[quote] = True
                end = stop.end() if other_end < 0 else other_end + 1
            if stop is None:
                break
            attributes, at, name = html[m.end() : stop.start()], stop.end(), name.lower()
            events += 1
            inline = name in INLINE
            if slash:
                if not inline:
                    texts.append((stack[-1], None, False))
                if inline:
                    depth = ending({name}, SCOPE)
                    if depth is not None:
                        # a formatting tag that ends early takes no block with it
                        if all(tags[e] in INLINE for e in stack[depth:]):
                            leave(depth)
                        else:
                            e = stack.pop(depth)
                            self.close[e] = events
                            count[name] -= 1
                            links -= name == "a"
                else:
                    names = HEADINGS if name in HEADINGS else {name}
                    depth = ending(names, SCOPE - {name} if name not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body") else ({"table"} - {name}))
                    if depth is not None:
                        leave(depth)
                continue
            if not inline:
                texts.append((stack[-1], None, False))
                if name in ENDS_P:
                    depth = ending({"p"}, SCOPE)
                    if depth is not None:
                        leave(depth)
                if name in HEADINGS and tags[stack[-1]] in HEADINGS:
                    leave(len(stack) - 1)
                if name in ENDED_BY:
                    while (depth := ending(*ENDED_BY[name])) is not None:
                        leave(depth)
                if name == "br" or (name in VOID and name != "hr"):
                    continue
            elif name == "a" and links:
                depth = ending({"a"}, SCOPE)
                if depth is not None:
                    leave(depth)
            if name in VOID:
                continue
            above = stack[-1]
            signature, worded, article = _kind(name, attributes)
            e = len(tags)
            tags.append(name)
            self.parent.append(above)
            self.block.append(self.block[above] if inline else e)
            self.role.append(0 if inline else _role(self.role[self.block[above]], signature))
            self.open.append(events)
            self.close.append(events)
            self.furniture.append(name in FURNITURE_TAGS)
            self.worded.append(0 if name in ("html", "body") else worded)
            self.article.append(name in ARTICLE_TAGS or article)
            if name in RAW:
                found = _RAW_END[name].search(html, at)
                at = len(html) if found is None else found.start()
                if found is None:
                    break
            stack.append(e)
            count[name] = count.get(name, 0) + 1
            links += name == "a"
        events += 1
        leave(1)
        self.close[0] = events

    def _hide(self) -> None:
        """Set ``hidden`` and ``chars``, ``linked``: characters inside each element that are not hidden, and those of them in links.

        An element is furniture by its words unless it holds an article, main or h1
        element that is none, and more than half of the page's text. The header of an article belongs to it.
        """
        n, parent = len(self.tag), self.parent
        by_tag, inside = [False] * n, [False] * n
        for e in range(1, n):
            p = parent[e]
            inside[e] = inside[p] or (self.article[e] and not self.worded[e])
            if self.worded[e] == 1 and inside[p]:
                self.worded[e] = 0
            by_tag[e] = by_tag[p] or (self.furniture[e] and not (self.tag[e] == "header" and inside[p]))
        size, mark = [0] * n, [0] * n
        for e, text, _ in self.texts:
            if text is not None and not by_tag[e]:
                size[e] += len(text.strip())
        for e in range(n - 1, 0, -1):
            mark[e] |= not by_tag[e] and not self.worded[e] and (self.article[e] or self.tag[e] == "h1")
            size[parent[e]] += size[e]
            mark[parent[e]] |= mark[e]
        self.hidden = by_tag
        for e in range(1, n):
            self.hidden[e] = by_tag[e] or self.hidden[parent[e]] or (self.worded[e] and not (mark[e] and 2 * size[e] > size[0]))
        self.chars, self.linked = [0] * n, [0] * n
        for e, text, link in self.texts:
            if text is not None and not self.hidden[e]:
                self.chars[e] += (k := len(text.strip()))
                self.linked[e] += k if link else 0
        for e in range(n - 1, 0, -1):
            self.chars[parent[e]] += self.chars[e]
            self.linked[parent[e]] += self.linked[e]

    def own_texts(self) -> dict[int, str]:
        """Block -> its text without that of the blocks in it, for blocks that have some."""
        parts: dict[int, list[str]] = {}
        for e, text, _ in self.texts:
            if text is not None and not text.isspace():
                parts.setdefault(self.block[e], []).append(text)
        return {b: " ".join("".join(p).split()) for b, p in parts.items()}

    def text_of(self, roots: set[int], left_out: set[int] = frozenset()) -> str:
        """The text inside ``roots`` that is not hidden: references decoded, white space as one space, blocks joined by one. Own text of the blocks ``left_out`` is left out."""
        inside = [False] * len(self.tag)
        for e in range(len(inside)):
            inside[e] = e in roots or (e > 0 and inside[self.parent[e]])
        out = []
        for e, text, _ in self.texts:
            if text is None:
                out.append(" ")
            elif inside[e] and not self.hidden[e] and self.block[e] not in left_out:
                out.append(unescape(text))
        return " ".join("".join(out).split())
