"""The leaf blocks of a web page: their text, the elements around them and their features."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object select textarea option datalist audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run inside a line of text; all others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An open p ends where one of these begins.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An open element of this kind ends where the same kind begins, up to the given bounds.
ENDS_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_NAME = re.compile(r"[a-z]+")
#: Character references of more digits than Python reads as a number.
_LONG_REFERENCE = re.compile(r"&#[0-9]{1000,}")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int  # characters inside links


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tags = tuple(tag for tag, _ in self.open if tag not in INLINE)
                names = tuple(name for _, own in self.open for name in own)
                self.blocks.append(Block(text, tags, names, self.linked))
            self.parts.clear()
            self.linked = 0

    def close_at(self, place: int) -> None:
        for tag, _ in self.open[place:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.open[place:]

    def last(self, tag: str, bounds: frozenset[str] | set[str] = frozenset()) -> int:
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == tag:
                return place
            if self.open[place][0] in bounds:
                break
        return -1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """As HTML has it, a comment up to the next >; CDATA only inside svg and math."""
        if self.rawdata.startswith("<![CDATA[", i) and max(self.last("svg"), self.last("math")) >= 0:
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in ENDS_P and (place := self.last("p", {"button", "table", "td"})) >= 0:
            self.close_at(place)
        if tag in ENDS_ITSELF and (place := self.last(tag, ENDS_ITSELF[tag])) >= 0:
            self.close_at(place)
        if tag == "body":
            self.silent = 0
        if tag in VOID:
            return
        names: tuple[str, ...] = ()
        if attrs:
            said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
            names = tuple(dict.fromkeys(_NAME.findall(said.lower())))
        self.open.append((tag, names))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if (place := self.last(tag)) >= 0:
            self.close_at(place)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str | None) -> list[Block]:
    """The blocks of a page in order; none for null. Malformed markup never fails."""
    parser = _Blocks()
    # ten digits without leading zeros are no character, as more are
    parser.feed(_LONG_REFERENCE.sub(lambda found: "&#" + (found[0][2:].lstrip("0") or "0")[:10], html or ""))
    parser.close()
    parser.flush()
    return parser.blocks
