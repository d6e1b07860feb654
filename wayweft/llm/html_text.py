"""Main text of web pages by two passes of block rules.

The markup is read once into blocks of text with their link text, stop words and enclosing parts.
Pass one calls long blocks with many stop words and few links good and link lists, notices and other
page furniture bad; short blocks in between stay open. In pass two an open block takes the label of
its nearest decided neighbours. Standing in an article speaks for a block in both.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.llm.words import slices

# Frequent words of the four languages of the corpus and of some others.
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with be at by this from or an not but which his her they have has had
    der die das und ist in zu den von mit sich des auf für im dem nicht ein eine als auch es an er so dass war wie bei oder
    le la les de des et un une du dans que qui pour par sur est pas avec ce il elle au en plus sont se son
    el los las y del se por con una su para como al lo más pero sus no es o ha era muy
    il di e che per non sono della con alla da i gli
    o os um uma não com do dos das em na no é mais""".split()
)
LONG, SHORT = 12, 4
STOP_HIGH, STOP_LOW, STOP_NONE = 0.25, 0.1, 0.02
LINKS_HIGH = 0.4

# Element names by their role in a page.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_SILENT = frozenset("noscript template svg math object canvas button select".split()) | _RAW
_FURNITURE = frozenset("nav header footer aside form menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LAYOUT_HINTS = frozenset("nav navbar navigation menu menus header masthead topbar footer footers sidebar sidebars toolbar banner contentinfo".split())
_HINTS = _LAYOUT_HINTS | frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising banners sponsor sponsored sponsors promo promos promotion
    breadcrumb breadcrumbs pagination pager aside related recommended social share sharing newsletter subscribe subscription signup login
    cookie cookies consent gdpr notice notices disclaimer popup modal comment comments comentarios commentaires kommentare
    respond reply replies disqus copyright complementary""".split()
)
# Hint words that articles are about as well; beside a content word and inside an article they are only doubts.
_SUBJECTS = frozenset("promotion social subscription consent copyright sponsors login".split())
_CONTENTS = frozenset("content contents body text story entry copy".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
# A tag whose quotes don't close ends at the next bracket.
_BROKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD_PARTS = re.compile(r"[a-z0-9]+")
_BLANK = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int
    in_article: bool
    furniture: bool
    doubted: bool = False


def _hint(attributes: str) -> str:
    """"layout", "doubt" or "other" where class, id or role name page furniture, else empty."""
    found, doubts = set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                parts = _WORD_PARTS.findall(token)
                # "has-sidebar" and the like speak of what lies beside the element.
                if parts and parts[0] not in ("has", "no", "with", "without", "not", "is"):
                    hints = _HINTS & set(parts)
                    if hints and hints <= _SUBJECTS and _CONTENTS & set(parts):
                        doubts = True
                    else:
                        found |= hints
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found.add("hidden")
    return ("layout" if found <= _LAYOUT_HINTS else "other") if found else "doubt" if doubts else ""


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, character references decoded, white space made single."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    # Open elements: (name, why they are furniture, inside an article).
    open_: list[tuple[str, str, bool]] = []
    link_depth = -1
    # Open elements by name, and the next end of an element whose contents are skipped (None: there is none).
    opened: Counter[str] = Counter()
    ends: dict[str, tuple[int, int] | None] = {}

    def next_end(name: str) -> int | None:
        if name not in ends or (ends[name] and ends[name][0] < at):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            ends[name] = end.span() if end else None
        return ends[name] and ends[name][1]

    def flush():
        nonlocal linked
        text = _BLANK.sub(" ", "".join(pieces)).strip()
        if text:
            _, why, article = open_[-1] if open_ else ("", "", False)
            out.append(Block(text, linked, article, why not in ("", "doubt"), why == "doubt"))
        pieces.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            linked += len(_BLANK.sub(" ", text).strip()) if link_depth >= 0 else 0

    at = 0
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        say(page[at:begin])
        tag = _TOKEN.match(page, begin) or _BROKEN.match(page, begin)
        if not tag:
            say("<")
            at = begin + 1
            continue
        at = tag.end()
        name = (tag[2] or "").lower().rstrip("/")
        if not name:
            continue
        if tag[1]:
            if name == "a":
                link_depth = -1
            if name == "br":
                say(" ")
            place = next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name) if opened[name] else -1
            if place >= 0 or name in _BLOCKS:
                flush()
            if place >= 0:
                opened.subtract(n for n, _, _ in open_[place:])
                del open_[place:]
                link_depth = -1 if link_depth > place else link_depth
            continue
        if name in _SILENT:
            end = next_end(name)
            if end and not tag[0].endswith("/>"):
                at = end
            elif name in _RAW and not end:
                at = len(page)
            continue
        if name == "a":
            link_depth = len(open_)
        _, why, article = open_[-1] if open_ else ("", "", False)
        hint = _hint(tag[3]) if name not in ("html", "body") else ""
        if name in ("br", "hr", "img", "wbr"):
            say("" if name == "wbr" else " ")
        if name in _BLOCKS or (hint and name not in _VOID):
            flush()
        if name in _VOID or not (name in _BLOCKS or hint):
            continue
        if hint == "doubt" and not article:
            hint = "other"
        if name in ("article", "main") and why in ("", "layout") and hint in ("", "layout"):
            why, article = "", True
        elif why in ("", "doubt"):
            why = "tag" if name in _FURNITURE else hint or why
        if article and name in ("h1", "h2") and why == "layout-tag":
            why = ""
        if article and name == "header" and why == "tag":
            why = "layout-tag"
        opened[name] += 1
        open_.append((name, why, article))
    flush()
    return out


def _neighbours(labels: list[bool | None]) -> list[list[tuple[int, bool]]]:
    """(distance, whether it is bad) of the nearest decided places before and after each one."""
    out: list[list[tuple[int, bool]]] = [[] for _ in labels]
    for way in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last = None
        for i in way:
            if last is not None:
                out[i].append((abs(i - last), not labels[last]))
            last = i if labels[i] is not None else last
    return out


def main_text(page: str) -> str:
    """The text of the good blocks, joined by one space.

    An article's blocks are bad only if they are mostly links, or if a class name doubts them and length
    and stop words don't speak for them, and open only if they are short, without
    links, stop words or punctuation; they look for neighbours in articles alone. In a page that has an
    article, blocks outside need length and stop words to be good, and open ones count articles as bad
    neighbours. Where hardly a word of the page is a stop word its language is unknown, and length and
    links decide; six letters count as a word there, as not every script sets blanks.
    """
    found = blocks(page)
    has_article = any(b.in_article and not b.furniture for b in found)
    counted = []
    for b in found:
        words = [w.strip(".,;:!?\"'()[]{}") for w in b.text.lower().split()]
        counted.append((len(words), sum(w in STOP_WORDS for w in words), b.linked / len(b.text)))
    told = [(n, k) for b, (n, k, links) in zip(found, counted) if not b.furniture and links <= LINKS_HIGH]
    unknown = sum(k for _, k in told) < STOP_NONE * sum(n for n, _ in told)
    labels: list[bool | None] = []
    for b, (n, k, links) in zip(found, counted):
        stops = k / n
        if b.furniture or links > LINKS_HIGH or b.doubted and not (n >= LONG and stops >= STOP_LOW):
            labels.append(False)
        elif b.in_article:
            labels.append(True if n >= SHORT or stops >= STOP_LOW or re.search(r"[.!?:;]", b.text) else None)
        elif unknown:
            labels.append(True if max(n, len(b.text) // 6) >= LONG else None)
        elif n >= LONG and stops >= STOP_LOW or n >= SHORT and stops >= STOP_HIGH and not has_article:
            labels.append(True)
        else:
            labels.append(None if n < LONG or stops > 0 else False)
    inside = _neighbours([x if b.in_article else None for b, x in zip(found, labels)])
    outside = _neighbours([False if b.in_article else x for b, x in zip(found, labels)])
    kept = []
    for b, label, near, far in zip(found, labels, inside, outside):
        if label is None and b.in_article:
            # Bad neighbours on one side alone don't outweigh the article.
            label = len(near) < 2 or not all(bad for _, bad in near)
        elif label is None:
            label = not min(far)[1] if far else True
        if label:
            kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, ...) as page_id, url, text and n_chars.

    A null or empty page, and one without a good block, gives an empty text. Pages are read one by
    one: nulls in other columns are carried, repeated rows give equal rows, other columns are left out
    and an empty table gives an empty result. Unclosed and cut-off markup is read as far as it goes.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(page or "") for page in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
