"""Main text of web pages by tag-path ratios.

The text of a page is gathered by the path of tags from the root to its leaf. Each path has two ratios, characters and
punctuation marks a node. In the order in which paths first appear both are smoothed, fused into one score and held
against a threshold; paths that lie in a part marked as navigation, advert, comment or the like score nothing. An element, role or
style marks a part for certain; a word of its class or id only raises doubt, which doesn't hold for a part with most of
the page's text. The
lowest container that holds most of the text on the chosen paths is the article, widened to the <article> or <main> around
it, or else to all chosen text and the headings before it; its blocks, without marked parts, are the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import other_columns, slices, text_arrays, tidy

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
SPLIT_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])")

# Fixed values of HTML: elements without content, elements whose content is no markup, inline elements, and which open
# elements a start tag closes (up to a limit).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}

#: Elements, roles and words of class or id that mark a part as not the article.
MARKED = frozenset("nav footer aside form button select menu dialog head svg object canvas audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs masthead header footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe subscription signup login comment comments commentlist "
    "disqus respond reply replies share sharing social related recommended pagination pager toolbar".split()
)
#: Words that say a part has or goes around something, and those that make a header one of the article.
ABOUT = frozenset("has with without no is show hide layout wrapper".split())
TITLED = frozenset("post entry article story content title".split())
#: Doubt holds for a part with less than this share of the page's text; more for the words of reader comments.
MOST, MOST_COMMENTS = 0.5, 0.9
REMARKS = frozenset("comment comments commentlist disqus respond reply replies".split())
UNMARKABLE = frozenset(["html", "body", "article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("html body article main section div td".split())
#: A path is chosen from this share of the highest score on; the article holds this share of the chosen text.
CHOSEN, HELD = 0.1, 0.8


class Element:
    __slots__ = ("name", "parent", "marked", "doubt", "path", "depth", "held", "size", "inside", "around")

    def __init__(self, name: str, parent: Element | None, marked: bool, doubt: float, paths: dict[tuple[int, str], int]):
        self.name, self.parent, self.marked, self.doubt = name, parent, marked, doubt
        self.held = self.size = 0
        self.inside = self.around = False
        if name in INLINE and parent is not None:
            self.path, self.depth = parent.path, parent.depth
        else:  # paths are numbers: of the path above and the name
            above = parent.path if parent else -1
            self.path = paths.setdefault((above, name), len(paths))
            self.depth = parent.depth + 1 if parent else 0


def doubtful(value: str) -> float:
    """The share of the page's text from which on a part of this class or id is no longer doubted; 0: it is not doubted."""
    most = 0.0
    for token in value.split():
        words = {w.lower() for w in SPLIT_NAME.split(token) if w}
        found = words & WORDS
        if not found or words & ABOUT or (found == {"header"} and words & TITLED):
            continue
        most = max(most, MOST_COMMENTS if found & REMARKS else MOST)
    return most


def is_marked(name: str, attributes: str, parent: Element) -> tuple[bool, float]:
    """Whether a start tag opens a part that is not the article for certain, and the share up to which it is doubted."""
    if name in MARKED:
        return True, 0.0
    if name == "header":  # the header of an article holds its title
        while parent and parent.name not in ("article", "main"):
            parent = parent.parent
        return parent is None, 0.0
    if not attributes or name in UNMARKABLE:
        return False, 0.0
    doubt = 0.0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            doubt = max(doubt, doubtful(value))
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, 0.0
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0.0
    return False, doubt


def settle_doubts(elements: list[Element], found: list[tuple[Element, int, str]]) -> None:
    """Mark doubted parts that don't hold too much of the text that is not marked for certain; parts inherit marks.

    On a page whose <article> or <main> has text, parts beside it stay doubted however long they are.
    """
    for element, _, text in found:
        if not element.marked:
            element.size += len(text.strip())
    for e in reversed(elements):
        e.around |= e.name in ("article", "main") and e.size > 0
        if e.parent is not None:
            e.parent.size += e.size
            e.parent.around |= e.around
    total, named = elements[0].size, elements[0].around
    for e in elements:  # those around come first
        above = e.parent
        e.inside = above is not None and (above.inside or above.name in ("article", "main"))
        beside = named and not e.around and not e.inside
        if above is not None and above.marked or e.doubt and (beside or e.size < e.doubt * total):
            e.marked = True


def leaves(html: str) -> tuple[list[tuple[Element, int, str]], list[Element]]:
    """Text leaves in page order (element, number of the block, raw text), and all elements, each after those around it.

    Unclosed and stray tags are repaired.
    """
    paths: dict[tuple[int, str], int] = {}
    root = Element("html", None, False, 0.0, paths)
    stack, out, elements, block, at, n = [root], [], [root], 0, 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            out.append((stack[-1], block, html[at:]))
            break
        if lt > at:
            out.append((stack[-1], block, html[at:lt]))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if tag is None:
            if lt + 1 < n and (html[lt + 1].isascii() and html[lt + 1].isalpha() or html[lt + 1] == "/"):
                if html.find(">", lt) < 0:
                    break  # the page ends inside a tag
                at = html.find(">", lt) + 1
            else:
                out.append((stack[-1], block, "<"))
                at = lt + 1
            continue
        at, name = tag.end(), tag[2].lower()
        inline = name in INLINE
        if not inline and name not in ("br", "wbr", "img"):
            block += 1
        if tag[1]:
            _close(stack, name, inline)
            continue
        if name == "br":
            out.append((stack[-1], block, " "))
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name == "html":
            continue
        if name in CLOSES_P:
            _close_open(stack, {"p"}, {"article", "button", "div", "section", "td", "th", "li", "blockquote"})
        if name in CLOSES:
            _close_open(stack, *CLOSES[name])
        parent = stack[-1]
        marked, doubt = is_marked(name, tag[3], parent)
        stack.append(Element(name, parent, parent.marked or marked, doubt, paths))
        elements.append(stack[-1])
    settle_doubts(elements, out)
    return out, elements


def _close(stack: list[Element], name: str, inline: bool) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name == name:
            del stack[i:]
            return
        if inline and stack[i].name not in INLINE:
            return


def _close_open(stack: list[Element], names: set[str], limits: set[str]) -> None:
    found = 0
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in limits:
            break
        if stack[i].name in names:
            found = i
    if found:
        del stack[found:]


def _smooth(x: np.ndarray) -> np.ndarray:
    padded = np.concatenate([x[:1], x, x[-1:]])
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def chosen_paths(found: list[tuple[Element, int, str]]) -> set[int]:
    """Paths whose fused, smoothed ratios reach the threshold."""
    nodes: dict[int, list[float]] = {}
    last: dict[int, int] = {}
    for element, block, text in found:
        size = len(text.strip())
        if size:
            row = nodes.setdefault(element.path, [0.0, 0.0, 0.0, 1.0])
            row[0] += last.get(element.path) != block
            row[1] += size
            row[2] += len(MARKS.findall(text))
            row[3] = min(row[3], 0.0 if element.marked else 1.0) if row[0] == 1 else max(row[3], 0.0 if element.marked else 1.0)
            last[element.path] = block
    if not nodes:
        return set()
    table = np.array(list(nodes.values()))
    text_ratio, mark_ratio = table[:, 1] / table[:, 0], table[:, 2] / table[:, 0]
    score = _smooth(text_ratio) * (1 + _smooth(mark_ratio)) * table[:, 3]
    return {p for p, s in zip(nodes, score) if s > 0 and s >= CHOSEN * score.max()}


def article(found: list[tuple[Element, int, str]], elements: list[Element], paths: set[int]) -> Element | None:
    """The lowest container with most of the text on the chosen paths, widened to the article around it."""
    for element, _, text in found:
        if element.path in paths and not element.marked:
            element.held += len(text.strip())
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.held += e.held
    total = elements[0].held
    holding = [e for e in elements if total and e.name in CONTAINERS and e.held >= HELD * total]
    if not holding:
        return None
    best = max(holding, key=lambda e: e.depth)
    around = list(_ancestors(best))
    named = [e for e in around if e.name in ("article", "main")]
    if named:
        return named[-1]
    # other sections: the lowest container that holds all chosen text
    best = next((e for e in around if e.name in CONTAINERS and e.held >= total), best)
    # headings before it, in a container around it below the body
    outside = {id(e): n for n, e in enumerate(_ancestors(best)) if e.name in CONTAINERS - {"html", "body"}}
    outer, known = best, set()
    _mark_inside(elements, best)
    for element, _, text in found:
        if element.inside:
            break
        if element.marked or not text.strip() or id(element) in known:
            continue
        head, steps = element, []
        while head is not None and head.name not in HEADINGS and id(head) not in known:
            steps.append(id(head))
            head = head.parent
        known.update(steps)  # none of them lies in a heading not yet looked at
        if head is None or id(head) in known:
            continue
        known.add(id(head))
        holder = next((e for e in _ancestors(head) if e.name in CONTAINERS), None)
        if holder is not None and outside.get(id(holder), -1) > outside.get(id(outer), -1):
            outer = holder
    return outer


def _mark_inside(elements: list[Element], top: Element) -> None:
    for e in elements:
        e.inside = e is top or (e.parent is not None and e.parent.inside)


def _ancestors(e: Element | None) -> Iterator[Element]:
    """An element and those around it, from the inside."""
    while e is not None:
        yield e
        e = e.parent


def main_text(html: str | None) -> str:
    """Blocks of the article joined by a line feed; white space inside a block is one space. Null or no text: empty."""
    found, elements = leaves(html or "")
    top = article(found, elements, chosen_paths(found))
    if top is None:
        return ""
    _mark_inside(elements, top)
    blocks: list[tuple[int, list[str]]] = []
    for element, block, text in found:
        if element.inside and not element.marked:
            if not blocks or blocks[-1][0] != block:
                blocks.append((block, []))
            blocks[-1][1].append(text)
    lines = (" ".join(unescape("".join(parts)).split()) for _, parts in blocks)
    return "\n".join(x for x in lines if x)


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every whole page; a column of that name is replaced, others stay, the page goes."""
    inner = df.select(*other_columns(df, [out, html]), F.col(f"`{html}`").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = text_arrays(batch.column(batch.num_columns - 1))
            for start, end in slices(pages):
                texts = [main_text(p) for p in pages.slice(start, end - start).to_pylist()]
                before = [c.slice(start, end - start) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*before, pa.array(texts, pa.string())], [*batch.schema.names[:-1], out])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]]
    return inner.mapInArrow(tidy(run), ", ".join([*kept, f"`{out}` string"]))
