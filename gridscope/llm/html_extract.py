"""Main text of web pages by two passes of block rules.

The first pass parts a page into blocks and decides those that are clear: by the container
they stand in, by link density, and by length and stop-word density. The second pass lets the
undecided short blocks inherit the label of the nearest decided block before and after them.

What the words of a class or id say is held against the page's prose: containers that would
throw it away, or keep only a small part of it, are not believed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from gridscope.llm.common import column_of, slices

GOOD, BAD, OPEN = 1, -1, 0

#: Elements of HTML by their role.
RAW = ("script", "style", "textarea", "iframe", "xmp", "noembed", "noframes")  # text up to the end tag, or the page's end
#: Left out with what stands in them; one that is never closed hides nothing. Formulas keep their text, not its source notation.
SHUT = ("noscript", "template", "svg", "canvas", "annotation", "annotation-xml")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a following element of the same kind ends.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
BAD_ELEMENTS = frozenset("head nav header footer aside form menu dialog button select label search option optgroup fieldset".split())
MAIN_ELEMENTS = frozenset("article main".split())

#: Words in class, id or role that mark a container.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner bottombar breadcrumb breadcrumbs captcha comment comments"
    " consent cookie cookies copyright disclaimer discussion disqus dropdown foot footer gdpr head header legal login masthead"
    " menu menubar metadata modal nav navbar navigation navi newsletter notice notices notification pager pagination paywall"
    " popup promo promotion promoted recommended register related replies reply respond reviews search share sharing sidebar"
    " signin signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar warning widget"
    " complementary contentinfo form dialog alertdialog".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry hentry main maincontent post story text".split())
#: Words of containers whose long texts are no main text; the others give way to a long block.
FIRM_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising captcha comment comments consent cookie cookies copyright disclaimer"
    " discussion disqus foot footer gdpr menu menubar modal nav navbar navigation navi newsletter pager pagination paywall popup promo"
    " promotion promoted recommended related replies reply respond reviews sidebar signin signup sponsor sponsored subscribe subscription"
    " complementary contentinfo form dialog alertdialog".split()
)
#: Elements that a word can mark as the main container.
CONTAINERS = frozenset("article main section div td".split())
#: Classes that tell a state, a subject or a framework, not a role.
_STATE = re.compile(r"(?:has|with|without|no|tag|category|cat|comments|ping)[-_](?!(?:list|area|section|wrapper|container|form|links?|cloud|box|block)\b)[\w-]+|elementor-widget[\w-]*", re.I)

#: Frequent words of several languages.
STOP_WORDS = frozenset(
    "the of and to in is that it for as was with be by on not he his are at this from or have an they which one you were all"
    " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach"
    " de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son cette"
    " el y los del las por con una para su al lo como más pero sus o este sí porque entre cuando muy sin sobre"
    " il di che è non si per gli della nel alla sono anche ma più ha questo"
    " os da em um uma não no na dos mais mas foi ao ele das tem à seu sua ou ser"
    " het een van en op te dat niet zijn met voor er maar om hij ook bij aan was"
    " w z się nie na że do jest jak po co ale od za przez był jego"
    " и в не на что он с как это по но из у за от к о для так же был она они мы его"
    " i och att det som på är av för den till med inte han om har ett var jeg ikke og"
    " ve bir bu için da ile çok olarak daha gibi ne"
    " και το του η της την με για από που δεν θα στο είναι"
    " في من على إلى أن هذا التي الذي عن مع كان لا ما"
    " है के में की से को का और यह पर ने हैं नहीं"
    " của và là có trong được cho không một người".split()
)

#: Letters of scripts without spaces; about two of the first kind make a word, five of the second.
_DENSE = re.compile(r"[\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")
_LOOSE = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u0F00-\u0FFF]")
#: A text that ends like a sentence.
_SENTENCE = re.compile(r"[.!?…。！？．।॥۔؟።។៕။]['\"”’»)\]」』）]*$")

LONG_WORDS, STOP_SHARE, LINK_SHARE, SHORT_WORDS = 30, 0.2, 0.5, 12

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SHUT}
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A run of text between block elements; ``inside`` is the label of its nearest marked container.

    ``doubted`` are the containers around it that only a word makes bad: their number in the
    page, and whether the word is firm. None if an element or an attribute makes it bad.
    """

    text: str
    link_chars: int
    inside: int
    heading: bool
    doubted: tuple[tuple[int, bool], ...] | None = ()
    label: int = OPEN


def bad_words(tag: str, attributes: str, within: int) -> set[str]:
    """Words in class, id or role that make a container bad."""
    if not attributes or tag in ("body", "html"):
        return set()
    told = (token for found in _MARK.findall(attributes) for token in "".join(found).split())
    words = {w for token in told if not _STATE.fullmatch(token) for w in _WORD.findall(_CAMEL.sub(" ", token).lower())} & BAD_WORDS
    return set() if within == GOOD and words <= {"head", "header"} else words


def container_label(tag: str, attributes: str, within: int) -> int | None:
    """What a container says about its blocks, but for bad words, or None if it says nothing."""
    if tag in BAD_ELEMENTS:
        # The header of an article holds its title; that of a page holds its menu.
        return None if tag == "header" and within == GOOD else BAD
    if attributes:
        if _HIDDEN.search(attributes):
            return BAD
        words = {
            w for found in _MARK.findall(attributes) for w in _WORD.findall(_CAMEL.sub(" ", "".join(found)).lower())
        }
        if tag in CONTAINERS and words & MAIN_WORDS and within != BAD:
            return GOOD
    return GOOD if tag in MAIN_ELEMENTS and within != BAD else None


def blocks_of(page: str, trusted: frozenset[int] = frozenset()) -> list[Block]:
    """The blocks of a page in order. Unclosed and stray tags are tolerated.

    Bad words of containers whose numbers are ``trusted`` say nothing.
    """
    stack: list[tuple[str, int, tuple[tuple[int, bool], ...] | None]] = []
    number = 0
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    links = 0

    def inside() -> int:
        return stack[-1][1] if stack else OPEN

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(p for p, in_link in parts if in_link)).split()))
                heading = any(t[0] == "h" and t[1:].isdigit() for t, *_ in stack[-2:])
                found.append(Block(text, linked, inside(), heading, stack[-1][2] if stack else ()))
            parts.clear()

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return

    at = 0
    unclosed: set[str] = set()  # looked for once, however often they are opened
    for token in _TOKEN.finditer(page):
        if token.start() < at:
            at = max(at, token.end())
            continue
        if token.start() > at:
            parts.append((page[at : token.start()], links > 0))
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag, rest = tag.lower(), token["rest"]
        if tag in _ENDS and not token["end"] and not rest.endswith("/") and tag not in unclosed:
            if end := _ENDS[tag].search(page, at):
                at = end.end()
                continue
            unclosed.add(tag)
        if tag == "a":
            links = max(0, links - 1) if token["end"] else 1
        if tag in BLOCKS:
            flush()
            links = 0 if tag != "a" else links
        elif tag == "br":
            parts.append((" ", links > 0))
        if token["end"]:
            if any(t == tag for t, *_ in stack):
                flush()
                close(tag)
        elif tag not in VOID and not rest.endswith("/"):
            if tag in SELF_ENDING and stack and stack[-1][0] == tag:
                stack.pop()
            elif tag in BLOCKS and stack and stack[-1][0] == "p":
                stack.pop()
            number += 1
            said, doubted = container_label(tag, rest, inside()), stack[-1][2] if stack else ()
            if said == BAD:
                doubted = None
            elif number not in trusted and (words := bad_words(tag, rest, inside())):
                said, doubted = BAD, None if doubted is None else (*doubted, (number, bool(words & FIRM_WORDS)))
            if tag in BLOCKS or said is not None:
                if said is not None:
                    flush()
                stack.append((tag, inside() if said is None else said, doubted))
    if at < len(page):
        parts.append((page[at:], links > 0))
    flush()
    return found


def size_of(text: str) -> tuple[float, bool]:
    """Words of a text, those of scripts without spaces by their letters, and whether it is mostly in such a script."""
    words = len(text.split())
    if text.isascii():
        return words, False
    unspaced = len(_DENSE.findall(text)) / 2 + len(_LOOSE.findall(text)) / 5
    return words + unspaced, unspaced > words


def by_text(block: Block) -> int:
    """Label of a block by its links, length and stop words; OPEN if none decides."""
    size, unspaced = size_of(block.text)
    if block.link_chars > LINK_SHARE * len(block.text) or size < LONG_WORDS and "\N{COPYRIGHT SIGN}" in block.text:
        return BAD
    if size < SHORT_WORDS:
        return OPEN
    words = block.text.lower().split()
    fluent = unspaced or sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) >= STOP_SHARE * len(words)
    if size >= LONG_WORDS:
        return GOOD if fluent or not block.link_chars else OPEN
    return GOOD if fluent and not block.link_chars else OPEN


def first_pass(blocks: list[Block]) -> None:
    """Labels by container, links, length and stop words; OPEN if none decides.

    Where containers mark most of the page's prose as the article, only blocks in them count.
    A page that leaves nothing good falls back to its undecided blocks that look like
    sentences, or else, if they are more than a few words, to all of them.
    """
    own = [by_text(b) for b in blocks]
    read = [(b, len(b.text)) for b, label in zip(blocks, own, strict=True) if label == GOOD and b.inside != BAD]
    read = read or [(b, len(b.text)) for b, label in zip(blocks, own, strict=True) if label == OPEN and b.inside != BAD and not b.heading]
    held = sum(n for b, n in read if b.inside == GOOD)
    marked = any(b.inside == GOOD for b in blocks) and 2 * held >= sum(n for _, n in read)
    for block, label in zip(blocks, own, strict=True):
        if block.inside == BAD or marked and block.inside == GOOD:
            block.label = block.inside
        elif block.inside == GOOD:
            block.label = label or GOOD
        else:
            block.label = BAD if marked and not block.heading else label
    if any(b.label == GOOD for b in blocks):
        return
    left = [b for b in blocks if b.label == OPEN and not b.heading]
    sentences = [b for b in left if _SENTENCE.search(b.text) or size_of(b.text)[0] >= SHORT_WORDS]
    if not sentences and sum(size_of(b.text)[0] for b in left) >= SHORT_WORDS:
        sentences = left
    for block in sentences:
        block.label = GOOD


def believed(page: str) -> list[Block]:
    """The blocks of a page, without the bad words that its prose speaks against.

    A word that is not firm gives way to a long block of prose; a firm one only if no article
    is marked and its container holds all prose and all but a few words of the rest.
    """
    trusted: frozenset[int] = frozenset()
    while True:
        blocks = blocks_of(page, trusted)
        prose = [b for b in blocks if b.doubted is not None and by_text(b) == GOOD]
        wrong = {
            k for b in prose if b.doubted and size_of(b.text)[0] >= LONG_WORDS and not any(firm for _, firm in b.doubted) for k, _ in b.doubted
        }
        if prose and not any(b.inside == GOOD for b in blocks):
            rest = [b for b in blocks if b.doubted is not None and not b.heading and by_text(b) == OPEN]
            around = set(prose[0].doubted).intersection(*[b.doubted for b in prose[1:]])
            wrong |= {k for k, firm in around if sum(size_of(b.text)[0] for b in rest if (k, firm) not in b.doubted) < SHORT_WORDS}
        if not wrong:
            return blocks
        trusted |= wrong


def second_pass(blocks: list[Block]) -> None:
    """Let undecided blocks inherit: good if both decided neighbours are good, or the nearer one is.

    At equal distance a heading follows what comes after it, any other block what comes
    before. A page without any decided block has no main text.
    """
    decided = [k for k, b in enumerate(blocks) if b.label != OPEN]
    first = [b.label for b in blocks]
    ahead = 0
    for k, block in enumerate(blocks):
        if block.label != OPEN:
            continue
        while ahead < len(decided) and decided[ahead] < k:
            ahead += 1
        before = decided[ahead - 1] if ahead else None
        after = decided[ahead] if ahead < len(decided) else None
        if before is None or after is None:
            near = after if before is None else before
        elif k - before == after - k:
            near = after if block.heading else before
        else:
            near = before if k - before < after - k else after
        block.label = BAD if near is None else first[near]


def main_text(page: str | None) -> str:
    """Main text of a page: its good blocks in order, parted by empty lines; empty if there is none.

    Where a page marks its article, only blocks that stand in it count; elsewhere the rules
    on length, links and stop words decide.
    """
    if not page:
        return ""
    blocks = believed(page)
    first_pass(blocks)
    second_pass(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole markup.

    A null or empty page gives an empty text. Repeated rows are kept; other columns are not
    read. Very long pages are handed over in small batches. A script, style or frame that is
    never closed reaches to the page's end, as in a browser; an unclosed element of
    :data:`SHUT` hides nothing. Formulas and objects keep their text.
    """
    chosen = pages.select(page_id, url, page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page):
            texts = [main_text(p) for p in column_of(batch, page)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[page_id, url, "text", "n_chars"],
            )

    fields = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    return chosen.mapInArrow(run, f"`{page_id}` {fields[page_id]}, `{url}` {fields[url]}, text string, n_chars long")
