"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A block has features
of its ancestors (tags, and families of class and id names) and of its text. The field labels
the chain of blocks as article or not; Viterbi finds the best labels of a whole page.

It is trained on at most ``FIT_PAGES`` pages of at most ``FIT_CHARS`` characters, picked by the
hash of their id and labelled by their containers; if all are longer, on the shortest ones, up
to ``FIT_TOTAL`` characters but one at least. If none of these has an article or a main element,
it learns from pages that stand here instead. Long chains are cut into pieces of ``FIT_BLOCKS``
blocks, the inside of long runs of one label left out; their first, last and then other pieces are
learned, ``FIT_PIECES`` in all or one of every chain. Each page is learned as it is and in a
changed form: other containers for the article, and sidebars, menus, notices, forms, adverts
and reader comments put around and into it, with text of other pages, so that the field
knows these by their marks and not by their words.

Defined cases: null or empty html gives an empty text; broken markup is read as far as it
goes (an unclosed head ends before what cannot stand in it, of other unclosed containers only
the tag is dropped, an unclosed script, style or comment lasts to the end); repeated rows each get their row; without a page to learn from, nothing is main
text; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES, FIT_CHARS, FIT_BLOCKS = 300, 100_000, 80
#: Characters of pages where all are longer; pieces of chains; blocks kept at each end of a long run.
FIT_TOTAL, FIT_PIECES, FIT_RUN = 10_000_000, 1_200, 20

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
#: Elements that are dropped whole if they are closed; if not, their tag alone is.
_CLOSING = {t: re.compile(rf"</{t}\s*>", re.I) for t in "noscript template svg iframe textarea select".split()}
#: What may stand in a head. Without an end tag, it ends before anything else.
IN_HEAD = frozenset("title meta link base basefont bgsound noscript template noframes".split())
_TITLE = re.compile(r"</title\s*>", re.I)
_SELECT = re.compile(r"<select(?=[\s/>])", re.I)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_STATE = re.compile(r"^(?:has|no|is|with|without)-|-(?:open|closed|enabled|disabled|active|visible|hidden)$")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base col embed hr link meta param source track".split())
#: An opening tag that ends an open element of the same kind.
ALONE = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
TAGS = frozenset(
    "article main section nav aside footer header form ul ol li table p blockquote pre figure h1 h2 h3 h4 h5 h6 div".split()
)
#: Families of class and id names.
FAMILIES = {
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar",
    "side": "side sidebar widget rail related recommended recommendations more popular trending",
    "foot": "foot footer copyright legal colophon",
    "head": "header masthead topbar logo",
    "notice": "cookie cookies consent notice alert modal popup overlay gdpr subscribe newsletter signup",
    "comment": "comment comments reply replies discussion disqus respond",
    "social": "share sharing social follow like tweet",
    "form": "form search login signin contact",
    "body": "content article post entry story text body main",
}
_FAMILY = {word: family for family, words in FAMILIES.items() for word in words.split()}
#: Tags of what stands apart from a main text.
APART_TAGS = frozenset({"nav", "aside", "footer", "form"})
NOT_MAIN = frozenset({"advert", "menu", "side", "foot", "head", "notice", "comment", "social", "form"})


class Block(NamedTuple):
    text: str
    tags: frozenset[str]
    families: frozenset[str]
    inner: str
    linked: float


def families_of(attributes: str) -> frozenset[str]:
    """Families of the names of an element. Names of states (has-sidebar, comments-open) say what a page can do."""
    if "=" not in attributes:
        return frozenset()
    names = " ".join(m.group(1).strip("\"'") for m in _NAME.finditer(attributes)).lower().split()
    return frozenset(_FAMILY[w] for name in names if not _STATE.search(name) for w in _WORD.findall(name) if w in _FAMILY)


def head_end(page: str, begin: int) -> int:
    """Where a head ends whose tag ends at ``begin``: after its end tag, else before what cannot stand in it."""
    at, end = begin, None
    while m := _PART.search(page, at):
        if end is None and page[at:m.start()].strip():
            end = at
        at, tag = m.end(), (m.group(3) or "").lower()
        if not tag:
            continue
        if tag == "head" and m.group(2):
            return at
        if tag == "body":
            return m.start() if end is None else end
        if not m.group(2) and tag in ("title", *_CLOSING):
            closed = (_TITLE if tag == "title" else _CLOSING[tag]).search(page, at)
            at = closed.end() if closed else at
        if end is None and tag not in IN_HEAD:
            end = m.start()
    if end is None and page[at:].strip():
        end = at
    return len(page) if end is None else end


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order.

    What holds the page, or most of it with its article, says nothing of what stands apart: such a
    wrapper's names and tag count as evidence for a main text only.
    """
    found: list[tuple[str, tuple[int, ...], float]] = []
    elements: list[tuple[str, frozenset[str]]] = []
    stack: list[tuple[str, int]] = []
    around: frozenset[int] = frozenset()  # the first article and what it stands in
    pieces: list[str] = []
    in_link, linked, at = 0, 0, 0
    headed, unclosed = False, set()

    def close():
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            found.append((text, tuple(i for _, i in stack), linked / len(text)))
        linked = 0

    while m := _PART.search(page, at):
        if m.start() > at:
            pieces.append(page[at:m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            if m.group(1):
                close()
            continue
        ending = m.group(2)
        if tag == "head":
            close()
            if not ending and not headed:
                headed, at = True, head_end(page, at)
            continue
        if tag in _CLOSING:
            close()
            if not ending and tag not in unclosed and not (tag == "svg" and m.group(4).endswith("/")):
                closed = _CLOSING[tag].search(page, at)
                if not closed:
                    unclosed.add(tag)
                # A select cannot stand in another: the first one was left open.
                elif tag != "select" or not _SELECT.search(page, at, closed.start()):
                    at = closed.end()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ending else 1
            elif tag in ("br", "img", "input"):
                pieces.append(" ")
            continue
        close()
        in_link = 0
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID and not m.group(4).endswith("/"):
            if tag in ALONE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if stack[i][0] not in ALONE:
                        break
            stack.append((tag, len(elements)))
            elements.append((tag, families_of(m.group(4))))
            named_apart = elements[-1][1] & NOT_MAIN or {t for t, _ in stack} & {"nav", "aside", "footer"}
            if tag in ("article", "main") and not around and not named_apart:
                around = frozenset(i for _, i in stack)
    pieces.append(page[at:])
    close()
    return evidence(found, elements, around)


#: Share of a page's text from which an element is a wrapper: with the first article in it, and in any case.
MOST_WITH_ARTICLE, MOST = 0.5, 0.9


def evidence(
    found: list[tuple[str, tuple[int, ...], float]], elements: list[tuple[str, frozenset[str]]], around: frozenset[int]
) -> list[Block]:
    """Blocks with what their containers say, wrappers taken for what they are."""
    held = [0] * len(elements)
    for text, chain, _ in found:
        for i in chain:
            held[i] += len(text)
    total = sum(len(text) for text, _, _ in found)

    def wraps(i: int) -> bool:
        return elements[i][0] in ("html", "body") or held[i] >= (MOST_WITH_ARTICLE if i in around else MOST) * total

    said = {}
    for i in set().union(*(chain for _, chain, _ in found)):
        tag, families = elements[i]
        if wraps(i):
            families = frozenset() if tag in ("html", "body") else families - NOT_MAIN
            tag = "" if tag in APART_TAGS else tag
        said[i] = (tag, families)
    return [
        Block(
            text, frozenset(said[i][0] for i in chain if said[i][0] in TAGS), frozenset().union(*(said[i][1] for i in chain)),
            elements[chain[-1]][0] if chain else "", linked,
        )
        for text, chain, linked in found
    ]


def features(block: Block) -> list[str]:
    text, n = block.text, block.text.count(" ") + 1
    found = [f"in:{t}" for t in block.tags] + [f"of:{f}" for f in block.families] + [f"is:{block.inner}", "any"]
    found += [f"words>{k}" for k in (3, 8, 20, 50) if n > k]
    if block.linked > 0.5:
        found.append("linked")
    if text[-1] in ".!?…\"”":
        found.append("sentence")
    if "," in text:
        found.append("comma")
    if "©" in text or "copyright" in text.lower():
        found.append("copyright")
    if not block.tags & {"article", "main"} and "body" not in block.families:
        found.append("outside")
    if block.families & NOT_MAIN or block.tags & APART_TAGS:
        found.append("apart")
    return found


def labelled(page: str) -> list[tuple[Block, int]]:
    """Blocks with 1 for text that stands in an article and in nothing that stands apart."""
    return [
        (b, int(bool(b.tags & {"article", "main"}) and not b.families & NOT_MAIN and not b.tags & APART_TAGS))
        for b in blocks_of(page)
    ]


#: What is put around (0, 2) or into (1) an article; %s is text of another page.
DECOYS = (
    (0, '<header class="masthead"><div class="logo">%s</div><p>%s</p></header>'),
    (0, '<div class="menu"><a href="/">%s</a> <a href="/">%s</a></div>'),
    (0, '<div id="cookie-notice"><p>%s</p></div>'),
    (0, '<div class="breadcrumbs"><p>%s</p></div>'),
    (1, '<div class="advert"><p>%s</p></div>'),
    (1, '<aside><p>%s</p></aside>'),
    (1, '<div class="share">%s</div>'),
    (1, '<form><p>%s</p></form>'),
    (2, '<aside class="sidebar"><h3>%s</h3><ul><li><a href="/">%s</a></li></ul><p>%s</p></aside>'),
    (2, '<div class="related"><h3>%s</h3><p>%s</p></div>'),
    (2, '<section id="comments"><h2>%s</h2><div class="comment"><p>%s</p></div><article class="comment"><p>%s</p></article></section>'),
    (2, '<form class="newsletter"><p>%s</p><label>%s</label></form>'),
    (2, '<div id="footer"><p>%s</p></div>'),
)
CONTAINERS = ("<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>',
              '<section class="post-body">%s</section>', '<div id="article-text"><div>%s</div></div>',
              '<main><header><h1>%s</h1></header>%s</main>')


#: Pages to learn from where a sample has no article.
KNOWN_PAGES = tuple(
    f"<body><article><h1>{title}</h1>{''.join(f'<p>{text}</p>' for text in texts)}</article></body>"
    for title, *texts in (
        ("On rivers", "Rivers carry sand, silt and gravel towards the sea, and they drop them where they slow down.",
         "In spring the water rises.", "Where two of them meet, towns were founded early, since goods could be moved there."),
        ("How bread is made", "Flour, water and salt are mixed and left to rest for an hour before the dough is shaped.", "Then it rises again.",
         "An oven that is hot from below gives a firm crust, which many people like best of all."),
        ("Notes from a walk", "We left before dawn and followed the old road, which climbs slowly through the woods.",
         "Nobody was there.", "From the top one sees three valleys, a lake and, on clear days, the coast."),
    )
)
#: Text of what stands around them.
KNOWN_OTHERS = ("Home", "Sign up now", "Read more", "All rights reserved.", "We use cookies to make this site better, and to count visits.",
                "Great post, thank you for writing it!", "Search", "You may also like these stories, picked for you every day.")


def changed(page: str, others: list[str], number: int, containers: tuple[str, ...] = CONTAINERS) -> list[tuple[Block, int]]:
    """The page's article in another container, between decoys; labels follow from that."""
    rows = labelled(page)
    own = [b.text for b, label in rows if label]
    if not own:
        return rows
    pick = lambda k: others[(number * 31 + k * 7) % len(others)]
    parts: dict[int, list[str]] = {0: [], 1: [], 2: []}
    for k, (place, decoy) in enumerate(DECOYS):
        if (number + k) % 3:
            n = decoy.count("%s")
            parts[place].append(decoy % tuple(html.escape(pick(k + i)) for i in range(n)))
    container = containers[number % len(containers)]
    paragraphs = [f"<p>{html.escape(t)}</p>" for t in own]
    middle = len(paragraphs) // 2
    inside = "".join([*paragraphs[:middle], *parts[1], *paragraphs[middle:]])
    if container.count("%s") == 2:
        inside = container % (html.escape(own[0]), inside)
    else:
        inside = container % inside
    made = blocks_of("<body>" + "".join(parts[0]) + inside + "".join(parts[2]) + "</body>")
    wanted = set(own)
    return [(b, int(b.text in wanted and "apart" not in features(b))) for b in made]


class Field(NamedTuple):
    """Weights of a feature for label 1, of a step between labels, and of the first label."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]
    first: float


def pieces_of(chain: list[tuple[Block, int]]) -> list[list[tuple[Block, int]]]:
    """A chain in pieces to learn from: the first, the last, then the others; short chains as they are."""
    if len(chain) <= FIT_BLOCKS:
        return [chain]
    kept, begin = [], 0
    for i in range(1, len(chain) + 1):
        if i == len(chain) or chain[i][1] != chain[begin][1]:
            run = chain[begin:i]
            kept += run if len(run) <= 2 * FIT_RUN else run[:FIT_RUN] + run[-FIT_RUN:]
            begin = i
    cut = [kept[i:i + FIT_BLOCKS] for i in range(0, len(kept), FIT_BLOCKS)]
    return [cut[0], *cut[:0:-1][:1], *cut[1:-1]]


def train(chains: list[list[tuple[Block, int]]], rounds: int = 250, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent; forward and backward over all chains at once."""
    pieces = [pieces_of(c) for c in chains if c]
    order = sorted((k, i) for i, cut in enumerate(pieces) for k in range(len(cut)))[:max(FIT_PIECES, len(pieces))]
    chains = [pieces[i][k] for k, i in order]
    # Only the first piece of a chain has the first label of a page.
    begins = np.array([k == 0 for k, _ in order], float)
    names = sorted({f for c in chains for b, _ in c for f in features(b)})
    place = {f: i for i, f in enumerate(names)}
    if not chains:
        return Field({"any": -10.0}, ((0.0, 0.0), (0.0, 0.0)), 0.0)
    s, t = len(chains), max(map(len, chains))
    x, y, live = np.zeros((s, t, len(names)), np.float32), np.zeros((s, t), int), np.zeros((s, t))
    for i, chain in enumerate(chains):
        for j, (block, label) in enumerate(chain):
            x[i, j, [place[f] for f in features(block)]] = 1
            y[i, j], live[i, j] = label, 1
    blocks = live.sum()
    w, a, first = np.zeros(len(names)), np.zeros((2, 2)), 0.0
    seen_steps = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen_steps[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & (live[:, 1:] == 1)).sum()
    seen = np.einsum("stf,st->f", x, y * live)
    moment = [np.zeros(len(names) + 5), np.zeros(len(names) + 5)]
    for step in range(1, rounds + 1):
        state = np.zeros((s, t, 2))
        state[:, :, 1] = x @ w
        state[:, 0, 1] += first * begins
        forward = np.zeros((s, t, 2))
        forward[:, 0] = state[:, 0]
        for j in range(1, t):
            into = np.logaddexp.reduce(forward[:, j - 1, :, None] + a[None], axis=1) + state[:, j]
            forward[:, j] = np.where(live[:, j, None] > 0, into, forward[:, j - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        backward = np.zeros((s, t, 2))
        steps = np.zeros((2, 2))
        for j in range(t - 2, -1, -1):
            on = live[:, j + 1, None] > 0
            out = np.logaddexp.reduce(a[None] + (state[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(on, out, backward[:, j + 1])
            pair = forward[:, j, :, None] + a[None] + (state[:, j + 1] + backward[:, j + 1])[:, None, :] - total[:, None, None]
            steps += (np.exp(np.minimum(pair, 0)) * on[:, :, None]).sum(0)
        p = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0)) * live
        gradient = np.concatenate([
            seen - np.einsum("stf,st->f", x, p), (seen_steps - steps).ravel(), [((y[:, 0] - p[:, 0]) * begins).sum()],
        ]) / blocks - ridge * np.concatenate([w, a.ravel(), [first]])
        moment[0] = 0.9 * moment[0] + 0.1 * gradient
        moment[1] = 0.99 * moment[1] + 0.01 * gradient**2
        move = 0.2 * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        w += move[:len(w)]
        a += move[len(w):-1].reshape(2, 2)
        first += move[-1]
    return Field(dict(zip(names, map(float, w))), tuple(tuple(map(float, r)) for r in a), float(first))


def viterbi(field: Field, blocks: list[Block]) -> list[int]:
    """The most likely labels of a chain."""
    if not blocks:
        return []
    weights, steps = field.weights, field.steps
    no, yes = 0.0, field.first
    back = []
    for k, block in enumerate(blocks):
        here = sum(weights.get(f, 0.0) for f in features(block))
        if k:
            into = (no + steps[0][0], yes + steps[1][0]), (no + steps[0][1], yes + steps[1][1])
            back.append((int(into[0][1] > into[0][0]), int(into[1][1] > into[1][0])))
            no, yes = max(into[0]), max(into[1])
        yes += here
    labels = [int(yes > no)]
    for pair in reversed(back):
        labels.append(pair[labels[-1]])
    return labels[::-1]


def main_text(field: Field, page: str) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, label in zip(blocks, viterbi(field, blocks)) if label)


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, page_id: str = "page_id", page: str = "html") -> Field:
    """A field trained on a bounded sample of pages, labelled by their containers."""
    full = pages.select(F.col(page).alias("html"), F.xxhash64(F.col(page_id), F.length(page)).alias("_h")).filter(F.length("html") > 0)
    short = full.filter(F.length("html") <= FIT_CHARS)
    # Hashes are ordered without their pages; pages come to the driver for the chosen ones only.
    last = short.select("_h").orderBy("_h").limit(fit_pages).agg(F.max("_h")).first()[0]
    sample = []
    if last is not None:
        chosen = short.filter(F.col("_h") <= last).orderBy("_h", "html").limit(fit_pages)
        sample = [r["html"] for r in chosen.select("html").collect()]
    if not sample:
        sizes = [r["n"] for r in full.select(F.length("html").alias("n")).orderBy("n").limit(fit_pages).collect()]
        room = max(1, int(np.searchsorted(np.cumsum(sizes), FIT_TOTAL, "right")))
        sample = [r["html"] for r in full.orderBy(F.length("html"), "_h", "html").limit(room).select("html").collect()]
    others = [b.text for p in sample for b in blocks_of(p)] or [""]
    # A page without an article says nothing of what a main text is.
    telling = [p for p in sample if any(label for _, label in labelled(p))]
    if not telling:
        # Without labels the sample says nothing of its own; the last container is none at all.
        return train([
            changed(KNOWN_PAGES[i % len(KNOWN_PAGES)], list(KNOWN_OTHERS), i, (*CONTAINERS, "%s")) for i in range(84)
        ])
    # Where other pages of the table do without articles, some are shown without.
    containers = CONTAINERS if len(telling) == len(sample) else (*CONTAINERS, '<div class="wrap">%s</div>', "%s")
    return train([labelled(p) for p in telling] + [changed(p, others, i, containers) for i, p in enumerate(telling)])


def extract(pages: DataFrame, field: Field | None = None, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    field = field or fit(pages, page_id=page_id, page=page)
    weights, steps, first = field

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Field(weights, steps, first)
        for batch in batches:
            yield pd.Series([main_text(known, p) for p in batch], dtype=object)

    text = F.pandas_udf(read, "string")(F.coalesce(F.col(page), F.lit("")))
    found = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
