"""Main text of web pages: the maximum-scoring run of words and tags.

A page is read as a sequence of words and tags. Words score positive, tags negative; one linear scan finds the
contiguous region with the largest sum, and its blocks are the text. The scores are log odds counted on labelled pages,
for tokens inside an article or main element, outside it, and on pages that name none.

From the same pages the module learns which elements announce something else (menus, adverts, forms, comments, ...):
by their tag, and by the words of their classes, ids and roles, each within and outside an article. A class says so only
if one of its words was found on such elements and none is unknown or was found on main text: `share-bar` does,
`share-price` does not. Such elements score nothing and are left out of the text, wherever they stand; so is what a
browser doesn't show.

Defined cases. Null or empty html, and pages without a word, give an empty text. Cut-off tags, comments and scripts
end with the page. Unclosed elements end with their parent; one that holds an article or main element is never left
out. Of regions with equal sums the first and longest is taken. What is left out inside a line doesn't end its block.
Rows with null or repeated ids are rows like others.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import bound_batches

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>?)", re.S
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)

#: Names of HTML elements.
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
#: Elements that a browser does not show as text.
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas button select textarea datalist".split())
#: Elements whose tag may say that they are something else.
SECTIONS = frozenset("nav menu footer aside header form label dialog".split())
MAIN = frozenset("article main".split())
#: A word marks an element if it was found so many times as often on other elements as on main text.
SURE = 3.0

#: Which tag of an element scores how much, by where it stands: inside an article, outside, or on a page without one.
PLACES = ("in", "out", "plain")


def names_of(rest: str) -> tuple[list[list[str]], bool]:
    """The words of each class, id and role of a start tag, without plural endings, and whether it is hidden."""
    out, hidden = [], False
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key in ("hidden", "aria-hidden", "style"):
            shown = {"hidden": False, "aria-hidden": value.lower() != "true", "style": not re.search(r"display\s*:\s*none", value, re.I)}
            hidden |= not shown[key]
            continue
        for token in value.split() if key == "class" else [value]:
            apart = re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()
            words = [w[:-1] if len(w) > 3 and w.endswith("s") and w[-2] != "s" else w for w in re.split(r"[^a-z]+", apart) if w]
            if words:
                out.append(words)
    return out, hidden


def labelled_marks(name: str, rest: str, inside: bool) -> bool:
    """Whether a start tag of a labelled page begins something else."""
    return name in UNSEEN or "data-skip" in rest


def lex(page: str, marks: Callable[[str, str, bool], bool], elements: list | None = None) -> list[list]:
    """The tokens of a page in order: [tag name, text, closing, left out, labelled, inside]; a text has no name.

    `inside` is true within an article or main element, `labelled` within an element with the attribute data-main, in
    labelled pages. `elements` receives (name, rest, inside, left out, first token, last token) of each element.
    """
    tokens: list[list] = []
    stack: list[list] = []  # [name, index of its first token, left out, is labelled, rest, inside]
    at, out, inside, labelled, seen = 0, 0, 0, 0, False

    def pop(until: int) -> None:
        nonlocal out, inside, labelled
        while len(stack) > until:
            name, first, is_out, is_main, rest, within = stack.pop()
            if elements is not None:
                elements.append((name, rest, within, out > 0, first, len(tokens)))
            out -= is_out
            inside -= name in MAIN and not is_out
            labelled -= is_main

    def text(piece: str) -> None:
        if piece:
            tokens.append(["", entities.unescape(piece), False, out > 0, labelled > 0, inside > 0])

    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            tokens.append([name, "", True, out > 0, labelled > 0, inside > 0])
            if depth >= 0:
                pop(depth)
            continue
        if name in BLOCK and stack and stack[-1][0] == "p" and name != "br":
            pop(len(stack) - 1)
        if name in ("li", "option", "td", "tr", "dd", "dt") and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        rest = m[3] or ""
        is_out, is_main = int(marks(name, rest, inside > 0)), int("data-main" in rest)
        if name in MAIN and out and not is_out and not seen:  # what holds the article was not something else after all
            for entry in stack:
                if entry[2] and (entry[0] == "form" or entry[0] not in SECTIONS | UNSEEN):
                    for token in tokens[entry[1] :]:
                        token[3] = False
                    entry[2] = 0
                    out -= 1
        seen |= name in MAIN and not is_out and not out
        out += is_out
        labelled += is_main
        tokens.append([name, "", False, out > 0, labelled > 0, inside > 0])
        if name in VOID or rest.endswith("/>"):
            out -= is_out
            labelled -= is_main
            continue
        stack.append([name, len(tokens) - 1, is_out, is_main, rest, inside > 0])
        inside += name in MAIN and not is_out
        if name in RAW:
            end = re.compile(rf"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
    pop(0)
    return tokens


@dataclass
class Model:
    """What is learned from labelled pages.

    `weights` has the score of a word ("") and of each tag by place, "*" for other tags; `words` by context the odds
    that a word of a class, or `<tag`, stands on something else: 1 is even.
    """

    weights: dict[tuple[str, str], float]
    words: dict[tuple[bool, str], float]

    def marker(self) -> Callable[[str, str, bool], bool]:
        """Whether a start tag announces something other than the article."""

        @lru_cache(maxsize=1 << 14)
        def marks(name: str, rest: str, inside: bool) -> bool:
            if name in UNSEEN or self.words.get((inside, f"<{name}"), 0.0) >= SURE:
                return True
            if not rest:
                return False
            found, hidden = names_of(rest)
            if hidden or name in ("body", "html", "main"):
                return hidden
            for words in found:
                odds = [self.words.get((inside, w), 0.0) for w in words]
                if min(odds) >= 1 / SURE and max(odds) >= SURE:
                    return True
            return False

        return marks


def place_of(token: list, named: bool) -> str:
    """Where a token stands."""
    return "in" if token[5] else "out" if named else "plain"


def is_named(tokens: list[list]) -> bool:
    """Whether a page has words in an article or main element."""
    return any(t[5] and not t[0] and not t[3] and not t[1].isspace() for t in tokens)


def learn(pages: list[str]) -> Model:
    """A model from labelled pages, whose main text has the attribute data-main and whose boilerplate data-skip.

    Scores are log odds of a word, and of each tag, to be part of the main text. A word's score is positive, but for
    words outside an article, and a tag's negative by construction; the labels set how much. The start and the end tag
    of an element are one piece of evidence, so each carries half.
    """
    tags = {(place, main): Counter() for place in PLACES for main in (True, False)}
    words: dict[tuple[bool, str], list[int]] = defaultdict(lambda: [0, 0])
    for page in pages:
        elements: list = []
        tokens = lex(page, labelled_marks, elements)
        named = is_named(tokens)
        for token in tokens:
            name, piece, _, left_out, main, _ = token
            if name not in MAIN and not left_out:
                tags[place_of(token, named), main][name] += 1 if name else len(piece.split())
        for name, rest, inside, left_out, first, last in elements:
            main = any(t[4] and not t[3] for t in tokens[first:last])
            if main or left_out:
                for word in {w for part in names_of(rest)[0] for w in part} | ({f"<{name}"} if name in SECTIONS else set()):
                    words[inside, word][0 if main else 1] += 1
    weights = {}
    for place in PLACES:
        count = {main: tags[place, main] for main in (True, False)}
        total = {main: sum(c.values()) + 1 for main, c in count.items()}

        def odds(name: str) -> float:
            found = math.log((count[True][name] + 0.5) / (count[False][name] + 0.5))
            return found - math.log(total[True] / total[False]) if place == "plain" else found

        # Where a page names its article, the place itself is evidence; elsewhere only how the classes differ is.
        word = max(-1.0, min(1.0, odds(""))) if place == "out" else max(0.5, min(2.0, odds("")))
        weights["", place] = word
        for name in (set(count[True]) | set(count[False])) - {""}:
            score = odds(name) - (word if place == "plain" else 0.0)
            weights[name, place] = min(-0.001 if place == "in" else -0.05, max(-3.0, score / (1 if name in VOID else 2)))
        weights["*", place] = {"in": -0.001, "out": -1.0, "plain": -1.0}[place]
    return Model(weights, {k: (other + 0.5) / (main + 0.5) for k, (main, other) in words.items()})


def scores(tokens: list[list], weights: dict[tuple[str, str], float]) -> list[float]:
    """The score of each token: of a text, that of its words."""
    named, out = is_named(tokens), []
    for token in tokens:
        name, piece, _, left_out, _, _ = token
        place = place_of(token, named)
        if left_out:
            out.append(0.0)
        elif name:
            out.append(weights.get((name, place), weights["*", place]))
        else:
            out.append(weights["", place] * len(piece.split()))
    return out


def region(tokens: list[list], weights: dict[tuple[str, str], float]) -> tuple[int, int]:
    """Start and end of the run of tokens with the largest sum of scores; (0, 0) if no word scores."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores(tokens, weights)):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best or (total == best and best > 0 and start == span[0]):
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, model: Model, marks: Callable[[str, str, bool], bool] | None = None) -> str:
    """The blocks of the best region, each on a line of its own, white space collapsed."""
    tokens = lex(page or "", marks or model.marker())
    start, end = region(tokens, model.weights)
    blocks, current = [], []
    for name, piece, _, left_out, _, _ in tokens[start:end]:
        if name in BLOCK:
            blocks.append("".join(current))
            current = []
        elif not left_out and not name:
            current.append(piece)
    blocks.append("".join(current))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


#: Words by which authors name what is not the article, of the labelled pages.
OTHER = (
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup login sidebar sidenav menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer header masthead comment comments commentlist reply replies respond disqus discussion "
    "share sharing social related recommended popup modal overlay widget toolbar skip search copyright complementary contentinfo"
).split()
#: Of these, the words that within an article name parts of it.
OWN = "header masthead banner discussion".split()
#: Words of both: parts of names that say nothing by themselves.
EITHER = (
    "box wrapper wrap container list item items bar block section area inner outer top bottom left right global site page post "
    "module panel slot unit link links text title form js sticky mobile desktop primary secondary col row content body main group"
).split()
#: Words of main text.
CONTENT = "article story entry lead intro summary chapter figure caption price news note notes work results quote body text".split()


def labelled_pages() -> list[str]:
    """A bounded set of labelled pages: invented layouts, whose main text has the attribute data-main and whose
    boilerplate has data-skip. Sentences differ in length, blocks in number and kind."""
    sentence = "the quick survey of the harbour found nine old boats and one new crane beside the long wall".split()

    def words(n: int, k: int = 0) -> str:
        return " ".join(sentence[(i * 7 + k) % len(sentence)] for i in range(n))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1 + i % 2, i)}</a></li>' for i in range(n)) + "</ul>"

    def prose(k: int) -> str:
        return "".join(
            f"<p>{words(20 + 9 * j, j)} <a href='#'>{words(2, j)}</a><br>{words(3, j)} <b>{words(2)}</b><br>{words(1, j)} <span>{words(2)}</span> "
            f"<em>{words(1)}</em> <i>{words(2)}</i> <strong>{words(2)}</strong>.</p>" for j in range(k)
        )

    def rich(k: int) -> str:
        return (
            f"<h2>{words(4)}</h2><div>{words(25)}</div><div><div>{words(12)}</div></div><h3>{words(3)}</h3><p>{words(45)}<br>{words(30)}<br>{words(2)}</p><ul>"
            + "".join(f"<li>{words(9, j)}</li>" for j in range(k))
            + f"</ul><blockquote><p>{words(25)}</p></blockquote><table><tr><td>{words(4)}</td><td>{words(3)}</td></tr></table><p>{words(40)}</p>"
        )

    plain = [
        f"<html><body><div>{links(8)}</div><div data-main><h1>{words(6)}</h1>{prose(6)}</div><div>{links(5)}<p>{words(4)}</p></div></body></html>",
        f"<html><body><table><tr><td>{links(6)}</td><td data-main>{rich(4)}</td><td>{links(9)}</td></tr></table></body></html>",
        f"<html><body><div><span>{words(2)}</span> <a href='/'>{words(1)}</a></div><section data-main><h1>{words(5)}</h1>{rich(3)}{prose(6)}</section><div><small>{words(5)}</small></div></body></html>",
        f"<html><body><center><img src='x'><a href='/'>{words(2)}</a></center><div><div data-main>{prose(5)}{rich(5)}</div></div><div><a href='/'>{words(2)}</a> | <a href='/'>{words(2)}</a></div></body></html>",
    ]
    named = [
        f"<html><body><nav data-skip>{links(7)}</nav><div>{links(3)}</div><article data-main><h1>{words(7)}</h1>{prose(6)}<footer data-skip>{words(4)}</footer></article>"
        f"<div><p>{words(6)}</p><a href='/'>{words(2)}</a></div><footer data-skip>{words(8)}</footer></body></html>",
        f"<html><body><header data-skip><a href='/'>{words(2)}</a></header><div><span>{words(3)}</span></div><main data-main><header><h1>{words(5)}</h1></header>{rich(4)}"
        f"<aside data-skip><p>{words(9)}</p></aside><form data-skip><label data-skip>{words(2)}</label></form>{prose(2)}</main><aside data-skip>{links(3)}</aside></body></html>",
        f"<html><body><menu data-skip>{links(4)}</menu><form data-skip><p>{words(3)}</p></form><dialog data-skip><p>{words(12)}</p></dialog><div>{links(6)}<h3>{words(2)}</h3></div>"
        f"<article data-main><p>{words(30)}</p><nav data-skip>{links(2)}</nav><dialog data-skip>{words(4)}</dialog><menu data-skip>{links(2)}</menu>{prose(3)}</article><div><p>{words(5)}</p><ul><li>{words(2)}</li></ul></div></body></html>",
    ]

    named.append(
        f"<html><body><div>{links(4)}</div><div data-main><h1>{words(6)}</h1><p>{words(24)}</p><article>{prose(4)}</article></div><div><p>{words(5)}</p>{links(3)}</div></body></html>"
    )

    def others(inside: bool) -> Iterator[str]:
        for k, word in enumerate(OTHER):
            if not (inside and word in OWN):
                yield f'<div class="{word}" data-skip><p>{words(3 + k % 9, k)}</p></div>'
                yield f'<div id="{word}-{EITHER[k % len(EITHER)]}" data-skip><p>{words(3 + k % 7, k)}</p></div>'
                for j in range(4):
                    yield f'<div class="{word} {EITHER[(4 * k + j) % len(EITHER)]}" data-skip>{words(2, k)}</div>'

    def own(inside: bool) -> str:
        content = "".join(f'<div class="{w} {x}"><p>{words(12, k)}</p></div>' for k, w in enumerate(CONTENT) for x in EITHER)
        both = "".join(f'<p class="{w}-{CONTENT[k % len(CONTENT)]}">{words(14, k)}</p>' for k, w in enumerate(OTHER))
        return content + both + ("".join(f'<section id="{w}"><p>{words(16, k)}</p></section>' for k, w in enumerate(OWN * 3)) if inside else "")

    wrap = "".join(f'<div class="{w}">' for w in EITHER)
    marked = [
        f"<html><body>{wrap}{''.join(others(False))}<article data-main>{prose(2)}{own(True)}{''.join(others(True))}{prose(2)}</article>{'</div>' * len(EITHER)}</body></html>",
        f"<html><body>{''.join(others(False))}<div data-main>{prose(3)}{own(False)}{rich(2)}</div></body></html>",
    ]
    return [*plain, *named, *marked]


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = model.marker()
        for batch in batches:
            texts = [main_text(x, model, marks) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame, html: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """`pages` with text and n_chars (code points) in place of `html`; columns of those names are replaced."""
    bound_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema.fields)
    out = f"{fields}, text string, n_chars long" if fields else "text string, n_chars long"
    return pages.select(*kept, F.col(html)).mapInArrow(_extract(learn(labelled or labelled_pages())), out)
