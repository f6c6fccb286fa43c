"""Main-text extraction from HTML by a linear-chain conditional random field.

A page is the sequence of its leaf blocks: runs of text between block-level boundaries of
the DOM (unclosed elements are closed as browsers do).  Each block has features of its
ancestors (tags, words of class, id and role) and of its text; the field, trained on
labelled pages by gradient ascent on the conditional likelihood (forward-backward),
labels blocks as main text or not, and Viterbi decoding takes the best labelling.

The labelled pages are made here: layouts of many kinds, some of whose frames tell
nothing by name, from a fixed seed, so that training is repeatable and takes no data from
the tables.  The maker knows the main text, and the blocks are labelled by it.

Edge cases: null html and pages without main text give the empty text; character
references are decoded; white space inside a block, ``<br>`` included, becomes one space;
repeated rows get equal results; pages of any length are labelled whole; an empty table
gives an empty result; extra columns pass through unless they are called as the result.
"""

from __future__ import annotations

import html as html_module
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORDS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements without text of the page; all other text, formulas and fallback text included, is left to the field.
SILENT = frozenset("script style template title head iframe".split())
RAW = frozenset("script style textarea title iframe template".split())
INLINE = frozenset("math mi mo mn ms mtext mrow msup msub mfrac msqrt mover munder semantics annotation svg g text tspan object canvas audio video a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


def blocks(page: str) -> list[tuple[str, frozenset[str], str, float]]:
    """(text, ancestor marks, innermost block tag, share of characters inside links) of each leaf block in page order."""
    out: list[tuple[str, frozenset[str], str, float]] = []
    stack: list[tuple[str, frozenset[str]]] = []  # open elements, each with the marks of itself and all above it
    depths: dict[str, list[int]] = {}  # of the open elements, by tag
    text: list[str] = []
    linked = total = links = silent = 0

    def flush() -> None:
        nonlocal linked, total
        if text:
            whole = " ".join(html_module.unescape("".join(text)).split())
            if whole:
                marks = stack[-1][1] if stack else frozenset()
                tag = next((t for t, _ in reversed(stack) if t not in INLINE), "")
                out.append((whole, marks, tag, linked / max(total, 1)))
            text.clear()
        linked = total = 0

    def pop(depth: int) -> None:
        nonlocal links, silent
        while len(stack) > depth:
            if stack[-1][0] not in INLINE:
                flush()
            tag, _ = stack.pop()
            depths[tag].pop()
            links -= tag == "a"
            silent -= tag in SILENT

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not silent:
                    text.append(piece)
                    size = len(piece.strip())
                    total += size
                    linked += size if links else 0
            continue
        tag = tag.lower()
        if m[1]:
            depth = depths[tag][-1] if depths.get(tag) else None
            if depth is None:
                continue
            if tag in INLINE and any(t not in INLINE for t, _ in stack[depth + 1 :]):
                continue  # a stray end inside another block
            pop(depth)
            continue
        if tag in CLOSES_P:
            if depths.get("p"):
                pop(depths["p"][-1])
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SIBLINGS[tag]:
                    pop(i)
                    break
                if stack[i][0] in SCOPES[tag]:
                    break
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
        named = {f"{k.lower()}={w}" for k, v in NAMED.findall(m[3] or "") for w in WORDS.findall(v.lower())}
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else n
            if tag not in SILENT:
                continue
        if (m[3] or "").endswith("/") and tag not in RAW:
            continue
        above = stack[-1][1] if stack else frozenset()
        own = {f"tag={tag}", *named}
        depths.setdefault(tag, []).append(len(stack))
        stack.append((tag, above if own <= above else above | own))
        links += tag == "a"
        silent += tag in SILENT
    pop(0)
    flush()
    return out


def features(found: list[tuple[str, frozenset[str], str, float]]) -> list[list[str]]:
    rows = []
    for i, (text, marks, tag, linked) in enumerate(found):
        words = text.split()
        row = ["bias", f"in={tag}", f"words={min(len(words).bit_length(), 7)}", f"linked={int(linked * 4)}", f"first={min(i, 3)}", f"last={min(len(found) - 1 - i, 2)}"]
        row += marks
        if text[-1] in ".!?…。:;\"”":
            row.append("ends")
        if "©" in text or "(c)" in text.lower():
            row.append("copyright")
        row.append(f"commas={min(sum(text.count(c) for c in ',.;'), 4)}")
        rows.append(row)
    return rows


class Field:
    """Weights of a two-label linear chain: 1 is main text."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.move = index, move.tolist()
        self.weight = {k: (float(emit[i, 0]), float(emit[i, 1])) for k, i in index.items()}

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the best labels; on ties main text."""
        if not rows:
            return []
        (m00, m01), (m10, m11) = self.move
        back, a, b = [], 0.0, 0.0
        for i, row in enumerate(rows):
            e0 = e1 = 0.0
            for f in row:
                w = self.weight.get(f)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if i:
                to0 = (a + m00, 0) if a + m00 > b + m10 else (b + m10, 1)
                to1 = (a + m01, 0) if a + m01 > b + m11 else (b + m11, 1)
                back.append((to0[1], to1[1]))
                a, b = to0[0] + e0, to1[0] + e1
            else:
                a, b = e0, e1
        label = 0 if a > b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 80, rate: float = 0.15, decay: float = 5e-4) -> Field:
    """Maximise the conditional log-likelihood of labelled sequences by gradient ascent (Adam)."""
    index: dict[str, int] = {}
    data = []
    for rows, labels in pages:
        ids = [[index.setdefault(f, len(index)) for f in row] for row in rows]
        flat = np.array([i for row in ids for i in row])
        owner = np.repeat(np.arange(len(ids)), [len(r) for r in ids])
        data.append((flat, owner, np.array(labels)))
    emit, move = np.zeros((len(index), 2)), np.zeros((2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit, move)]
    for epoch in range(1, epochs + 1):
        grad_e, grad_m = -decay * len(data) * emit, -decay * len(data) * move
        for flat, owner, y in data:
            n = y.size
            score = np.zeros((n, 2))
            np.add.at(score, owner, emit[flat])
            up, down = np.zeros((n, 2)), np.zeros((n, 2))
            up[0] = score[0]
            for i in range(1, n):
                up[i] = score[i] + np.logaddexp(up[i - 1, 0] + move[0], up[i - 1, 1] + move[1])
            for i in range(n - 2, -1, -1):
                nxt = down[i + 1] + score[i + 1]
                down[i] = np.logaddexp(move[:, 0] + nxt[0], move[:, 1] + nxt[1])
            z = np.logaddexp(*up[-1])
            p = np.exp(up + down - z)
            gold = np.zeros((n, 2))
            gold[np.arange(n), y] = 1
            np.add.at(grad_e, flat, (gold - p)[owner])
            if n > 1:
                pair = up[:-1, :, None] + move[None] + (score + down)[1:, None, :] - z
                grad_m -= np.exp(pair).sum(0)
                np.add.at(grad_m, (y[:-1], y[1:]), 1)
        for x, g, (m, v) in zip((emit, move), (grad_e, grad_m), state, strict=True):
            g = g / len(data)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Field(index, emit, move)


#: How made pages frame their main text; ``bare`` has no frame, ``odd`` and ``cell`` frames tell nothing by name.
FAMILIES = ("article", "main", "class", "id", "role", "odd", "cell", "bare")


def labelled_pages(n: int = 600, seed: int = 7, families: tuple[str, ...] = FAMILIES) -> list[tuple[str, list[str]]]:
    """Pages of many layouts, each with its main blocks in page order."""
    rnd = random.Random(seed)
    pick = rnd.choice
    syllables = "ba ko lin dor mes ta ri ven sol pek um ja fi gra tov el nu shi wor ck ly zam ñu öl éa та ни ко".split()

    def word() -> str:
        return "".join(pick(syllables) for _ in range(rnd.randint(1, 4)))

    def sentence(lo: int = 4, hi: int = 18) -> str:
        body = [word() for _ in range(rnd.randint(lo, hi))]
        style = rnd.random()
        if style < 0.1:
            body = [w.upper() + pick(["!!", ""]) for w in body]
        elif style < 0.2:
            body = [w + pick(["***", "###", "$$", "%%%"]) for w in body]
        elif style < 0.25:
            body = [body[0]] * len(body)
        return " ".join(body).capitalize() + pick([".", ".", "!", "?", ""])

    def named(*known: str) -> str:
        """Attributes of a frame of the page's furniture; every third tells nothing."""
        return f' {pick(["class", "id"])}="{pick(known) if rnd.random() < 0.67 else word()}"'

    def menu(tag: str, attributes: str = "") -> str:
        items = "".join(f'<li><a href="/{word()}">{pick([word(), word().capitalize(), word() + ",", word() + "."])}</a></li>' for _ in range(rnd.randint(2, 9)))
        return f"<{tag}{attributes}><ul>{items}</ul></{tag}>"

    def furniture(kind: str) -> str:
        s = pick(["", "\n"]).join(sentence(2, 14) for _ in range(rnd.randint(1, 3)))
        if kind == "advert":
            return f"<div{named('ad', 'ads', 'advert', 'sponsored', 'promo banner')}>{pick([s, f'<a href=#>{s}</a>', f'<p>{s}</p>'])}</div>"
        if kind == "aside":
            return f"<aside{pick(['', named('sidebar')])}><h3>{word()}</h3><p>{s}</p><p><a href=/x>{sentence(2, 6)}</a></p></aside>"
        if kind == "notice":
            return f"<div{named('cookie', 'cookie-notice', 'notice', 'consent', 'gdpr')}><p>{s}</p><button>{word()}</button></div>"
        if kind == "form":
            return f"<form><label>{word()}</label><input name=q><select><option>{word()}<option>{word()}</select><textarea>{word()}</textarea><button>{word()}</button></form>"
        if kind == "share":
            return f"<div{named('share', 'social', 'related', 'breadcrumb', 'tags', 'meta')}><a href=#>{word()}</a> <a href=#>{word()}</a></div>"
        if kind == "comments":
            tag = pick(["section", "div"])
            own = "".join(f"<div{pick([' class=comment', ' class=reply', ''])}><b>{word()}</b><p>{sentence(3, 25)}</p></div>" for _ in range(rnd.randint(1, 4)))
            return f'<{tag} {pick(["class", "id"])}="{pick(["comments", "comment-list", "discussion", "replies"])}"><h2>{word()}</h2>{own}</{tag}>'
        if kind == "fallback":
            return f"<noscript>{sentence(2, 8)}</noscript>"
        return f"<div{named('sidebar', 'widget', 'menu', 'nav', 'header', 'footer')}><p>{s}</p></div>"

    pages = []
    for _ in range(n):
        main: list[str] = []
        body: list[str] = []

        def put(markup: str, *texts: str, main=main, body=body) -> None:
            body.append(markup)
            main.extend(texts)

        title = sentence(2, 9)
        if rnd.random() < 0.85:
            put(f"<h1>{title}</h1>", title)
        for _ in range(pick([0, 1, 1, 2, 3, 5, 9])):
            text = sentence(1, pick([1, 1, 2, 3])) if rnd.random() < 0.3 else " ".join(sentence() for _ in range(pick([1, 1, 2, 4, 8])))
            more, short = sentence(2, 8), word()
            kind = rnd.randrange(14)
            if kind < 6:
                put(f"<p>{text}{pick(['</p>', '</p>', ''])}", text)
            elif kind == 6:
                put(f"<p>{text}<br>{more}</p>", f"{text} {more}")
            elif kind == 7:
                put(f"<p><{(t := pick(['b', 'i', 'em', 'span', 'strong']))}>{text}{pick(['', f'</{t}></p>'])}", text)
            elif kind == 8:
                put(f"<h2>{more}</h2><blockquote>{text}</blockquote>", more, text)
            elif kind == 9:
                put(f"<ul><li>{text}</li><li>{more}</li></ul>", text, more)
            elif kind == 10:
                put(f'<p>{text} <a href="/a">{short}</a> {more}</p>', f"{text} {short} {more}")
            elif kind == 11:
                put(f"<pre>{text}</pre><table><tr><td>{more}<td>{short}</table>", text, more, short)
            elif kind == 12:
                put(f"<p>{text} <math><mi>{short}</mi><mo>=</mo><mn>2</mn></math> {more}</p>", f"{text} {short}=2 {more}")
            else:
                put(f"<figure><img src=x><figcaption>{more}</figcaption></figure><div>{text}</div>", more, text)
            if rnd.random() < 0.15:
                body.append(furniture(pick(["advert", "aside", "share", "form"])))
        inner = "\n".join(body)
        if rnd.random() < 0.25:
            inner += furniture("comments")
        frame = pick(families)
        opened, closed = {
            "article": pick([("<article>", "</article>"), ("<main><article class=post>", "</article></main>")]),
            "main": ("<main>", "</main>"),
            "class": (f'<div class="{pick(["content", "post", "entry", "article body", "story", "text"])}">', "</div>"),
            "id": (f'<div id={pick(["content", "main", "story", "page"])}>', "</div>"),
            "role": ('<div role="main">', "</div>"),
            "odd": (f'<{(t := pick(["div", "section"]))} class="{word()}">', f"</{t}>"),
            "cell": (f"<table><tr><td>{menu('div')}<td>", "</table>"),
            "bare": ("", ""),
        }[frame]
        top = [pick([menu("nav"), menu("header"), menu("div", named("menu", "navigation")), f"<header><p>{sentence(1, 5)}</p></header>" + menu("nav")])]
        top += [furniture(k) for k in ("advert", "notice", "form", "share", "side", "fallback") if rnd.random() < 0.35]
        rnd.shuffle(top)
        low = [furniture(k) for k in ("comments", "aside", "advert", "share", "form", "side") if rnd.random() < 0.3]
        foot = pick([f"<footer>{pick(['&copy;', 'Copyright', '&reg;', ''])} {word()} {sentence(1, 14)}</footer>", f'<div class="footer"><p>&copy; {sentence(2, 9)}</p></div>', menu("footer"), f"<footer><p>{sentence(2, 16)}</p></footer>"])
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>a{{}}</style></head><body>"
        pages.append((head + "\n".join(top) + opened + inner + closed + "".join(low) + foot + "</body></html>", [" ".join(x.split()) for x in main if x.split()]))
    return pages


def labels_of(found: list[tuple[str, frozenset[str], str, float]], main: list[str]) -> list[int]:
    """1 for the blocks that are the known main text: its longest common subsequence with the page's blocks, in order."""
    n, m = len(found), len(main)
    best = np.zeros((n + 1, m + 1), np.int32)
    same = [[b[0] == t for t in main] for b in found]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if same[i][j] else max(best[i + 1, j], best[i, j + 1])
    out, j = [0] * n, 0
    for i in range(n):
        if j < m and same[i][j] and best[i, j] == best[i + 1, j + 1] + 1:
            out[i], j = 1, j + 1
        else:
            while j < m and best[i + 1, j] < best[i, j] and not same[i][j]:
                j += 1
            if j < m and same[i][j]:
                out[i], j = 1, j + 1
    return out


_trained: list[Field] = []


def field_of(pages: list[tuple[str, list[str]]]) -> Field:
    """The field trained on labelled pages."""
    data = []
    for page, main in pages:
        found = blocks(page)
        if found:
            data.append((features(found), labels_of(found, main)))
    return train(data)


def default_field() -> Field:
    if not _trained:
        _trained.append(field_of(labelled_pages()))
    return _trained[0]


def extract(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def main_text(pages: DataFrame, html: str = "html", out: str = "text", field: Field | None = None) -> DataFrame:
    """``pages`` without the html, with its main text as ``out``."""
    small_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(field or default_field())  # some thousand weights
    rest = [c for c in pages.columns if c not in (html, out)]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, model.value) for h in batch["__html"].to_pylist()]
            yield pa.record_batch([*(batch[c] for c in rest), pa.array(texts, pa.string())], [*rest, out])

    return pages.select(*[F.col(f"`{c}`") for c in rest], F.col(html).cast("string").alias("__html")).mapInArrow(run, schema)
