"""Wiki storage format (XHTML with ``ac:`` and ``ri:`` elements): blocks, macros and links."""

from __future__ import annotations

import html.entities
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

from pyspark.sql import DataFrame

from quillgraph.schemas import ELEMENT, LINK_ITEM
from quillgraph.sources.batches import parser

AC, RI = "{urn:ac}", "{urn:ri}"
KINDS = {"p": "paragraph", "table": "table", "pre": "code", "blockquote": "quote", "hr": "hr", "ul": "list", "ol": "list"}
XML_ENTITIES = {"amp", "lt", "gt", "quot", "apos"}
Handler = Callable[[ET.Element], dict | None]


def substitute_entities(text: str) -> str:
    def put(m: re.Match) -> str:
        found = html.entities.html5.get(m[1] + ";")
        return m[0] if m[1] in XML_ENTITIES or found is None else "".join(f"&#{ord(c)};" for c in found)

    return re.sub(r"&([A-Za-z][A-Za-z0-9]*);", put, text)


def parse_tree(text: str) -> ET.Element:
    """The fragment under one root; what is not well-formed is repaired as far as possible."""
    whole = f'<root xmlns:ac="urn:ac" xmlns:ri="urn:ri">{substitute_entities(text)}</root>'
    try:
        return ET.fromstring(whole)
    except ET.ParseError:
        return _recovered(text)


def _recovered(text: str) -> ET.Element:
    from html.parser import HTMLParser

    void = {"br", "hr", "img", "col", "input"}

    class Builder(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = ET.Element("root")
            self.open = [self.root]

        @staticmethod
        def name(tag: str) -> str:
            return tag.replace("ac:", AC, 1) if tag.startswith("ac:") else tag.replace("ri:", RI, 1) if tag.startswith("ri:") else tag

        def handle_starttag(self, tag, attrs):
            if tag == "p" and self.open[-1].tag == "p":
                self.open.pop()
            node = ET.SubElement(self.open[-1], self.name(tag), {self.name(k): v or "" for k, v in attrs})
            if tag not in void:
                self.open.append(node)

        def handle_startendtag(self, tag, attrs):
            ET.SubElement(self.open[-1], self.name(tag), {self.name(k): v or "" for k, v in attrs})

        def handle_endtag(self, tag):
            name = self.name(tag)
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == name:
                    del self.open[i:]
                    break

        def handle_data(self, data):
            node = self.open[-1]
            if len(node):
                node[-1].tail = (node[-1].tail or "") + data
            else:
                node.text = (node.text or "") + data

        def unknown_decl(self, data):
            if data.startswith("CDATA["):
                self.handle_data(data[6:])

    b = Builder()
    b.feed(text)
    b.close()
    return b.root


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def text_of(node: ET.Element) -> str:
    return " ".join(t for t in (x.strip() for x in node.itertext()) if t)


def serialize(node: ET.Element) -> str:
    tail, node.tail = node.tail, None
    out = ET.tostring(node, encoding="unicode")
    node.tail = tail
    return out


def param(node: ET.Element, name: str) -> str | None:
    return next(((x.text or "").strip() for x in node.iter(AC + "parameter") if x.get(AC + "name") == name), None)


def plain_body(node: ET.Element) -> str:
    found = node.find(AC + "plain-text-body")
    return "" if found is None else "".join(found.itertext())


def rich_body(node: ET.Element) -> str:
    found = node.find(AC + "rich-text-body")
    return "" if found is None else " ".join(found.itertext()).strip()


def _element(kind: str, text: str, anchor: str | None = None, level: int | None = None, **meta: str | None) -> dict:
    return {"kind": kind, "text": text, "anchor": anchor, "heading_level": level, "metadata": {k: v for k, v in meta.items() if v is not None}}


def _callout(node: ET.Element) -> dict:
    return _element("callout", rich_body(node), callout_type=node.get(AC + "name"), title=param(node, "title"))


def _include(node: ET.Element) -> dict:
    page = next(node.iter(RI + "page"), None)
    title = page.get(RI + "content-title") if page is not None else (param(node, "") or text_of(node))
    return _element("include_page", "", title=title, space=page.get(RI + "space-key") if page is not None else None)


MACROS: dict[str, Handler] = {
    "code": lambda n: _element("code", plain_body(n), language=param(n, "language")),
    **dict.fromkeys(("info", "warning", "note", "panel", "tip"), _callout),
    "expand": lambda n: _element("expand", rich_body(n), title=param(n, "title")),
    "anchor": lambda n: _element("anchor", "", anchor=param(n, "")),
    "include": _include,
    "excerpt-include": _include,
    "include-page": _include,
    "toc": lambda n: None,
}


def parse_storage(text: str, macros: dict[str, Handler] = MACROS) -> list[dict]:
    """Top-level blocks with their anchors; loose text and comments drop."""
    out: list[dict] = []
    for node in parse_tree(text):
        if not isinstance(node.tag, str):
            continue
        tag = local(node.tag)
        if node.tag == AC + "structured-macro":
            name = node.get(AC + "name") or ""
            handler = macros.get(name)
            item = handler(node) if handler else _element("unknown", rich_body(node) or plain_body(node), macro=name)
        elif re.fullmatch("h[1-6]", tag):
            item = _element("heading", text_of(node), anchor=node.get("id"), level=int(tag[1]))
        elif tag in KINDS:
            item = _element(KINDS[tag], text_of(node), **({"list_kind": tag} if tag in ("ul", "ol") else {}))
        else:
            item = _element("unknown", text_of(node), tag=tag)
        if item is not None:
            out.append(item | {"raw": serialize(node)})
    return _merge_anchors(out)


def _merge_anchors(items: list[dict]) -> list[dict]:
    """An anchor macro names the next element that has no anchor; the last of several wins; trailing ones stay."""
    out, pending = [], None
    for item in items:
        if item["kind"] == "anchor":
            pending = item
            continue
        if pending is not None:
            item = item if item["anchor"] else item | {"anchor": pending["anchor"]}
            pending = None
        out.append(item)
    if pending is not None:
        out.append(pending)
    return [x | {"seq": i} for i, x in enumerate(out)]


def _label(node: ET.Element) -> str:
    for name in ("plain-text-link-body", "link-body"):
        found = node.find(AC + name)
        if found is not None and text_of(found):
            return text_of(found)
    return ""


def storage_links(raw: str, default_space: str | None = None) -> list[dict]:
    """Links of a section in document order; none from inside macros, no <a> inside ac:link."""
    out: list[dict] = []

    def add(kind: str, resolved: bool, anchor: str | None = None, **meta: str | None) -> None:
        out.append({"seq": len(out), "kind": kind, "target_anchor": anchor, "resolved": resolved, "metadata": {k: v for k, v in meta.items() if v}})

    def walk(node: ET.Element, inside: bool) -> None:
        if not isinstance(node.tag, str):
            return
        if node.tag == AC + "structured-macro":
            name = node.get(AC + "name") or ""
            if name == "jira" and param(node, "key"):
                add("jira", True, key=param(node, "key"), server=param(node, "server"))
            elif name in ("include", "include-page", "excerpt-include"):
                made = _include(node)["metadata"]
                if made.get("title"):
                    has_page = next(node.iter(RI + "page"), None) is not None
                    add("include", False, title=made["title"], space=made.get("space") or (default_space if has_page else None))
            inside = True
        elif node.tag == AC + "link":
            if not inside:
                page, file, user = node.find(RI + "page"), node.find(RI + "attachment"), node.find(RI + "user")
                if file is not None:
                    own = file.find(RI + "page")
                    add("attachment", False, title=own.get(RI + "content-title") if own is not None else None, space=(own.get(RI + "space-key") if own is not None else None) or default_space, filename=file.get(RI + "filename"), label=_label(node))
                elif user is not None:
                    add("user", True, user=user.get(RI + "account-id") or user.get(RI + "userkey"), label=_label(node))
                elif page is not None:
                    add("page", False, node.get(AC + "anchor"), title=page.get(RI + "content-title"), space=page.get(RI + "space-key") or default_space, label=_label(node))
            inside = True
        elif local(node.tag) == "a" and not inside and node.get("href"):
            add("external", True, href=node.get("href"), label=(node.text or "").strip())
        for child in node:
            walk(child, inside)

    for node in parse_tree(raw):
        walk(node, False)
    return out


def page_sections(body: str | None, space: str | None) -> list[dict]:
    return parse_storage(body or "")


def page_links(body: str | None, space: str | None) -> list[dict]:
    return [{"section_seq": s["seq"], **x} for s in parse_storage(body or "") for x in storage_links(s["raw"], space)]


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages``: body, space and others; adds ``sections`` and ``links``, each by a function of its own."""
    return pages.withColumns({"sections": parser(page_sections, f"array<{ELEMENT}>")("body", "space"), "links": parser(page_links, f"array<{LINK_ITEM}>")("body", "space")})
