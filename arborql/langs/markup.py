"""HTML and XML."""

from __future__ import annotations

import re

from .tree import Syn, error, fitted, token

#: Elements without an end, and what an open paragraph or item can't hold (fixed values of the language).
VOID = set("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source track wbr".split())
RAW = {"script": "script_element", "style": "style_element"}
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "colgroup": {"colgroup"}, "rb": {"rb", "rt", "rp"}, "rt": {"rb", "rt", "rp"}, "rp": {"rb", "rt", "rp"}}
SCOPES = {"ul", "ol", "dl", "table", "select"}
ATTRIBUTE = re.compile(r"\s*([^\s=/>\"'<]+)(?:(\s*)(=)\s*(?:(\")([^\"]*)(\")|(')([^']*)(')|([^\s\"'=<>`]+)))?")
TEXT = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{0,30});?|[^<>&]+|[<>&]")


def _attributes(source: str, at: int, tag: Syn) -> int:
    while (m := ATTRIBUTE.match(source, at)) and m[1]:
        if source[m.start(1) : m.end(1)] == "/":
            break
        node = Syn("attribute", m.start(1), m.end()).add(Syn("attribute_name", m.start(1), m.end(1)))
        if m[3]:
            node.add(token("=", m.start(3)))
            for quote, inner, close in ((4, 5, 6), (7, 8, 9)):
                if m[quote]:
                    value = Syn("quoted_attribute_value", m.start(quote), m.end(close)).add(token(m[quote], m.start(quote)))
                    if m[inner]:
                        value.add(Syn("attribute_value", m.start(inner), m.end(inner)))
                    node.add(value.add(token(m[close], m.start(close))))
            if m[10]:
                node.add(Syn("attribute_value", m.start(10), m.end(10)))
        tag.add(node)
        at = m.end()
    return at


def _text(source: str, start: int, end: int, into: Syn) -> None:
    for m in TEXT.finditer(source, start, end):
        piece = m[0]
        if piece[0] == "&" and len(piece) > 1:
            into.add(Syn("entity", m.start(), m.end()))
        elif piece in "<>&":
            into.add(error(m.start(), m.end()))
        elif stripped := piece.strip():
            at = m.start() + piece.index(stripped[0])
            into.add(Syn("text", at, at + len(stripped)))


def parse_html(source: str) -> Syn:
    root = Syn("document", 0, len(source))
    stack: list[tuple[Syn, str]] = [(root, "")]
    mark = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|</\s*([a-zA-Z][^\s/>]*)\s*(?:>|\Z)|<([a-zA-Z][^\s/>]*)", re.S)

    def pop(at: int) -> None:
        node, _ = stack.pop()
        fitted(node)

    at = 0
    while at < len(source):
        m = mark.search(source, at)
        _text(source, at, m.start() if m else len(source), stack[-1][0])
        if m is None:
            break
        at = m.end()
        if m[0].startswith("<!--"):
            stack[-1][0].add(Syn("comment", m.start(), at, extra=True))
        elif m[0].startswith("<!"):
            stack[-1][0].add(Syn("doctype", m.start(), at).add(token("<!", m.start()), token("doctype", m.start() + 2, min(at, m.start() + 9)), token(">", at - 1)))
        elif m[1]:
            name = m[1].lower()
            end = Syn("end_tag", m.start(), at).add(token("</", m.start()), Syn("tag_name", m.start(1), m.end(1)), token(">", at - 1, at))
            if any(n == name for _, n in stack[1:]):
                while stack[-1][1] != name:
                    pop(m.start())
                stack[-1][0].add(end)
                pop(at)
            else:
                end.kind = "erroneous_end_tag"
                end.kids[1].kind = "erroneous_end_tag_name"
                stack[-1][0].add(end)
        else:
            name = m[2].lower()
            if name in ENDS_P and any(n == "p" for _, n in stack):
                depth = max(i for i, (_, n) in enumerate(stack) if n == "p")
                if not any(n in ENDS_P - {"p"} for _, n in stack[depth + 1 :]):
                    while len(stack) > depth:
                        pop(m.start())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] in SCOPES:
                    break
                if stack[i][1] in ENDS.get(name, ()):
                    while len(stack) > i:
                        pop(m.start())
            start = Syn("start_tag", m.start(), at).add(token("<", m.start()), Syn("tag_name", m.start(2), m.end(2)))
            at = _attributes(source, at, start)
            close = re.compile(r"\s*(/?>)").match(source, at)
            if close is None:
                skip = source.find(">", at)
                skip = len(source) if skip < 0 else skip
                if source[at:skip].strip():
                    start.add(error(at, skip))
                close = re.compile(r"(/?>|\Z)").match(source, skip)
            at = close.end()
            closed = close[1] == "/>"
            if close[1]:
                start.add(token(close[1], close.start(1)))
            else:
                start.add(Syn(">", at, at, named=False, missing=True))
            start.end = at
            if closed:
                start.kind = "self_closing_tag"
            element = Syn(RAW.get(name, "element") if not closed else "element", start.start, at).add(start)
            stack[-1][0].add(element)
            if name in RAW and not closed:
                end = re.compile(rf"</\s*{name}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else len(source)
                if stop > at:
                    element.add(Syn("raw_text", at, stop))
                at = stop
                stack.append((element, name))
            elif name not in VOID and not closed:
                stack.append((element, name))
    while len(stack) > 1:
        pop(len(source))
    if root.kids:
        fitted(root)
    return root


NAME = r"[^\s<>/=\"'&;]+"
XML = re.compile(rf"(?P<comment><!--.*?-->)|(?P<cdata><!\[CDATA\[(?P<inner>.*?)\]\]>)|(?P<decl><\?xml\b.*?\?>)|(?P<pi><\?.*?\?>)|(?P<doctype><!DOCTYPE(?:[^\[>]|\[.*?\])*>)|</(?P<end>{NAME})\s*>|<(?P<open>{NAME})|(?P<ref>&(?:#\d+|#x[0-9a-fA-F]+|{NAME});)|(?P<text>[^<&]+)|(?P<bad>[<&])", re.S)
XML_ATTRIBUTE = re.compile(rf"\s+({NAME})\s*(=)\s*(?:(\")([^\"<]*)(\")|(')([^'<]*)('))")


def parse_xml(source: str) -> Syn:
    root = Syn("document", 0, len(source))
    prolog = Syn("prolog", 0, 0)
    stack: list[tuple[Syn, Syn, str]] = [(root, root, "")]  # element, where its content goes, name
    at = 0

    def content() -> Syn:
        element, inside, _ = stack[-1]
        if len(stack) > 1 and inside is element:
            inside = Syn("content", at, at)
            element.add(inside)
            stack[-1] = (element, inside, stack[-1][2])
        return inside

    def put(node: Syn) -> None:
        if len(stack) == 1 and not any(k.kind == "element" for k in root.kids) and node.kind in ("XMLDecl", "Comment", "doctypedecl", "PI"):
            if not prolog.kids:
                root.kids.insert(0, prolog)
            prolog.add(node)
            fitted(prolog)
        else:
            content().add(node)

    def pop(end: Syn | None) -> None:
        element, inside, _ = stack.pop()
        if inside is not element:
            fitted(inside)
        if end is not None:
            element.add(end)
        else:
            element.add(Syn("ETag", element.kids[-1].end, element.kids[-1].end, missing=True))
        fitted(element)

    while at < len(source):
        m = XML.match(source, at)
        start, at, kind = m.start(), m.end(), m.lastgroup
        if m["text"] is not None:
            if len(stack) > 1:
                content().add(Syn("CharData", start, at))
            elif m["text"].strip("\ufeff \t\r\n"):
                root.add(error(start, at))
        elif kind == "comment":
            put(Syn("Comment", start, at, extra=True))
        elif m["cdata"] is not None:
            content().add(Syn("CDSect", start, at).add(Syn("CDStart", start, start + 9), Syn("CData", start + 9, at - 3), token("]]>", at - 3)))
        elif kind == "decl":
            put(Syn("XMLDecl", start, at))
        elif kind == "pi":
            put(Syn("PI", start, at))
        elif kind == "doctype":
            put(Syn("doctypedecl", start, at))
        elif kind == "ref":
            content().add(Syn("Reference", start, at) if len(stack) > 1 else error(start, at))
        elif kind == "bad":
            content().add(error(start, at))
        elif m["end"] is not None:
            end = Syn("ETag", start, at).add(token("</", start), Syn("Name", m.start("end"), m.end("end")), token(">", at - 1))
            if any(n == m["end"] for _, _, n in stack[1:]):
                while stack[-1][2] != m["end"]:
                    pop(None)
                pop(end)
            else:
                content().add(Syn("ERROR", start, at, kids=[end]))
        else:
            tag = Syn("STag", start, at).add(token("<", start), Syn("Name", m.start("open"), m.end("open")))
            while a := XML_ATTRIBUTE.match(source, at):
                quote = 3 if a[3] else 6
                value = Syn("AttValue", a.start(quote), a.end(quote + 2)).add(token(a[quote], a.start(quote)), token(a[quote], a.start(quote + 2)))
                tag.add(Syn("Attribute", a.start(1), a.end()).add(Syn("Name", a.start(1), a.end(1)), token("=", a.start(2)), value))
                at = a.end()
            close = re.compile(r"\s*(/?>)").match(source, at)
            if close is None:
                skip = source.find(">", at)
                skip = len(source) if skip < 0 else skip
                tag.add(error(at, skip))
                close = re.compile(r"(/?>|\Z)").match(source, skip)
            at = close.end()
            if close[1]:
                tag.add(token(close[1], close.start(1)))
            tag.end = at
            element = Syn("element", start, at).add(tag)
            if len(stack) == 1 and any(k.kind == "element" for k in root.kids):
                root.add(Syn("ERROR", start, at, kids=[element]))
            else:
                (content() if len(stack) > 1 else root).add(element)
            if close[1] == "/>":
                tag.kind = "EmptyElemTag"
            else:
                stack.append((element, element, m["open"]))
    while len(stack) > 1:
        pop(None)
    if root.kids:
        fitted(root)
    return root
