"""YAML: block mappings and sequences, flow collections, plain, quoted and block scalars."""

from __future__ import annotations

import re

from .tree import Syn, error, fitted, settled, token

COMMENT = re.compile(r"(?:(?<=\s)|^)#[^\n]*", re.M)
KEY = re.compile(r"(?:\"(?:\\.|[^\"\\\n])*\"|'(?:''|[^'\n])*'|[^\s#\-\[\]{},\"'|>&*!%@`][^\n]*?|-[^\s][^\n]*?)(?=\s*:(?:[ \t\n]|\Z))")
#: Plain scalars by their kind (fixed values of the core schema).
KINDS = [(re.compile(p), k) for p, k in ((r"(?:true|True|TRUE|false|False|FALSE)\Z", "boolean_scalar"), (r"(?:null|Null|NULL|~)\Z", "null_scalar"), (r"[-+]?(?:0|[1-9][0-9]*|0o[0-7]+|0x[0-9a-fA-F]+)\Z", "integer_scalar"), (r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\Z|[-+]?\.(?:inf|Inf|INF)\Z|\.(?:nan|NaN|NAN)\Z", "float_scalar"), (r"\d{4}-\d\d?-\d\d?(?:[Tt ].*)?\Z", "timestamp_scalar"))]


class _Yaml:
    def __init__(self, source: str):
        self.src = source
        self.lines: list[tuple[int, int, int]] = []  # indent, first content character, end without comment
        self.comments: list[Syn] = []
        at = 0
        for line in source.split("\n"):
            cut = self._without_comment(line, at)
            body = line[:cut].rstrip()
            if body.strip():
                self.lines.append((len(body) - len(body.lstrip(" ")), at + len(body) - len(body.lstrip()), at + len(body)))
            at += len(line) + 1

    def _without_comment(self, line: str, at: int) -> int:
        if "#" not in line:
            return len(line)
        quote = ""
        for i, c in enumerate(line):
            if quote:
                if c == quote and not (quote == '"' and line[i - 1] == "\\"):
                    quote = ""
            elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:"):
                quote = c
            elif c == "#" and (i == 0 or line[i - 1] in " \t"):
                self.comments.append(Syn("comment", at + i, at + len(line.rstrip()), extra=True))
                return i
        return len(line)

    def stream(self) -> Syn:
        root = Syn("stream", 0, len(self.src))
        i = 0
        while i < len(self.lines):
            doc = Syn("document", 0, 0)
            if self.src.startswith("---", self.lines[i][1]):
                doc.add(token("---", self.lines[i][1]))
                i += 1
            start = i
            while i < len(self.lines) and not re.match(r"(?:---|\.\.\.)(?:\s|\Z)", self.src[self.lines[i][1] : self.lines[i][2]]):
                i += 1
            at = start
            while at < i:
                node, at = self.block(at, i, self.lines[at][0])
                doc.add(node)
            if i < len(self.lines) and self.src.startswith("...", self.lines[i][1]):
                doc.add(token("...", self.lines[i][1]))
                i += 1
            root.add(fitted(doc))
        self._place(root)
        return settled(fitted(root)) if root.kids else root

    def _place(self, root: Syn) -> None:
        """Comments go to the smallest node around them."""
        inside = {n.start for n in root.walk() if n.kind == "block_scalar"}
        for c in self.comments:
            at = root
            while (deeper := next((k for k in at.kids if k.start <= c.start and c.end <= k.end and k.named and k.kids), None)) is not None:
                at = deeper
            if any(n.kind == "block_scalar" and n.start <= c.start < n.end for n in at.kids) or at.start in inside and at.kind == "block_scalar":
                continue
            at.kids.append(c)
            at.kids.sort(key=lambda k: (k.start, k.end))

    def block(self, i: int, end: int, indent: int) -> tuple[Syn, int]:
        _, at, stop = self.lines[i]
        text = self.src[at:stop]
        if text == "-" or text.startswith("- "):
            return self.sequence(i, end, indent)
        if KEY.match(self.src, at, stop + 1) and self._colon(at, stop) is not None:
            return self.mapping(i, end, indent)
        return self.scalar(at, stop, i, end, indent)

    def _colon(self, at: int, stop: int) -> int | None:
        m = KEY.match(self.src, at, min(len(self.src), stop + 1))
        if m is None or m.end() > stop:
            return None
        return self.src.index(":", m.end()) if ":" in self.src[m.end() : stop + 1] else None

    def sequence(self, i: int, end: int, indent: int) -> tuple[Syn, int]:
        seq = Syn("block_sequence", 0, 0)
        while i < end and self.lines[i][0] == indent and (text := self.src[self.lines[i][1] : self.lines[i][2]]).startswith("-") and (text == "-" or text[1] in " \t"):
            _, at, stop = self.lines[i]
            item = Syn("block_sequence_item", at, stop).add(token("-", at))
            inner = at + 1 + len(text[1:]) - len(text[1:].lstrip()) if text.strip("- \t") or len(text) > 1 else stop
            if inner < stop:
                self.lines[i] = (indent + inner - at, inner, stop)
                node, i = self.block(i, end, indent + inner - at)
                item.add(node)
            else:
                i += 1
                if i < end and self.lines[i][0] > indent:
                    node, i = self.block(i, end, self.lines[i][0])
                    item.add(node)
            seq.add(fitted(item))
        return fitted(Syn("block_node", 0, 0).add(fitted(seq))), i

    def mapping(self, i: int, end: int, indent: int) -> tuple[Syn, int]:
        mapping = Syn("block_mapping", 0, 0)
        while i < end and self.lines[i][0] == indent:
            _, at, stop = self.lines[i]
            colon = self._colon(at, stop)
            if colon is None:
                if self.src[at:stop].startswith("-"):
                    break
                mapping.add(error(at, stop))
                i += 1
                continue
            key = self.flow(at, colon)
            key.field = "key"
            pair = Syn("block_mapping_pair", at, stop).add(key, token(":", colon))
            inner = colon + 1
            while inner < stop and self.src[inner] in " \t":
                inner += 1
            value = None
            if inner < stop:
                value, i = self.scalar(inner, stop, i, end, indent)
            else:
                i += 1
                if i < end and (self.lines[i][0] > indent or self.lines[i][0] == indent and re.match(r"-(?:\s|\Z)", self.src[self.lines[i][1] : self.lines[i][2]])):
                    value, i = self.block(i, end, self.lines[i][0])
            if value is not None:
                value.field = "value"
                pair.add(value)
            mapping.add(fitted(pair))
        return fitted(Syn("block_node", 0, 0).add(fitted(mapping))), i

    def scalar(self, at: int, stop: int, i: int, end: int, indent: int) -> tuple[Syn, int]:
        text = self.src[at:stop]
        if re.match(r"[|>][0-9+-]*\Z", text):
            j = i + 1
            while j < end and self.lines[j][0] > indent:
                j += 1
            last = self.lines[j - 1][2]
            return Syn("block_node", at, last).add(Syn("block_scalar", at, last)), j
        if text[0] in "[{" or text[0] in "\"'" and not self._closed(text):
            depth, j = text, i
            while not self._closed(depth) and j + 1 < end:
                j += 1
                depth = self.src[at : self.lines[j][2]]
            return self.flow(at, self.lines[j][2] if j > i else stop), j + 1
        j = i + 1
        while j < end and self.lines[j][0] > indent and text[0] not in "\"'[{" and self._colon(self.lines[j][1], self.lines[j][2]) is None:
            j += 1
        return self.flow(at, self.lines[j - 1][2] if j > i + 1 else stop), j

    def _closed(self, text: str) -> bool:
        if text[0] in "\"'":
            return re.match(r"\"(?:\\.|[^\"\\])*\"\Z|'(?:''|[^'])*'\Z", text, re.S) is not None
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'", "", text)
        return bare.count("[") + bare.count("{") <= bare.count("]") + bare.count("}")

    def flow(self, at: int, stop: int) -> Syn:
        while stop > at and self.src[stop - 1] in " \t\r\n":
            stop -= 1
        text = self.src[at:stop]
        node = Syn("flow_node", at, stop)
        lead = re.match(r"(?:([&!])[^\s,\[\]{}]*\s*)+", text)
        if lead:
            for m in re.finditer(r"([&!])[^\s,\[\]{}]*", lead[0]):
                node.add(Syn("anchor" if m[1] == "&" else "tag", at + m.start(), at + m.end()))
            at += lead.end()
            text = text[lead.end() :]
        if not text:
            return node
        if text[0] in "[{":
            inner, stop_at = self.collection(at, stop)
            node.add(inner)
            if stop_at < stop:
                node.add(error(stop_at, stop))
        elif text[0] in "\"'":
            node.add(Syn("double_quote_scalar" if text[0] == '"' else "single_quote_scalar", at, stop))
        elif text[0] == "*":
            node.add(Syn("alias", at, stop))
        else:
            kind = next((k for p, k in KINDS if p.match(text)), "string_scalar")
            node.add(Syn("plain_scalar", at, stop).add(Syn(kind, at, stop)))
        return node

    def collection(self, at: int, stop: int) -> tuple[Syn, int]:
        close = "]" if self.src[at] == "[" else "}"
        node = Syn("flow_sequence" if close == "]" else "flow_mapping", at, stop).add(token(self.src[at], at))
        item = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'|[^,\[\]{}:\n]+(?::(?=[^\s,\[\]{}])[^,\[\]{}:\n]*)*", re.S)
        at += 1
        while at < stop:
            c = self.src[at]
            if c in " \t\r\n":
                at += 1
            elif c == close:
                node.end = at + 1
                return node.add(token(close, at)), at + 1
            elif c == ",":
                node.add(token(",", at))
                at += 1
            else:
                first, at = self._flow_item(item, at, stop)
                after = at
                while after < stop and self.src[after] in " \t\r\n":
                    after += 1
                if after < stop and self.src[after] == ":":
                    first.field = "key"
                    pair = Syn("flow_pair", first.start, after + 1).add(first, token(":", after))
                    at = after + 1
                    while at < stop and self.src[at] in " \t\r\n":
                        at += 1
                    if at < stop and self.src[at] not in ",]}":
                        value, at = self._flow_item(item, at, stop)
                        value.field = "value"
                        pair.add(value)
                    node.add(fitted(pair))
                else:
                    node.add(first)
        node.end = stop
        return node.add(Syn(close, stop, stop, named=False, missing=True)), stop

    def _flow_item(self, item: re.Pattern, at: int, stop: int) -> tuple[Syn, int]:
        if self.src[at] in "[{":
            inner, end = self.collection(at, stop)
            return Syn("flow_node", inner.start, end).add(inner), end
        m = item.match(self.src, at, stop)
        if m is None:
            return error(at, at + 1), at + 1
        return self.flow(at, m.end()), m.end()


def parse(source: str) -> Syn:
    return _Yaml(source).stream()
