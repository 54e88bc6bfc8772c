"""CSS, and SCSS with nesting, variables and line comments."""

from __future__ import annotations

import re

from .tree import Syn, error, fitted, settled, token

LEX = re.compile(
    r"(?P<space>\s+)|(?P<comment>/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<important>!\s*important\b)|(?P<color>\#[0-9a-fA-F]{3,8}\b)"
    r"|(?P<number>[+-]?(?:\d*\.\d+|\d+)(?:[eE][+-]?\d+)?)(?P<unit>%|[a-zA-Z]+)?|(?P<at>@[\w-]+)|(?P<variable>\$[\w-]+)|(?P<word>--[\w-]+|-?[A-Za-z_\u0080-\uffff][\w\u0080-\uffff-]*)|(?P<sign>::|[{}()\[\];:,.#>+~*&=|^$/%<-]|.)",
    re.S,
)
SIMPLE = {".": ("class_selector", "class_name"), "#": ("id_selector", "id_name"), ":": ("pseudo_class_selector", "class_name"), "::": ("pseudo_element_selector", "tag_name")}
COMBINATORS = {">": "child_selector", "~": "sibling_selector", "+": "adjacent_sibling_selector"}
STATEMENTS = {"@media": "media_statement", "@import": "import_statement", "@charset": "charset_statement", "@namespace": "namespace_statement", "@supports": "supports_statement", "@keyframes": "keyframes_statement", "@include": "include_statement", "@mixin": "mixin_statement", "@extend": "extend_statement", "@use": "use_statement", "@return": "return_statement", "@if": "if_statement", "@each": "each_statement", "@for": "for_statement", "@function": "function_statement"}


class _Css:
    def __init__(self, source: str, scss: bool):
        lex = re.compile(r"(?P<line>//[^\n]*)|" + LEX.pattern, re.S) if scss else LEX
        self.src, self.scss = source, scss
        self.tokens, self.comments = [], []
        for m in lex.finditer(source):
            if m.lastgroup == "space":
                continue
            if m["comment"] or scss and m["line"]:
                self.comments.append(Syn("comment" if m["comment"] else "js_comment", m.start(), m.end(), extra=True))
                continue
            kind = next(k for k in ("string", "important", "color", "number", "at", "variable", "word", "sign") if m[k] is not None)
            self.tokens.append((kind, m[0], m.start(), m.end(), m))
        self.i = 0

    def text(self, ahead: int = 0) -> str:
        return self.tokens[self.i + ahead][1] if self.i + ahead < len(self.tokens) else ""

    def sign(self) -> Syn:
        _, text, a, b, _ = self.tokens[self.i]
        self.i += 1
        return token(text, a, b)

    def sheet(self) -> Syn:
        root = Syn("stylesheet", 0, len(self.src))
        while self.i < len(self.tokens):
            before = self.i
            root.add(*self.item(True))
            if self.i == before:
                _, _, a, b, _ = self.tokens[self.i]
                root.add(error(a, b))
                self.i += 1
        for c in self.comments:
            at = root
            while (deeper := next((k for k in at.kids if k.named and k.kids and k.start <= c.start and c.end <= k.end), None)) is not None:
                at = deeper
            at.kids.append(c)
            at.kids.sort(key=lambda k: (k.start, k.end))
        return settled(fitted(root)) if root.kids else root

    def ends(self) -> tuple[int, str]:
        """Where the current item ends: at a block, a semicolon or the end of its block."""
        depth, j = 0, self.i
        while j < len(self.tokens):
            text = self.tokens[j][1]
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(text, 0)
            if depth <= 0 and text in "{;}" and self.tokens[j][0] == "sign":
                return j, text
            j += 1
        return j, ""

    def item(self, top: bool) -> list[Syn]:
        kind, text, a, b, _ = self.tokens[self.i]
        if text == ";":
            return [self.sign()]
        if kind == "at":
            return [self.statement()]
        end, how = self.ends()
        colon = self.text(1) == ":" or kind == "variable"
        if colon and how != "{" and (not top or self.scss or how == "" or True):
            return [self.declaration(end, how)]
        if how == "{":
            rule = Syn("rule_set", a, b).add(self.selectors(end))
            self.i = end
            return [fitted(rule.add(self.block()))]
        self.i = end + (how == ";")
        return [error(a, max(b, self.tokens[self.i - 1][3]))]

    def statement(self) -> Syn:
        _, text, a, b, _ = self.tokens[self.i]
        node = Syn(STATEMENTS.get(text, "at_rule"), a, b)
        known = text in STATEMENTS
        node.add(token(text, a, b) if known else Syn("at_keyword", a, b))
        self.i += 1
        end, how = self.ends()
        while self.i < end:
            node.add(self.value())
        if how == "{":
            node.add(self.block())
        elif how == ";":
            node.add(self.sign())
        return fitted(node)

    def block(self) -> Syn:
        node = Syn("block", 0, 0).add(self.sign())
        while self.i < len(self.tokens) and self.text() != "}":
            before = self.i
            node.add(*self.item(False))
            if self.i == before:
                _, _, a, b, _ = self.tokens[self.i]
                node.add(error(a, b))
                self.i += 1
        if self.i < len(self.tokens):
            node.add(self.sign())
        else:
            node.add(Syn("}", len(self.src), len(self.src), named=False, missing=True))
        return fitted(node)

    def declaration(self, end: int, how: str) -> Syn:
        kind, _, a, b, _ = self.tokens[self.i]
        self.i += 1
        node = Syn("declaration", a, b).add(Syn("variable_name" if kind == "variable" else "property_name", a, b))
        if self.text() != ":" or kind not in ("word", "variable"):
            self.i = end + (how == ";")
            return error(a, max(b, self.tokens[self.i - 1][3]))
        node.add(self.sign())
        if self.i >= end:
            node.add(error(node.kids[-1].end, node.kids[-1].end))
        while self.i < end:
            node.add(self.value())
        if how == ";":
            node.add(self.sign())
        return fitted(node)

    def value(self) -> Syn:
        kind, text, a, b, m = self.tokens[self.i]
        self.i += 1
        if kind == "string":
            return Syn("string_value", a, b).add(token(text[0], a), token(text[0], b - 1))
        if kind == "important":
            return Syn("important", a, b)
        if kind == "color":
            return Syn("color_value", a, b).add(token("#", a))
        if kind == "number":
            node = Syn("float_value" if "." in m["number"] or "e" in m["number"].lower() else "integer_value", a, b)
            return node.add(Syn("unit", m.start("unit"), b)) if m["unit"] else node
        if kind == "variable":
            return Syn("variable_value" if self.scss else "ERROR", a, b)
        if kind == "word" and self.text() == "(" and self.tokens[self.i][2] == b:
            args = Syn("arguments", 0, 0)
            node = Syn("call_expression", a, b).add(Syn("function_name", a, b))
            args.add(self.sign())
            while self.i < len(self.tokens) and self.text() != ")":
                args.add(self.value())
            if self.i < len(self.tokens):
                args.add(self.sign())
            return fitted(node.add(fitted(args)))
        if kind == "word":
            return Syn("plain_value", a, b)
        if text == "(":
            node = Syn("parenthesized_value", a, b).add(token("(", a))
            while self.i < len(self.tokens) and self.text() != ")":
                node.add(self.value())
            if self.i < len(self.tokens):
                node.add(self.sign())
            return fitted(node)
        return token(text, a, b)

    def selectors(self, end: int) -> Syn:
        node = Syn("selectors", 0, 0)
        while self.i < end:
            if self.text() == ",":
                node.add(self.sign())
            else:
                node.add(self.selector(end))
        return fitted(node)

    def selector(self, end: int) -> Syn:
        left: Syn | None = None
        while self.i < end and self.text() != ",":
            _, text, a, b, _ = self.tokens[self.i]
            spaced = left is not None and left.end < a
            if text in COMBINATORS:
                sign = self.sign()
                right = self.compound(end, None) if self.i < end else error(b, b)
                left = fitted(Syn(COMBINATORS[text], 0, 0).add(*([left] if left else []), sign, right))
            elif spaced:
                left = fitted(Syn("descendant_selector", 0, 0).add(left, self.compound(end, None)))
            else:
                before = self.i
                left = self.compound(end, left)
                if self.i == before:  # what fits no selector
                    left = fitted(Syn("ERROR", a, b).add(*([left] if left else []), self.value()))
        return left

    def compound(self, end: int, left: Syn | None) -> Syn:
        while self.i < end:
            kind, text, a, b, m = self.tokens[self.i]
            if left is not None and left.end < a:
                break
            if kind == "color" or text == "#" and self.i + 1 < end:
                sign = token("#", a)
                name_end = b if kind == "color" else self.tokens[self.i + 1][3]
                self.i += 1 if kind == "color" else 2
                left = fitted(Syn("id_selector", 0, 0).add(*([left] if left else []), sign, Syn("id_name", a + 1, name_end)))
            elif text in SIMPLE and self.i + 1 < end:
                outer, inner = SIMPLE[text]
                sign = self.sign()
                _, _, c, d, _ = self.tokens[self.i]
                self.i += 1
                name = Syn(inner, c, d).add(Syn("identifier", c, d)) if inner == "class_name" and text == "." else Syn(inner, c, d)
                left = Syn(outer, a, d).add(*([left] if left else []), sign, name)
                if self.text() == "(" and self.i < end and self.tokens[self.i][2] == d:
                    args = Syn("arguments", 0, 0).add(self.sign())
                    while self.i < end and self.text() != ")":
                        args.add(self.value())
                    if self.i < end:
                        args.add(self.sign())
                    left.add(fitted(args))
                left = fitted(left)
            elif text == "[":
                node = Syn("attribute_selector", a, b).add(*([left] if left else []), self.sign())
                while self.i < end and self.text() != "]":
                    k, _, c, d, _ = self.tokens[self.i]
                    node.add(Syn("attribute_name", c, d) if k == "word" and node.kids[-1].kind == "[" else self._bump())
                    if node.kids[-1].kind == "attribute_name":
                        self.i += 1
                if self.i < end:
                    node.add(self.sign())
                left = fitted(node)
            elif left is not None:
                break
            elif kind == "word":
                left = Syn("tag_name", a, b)
                self.i += 1
            elif text == "*":
                left = Syn("universal_selector", a, b)
                self.i += 1
            elif text == "&":
                left = Syn("nesting_selector", a, b)
                self.i += 1
            elif kind == "number":
                left = Syn("integer_value", a, b)
                self.i += 1
            else:
                left = error(a, b)
                self.i += 1
        return left

    def _bump(self) -> Syn:
        return self.value()


def parse(source: str) -> Syn:
    return _Css(source, False).sheet()


def parse_scss(source: str) -> Syn:
    return _Css(source, True).sheet()
