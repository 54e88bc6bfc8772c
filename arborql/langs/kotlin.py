"""Kotlin: statements may stand at the top of a file, as in scripts; a line's end ends a statement where it can."""

from __future__ import annotations

import re

from .code import Broken, Parser, Token, named, with_comments
from .tree import Syn

LEX = re.compile(
    r"(?P<space>[ \t\r\f﻿;]*\n[\s;]*|[ \t\r\f﻿]+)|(?P<line_comment>//[^\n]*|\A#![^\n]*)|(?P<block_comment>/\*.*?(?:\*/|\Z))|(?P<quote>\"\"\"|\")|(?P<char>'(?:\\u[\da-fA-F]{4}|\\.|[^'\\\n])')|"
    r"(?P<label>[^\W\d]\w*@(?!\w))|(?P<at>@(?:[^\W\d]\w*:)?(?=[\w\[]))|(?P<name>`[^`\n]+`|[^\W\d]\w*)|(?P<hex>0[xX][\da-fA-F_]+[uUL]*)|(?P<bin>0[bB][01_]+[uUL]*)|"
    r"(?P<real>(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fF]?|\d[\d_]*[eE][+-]?\d+[fF]?|\d[\d_]*[fF])|(?P<integer>\d[\d_]*[uUL]*)|"
    r"(?P<sign>===|!==|\.\.<|\.\.\.|->|\?:|\?\.|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|!!|\.\.|!in\b|!is\b|[-+*/%!<>=?:;,.@#&(){}\[\]])|(?P<bad>.)",
    re.S,
)
KEYWORDS = frozenset("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while".split())
MODIFIERS = {
    **dict.fromkeys("public private internal protected".split(), "visibility_modifier"), **dict.fromkeys("enum sealed annotation data inner value".split(), "class_modifier"), **dict.fromkeys("override lateinit".split(), "member_modifier"),
    **dict.fromkeys("tailrec operator infix inline external suspend".split(), "function_modifier"), "const": "property_modifier", **dict.fromkeys("abstract final open".split(), "inheritance_modifier"), **dict.fromkeys("vararg noinline crossinline".split(), "parameter_modifier"),
    "expect": "platform_modifier", "actual": "platform_modifier",
}
LITERALS = {"integer": "integer_literal", "real": "real_literal", "hex": "hex_literal", "bin": "bin_literal", "char": "character_literal"}
LEVELS = [{"||": "disjunction_expression"}, {"&&": "conjunction_expression"}, dict.fromkeys("== != === !==".split(), "equality_expression"), dict.fromkeys("< > <= >=".split(), "comparison_expression"), dict.fromkeys("in !in is !is".split(), "check_expression"), {"?:": "elvis_expression"}, {}, dict.fromkeys(("..", "..<"), "range_expression"), dict.fromkeys("+ -".split(), "additive_expression"), dict.fromkeys("* / %".split(), "multiplicative_expression")]
INFIX = 6
ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=")


def _string(source: str, at: int, stop: int) -> tuple[Syn, int]:
    quote = '"""' if source.startswith('"""', at) else '"'
    node, begin = Syn("string_literal", at, at, kids=[Syn(quote, at, at + len(quote), named=False)]), at + len(quote)
    place = begin

    def content(to: int) -> None:
        if begin < to:
            node.add(Syn("string_content", begin, to))

    while place < stop and not source.startswith(quote, place):
        c = source[place]
        if c == "\\" and quote == '"':
            place += 2
        elif source.startswith("${", place):
            content(place)
            end = _hole_end(source, place + 1, stop)
            node.add(Syn("${", place, place + 2, named=False), Syn("interpolated_expression", place + 2, end - 1, kids=_inside(source, place + 2, end - 1)), Syn("}", end - 1, end, named=False))
            place = begin = end
        elif c == "$" and (m := re.compile(r"[^\W\d]\w*").match(source, place + 1, stop)):
            content(place)
            node.add(Syn("$", place, place + 1, named=False), Syn("interpolated_identifier", place + 1, m.end()))
            place = begin = m.end()
        elif c == "\n" and quote == '"':
            break
        else:
            place += 1
    while quote == '"""' and source.startswith('""""', place):
        place += 1
    content(place)
    end = min(place + len(quote), stop)
    node.add(Syn(quote, place, end, named=False))
    node.end = end
    return node, end


def _hole_end(source: str, at: int, stop: int) -> int:
    depth = 0
    while at < stop:
        if source[at] == '"':
            at = _string(source, at, stop)[1]
            continue
        depth += (source[at] == "{") - (source[at] == "}")
        at += 1
        if not depth:
            break
    return at


def _inside(source: str, start: int, stop: int) -> list[Syn]:
    parser = _Kotlin(source, start, stop)
    found = parser.tried(parser.expression)
    return [found] if found is not None else []


class _Kotlin(Parser):
    keywords = KEYWORDS
    no_lambda = False

    def __init__(self, source: str, start: int = 0, stop: int | None = None):
        self.comments: list[Syn] = []
        self.strings: dict[int, Syn] = {}
        super().__init__(source, self.read(source, start, len(source) if stop is None else stop))

    def read(self, source: str, at: int, stop: int) -> list[Token]:
        tokens: list[Token] = []
        fresh = True
        while at < stop:
            m = LEX.match(source, at, stop)
            kind, end = m.lastgroup, m.end()
            if kind == "space":
                fresh = fresh or "\n" in m[0]
            elif kind in ("line_comment", "block_comment"):
                self.comments.append(Syn("line_comment" if kind == "line_comment" else "multiline_comment", at, end, extra=True))
            elif kind == "quote":
                self.strings[at], end = _string(source, at, stop)
                tokens.append(Token("string", '"', at, end, fresh))
                fresh = False
            else:
                tokens.append(Token("literal", kind, at, end, fresh) if kind in LITERALS else Token("sign" if kind == "bad" else kind, m[0], at, end, fresh))
                fresh = False
            at = end
        tokens.append(Token("end", "", stop, stop, True))
        return tokens

    def name(self, kind: str = "simple_identifier") -> Syn:
        return self.identifier(kind)

    # -- files and declarations ------------------------------------------------------------------------------------

    def file(self) -> Syn:
        root = Syn("source_file", 0, len(self.source))
        while self.now.kind != "end":
            root.add(self.recovered(self.top, lambda t: t.fresh))
        return root

    def top(self) -> Syn:
        if self.now.kind == "at" and self.now.text == "@file:":
            return self.make("file_annotation", *self.annotation().kids)
        if self.sees("package") or self.sees("import"):
            word = self.token()
            kids = [self.name()]
            while self.sees(".") and self.ahead().kind == "name":
                kids += [self.token(), self.leaf("simple_identifier")]
            path = self.make("identifier", *kids)
            more = []
            if self.sees("."):
                more = [self.token(), self.make("wildcard_import", self.take("*"))]
            elif self.sees("as"):
                more = [self.make("import_alias", self.token(), self.name("type_identifier"))]
            return self.make("package_header" if word.kind == "package" else "import_header", word, path, *more)
        return self.ended()

    def ended(self) -> Syn:
        found = self.statement()
        self.accept(";")
        if not self.now.fresh and not self.sees("}") and self.now.kind != "end" and self.tokens[self.at - 1].text != ";":
            raise Broken
        return found

    def modifiers(self) -> Syn | None:
        kids = []
        while True:
            if self.now.kind == "at":
                kids.append(self.annotation())
            elif self.now.kind == "name" and self.now.text in MODIFIERS and (self.ahead().kind in ("name", "at") and self.ahead().text not in ("in", "is", "as") and not self.ahead().fresh):
                kids.append(Syn(MODIFIERS[self.now.text], self.now.start, self.now.end, kids=[self.token()]))
            else:
                return self.make("modifiers", *kids) if kids else None

    def annotation(self) -> Syn:
        sign = self.token()
        if self.sees("["):
            return self.make("annotation", sign, self.token(), *self.listed("]", self.user_type), self.take("]"))
        kind = self.user_type()
        return self.make("annotation", sign, self.make("constructor_invocation", kind, self.arguments()) if self.sees("(") and self.now.start == kind.end else kind)

    def declaration(self) -> Syn | None:
        at = self.at
        modifiers = self.modifiers()
        if self.sees("class", "interface") or self.sees("fun") and self.ahead().text == "interface":
            return self.class_(modifiers)
        if self.sees("companion") and self.ahead().text == "object":
            kids = [modifiers, self.token(), self.token(), self.name("type_identifier") if self.now.kind == "name" and not self.now.fresh else None, *self.supertypes()]
            return self.make("companion_object", *kids, self.class_body() if self.sees("{") else None)
        if self.sees("object") and self.ahead().kind == "name":
            kids = [modifiers, self.token(), self.name("type_identifier"), *self.supertypes()]
            return self.make("object_declaration", *kids, self.class_body() if self.sees("{") else None)
        if self.sees("fun") and self.ahead().text != "(":
            return self.function(modifiers)
        if self.sees("val", "var"):
            return self.property(modifiers)
        if self.sees("typealias"):
            return self.make("type_alias", modifiers, self.token(), self.name("type_identifier"), self.type_parameters(), self.take("="), self.type())
        self.at = at
        return None

    def class_(self, modifiers: Syn | None) -> Syn:
        kids = [modifiers, self.accept("fun"), self.token(), self.name("type_identifier"), self.type_parameters()]
        enum = modifiers is not None and "enum" in self.source[modifiers.start : modifiers.end].split()
        if self.sees("(") or self.sees("constructor", "private", "internal", "protected") or self.now.kind == "at" and self.ahead(2).text == "constructor":
            head = [self.modifiers(), self.accept("constructor"), self.take("(")]

            def one() -> Syn:
                own = [self.modifiers()]
                if self.sees("val", "var"):
                    own.append(self.make("binding_pattern_kind", self.token()))
                own += [self.name(), self.take(":"), self.type()]
                return self.make("class_parameter", *own, *([self.token(), self.expression()] if self.sees("=") else []))

            kids.append(self.make("primary_constructor", *head, *self.listed(")", one), self.take(")")))
        kids += self.supertypes()
        if self.sees("where"):
            kids.append(self.where())
        if self.sees("{"):
            kids.append(self.enum_body() if enum else self.class_body())
        return self.make("class_declaration", *kids)

    def where(self) -> Syn:
        kids = [self.token()]
        while True:
            kids.append(self.make("type_constraint", self.name("type_identifier"), self.take(":"), self.type()))
            if not self.sees(","):
                return self.make("type_constraints", *kids)
            kids.append(self.token())

    def supertypes(self) -> list[Syn]:
        if not self.sees(":"):
            return []
        kids = [self.token()]
        while True:
            kind = self.type()
            if self.sees("("):
                kind = self.make("constructor_invocation", kind, self.arguments())
            elif self.sees("by"):
                kind = self.make("explicit_delegation", kind, self.token(), self.plain(self.expression))
            kids.append(self.make("delegation_specifier", kind))
            if not self.sees(","):
                return kids
            kids.append(self.token())

    def plain(self, parse):
        """What ``parse`` reads where a brace opens a body."""
        before, self.no_lambda = self.no_lambda, True
        found = parse()
        self.no_lambda = before
        return found

    def free(self, parse):
        before, self.no_lambda = self.no_lambda, False
        found = parse()
        self.no_lambda = before
        return found

    def class_body(self) -> Syn:
        kids = [self.take("{")]
        while not self.sees("}") and self.now.kind != "end":
            kids.append(self.recovered(lambda: self.free(self.member), lambda t: t.fresh))
        return self.make("class_body", *kids, self.take("}"))

    def enum_body(self) -> Syn:
        kids = [self.take("{")]
        while self.now.kind in ("name", "at") and not self.sees("fun", "val", "var", "companion", "override"):
            own = [self.modifiers(), self.name(), self.arguments() if self.sees("(") else None, self.class_body() if self.sees("{") else None]
            kids.append(self.make("enum_entry", *own))
            if self.sees(","):
                kids.append(self.token())
        self.accept(";")
        while not self.sees("}") and self.now.kind != "end":
            kids.append(self.recovered(lambda: self.free(self.member), lambda t: t.fresh))
        return self.make("enum_class_body", *kids, self.take("}"))

    def member(self) -> Syn:
        if self.sees("init") and self.ahead().text == "{":
            return self.make("anonymous_initializer", self.token(), *self.block())
        at = self.at
        modifiers = self.modifiers()
        if self.sees("constructor"):
            kids = [modifiers, self.token(), self.parameters()]
            if self.sees(":"):
                kids += [self.token(), self.make("constructor_delegation_call", self.take("this", "super"), self.arguments())]
            return self.make("secondary_constructor", *kids, *(self.block() if self.sees("{") else []))
        self.at = at
        found = self.declaration()
        if found is None:
            raise Broken
        self.accept(";")
        return found

    def function(self, modifiers: Syn | None) -> Syn:
        kids = [modifiers, self.token(), self.type_parameters()]
        kids += [*(self.tried(self.receiver) or []), self.name(), self.parameters()]
        if self.sees(":"):
            kids += [self.token(), self.type()]
        if self.sees("where"):
            kids.append(self.where())
        if self.sees("="):
            kids.append(self.make("function_body", self.token(), self.expression()))
        elif self.sees("{"):
            kids.append(self.make("function_body", *self.block()))
        return self.make("function_declaration", *kids)

    def receiver(self) -> list[Syn]:
        kind = self.make("parenthesized_type", self.token(), self.type(), self.take(")")) if self.sees("(") else self.user_type(last=False)
        if self.sees("?."):  # nullable
            t = self.token()
            return [self.make("nullable_type", kind, Syn("?", t.start, t.start + 1, named=False)), Syn(".", t.start + 1, t.end, named=False)]
        return [kind, self.take(".")]

    def parameters(self) -> Syn:
        kids = [self.take("(")]
        while not self.sees(")"):
            modifiers = self.modifiers()
            if modifiers is not None:
                modifiers.kind = "parameter_modifiers"
                kids.append(modifiers)
            name = self.name()
            kids.append(self.make("parameter", name, self.token(), self.type()) if self.sees(":") else self.make("parameter", name))
            if self.sees("="):
                kids += [self.token(), self.expression()]
            if not self.sees(")"):
                kids.append(self.take(","))
        return self.make("function_value_parameters", *kids, self.token())

    def variable(self) -> Syn:
        if self.sees("("):
            return self.make("multi_variable_declaration", self.token(), *self.listed(")", self.variable), self.take(")"))
        name = self.name()
        return self.make("variable_declaration", name, self.token(), self.type()) if self.sees(":") else self.make("variable_declaration", name)

    def property(self, modifiers: Syn | None) -> Syn:
        kids = [modifiers, self.make("binding_pattern_kind", self.token()), self.type_parameters()]
        kids += [*(self.tried(self.receiver) or []), self.variable()]
        if self.sees("="):
            kids += [self.token(), self.expression()]
        elif self.sees("by"):
            kids.append(self.make("property_delegate", self.token(), self.expression()))
        while self.accessor():
            before = self.modifiers()
            word = self.token()
            own = [before, word]
            if self.sees("("):
                own.append(self.token())
                if not self.sees(")"):
                    own.append(self.make("parameter_with_optional_type", self.name(), *([self.token(), self.type()] if self.sees(":") else [])))
                own.append(self.take(")"))
                if self.sees(":"):
                    own += [self.token(), self.type()]
                own.append(self.make("function_body", self.token(), self.expression()) if self.sees("=") else self.make("function_body", *self.block()))
            kids.append(self.make("getter" if word.kind == "get" else "setter", *own))
        return self.make("property_declaration", *kids)

    def accessor(self) -> bool:
        by = 1 if self.now.text in MODIFIERS else 0
        t = self.ahead(by) if by else self.now
        return t.text in ("get", "set") and t.kind == "name" and (self.ahead(by + 1).text == "(" or by == 1)

    # -- types -----------------------------------------------------------------------------------------------------

    def type(self) -> Syn:
        return self.deeper(self._type)

    def _type(self) -> Syn:
        while self.now.kind == "at" or self.sees("suspend"):
            self.annotation() if self.now.kind == "at" else self.token()
        if self.sees("("):
            found = self.tried(self.function_type) or self.make("parenthesized_type", self.token(), self.type(), self.take(")"))
        else:
            found = self.user_type()
            if self.sees(".") and self.ahead().text == "(":
                dot = self.token()
                inner = self.function_type()
                return self.make("function_type", found, dot, *inner.kids)
        while self.sees("?") and not self.now.fresh:
            found = self.make("nullable_type", found, self.token())
        if self.sees("&"):
            found = self.make("not_nullable_type", found, self.token(), self.type())
        return found

    def function_type(self) -> Syn:
        def one() -> Syn:
            if self.now.kind == "name" and self.ahead().text == ":":
                return self.make("parameter", self.name(), self.token(), self.type())
            return self.type()

        parameters = self.make("function_type_parameters", self.take("("), *self.listed(")", one), self.take(")"))
        return self.make("function_type", parameters, self.take("->"), self.type())

    def user_type(self, last: bool = True) -> Syn:
        kids = [self.name("type_identifier")]
        while True:
            if self.sees("<") and (arguments := self.tried(self.type_arguments)) is not None:
                kids.append(arguments)
            elif self.sees(".") and self.ahead().kind == "name" and (last or self.ahead(2).text in (".", "<")):
                kids += [self.token(), self.name("type_identifier")]
            else:
                return self.make("user_type", *kids)

    def type_arguments(self) -> Syn:
        def one() -> Syn:
            if self.sees("*"):
                return self.make("type_projection", self.token())
            variance = self.make("type_projection_modifiers", self.token()) if self.sees("in", "out") else None
            return self.make("type_projection", variance, self.type())

        return self.make("type_arguments", self.take("<"), *self.listed(">", one), self.take(">"))

    def type_parameters(self) -> Syn | None:
        if not self.sees("<"):
            return None

        def one() -> Syn:
            before = self.make("type_parameter_modifiers", self.token()) if self.sees("in", "out", "reified") else None
            name = self.name("type_identifier")
            return self.make("type_parameter", before, name, *([self.token(), self.type()] if self.sees(":") else []))

        return self.make("type_parameters", self.token(), *self.listed(">", one), self.take(">"))

    # -- statements ------------------------------------------------------------------------------------------------

    def block(self) -> list[Syn]:
        open_ = self.take("{")
        inside = self.statements()
        return [open_, *([inside] if inside is not None else []), self.take("}")]

    def statements(self) -> Syn | None:
        kids: list[Syn] = []

        def all_() -> None:
            while not self.sees("}") and self.now.kind != "end":
                if self.accept(";") is None:
                    kids.append(self.recovered(self.ended, lambda t: t.fresh))

        self.deeper(lambda: self.free(all_))
        return self.make("statements", *kids) if kids else None

    def statement(self) -> Syn:
        return self.deeper(self._statement)

    def _statement(self) -> Syn:
        if (found := self.declaration()) is not None:
            return found
        if self.now.kind == "label" and self.ahead().text in ("for", "while", "do", "{"):
            self.at += 1
        if self.sees("for"):
            kids = [self.token(), self.take("("), self.variable(), self.take("in"), self.free(self.expression), self.take(")")]
            return self.make("for_statement", *kids, self.control_body())
        if self.sees("while"):
            kids = [self.token(), self.take("("), self.free(self.expression), self.take(")")]
            return self.make("while_statement", *kids, self.token() if self.sees(";") else self.control_body())
        if self.sees("do"):
            kids = [self.token(), self.control_body() if not self.sees("while") else None, self.take("while"), self.take("("), self.free(self.expression)]
            return self.make("do_while_statement", *kids, self.take(")"))
        found = self.expression()
        if self.sees(*ASSIGN):
            return self.make("assignment", self.make("directly_assignable_expression", found), self.token(), self.expression())
        return found

    def control_body(self) -> Syn:
        return self.make("control_structure_body", *self.block()) if self.sees("{") else self.make("control_structure_body", self.statement())

    # -- expressions -----------------------------------------------------------------------------------------------

    def expression(self) -> Syn:
        return self.deeper(lambda: self.level(0))

    def level(self, n: int) -> Syn:
        if n == len(LEVELS):
            found = self.prefix()
            while self.sees("as"):
                word = self.token()
                if self.sees("?") and self.now.start == word.end:
                    word = Syn("as?", word.start, self.token().end, named=False)
                found = self.make("as_expression", found, word, self.type())
            return found
        left = self.level(n + 1)
        while True:
            t = self.now
            if n == INFIX:
                if t.kind != "name" or t.text in KEYWORDS or t.fresh or t.text in ("by", "where") or self.ahead().text in ("=", ".", ",", ")", ":", "}", "->", "?.", "==") or self.ahead().kind == "end" or self.ahead().fresh:
                    return left
                name = self.name()
                left = self.make("infix_expression", left, name, self.level(n + 1))
                continue
            kind = LEVELS[n].get(t.text) if t.kind in ("sign", "name") else None
            if kind is None or t.fresh and t.text not in ("&&", "||", "?:"):
                return left
            operator = self.token()
            left = self.make(kind, left, operator, self.type() if operator.kind in ("is", "!is") else self.level(n + 1))

    def prefix(self) -> Syn:
        if self.sees("!", "-", "+", "++", "--"):
            return self.deeper(lambda: self.make("prefix_expression", self.token(), self.prefix()))
        if self.sees("!!"):
            t = self.token()
            inner = Syn("!", t.start + 1, t.end, named=False)
            return self.make("prefix_expression", Syn("!", t.start, t.start + 1, named=False), self.make("prefix_expression", inner, self.prefix()))
        if self.now.kind == "at":
            return self.make("prefix_expression", self.annotation(), self.prefix())
        if self.now.kind == "label":
            return self.make("prefix_expression", self.leaf("label"), self.prefix())
        return self.postfix(self.primary())

    def primary(self) -> Syn:
        t = self.now
        if t.kind == "string":
            self.at += 1
            return self.strings[t.start]
        if t.kind == "literal":
            return self.leaf(LITERALS[t.text])
        if self.sees("true", "false"):
            return Syn("boolean_literal", t.start, t.end, kids=[self.token()])
        if self.sees("null"):
            return self.leaf("null_literal")
        if self.sees("this", "super"):
            kids = [self.token()]
            if kids[0].kind == "super" and self.sees("<"):
                kids += [self.token(), self.type(), self.take(">")]
            if self.now.kind == "at" and self.now.start == t.end:
                kids += [self.token(), self.name("type_identifier")]
            return self.make(f"{kids[0].kind}_expression", *kids)
        if self.sees("("):
            return self.make("parenthesized_expression", self.token(), self.free(self.expression), self.take(")"))
        if self.sees("["):
            return self.make("collection_literal", self.token(), *self.free(lambda: self.listed("]", self.expression)), self.take("]"))
        if self.sees("{"):
            return self.lambda_()
        if self.sees("if"):
            return self.if_()
        if self.sees("when"):
            return self.when()
        if self.sees("try"):
            kids = [self.token(), *self.block()]
            while self.sees("catch"):
                own = [self.token(), self.take("("), self.name(), self.take(":"), self.type(), self.take(")")]
                kids.append(self.make("catch_block", *own, *self.block()))
            if self.sees("finally"):
                kids.append(self.make("finally_block", self.token(), *self.block()))
            return self.make("try_expression", *kids)
        if self.sees("return", "break", "continue", "throw"):
            kids = [self.token()]
            if self.now.kind in ("at", "label") and self.now.start == kids[0].end:
                kids.append(self.token())
                if self.now.kind == "name" and self.now.start == kids[-1].end:
                    kids.append(self.name())
            if kids[0].kind in ("return", "throw") and not self.now.fresh and not self.sees("}", ")", ",", ";", "]", "else", "->") and self.now.kind != "end":
                kids.append(self.expression())
            return self.make("jump_expression", *kids)
        if self.sees("object"):
            kids = [self.token(), *self.supertypes()]
            return self.make("object_literal", *kids, self.class_body())
        if self.sees("fun"):
            kids = [self.token(), self.parameters()]
            if self.sees(":"):
                kids += [self.token(), self.type()]
            return self.make("anonymous_function", *kids, self.make("function_body", self.token(), self.expression()) if self.sees("=") else self.make("function_body", *self.block()))
        if self.sees("::"):
            return self.make("callable_reference", self.token(), self.accept("class") or self.name())
        return self.name()

    def lambda_(self) -> Syn:
        open_ = self.take("{")

        def header() -> list[Syn]:
            kids = [self.variable()] if not self.sees("->") else []
            while self.sees(","):
                kids += [self.token(), self.variable()]
            arrow = self.take("->")
            return [*([self.make("lambda_parameters", *kids)] if kids else []), arrow]

        head = self.tried(header) or []
        return self.make("lambda_literal", open_, *head, self.statements(), self.take("}"))

    def if_(self) -> Syn:
        kids = [self.token(), self.take("("), named("condition", self.free(self.expression)), self.take(")")]
        if not self.sees("else", ";"):
            kids.append(named("consequence", self.control_body()))
        if self.sees(";") and self.ahead().text == "else":
            kids.append(self.token())
        if self.sees("else"):
            kids += [self.token(), named("alternative", self.control_body())]
        return self.make("if_expression", *kids)

    def when(self) -> Syn:
        kids = [self.token()]
        if self.sees("("):
            subject = [self.token()]
            if self.sees("val"):
                subject += [self.token(), self.variable(), self.take("=")]
            kids.append(self.make("when_subject", *subject, self.free(self.expression), self.take(")")))
        kids.append(self.take("{"))

        def condition() -> Syn:
            if self.sees("in", "!in"):
                return self.make("when_condition", self.make("range_test", self.token(), self.expression()))
            if self.sees("is", "!is"):
                return self.make("when_condition", self.make("type_test", self.token(), self.type()))
            return self.make("when_condition", self.expression())

        while not self.sees("}") and self.now.kind != "end":
            own = [self.token()] if self.sees("else") else [condition()]
            while self.sees(","):
                own += [self.token(), condition()]
            kids.append(self.make("when_entry", *own, self.take("->"), self.free(self.control_body)))
            self.accept(";")
        return self.make("when_expression", *kids, self.take("}"))

    def arguments(self) -> Syn:
        def one() -> Syn:
            if self.now.kind == "name" and self.ahead().text == "=" and self.now.text not in KEYWORDS:
                return self.make("value_argument", self.name(), self.token(), self.expression())
            return self.make("value_argument", self.accept("*"), self.expression())

        return self.make("value_arguments", self.take("("), *self.free(lambda: self.listed(")", one)), self.take(")"))

    def call_types(self) -> Syn:
        found = self.type_arguments()
        if not self.sees("(", "{") or self.now.fresh:
            raise Broken
        return found

    def postfix(self, found: Syn) -> Syn:
        while True:
            if self.sees(".", "?.") and self.ahead().kind == "name":
                sign = self.token()
                found = self.make("navigation_expression", found, self.make("navigation_suffix", sign, self.leaf("simple_identifier")))
            elif self.sees("::") and not self.now.fresh:
                sign = self.token()
                suffix = self.make("navigation_suffix", sign, self.token() if self.sees("class") else self.name())
                found = self.make("navigation_expression", found, suffix) if found.kind != "simple_identifier" else self.make("callable_reference", Syn("type_identifier", found.start, found.end), *suffix.kids)
            elif self.sees("!!", "++", "--") and not self.now.fresh:
                found = self.make("postfix_expression", found, self.token())
            elif self.sees("[") and not self.now.fresh:
                found = self.make("indexing_expression", found, self.make("indexing_suffix", self.token(), *self.free(lambda: self.listed("]", self.expression)), self.take("]")))
            elif self.sees("(") and not self.now.fresh or self.sees("<") and (types := self.tried(self.call_types)) is not None:
                own = [types] if self.tokens[self.at - 1].text == ">" and not self.sees("<") and self.tokens[self.at - 1].end > found.end else []
                if self.sees("("):
                    own.append(self.arguments())
                if self.sees("{") and not self.no_lambda and not self.now.fresh:
                    own.append(self.make("annotated_lambda", self.lambda_()))
                found = self.make("call_expression", found, self.make("call_suffix", *own))
            elif self.sees("{") and not self.no_lambda and not self.now.fresh and found.kind in ("simple_identifier", "navigation_expression", "call_expression"):
                found = self.make("call_expression", found, self.make("call_suffix", self.make("annotated_lambda", self.lambda_())))
            else:
                return found


def parse(source: str) -> Syn:
    parser = _Kotlin(source)
    return with_comments(parser.file(), parser.comments)
