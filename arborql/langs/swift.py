"""Swift: statements may stand at the top of a file; a line's end ends a statement where it can."""

from __future__ import annotations

import re

from .code import Broken, Parser, Token, named, with_comments
from .tree import Syn

LEX = re.compile(
    r"(?P<space>[\s﻿]+)|(?P<comment>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<quote>\"\"\"|\"|#+\")|(?P<hash>#[a-zA-Z]\w*)|(?P<at>@[^\W\d]\w*)|(?P<name>`\w+`|\$\d+|[^\W\d]\w*)|"
    r"(?P<hex>0x[\da-fA-F_]+)|(?P<bin>0b[01_]+)|(?P<oct>0o[0-7_]+)|(?P<real>\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*[eE][+-]?\d+)|(?P<integer>\d[\d_]*)|"
    r"(?P<sign>===|!==|\.\.\.|\.\.<|->|&&|\|\||\?\?|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&\+|&-|&\*|<<|[-+*/%!<>=?:;,.&|^~(){}\[\]\\])|(?P<bad>.)",
    re.S,
)
KEYWORDS = frozenset("as break case catch class continue default defer deinit do else enum extension fallthrough false fileprivate for func guard if import in init inout internal is let nil operator private protocol public repeat rethrows return self Self static struct subscript super switch throw throws true try typealias var where while".split())
MODIFIERS = {
    **dict.fromkeys("public private internal fileprivate open".split(), "visibility_modifier"), **dict.fromkeys("static class final lazy weak unowned override convenience required mutating nonmutating optional dynamic indirect nonisolated".split(), "member_modifier"),
}
LITERALS = {"integer": "integer_literal", "real": "real_literal", "hex": "hex_literal", "bin": "bin_literal", "oct": "oct_literal"}
LEVELS = [{"||": "disjunction_expression"}, {"&&": "conjunction_expression"}, dict.fromkeys("== != === !==".split(), "equality_expression"), dict.fromkeys("< > <= >=".split(), "comparison_expression"), {"is": "check_expression", "as": "as_expression"}, {"??": "nil_coalescing_expression"}, dict.fromkeys(("...", "..<"), "range_expression"), dict.fromkeys("+ - | ^ &+ &-".split(), "additive_expression"), dict.fromkeys("* / % & << &*".split(), "multiplicative_expression")]
BITWISE = {"|": "bitwise_operation", "^": "bitwise_operation", "&": "bitwise_operation", "<<": "bitwise_operation"}
ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=")


def _string(source: str, at: int, stop: int) -> tuple[Syn, int]:
    marks = len(source[at:]) - len(source[at:].lstrip("#")) if source[at] == "#" else 0
    quote = '"""' if source.startswith('"""', at + marks) else '"'
    close, hole = quote + "#" * marks, "\\" + "#" * marks + "("
    kind, text = ("raw_string_literal", "raw_str_part") if marks else ("multi_line_string_literal", "multi_line_str_text") if quote == '"""' else ("line_string_literal", "line_str_text")
    place = begin = at + marks + len(quote)
    node = Syn(kind, at, at, kids=[Syn(source[at:place], at, place, named=False)])
    while place < stop and not source.startswith(close, place):
        if source.startswith(hole, place):
            if begin < place:
                node.add(Syn(text, begin, place))
            inside = place + len(hole)
            end = _hole_end(source, inside, stop)
            parser = _Swift(source, inside, end - 1)
            found = parser.tried(parser.expression)
            node.add(Syn(hole, place, inside, named=False), *([Syn("interpolated_expression", found.start, found.end, kids=[found])] if found else []), Syn(")", end - 1, end, named=False))
            place = begin = end
        elif source[place] == "\\" and not marks:
            place += 2
        elif source[place] == "\n" and quote == '"':
            break
        else:
            place += 1
    if begin < place:
        node.add(Syn(text, begin, min(place, stop)))
    end = min(place + len(close), stop)
    node.add(Syn(close, min(place, end), end, named=False))
    node.end = end
    return node, end


def _hole_end(source: str, at: int, stop: int) -> int:
    depth = 1
    while at < stop and depth:
        if source[at] == '"':
            at = _string(source, at, stop)[1]
            continue
        depth += (source[at] == "(") - (source[at] == ")")
        at += 1
    return at


class _Swift(Parser):
    keywords = KEYWORDS
    no_trailing = False

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
            elif kind in ("comment", "block"):
                self.comments.append(Syn("comment" if kind == "comment" else "multiline_comment", at, end, extra=True))
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
        if self.sees("self", "Self", "init", "default", "in", "class") and kind == "any":
            return self.leaf("simple_identifier")
        return self.identifier("simple_identifier" if kind == "any" else kind)

    def joined(self) -> bool:
        """Whether nothing stands between this token and the one before it."""
        return self.now.start == self.tokens[self.at - 1].end

    # -- declarations ----------------------------------------------------------------------------------------------

    def file(self) -> Syn:
        root = Syn("source_file", 0, len(self.source))
        while self.now.kind != "end":
            if self.accept(";") is None:
                root.add(self.recovered(self.ended, lambda t: t.fresh))
        return root

    def ended(self) -> Syn:
        found = self.statement()
        self.accept(";")
        if not self.now.fresh and not self.sees("}", "case", "default") and self.now.kind != "end" and self.tokens[self.at - 1].text != ";":
            raise Broken
        return found

    def modifiers(self) -> Syn | None:
        kids = []
        while True:
            if self.now.kind == "at":
                t = self.now
                self.at += 1
                own = [Syn("@", t.start, t.start + 1, named=False), Syn("user_type", t.start + 1, t.end, kids=[Syn("type_identifier", t.start + 1, t.end)])]
                if self.sees("(") and self.joined():
                    own += self.arguments().kids
                kids.append(self.make("attribute", *own))
            elif self.now.kind == "name" and self.now.text in MODIFIERS and (self.ahead().kind in ("name", "at") or self.ahead().text == "(" and MODIFIERS[self.now.text] == "visibility_modifier" or self.now.text == "unowned"):
                if self.sees("class") and self.ahead().text not in ("func", "var", "let", "override", "final"):
                    break
                own = [self.token()]
                if self.sees("("):
                    own += [self.token(), self.token(), self.take(")")]
                kids.append(self.make(MODIFIERS[own[0].kind], *own))
            else:
                break
        return self.make("modifiers", *kids) if kids else None

    def declaration(self) -> Syn | None:
        at = self.at
        modifiers = self.modifiers()
        if self.sees("func"):
            return self.function(modifiers)
        if self.sees("let", "var"):
            return self.property(modifiers)
        if self.sees("class", "struct", "enum", "extension") or self.sees("actor") and self.ahead().kind == "name":
            word = named("declaration_kind", self.token())
            name = named("name", self.user_type() if word.kind == "extension" else self.name("type_identifier"))
            kids = [modifiers, word, name, self.type_parameters(), *self.inherited(), self.where()]
            body = self.body("enum_class_body" if word.kind == "enum" else "class_body")
            return self.make("class_declaration", *kids, named("body", body))
        if self.sees("protocol"):
            kids = [modifiers, self.token(), named("name", self.name("type_identifier")), *self.inherited(), self.where()]
            return self.make("protocol_declaration", *kids, named("body", self.body("protocol_body")))
        if self.sees("typealias"):
            return self.make("typealias_declaration", modifiers, self.token(), self.name("type_identifier"), self.type_parameters(), self.take("="), self.type())
        if self.sees("init") and self.ahead().text in ("(", "?", "!", "<"):
            kids = [modifiers, self.token(), self.accept("?", "!"), self.type_parameters(), *self.parameters(), *self.effects(), self.where()]
            return self.make("init_declaration", *kids, named("body", self.function_body()) if self.sees("{") else None)
        if self.sees("deinit"):
            return self.make("deinit_declaration", modifiers, self.token(), named("body", self.function_body()))
        if self.sees("subscript"):
            kids = [modifiers, self.token(), *self.parameters(), self.take("->"), self.type()]
            return self.make("subscript_declaration", *kids, *([self.accessors()] if self.sees("{") else []))
        if self.sees("associatedtype"):
            return self.make("associatedtype_declaration", modifiers, self.token(), self.name("type_identifier"), *self.inherited(), *([self.token(), self.type()] if self.sees("=") else []))
        if self.sees("import"):
            word = self.token()
            kids = [self.name()]
            while self.sees("."):
                kids += [self.token(), self.name()]
            return self.make("import_declaration", modifiers, word, self.make("identifier", *kids))
        if self.sees("case") and self.inside_enum:
            return self.enum_case(modifiers)
        self.at = at
        return None

    inside_enum = False

    def enum_case(self, modifiers: Syn | None) -> Syn:
        kids = [modifiers, self.token()]
        while True:
            kids.append(named("name", self.name("any")))
            if self.sees("("):
                def one() -> list[Syn]:
                    label = [self.name("any"), self.token()] if self.now.kind == "name" and self.ahead().text == ":" else []
                    return self.make("parameter", *label, self.type())

                kids.append(self.make("enum_type_parameters", self.token(), *self.listed(")", one), self.take(")")))
            if self.sees("="):
                kids += [self.token(), self.expression()]
            if not self.sees(","):
                return self.make("enum_entry", *kids)
            kids.append(self.token())

    def inherited(self) -> list[Syn]:
        if not self.sees(":"):
            return []
        kids = [self.token()]
        while True:
            kids.append(self.make("inheritance_specifier", named("inherits_from", self.token() if self.sees("class") else self.type())))
            if not self.sees(",", "&"):
                return kids
            kids.append(self.token())

    def where(self) -> Syn | None:
        if not self.sees("where"):
            return None
        kids = [self.token()]
        while True:
            left = self.type()
            kids.append(self.make("type_constraint", left, self.take(":", "=="), self.type()))
            if not self.sees(","):
                return self.make("type_constraints", *kids)
            kids.append(self.token())

    def body(self, kind: str) -> Syn:
        before, self.inside_enum = (self.inside_enum, self.no_trailing), kind == "enum_class_body"
        self.no_trailing = False
        kids = [self.take("{")]

        def member() -> Syn:
            if self.now.kind == "hash":
                return self.directive()
            found = self.declaration()
            if found is None:
                raise Broken
            self.accept(";")
            return found

        while not self.sees("}") and self.now.kind != "end":
            kids.append(self.recovered(member, lambda t: t.fresh))
        self.inside_enum, self.no_trailing = before
        return self.make(kind, *kids, self.take("}"))

    def directive(self) -> Syn:
        start = self.token()
        while not self.now.fresh and self.now.kind != "end":
            self.at += 1
        return Syn("directive", start.start, self.tokens[self.at - 1].end)

    def function(self, modifiers: Syn | None) -> Syn:
        kids = [modifiers, self.token(), named("name", self.name() if self.now.kind == "name" else Syn("custom_operator", self.now.start, self.token().end)), self.type_parameters(), *self.parameters(), *self.effects()]
        if self.sees("->"):
            kids += [self.token(), named("return_type", self.type())]
        kids.append(self.where())
        return self.make("function_declaration", *kids, named("body", self.function_body())) if self.sees("{") else self.make("protocol_function_declaration", *kids)

    def effects(self) -> list[Syn]:
        found = []
        while self.sees("async", "throws", "rethrows"):
            found.append(Syn(self.now.text, self.now.start, self.now.end, kids=[self.token()]))
        return found

    def parameters(self) -> list[Syn]:
        kids = [self.take("(")]
        while not self.sees(")"):
            own = [self.modifiers(), named("external_name", self.name("any")) if self.ahead().kind == "name" else None, named("name", self.name("any"))]
            if self.sees(":"):
                own += [self.token(), self.make("parameter_modifiers", self.token()) if self.sees("inout") else None, named("type", self.type()), self.accept("...")]
            kids.append(self.make("parameter", *own))
            if self.sees("="):
                kids += [self.token(), named("default_value", self.expression())]
            if not self.sees(")"):
                kids.append(self.take(","))
        return [*kids, self.token()]

    def type_parameters(self) -> Syn | None:
        if not self.sees("<"):
            return None

        def one() -> Syn:
            name = self.name("type_identifier")
            return self.make("type_parameter", name, self.token(), self.type()) if self.sees(":") else self.make("type_parameter", name)

        return self.make("type_parameters", self.token(), *self.listed(">", one), self.take(">"))

    def function_body(self) -> Syn:
        return self.make("function_body", *self.block())

    def block(self) -> list[Syn]:
        open_ = self.take("{")
        inside = self.statements()
        return [open_, *([inside] if inside is not None else []), self.take("}")]

    def statements(self, *until: str) -> Syn | None:
        kids: list[Syn] = []
        before, self.no_trailing, self.inside_enum = (self.no_trailing, self.inside_enum), False, False

        def all_() -> None:
            while not self.sees("}", *until) and self.now.kind != "end":
                if self.accept(";") is None:
                    kids.append(self.recovered(self.ended, lambda t: t.fresh))

        self.deeper(all_)
        self.no_trailing, self.inside_enum = before
        return self.make("statements", *kids) if kids else None

    def pattern(self) -> Syn:
        if self.sees("("):
            return self.make("pattern", self.token(), *self.listed(")", self.pattern), self.take(")"))
        if self.sees("let", "var"):
            return self.make("pattern", self.make("value_binding_pattern", named("mutability", self.token())), self.pattern())
        return self.make("pattern", named("bound_identifier", self.name()))

    def property(self, modifiers: Syn | None) -> Syn:
        kids = [modifiers, self.make("value_binding_pattern", named("mutability", self.token()))]
        while True:
            kids.append(named("name", self.pattern()))
            if self.sees(":"):
                kids.append(self.make("type_annotation", self.token(), named("type", self.type())))
            if self.sees("="):
                kids += [self.token(), named("value", self.expression())]
            if self.sees("{") and not self.no_trailing:
                kids.append(self.accessors())
            if not self.sees(","):
                return self.make("property_declaration", *kids)
            kids.append(self.token())

    def accessors(self) -> Syn:
        def whole() -> Syn:
            kids = [self.take("{")]
            while not self.sees("}"):
                own = [self.modifiers(), self.take("get", "set", "willSet", "didSet"), *self.effects()]
                if self.sees("("):
                    own += [self.token(), self.name(), self.take(")")]
                kind = {"get": "computed_getter", "set": "computed_setter", "willSet": "willset_clause", "didSet": "didset_clause"}[own[1].kind]
                kids.append(self.make(kind, *own, *(self.block() if self.sees("{") else [])))
            if len(kids) == 1:
                raise Broken
            return self.make("computed_property", *kids, self.token())

        return self.tried(whole) or named("computed_value", self.make("computed_property", *self.block()))

    # -- types -----------------------------------------------------------------------------------------------------

    def type(self) -> Syn:
        return self.deeper(self._type)

    def _type(self) -> Syn:
        while self.now.kind == "at" or self.sees("inout", "some", "any") and self.ahead().kind in ("name", "at"):
            if self.sees("some", "any"):
                return self.make("opaque_type" if self.sees("some") else "existential_type", self.token(), self.type())
            self.modifiers() if self.now.kind == "at" else self.token()
        if self.sees("["):
            kids = [self.token(), self.type()]
            if self.sees(":"):
                found = self.make("dictionary_type", *kids, self.token(), self.type(), self.take("]"))
            else:
                found = self.make("array_type", *kids, self.take("]"))
        elif self.sees("("):
            def one() -> Syn:
                label = []
                while self.now.kind == "name" and (self.ahead().text == ":" or self.ahead(2).text == ":" and self.ahead().kind == "name"):
                    label += [self.name("any"), *([self.token()] if self.sees(":") else [])]
                found = self.make("tuple_type_item", *label, self.type())
                self.accept("...")
                return found

            found = self.make("tuple_type", self.token(), *self.listed(")", one), self.take(")"))
            more = self.effects()
            if self.sees("->"):
                return self.make("function_type", found, *more, self.token(), self.type())
        else:
            found = self.user_type()
        while True:
            if self.sees("?", "!") and self.joined():
                found = self.make("optional_type", found, self.token()) if self.sees("?") else self.make("implicitly_unwrapped_type", found, self.token())
            elif self.sees("&"):
                found = self.make("protocol_composition_type", found, self.token(), self.type())
            else:
                return found

    def user_type(self) -> Syn:
        kids = [self.leaf("type_identifier") if self.sees("Self") else self.name("type_identifier")]
        while True:
            if self.sees("<") and (arguments := self.tried(self.type_arguments)) is not None:
                kids.append(arguments)
            elif self.sees(".") and self.ahead().kind == "name":
                kids += [self.token(), self.leaf("type_identifier")]
            else:
                return self.make("user_type", *kids)

    def type_arguments(self) -> Syn:
        return self.make("type_arguments", self.take("<"), *self.listed(">", self.type), self.take(">"))

    # -- statements ------------------------------------------------------------------------------------------------

    def statement(self) -> Syn:
        return self.deeper(self._statement)

    def headed(self, parse):
        before, self.no_trailing = self.no_trailing, True
        found = parse()
        self.no_trailing = before
        return found

    def free(self, parse):
        before, self.no_trailing = self.no_trailing, False
        found = parse()
        self.no_trailing = before
        return found

    def conditions(self) -> list[Syn]:
        kids: list[Syn] = []
        while True:
            if self.sees("let", "var"):
                kids += [self.make("value_binding_pattern", named("mutability", self.token())), named("bound_identifier", self.name("any"))]
                if self.sees(":"):
                    kids.append(self.make("type_annotation", self.token(), self.type()))
                if self.sees("="):
                    kids += [self.token(), self.headed(self.expression)]
            elif self.sees("case"):
                kids += [self.token(), self.headed(self.case_pattern), self.take("="), self.headed(self.expression)]
            elif self.now.kind == "hash":
                kids.append(self.make("availability_condition", Syn(self.now.text, self.now.start, self.token().end, named=False), *self.arguments().kids))
            else:
                kids.append(named("condition", self.headed(self.expression)))
            if not self.sees(","):
                return kids
            kids.append(self.token())

    def case_pattern(self) -> Syn:
        if self.sees("let", "var"):
            return self.make("pattern", self.make("value_binding_pattern", named("mutability", self.token())), self.case_pattern())
        if self.sees("is"):
            return self.make("pattern", self.token(), self.type())
        found = self.tried(lambda: self.make("pattern", self.token(), *self.listed(")", self.case_pattern), self.take(")"))) if self.sees("(") else None
        if found is None and self.sees(".") or found is None and self.now.kind == "name" and self.ahead().text == ".":
            def whole() -> Syn:
                kids = [] if self.sees(".") else [self.user_head()]
                kids += [self.take("."), self.name("any")]
                if self.sees("("):
                    def one() -> Syn:
                        label = [self.name("any"), self.token()] if self.now.kind == "name" and self.ahead().text == ":" else []
                        return self.make("tuple_pattern_item", *label, self.case_pattern())

                    kids.append(self.make("tuple_pattern", self.token(), *self.listed(")", one), self.take(")")))
                if not self.sees(":", ",", "=", "where", "in", ")", "?"):
                    raise Broken
                return self.make("pattern", *kids, self.accept("?"))

            found = self.tried(whole)
        if found is None:
            found = self.make("pattern", self.expression())
        return found

    def user_head(self) -> Syn:
        return self.make("user_type", self.name("type_identifier"))

    def _statement(self) -> Syn:
        if self.now.kind == "hash" and self.now.text in ("#if", "#else", "#elseif", "#endif", "#warning", "#error"):
            return self.directive()
        if (found := self.declaration()) is not None:
            return found
        if self.now.kind == "name" and self.ahead().text == ":" and self.ahead(2).text in ("for", "while", "repeat", "switch", "if"):
            return self.make("statement_label", self.name(), self.token(), self.statement())
        if self.sees("if"):
            return self.if_()
        if self.sees("guard"):
            return self.make("guard_statement", self.token(), *self.conditions(), self.take("else"), *self.block())
        if self.sees("for"):
            kids = [self.token(), self.accept("try"), self.accept("await"), self.accept("case"), named("item", self.headed(self.case_pattern) if self.tokens[self.at - 1].text == "case" else self.pattern())]
            if self.sees(":"):
                kids.append(self.make("type_annotation", self.token(), self.type()))
            kids += [self.take("in"), named("collection", self.headed(self.expression))]
            if self.sees("where"):
                kids.append(self.make("where_clause", self.token(), self.headed(self.expression)))
            return self.make("for_statement", *kids, *self.block())
        if self.sees("while"):
            return self.make("while_statement", self.token(), *self.conditions(), *self.block())
        if self.sees("repeat"):
            return self.make("repeat_while_statement", self.token(), *self.block(), self.take("while"), self.expression())
        if self.sees("do"):
            kids = [self.token(), *self.block()]
            while self.sees("catch"):
                own = [self.token(), None if self.sees("{") else self.headed(self.case_pattern)]
                kids.append(self.make("catch_block", *own, *self.block()))
            return self.make("do_statement", *kids)
        if self.sees("defer"):
            return self.make("defer_statement", self.token(), *self.block())
        if self.sees("switch"):
            return self.switch()
        if self.sees("return", "throw", "break", "continue", "fallthrough"):
            kids = [Syn("throw_keyword", self.now.start, self.now.end, kids=[self.token()]) if self.sees("throw") else self.token()]
            if kids[0].kind in ("return", "throw_keyword") and not self.now.fresh and not self.sees("}", ";") and self.now.kind != "end":
                kids.append(named("result", self.expression()))
            elif kids[0].kind in ("break", "continue") and self.now.kind == "name" and not self.now.fresh:
                kids.append(self.name())
            return self.make("control_transfer_statement", *kids)
        found = self.expression()
        if self.sees(*ASSIGN):
            return self.make("assignment", named("target", self.make("directly_assignable_expression", found)), named("operator", self.token()), named("result", self.expression()))
        return found

    def if_(self) -> Syn:
        kids = [self.token(), *self.conditions(), *self.block()]
        if self.sees("else"):
            kids.append(Syn("else", self.now.start, self.now.end, kids=[self.token()]))
            kids += [self.if_()] if self.sees("if") else self.block()
        return self.make("if_statement", *kids)

    def switch(self) -> Syn:
        kids = [self.token(), named("expr", self.headed(self.expression)), self.take("{")]
        while not self.sees("}"):
            while self.now.kind == "at":
                self.modifiers()
            if self.sees("default"):
                own = [Syn("default_keyword", self.now.start, self.now.end, kids=[self.token()])]
            else:
                own = [self.take("case")]
                while True:
                    own.append(self.make("switch_pattern", self.case_pattern()))
                    if self.sees("where"):
                        own.append(self.make("where_clause", self.token(), self.expression()))
                    if not self.sees(","):
                        break
                    own.append(self.token())
            kids.append(self.make("switch_entry", *own, self.take(":"), self.statements("case", "default")))
        return self.make("switch_statement", *kids, self.token())

    # -- expressions -----------------------------------------------------------------------------------------------

    def expression(self) -> Syn:
        return self.deeper(self._expression)

    def _expression(self) -> Syn:
        if self.sees("try"):
            word = self.token()
            kids = [word, self.token()] if self.sees("?", "!") and self.joined() else [word]
            return self.make("try_expression", self.make("try_operator", *kids), named("expr", self.expression()))
        if self.sees("await") and self.ahead().kind == "name":
            return self.make("await_expression", self.token(), named("expr", self.expression()))
        found = self.level(0)
        if self.sees("?") and not self.joined():
            return self.make("ternary_expression", named("condition", found), self.token(), named("if_true", self.expression()), self.take(":"), named("if_false", self.expression()))
        return found

    def level(self, n: int) -> Syn:
        if n == len(LEVELS):
            return self.prefix()
        left = self.level(n + 1)
        while True:
            t = self.now
            kind = LEVELS[n].get(t.text) if t.kind in ("sign", "name") else None
            if kind is None or t.kind == "sign" and t.fresh and self.ahead().start == t.end and t.text in ("-", "&", "<"):
                return left
            if t.text == "as":
                word = self.token()
                mark = [self.token()] if self.sees("?", "!") and self.joined() else []
                left = self.make("as_expression", named("expr", left), self.make("as_operator", Syn("as" + "".join(m.kind for m in mark), word.start, mark[0].end if mark else word.end, named=False)), named("type", self.type()))
            elif t.text == "is":
                left = self.make("check_expression", named("target", left), named("op", self.token()), named("type", self.type()))
            else:
                operator = named("op", self.token())
                if kind == "range_expression" and (self.sees("]", ")", "{", ",") or self.now.fresh):
                    left = self.make("open_end_range_expression", named("start", left), operator)
                    continue
                right = self.expression() if self.sees("try") else self.level(n + 1)
                left = self.make(BITWISE.get(t.text, kind), named("lhs", left), operator, named("rhs", right))

    def prefix(self) -> Syn:
        if self.sees("!", "-", "+", "~", "&", "...", "..<"):
            return self.deeper(lambda: self.make("prefix_expression", named("operation", Syn("bang", self.now.start, self.now.end, kids=[self.token()]) if self.sees("!") else self.token()), named("target", self.prefix())))
        if self.sees("try", "await"):
            return self._expression()
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
        if self.sees("nil"):
            return self.token()
        if self.sees("self"):
            return Syn("self_expression", t.start, t.end, kids=[self.token()])
        if self.sees("super"):
            return Syn("super_expression", t.start, t.end, kids=[self.token()])
        if self.sees("Self"):
            return self.leaf("simple_identifier")
        if t.kind == "hash":
            self.at += 1
            head = Syn(t.text, t.start, t.end, named=False)
            return self.make("selector_expression" if t.text == "#selector" else "special_literal", head, *(self.arguments().kids if self.sees("(") else []))
        if self.sees("\\"):
            kids = [self.token()]
            if self.now.kind == "name":
                kids.append(self.user_type())
            while self.sees("."):
                kids += [self.token(), self.name("any")]
            return self.make("key_path_expression", *kids)
        if self.sees("."):
            return self.make("prefix_expression", named("operation", self.token()), named("target", self.name("any")))
        if self.sees("("):
            def one() -> Syn:
                label = [named("name", self.name()), self.token()] if self.now.kind == "name" and self.ahead().text == ":" else []
                return self.make("tuple_item", *label, self.expression())

            kids = [self.token(), *self.free(lambda: self.listed(")", one)), self.take(")")]
            flat = [k for x in kids for k in (x.kids if x.kind == "tuple_item" else [x])]
            return self.make("tuple_expression", *(named("value", k) if k.named and k.field is None else k for k in flat))
        if self.sees("["):
            return self.free(self.collection)
        if self.sees("{"):
            return self.lambda_()
        if self.sees("if"):
            return self.if_()
        if self.sees("switch"):
            return self.switch()
        found = self.name()
        if self.sees("<") and (types := self.tried(self.call_types)) is not None:
            return self.make("constructor_expression", named("constructed_type", self.make("user_type", Syn("type_identifier", found.start, found.end), types)), self.make("constructor_suffix", self.arguments()))
        return found

    def call_types(self) -> Syn:
        found = self.type_arguments()
        if not self.sees("("):
            raise Broken
        return found

    def collection(self) -> Syn:
        open_ = self.token()
        if self.sees(":"):
            return self.make("dictionary_literal", open_, self.token(), self.take("]"))
        if self.sees("]"):
            return self.make("array_literal", open_, self.token())
        pairs = False

        def one() -> list[Syn]:
            nonlocal pairs
            kids = [self.expression()]
            if self.sees(":"):
                pairs = True
                kids = [named("key", kids[0]), self.token(), named("value", self.expression())]
            return Syn("several", kids[0].start, kids[-1].end, kids=kids)

        kids = self.listed("]", one)
        flat = [k for x in kids for k in (x.kids if x.kind == "several" else [x])]
        return self.make("dictionary_literal" if pairs else "array_literal", open_, *flat, self.take("]"))

    def lambda_(self) -> Syn:
        open_ = self.take("{")

        def head() -> list[Syn]:
            capture = []
            if self.sees("["):
                own = [self.token()]
                while not self.sees("]"):
                    if self.now.kind == "end":
                        raise Broken
                    own.append(self.leaf("simple_identifier") if self.now.kind == "name" and self.now.text not in ("weak", "unowned") else self.token())
                capture = [self.make("capture_list", *own, self.token())]
            if self.sees("in"):
                return [*capture, self.token()]
            if self.sees("("):
                kids = [self.make("lambda_function_type_parameters", *self.parameters())]
            else:
                names = [self.make("lambda_parameter", self.name())]
                while self.sees(","):
                    names += [self.token(), self.make("lambda_parameter", self.name())]
                kids = [self.make("lambda_function_type_parameters", *names)]
            kids += self.effects()
            if self.sees("->"):
                kids += [self.token(), self.type()]
            kind = self.make("lambda_function_type", *kids)
            return [*capture, named("type", kind), self.take("in")]

        started = self.tried(head) or []
        return self.make("lambda_literal", open_, *started, self.statements(), self.take("}"))

    def arguments(self) -> Syn:
        def one() -> Syn:
            if (self.now.kind == "name") and self.ahead().text == ":":
                return self.make("value_argument", named("name", self.make("value_argument_label", self.leaf("simple_identifier"))), self.token(), named("value", self.expression()))
            return self.make("value_argument", named("value", self.expression()))

        return self.make("value_arguments", self.take("("), *self.free(lambda: self.listed(")", one)), self.take(")"))

    def postfix(self, found: Syn) -> Syn:
        while True:
            if self.sees(".") and (self.ahead().kind in ("name", "literal")):
                dot = self.token()
                suffix = self.leaf("integer_literal") if self.now.kind == "literal" else self.leaf("simple_identifier")
                found = self.make("navigation_expression", named("target", found), named("suffix", self.make("navigation_suffix", dot, named("suffix", suffix))))
            elif self.sees("!") and self.joined() and not (self.ahead().start == self.now.end and self.ahead().text == "="):
                found = self.make("postfix_expression", named("target", found), named("operation", Syn("bang", self.now.start, self.now.end, kids=[self.token()])))
            elif self.sees("?") and self.joined() and self.ahead().text in (".", "[", "(") and self.ahead().start == self.now.end:
                found = self.make("optional_chaining_expression", found, self.token())
            elif self.sees("(") and not self.now.fresh:
                own = [self.arguments()]
                if self.sees("{") and not self.no_trailing and not self.now.fresh:
                    own.append(self.lambda_())
                found = self.make("call_expression", found, self.make("call_suffix", *own))
            elif self.sees("[") and not self.now.fresh:
                def one() -> Syn:
                    return self.make("value_argument", named("value", self.expression()))

                own = self.make("value_arguments", self.token(), *self.free(lambda: self.listed("]", one)), self.take("]"))
                found = self.make("call_expression", found, self.make("call_suffix", own))
            elif self.sees("{") and not self.no_trailing and not self.now.fresh and found.kind in ("simple_identifier", "navigation_expression"):
                found = self.make("call_expression", found, self.make("call_suffix", self.lambda_()))
            else:
                return found


def parse(source: str) -> Syn:
    parser = _Swift(source)
    return with_comments(parser.file(), parser.comments)
