"""Go: statements may stand at the top of a file, as fragments do."""

from __future__ import annotations

import re

from .code import Broken, Parser, Token, named, with_comments
from .tree import Syn

LEX = re.compile(
    r"(?P<space>[ \t\r﻿]+)|(?P<newline>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<name>[^\W\d]\w*)|"
    r"(?P<imaginary>(?:\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d+)i)|(?P<float>0[xX][\da-fA-F_]*\.?[\da-fA-F_]*[pP][+-]?\d+|\d[\d_]*\.[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*[eE][+-]?\d+|\.\d[\d_]*(?:[eE][+-]?\d+)?)|"
    r"(?P<int>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\")|(?P<raw>`[^`]*`)|(?P<rune>'(?:\\.[^']*|[^'\\\n])')|"
    r"(?P<sign><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])|(?P<bad>.)",
    re.S,
)
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
#: A line feed ends a statement after these, and after names and literals.
ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
LITERALS = {"int": "int_literal", "float": "float_literal", "imaginary": "imaginary_literal", "rune": "rune_literal", "string": "interpreted_string_literal", "raw": "raw_string_literal"}
LEVELS = [dict.fromkeys(x.split(), "binary_expression") for x in ("||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^")]
ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=")


def _tokens(source: str) -> tuple[list[Token], list[Syn]]:
    tokens: list[Token] = []
    comments: list[Syn] = []

    def end_line(at: int) -> None:
        if tokens and (tokens[-1].kind in ("name", "number", "string") and tokens[-1].text not in KEYWORDS or tokens[-1].text in ENDS):
            tokens.append(Token("line", "\n", at, at))

    for m in LEX.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "newline":
            end_line(m.start())
        elif kind == "comment":
            comments.append(Syn("comment", m.start(), m.end(), extra=True))
            if "\n" in text:
                end_line(m.start())
        else:
            tokens.append(Token("string" if kind in ("string", "raw", "rune") else "number" if kind in LITERALS else "name" if kind == "name" else "sign", text, m.start(), m.end()))
            if kind in LITERALS:
                tokens[-1].text = kind  # its kind of literal; the text is the source's
    end_line(len(source))
    tokens.append(Token("end", "", len(source), len(source)))
    return tokens, comments


class _Go(Parser):
    keywords = KEYWORDS
    plain = False  # in the head of a statement, where { opens its body

    # -- files -----------------------------------------------------------------------------------------------------

    def file(self) -> Syn:
        root = Syn("source_file", 0, len(self.source))
        while self.now.kind != "end":
            if self.sees("\n", ";"):
                self.at += 1
                continue
            root.add(self.recovered(self.top, lambda t: t.kind == "line" or t.text == ";"))
        return root

    def top(self) -> Syn:
        found = self.top_level()
        if self.now.kind != "end" and not self.sees("\n", ";"):
            raise Broken
        return found

    def top_level(self) -> Syn:
        if self.sees("package"):
            return self.make("package_clause", self.token(), self.identifier("package_identifier"))
        if self.sees("import"):
            return self.make("import_declaration", self.token(), self.grouped("import_spec_list", self.import_spec))
        if self.sees("func") and (self.ahead().kind == "name" or self.ahead().text == "(" and self.tried_method()):
            return self.function()
        return self.statement()

    def tried_method(self) -> bool:
        """Whether a name follows the first list of parameters, as in a method."""
        at, open_ = self.at + 1, 0
        while self.tokens[at].kind != "end":
            open_ += self.tokens[at].text == "("
            open_ -= self.tokens[at].text == ")"
            at += 1
            if not open_:
                return self.tokens[at].kind == "name" and self.tokens[at].text not in KEYWORDS and self.tokens[at + 1].text == "("
        return False

    def grouped(self, kind: str | None, one) -> Syn | list[Syn]:
        if not self.sees("("):
            return one()
        kids = [self.token()]
        while not self.sees(")"):
            if not self.accept("\n", ";"):
                kids.append(one())
        kids.append(self.take(")"))
        return self.make(kind, *kids)

    def import_spec(self) -> Syn:
        name = self.leaf("dot") if self.sees(".") else self.identifier("blank_identifier" if self.now.text == "_" else "package_identifier") if self.now.kind == "name" else None
        return self.make("import_spec", named("name", name), named("path", self.literal()))

    def function(self) -> Syn:
        kids = [self.token()]
        method = self.sees("(")
        if method:
            kids.append(named("receiver", self.parameters()))
        kids.append(named("name", self.identifier("field_identifier" if method else "identifier")))
        if self.sees("["):
            kids.append(named("type_parameters", self.type_parameters()))
        kids += self.signature()
        if self.sees("{"):
            kids.append(named("body", self.block()))
        return self.make("method_declaration" if method else "function_declaration", *kids)

    def signature(self) -> list[Syn]:
        kids = [named("parameters", self.parameters())]
        if self.sees("("):
            kids.append(named("result", self.parameters()))
        elif result := self.tried(self.type):
            kids.append(named("result", result))
        return kids

    def type_parameters(self) -> Syn:
        def one() -> Syn:
            names = [named("name", self.identifier())]
            while self.sees(","):
                names += [self.token(), named("name", self.identifier())]
            kids = [named("type", self.make("type_constraint", *self.union()))]
            return self.make("type_parameter_declaration", *names, *kids)

        return self.make("type_parameter_list", self.take("["), *self.listed("]", one), self.take("]"))

    def union(self) -> list[Syn]:
        kids = [self.constraint()]
        while self.sees("|"):
            kids += [self.token(), self.constraint()]
        return kids

    def constraint(self) -> Syn:
        return self.make("negated_type", self.token(), self.type()) if self.sees("~") else self.type()

    def parameters(self) -> Syn:
        open_ = self.take("(")
        entries: list[tuple[list[Syn], Syn | None]] = []  # what was read, and the comma after it

        def entry() -> list[Syn]:
            if self.sees("..."):
                return [self.token(), self.type()]
            first = self.type()
            if self.sees(",", ")"):
                return [first]
            if first.kind != "type_identifier":
                raise Broken
            return [Syn("identifier", first.start, first.end), *([self.token()] if self.sees("...") else []), self.type()]

        while not self.sees(")"):
            while self.accept("\n"):
                pass
            found = entry()
            comma = None if self.sees(")") else self.take(",")
            entries.append((found, comma))
            while self.accept("\n"):
                pass
        close = self.take(")")
        kids: list[Syn] = [open_]
        with_names = any(len(e) > 1 and e[0].named for e, _ in entries)
        names: list[Syn] = []
        for found, comma in entries:
            if with_names and len(found) == 1:
                names.append(named("name", Syn("identifier", found[0].start, found[0].end)))
                names += [comma] if comma else []
                continue
            dots = any(not k.named for k in found)
            own = [named("name", k) if k.kind == "identifier" and len(found) > 1 and k is found[0] and k.named else named("type", k) if k is found[-1] else k for k in found]
            kids.append(self.make("variadic_parameter_declaration" if dots else "parameter_declaration", *names, *own))
            names = []
            kids += [comma] if comma else []
        if names:
            raise Broken
        return self.make("parameter_list", *kids, close)

    # -- types -----------------------------------------------------------------------------------------------------

    def type(self) -> Syn:
        return self.deeper(self._type)

    def _type(self) -> Syn:
        if self.now.kind == "name" and self.now.text not in KEYWORDS:
            if self.ahead().text == "." and self.ahead(2).kind == "name":
                found = self.make("qualified_type", named("package", self.identifier("package_identifier")), self.token(), named("name", self.identifier("type_identifier")))
            else:
                found = self.identifier("type_identifier")
            if self.sees("[") and self.ahead().text != "]" and (arguments := self.tried(self.type_arguments)):
                found = self.make("generic_type", named("type", found), named("type_arguments", arguments))
            return found
        if self.sees("*"):
            return self.make("pointer_type", self.token(), self.type())
        if self.sees("("):
            return self.make("parenthesized_type", self.token(), self.type(), self.take(")"))
        if self.sees("["):
            open_ = self.token()
            if self.sees("]"):
                return self.make("slice_type", open_, self.token(), named("element", self.type()))
            if self.sees("..."):
                return self.make("implicit_length_array_type", open_, self.token(), self.take("]"), named("element", self.type()))
            return self.make("array_type", open_, named("length", self.free(self.expression)), self.take("]"), named("element", self.type()))
        if self.sees("map"):
            return self.make("map_type", self.token(), self.take("["), named("key", self.type()), self.take("]"), named("value", self.type()))
        if self.sees("chan"):
            return self.make("channel_type", self.token(), self.accept("<-"), named("value", self.type()))
        if self.sees("<-"):
            return self.make("channel_type", self.token(), self.take("chan"), named("value", self.type()))
        if self.sees("func"):
            return self.make("function_type", self.token(), *self.signature())
        if self.sees("struct"):
            return self.make("struct_type", self.token(), self.fields())
        if self.sees("interface"):
            return self.make("interface_type", self.token(), *self.methods())
        raise Broken

    def type_arguments(self) -> Syn:
        return self.make("type_arguments", self.take("["), *self.listed("]", self.type), self.take("]"))

    def fields(self) -> Syn:
        kids = [self.take("{")]
        while not self.sees("}"):
            if self.accept("\n", ";"):
                continue
            own: list[Syn] = []
            if self.now.kind == "name" and self.ahead().text not in (".", "\n", ";", "}") and self.ahead().kind != "string":
                own.append(named("name", self.identifier("field_identifier")))
                while self.sees(","):
                    own += [self.token(), named("name", self.identifier("field_identifier"))]
            own.append(named("type", self.type()))
            if self.now.kind == "string":
                own.append(named("tag", self.literal()))
            kids.append(self.make("field_declaration", *own))
        return self.make("field_declaration_list", *kids, self.take("}"))

    def methods(self) -> list[Syn]:
        kids = [self.take("{")]
        while not self.sees("}"):
            if self.accept("\n", ";"):
                continue
            if self.now.kind == "name" and self.ahead().text == "(":
                kids.append(self.make("method_spec", named("name", self.identifier("field_identifier")), *self.signature()))
            else:
                kids.append(self.make("constraint_elem", *self.union()))
        return [*kids, self.take("}")]

    # -- statements ------------------------------------------------------------------------------------------------

    def block(self) -> Syn:
        return self.deeper(lambda: self.make("block", self.take("{"), *self.statements("}"), self.take("}")))

    def statements(self, *until: str) -> list[Syn]:
        found: list[Syn] = []
        plain, self.plain = self.plain, False
        while not self.sees(*until) and self.now.kind != "end":
            if self.sees("\n"):
                self.at += 1
            elif self.sees(";"):
                found.append(self.token())
            else:
                found.append(self.recovered(lambda: self.ended(until), lambda t: t.kind == "line" or t.text == ";"))
        self.plain = plain
        return found

    def ended(self, until: tuple[str, ...]) -> Syn:
        found = self.statement()
        if not self.sees("\n", ";", *until) and self.now.kind != "end":
            raise Broken
        return found

    def statement(self) -> Syn:
        word = self.now.text if self.now.kind in ("name", "sign") else ""
        if word in ("var", "const", "type"):
            return self.declaration(word)
        if word == "return":
            return self.make("return_statement", self.token(), None if self.sees("\n", ";", "}") or self.now.kind == "end" else self.expressions())
        if word in ("go", "defer"):
            return self.make(f"{word}_statement", self.token(), self.expression())
        if word in ("break", "continue", "goto"):
            return self.make(f"{word}_statement", self.token(), self.identifier("label_name") if self.now.kind == "name" else None)
        if word == "fallthrough":
            return self.make("fallthrough_statement", self.token())
        if word == "if":
            return self.deeper(self.if_)
        if word == "for":
            return self.deeper(self.for_)
        if word == "switch":
            return self.deeper(self.switch)
        if word == "select":
            return self.make("select_statement", self.token(), self.take("{"), *self.cases("communication_case"), self.take("}"))
        if word == "{":
            return self.block()
        if self.now.kind == "name" and self.ahead().text == ":" and word not in KEYWORDS:
            label = named("label", self.identifier("label_name"))
            colon = self.token()
            while self.accept("\n"):
                pass
            return self.make("labeled_statement", label, colon, None if self.sees("}") else self.statement())
        return self.simple()

    def simple(self) -> Syn:
        left = self.expressions()
        if self.sees(":="):
            return self.make("short_var_declaration", named("left", left), self.token(), named("right", self.expressions()))
        if self.sees(*ASSIGN):
            return self.make("assignment_statement", named("left", left), named("operator", self.token()), named("right", self.expressions()))
        if len(left.kids) > 1:
            raise Broken
        one = left.kids[0]
        if self.sees("++", "--"):
            sign = self.token()
            return self.make("inc_statement" if sign.kind == "++" else "dec_statement", one, sign)
        if self.sees("<-"):
            return self.make("send_statement", named("channel", one), self.token(), named("value", self.expression()))
        return self.make("expression_statement", one)

    def declaration(self, word: str) -> Syn:
        keyword = self.token()
        one = {"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[word]
        if not self.sees("("):
            return self.make(f"{word}_declaration", keyword, one())
        kids = [self.token()]
        while not self.sees(")"):
            if not self.accept("\n", ";"):
                kids.append(one())
        return self.make(f"{word}_declaration", keyword, *kids, self.take(")"))

    def names(self) -> list[Syn]:
        kids = [named("name", self.identifier())]
        while self.sees(","):
            kids += [self.token(), named("name", self.identifier())]
        return kids

    def var_spec(self, kind: str = "var_spec") -> Syn:
        kids = self.names()
        if not self.sees("=", "\n", ";", ")") and self.now.kind != "end":
            kids.append(named("type", self.type()))
        if self.sees("="):
            kids += [self.token(), named("value", self.expressions())]
        return self.make(kind, *kids)

    def const_spec(self) -> Syn:
        return self.var_spec("const_spec")

    def type_spec(self) -> Syn:
        name = named("name", self.identifier("type_identifier"))
        if self.sees("="):
            return self.make("type_alias", name, self.token(), named("type", self.type()))
        parameters = self.tried(lambda: named("type_parameters", self.type_parameters())) if self.sees("[") and self.ahead().kind == "name" else None
        return self.make("type_spec", name, parameters, named("type", self.type()))

    def headed(self, parse):
        """What ``parse`` reads in a statement's head, where a brace opens the body."""
        plain, self.plain = self.plain, True
        found = parse()
        self.plain = plain
        return found

    def free(self, parse):
        plain, self.plain = self.plain, False
        found = parse()
        self.plain = plain
        return found

    def if_(self) -> Syn:
        kids = [self.token()]
        first = self.headed(lambda: self.simple() if not self.sees(";") else None)
        if self.sees(";"):
            kids += [named("initializer", first), self.token()]
            first = self.headed(self.simple)
        if first is None or first.kind != "expression_statement":
            raise Broken
        kids += [named("condition", first.kids[0]), named("consequence", self.block())]
        if self.sees("else"):
            kids.append(self.token())
            kids.append(named("alternative", self.deeper(self.if_) if self.sees("if") else self.block()))
        return self.make("if_statement", *kids)

    def range_(self) -> Syn | None:
        kids: list[Syn] = []
        if not self.sees("range"):
            kids += [named("left", self.expressions()), self.take(":=", "=")]
        return self.make("range_clause", *kids, self.take("range"), named("right", self.expression()))

    def for_(self) -> Syn:
        kids = [self.token()]
        if not self.sees("{"):
            head = self.headed(lambda: self.tried(self.range_))
            if head is None:
                first = None if self.sees(";") else self.headed(self.simple)
                if self.sees(";"):
                    parts = [named("initializer", first), self.token()]
                    if not self.sees(";"):
                        condition = self.headed(self.simple)
                        if condition.kind != "expression_statement":
                            raise Broken
                        parts.append(named("condition", condition.kids[0]))
                    parts.append(self.take(";"))
                    if not self.sees("{"):
                        parts.append(named("update", self.headed(self.simple)))
                    head = self.make("for_clause", *parts)
                elif first is not None and first.kind == "expression_statement":
                    head = first.kids[0]
                else:
                    raise Broken
            kids.append(head)
        return self.make("for_statement", *kids, named("body", self.block()))

    def switch(self) -> Syn:
        kids = [self.token()]
        type_switch = False
        if not self.sees("{"):
            first = None if self.sees(";") else self.headed(self.simple)
            if self.sees(";"):
                kids += [named("initializer", first), self.token()]
                first = None if self.sees("{") else self.headed(self.simple)
            if first is not None:
                value = first
                if first.kind == "short_var_declaration":
                    value = first.kids[2].kids[0]
                elif first.kind == "expression_statement":
                    value = first.kids[0]
                type_switch = value.kind == "type_switch_guard"
                if type_switch:
                    if first.kind == "short_var_declaration":
                        kids += [named("alias", first.kids[0]), first.kids[1]]
                    kids += [named("value", value.kids[0]), *value.kids[1:]]
                elif first.kind == "expression_statement":
                    kids.append(named("value", value))
                else:
                    raise Broken
        kids.append(self.take("{"))
        kids += self.cases("type_case" if type_switch else "expression_case")
        return self.make("type_switch_statement" if type_switch else "expression_switch_statement", *kids, self.take("}"))

    def cases(self, kind: str) -> list[Syn]:
        found: list[Syn] = []
        while not self.sees("}"):
            if self.accept("\n", ";"):
                continue
            if self.sees("default"):
                found.append(self.make("default_case", self.token(), self.take(":"), *self.statements("case", "default", "}")))
                continue
            word = self.take("case")
            if kind == "type_case":
                head = [named("type", k) if k.named else k for k in self.listed(":", lambda: self.leaf("nil") if self.sees("nil") else self.type())]
            elif kind == "communication_case":
                head = [named("communication", self.receive())]
            else:
                head = [named("value", self.expressions())]
            found.append(self.make(kind, word, *head, self.take(":"), *self.statements("case", "default", "}")))
        return found

    def receive(self) -> Syn:
        found = self.simple()
        if found.kind == "send_statement":
            return found
        if found.kind == "expression_statement":
            return self.make("receive_statement", named("right", found.kids[0]))
        if found.kind in ("short_var_declaration", "assignment_statement"):
            right = found.kids[2].kids[0]
            return self.make("receive_statement", found.kids[0], Syn(found.kids[1].kind, found.kids[1].start, found.kids[1].end, named=False), named("right", right))
        raise Broken

    # -- expressions -----------------------------------------------------------------------------------------------

    def expressions(self) -> Syn:
        kids = [self.expression()]
        while self.sees(","):
            kids += [self.token(), self.expression()]
        return self.make("expression_list", *kids)

    def expression(self) -> Syn:
        return self.deeper(lambda: self.binary(LEVELS, self.unary))

    def unary(self) -> Syn:
        if self.sees("+", "-", "!", "^", "*", "&", "<-"):
            return self.deeper(lambda: self.make("unary_expression", named("operator", self.token()), named("operand", self.unary())))
        return self.primary()

    def literal(self) -> Syn:
        if self.now.text not in LITERALS or self.now.kind not in ("number", "string"):
            raise Broken
        return self.leaf(LITERALS[self.now.text])

    def primary(self) -> Syn:
        t = self.now
        if t.kind in ("number", "string"):
            found = self.literal()
        elif t.kind == "name" and t.text not in KEYWORDS:
            found = self.leaf(t.text if t.text in ("true", "false", "nil", "iota") else "identifier")
        elif self.sees("("):
            found = self.make("parenthesized_expression", self.token(), self.free(self.expression), self.take(")"))
        elif self.sees("func"):
            word, signature = self.token(), self.signature()
            if self.sees("{"):
                found = self.make("func_literal", word, *signature, named("body", self.free(self.block)))
            else:
                found = self.make("function_type", word, *signature)
        elif self.sees("[", "map", "chan", "struct", "interface"):
            found = self.type()
            if self.sees("{"):
                found = self.make("composite_literal", named("type", found), named("body", self.free(self.elements)))
            elif self.sees("("):
                found = self.make("type_conversion_expression", named("type", found), self.token(), named("operand", self.free(self.expression)), self.accept(","), self.take(")"))
        else:
            raise Broken
        return self.postfix(found)

    def postfix(self, found: Syn) -> Syn:
        while True:
            if self.sees("("):
                found = self.make("call_expression", named("function", found), named("arguments", self.free(self.arguments)))
            elif self.sees(".") and self.ahead().text == "(":
                dot, open_ = self.token(), self.token()
                if self.sees("type"):
                    return self.make("type_switch_guard", found, dot, open_, self.token(), self.take(")"))
                found = self.make("type_assertion_expression", named("operand", found), dot, open_, named("type", self.type()), self.take(")"))
            elif self.sees("."):
                found = self.make("selector_expression", named("operand", found), self.token(), named("field", self.identifier("field_identifier")))
            elif self.sees("["):
                found = self.free(lambda: self.index(found))
            elif self.sees("{") and not self.plain and (kind := self.as_type(found)):
                found = self.make("composite_literal", named("type", kind), named("body", self.free(self.elements)))
            else:
                return found

    def as_type(self, found: Syn) -> Syn | None:
        """The type that a name stands for in front of a composite literal's body."""
        if found.kind == "identifier":
            return Syn("type_identifier", found.start, found.end)
        if found.kind == "selector_expression" and found.kids[0].kind == "identifier":
            a, dot, b = found.kids
            return self.make("qualified_type", named("package", Syn("package_identifier", a.start, a.end)), dot, named("name", Syn("type_identifier", b.start, b.end)))
        if found.kind == "index_expression" and (inner := self.as_type(found.kids[0])):
            rest = [Syn("type_identifier", k.start, k.end) if k.kind == "identifier" else k for k in found.kids[1:]]
            return self.make("generic_type", named("type", inner), named("type_arguments", self.make("type_arguments", *rest)))
        return None

    def index(self, operand: Syn) -> Syn:
        kids = [named("operand", operand), self.token()]
        if not self.sees(":"):
            kids.append(self.expression_or_type())
            if self.sees("]"):
                named("index", kids[-1])
                return self.make("index_expression", *kids, self.token())
            if self.sees(","):
                while self.sees(","):
                    kids += [self.token(), self.expression_or_type()]
                return self.make("index_expression", *kids, self.take("]"))
            named("start", kids[-1])
        kids.append(self.take(":"))
        if not self.sees("]", ":"):
            kids.append(named("end", self.expression()))
        if self.sees(":"):
            kids += [self.token(), named("capacity", self.expression())]
        return self.make("slice_expression", *kids, self.take("]"))

    def expression_or_type(self) -> Syn:
        return self.tried(self.expression) or self.type()

    def arguments(self) -> Syn:
        def one() -> Syn:
            found = self.expression_or_type()
            return self.make("variadic_argument", found, self.token()) if self.sees("...") else found

        return self.make("argument_list", self.take("("), *self.listed(")", one), self.take(")"))

    def elements(self) -> Syn:
        def value() -> Syn:
            return self.make("literal_element", self.deeper(self.elements) if self.sees("{") else self.expression())

        kids = [self.take("{")]
        while not self.sees("}"):
            if self.accept("\n"):
                continue
            item = value()
            if self.sees(":"):
                item = self.make("keyed_element", item, self.token(), value())
            kids.append(item)
            if not self.sees("}"):
                comma = self.take(",", "\n")
                kids += [comma] if comma.kind == "," else []
        return self.make("literal_value", *kids, self.take("}"))


def parse(source: str) -> Syn:
    tokens, comments = _tokens(source)
    return with_comments(_Go(source, tokens).file(), comments)
