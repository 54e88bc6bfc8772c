"""C#: members and statements may stand at the top of a file, as fragments do. Preprocessor lines are passed over."""

from __future__ import annotations

import re

from .code import Broken, Parser, Token, named, with_comments
from .tree import Syn

LEX = re.compile(
    r"(?P<space>[\s﻿]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<line>#[^\n]*)|(?P<rawtext>\"\"\".*?\"\"\")|(?P<verbatim>@\"(?:\"\"|[^\"])*\")|(?P<filled>(?:\$@|@\$|\$+)\")|(?P<string>\"(?:\\.|[^\"\\\n])*\"(?:u8)?)|(?P<char>'(?:\\[^']+|[^'\\\n])')|"
    r"(?P<name>@?[^\W\d]\w*)|(?P<real>(?:\d[\d_]*\.\d[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDmM]?|\d[\d_]*(?:[eE][+-]?\d+)[fFdDmM]?|\d[\d_]*[fFdDmM])|(?P<integer>0[xX][\da-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|\d[\d_]*[uUlL]*)|"
    r"(?P<sign><<=|\?\?=|=>|->|::|\+\+|--|&&|\|\||\?\?|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\.\.|[-+*/%&|^!~<>=?:;,.(){}\[\]])|(?P<bad>.)",
    re.S,
)
KEYWORDS = frozenset("abstract as base break case catch checked class const continue default delegate do else enum event explicit extern false finally fixed for foreach goto if implicit in interface internal is lock namespace new null operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch this throw true try typeof unchecked unsafe using virtual volatile while bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
PREDEFINED = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
MODIFIERS = frozenset("abstract async const extern file fixed internal new override partial private protected public readonly required sealed static unsafe virtual volatile".split())
LITERALS = {"integer": "integer_literal", "real": "real_literal", "char": "character_literal", "verbatim": "verbatim_string_literal", "rawtext": "raw_string_literal", "string": "string_literal"}
LEVELS = [dict.fromkeys(x.split(), "binary_expression") for x in ("??", "||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %")]
ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", "??=")
PARTS = re.compile(r"\\(?:u[\da-fA-F]{4}|x[\da-fA-F]{1,4}|.)|[^\\]+", re.S)


def _string_end(source: str, at: int) -> int:
    """Where an interpolated string ends, braces and strings in them passed over."""
    verbatim, at = "@" in source[at : at + 2], source.index('"', at) + 1
    while at < len(source):
        c = source[at]
        if c == "\\" and not verbatim or source.startswith(("{{", "}}"), at) or verbatim and source.startswith('""', at):
            at += 2
        elif c == "{":
            at = _hole_end(source, at)
        elif c == '"':
            return at + 1
        elif c == "\n" and not verbatim:
            return at
        else:
            at += 1
    return at


def _hole_end(source: str, at: int) -> int:
    depth = 0
    while at < len(source):
        m = LEX.match(source, at)
        if m.lastgroup == "filled":
            at = _string_end(source, at)
            continue
        depth += (m[0] == "{") - (m[0] == "}")
        at = m.end()
        if not depth:
            break
    return at


def _tokens(source: str, start: int = 0, stop: int | None = None) -> tuple[list[Token], list[Syn]]:
    tokens: list[Token] = []
    comments: list[Syn] = []
    at, fresh, stop = start, True, len(source) if stop is None else stop
    while at < stop:
        m = LEX.match(source, at, stop)
        kind, end = m.lastgroup, m.end()
        if kind == "filled":
            end = min(_string_end(source, at), stop)
        if kind == "space":
            fresh = fresh or "\n" in m[0]
        elif kind == "comment":
            comments.append(Syn("comment", at, end, extra=True))
        elif kind != "line":
            tokens.append(Token("literal", kind, at, end, fresh) if kind in LITERALS or kind == "filled" else Token("sign" if kind == "bad" else kind, m[0], at, end, fresh))
            fresh = False
        at = end
    tokens.append(Token("end", "", stop, stop, True))
    return tokens, comments


class _CSharp(Parser):
    keywords = KEYWORDS

    def unit(self) -> Syn:
        root = Syn("compilation_unit", 0, len(self.source))
        while self.now.kind != "end":
            root.add(self.recovered(self.top, self.starts))
        return root

    @staticmethod
    def starts(t: Token) -> bool:
        return t.fresh or t.text == ";"

    def top(self) -> Syn:
        if self.sees("using") and self.ahead().text != "(" and (found := self.tried(self.using)) is not None:
            return found
        if self.sees("namespace"):
            kids = [self.token(), named("name", self.name())]
            return self.make("file_scoped_namespace_declaration", *kids, self.token()) if self.sees(";") else self.make("namespace_declaration", *kids, named("body", self.declarations()))
        if (found := self.tried(self.member)) is not None and found.kind not in ("field_declaration", "method_declaration"):
            return found
        if found is not None and any(k.kind == "modifier" for k in found.kids):
            return found
        if found is not None:  # without modifiers it's a statement of the program
            kind = "local_function_statement" if found.kind == "method_declaration" else "local_declaration_statement"
            return self.make("global_statement", Syn(kind, found.start, found.end, kids=found.kids))
        return self.make("global_statement", self.statement())

    def using(self) -> Syn:
        kids = [self.accept("global"), self.token(), self.accept("static")]
        if self.now.kind == "name" and self.ahead().text == "=":
            kids += [named("name", self.identifier()), self.token()]
        return self.make("using_directive", *kids, self.name(), self.take(";"))

    def declarations(self) -> Syn:
        kids = [self.take("{")]
        while not self.sees("}") and self.now.kind != "end":
            kids.append(self.recovered(lambda: self.top() if self.sees("namespace") else self.member(), self.starts))
        return self.make("declaration_list", *kids, self.take("}"), self.accept(";"))

    # -- members ---------------------------------------------------------------------------------------------------

    def attributes(self) -> list[Syn]:
        found = []
        while self.sees("["):
            open_ = self.token()
            if self.now.kind == "name" and self.ahead().text == ":":
                self.at += 2

            def one() -> Syn:
                return self.make("attribute", named("name", self.name()), self.make("attribute_argument_list", *self.arguments().kids) if self.sees("(") else None)

            found.append(self.make("attribute_list", open_, *self.listed("]", one), self.take("]")))
        return found

    def modifiers(self) -> list[Syn]:
        found = []
        while self.now.kind == "name" and self.now.text in MODIFIERS and self.ahead().text not in ("=", ";", ",", ")", "(", "."):
            found.append(Syn("modifier", self.now.start, self.now.end, kids=[self.token()]))
        return found

    def member(self) -> Syn:
        before = [*self.attributes(), *self.modifiers()]
        word = self.now.text if self.now.kind == "name" else ""
        if word in ("class", "struct", "interface") or word == "record" and self.ahead().kind == "name":
            kids = [*before, self.token(), self.accept("struct", "class") if word == "record" else None, named("name", self.identifier()), self.type_parameters()]
            if self.sees("("):
                kids.append(named("parameters", self.parameters()))
            kids += [self.bases(), *self.constraints()]
            return self.make(f"{word}_declaration", *kids, self.token() if self.sees(";") else named("body", self.declarations()))
        if word == "enum":
            def one() -> Syn:
                self.attributes()
                name = named("name", self.identifier())
                return self.make("enum_member_declaration", name, self.token(), named("value", self.expression())) if self.sees("=") else self.make("enum_member_declaration", name)

            kids = [*before, self.token(), named("name", self.identifier()), self.bases()]
            return self.make("enum_declaration", *kids, named("body", self.make("enum_member_declaration_list", self.take("{"), *self.listed("}", one), self.take("}"))), self.accept(";"))
        if word == "delegate" and self.ahead().text not in ("(", "{"):
            kids = [*before, self.token(), named("type", self.type()), named("name", self.identifier()), self.type_parameters(), named("parameters", self.parameters()), *self.constraints()]
            return self.make("delegate_declaration", *kids, self.take(";"))
        if self.sees("~"):
            return self.make("destructor_declaration", *before, self.token(), named("name", self.identifier()), named("parameters", self.parameters()), *self.body())
        if word == "event":
            return self.make("event_field_declaration", *before, self.token(), self.variables(), self.take(";"))
        if self.now.kind == "name" and self.ahead().text == "(" and word not in KEYWORDS:
            kids = [*before, named("name", self.identifier()), named("parameters", self.parameters())]
            if self.sees(":"):
                kids.append(self.make("constructor_initializer", self.token(), self.take("base", "this"), self.arguments()))
            return self.make("constructor_declaration", *kids, *self.body())
        at = self.at
        kind = named("type", self.type())
        if self.sees("operator") or kind.kind == "identifier" and self.source[kind.start : kind.end] in ("implicit", "explicit"):
            kids = [self.take("operator")]
            kids.append(self.token())
            return self.make("operator_declaration", *before, kind, *kids, named("parameters", self.parameters()), *self.body())
        if self.sees("this") and self.ahead().text == "[":
            kids = [self.token(), self.make("bracketed_parameter_list", self.take("["), *self.listed("]", self.parameter), self.take("]"))]
            return self.make("indexer_declaration", *before, kind, *kids, *self.accessors())
        if self.now.kind != "name":
            raise Broken
        dotted = []
        while self.ahead().text == "." and self.now.kind == "name":
            dotted += [self.identifier(), self.token()]
        name = named("name", self.identifier())
        types = self.type_parameters()
        if self.sees("("):
            kids = [*before, named("returns", kind), *dotted, name, types, named("parameters", self.parameters()), *self.constraints()]
            return self.make("method_declaration", *kids, *self.body())
        if self.sees("{", "=>"):
            return self.make("property_declaration", *before, kind, *dotted, name, *self.accessors())
        self.at = at
        return self.make("field_declaration", *before, self.variables(), self.take(";"))

    def body(self) -> list[Syn]:
        if self.sees(";"):
            return [self.token()]
        if self.sees("=>"):
            return [named("body", self.make("arrow_expression_clause", self.token(), self.expression())), self.take(";")]
        return [named("body", self.block())]

    def accessors(self) -> list[Syn]:
        if self.sees("=>"):
            return [named("value", self.make("arrow_expression_clause", self.token(), self.expression())), self.take(";")]
        kids = [self.take("{")]
        while not self.sees("}"):
            own = [*self.attributes(), *self.modifiers(), named("name", self.take("get", "set", "init", "add", "remove"))]
            kids.append(self.make("accessor_declaration", *own, *self.body()))
        found = [named("accessors", self.make("accessor_list", *kids, self.token()))]
        if self.sees("="):
            found += [self.token(), named("value", self.expression()), self.take(";")]
        return found

    def bases(self) -> Syn | None:
        if not self.sees(":"):
            return None
        kids = [self.token(), self.type()]
        while self.sees(",", "("):
            kids += [self.token(), self.type()] if self.sees(",") else [self.arguments()]
        return self.make("base_list", *kids)

    def type_parameters(self) -> Syn | None:
        if not self.sees("<"):
            return None

        def one() -> Syn:
            self.attributes()
            return self.make("type_parameter", self.accept("in", "out"), named("name", self.identifier()))

        return named("type_parameters", self.make("type_parameter_list", self.token(), *self.listed(">", one), self.take(">")))

    def constraints(self) -> list[Syn]:
        found = []
        while self.now.text == "where" and self.now.kind == "name":
            kids = [self.token(), self.identifier(), self.take(":")]
            while not self.sees("{", ";", "=>", "where"):
                if self.sees(","):
                    kids.append(self.token())
                elif self.sees("new"):
                    kids.append(self.make("constructor_constraint", self.token(), self.take("("), self.take(")")))
                else:
                    kids.append(self.make("type_parameter_constraint", self.token() if self.sees("class", "struct", "default") else self.type()))
                    self.accept("?")
            found.append(self.make("type_parameter_constraints_clause", *kids))
        return found

    def parameters(self) -> Syn:
        return self.make("parameter_list", self.take("("), *self.listed(")", self.parameter), self.take(")"))

    def parameter(self) -> Syn:
        kids = self.attributes()
        while self.sees("ref", "out", "in", "params", "this", "scoped", "readonly"):
            kids.append(Syn("modifier", self.now.start, self.now.end, kids=[self.token()]))
        if self.now.kind == "name" and self.now.text not in KEYWORDS and self.ahead().text in (",", ")"):
            return self.make("parameter", *kids, named("name", self.identifier()))
        kids += [named("type", self.type()), named("name", self.identifier())]
        return self.make("parameter", *kids, self.token(), self.expression()) if self.sees("=") else self.make("parameter", *kids)

    def variables(self) -> Syn:
        kids = [named("type", self.type())]

        def one() -> Syn:
            name = named("name", self.identifier())
            return self.make("variable_declarator", name, self.token(), self.initializer() if self.sees("{") else self.expression()) if self.sees("=") else self.make("variable_declarator", name)

        kids.append(one())
        while self.sees(","):
            kids += [self.token(), one()]
        return self.make("variable_declaration", *kids)

    # -- names and types -------------------------------------------------------------------------------------------

    def name(self) -> Syn:
        found = self.simple_name()
        while self.sees(".", "::"):
            found = self.make("qualified_name", named("qualifier", found), self.token(), named("name", self.simple_name()))
        return found

    def simple_name(self) -> Syn:
        found = self.identifier()
        if self.sees("<") and (arguments := self.tried(self.type_arguments)) is not None:
            return self.make("generic_name", found, arguments)
        return found

    def type_arguments(self) -> Syn:
        open_ = self.take("<")
        if self.sees(">", ","):
            kids = []
            while self.sees(","):
                kids.append(self.token())
            return self.make("type_argument_list", open_, *kids, self.take(">"))
        return self.make("type_argument_list", open_, *self.listed(">", self.type), self.take(">"))

    def type(self) -> Syn:
        return self.deeper(self._type)

    def _type(self) -> Syn:
        if self.sees("ref"):
            return self.make("ref_type", self.token(), self.accept("readonly"), self.type())
        t = self.now
        if t.kind == "name" and t.text in PREDEFINED:
            found = self.leaf("predefined_type")
        elif self.sees("("):
            def element() -> Syn:
                return self.make("tuple_element", named("type", self.type()), named("name", self.identifier()) if self.now.kind == "name" else None)

            found = self.make("tuple_type", self.token(), element(), self.take(","), *self.listed(")", element), self.take(")"))
        elif t.text == "var" and t.kind == "name" and self.ahead().kind == "name":
            found = Syn("implicit_type", t.start, t.end, kids=[self.token()])
        else:
            found = self.name()
        while True:
            if self.sees("?") and (self.ahead().kind == "name" or self.ahead().text in (")", ",", ">", "[", "{", ";", "=", "(")) and self.ahead().kind != "literal":
                found = self.make("nullable_type", named("type", found), self.token())
            elif self.sees("[") and self.ahead().text in ("]", ","):
                kids = [self.token()]
                while self.sees(","):
                    kids.append(self.token())
                found = self.make("array_type", named("type", found), named("rank", self.make("array_rank_specifier", *kids, self.take("]"))))
            elif self.sees("*") and found.kind == "predefined_type":
                found = self.make("pointer_type", named("type", found), self.token())
            else:
                return found

    # -- statements ------------------------------------------------------------------------------------------------

    def block(self) -> Syn:
        def inside() -> Syn:
            kids = [self.take("{")]
            while not self.sees("}") and self.now.kind != "end":
                kids.append(self.recovered(self.statement, self.starts))
            return self.make("block", *kids, self.take("}"))

        return self.deeper(inside)

    def statement(self) -> Syn:
        return self.deeper(self._statement)

    def _statement(self) -> Syn:
        word = self.now.text if self.now.kind in ("name", "sign") else ""
        after = self.ahead()
        condition = lambda field="condition": [self.take("("), named(field, self.expression()), self.take(")")]
        if word == "{":
            return self.block()
        if word == ";":
            return self.make("empty_statement", self.token())
        if word == "if":
            kids = [self.token(), *condition(), named("consequence", self.statement())]
            if self.sees("else"):
                kids += [self.token(), named("alternative", self.statement())]
            return self.make("if_statement", *kids)
        if word == "while":
            return self.make("while_statement", self.token(), *condition(), named("body", self.statement()))
        if word == "do":
            return self.make("do_statement", self.token(), named("body", self.statement()), self.take("while"), *condition(), self.take(";"))
        if word == "for":
            kids = [self.token(), self.take("(")]
            if not self.sees(";"):
                kids.append(named("initializer", self.tried(self.declared) or self.expression()))
            kids += [self.take(";"), None if self.sees(";") else named("condition", self.expression()), self.take(";")]
            kids += [named("update", k) if k.named else k for k in self.listed(")", self.expression)]
            return self.make("for_statement", *kids, self.take(")"), named("body", self.statement()))
        if word == "foreach" or word == "await" and after.text == "foreach":
            kids = [self.accept("await"), self.token(), self.take("("), named("type", self.type()), named("left", self.identifier() if self.now.kind == "name" else self.expression()), self.take("in"), named("right", self.expression()), self.take(")")]
            return self.make("foreach_statement", *kids, named("body", self.statement()))
        if word in ("lock", "fixed") and after.text == "(":
            inside = self.token(), self.take("("), self.declared() if word == "fixed" else self.expression(), self.take(")")
            return self.make(f"{word}_statement", *inside, named("body", self.statement()))
        if word in ("checked", "unchecked", "unsafe") and after.text == "{":
            return self.make("unsafe_statement" if word == "unsafe" else "checked_statement", self.token(), self.block())
        if word in ("using", "await") and (after.text == "(" and word == "using" or after.text == "using" and self.ahead(2).text == "("):
            kids = [self.accept("await"), self.token(), self.take("("), self.tried(self.declared) or self.expression(), self.take(")")]
            return self.make("using_statement", *kids, named("body", self.statement()))
        if word == "using" or word == "await" and after.text == "using":
            return self.make("local_declaration_statement", self.accept("await"), self.token(), self.declared(), self.take(";"))
        if word in ("return", "throw"):
            return self.make(f"{word}_statement", self.token(), None if self.sees(";") else self.expression(), self.take(";"))
        if word == "yield" and after.text in ("return", "break"):
            kids = [self.token(), self.token()]
            return self.make("yield_statement", *kids, None if self.sees(";") else self.expression(), self.take(";"))
        if word in ("break", "continue"):
            return self.make(f"{word}_statement", self.token(), self.take(";"))
        if word == "goto":
            return self.make("goto_statement", self.token(), self.accept("case", "default"), None if self.sees(";") else self.expression(), self.take(";"))
        if word == "try":
            kids = [self.token(), named("body", self.block())]
            while self.sees("catch"):
                own = [self.token()]
                if self.sees("("):
                    own.append(self.make("catch_declaration", self.token(), named("type", self.type()), named("name", self.identifier()) if self.now.kind == "name" else None, self.take(")")))
                if self.now.text == "when":
                    own.append(self.make("catch_filter_clause", self.token(), *condition("")))
                kids.append(self.make("catch_clause", *own, named("body", self.block())))
            if self.sees("finally"):
                kids.append(self.make("finally_clause", self.token(), self.block()))
            return self.make("try_statement", *kids)
        if word == "switch":
            kids = [self.token(), *condition("value")]
            body = [self.take("{")]
            while not self.sees("}"):
                section = []
                while self.sees("case", "default"):
                    section.append(self.token())
                    if section[-1].kind == "case":
                        section.append(self.pattern())
                        if self.now.text == "when":
                            section.append(self.make("when_clause", self.token(), self.expression()))
                    section.append(self.take(":"))
                if not section:
                    raise Broken
                while not self.sees("case", "default", "}") and self.now.kind != "end":
                    section.append(self.recovered(self.statement, self.starts))
                body.append(self.make("switch_section", *section))
            return self.make("switch_statement", *kids, named("body", self.make("switch_body", *body, self.take("}"))))
        if self.now.kind == "name" and after.text == ":" and word not in KEYWORDS:
            return self.make("labeled_statement", self.identifier(), self.token(), self.statement())
        return self.tried(self.local) or self.tried(self.function) or self.expressed()

    def expressed(self) -> Syn:
        found = self.expression()
        return self.make("expression_statement", found, None if found.kind == "identifier" and self.sees("}") else self.take(";"))

    def declared(self) -> Syn:
        found = self.variables()
        if self.sees("in", "("):
            raise Broken
        return found

    def local(self) -> Syn:
        before = [Syn("modifier", self.now.start, self.now.end, kids=[self.token()])] if self.sees("const", "scoped") else []
        return self.make("local_declaration_statement", *before, self.variables(), self.take(";"))

    def function(self) -> Syn:
        kids = [*self.attributes(), *self.modifiers(), named("type", self.type()), named("name", self.identifier()), self.type_parameters(), named("parameters", self.parameters()), *self.constraints()]
        return self.make("local_function_statement", *kids, *self.body())

    # -- expressions -----------------------------------------------------------------------------------------------

    def expression(self) -> Syn:
        return self.deeper(self._expression)

    def _expression(self) -> Syn:
        if self.sees("throw"):
            return self.make("throw_expression", self.token(), self.expression())
        if self.sees("ref"):
            return self.make("ref_expression", self.token(), self.expression())
        if (self.sees("(", "async", "static", "delegate") or self.now.kind == "name" and self.ahead().text == "=>") and (found := self.tried(self.lambda_)) is not None:
            return found
        left = self.ternary()
        if self.sees(*ASSIGN) or self.sees(">") and self.ahead().text in (">=", ">") and self.ahead().start == self.now.end and self.ahead(1 + (self.ahead().text == ">")).text == ">=":
            operator = self.token()
            while operator.kind == ">" and self.now.start == operator.end or operator.kind == ">>" and self.now.start == operator.end:
                more = self.token()
                operator = Syn(operator.kind + more.kind, operator.start, more.end, named=False)
                if operator.kind.endswith("="):
                    break
            return self.make("assignment_expression", named("left", left), named("operator", operator), named("right", self.initializer() if self.sees("{") else self.expression()))
        return left

    def lambda_(self) -> Syn:
        before = []
        while self.sees("async", "static"):
            before.append(Syn("modifier", self.now.start, self.now.end, kids=[self.token()]))
        if self.sees("delegate"):
            return self.make("anonymous_method_expression", *before, self.token(), named("parameters", self.parameters()) if self.sees("(") else None, self.block())
        parameters = self.parameters() if self.sees("(") else Syn("implicit_parameter", self.now.start, self.now.end, kids=[]) if self.now.kind == "name" else None
        if parameters is None:
            raise Broken
        if parameters.kind == "implicit_parameter":
            self.identifier()
        return self.make("lambda_expression", *before, named("parameters", parameters), self.take("=>"), named("body", self.block() if self.sees("{") else self.expression()))

    def ternary(self) -> Syn:
        found = self.binary(LEVELS, self.unary)
        if self.sees("?") and self.ahead().text not in (".", "["):
            return self.make("conditional_expression", named("condition", found), self.token(), named("consequence", self.expression()), self.take(":"), named("alternative", self.expression()))
        return found

    def binary(self, levels: list[dict[str, str]], operand, level: int = 0) -> Syn:
        if level == len(levels):
            found = operand()
            if self.sees("..") and not self.sees("]"):
                found = self.make("range_expression", found, self.token(), None if self.sees("]", ")") else operand())
            return found
        left = self.binary(levels, operand, level + 1)
        while self.now.kind in ("sign", "name"):
            if ">" in levels[level] and self.sees("is", "as"):
                word = self.token()
                if word.kind == "as":
                    left = self.make("as_expression", named("left", left), named("operator", word), named("right", self.type()))
                    continue
                pattern = self.pattern()
                plain = pattern.kind in ("identifier", "predefined_type", "qualified_name", "generic_name", "nullable_type", "array_type")
                left = self.make("is_expression", named("left", left), named("operator", word), named("right", pattern)) if plain else self.make("is_pattern_expression", named("expression", left), word, named("pattern", pattern))
                continue
            touching = self.now.text == ">" and self.ahead().start == self.now.end and self.ahead().text in (">", ">=")
            if touching and (self.ahead().text == ">=" or self.ahead(2).text == ">="):
                break
            text = ">>" if touching else self.now.text
            if text not in levels[level]:
                break
            operator = self.token()
            if touching:
                operator = Syn(">>", operator.start, self.token().end, named=False)
            right = self.make("throw_expression", self.token(), self.expression()) if self.sees("throw") else self.binary(levels, operand, level + 1)
            left = self.make("binary_expression", named("left", left), named("operator", operator), named("right", right))
        return left

    def pattern(self) -> Syn:
        left = self.and_pattern()
        while self.now.text == "or" and self.now.kind == "name":
            left = self.make("or_pattern", named("left", left), named("operator", self.token()), named("right", self.and_pattern()))
        return left

    def and_pattern(self) -> Syn:
        left = self.one_pattern()
        while self.now.text == "and" and self.now.kind == "name":
            left = self.make("and_pattern", named("left", left), named("operator", self.token()), named("right", self.one_pattern()))
        return left

    def one_pattern(self) -> Syn:
        t = self.now
        if t.text == "not" and t.kind == "name":
            return self.make("negated_pattern", self.token(), self.one_pattern())
        if self.sees("<", ">", "<=", ">="):
            return self.make("relational_pattern", self.token(), self.binary(LEVELS[8:], self.unary))
        if self.sees("null", "true", "false", "-") or t.kind == "literal":
            return self.make("constant_pattern", self.binary(LEVELS[8:], self.unary))
        if t.text == "_" and t.kind == "name":
            return Syn("discard", t.start, t.end, kids=[self.token()])
        if t.text == "var" and t.kind == "name":
            return self.make("var_pattern", self.token(), self.identifier())
        if self.sees("("):
            return self.make("parenthesized_pattern", self.token(), *self.listed(")", self.pattern), self.take(")"))
        kind = None if self.sees("{") else self.type()
        if self.sees("{"):
            def one() -> Syn:
                return self.make("subpattern", self.name(), self.take(":"), self.pattern())

            clause = self.make("property_pattern_clause", self.token(), *self.listed("}", one), self.take("}"))
            return self.make("recursive_pattern", kind and named("type", kind), clause, named("name", self.identifier()) if self.now.kind == "name" and self.now.text not in (*KEYWORDS, "and", "or", "when") else None)
        if self.now.kind == "name" and self.now.text not in (*KEYWORDS, "and", "or", "when"):
            return self.make("declaration_pattern", named("type", kind), named("name", self.identifier()))
        return kind

    def unary(self) -> Syn:
        return self.deeper(self._unary)

    def _unary(self) -> Syn:
        if self.sees("+", "-", "!", "~", "++", "--", "&", "*", "^"):
            return self.make("prefix_unary_expression", self.token(), self.unary())
        if self.sees("await") and (self.ahead().kind in ("name", "literal") or self.ahead().text == "("):
            return self.make("await_expression", self.token(), self.unary())
        if self.sees("(") and (found := self.tried(self.cast)) is not None:
            return found
        found = self.postfix(self.primary())
        while self.sees("++", "--") or self.sees("!") and self.ahead().text != "=":
            found = self.make("postfix_unary_expression", found, self.token())
            found = self.postfix(found)
        while self.sees("switch") and self.ahead().text == "{":
            word, open_ = self.token(), self.token()

            def arm() -> Syn:
                kids = [self.pattern()]
                if self.now.text == "when":
                    kids.append(self.make("when_clause", self.token(), self.expression()))
                return self.make("switch_expression_arm", *kids, self.take("=>"), self.expression())

            found = self.make("switch_expression", found, word, open_, *self.listed("}", arm), self.take("}"))
        return found

    def cast(self) -> Syn:
        open_, kind, close = self.take("("), self.type(), self.take(")")
        plain = kind.kind in ("predefined_type", "array_type", "nullable_type")
        if not plain and not (self.now.kind in ("literal",) or self.now.kind == "name" and self.now.text not in ("is", "as", "in", "switch") or self.sees("(", "~", "!")):
            raise Broken
        return self.make("cast_expression", open_, named("type", kind), close, named("value", self.unary()))

    def literal(self) -> Syn:
        t = self.now
        self.at += 1
        if t.text == "filled":
            return self.filled(t)
        node = Syn(LITERALS[t.text], t.start, t.end)
        if t.text == "string":
            end = self.source.rindex('"', t.start, t.end)
            node.add(Syn('"', t.start, t.start + 1, named=False))
            for m in PARTS.finditer(self.source, t.start + 1, end):
                node.add(Syn("escape_sequence" if m[0][0] == "\\" else "string_literal_content", m.start(), m.end()))
            node.add(Syn('"', end, t.end, named=False))
        return node

    def filled(self, t: Token) -> Syn:
        at = self.source.index('"', t.start) + 1
        node = Syn("interpolated_string_expression", t.start, t.end, kids=[Syn("interpolation_start", t.start, at)])
        begin = at
        while at < t.end - 1:
            if self.source.startswith(("{{", "}}"), at) or self.source[at] == "\\":
                at += 2
            elif self.source[at] == "{":
                if begin < at:
                    node.add(Syn("string_content", begin, at))
                end = _hole_end(self.source, at)
                inner = _CSharp(self.source, _tokens(self.source, at + 1, end - 1)[0])
                found = inner.tried(inner.expression)
                node.add(Syn("interpolation", at, end, kids=[Syn("interpolation_brace", at, at + 1), *([found] if found else []), Syn("interpolation_brace", end - 1, end)]))
                at = begin = end
            else:
                at += 1
        if begin < t.end - 1:
            node.add(Syn("string_content", begin, t.end - 1))
        return node.add(Syn('"', t.end - 1, t.end, named=False))

    def primary(self) -> Syn:
        t = self.now
        if t.kind == "literal":
            return self.literal()
        if self.sees("true", "false"):
            return Syn("boolean_literal", t.start, t.end, kids=[self.token()])
        if self.sees("null"):
            return self.leaf("null_literal")
        if self.sees("this", "base"):
            return self.leaf(t.text)
        if self.sees("("):
            open_ = self.token()
            first = self.argument()
            if self.sees(")"):
                return self.make("parenthesized_expression", open_, first.kids[0], self.token())
            return self.make("tuple_expression", open_, first, self.take(","), *self.listed(")", self.argument), self.take(")"))
        if self.sees("new"):
            return self.new()
        if self.sees("typeof", "sizeof", "default") and self.ahead().text == "(":
            word = self.token()
            return self.make(f"{word.kind}_expression", word, self.token(), named("type", self.type()), self.take(")"))
        if self.sees("default"):
            return self.make("default_expression", self.token())
        if self.sees("checked", "unchecked"):
            return self.make("checked_expression", self.token(), self.take("("), self.expression(), self.take(")"))
        if self.sees("stackalloc"):
            return self.make("stackalloc_expression", self.token(), self.type(), *self.subscript())
        if self.sees("["):
            return self.make("collection_expression", self.token(), *self.listed("]", lambda: self.make("spread_element", self.token(), self.expression()) if self.sees("..") else self.expression()), self.take("]"))
        if t.kind == "name" and t.text in PREDEFINED:
            return self.leaf("predefined_type")
        if t.kind != "name":
            raise Broken
        found = self.identifier()
        return self.generic(found)

    def generic(self, found: Syn) -> Syn:
        def whole() -> Syn:
            arguments = self.type_arguments()
            if not self.sees("(", ")", "]", ":", ";", ",", ".", "?", "==", "!=", "}", "{"):
                raise Broken
            return self.make("generic_name", found, arguments)

        return (self.tried(whole) if self.sees("<") else None) or found

    def subscript(self) -> list[Syn]:
        return [self.make("bracketed_argument_list", self.token(), *self.listed("]", self.argument), self.take("]"))] if self.sees("[") else []

    def new(self) -> Syn:
        word = self.token()
        if self.sees("{"):
            return self.make("anonymous_object_creation_expression", word, *self.initializer().kids)
        if self.sees("("):
            return self.make("implicit_object_creation_expression", word, self.arguments(), self.initializer() if self.sees("{") else None)
        if self.sees("["):
            return self.make("implicit_array_creation_expression", word, self.token(), self.take("]"), self.initializer())
        kind = self.type()
        if self.sees("["):
            sizes = self.make("array_rank_specifier", self.token(), *self.listed("]", self.expression), self.take("]"))
            return self.make("array_creation_expression", word, named("type", self.make("array_type", named("type", kind), named("rank", sizes))), self.initializer() if self.sees("{") else None)
        if kind.kind == "array_type":
            return self.make("array_creation_expression", word, named("type", kind), self.initializer())
        return self.make("object_creation_expression", word, named("type", kind), named("arguments", self.arguments()) if self.sees("(") else None, named("initializer", self.initializer()) if self.sees("{") else None)

    def initializer(self) -> Syn:
        def one() -> Syn:
            return self.initializer() if self.sees("{") else self.expression()

        return self.make("initializer_expression", self.take("{"), *self.listed("}", one), self.take("}"))

    def argument(self) -> Syn:
        kids = []
        if self.now.kind == "name" and self.ahead().text == ":" and self.now.text not in KEYWORDS:
            kids += [named("name", self.identifier()), self.token()]
        if self.sees("ref", "out", "in"):
            kids.append(self.token())
            if (found := self.tried(lambda: self.make("declaration_expression", named("type", self.type()), named("name", self.identifier())))) is not None:
                return self.make("argument", *kids, found)
        return self.make("argument", *kids, self.expression())

    def arguments(self) -> Syn:
        return self.make("argument_list", self.take("("), *self.listed(")", self.argument), self.take(")"))

    def postfix(self, found: Syn) -> Syn:
        while True:
            if self.sees(".", "->"):
                dot = self.token()
                found = self.make("member_access_expression", named("expression", found), dot, named("name", self.generic(self.identifier())))
            elif self.sees("("):
                found = self.make("invocation_expression", named("function", found), named("arguments", self.arguments()))
            elif self.sees("["):
                found = self.make("element_access_expression", named("expression", found), *(named("subscript", k) for k in self.subscript()))
            elif self.sees("?") and self.ahead().text in (".", "[") and self.ahead().start == self.now.end:
                mark = self.token()
                if self.sees("."):
                    rest = self.postfix(self.make("member_binding_expression", self.token(), named("name", self.generic(self.identifier()))))
                else:
                    rest = self.postfix(self.make("element_binding_expression", *self.subscript()))
                return self.make("conditional_access_expression", named("condition", found), mark, rest)
            elif self.sees("!") and self.ahead().text in (".", "[", ")", ";", ","):
                found = self.make("postfix_unary_expression", found, self.token())
            else:
                return found


def parse(source: str) -> Syn:
    tokens, comments = _tokens(source)
    return with_comments(_CSharp(source, tokens).unit(), comments)
