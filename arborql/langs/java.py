"""Java: statements and members may stand at the top of a file, as fragments do."""

from __future__ import annotations

import re

from .code import Broken, Parser, Token, named, with_comments
from .tree import Syn

LEX = re.compile(
    r"(?P<space>[\s﻿]+)|(?P<line_comment>//[^\n]*)|(?P<block_comment>/\*.*?(?:\*/|\Z))|(?P<name>@interface\b|[^\W\d][\w$]*|\$[\w$]*)|"
    r"(?P<text>\"\"\"(?:\\.|[^\\])*?\"\"\")|(?P<string>\"(?:\\.|[^\"\\\n])*\")|(?P<char>'(?:\\[^']*'?|[^'\\\n])')|(?P<hex>0[xX][\da-fA-F_]+[lL]?)|(?P<bin>0[bB][01_]+[lL]?)|"
    r"(?P<float>(?:\d[\d_]*\.[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdD]?|\d[\d_]*[eE][+-]?\d+[fFdD]?|\d[\d_]*[fFdD])|(?P<int>\d[\d_]*[lL]?)|"
    r"(?P<sign><<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/%&|^!~<>=?:;,.@(){}\[\]])|(?P<bad>.)",
    re.S,
)
KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if goto implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
MODIFIERS = frozenset("public protected private abstract static final strictfp native transient volatile synchronized default sealed".split())
TYPES = {**dict.fromkeys("int byte short long char".split(), "integral_type"), "float": "floating_point_type", "double": "floating_point_type", "boolean": "boolean_type", "void": "void_type"}
LITERALS = {"int": "decimal_integer_literal", "hex": "hex_integer_literal", "bin": "binary_integer_literal", "float": "decimal_floating_point_literal", "char": "character_literal"}
LEVELS = [dict.fromkeys(x.split(), "binary_expression") for x in ("||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >> >>>", "+ -", "* / %")]
ASSIGN = ("=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<=", ">>=", ">>>=")
PARTS = re.compile(r"\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.)|[^\\]+", re.S)


def _tokens(source: str) -> tuple[list[Token], list[Syn]]:
    """Closing angles are tokens of one sign, so that lists of types can end; shifts are put together where they're used."""
    tokens: list[Token] = []
    comments: list[Syn] = []
    fresh = True
    for m in LEX.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "space":
            fresh = fresh or "\n" in text
            continue
        if kind in ("line_comment", "block_comment"):
            comments.append(Syn(kind, m.start(), m.end(), extra=True))
            continue
        if kind in LITERALS:
            tokens.append(Token("number", kind, m.start(), m.end(), fresh))
        else:
            tokens.append(Token({"text": "string", "bad": "sign"}.get(kind, kind), text, m.start(), m.end(), fresh))
        fresh = False
    tokens.append(Token("end", "", len(source), len(source), True))
    return tokens, comments


class _Java(Parser):
    keywords = KEYWORDS

    def program(self) -> Syn:
        root = Syn("program", 0, len(self.source))
        while self.now.kind != "end":
            root.add(self.recovered(self.top, lambda t: t.fresh or t.text == ";"))
        return root

    def top(self) -> Syn:
        if self.sees("package") or self.sees("import"):
            word = self.token()
            kids = [word, self.accept("static"), self.scoped()]
            if self.sees("."):
                kids += [self.token(), Syn("asterisk", self.now.start, self.now.end, kids=[self.take("*")])]
            return self.make(f"{word.kind}_declaration", *kids, self.take(";"))
        return self.tried(self.declared) or self.tried(lambda: self.member("")) or self.statement()

    def scoped(self) -> Syn:
        found = self.identifier()
        while self.sees(".") and self.ahead().kind == "name":
            found = self.make("scoped_identifier", named("scope", found), self.token(), named("name", self.identifier()))
        return found

    # -- declarations ------------------------------------------------------------------------------------------------

    def modifiers(self) -> Syn | None:
        kids = []
        while self.sees(*MODIFIERS) and not (self.sees("default") and self.ahead().text in (":", "->")) and not (self.sees("synchronized") and self.ahead().text == "(") or self.sees("@") and self.ahead().text != "interface":
            kids.append(self.annotation() if self.sees("@") else self.token())
        return self.make("modifiers", *kids) if kids else None

    def annotation(self) -> Syn:
        kids = [self.take("@"), named("name", self.scoped())]
        if not self.sees("("):
            return self.make("marker_annotation", *kids)

        def one() -> Syn:
            if self.now.kind == "name" and self.ahead().text == "=":
                return self.make("element_value_pair", named("key", self.identifier()), self.token(), named("value", value()))
            return value()

        def value() -> Syn:
            if self.sees("{"):
                return self.make("element_value_array_initializer", self.token(), *self.listed("}", value), self.take("}"))
            return self.annotation() if self.sees("@") else self.ternary()

        return self.make("annotation", *kids, named("arguments", self.make("annotation_argument_list", self.token(), *self.listed(")", one), self.take(")"))))

    def declared(self) -> Syn:
        """A class, an interface, an enumeration or a record."""
        modifiers = self.modifiers()
        word = self.now.text
        if word == "record" and (self.ahead().kind != "name" or self.ahead(2).text not in ("(", "<")) or word not in ("class", "interface", "enum", "record", "@interface"):
            raise Broken
        kids = [modifiers, self.token(), named("name", self.identifier()), self.type_parameters()]
        if word == "record":
            kids.append(named("parameters", self.parameters()))
        if word == "interface" and self.sees("extends"):
            kids.append(self.make("extends_interfaces", self.token(), self.type_list()))
        if word == "class" and self.sees("extends"):
            kids.append(named("superclass", self.make("superclass", self.token(), self.type())))
        if self.sees("implements"):
            kids.append(named("interfaces", self.make("super_interfaces", self.token(), self.type_list())))
        if self.sees("permits"):
            kids.append(named("permits", self.make("permits", self.token(), self.type_list())))
        if word == "enum":
            return self.make("enum_declaration", *kids, named("body", self.enum_body()))
        kind = {"interface": "interface", "@interface": "annotation_type"}.get(word, word)
        body = self.class_body("interface_body" if word == "interface" else "annotation_type_body" if word == "@interface" else "class_body")
        return self.make(f"{kind}_declaration", *kids, named("body", body))

    def type_list(self) -> Syn:
        kids = [self.type()]
        while self.sees(","):
            kids += [self.token(), self.type()]
        return self.make("type_list", *kids)

    def enum_body(self) -> Syn:
        kids = [self.take("{")]
        while not self.sees("}", ";"):
            constant = [self.modifiers(), named("name", self.identifier()), named("arguments", self.arguments()) if self.sees("(") else None, named("body", self.class_body()) if self.sees("{") else None]
            kids.append(self.make("enum_constant", *constant))
            if not self.sees("}", ";"):
                kids.append(self.take(","))
        if self.sees(";"):
            rest = [self.token()]
            while not self.sees("}") and self.now.kind != "end":
                rest.append(self.token() if self.sees(";") else self.recovered(lambda: self.member("class_body"), lambda t: t.fresh))
            kids.append(self.make("enum_body_declarations", *rest))
        return self.make("enum_body", *kids, self.take("}"))

    def class_body(self, kind: str = "class_body") -> Syn:
        kids = [self.take("{")]
        while not self.sees("}") and self.now.kind != "end":
            kids.append(self.token() if self.sees(";") else self.recovered(lambda: self.member(kind), lambda t: t.fresh))
        return self.make(kind, *kids, self.take("}"))

    def member(self, inside: str) -> Syn:
        if found := self.tried(self.declared):
            return found
        if self.sees("static") and self.ahead().text == "{":
            return self.make("static_initializer", self.token(), self.block())
        if self.sees("{") and inside:
            return self.block()
        modifiers, types = self.modifiers(), self.type_parameters()
        if self.now.kind == "name" and self.ahead().text == "(" and (inside or modifiers):
            kids = [modifiers, types, named("name", self.identifier()), named("parameters", self.parameters()), self.throws()]
            return self.make("constructor_declaration", *kids, named("body", self.block("constructor_body")))
        if self.now.kind == "name" and self.ahead().text == "{" and inside:
            return self.make("compact_constructor_declaration", modifiers, named("name", self.identifier()), named("body", self.block()))
        kind = named("type", self.type())
        if self.now.kind != "name":
            raise Broken
        if self.ahead().text == "(":
            kids = [modifiers, types, kind, named("name", self.identifier()), named("parameters", self.parameters()), self.dimensions(), self.throws()]
            if self.sees("default"):
                kids += [self.token(), named("value", self.ternary())]
            return self.make("method_declaration", *kids, named("body", self.block()) if self.sees("{") else self.take(";"))
        if not inside and modifiers is None:
            raise Broken
        return self.make("field_declaration", modifiers, kind, *self.declarators(), self.take(";"))

    def throws(self) -> Syn | None:
        return self.make("throws", self.token(), *self.type_list().kids) if self.sees("throws") else None

    def declarators(self) -> list[Syn]:
        def one() -> Syn:
            kids = [named("name", self.identifier()), self.dimensions()]
            if self.sees("="):
                kids += [self.token(), named("value", self.initializer())]
            return named("declarator", self.make("variable_declarator", *kids))

        kids = [one()]
        while self.sees(","):
            kids += [self.token(), one()]
        return kids

    def initializer(self) -> Syn:
        if self.sees("{"):
            return self.make("array_initializer", self.token(), *self.listed("}", self.initializer), self.take("}"))
        return self.expression()

    def parameters(self) -> Syn:
        def one() -> Syn:
            modifiers = self.modifiers()
            if modifiers is None and self.now.kind == "name" and self.now.text not in KEYWORDS and self.ahead().text in (",", ")"):
                return self.make("formal_parameter", named("name", self.identifier()))
            kind = self.type()
            if self.sees("..."):
                return self.make("spread_parameter", modifiers, kind, self.token(), self.make("variable_declarator", named("name", self.identifier())))
            if self.sees("this"):
                return self.make("receiver_parameter", modifiers, kind, self.leaf("this"))
            return self.make("formal_parameter", modifiers, named("type", kind), named("name", self.identifier()), self.dimensions())

        return self.make("formal_parameters", self.take("("), *self.listed(")", one), self.take(")"))

    # -- types -------------------------------------------------------------------------------------------------------

    def dimensions(self) -> Syn | None:
        kids = []
        while self.sees("[") and self.ahead().text == "]":
            kids += [self.token(), self.token()]
        return named("dimensions", self.make("dimensions", *kids)) if kids else None

    def type(self) -> Syn:
        return self.deeper(self._type)

    def _type(self) -> Syn:
        while self.sees("@"):
            self.annotation()
        word = self.now.text
        if self.now.kind == "name" and word in TYPES:
            leaf = Syn(TYPES[word], self.now.start, self.now.end)
            if TYPES[word] in ("integral_type", "floating_point_type"):
                leaf.kids = [Syn(word, self.now.start, self.now.end, named=False)]
            self.at += 1
            found = leaf
        else:
            found = self.identifier("type_identifier")
            found = self.generic(found)
            while self.sees(".") and self.ahead().kind == "name" and self.ahead().text not in KEYWORDS:
                found = self.generic(self.make("scoped_type_identifier", found, self.token(), self.identifier("type_identifier")))
        if (dimensions := self.dimensions()) is not None:
            found = self.make("array_type", named("element", found), dimensions)
        return found

    def generic(self, found: Syn) -> Syn:
        if self.sees("<") and (arguments := self.tried(self.type_arguments)):
            return self.make("generic_type", found, arguments)
        return found

    def type_arguments(self) -> Syn:
        def one() -> Syn:
            if self.sees("?"):
                kids = [self.token()]
                if self.sees("extends", "super"):
                    kids += [self.token(), self.type()]
                return self.make("wildcard", *kids)
            return self.type()

        return self.make("type_arguments", self.take("<"), *self.listed(">", one), self.take(">"))

    def type_parameters(self) -> Syn | None:
        if not self.sees("<"):
            return None

        def one() -> Syn:
            kids = [self.identifier("type_identifier")]
            if self.sees("extends"):
                bound = [self.token(), self.type()]
                while self.sees("&"):
                    bound += [self.token(), self.type()]
                kids.append(self.make("type_bound", *bound))
            return self.make("type_parameter", *kids)

        return named("type_parameters", self.make("type_parameters", self.token(), *self.listed(">", one), self.take(">")))

    # -- statements --------------------------------------------------------------------------------------------------

    def block(self, kind: str = "block") -> Syn:
        def inside() -> Syn:
            kids = [self.take("{")]
            while not self.sees("}") and self.now.kind != "end":
                kids.append(self.recovered(self.statement, lambda t: t.fresh or t.text == ";"))
            return self.make(kind, *kids, self.take("}"))

        return self.deeper(inside)

    def statement(self) -> Syn:
        return self.deeper(self._statement)

    def parenthesized(self) -> Syn:
        return self.make("parenthesized_expression", self.take("("), self.expression(), self.take(")"))

    def _statement(self) -> Syn:
        word = self.now.text if self.now.kind in ("name", "sign") else ""
        after = self.ahead()
        if word == "{":
            return self.block()
        if word == ";":
            return self.token()
        if word == "if":
            kids = [self.token(), named("condition", self.parenthesized()), named("consequence", self.statement())]
            if self.sees("else"):
                kids += [self.token(), named("alternative", self.statement())]
            return self.make("if_statement", *kids)
        if word == "while":
            return self.make("while_statement", self.token(), named("condition", self.parenthesized()), named("body", self.statement()))
        if word == "do":
            return self.make("do_statement", self.token(), named("body", self.statement()), self.take("while"), named("condition", self.parenthesized()), self.take(";"))
        if word == "for":
            return self.for_()
        if word == "try":
            return self.try_()
        if word == "switch":
            found = self.switch()
            return found if not self.sees(".", ";") else self.make("expression_statement", self.rest_of(found), self.take(";"))
        if word in ("return", "throw"):
            kids = [self.token(), None if self.sees(";") else self.expression()]
            return self.make(f"{word}_statement", *kids, self.take(";"))
        if word == "yield" and after.text not in ("=", ".", "(", "++", "--"):
            return self.make("yield_statement", self.token(), self.expression(), self.take(";"))
        if word in ("break", "continue"):
            return self.make(f"{word}_statement", self.token(), self.identifier() if self.now.kind == "name" else None, self.take(";"))
        if word == "assert":
            kids = [self.token(), self.expression()]
            if self.sees(":"):
                kids += [self.token(), self.expression()]
            return self.make("assert_statement", *kids, self.take(";"))
        if word == "synchronized" and after.text == "(":
            return self.make("synchronized_statement", self.token(), self.parenthesized(), named("body", self.block()))
        if self.now.kind == "name" and after.text == ":" and word not in KEYWORDS:
            return self.make("labeled_statement", self.identifier(), self.token(), self.statement())
        return self.tried(self.declared) or self.tried(self.local) or self.expressed()

    def expressed(self) -> Syn:
        """An expression and its semicolon; a name alone may end a block without one, as what stands for statements in a pattern does."""
        found = self.expression()
        return self.make("expression_statement", found, None if found.kind == "identifier" and self.sees("}") else self.take(";"))

    def local(self) -> Syn:
        kids = [self.modifiers(), named("type", self.type())]
        return self.make("local_variable_declaration", *kids, *self.declarators(), self.take(";"))

    def for_(self) -> Syn:
        word, open_ = self.token(), self.take("(")

        def each() -> Syn:
            kids = [self.modifiers(), named("type", self.type()), named("name", self.identifier()), self.take(":"), named("value", self.expression()), self.take(")")]
            return self.make("enhanced_for_statement", word, open_, *kids, named("body", self.statement()))

        if (found := self.tried(each)) is not None:
            return found
        kids: list[Syn] = []

        def several(field: str, until: str) -> list[Syn]:
            return [named(field, k) if k.named else k for k in self.listed(until, self.expression)]

        if (first := self.tried(self.local)) is not None:
            kids.append(named("init", first))
        else:
            kids += [*several("init", ";"), self.take(";")]
        if not self.sees(";"):
            kids.append(named("condition", self.expression()))
        kids += [self.take(";"), *several("update", ")"), self.take(")")]
        return self.make("for_statement", word, open_, *kids, named("body", self.statement()))

    def try_(self) -> Syn:
        kids = [self.token()]
        kind = "try_statement"
        if self.sees("("):
            def resource() -> Syn:
                def whole() -> Syn:
                    return self.make("resource", self.modifiers(), named("type", self.type()), named("name", self.identifier()), self.take("="), named("value", self.expression()))

                return self.tried(whole) or self.make("resource", self.expression())

            kids.append(named("resources", self.make("resource_specification", self.token(), *self.listed(")", resource, ";"), self.take(")"))))
            kind = "try_with_resources_statement"
        kids.append(named("body", self.block()))
        while self.sees("catch"):
            word, open_ = self.token(), self.take("(")
            types = [self.modifiers()]
            caught = [self.type()]
            while self.sees("|"):
                caught += [self.token(), self.type()]
            parameter = self.make("catch_formal_parameter", *types, self.make("catch_type", *caught), named("name", self.identifier()))
            kids.append(self.make("catch_clause", word, open_, parameter, self.take(")"), named("body", self.block())))
        if self.sees("finally"):
            kids.append(self.make("finally_clause", self.token(), self.block()))
        return self.make(kind, *kids)

    def switch(self) -> Syn:
        kids = [self.token(), named("condition", self.parenthesized())]
        body = [self.take("{")]
        while not self.sees("}"):
            label = self.label()
            if self.sees("->"):
                arrow = self.token()
                value = self.block() if self.sees("{") else self.statement() if self.sees("throw") else self.make("expression_statement", self.expression(), self.take(";"))
                body.append(self.make("switch_rule", label, arrow, value))
                continue
            group = [label, self.take(":")]
            while self.sees("case", "default"):
                group += [self.label(), self.take(":")]
            while not self.sees("case", "default", "}") and self.now.kind != "end":
                group.append(self.recovered(self.statement, lambda t: t.fresh or t.text == ";"))
            body.append(self.make("switch_block_statement_group", *group))
        return self.make("switch_expression", *kids, named("body", self.make("switch_block", *body, self.take("}"))))

    def label(self) -> Syn:
        if self.sees("default"):
            return self.make("switch_label", self.token())

        def one() -> Syn:
            if self.sees("default"):
                return self.token()
            typed = self.tried(lambda: self.make("type_pattern", self.type(), self.identifier()))
            return typed or self.ternary()

        kids = [self.take("case"), one()]
        while self.sees(","):
            kids += [self.token(), one()]
        if self.now.text == "when" and self.now.kind == "name":
            kids.append(self.make("guard", self.token(), self.ternary()))
        return self.make("switch_label", *kids)

    # -- expressions -------------------------------------------------------------------------------------------------

    def expression(self) -> Syn:
        return self.deeper(self._expression)

    def _expression(self) -> Syn:
        if (self.sees("(") or self.now.kind == "name" and self.ahead().text == "->") and (found := self.tried(self.lambda_)):
            return found
        left = self.ternary()
        if self.sees(*ASSIGN) or self.sees(">") and self.ahead().text in (">=", ">") and self.ahead().start == self.now.end:
            operator = self.token() if self.sees(*ASSIGN) else self.shift(">>=", ">>>=")
            return self.make("assignment_expression", named("left", left), named("operator", operator), named("right", self.expression()))
        return left

    def shift(self, *signs: str) -> Syn:
        """A sign of several tokens that touch."""
        start, end, count, text = self.now.start, self.now.end, 0, ""
        for count in range(1, 4):
            t = self.ahead(count - 1)
            if count > 1 and t.start != end:
                break
            text, end = text + t.text, t.end
            if text in signs:
                self.at += count
                return Syn(text, start, end, named=False)
        raise Broken

    def lambda_(self) -> Syn:
        if self.sees("("):
            parameters = self.tried(self.inferred) or self.parameters()
        else:
            parameters = self.identifier()
        return self.make("lambda_expression", named("parameters", parameters), self.take("->"), named("body", self.block() if self.sees("{") else self.expression()))

    def inferred(self) -> Syn:
        return self.make("inferred_parameters", self.take("("), self.identifier(), *(x for k in self.more_names() for x in k), self.take(")"))

    def more_names(self) -> list[list[Syn]]:
        found = []
        while self.sees(","):
            found.append([self.token(), self.identifier()])
        return found

    def ternary(self) -> Syn:
        found = self.binary(LEVELS, self.unary)
        if not self.sees("?"):
            return found
        kids = [named("condition", found), self.token(), named("consequence", self.expression()), self.take(":")]
        return self.make("ternary_expression", *kids, named("alternative", (self.tried(self.lambda_) if self.sees("(") or self.ahead().text == "->" else None) or self.ternary()))

    def binary(self, levels: list[dict[str, str]], operand, level: int = 0) -> Syn:
        if level == len(levels):
            return operand()
        left = self.binary(levels, operand, level + 1)
        while True:
            if ">" in levels[level] and self.sees("instanceof"):
                word = self.token()
                kids = [named("left", left), word, self.accept("final"), named("right", self.type())]
                if self.now.kind == "name" and self.now.text not in KEYWORDS:
                    kids.append(named("name", self.identifier()))
                left = self.make("instanceof_expression", *kids)
                continue
            touching = self.sees(">") and self.ahead().start == self.now.end and self.ahead().text in (">", ">=")
            if touching:
                if ">>" not in levels[level] or self.assigns():
                    return left
                operator = self.tried(lambda: self.shift(">>>")) or self.shift(">>")
            elif self.now.kind == "sign" and self.now.text in levels[level]:
                operator = self.token()
            else:
                return left
            left = self.make("binary_expression", named("left", left), named("operator", operator), named("right", self.binary(levels, operand, level + 1)))

    def assigns(self) -> bool:
        at = self.at
        found = self.tried(lambda: self.shift(">>=", ">>>=")) is not None
        self.at = at
        return found

    def unary(self) -> Syn:
        return self.deeper(self._unary)

    def _unary(self) -> Syn:
        if self.sees("+", "-", "!", "~"):
            return self.make("unary_expression", named("operator", self.token()), named("operand", self.unary()))
        if self.sees("++", "--"):
            return self.make("update_expression", self.token(), self.unary())
        if self.sees("(") and (found := self.tried(self.cast)):
            return found
        found = self.rest_of(self.primary())
        if self.sees("++", "--"):
            found = self.make("update_expression", found, self.token())
        return found

    def cast(self) -> Syn:
        open_, kind = self.take("("), [self.type()]
        plain = kind[0].kind in TYPES.values()
        while self.sees("&"):
            kind += [self.token(), self.type()]
        close = self.take(")")
        if not plain and self.now.kind == "sign" and not self.sees("(", "!", "~") or self.now.kind == "end" or self.sees("instanceof"):
            raise Broken
        value = (self.tried(self.lambda_) if self.sees("(") or self.ahead().text == "->" else None) or self.unary()
        return self.make("cast_expression", open_, *(named("type", k) if k.named else k for k in kind), close, named("value", value))

    def primary(self) -> Syn:
        t = self.now
        if t.kind == "number":
            return self.leaf(LITERALS[t.text])
        if t.kind == "string":
            return self.string()
        if self.sees("("):
            return self.parenthesized()
        if t.kind != "name":
            raise Broken
        if t.text in ("this", "super", "true", "false"):
            return self.leaf(t.text)
        if t.text == "null":
            return self.leaf("null_literal")
        if t.text == "switch":
            return self.switch()
        if t.text == "new":
            return self.new()
        if t.text in TYPES:
            kind = self.type()
            if self.sees("."):
                return self.make("class_literal", kind, self.token(), self.take("class"))
            return self.make("method_reference", kind, self.take("::"), self.take("new"))
        if self.ahead().text == "(":
            return self.make("method_invocation", named("name", self.identifier()), named("arguments", self.arguments()))
        if (found := self.tried(self.reference_of_type)) is not None:
            return found
        return self.identifier()

    def reference_of_type(self) -> Syn:
        kind = self.type()
        if kind.kind == "array_type" and self.sees(".") and self.ahead().text == "class":
            return self.make("class_literal", kind, self.token(), self.token())
        if kind.kind not in ("generic_type", "array_type") or not self.sees("::"):
            raise Broken
        return self.make("method_reference", kind, self.token(), self.accept("new") or self.identifier())

    def string(self) -> Syn:
        t = self.now
        self.at += 1
        width = 3 if t.text.startswith('"""') else 1
        quote = '"' * width
        node = Syn("string_literal", t.start, t.end, kids=[Syn(quote, t.start, t.start + width, named=False)])
        for m in PARTS.finditer(self.source, t.start + width, t.end - width):
            node.add(Syn("escape_sequence" if m[0][0] == "\\" else "multiline_string_fragment" if width > 1 else "string_fragment", m.start(), m.end()))
        return node.add(Syn(quote, t.end - width, t.end, named=False))

    def new(self) -> Syn:
        word = self.token()
        kind = self._type() if not self.sees("@") else self.type()
        if kind.kind == "array_type" and self.sees("{"):
            return self.make("array_creation_expression", word, named("type", kind.kids[0]), named("dimensions", kind.kids[1]), named("value", self.initializer()))
        if self.sees("["):
            sizes = []
            while self.sees("[") and self.ahead().text != "]":
                sizes.append(named("dimensions", self.make("dimensions_expr", self.token(), self.expression(), self.take("]"))))
            return self.make("array_creation_expression", word, named("type", kind), *sizes, self.dimensions())
        if kind.kind == "type_identifier" and self.sees("<") and self.ahead().text == ">":
            kind = self.make("generic_type", kind, self.make("type_arguments", self.token(), self.token()))
        return self.make("object_creation_expression", word, named("type", kind), named("arguments", self.arguments()), self.class_body() if self.sees("{") else None)

    def arguments(self) -> Syn:
        return self.make("argument_list", self.take("("), *self.listed(")", self.expression), self.take(")"))

    def rest_of(self, found: Syn) -> Syn:
        while True:
            if self.sees("."):
                dot = self.token()
                if self.sees("class"):
                    found = self.make("class_literal", found, dot, self.token())
                elif self.sees("new"):
                    inner = self.new()
                    found = self.make(inner.kind, found, dot, *inner.kids)
                elif self.sees("this", "super"):
                    found = self.make("field_access", named("object", found), dot, named("field", self.leaf(self.now.text)))
                else:
                    types = named("type_arguments", self.type_arguments()) if self.sees("<") else None
                    name = self.identifier()
                    if self.sees("("):
                        found = self.make("method_invocation", named("object", found), dot, types, named("name", name), named("arguments", self.arguments()))
                    else:
                        found = self.make("field_access", named("object", found), dot, named("field", name))
            elif self.sees("["):
                found = self.make("array_access", named("array", found), self.token(), named("index", self.expression()), self.take("]"))
            elif self.sees("::"):
                found = self.make("method_reference", found, self.token(), self.accept("new") or self.identifier())
            elif found.kind in ("this", "super") and self.sees("("):
                return self.make("explicit_constructor_invocation", named("constructor", found), named("arguments", self.arguments()))
            else:
                return found


def parse(source: str) -> Syn:
    tokens, comments = _tokens(source)
    return with_comments(_Java(source, tokens).program(), comments)
