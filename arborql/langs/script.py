"""TypeScript, and with JSX JavaScript: tokens are read as the parser goes, as what a slash or an angle means depends on it."""

from __future__ import annotations

import re

from .code import Broken, Parser, Token, named, with_comments
from .tree import Syn

SPACE = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*)+", re.S)
COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*", re.S)
LEX = re.compile(
    r"(?P<name>[#@]?[^\W\d][\w$]*|[#]?\$[\w$]*)|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|"
    r"(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.(){}\[\]@])|(?P<bad>.)",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
PARTS = re.compile(r"\\(?:u\{[^}]*\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|.)|[^\\]+", re.S)
KEYWORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split())
#: After these a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof case do else in instanceof new throw void delete yield await of".split())
LEVELS = [dict.fromkeys(x.split(), "binary_expression") for x in ("?? ||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in as satisfies", "<< >> >>>", "+ -", "* / %")]
AUGMENTED = ("+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=")
PREDEFINED = frozenset("any number boolean string symbol void unknown never object".split())
PLAIN = {"this": "this", "super": "super", "null": "null", "true": "true", "false": "false"}
MODIFIERS = ("public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor")


class _Script(Parser):
    keywords = KEYWORDS

    def __init__(self, source: str, jsx: bool, start: int = 0, end: int | None = None):
        super().__init__(source, [])
        self.jsx, self.place, self.stop = jsx, start, len(source) if end is None else end
        self.comments: list[Syn] = []
        self.no_in = False

    # -- tokens ----------------------------------------------------------------------------------------------------

    def fill(self, upto: int) -> None:
        while len(self.tokens) <= upto and (not self.tokens or self.tokens[-1].kind != "end"):
            self.tokens.append(self.read())

    @property
    def now(self) -> Token:
        self.fill(self.at)
        return self.tokens[self.at]

    def ahead(self, by: int = 1) -> Token:
        self.fill(self.at + by)
        return self.tokens[min(self.at + by, len(self.tokens) - 1)]

    def sees(self, *texts: str) -> bool:
        t = self.now
        return t.text in texts and t.kind in ("sign", "name")

    def read(self) -> Token:
        fresh = not self.tokens
        m = SPACE.match(self.source, self.place, self.stop)
        if m:
            fresh = fresh or "\n" in m[0]
            for c in COMMENT.finditer(self.source, m.start(), m.end()):
                self.comments.append(Syn("comment", c.start(), c.end(), extra=True))
            self.place = m.end()
        at = self.place
        if at >= self.stop:
            return Token("end", "", self.stop, self.stop, True)
        if self.source[at] == "`":
            self.place = self.template_end(at)
            return Token("template", "`", at, self.place, fresh)
        before = self.tokens[-1] if self.tokens else None
        if self.source[at] == "/" and (before is None or before.kind == "sign" and before.text not in (")", "]", "}", "++", "--") or before.kind == "name" and before.text in BEFORE_REGEX) and (m := REGEX.match(self.source, at, self.stop)):
            self.place = m.end()
            return Token("regex", "/", at, self.place, fresh)
        m = LEX.match(self.source, at, self.stop)
        self.place = m.end()
        kind = m.lastgroup
        return Token("sign" if kind == "bad" else kind, m[0], at, m.end(), fresh)

    def template_end(self, at: int) -> int:
        at += 1
        while at < self.stop and self.source[at] != "`":
            if self.source[at] == "\\":
                at += 2
            elif self.source.startswith("${", at):
                at = self.hole_end(at + 1)
            else:
                at += 1
        return min(at + 1, self.stop)

    def hole_end(self, at: int) -> int:
        """Where the brace that opens at ``at`` is closed, strings and templates in it passed over."""
        depth = 0
        while at < self.stop:
            c = self.source[at]
            if c == "`":
                at = self.template_end(at)
                continue
            if c in "\"'" and (m := LEX.match(self.source, at, self.stop)) and m.lastgroup == "string":
                at = m.end()
                continue
            depth += (c == "{") - (c == "}")
            at += 1
            if not depth:
                break
        return at

    def split(self) -> None:
        """Parts the first angle of a token such as >> from the rest: it closes a list of types."""
        t = self.now
        if t.kind == "sign" and len(t.text) > 1 and t.text[0] == ">":
            del self.tokens[self.at + 1 :]
            self.tokens[self.at] = Token("sign", ">", t.start, t.start + 1, t.fresh)
            self.place = t.start + 1

    # -- statements ------------------------------------------------------------------------------------------------

    def program(self) -> Syn:
        root = Syn("program", 0, len(self.source))
        while self.now.kind != "end":
            root.add(self.recovered(self.statement, self.starts))
        return root

    @staticmethod
    def starts(t: Token) -> bool:
        return t.fresh or t.text == ";"

    def block(self, kind: str = "statement_block") -> Syn:
        def inside() -> Syn:
            kids = [self.take("{")]
            while not self.sees("}") and self.now.kind != "end":
                kids.append(self.recovered(self.statement, self.starts))
            return self.make(kind, *kids, self.take("}"))

        return self.deeper(inside)

    def semicolon(self) -> Syn | None:
        if self.sees(";"):
            return self.token()
        if self.sees("}") or self.now.fresh or self.now.kind == "end":
            return None
        raise Broken

    def statement(self) -> Syn:
        return self.deeper(self._statement)

    def _statement(self) -> Syn:
        t = self.now
        word = t.text if t.kind in ("name", "sign") else ""
        after = self.ahead()
        if word == "{":
            return self.block()
        if word == ";":
            return Syn("empty_statement", t.start, t.end, kids=[self.token()])
        if word == "var" or word == "const" and after.text != "enum" or word == "let" and (after.kind == "name" and after.text not in ("in", "instanceof", "of") or after.text in ("{", "[")):
            found = self.declaration()
            return self.make(found.kind, *found.kids, self.semicolon())
        if word == "function" or word == "async" and after.text == "function" and not after.fresh:
            return self.function("function_declaration")
        if word == "class" or word == "abstract" and after.text == "class" or word.startswith("@") and len(word) > 1:
            return self.class_("class_declaration")
        if word == "if":
            kids = [self.token(), named("condition", self.parenthesized()), named("consequence", self.statement())]
            if self.sees("else"):
                kids.append(named("alternative", self.make("else_clause", self.token(), self.statement())))
            return self.make("if_statement", *kids)
        if word == "for":
            return self.for_()
        if word == "while":
            return self.make("while_statement", self.token(), named("condition", self.parenthesized()), named("body", self.statement()))
        if word == "do":
            kids = [self.token(), named("body", self.statement()), self.take("while"), named("condition", self.parenthesized())]
            return self.make("do_statement", *kids, self.accept(";"))
        if word in ("return", "throw"):
            kids = [self.token()]
            if not (self.sees(";", "}") or self.now.fresh or self.now.kind == "end"):
                kids.append(self.expressions())
            elif word == "throw":
                raise Broken
            return self.make(f"{word}_statement", *kids, self.semicolon())
        if word in ("break", "continue", "debugger"):
            kids = [self.token()]
            if self.now.kind == "name" and not self.now.fresh and word != "debugger":
                kids.append(named("label", self.identifier("statement_identifier")))
            return self.make(f"{word}_statement", *kids, self.semicolon())
        if word == "try":
            kids = [self.token(), named("body", self.block())]
            if self.sees("catch"):
                clause = [self.token()]
                if self.sees("("):
                    clause += [self.token(), named("parameter", self.pattern()), self.annotation() if self.sees(":") else None, self.take(")")]
                kids.append(named("handler", self.make("catch_clause", *clause, named("body", self.block()))))
            if self.sees("finally"):
                kids.append(named("finalizer", self.make("finally_clause", self.token(), named("body", self.block()))))
            return self.make("try_statement", *kids)
        if word == "switch":
            return self.switch()
        if word == "import" and after.text not in ("(", "."):
            return self.import_()
        if word == "export":
            return self.export()
        if found := self.typed(word, after):
            return found
        if t.kind == "name" and after.text == ":" and word not in KEYWORDS:
            return self.make("labeled_statement", named("label", self.identifier("statement_identifier")), self.token(), named("body", self.statement()))
        return self.make("expression_statement", self.expressions(), self.semicolon())

    def typed(self, word: str, after: Token) -> Syn | None:
        """Declarations that TypeScript adds; their words are names elsewhere."""
        if after.kind != "name" and not (after.kind == "string" and word in ("module", "declare")) and not (word in ("declare", "global") and after.text == "{") or after.fresh and word != "enum":
            return None
        if word == "type":
            kids = [self.token(), named("name", self.identifier("type_identifier")), self.type_parameters()]
            return self.make("type_alias_declaration", *kids, self.take("="), named("value", self.type()), self.semicolon())
        if word == "interface":
            kids = [self.token(), named("name", self.identifier("type_identifier")), self.type_parameters()]
            if self.sees("extends"):
                kids.append(self.make("extends_type_clause", self.token(), *self.listed("{", self.type)))
            return self.make("interface_declaration", *kids, named("body", self.object_type("interface_body")))
        if word == "enum" or word == "const" and after.text == "enum":
            kids = [self.token(), self.accept("enum"), named("name", self.identifier())]

            def member() -> Syn:
                name = self.property_name()
                return self.make("enum_assignment", named("name", name), self.token(), named("value", self.assignment())) if self.sees("=") else name

            return self.make("enum_declaration", *kids, named("body", self.make("enum_body", self.take("{"), *self.listed("}", member), self.take("}"))))
        if word in ("namespace", "module"):
            kids = [self.token(), named("name", self.string() if self.now.kind == "string" else self.dotted())]
            found = self.make("internal_module" if kids[0].kind == "namespace" else "module", *kids, named("body", self.block()) if self.sees("{") else None)
            return self.make("expression_statement", found) if kids[0].kind == "namespace" else found
        if word == "declare":
            word_ = self.token()
            if self.sees("global") and self.ahead().text == "{":
                return self.make("ambient_declaration", word_, self.token(), self.block())
            return self.make("ambient_declaration", word_, self.bodiless() or self.statement())
        return None

    def bodiless(self) -> Syn | None:
        return self.tried(lambda: self.signature_of("function_signature")) if self.sees("function") else None

    def signature_of(self, kind: str) -> Syn:
        kids = [self.token(), named("name", self.identifier()), *self.call_signature()]
        if self.sees("{"):
            raise Broken
        return self.make(kind, *kids, self.semicolon())

    def dotted(self) -> Syn:
        found = self.identifier()
        while self.sees("."):
            found = self.make("nested_identifier", found, self.token(), self.identifier("property_identifier"))
        return found

    def declaration(self) -> Syn:
        word = self.token()

        def one() -> Syn:
            kids = [named("name", self.pattern()), self.accept("!"), named("type", self.annotation()) if self.sees(":") else None]
            if self.sees("="):
                kids += [self.token(), named("value", self.assignment())]
            return self.make("variable_declarator", *kids)

        kids = [one()]
        while self.sees(","):
            kids += [self.token(), one()]
        return self.make("variable_declaration" if word.kind == "var" else "lexical_declaration", word if word.kind == "var" else named("kind", word), *kids)

    def function(self, kind: str) -> Syn:
        kids = [self.accept("async"), self.take("function")]
        if self.sees("*"):
            kids.append(self.token())
            kind = "generator_" + kind.replace("_expression", "")
        if self.now.kind == "name" and self.now.text not in KEYWORDS:
            kids.append(named("name", self.identifier()))
        kids += self.call_signature()
        if kind.endswith("declaration") and not self.sees("{"):
            return self.make("function_signature", *kids, self.semicolon())
        return self.make(kind, *kids, named("body", self.block()))

    def call_signature(self) -> list[Syn]:
        kids = [self.type_parameters(), named("parameters", self.parameters())]
        if self.sees(":"):
            kids.append(named("return_type", self.annotation()))
        return [k for k in kids if k is not None]

    def parameters(self) -> Syn:
        def one() -> Syn:
            kids: list[Syn | None] = []
            while self.now.kind == "name" and self.now.text[0] == "@":
                kids.append(self.decorator())
            while self.sees("public", "private", "protected", "readonly", "override") and self.ahead().kind == "name":
                kids.append(Syn("accessibility_modifier", self.now.start, self.now.end, kids=[self.token()]))
            if self.sees("..."):
                pattern = self.make("rest_pattern", self.token(), self.pattern())
            else:
                pattern = self.leaf("this") if self.sees("this") else self.pattern()
            kids.append(named("pattern", pattern))
            optional = self.sees("?")
            if optional:
                kids.append(self.token())
            if self.sees(":"):
                kids.append(named("type", self.annotation()))
            if self.sees("="):
                kids += [self.token(), named("value", self.assignment())]
            return self.make("optional_parameter" if optional else "required_parameter", *kids)

        return self.make("formal_parameters", self.take("("), *self.listed(")", one), self.take(")"))

    def pattern(self) -> Syn:
        if self.sees("["):
            def item() -> Syn:
                found = self.make("rest_pattern", self.token(), self.pattern()) if self.sees("...") else self.pattern()
                return self.make("assignment_pattern", named("left", found), self.token(), named("right", self.assignment())) if self.sees("=") else found

            kids = [self.token()]
            while not self.sees("]"):
                kids.append(self.token() if self.sees(",") else item())
            return self.make("array_pattern", *kids, self.take("]"))
        if self.sees("{"):
            def field() -> Syn:
                if self.sees("..."):
                    return self.make("rest_pattern", self.token(), self.identifier())
                key = self.property_name()
                if self.sees(":"):
                    key.kind = "property_identifier" if key.kind == "identifier" else key.kind
                    value = [self.token(), self.pattern()]
                    if self.sees("="):
                        value[1] = self.make("assignment_pattern", named("left", value[1]), self.token(), named("right", self.assignment()))
                    return self.make("pair_pattern", named("key", key), value[0], named("value", value[1]))
                key.kind = "shorthand_property_identifier_pattern"
                return self.make("object_assignment_pattern", named("left", key), self.token(), named("right", self.assignment())) if self.sees("=") else key

            return self.make("object_pattern", self.token(), *self.listed("}", field), self.take("}"))
        return self.identifier()

    def decorator(self) -> Syn:
        t = self.now
        self.at += 1
        sign = Syn("@", t.start, t.start + 1, named=False)
        found = Syn("identifier", t.start + 1, t.end)
        while self.sees("."):
            found = self.make("member_expression", named("object", found), self.token(), named("property", self.identifier("property_identifier")))
        if self.sees("("):
            found = self.make("call_expression", named("function", found), named("arguments", self.arguments()))
        return self.make("decorator", sign, found)

    def class_(self, kind: str) -> Syn:
        kids: list[Syn | None] = []
        while self.now.kind == "name" and self.now.text[0] == "@":
            kids.append(named("decorator", self.decorator()))
        if self.sees("export"):
            raise Broken
        if self.sees("abstract"):
            kids.append(self.token())
            kind = "abstract_class_declaration"
        kids.append(self.take("class"))
        if self.now.kind == "name" and self.now.text not in (*KEYWORDS, "implements"):
            kids.append(named("name", self.identifier("type_identifier")))
        kids.append(self.type_parameters())
        heritage = []
        if self.sees("extends"):
            heritage.append(self.make("extends_clause", self.token(), named("value", self.postfix(self.atom())), self.tried(self.type_arguments) if self.sees("<") else None))
        if self.sees("implements"):
            heritage.append(self.make("implements_clause", self.token(), *self.listed("{", self.type)))
        if heritage:
            kids.append(self.make("class_heritage", *heritage))
        body = [self.take("{")]
        while not self.sees("}") and self.now.kind != "end":
            body.append(self.token() if self.sees(";") else self.recovered(self.member, self.starts))
        return self.make(kind, *kids, named("body", self.make("class_body", *body, self.take("}"))))

    def member(self) -> Syn:
        kids: list[Syn | None] = []
        if self.now.kind == "name" and self.now.text[0] == "@":
            return self.decorator()
        if self.sees("static") and self.ahead().text == "{":
            return self.make("class_static_block", self.token(), named("body", self.block()))
        while self.sees(*MODIFIERS) and self.ahead().text not in ("(", "=", ";", ":", "?", "!", "}", "<", ","):
            token = self.token()
            kids.append(Syn("accessibility_modifier", token.start, token.end, kids=[token]) if token.kind in ("public", "private", "protected") else token)
        if self.sees("get", "set") and self.ahead().text not in ("(", "=", ";", ":", "?", "!", "}", "<", ","):
            kids.append(self.token())
        kids.append(self.accept("*"))
        if self.sees("["):
            if (index := self.tried(self.index_signature)) is not None:
                return self.make("index_signature", *kids, *index.kids, self.semicolon())
        kids.append(named("name", self.property_name()))
        kids.append(self.accept("?", "!"))
        if self.sees("(", "<"):
            kids += self.call_signature()
            if self.sees("{"):
                return self.make("method_definition", *kids, named("body", self.block()))
            return self.make("method_signature", *kids, self.semicolon())
        if self.sees(":"):
            kids.append(named("type", self.annotation()))
        if self.sees("="):
            kids += [self.token(), named("value", self.assignment())]
        return self.make("public_field_definition", *kids, self.semicolon())

    def property_name(self) -> Syn:
        if self.now.kind == "string":
            return self.string()
        if self.now.kind == "number":
            return self.leaf("number")
        if self.sees("["):
            return self.make("computed_property_name", self.token(), self.assignment(), self.take("]"))
        if self.now.kind != "name":
            raise Broken
        return self.leaf("private_property_identifier" if self.now.text[0] == "#" else "property_identifier")

    def for_(self) -> Syn:
        kids: list[Syn | None] = [self.token(), self.accept("await"), self.take("(")]
        no_in, self.no_in = self.no_in, True
        if self.sees(";"):
            first = self.make("empty_statement", self.token())
            each = None
        else:
            word = self.now.text
            if word in ("var", "const") or word == "let" and self.ahead().text not in ("in", "of", "=", ";"):
                head = [named("kind", self.token()), named("left", self.pattern())]
                if self.sees("of", "in"):
                    each, first = head, None
                else:
                    self.at -= 0
                    each = None
                    first = self.rest_of_declaration(head)
            else:
                found = self.expressions()
                each, first = ([named("left", found)], None) if self.sees("of", "in") else (None, self.make("expression_statement", found, self.take(";")))
        self.no_in = no_in
        if each is not None:
            kids += [*each, named("operator", self.token()), named("right", self.expressions()), self.take(")")]
            return self.make("for_in_statement", *kids, named("body", self.statement()))
        kids.append(named("initializer", first))
        kids.append(named("condition", self.make("empty_statement", self.token()) if self.sees(";") else self.make("expression_statement", self.expressions(), self.take(";"))))
        if not self.sees(")"):
            kids.append(named("increment", self.expressions()))
        return self.make("for_statement", *kids, self.take(")"), named("body", self.statement()))

    def rest_of_declaration(self, head: list[Syn]) -> Syn:
        """A declaration whose word and first name were read."""
        word, name = head
        word.field = None if word.kind == "var" else "kind"
        kids = [named("name", name), named("type", self.annotation()) if self.sees(":") else None]
        if self.sees("="):
            kids += [self.token(), named("value", self.assignment())]
        every = [self.make("variable_declarator", *kids)]
        while self.sees(","):
            every.append(self.token())
            kids = [named("name", self.pattern()), named("type", self.annotation()) if self.sees(":") else None]
            if self.sees("="):
                kids += [self.token(), named("value", self.assignment())]
            every.append(self.make("variable_declarator", *kids))
        return self.make("variable_declaration" if word.kind == "var" else "lexical_declaration", word, *every, self.take(";"))

    def switch(self) -> Syn:
        kids = [self.token(), named("value", self.parenthesized())]
        body = [self.take("{")]
        while not self.sees("}"):
            if self.sees("default"):
                head, kind = [self.token(), self.take(":")], "switch_default"
            else:
                head, kind = [self.take("case"), named("value", self.expressions()), self.take(":")], "switch_case"
            while not self.sees("case", "default", "}") and self.now.kind != "end":
                head.append(named("body", self.recovered(self.statement, self.starts)))
            body.append(self.make(kind, *head))
        return self.make("switch_statement", *kids, named("body", self.make("switch_body", *body, self.take("}"))))

    def import_(self) -> Syn:
        kids = [self.token()]
        if self.sees("type") and self.ahead().text not in ("from", ",", "="):
            kids.append(self.token())
        if self.now.kind != "string":
            clause: list[Syn] = []
            if self.now.kind == "name":
                clause.append(self.identifier())
                if self.sees("="):
                    kids.append(self.make("import_require_clause", *clause, self.token(), self.postfix(self.atom())))
                    return self.make("import_statement", *kids, self.semicolon())
                if self.sees(","):
                    clause.append(self.token())
            if self.sees("*"):
                clause.append(self.make("namespace_import", self.token(), self.take("as"), self.identifier()))
            elif self.sees("{"):
                clause.append(self.make("named_imports", self.token(), *self.listed("}", lambda: self.specifier("import_specifier")), self.take("}")))
            kids += [self.make("import_clause", *clause), self.take("from")]
        kids.append(named("source", self.string()))
        if self.sees("with", "assert") and not self.now.fresh:
            kids.append(self.make("import_attribute", self.token(), self.object()))
        return self.make("import_statement", *kids, self.semicolon())

    def specifier(self, kind: str) -> Syn:
        kids = [self.token()] if self.sees("type") and self.ahead().text not in (",", "}", "as") else []
        name = self.string() if self.now.kind == "string" else self.leaf("identifier") if self.now.kind == "name" else None
        if name is None:
            raise Broken
        kids.append(named("name", name))
        if self.sees("as"):
            kids += [self.token(), named("alias", self.string() if self.now.kind == "string" else self.leaf("identifier"))]
        return self.make(kind, *kids)

    def export(self) -> Syn:
        kids = [self.token()]
        if self.sees("*"):
            kids.append(self.token())
            if self.sees("as"):
                kids[-1] = self.make("namespace_export", kids[-1], self.token(), self.leaf("identifier"))
            return self.make("export_statement", *kids, self.take("from"), named("source", self.string()), self.semicolon())
        if self.sees("type") and self.ahead().text == "{":
            kids.append(self.token())
        if self.sees("{"):
            kids.append(self.make("export_clause", self.token(), *self.listed("}", lambda: self.specifier("export_specifier")), self.take("}")))
            if self.sees("from"):
                kids += [self.token(), named("source", self.string())]
            return self.make("export_statement", *kids, self.semicolon())
        if self.sees("="):
            return self.make("export_statement", *kids, self.token(), self.expressions(), self.semicolon())
        if self.sees("as") and self.ahead().text == "namespace":
            return self.make("export_statement", *kids, self.token(), self.token(), self.identifier(), self.semicolon())
        if self.sees("default"):
            kids.append(self.token())
            if self.sees("function", "class", "abstract", "interface") or self.sees("async") and self.ahead().text == "function":
                return self.make("export_statement", *kids, named("declaration", self.statement()))
            return self.make("export_statement", *kids, named("value", self.assignment()), self.semicolon())
        return self.make("export_statement", *kids, named("declaration", self.statement()))

    # -- expressions -----------------------------------------------------------------------------------------------

    def parenthesized(self) -> Syn:
        open_ = self.take("(")
        no_in, self.no_in = self.no_in, False
        inside = self.expressions()
        self.no_in = no_in
        return self.make("parenthesized_expression", open_, inside, self.take(")"))

    def expressions(self) -> Syn:
        found = self.assignment()
        if not self.sees(","):
            return found
        kids = [found]
        while self.sees(","):
            kids += [self.token(), self.assignment()]
        return self.make("sequence_expression", *kids)

    def assignment(self) -> Syn:
        return self.deeper(self._assignment)

    def _assignment(self) -> Syn:
        t, after = self.now, self.ahead()
        if t.kind == "name" and t.text not in KEYWORDS and (after.text == "=>" or t.text == "async" and after.kind == "name" and not after.fresh and self.ahead(2).text == "=>"):
            kids = [self.token()] if after.text != "=>" else []
            return self.arrow([*kids, named("parameter", self.identifier())])
        if (t.text in ("(", "<") and t.kind == "sign" or t.text == "async" and after.text in ("(", "<") and not after.fresh) and (found := self.tried(self.arrow_function)):
            return found
        if self.sees("yield") and after.kind != "sign" or self.sees("yield") and after.text in ("*", "(", "[", "{", ";"):
            kids = [self.token(), self.accept("*")]
            if not (self.now.fresh or self.sees(")", "]", "}", ",", ";") or self.now.kind == "end"):
                kids.append(self.assignment())
            return self.make("yield_expression", *kids)
        left = self.ternary()
        if self.sees("="):
            left = {"object": lambda: Syn("object_pattern", left.start, left.end, kids=left.kids), "array": lambda: Syn("array_pattern", left.start, left.end, kids=left.kids)}.get(left.kind, lambda: left)()
            return self.make("assignment_expression", named("left", left), self.token(), named("right", self.assignment()))
        if self.sees(*AUGMENTED):
            return self.make("augmented_assignment_expression", named("left", left), named("operator", self.token()), named("right", self.assignment()))
        return left

    def arrow_function(self) -> Syn:
        return self.arrow([self.accept("async"), *self.call_signature()])

    def arrow(self, head: list[Syn | None]) -> Syn:
        if self.now.fresh:
            raise Broken
        sign = self.take("=>")
        return self.make("arrow_function", *head, sign, named("body", self.block() if self.sees("{") else self.assignment()))

    def ternary(self) -> Syn:
        found = self.binary(LEVELS, self.unary)
        if not self.sees("?"):
            return found
        no_in, self.no_in = self.no_in, False
        kids = [named("condition", found), self.token(), named("consequence", self.assignment())]
        self.no_in = no_in
        return self.make("ternary_expression", *kids, self.take(":"), named("alternative", self.assignment()))

    def binary(self, levels: list[dict[str, str]], operand, level: int = 0) -> Syn:
        if level == len(levels):
            return operand()
        left = self.binary(levels, operand, level + 1)
        while self.now.kind in ("sign", "name") and (kind := levels[level].get(self.now.text)):
            if self.now.text in ("as", "satisfies"):
                if self.now.fresh:
                    break
                word = self.token()
                left = self.make(f"{word.kind}_expression", left, word, self.token() if self.sees("const") else self.type())
                continue
            if self.now.text == "in" and self.no_in:
                break
            operator = self.token()
            left = self.make(kind, named("left", left), named("operator", operator), named("right", self.binary(levels, operand, level + 1)))
        return left

    def unary(self) -> Syn:
        return self.deeper(self._unary)

    def _unary(self) -> Syn:
        if self.sees("!", "~", "-", "+", "typeof", "void", "delete"):
            return self.make("unary_expression", named("operator", self.token()), named("argument", self.unary()))
        if self.sees("++", "--"):
            return self.make("update_expression", named("operator", self.token()), named("argument", self.unary()))
        if self.sees("await") and (self.ahead().kind != "sign" or self.ahead().text in ("(", "[", "{")) and self.ahead().text not in ("in", "of"):
            return self.make("await_expression", self.token(), self.unary())
        if self.sees("<") and not self.jsx:
            return self.make("type_assertion", self.type_arguments(), self.unary())
        found = self.postfix(self.atom())
        if self.sees("++", "--") and not self.now.fresh:
            found = self.make("update_expression", named("argument", found), named("operator", self.token()))
        if self.sees("**"):
            return self.make("binary_expression", named("left", found), named("operator", self.token()), named("right", self.unary()))
        return found

    def atom(self) -> Syn:
        t = self.now
        if t.kind == "name":
            if t.text in PLAIN:
                return self.leaf(PLAIN[t.text])
            if t.text == "function" or t.text == "async" and self.ahead().text == "function":
                return self.function("function_expression")
            if t.text == "class":
                return self.class_("class")
            if t.text == "new":
                return self.new()
            if t.text == "import":
                return self.leaf("import")
            if t.text in KEYWORDS or t.text[0] == "@":
                raise Broken
            return self.leaf("undefined" if t.text == "undefined" else "private_property_identifier" if t.text[0] == "#" else "identifier")
        if t.kind == "number":
            return self.leaf("number")
        if t.kind == "string":
            return self.string()
        if t.kind == "template":
            return self.template()
        if t.kind == "regex":
            self.at += 1
            cut = self.source.rindex("/", t.start, t.end)
            flags = [Syn("regex_flags", cut + 1, t.end)] if cut + 1 < t.end else []
            return Syn("regex", t.start, t.end, kids=[Syn("/", t.start, t.start + 1, named=False), named("pattern", Syn("regex_pattern", t.start + 1, cut)), Syn("/", cut, cut + 1, named=False), *flags])
        if self.sees("("):
            return self.parenthesized()
        if self.sees("["):
            kids = [self.token()]
            no_in, self.no_in = self.no_in, False
            while not self.sees("]"):
                if self.sees(","):
                    kids.append(self.token())
                    continue
                kids.append(self.spread())
                if not self.sees(",", "]"):
                    raise Broken
            self.no_in = no_in
            return self.make("array", *kids, self.take("]"))
        if self.sees("{"):
            return self.object()
        if self.sees("<") and self.jsx:
            return self.markup()
        raise Broken

    def spread(self) -> Syn:
        return self.make("spread_element", self.token(), self.assignment()) if self.sees("...") else self.assignment()

    def new(self) -> Syn:
        word = self.token()
        if self.sees("."):
            return self.make("meta_property", word, self.token(), self.leaf("property_identifier"))
        made = self.new() if self.sees("new") else self.atom()
        while self.sees(".", "["):
            made = self.member_of(made)
        types = self.tried(self.type_arguments) if self.sees("<") else None
        return self.make("new_expression", word, named("constructor", made), types and named("type_arguments", types), named("arguments", self.arguments()) if self.sees("(") else None)

    def member_of(self, found: Syn) -> Syn:
        if self.sees("["):
            open_ = self.token()
            no_in, self.no_in = self.no_in, False
            index = named("index", self.expressions())
            self.no_in = no_in
            return self.make("subscript_expression", named("object", found), open_, index, self.take("]"))
        dot = self.token()
        if self.now.kind != "name":
            raise Broken
        return self.make("member_expression", named("object", found), dot, named("property", self.leaf("private_property_identifier" if self.now.text[0] == "#" else "property_identifier")))

    def postfix(self, found: Syn) -> Syn:
        while True:
            if self.sees(".", "["):
                found = self.member_of(found)
            elif self.sees("?."):
                t = self.now
                chain = Syn("optional_chain", t.start, t.end, kids=[self.token()])
                if self.sees("("):
                    found = self.make("call_expression", named("function", found), chain, named("arguments", self.arguments()))
                elif self.sees("["):
                    open_ = self.token()
                    found = self.make("subscript_expression", named("object", found), chain, open_, named("index", self.expressions()), self.take("]"))
                elif self.now.kind == "name":
                    found = self.make("member_expression", named("object", found), chain, named("property", self.leaf("property_identifier")))
                else:
                    raise Broken
            elif self.sees("("):
                found = self.make("call_expression", named("function", found), named("arguments", self.arguments()))
            elif self.now.kind == "template":
                found = self.make("call_expression", named("function", found), named("arguments", self.template()))
            elif self.sees("!") and not self.now.fresh and self.ahead().text != "=":
                found = self.make("non_null_expression", found, self.token())
            elif self.sees("<") and (types := self.tried(self.call_types)):
                found = self.make("call_expression", named("function", found), named("type_arguments", types), named("arguments", self.arguments()))
            else:
                return found

    def call_types(self) -> Syn:
        found = self.type_arguments()
        if not self.sees("("):
            raise Broken
        return found

    def arguments(self) -> Syn:
        open_ = self.take("(")
        no_in, self.no_in = self.no_in, False
        kids = self.listed(")", self.spread)
        self.no_in = no_in
        return self.make("arguments", open_, *kids, self.take(")"))

    def string(self) -> Syn:
        t = self.now
        if t.kind != "string":
            raise Broken
        self.at += 1
        node = Syn("string", t.start, t.end, kids=[Syn(t.text[0], t.start, t.start + 1, named=False)])
        for m in PARTS.finditer(self.source, t.start + 1, t.end - 1):
            node.add(Syn("escape_sequence" if m[0][0] == "\\" else "string_fragment", m.start(), m.end()))
        return node.add(Syn(t.text[0], t.end - 1, t.end, named=False))

    def template(self) -> Syn:
        t = self.now
        self.at += 1
        node = Syn("template_string", t.start, t.end, kids=[Syn("`", t.start, t.start + 1, named=False)])
        at = begin = t.start + 1
        while at < t.end - 1:
            if self.source[at] == "\\":
                at += 2
            elif self.source.startswith("${", at):
                if begin < at:
                    node.add(Syn("string_fragment", begin, at))
                end = self.hole_end(at + 1)
                node.add(Syn("template_substitution", at, end, kids=[Syn("${", at, at + 2, named=False), *self.nested(at + 2, end - 1), Syn("}", end - 1, end, named=False)]))
                at = begin = end
            else:
                at += 1
        if begin < t.end - 1:
            node.add(Syn("string_fragment", begin, t.end - 1))
        return node.add(Syn("`", t.end - 1, t.end, named=False))

    def nested(self, start: int, end: int) -> list[Syn]:
        """The expression between two places."""
        inner = _Script(self.source, self.jsx, start, end)
        inner.depth = self.depth + 1
        if inner.now.kind == "end":
            self.comments += inner.comments
            return []
        found = [inner.spread() if inner.sees("...") else inner.expressions()]
        if inner.now.kind != "end":
            raise Broken
        self.comments += inner.comments
        return found

    def object(self) -> Syn:
        def item() -> Syn:
            if self.sees("..."):
                return self.spread()
            at = self.at
            head: list[Syn | None] = []
            while self.sees("async", "get", "set") and self.ahead().text not in ("(", ",", "}", ":", "=", "<"):
                head.append(self.token())
            head.append(self.accept("*"))
            name = self.property_name()
            if self.sees("(", "<"):
                return self.make("method_definition", *head, named("name", name), *self.call_signature(), named("body", self.block()))
            if self.sees(":"):
                return self.make("pair", named("key", name), self.token(), named("value", self.assignment()))
            if name.kind != "property_identifier" or len([h for h in head if h]):
                raise Broken
            self.at = at + 1
            name.kind = "shorthand_property_identifier"
            return self.make("object_assignment_pattern", named("left", name), self.token(), named("right", self.assignment())) if self.sees("=") else name

        open_ = self.take("{")
        no_in, self.no_in = self.no_in, False
        kids = self.listed("}", item)
        self.no_in = no_in
        return self.make("object", open_, *kids, self.take("}"))

    # -- JSX -------------------------------------------------------------------------------------------------------

    def markup(self) -> Syn:
        """An element, read from the source itself: its text isn't made of tokens."""
        start = self.now.start
        node, end = self.deeper(lambda: self.element(start))
        del self.tokens[self.at :]
        self.tokens.append(Token("jsx", "", start, end))
        self.at += 1
        self.place = end
        return node

    def skip(self, at: int) -> int:
        m = SPACE.match(self.source, at, self.stop)
        return m.end() if m else at

    def tag_name(self, at: int) -> tuple[Syn, int]:
        m = re.compile(r"[A-Za-z_$][\w$:.-]*").match(self.source, at, self.stop)
        if m is None:
            raise Broken
        if "." in m[0]:
            head, _, tail = m[0].rpartition(".")
            cut = at + len(head)
            return Syn("member_expression", at, m.end(), kids=[named("object", Syn("identifier", at, cut)), Syn(".", cut, cut + 1, named=False), named("property", Syn("property_identifier", cut + 1, m.end()))]), m.end()
        return Syn("identifier", at, m.end()), m.end()

    def braced(self, at: int) -> tuple[Syn, int]:
        end = self.hole_end(at)
        return Syn("jsx_expression", at, end, kids=[Syn("{", at, at + 1, named=False), *self.nested(at + 1, end - 1), Syn("}", end - 1, end, named=False)]), end

    def element(self, start: int) -> tuple[Syn, int]:
        source = self.source
        at = self.skip(start + 1)
        kids = [Syn("<", start, start + 1, named=False)]
        if not source.startswith(">", at):
            name, at = self.tag_name(at)
            kids.append(named("name", name))
            while True:
                at = self.skip(at)
                if source.startswith("/", at):
                    end = self.skip(at + 1)
                    if not source.startswith(">", end):
                        raise Broken
                    return Syn("jsx_self_closing_element", start, end + 1, kids=[*kids, Syn("/>", at, end + 1, named=False)]), end + 1
                if source.startswith(">", at):
                    break
                if source.startswith("{", at):
                    attribute, at = self.braced(at)
                else:
                    attribute, at = self.attribute(at)
                kids.append(named("attribute", attribute))
        opening = Syn("jsx_opening_element", start, at + 1, kids=[*kids, Syn(">", at, at + 1, named=False)])
        at += 1
        inside: list[Syn] = []
        while True:
            cut = next((i for i in range(at, self.stop) if source[i] in "<{"), self.stop)
            if cut > at and source[at:cut].strip():
                inside.append(Syn("jsx_text", at, cut))
            if cut >= self.stop:
                raise Broken
            if source[cut] == "{":
                node, at = self.braced(cut)
                inside.append(node)
                continue
            after = self.skip(cut + 1)
            if source.startswith("/", after):
                close = [Syn("</", cut, after + 1, named=False)]
                at = self.skip(after + 1)
                if not source.startswith(">", at):
                    name, at = self.tag_name(at)
                    close.append(named("name", name))
                    at = self.skip(at)
                    if not source.startswith(">", at):
                        raise Broken
                closing = Syn("jsx_closing_element", cut, at + 1, kids=[*close, Syn(">", at, at + 1, named=False)])
                return Syn("jsx_element", start, at + 1, kids=[named("open_tag", opening), *inside, named("close_tag", closing)]), at + 1
            node, at = self.deeper(lambda cut=cut: self.element(cut))
            inside.append(node)

    def attribute(self, at: int) -> tuple[Syn, int]:
        name, end = self.tag_name(at)
        name = Syn("property_identifier", name.start, name.end)
        after = self.skip(end)
        if not self.source.startswith("=", after):
            return Syn("jsx_attribute", at, end, kids=[name]), end
        sign, value = Syn("=", after, after + 1, named=False), self.skip(after + 1)
        c = self.source[value : value + 1]
        if c == "{":
            node, end = self.braced(value)
        elif c in ("'", '"'):
            end = self.source.find(c, value + 1, self.stop) + 1
            if not end:
                raise Broken
            node = Syn("string", value, end, kids=[Syn(c, value, value + 1, named=False), *([Syn("string_fragment", value + 1, end - 1)] if end > value + 2 else []), Syn(c, end - 1, end, named=False)])
        else:
            raise Broken
        return Syn("jsx_attribute", at, end, kids=[name, sign, node]), end

    # -- types -----------------------------------------------------------------------------------------------------

    def annotation(self) -> Syn:
        colon = self.take(":")
        if self.sees("asserts") and self.ahead().kind == "name" and not self.ahead().fresh:
            return self.make("asserts_annotation", colon, self.token(), self.type())
        return self.make("type_annotation", colon, self.type())

    def type(self) -> Syn:
        return self.deeper(self._type)

    def _type(self) -> Syn:
        if self.sees("new") or self.sees("abstract") and self.ahead().text == "new":
            kids = [self.accept("abstract"), self.token(), self.type_parameters(), named("parameters", self.parameters()), self.take("=>")]
            return self.make("constructor_type", *kids, named("type", self.type()))
        if self.sees("(", "<") and (found := self.tried(self.function_type)):
            return found
        found = self.union()
        if self.sees("is") and not self.now.fresh and found.kind in ("type_identifier", "this_type"):
            found = self.make("type_predicate", named("name", Syn("identifier", found.start, found.end)), self.token(), named("type", self.type()))
        if self.sees("extends") and not self.no_conditional:
            kids = [named("left", found), self.token()]
            before, self.no_conditional = self.no_conditional, True
            kids.append(named("right", self.type()))
            self.no_conditional = before
            return self.make("conditional_type", *kids, self.take("?"), named("consequence", self.type()), self.take(":"), named("alternative", self.type()))
        return found

    no_conditional = False

    def function_type(self) -> Syn:
        kids = [self.type_parameters(), named("parameters", self.parameters())]
        return self.make("function_type", *kids, self.take("=>"), named("return_type", self.type()))

    def union(self) -> Syn:
        found = self.make("union_type", self.token(), self.intersection()) if self.sees("|") else self.intersection()
        while self.sees("|"):
            found = self.make("union_type", found, self.token(), self.intersection())
        return found

    def intersection(self) -> Syn:
        found = self.make("intersection_type", self.token(), self.type_operator()) if self.sees("&") else self.type_operator()
        while self.sees("&"):
            found = self.make("intersection_type", found, self.token(), self.type_operator())
        return found

    def type_operator(self) -> Syn:
        follows = self.ahead()
        if self.sees("keyof", "unique", "readonly", "infer") and (follows.kind in ("name", "string") or follows.text in ("(", "[", "{")) and not follows.fresh:
            word = self.token()
            if word.kind == "infer":
                return self.make("infer_type", word, self.identifier("type_identifier"))
            return self.make({"keyof": "index_type_query", "readonly": "readonly_type", "unique": "unique_type"}[word.kind], word, self.type_operator())
        found = self.type_atom()
        while self.sees("[") and not self.now.fresh:
            open_ = self.token()
            if self.sees("]"):
                found = self.make("array_type", found, open_, self.token())
            else:
                found = self.make("lookup_type", found, open_, self.type(), self.take("]"))
        return found

    def type_atom(self) -> Syn:
        t = self.now
        if t.kind == "name":
            if t.text in ("null", "true", "false", "undefined"):
                return self.make("literal_type", self.leaf(t.text))
            if t.text == "this":
                return self.leaf("this_type")
            if t.text == "typeof":
                found = self.make("type_query", self.token(), self.query_name())
                return found
            if t.text == "void" or t.text in PREDEFINED and self.ahead().text not in (".",):
                self.at += 1
                return Syn("predefined_type", t.start, t.end, kids=[Syn(t.text, t.start, t.end, named=False)])
            if t.text == "import":
                found = self.make("call_expression", named("function", self.leaf("import")), named("arguments", self.arguments()))
            else:
                if t.text in KEYWORDS:
                    raise Broken
                found = self.leaf("type_identifier")
            while self.sees("."):
                if found.kind == "type_identifier":
                    found.kind = "identifier"
                found = self.make("nested_type_identifier", named("module", found), self.token(), named("name", self.leaf("type_identifier")))
            if self.sees("<"):
                return self.make("generic_type", named("name", found), named("type_arguments", self.type_arguments()))
            return found
        if t.kind == "string":
            return self.make("literal_type", self.string())
        if t.kind == "number":
            return self.make("literal_type", self.leaf("number"))
        if t.kind == "template":
            return self.make("template_literal_type", self.template())
        if self.sees("-") and self.ahead().kind == "number":
            return self.make("literal_type", self.make("unary_expression", named("operator", self.token()), named("argument", self.leaf("number"))))
        if self.sees("("):
            open_ = self.token()
            before, self.no_conditional = self.no_conditional, False
            inside = self.type()
            self.no_conditional = before
            return self.make("parenthesized_type", open_, inside, self.take(")"))
        if self.sees("["):
            def item() -> Syn:
                if self.sees("..."):
                    dots = self.token()
                    if self.now.kind == "name" and self.ahead().text == ":":
                        return self.make("required_parameter", named("pattern", self.make("rest_pattern", dots, self.leaf("identifier"))), named("type", self.annotation()))
                    return self.make("rest_type", dots, self.type())
                if self.now.kind == "name" and (self.ahead().text == ":" or self.ahead().text == "?" and self.ahead(2).text == ":"):
                    return self.make("required_parameter", named("name", self.leaf("identifier")), self.accept("?"), named("type", self.annotation()))
                found = self.type()
                return self.make("optional_type", found, self.token()) if self.sees("?") else found

            return self.make("tuple_type", self.token(), *self.listed("]", item), self.take("]"))
        if self.sees("{"):
            return self.object_type("object_type")
        raise Broken

    def query_name(self) -> Syn:
        found = self.leaf("import") if self.sees("import") else self.leaf("this") if self.sees("this") else self.identifier()
        if self.sees("("):
            found = self.make("call_expression", named("function", found), named("arguments", self.arguments()))
        while self.sees("."):
            found = self.make("member_expression", named("object", found), self.token(), named("property", self.leaf("property_identifier")))
        return found

    def type_arguments(self) -> Syn:
        open_ = self.take("<")
        before, self.no_conditional = self.no_conditional, False
        kids = []
        while not self.closes():
            kids.append(self.type())
            if not self.closes():
                kids.append(self.take(","))
        self.no_conditional = before
        return self.make("type_arguments", open_, *kids, self.take(">"))

    def closes(self) -> bool:
        self.split()
        return self.sees(">")

    def type_parameters(self) -> Syn | None:
        if not self.sees("<"):
            return None

        def one() -> Syn:
            kids = [self.token()] if self.sees("const", "in", "out") and self.ahead().kind == "name" else []
            kids.append(named("name", self.identifier("type_identifier")))
            if self.sees("extends"):
                kids.append(named("constraint", self.make("constraint", self.token(), self.type())))
            if self.sees("="):
                kids.append(named("value", self.make("default_type", self.token(), self.type())))
            return self.make("type_parameter", *kids)

        kids = [self.token()]
        while not self.closes():
            kids.append(one())
            if not self.closes():
                kids.append(self.take(","))
        return named("type_parameters", self.make("type_parameters", *kids, self.take(">")))

    def index_signature(self) -> Syn:
        kids = [self.take("["), named("name", self.identifier())]
        if self.sees("in"):
            kids = [kids[0], self.make("mapped_type_clause", named("name", Syn("type_identifier", kids[1].start, kids[1].end)), self.token(), named("type", self.type()), *([self.token(), named("alias", self.type())] if self.sees("as") else []))]
        else:
            kids += [self.take(":"), named("index_type", self.type())]
        kids.append(self.take("]"))
        if self.sees("?", "-", "+"):
            kids += [self.token(), *([self.take("?")] if self.sees("?") and kids[-1].kind in ("-", "+") else [])]
        return self.make("index_signature", *kids, named("type", self.annotation()) if self.sees(":") else None)

    def object_type(self, kind: str) -> Syn:
        def member() -> Syn:
            kids: list[Syn | None] = []
            if self.sees("+", "-") and self.ahead().text == "readonly":
                kids.append(self.token())
            while self.sees("readonly", "get", "set") and self.ahead().text not in (":", "?", "(", ";", ",", "}", "<"):
                kids.append(self.token())
            if self.sees("(", "<"):
                return self.make("call_signature", *self.call_signature())
            if self.sees("new") and self.ahead().text in ("(", "<"):
                return self.make("construct_signature", self.token(), *self.call_signature())
            if self.sees("[") and (found := self.tried(self.index_signature)) is not None:
                return self.make("index_signature", *kids, *found.kids)
            kids += [named("name", self.property_name()), self.accept("?")]
            if self.sees("(", "<"):
                return self.make("method_signature", *kids, *self.call_signature())
            return self.make("property_signature", *kids, named("type", self.annotation()) if self.sees(":") else None)

        kids = [self.take("{")]
        before, self.no_conditional = self.no_conditional, False
        while not self.sees("}"):
            if self.sees(";", ","):
                kids.append(self.token())
                continue
            kids.append(member())
            if not self.sees(";", ",", "}") and not self.now.fresh:
                raise Broken
        self.no_conditional = before
        return self.make(kind, *kids, self.take("}"))


def _parse(source: str, jsx: bool) -> Syn:
    parser = _Script(source, jsx)
    root = parser.program()
    seen = {c.start: c for c in parser.comments}
    return with_comments(root, [seen[k] for k in sorted(seen)])


def parse(source: str) -> Syn:
    return _parse(source, False)


def parse_jsx(source: str) -> Syn:
    return _parse(source, True)
