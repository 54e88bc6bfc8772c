"""C, and the part of C++ that rules mostly ask for: classes, namespaces, templates, references, lambdas, range loops.

Declarations and expressions look alike (``a * b;``); what begins with a type's keyword, with two names, or with a name, stars and
a name that is declared like one is read as a declaration. Preprocessor lines are nodes of their own.
"""

from __future__ import annotations

import re

from .code import Broken, Parser, Token, named, with_comments
from .tree import Syn

LEX = re.compile(
    r"(?P<space>(?:[ \t\r\f\v﻿]|\\\r?\n)+)|(?P<newline>\n)|(?P<comment>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z))|"
    r"(?P<raw>(?:u8|[uUL])?R\"(?P<mark>[^()\\\s]{0,16})\(.*?\)(?P=mark)\")|(?P<string>(?:u8|[uUL])?\"(?:\\.|[^\"\\\n])*\")|(?P<char>(?:u8|[uUL])?'(?:\\.[^']*|[^'\\\n])+')|(?P<name>[^\W\d]\w*)|"
    r"(?P<number>(?:0[xX][\da-fA-F']+(?:\.[\da-fA-F']*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)[a-zA-Z_]*)|"
    r"(?P<sign><=>|<<=|>>=|\.\.\.|->\*|->|::|\.\*|\+\+|--|<<|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\^=|\|=|[-+*/%&|^!~<>=?:;,.#(){}\[\]])|(?P<bad>.)",
    re.S,
)
PRIMITIVE = frozenset("int char void float double bool _Bool size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t char16_t char32_t wchar_t nullptr_t".split())
SIZES = frozenset("signed unsigned long short".split())
QUALIFIERS = frozenset("const volatile restrict _Atomic constexpr __restrict mutable noreturn _Noreturn consteval constinit".split())
STORAGE = frozenset("extern static auto register inline thread_local __inline _Thread_local".split())
KEYWORDS_C = frozenset("break case continue default do else enum for goto if return sizeof struct switch typedef union while".split()) | SIZES | QUALIFIERS | STORAGE
KEYWORDS_CPP = KEYWORDS_C | frozenset("class namespace using template typename new delete try catch throw public private protected friend virtual operator explicit this nullptr true false decltype noexcept static_cast dynamic_cast reinterpret_cast const_cast co_await co_return co_yield".split())
LEVELS = [dict.fromkeys(x.split(), "binary_expression") for x in ("||", "&&", "|", "^", "&", "== !=", "< > <= >= <=>", "<< >>", "+ -", "* / %")]
ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=")
PARTS = re.compile(r"\\(?:u[\da-fA-F]{4}|U[\da-fA-F]{8}|x[\da-fA-F]+|[0-7]{1,3}|.)|[^\\]+", re.S)
DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)((?:\\\r?\n|/\*.*?\*/|(?!//)[^\n])*)", re.S)


class _C(Parser):
    keywords = KEYWORDS_C
    cpp = False

    def __init__(self, source: str):
        self.comments: list[Syn] = []
        super().__init__(source, self.read(source))

    def read(self, source: str) -> list[Token]:
        tokens: list[Token] = []
        at, fresh = 0, True
        while at < len(source):
            if fresh and (m := DIRECTIVE.match(source, at)) and "#" in source[at : m.end()]:
                start = source.index("#", at)
                end = m.end() - (len(m[0]) - len(m[0].rstrip()))
                tokens.append(Token("directive", m[1], start, end, True))
                at = m.end()
                continue
            m = LEX.match(source, at)
            kind, at = m.lastgroup if m.lastgroup != "mark" else "raw", m.end()
            if kind == "newline":
                fresh = True
            elif kind == "comment":
                self.comments.append(Syn("comment", m.start(), m.end(), extra=True))
            elif kind != "space":
                tokens.append(Token("string" if kind == "raw" else "sign" if kind == "bad" else kind, m[0], m.start(), m.end(), fresh))
                fresh = False
        tokens.append(Token("end", "", len(source), len(source), True))
        return tokens

    # -- the file --------------------------------------------------------------------------------------------------

    def unit(self) -> Syn:
        root = Syn("translation_unit", 0, len(self.source))
        while self.now.kind != "end":
            root.add(self.recovered(self.top, self.starts))
        return root

    @staticmethod
    def starts(t: Token) -> bool:
        return t.fresh or t.text == ";"

    def directive(self) -> Syn:
        t = self.now
        self.at += 1
        body = t.start + self.source[t.start : t.end].find(t.text) + len(t.text) if t.text else t.start + 1
        head = Syn(f"#{t.text}", t.start, body, named=False)
        rest = self.source[body : t.end].strip()
        first = self.source.index(rest, body) if rest else t.end
        if t.text == "include" and rest:
            kind = "string_literal" if rest[0] == '"' else "system_lib_string" if rest[0] == "<" else "identifier"
            return Syn("preproc_include", t.start, t.end, kids=[head, named("path", Syn(kind, first, first + len(rest)))])
        if t.text == "define" and (m := re.match(r"(\w+)(\([^()]*\))?", rest)):
            kids = [head, named("name", Syn("identifier", first, first + len(m[1])))]
            if m[2]:
                kids.append(named("parameters", Syn("preproc_params", first + m.start(2), first + m.end(2))))
            value = rest[m.end() :].strip()
            if value:
                at = first + rest.index(value, m.end())
                kids.append(named("value", Syn("preproc_arg", at, at + len(value))))
            return Syn("preproc_function_def" if m[2] else "preproc_def", t.start, t.end, kids=kids)
        return Syn("preproc_call", t.start, t.end, kids=[named("directive", Syn("preproc_directive", t.start, body)), *([named("argument", Syn("preproc_arg", first, first + len(rest)))] if rest else [])])

    def top(self) -> Syn:
        if self.now.kind == "directive":
            return self.directive()
        if self.sees("extern") and self.ahead().kind == "string":
            return self.make("linkage_specification", self.token(), named("value", self.string()), named("body", self.listed_declarations() if self.sees("{") else self.top()))
        return self.tried(self.declaration) or self.statement()

    def listed_declarations(self, kind: str = "declaration_list") -> Syn:
        kids = [self.take("{")]
        while not self.sees("}") and self.now.kind != "end":
            kids.append(self.recovered(self.top, self.starts))
        return self.make(kind, *kids, self.take("}"))

    # -- declarations ----------------------------------------------------------------------------------------------

    def specifiers(self) -> tuple[list[Syn], Syn | None]:
        """What stands before a declarator, and the type in it."""
        before: list[Syn] = []
        found: Syn | None = None
        while True:
            t = self.now
            if t.kind != "name":
                break
            if t.text in STORAGE and not (t.text == "auto" and self.cpp):
                before.append(Syn("storage_class_specifier", t.start, t.end, kids=[self.token()]))
            elif t.text in QUALIFIERS:
                before.append(Syn("type_qualifier", t.start, t.end, kids=[self.token()]))
            elif self.cpp and t.text in ("virtual", "explicit", "friend"):
                before.append(self.token())
            elif found is None and (one := self.tried(self.type_specifier)) is not None:
                found = named("type", one)
                before.append(found)
            else:
                break
        return before, found

    def type_specifier(self) -> Syn:
        t = self.now
        if t.kind != "name":
            raise Broken
        if t.text in SIZES:
            kids = []
            while self.sees(*SIZES):
                kids.append(self.token())
            if self.now.kind == "name" and self.now.text in PRIMITIVE:
                kids.append(named("type", self.leaf("primitive_type")))
            return self.make("sized_type_specifier", *kids)
        if t.text in PRIMITIVE:
            return self.leaf("primitive_type")
        if t.text in ("struct", "union", "class") and (t.text != "class" or self.cpp):
            word = self.token()
            kids = [word, named("name", self.type_name()) if self.now.kind == "name" else None]
            if self.cpp and self.sees(":"):
                kids.append(self.make("base_class_clause", self.token(), *self.listed("{", self.base)))
            if self.sees("{"):
                kids.append(named("body", self.fields()))
            if len(kids) == 2 and kids[1] is None:
                raise Broken
            return self.make(f"{word.kind}_specifier", *kids)
        if t.text == "enum":
            kids = [self.token(), self.accept("class", "struct"), named("name", self.identifier("type_identifier")) if self.now.kind == "name" else None]
            if self.sees(":"):
                kids += [self.token(), named("base", self.type_specifier())]
            if self.sees("{"):
                def one() -> Syn:
                    name = named("name", self.identifier())
                    return self.make("enumerator", name, self.token(), named("value", self.ternary())) if self.sees("=") else self.make("enumerator", name)

                kids.append(named("body", self.make("enumerator_list", self.token(), *self.listed("}", one), self.take("}"))))
            return self.make("enum_specifier", *kids)
        if self.cpp and t.text == "auto":
            return Syn("placeholder_type_specifier", t.start, t.end, kids=[self.leaf("auto")])
        if self.cpp and t.text == "decltype":
            return self.make("decltype", self.token(), self.take("("), self.expression(), self.take(")"))
        if self.cpp and t.text == "typename":
            return self.make("dependent_type", self.token(), self.type_name())
        if t.text in self.keywords:
            raise Broken
        return self.type_name()

    def base(self) -> Syn:
        while self.sees("public", "private", "protected", "virtual"):
            self.at += 1
        return self.type_name()

    def type_name(self) -> Syn:
        found = self.identifier("type_identifier")
        if self.cpp:
            found = self.templated(found, "template_type")
            while self.sees("::") and self.ahead().kind == "name":
                scope = Syn("namespace_identifier", found.start, found.end) if found.kind == "type_identifier" else found
                colons = self.token()
                found = self.make("qualified_identifier", named("scope", scope), colons, named("name", self.templated(self.identifier("type_identifier"), "template_type")))
        return found

    def templated(self, found: Syn, kind: str) -> Syn:
        if self.sees("<") and (arguments := self.tried(self.template_arguments)):
            return self.make(kind, named("name", found), named("arguments", arguments))
        return found

    def template_arguments(self) -> Syn:
        def one() -> Syn:
            found = self.tried(self.type_descriptor)
            if found is not None and self.sees(",", ">", "..."):
                self.accept("...")
                return found
            return self.binary(LEVELS[7:], self.unary)

        open_ = self.take("<")
        return self.make("template_argument_list", open_, *self.listed(">", one), self.take(">"))

    def type_descriptor(self) -> Syn:
        before, found = self.specifiers()
        if found is None:
            raise Broken
        return self.make("type_descriptor", *before, named("declarator", self.abstract()))

    def abstract(self) -> Syn | None:
        if self.sees("*"):
            return self.make("abstract_pointer_declarator", self.token(), *self.qualifiers(), named("declarator", self.abstract()))
        if self.cpp and self.sees("&", "&&"):
            return self.make("abstract_reference_declarator", self.token(), self.abstract())
        if self.sees("["):
            return self.make("abstract_array_declarator", self.token(), None if self.sees("]") else named("size", self.expression()), self.take("]"))
        if self.sees("(") and (self.ahead().text == "*" or self.cpp and self.ahead().text in (")", "const") or self.ahead().text in PRIMITIVE):
            if self.ahead().text == "*":
                inner = self.make("abstract_parenthesized_declarator", self.token(), self.abstract(), self.take(")"))
                return self.make("abstract_function_declarator", named("declarator", inner), named("parameters", self.parameters())) if self.sees("(") else inner
            return self.make("abstract_function_declarator", named("parameters", self.parameters()))
        return None

    def qualifiers(self) -> list[Syn]:
        found = []
        while self.now.kind == "name" and self.now.text in QUALIFIERS:
            found.append(Syn("type_qualifier", self.now.start, self.now.end, kids=[self.token()]))
        return found

    def declarator(self, name: str = "identifier") -> Syn:
        return self.deeper(lambda: self._declarator(name))

    def _declarator(self, name: str) -> Syn:
        if self.sees("*"):
            return self.make("pointer_declarator", self.token(), *self.qualifiers(), named("declarator", self.declarator(name)))
        if self.cpp and self.sees("&", "&&"):
            return self.make("reference_declarator", self.token(), self.declarator(name))
        if self.sees("("):
            found = self.make("parenthesized_declarator", self.token(), self.declarator(name), self.take(")"))
        elif self.cpp and self.sees("["):
            found = self.make("structured_binding_declarator", self.token(), *self.listed("]", self.identifier), self.take("]"))
        else:
            found = self.declared_name(name)
        while True:
            if self.sees("("):
                parameters = self.tried(self.parameters)
                if parameters is None:
                    return found
                found = self.make("function_declarator", named("declarator", found), named("parameters", parameters), *self.after_parameters())
            elif self.sees("["):
                found = self.make("array_declarator", named("declarator", found), self.token(), None if self.sees("]") else named("size", self.expression()), self.take("]"))
            else:
                return found

    def declared_name(self, name: str) -> Syn:
        if self.cpp and self.sees("operator"):
            kids = [self.token()]
            if self.sees("("):
                kids += [self.token(), self.take(")")]
            elif self.now.kind == "sign":
                kids.append(self.token())
                if self.sees("]"):
                    kids.append(self.token())
            else:
                return self.make("operator_cast", *kids, named("type", self.type_descriptor()))
            return self.make("operator_name", *kids)
        if self.cpp and self.sees("~"):
            return self.make("destructor_name", self.token(), self.identifier())
        found = self.identifier(name)
        while self.cpp and self.sees("::") or self.cpp and self.sees("<") and self.tried_scope():
            found = self.templated(found, "template_type") if self.sees("<") else found
            scope = Syn("namespace_identifier", found.start, found.end) if found.kind == name else found
            found = self.make("qualified_identifier", named("scope", scope), self.take("::"), named("name", self.declared_name("identifier")))
        return found

    def tried_scope(self) -> bool:
        at = self.at
        ok = self.tried(self.template_arguments) is not None and self.sees("::")
        self.at = at
        return ok

    def after_parameters(self) -> list[Syn]:
        kids: list[Syn] = []
        while self.cpp:
            if self.sees("const", "volatile"):
                kids += self.qualifiers()
            elif self.sees("noexcept"):
                kids.append(self.make("noexcept", self.token(), *([self.token(), self.expression(), self.take(")")] if self.sees("(") else [])))
            elif self.sees("override", "final"):
                kids.append(Syn("virtual_specifier", self.now.start, self.now.end, kids=[self.token()]))
            elif self.sees("->"):
                kids.append(self.make("trailing_return_type", self.token(), self.type_descriptor()))
            else:
                break
        return kids

    def parameters(self) -> Syn:
        def one() -> Syn:
            if self.sees("..."):
                return Syn("variadic_parameter", self.now.start, self.now.end, kids=[self.token()])
            before, found = self.specifiers()
            if found is None:
                raise Broken
            self.accept("...")
            declarator = None if self.sees(",", ")", "=") else self.tried(self.declarator) or self.abstract()
            kids = [*before, named("declarator", declarator)]
            if self.cpp and self.sees("="):
                return self.make("optional_parameter_declaration", *kids, self.token(), named("default_value", self.initializer()))
            return self.make("parameter_declaration", *kids)

        return self.make("parameter_list", self.take("("), *self.listed(")", one), self.take(")"))

    def initializer(self) -> Syn:
        return self.initializers() if self.sees("{") else self.assignment()

    def initializers(self) -> Syn:
        def one() -> Syn:
            if self.sees(".", "[") and (pair := self.tried(self.designated)) is not None:
                return pair
            return self.initializer()

        return self.make("initializer_list", self.take("{"), *self.listed("}", one), self.take("}"))

    def designated(self) -> Syn:
        kids: list[Syn] = []
        while self.sees(".", "["):
            if self.sees("."):
                kids.append(named("designator", self.make("field_designator", self.token(), self.identifier("field_identifier"))))
            else:
                kids.append(named("designator", self.make("subscript_designator", self.token(), self.expression(), self.take("]"))))
        return self.make("initializer_pair", *kids, self.take("="), named("value", self.initializer()))

    def declaration(self) -> Syn:
        """A declaration or a function; broken if an expression is as likely."""
        if self.sees("typedef"):
            word = self.token()
            before, found = self.specifiers()
            if found is None:
                raise Broken
            kids = [named("declarator", k) if k.named else k for k in self.listed(";", lambda: self.declarator("type_identifier"))]
            return self.make("type_definition", word, *before, *kids, self.take(";"))
        if self.cpp and (found := self.cpp_declaration()) is not None:
            return found
        start = self.now
        before, kind = self.specifiers()
        if kind is None and not (self.cpp and before):
            raise Broken
        if self.sees(";"):
            if kind is not None and kind.kind in ("struct_specifier", "union_specifier", "enum_specifier", "class_specifier") and len(before) == 1:
                return self.make(kind.kind, *kind.kids, self.token())
            if kind is not None and kind.kind == "type_identifier" and len(before) == 1:
                raise Broken
            return self.make("declaration", *before, self.token())
        plain = kind is not None and kind.kind in ("type_identifier", "qualified_identifier", "template_type") and len(before) == 1
        if plain and self.sees("("):
            raise Broken  # a call
        first = self.declarator()
        if self.sees("{") and first.kind in ("function_declarator", "pointer_declarator", "reference_declarator") or self.cpp and self.sees(":") and first.kind == "function_declarator":
            more = [self.member_initializers()] if self.sees(":") else []
            return self.make("function_definition", *before, named("declarator", first), *more, named("body", self.block()))
        if plain and start.text not in self.keywords and first.kind == "reference_declarator" and not self.sees("=", ";", "{"):
            raise Broken
        kids = [self.initialized(first)]
        while self.sees(","):
            kids += [self.token(), self.initialized(self.declarator())]
        if self.cpp and self.sees(":"):
            raise Broken
        return self.make("declaration", *before, *(named("declarator", k) if k.named else k for k in kids), self.take(";"))

    def initialized(self, declarator: Syn) -> Syn:
        if self.sees("="):
            return self.make("init_declarator", named("declarator", declarator), self.token(), named("value", self.initializer()))
        if self.cpp and self.sees("{"):
            return self.make("init_declarator", named("declarator", declarator), named("value", self.initializers()))
        if self.cpp and self.sees("("):
            return self.make("init_declarator", named("declarator", declarator), named("value", self.arguments()))
        return declarator

    def fields(self) -> Syn:
        kids = [self.take("{")]
        while not self.sees("}") and self.now.kind != "end":
            if self.sees(";"):
                kids.append(self.token())
            else:
                kids.append(self.recovered(self.field, self.starts))
        return self.make("field_declaration_list", *kids, self.take("}"))

    def field(self) -> Syn:
        if self.now.kind == "directive":
            return self.directive()
        if self.cpp and (found := self.cpp_member()) is not None:
            return found
        before, kind = self.specifiers()
        if kind is None:
            raise Broken
        kids: list[Syn] = []
        while not self.sees(";"):
            if not self.sees(":"):
                one = named("declarator", self.declarator("field_identifier"))
                if self.cpp and one.kind in ("function_declarator", "reference_declarator", "pointer_declarator") and self.sees("{", ":"):
                    more = [self.member_initializers()] if self.sees(":") else []
                    return self.make("function_definition", *before, one, *more, named("body", self.block()))
                kids.append(one)
            if self.sees(":"):
                kids.append(self.make("bitfield_clause", self.token(), self.ternary()))
            if self.sees("=") and self.ahead().text in ("delete", "default"):
                equals, what = self.token(), self.token()
                clause = self.make(f"{what.kind}_method_clause", equals, what, self.take(";"))
                return self.make("function_definition", *before, *kids, clause)
            if self.sees("="):
                kids += [self.token(), named("default_value", self.initializer())]
            elif self.cpp and self.sees("{"):
                kids.append(named("default_value", self.initializers()))
            if not self.sees(";"):
                kids.append(self.take(","))
        return self.make("field_declaration", *before, *kids, self.token())

    def cpp_declaration(self) -> Syn | None:
        return None

    def cpp_member(self) -> Syn | None:
        return None

    def member_initializers(self) -> Syn:
        raise Broken

    # -- statements ------------------------------------------------------------------------------------------------

    def block(self) -> Syn:
        def inside() -> Syn:
            kids = [self.take("{")]
            while not self.sees("}") and self.now.kind != "end":
                kids.append(self.recovered(self.item, self.starts))
            return self.make("compound_statement", *kids, self.take("}"))

        return self.deeper(inside)

    def item(self) -> Syn:
        if self.now.kind == "directive":
            return self.directive()
        return (self.tried(self.declaration) if self.declares() else None) or self.statement()

    def declares(self) -> bool:
        """Whether a declaration may begin here."""
        t, after = self.now, self.ahead()
        if t.kind != "name" or t.text in ("return", "if", "for", "while", "do", "switch", "case", "default", "goto", "break", "continue", "else", "sizeof"):
            return False
        if t.text in self.keywords or t.text in PRIMITIVE:
            return True
        if after.kind == "name" and after.text not in ("and", "or"):
            return True
        if self.cpp and after.text in ("::", "<"):
            return True
        at = 1
        while self.ahead(at).text in ("*", "&", "&&", "const"):
            at += 1
        return at > 1 and self.ahead(at).kind == "name" and self.ahead(at + 1).text in ("=", ";", ",", "[", "{", ")")

    def statement(self) -> Syn:
        return self.deeper(self._statement)

    def parenthesized(self) -> Syn:
        return self.make("parenthesized_expression", self.take("("), self.commas(), self.take(")"))

    def condition(self) -> Syn:
        return self.parenthesized()

    def _statement(self) -> Syn:
        word = self.now.text if self.now.kind in ("name", "sign") else ""
        if word == "{":
            return self.block()
        if word == ";":
            return self.make("expression_statement", self.token())
        if word == "if":
            kids = [self.token(), self.accept("constexpr"), named("condition", self.condition()), named("consequence", self.item())]
            if self.sees("else"):
                kids.append(named("alternative", self.make("else_clause", self.token(), self.item())))
            return self.make("if_statement", *kids)
        if word == "while":
            return self.make("while_statement", self.token(), named("condition", self.condition()), named("body", self.item()))
        if word == "do":
            return self.make("do_statement", self.token(), named("body", self.item()), self.take("while"), named("condition", self.parenthesized()), self.take(";"))
        if word == "switch":
            return self.make("switch_statement", self.token(), named("condition", self.condition()), named("body", self.block()))
        if word in ("case", "default") and (word == "case" or self.ahead().text == ":"):
            kids = [self.token()] if word == "default" else [self.token(), named("value", self.ternary())]
            kids.append(self.take(":"))
            while not self.sees("case", "default", "}") and self.now.kind != "end":
                kids.append(self.recovered(self.item, self.starts))
            return self.make("case_statement", *kids)
        if word == "for":
            return self.for_()
        if word == "return":
            return self.make("return_statement", self.token(), None if self.sees(";") else self.initializers() if self.sees("{") else self.commas(), self.take(";"))
        if word in ("break", "continue"):
            return self.make(f"{word}_statement", self.token(), self.take(";"))
        if word == "goto":
            return self.make("goto_statement", self.token(), named("label", self.identifier("statement_identifier")), self.take(";"))
        if self.now.kind == "name" and self.ahead().text == ":" and word not in self.keywords:
            return self.make("labeled_statement", named("label", self.identifier("statement_identifier")), self.token(), self.item())
        if (found := self.cpp_statement(word)) is not None:
            return found
        found = self.commas()
        return self.make("expression_statement", found, None if found.kind == "identifier" and self.sees("}") else self.take(";"))

    def cpp_statement(self, word: str) -> Syn | None:
        return None

    def for_(self) -> Syn:
        kids = [self.token(), self.take("(")]
        if self.cpp and (each := self.tried(self.range_head)) is not None:
            return self.make("for_range_loop", *kids, *each, self.take(")"), named("body", self.item()))
        if (first := self.tried(self.declaration)) is not None:
            kids.append(named("initializer", first))
        else:
            kids += [None if self.sees(";") else named("initializer", self.commas()), self.take(";")]
        kids += [None if self.sees(";") else named("condition", self.commas()), self.take(";")]
        kids += [None if self.sees(")") else named("update", self.commas()), self.take(")")]
        return self.make("for_statement", *kids, named("body", self.item()))

    def range_head(self) -> list[Syn]:
        before, kind = self.specifiers()
        if kind is None:
            raise Broken
        return [*before, named("declarator", self.declarator()), self.take(":"), named("right", self.initializer())]

    # -- expressions -----------------------------------------------------------------------------------------------

    def commas(self) -> Syn:
        found = self.expression()
        while self.sees(","):
            found = self.make("comma_expression", named("left", found), self.token(), named("right", self.expression()))
        return found

    def expression(self) -> Syn:
        return self.assignment()

    def assignment(self) -> Syn:
        return self.deeper(self._assignment)

    def _assignment(self) -> Syn:
        if self.cpp and self.sees("throw"):
            raise Broken
        left = self.ternary()
        if self.sees(*ASSIGN):
            return self.make("assignment_expression", named("left", left), named("operator", self.token()), named("right", self.initializer()))
        return left

    def ternary(self) -> Syn:
        found = self.binary(LEVELS, self.unary)
        if self.sees("?"):
            return self.make("conditional_expression", named("condition", found), self.token(), None if self.sees(":") else named("consequence", self.commas()), self.take(":"), named("alternative", self.assignment()))
        return found

    def binary(self, levels: list[dict[str, str]], operand, level: int = 0) -> Syn:
        if level == len(levels):
            return operand()
        left = self.binary(levels, operand, level + 1)
        while self.now.kind == "sign":
            shift = self.now.text == ">" and self.ahead().text == ">" and self.ahead().start == self.now.end
            text = ">>" if shift else self.now.text
            if text not in levels[level] or text == ">" and self.ahead().text == ">=" and self.ahead().start == self.now.end:
                break
            operator = self.token()
            if shift:
                operator = Syn(">>", operator.start, self.token().end, named=False)
            left = self.make("binary_expression", named("left", left), named("operator", operator), named("right", self.binary(levels, operand, level + 1)))
        return left

    def unary(self) -> Syn:
        return self.deeper(self._unary)

    def _unary(self) -> Syn:
        if self.sees("!", "~", "-", "+"):
            return self.make("unary_expression", named("operator", self.token()), named("argument", self.unary()))
        if self.sees("*", "&"):
            return self.make("pointer_expression", named("operator", self.token()), named("argument", self.unary()))
        if self.sees("++", "--"):
            return self.make("update_expression", named("operator", self.token()), named("argument", self.unary()))
        if self.sees("sizeof"):
            word = self.token()
            if self.sees("(") and (kind := self.tried(lambda: [self.token(), named("type", self.type_in_sizeof()), self.take(")")])):
                return self.make("sizeof_expression", word, *kind)
            return self.make("sizeof_expression", word, named("value", self.unary()))
        if self.sees("(") and (found := self.tried(self.cast)) is not None:
            return found
        found = self.postfix(self.primary())
        return found

    def type_in_sizeof(self) -> Syn:
        t = self.now
        if t.kind == "name" and t.text not in self.keywords and t.text not in PRIMITIVE and self.ahead().text == ")":
            raise Broken  # as likely a variable
        return self.type_descriptor()

    def cast(self) -> Syn:
        open_, kind = self.take("("), self.type_descriptor()
        close = self.take(")")
        if self.sees("{"):
            return self.make("compound_literal_expression", open_, named("type", kind), close, named("value", self.initializers()))
        plain = kind.kids[0].kind == "type_identifier" and len(kind.kids) == 1
        if plain and (self.now.kind == "sign" and not self.sees("(", "~", "!") or self.now.kind == "end"):
            raise Broken
        if self.now.kind == "sign" and not self.sees("(", "~", "!", "*", "&", "-", "+", "++", "--", "{"):
            raise Broken
        return self.make("cast_expression", open_, named("type", kind), close, named("value", self.unary()))

    def primary(self) -> Syn:
        t = self.now
        if t.kind == "number":
            return self.leaf("number_literal")
        if t.kind == "string":
            kids = [self.string()]
            while self.now.kind == "string" or self.now.kind == "name" and self.ahead().kind == "string" and len(kids) and self.now.text.isupper():
                kids.append(self.string() if self.now.kind == "string" else self.identifier())
            return kids[0] if len(kids) == 1 else self.make("concatenated_string", *kids)
        if t.kind == "char":
            return self.leaf("char_literal")
        if self.sees("("):
            return self.parenthesized()
        if (found := self.cpp_primary()) is not None:
            return found
        if t.kind == "name" and (t.text not in self.keywords):
            return self.leaf({"true": "true", "false": "false", "NULL": "null", "nullptr": "null"}.get(t.text, "identifier"))
        raise Broken

    def cpp_primary(self) -> Syn | None:
        return None

    def string(self) -> Syn:
        t = self.now
        if t.kind != "string":
            raise Broken
        self.at += 1
        a = self.source.index('"', t.start) + 1
        if "R" in self.source[t.start : a]:
            return Syn("raw_string_literal", t.start, t.end)
        node = Syn("string_literal", t.start, t.end, kids=[Syn(self.source[t.start : a], t.start, a, named=False)])
        for m in PARTS.finditer(self.source, a, t.end - 1):
            node.add(Syn("escape_sequence" if m[0][0] == "\\" else "string_content", m.start(), m.end()))
        return node.add(Syn('"', t.end - 1, t.end, named=False))

    def arguments(self) -> Syn:
        return self.make("argument_list", self.take("("), *self.listed(")", self.argument), self.take(")"))

    def argument(self) -> Syn:
        t = self.now
        if t.kind == "name" and (t.text in PRIMITIVE or t.text in SIZES or t.text in ("struct", "union", "enum", "const")) and (found := self.tried(self.type_descriptor)) is not None and self.sees(",", ")"):
            return found
        return self.initializer()

    def postfix(self, found: Syn) -> Syn:
        while True:
            if self.sees("("):
                found = self.make("call_expression", named("function", found), named("arguments", self.arguments()))
            elif self.sees("["):
                found = self.make("subscript_expression", named("argument", found), self.token(), named("index", self.commas()), self.take("]"))
            elif self.sees(".", "->"):
                operator = named("operator", self.token())
                if self.cpp and self.sees("~"):
                    field = self.make("destructor_name", self.token(), self.identifier())
                else:
                    self.accept("template")
                    field = self.identifier("field_identifier")
                    field = self.call_template(field, "template_method") if self.cpp else field
                found = self.make("field_expression", named("argument", found), operator, named("field", field))
            elif self.sees("++", "--"):
                found = self.make("update_expression", named("argument", found), named("operator", self.token()))
            elif self.cpp and self.sees("{") and found.kind in ("template_function", "qualified_identifier"):
                found = self.make("compound_literal_expression", named("type", found), named("value", self.initializers()))
            else:
                return found

    def call_template(self, found: Syn, kind: str) -> Syn:
        """A name with template arguments in front of a call."""
        def whole() -> Syn:
            arguments = self.template_arguments()
            if not self.sees("(", "::", "{"):
                raise Broken
            return self.make(kind, named("name", found), named("arguments", arguments))

        return (self.tried(whole) if self.sees("<") else None) or found


class _Cpp(_C):
    keywords = KEYWORDS_CPP
    cpp = True

    def cpp_declaration(self) -> Syn | None:
        if self.sees("namespace"):
            kids = [self.token(), named("name", self.scoped()) if self.now.kind == "name" else None]
            if self.sees("="):
                return self.make("namespace_alias_definition", *kids, self.token(), self.scoped(), self.take(";"))
            return self.make("namespace_definition", *kids, named("body", self.listed_declarations()))
        if self.sees("using"):
            word = self.token()
            if self.now.kind == "name" and self.ahead().text == "=":
                return self.make("alias_declaration", word, named("name", self.identifier("type_identifier")), self.token(), named("type", self.type_descriptor()), self.take(";"))
            return self.make("using_declaration", word, self.accept("namespace"), self.scoped(), self.take(";"))
        if self.sees("template"):
            word = self.token()
            parameters = self.make("template_parameter_list", self.take("<"), *self.listed(">", self.template_parameter), self.take(">"))
            return self.make("template_declaration", word, named("parameters", parameters), self.tried(self.declaration) or self.field())
        if self.sees("static_assert"):
            return self.make("static_assert_declaration", self.token(), *self.arguments().kids, self.take(";"))
        return None

    def template_parameter(self) -> Syn:
        if self.sees("typename", "class"):
            word, dots = self.token(), self.accept("...")
            name = self.identifier("type_identifier") if self.now.kind == "name" else None
            if self.sees("="):
                return self.make("optional_type_parameter_declaration", word, named("name", name), self.token(), named("default_type", self.type_descriptor()))
            return self.make("variadic_type_parameter_declaration" if dots else "type_parameter_declaration", word, dots, name)
        before, kind = self.specifiers()
        if kind is None:
            raise Broken
        kids = [*before, None if self.sees(",", ">", "=") else named("declarator", self.declarator())]
        if self.sees("="):
            kids += [self.token(), named("default_value", self.binary(LEVELS[7:], self.unary))]
        return self.make("parameter_declaration", *kids)

    def scoped(self) -> Syn:
        if self.sees("::"):
            return self.make("qualified_identifier", self.token(), named("name", self.scoped()))
        found = self.identifier()
        while self.sees("::"):
            found = self.make("qualified_identifier", named("scope", Syn("namespace_identifier", found.start, found.end) if found.kind == "identifier" else found), self.token(), named("name", self.identifier()))
        return found

    def cpp_member(self) -> Syn | None:
        if self.sees("public", "private", "protected") and self.ahead().text == ":":
            token = self.token()
            self.at += 1
            return Syn("access_specifier", token.start, token.end, kids=[token])
        if self.sees("using", "template", "typedef", "static_assert"):
            return self.declaration()
        if self.sees("friend"):
            return self.make("friend_declaration", self.token(), self.declaration())
        return self.tried(self.constructor)

    def constructor(self) -> Syn:
        """A constructor or a destructor: a declarator without a type."""
        before = []
        while self.sees("explicit", "virtual", "inline", "constexpr", "static"):
            before.append(self.token())
        if not (self.now.kind == "name" and self.now.text not in self.keywords and self.ahead().text == "(" or self.sees("~", "operator")):
            raise Broken
        one = named("declarator", self.declarator())
        if one.kind not in ("function_declarator", "operator_cast"):
            raise Broken
        if one.kind == "operator_cast":
            self.accept("(")
        more = [self.member_initializers()] if self.sees(":") else []
        if self.sees("{"):
            return self.make("function_definition", *before, one, *more, named("body", self.block()))
        if self.sees("="):
            equals, what = self.token(), self.token()
            clause = self.make("default_method_clause" if what.kind == "default" else "delete_method_clause", equals, what, self.take(";"))
            return self.make("function_definition", *before, one, clause)
        return self.make("declaration", *before, one, self.take(";"))

    def member_initializers(self) -> Syn:
        def one() -> Syn:
            name = self.identifier("field_identifier")
            return self.make("field_initializer", self.templated(name, "template_method"), self.initializers() if self.sees("{") else self.arguments())

        kids = [self.take(":"), one()]
        while self.sees(","):
            kids += [self.token(), one()]
        return self.make("field_initializer_list", *kids)

    def condition(self) -> Syn:
        def declared() -> Syn:
            open_ = self.take("(")
            before, kind = self.specifiers()
            if kind is None:
                raise Broken
            value = self.make("declaration", *before, named("declarator", self.declarator()), self.take("="), named("value", self.initializer()))
            more = [self.token(), named("value", self.commas())] if self.sees(";") else []
            return self.make("condition_clause", open_, named("value", value) if not more else named("initializer", value), *more, self.take(")"))

        if self.declares_at(1) and (found := self.tried(declared)) is not None:
            return found
        return self.make("condition_clause", self.take("("), named("value", self.commas()), self.take(")"))

    def declares_at(self, by: int) -> bool:
        self.at += by
        found = self.declares()
        self.at -= by
        return found

    def cpp_statement(self, word: str) -> Syn | None:
        if word == "try":
            kids = [self.token(), named("body", self.block())]
            while self.sees("catch"):
                kids.append(self.make("catch_clause", self.token(), named("parameters", self.parameters()), named("body", self.block())))
            return self.make("try_statement", *kids)
        if word == "throw":
            return self.make("throw_statement", self.token(), None if self.sees(";") else self.commas(), self.take(";"))
        if word in ("co_return", "co_yield"):
            return self.make(f"{word}_statement", self.token(), None if self.sees(";") else self.commas(), self.take(";"))
        return None

    def cpp_primary(self) -> Syn | None:
        t = self.now
        if self.sees("new"):
            kids = [self.token()]
            before, kind = self.specifiers()
            if kind is None:
                raise Broken
            kids += before
            if self.sees("["):
                kids.append(named("declarator", self.make("new_declarator", self.token(), named("length", self.expression()), self.take("]"))))
            return self.make("new_expression", *kids, named("arguments", self.arguments() if self.sees("(") else self.initializers() if self.sees("{") else None))
        if self.sees("delete"):
            kids = [self.token()]
            if self.sees("["):
                kids += [self.token(), self.take("]")]
            return self.make("delete_expression", *kids, self.unary())
        if self.sees("this"):
            return self.leaf("this")
        if t.kind == "name" and t.text in ("nullptr", "true", "false"):
            return self.leaf("null" if t.text == "nullptr" else t.text)
        if self.sees("["):
            return self.lambda_()
        if t.kind == "name" and t.text.endswith("_cast") and self.ahead().text == "<":
            name = Syn("identifier", t.start, t.end)
            self.at += 1
            function = self.make("template_function", named("name", name), named("arguments", self.template_arguments()))
            return self.make("call_expression", named("function", function), named("arguments", self.arguments()))
        if self.sees("::"):
            return self.make("qualified_identifier", self.token(), named("name", self.identifier()))
        if t.kind == "name" and (t.text in PRIMITIVE) and self.ahead().text in ("(", "{"):
            return self.leaf("primitive_type")
        if t.kind == "name" and t.text not in self.keywords and self.ahead().text in ("::", "<"):
            found = self.call_template(self.identifier(), "template_function")
            while self.sees("::") and self.ahead().kind == "name":
                scope = Syn("namespace_identifier", found.start, found.end) if found.kind == "identifier" else found
                if scope.kind == "template_function":
                    scope.kind = "template_type"
                found = self.make("qualified_identifier", named("scope", scope), self.token(), named("name", self.call_template(self.identifier(), "template_function")))
            return found
        return None

    def lambda_(self) -> Syn:
        kids = [self.take("[")]
        depth = 1
        while depth:
            t = self.now
            if t.kind == "end":
                raise Broken
            depth += (t.text == "[") - (t.text == "]")
            if t.kind == "name" and t.text not in self.keywords:
                kids.append(self.leaf("identifier"))
            else:
                kids.append(self.token())
        captures = self.make("lambda_capture_specifier", *kids)
        more = []
        if self.sees("("):
            parameters = self.parameters()
            more = [named("declarator", self.make("abstract_function_declarator", named("parameters", parameters), *(self.token() for _ in range(self.sees("mutable"))), *self.after_parameters()))]
        return self.make("lambda_expression", named("captures", captures), *more, named("body", self.block()))


def _parse(source: str, kind: type[_C]) -> Syn:
    parser = kind(source)
    return with_comments(parser.unit(), parser.comments)


def parse(source: str) -> Syn:
    return _parse(source, _C)


def parse_cpp(source: str) -> Syn:
    return _parse(source, _Cpp)
