"""Rust: items and statements may stand at the top of a file, as fragments do. What is between a macro's brackets is tokens."""

from __future__ import annotations

import re

from .code import Broken, Parser, Token, named, with_comments
from .tree import Syn

LEX = re.compile(
    r"(?P<space>[\s﻿]+)|(?P<line_comment>//[^\n]*)|(?P<block_comment>/\*)|(?P<raw>b?r(?P<mark>#*)\".*?\"(?P=mark))|(?P<string>[bc]?\"(?:\\.|[^\"\\])*\")|"
    r"(?P<char>b?'(?:\\(?:x[\da-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])')|(?P<life>'[^\W\d]\w*)|(?P<name>r#[^\W\d]\w*|[^\W\d]\w*)|"
    r"(?P<float>\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?[\d_]+)?|[eE][+-]?[\d_]+)(?:f32|f64)?|\d[\d_]*\.(?![.\w])|\d[\d_]*f(?:32|64))|(?P<int>0[xX][\da-fA-F_]+\w*|0[bB][01_]+\w*|0[oO][0-7_]+\w*|\d[\d_]*[iu]?\w*)|"
    r"(?P<sign><<=|>>=|\.\.\.|\.\.=|\.\.|=>|->|::|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!<>=?:;,.@#$~(){}\[\]])|(?P<bad>.)",
    re.S,
)
KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
PRIMITIVE = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())
LITERALS = {"int": "integer_literal", "float": "float_literal", "char": "char_literal", "raw": "raw_string_literal", "string": "string_literal"}
LEVELS = [dict.fromkeys(x.split(), "binary_expression") for x in ("||", "&&", "== != < > <= >=", "|", "^", "&", "<< >>", "+ -", "* / %")]
COMPOUND = ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=")
BLOCKLIKE = ("if_expression", "match_expression", "while_expression", "loop_expression", "for_expression", "block", "unsafe_block", "async_block", "const_block")
OPEN = {"(": ")", "[": "]", "{": "}"}


def _tokens(source: str) -> tuple[list[Token], list[Syn]]:
    tokens: list[Token] = []
    comments: list[Syn] = []
    at, fresh = 0, True
    while at < len(source):
        m = LEX.match(source, at)
        kind = "raw" if m.lastgroup == "mark" else m.lastgroup
        end = m.end()
        if kind == "space":
            fresh = fresh or "\n" in m[0]
        elif kind == "line_comment":
            comments.append(Syn(kind, at, end, extra=True))
        elif kind == "block_comment":
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(source, end)):
                depth, end = depth + (1 if n[0] == "/*" else -1), n.end()
            end = len(source) if depth else end
            comments.append(Syn(kind, at, end, extra=True))
        else:
            if kind in LITERALS:
                tokens.append(Token("literal", kind, at, end, fresh))
            else:
                tokens.append(Token("sign" if kind == "bad" else kind, m[0], at, end, fresh))
            fresh = False
        at = end
    tokens.append(Token("end", "", len(source), len(source), True))
    return tokens, comments


class _Rust(Parser):
    keywords = KEYWORDS
    plain = False  # in a head, where a brace opens the body

    def file(self) -> Syn:
        root = Syn("source_file", 0, len(self.source))
        while self.now.kind != "end":
            root.add(self.recovered(lambda: self.statement(("end",)), self.starts))
        return root

    @staticmethod
    def starts(t: Token) -> bool:
        return t.fresh or t.text == ";"

    def free(self, parse):
        plain, self.plain = self.plain, False
        found = parse()
        self.plain = plain
        return found

    def head(self, parse):
        plain, self.plain = self.plain, True
        found = parse()
        self.plain = plain
        return found

    # -- items -----------------------------------------------------------------------------------------------------

    def attribute(self) -> Syn:
        sign, bang, open_ = self.token(), self.accept("!"), self.take("[")
        path = self.path("identifier")
        more = []
        if self.sees("="):
            more = [self.token(), named("value", self.expression())]
        elif self.sees("(", "[", "{"):
            more = [named("arguments", self.token_tree())]
        return self.make("inner_attribute_item" if bang else "attribute_item", sign, bang, open_, self.make("attribute", path, *more), self.take("]"))

    def visibility(self) -> Syn | None:
        if not self.sees("pub"):
            return None
        kids = [self.token()]
        if self.sees("(") and self.ahead().text in ("crate", "self", "super", "in"):
            kids += [self.token(), self.accept("in"), self.path("identifier"), self.take(")")]
        return self.make("visibility_modifier", *kids)

    def item(self) -> Syn | None:
        """An item, or None if none begins here."""
        if self.sees("#"):
            return self.attribute()
        at = self.at
        seen = self.visibility()
        word, after = self.now.text, self.ahead().text
        if self.now.kind != "name":
            found = None
        elif word == "fn" or word in ("const", "async", "unsafe", "extern") and (after in ("fn", "unsafe", "async", "extern") or self.ahead().kind == "literal" and self.ahead(2).text == "fn"):
            return self.function(seen)
        elif word == "unsafe" and after in ("impl", "trait"):
            self.at += 1
            return self.item()
        else:
            found = {"struct": self.struct, "union": self.struct, "enum": self.enum, "impl": self.impl, "trait": self.trait, "mod": self.mod, "use": self.use, "const": self.const, "static": self.const, "type": self.type_item, "extern": self.extern, "macro_rules": self.macro_rules}.get(word)
            if word == "union" and self.ahead().kind != "name" or word == "const" and after == "{" or word == "macro_rules" and after != "!":
                found = None
        if found is None:
            if seen is not None:
                raise Broken
            self.at = at
            return None
        return found(seen)

    def function(self, seen: Syn | None) -> Syn:
        kids = []
        while not self.sees("fn"):
            kids.append(self.token() if self.now.kind == "name" else self.literal())
        modifiers = self.make("function_modifiers", *kids) if kids else None
        kids = [seen, modifiers, self.token(), named("name", self.identifier()), self.type_parameters(), named("parameters", self.parameters())]
        if self.sees("->"):
            kids += [self.token(), named("return_type", self.type())]
        kids.append(self.where())
        return self.make("function_signature_item", *kids, self.token()) if self.sees(";") else self.make("function_item", *kids, named("body", self.block()))

    def parameters(self) -> Syn:
        def one() -> Syn:
            while self.sees("#"):
                self.attribute()
            at = self.at
            own = []
            if self.sees("&"):
                own.append(self.token())
                if self.now.kind == "life":
                    own.append(self.lifetime())
            if self.sees("mut"):
                own.append(Syn("mutable_specifier", self.now.start, self.now.end, kids=[self.token()]))
            if self.sees("self") and self.ahead().text != ":":
                return self.make("self_parameter", *own, self.leaf("self"))
            self.at = at
            if self.sees("..."):
                return self.make("variadic_parameter", self.token())
            mutable = Syn("mutable_specifier", self.now.start, self.now.end, kids=[self.token()]) if self.sees("mut") else None
            pattern = named("pattern", self.leaf("self") if self.sees("self") else self.pattern())
            if mutable is None and pattern.kind == "identifier" and self.sees(",", ")"):
                return Syn("type_identifier", pattern.start, pattern.end)
            return self.make("parameter", mutable, pattern, self.take(":"), named("type", self.type()))

        return self.make("parameters", self.take("("), *self.listed(")", one), self.take(")"))

    def lifetime(self) -> Syn:
        t = self.now
        self.at += 1
        return Syn("lifetime", t.start, t.end, kids=[Syn("'", t.start, t.start + 1, named=False), Syn("identifier", t.start + 1, t.end)])

    def type_parameters(self) -> Syn | None:
        if not self.sees("<"):
            return None

        def one() -> Syn:
            if self.now.kind == "life":
                name = self.lifetime()
                return self.make("constrained_type_parameter", named("left", name), named("bounds", self.bounds())) if self.sees(":") else name
            if self.sees("const"):
                kids = [self.token(), named("name", self.identifier()), self.take(":"), named("type", self.type())]
                return self.make("const_parameter", *kids, *([self.token(), named("value", self.unary())] if self.sees("=") else []))
            name = self.identifier("type_identifier")
            if self.sees(":"):
                name = self.make("constrained_type_parameter", named("left", name), named("bounds", self.bounds()))
            return self.make("optional_type_parameter", named("name", name), self.token(), named("default_type", self.type())) if self.sees("=") else name

        return named("type_parameters", self.make("type_parameters", self.token(), *self.listed(">", one), self.take(">")))

    def bounds(self) -> Syn:
        kids = [self.take(":")]
        while not self.sees(",", ">", "{", "=", ";", "where"):
            if self.sees("+"):
                kids.append(self.token())
            elif self.now.kind == "life":
                kids.append(self.lifetime())
            elif self.sees("?"):
                kids.append(self.make("removed_trait_bound", self.token(), self.type()))
            else:
                kids.append(self.type())
        return self.make("trait_bounds", *kids)

    def where(self) -> Syn | None:
        if not self.sees("where"):
            return None
        kids = [self.token()]
        while not self.sees("{", ";"):
            left = self.lifetime() if self.now.kind == "life" else self.type()
            kids.append(self.make("where_predicate", named("left", left), named("bounds", self.bounds())))
            if not self.sees("{", ";"):
                kids.append(self.take(","))
        return self.make("where_clause", *kids)

    def fields(self) -> Syn:
        def one() -> Syn:
            before = []
            while self.sees("#"):
                before.append(self.attribute())
            return self.make("field_declaration", self.visibility(), named("name", self.identifier("field_identifier")), self.take(":"), named("type", self.type()))

        return self.make("field_declaration_list", self.take("{"), *self.listed("}", one), self.take("}"))

    def ordered(self) -> Syn:
        def one() -> Syn:
            while self.sees("#"):
                self.attribute()
            self.visibility()
            return named("type", self.type())

        return self.make("ordered_field_declaration_list", self.take("("), *self.listed(")", one), self.take(")"))

    def struct(self, seen: Syn | None) -> Syn:
        kids = [seen, self.token(), named("name", self.identifier("type_identifier")), self.type_parameters(), self.where()]
        kind = f"{kids[1].kind}_item"
        if self.sees("{"):
            return self.make(kind, *kids, named("body", self.fields()))
        if self.sees("("):
            kids.append(named("body", self.ordered()))
        return self.make(kind, *kids, self.where(), self.take(";"))

    def enum(self, seen: Syn | None) -> Syn:
        def variant() -> Syn:
            while self.sees("#"):
                self.attribute()
            kids = [named("name", self.identifier())]
            if self.sees("{"):
                kids.append(named("body", self.fields()))
            elif self.sees("("):
                kids.append(named("body", self.ordered()))
            if self.sees("="):
                kids += [self.token(), named("value", self.expression())]
            return self.make("enum_variant", *kids)

        kids = [seen, self.token(), named("name", self.identifier("type_identifier")), self.type_parameters(), self.where()]
        return self.make("enum_item", *kids, named("body", self.make("enum_variant_list", self.take("{"), *self.listed("}", variant), self.take("}"))))

    def declarations(self) -> Syn:
        kids = [self.take("{")]
        while not self.sees("}") and self.now.kind != "end":
            kids.append(self.recovered(self.declared, self.starts))
        return self.make("declaration_list", *kids, self.take("}"))

    def declared(self) -> Syn:
        found = self.item()
        if found is None and self.now.kind == "name" and self.ahead().text == "}":
            found = self.identifier()  # what stands for items in a pattern
        if found is None:
            found = self.make("macro_invocation", *self.macro().kids, self.accept(";"))
        return found

    def impl(self, seen: Syn | None) -> Syn:
        kids = [self.token(), self.type_parameters(), self.accept("!")]
        first = self.type()
        if self.sees("for"):
            kids += [named("trait", first), self.token(), named("type", self.type())]
        else:
            kids.append(named("type", first))
        return self.make("impl_item", *kids, self.where(), named("body", self.declarations()))

    def trait(self, seen: Syn | None) -> Syn:
        kids = [seen, self.token(), named("name", self.identifier("type_identifier")), self.type_parameters(), named("bounds", self.bounds()) if self.sees(":") else None, self.where()]
        return self.make("trait_item", *kids, named("body", self.declarations()))

    def mod(self, seen: Syn | None) -> Syn:
        kids = [seen, self.token(), named("name", self.identifier())]
        return self.make("mod_item", *kids, self.token() if self.sees(";") else named("body", self.declarations()))

    def extern(self, seen: Syn | None) -> Syn:
        kids = [seen, self.token()]
        if self.sees("crate"):
            kids += [self.token(), named("name", self.identifier())]
            if self.sees("as"):
                kids += [self.token(), named("alias", self.identifier())]
            return self.make("extern_crate_declaration", *kids, self.take(";"))
        return self.make("foreign_mod_item", *kids, self.literal() if self.now.kind == "literal" else None, named("body", self.declarations()))

    def use(self, seen: Syn | None) -> Syn:
        return self.make("use_declaration", seen, self.token(), named("argument", self.use_tree()), self.take(";"))

    def use_tree(self) -> Syn:
        def listed() -> Syn:
            return self.make("use_list", self.token(), *self.listed("}", self.use_tree), self.take("}"))

        if self.sees("{"):
            return listed()
        if self.sees("*"):
            return self.make("use_wildcard", self.token())
        lead = [self.token()] if self.sees("::") else []
        found = self.segment("identifier")
        while self.sees("::"):
            colons = self.token()
            if self.sees("{"):
                return self.make("scoped_use_list", *lead, named("path", found), colons, named("list", listed()))
            if self.sees("*"):
                return self.make("use_wildcard", found, colons, self.token())
            found = self.make("scoped_identifier", named("path", found), colons, named("name", self.segment("identifier")))
        if self.sees("as"):
            return self.make("use_as_clause", named("path", found), self.token(), named("alias", self.identifier()))
        return found

    def const(self, seen: Syn | None) -> Syn:
        word = self.token()
        kids = [seen, word, Syn("mutable_specifier", self.now.start, self.now.end, kids=[self.token()]) if self.sees("mut") else None, named("name", self.identifier()), self.take(":"), named("type", self.type())]
        if self.sees("="):
            kids += [self.token(), named("value", self.expression())]
        return self.make(f"{word.kind}_item", *kids, self.take(";"))

    def type_item(self, seen: Syn | None) -> Syn:
        kids = [seen, self.token(), named("name", self.identifier("type_identifier")), self.type_parameters()]
        if self.sees(":"):
            kids.append(self.bounds())
        kids.append(self.where())
        if self.sees("="):
            return self.make("type_item", *kids, self.token(), named("type", self.type()), self.where(), self.take(";"))
        return self.make("associated_type", *kids, self.take(";"))

    def macro_rules(self, seen: Syn | None) -> Syn:
        kids = [self.token(), self.take("!"), named("name", self.identifier())]
        tree = self.token_tree()
        return self.make("macro_definition", *kids, tree, self.accept(";"))

    # -- types -----------------------------------------------------------------------------------------------------

    def segment(self, kind: str) -> Syn:
        if self.sees("crate", "self", "super"):
            return self.leaf(self.now.text)
        if self.sees("Self"):
            return self.leaf(kind)
        return self.identifier(kind)

    def path(self, kind: str) -> Syn:
        lead = [self.token()] if self.sees("::") else []
        found = self.segment(kind if self.ahead().text != "::" else "identifier")
        while self.sees("::") and self.ahead().kind == "name":
            colons = self.token()
            last = self.ahead().text != "::" or self.ahead(2).kind != "name"
            found = self.make("scoped_type_identifier" if last and kind == "type_identifier" else "scoped_identifier", *lead, named("path", found), colons, named("name", self.segment(kind if last else "identifier")))
            lead = []
        return found

    def type(self) -> Syn:
        return self.deeper(self._type)

    def _type(self) -> Syn:
        t = self.now
        if t.kind == "sign":
            if self.sees("&", "&&"):
                token = self.token()
                kids = [Syn("&", token.start, token.start + 1, named=False)]
                if self.now.kind == "life":
                    kids.append(self.lifetime())
                if self.sees("mut"):
                    kids.append(Syn("mutable_specifier", self.now.start, self.now.end, kids=[self.token()]))
                return self.make("reference_type", *kids, named("type", self.type()))
            if self.sees("*"):
                return self.make("pointer_type", self.token(), self.take("const", "mut"), named("type", self.type()))
            if self.sees("("):
                kids = [self.token(), *self.listed(")", self.type)]
                close = self.take(")")
                return self.make("unit_type" if len(kids) == 1 else "tuple_type", *kids, close)
            if self.sees("["):
                kids = [self.token(), named("element", self.type())]
                if self.sees(";"):
                    kids += [self.token(), named("length", self.free(self.expression))]
                return self.make("array_type", *kids, self.take("]"))
            if self.sees("!"):
                return self.make("never_type", self.token())
            if self.sees("<"):
                kids = [self.token(), self.type()]
                if self.sees("as"):
                    kids += [self.token(), self.type()]
                bracketed = self.make("bracketed_type", *kids, self.take(">"))
                return self.make("scoped_type_identifier", named("path", bracketed), self.take("::"), named("name", self.identifier("type_identifier")))
            if not self.sees("::"):
                raise Broken
        if t.kind == "name":
            if t.text in ("impl", "dyn"):
                kids = [self.token(), self.type()]
                while self.sees("+"):
                    kids.append(self.token())
                    if self.sees("use"):
                        kids.append(self.make("use_bounds", self.token(), self.type_arguments()))
                    else:
                        kids.append(self.lifetime() if self.now.kind == "life" else self.type())
                return self.make("abstract_type" if t.text == "impl" else "dynamic_type", *kids)
            if t.text in ("fn", "unsafe", "extern") or t.text == "for" and self.ahead().text == "<":
                kids = []
                while not self.sees("fn"):
                    kids.append(self.type_parameters() if self.sees("<") else self.literal() if self.now.kind == "literal" else self.token())
                kids += [self.token(), named("parameters", self.function_types())]
                return self.make("function_type", *kids, *([self.token(), named("return_type", self.type())] if self.sees("->") else []))
            if t.text == "_":
                return self.leaf("_")
            if t.text in PRIMITIVE and self.ahead().text != "::":
                return self.leaf("primitive_type")
        found = self.path("type_identifier")
        if self.sees("!") and self.ahead().text in ("(", "[", "{"):
            return self.make("macro_invocation", named("macro", found), self.token(), self.token_tree())
        if self.sees("::") and self.ahead().text == "<":
            self.at += 1
        if self.sees("<"):
            found = self.make("generic_type", named("type", found), named("type_arguments", self.type_arguments()))
            while self.sees("::") and self.ahead().kind == "name":
                found = self.make("scoped_type_identifier", named("path", found), self.token(), named("name", self.identifier("type_identifier")))
        elif self.sees("(") and self.source[found.start : found.end].rsplit(":", 1)[-1] in ("Fn", "FnMut", "FnOnce"):
            kids = [named("trait", found), named("parameters", self.function_types())]
            found = self.make("function_type", *kids, *([self.token(), named("return_type", self.type())] if self.sees("->") else []))
        return found

    def function_types(self) -> Syn:
        def one() -> Syn:
            if self.now.kind == "name" and self.ahead().text == ":":
                return self.make("parameter", named("pattern", self.identifier()), self.token(), named("type", self.type()))
            return self.type()

        return self.make("parameters", self.take("("), *self.listed(")", one), self.take(")"))

    def type_arguments(self) -> Syn:
        def one() -> Syn:
            if self.now.kind == "life":
                return self.lifetime()
            if self.now.kind == "literal" or self.sees("-", "{"):
                return self.block() if self.sees("{") else self.unary()
            found = self.type()
            if self.sees("="):
                return self.make("type_binding", named("name", found), self.token(), named("type", self.type()))
            return found

        return self.make("type_arguments", self.take("<"), *self.listed(">", one), self.take(">"))

    # -- patterns --------------------------------------------------------------------------------------------------

    def pattern(self) -> Syn:
        def inside() -> Syn:
            if self.sees("|"):
                self.at += 1
            found = self.one_pattern()
            while self.sees("|"):
                found = self.make("or_pattern", found, self.token(), self.one_pattern())
            return found

        return self.deeper(inside)

    def one_pattern(self) -> Syn:
        t = self.now
        if self.sees("&", "&&"):
            token = self.token()
            return self.make("reference_pattern", token, Syn("mutable_specifier", self.now.start, self.now.end, kids=[self.token()]) if self.sees("mut") else None, self.one_pattern())
        if self.sees("ref"):
            return self.make("ref_pattern", self.token(), self.one_pattern())
        if self.sees("mut"):
            return self.make("mut_pattern", Syn("mutable_specifier", self.now.start, self.now.end, kids=[self.token()]), self.one_pattern())
        if self.sees(".."):
            return Syn("remaining_field_pattern", t.start, t.end, kids=[self.token()])
        if self.sees("("):
            return self.make("tuple_pattern", self.token(), *self.listed(")", self.pattern), self.take(")"))
        if self.sees("["):
            return self.make("slice_pattern", self.token(), *self.listed("]", self.pattern), self.take("]"))
        if t.kind == "literal" or self.sees("-", "true", "false"):
            found = self.make("negative_literal", self.token(), self.literal()) if self.sees("-") else self.literal()
            return self.ranged(found)
        if self.sees("_"):
            return self.leaf("_")
        name = self.path("identifier")
        if self.sees("::") and self.ahead().text == "<":
            self.at += 1
            name = self.make("generic_type", named("type", name), named("type_arguments", self.type_arguments()))
        if self.sees("!") and self.ahead().text in ("(", "[", "{"):
            return self.make("macro_invocation", named("macro", name), self.token(), self.token_tree())
        if self.sees("("):
            return self.make("tuple_struct_pattern", named("type", name), self.token(), *self.listed(")", self.pattern), self.take(")"))
        if self.sees("{"):
            def field() -> Syn:
                if self.sees(".."):
                    return Syn("remaining_field_pattern", self.now.start, self.now.end, kids=[self.token()])
                if self.now.kind == "name" and self.ahead().text == ":":
                    return self.make("field_pattern", named("name", self.identifier("field_identifier")), self.token(), named("pattern", self.pattern()))
                return self.make("field_pattern", self.accept("ref"), self.accept("mut"), named("name", self.identifier("shorthand_field_identifier")))

            kind = Syn("type_identifier", name.start, name.end) if name.kind == "identifier" else name
            return self.make("struct_pattern", named("type", kind), self.token(), *self.listed("}", field), self.take("}"))
        if self.sees("@"):
            return self.make("captured_pattern", name, self.token(), self.one_pattern())
        return self.ranged(name)

    def ranged(self, found: Syn) -> Syn:
        if self.sees("..=", "..", "..."):
            sign = self.token()
            last = self.literal() if self.now.kind == "literal" else self.make("negative_literal", self.token(), self.literal()) if self.sees("-") else self.path("identifier") if self.now.kind == "name" and self.now.text not in ("if",) else None
            return self.make("range_pattern", found, sign, last)
        return found

    # -- statements ------------------------------------------------------------------------------------------------

    def block(self) -> Syn:
        def inside() -> Syn:
            kids = [self.take("{")]
            while not self.sees("}") and self.now.kind != "end":
                kids.append(self.recovered(lambda: self.statement(("}",)), self.starts))
            return self.make("block", *kids, self.take("}"))

        return self.deeper(lambda: self.free(inside))

    def statement(self, until: tuple[str, ...]) -> Syn:
        if self.sees(";"):
            return self.make("empty_statement", self.token())
        if (found := self.item()) is not None:
            return found
        if self.sees("let"):
            word = self.token()
            mutable = Syn("mutable_specifier", self.now.start, self.now.end, kids=[self.token()]) if self.sees("mut") else None
            kids = [word, mutable, named("pattern", self.pattern())]
            if self.sees(":"):
                kids += [self.token(), named("type", self.type())]
            if self.sees("="):
                kids += [self.token(), named("value", self.expression())]
            if self.sees("else"):
                kids += [self.token(), named("alternative", self.block())]
            return self.make("let_declaration", *kids, self.take(";"))
        found = self.block_like() or self.expression()
        if self.sees(";"):
            return self.make("expression_statement", found, self.token())
        if self.sees("}") or self.now.kind == "end":
            return found if self.sees("}") and found.kind not in BLOCKLIKE else self.make("expression_statement", found) if found.kind in BLOCKLIKE else found
        if found.kind in BLOCKLIKE or found.kind == "macro_invocation" and self.source[found.end - 1] == "}":
            return self.make("expression_statement", found)
        raise Broken

    def block_like(self) -> Syn | None:
        """An expression with a block, which ends a statement if no member or question mark follows."""
        if not self.sees("if", "match", "while", "loop", "for", "unsafe", "{") and not (self.now.kind == "life" and self.ahead().text == ":"):
            return None
        at = self.at
        found = self.free(self.primary)
        if self.sees(".", "?"):
            self.at = at
            return None
        return found

    # -- expressions -----------------------------------------------------------------------------------------------

    def expression(self) -> Syn:
        return self.deeper(self._expression)

    def _expression(self) -> Syn:
        left = self.range()
        if self.sees("="):
            return self.make("assignment_expression", named("left", left), self.token(), named("right", self.expression()))
        if self.sees(*COMPOUND) or self.sees(">") and self.ahead().text == ">=" and self.ahead().start == self.now.end:
            first = self.token()
            operator = Syn(">>=", first.start, self.token().end, named=False) if first.kind == ">" else first
            return self.make("compound_assignment_expr", named("left", left), named("operator", operator), named("right", self.expression()))
        return left

    def range(self) -> Syn:
        ends = lambda: self.sees(")", "]", "}", ",", ";", "=>") or self.plain and self.sees("{") or self.now.kind == "end"
        if self.sees("..", "..="):
            sign = self.token()
            return self.make("range_expression", sign, None if ends() else self.binary(LEVELS, self.unary))
        left = self.binary(LEVELS, self.unary)
        if self.sees("..", "..="):
            sign = self.token()
            return self.make("range_expression", left, sign, None if ends() else self.binary(LEVELS, self.unary))
        return left

    def binary(self, levels: list[dict[str, str]], operand, level: int = 0) -> Syn:
        if level == len(levels):
            found = operand()
            while self.sees("as"):
                found = self.make("type_cast_expression", named("value", found), self.token(), named("type", self.type()))
            return found
        left = self.binary(levels, operand, level + 1)
        while self.now.kind == "sign":
            touching = self.now.text == ">" and self.ahead().start == self.now.end and self.ahead().text in (">", ">=")
            if touching and self.ahead().text == ">=":
                break
            text = ">>" if touching else self.now.text
            if text not in levels[level]:
                break
            operator = self.token()
            if touching:
                operator = Syn(">>", operator.start, self.token().end, named=False)
            left = self.make("binary_expression", named("left", left), named("operator", operator), named("right", self.binary(levels, operand, level + 1)))
        return left

    def unary(self) -> Syn:
        return self.deeper(self._unary)

    def _unary(self) -> Syn:
        if self.sees("-", "!", "*"):
            return self.make("unary_expression", self.token(), self.unary())
        if self.sees("&", "&&"):
            token = self.token()
            one = lambda start: Syn("&", start, start + 1, named=False)
            mutable = Syn("mutable_specifier", self.now.start, self.now.end, kids=[self.token()]) if self.sees("mut") else None
            found = self.make("reference_expression", one(token.end - 1), mutable, named("value", self.unary()))
            return found if token.kind == "&" else self.make("reference_expression", one(token.start), named("value", found))
        return self.postfix(self.primary())

    def literal(self) -> Syn:
        t = self.now
        if self.sees("true", "false"):
            token = self.token()
            return Syn("boolean_literal", t.start, t.end, kids=[token])
        if t.kind != "literal":
            raise Broken
        self.at += 1
        node = Syn(LITERALS[t.text], t.start, t.end)
        if t.text == "string":
            a = self.source.index('"', t.start) + 1
            node.add(Syn('"', t.start, a, named=False))
            if a < t.end - 1:
                node.add(Syn("string_content", a, t.end - 1))
            node.add(Syn('"', t.end - 1, t.end, named=False))
        return node

    def primary(self) -> Syn:
        t = self.now
        if t.kind == "literal" or self.sees("true", "false"):
            return self.literal()
        if t.kind == "life":
            label = self.make("label", *self.lifetime().kids)
            colon = self.take(":")
            found = self.primary()
            return Syn(found.kind, label.start, found.end, kids=[label, colon, *found.kids])
        if self.sees("("):
            open_ = self.token()
            if self.sees(")"):
                return self.make("unit_expression", open_, self.token())
            first = self.free(self.expression)
            if self.sees(")"):
                return self.make("parenthesized_expression", open_, first, self.token())
            comma = self.take(",")
            return self.make("tuple_expression", open_, first, comma, *self.free(lambda: self.listed(")", self.expression)), self.take(")"))
        if self.sees("["):
            open_ = self.token()
            if self.sees("]"):
                return self.make("array_expression", open_, self.token())
            first = self.free(self.expression)
            if self.sees(";"):
                return self.make("array_expression", open_, first, self.token(), named("length", self.free(self.expression)), self.take("]"))
            more = [self.take(","), *self.free(lambda: self.listed("]", self.expression))] if not self.sees("]") else []
            return self.make("array_expression", open_, first, *more, self.take("]"))
        if self.sees("{"):
            return self.block()
        if self.sees("|", "||", "move", "static") or self.sees("async") and self.ahead().text in ("move", "|", "||") and self.ahead(2).text in ("|", "||", "{") and self.ahead(2).text != "{":
            return self.closure()
        if self.sees("if"):
            kids = [self.token(), named("condition", self.condition()), named("consequence", self.block())]
            if self.sees("else"):
                kids.append(named("alternative", self.make("else_clause", self.token(), self.primary() if self.sees("if") else self.block())))
            return self.make("if_expression", *kids)
        if self.sees("match"):
            return self.match()
        if self.sees("while"):
            return self.make("while_expression", self.token(), named("condition", self.condition()), named("body", self.block()))
        if self.sees("loop"):
            return self.make("loop_expression", self.token(), named("body", self.block()))
        if self.sees("for"):
            kids = [self.token(), named("pattern", self.pattern()), self.take("in"), named("value", self.head(self.expression))]
            return self.make("for_expression", *kids, named("body", self.block()))
        if self.sees("unsafe", "async", "const") and (self.ahead().text == "{" or self.ahead().text == "move"):
            word = self.token()
            return self.make(f"{word.kind}_block", word, self.accept("move"), self.block())
        if self.sees("return", "break", "continue"):
            word = self.token()
            label = self.make("label", *self.lifetime().kids) if self.now.kind == "life" else None
            value = None if word.kind == "continue" or self.sees(";", "}", ")", ",", "]", "=>") or self.now.kind == "end" or self.plain and self.sees("{") else self.expression()
            return self.make(f"{word.kind}_expression", word, label, value)
        if self.sees("let"):
            return self.let_condition()
        if self.sees("<"):
            kind = self._type()
            return Syn("scoped_identifier", kind.start, kind.end, kids=kind.kids)
        if t.kind != "name" and not self.sees("::"):
            raise Broken
        found = self.path("identifier")
        if self.sees("::") and self.ahead().text == "<":
            colons, arguments = self.token(), self.type_arguments()
            if self.sees("::"):
                found = self.make("scoped_identifier", named("path", self.make("generic_type", named("type", found), colons, named("type_arguments", arguments))), self.token(), named("name", self.identifier()))
            else:
                found = self.make("generic_function", named("function", found), colons, named("type_arguments", arguments))
        if self.sees("!") and self.ahead().text in OPEN:
            return self.make("macro_invocation", named("macro", found), self.token(), self.token_tree())
        if self.sees("{") and not self.plain and found.kind in ("identifier", "scoped_identifier"):
            kind = Syn("type_identifier", found.start, found.end) if found.kind == "identifier" else Syn("scoped_type_identifier", found.start, found.end, kids=found.kids)
            return self.make("struct_expression", named("name", kind), named("body", self.free(self.field_values)))
        return found

    def macro(self) -> Syn:
        return self.make("macro_invocation", named("macro", self.path("identifier")), self.take("!"), self.token_tree())

    def token_tree(self) -> Syn:
        open_ = self.take(*OPEN)
        kids, close = [open_], OPEN[open_.kind]
        while not self.sees(close):
            t = self.now
            if t.kind == "end" or self.sees(")", "]", "}"):
                raise Broken
            if self.sees(*OPEN):
                kids.append(self.deeper(self.token_tree))
            elif t.kind == "literal" or self.sees("true", "false"):
                kids.append(self.literal())
            elif t.kind == "name" and t.text not in KEYWORDS:
                kids.append(self.leaf("primitive_type" if t.text in PRIMITIVE else "identifier"))
            elif self.sees("self", "crate", "super"):
                kids.append(self.leaf(t.text))
            else:
                kids.append(self.token())
        return self.make("token_tree", *kids, self.token())

    def field_values(self) -> Syn:
        def one() -> Syn:
            while self.sees("#"):
                self.attribute()
            if self.sees(".."):
                return self.make("base_field_initializer", self.token(), self.expression())
            if self.ahead().text == ":":
                name = self.leaf("integer_literal") if self.now.kind == "literal" else self.identifier("field_identifier")
                return self.make("field_initializer", named("field", name), self.token(), named("value", self.expression()))
            return self.make("shorthand_field_initializer", self.identifier())

        return self.make("field_initializer_list", self.take("{"), *self.listed("}", one), self.take("}"))

    def condition(self) -> Syn:
        return self.head(self.expression)

    def let_condition(self) -> Syn:
        return self.make("let_condition", self.token(), named("pattern", self.pattern()), self.take("="), named("value", self.binary(LEVELS[2:], self.unary)))

    def match(self) -> Syn:
        kids = [self.token(), named("value", self.head(self.expression))]
        body = [self.take("{")]

        def arm() -> Syn:
            while self.sees("#"):
                self.attribute()
            pattern = [self.pattern()]
            if self.sees("if"):
                pattern += [self.token(), named("condition", self.expression())]
            head = [named("pattern", self.make("match_pattern", *pattern)), self.take("=>")]
            value = self.block_like() if self.sees("{") else None
            if value is not None and not self.sees(",", "}"):
                return self.make("match_arm", *head, named("value", value))
            value = value or self.expression()
            return self.make("match_arm", *head, named("value", value), None if self.sees("}") else self.take(","))

        while not self.sees("}") and self.now.kind != "end":
            body.append(self.free(arm))
        return self.make("match_expression", *kids, named("body", self.make("match_block", *body, self.take("}"))))

    def closure(self) -> Syn:
        kids = []
        while self.sees("static", "async", "move"):
            kids.append(self.token())
        if self.sees("||"):
            t = self.token()
            parameters = Syn("closure_parameters", t.start, t.end, kids=[Syn("|", t.start, t.start + 1, named=False), Syn("|", t.end - 1, t.end, named=False)])
        else:
            def one() -> Syn:
                pattern = self.one_pattern()
                return self.make("parameter", named("pattern", pattern), self.token(), named("type", self.type())) if self.sees(":") else pattern

            parameters = self.make("closure_parameters", self.take("|"), *self.listed("|", one), self.take("|"))
        kids.append(named("parameters", parameters))
        if self.sees("->"):
            kids += [self.token(), named("return_type", self.type())]
        return self.make("closure_expression", *kids, named("body", self.expression()))

    def postfix(self, found: Syn) -> Syn:
        while True:
            if self.sees("?"):
                found = self.make("try_expression", found, self.token())
            elif self.sees("("):
                arguments = self.make("arguments", self.token(), *self.free(lambda: self.listed(")", self.expression)), self.take(")"))
                found = self.make("call_expression", named("function", found), named("arguments", arguments))
            elif self.sees("["):
                found = self.make("index_expression", found, self.token(), self.free(self.expression), self.take("]"))
            elif self.sees("."):
                dot = self.token()
                if self.sees("await"):
                    found = self.make("await_expression", found, dot, self.token())
                    continue
                if self.now.kind == "literal":
                    field = self.leaf("integer_literal")
                else:
                    field = self.identifier("field_identifier")
                found = self.make("field_expression", named("value", found), dot, named("field", field))
                if self.sees("::"):
                    found = self.make("generic_function", named("function", found), self.token(), named("type_arguments", self.type_arguments()))
            else:
                return found


def parse(source: str) -> Syn:
    tokens, comments = _tokens(source)
    return with_comments(_Rust(source, tokens).file(), comments)
