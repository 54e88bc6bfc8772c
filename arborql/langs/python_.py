"""Python: indentation becomes tokens, brackets hide line ends."""

from __future__ import annotations

import re

from .code import Broken, Parser, Token, named, with_comments
from .tree import Syn

LEX = re.compile(
    r"(?P<space>(?:[ \t\r\f﻿]|\\\r?\n)+)|(?P<newline>\n)|(?P<comment>#[^\n]*)|"
    r"(?P<string>(?:[rRbBuUfF]{1,2})?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))|(?P<name>[^\W\d]\w*)|"
    r"(?P<float>(?:\d[\d_]*\.[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?|\d[\d_]*[eE][+-]?\d+[jJ]?)|(?P<integer>0[xXbBoO][\da-fA-F_]+|\d[\d_]*[jJlL]?)|"
    r"(?P<sign>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<>|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=])|(?P<bad>.)",
    re.S,
)
KEYWORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
OPENERS, CLOSERS = "([{", ")]}"
AUGMENTED = ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")
LEVELS = [dict.fromkeys(x.split(), "binary_operator") for x in ("|", "^", "&", "<< >>", "+ -", "* / // % @")]
SIMPLE_WORDS = {"pass": "pass_statement", "break": "break_statement", "continue": "continue_statement"}
COMPOUND = ("if", "for", "while", "try", "with", "def", "class", "async", "@")


def _tokens(source: str) -> tuple[list[Token], list[Syn]]:
    """Tokens with ``line``, ``indent`` and ``dedent`` among them. An indentation that fits none before it counts as the nearest."""
    tokens: list[Token] = []
    comments: list[Syn] = []
    indents, open_, begin, line = [0], 0, True, 0
    for m in LEX.finditer(source):
        kind, text, at = m.lastgroup, m[0], m.start()
        if kind == "newline":
            if not open_ and tokens and tokens[-1].kind not in ("line", "indent", "dedent"):
                tokens.append(Token("line", "\n", at, at))
            begin, line = True, m.end()
            continue
        if kind == "space":
            continue
        if kind == "comment":
            comments.append(Syn("comment", at, m.end(), extra=True))
            continue
        if begin and not open_:
            width = len(source[line:at].expandtabs(8))
            if width > indents[-1]:
                indents.append(width)
                tokens.append(Token("indent", "", at, at))
            while width < indents[-1]:
                indents.pop()
                tokens.append(Token("dedent", "", at, at))
        begin = False
        if kind == "sign":
            open_ = open_ + 1 if text in OPENERS else max(0, open_ - 1) if text in CLOSERS else open_
        tokens.append(Token("number" if kind in ("float", "integer") else "sign" if kind == "bad" else kind, kind if kind in ("float", "integer") else text, at, m.end()))
    end = len(source)
    if tokens and tokens[-1].kind not in ("line", "dedent"):
        tokens.append(Token("line", "\n", end, end))
    tokens += [Token("dedent", "", end, end) for _ in indents[1:]]
    tokens.append(Token("end", "", end, end))
    return tokens, comments


class _Python(Parser):
    keywords = KEYWORDS

    def file(self) -> Syn:
        root = Syn("module", 0, len(self.source))
        while self.now.kind != "end":
            if self.now.kind in ("line", "indent", "dedent"):
                self.at += 1
            else:
                root.add(*self.line())
        return root

    def line(self) -> list[Syn]:
        """A compound statement, or simple ones up to the end of the line."""
        ends = lambda t: t.kind in ("line", "dedent")
        if self.sees(*COMPOUND) or self.sees("match") and self.opens_block():
            found = [self.recovered(lambda: self.deeper(self.compound), ends)]
        else:
            found = self.recovered_simple(ends)
        if self.now.kind == "line":
            self.at += 1
        return found

    def opens_block(self) -> bool:
        """Whether this line ends with a colon, as a match statement does."""
        at = self.at
        while self.tokens[at].kind not in ("line", "end"):
            at += 1
        return at > self.at + 1 and self.tokens[at - 1].text == ":" and self.tokens[self.at + 1].text not in ("=", ".", ",", ")", ":")

    def recovered_simple(self, ends) -> list[Syn]:
        def some() -> Syn:
            kids = [self.simple()]
            while self.sees(";"):
                kids.append(self.token())
                if self.now.kind != "line":
                    kids.append(self.simple())
            if self.now.kind not in ("line", "end", "dedent"):
                raise Broken
            return Syn("several", kids[0].start, kids[-1].end, kids=kids)

        found = self.recovered(some, ends)
        return found.kids if found.kind == "several" else [found]

    def suite(self) -> Syn:
        """The statements after a colon."""
        if self.now.kind != "line":
            found = Syn("block", self.now.start, self.now.start, kids=self.recovered_simple(lambda t: t.kind == "line"))
            if self.now.kind == "line":
                self.at += 1
        else:
            self.at += 1
            if self.now.kind != "indent":
                raise Broken
            self.at += 1
            kids: list[Syn] = []
            while self.now.kind not in ("dedent", "end"):
                kids += self.line() if self.now.kind not in ("line", "indent") else []
                if self.now.kind in ("line", "indent"):
                    self.at += 1
            if self.now.kind == "dedent":
                self.at += 1
            found = Syn("block", 0, 0, kids=kids)
        found.start, found.end = found.kids[0].start, found.kids[-1].end
        return found

    # -- compound statements -----------------------------------------------------------------------------------------

    def compound(self) -> Syn:
        word = self.now.text
        if word == "@":
            kids = []
            while self.sees("@"):
                kids.append(self.make("decorator", self.token(), self.named_expression()))
                while self.now.kind == "line":
                    self.at += 1
            return self.make("decorated_definition", *kids, named("definition", self.compound()))
        start = [self.token()] if word == "async" else []
        word = self.now.text
        found = {"if": self.if_, "for": self.for_, "while": self.while_, "try": self.try_, "with": self.with_, "def": self.def_, "class": self.class_, "match": self.match_}.get(word)
        if found is None:
            raise Broken
        return found(start)

    def body(self, field: str = "body") -> list[Syn]:
        return [self.take(":"), named(field, self.suite())]

    def clauses(self, *words: str) -> list[Syn]:
        found = []
        while self.sees(*words):
            word = self.now.text
            if word == "elif":
                found.append(named("alternative", self.make("elif_clause", self.token(), named("condition", self.named_expression()), *self.body("consequence"))))
            elif word == "else":
                clause = self.make("else_clause", self.token(), *self.body())
                found.append(named("alternative", clause))
            elif word == "finally":
                found.append(self.make("finally_clause", self.token(), *self.body("")))
            else:
                kids = [self.token(), self.accept("*")]
                if not self.sees(":"):
                    value = self.expression_list()
                    if self.sees("as"):
                        value = self.make("as_pattern", value, self.token(), named("alias", self.make("as_pattern_target", self.expression())))
                    kids.append(value)
                found.append(self.make("except_clause", *kids, *self.body("")))
        for clause in found:
            for k in clause.kids:
                k.field = k.field or None
        return found

    def if_(self, start: list[Syn]) -> Syn:
        return self.make("if_statement", self.token(), named("condition", self.named_expression()), *self.body("consequence"), *self.clauses("elif", "else"))

    def while_(self, start: list[Syn]) -> Syn:
        return self.make("while_statement", self.token(), named("condition", self.named_expression()), *self.body(), *self.clauses("else"))

    def for_(self, start: list[Syn]) -> Syn:
        word = self.token()
        left = named("left", self.targets())
        return self.make("for_statement", *start, word, left, self.take("in"), named("right", self.expression_list()), *self.body(), *self.clauses("else"))

    def try_(self, start: list[Syn]) -> Syn:
        return self.make("try_statement", self.token(), *self.body(), *self.clauses("except", "else", "finally"))

    def with_(self, start: list[Syn]) -> Syn:
        def item() -> Syn:
            value = self.expression()
            if self.sees("as"):
                value = self.make("as_pattern", value, self.token(), named("alias", self.make("as_pattern_target", self.primary())))
            return self.make("with_item", named("value", value))

        def plain() -> Syn:
            kids = [item()]
            while self.sees(","):
                kids += [self.token(), item()]
            if not self.sees(":"):
                raise Broken
            return self.make("with_clause", *kids)

        word = self.token()
        clause = self.tried(plain) or self.make("with_clause", self.take("("), *self.listed(")", item), self.take(")"))
        return self.make("with_statement", *start, word, clause, *self.body())

    def def_(self, start: list[Syn]) -> Syn:
        kids = [*start, self.token(), named("name", self.identifier())]
        if self.sees("["):
            kids.append(named("type_parameters", self.make("type_parameter", self.token(), *self.listed("]", self.type), self.take("]"))))
        kids.append(named("parameters", self.make("parameters", self.take("("), *self.listed(")", self.parameter), self.take(")"))))
        if self.sees("->"):
            kids += [self.token(), named("return_type", self.type())]
        return self.make("function_definition", *kids, *self.body())

    def class_(self, start: list[Syn]) -> Syn:
        kids = [self.token(), named("name", self.identifier())]
        if self.sees("["):
            kids.append(named("type_parameters", self.make("type_parameter", self.token(), *self.listed("]", self.type), self.take("]"))))
        if self.sees("("):
            kids.append(named("superclasses", self.arguments()))
        return self.make("class_definition", *kids, *self.body())

    def match_(self, start: list[Syn]) -> Syn:
        kids = [Syn("match", self.now.start, self.now.end, named=False)]
        self.at += 1
        kids += [named("subject", self.expression_list()), self.take(":")]
        if self.now.kind != "line" or self.ahead().kind != "indent":
            raise Broken
        self.at += 2
        cases = []
        while self.sees("case"):
            word = Syn("case", self.now.start, self.now.end, named=False)
            self.at += 1
            pattern = self.make("case_pattern", self.expression_list())
            guard = [named("guard", self.make("if_clause", self.token(), self.named_expression()))] if self.sees("if") else []
            cases.append(named("alternative", self.make("case_clause", word, pattern, *guard, *self.body("consequence"))))
        if self.now.kind != "dedent" or not cases:
            raise Broken
        self.at += 1
        return self.make("match_statement", *kids, named("body", self.make("block", *cases)))

    def type(self) -> Syn:
        return self.make("type", self.expression())

    def parameter(self, annotated: bool = True) -> Syn:
        if self.sees("/"):
            return Syn("positional_separator", self.now.start, self.now.end, kids=[self.token()])
        if self.sees("*", "**"):
            star = self.token()
            if self.sees(",", ")", ":"):
                return Syn("keyword_separator", star.start, star.end, kids=[star])
            name = self.make("list_splat_pattern" if star.kind == "*" else "dictionary_splat_pattern", star, self.identifier())
        else:
            name = self.identifier()
        kind = [self.token(), named("type", self.type())] if annotated and self.sees(":") else []
        if self.sees("="):
            return self.make("typed_default_parameter" if kind else "default_parameter", named("name", name), *kind, self.token(), named("value", self.expression()))
        return self.make("typed_parameter", name, *kind) if kind else name

    # -- simple statements -------------------------------------------------------------------------------------------

    def simple(self) -> Syn:
        word = self.now.text if self.now.kind == "name" else ""
        done = self.now.kind == "line"
        if done:
            raise Broken
        if word in SIMPLE_WORDS:
            return self.make(SIMPLE_WORDS[word], self.token())
        if word == "return":
            token = self.token()
            return self.make("return_statement", token, None if self.ends() else self.expression_list())
        if word == "raise":
            kids = [self.token()]
            if not self.ends():
                kids.append(self.expression_list())
                if self.sees("from"):
                    kids += [self.token(), named("cause", self.expression())]
            return self.make("raise_statement", *kids)
        if word == "assert":
            return self.make("assert_statement", self.token(), self.expression(), *([self.token(), self.expression()] if self.sees(",") else []))
        if word == "del":
            return self.make("delete_statement", self.token(), self.expression_list())
        if word in ("global", "nonlocal"):
            kids = [self.token(), self.identifier()]
            while self.sees(","):
                kids += [self.token(), self.identifier()]
            return self.make(f"{word}_statement", *kids)
        if word == "import":
            kids = [self.token(), named("name", self.imported())]
            while self.sees(","):
                kids += [self.token(), named("name", self.imported())]
            return self.make("import_statement", *kids)
        if word == "from":
            return self.import_from()
        return self.expression_statement()

    def ends(self) -> bool:
        return self.now.kind in ("line", "end", "dedent") or self.sees(";")

    def dotted(self) -> Syn:
        kids = [self.identifier()]
        while self.sees("."):
            kids += [self.token(), self.identifier()]
        return self.make("dotted_name", *kids)

    def imported(self) -> Syn:
        name = self.dotted()
        return self.make("aliased_import", named("name", name), self.token(), named("alias", self.identifier())) if self.sees("as") else name

    def import_from(self) -> Syn:
        kids = [self.token()]
        if self.sees(".", "..."):
            dots = []
            while self.sees(".", "..."):
                dots.append(self.token())
            prefix = self.make("import_prefix", *dots)
            kids.append(named("module_name", self.make("relative_import", prefix, None if self.sees("import") else self.dotted())))
        else:
            kids.append(named("module_name", self.dotted()))
        future = self.source[kids[1].start : kids[1].end] == "__future__"
        kids.append(self.take("import"))
        if self.sees("*"):
            kids.append(Syn("wildcard_import", self.now.start, self.now.end, kids=[self.token()]))
        elif self.sees("("):
            kids += [self.token(), *(named("name", k) if k.named else k for k in self.listed(")", self.imported)), self.take(")")]
        else:
            kids.append(named("name", self.imported()))
            while self.sees(","):
                kids += [self.token(), named("name", self.imported())]
        return self.make("future_import_statement" if future else "import_from_statement", *[k for n, k in enumerate(kids) if not future or n != 1])

    def expression_statement(self) -> Syn:
        left = self.expression_list()
        if self.sees(*AUGMENTED):
            return self.make("expression_statement", self.make("augmented_assignment", named("left", left), named("operator", self.token()), named("right", self.right())))
        if self.sees(":", "="):
            return self.make("expression_statement", self.assignment(left))
        return self.make("expression_statement", *left.kids) if left.kind == "expression_list" else self.make("expression_statement", left)

    def assignment(self, left: Syn) -> Syn:
        kids = [named("left", self.target(left))]
        if self.sees(":"):
            kids += [self.token(), named("type", self.type())]
        if self.sees("="):
            kids.append(self.token())
            right = self.right()
            kids.append(named("right", self.assignment(right) if self.sees("=") else right))
        return self.make("assignment", *kids)

    def target(self, left: Syn) -> Syn:
        kind = {"expression_list": "pattern_list", "tuple": "tuple_pattern", "list": "list_pattern"}.get(left.kind)
        return Syn(kind, left.start, left.end, kids=left.kids) if kind else left

    def right(self) -> Syn:
        return self.yield_() if self.sees("yield") else self.expression_list()

    def targets(self) -> Syn:
        kids = [self.splat_or(self.primary)]
        while self.sees(","):
            kids.append(self.token())
            if not self.sees("in"):
                kids.append(self.splat_or(self.primary))
        return self.target(kids[0]) if len(kids) == 1 else self.make("pattern_list", *kids)

    # -- expressions -------------------------------------------------------------------------------------------------

    def splat_or(self, one) -> Syn:
        return self.make("list_splat", self.token(), self.binary(LEVELS, self.factor)) if self.sees("*") else one()

    def expression_list(self) -> Syn:
        if self.sees("yield"):
            return self.yield_()
        first = self.splat_or(self.named_expression)
        if not self.sees(","):
            return first
        kids = [first]
        while self.sees(","):
            kids.append(self.token())
            if self.ends() or self.sees("=", ":", ")", "]", "}"):
                break
            kids.append(self.splat_or(self.named_expression))
        return self.make("expression_list", *kids)

    def yield_(self) -> Syn:
        kids = [self.token()]
        if self.sees("from"):
            kids += [self.token(), self.expression()]
        elif not self.ends() and not self.sees(")", "]", "}", "="):
            kids.append(self.expression_list())
        return self.make("yield", *kids)

    def named_expression(self) -> Syn:
        found = self.expression()
        if self.sees(":=") and found.kind == "identifier":
            return self.make("named_expression", named("name", found), self.token(), named("value", self.expression()))
        return found

    def expression(self) -> Syn:
        return self.deeper(self._expression)

    def _expression(self) -> Syn:
        if self.sees("lambda"):
            word = self.token()
            parameters = None if self.sees(":") else named("parameters", self.make("lambda_parameters", *self.listed(":", lambda: self.parameter(False))))
            return self.make("lambda", word, parameters, self.take(":"), named("body", self.expression()))
        found = self.or_()
        if self.sees("if"):
            at = self.at
            kids = [found, self.token(), self.or_()]
            if not self.sees("else"):
                self.at = at  # a filter of a comprehension
                return found
            return self.make("conditional_expression", *kids, self.token(), self.expression())
        return found

    def or_(self) -> Syn:
        return self.binary([{"or": "boolean_operator"}, {"and": "boolean_operator"}], self.not_)

    def not_(self) -> Syn:
        if self.sees("not"):
            return self.deeper(lambda: self.make("not_operator", self.token(), named("argument", self.not_())))
        kids = [self.binary(LEVELS, self.factor)]
        while self.sees("<", ">", "==", "!=", "<>", "<=", ">=", "in", "is", "not"):
            if self.sees("not", "is") and self.ahead().text == ("in" if self.sees("not") else "not"):
                first, second = self.token(), self.token()
                operator = Syn(f"{first.kind} {second.kind}", first.start, second.end, named=False)
            elif self.sees("not"):
                break
            else:
                operator = self.token()
            kids += [named("operators", operator), self.binary(LEVELS, self.factor)]
        return kids[0] if len(kids) == 1 else self.make("comparison_operator", *kids)

    def factor(self) -> Syn:
        if self.sees("+", "-", "~"):
            return self.deeper(lambda: self.make("unary_operator", named("operator", self.token()), named("argument", self.factor())))
        found = self.make("await", self.token(), self.primary()) if self.sees("await") else self.primary()
        if self.sees("**"):
            return self.make("binary_operator", named("left", found), named("operator", self.token()), named("right", self.deeper(self.factor)))
        return found

    def primary(self) -> Syn:
        t = self.now
        if t.kind == "name" and t.text not in KEYWORDS:
            found = self.leaf({"True": "true", "False": "false", "None": "none"}.get(t.text, "identifier"))
        elif t.kind == "number":
            found = self.leaf(t.text)
        elif t.kind == "string":
            found = self.strings()
        elif self.sees("..."):
            found = self.leaf("ellipsis")
        elif self.sees("("):
            found = self.deeper(self.parentheses)
        elif self.sees("["):
            found = self.deeper(lambda: self.bracketed("list", "]", "list_comprehension"))
        elif self.sees("{"):
            found = self.deeper(self.braces)
        else:
            raise Broken
        while True:
            if self.sees("."):
                found = self.make("attribute", named("object", found), self.token(), named("attribute", self.identifier()))
            elif self.sees("("):
                found = self.make("call", named("function", found), named("arguments", self.deeper(self.arguments)))
            elif self.sees("["):
                open_ = self.token()
                items = [named("subscript", k) if k.named else k for k in self.listed("]", self.slice)]
                found = self.make("subscript", named("value", found), open_, *items, self.take("]"))
            else:
                return found

    def slice(self) -> Syn:
        start = None if self.sees(":") else self.splat_or(self.named_expression)
        if not self.sees(":"):
            return start
        kids = [start, self.token()]
        if not self.sees(",", "]", ":"):
            kids.append(self.expression())
        if self.sees(":"):
            kids.append(self.token())
            if not self.sees(",", "]"):
                kids.append(self.expression())
        return self.make("slice", *kids)

    def strings(self) -> Syn:
        kids = [self.string()]
        while self.now.kind == "string":
            kids.append(self.string())
        return kids[0] if len(kids) == 1 else self.make("concatenated_string", *kids)

    def string(self) -> Syn:
        t = self.now
        self.at += 1
        prefix = re.match(r"[A-Za-z]*", t.text)[0]
        quote = len(prefix) + (3 if t.text[len(prefix) :].startswith(('"""', "'''")) else 1)
        a, b = t.start + quote, t.end - quote + len(prefix)
        node = Syn("string", t.start, t.end, kids=[Syn("string_start", t.start, a)])
        at = a
        if "f" in prefix.lower():
            for x, y in _holes(self.source, a, b):
                if at < x:
                    node.add(Syn("string_content", at, x))
                node.add(Syn("interpolation", x, y, kids=_interpolated(self.source, x, y)))
                at = y
        if at < b:
            node.add(Syn("string_content", at, b))
        return node.add(Syn("string_end", b, t.end))

    def comprehension(self, kind: str, open_: Syn, body: Syn, close: str) -> Syn:
        kids = [open_, named("body", body)]
        while self.sees("for", "async", "if"):
            if self.sees("if"):
                kids.append(self.make("if_clause", self.token(), self.named_expression()))
                continue
            start = [self.token()] if self.sees("async") else []
            word = self.take("for")
            left = named("left", self.targets())
            kids.append(self.make("for_in_clause", *start, word, left, self.take("in"), named("right", self.or_() if not self.sees("lambda") else self.expression())))
        return self.make(kind, *kids, self.take(close))

    def parentheses(self) -> Syn:
        open_ = self.token()
        if self.sees("yield"):
            return self.make("parenthesized_expression", open_, self.yield_(), self.take(")"))
        if self.sees(")"):
            return self.make("tuple", open_, self.token())
        first = self.splat_or(self.named_expression)
        if self.sees("for", "async"):
            return self.comprehension("generator_expression", open_, first, ")")
        if self.sees(")"):
            return self.make("parenthesized_expression", open_, first, self.token())
        comma = self.take(",")
        return self.make("tuple", open_, first, comma, *self.listed(")", lambda: self.splat_or(self.named_expression)), self.take(")"))

    def bracketed(self, kind: str, close: str, comprehension: str) -> Syn:
        open_ = self.token()
        if self.sees(close):
            return self.make(kind, open_, self.token())
        first = self.splat_or(self.named_expression)
        if self.sees("for", "async"):
            return self.comprehension(comprehension, open_, first, close)
        more = [self.take(","), *self.listed(close, lambda: self.splat_or(self.named_expression))] if not self.sees(close) else []
        return self.make(kind, open_, first, *more, self.take(close))

    def braces(self) -> Syn:
        open_ = self.token()

        def item() -> Syn:
            if self.sees("**"):
                return self.make("dictionary_splat", self.token(), self.binary(LEVELS, self.factor))
            key = self.splat_or(self.named_expression)
            return self.make("pair", named("key", key), self.token(), named("value", self.expression())) if self.sees(":") else key

        if self.sees("}"):
            return self.make("dictionary", open_, self.token())
        first = item()
        kind = "dictionary" if first.kind in ("pair", "dictionary_splat") else "set"
        if self.sees("for", "async"):
            return self.comprehension(f"{kind}_comprehension", open_, first, "}")
        more = [self.take(","), *self.listed("}", item)] if not self.sees("}") else []
        return self.make(kind, open_, first, *more, self.take("}"))

    def arguments(self) -> Syn:
        open_ = self.take("(")

        def one() -> Syn:
            if self.sees("**"):
                return self.make("dictionary_splat", self.token(), self.expression())
            if self.now.kind == "name" and self.ahead().text == "=" and self.now.text not in KEYWORDS:
                return self.make("keyword_argument", named("name", self.identifier()), self.token(), named("value", self.expression()))
            return self.splat_or(self.named_expression)

        if self.sees(")"):
            return self.make("argument_list", open_, self.token())
        first = one()
        if self.sees("for", "async") and first.kind != "keyword_argument":
            return self.comprehension("generator_expression", open_, first, ")")
        more = [self.take(","), *self.listed(")", one)] if not self.sees(")") else []
        return self.make("argument_list", open_, first, *more, self.take(")"))


def _holes(source: str, a: int, b: int) -> list[tuple[int, int]]:
    """The braces of a formatted string that hold expressions."""
    found, at = [], a
    while (at := source.find("{", at, b)) >= 0:
        if source.startswith("{{", at):
            at += 2
            continue
        depth, end = 0, at
        while end < b:
            depth += (source[end] in "{[(") - (source[end] in "}])")
            end += 1
            if not depth:
                break
        found.append((at, end))
        at = end
    return found


def _interpolated(source: str, x: int, y: int) -> list[Syn]:
    """The parts of ``{expression!r:format}``."""
    tokens, _ = _tokens(source[x + 1 : y - 1])
    parser = _Python(source[x + 1 : y - 1], [t for t in tokens if t.kind not in ("line", "indent", "dedent")])
    inside = parser.tried(parser.expression_list)
    kids = [Syn("{", x, x + 1, named=False)]
    if inside is not None:
        for node in inside.walk():
            node.start, node.end = node.start + x + 1, node.end + x + 1
        kids.append(named("expression", inside))
    return [*kids, Syn("}", y - 1, y, named=False)]


def parse(source: str) -> Syn:
    tokens, comments = _tokens(source)
    return with_comments(_Python(source, tokens).file(), comments)
