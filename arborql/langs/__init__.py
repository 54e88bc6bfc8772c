"""The languages: how they are recognised, parsed, and what of their trees the matcher treats specially."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from . import c, csharp, css, go, java, json_, kotlin, markup, python_, rust, script, swift, yaml_
from .tree import Syn, Tape


@dataclass(frozen=True)
class Language:
    """``literals`` are compared by text, ``folded`` kinds without case. ``meta_in_strings``: $X counts between quotes;
    ``quote_bare``: outside it is quoted; ``tag_variadics``: $$$ in a tag becomes an attribute; ``upper_only``: $x is the
    language's own. ``interpolations``: a literal with one of these is compared part by part. ``around``: what a fragment may be wrapped in to parse. ``joint`` stands in names of stand-ins.
    ``tape``: parses without an object for each node."""

    name: str
    aliases: tuple[str, ...]
    extensions: tuple[str, ...]
    parse: Callable[[str], Syn] | None = None
    literals: frozenset[str] = frozenset()
    comments: frozenset[str] = frozenset()
    transparent: frozenset[str] = frozenset()
    folded: frozenset[str] = frozenset()
    interpolations: frozenset[str] = frozenset()
    around: tuple[tuple[str, str], ...] = ()
    explicit: bool = False
    meta_in_strings: bool = False
    quote_bare: bool = False
    tag_variadics: bool = False
    upper_only: bool = False
    missing_ok: bool = False
    joint: str = "_"
    tape: Callable[[str], Tape] | None = None

    def read(self, source: str) -> Syn | Tape:
        return (self.tape or self.parse)(source)

    @cached_property
    def through(self) -> frozenset[str]:
        """Kinds that matching looks through to their only named child."""
        return THROUGH | self.transparent

    @property
    def blocks(self) -> frozenset[str]:
        return BLOCKS

    @property
    def separators(self) -> frozenset[str]:
        return SEPARATORS


def _kinds(words: str) -> frozenset[str]:
    return frozenset(words.split())


#: Kinds that hold a whole file, one expression, statements or list items, whatever the language (fixed values).
FILES = _kinds("program source_file module translation_unit compilation_unit document stylesheet stream block_mapping block_sequence")
THROUGH = _kinds("expression_statement global_statement element quoted_attribute_value content block_node flow_node plain_scalar")
BLOCKS = _kinds("block statement_block compound_statement statements source_file module program translation_unit compilation_unit document element content stylesheet block_mapping block_sequence")
SEPARATORS = frozenset({";", ",", "\n", "\r", "\r\n"})
ITEMS = _kinds(
    "required_parameter optional_parameter parameter formal_parameter spread_parameter parameter_declaration typed_parameter default_parameter typed_default_parameter "
    "argument value_argument literal_element keyed_element field_initializer shorthand_field_initializer attribute Attribute block_sequence_item"
)
START_TAGS = _kinds("start_tag STag EmptyElemTag")

LANGUAGES = (
    Language("go", ("golang",), (".go",), go.parse, _kinds("int_literal float_literal imaginary_literal rune_literal interpreted_string_literal raw_string_literal true false nil"), _kinds("comment"), around=(("package p\nfunc _() {\n", "\n}"), ("package p\nvar _ = ", ""))),
    Language("python", ("py",), (".py", ".pyi"), python_.parse, _kinds("integer float string true false none"), _kinds("comment"), around=(("_ = ", ""),), interpolations=_kinds("interpolation")),
    Language("java", (), (".java",), java.parse, _kinds("decimal_integer_literal hex_integer_literal decimal_floating_point_literal string_literal character_literal true false null_literal"), _kinds("line_comment block_comment"), around=(("class _ {\n", "\n}"), ("class _ { void _() {\n", "\n} }"), ("class _ { Object _ = ", "; }"))),
    Language("c", (), (".c", ".h"), c.parse, _kinds("number_literal string_literal char_literal true false null"), _kinds("comment"), around=(("void _() {\n", "\n}"), ("int _ = ", ";"))),
    Language("cpp", ("c++", "cc"), (".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".hh"), c.parse_cpp, _kinds("number_literal string_literal char_literal true false nullptr"), _kinds("comment"), around=(("void _() {\n", "\n}"), ("auto _ = ", ";"))),
    Language("rust", ("rs",), (".rs",), rust.parse, _kinds("integer_literal float_literal string_literal raw_string_literal char_literal boolean_literal"), _kinds("line_comment block_comment"), around=(("fn _() {\n", "\n}"), ("fn _() { let _ = ", "; }"))),
    Language("csharp", ("cs", "c#"), (".cs",), csharp.parse, _kinds("integer_literal real_literal string_literal character_literal boolean_literal null_literal verbatim_string_literal"), _kinds("comment"), around=(("class _ {\n", "\n}"), ("class _ { void _() {\n", "\n} }"), ("class _ { object _ = ", "; }"))),
    Language("kotlin", ("kt", "kts"), (".kt", ".kts"), kotlin.parse, _kinds("integer_literal real_literal hex_literal bin_literal string_literal character_literal boolean_literal"), _kinds("line_comment multiline_comment"), interpolations=_kinds("interpolated_expression interpolated_identifier"), around=(("fun _() {\n", "\n}"), ("val _ = ", ""))),
    Language("swift", (), (".swift",), swift.parse, _kinds("integer_literal real_literal hex_literal oct_literal bin_literal line_string_literal multi_line_string_literal boolean_literal"), _kinds("comment multiline_comment"), interpolations=_kinds("interpolated_expression"), around=(("func _() {\n", "\n}"), ("let _ = ", ""))),
    Language("typescript", ("ts",), (".ts", ".mts", ".cts"), script.parse, _kinds("number string template_string regex true false null undefined"), _kinds("comment"), interpolations=_kinds("template_substitution"), around=(("function _() {\n", "\n}"), ("let _ = ", ""))),
    Language("tsx", ("javascript", "js", "jsx"), (".tsx", ".js", ".jsx", ".mjs", ".cjs"), script.parse_jsx, _kinds("number string template_string regex true false null undefined"), _kinds("comment"), interpolations=_kinds("template_substitution"), around=(("function _() {\n", "\n}"), ("let _ = ", ""))),
    Language("html", (), (".html", ".htm"), markup.parse_html, _kinds("attribute_value quoted_attribute_value text raw_text"), _kinds("comment"), folded=_kinds("tag_name attribute_name"), around=(("<qz-x ", ">"),), explicit=True, meta_in_strings=True, missing_ok=True, joint="-"),
    Language("css", (), (".css",), css.parse, _kinds("string_value integer_value float_value color_value"), _kinds("comment"), around=(("a {\n", "\n}"),), explicit=True, meta_in_strings=True),
    Language("scss", (), (".scss",), css.parse_scss, _kinds("string_value integer_value float_value color_value"), _kinds("comment js_comment"), around=(("a {\n", "\n}"),), explicit=True, meta_in_strings=True, upper_only=True),
    Language("json", ("jsonc",), (".json", ".jsonc"), json_.parse, _kinds("number true false null"), _kinds("comment"), transparent=_kinds("string"), around=(("{", "}"),), explicit=True, meta_in_strings=True, quote_bare=True, tape=json_.tape),
    Language("yaml", ("yml",), (".yaml", ".yml"), yaml_.parse, _kinds("integer_scalar float_scalar boolean_scalar null_scalar double_quote_scalar single_quote_scalar block_scalar timestamp_scalar"), _kinds("comment"), explicit=True),
    Language("xml", (), (".xml", ".svg", ".xsd", ".xsl", ".xslt"), markup.parse_xml, _kinds("AttValue CharData CData"), _kinds("Comment"), around=(("<qz-x ", "/>"), ("<qz-x>", "</qz-x>")), explicit=True, meta_in_strings=True, tag_variadics=True),
)
#: What is known by name and extension but has no parser here.
KNOWN_ONLY: tuple[Language, ...] = ()
BY_NAME = {n: lang for lang in (*LANGUAGES, *KNOWN_ONLY) for n in (lang.name, *lang.aliases)}
BY_EXTENSION = {e: lang.name for lang in (*LANGUAGES, *KNOWN_ONLY) for e in lang.extensions}


def language(name: str) -> Language:
    """By name or alias, in any case; KeyError if there's none."""
    return BY_NAME[name.lower()]

