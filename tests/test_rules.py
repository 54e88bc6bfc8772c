"""The rule language: what rule files say, and what is wrong with those that say nothing."""

import pytest

from arborql.rules import RuleError, read_rules

#: Source and a piece of its error.
MALFORMED = [
    ('rule r { flavour "x" pattern { f() } }', "unknown field"), ('rule r { message "hi" }', "no pattern/query"), ("rule r { severity noisy pattern { f() } }", "unknown severity"),
    ('rule r {\n message "open\n pattern { f() }\n}', "unterminated"), ('pattern """f($x)', "unterminated"), ("pattern `f($x)", "unterminated"), ("pattern { if y {", "unbalanced"), ("rule r {\n pattern { f() }", "expected '}'"),
    ("rule r { any { } }", "needs at least one matcher"), ('rule r { pattern { f($x) } where $x = "y" }', "expected '=='"), ("rule r { pattern { f() } inside thing }", "expected a matcher"),
    ('rule r { pattern { f() } where $ matches "y" }', "metavariable name"), ('rule r { pattern { f() } test { maybe "x" } }', "unknown test entry"), ('rule r { pattern { f($x) } where $x resembles "y" }', "unknown constraint operator"),
    ("rule r { pattern { f($x) } where $x in @NONE }", "undefined let"), ("let L = [a, b]\nrule r { pattern { f($x) } where $x matches @L }", "is a list"), ('let R = "x"\nrule r { pattern { f($x) } where $x in @R }', "is a regex"),
    ("rule { pattern { f() } }", "expected an identifier"), ("rule a { pattern { f() } }\nthing b { pattern { g() } }", "expected another 'rule' block"), ("rule r { pattern { f($x) } where $x == 5 }", "metavariable or a string"),
    ('rule r { pattern { f() } test { match "f()" fix "g()" } }', "fix"), ("rule r { pattern { f($x) } where $x > -1 }", "unexpected character"), ("rule r { pattern { f() } has { pattern { g() } } }", "expected a matcher"),
]


@pytest.mark.parametrize(("source", "why"), MALFORMED)
def test_malformed(source, why):
    with pytest.raises(RuleError, match=r"(?s)^r\.lint:\d+:\d+: .*") as e:
        read_rules(source, "r.lint")
    assert why in str(e.value)


def test_all_fields():
    (r,) = read_rules(
        'rule a-b { msg "m" help "n" severity warn in go, json link "u" tags x, y-z path "a/**", "b" exclude ["c", d] focus $X pattern { f($X) } not directly inside pattern { g() } '
        'precedes any { pattern { h() } query "(x) @y" where $y length >= 2.5 } where $X not kind in [a, b] fix `z` tests { bad "f(1)" count 2 fix { z } good { f() } } }'
    )
    assert (r.id, r.message, r.note, r.severity, r.languages, r.url, r.tags) == ("a-b", "m", "n", "warning", ["go", "json"], "u", ["x", "y-z"])
    assert (r.paths, r.exclude, r.report, r.fix) == (["a/**", "b"], ["c", "d"], "X", "z")
    assert [(x.name, x.negated, x.directly, x.matcher.kind) for x in r.relations] == [("inside", True, True, "pattern"), ("precedes", False, False, "any")]
    assert (r.relations[1].matcher.where[0].op, r.relations[1].matcher.where[0].value) == ("length_ge", 2.5)
    assert (r.where[0].op, r.where[0].negated, r.where[0].value) == ("kind_in", True, ["a", "b"])
    assert [(c.expect, c.code, c.count, c.fixed) for c in r.cases] == [("match", "f(1)", 2, "z"), ("no_match", "f()", -1, None)]


def test_defaults_and_bare_files():
    (r,) = read_rules('# a comment\nin json // more\npattern { "k": 1 }\n/* end */', "dir/no-k.lint")
    assert (r.id, r.message, r.severity) == ("no-k", "no-k", "warning")
    assert read_rules(" \n# nothing\n") == []
    (r,) = read_rules("rule r { pattern { f() } pattern { g() } }")
    assert r.match.kind == "all" and [p.body for p in r.match.parts] == ["f()", "g()"]


def test_strings_and_bodies():
    source = r'''rule r { message "a\n\t\"\\ \q" note """
      one
        two
    """ pattern {
        f("}", ')', `}`) // }
        /* } */ #fff 'a
    } }'''
    (r,) = read_rules(source)
    assert r.message == 'a\n\t"\\ \\q' and r.note == "one\n  two"
    assert r.match.body == "f(\"}\", ')', `}`) // }\n/* } */ #fff 'a"


def test_lets_are_used_where_they_fit():
    rules = read_rules('let L = [a "b c" 3]\nlet R = "^x"\nlet M = any { pattern { f() } pattern { g() } }\nrule one { @M where $x in @L where $x matches @R }\nlet N = not @M\nrule two { pattern { h() } @N where $x is @M }')
    assert rules[0].match.kind == "any" and rules[0].where[0].value == ["a", "b c", "3"] and rules[0].where[1].value == "^x"
    assert rules[1].match.parts[1].kind == "not" and rules[1].where[0].matcher.kind == "any"


def test_count_takes_whole_numbers_only():
    (r,) = read_rules('rule r { pattern { f() } test { match "f()" count 2.5 } }')
    assert r.cases[0].count == 0
