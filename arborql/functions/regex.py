"""Regular expressions of the RE2 kind for Python, and path globs for Spark."""

from __future__ import annotations

import re
from functools import lru_cache

import regex as unicode_re

from ..rules.model import RuleError

#: ASCII classes by name (fixed values).
CLASSES = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "0-9a-zA-Z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0b\f\r ", "punct": r"!-/:-@\[-`{-~", "cntrl": r"\x00-\x1f\x7f", "graph": "!-~", "print": " -~", "blank": r"\t ", "xdigit": "0-9a-fA-F", "word": "0-9A-Za-z_"}
#: What a letter after a backslash stands for: the members of a class.
SHORT = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}


def python(pattern: str) -> str:
    """The same search for Python: classes are ASCII, $ is the end of the text, flags in the middle hold to the end of their group.

    What RE2 doesn't have (back-references, looking around, possessive and atomic groups) is an error, as there.
    """
    out: list[str] = []
    at, multiline = 0, False
    groups: list[list[str]] = [[]]  # by open group, the flags that were set inside it

    def fail(why: str) -> RuleError:
        return RuleError(f"invalid regex {pattern!r}: {why}")

    def escape(in_class: bool) -> str:
        nonlocal at
        if at + 1 == len(pattern):
            raise fail("trailing backslash")
        d = pattern[at + 1]
        if d.isdigit() and d != "0" or d in "kGZXRhHVN":
            raise fail(f"\\{d} isn't supported")
        if d == "Q":
            end = pattern.find("\\E", at)
            body = pattern[at + 2 : len(pattern) if end < 0 else end]
            at = len(pattern) if end < 0 else end + 2
            return re.escape(body)
        if d in "pP" and (m := re.match(r"\{(\^?)(\w+)\}|(\w)", pattern[at + 2 :])):
            at += 2 + m.end()
            return f"\\{d if not m[1] else 'P' if d == 'p' else 'p'}{{{m[2] or m[3]}}}"
        if d == "x" and (m := re.match(r"\{([0-9A-Fa-f]{1,6})\}", pattern[at + 2 :])):
            at += 2 + m.end()
            return re.escape(chr(int(m[1], 16)))
        at += 2
        if d.lower() in SHORT:
            inside = SHORT[d.lower()]
            if in_class:
                return inside if d.islower() else f"\\{d}"
            return f"[{'^' * d.isupper()}{inside}]"
        if d in "bB" and not in_class:
            return f"(?a:\\{d})"
        return {"z": r"\Z", "C": "(?s:.)", "v": r"\x0b", "A": r"\A"}.get(d, f"\\{d}" if not d.isalpha() or d in "afnrtx" else d)

    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(escape(False))
            continue
        if c == "[":
            at += 1
            out.append("[^" if pattern.startswith("^", at) else "[")
            at += pattern.startswith("^", at)
            first = True
            while True:
                if at >= len(pattern):
                    raise fail("missing closing bracket")
                c = pattern[at]
                if c == "]" and not first:
                    break
                first = False
                if pattern.startswith("[:", at) and (end := pattern.find(":]", at)) > 0 and pattern[at + 2 : end].lstrip("^") in CLASSES:
                    name = pattern[at + 2 : end]
                    if name[0] == "^":
                        raise fail("a negated class in a class isn't supported")
                    out.append(CLASSES[name])
                    at = end + 2
                elif c == "\\":
                    out.append(escape(True))
                else:
                    out.append("\\" + c if c in "[]&~|" else c)
                    at += 1
            out.append("]")
            at += 1
            continue
        if c == "(":
            m = re.match(r"\(\?(?:P?<([A-Za-z]\w*)>|([imsU]*(?:-[imsU]+)?)([:)]))", pattern[at:])
            if m is None and pattern.startswith("(?", at):
                raise fail("this group isn't supported")
            if m is None:
                out.append("(")
                groups.append([])
                at += 1
                continue
            at += m.end()
            if m[1]:
                out.append(f"(?P<{m[1]}>")
                groups.append([])
                continue
            on, _, off = m[2].replace("U", "").partition("-")
            multiline = multiline or "m" in on
            flags = f"(?{on}{'-' + off if off else ''}:"
            out.append(flags)
            if m[3] == ":":
                groups.append([])
            else:
                groups[-1].append(flags)
            continue
        if c == ")":
            if len(groups) == 1:
                raise fail("missing closing bracket")
            out.append(")" * len(groups.pop()) + ")")
        elif c == "|":
            out.append(")" * len(groups[-1]) + "|" + "".join(groups[-1]))
        elif c == "$" and not multiline:
            out.append(r"\Z")
        elif c in "*+?}" and pattern.startswith("+", at + 1):
            raise fail("possessive quantifiers aren't supported")
        else:
            out.append(c)
        at += 1
    if len(groups) > 1:
        raise fail("missing closing bracket")
    return "".join(out) + ")" * len(groups[0])


@lru_cache(maxsize=512)
def compiled(pattern: str):
    """A compiled search; classes by Unicode property need the larger engine."""
    text = python(pattern)
    try:
        return (unicode_re if "\\p" in text or "\\P" in text else re).compile(text)
    except (re.error, unicode_re.error, OverflowError) as e:
        raise RuleError(f"invalid regex {pattern!r}: {e}") from None


def glob(pattern: str) -> str:
    """A glob over whole paths as a Java regex: * within a folder, ** across, ? one character."""
    out, at = [], 0
    while at < len(pattern):
        for text, found in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if pattern.startswith(text, at):
                out.append(found)
                at += len(text)
                break
        else:
            out.append(re.sub(r"([^\w/])", r"\\\1", pattern[at]))
            at += 1
    return f"^{''.join(out)}\\z"
