"""JSON with comments."""

from __future__ import annotations

import re

from .tree import Syn, Tape, sign

LEX = re.compile(r"(?P<space>[ \t\r\n\ufeff]+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\")|(?P<number>-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)(?![\w])|(?P<sign>[{}\[\],:])|(?P<bad>[\w$]+|.)", re.S)
PARTS = re.compile(r"\\(?:u[0-9a-fA-F]{4}|.)|[^\\]+", re.S)
CLOSERS = {"{": "}", "[": "]"}
_SPACE, _COMMENT, _STRING, _NUMBER, _WORD, _SIGN = (LEX.groupindex[x] for x in ("space", "comment", "string", "number", "word", "sign"))


def tape(source: str) -> Tape:
    """Nodes are written down once, in their order, so a document of any size takes 20 bytes a node. Open brackets are a stack,
    so depth is bounded by memory only; what doesn't fit is an error node in its place."""
    made = Tape()
    signs, start, end, parent, stop = made.signs, made.start, made.end, made.parent, made.stop
    object_, pair_, error_, quote, content, escape, colon, comma = sign("object"), sign("pair"), sign("ERROR"), sign('"', False), sign("string_content"), sign("escape_sequence"), sign(":", False), sign(",", False)
    objects = {object_, sign("object", field="value"), sign("object", field="key")}
    labels = {k: (sign(k), sign(k, field="key"), sign(k, field="value")) for k in ("object", "array", "string", "number", "true", "false", "null")}
    tokens = {c: sign(c, False) for c in "{}[]"}
    closers = {c: sign(c, False, missing=True) for c in "]}"}
    odd = False  # errors, comments: spans and ends are set afterwards

    # Open containers, with their last child; the pairs that they are in the middle of, with their children, those that aren't comments, and the last one.
    stack, last, pair, total, solid, final = [0], [-1], [], [], [], []

    def new(n: int, a: int, b: int, above: int) -> int:
        at = len(signs)
        signs.append(n)
        start.append(a)
        end.append(b)
        parent.append(above)
        stop.append(at + 1)
        return at

    def put(kind: str, a: int, b: int) -> int:
        """A value in its place: below an open pair, as the key of a new one, or else below the container."""
        nonlocal odd
        at = len(signs)
        plain, key, value = labels[kind]
        if signs[stack[-1]] not in objects:
            last[-1] = at
            return new(plain, a, b, stack[-1])
        inside = pair and last[-1] == pair[-1]
        if inside and total[-1] == 2:
            total[-1] += 1
            solid[-1] += 1
            final[-1] = at
            end[pair[-1]] = b
            stop[pair[-1]] = at + 1
            return new(value, a, b, pair[-1])
        last[-1] = at
        if not inside and kind in ("string", "number"):
            new(pair_, a, b, stack[-1])
            pair.append(at)
            total.append(1)
            solid.append(1)
            final.append(at + 1)
            return new(key, a, b, at)
        odd = True
        new(error_, a, b, stack[-1])
        return new(plain, a, b, at)

    def wrong(a: int, b: int) -> None:
        nonlocal odd
        odd = True
        last[-1] = new(error_, a, b, stack[-1])

    def finish() -> None:
        """Ends the pair that the innermost container is in; one without a value is an error."""
        nonlocal odd
        if pair and last[-1] == pair[-1]:
            at = pair.pop()
            total.pop()
            if solid.pop() < 3:
                signs[at], odd = error_, True
            end[at] = end[final.pop()]

    def close(n: int, a: int, b: int) -> None:
        finish()
        at = stack.pop()
        last.pop()
        new(n, a, b, at)
        end[at], stop[at] = b, len(signs)
        if pair and final[-1] == at:
            end[pair[-1]], stop[pair[-1]] = b, len(signs)

    new(sign("document"), 0, len(source), -1)
    for m in LEX.finditer(source):
        kind = m.lastindex
        if kind == _SPACE:
            continue
        a, b = m.span()
        if kind == _STRING:
            at = put("string", a, b)
            if b - a > 2 and source.find("\\", a, b) < 0:
                signs.extend((quote, content, quote))
                start.extend((a, a + 1, b - 1))
                end.extend((a + 1, b - 1, b))
                parent.extend((at, at, at))
                stop.extend((at + 2, at + 3, at + 4))
            else:
                new(quote, a, a + 1, at)
                for x in PARTS.finditer(source, a + 1, b - 1):
                    new(escape if source[x.start()] == "\\" else content, x.start(), x.end(), at)
                new(quote, b - 1, b, at)
            stop[at] = len(signs)
            if pair and final[-1] == at:
                stop[pair[-1]] = len(signs)
        elif kind == _SIGN:
            text = source[a]
            if text == ":":
                if pair and last[-1] == pair[-1] and solid[-1] == 1:
                    final[-1] = new(colon, a, b, pair[-1])
                    total[-1] += 1
                    solid[-1] += 1
                else:
                    wrong(a, b)
            elif text == ",":
                finish()
                if len(stack) > 1:
                    last[-1] = new(comma, a, b, stack[-1])
                else:
                    wrong(a, b)
            elif text in CLOSERS:
                at = put("object" if text == "{" else "array", a, b)
                stack.append(at)
                last.append(new(tokens[text], a, b, at))
            elif len(stack) > 1 and (text == "}") == (signs[stack[-1]] in objects):
                close(tokens[text], a, b)
            else:
                wrong(a, b)
        elif kind == _NUMBER:
            put("number", a, b)
        elif kind == _WORD:
            put(m[0], a, b)
        elif kind == _COMMENT:
            odd = True
            n = sign("comment", extra=True)
            if pair and last[-1] == pair[-1] and total[-1] < 3:
                final[-1] = new(n, a, b, pair[-1])
                total[-1] += 1
            else:
                last[-1] = new(n, a, b, stack[-1])
        else:
            wrong(a, b)
    odd = odd or len(stack) > 1
    while len(stack) > 1:
        close(closers["}" if signs[stack[-1]] in objects else "]"], len(source), len(source))
    stop[0] = len(signs)
    if last[0] >= 0:
        start[0], end[0] = start[1], max(end[last[0]], end[1])
    if odd:
        made.settle()
        made.closed()
    return made


def parse(source: str) -> Syn:
    return tape(source).syn()
