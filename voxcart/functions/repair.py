"""Damaged JSON text to JSON text, by one pass of an automaton with a stack.

Model answers come with text around them, in code fences, cut off at a limit, with single or
curly quotes, bare keys, raw line breaks in strings, missing or spare commas, and words of
other languages for ``true`` and ``null``.  The automaton reads the first object or array
of a text character by character.  It knows on its stack which containers are open and what
each expects next, writes what is there in correct form, and at the end of the text closes
what is still open.  A quote inside a string ends it only if what follows can follow a
string, as far as ``AHEAD`` characters tell.
"""

from __future__ import annotations

import json
import re

# Containers that may be open at once, and characters that are looked ahead.
DEEPEST = 500
AHEAD = 64

QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
WORDS = {
    "true": "true", "false": "false", "null": "null", "none": "null",
    "nan": "null", "undefined": "null", "infinity": "null",
}
ESCAPES = frozenset('"\\/bfnrt')
NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\Z")
HEX = re.compile(r"[0-9a-fA-F]{4}")
# What stands in a JSON string as it is, whatever quote closes it.
_PLAIN = re.compile("[^\x00-\x1f\\\\\"'”’`]+")
_START = re.compile(r"[{\[]")
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)+", re.DOTALL)
_BARE = re.compile(r"[^\s,:{}\[\]\"“”]+(?:[ \t]+[^\s,:{}\[\]\"“”]+)*")

# What a container expects next.
KEY, COLON, VALUE, NEXT = range(4)


def _string(text: str, at: int, in_key: bool) -> tuple[str, int]:
    """The string that begins with the quote at ``at``, as JSON, and the place behind it."""
    close = QUOTES[text[at]]
    out = ['"']
    at += 1
    size = len(text)
    while at < size:
        plain = _PLAIN.match(text, at)
        if plain:
            out.append(plain[0])
            at = plain.end()
            continue
        c = text[at]
        if c == "\\":
            follows = text[at + 1 : at + 2]
            if follows in ESCAPES and follows:
                out.append(c + follows)
                at += 2
            elif follows == "u" and HEX.match(text, at + 2):
                out.append(text[at : at + 6])
                at += 6
            else:
                # No JSON escape, such as \' : the sign itself.
                out.append(json.dumps(follows)[1:-1] if follows else "")
                at += 2
        elif c == close and _ends(text, at + 1, in_key):
            return "".join(out) + '"', at + 1
        else:
            out.append(json.dumps(c, ensure_ascii=False)[1:-1])
            at += 1
    return "".join(out) + '"', size


def _ends(text: str, at: int, in_key: bool) -> bool:
    """Whether what is at ``at`` can follow a string."""
    rest = text[at : at + AHEAD]
    after = rest.lstrip()
    if not after:
        return True
    if in_key:
        return after[0] == ":" or after[0] in "}]"
    if after[0] in ",}]":
        return True
    # A missing comma: the next key or element begins, on a new line or with a quote.
    if after[0] in QUOTES and len(rest) > len(after):
        return bool(re.match(r"""["'“‘`][^"'”’`\n]*["'”’`]\s*[:,\]}]""", after))
    if "\n" in rest[: len(rest) - len(after)]:
        return bool(re.match(r"\w+\s*:", after))
    return False


def _bare(text: str, at: int, is_key: bool) -> tuple[str, int]:
    found = _BARE.match(text, at)
    if found is None:
        return "", at + 1
    word = found[0]
    if is_key:
        return json.dumps(word, ensure_ascii=False), found.end()
    # A bare value may be followed by a key without a comma; words of JSON stand alone.
    first = word.split()[0]
    if first.lower() in WORDS:
        return WORDS[first.lower()], at + len(first)
    if NUMBER.match(first):
        return first, at + len(first)
    plain = first.lstrip("+")
    if re.match(r"-?[0-9]*\.?[0-9]+\Z|-?[0-9]+\.\Z", plain):
        return json.dumps(float(plain)), at + len(first)
    return json.dumps(word.rstrip("'`"), ensure_ascii=False), found.end()


def repair_json(text: str | None) -> str | None:
    """The first object or array of ``text`` as JSON text; NULL if there is none."""
    begin = _START.search(text) if text else None
    if begin is None:
        return None
    out: list[str] = []
    closers: list[str] = []
    expects: list[int] = []
    at, size = begin.start(), len(text)

    def open_container(c: str) -> None:
        out.append(c)
        closers.append("}" if c == "{" else "]")
        expects.append(KEY if c == "{" else VALUE)

    def close_container() -> None:
        if expects[-1] == COLON:
            out.append(":null")
        elif expects[-1] == VALUE and closers[-1] == "}":
            out.append("null")
        if out[-1] == ",":
            out.pop()
        out.append(closers.pop())
        expects.pop()

    def before_item() -> None:
        if expects[-1] == NEXT:
            out.append(",")
            expects[-1] = KEY if closers[-1] == "}" else VALUE
        elif expects[-1] == COLON:
            out.append(":")
            expects[-1] = VALUE

    open_container(text[at])
    at += 1
    while at < size and closers:
        space = _SPACE.match(text, at)
        if space:
            at = space.end()
            continue
        c = text[at]
        if c in "}]":
            # A closer of an outer container closes the inner ones as well.
            if c in closers:
                while closers[-1] != c:
                    close_container()
                    if expects:
                        expects[-1] = NEXT
                close_container()
                if expects:
                    expects[-1] = NEXT
            at += 1
        elif c == ",":
            if expects[-1] == COLON:
                out.append(":null")
                expects[-1] = NEXT
            elif expects[-1] == VALUE and closers[-1] == "}":
                out.append("null")
                expects[-1] = NEXT
            if expects[-1] == NEXT:
                out.append(",")
                expects[-1] = KEY if closers[-1] == "}" else VALUE
            at += 1
        elif c == ":":
            if expects[-1] == COLON:
                out.append(":")
                expects[-1] = VALUE
            at += 1
        elif c in "{[":
            before_item()
            if expects[-1] == KEY:
                # An object or array in the place of a key has none.
                out.append('"":')
            if len(closers) >= DEEPEST:
                return None
            expects[-1] = NEXT
            open_container(c)
            at += 1
        else:
            before_item()
            is_key = expects[-1] == KEY
            found, at = _string(text, at, is_key) if c in QUOTES else _bare(text, at, is_key)
            if found:
                out.append(found)
                expects[-1] = COLON if is_key else NEXT
    while closers:
        close_container()
        if expects:
            expects[-1] = NEXT
    return "".join(out)
