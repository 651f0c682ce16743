"""Leaves of a JSON document, by one walk over its tokens with a stack of open containers.

Nothing recurses, so nesting is bounded by the text alone; a document is walked twice, once to
see whether it is JSON as a whole, once to give its leaves, so they need not be kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import JSONDecodeError, scanstring

BLANK = re.compile(r"[ \t\n\r]*")
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
WORDS = {"t": ("true", "bool"), "f": ("false", "bool"), "n": ("null", "null")}
QUOTED = re.compile(r'[.\["]')

Leaf = tuple[str, str, str]  # path, type, value


def step_name(key: str) -> str:
    """The name of a key inside of a path; one that looks like a path is quoted, so that no two leaves share one."""
    if key == "" or QUOTED.search(key):
        return '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return key


def _path(stack: list) -> str:
    parts = []
    for frame in stack:
        if frame[0] == "[":
            parts.append(f"[{frame[1]}]")
        else:
            parts.append(f".{step_name(frame[1])}" if parts else step_name(frame[1]))
    return "".join(parts)


def _string(text: str, at: int) -> tuple[str, int]:
    value, end = scanstring(text, at, True)
    if not value.isascii():
        value = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # halves of a pair alone are no text
    return value, end


def _walk(text: str, dead: set[int], emit: bool) -> Iterator[Leaf]:
    """Leaves in order, if asked for; ``dead`` gets, or has, the places of keys that a later equal key of their object replaces."""
    stack: list[list] = []  # [kind, position or key, places of keys, whether a dead value is open above]
    at, end, skipped = BLANK.match(text, 0).end(), len(text), 0
    while True:
        # a value starts here
        c = text[at : at + 1]
        leaf = None
        if c == "{" or c == "[":
            at = BLANK.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
                leaf = ("tree", "{}") if c == "{" else ("list", "[]")
            else:
                stack.append([c, 0, {}, False])
                if c == "{":
                    at, skipped = _key(text, at, stack[-1], dead, emit, skipped)
                continue
        elif c == '"':
            value, at = _string(text, at + 1)
            leaf = ("string", value)
        elif c in WORDS and c and text.startswith(WORDS[c][0], at):
            at += len(WORDS[c][0])
            leaf = WORDS[c][1], WORDS[c][0]
        elif m := NUMBER.match(text, at):
            at = m.end()
            leaf = ("number", m[0])
        else:
            raise JSONDecodeError("no value", text, at)
        if emit and not skipped:
            yield _path(stack), *leaf
        # what follows a value
        while True:
            at = BLANK.match(text, at).end()
            if not stack:
                if at != end:
                    raise JSONDecodeError("text behind the value", text, at)
                return
            frame = stack[-1]
            if frame[3]:
                frame[3] = False
                skipped -= 1
            c = text[at : at + 1]
            if c == ",":
                at = BLANK.match(text, at + 1).end()
                if frame[0] == "[":
                    frame[1] += 1
                else:
                    at, skipped = _key(text, at, frame, dead, emit, skipped)
                break
            if c != ("]" if frame[0] == "[" else "}"):
                raise JSONDecodeError("neither a comma nor an end", text, at)
            stack.pop()
            at += 1


def _key(text: str, at: int, frame: list, dead: set[int], emit: bool, skipped: int) -> tuple[int, int]:
    if text[at : at + 1] != '"':
        raise JSONDecodeError("no key", text, at)
    place = at
    key, at = _string(text, at + 1)
    at = BLANK.match(text, at).end()
    if text[at : at + 1] != ":":
        raise JSONDecodeError("no colon", text, at)
    frame[1] = key
    if not emit:
        if key in frame[2]:
            dead.add(frame[2][key])
        frame[2][key] = place
    elif place in dead:
        frame[3] = True
        skipped += 1
    return BLANK.match(text, at + 1).end(), skipped


def checked(text: str) -> set[int] | None:
    """Places of replaced keys; None if the text is not JSON."""
    dead: set[int] = set()
    try:
        for _ in _walk(text, dead, False):
            pass
    except ValueError:
        return None
    return dead


def leaves(text: str) -> Iterator[Leaf]:
    """Path, type and value of each leaf; none of a text that is not JSON. Empty containers are leaves, numbers stay as written, the last of equal keys wins."""
    dead = checked(text)
    if dead is not None:
        yield from _walk(text, dead, True)
