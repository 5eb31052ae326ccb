"""Finding the JSON value inside a model output. Plain Python for one text at a
time: Spark has no function that matches brackets, and only outputs that did
not parse get here."""

from __future__ import annotations

import re

_STRING_OR_BRACKET = {
    "{": re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|([{}])', re.DOTALL),
    "[": re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|([\[\]])', re.DOTALL),
}
_VALUE = re.compile(r"\{.*\}|\[.*\]", re.DOTALL)
_FENCED = re.compile(r"```.*\n((?:.|\n)*?)(?:\n```\s*)?")


def first_block(text: str) -> str | None:
    """The first balanced object or array, brackets inside strings not counted."""
    start = re.search(r"[{\[]", text)
    if start is None:
        return None
    opening, depth = start.group(), 0
    for token in _STRING_OR_BRACKET[opening].finditer(text, start.start()):
        if token.group(1):
            depth += 1 if token.group(1) == opening else -1
            if depth == 0:
                return text[start.start():token.end()]
    return None


def without_fence(text: str) -> str:
    """What stands below the first line of a code fence, without the line that ends it."""
    fenced = _FENCED.fullmatch(text)
    return fenced.group(1).strip() if fenced else text


def json_candidate(text: str) -> str | None:
    """What may be the JSON value of an output: all of it if its ends look like one, else the
    first balanced block, which may stand below a fence whose own line has a bracket."""
    whole = text.strip()
    if _VALUE.fullmatch(whole):
        return whole
    return first_block(whole) or first_block(without_fence(whole))
