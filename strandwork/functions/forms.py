"""Declarations and imports as written forms: "fn NAME GENERICS? ARGS" instead of hand-made expressions.

A form is a line of tokens. Capitals stand for parts of the source text (``PARTS``), ``a|b`` for one of several words, a trailing ``?`` for
something that may be missing, anything else for itself. Between two words there are blanks, around punctuation there may be. The resulting
expression reads alike in Java and RE2; its groups are the capitals that capture."""

from __future__ import annotations

import re

#: What the capitals stand for, and whether they begin and end like a word.
PARTS = {
    "NAME": (r"(\w+)", True, True),
    "DOTTED": (r"([\w.]+)", True, True),
    "SCOPED": (r"([\w:]+)", True, True),
    "PATH": (r"[\"']([^\"']+)[\"']", False, False),
    "HEADER": (r"[<\"]([^>\"]+)[>\"]", False, False),
    "ARGS": (r"\(([^)]*)\)", False, False),
    "WORD": (r"\w+", True, True),
    "LETTER": (r"\w", True, True),
    "SPAN": (r"\([^)]*\)", False, False),
    "RECEIVER": (r"\([^)]+\)", False, True),
    "GENERICS": (r"<[^>]*>", False, False),
    "TYPES": (r"\w[\w *:&]*", True, True),
    "ANYTHING": (r".*", True, False),
    "LITTLE": (r".*?", True, False),
    "HEAD": (r"[^{;]*", False, False),
    "BASES": (r"[^{]*", False, False),
}


def _token(token: str) -> tuple[str, bool, bool]:
    if token in PARTS:
        return PARTS[token]
    words = [re.escape(w) for w in token.split("|")] if len(token) > 1 else [re.escape(token)]
    piece = words[0] if len(words) == 1 else "(?:" + "|".join(words) + ")"
    return piece, bool(re.match(r"\w", token)), bool(re.search(r"\w$", token))


def form(text: str, start: bool = False) -> str:
    """The expression of a form; with ``start`` it begins at the start of a line."""
    tokens = text.split()
    out, after = ("(?m)^" if start else ""), None  # after: whether the text so far ends like a word
    gap = lambda a, b: "" if a is None else r"\s+" if a and b else r"\s*"
    for i, token in enumerate(tokens):
        optional = token.endswith("?") and len(token) > 1
        piece, left, right = _token(token[:-1] if optional else token)
        if not optional:
            out, after = out + gap(after, left) + piece, right
            continue
        follows = _token(tokens[i + 1].rstrip("?"))[1] if i + 1 < len(tokens) else False
        out += gap(after, True if after else left) if after is not None and (left or follows) else gap(after, False)
        out, after = out + f"(?:{piece}{gap(right, follows)})?", None
    return out


def either(*forms: str, start: bool = True) -> str:
    """One expression for several forms, without groups of its own."""
    return ("(?m)^" if start else "") + "(?:" + "|".join(re.sub(r"(?<!\\)\((?!\?)", "(?:", form(f)) for f in forms) + ")"
