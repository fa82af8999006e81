"""Prompt guard: what to do with a prompt by its size, and reminders by a session's turns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

from strandwork.functions import text as T

#: Limits of prompts and turns.
WARN_WORDS, WARN_LINES, COMPRESS_WORDS, REJECT_WORDS = 900, 120, 800, 3000
COMPACT_TURN, RESET_TURN, CRITICAL_TURN, REMINDER_TURNS = 10, 40, 50, (5, 8, 10, 12, 15, 20, 28, 36)


def classify(prompt: Column, bypass: Column) -> Column:
    words, lines = T.word_count(prompt), F.size(F.split(prompt, "\n"))
    return (
        F.when(prompt.isNull() | bypass, "pass")
        .when(words > REJECT_WORDS, "reject")
        .when(words > COMPRESS_WORDS, "compress")
        .when((words > WARN_WORDS) | (lines > WARN_LINES), "warn")
        .otherwise("pass")
    )


def reminder(turn: Column) -> Column:
    return (
        F.when((turn >= CRITICAL_TURN) & (turn % 10 == 0), "critical")
        .when((turn >= RESET_TURN) & (turn % 5 == 0), "reset")
        .when(turn == COMPACT_TURN, "compact")
        .when(turn.isin(*REMINDER_TURNS), "remind")
    )


def json_field(payload: Column, names: list[str]) -> Column:
    """The first of the named fields that a JSON object holds, at the top or one level down, in order of the names."""
    found = [F.get_json_object(payload, f"$.{n}") for n in names] + [F.get_json_object(payload, f"$.*.{n}") for n in names]
    return F.coalesce(*found)


#: The fields that hold a prompt and a session, in order.
PROMPT_FIELDS = ("user_prompt", "prompt", "message", "input")
SESSION_FIELDS = ("session_id", "sessionId", "conversation_id", "conversationId")


def search(payload, names: tuple[str, ...], leaves: bool, blank: bool) -> str:
    """The first string of a named field: an object's own fields first, then its values in order, at any depth. With ``leaves`` any other
    string counts too; a blank field counts where ``blank``. '' if there is none. Works off a list, so depth costs no stack."""
    todo = [payload]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            own = next((x[n] for n in names if isinstance(x.get(n), str) and (blank or x[n].strip())), None)
            if own:
                return own
            if own is None:
                todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
        elif leaves and isinstance(x, str) and x:
            return x
    return ""


def _deep(payload: Column, find) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return find(json.loads(t)) if t is not None else None
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return run(payload)


def prompt_of(payload: Column) -> Column:
    """The prompt in a JSON payload, '' without one; null for null and for what is no JSON."""
    return _deep(payload, lambda x: search(x, PROMPT_FIELDS, True, True))


def session_of(payload: Column) -> Column:
    """The session of a JSON payload, 'default' without one; null for null and for what is no JSON."""
    return _deep(payload, lambda x: search(x, SESSION_FIELDS, False, False).strip() or "default")
