"""Python sources by their syntax tree: segments for chunking, definitions for patching."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, functions as F

_DEFINES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def parse(text: str) -> ast.Module | None:
    """The tree of a text, or None if it is no Python."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def first_line(node: ast.AST) -> int:
    """The line (from 1) on which a definition begins, decorators included."""
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


def segments(text: str | None) -> list[str]:
    """The outermost definitions of a Python text, whole lines each; what lies outside is left out. [] if there are none or it does not parse."""
    tree = parse(text) if text else None
    if tree is None:
        return []
    lines = text.split("\n")
    found, queue = [], list(tree.body)
    while queue:
        node = queue.pop(0)
        if isinstance(node, _DEFINES):
            found.append((first_line(node), node.end_lineno))
        else:
            queue = [x for x in ast.iter_child_nodes(node) if isinstance(x, ast.stmt)] + queue
    return ["\n".join(lines[a - 1 : b]) for a, b in sorted(found)]


def segment_column(text: Column, is_python: Column) -> Column:
    """array<string>: ``segments`` of Python texts, batched over Arrow; [] for others."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(segments)

    return run(F.when(is_python, text))


def definitions(tree: ast.Module, kind: str, name: str) -> list[ast.AST]:
    """Definitions of a name: classes, or functions; 'C.m' names the method m of the class C."""
    owner, _, last = name.rpartition(".")
    wanted = ast.ClassDef if kind == "class" else (ast.FunctionDef, ast.AsyncFunctionDef)
    scopes = [tree] if not owner else [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef) and n.name == owner]
    return [n for s in scopes for n in (ast.walk(s) if not owner else s.body) if isinstance(n, wanted) and n.name == last]


def reindent(code: str, indent: str) -> list[str]:
    """Lines of code moved so that the first that is not blank starts at ``indent``."""
    lines = code.rstrip("\n").split("\n")
    first = next((x for x in lines if x.strip()), "")
    own = len(first) - len(first.lstrip())
    return [indent + (x[own:] if not x[:own].strip() else x.lstrip()) if x.strip() else "" for x in lines]


def replace_definition(content: str, kind: str, name: str, code: str) -> tuple[str | None, str]:
    """(new content, 'ok') or (None, why not): the one definition of a name gives way to ``code``; its decorators stay."""
    tree = parse(content)
    if tree is None:
        return None, "no syntax tree"
    found = definitions(tree, kind, name)
    if len(found) != 1:
        return None, f"definition occurs {len(found)} times"
    lines = content.split("\n")
    at, end = found[0].lineno, found[0].end_lineno
    indent = lines[at - 1][: len(lines[at - 1]) - len(lines[at - 1].lstrip())]
    return "\n".join(lines[: at - 1] + reindent(code, indent) + lines[end:]), "ok"
