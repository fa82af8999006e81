"""SEARCH/REPLACE blocks: parsing and all-or-nothing application per file."""

from __future__ import annotations

import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandwork.operators.syntax import replace_definition

#: The markers of a block.
_BLOCK = re.compile(r"^<{5,} ?SEARCH[ \t]*(?:\((?P<file>[^)\n]+)\))?[ \t]*\n(?P<search>.*?)^={5,}[ \t]*\n(?P<replace>.*?)^>{5,} ?REPLACE[ \t]*$", re.M | re.S)
_NAMED = re.compile(r"^@@(?P<kind>FUNCTION|CLASS|METHOD)[ \t]+(?P<name>[\w.]+)[ \t]*\n(?P<code>.*?)^@@END[ \t]*$", re.M | re.S)
_HEAD = r"(?m)^(?P<indent>[ \t]*)(?:async[ \t]+)?(?:def|class|function|func|fn)[ \t]+{name}\b"


def parse_blocks(text: str) -> list[dict]:
    """Blocks in order of their line: kind, file, search, replace, name, line."""
    out = []
    for m in _BLOCK.finditer(text):
        out.append({"kind": "search", "file": m["file"], "search": m["search"].removesuffix("\n"), "replace": m["replace"].removesuffix("\n"), "name": None, "line": text.count("\n", 0, m.start()) + 1})
    for m in _NAMED.finditer(text):
        out.append({"kind": m["kind"].lower(), "file": None, "search": None, "replace": m["code"].removesuffix("\n"), "name": m["name"], "line": text.count("\n", 0, m.start()) + 1})
    return sorted(out, key=lambda b: b["line"])


def apply_block(content: str, block: dict, file: str = "") -> tuple[str | None, str]:
    """(new content, 'ok') or (None, why not). A search text must occur exactly once; a named definition too.

    In Python that parses, definitions are found in the syntax tree; elsewhere by the form of their first line and indentation."""
    if block["kind"] == "search":
        n = content.count(block["search"]) if block["search"] else 0
        return (content.replace(block["search"], block["replace"], 1), "ok") if n == 1 else (None, f"search text occurs {n} times")
    if file.lower().endswith(".py"):
        new, why = replace_definition(content, block["kind"], block["name"], block["replace"])
        if why != "no syntax tree":
            return new, why
    name = block["name"].rpartition(".")[2]
    heads = list(re.finditer(_HEAD.format(name=re.escape(name)), content))
    if len(heads) != 1:
        return None, f"definition occurs {len(heads)} times"
    lines, first = content.split("\n"), content.count("\n", 0, heads[0].start())
    indent = len(heads[0]["indent"].expandtabs())
    last = first
    for i in range(first + 1, len(lines)):
        if lines[i].strip() and len(lines[i].expandtabs()) - len(lines[i].expandtabs().lstrip()) <= indent:
            if lines[i].strip() in ("}", "end", "};"):
                last = i
            break
        if lines[i].strip():
            last = i
    own = min((len(x) - len(x.lstrip()) for x in block["replace"].split("\n") if x.strip()), default=0)
    new = [heads[0]["indent"] + x[own:] if x.strip() else x for x in block["replace"].split("\n")]
    return "\n".join(lines[:first] + new + lines[last + 1 :]), "ok"


def apply_text(content: str, patch: str | None, file: str = "") -> tuple[str, int, int, str]:
    """(content, applied, failed, message): every block of a patch in order, or none of them."""
    blocks = [b for b in parse_blocks(patch or "") if b["file"] in (None, file)]
    new = content
    for i, b in enumerate(blocks):
        new, why = apply_block(new, b, file)
        if new is None:
            left = len(blocks) - i - 1
            return content, 0, len(blocks), why + (f"; {left} blocks skipped" if left else "")
    return new, len(blocks), 0, "ok"


def apply_patches(files: DataFrame, patches: DataFrame, dry_run: bool = False) -> DataFrame:
    """(file, content, applied, failed, message): every block of a file's patch in order, or none of them; a dry run counts, and keeps the content.

    files (file, content), patches (file, patch); files without a patch keep their content; a null patch has no blocks; a patch without
    its file gives a row without content in which all its blocks have failed."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content, patch in zip(pdf["file"], pdf["content"], pdf["patch"]):
                if content is None:
                    rows.append((file, None, 0, len(parse_blocks(patch or "")), "file not found"))
                    continue
                new, applied, failed, why = apply_text(content, patch, file or "")
                rows.append((file, content if dry_run else new, applied, failed, why))
            yield pd.DataFrame(rows, columns=["file", "content", "applied", "failed", "message"])

    one = patches.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("patch")), "\n").alias("patch"))
    return files.join(one, "file", "full_outer").mapInPandas(run, "file string, content string, applied int, failed int, message string")


def apply_to_folder(text: str, folder: Path, default: str | None = None, dry_run: bool = False) -> dict:
    """{applied, failed, messages} of a patch over files of a folder: one transaction a file; a block without a file goes to ``default``."""
    out: dict = {"applied": 0, "failed": 0, "messages": []}
    groups: dict[str, list[dict]] = {}
    for b in parse_blocks(text):
        name = b["file"] or default
        if name is None:
            out["failed"] += 1
            out["messages"].append(f"line {b['line']}: no file")
        else:
            groups.setdefault(name, []).append(b)
    for name, blocks in groups.items():
        path = folder / name
        try:
            content = new = path.read_text(encoding="utf-8")
        except (OSError, UnicodeError) as e:
            out["failed"] += len(blocks)
            out["messages"].append(f"{name}: {type(e).__name__}")
            continue
        why = "ok"
        for b in blocks:
            new, why = apply_block(new, b, name)
            if new is None:
                break
        if new is None:
            out["failed"] += len(blocks)
            out["messages"].append(f"{name}: {why}; file kept")
            continue
        if not dry_run and new != content:
            path.write_text(new, encoding="utf-8")
        out["applied"] += len(blocks)
        out["messages"].append(f"{name}: {len(blocks)} blocks{' (dry run)' if dry_run else ''}")
    return out
