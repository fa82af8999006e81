"""p4: functions and methods paired with their documentation.

Per file: strings and comments are blanked (positions kept), signatures are detected by regular expressions on what is left, bodies are
delimited by an indentation stack (Python), an end-keyword stack (Ruby) or a brace stack, and the nearest comment above is
attached if only annotations lie between (line distance 0); Python's documentation is the docstring. Pairs whose
documentation is empty or trivial are dropped.

Trivial: the description, which ends where a parameter or return section begins, has fewer than four words of letters,
opens with a to-do mark, or only repeats words of the function's name.

Defined results: null and empty texts and files of other languages give no row; one row per definition, also for equal
names; repeated rows give one row; lines end with LF or CRLF; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.llm.signs import suffix, suffix_rows
from strandwork.session import table

#: Fixed value: languages with functions.
LANGUAGES = {"python", "javascript", "typescript", "go", "java", "rust", "ruby"}
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_SLASHES = r"(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?(?:\*/|\Z))"
_JS_REGEX = r"(?<=[=(,:;!&|?{}\[])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_SKIP = {
    "python": rf"(?P<line>#[^\n]*)|(?P<doc>[rRbBuUfF]{{0,2}}(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|{_DQ}|{_SQ}))",
    "ruby": rf"(?P<line>#[^\n]*)|(?P<block>^=begin\b[\s\S]*?(?:^=end\b|\Z))|<<[~-]?(?P<q>[\"'`]?)(?P<h>[A-Z_]\w*)(?P=q)[^\n]*\n[\s\S]*?(?:^[ \t]*(?P=h)\b|\Z)|{_DQ}|{_SQ}|`[^`]*`",
    "go": rf"{_SLASHES}|`[^`]*`|{_DQ}|'(?:[^'\\\n]|\\.[^'\n]{{0,8}})'",
    "rust": rf"{_SLASHES}|b?r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n][^'\n]{{0,8}})'",
    "java": rf"{_SLASHES}|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|{_DQ}|{_SQ}",
    "javascript": rf"{_SLASHES}|`(?:[^`\\]|\\[\s\S])*`|{_DQ}|{_SQ}|{_JS_REGEX}",
}
_SKIP["typescript"] = _SKIP["javascript"]
_SKIP = {k: re.compile(v, re.M) for k, v in _SKIP.items()}

_JS_NAME = r"[A-Za-z_$][\w$]*"
_JS_MODS = r"(?:(?:public|private|protected|static|async|override|readonly|abstract|declare|export|default|get|set)\s+)*"
_SIGNATURE = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?=[(\[])", re.M),
    "ruby": re.compile(r"^[ \t]*(?:(?:private|public|protected|module_function|memoize)[ \t]+)?def[ \t]+(?:(?:self|[A-Z]\w*)\.)?(?P<name>\w+[?!=]?)", re.M),
    "go": re.compile(r"^func[ \t]+(?:\([^)\n]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?=[(\[])", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:[ \t]*\([^)\n]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\S*)?)[ \t]+)*fn[ \t]+(?P<name>\w+)[ \t]*(?=[(<])", re.M),
    "java": re.compile(r"^[ \t]*(?:@\w+(?:\([^)\n]*\))?[ \t]+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^;{}()]*?>\s+)?(?P<type>[A-Za-z_][\w.]*(?:\s*<[^;{}()=]*>)?(?:\s*\[\s*\])*)\s+(?P<name>[A-Za-z_$][\w$]*)[ \t]*(?=\()", re.M),
    "javascript": re.compile(
        rf"^[ \t]*{_JS_MODS}function\b\s*\*?\s*(?P<name>{_JS_NAME})\s*(?=[(<])"
        rf"|^[ \t]*{_JS_MODS}(?:(?:const|let|var)\s+)?(?:{_JS_NAME}\.)*(?P<name2>{_JS_NAME})\s*(?::[^=;\n]*)?=\s*(?:async\b\s*)?(?P<arrow>function\b|\(|<|{_JS_NAME}\s*=>)"
        rf"|^[ \t]*(?P<name4>{_JS_NAME})\s*:\s*(?:async\b\s*)?function\b"
        rf"|^[ \t]*{_JS_MODS}\*?[ \t]*(?P<name3>\#?{_JS_NAME})\??[ \t]*(?=[(<])",
        re.M,
    ),
}
_SIGNATURE["typescript"] = _SIGNATURE["javascript"]
#: Words that stand before a parenthesis or a name without defining anything.
_NO_NAME = set("if for while switch catch return function with await yield typeof new delete void throw else do case in of super import export instanceof".split())
_NO_TYPE = set("return new throw else case package import assert yield goto await class interface enum record extends implements".split())
_TODO = re.compile(r"\W*(todo|fixme|xxx|hack|tbd|wip)\b", re.I)
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: What opens a parameter or return section.
_SECTION = re.compile(
    r"\s*(?:[@\\](?!code|link)[A-Za-z]+|:[A-Za-z]+(?:[ \t][^:]*)?:|#+\s*(?:arguments?|parameters?|params?|returns?|errors?|panics?|examples?|safety)\b"
    r"|(?:args|arguments|parameters?|params|keyword args|returns?|return value|yields?|raises|throws|attributes|examples?|notes?)\s*:\s*$|(?:parameters?|returns?|raises|yields)\s*$|[-=]{3,}\s*$)",
    re.I,
)
_ROW = "id long, func_name string, def_line int, end_line int, documentation string, code string"


def blank(text: str, language: str) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with strings and comments blanked, (start, end, kind) of each comment or Python string)."""
    out, found, at = [], [], 0
    for m in _SKIP[language].finditer(text):
        kind = m.lastgroup if m.lastgroup in ("line", "block", "doc") else next((k for k in ("line", "block", "doc") if m.groupdict().get(k)), None)
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", m.group()) if kind in ("line", "block") else re.sub(r"[^\n]", "_", m.group())]
        if kind:
            found.append((m.start(), m.end(), kind))
        at = m.end()
    out.append(text[at:])
    return "".join(out), found


_PAIR = re.compile(r"[()\[\]{}]")
_TYPE_PAIR = re.compile(r"[<>()\[\]{};]")
_CLOSED = {")": "(", "]": "[", "}": "{"}
#: What follows the parameters of an arrow function, of a method, of a method's signature in a type, and of a Java method.
_ARROW = re.compile(r"\s*(?::[^;={}]*(?:\{[^{}]*\}[^;={}]*)?)?=>")
_METHOD = re.compile(r"\s*(?::\s*[^;{}=]*(?:\{[^{}]*\}[^;{}=]*)?)?\{")
_TYPED = re.compile(r"\s*:\s*[^;{}=\n]+;")
_JAVA_BODY = re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s<>@]+)?(?:default\s+[^;{}]+)?[{;]")


class Closers:
    """Position after the bracket that closes the one at a position, -1 if none does; all brackets of a text in one pass."""

    def __init__(self, code: str):
        self.end: dict[int, int] = {}
        stack = []
        for m in _PAIR.finditer(code):
            if m.group() in "([{":
                stack.append(m.start())
            elif stack:
                self.end[stack.pop()] = m.end()

    def __call__(self, at: int) -> int:
        return self.end.get(at, -1)


def angle(code: str, at: int) -> int:
    """Position after a type parameter list that starts at ``at``; -1 if what starts there is none."""
    stack: list[str] = []
    for m in _TYPE_PAIR.finditer(code, at):
        c = m.group()
        if c == ">":
            if code[m.start() - 1] in "-=" or stack[-1] != "<":
                continue
            stack.pop()
            if not stack:
                return m.end()
        elif c in "<([{":
            stack.append(c)
        elif c == ";":
            if "{" not in stack:
                return -1
        elif stack[-1] != _CLOSED[c]:
            return -1
        else:
            stack.pop()
    return -1


def signatures(code: str, language: str, close: Closers | None = None) -> Iterator[tuple[int, int, str, int]]:
    """(start of the statement, start of the name, name, position after the parameters) of each definition."""
    close = close or Closers(code)
    for m in _SIGNATURE[language].finditer(code):
        group = next(g for g in ("name", "name2", "name3", "name4") if g in m.groupdict() and m.group(g))
        name, at = m.group(group), m.end()
        if language in ("javascript", "typescript"):
            if name in _NO_NAME:
                continue
            if group == "name2":
                head = m.group("arrow")
                if head in ("(", "<"):
                    at -= 1
                    if head == "<":
                        at = angle(code, at)
                        at = code.find("(", at) if at > 0 else -1
                    end = close(at)
                    if end < 0 or not _ARROW.match(code, end):
                        continue
                else:
                    end = at
            else:
                if at < len(code) and code[at] == "<":
                    at = angle(code, at)
                    at = code.find("(", at) if at > 0 else -1
                end = close(at) if at >= 0 and at < len(code) and code[at] == "(" else at
                if group == "name3" and (end < 0 or not _METHOD.match(code, end)):
                    if end < 0 or language != "typescript" or not _TYPED.match(code, end):
                        continue
        elif language == "java":
            end = close(at)
            first = m.group("type").split("<")[0].strip()
            if first in _NO_TYPE or name in _NO_NAME or end < 0 or not _JAVA_BODY.match(code, end):
                continue
        elif language == "ruby":
            end = close(at) if code[at : at + 1] == "(" else at
        else:
            if code[at : at + 1] == "<":
                at = angle(code, at)
            elif language == "go" and code[at : at + 1] == "[" or language == "python" and code[at : at + 1] == "[":
                at = close(at)
            while 0 <= at < len(code) and code[at] in " \t\n":
                at += 1
            end = close(at) if 0 <= at < len(code) and code[at] == "(" else -1
            if end < 0:
                continue
        yield m.start() + len(m.group()) - len(m.group().lstrip()), m.start(group), name, end if end > 0 else at


_OPENS = re.compile(r"^\s*(?:def|class|module|if|unless|case|while|until|for|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")


_END = re.compile(r"(?<![\w.:])end\b(?![?!:=])")


class Depths:
    """Answers by position over running sums of a list of steps, prepared in one pass each."""

    def __init__(self, steps: list[int]):
        self.total = [0, *accumulate(steps)]

    def before(self) -> list[int]:
        """For each position the last one before it whose sum is at least as large, or -1."""
        out, stack = [], []
        for i, v in enumerate(self.total):
            while stack and self.total[stack[-1]] < v:
                stack.pop()
            out.append(stack[-1] if stack else -1)
            stack.append(i)
        return out

    def behind(self) -> list[int]:
        """For each position the first one behind it whose sum is at most as large, or the last position."""
        out, stack = [len(self.total) - 1] * len(self.total), []
        for i, v in enumerate(self.total):
            while stack and self.total[stack[-1]] >= v:
                out[stack.pop()] = i
            stack.append(i)
        return out


def body_end(lines: list[str], first: int, language: str, code: str, after: int, line_of, close: Closers, blocks: list[int]) -> int:
    """Last line (index) of a body that starts on line ``first``; ``blocks``: for Ruby, the line behind the block that each line opens."""
    if language == "python":
        own = len(lines[first]) - len(lines[first].lstrip())
        last = line_of(after)
        stack = [own]
        for i in range(last + 1, len(lines)):
            x = lines[i]
            if not x.strip():
                continue
            indent = len(x) - len(x.lstrip())
            while stack and indent <= stack[-1]:
                stack.pop()
            if not stack:
                break
            stack.append(indent)
            last = i
        return last
    if language == "ruby":
        return blocks[first] - 1
    brace, stop = code.find("{", after), code.find(";", after)
    if brace < 0 or 0 <= stop < brace:
        return line_of(stop if stop >= 0 else after)
    end = close(brace)
    return line_of(end - 1) if end > 0 else len(lines) - 1


def _strip_block(text: str) -> list[str]:
    inner = re.sub(r"^/\*+|\*+/$", "", text)
    return [re.sub(r"^\s*\*+ ?", "", x).strip() for x in inner.split("\n")]


def description(lines: list[str]) -> str:
    """What precedes any parameter or return section."""
    out = []
    for x in lines:
        if _SECTION.match(x):
            break
        out.append(x)
    return "\n".join(out).strip()


def is_trivial(text: str, name: str) -> bool:
    words = [w.lower() for w in _LETTERS.findall(text)]
    if len(words) < 4 or _TODO.match(text):
        return True
    own = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+", name)} | {name.lower()}
    return all(w in own for w in words)


def _annotations(code: list[str], opened: list[int], at: int, mark: str) -> int:
    """Index of the first line of the run of annotations that ends above line ``at``; opened: where the brackets closed above each line open."""
    while at > 0:
        i = opened[at]
        if i < 0 or not code[i].lstrip().startswith(mark):
            return at
        at = i
    return at


def functions(text: str, language: str) -> Iterator[tuple[str, int, int, list[str], str]]:
    """(name, line of the name, last line, documentation lines, code) of each named function; lines count from 1."""
    text = text.replace("\r\n", "\n")
    if text.startswith("﻿"):
        text = " " + text[1:] if language == "python" else text[1:]
    if language == "python" and text.startswith(" "):
        text = text[1:]
    code, marks = blank(text, language)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line_of = lambda p: bisect_right(starts, p) - 1
    raw, lines = text.split("\n"), code.split("\n")
    close = Closers(code)
    ruby = Depths([len(_OPENS.findall(x.rstrip())) - len(_END.findall(x.rstrip())) for x in lines]).behind() if language == "ruby" else []
    opened = Depths([sum(map(x.count, ")]}")) - sum(map(x.count, "([{")) for x in lines]).before() if language in ("rust", "java", "javascript", "typescript") else []
    blocks, whole, strings = {}, {}, {}
    for a, b, kind in marks:
        la, lb = line_of(a), line_of(max(a, b - 1))
        alone = not text[starts[la] : a].strip()
        if kind == "line" and alone:
            whole[la] = text[a:b]
        elif kind == "block" and alone:
            blocks[lb] = (la, text[a:b])
        elif kind == "doc":
            strings[a] = text[a:b]
    for start, named, name, after in signatures(code, language, close):
        first, line = line_of(start), line_of(named)
        doc: list[str] = []
        if language == "python":
            colon = _python_colon(code, after)
            if colon < 0:
                continue
            m = re.compile(r"\s*").match(code, colon)
            body = m.end()
            s = strings.get(body)
            if s is not None and "b" not in s[: len(s) - len(s.lstrip("rRbBuUfF"))].lower():
                s = s.lstrip("rRbBuUfF")
                quote = s[:3] if s[:3] in ('"""', "'''") else s[:1]
                doc = [x.strip() for x in s[len(quote) :].removesuffix(quote).split("\n")]
        elif language in ("go", "ruby"):
            i = first
            mark = "//" if language == "go" else "#"
            while i - 1 in whole and whole[i - 1].startswith(mark):
                i -= 1
            doc = [whole[k][len(mark) :].strip() for k in range(i, first) if not re.match(r"//(go|line|export|lint|nolint)\b:?\S|#!|# -\*-|# frozen_string_literal", whole[k])]
            if language == "ruby":
                doc = [x.lstrip("#").strip() for x in doc]
        elif language == "rust":
            i, doc = first, []
            while i > 0:
                if i - 1 in whole and re.match(r"///(?!/)", whole[i - 1]):
                    doc.insert(0, whole[i - 1][3:].strip())
                    i -= 1
                else:
                    up = _annotations(lines, opened, i, "#")
                    if up == i:
                        break
                    i = up
        else:
            i = _annotations(lines, opened, first, "@")
            if i - 1 in blocks and re.match(r"/\*\*(?!/)", blocks[i - 1][1]):
                doc = _strip_block(blocks[i - 1][1])
        if not any(doc):
            continue
        last = max(line, body_end(lines, line, language, code, after, line_of, close, ruby))
        yield name, line + 1, last + 1, doc, "\n".join(raw[first : last + 1])


def _python_colon(code: str, after: int) -> int:
    """Position after the colon that ends a def's header."""
    depth = 0
    for m in re.compile(r"[()\[\]{}:\n]").finditer(code, after):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            return m.end()
        elif c == "\n" and depth == 0 and not code[after : m.start()].rstrip().endswith("\\"):
            return -1
    return -1


def _extract(language_of):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                language = language_of.get(suffix(source))
                if language is None:
                    continue
                for name, line, last, doc, code in functions(text, language):
                    said = description(doc)
                    if is_trivial(said, name):
                        continue
                    for column, value in zip(out, (key, name, line, last, said, code)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())],
                names=["id", "func_name", "def_line", "end_line", "documentation", "code"],
            )

    return run


def documented_functions(df: DataFrame, suffixes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, func_name, def_line, end_line, documentation, code); a narrow map without a shuffle.

    The driver reads the suffixes of the seven languages (see ``suffix_rows``)."""
    known = {r.suffix.lower(): r.lang.lower() for r in suffix_rows(suffixes.where("suffix IS NOT NULL AND lang IS NOT NULL").select("suffix", "lang"))}
    language_of = {s: x for s, x in known.items() if x in LANGUAGES}
    some = df.where(F.col(key).isNotNull() & F.col("source").isNotNull() & (F.length("raw_text") > 0)).select(F.col(key).cast("long").alias("id"), "source", "raw_text")
    some = some.where(F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1)).isin(*sorted(language_of)))
    return some.mapInArrow(_extract(language_of), _ROW).withColumnRenamed("id", key)


def p4_found(spark, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "code_suffixes")).select("doc_id", "func_name", "def_line").distinct()


def p4_pairs(spark, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "code_suffixes"))
