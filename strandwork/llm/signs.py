"""Signs that nobody of a project wrote a file by hand: in its path, in its remarks, in its content."""

from __future__ import annotations

import re
from collections import Counter

#: Customary names of directories and files for other people's code and for output of tools.
FOREIGN_DIRS = {"vendor", "vendors", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "extern", "external", "externals", "deps", "node_modules", "bower_components", "jspm_packages", "site-packages", "pods"}
GENERATED_DIRS = {"gen", "_gen", "generated", "_generated", "__generated__", "autogen", "auto-generated", "autogenerated", "codegen", "generated-sources", "generated-src", "generated_src"}
GENERATED_NAME = re.compile(r"(\.(generated|gen|g|autogen|designer|pb|pb\.gw|pb2|grpc)\.\w+|[._-](generated|autogen|gen|pb2|pb2_grpc|pb)\.\w+|^(zz_)?generated[._-].*|generated\.(java|kt|cs|scala|swift))$")
BUILT_NAME = re.compile(r"[.-](min|bundle|bundled|packed|umd\.prod|chunk)\.(js|mjs|cjs|css|jsx|ts)$")

#: Customary wordings of remarks. Each states what the file is, so a remark that tells of such things in passing has none.
_GENERATED = [
    r"^code generated\b.*\bdo not (edit|modify|change)",
    r"^@generated\b",
    r"^<auto-?generated\b",
    r"^(this (file|code|module|source) (is|was|has been) )?(automatically|auto-?) ?generated\b(?!.*\bby hand\b)",
    r"^auto-?generated file\b",
    r"^this (file|code|module|source) (is|was|has been) (machine[- ])?(generated|produced|written|created) (by|from) (?!hand)",
    r"^generated (by|from|with|using)\b.*\b(do not|don't) (edit|modify|change|touch)",
    r"^produced by\b.*\b(edits?|changes?)\b.*\b(overwritten|lost|discarded)",
    r"^(note: ?)?machine[- ](written|generated|made)\b",
    r"^(do not|don't) (edit|modify)( this file)?( by hand| manually)?[.!;:,]? *((this|it) (is|was) |auto|generated|all changes|your changes|changes)",
    r"\b(manual|hand|local|your) (edits?|changes?|modifications?) (are|will be|get) (overwritten|lost|discarded)",
    r"\bhand (edits?|changes?) do(es)? not survive\b",
    r"\boutput,? (do not edit|regenerate (with|by|using|from))\b",
    r"^(schema|checksum|source hash|content hash|input digest)[: ] *[0-9a-f]{8,64}$",
]
_FOREIGN = [
    r"^vendored (from|copy|by|version)\b",
    r"^third[- ]party (code|source|file|library|software)\s*:",
    r"^(copied|taken|included) (verbatim|unchanged|unmodified|as is) from\b",
    r"^imported from\b.*\b(revision|rev|commit|upstream|tag|version)\b",
    r"\bupstream (copy|version|source)\b.*\b(do not|don't|no local)\b",
    r"^(this is )?an? (unmodified|verbatim|unchanged|exact) (snapshot|copy)\b",
]
REMARK_GENERATED = re.compile("|".join(_GENERATED), re.I)
REMARK_FOREIGN = re.compile("|".join(_FOREIGN), re.I)
#: Whatever opens a line of remark, and what may close it.
_LINE = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|\*+(?!/)|--+|;+|<!--)\s*[~=*-]*\s*(.*?)\s*[~=*-]*\s*(?:\*/|-->)?\s*$")
_SOON = re.compile("generat|produced|machine|edit|modify|vendored|third|verbatim|imported|upstream|unmodified|unchanged|copy|survive|overwritten|lost|regenerate|schema|checksum|hash|digest", re.I)
_LITERAL = re.compile(
    r'"""[\s\S]*?"""' r"|'''[\s\S]*?'''" r"|`[^`]*`" r'|"(?:[^"\\\n]|\\.)*"' r"|'(?:[^'\\\n]|\\.)*'"
)
_COMMENT_OR_LITERAL = {
    "hash": re.compile(_LITERAL.pattern.replace("|`[^`]*`", "") + r"|(?P<c>#[^\n]*)"),
    "slash": re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|" + r'`[^`]*`|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''),
    "rust": re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|" + r'r(?P<h>#*)"[\s\S]*?"(?P=h)|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\\n]|\\.)\''),
    "dash": re.compile(r"(?P<c>--[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|" + r"'(?:[^'])*'"),
}
#: Comment styles by suffix.
STYLE = {".py": "hash", ".rb": "hash", ".sh": "hash", ".rs": "rust", ".sql": "dash"}
_NUMBER = re.compile(r"(?<![\w.])[+-]?(?:0x[0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])")
_WORD = re.compile(r"[^\W\d]\w*")
_DIGITS = re.compile(r"\d+")
_IMPORT = re.compile(r'(import|from|use|package|require|using|#include)\b|(const|let|var) \w+ = require\(|[()]$|(\w+ )?""$')
#: Words that make a line's shape.
_STATEMENT = set("def end return pub fn func class struct const let var export function public private static final if for while switch case throw raise new await async".split())
LONG_LINE = 200


def suffix(source: str) -> str:
    name = source.rpartition("/")[2].lower()
    dot = name.rfind(".")
    return name[dot:] if dot > 0 else ""


def suffix_rows(suffixes, most: int = 1000) -> list:
    """The distinct rows of a table of suffixes, for the driver; a table with more than ``most`` rows is no such table and is refused."""
    rows = suffixes.distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} suffixes")
    return rows


def path_sign(source: str | None) -> str | None:
    """'foreign', 'generated' or 'built' by the directories below the repository and the file's name."""
    if not source:
        return None
    *dirs, name = source.lower().split("/")
    below = set(dirs[1:])
    if below & FOREIGN_DIRS:
        return "foreign"
    if BUILT_NAME.search(name):
        return "built"
    if below & GENERATED_DIRS or GENERATED_NAME.search(name):
        return "generated"
    return None


def split_code(text: str, style: str) -> tuple[list[str], str, list[str]]:
    """(comments, code without comments and with literals blanked, literals)."""
    comments, literals, code, at = [], [], [], 0
    for m in _COMMENT_OR_LITERAL[style].finditer(text):
        code.append(text[at : m.start()])
        at = m.end()
        if m.group("c") is not None:
            comments.append(m.group("c"))
        else:
            literals.append(m.group())
            code.append('""')
    code.append(text[at:])
    return comments, "".join(code), literals


def remark_sign(comments: list[str]) -> str | None:
    for c in comments:
        if not _SOON.search(c):
            continue
        for line in c.split("\n"):
            m = _LINE.match(line)
            said = m.group(1) if m else line.strip()
            if REMARK_FOREIGN.search(said):
                return "foreign"
            if REMARK_GENERATED.search(said):
                return "generated"
    return None


def is_minified(code: str) -> bool:
    """Most of the code, literals aside, lies in overlong lines and hardly has a blank."""
    lines = [x.strip() for x in code.split("\n")]
    total = sum(map(len, lines))
    long = [x for x in lines if len(x) > LONG_LINE]
    size = sum(map(len, long))
    return size >= 0.5 * total and size > 0 and sum(x.count(" ") + x.count("\t") for x in long) < 0.12 * size


def is_data(code: str, literals: list[str]) -> bool:
    """Numbers and strings without blanks outweigh everything that is neither literal nor punctuation."""
    numbers = _NUMBER.findall(code)
    tight = [x for x in literals if x.count(" ") * 40 <= len(x)]
    size = sum(map(len, numbers)) + sum(map(len, tight))
    rest = len(re.sub(r"[\s\[\](){},;:]+", "", _NUMBER.sub("", code))) - 2 * len(literals)
    return size >= 200 and size >= 1.3 * max(0, rest)


def is_uniform(code: str) -> bool:
    """Twelve or more lines beside imports, nearly all of the same four shapes (names and numbers blanked)."""
    shapes = Counter()
    for line in code.split("\n"):
        x = line.strip()
        if x and not _IMPORT.match(x):
            shapes[_DIGITS.sub("0", _WORD.sub(lambda m: m.group() if m.group() in _STATEMENT else "w", x))] += 1
    total = shapes.total()
    return total >= 12 and sum(n for _, n in shapes.most_common(4)) >= 0.97 * total


def content_sign(source: str | None, text: str | None, code_suffixes: frozenset[str]) -> str | None:
    """'foreign', 'generated', 'built' or 'data' by remarks and content."""
    if not text:
        return None
    end = suffix(source or "")
    comments, code, literals = split_code(text.replace("\r\n", "\n"), STYLE.get(end, "slash" if end in code_suffixes else "hash"))
    sign = remark_sign(comments)
    if sign is None and end in code_suffixes:
        if end in (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".css") and is_minified(code):
            sign = "built"
        elif end not in (".css", ".sql", ".sh"):
            sign = "data" if is_data(code, literals) else "generated" if is_uniform(code) else None
    return sign
