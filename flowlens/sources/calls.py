"""Finding call sites in source files.

A small lexical scanner, run per file inside Spark tasks: comments and strings are blanked out, then
every ``(...)`` that follows a name chain is a call. Exact for plain call syntax; best effort for
calls without parentheses, trailing blocks, macros and interpolated strings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CALL_SCHEMA
from ..session import ship_package

# ---- fixed values -------------------------------------------------------------
WITHOUT_CALLS = {"html", "css", "scss", "yaml", "toml", "xml", "hcl", "markdown", "proto", "graphql", "bash",
                 "dockerfile", "make", "sql"}
HASH_COMMENTS = {"python", "ruby", "perl", "r", "elixir", "julia", "nim", "powershell", "php", "cmake"}
DASH_COMMENTS = {"lua", "haskell"}
# languages where "type name(...)" or "name(...) {" declares
C_LIKE = {"javascript", "typescript", "tsx", "vue", "svelte", "java", "c", "cpp", "c_sharp", "dart", "objc", "groovy"}
DECLARES = set("def defp func function fn fun sub proc class interface struct enum trait impl macro".split())
# words that are followed by "(" without calling anything
NOT_CALLED = DECLARES | set("if elif elsif else for foreach while until switch match catch return when unless with "
                            "and or not in is async typeof sizeof throw yield case select where except".split())
NOT_CALLED_IN = {
    "python": set("def class if elif else for while in not and or is return with except lambda assert del raise "
                  "yield await import from async global".split()),
    "go": NOT_CALLED | set("import const var type map chan range go defer".split()),
    "java": NOT_CALLED | {"super", "this", "synchronized", "try", "assert"},
}
BEFORE_CALL = set("return await new throw yield case in of else do typeof void delete not and or instanceof is "
                  "as go defer out ref".split())
# languages whose strings hold code: opening quote -> what a hole looks like
HOLES = {
    **dict.fromkeys(("javascript", "typescript", "tsx", "vue", "svelte"), {"`": r"\$\{[^{}]*\}"}),
    **dict.fromkeys(("kotlin", "groovy", "dart", "scala"), {'"': r"\$\{[^{}]*\}"}),
    **dict.fromkeys(("ruby", "elixir"), {'"': r"\#\{[^{}]*\}"}),
    "python": {"f": r"(?<!\{)\{[^{}]*\}(?!\})"},
}
# ---- end of fixed values --------------------------------------------------------

_NAME = "A-Za-z0-9_$"
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$@")
_BLANK = " \t\r\n"
_BODY = re.compile(r"\s*(?::[^={};()]+|throws [\w., ]+)?\{")
_OPEN_STRING, _IN_STRING, _CLOSE_STRING = "\x01", "\x02", "\x03"


def _hidden_text(language: str) -> re.Pattern:
    """Matches comments (group 1) and strings of a language."""
    comments = []
    if language in HASH_COMMENTS:
        comments.append(r"\#[^\n]*")
    if language in DASH_COMMENTS:
        comments.append(r"--[^\n]*")
    if language not in HASH_COMMENTS | DASH_COMMENTS or language == "php":
        comments.append(r"//[^\n]*|/\*.*?(?:\*/|\Z)")
    single = r"'(?:\\.|[^'\\\n])'" if language in ("rust", "c", "cpp", "java", "go") else r"'(?:\\.|[^'\\\n])*'"
    strings = [r'"""(?:\\.|[^\\])*?"""', r"'''(?:\\.|[^\\])*?'''", r'"(?:\\.|[^"\\\n])*"', single]
    strings.append(r"`[^`]*`" if language == "go" else r"`(?:\\.|[^`\\])*`")
    return re.compile(f"({'|'.join(comments)})|{'|'.join(strings)}", re.S)


_PATTERNS: dict[str, re.Pattern] = {}


def _blanked(text: str, language: str) -> str:
    """The text with comments turned to blanks and strings to marks, same length. Code in the holes of
    a string stays."""
    if language not in _PATTERNS:
        _PATTERNS[language] = _hidden_text(language)
    holes = HOLES.get(language, {})

    def hole_of(m: re.Match) -> str | None:
        if language == "python":
            return holes["f"] if re.search(r"(?<!\w)[rR]?[fF][rR]?\Z", text[max(0, m.start() - 3):m.start()]) else None
        return holes.get(text[m.start()])

    def blank(m: re.Match) -> str:
        n = m.end() - m.start()
        if m.group(1) is not None:
            return " " * n
        marks = _OPEN_STRING + _IN_STRING * (n - 2) + _CLOSE_STRING
        hole = hole_of(m) if holes else None
        if hole:
            parts, at = [], 0
            for h in re.finditer(hole, m.group()):
                parts += [marks[at:h.start() + 1], _PATTERNS[language].sub(lambda x: " " * (x.end() - x.start()), h.group()[1:])]
                at = h.end()
            marks = "".join(parts) + marks[at:]
        return marks

    return _PATTERNS[language].sub(blank, text)


def _brackets(code: str) -> tuple[dict[int, int], dict[int, int]]:
    """Matching positions of ( and [, by opener and by closer."""
    closes, opens, stack = {}, {}, []
    partner = {")": "(", "]": "[", "}": "{"}
    waiting = dict.fromkeys("([{", 0)
    for m in re.finditer(r"[()\[\]{}]", code):
        ch, at = m.group(), m.start()
        if ch in "([{":
            stack.append((ch, at))
            waiting[ch] += 1
        elif waiting[partner[ch]]:
            kind = ""
            while kind != partner[ch]:  # drops openers that were never closed
                kind, start = stack.pop()
                waiting[kind] -= 1
            closes[start], opens[at] = at, start
    return closes, opens


def _skip_back(code: str, i: int, blanks: str) -> int:
    while i > 0 and code[i - 1] in blanks:
        i -= 1
    return i


def _open_angle(code: str, end: int, extra: str = "") -> int:
    """Where the type arguments that end before ``end`` open, right behind a name; -1 if they are none."""
    depth, i = 0, end
    while i > 0 and (code[i - 1] in "<>,.|&[]" + extra + _BLANK or code[i - 1] in _NAME_CHARS):
        i -= 1
        depth += (code[i] == ">") - (code[i] == "<")
        if not depth:
            return i if i and code[i - 1] in _NAME_CHARS else -1
    return -1


def _chain_start(code: str, paren: int, opens: dict[int, int], known: dict[int, int]) -> int:
    """Where the callee of the argument list at ``paren`` starts, or -1 if nothing is called. ``known`` has the starts of
    the argument lists before it, so a chain is walked once."""
    i = paren
    if i and code[i - 1] == ">":  # type arguments
        i = _open_angle(code, i)
        if i < 0:
            return -1
    elif i and code[i - 1] in " \t":
        i = _skip_back(code, i, " \t")
        if not i or code[i - 1] not in _NAME_CHARS:
            return -1
    start = -1
    while i > 0:
        ch = code[i - 1]
        if ch in _NAME_CHARS:
            start = i - 1
            while start > 0 and code[start - 1] in _NAME_CHARS:
                start -= 1
            if code[start].isdigit():
                return -1
        elif ch in ")]" and i - 1 in opens:
            start = i = opens[i - 1]
            if known.get(i, -1) >= 0:
                return known[i]
            if i and (code[i - 1] in _NAME_CHARS or code[i - 1] in ")]" + _CLOSE_STRING):
                continue
        elif ch == _CLOSE_STRING:
            start = code.rindex(_OPEN_STRING, 0, i)
            prefix = re.search(r"(?<![\w$])[rRbBuUfF]{1,2}\Z", code[max(0, start - 3):start])
            start -= len(prefix.group()) if prefix else 0
        else:
            break
        before = _skip_back(code, start, _BLANK)
        if not before or code[before - 1] not in ".:>":
            break
        for mark in ("?.", "!.", "&.", "::", "->", "."):
            if code.endswith(mark, 0, before):
                i = _skip_back(code, before - len(mark), _BLANK)
                break
        else:
            break
    return start


def _word_before(code: str, i: int) -> str:
    j = _skip_back(code, i, " \t*&")
    k = j
    while k > 0 and code[k - 1] in _NAME_CHARS:
        k -= 1
    return code[k:j]


def _declares(code: str, start: int, paren: int, close: int, opens: dict[int, int], language: str) -> bool:
    before = _word_before(code, start)
    if before in (("def", "class") if language == "python" else DECLARES):
        return True
    at = _skip_back(code, start, " \t")
    if language == "go" and at and code[at - 1] == ")" and at - 1 in opens:  # func (recv T) Name(...)
        return _word_before(code, opens[at - 1]) == "func"
    if language not in C_LIKE:
        return False
    if at < start and at and code[at - 1] == ">" and _open_angle(code, at, "?") > 0:
        return True  # generic return type
    if before == "void" and language not in ("javascript", "typescript", "tsx", "vue", "svelte"):
        return True
    if before and not before[0].isdigit() and before not in BEFORE_CALL and start > at - len(before):
        return at < start or code[start - 1] in "*&"
    if code.find(".", start, paren) < 0 and _BODY.match(code, close + 1):
        return True
    return False


def find_calls(src: bytes, language: str) -> Iterator[tuple[int, int, int, str, str, str]]:
    """(start_byte, end_byte, line, callee, args_text, full_text), outer calls before inner ones."""
    if language in WITHOUT_CALLS:
        return
    code = _blanked(src.decode("latin-1"), language)  # one character per byte
    closes, opens = _brackets(code)
    keywords = NOT_CALLED_IN.get(language, NOT_CALLED)
    lines = [m.start() for m in re.finditer(b"\n", src)]
    found, known = [], {}
    for paren, close in closes.items():
        if code[paren] != "(":
            continue
        start = known[paren] = _chain_start(code, paren, opens, known)
        if start < 0:
            continue
        if code[start] == "@" and language != "ruby":
            start += 1  # decorator
        callee = code[start:paren].strip()
        head = re.match(rf"[{_NAME}@]*", callee).group()
        if head in keywords and (head == callee or callee[len(head)] in "( \t"):
            continue
        if language == "php" and re.search(r"->\s*[\w$]+\Z", callee):
            continue  # a member call is not one of the call node types
        if _word_before(code, start) == "new":
            if "(" not in callee:
                continue
            start = code.rindex("new", 0, start)
        elif _declares(code, start, paren, close, opens, language):
            continue
        found.append((start, close + 1, paren))
    for start, end, paren in sorted(found, key=lambda f: (f[0], -f[1])):
        text = [src[a:b].decode("utf-8", "replace") for a, b in ((start, paren), (paren, end), (start, end))]
        yield start, end, bisect_left(lines, start) + 1, text[0].strip(), text[1], text[2]


#: A batch of calls goes on at so many calls or bytes of text: as Python objects a short call is many times its text.
_ROWS_PER_BATCH = 10_000
_BYTES_PER_BATCH = 4 << 20
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
_CALLS = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in CALL_SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), _CALLS.types)], schema=_CALLS)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for files in batches:
        for i in range(files.num_rows):  # one file at a time becomes Python objects
            root_idx, base, rel, content, language = (column[i].as_py() for column in files.columns)
            for call in find_calls(content, language):
                rows.append((root_idx, base, rel, *call))
                size += 2 * len(call[5])
                if len(rows) >= _ROWS_PER_BATCH or size >= _BYTES_PER_BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
    if rows:
        yield _batch(rows)


def extract_calls(files: DataFrame) -> DataFrame:
    """The ``calls`` table of code files ``(root_idx, base, rel, content, language)``."""
    ship_package(files.sparkSession)
    return (files.filter(F.col("language").isNotNull()).select("root_idx", "base", "rel", "content", "language")
            .mapInArrow(_extract, CALL_SCHEMA))
