"""Code-repository scan: symbols, calls by scope, imports, and notes tied to code.

Source files are rows (path, source), each read by a state machine in the tasks:
it walks the characters once, blanks comments and strings (so that code inside
them does not count) and pairs brackets.  Definitions may so take several lines,
a call's caller is the innermost function whose body holds it, and imports keep
their quoted paths.  A file is at most 512 KB.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 512 * 1024
#: Language by the file's extension.
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "cs": "csharp", "rb": "ruby"}
VENDORED = r"(?:^|/)(?:node_modules|vendor|target|dist|build|\.git|\.venv|venv|__pycache__)(?:/|$)"
#: What opens a comment or string that ends at ... and may hold an escaped end; longer openings first.
QUOTES = {
    "rust": [("//", "\n", False), ("/*", "*/", False), ('"', '"', True)],
    "python": [("#", "\n", False), ('"""', '"""', True), ("'''", "'''", True), ('"', '"', True), ("'", "'", True)],
    "typescript": [("//", "\n", False), ("/*", "*/", False), ("`", "`", True), ('"', '"', True), ("'", "'", True)],
    "go": [("//", "\n", False), ("/*", "*/", False), ("`", "`", False), ('"', '"', True), ("'", "'", True)],
    "java": [("//", "\n", False), ("/*", "*/", False), ('"""', '"""', True), ('"', '"', True), ("'", "'", True)],
    "csharp": [("//", "\n", False), ("/*", "*/", False), ('@"', '"', False), ('"', '"', True), ("'", "'", True)],
    "ruby": [("#", "\n", False), ('"', '"', True), ("'", "'", True)],
}
#: Definitions of functions in blanked text; the name is the first group that matched.
FUNCTIONS = {
    "rust": r"\bfn\s+([A-Za-z_]\w*)",
    "python": r"(?m)^[ \t]*(?:async\s+)?def\s+([A-Za-z_]\w*)",
    "typescript": r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]*?)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)\s*(?::[^=;{]*?)?=>"
                  r"|(?m:^)[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^<>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^;{}]*?)?\{",
    "go": r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "java": r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)+(?:<[^>]*>\s*)?(?:[\w.<>\[\], ?]+?\s+)?([A-Za-z_]\w*)\s*\(",
    "csharp": r"(?m)^[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:public|protected|private|internal|static|virtual|override|async|sealed|abstract)\s+)+(?:[\w.<>\[\], ?]+?\s+)?([A-Za-z_]\w*)\s*(?:<[^<>]*>)?\(",
    "ruby": r"(?m)^[ \t]*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)",
}
TYPES = r"(?m)^[ \t]*(?:(?:pub(?:\([^)]*\))?|export|default|public|private|protected|internal|abstract|final|sealed|static|declare|partial)\s+)*(?:class|struct|enum|trait|interface|module|type)\s+([A-Za-z_]\w*)"
#: Imports in the text with comments blanked and strings kept.
IMPORTS = {
    "rust": r"(?m)^[ \t]*(?:pub\s+)?use\s+([^;{]+?)(?:::)?\s*(?:\{|;|\bas\b)|^[ \t]*extern\s+crate\s+(\w+)",
    "python": r"(?m)^[ \t]*from\s+([.\w]+)\s+import\b|^[ \t]*import\s+([\w.]+(?:\s*(?:as\s+\w+)?\s*,\s*[\w.]+)*)",
    "typescript": r"\b(?:import|export)\b[^;'\"`]*?\bfrom\s*['\"]([^'\"]+)|\bimport\s*\(?\s*['\"]([^'\"]+)|\brequire\s*\(\s*['\"]([^'\"]+)",
    "go": r"(?m)^import\s+(?:\w+\s+)?\"([^\"]+)\"|^[ \t]+(?:[\w.]+\s+)?\"([^\"]+)\"[ \t]*$",
    "java": r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    "csharp": r"(?m)^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",
    "ruby": r"(?m)^[ \t]*(?:require|require_relative|load)\s*\(?\s*['\"]([^'\"]+)",
}
NOT_CALLS = frozenset("if for while switch match return catch elif with not and or in assert sizeof typeof fn def func function lambda await new yield except print unless until when do else using lock foreach super this async import require".split())
_CALL = re.compile(r"([A-Za-z_]\w*[?!]?)\s*(?:::<[^<>]*>)?\(")
_compiled = {kind: {lang: re.compile(p) for lang, p in table.items()} for kind, table in (("functions", FUNCTIONS), ("imports", IMPORTS))}
_types = re.compile(TYPES)


def blanked(source: str, language: str) -> tuple[str, str]:
    """(text without comments and strings, text without comments), of the same length and lines; one walk, one state at a time.

    A quote that is not closed on its line opens no string where strings end
    with the line; a Rust lifetime such as ``'a`` is no quote.
    """
    code, kept, at, n = [], [], 0, len(source)
    starts = re.compile("|".join(re.escape(a) for a, _, _ in QUOTES[language]) + (r"|b?r(?P<hashes>#*)\"" if language == "rust" else ""))
    ends = {a: (b, escapes) for a, b, escapes in QUOTES[language]}
    blank = lambda t: re.sub(r"[^\n]", " ", t)
    while at < n:
        m = starts.search(source, at)
        if not m:
            break
        opening = m[0]
        if language == "rust" and opening not in ends:
            end, escapes = '"' + m["hashes"], False
        else:
            end, escapes = ends[opening]
        stop = m.end()
        while stop < n and not source.startswith(end, stop):
            if escapes and source[stop] == "\\":
                stop += 1
            elif len(end) == 1 and end in "\"'" and source[stop] == "\n" and not (language in ("rust", "ruby") or opening == '@"'):
                stop = -1  # no string after all
                break
            stop += 1
        code.append(source[at : m.start()])
        kept.append(source[at : m.start()])
        if stop < 0:
            code.append(opening)
            kept.append(opening)
            at = m.end()
            continue
        after = min(n, stop + (0 if end == "\n" else len(end)))
        inside = source[m.start() : after]
        code.append(blank(inside))
        kept.append(blank(inside) if opening in ("//", "/*", "#") else inside)
        at = after
    return "".join(code) + source[at:], "".join(kept) + source[at:]


def _body_end(code: str, at: int, language: str) -> int:
    """Where the body of the function defined at ``at`` ends."""
    if language in ("python", "ruby"):  # by indentation
        line = code.rfind("\n", 0, at) + 1
        depth = len(code[line:at]) - len(code[line:at].lstrip()) if code[line:at].strip() else at - line
        colon = re.compile(r":[ \t]*(?=\n)|:[ \t]*\S") if language == "python" else re.compile(r"\n|\Z")
        m = colon.search(code, _close(code, code.find("(", at)) if language == "python" and "(" in code[at : code.find("\n", at) % (len(code) + 1)] else at)
        first = code.find("\n", m.start() if m else at) + 1 or len(code)
        for line in re.finditer(r"(?m)^([ \t]*)\S", code[first:]):
            if len(line[1]) <= depth:
                stop = first + line.start()
                return code.find("\n", stop) % (len(code) + 1) if language == "ruby" and code.startswith("end", stop + len(line[1])) else stop
        return len(code)
    depth = 0
    for m in re.compile(r"[(\[{}\])]|;|=>").finditer(code, at):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif depth <= 0 and m[0] == "{":
            return _close(code, m.start())
        elif depth <= 0 and m[0] in (";", "}"):
            return m.start()  # a declaration, or an expression without braces
    return len(code)


def _close(code: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(code, max(at, 0)):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def scan_file(source: str, language: str) -> tuple[list[tuple[int, str, str]], list[tuple[int, str | None, str]], list[tuple[int, str]]]:
    """Definitions (line, name, kind), calls (line, caller, callee) and imports (line, module) of one file."""
    code, kept = blanked(source, language)
    lines = [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda at: bisect_right(lines, at)
    functions = []
    for m in _compiled["functions"][language].finditer(code):
        name = next(g for g in m.groups() if g)
        if name not in NOT_CALLS:
            start = m.start(m.lastindex)
            functions.append((start, _body_end(code, start, language), name))
    types = [(m.start(1), m[1]) for m in _types.finditer(code)]
    symbols = sorted({(line(a), n, "function") for a, _, n in functions} | {(line(a), n, "type") for a, n in types})
    defined = {a for a, _, _ in functions}
    found, open_ = set(), []
    todo = sorted(functions)
    for m in _CALL.finditer(code):
        at = m.start(1)
        while todo and todo[0][0] <= at:
            open_.append(todo.pop(0))
        open_ = [f for f in open_ if f[1] > at]
        if at not in defined and m[1] not in NOT_CALLS:
            found.add((line(at), open_[-1][2] if open_ else None, m[1]))
    imports = set()
    for m in _compiled["imports"][language].finditer(kept):
        text = next(g for g in m.groups() if g)
        parts = re.split(r"\s*,\s*", text) if language == "python" and m[2] else [text]
        if language != "go" or m[1] or re.search(r"(?m)^import\s*\([^)]*\Z", kept[: m.start()]):
            imports |= {(line(m.start()) + m[0][: len(m[0]) - len(m[0].lstrip("\n"))].count("\n"), re.sub(r"\s+as\s+.*|\s+", "", p)) for p in parts}
    return symbols, sorted(found, key=lambda c: (c[0], c[1] or "", c[2])), sorted(imports)


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for suffix, name in LANGUAGES.items():
        out = F.when(extension == suffix, name).otherwise(out)
    return out


def scan(files: DataFrame) -> DataFrame:
    """``(path, language, what, line, name, detail)``: definitions (detail: kind), calls (name: callee, detail: caller) and imports.

    Vendored folders, other files, null sources and files over 512 KB are skipped.
    """
    kept = files.select("path", "source", language_of(F.col("path")).alias("language")).where(
        F.col("language").isNotNull() & F.col("source").isNotNull() & ~F.col("path").rlike(VENDORED) & (F.octet_length("source") <= MAX_BYTES))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, source, language in pdf.itertuples(index=False, name=None):
                symbols, calls_, imports_ = scan_file(source, language)
                rows += [(path, language, "symbol", a, n, k) for a, n, k in symbols] + [(path, language, "call", a, n, c) for a, c, n in calls_] + [(path, language, "import", a, n, None) for a, n in imports_]
            yield pd.DataFrame(rows, columns=["path", "language", "what", "line", "name", "detail"])

    return kept.mapInPandas(run, "path string, language string, what string, line int, name string, detail string")


def symbols(files: DataFrame) -> DataFrame:
    """``(path, language, line, name, kind)`` of each definition."""
    return scan(files).where("what = 'symbol'").select("path", "language", "line", "name", F.col("detail").alias("kind"))


def calls(files: DataFrame) -> DataFrame:
    """``(path, line, caller, callee)``; the caller is the innermost function around the call, null outside."""
    return scan(files).where("what = 'call'").select("path", "line", F.col("detail").alias("caller"), F.col("name").alias("callee"))


def imports(files: DataFrame) -> DataFrame:
    """``(path, language, line, module)`` of each import."""
    return scan(files).where("what = 'import'").select("path", "language", "line", F.col("name").alias("module"))


def resolved_calls(found: DataFrame, defined: DataFrame) -> DataFrame:
    """Calls whose callee some scanned file defines."""
    return found.join(defined.select(F.col("name").alias("callee")), "callee", "left_semi")


def notes_to_code(notes: DataFrame, defined: DataFrame) -> DataFrame:
    """Distinct ``(id, name, path)`` for the identifiers of four characters or more in back quotes in (id, content)."""
    named = notes.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"`([A-Za-z_][A-Za-z0-9_]{3,})`"), F.lit(1)))).alias("name"))
    return named.join(defined.select("name", "path").distinct(), "name").select("id", "name", "path")


def in_file(defined: DataFrame, path: str) -> DataFrame:
    """Definitions of a file, by line; the path is whole or its last parts."""
    return defined.where((F.col("path") == path) | F.col("path").endswith("/" + path)).orderBy("path", "line")


def where_defined(defined: DataFrame, name: str) -> DataFrame:
    """G6."""
    return defined.where(F.col("name") == name).orderBy("path", "line")


def who_calls(found: DataFrame, name: str) -> DataFrame:
    """G6."""
    return found.where(F.col("callee") == name).orderBy("path", "line")
