"""Symbols and unresolved edges from source files.

Python files are parsed with the standard library.  The other languages are read by a small scanner: comments and strings
are blanked out, braces matched, and declarations found by the patterns of each language.  It is an approximation of a
full parser; errors are counted as unbalanced braces or as a failed parse.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lodestrand.functions import constants as K
from lodestrand.functions.hashing import symbol_id
from lodestrand.operators.scratch import Scratch
from lodestrand.sources.scan import language_of, read_source

SYMBOL, PENDING, FILE = 0, 1, 2
ROWS = "part int, file string, name string, other string, line int, col int, end_line int, kind int, signature string, scope string, lang int, is_definition boolean, place int, mtime bigint, size bigint, errors int"


@dataclass
class Found:
    """What a file holds, in order: symbols, unresolved edges (caller or None, callee, line, kind), errors."""

    symbols: list[dict] = field(default_factory=list)
    pending: list[tuple[str | None, str, int, int]] = field(default_factory=list)
    errors: int = 0

    def symbol(self, name: str, kind: int, line: int, col: int, end_line: int, signature: str = "", scope: str = "", definition: bool = False) -> None:
        text = re.sub(r"[\n\t]", " ", signature)[:511]
        self.symbols.append({"name": name[:255], "kind": kind, "line": line, "col": col, "end_line": end_line, "signature": text, "scope": scope[:255], "is_definition": definition})

    def edge(self, caller: str | None, callee: str, line: int, kind: int) -> None:
        if callee and callee != caller:
            self.pending.append((caller, callee, line, kind))


def is_noise(name: str) -> bool:
    return len(name) < 5 or name in K.NOISE_WORDS


# Python ---------------------------------------------------------------------------------------------------------------


class _PythonVisitor(ast.NodeVisitor):
    def __init__(self, lines: list[str]):
        self.found, self.lines = Found(), lines
        self.scope: list[str] = []
        self.function: list[str] = []

    def _signature(self, node: ast.AST) -> str:
        return self.lines[node.lineno - 1].strip() if node.lineno <= len(self.lines) else ""

    def _declared(self, node, kind: int) -> None:
        self.found.symbol(node.name, kind, node.lineno, node.col_offset + 1, node.end_lineno, self._signature(node), self.scope[-1] if self.scope else "", True)

    def visit_FunctionDef(self, node) -> None:
        self._declared(node, K.METHOD if self.scope and not self.function else K.FUNCTION)
        for d in node.decorator_list:
            self.visit(d)
        self.function.append(node.name)
        for child in [node.args, *node.body]:
            self.visit(child)
        self.function.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._declared(node, K.CLASS)
        for base in node.bases:
            if name := _last_name(base):
                self.found.edge(node.name, name, node.lineno, K.INHERITS)
        self.scope.append(node.name)
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.found.symbol(a.name, K.INCLUDE, node.lineno, node.col_offset + 1, node.end_lineno, self._signature(node))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.found.symbol(node.module or ".", K.INCLUDE, node.lineno, node.col_offset + 1, node.end_lineno, self._signature(node))

    def visit_Call(self, node: ast.Call) -> None:
        if name := _last_name(node.func):
            self.found.edge(self.function[-1] if self.function else None, name, node.lineno, K.CALLS)
        if isinstance(node.func, ast.Attribute):
            self.visit(node.func.value)
        for child in [*node.args, *[k.value for k in node.keywords]]:
            self.visit(child)

    def visit_Assign(self, node: ast.Assign) -> None:
        if not self.function and not self.scope:
            for t in node.targets:
                if isinstance(t, ast.Name) and not is_noise(t.id):
                    self.found.symbol(t.id, K.VARIABLE, node.lineno, node.col_offset + 1, node.end_lineno, self._signature(node))
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if self.function and isinstance(node.ctx, ast.Load) and not is_noise(node.id):
            self.found.edge(self.function[-1], node.id, node.lineno, K.REFERENCES)


def _last_name(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def extract_python(text: str) -> Found:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Found(errors=1)
    visitor = _PythonVisitor(text.split("\n"))
    try:
        visitor.visit(tree)
    except RecursionError:
        visitor.found.errors += 1
    return visitor.found


# Languages with braces ------------------------------------------------------------------------------------------------

BLANKED = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
INCLUDE_LINE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", re.M)
MACRO_LINE = re.compile(r"^[ \t]*#[ \t]*define[ \t]+(\w+)[^\n]*", re.M)
CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
WORD = re.compile(r"\b[A-Za-z_]\w*\b")
CONTROL = frozenset("if for while switch return sizeof catch else do case defer go select match loop fn func function new throw typeof await alignof decltype".split())

_FUNCTION = (re.compile(r"(?:^|(?<=[;{}\n]))[ \t]*((?:[A-Za-z_][\w:<>,*&\[\] \t]*[\s*&])?(?:(\w+)::)?(~?[A-Za-z_]\w*)[ \t]*\([^;{}]*\)[^;{}()=]*)\{"), K.FUNCTION)
_TYPES = [
    (re.compile(r"\b(struct[ \t]+(\w+))[^;{}()=]*\{"), K.STRUCT),
    (re.compile(r"\b(enum(?:[ \t]+class)?[ \t]+(\w+))[^;{}()=]*\{"), K.ENUM),
    (re.compile(r"(?<!enum )\b(class[ \t]+(\w+)[^;{}()=]*)\{"), K.CLASS),
    (re.compile(r"\b(namespace[ \t]+(\w+))[^;{}()=]*\{"), K.NAMESPACE),
]
_TYPEDEF = (re.compile(r"\btypedef\b[^;{}]*?\b(\w+)[ \t]*;"), K.TYPEDEF)
_SCRIPT = [
    (re.compile(r"\b(function\*?[ \t]+(\w+)[ \t]*\([^{}]*\)[^;{}]*)\{"), K.FUNCTION),
    (re.compile(r"\b(class[ \t]+(\w+)[^;{}()]*)\{"), K.CLASS),
    (re.compile(r"\b((?:const|let|var)[ \t]+(\w+)[ \t]*=[ \t]*(?:async[ \t]*)?(?:function[ \t]*)?\([^{}()]*\)[^;{}()]*)\{"), K.FUNCTION),
    (re.compile(r"(?<=[;{}\n])[ \t]*((?:static[ \t]+|async[ \t]+|get[ \t]+|set[ \t]+)*(?!(?:if|for|while|switch|catch|function)\b)(\w+)[ \t]*\([^;{}()]*\)[^;{}()=]*)\{"), K.METHOD),
    (re.compile(r"\b(interface[ \t]+(\w+)[^;{}()]*)\{"), K.CLASS),
    (re.compile(r"\b(enum[ \t]+(\w+)[^;{}()]*)\{"), K.ENUM),
]
_GO = [
    (re.compile(r"^(func[ \t]+(\w+)[ \t]*\([^{}]*)\{", re.M), K.FUNCTION),
    (re.compile(r"^(func[ \t]*\([^)]*\)[ \t]*(\w+)[ \t]*\([^{}]*)\{", re.M), K.METHOD),
    (re.compile(r"^(type[ \t]+(\w+)[ \t]+struct[ \t]*)\{", re.M), K.STRUCT),
    (re.compile(r"^(type[ \t]+(\w+)[ \t]+interface[ \t]*)\{", re.M), K.CLASS),
]
_RUST = [
    (re.compile(r"\b(fn[ \t]+(\w+)[^;{}]*)\{"), K.FUNCTION),
    (re.compile(r"\b(struct[ \t]+(\w+)[^;{}()]*)\{"), K.STRUCT),
    (re.compile(r"\b(enum[ \t]+(\w+)[^;{}()]*)\{"), K.ENUM),
    (re.compile(r"\b(trait[ \t]+(\w+)[^;{}]*)\{"), K.CLASS),
    (re.compile(r"\b(impl(?:<[^>]*>)?[ \t]+(?:[\w:<>]+[ \t]+for[ \t]+)?(\w+)[^;{}]*)\{"), K.NAMESPACE),
]
_IMPORTS = {3: re.compile(r"^[ \t]*import[^\n]*", re.M), 4: re.compile(r"^[ \t]*import[^\n]*", re.M), 5: re.compile(r"^[ \t]*import[^\n]*", re.M), 6: re.compile(r"^[ \t]*use[ \t]+[^;]+;", re.M)}
_VARIABLES = {3: re.compile(r"^(?:export[ \t]+)?(?:const|let|var)[ \t]+(\w+)[ \t]*=(?![^\n]*(?:=>|function))", re.M), 5: re.compile(r"^(?:const|var)[ \t]+(\w+)", re.M)}
_VARIABLES[4] = _VARIABLES[3]
_VARIABLES[6] = re.compile(r"^(?:pub(?:\([^)]*\))?[ \t]+)?(?:static(?:[ \t]+mut)?|const)[ \t]+(\w+)[ \t]*:", re.M)
#: A declaration of C or C++ outside all braces and parentheses, which ``outermost`` has left empty.
_VARIABLES[0] = _VARIABLES[1] = re.compile(r"(?:^|(?<=[;}]))\s*(?!(?:typedef|using|return|struct|class|enum|union|namespace|template|friend)\b[^;=]*;)(?:[A-Za-z_][\w:<>,]*[\s*&]+)+(\w+)[ \t]*(?:\[[^\]]*\][ \t]*)*(?:=[^;]*)?;")
BASES = re.compile(r"(?:\bextends\b|\bimplements\b|(?<!:):(?!:))([^{]*)")


def blanked(text: str) -> str:
    """Comments and strings as spaces; lines stay lines."""
    return BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def brace_ends(code: str) -> tuple[dict[int, int], int]:
    """Where each opening brace is closed, and how many braces have no partner."""
    ends, stack, odd = {}, [], 0
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.start()
        else:
            odd += 1
    return ends, odd + len(stack)


def outermost(code: str) -> str:
    """``code`` with everything inside braces or parentheses, and lines of the preprocessor, as spaces."""
    code = re.sub(r"^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), code, flags=re.M)
    out, depth, at = [], 0, 0
    for m in [*re.finditer(r"[{}()]", code), None]:
        part = code[at : m.start()] if m else code[at:]
        out.append(re.sub(r"[^\n]", " ", part) if depth else part)
        if m:
            depth -= m[0] in "})" and depth > 0
            out.append(" " if depth else m[0])
            depth += m[0] in "{("
            at = m.end()
    return "".join(out)


def extract_braced(text: str, lang: int) -> Found:
    code = blanked(text)
    found, starts = Found(), [0, *[m.end() for m in re.finditer("\n", code)]]
    ends, found.errors = brace_ends(code)

    def at(offset: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(starts, offset)
        return line, offset - starts[line - 1] + 1

    declared: list[tuple[int, int, int, str, int, str, str]] = []  # start, body, end, name, kind, signature, own scope
    rules = {0: [*_TYPES[:2], _FUNCTION], 1: [*_TYPES, _FUNCTION], 3: _SCRIPT, 4: _SCRIPT, 5: _GO, 6: _RUST}[lang]
    taken: set[int] = set()
    for pattern, kind in rules:
        for m in pattern.finditer(code):
            body = m.end() - 1
            name, own = (m[3], m[2] or "") if pattern is _FUNCTION[0] else (m[2], "")
            if body in taken or name in CONTROL:
                continue
            taken.add(body)
            start = m.start(1) + len(m[1]) - len(m[1].lstrip())
            declared.append((start, body, ends.get(body, len(code) - 1), name, kind, text[start:body].strip(), own))
    declared.sort()
    types = [d for d in declared if d[4] in (K.CLASS, K.STRUCT, K.NAMESPACE)]
    functions = [d for d in declared if d[4] in (K.FUNCTION, K.METHOD)]

    def inside(where: list, offset: int):
        held = [d for d in where if d[1] < offset <= d[2]]
        return held[-1] if held else None

    for start, _, end, name, kind, signature, own in declared:
        line, col = at(start)
        outer = inside(types, start)
        scope = own or (outer[3] if outer else "")
        if kind == K.FUNCTION and scope and not (outer and outer[4] == K.NAMESPACE and lang == 1):
            kind = K.METHOD
        found.symbol(name, kind, line, col, at(end)[0], signature + (" " if kind in (K.FUNCTION, K.METHOD) else ""), scope, kind != K.NAMESPACE)
        if kind in (K.CLASS, K.STRUCT) and (m := BASES.search(code[start : code.find("{", start)])):
            for base in WORD.findall(m[1]):
                if base not in ("public", "private", "protected", "virtual", "extends", "implements") and not is_noise(base):
                    found.edge(name, base, line, K.INHERITS)
    if lang in (0, 1):
        for m in INCLUDE_LINE.finditer(text):
            found.symbol(m[1], K.INCLUDE, *at(m.start(1)), at(m.start())[0], m[0].strip())
        for m in MACRO_LINE.finditer(code):
            found.symbol(m[1], K.MACRO, *at(m.start(1)), at(m.end())[0], m[0].strip())
        for m in _TYPEDEF[0].finditer(code):
            found.symbol(m[1], K.TYPEDEF, *at(m.start()), at(m.end())[0], m[0])
    for m in _IMPORTS[lang].finditer(text) if lang in _IMPORTS else ():
        found.symbol(m[0].strip()[:255], K.INCLUDE, *at(m.start()), at(m.end())[0], m[0].strip())
    for m in _VARIABLES[lang].finditer(outermost(code) if lang in (0, 1) else code) if lang in _VARIABLES else ():
        if not is_noise(m[1]):
            found.symbol(m[1], K.VARIABLE, *at(m.start(1)), at(m.end())[0], m[0])
    bodies = [d for d in functions if not inside([x for x in functions if x is not d], d[0])]
    names = {d[0] + code[d[0] : d[1]].rfind(d[3]) for d in functions}
    for _, body, end, name, *_ in bodies:
        seen: set[str] = set()
        for m in WORD.finditer(code, body, end):
            word = m[0]
            if word in CONTROL or m.start() in names:
                continue
            line = at(m.start())[0]
            if CALL.match(code, m.start()):
                found.edge(name, word, line, K.CALLS)
            elif not is_noise(word) and word not in seen:
                seen.add(word)
                found.edge(name, word, line, K.REFERENCES)
    return found


def extract_text(text: str, path: str) -> tuple[Found, int]:
    """What a file holds, and its language: a .h file is C++ if that reads with fewer errors or has its keywords."""
    lang = language_of(path)
    if lang == 2:
        return extract_python(text), lang
    if path.endswith(".h") and re.search(r"^\s*(?:class|namespace|template)\b", blanked(text), re.M):
        lang = 1
    return extract_braced(text, lang), lang


def extract_files(paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, unresolved edges and file rows of ``paths`` (path), read and parsed on the executors.

    Files that are gone, empty, binary or too large give no rows.  Paths must be readable where tasks run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        names = [c.split()[0] for c in ROWS.split(", ")]
        for b in batches:
            for path in b.column("path").to_pylist():
                data = read_source(path)
                if data is None or language_of(path) == K.UNKNOWN_LANG:
                    continue
                found, lang = extract_text(data.decode("utf-8", "replace"), path)
                rows = [dict(part=SYMBOL, file=path, lang=lang, place=i, **s) for i, s in enumerate(found.symbols)]
                rows += [dict(part=PENDING, file=path, name=caller, other=callee, line=line, kind=kind, place=i) for i, (caller, callee, line, kind) in enumerate(found.pending)]
                rows.append(dict(part=FILE, file=path, lang=lang, mtime=int(os.path.getmtime(path)), size=len(data), errors=found.errors))
                types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
                kinds = [types[c.split()[1]] for c in ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    c = F.col
    dealt = paths.select("path").repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism), "path")
    # written once: a file that changes meanwhile must not give tables that disagree, and none is parsed twice
    rows = Scratch(paths.sparkSession, "extract").write(dealt.mapInArrow(run, ROWS), "rows")
    # the order of files, then of rows inside them
    seq = F.abs(F.xxhash64("file") % (1 << 40)) * (1 << 20) + F.col("place")
    symbols = rows.where(c("part") == SYMBOL).select(symbol_id(c("file"), c("name"), c("line")).alias("id"), "name", "file", "line", "col", "end_line", "kind", "signature", "scope", "lang", "is_definition", seq.alias("seq"))
    # two symbols of one name on one line are one, the later
    columns = [x for x in symbols.columns if x not in ("id", "seq")]
    symbols = symbols.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("s"), F.min("seq").alias("seq")).select("id", "s.*", "seq")
    pending = rows.where(c("part") == PENDING).select(c("file").alias("caller_file"), c("name").alias("caller_name"), c("other").alias("callee_name"), c("line").alias("caller_line"), "kind", seq.alias("seq"))
    files = rows.where(c("part") == FILE).select(c("file").alias("path"), "mtime", "size", F.lit("").alias("hash"), "lang", c("errors").cast(IntegerType()).alias("error_count"))
    return symbols, pending, files
