"""Structural units of one source file: Python through its own parser, languages with braces through a scanner.

A file is small and its units are found inside one task. The scanner blanks strings and comments, pairs
braces, and looks for declarations in what is left. It does not build a syntax tree: code that a
preprocessor or a template engine assembles may be cut differently than a compiler would cut it.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

#: The grammar of each extension.
GRAMMARS = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".js": "javascript", ".jsx": "javascript", ".py": "python", ".ts": "typescript", ".tsx": "tsx",
}


@dataclass(frozen=True)
class Unit:
    start: int
    end: int
    kind: str
    symbol: str | None
    parent: str | None


def python_units(source: bytes) -> tuple[list[Unit], bool]:
    """(units, whether the file has syntax errors): functions in no other function, and classes without such a function of their own.

    A file with an error has no units. One walk down the tree carries the class around a node and whether a function is.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], True
    begins = [0] + [m.end() for m in re.finditer(rb"\r\n|\r|\n", source)]
    units: list[Unit] = []
    classes: list[tuple[ast.ClassDef, ast.ClassDef | None]] = []
    with_functions: set[ast.AST] = set()

    def unit(node, kind: str, owner: ast.ClassDef | None) -> Unit:
        return Unit(begins[node.lineno - 1] + node.col_offset, begins[node.end_lineno - 1] + node.end_col_offset, kind, node.name, owner.name if owner else None)

    todo: list[tuple[ast.AST, ast.ClassDef | None, bool]] = [(tree, None, False)]
    while todo:
        above, owner, in_function = todo.pop()
        for node in ast.iter_child_nodes(above):
            if isinstance(node, ast.ClassDef):
                classes.append((node, owner))
                todo.append((node, node, in_function))
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and not in_function:
                kind = "function" if owner is None else "constructor" if node.name == "__init__" else "method"
                units.append(unit(node, kind, owner))
                with_functions.add(owner)
                todo.append((node, owner, True))
            else:
                todo.append((node, owner, in_function))
    return units + [unit(node, "class", owner) for node, owner in classes if node not in with_functions], False


_HIDDEN = re.compile(rb"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
_NAME = rb"[A-Za-z_$][\w$]*"
_CONTROL = {b"if", b"for", b"while", b"switch", b"catch", b"return", b"function", b"with", b"else", b"do", b"sizeof"}


def _blanked(source: bytes) -> bytes:
    """The source with strings and comments as blanks of the same length, line ends kept."""
    return _HIDDEN.sub(lambda m: re.sub(rb"[^\r\n]", b" ", m[0]), source)


class Braces:
    """The braces of blanked code as a tree: what a declaration lies in is read off the braces around its place."""

    def __init__(self, code: bytes):
        self.end: dict[int, int] = {}  # opening brace -> place after its partner
        self.outer: dict[int, int | None] = {}
        self.opening: list[int] = []
        self.errors = False
        open_: list[int] = []
        for m in re.finditer(rb"[{}]", code):
            if m[0] == b"{":
                self.outer[m.start()] = open_[-1] if open_ else None
                self.opening.append(m.start())
                open_.append(m.start())
            elif open_:
                self.end[open_.pop()] = m.end()
            else:
                self.errors = True
        self.errors |= bool(open_)

    def around(self, place: int) -> Iterator[int]:
        """The opening braces of the blocks around a place, from the inside out; braces without a partner are none."""
        k = bisect_left(self.opening, place)
        at = self.opening[k - 1] if k else None
        while at is not None:
            if self.end.get(at, 0) > place:
                yield at
            at = self.outer[at]


def _text(x: bytes | None) -> str | None:
    return x.decode() if x is not None else None


def _blocks(code: bytes, pattern: bytes, braces: Braces, skip=()) -> dict[int, tuple[int, str]]:
    """Opening brace -> (start, name) of the declarations whose match ends with a brace that has a partner."""
    return {m.end() - 1: (m.start("node"), _text(m["name"])) for m in re.finditer(pattern, code, re.DOTALL) if m.end() - 1 in braces.end and m["name"] not in skip}


def _block_units(blocks: dict[int, tuple[int, str]], braces: Braces, kind: str) -> list[Unit]:
    return [Unit(start, braces.end[b], kind, name, None) for b, (start, name) in blocks.items()]


def script_units(source: bytes, typed: bool) -> tuple[list[Unit], bool]:
    code = _blanked(source)
    braces = Braces(code)
    classes = _blocks(code, rb"(?<![\w$.])(?P<node>" + (rb"(?:abstract\s+)?" if typed else b"") + rb"class\s+(?P<name>" + _NAME + rb")[^{};()]*)\{", braces)
    arguments = rb"\((?:[^()]|\([^()]*\))*\)\s*(?::\s*[^{};=]+)?\{"
    modifiers = rb"(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?\s*"
    found = _blocks(code, rb"(?<=[{};\s])(?P<node>" + modifiers + rb"(?P<name>#?" + _NAME + rb")\s*(?:<[^{}()]*>)?\s*)" + arguments, braces, _CONTROL)
    owners = {b: next(braces.around(b), None) for b in found}
    methods = {b: found[b] for b, owner in owners.items() if owner in classes}  # the class's own brace and no other is around
    units = [Unit(start, braces.end[b], "constructor" if name == "constructor" else "method", name, classes[owners[b]][1]) for b, (start, name) in methods.items()]
    outside = lambda place: methods.keys().isdisjoint(braces.around(place))
    functions = _blocks(code, rb"(?<![\w$.])(?P<node>(?:async\s+)?function\s*\*?\s*(?P<name>" + _NAME + rb")\s*(?:<[^{}()]*>)?\s*)" + arguments, braces)
    units += _block_units({b: x for b, x in functions.items() if outside(x[0])}, braces, "function")
    value = rb"(?<=\s)(?P<name>" + _NAME + rb")\s*(?::[^=;{}]+)?=\s*(?:async\s+)?(?:function\b[^{;]*|(?:<[^>]+>\s*)?(?:\((?:[^()]|\([^()]*\))*\)|" + _NAME + rb")\s*(?::[^={;]+)?=>\s*)"
    for m in re.finditer(rb"\b(?:const|let|var)(?=\s)", code):
        if v := re.compile(rb"\s*" + value.removeprefix(rb"(?<=\s)"), re.DOTALL).match(code, m.end()):
            end = braces.end.get(v.end())
            if end is None:
                stop = re.compile(rb"[;\n]").search(code, v.end())
                end = stop.start() if stop else len(code)
            if outside(v.start("name")):
                units.append(Unit(v.start("name"), end, "function", _text(v["name"]), None))
    if typed:
        for kind, word in (("interface", rb"interface"), ("enum", rb"(?:const\s+)?enum")):
            units += _block_units(_blocks(code, rb"(?<![\w$.])(?P<node>" + word + rb"\s+(?P<name>" + _NAME + rb")[^{};()]*)\{", braces), braces, kind)
        for m in re.finditer(rb"(?<![\w$.])type\s+(?P<name>" + _NAME + rb")[^=;{}()]*=", code):
            at, depth = m.end(), 0
            while at < len(code) and (depth or code[at : at + 1] != b";"):
                depth += (code[at : at + 1] in (b"{", b"(", b"[")) - (code[at : at + 1] in (b"}", b")", b"]"))
                at += 1
            units.append(Unit(m.start(), min(at + 1, len(code)), "type", _text(m["name"]), None))
    with_methods = {owners[b] for b in methods}
    return units + _block_units({b: x for b, x in classes.items() if b not in with_methods}, braces, "class"), braces.errors


def c_units(source: bytes, plus: bool) -> tuple[list[Unit], bool]:
    code = re.sub(rb"(?m)^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", lambda m: re.sub(rb"[^\r\n]", b" ", m[0]), _blanked(source))
    braces = Braces(code)
    classes = _blocks(code, rb"\b(?P<node>(?:class|struct)\s+(?P<name>[A-Za-z_]\w*)[^{};()=]*)\{", braces) if plus else {}
    classes = {b: x for b, x in classes.items() if not re.search(rb"\benum\s+$", code[: x[0]])}
    functions: dict[int, tuple[int, str]] = {}
    for brace in braces.opening:
        if brace not in braces.end:
            continue
        begin = max(code.rfind(c, 0, brace) for c in (b";", b"{", b"}")) + 1
        head = code[begin:brace]
        head = re.sub(rb"^(?:\s*(?:public|private|protected)\s*:)+", lambda x: b" " * len(x[0]), head)
        names = re.findall(rb"(~?[A-Za-z_]\w*)\s*\(", head)
        if names and b")" in head and names[-1] not in _CONTROL and b"=" not in head.split(b"(")[0]:
            functions[brace] = begin + len(head) - len(head.lstrip()), _text(names[-1])
    units, with_methods = [], set()
    for brace, (start, name) in functions.items():
        around = list(braces.around(brace))
        if not functions.keys().isdisjoint(around):
            continue
        owner = next((b for b in around if b in classes), None)
        with_methods.add(owner)
        own = classes[owner][1] if owner is not None else None
        kind = "function" if owner is None else "constructor" if name == own else "method"
        units.append(Unit(start, braces.end[brace], kind, name, own))
    units += _block_units({b: x for b, x in classes.items() if b not in with_methods}, braces, "class")
    units += _block_units(_blocks(code, rb"\b(?P<node>enum(?:\s+(?:class|struct))?\s+(?P<name>[A-Za-z_]\w*)[^{};()]*)\{", braces), braces, "enum")
    return units, braces.errors


def units_of(grammar: str, source: bytes) -> tuple[list[Unit], bool]:
    """(units by place, whether the source has errors)."""
    if grammar == "python":
        units, errors = python_units(source)
    elif grammar in ("c", "cpp"):
        units, errors = c_units(source, grammar == "cpp")
    else:
        units, errors = script_units(source, grammar != "javascript")
    return sorted(units, key=lambda u: (u.start, u.end, u.kind)), errors


_LINES = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def line_parts(text: bytes, first_line: int, most: int, overlap: int) -> list[tuple[int, int, int | None, int, str]]:
    """(start_line, end_line, part_index, part_count, content) of a text's windows."""
    own = _LINES.findall(text) or [b""]
    starts = [0]
    while starts[-1] + most < len(own):
        starts.append(starts[-1] + most - overlap)
    many = len(starts)
    return [(first_line + s, first_line + min(s + most, len(own)) - 1, k + 1 if many > 1 else None, many, b"".join(own[s : s + most]).decode()) for k, s in enumerate(starts)]


def chunk_source(grammar: str, source: bytes, most: int, overlap: int, most_unit: int) -> list[tuple]:
    """Chunks of a file: its units, and what lies between them in windows without overlap; or windows of all of it."""
    units, errors = units_of(grammar, source)
    if not units:
        status = "fallback_syntax_errors" if errors else "fallback_no_structures"
        return [("file", None, None, *p, status) for p in line_parts(source, 1, most, overlap)]
    line = lambda at: source.count(b"\n", 0, at) + 1
    status = "parsed_with_errors" if errors else "parsed"
    out = [(u.kind, u.symbol, u.parent, *p, status) for u in units for p in line_parts(source[u.start : u.end], line(u.start), most_unit, 0)]
    reached = accumulate((u.end for u in units), max, initial=0)  # what lies before each unit is free from where all units so far end
    between = [(a, b) for a, b in zip(reached, [*(u.start for u in units), len(source)]) if source[a:b].strip()]
    return out + [("file", None, None, *p, "file_context") for a, b in between for p in line_parts(source[a:b], line(a), most, 0)]
