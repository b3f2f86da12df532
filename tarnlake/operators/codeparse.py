"""Structure of Python, JavaScript and TypeScript sources as (display, text, first line, last line) parts.

Python goes through the standard `ast`. For the others there is no parser at hand, so strings and comments are blanked
out and declarations are found at the depth of brackets where they can stand.
"""

from __future__ import annotations

import ast
import re

Part = tuple[str, str, int, int]

#: Lines and characters of a comment that still belong to the symbol below it.
COMMENT_LINES, COMMENT_CHARS = 10, 500

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Lines:
    """A source by 1-based lines."""

    def __init__(self, source: str):
        self.all = source.splitlines(keepends=True)

    def __len__(self) -> int:
        return len(self.all)

    def text(self, first: int, last: int) -> str:
        n = len(self.all)
        first = min(max(first, 1), n)
        return "".join(self.all[first - 1 : max(first, min(last, n))]).strip() if n else ""

    def line(self, k: int) -> str:
        return self.all[k - 1].strip() if 1 <= k <= len(self.all) else ""


def _gaps(symbols: list[tuple[int, int, list[Part]]], lines: _Lines) -> list[Part]:
    """Symbols (first line, last line, their parts) with what stands before, between and behind them as module parts."""
    out: list[Part] = []
    at = 1
    for k, (first, last, parts) in enumerate([*symbols, (len(lines) + 1, len(lines), [])]):
        body = lines.text(at, first - 1) if at < first else ""
        if body:
            out.append(("module globals" if k else "module", body, at, first - 1))
        out += parts
        at = last + 1
    return out


class _Comments:
    """Runs of whole-line comments: for a line, where the run that ends right above it begins.

    A line that names an interpreter or an encoding ends a run, and is no part of it.
    """

    _HEAD = re.compile(r"#!|# (?:-\*- )?coding", re.I)

    def __init__(self, lines: _Lines):
        self.above = [0] * (len(lines) + 2)  # comment lines directly above each line
        self.sizes = [0]  # characters of all lines up to each
        for k, line in enumerate(lines.all, 1):
            bare = line.strip()
            own = bare.startswith("#") and not self._HEAD.match(bare)
            self.above[k + 1] = self.above[k] + 1 if own else 0
            self.sizes.append(self.sizes[-1] + len(line.rstrip("\n")) + 1)

    def start(self, first: int) -> int:
        """`first`, or up to COMMENT_LINES lines before it; the one that reaches COMMENT_CHARS is the last taken."""
        at = first - min(self.above[first], COMMENT_LINES)
        while at + 1 < first and self.sizes[first - 1] - self.sizes[at] >= COMMENT_CHARS:
            at += 1
        return at


class _Symbol:
    """A definition with its decorators, and the comments above them if it is to have those."""

    def __init__(self, node: ast.AST, comments: _Comments | None = None):
        decorators = getattr(node, "decorator_list", ())
        begin = min((d.lineno for d in decorators), default=node.lineno)
        self.node, self.first, self.last = node, comments.start(min(begin, node.lineno)) if comments else min(begin, node.lineno), node.end_lineno

    def signature(self, lines: _Lines, without: str) -> str:
        return lines.line(self.node.lineno) or without

    def part(self, lines: _Lines, display: str) -> list[Part]:
        text = lines.text(self.first, self.last)
        return [(display, text, self.first, self.last)] if text else []


_DEF = re.compile(r"(?P<kind>async )?def (?P<rest>.*)", re.S)


def _qualified(owner: str, signature: str) -> str:
    """A method's signature with the class before its name, for instance `async C.go(self)`."""
    bare = signature.rstrip(":").strip()
    m = _DEF.match(bare)
    return f"{m['kind'] or ''}{owner}.{m['rest'].strip()}" if m else f"{owner}.{bare}"


def _class_parts(symbol: _Symbol, lines: _Lines, comments: _Comments) -> list[Part]:
    """The class (head, docstring, what isn't a method, names of the methods), then each method."""
    node, doc = symbol.node, ast.get_docstring(symbol.node)
    methods = [x for x in node.body if isinstance(x, _FUNCTIONS)]
    rest = [_Symbol(x) for x in node.body[bool(doc) :] if x not in methods]
    pieces = [lines.text(symbol.first, node.lineno), (doc or "").strip()]
    pieces += [lines.text(x.first, x.last) for x in rest]
    pieces += ["Methods: " + ", ".join(x.name for x in methods)] * bool(methods)
    text = "\n".join(x for x in pieces if x).strip()
    out: list[Part] = [(symbol.signature(lines, f"class {node.name}"), text, symbol.first, symbol.last)] * bool(text)
    for method in (_Symbol(x, comments) for x in methods):
        out += method.part(lines, _qualified(node.name, method.signature(lines, method.node.name)))
    return out


def python_chunks(source: str) -> list[Part]:
    """Functions, classes, methods, and module code between them; nothing for what isn't valid Python."""
    source = source.replace("\r\n", "\n")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = _Lines(source)
    comments = _Comments(lines)
    symbols = []
    for symbol in (_Symbol(x, comments) for x in tree.body if isinstance(x, (*_FUNCTIONS, ast.ClassDef))):
        if isinstance(symbol.node, ast.ClassDef):
            parts = _class_parts(symbol, lines, comments)
        else:
            parts = symbol.part(lines, symbol.signature(lines, f"def {symbol.node.name}"))
        symbols.append((symbol.first, symbol.last, parts))
    return _gaps(sorted(symbols, key=lambda s: s[0]), lines)


# --- JavaScript and TypeScript ---------------------------------------------------------------------------------------

_SKIPPED = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/""",
    re.S,
)
_NAME = r"[A-Za-z_$][\w$]*"
_TOP = re.compile(
    rf"(?P<export>export\s+(?:default\s+)?)?(?:(?P<function>(?:async\s+)?function\s*\*?\s*(?P<fname>{_NAME})?)|(?:abstract\s+)?(?P<class>class)\s+(?P<cname>{_NAME})|(?P<var>const|let|var)\s+(?P<vname>{_NAME}))"
)
_ARROW = re.compile(r"\s*(?::[^=;]*?)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)\s*(?::[^={;]*)?=>")
_METHOD = re.compile(rf"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(?P<name>#?{_NAME})\s*(?:<[^>]*>)?\s*\(")
_WORDS = frozenset({"if", "for", "while", "switch", "catch", "return", "function", "with", "do", "else", "new", "typeof", "await"})


def _blanked(source: str) -> str:
    """The source with strings, templates, regular expressions and comments made of spaces, line ends kept."""
    return _SKIPPED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _depths(code: str) -> list[int]:
    out, depth = [], 0
    for c in code:
        if c in "}])":
            depth = max(depth - 1, 0)
        out.append(depth)
        if c in "{[(":
            depth += 1
    return out


def _end(code: str, depths: list[int], at: int, level: int, braces: bool) -> int:
    """Where what begins at `at` ends: behind its closing brace, or at its semicolon or the end of a line outside all brackets."""
    opened = False
    for i in range(at, len(code)):
        c, d = code[i], depths[i]
        if d == level and c == "{":
            opened = True
        elif d == level and c == "}" and opened and braces:
            return i + 1
        elif d == level and c == ";" or d < level:
            return i + (c == ";")
        elif d == level and c == "\n" and opened and not braces:
            return i
    return len(code)


def _commented(lines: _Lines, first: int, last: int = 0) -> tuple[int, str]:
    """First line with the comment directly above it, and that comment, cut to its limits."""
    at = first - 1
    if lines.line(at).startswith("//"):
        while lines.line(at - 1).startswith("//"):
            at -= 1
    elif "*/" in lines.line(at):
        while at > 1 and "/*" not in lines.line(at):
            at -= 1
        if not lines.line(at).startswith("/*"):
            return first, ""
    else:
        return first, ""
    comment = "\n".join(x.rstrip("\n") for x in lines.all[at - 1 : first - 1][:COMMENT_LINES]).strip()
    return (at, comment[:COMMENT_CHARS].rstrip()) if comment else (first, "")


def _first_line(text: str) -> str:
    return next((x.strip() for x in text.splitlines() if x.strip()), text[:80])


def script_chunks(source: str) -> list[Part]:
    """Function declarations, arrow functions in variables, classes with their methods, and module code between them."""
    source = source.replace("\r\n", "\n")
    code = _blanked(source)
    depths, lines = _depths(code), _Lines(source)
    number = lambda i: source.count("\n", 0, i) + 1
    symbols: list[tuple[int, int, list[Part]]] = []
    at = 0
    while m := _TOP.search(code, at):
        at = m.start() + 1
        if depths[m.start()] or m.start() and (code[m.start() - 1].isalnum() or code[m.start() - 1] in "_$."):
            continue
        if m["var"] and not _ARROW.match(code, m.end()):
            continue
        end = _end(code, depths, m.end(), 0, not m["var"])
        text = source[m.start() : end].strip()
        first, last = number(m.start()), number(max(end - 1, m.start()))
        top, comment = _commented(lines, first)
        at = end
        if not m["class"]:
            symbols.append((top, last, [(_first_line(text), "\n".join(filter(None, [comment, text])), top, last)]))
            continue
        methods, inner = [], code.find("{", m.end())
        k = inner + 1
        while 0 < k < end and (n := _METHOD.search(code, k, end)):
            k = n.end()
            if depths[n.start("name")] != 1 or n["name"] in _WORDS:
                continue
            close = _end(code, depths, n.end() - 1, 1, True)
            if "{" not in code[n.end() : close]:
                continue
            begin = n.start() + len(n[0]) - len(n[0].lstrip())
            a, b = number(begin), number(close - 1)
            over, said = _commented(lines, a)
            methods.append((n["name"], "\n".join(filter(None, [said, source[begin:close]])), over, b))
            k = close
        names = ", ".join(x[0] for x in methods)
        body = "\n".join(filter(None, [comment, _first_line(text), names and f"Methods: {names}"]))
        shown = f"{'export ' if m['export'] else ''}class {m['cname']}"
        symbols.append((top, last, [(shown, body, top, last), *((f"{m['cname']}.{x[0]}", *x[1:]) for x in methods)]))
    return _gaps(symbols, lines)


def code_chunks(path: str, source: str) -> list[Part]:
    """Parts of a source by its suffix; none for other kinds."""
    if not source:
        return []
    return python_chunks(source) if path.lower().endswith(".py") else script_chunks(source)
