"""Python by its own ast module; a text that does not parse falls back to a scan of its lines."""

from __future__ import annotations

import ast
import re

from .noise import is_noise

_WRAPPERS = frozenset("ClassVar Dict Final List Optional Set Tuple Union dict list set tuple".split())


def type_name(node: ast.expr | None) -> str | None:
    """The class an annotation names, out of its wrapper or the left of a union; None unless it begins in upper case."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            node = ast.parse(node.value, mode="eval").body
        except SyntaxError:
            return None
    if isinstance(node, ast.Subscript):
        head = dotted(node.value)
        if head and head.split(".")[-1] in _WRAPPERS:
            inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) and node.slice.elts else node.slice
            return type_name(inner)
        node = node.value
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return type_name(node.left)
    name = dotted(node) if node is not None else None
    short = name.split(".")[-1] if name else ""
    return short if short[:1].isupper() and short not in _WRAPPERS else None


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    if isinstance(node, ast.Subscript):
        return dotted(node.value)
    return None


def extract(content: str) -> dict:
    """imports, calls, symbols, bases, injections, nodes, errors of one file."""
    out: dict = {"imports": [], "calls": [], "symbols": [], "bases": [], "injections": [], "nodes": [], "errors": []}
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError) as e:
        out["errors"].append(f"{type(e).__name__} at line {getattr(e, 'lineno', None) or 0}")
        return scan(content, out)
    lines = content.encode("utf-8", "surrogatepass").split(b"\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line) + 1)

    def visit(node: ast.AST, scope: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, ast.Import):
                out["imports"] += [(a.name, [], a.asname, False, child.lineno) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out["imports"].append(("." * child.level + (child.module or ""), [a.name for a in child.names], child.names[0].asname if len(child.names) == 1 else None, child.level > 0, child.lineno))
            elif isinstance(child, ast.Call):
                callee = child.func.attr if isinstance(child.func, ast.Attribute) else child.func.id if isinstance(child.func, ast.Name) else None
                if callee and not is_noise(callee, "python"):
                    out["calls"].append((callee, child.lineno))
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if scope else "function"
                decorators = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in child.decorator_list]
                out["symbols"].append((child.name, kind, scope, child.lineno, child.end_lineno, decorators))
                start = offsets[child.lineno - 1] + child.col_offset
                out["nodes"].append(("class" if is_class else "function", child.name, scope, start, offsets[child.end_lineno - 1] + child.end_col_offset, child.lineno, child.end_lineno))
                if is_class:
                    inner = child.name
                    found = [n for n in map(dotted, child.bases) if n]
                    out["bases"] += [(child.name, b.split(".")[-1], child.lineno) for b in found]
                    out["injections"] += [(child.name, t, s.target.id, s.lineno) for s in child.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and (t := type_name(s.annotation))]
                elif child.name == "__init__" and scope:
                    args = child.args.args
                    bare = args[: len(args) - len(child.args.defaults)]
                    out["injections"] += [(scope, t, a.arg, a.lineno) for a in bare if a.arg not in ("self", "cls") and (t := type_name(a.annotation))]
            visit(child, inner)

    visit(tree, None)
    return out


def scan(content: str, out: dict) -> dict:
    """What the lines of a broken file still tell: definitions by indentation, and plain imports."""
    lines, scopes = content.split("\n"), []
    for k, line in enumerate(lines, 1):
        found = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line)
        if found:
            depth = len(found[1].expandtabs())
            while scopes and scopes[-1][0] >= depth:
                scopes.pop()
            parent = next((n for _, n, kind in reversed(scopes) if kind == "class"), None)
            end = next((j for j in range(k, len(lines)) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= depth), len(lines))
            out["symbols"].append((found[3], "class" if found[2] == "class" else "method" if parent else "function", parent, k, max(k, end), []))
            scopes.append((depth, found[3], found[2]))
        elif m := re.match(r"\s*import\s+([\w.]+)", line):
            out["imports"].append((m[1], [], None, False, k))
        elif m := re.match(r"\s*from\s+(\.*[\w.]*)\s+import\s+(.+)", line):
            out["imports"].append((m[1], [x.strip() for x in m[2].split(",")], None, m[1].startswith("."), k))
    return out
