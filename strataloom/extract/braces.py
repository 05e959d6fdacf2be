"""JavaScript, TypeScript, Rust, Go and Java by a scan of code whose comments and strings are blanked out."""

from __future__ import annotations

import re

from .noise import CONTROL, RESERVED, is_noise

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUST_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'", re.S)
_PRIMITIVE = set("boolean byte char double float int long short void String Integer Long Double Float Boolean Short Byte Character".split())


def blanked(content: str, rust: bool = False) -> str:
    """The content with comments and strings as blanks, of the same length and lines."""
    return (_RUST_SKIP if rust else _SKIP).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)


class Code:
    def __init__(self, content: str, language: str):
        self.raw, self.language = content, language
        self.code = blanked(content, language == "rust")
        self.starts = [0, *(m.end() for m in re.finditer("\n", content))]
        self.out: dict = {"imports": [], "calls": [], "symbols": [], "bases": [], "injections": [], "nodes": [], "errors": []}
        self.spans: list[tuple[int, int, str, str]] = []  # start, end, name, kind of scopes

    def line(self, at: int) -> int:
        lo, hi = 0, len(self.starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self.starts[mid] <= at:
                lo = mid
            else:
                hi = mid
        return lo + 1

    def body(self, at: int) -> tuple[int, int]:
        """From the first brace after `at` to its partner; the end of the line where there is none before a semicolon."""
        stop = re.compile(r"[{;]").search(self.code, at)
        if not stop or stop[0] == ";":
            end = stop.end() if stop else len(self.code)
            return end, end
        depth = 0
        for m in re.compile(r"[{}]").finditer(self.code, stop.start()):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return stop.start(), m.end()
        self.out["errors"].append(f"brace not closed at line {self.line(stop.start())}")
        return stop.start(), len(self.code)

    def scope(self, at: int, kinds: tuple[str, ...]) -> str | None:
        inside = [s for s in self.spans if s[0] < at < s[1] and s[3] in kinds]
        return max(inside)[2] if inside else None

    def symbol(self, name: str, kind: str, parent: str | None, start: int, end: int, decorators: list[str] = (), node: str | None = None) -> None:
        first, last = self.line(start), self.line(max(start, end - 1))
        self.out["symbols"].append((name, kind, parent, first, last, list(decorators)))
        b = lambda i: len(self.raw[:i].encode("utf-8", "surrogatepass"))
        self.out["nodes"].append((node or kind, name, parent, b(start), b(end), first, last))

    def calls(self, pattern: str = r"([A-Za-z_$][\w$]*)\s*\(") -> None:
        heads = self.heads
        for m in re.finditer(pattern, self.code):
            if m.start(1) in heads or m[1] in CONTROL or m[1] in RESERVED.get(self.language, ()) or is_noise(m[1], self.language):
                continue
            self.out["calls"].append((m[1], self.line(m.start(1))))

    heads: set[int] = set()


def _block(c: Code, pattern: str, kind, scopes: tuple[str, ...] = (), is_scope: bool = False, flags: int = re.M) -> list[re.Match]:
    """Symbols for each match with a group `name`; kind is a name or a function of the match."""
    found = []
    for m in re.finditer(pattern, c.code, flags):
        if m["name"] in CONTROL:
            continue
        k = kind(m) if callable(kind) else kind
        start, end = c.body(m.end() - 1 if c.code[m.end() - 1 : m.end()] == "{" else m.end())
        first = m.start() + len(m[0]) - len(m[0].lstrip())
        parent = c.scope(m.start("name"), scopes) if scopes else None
        if is_scope:
            c.spans.append((first, end, m["name"], k))
        c.heads = c.heads | {m.start("name")}
        c.symbol(m["name"], k, parent, first, max(end, m.end()))
        found.append(m)
    return found


def script(content: str, language: str) -> dict:
    c = Code(content, language)
    for m in re.finditer(r"^\s*(?:import|export)\s+(?:type\s+)?(?:([\w$*{},\s]+?)\s+from\s+)?['\"]([^'\"\n]+)['\"]", content, re.M):
        if not c.code[m.start() : m.end()].strip().startswith(("import", "export")):
            continue
        names = re.findall(r"[\w$]+", re.sub(r"\bas\s+[\w$]+|\btype\b", "", m[1] or ""))
        alias = re.search(r"\bas\s+([\w$]+)", m[1] or "")
        c.out["imports"].append((m[2], names, alias[1] if alias else None, m[2].startswith("."), c.line(m.start() + len(m[0]) - len(m[0].lstrip()))))
    for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", content):
        c.out["imports"].append((m[2], re.findall(r"[\w$]+", m[1]), None, m[2].startswith("."), c.line(m.start())))
    for m in _block(c, r"(?:^|[;}\s])(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)[^{;]*\{", "class", is_scope=True):
        for heritage in re.finditer(r"\b(?:extends|implements)\s+([\w$.,\s<>]+)", m[0]):
            names = re.sub(r"<[^>]*>", "", re.split(r"\b(?:extends|implements)\b", heritage[1])[0])
            c.out["bases"] += [(m["name"], n.strip().split(".")[-1], c.line(m.start("name"))) for n in names.split(",") if n.strip()]
    _block(c, r"^\s*(?:export\s+)?interface\s+(?P<name>[\w$]+)[^{]*\{", "interface", is_scope=True)
    _block(c, r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)\s*\{", "enum")
    _block(c, r"(?:^|[;}\s])(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*\(", "function")
    _block(c, r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>", "function", ("class",))
    for m in re.finditer(r"^[ \t]*((?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*)\*?(?P<name>[\w$]+)\s*\((?P<args>[^)]*)\)\s*(?::[^{;\n]+)?\{", c.code, re.M):
        owner = c.scope(m.start("name"), ("class",))
        if owner and m["name"] not in CONTROL:
            _, end = c.body(m.end() - 1)
            c.heads = c.heads | {m.start("name")}
            c.symbol(m["name"], "method", owner, m.start() + len(m[0]) - len(m[0].lstrip()), end)
            if language == "typescript" and m["name"] == "constructor":
                for a in re.finditer(r"(?:public|private|protected|readonly)\s+(?:readonly\s+)?([\w$]+)\??\s*:\s*([A-Z][\w$]*)", m["args"]):
                    c.out["injections"].append((owner, a[2], a[1], c.line(m.start("args") + a.start())))
    c.calls()
    return c.out


def rust(content: str) -> dict:
    c = Code(content, "rust")
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", c.code, re.M):
        path = re.sub(r"\s+", " ", m[1]).strip()
        c.out["imports"].append((path, [], None, path.startswith(("self::", "super::")), c.line(m.end() - 1)))
    for m in re.finditer(r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)[^{;]*\{", c.code, re.M):
        start, end = c.body(m.end() - 1)
        c.spans.append((m.start(), end, m["name"], "impl"))
    head = r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*"
    for word, kind in (("struct", "struct"), ("enum", "enum"), ("mod", "module")):
        _block(c, head + word + r"\s+(?P<name>\w+)", kind)
    for m in _block(c, head + r"trait\s+(?P<name>\w+)[^{;]*", "trait", is_scope=True):
        bounds = re.search(r"trait\s+\w+(?:<[^>]*>)?\s*:\s*([^{]+?)(?:\bwhere\b|$)", m[0], re.S)
        if bounds:
            c.out["bases"] += [(m["name"], b.strip().split("::")[-1].split("<")[0], c.line(m.start("name"))) for b in bounds[1].split("+") if b.strip() and b.strip()[0].isalpha()]
    _block(c, head + r"fn\s+(?P<name>\w+)", lambda m: "method" if c.scope(m.start("name"), ("impl", "trait")) else "function", ("impl", "trait"))
    c.calls(r"([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\(")
    return c.out


def go(content: str) -> dict:
    c = Code(content, "go")
    for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|((?:[\w.]+\s+)?\"[^\"]+\"))", content, re.M):
        body, at = (m[1], m.start(1)) if m[1] is not None else (m[2], m.start(2))
        for s in re.finditer(r"(?:([\w.]+)[ \t]+)?\"([^\"]+)\"", body):
            c.out["imports"].append((s[2], [], s[1], False, c.line(at + s.start(2))))
    _block(c, r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<what>\w+)", lambda m: {"struct": "struct", "interface": "interface"}.get(m["what"], "unknown"))
    c.heads = c.heads | {m.start(1) for m in re.finditer(r"^[ \t]*(import|const|var|type)\s*\(", c.code, re.M)}  # groups, not calls
    for m in re.finditer(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*[\[(]", c.code, re.M):
        _, end = c.body(m.end())
        c.heads = c.heads | {m.start("name")}
        c.symbol(m["name"], "method" if m["owner"] else "function", m["owner"], m.start(), end)
    c.calls()
    return c.out


def java(content: str) -> dict:
    c = Code(content, "java")
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", c.code, re.M):
        c.out["imports"].append((m[1], [m[1].split(".")[-1]], None, False, c.line(m.start(1))))
    mods = r"(?:(?:public|private|protected|static|final|abstract|sealed|default|synchronized|native)\s+)*"
    for word, kind in (("class", "class"), ("interface", "interface"), ("enum", "enum"), ("record", "class")):
        for m in _block(c, r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*" + mods + word + r"\s+(?P<name>\w+)[^{;]*\{", kind, ("class", "interface", "enum"), is_scope=True):
            for heritage in re.finditer(r"\b(?:extends|implements)\s+(.+?)(?=\b(?:extends|implements|permits)\b|\{)", m[0], re.S):
                names = re.sub(r"<[^<>]*>", "", heritage[1])
                c.out["bases"] += [(m["name"], n.strip().split(".")[-1], c.line(m.start("name"))) for n in names.split(",") if n.strip()]
    for m in re.finditer(r"^[ \t]*(?P<marks>(?:@\w+(?:\([^)]*\))?\s+)*)" + mods + r"(?:<[^>]+>\s+)?(?:[\w.<>\[\],?]+\s+)?(?P<name>\w+)\s*\((?P<args>[^)]*)\)\s*(?:throws\s+[\w.,\s]+)?[{;]", c.code, re.M):
        owner = c.scope(m.start("name"), ("class", "interface", "enum"))
        before = c.code[: m.start("name")].rstrip()[-7:]
        if not owner or m["name"] in CONTROL or before.endswith(("return", "new", "=", ".", "(")):
            continue
        if not re.match(r"[ \t]*(?:@|public|private|protected|static|final|abstract|[\w.<>\[\],?]+\s+\w+\s*\()", m[0]) and m["name"] != owner:
            continue
        _, end = c.body(m.end() - 1)
        c.heads = c.heads | {m.start("name")}
        c.symbol(m["name"], "method", owner, m.start() + len(m[0]) - len(m[0].lstrip()), end, re.findall(r"@(\w+)", m["marks"]))
        if m["name"] == owner and re.search(r"@(?:Autowired|Inject|Resource)\b", m["marks"]):
            for a in re.finditer(r"(?:final\s+)?([A-Z]\w*)(?:<[^>]*>)?\s+(\w+)", m["args"]):
                if a[1] not in _PRIMITIVE:
                    c.out["injections"].append((owner, a[1], a[2], c.line(m.start("args") + a.start())))
    required = {s[2] for s in c.spans if re.search(r"@RequiredArgsConstructor\b", c.code[max(0, s[0] - 200) : s[0] + 200])}
    for m in re.finditer(r"^[ \t]*(?P<marks>(?:@\w+(?:\([^)]*\))?\s+)*)(?P<mods>" + mods + r")(?P<type>[A-Z]\w*)(?:<[^>]*>)?\s+(?P<name>\w+)\s*(?:=[^;]*)?;", c.code, re.M):
        owner = c.scope(m.start("name"), ("class",))
        marked = re.search(r"@(?:Autowired|Inject|Resource)\b", m["marks"])
        if owner and m["type"] not in _PRIMITIVE and (marked or (owner in required and "final" in m["mods"] and "static" not in m["mods"])):
            c.out["injections"].append((owner, m["type"], m["name"], c.line(m.start("name"))))
    c.calls()
    return c.out
