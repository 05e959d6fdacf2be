"""Names too common to be worth a call edge, by language."""

from __future__ import annotations

import builtins

_PYTHON = {n for n in dir(builtins) if n[0].islower()} | set(
    "add append clear close copy decode encode endswith extend flush get insert items join keys lstrip pop quit read remove replace rstrip seek split startswith strip update values write exit".split()
)
_SCRIPT = set(
    "warn values useState useRef useReducer useMemo useLayoutEffect useEffect useContext useCallback unshift trimStart trimEnd trim trace toUpperCase toString toLowerCase then substring startsWith split splice sort some slice size shift setTimeout setInterval setAttribute set search reverse resolve require replaceAll replace repeat removeEventListener reject reduce race querySelectorAll querySelector push pop parseInt parseFloat padStart padEnd match map log lastIndexOf keys join isNaN isFinite info indexOf includes has getOwnPropertyNames getElementById getAttribute get freeze forEach flatMap flat findIndex find finally filter fill every error entries endsWith encodeURIComponent delete decodeURIComponent debug create copyWithin concat clearTimeout clearInterval clear charCodeAt charAt catch assign any allSettled all addEventListener add".split()
)
_RUST = set(
    "vec unwrap trim to_string to_owned starts_with split replace remove push println print pop panic ok map len iter_mut iter is_some is_ok is_none is_err into_iter into insert get from format filter expect err eprintln eprint ends_with debug_assert contains collect clone assert_ne assert_eq assert as_str as_bytes".split()
)
NOISE: dict[str, frozenset[str]] = {"python": frozenset(_PYTHON), "javascript": frozenset(_SCRIPT), "typescript": frozenset(_SCRIPT), "rust": frozenset(_RUST)}
CONTROL = frozenset("if for while switch catch return function match loop fn func new throw typeof await super this else do try sizeof synchronized assert elif in not and or with lambda yield".split())
#: Words that one language keeps for itself and others may call.
RESERVED = {"go": frozenset("go defer select range chan map make".split())}


def is_noise(name: str, language: str) -> bool:
    """Go and Java calls are kept whatever their name; a language without a set drops names of one letter."""
    if language in ("go", "java"):
        return False
    return name in NOISE[language] if language in NOISE else len(name) <= 1
