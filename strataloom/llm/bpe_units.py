"""Units of a text that a byte-level BPE with the usual split pattern encodes independently, and bounded memos of their ids.

A cut between a character that is not white space and one that is can be made anywhere: no alternative of the
pattern spans it, and its only look-ahead looks from white space to what follows. So a text falls into units of
white space followed by the rest of a word, and the units' ids joined are the text's ids. Strings of added tokens
are split off first, as the library does.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: White space as the pattern's \s has it (Unicode White_Space); Python's own \s has four control characters more.
WHITE = " \t\n\r\x0b\x0c\x85\xa0  -     　"
UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The split pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"
#: A unit that splits into words and marks without asking the full pattern, and may go on over one line end. The groups
#: are its pre-tokens (a line end stays with its word, from which it splits as it would anywhere).
PLAIN_UNIT = re.compile(f"( ?{_LETTERS})({_MARKS})(\n{_LETTERS})?({_MARKS})\\Z")
_DOUBLE = re.compile(f"[{WHITE}] ")


def load_tokenizer(path: str):
    """The library's tokenizer; its own threads are off, as Spark runs one task a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Memo(dict):
    """A dict that computes what it lacks. Two generations bound it: when the young one is full, it becomes the old one.

    A string above LONGEST_KEY characters is computed each time and never kept, so entries bound bytes too.
    """

    LONGEST_KEY = 256

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST_KEY:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def lacks(self, key) -> bool:
        return key not in self and key not in self.old


class UnitEncoder:
    """What `measure` gives for each unit, joined over whole texts.

    `measure` maps a unit's text to bytes (ids) or to a number. `added` maps strings of added tokens to the same.
    """

    def __init__(self, measure, added: dict, most: int = 300_000):
        self.measure, self.added = measure, added
        self.spaced = Memo(lambda part: measure(" " + part), most)
        self.plain = Memo(measure, most // 4)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None

    def parts(self, text: str) -> list:
        if not text:
            return []
        if self.split is None or not any(s in text for s in self.added):
            return self.section(text)
        out: list = []
        for piece in self.split.split(text):
            out += [self.added[piece]] if piece in self.added else self.section(piece)
        return out

    def section(self, text: str) -> list:
        if not text:
            return []
        if _DOUBLE.search(text) or text[-1] == " ":
            return list(map(self.plain.__getitem__, UNITS.findall(text)))
        # single blanks alone between parts; a part with other white space inside is a unit for the pattern below it
        first, *rest = text.split(" ")
        out = list(map(self.spaced.__getitem__, rest))
        return [self.plain[first], *out] if first else out


def added_tokens(tokenizer) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


def ranked_by_id(tokenizer, path: str) -> dict[bytes, int] | None:
    """Bytes of each token to its id, where the file ranks merges by the ids that they make; None where it does not."""
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
    if made != list(range(256, 256 + len(made))):
        return None
    letters = {c: b for b, c in enumerate(byte_letters())}
    added = added_tokens(tokenizer)
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in added}


#: Characters outside these blocks go to the tokenizers library: there two libraries' tables of letters might differ.
RARE = re.compile("[^\x00-\u024f\u2000-\u206f\u20a0-\u20c0]")
#: A run of white space this long goes to the tokenizers library: the pattern's look-ahead makes tiktoken step back over
#: the whole run, which fails (and kills the worker) on a run of a million.
_LONG_BLANK = re.compile(f"[{WHITE}]{{4096}}")


class IdsEncoder:
    """A text's ids, as little-endian unsigned 32-bit bytes, as the tokenizers library gives them with its defaults.

    Where a vocabulary ranks its merges by the ids that they make, as is checked when it is loaded, texts go to tiktoken
    with the same vocabulary, which is several times faster and gives the same ids. What the two might split
    differently, rare characters and very long runs of white space, goes to the tokenizers library: by the text alone,
    so all workers agree. Strings of added tokens are split off first, as the library does.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.added = {s: np.array([i], "<u4").tobytes() for s, i in added_tokens(self.tokenizer).items()}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.fast = None
        if ranks := ranked_by_id(self.tokenizer, path):
            import tiktoken

            self.fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def section(self, text: str) -> bytes:
        if self.fast is None or RARE.search(text) or _LONG_BLANK.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.split is None or not any(s in text for s in self.added):
            return self.section(text) if text else b""
        return b"".join(self.added[p] if p in self.added else self.section(p) for p in self.split.split(text) if p)


_ENCODERS: dict = {}


def worker_encoder(key: tuple, make):
    """One encoder for a Python worker, kept from task to task."""
    if key not in _ENCODERS:
        _ENCODERS[key] = make()
    return _ENCODERS[key]
