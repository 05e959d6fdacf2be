import random

import pytest

SYLLABLES = {"en": "the ing er on an re".split(), "de": "sch ein ung der lich zu".split(), "fr": "eau que ou ai tion le".split()}


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def sentence():
    def make(lang, words, seed):
        rng = random.Random(f"{lang}-{seed}")
        return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words)) + "."

    return make


#: Texts at the edges: null, empty, blank, one letter, one very long word, special strings, control characters, emoji.
EDGES = [None, "", " ", "\n\n", "a", "x" * 50_000, "a<|endoftext|> b", "tab\tand\x1cfs  two  blanks ", "été 🙂 日本語 ½²", "it's\r\nwe'll", "word " * 3000]
