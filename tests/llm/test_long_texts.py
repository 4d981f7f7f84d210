"""Texts of hundreds of thousands of characters must not take quadratic time."""

import time

import pytest

from tessera.llm.credentials import scan_text
from tessera.llm.parsing import judge
from tessera.llm.provenance import composition_origin, header_origin
from tessera.llm.unify import canonical_words, consistent, oddities

N = 200_000
TEXTS = {
    "newlines": "\n" * N, "digits": "1" * N, "spaces": "password= x" + " " * N, "flags": "--a" * (N // 3), "dots": "a.a" * (N // 3) + "://", "quotes": "'" * N, "hashes": "# code file " * (N // 12),
    "brackets": "(" * N, "tags": "<a " * (N // 3), "letters": "token=" + "aB3" * (N // 3), "odd": chr(0x430) * (N // 2) + "a" * (N // 2), "marks": ("e" + chr(0x301)) * (N // 2), "backslashes": "key='" + "\\" * N, "lines": "x = 1\n" * (N // 6),
}


@pytest.mark.parametrize("name", TEXTS)
def test_time(name):
    text = TEXTS[name]
    for what in (
        scan_text, lambda t: judge("a.py", t), lambda t: judge("a.json", t), lambda t: composition_origin("a.py", t), lambda t: header_origin("a.py", "o/r", t), consistent, oddities, canonical_words,
    ):
        began = time.process_time()
        what(text)
        assert time.process_time() - began < 20, what  # the TOML reader joins long dotted keys part by part
