import re

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import textkernel as tk

TEXTS = ["Hello  world\tfoo bar", None, "", "  ", "é à\u00a0ü A-b\x0bc", "x" * 50, "one two three\nfour", "\x85 \x1c z"]


@pytest.mark.parametrize("piece", [5, 16, 1 << 20])
@pytest.mark.parametrize("table,pattern", [(tk.SPACES, rb"[^\x20\x09-\x0D]+"), (tk.NON_ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_those_of_the_pattern(monkeypatch, piece, table, pattern):
    monkeypatch.setattr(tk, "PIECE", piece)
    texts = [t if t is None else t.lower() for t in TEXTS] * 3
    column = pa.array(texts)
    for part, expected in ((column, texts), (column.slice(2, 9), texts[2:11]), (column.cast(pa.large_string()), texts)):
        data, bounds = tk.text_bytes(part)
        h, s, e, first = tk.hash_words(data, bounds, table)
        seen = {}
        for k, t in enumerate(expected):
            words = re.findall(pattern, (t or "").encode())
            assert [bytes(data[a:b]) for a, b in zip(s[first[k] : first[k + 1]], e[first[k] : first[k + 1]], strict=True)] == words
            for w, x in zip(words, h[first[k] : first[k + 1]], strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_case_of_ascii_alone_is_ignored():
    data, bounds = tk.text_bytes(pa.array(["ABC abc", "É é"]))
    h, *_ = tk.hash_words(data, bounds, tk.SPACES)
    assert h[0] == h[1] and h[2] != h[3]


def test_empty_column():
    data, bounds = tk.text_bytes(pa.array([], pa.string()))
    h, s, e, first = tk.hash_words(data, bounds, tk.SPACES)
    assert len(h) == len(s) == len(e) == 0 and first.tolist() == [0]


def test_chain_tells_order_and_length():
    w = np.array([1, 2, 3, 1, 2], np.uint64)
    a = tk.chain(w, np.array([0, 3]), 2)
    assert a[0] == a[1] and tk.chain(w, np.array([1]), 2)[0] != a[0] and tk.chain(w, np.array([0]), 1)[0] != a[0]
