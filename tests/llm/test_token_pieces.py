"""The encoder cuts texts into pieces that occur again, and gives the library each of them once."""

import random

import numpy as np
import pytest

from loomwork.llm import token_files as T

tokenizers = pytest.importorskip("tokenizers")


def test_signs_and_lines_make_no_new_pieces(monkeypatch):
    plain, seen = tokenizers.Tokenizer.from_file(T.default_tokenizer()), []

    class Counted:
        from_file = staticmethod(lambda path: Counted())

        def __getattr__(self, name):
            return getattr(plain, name)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    width, encode = T.encoder(T.default_tokenizer())
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abcdeéßя") for _ in range(8)) for _ in range(300)})
    ends = ["", ".", ",", "!!", ";***", "'s", ":\n", ".\n", "?\n"]
    texts = ["".join(rnd.choice(words) + (e := rnd.choice(ends)) + (" " if e[-1:] != "\n" else "") for _ in range(40)) for _ in range(400)]
    got = [np.frombuffer(x, f"<u{width}").tolist() for x in encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    given = sum(map(len, seen))
    assert given < 3 * sum(map(len, words)), given  # each word after a space and after none, and a few signs


def test_long_pieces_are_encoded_whole_and_cut_texts_may_be_views(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "LONGEST", 5)
    plain, (width, encode) = tokenizers.Tokenizer.from_file(T.default_tokenizer()), T.encoder(T.default_tokenizer())
    texts = ["", "a\n\nlonger,pieces  here\n", "\n", " end ", "中文　　字 — x. y", "", "<|endoftext|>.x!<|endoftext|>\nLine", "\nLine.\tTab", "×a÷b é, é×."]
    for kind in (pa.string(), pa.large_string()):
        held = pa.array(["before", *texts, *texts, "after"], kind).slice(1, 2 * len(texts))
        for _ in range(2):
            got = [np.frombuffer(x, f"<u{width}").tolist() for x in encode(held)]
            assert got == [plain.encode(t, add_special_tokens=False).ids for t in [*texts, *texts]]
