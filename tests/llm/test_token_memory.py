"""The encoder's memory of pieces never changes what it gives."""

import random

import numpy as np

from loomwork.llm import token_files as T


def test_forgetting_changes_no_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T, "REMEMBERED", 7)
    path = T.default_tokenizer()
    width, encode = T.encoder(path)
    plain = Tokenizer.from_file(path)
    rnd = random.Random(5)
    words = ["a", "the", "naïve", "x,", "Straße.", "42", "don't", "你好", "end.\nNext", "<|endoftext|>", "..."] + ["".join(rnd.choice("abcde") for _ in range(4)) for _ in range(40)]
    for _ in range(60):
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12))) for _ in range(rnd.randrange(1, 5))]
        got = [np.frombuffer(bytes(x), f"<u{width}").tolist() for x in encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
