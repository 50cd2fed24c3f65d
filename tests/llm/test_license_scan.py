"""The exact phrases against a plain search, and long texts."""

import random
import re
import time

from loomwork.llm import license_scan as L

EXACT = [(f" {p} ".encode(), label) for p, label in L.PHRASES]


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    starts, labels = [], set()
    for p, label in L.PHRASES:
        v = p.split()
        for i in range(len(words) - len(v) + 1):
            if words[i : i + len(v)] == v:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels


def test_base_equals_plain_search():
    rnd = random.Random(5)
    parts = "gnu GNU general public license licence apache Apache cc by CC-BY mit MIT license é . , \n 9 cc by-nc x".split(" ")
    for _ in range(4000):
        text = rnd.choice([" ", "-", ", ", "é "]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        got = L.scan(text.encode(), EXACT, [])
        starts = got["starts"]
        assert (got["n_words"], len(starts), min(starts, default=None), max(starts, default=None), got["base"]) == plain(text), text


def test_word_numbers_of_notices():
    notices = [L.Notice(t, label) for t, label in L.NOTICES]
    text = "one two " * 50 + "Released undr the MIT license. " + "three " * 7 + "Licensed under CC BY-NC and more"
    spans = L.scan(text.encode(), EXACT, notices)["spans"]
    assert {(100, "mit", 1), (112, "cc-by-nc", 0)} <= {(s[0], s[3], s[4]) for s in spans}


def test_long_texts_cost_no_more_than_their_length():
    for phrase in (b"mit license ", b"cc by ", b"gnu general public license "):
        t = time.perf_counter()
        assert len(L.scan(phrase * 80_000, EXACT, [])["starts"]) == 80_000
        assert time.perf_counter() - t < 0.5
    notices = [L.Notice(t, label) for t, label in L.NOTICES]
    t = time.perf_counter()
    L.scan(b"gnu general public license " * 10_000, EXACT, notices)
    assert time.perf_counter() - t < 20
