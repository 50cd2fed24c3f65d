"""Quotas to the word, and blocks that are taken as wholes in seeded order."""

import random

from loomwork.llm import mixing as M


def documents(rnd):
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 30, 400])), rnd.choice(["big"] * 6 + ["mid", "mid", None])) for i in range(900)]
    return rows + [(5000 + i, "one two three", "small") for i in range(3)] + [(6000, " ".join(["x"] * 9000), "long"), (6001, None, "empty"), (6002, "", "empty")]


def test_targets_are_met_to_the_word(spark):
    rows = documents(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for shard_words in (2000, 15_000, 250_000):
        taken, target = {}, {}
        for r in M.mixture(df, shard_words=shard_words, block_words=128).collect():
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
            target[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["full"] * r["size"] + r["part"]
            assert r["part"] == sum(x["high"] - x["low"] for x in r["ranges"])
        assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_blocks_are_taken_whole_and_in_seeded_order(spark):
    """All words of one shard, cut into blocks: all taken blocks but one are whole, they are scattered, and another seed takes others."""
    df = spark.createDataFrame([(i, " ".join(["w"] * 50), "a" if i < 400 else "b") for i in range(800)], "doc_id long, text string, source string")

    def blocks(seed):
        order = sorted(M.mixture(df, weights=(1, 3), block_words=500, seed=seed).where("source = 'a'").collect(), key=lambda r: M_place(seed, r["doc_id"]))
        whole = [r["taken"] for r in order]
        return [sum(whole[i : i + 10]) for i in range(0, 400, 10)]

    def M_place(seed, k):
        import hashlib

        return hashlib.md5(f"{seed}:{k}".encode()).hexdigest()

    first, second = blocks("s1"), blocks("s2")
    assert sum(first) == sum(second) == 10_000
    assert set(first) == {0, 500} and first.count(500) == 20 and first != second
    assert sum(a != b for a, b in zip(first, first[1:], strict=False)) > 6


def test_mixed_rows_hold_the_taken_words(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"{i}w{k}" for k in range(rnd.choice([3, 40, 700]))), rnd.choice("ab")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"block_words": 100, "weights": (1, 4)}
    mix = {r["doc_id"]: r for r in M.mixture(df, **options).collect()}
    got = {}
    for r in M.mixed_documents(df, **options).collect():
        got.setdefault(r["doc_id"], []).append(r["text"].split())
    texts = {i: t.split() for i, t, _ in rows}
    for i, m in mix.items():
        want = [texts[i]] * m["full"]
        part = [w for x in m["ranges"] for w in texts[i][x["low"] : x["high"]]]
        assert sorted(got.get(i, [])) == sorted(want + ([part] if part else []))
