"""The whole pipeline against a plain version of every stage, and what its files leave behind."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from loomwork.llm import chat, mixing, quality, token_files, url_rules

from .test_near_dup import brute
from .test_outputs import library, plain_targets
from .test_texts import plain_hits, plain_kneser_ney, plain_rules


def fixture():
    rnd = random.Random(21)
    vocabulary = {s: ["".join(rnd.choice(s) for _ in range(rnd.randint(2, 7))) for _ in range(400)] for s in ("abcdefgh", "mnopqrst")}
    rows = []
    for i in range(110):
        v = vocabulary["abcdefgh" if i % 3 else "mnopqrst"]
        rows.append((i, " ".join(rnd.choice(v) for _ in range(rnd.randint(40, 130))), "en" if i % 3 else "fr", rnd.choice(["web", "web", "book", None])))
    for i in range(0, 40, 5):  # near copies
        w = rows[i][1].split()
        w[rnd.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w), rows[i][2], "web"))
    rows += [(300 + i, " ".join("".join(rnd.choice("#&%wzxq") for _ in range(9)) for _ in range(70)), "en", "web") for i in range(2)]
    rows += [(400, None, "en", "web"), (401, "", "fr", None), (402, "one two", "en", "book"), (403, rows[3][1], "en", "book"), (404, "ab cd ef " * 60, "en", "web")]
    bench = [(1, " ".join(rows[7][1].split()[5:17])), (2, "nothing of this kind"), (3, None)]
    return rows, bench


def plain_quality(rows):
    model = {lang: plain_kneser_ney([t for _, t, x, _ in rows if t and x == lang], quality.ORDER) for lang in ("en", "fr")}
    scores = {}
    for k, t, lang, _ in rows:
        n, _, _, _, repeat = plain_rules(t)
        if n >= 50 and 100 * repeat <= 50 * n:
            s = quality._START * 4 + quality.normalise(t) + quality._END
            scores[k] = (lang, t, -sum(model[lang][s[i : i + 5]] for i in range(len(s) - 4)) / n)
    kept = set()
    for lang in ("en", "fr"):
        bins = sorted(np.floor(x / quality.BIN) for x in {t: x for of, t, x in scores.values() if of == lang}.values())
        at = lambda q, b=bins: (next(x for i, x in enumerate(b) if i + 1 >= q * len(b)) + 0.5) * quality.BIN
        spread = max(at(0.75) - at(0.25), quality.LEAST_SPREAD)
        low, high = at(0.25) - spread * quality.LOW_WIDTH, at(0.75) + spread * quality.HIGH_WIDTH
        kept |= {k for k, (of, _, x) in scores.items() if of == lang and low <= x <= high}
    return [r for r in rows if r[0] in kept]


def plain_mix(rows):
    """Sources of one shard each: full passes, then blocks in seeded order until the target is reached."""
    by, out = {}, []
    for k, t, _, s in rows:
        by.setdefault(s, []).append((hashlib.md5(f"{mixing.SEED}:{k}".encode()).hexdigest(), k, t.split()))
    targets = plain_targets({s: sum(len(w) for _, _, w in of) for s, of in by.items()})
    for s, of in by.items():
        words = [(k, i) for _, k, w in sorted(of) for i in range(len(w))]
        texts = {k: w for _, k, w in of}
        full, rest = divmod(int(np.floor(targets[s] + 0.5)), len(words))
        size = mixing.BLOCK_WORDS
        order = sorted(range(-(-len(words) // size)), key=lambda i: hashlib.md5(f"{mixing.SEED}:{s or ''}:0:{i}".encode()).hexdigest())
        taken = [w for i in order for w in words[i * size : (i + 1) * size]][:rest]
        part = {}
        for k, i in sorted(taken):
            part.setdefault(k, []).append(i)
        for _, k, t in of:
            out += [(k, t, True)] * full
            if k in part:
                out.append((k, [t[i] for i in part[k]], len(part[k]) == len(t)))
    return [(k, " ".join(w)) for k, w, _ in out]


def test_run_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline as P

    rows, bench = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", __import__("pyspark.sql.functions", fromlist=["length"]).length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = plain_quality(rows)
    assert 60 < len(kept) < len(rows) - 8 and not {300, 301, 404} & {r[0] for r in kept}
    alone = {k for k, _, _, stays in brute([(k, t) for k, t, _, _ in kept]) if stays}
    once = [r for r in kept if r[0] in alone]
    clean = [r for r in once if not plain_hits(r[1], bench)[-1]]
    assert len(clean) < len(once) < len(kept)
    tok, at, want = library(), 0, []
    mixed = {}
    for k, t in plain_mix(clean):
        mixed.setdefault(k, []).append((len(ids := [*tok.encode(t, add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes())))
    spark.conf.set("loomwork.tokens.dir", f"file://{tmp_path}/tokens")
    try:
        got = P.run(spark, str(tmp_path)).orderBy("start").collect()
    finally:
        spark.conf.unset("loomwork.tokens.dir")
    found = {}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in mixed.items()}
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    # the files stay, and the manifest beside them tells all that is needed to read them
    manifest = token_files.open_manifest(f"file://{tmp_path}/tokens")
    assert sum(m["n_tokens"] for m in manifest) == at and sum(m["n_docs"] for m in manifest) == len(got)


def test_rows_without_a_conversation_id(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "user", "a"), (None, 1, "user", "b"), (4, 0, "user", "b"), (4, 1, "bot", "c"), (5, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r["conv_id"], [t["text"] for t in r["turns"]]) for r in chat.maximal_conversations(df).collect()), key=repr)
    assert got == [(4, ["b", "c"]), (5, ["a"])]
    lost = chat.maximal_conversations(df.where("conv_id is null and text = 'a'")).collect()
    assert [(r["conv_id"], len(r["turns"])) for r in lost] == [(None, 1)]


def test_chat_sql_with_null_ids(spark):
    import duckdb

    rows = [(None, 1, "user", "a"), (None, 2, "user", "a"), (None, 1, "user", "z"), (4, 0, "user", "b"), (4, 1, "bot", "c"), (5, 0, "user", "a"), (None, 3, None, "q"), (6, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64"}))
    want = sorted(con.sql(f"select conv_id, n_turns, text from ({chat.OP5_SQL})").fetchall(), key=repr)
    assert sorted(map(tuple, chat.rendered(chat.maximal_conversations(df)).collect()), key=repr) == want


@pytest.mark.parametrize("n", [0, 3])
def test_null_urls_are_judged_apart(spark, n):
    df = spark.createDataFrame([(i, None) for i in range(n)] + [(9, "http://x.net/")], "page_id long, url string")
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judged(df, rules).collect()}
    assert got == {i: "allow" for i in range(n)} | {9: "block"}
