"""Token files, mixing, chat, URL rules, HTML text and the pipeline."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from loomwork.llm import chat as C
from loomwork.llm import html_text as H
from loomwork.llm import mixing as M
from loomwork.llm import token_files as T
from loomwork.llm import url_rules as U

tokenizers = pytest.importorskip("tokenizers")


def library():
    return tokenizers.Tokenizer.from_file(T.default_tokenizer())


def test_encoder_equals_library():
    tok, (width, encode) = library(), T.encoder(T.default_tokenizer())
    rnd = random.Random(3)
    signs = ["a", "B", " ", "  ", "\n", "\t", "9", "'s", "é", "\u00a0", "\u3000", "<|endoftext|>", "!", "中", " \n", "\x1c", "\u200b", "\x85", "'", "ǆ", "²", "😀", ".", "word", " word"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(6000)]
    for i in range(0, len(texts), 1500):
        for t, raw in zip(texts[i : i + 1500], encode(texts[i : i + 1500]), strict=True):
            assert np.frombuffer(raw, f"<u{width}").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("part_chars", [16_000_000, 300])
def test_token_files_round_trip(spark, tmp_path, part_chars):
    rows = [(5, "hello world"), (2, "a  b\n c"), (5, None), (5, "again"), (None, "no id"), (9, ""), (-4, "été " * 4000), (5, "again")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(3)
    folder = f"file://{tmp_path}/files"
    manifest = T.write_token_files(df, folder, T.default_tokenizer(), part_chars=part_chars)
    got = sorted(map(tuple, T.read_token_files(spark, folder, manifest).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted([r[0] for r in rows], key=lambda x: (x is not None, x))
    tok, at, want = library(), 0, {}
    for k, t in rows:
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(k, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    for k, start, n, crc in got:
        assert start == at and (n, crc) in want[k]
        want[k].remove((n, crc))
        at += n
    assert not any(want.values())
    name = manifest[0]["name"]
    _, offsets, tokens = T.open_part(folder, name)
    assert isinstance(tokens, np.memmap) and offsets[-1] == len(tokens)
    assert T.token_output(df.limit(0)).count() == 0


def seats(votes, n):
    out = [0] * len(votes)
    for _ in range(n):
        i = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_sainte_lague_equals_one_by_one(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        votes = [rnd.choice([0, 1, 3, 50, 50, 1000, 7777]) for _ in range(rnd.randint(1, 30))]
        n = rnd.choice([0, 1, 5, 40, 333]) if any(votes) else 0
        rows += [(g, i, v, n) for i, v in enumerate(votes)]
        want[g] = seats(votes, n)
    got = M.sainte_lague(spark.createDataFrame(rows, "g int, i int, v long, n long"), ["g"], "v", "n", ["i"]).collect()
    assert {(r["g"], r["i"]): r["quota"] for r in got} == {(g, i): q for g, qs in want.items() for i, q in enumerate(qs)}


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    held, total = set(), sum(sizes.values())
    while True:
        rest, free = total - sum(3 * sizes[s] for s in held), sum(w[s] for s in sizes if s not in held)
        over = {s for s in sizes if s not in held and 3 * sizes[s] <= rest * w[s] / free}
        if not over:
            return {s: 3.0 * sizes[s] if s in held else rest * w[s] / free for s in sizes}
        held |= over


def test_mixture(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), rnd.choice(["a", "a", "a", "b", "é", None, "tiny"])) for i in range(400)]
    rows += [(5, None, "a"), (None, "x y z", None), (7, "\u00a0 x\ty", "b"), (7, "\u00a0 x\ty", "b"), (900, "one two three", "lonely"), (901, None, "empty")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = M.mixture(df, shard_words=2000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        shards = max(1, -(-sizes[s] // 2000))
        assert abs(n - want[s]) <= M.BLOCK_WORDS * (shards + 1), (s, n, want[s])
    again = M.mixture(df.repartition(7), shard_words=2000).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = M.mixed_documents(df, shard_words=2000)
    assert out.columns == df.columns
    assert sum(len((r["text"] or "").encode().split()) for r in out.collect()) == sum(taken.values())
    assert M.mixture(df.limit(0)).count() == 0


def test_mixture_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    cols = "doc_id, size, source_size, target, taken"
    want = sorted(con.sql(f"select {cols} from ({M.OP9_SQL})").fetchall())
    assert sorted(map(tuple, M.op9_mixing(spark, sf).selectExpr(*cols.split(", ")).collect())) == want


def test_chat(spark):
    rnd = random.Random(4)
    longest = [[(t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for t in range(rnd.randint(1, 6))] for c in range(8)]
    convs = longest + [c[: rnd.randint(1, len(c))] for c in longest for _ in range(3)] + [[(0, None, None), (0, "a", "b<|im_end|>")], [(0, None, "")]]
    rows = [(100 - i, *t, "z") for i, c in enumerate(convs) for t in c] + [(None, 1, "user", "lost", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chain string").repartition(3)
    strip = lambda c: tuple((r, x) for _, r, x in sorted(c, key=lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or "")))
    all_ = {100 - i: strip(c) for i, c in enumerate(convs)} | {None: (("user", "lost"),)}
    best = {}
    for k, c in all_.items():
        if not any(o[: len(c)] == c and len(o) > len(c) for o in all_.values()):
            best[c] = k if c not in best or k is not None and k < best[c] else best[c]
    got = {r["conv_id"]: r for r in C.rendered(C.maximal_conversations(df)).collect()}
    assert set(got) == set(best.values())
    assert got[max(k for k in got if k and len(all_[k]) > 1)]["text"].startswith("<|im_start|>user\ntext")
    odd = next(r for r in got.values() if "< |im_end|>" in r["text"])
    assert odd["text"].count("<|im_end|>") == odd["n_turns"] == 2
    assert C.maximal_conversations(df.limit(0)).count() == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c)[0]
    host, _, path = rest.partition("/")
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), f"/{path}" if "/" in rest else ""
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_rules(spark):
    hosts = ["example.net", "WWW.Example.NET", "notexample.net", "example.com", "m.example.com", "x.org", "org", "net", "a.b.c.net", "", "exämple.com", "net:80"]
    paths = ["", "/", "/en/", "/en", "/en/x?y=/de/", "/de/a#b", "/fr/", "/frx", "?q=://net/", "#/"]
    urls = [f"{s}{h}{p}" for h in hosts for p in paths for s in ("http://", "ftp://")] + [None, "", "no scheme", "x://", "http://" + "a." * 300 + "net/"]
    df = spark.createDataFrame([(i % 50, u, "q") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*U.RULES, (None, None, "allow")], "host string, path string, verdict string")
    got = U.judged(df, rules).collect()
    assert len(got) == 2 * len(urls)
    want = {}
    for i, u in enumerate(urls * 2):
        host, path, r = plain_rule(u)
        want.setdefault((i % 50, host, path, r and r[0], r[1] if r else "allow"), []).append(u)
    found = {}
    for r in got:
        found.setdefault((r["page_id"], r["host"], r["path"], None if r["rule"] == "" else r["rule"], r["verdict"]), []).append(1)
    assert {k: len(v) for k, v in want.items()} == {k: len(v) for k, v in found.items()}
    assert U.judged(df.limit(0), rules).count() == 0 and U.judged(df, rules.limit(0)).where("rule is not null").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{x}</style><script>var t="</p><p>no";</script></head><body class="home">
<header>no</header><nav><ul><li><a href="/x">no</a></ul></nav><div class="cookie-notice">no</div><!-- <p>no --><div class="ad">no <p>no</p></div>
<article class="post-17"><h1>Title &amp; more</h1><p>First, with <b>bold<br>text</b> &lt;b&gt;, and a &nbsp; space, long enough to be the text of the page.<p>Second
 one, 1 < 2, also long enough, with commas, to count.<div class="share">no</div><aside>no</aside><form>no<input></form>
<ul><li>Item one<li>Item two</ul><div class="comments"><p>no, reader, no, reader</p></div></article><footer>&copy; no</footer>"""
TEXT = "Title & more\n\nFirst, with bold text <b>, and a space, long enough to be the text of the page.\n\nSecond one, 1 < 2, also long enough, with commas, to count.\n\nItem one\n\nItem two"


def test_html(spark):
    assert H.extract(PAGE) == TEXT
    many = [(i, f"http://h.org/{i}", PAGE.replace("Title", f"Title {i}").replace("post-17", f"post-{i}")) for i in range(20)]
    # a page whose sidebar is longer than its article: the host's other pages decide
    trap = PAGE.replace("<footer>", "<div class=box><p>" + "other words, many, of them, " * 40 + "</p></div><footer>")
    rows = many + [(90, "http://H.org/z", trap), (91, None, PAGE), (92, "x", None), (92, "http://h.org/", ""), (93, "http://h.org/", "just text & more"), (94, "http://h.org/", "<p>" * 3000 + "deep"), (95, "http://h.org/", '<div class="a>x<p title=\'q>b')]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int").repartition(4)
    got = {}
    for r in H.article_texts(df).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert got[90][0]["text"] == TEXT and got[91][0]["text"] == TEXT and got[3][0]["text"] == TEXT.replace("Title", "Title 3")
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got[92]) and len(got[92]) == 2
    assert got[93][0]["text"] == "just text & more" and got[94][0]["text"] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for rs in got.values() for r in rs)
    assert H.article_texts(df.limit(0)).count() == 0


def test_html_on_the_pages(spark, sf):
    """The pages' own template: the article element's blocks."""
    import html
    import re

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in H.op10_html_text(spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", rows[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|div|ul|li)\b[^>]*>", body)]
        assert r["text"] == "\n\n".join(x for x in parts if x)


def test_pipeline(spark, sf):
    """Each stage on its own input against what its operator says of that input."""
    import corpus_pipeline as P
    from loomwork.llm import decontaminate, near_dup, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, kept = docs.columns, {}
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
        if name == "quality_rules":
            want = ids(quality.quality_scores(before, keep=["doc_id"]).where("kept"))
        elif name == "near_duplicates":
            want = ids(near_dup.near_duplicates(before).where("kept"))
        elif name == "decontamination":
            want = ids(decontaminate.contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("not contaminated"))
        elif name == "mix":
            mix = M.mixture(before)
            n = {r["doc_id"]: r["taken"] for r in mix.where("taken > 0").collect()}
            got = {}
            for r in docs.collect():
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].encode().split())
            assert got == n and docs.columns == cols
            continue
        else:
            assert ids(docs) == ids(before)
            continue
        assert ids(docs) == want and docs.columns == cols and len(want) > 0
        kept[name] = len(want)
    assert [k for k, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mix", "token_output"]


def test_sql_of_the_others(spark, sf):
    import duckdb

    from loomwork import llm

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    for name in ("op2_decontaminate", "op5_chat", "op6_url_rules"):
        df = llm.queries()[name](spark, sf)
        cols = ", ".join(df.columns)
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(con.sql(f"select {cols} from ({llm.oracle_sql()[name]})").fetchall(), key=repr), name
