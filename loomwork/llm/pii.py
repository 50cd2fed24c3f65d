"""Personal data: exact patterns, and a skip-chain conditional random field that finds what they miss.

The field's nodes are the tokens that hold a digit, an "@" or what is written for one ("[at]"); every other token is
certainly outside an entity. Edges join neighbours in the text (the chain) and, over any distance in the document,
consecutive occurrences of one token, of one address however its signs are written, and of one number or of its last
digits (the skips), so an entity that is written twice gets the same label twice. Tokens inside a span of the exact
patterns are observed with its label. Loopy message passing gives each other token its marginal; runs of tokens that are
confidently of one kind become spans. Besides the kinds of the exact patterns the field knows secrets: long mixed tokens
that are assigned to a name such as "token" or "password", and what repeats them.

Node, chain and skip weights are trained together by pseudo-likelihood on a bounded sample of documents. Labels come from
the exact patterns and assigned secrets; since those see only what is written plainly, the sample's documents get further
mentions of their entities in degraded form (no country code, spelled-out signs, other separators), labelled as the
entity, and numbers of the same shape that belong to nothing. All documents are searched.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frees, small_batches, table

KINDS = ("email", "ip", "card", "phone")  #: The contract's, with exact patterns.
FOUND = (*KINDS, "secret")  #: Those of added spans.
LABELS = ("", *FOUND)
SECRET = len(KINDS)
TRAIN_DOCS = 2000  #: The model trains on the documents with a digit or "@" that have the smallest hashes, so many at most.
TRAIN_TOKENS = 60_000  #: And on so many of their tokens at most.
ROUNDS, DAMPING = 10, 0.5  #: Of message passing.
SKIP_WEIGHT = 2.0  #: Log odds that a skip edge gives to equal labels where no sample teaches them.
CONFIDENT = 0.9  #: Least marginal of a token of an added span.

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_SIGN = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
_GAP = re.compile(r"\s")
_ALPHA, _HEX = re.compile(r"[^\W\d_]"), re.compile(r"[0-9a-fA-F]{16,}")
_AT, _DOT = re.compile(r"\s*[\[(]at[\])]\s*", re.I), re.compile(r"\s*[\[(](?:dot|\.)[\])]\s*", re.I)
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)[\w.-]*[\"']?\s*(?:=|:|is)\s*[\"'(]*\Z", re.I)
_LETTER_AND_DIGIT = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_/+=.~-]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the exact patterns' matches, leftmost and non-overlapping in each kind, in order."""
    out = []
    at, past = text.find("@"), 0
    while at >= 0:  # an address is the run of local characters before an "@" and the domain after it
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            past = m.end()
        else:
            past = at + 1
        at = text.find("@", past)
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) < 4 and int(q or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of the white-space delimited tokens with a digit or an "@", without punctuation around them."""
    out, at = [], 0
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = (g.start() if (g := _GAP.search(text, m.start())) else len(text))
        at = end
        a, b = start, end
        while a < b and text[a] in "\"'<>[]{},;:!?.":
            a += 1
        while b > a and text[b - 1] in "\"'<>[]{},;:!?.":
            b -= 1
        if a < b:
            out.append((a, b))
    return out


FEATURES = 80
_SIZES = (1, 2, 3, 4, 5, 7, 8, 10, 11, 12, 14, 17, 20)


def features(words: list[str], k: int, before: bool, after: bool, named: bool = False) -> list[int]:
    """Numbers of the features that hold for token k; before and after tell whether its neighbours adjoin it, named whether a name such as "token" stands before it."""
    w = words[k]
    digits = _NO_DIGIT.sub("", w)
    n = len(digits)
    out = [0, 1 + sum(n >= s for s in _SIZES)]  # 1..14
    if "@" in w:
        out.append(15 + ("." in w.rpartition("@")[2]))  # 15, 16
    dots, dashes = w.count("."), w.count("-")
    out.append(17 + min(dots, 4))  # 17..21
    out.append(22 + min(dashes, 3))  # 22..25
    out.append(26 if _ALPHA.search(w) else 27)
    if w[0] == "+":
        out.append(28)
    if "(" in w or ")" in w:
        out.append(29)
    if "=" in w or '"' in w or "/" in w or "_" in w:
        out.append(30)
    if dots == 3 and len(w) < 16 and all(p.isdigit() and p.isascii() and int(p) < 256 for p in w.split(".")):
        out.append(31)
    if 14 <= n <= 19 and luhn(digits):
        out.append(32)
    if n == len(w):
        out.append(33)
    if re.fullmatch(r"\(?[0-9]{3}\)?", w):
        out.append(34)
    if re.fullmatch(r"[0-9]{3}[-.][0-9]{4}", w):
        out.append(35)
    if re.fullmatch(r"\(?[0-9]{3}\)?[-.][0-9]{3}[-.][0-9]{4}", w):
        out.append(36)
    if re.fullmatch(r"[0-9]{4}", w):
        out.append(37)
    for j, side, on in ((k - 1, 38, before), (k + 1, 50, after)):
        if not on:
            out.append(side)
            continue
        v = words[j]
        m = len(_NO_DIGIT.sub("", v))
        out.append(side + 1 + min(m, 5))  # 1..6
        if v[0] == "+":
            out.append(side + 7)
        if "(" in v or ")" in v:
            out.append(side + 8)
        if _ALPHA.search(v):
            out.append(side + 9)
        if "-" in v:
            out.append(side + 10)
    if _AT.search(w):
        out.append(62)
    if _HEX.fullmatch(w):
        out.append(63)
    if _LETTER_AND_DIGIT.fullmatch(w):
        out.append(64)
    if named:
        out.append(65)
    if n > 6 and re.search(r"[0-9][./][0-9]", w) and dots != 3:
        out.append(66)
    return out


def _keys(w: str, digits: str) -> list[tuple]:
    """What a token has in common with others that stand for the same thing."""
    out = []
    if len(digits) >= 4 or "@" in w:
        out.append((0, w.lower()))
    if len(digits) >= 7:
        out.append((1, digits))
        out.append((2, digits[-10:] if len(digits) > 10 else digits))
    if "@" in w or _AT.search(w):
        out.append((3, _DOT.sub(".", _AT.sub("@", w.lower()))))
    if digits and w.count("[") + w.count("(") and "." in w:
        out.append((3, _DOT.sub(".", w.lower())))
    elif w.count(".") == 3:
        out.append((3, w.lower()))
    return out


def graph(text: str, spans: list[tuple[int, int, int]]):
    """(places, active features of each token, observed label or -1 of each, chain edges, skip edges) of a text, in time in proportion to its length and its spans."""
    places = tokens(text)
    words = [text[a:b] for a, b in places]
    near = [i + 1 < len(places) and places[i + 1][0] - places[i][1] <= 2 for i in range(len(places))]
    named = [len(w) > 15 and bool(_NAMED.search(text, max(0, places[k][0] - 40), places[k][0])) for k, w in enumerate(words)]
    active = [features(words, k, k > 0 and near[k - 1], near[k], named[k]) for k in range(len(words))]
    observed = [-1] * len(words)
    starts = [a for a, _ in places]
    for start, kind, end in sorted(spans, key=lambda s: -s[1]):
        k = max(bisect_right(starts, start) - 1, 0)
        while k < len(places) and starts[k] < end:
            if start < places[k][1]:
                observed[k] = kind + 1
            k += 1
    last: dict = {}
    skips = set()
    digits = [_NO_DIGIT.sub("", w) for w in words]
    for k, w in enumerate(words):
        split = [(4, digits[k] + digits[k + 1])] if near[k] and len(digits[k]) == 3 and len(digits[k + 1]) == 7 else []
        for key in _keys(w, digits[k]) + split:
            if key in last and last[key] != k:
                skips.add((last[key], k))
            last[key] = k
    return places, active, observed, [(k, k + 1) for k in range(len(words) - 1) if near[k]], sorted(skips)


def assigned_secrets(text: str, places) -> list[int]:
    """Tokens with letters and digits that are assigned to a name such as "token": labels to train on."""
    return [k for k, (a, b) in enumerate(places) if b - a > 15 and _LETTER_AND_DIGIT.fullmatch(text, a, b) and _NAMED.search(text, max(0, a - 40), a)]


def degraded(kind: int, entity: str, rnd: random.Random) -> str | None:
    """Another way to write an entity that its exact pattern does not match; None if there is none."""
    if kind == 0:
        at, dot = rnd.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("[at]", "."), ("(at)", ".")])
        return entity.replace("@", at).replace(".", dot)
    if kind == 1:
        return entity.replace(".", rnd.choice(["[.]", "(.)"]))
    if kind == 2:
        digits = _NO_DIGIT.sub("", entity)
        return rnd.choice([".", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        parts = entity.split(None, 1)
        return parts[1] if len(parts) == 2 and len(_NO_DIGIT.sub("", parts[1])) >= 7 else None
    return entity


def training_graph(text: str, seed: int):
    """graph() of a text with degraded mentions of its entities and unrelated numbers, a label for each token, and which tokens are no examples.

    Tokens that repeat an entity outside one, and their neighbours, may be what the patterns miss: they are no examples.
    """
    rnd, base = random.Random(seed), base_spans(text)
    more, forced = [], []
    mentions = [(kind, text[a:b]) for a, kind, b in base]
    mentions += [(SECRET, text[a:b]) for a, b in (places[k] for places in [tokens(text)] for k in assigned_secrets(text, places))]
    for kind, entity in mentions[:50]:
        if rnd.random() < 0.7 and (other := degraded(kind, entity, rnd)):
            more.append((other, kind + 1))
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    shapes = [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", lambda: digits(16), lambda: f"{rnd.randrange(256)}[.]{digits(2)}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"x[at]{digits(2)}"]
    more += [(rnd.choice(shapes)(), 0) for _ in range(rnd.randrange(3))]
    rnd.shuffle(more)
    for other, label in more:
        text += " so "
        forced.append((len(text), len(text) + len(other), label))
        text += other
    places, active, observed, chain, skips = graph(text, base)
    labels = [max(x, 0) for x in observed]
    for k in assigned_secrets(text, places):
        labels[k] = observed[k] = SECRET + 1
    starts, free = [a for a, _ in places], set()
    for a, b, label in forced:
        k = bisect_right(starts, a)
        k = max(k - 1, 0)
        while k < len(places) and places[k][0] < b:
            if places[k][1] > a:
                labels[k] = label
                free.add(k)
            k += 1
    open_ = {b for a, b in skips if observed[a] > 0 >= observed[b] and b not in free} | {a for a, b in skips if observed[b] > 0 >= observed[a] and a not in free}
    open_ |= {b for a, b in chain if a in open_ and observed[b] < 0 and b not in free} | {a for a, b in chain if b in open_ and observed[a] < 0 and a not in free}
    return active, labels, chain, skips, open_


@dataclass
class Field:
    """Weights: of features by label, of neighbouring labels, and of equal labels at the ends of a skip edge."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def train(active: list[list[int]], labels: np.ndarray, chain: np.ndarray, skips: np.ndarray, steps: int = 600, decay: float = 1e-4) -> Field:
    """Node, chain and skip weights together, by gradient ascent on the pseudo-likelihood: each label given the features and the labels of its neighbours. Edges are pairs of token numbers."""
    m, n = len(LABELS), len(labels)
    if not n:
        w = np.zeros((FEATURES, m))
        w[0, 0] = 5.0
        return Field(w, np.zeros((m, m)), np.full(m, SKIP_WEIGHT))
    x = np.zeros((n, FEATURES), np.float32)
    for i, fs in enumerate(active):
        x[i, fs] = 1
    y = np.eye(m, dtype=np.float32)[labels]
    left, right = chain.reshape(-1, 2).T
    one, two = skips.reshape(-1, 2).T
    gather = lambda at, rows: np.stack([np.bincount(at, rows[:, j], n) for j in range(m)], 1) if len(at) else np.zeros((n, m))
    # for each token the labels before it, after it and at the other ends of its skips, counted
    past, next_, far = gather(right, y[left]), gather(left, y[right]), gather(one, y[two]) + gather(two, y[one])
    far = np.minimum(far, 2)  # of many occurrences two are enough, or what is repeated often would decide the weights
    field = Field(np.zeros((FEATURES, m)), np.zeros((m, m)), np.zeros(m))
    speed = [np.zeros_like(field.node), np.zeros_like(field.chain), np.zeros_like(field.skip)]
    # rare labels weigh as much as all that is outside, up to a tenfold
    often = np.bincount(labels, minlength=m)
    weigh = np.minimum(10.0, often.max() / np.maximum(often, 1)) ** 0.5
    weigh = (weigh[labels] / (weigh[labels].sum() / n))[:, None]
    for _ in range(steps):
        z = x @ field.node + past @ field.chain + next_ @ field.chain.T + far * field.skip
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - y) * weigh / n
        slopes = (x.T @ error + decay * field.node, past.T @ error + error.T @ next_ + decay * field.chain, (far * error).sum(0) + decay * field.skip)
        for v, slope in zip(speed, slopes, strict=True):
            v *= 0.9
            v -= 0.5 * slope
        field.node += speed[0]
        field.chain += speed[1]
        field.skip += speed[2]
    field.chain = np.clip(field.chain, -4, 4)
    field.skip = np.clip(field.skip, 0, 8)
    return field


EDGES_AT_ONCE = 20_000  #: Whose messages are computed at once: their pairs of labels take 6 MB.


def marginals(scores: np.ndarray, chain: np.ndarray, skips: np.ndarray, potentials: np.ndarray, skip_weight: float | np.ndarray = SKIP_WEIGHT, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """Beliefs of all nodes after loopy sum-product message passing in log space; edges are pairs of node numbers. Only the messages are held for all edges at once."""
    n, m = scores.shape
    chain, skips = np.asarray(chain, np.int64).reshape(-1, 2), np.asarray(skips, np.int64).reshape(-1, 2)
    # messages along and against the edges, of the chain and of the skips
    groups = [(chain[:, 0], chain[:, 1], potentials), (chain[:, 1], chain[:, 0], potentials.T), (skips[:, 0], skips[:, 1], None), (skips[:, 1], skips[:, 0], None)]
    again = np.expm1(np.broadcast_to(np.asarray(skip_weight, float), m))
    sent = [np.zeros((len(src), m)) for src, _, _ in groups]
    belief = scores
    for _ in range(rounds if len(chain) + len(skips) else 0):
        new = []
        for k, (src, _, psi) in enumerate(groups):
            out, back = np.empty_like(sent[k]), sent[k ^ 1]
            for i in range(0, len(src), EDGES_AT_ONCE):
                part = slice(i, i + EDGES_AT_ONCE)
                a = belief[src[part]] - back[part]
                a -= a.max(1, keepdims=True)
                if psi is None:  # equal labels count more, all others alike
                    e = np.exp(a)
                    got = np.log(e.sum(1, keepdims=True) + again * e)
                else:
                    got = np.log(np.exp(a) @ np.exp(psi))
                out[part] = got - got.max(1, keepdims=True)
            new.append(damping * sent[k] + (1 - damping) * out)
        sent = new
        belief = scores.copy()
        for (_, dst, _), msg in zip(groups, sent, strict=True):
            for j in range(m) if len(dst) else ():
                belief[:, j] += np.bincount(dst, msg[:, j], n)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _plausible(kind: int, words: list[str]) -> bool:
    """Whether an added span can be of its kind at all, however it is written."""
    whole = " ".join(words)
    n = len(_NO_DIGIT.sub("", whole))
    if kind == 0:
        return len(words) == 1 and bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9]", _AT.sub("@", whole)))
    if kind == SECRET:
        return len(words) == 1 and len(whole) > 15 and bool(_LETTER_AND_DIGIT.fullmatch(whole))
    if _ALPHA.search(whole):
        return False
    if kind == 1:
        return len(words) == 1 and bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5}|/[0-9]{1,2})?", _DOT.sub(".", whole)))
    if kind == 2:
        return 14 <= n <= 19 and luhn(_NO_DIGIT.sub("", whole))
    return 7 <= n <= 15 and bool(re.search(r"[-+().\x20]", whole))


def added_spans(text: str, places, observed, belief: np.ndarray, chain, confident: float = CONFIDENT) -> list[tuple[int, int, int]]:
    """Spans of the tokens outside base spans that are confidently of one kind; of cards and phones, runs of neighbours."""
    best = belief.argmax(1)
    sure = (belief.max(1) >= confident) & (best > 0) & (np.array(observed) < 0)
    joined, out, k = {a for a, _ in chain}, [], 0
    while k < len(places):
        if not sure[k]:
            k += 1
            continue
        j = k
        while j in joined and j + 1 < len(places) and sure[j + 1] and best[j + 1] == best[k] and best[k] in (3, 4):
            j += 1
        if _plausible(int(best[k]) - 1, [text[a:b] for a, b in places[k : j + 1]]):
            out.append((places[k][0], int(best[k]) - 1, places[j][1]))
        k = j + 1
    return out


def search(texts: list[str], field: Field, skips: bool = True) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; without `skips` the field is but a chain. Graphs of several texts are solved together until they have enough nodes."""
    out, waiting, size = [], [], 0
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, []))
        if not _SIGN.search(text):
            continue
        g = graph(text, base)
        waiting.append((i, g))
        size += len(g[0])
        if size >= NODES_AT_ONCE:
            _solve(texts, waiting, out, field, skips)
            waiting, size = [], 0
    if size:
        _solve(texts, waiting, out, field, skips)
    return out


def _solve(texts, waiting, out, field: Field, skips: bool) -> None:
    """Puts the added spans of the waiting graphs into out."""
    scores, chains, far, starts = [], [], [], [0]
    for _, (places, active, observed, chain, skip) in waiting:
        at = starts[-1]
        for fs, seen in zip(active, observed, strict=True):
            scores.append(field.node[fs].sum(0) if seen < 0 else np.where(np.arange(len(LABELS)) == seen, 0.0, -30.0))
        chains += [(at + a, at + b) for a, b in chain]
        far += [(at + a, at + b) for a, b in skip] if skips else []
        starts.append(at + len(places))
    belief = marginals(np.array(scores), np.array(chains, np.int64), np.array(far, np.int64), field.chain, field.skip)
    for (i, (places, _, observed, chain, _)), start in zip(waiting, starts, strict=False):
        out[i][1].extend(added_spans(texts[i], places, observed, belief[start : start + len(places)], chain))


def trained_field(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_tokens: int = TRAIN_TOKENS) -> Field:
    """The field, trained on the rows of docs(text) with the smallest hashes; copies of a text count once."""
    rows = docs.where(F.col("text").rlike(_SIGN_SQL)).select(F.xxhash64("text").alias("h"), "text")
    # the smallest hashes are found among distinct hashes alone, so no task gathers texts and copies crowd nothing out
    least = rows.select("h").distinct().orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    if least is None:
        return train([], np.empty(0, np.int64), np.empty((0, 2), np.int64), np.empty((0, 2), np.int64))
    rows = rows.where(F.col("h") <= least).dropDuplicates(["h"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                active, labels, chain, skips, open_ = training_graph(text, h)
                n = min(len(active), train_tokens)
                back = [[] for _ in range(n)]
                for a, b in skips:
                    if b < n:
                        back[b].append(a)
                follows = {b for _, b in chain}
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(active[:n], pa.list_(pa.int32())), pa.array([-1 if k in open_ else labels[k] for k in range(n)], pa.int32()), pa.array([k in follows for k in range(n)], pa.bool_()), pa.array(back, pa.list_(pa.int32()))], names=["h", "k", "active", "label", "follows", "back"])

    found = rows.mapInArrow(frees(run), "h long, k int, active array<int>, label int, follows boolean, back array<int>").orderBy("h", "k").limit(train_tokens).collect()
    at = {(r["h"], r["k"]): i for i, r in enumerate(x for x in found if x["label"] >= 0)}
    active, labels, chain, skips = [], [], [], []
    for r in found:
        if (me := at.get((r["h"], r["k"]))) is None:
            continue
        active.append(r["active"]), labels.append(r["label"])
        if r["follows"] and (r["h"], r["k"] - 1) in at:
            chain.append((me - 1, me))
        skips += [(at[r["h"], k], me) for k in r["back"] if (r["h"], k) in at]
    return train(active, np.array(labels, np.int64), np.array(chain, np.int64).reshape(-1, 2), np.array(skips, np.int64).reshape(-1, 2))


_SIGN_SQL = r"(?i)[0-9@]|[\[(]at[\])]"
NODES_AT_ONCE = 5_000


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, train_tokens: int = TRAIN_TOKENS) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (spans of the exact patterns), base_sha256, spans, n_added and n_spans (all).

    Spans are kind:start:end in code points, end exclusive, by start and then by kind as listed, joined by commas.
    base_sha256 is the lowercase hex digest of the exact patterns' spans, spans has these and those that the field adds,
    which may also be of the kind secret. Spans of different kinds may overlap. A null text is empty. Rows are searched
    one by one, whole however long, so repeated rows get equal results; an empty table gives an empty result. Other
    columns are ignored, whatever their names. Documents without digits and "@" have no node and cost one look.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    field = trained_field(rows, train_docs, train_tokens)
    schema = T.StructType([rows.schema.fields[0], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("n_spans", T.LongType())])

    def run(batches):
        import pyarrow as pa

        said = lambda spans: ",".join(f"{FOUND[k]}:{a}:{b}" for a, k, b in sorted(spans))
        for batch in batches:
            out = search([t or "" for t in batch.column("text").to_pylist()], field)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in out], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([said(base + more) for base, more in out], pa.string()), pa.array([len(more) for _, more in out], pa.int64()), pa.array([len(base) + len(more) for base, more in out], pa.int64())], names=schema.names)

    return rows.mapInArrow(frees(run), schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
