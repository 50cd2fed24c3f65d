"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A data set is a folder of numbered pairs of files, in ascending order of documents:

* NNNNNN.ids: the token ids of all documents of the part, one after another, little-endian unsigned 16-bit integers if
  the vocabulary allows it, else 32-bit. Nothing else, so it can be mapped into memory as an array.
* NNNNNN.idx: the magic b"TOKIDX01", the width of an id in bytes and the number of documents n as 64-bit integers, n + 1
  offsets in tokens, and n document ids, all little-endian 64-bit; a null document id is the smallest 64-bit integer.

The position of a part in the whole is the prefix sum of the tokens of the parts before it; only one line for each part
reaches the driver. A part is written under a name of its attempt and the manifest names the attempt that Spark kept, so
lost executors and speculative copies leave at most files that nobody reads.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, frees, table

MAGIC = b"TOKIDX01"
END_ID = 2
PART_CHARS = 16_000_000  #: About so many bytes of UTF-8 text go into one part.
NULL_ID = -(2**63)
TEXTS_AT_ONCE = 8_000_000  #: About so many bytes of text are encoded at once: pieces that occur again among them cost nothing.


def _are(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of bytes: True for those in the ranges, whose ends belong to them."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: White space of one byte; the first and the last bytes of any longer one; letters of one byte; first bytes of two that are letters with any second (0xC3 has two exceptions); signs.
_WHITE = _are((9, 13), (28, 32))
_WHITE_LEADS, _WHITE_ENDS = _are((0xC2, 0xC2), (0xE1, 0xE3)), _are((0x80, 0x8A), (0x9F, 0xA0), (0xA8, 0xA9), (0xAF, 0xAF))
_LETTERS, _LETTER_LEADS = _are((65, 90), (97, 122)), _are((0xC4, 0xC7), (0xD0, 0xD1))
_SIGNS = _are((33, 47), (58, 64), (91, 96), (123, 126))
_SPACE_LETTER, _LINE_LETTER = "\u0120", "\u010a"  #: How byte-level BPE writes a space and a line feed.
WORDS_AT_ONCE = 20_000
REMEMBERED = 250_000  #: Beyond so many pieces a new generation begins; what the last one held is kept for one more, and longer if it occurs again.
LONGEST = 100  #: Longer pieces are not remembered, so that the memory is bounded in bytes too.


def _cuts(data: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Where the UTF-8 bytes of texts can be cut, besides between texts, so that byte-level BPE gives for the pieces what it gives for the whole.

    Its pattern surely begins a match at a space or line feed behind what is no white space, behind such a line feed if no
    white space follows, and at a sign behind a letter; and the match before ends alike if nothing follows. `signs` is a table of
    the signs that count. What is not sure (some white space has several bytes) is not cut.
    """

    def solid(at):  # the character that ends here is no white space
        last = data[at]
        return ~(_WHITE[last] | _WHITE_ENDS[last] & (_WHITE_LEADS[data[np.maximum(at - 1, 0)]] | _WHITE_LEADS[data[np.maximum(at - 2, 0)]]))

    spaces, lines, others = (np.flatnonzero(x) + 1 for x in (data[1:] == 32, data[1:] == 10, signs[data[1:]]))
    spaces, lines = spaces[solid(spaces - 1)], lines[solid(lines - 1)]
    behind = lines[lines < len(data) - 1] + 1
    behind = behind[~(_WHITE | _WHITE_LEADS)[data[behind]]]
    last, first = data[others - 1], data[np.maximum(others - 2, 0)]
    others = others[_LETTERS[last] | (last >= 0x80) & (_LETTER_LEADS[first] | (first == 0xC3) & (last != 0x97) & (last != 0xB7))]
    return np.concatenate([spaces, lines, behind, others])


def encoder(path: str):
    """(width of an id in bytes, a function from texts, a list or an Arrow array, to their ids as bytes of little-endian unsigned integers): what Tokenizer.encode(text, add_special_tokens=False) gives.

    A byte-level BPE file without normalizer, prefix space or truncation splits a text at spaces, line feeds and signs that
    _cuts() finds, whatever else stands around. So the texts are cut there, by views on their bytes, and Arrow numbers the
    distinct pieces; the library encodes each distinct piece that is not remembered, many in one text, where a token that
    begins with a space begins a piece, or a line feed stands between two; and Arrow puts the ids of all pieces together.
    For any other file, texts are encoded as they stand.
    """
    import json
    import os

    import pyarrow as pa

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    spec = json.loads(tok.to_str())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    local = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
    local = local and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    added = "".join(x["content"] for x in spec.get("added_tokens", []))
    local = local and not {" ", "\n"} & set(added) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec.get("added_tokens", []))
    vocabulary = tok.get_vocab()
    size = max([END_ID, *vocabulary.values()]) + 1
    width = 2 if size <= 2**16 else 4
    dtype = f"<u{width}"
    opens = np.zeros(size, bool)
    opens[[i for t, i in vocabulary.items() if t.startswith(_SPACE_LETTER)]] = True
    line = vocabulary.get(_LINE_LETTER, -1)
    signs = _SIGNS.copy()
    signs[[x for x in added.encode() if x < 128]] = False  # an added token is never cut

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}

    def learn(pieces: list[str]) -> None:
        """Remembers the ids of the pieces. Those that could run into others, and all where tokens and pieces disagree, are encoded apart."""
        spaced, bare, odd = [], [], []
        for p in pieces:
            if p[-1].isspace():
                odd.append(p)
            elif p[0] == " ":
                (odd if p[1].isspace() or " " in p[1:] else spaced).append(p)
            else:
                (odd if p[0].isspace() or "\n" in p else bare).append(p)
        for i in range(0, len(spaced), WORDS_AT_ONCE):
            part = spaced[i : i + WORDS_AT_ONCE]
            got = ids(["".join(part)])[0]
            at = np.flatnonzero(opens[got])
            if len(at) != len(part):
                odd += part
                continue
            raw, cuts = got.tobytes(), (np.append(at, len(got)) * width).tolist()
            known.update(zip(part, [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], strict=True))
        for i in range(0, len(bare), WORDS_AT_ONCE):
            part = bare[i : i + WORDS_AT_ONCE]
            got = ids(["\n".join(part)])[0]
            at = np.flatnonzero(got == line)
            if len(at) != len(part) - 1:
                odd += part
                continue
            raw, begin, end = got.tobytes(), (np.append(0, at + 1) * width).tolist(), (np.append(at, len(got)) * width).tolist()
            known.update(zip(part, [raw[x:y] for x, y in zip(begin, end, strict=True)], strict=True))
        known.update(zip(odd, [x.tobytes() for x in ids(odd)], strict=True))

    def encode(texts):
        nonlocal known, before
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not local:
            return [x.tobytes() for x in ids(texts.to_pylist())]
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        starts = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
        if starts[0] == starts[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0] : starts[-1]]
        begins = np.zeros(len(data) + 1, bool)
        begins[_cuts(data, signs)] = True
        begins[starts - starts[0]] = True
        at = (np.flatnonzero(begins) + starts[0]).astype(kind)
        coded = pa.Array.from_buffers(texts.type, len(at) - 1, [None, pa.py_buffer(at), texts.buffers()[2]]).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(known) > REMEMBERED:
            before, known = known, {}
        unknown = []
        for p in pieces:
            if p not in known:
                if p in before:
                    known[p] = before[p]
                else:
                    unknown.append(p)
        learn(unknown)
        values = list(map(known.__getitem__, pieces))
        for p in unknown:
            if len(p) > LONGEST:
                del known[p]
        ends = np.zeros(len(values) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // width, out=ends[1:])
        taken = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), dtype))).take(coded.indices)
        cuts = (taken.offsets.to_numpy()[np.searchsorted(at, starts)] * width).tolist()
        raw = memoryview(taken.values.to_numpy()).cast("B")
        return [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    return width, encode


def worker_encoder(path: str):
    """The encoder of this process. Workers serve many tasks, and each tokenizer that is built anew leaves some memory behind."""
    import sys
    import types

    kept = sys.modules.setdefault("_loomwork_worker", types.ModuleType("_loomwork_worker"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, encoder(path)
    return kept.encoder


def _files(folder: str):
    """(file system, path) of a folder named by a URI or a path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (fs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, part_chars: int = PART_CHARS) -> list[dict]:
    """Encodes all texts, ends each with end_id, and writes them in ascending order of ids. Returns the manifest: a dict for each part, with its base; it is also written to the folder, as manifest.json.

    A null text is empty. Ids are 64-bit integers; what can't be cast to one counts as null. Null ids come first; rows of
    one id are ordered by their text, and equal rows are written as often as they stand. Texts of any length are encoded
    whole. An empty table gives no part. Other columns are not written, whatever their names.
    """
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"]
    if not held:
        return _manifest(folder, [])
    parts = max(1, -(-int(held) // part_chars))
    # ordered by id, then by a hash of the text, so that rows of one id can be dealt to several parts
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        fs, root = _files(folder)
        name, sink, offsets, docs_seen = f"{part:06d}-{attempt}", None, [0], []
        for batch in _gathered(batches):
            if sink is None:
                width, encode = worker_encoder(tokenizer)
                end = end_id.to_bytes(width, "little")
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}.ids")
            ids, got = batch.column("doc_id").to_pylist(), encode(batch.column("text"))
            for x in got:
                offsets.append(offsets[-1] + len(x) // width + 1)
                sink.write(x)
                sink.write(end)
            docs_seen += [NULL_ID if x is None else x for x in ids]
        if sink is not None:
            sink.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(MAGIC + np.array([width, len(docs_seen)], "<i8").tobytes() + np.array(offsets, "<i8").tobytes() + np.array(docs_seen, "<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": len(docs_seen), "n_tokens": offsets[-1]}])

    run.keeps = True
    made = ordered.drop("tie").mapInArrow(frees(run), "part long, name string, n_docs long, n_tokens long").collect()  # one row for each part
    base, manifest = 0, []
    for r in sorted(made, key=lambda r: r["part"]):
        manifest.append(r.asDict() | {"base": base})
        base += r["n_tokens"]
    return _manifest(folder, manifest)


def _manifest(folder: str, manifest: list[dict]) -> list[dict]:
    import json

    fs, root = _files(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def open_manifest(folder: str) -> list[dict]:
    """The manifest that write_token_files left in a folder."""
    import json

    fs, root = _files(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _gathered(batches):
    """Batches, joined until they hold enough text."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= TEXTS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def open_part(folder: str, name: str):
    """(document ids, offsets, ids) of a part; the ids are mapped into memory where the folder is local, and offsets are in tokens from the part's start."""
    fs, root = _files(folder)
    with fs.open_input_file(f"{root}/{name}.idx") as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{name}.idx has no such format")
    width, n = np.frombuffer(raw, "<i8", 2, 8)
    offsets, ids = np.frombuffer(raw, "<i8", n + 1, 24), np.frombuffer(raw, "<i8", n, 24 + 8 * (n + 1))
    dtype = {2: "<u2", 4: "<u4"}[int(width)]
    if type(fs).__name__ == "LocalFileSystem":
        tokens = np.memmap(f"{root}/{name}.ids", dtype, "r") if offsets[-1] else np.empty(0, dtype)
    else:
        with fs.open_input_file(f"{root}/{name}.ids") as f:
            tokens = np.frombuffer(f.read(), dtype)
    return ids, offsets, tokens


def read_token_files(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts the tokens of all documents before it."""
    kind = "part long, name string, n_docs long, n_tokens long, base long"
    parts = spark.createDataFrame([tuple(m[k] for k in ("part", "name", "n_docs", "n_tokens", "base")) for m in manifest], kind)
    parts = parts.repartition(max(1, len(manifest)), "part") if manifest else parts

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for m in batch.to_pylist():
                ids, offsets, tokens = open_part(folder, m["name"])
                for i in range(0, len(ids), 5000):
                    j = min(i + 5000, len(ids))
                    cut = [tokens[a:b] for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in cut]
                    yield pa.RecordBatch.from_arrays([pa.array([None if x == NULL_ID else x for x in ids[i:j].tolist()], pa.int64()), pa.array(offsets[i:j] + m["base"]), pa.array(np.diff(offsets[i : j + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.mapInArrow(frees(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def token_output(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Writes docs as token files, by default in the shared folder, and reads them back: see write_token_files and read_token_files."""
    folder = folder or Scratch(docs.sparkSession, "tokens").path("files")
    manifest = write_token_files(docs, folder, tokenizer or default_tokenizer(), **options)
    return read_token_files(docs.sparkSession, folder, manifest)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
