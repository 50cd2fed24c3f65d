"""Columns of the caller that bear names which the operators use inside: no stage may trip over them or change them."""

import random

import pytest

from loomwork.llm import decontaminate, mixing, near_dup, quality, token_files

NAMES = (
    "kept n_words word_chars n_symbols n_dup_lines n_repeat_words n_grams log_ppl low high base_failed band text_key nll row h n rows lang_key "
    "size place full low1 high1 low2 high2 shard shards source_size target taken begin end ranges weight quota no _no _s _h _a _b _c _source _size _place _text _row "
    "fp label cid gid key bands sketch component_id rep head chunk _fp _label _component "
    "hit items n_hit n_items contaminated items_sha256 _hit _items tie start n_tokens ids_crc32 _keep_text _band _lang _text_key"
).split()


def documents(spark):
    rnd = random.Random(3)
    vocabulary = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}" for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(50, 80))), rnd.choice(["en", None]), rnd.choice(["a", "b", None])) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "a") for i in range(5)] + [(5, None, None, None), (None, "", "en", "b"), (None, rows[7][1], None, None)]
    return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, x int").repartition(3)


STAGES = {
    "quality": lambda d, b: quality.filter_quality(d),
    "near_dup": lambda d, b: near_dup.one_of_each(d),
    "decontaminate": lambda d, b: decontaminate.drop_contaminated(d, b),
    "mixing": lambda d, b: mixing.mixed_documents(d),
    "token_files": lambda d, b: token_files.token_output(d),
}


@pytest.mark.parametrize("stage", STAGES)
def test_clashing_names(spark, stage):
    docs = documents(spark)
    bench = spark.createDataFrame([(1, " ".join(docs.where("doc_id = 3").first()["text"].split()[:12]))], "item_id long, text string")
    clash = docs.select("*", *[(docs["x"] + i).alias(n) for i, n in enumerate(NAMES)])
    own = ["doc_id", "text", "lang", "source"]
    want, got = STAGES[stage](docs, bench), STAGES[stage](clash, bench)
    if stage == "token_files":
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        return
    assert got.columns == clash.columns and want.columns == docs.columns
    rows = got.collect()
    assert sorted((tuple(r[c] for c in own) for r in rows), key=repr) == sorted((tuple(r[c] for c in own) for r in want.collect()), key=repr) and rows
    assert all(r[n] == 7 + i for r in rows for i, n in enumerate(NAMES))
