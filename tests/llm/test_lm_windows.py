"""The training windows of op1 cover every training document, and scores hardly depend on the buckets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import lm
from weftline.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


def test_windows_cover_whole_documents():
    cutter = lm.pieces(PATH, lm.SUBWORDS)
    texts = [None, "one", "a b c " * 3000, "", "the end of it " * 7]
    table = pa.table({"doc_id": pa.array(range(5), pa.int64()), "text": texts})
    t, train = lm._Text(table, cutter), lm._training(lm._with_fold(table))
    ids, context, offsets = t.stream(0, 5, cutter.end)
    want = [(context[i - 1], ids[i]) for d in range(5) if train[d] for i in range(offsets[d] + 1, offsets[d + 1])]
    got = []
    for turn in range(lm.ROUNDS):
        x, c = lm._windows(t, train, cutter.end, turn)
        got += [(a, b) for a, b in zip(c.ravel(), x[:, 1:].ravel()) if b >= 0]
    assert train[2] and sorted(got) == sorted(want)


def test_buckets_hardly_change_scores(spark):
    r = random.Random(8)
    words = ["".join(r.choice("aeioutnrs") for _ in range(r.randint(1, 7))) for _ in range(200)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(50, 400)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({x["doc_id"]: x for x in lm.score(docs, PATH, bucket_bytes=b).collect()} for b in (lm.BUCKET_BYTES, 40_000))
    tokens = sum(x["n_tokens"] for x in one.values())
    assert [one[i]["base_score"] for i in one] == pytest.approx([many[i]["base_score"] for i in one])
    assert sum(one[i]["score"] for i in one) / tokens == pytest.approx(sum(many[i]["score"] for i in one) / tokens, abs=0.05)
    held = [x for x in one.values() if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held) - 0.05 * tokens
