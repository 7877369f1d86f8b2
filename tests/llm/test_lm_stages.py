"""The fast steps of op1 against plain ones, and what each stage of op1 does to the scores."""

import random

import numpy as np
import pytest

from weftline.llm import attention, lm, textbuf
from weftline.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


def test_sums_of_subwords():
    g = np.random.default_rng(4)
    for n in (1, 7, 8, 9, 3000):
        which, rows = g.integers(0, 40, n) ** 2 // 40, np.vstack([g.normal(size=(n, 6)), np.zeros((1, 6))]).astype(np.float32)
        want = np.zeros((50, 6))
        np.add.at(want, which, rows[:-1])
        assert attention._sums(rows, which, 50) == pytest.approx(want, abs=1e-4)


def test_order_of_keys_that_share_their_first_bits():
    g = np.random.default_rng(5)
    few = g.integers(0, 50, 4000).astype(np.uint64)
    for keys in (few, few << np.uint64(40), g.integers(0, 1 << 63, 4000).astype(np.uint64), ~few, few[:0], few[:1], few[:2]):
        assert np.array_equal(textbuf.sorted_order(keys), np.argsort(keys, kind="stable"))


def test_pieces_are_longest_matches():
    import base64

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(b): int(r) for b, r in map(bytes.split, f)}
    cutter = lm.Pieces(PATH)
    r = random.Random(6)
    words = [b" the", b"\0\0\0\0\0\0\0\0\0", b" \0the\0\0", "é日本\U0001f600".encode(), *[bytes(r.choice(b" theinga\0\xff") for _ in range(r.randint(1, 30))) for _ in range(300)]]
    cuts = np.cumsum([0, *map(len, words)])
    ids, at = cutter.cut(np.frombuffer(b"".join(words), np.uint8), cuts[:-1], cuts[1:])
    for i, word in enumerate(words):
        want = []
        while word:
            size = max(k for k in range(1, min(lm.LONGEST, len(word)) + 1) if ranks.get(word[:k], cutter.end) < cutter.end)
            want.append(ranks[word[:size]])
            word = word[size:]
        assert ids[at[i] : at[i + 1]].tolist() == want


def test_every_stage_reaches_the_scores(spark, monkeypatch):
    """Without the training of the attention, or without the subwords' counts, every text's score is another, and held-out texts' are worse."""
    r = random.Random(9)
    words = ["".join(r.choice("aeioutnrs") for _ in range(r.randint(1, 7))) for _ in range(200)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words[: 20 * (1 + i % 10)]) for _ in range(300))) for i in range(200)], "doc_id long, text string")

    def scores():
        return {x["doc_id"]: x for x in lm.score(docs, PATH).collect()}

    whole = scores()
    with monkeypatch.context() as m:
        m.setattr(lm, "_trained", lambda rows, base, path, v: attention.fresh(v))
        untrained = scores()
    with monkeypatch.context() as m:
        of = attention.Counts.of
        m.setattr(attention.Counts, "of", classmethod(lambda cls, counts: of(np.zeros_like(counts))))
        uncounted = scores()
    for other in (untrained, uncounted):
        assert all(whole[i][c] != other[i][c] for i in whole for c in ("score", "attention_score"))
        assert sum(x["attention_score"] - other[i]["attention_score"] for i, x in whole.items() if x["held_out"]) > 0
