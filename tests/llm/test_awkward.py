"""Many buckets, repeated and missing ids, empty tables and clashing columns."""

import random

import numpy as np
import pytest

from weftline.llm import bpe, buckets, simhash, substring, suffix
from weftline.llm.queries import tokenizer_path

r = random.Random(12)
WORDS = ["".join(r.choice("aeioutnrs") for _ in range(r.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared = [prose(n) for n in (60, 75, 120, 200)]
    rows = [(i, prose(r.randint(5, 150)) + " " + r.choice(shared) + " " + prose(r.randint(5, 150))) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(12)] + [(i, "ab" * 600 + prose(3)) for i in range(200, 203)] + [(300, "abcde" * 300), (None, shared[3]), (300, "abcde" * 300), (301, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_many_buckets_give_what_one_gives(docs):
    for remove in (suffix.remove_repeats, substring.remove_repeats):
        one, many = (sorted(map(tuple, remove(docs, texts=False, bucket_bytes=b).collect()), key=str) for b in (1 << 23, 6_000))
        assert one == many and sum(x[2] > 0 for x in one) > 20


def test_longest_run_tells_shorter_repeats(spark):
    shared = prose(55)
    rows = [(i, prose(80) + " " + shared + " " + prose(80)) for i in range(2)] + [(5, prose(200))]
    got = {x["doc_id"]: x for x in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=False).collect()}
    assert len(shared) < 400 and got[0]["n_removed"] == got[5]["n_removed"] == 0
    assert got[0]["longest_run"] == got[1]["longest_run"] > 100 > got[5]["longest_run"]


def test_common_first_values():
    g = np.random.default_rng(2)
    lists = sorted(g.integers(0, 3, g.integers(0, 6)).tolist() for _ in range(200))
    flat = np.array([x for a in lists for x in a], np.int64)
    off = np.concatenate([[0], np.cumsum([len(a) for a in lists])])

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert suffix._common(flat, off).tolist() == [common(a, b) for a, b in zip(lists, lists[1:])]


def test_buckets_grow_as_the_root_of_the_corpus():
    n = [buckets.n_buckets(t, 0) for t in (10**13, 4 * 10**13, 16 * 10**13)]
    assert n[1] / n[0] == pytest.approx(2, rel=0.01) and n[2] / n[1] == pytest.approx(2, rel=0.01)
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64))
    sent = buckets.send(3, keys, 1 << 30, lambda s: keys[s].tobytes())
    assert sent.num_rows <= 500 and b"".join(sent["payload"].to_pylist()) == keys.tobytes()


def test_keep_one_loses_no_text(spark):
    a, b, c = prose(40), prose(40), prose(40)
    rows = [(2, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "y"), (None, c, "z"), (None, c, "z"), (None, a, "z"), (7, None, "n"), (8, "", "n")]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(parts)
        got = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
        assert got == sorted([(2, a, "x"), (5, b, "y"), (None, c, "z"), (7, None, "n")], key=str)
        assert simhash.keep_one(df).columns == df.columns
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_merging_side_by_side_is_exact():
    v = bpe.codec(tokenizer_path("byte_bpe_50k.json")).v
    words = [bytes(r.choice(b"aabcdehst 0\xc3\xa9") for _ in range(r.randint(0, 30))) for _ in range(2000)] + [b"aaaa" * k for k in range(1, 70)] + [b"a", b""]
    assert v.merged(words) == [v.exact(w) for w in words]


@pytest.mark.parametrize("rows", [[], [(1, "one text of words", "en", "s", 17, "c"), (1, "another text altogether here", "en", "s", 28, "c"), (None, "one text of words", None, None, None, None), (2, None, None, None, None, None)]])
def test_pipeline_on_awkward_tables(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that nothing holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"] for x in out), key=str) == ([1, 1, 2] if rows else [])
