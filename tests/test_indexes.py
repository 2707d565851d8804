import random

import pytest

from ledgerlens.operators import indexes, retrieval


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(["the", *r.choices(words, weights=[1 / (j + 1) for j in range(200)], k=r.randrange(1, 60))])) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "the the the w3"), (n + 3, "the the the w3"), (n + 4, "rare " * 40)]
    return rows


@pytest.fixture(scope="module")
def lexical(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lexical"))
    docs = spark.createDataFrame(texts(1, 1500), "doc_id long, text string").repartition(3)
    indexes.BLOCK_TEXTS, before = 64, indexes.BLOCK_TEXTS
    indexes.write_lexical(docs, f"{path}/index")
    indexes.BLOCK_TEXTS = before
    return docs, f"{path}/index"


@pytest.mark.parametrize("words", [["w3", "w40"], ["the"], ["the", "w1", "w1", "w150"], ["rare"], ["nothing"], ["nothing", "w7"]])
def test_lexical_index_gives_the_full_scan(spark, lexical, words):
    docs, path = lexical
    got = indexes.search_lexical(spark, path, words, 7).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in retrieval.bm25(docs, words, 7).collect()]


def test_a_query_lists_its_words_files_only(spark, lexical):
    _, path = lexical
    all_files = spark.read.parquet(f"{path}/postings").inputFiles()
    held = indexes.postings(spark, path, ["w3", "w40"])
    assert len(held.inputFiles()) <= 2 < len(all_files) / 4
    assert {r.word for r in held.select("word").distinct().collect()} == {"w3", "w40"}
    assert max(len(r.texts) for r in held.collect()) < 200  # blocks, not lists of all texts


def vectors(seed, n, dim=8):
    r = random.Random(seed)
    mid = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(20)]
    rows = [(i, [m + r.gauss(0, 0.05) for m in mid[i % 20]]) for i in range(n)]
    return rows + [(n, [0.0] * dim), (n + 1, rows[5][1]), (n + 2, [2 * x for x in rows[5][1]])]


def test_vector_index_gives_the_full_scan(spark, tmp_path):
    """The same rows, with ties and a vector of length zero, from a part of the clusters."""
    rows = vectors(2, 900)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    indexes.write_vectors(df, f"{tmp_path}/index")
    shares = []
    for query in (rows[5][1], rows[17][1], [1.0] + [0.0] * 7, [0.0] * 8):
        for k in (1, 10, 60):
            got, share = indexes.search_vectors(spark, f"{tmp_path}/index", query, k)
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in retrieval.cosine(df, query, k).collect()]
            shares.append(share)
    assert min(shares) < 0.3 and max(shares[-3:]) == 1


def test_vector_index_of_few(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    indexes.write_vectors(df, f"{tmp_path}/one")
    assert [tuple(r) for r in indexes.search_vectors(spark, f"{tmp_path}/one", [2.0, 0.0], 5)[0].collect()] == [(1, 1.0)]
