"""Single stages of the pipeline on planted documents."""

import pytest

import corpus_pipeline

ITEM = "what is the boiling point of water at the top of the highest mountain on earth"


@pytest.fixture(scope="module")
def benchmark_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    other = "name the three largest rivers of the continent in the order of their length from source to mouth"
    spark.createDataFrame([(1, ITEM), (2, other)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_a_document_with_a_single_benchmark_item_is_dropped(spark, benchmark_dir):
    rows = [
        (1, f"before it {ITEM} and after it"),
        (2, " ".join(ITEM.split()[:8])),  # one window
        (3, " ".join(ITEM.split()[:7])),  # less than a window
        (4, "nothing of the kind"),
        (5, None),
    ]
    kept = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), benchmark_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_near_copies_by_similarity_are_dropped(spark):
    words = [f"w{i}" for i in range(100)]
    changed = [*words[:50], "other", *words[51:]]  # 91 of 101 five-word shingles shared
    apart = [w if i % 12 else f"x{i}" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(apart)), (4, None), (5, " "), (6, "one two"), (7, "ONE two")]
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]
