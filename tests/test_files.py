"""Files made from texts, and the queries over many of them."""

from inkveil.plans import source_queries as Q


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_each_row_is_a_file_whatever_its_id(spark, tmp_path):
    folder = documents(spark, tmp_path, [(1, "a"), (1, "b"), (2, None), (None, "c"), (-3, "d"), (4, "x" * 4000)])
    got = sorted((str(r.doc_id), r.length, r.error_code, r.content) for r in Q.read_files(spark, folder).collect())
    assert got == [
        ("-3", 2, None, "d\n"), ("1", 2, None, "a\n"), ("1", 2, None, "b\n"), ("2", 1, None, "\n"), ("4", 4001, "TOO_LARGE", None), ("None", 2, None, "c\n"),
    ]


def test_many_small_files_go_to_few_tasks(spark, tmp_path):
    folder = documents(spark, tmp_path, [(i, "a") for i in range(2000)])
    assert Q.read_files(spark, folder).rdd.getNumPartitions() < 40
