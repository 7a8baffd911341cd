import numpy as np

from inkveil.llm.quality import grow, keep_good, quality_scores, statistics


def test_trees_walk_as_by_hand():
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = grow(x, y, trees=20, depth=3)
    bins = forest.binned(x)

    def walk(row):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] + (bins[row, forest.feature[node]] > forest.bin[node])
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    got = forest.probability(x)
    assert np.allclose(got, [walk(k) for k in range(len(x))])
    assert ((got > 0.5) == y).mean() > 0.97


def test_constant_without_both_labels():
    assert np.allclose(grow(np.zeros((0, 3)), np.zeros(0)).probability(np.ones((2, 3))), 0.5)
    assert (grow(np.ones((5, 3)), np.ones(5)).probability(np.ones((2, 3))) > 0.8).all()


def test_statistics_by_text():
    texts = [b"", b"a", "The cat. The CAT! 12 é\n".encode(), b"x " * 50_000, b" \n "]
    whole = statistics(texts)
    assert np.isfinite(whole).all()
    assert np.allclose(whole, np.concatenate([statistics([t]) for t in texts]))


def test_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scores = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(scores) > 50
    assert (scores.predicted == scores.quality).mean() > 0.95
    kept = {r.doc_id for r in keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in quality_scores(docs, labels).where("predicted = 1").collect()}


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    key = lambda r: r.doc_id
    assert sorted(quality_scores(docs, labels).collect(), key=key) == sorted(quality_scores(docs, turned).collect(), key=key)


def test_sample_is_bounded_before_it_is_sorted(spark):
    """Of many labels only about the sample is looked at; both ways to fit choose the same rows."""
    from pyspark.sql import functions as F

    from inkveil.llm.quality import fit, keep_good, measured, quality_scores, training_labels

    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "Some plain words stand here and there.").otherwise("x9 {} 77 ;; == 0x1").alias("text"),
    )
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("quality"))
    label = training_labels(docs.select("doc_id"), labels, 300)
    assert 1000 < label.count() < 1700
    assert training_labels(docs.select("doc_id"), labels, 10_000).count() > 4000
    kept = {r.doc_id for r in keep_good(docs, labels, sample=300).collect()}
    assert kept == {r.doc_id for r in quality_scores(docs, labels, sample=300).collect() if r.predicted}
    assert kept == set(range(0, 6000, 2))
    found = measured(docs)
    assert (fit(found, label, 300).probability(np.zeros((1, len(found.first().statistics)))) == fit(found.repartition(9), label, 300).probability(
        np.zeros((1, len(found.first().statistics))))).all()
