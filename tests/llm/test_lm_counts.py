"""The counts of the language model do not depend on how the texts are dealt to tasks."""

import numpy as np

from apexframe.llm import mixture

from .cases import FOLDER


def test_counts_are_the_same_in_one_and_many_partitions(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").limit(60).cache()
    one, many = mixture.trained(texts.repartition(1)), mixture.trained(texts.repartition(12))
    assert np.array_equal(one.counts, many.counts)
    assert one.counts.any()
    texts.unpersist()
