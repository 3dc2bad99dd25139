"""Units are aligned once for the whole corpus, and meet their blocks packed."""

import public_tokenizers
from pyspark.sql import functions as F
from tessera.llm import common, token_alignment

BYTE, PIECE = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_a_unit_of_many_blocks_is_aligned_once(spark, prose):
    docs = spark.createDataFrame([(k, prose(k % 3, 60)) for k in range(60)] + [(100, None), (101, "")], "doc_id long, text string").repartition(3)
    cut = common.Scratch(spark, "test").keep(token_alignment.blocks(docs, 1500), "cut")
    n_blocks = cut.select("block").distinct().count()
    n_units = cut.where("text <> ' '").select("text").distinct().count()  # that of an empty text, a space, does not come back
    texts = cut.where("unit IS NOT NULL").select("text").repartition(common.partitions(spark), "text").distinct()
    made = token_alignment.aligned(token_alignment.tokens(texts, BYTE, PIECE)).persist()
    assert n_blocks > 3 and made.count() == n_units < cut.where("text IS NOT NULL").count() / 3
    held = made.select("text", F.array_distinct(F.col("pairs")["pair"]).alias("pairs"))
    assert token_alignment.by_block(spark, cut, held).count() <= n_blocks * (common.partitions(spark) + 1) < cut.count()
    made.unpersist()
