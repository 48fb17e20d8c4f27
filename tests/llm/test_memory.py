"""Workers are reused, so a task must not leave its tables behind in them."""

import gc

import pyarrow as pa

from studylens.llm import packing


def test_packing_leaves_no_vocabulary_in_the_workers(spark, docs):
    import public_tokenizers

    def left(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(o).__name__ == "WordCodec" for o in gc.get_objects())]})

    packing.token_pieces(docs([(i, "some words") for i in range(9)]), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json")).count()
    found = spark.range(64).repartition(16).mapInArrow(left, "n long").collect()
    assert found and sum(r.n for r in found) == 0
