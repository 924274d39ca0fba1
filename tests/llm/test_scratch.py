import os

import corpus_pipeline
from helpers import SF_SMALL, documents
from parcelrisk.llm import packing, simhash
from parcelrisk.llm.common import scratch_scope, written
from parcelrisk.llm.queries import WORD_BPE, tokenizer_file
from parcelrisk.session import checkpoint_dir


def tables(spark):
    folder = checkpoint_dir(spark).replace("file:", "") + "/scratch"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_a_scope_deletes_what_operators_wrote(spark):
    docs = documents(spark, ["a b c d", "a b c d", "x"])
    kept = written(docs, "kept")
    before = tables(spark)
    with scratch_scope(spark):
        n = len(simhash.near_duplicates(docs).collect())
        with scratch_scope(spark):
            assert len(packing.pack_documents(docs, tokenizer_file(WORD_BPE)).collect()) == 3
        assert len(tables(spark) - before) >= 1
    assert n == 3 and tables(spark) == before and kept.count() == 3


def test_the_pipeline_leaves_the_last_stage_only(spark):
    before = tables(spark)
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0
    left = {name.rsplit("-", 1)[0] for name in tables(spark) - before}
    assert left <= {"pipeline-decontamination", "packing-lengths"}
