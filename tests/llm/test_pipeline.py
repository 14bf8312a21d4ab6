"""The pipeline against its stages done in plain Python, and the registry."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from pathmix.llm import common, registry

from .test_joins import near
from .test_text_operators import contamination, secret_spans


def test_stages_do_what_they_say(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = []
    for _, stage in corpus_pipeline.STAGES:
        rows.append({r["doc_id"]: r for r in docs.collect()})
        docs = common.settle(stage(spark, docs, sf))
    last = {r["doc_id"]: r for r in docs.collect()}
    kept, single, clean, hidden = rows[1], rows[2], rows[3], rows[3 + 1]
    assert set(kept) < set(rows[0]) and all(kept[i] == rows[0][i] for i in kept)
    parts = near([(i, r["text"]) for i, r in kept.items()], width=5)
    assert set(single) == {i for i, (_, c) in parts.items() if i == c}
    items = [tuple(r) for r in common.table(spark, sf, "benchmark").collect()]
    found = contamination([(i, r["text"]) for i, r in single.items()], items)
    assert set(clean) == {i for i, x in found.items() if not x[4]}
    assert set(hidden) == set(clean)
    for i, r in clean.items():
        spans = secret_spans(r["text"])
        assert (hidden[i]["text"] != r["text"]) >= bool(spans)
        assert all(r["text"][a:b] not in hidden[i]["text"] for a, _, b in spans) and hidden[i]["n_chars"] == len(hidden[i]["text"])
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in hidden.items():
        assert np.array_equal(last[i]["ids"], lib.encode(r["text"], add_special_tokens=False).ids)


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_registry(spark):
    names = list(registry.QUERIES)
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(names) <= set(__spark_entry__.queries())
