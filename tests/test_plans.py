"""What the plans must and must not hold."""

import re

import pytest

from inkstone.plans import files, models, reference, training

MODULES = (reference, files, models, training)
QUERIES = {name: q for m in MODULES for name, q in m.queries().items()}
#: Queries that need Python: vocabulary look-ups, generation, the tokenizer, dense arrays.
PYTHON = {"encode_docs", "decode_docs", "generate", "training_batches", "model_logits", "prototype_logits", "greedy_ids", "p4_found", "p4_plain", "p6_found", "p6_key_totals"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products_and_no_needless_python(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|CollectLimit", text)
    assert bool(re.search("MapInArrow|MapInPandas", text)) <= (name in PYTHON)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("rejection_counts", {"rec_id", "paragraphs"}),
        ("low_count_tally", {"source_file", "rec_pos", "author", "rhythmic", "baidu", "so360", "bing", "bing_en", "google"}),
        ("p4_found", {"rec_id", "paragraphs"}),
        ("dataset_union_exclude", {"doc_id", "source"}),
        ("total_chars", {"text"}),
        ("decode_argmax", {"vec_id", "embedding"}),
    ],
)
def test_only_needed_columns_are_read(spark, small, name, columns):
    read = set()
    for schema in re.findall(r"ReadSchema: struct<(.*)>", plan(QUERIES[name](spark, small))):
        read |= {f.split(":")[0] for f in re.findall(r"\w+:", schema) for f in [f]}
    assert read - {"element"} <= columns


def test_filters_reach_the_scan(spark, small):
    assert re.search(r"PushedFilters: \[IsNotNull\(rec_id\)", plan(QUERIES["p4_found"](spark, small)))
    assert re.search(r"PushedFilters: \[[^\]]*source", plan(QUERIES["dataset_union_exclude"](spark, small)))


@pytest.mark.parametrize("name", ["char_windows", "window_grid"])
def test_windows_shuffle_no_texts(spark, small, name):
    """Below every exchange of the plan texts are either not there or cut down to the pieces of the windows."""
    text = plan(QUERIES[name](spark, small))
    assert "_piece" in text and not re.search(r"Exchange hashpartitioning\(block", text)
