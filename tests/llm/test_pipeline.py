"""The whole pipeline against plain versions of its stages."""

import re

import corpus_pipeline
from test_llm_text import SF, brute_components, brute_contamination, lower
from tokenizers import Tokenizer

from symloom.llm import queries


def test_pipeline(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    first = {}
    for i, t in docs:
        first.setdefault(lower(t), i)
    docs = [(i, t) for i, t in docs if first[lower(t)] == i]
    roots = brute_components([t for _, t in docs], 5, 80)
    docs = [d for k, (d, (_, root)) in enumerate(zip(docs, roots, strict=True)) if root == k]
    hits = brute_contamination([t for _, t in docs], items, 10)
    docs = [d for d, (_, hit, _) in zip(docs, hits, strict=True) if not hit]
    plain = Tokenizer.from_file(queries.tokenizer_path())
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    assert sum(r["length"] for r in got) == sum(want.values())
