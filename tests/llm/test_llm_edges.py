"""Copies on the curve, buckets read back, columns of any name, memory given back."""

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from symloom.llm import blocks, decontaminate, hilbert, language, packing, queries

SF = "/root/testdata/sf0.001"
CLASHES = ["row", "best", "score", "set", "letter", "__text", "__best", "words", "hit", "bits", "items", "matches", "__hit", "__words", "a.b", "odd `name`"]


def test_copies_are_one_run_of_the_curve(spark):
    rows = [(k, f"text {k % 90}" * (k % 90), ["x", "y", None][k % 3], f"s{k % 7}", k % 11) for k in range(400)]
    rows += [(1000 + k, None if k % 2 else "", None, "s1", k) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    plan = hilbert.shard_plan(docs, ["lang", "source", "n_chars"], shards=40).collect()
    counts = collections.Counter(r["shard"] for r in plan)
    assert len(plan) == 430 and max(counts.values()) - min(counts.values()) <= 1
    place = {r["doc_id"]: (r["shard"], r["slot"]) for r in plan}
    order = {i: k for k, i in enumerate(sorted(place, key=place.get))}
    text = {r[0]: r[1] or "" for r in rows}
    groups = collections.defaultdict(list)
    for i, t in text.items():
        groups[t].append(order[i])
    # every group of equal texts is a run without gaps, in order of the ids
    for t, places in groups.items():
        assert sorted(places) == list(range(min(places), min(places) + len(places)))
        ids = [i for i in sorted(place, key=place.get) if text[i] == t]
        assert ids == sorted(ids)
    # 40 shards have 39 ends, so no more groups than that can be cut
    cut = sum(len({place[i][0] for i in text if text[i] == t}) > 1 for t in groups)
    assert cut <= 39


def test_plan_equals_a_plain_sort(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = hilbert.shard_plan(docs, ["lang", "source", "n_chars"], shards=7).collect()
    rows = sorted(plan, key=lambda r: (r["shard"], r["slot"]))
    curve = [r["curve"] for r in rows]
    assert curve == sorted(curve)
    n = len(rows)
    assert [r["shard"] for r in rows] == [k * 7 // n for k in range(n)]


def test_buckets_are_read_back(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    pieces = packing.pack_documents(docs, queries.tokenizer_path(), full=256)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    whole = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in pieces.collect()}
    back, numbers = {}, {}
    for bits in range(9):
        rows = packing.read_bucket(spark, str(tmp_path / "buckets"), 1 << bits).collect()
        assert all(len(r["ids"]) == 4 << bits and r["offset"] == 0 for r in rows)
        back.update({(r["doc_id"], r["start"]): bytes(r["ids"]) for r in rows})
        numbers[bits] = [r["sequence_id"] for r in rows]
        assert len(set(numbers[bits])) == len(rows)
    assert back == whole
    assert packing.read_bucket(spark, str(tmp_path / "buckets"), 512).count() == 0
    filled = [numbers[b] for b in range(9) if numbers[b]]
    assert all(max(a) < min(b) for a, b in zip(filled, filled[1:]))


def test_words_without_one_closing_token(monkeypatch):
    tokens = packing.WordTokens(queries.tokenizer_path())
    texts = ["hello there, World", "it's 42 o'clock"]
    want, cut = tokens.encode(texts)
    other = packing.WordTokens(queries.tokenizer_path())
    other.closes[:] = False
    got, bounds = other.encode(texts)
    assert got.tolist() == want.tolist() and bounds.tolist() == cut.tolist()


def test_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})
    model = language.train(docs)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() > 0
    assert kept.filter("`__best` <> 6 OR `row` <> 0 OR `odd ``name``` <> 15").count() == 0
    found = language.identify(docs, model)
    assert set(found.columns) == set(docs.columns) | {"__best", "__score", "__set"} and found.count() == 60
    items = spark.createDataFrame([("q1", " ".join(docs.first()["text"].split()[:12])), ("q2", None)], "item_id string, text string")
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and 0 < clean.count() < 60
    assert clean.filter("hit <> 8 OR `__hit` <> 12").count() == 0
    told = decontaminate.find_contamination(docs, items)
    assert set(told.columns) == set(docs.columns) | {f"__{n}" for n in decontaminate.FOUND}
    bare = decontaminate.find_contamination(docs.select("doc_id", "text"), items, with_matches=False)
    with_spans = {r["doc_id"]: r for r in told.collect()}
    for r in bare.collect():
        full = with_spans[r["doc_id"]]
        assert (r["__words"], r["__hit"], r["__bits"], r["__items"]) == (full["__words"], full["__hit"], full["__bits"], full["__items"])
        assert r["__matches"] == [] and bool(full["__matches"]) == (full["__hit"] > 0)


def test_a_prompt_that_many_items_share(spark):
    prompt = "answer the next question with one word and give no reason"
    items = spark.createDataFrame([(f"q{k}", f"{prompt} item{k} tail{k}") for k in range(300)], "item_id string, text string")
    texts = [f"{prompt} " * 40, f"before {prompt} item7 tail7 after", "answer the next question with no word", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, items, with_matches=False).collect()}
    size = len(prompt.split())
    assert [len(got[k]["__items"]) for k in range(4)] == [300, 300, 0, 0]
    assert [got[k]["__hit"] for k in range(4)] == [40 * size, size + 2, 0, 0]


def test_memory_is_given_back():
    blocks.powers(1000)
    assert blocks._powers
    out = list(blocks.released(lambda batches: (b for b in batches))([pa.array([1])]))
    assert len(out) == 1 and not blocks._powers
    assert np.array_equal(blocks.powers(5)[0][:1], np.ones(1, np.uint64))
