"""Packing, language, decontamination and duplicates against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import decontaminate, exact_dedup, language, near_dedup, packing, queries

SF = "/root/testdata/sf0.001"
WEIRD = ["", None, "   ", "a", "A", "don't we're 'x ''s", "É é ß İ 日本", "x" * 30000, "word " * 9000, "\t\n", "a\x85b\xa0c", "<|endoftext|> x"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"id": F.lit("x"), "node": F.lit(1), "lang": F.lit(None).cast("string"), "n": F.lit(2), "sha": F.lit(b"q")}) if extra else df


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()] + WEIRD


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, texts, keep):
    texts = texts + texts[:50] + ["SAME text"] * 70 + ["same TEXT"] * 30
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)  # runs of several batches
    try:
        rows = exact_dedup.exact_dedup(frame(spark, texts, True).repartition(3), keep=keep, fan_bits=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["doc_id"]: r for r in rows}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        winner = max(ids) if keep == "largest" else min(ids)
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (winner, len(ids), i == winner)
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert sum(r["kept"] for r in got) == 3
    assert sorted(r["group_size"] for r in got) == [1, 2, 2, 3, 3, 3]
    assert exact_dedup.drop_copies(df).count() == 3
    assert exact_dedup.drop_copies(df).columns == df.columns
    empty = df.limit(0)
    assert exact_dedup.exact_dedup(empty).collect() == []
    assert exact_dedup.drop_copies(empty).collect() == []


def test_packing(spark, texts):
    rnd = random.Random(3)
    alphabet = "ab sS'tT rReE lL vV dD mM.,;1 2\n\té ßÀ<|>"
    texts = texts + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(300)]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack_documents(frame(spark, texts, True), queries.tokenizer_path()).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    parts = {}
    for r in rows:
        assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        parts.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        own = sorted(parts[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist()
        assert ids == [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert {r["doc_tokens"] for r in own} == {len(ids)}
        lengths = [r["length"] for r in own if r["length"] < 2048]
        assert lengths == sorted(set(lengths), reverse=True)
    assert packing.pack_documents(frame(spark, texts).limit(0), queries.tokenizer_path()).collect() == []


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    tokens = packing.WordTokens(queries.tokenizer_path())
    for batch in (["alpha beta gamma"], ["delta epsilon zeta alpha"], ["alpha beta gamma delta epsilon zeta eta"]):
        ids, _ = tokens.encode(batch)
        assert ids.tolist() == tokens.whole(batch[0]).tolist()


def test_packing_query_digest(spark):
    row = queries.QUERIES["op4_packing"](spark, SF).first()
    piece = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), queries.tokenizer_path()).first()
    assert row["ids_crc32"] == zlib.crc32(bytes(piece["ids"]))


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = language.identify(docs, language.train(docs)).filter(language.held_out("doc_id", 5, 0))
    right = got.agg(F.avg((F.col("__best") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_mixture_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs)
    by = {r["lang"]: r["text"] for r in docs.filter("length(text) between 3000 and 6000").collect()}
    mixed = spark.createDataFrame(
        [(1, by["en"][:1500] + " " + by["fr"][:1500]), (2, None), (3, "12 34 !"), (4, "a"), (5, by["de"])], "doc_id long, text string"
    )
    got = {r["doc_id"]: r for r in language.identify(mixed, model).collect()}
    assert {s["lang"] for s in got[1]["__set"]} == {"en", "fr"}
    assert all(0.3 < s["share"] < 0.7 for s in got[1]["__set"])
    assert [got[k]["__best"] for k in (2, 3)] == ["und", "und"]
    assert got[4]["__best"] in model.langs
    assert [s["lang"] for s in got[5]["__set"]] == ["de"]
    kept = language.keep_identified(docs.unionByName(mixed.withColumn("lang", F.lit(None).cast("string"))))
    assert kept.columns == docs.columns and kept.count() == docs.count() + 3
    none = language.identify(mixed, language.train(docs.limit(0)))
    assert {r["__best"] for r in none.collect()} == {"und"}
    assert language.identify(mixed.limit(0), model).collect() == []


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_contamination(texts, items, window):
    wins = []
    for name, t in items:
        w = words_of(t)
        size = min(window, len(w))
        wins.append((name, size, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()))
    out = []
    for t in texts:
        w = words_of(t)
        hit, names = set(), set()
        for name, size, grams in wins:
            for i in range(len(w) - size + 1) if size else ():
                if tuple(w[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    names.add(name)
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("blocks", [16 << 20, 300])
def test_contamination(spark, texts, monkeypatch, blocks):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", blocks)
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    rnd = random.Random(5)
    small = ["".join(rnd.choice("ab ") for _ in range(60)) for _ in range(60)]
    bench += [("90", "a b"), ("91", None), ("92", "!!"), ("93", "b a b b a ab a b b a a"), ("94", small[3]), ("94", small[4] * 2), ("95", "É é 日本")]
    texts = texts[:60] + WEIRD + small + [bench[0][1] + " tail", "x " + bench[1][1].upper()]
    items = spark.createDataFrame(bench, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(frame(spark, texts, True), items).collect()}
    for i, want in enumerate(brute_contamination(texts, bench, 10)):
        r = got[i]
        assert (r["__words"], r["__hit"], sorted(set(r["__items"]))) == want
        w = words_of(texts[i])
        for m in r["__matches"]:
            found = [words_of(t)[m["item_start"] : m["item_start"] + m["length"]] for n, t in bench if n == m["item"]]
            assert w[m["start"] : m["start"] + m["length"]] in found
    kept = decontaminate.drop_contaminated(frame(spark, texts, True), items)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["__hit"]}
    none = decontaminate.find_contamination(frame(spark, texts), items.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["__hit"] for r in none)
    assert decontaminate.find_contamination(frame(spark, texts).limit(0), items).collect() == []


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def near_texts():
    rnd = random.Random(9)
    vocabulary = ["w%d" % k for k in range(400)]
    out = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 140))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randrange(0, 9)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append(" ".join(copy))
    # a chain whose ends are far apart
    chain = [rnd.choice(vocabulary) for _ in range(100)]
    for k in range(25):
        chain = list(chain)
        chain[4 * k] = "c%d" % k
        out.append(" ".join(chain))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, texts, words, percent):
    texts = near_texts() + texts[:100] + WEIRD + ["Only two", "only TWO", "one"] + ["copy of this text here now"] * 40
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, texts, True), words=words, percent=percent).collect()}
    want = brute_components(texts, words, percent)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string, node int"
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "a b c d e f", 3), (None, None, 4), (5, "", 5)], schema)
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("1", "1"), ("1", "1"), ("5", "5"), ("None", "1"), ("None", "None")]
    assert sum(r["kept"] for r in got) == 3
    left = near_dedup.drop_near_copies(df)
    assert left.columns == df.columns and left.count() == 3
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_sketch_coordinates_estimate_similarity():
    value = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = value[:240], value[60:]
    table = near_dedup.sketches(np.concatenate((a, b)), np.repeat([0, 1], 240), 2, 400)
    assert (table != near_dedup._EMPTY).all()
    assert abs((table[0] == table[1]).mean() - 180 / 300) < 0.08
    one = near_dedup.sketches(value[:1], np.zeros(1, np.int64), 1, 64)
    assert (one != near_dedup._EMPTY).all()
