"""Archives, shards, suffix arrays, toxicity and language-model scores against plain versions."""

import gzip
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from symloom.llm import hilbert, language, lattice_lm, queries, suffix_dedup, toxicity, warc

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    have, want = oracle.compare(spark, oracle.database(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
    assert have == want


# archives


def test_normalise_foreign_archive(spark, tmp_path):
    blocks = [b"x" * 700000, b"", b"a\r\n\r\nWARC/1.0\r\nb", "é".encode() * 5]
    whole = b"".join(
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b)
        for i, b in enumerate(blocks)
    )
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "in" / "two.warc.gz").write_bytes(gzip.compress(whole[:900000]) + gzip.compress(whole[900000:]))
    (tmp_path / "in" / "none.warc.gz").write_bytes(gzip.compress(b""))
    warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    index = spark.read.parquet(str(tmp_path / "out" / "index")).orderBy("archive", "number").collect()
    assert [(r["archive"], r["number"]) for r in index] == [(a, n) for a in ("one.warc.gz", "two.warc.gz") for n in range(4)]
    for name in ("one.warc.gz", "two.warc.gz"):
        (path,) = (tmp_path / "out" / "archives").glob(f"archive={name}/part-*")
        data = path.read_bytes()
        assert gzip.decompress(data) == whole  # a plain reader takes it
        for r in index:
            if r["archive"] == name:
                one = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
                assert one.startswith(b"WARC/1.0") and f"<urn:page:{r['number']}>".encode() in one
    rows = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted(bytes(r["block"]) for r in rows) == sorted(blocks * 2)


def test_damaged_archive_fails():
    body = b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort"
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflate(gzip.compress(body))))
    with pytest.raises(ValueError):
        list(warc.inflate(gzip.compress(body * 100)[:-20]))


def test_pages_edges(spark, tmp_path):
    big = "y" * 1500
    schema = "page_id long, url string, html string, digest string, refers_to int"
    rows = [(1, "u\r\nx", big, "a", 1), (2, None, big, "a", 2), (3, "u", None, "a", 3), (4, "u", "small", None, 4), (5, "u", "small", "", 5), (None, "u", big, "", 6), (2, "v", big, "", 7), (7, "u", "é" * 500, "", 8), (8, "u", "é" * 500, "", 9)]
    pages = spark.createDataFrame(rows, schema)
    for data, part in ((pages, "a"), (pages.limit(0), "b")):
        warc.write_monolithic(warc.records(data), str(tmp_path / part / "in"))
        warc.normalise(spark, str(tmp_path / part / "in"), str(tmp_path / part / "out"))
    got = warc.page_table(warc.read_archives(spark, str(tmp_path / "a" / "out"))).collect()
    seen = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    assert seen == [
        ("1", 1500, "revisit", 2), ("2", 1500, "response", None), ("2", 1500, "response", None), ("3", 0, "response", None),
        ("4", 5, "response", None), ("5", 5, "response", None), ("7", 1000, "revisit", 8), ("8", 1000, "response", None), ("None", 1500, "revisit", 2),
    ]
    assert {r["payload_digest"] for r in got if r["payload_bytes"] == 1500} == {hashlib.sha1(big.encode()).hexdigest()}
    assert warc.page_table(warc.read_archives(spark, str(tmp_path / "b" / "out"))).collect() == []


# shards


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"d{k} int" for k in range(dims)))
    rows = df.withColumn("at", hilbert.curve_index([F.col(f"d{k}") for k in range(dims)], bits)).collect()
    order = {r["at"]: tuple(r)[:dims] for r in rows}
    assert sorted(order) == list(range(len(cells)))
    for i in range(len(cells) - 1):
        assert sum(abs(a - b) for a, b in zip(order[i], order[i + 1], strict=True)) == 1


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"size": F.lit(1), "shard": F.lit("x")})
    plan = hilbert.shard_plan(docs, ["lang", "source", "n_chars", "doc_id"], 7, law).collect()
    assert sorted(r["doc_id"] for r in plan) == list(range(1000))
    by = {}
    for r in plan:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(7))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    runs = [sorted(r["curve"] for r in by[k]) for k in range(7)]
    assert all(a[-1] <= b[0] for a, b in zip(runs, runs[1:], strict=False))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        total = [sum(r["size"] for r in rows) for rows in by.values()]
        assert max(total) - min(total) <= 2 * max(r["size"] for r in plan)


def test_codes_of_texts_with_a_common_beginning(spark):
    rows = [(f"https://host{i % 50:02d}/é", None if i % 9 == 0 else i % 3 == 0) for i in range(1000)]
    coded = hilbert.quantised(spark.createDataFrame(rows, "source string, flag boolean"), ["source", "flag"]).collect()
    by = {}
    for r in coded:
        by.setdefault(r["source"], set()).add(r["__code_0"])
    codes = [by[k] for k in sorted(by)]
    assert all(len(c) == 1 for c in codes)
    flat = [c for own in codes for c in own]
    assert flat == sorted(flat) and len(set(flat)) >= 31
    assert {r["__code_1"] for r in coded if r["flag"] is None} == {0}
    assert len({(r["flag"], r["__code_1"]) for r in coded if r["flag"] is not None}) == 2


def test_shard_edges(spark, tmp_path):
    schema = "doc_id long, text string, lang string, score double"
    df = spark.createDataFrame([(1, None, None, float("nan")), (1, None, None, None), (None, "a", "x", 1.0), (4, "é", "x", 2.0)], schema)
    plan = hilbert.shard_plan(df, ["lang", "score"], 40).collect()
    assert sorted(r["size"] for r in plan) == [16, 16, 17, 18]
    assert len({r["shard"] for r in plan}) == 4 and {r["slot"] for r in plan} == {0}
    assert hilbert.shard_plan(df.limit(0), ["lang", "score"], 40).collect() == []
    docs = df.filter("doc_id = 4 or doc_id is null")
    hilbert.write_shards(docs, hilbert.shard_plan(docs, ["lang", "score"], 2), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


# suffix arrays


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        left = bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,modulus,seed", [(400, 64, 73, 1), (40, 8, 7, 2), (40, 8, 13, 3), (30, 4, 7, 4)])
def test_repeats(spark, length, gram, modulus, seed):
    rnd = random.Random(seed)
    letters = "abcdefghij é" if seed < 4 else "ab"
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    shared = [text(rnd.randrange(length // 2, 4 * length)) for _ in range(12)]
    docs = []
    for _ in range(90):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            piece = rnd.choice(shared)
            a = rnd.randrange(len(piece) // 2)
            parts += [text(rnd.randrange(0, 2 * length)), piece[a : a + rnd.randrange(1, 3 * length)]]
        docs.append("".join(parts))
    docs += docs[:6] + [None, "", "a" * (3 * length), text(length), docs[3] + text(5), "xyz" * length]
    docs += [shared[0][:length] * 2, shared[1], shared[1], shared[1]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"mark": F.lit(1), "at": F.lit(2)})
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, length, gram=gram, modulus=modulus).collect()}
    for i, want in enumerate(brute_repeats([(d or "").encode() for d in docs], length)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) == want
    assert suffix_dedup.remove_repeats(df.limit(0), length, gram=gram, modulus=modulus).collect() == []


@pytest.mark.parametrize("length,gram,modulus", [(400, 64, 73), (40, 8, 13)])
def test_repeats_of_edges_elsewhere(spark, length, gram, modulus):
    """Common beginnings, common endings and near copies with an early edit, of which a third text has a part at any place."""
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = []
    for shift in range(1, modulus + 1):
        x = text(length + 2 * modulus + 30)
        y = x[::-1]
        part = x[10 : length + 30]
        docs += [x + text(9), x + text(5), text(shift) + part + text(20)]
        docs += [text(9) + y, text(shift) + y, text(2 * shift) + part[::-1] + text(20)]
        z = text(length + 2 * modulus + 30)
        docs += [z, z[:5] + "#" + z[6:], text(shift) + z[10 : length + 30] + text(20)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, length, gram=gram, modulus=modulus).collect()}
    want = brute_repeats([d.encode() for d in docs], length)
    wrong = [i for i, w in enumerate(want) if (got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["spans"]), got[i]["kept_sha256"]) != w]
    assert wrong == []


def test_repeats_of_one_text_in_many_rows(spark):
    """Rows of a common text, long or short, are not dealt to one task."""
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    hot, short, part = text(600), text(30), text(450)
    docs = [hot] * 400 + [short] * 400 + [text(20) + part, part + text(30), text(10) + hot[50:500]] + [text(500) for _ in range(20)] + [text(410)] * 2
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(8, "doc_id")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = suffix_dedup.remove_repeats(df).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for i, want in enumerate(brute_repeats([d.encode() for d in docs], 400)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["spans"]), got[i]["kept_sha256"]) == want
    for first in (0, 400):
        assert max(Counter(got[i]["task"] for i in range(first, first + 400)).values()) < 200


@pytest.mark.parametrize("modulus", [7, 13, 31, 73])
def test_difference_cover(modulus):
    cover = suffix_dedup.difference_cover(modulus)
    assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))


def test_compare_over_small_batches(spark):
    rows = [(n, a, m, 0) for n in range(6) for a, times in ((0, n % 3), (5, n % 2), (6, n), (7, 2 * (n > 3))) for m in range(100 * a, 100 * a + times)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        df = spark.createDataFrame(rows + rows[:4], "name long, around long, mark long, at long")
        got = {(r["kind"], r["mark"], r["name"]) for r in named(suffix_dedup.compared(df.withColumn("at", F.col("name")), "x"))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for n, a, m, _ in rows:
        by.setdefault(n, {}).setdefault(a, set()).add(m)
    for n, runs in by.items():
        several = sum(map(len, runs.values())) > 1
        for a, marks in runs.items():
            for m in marks:
                want = (suffix_dedup.SETTLED if a and len(marks) > 1 else suffix_dedup.OPEN) if several else None
                assert {k for k in (0, 1) if (k, m, n) in got} == ({want} if several else set())
            told = any((suffix_dedup.LIKE, m, n) in got for m in marks)
            assert told or not (a and len(marks) > 1 and len(runs) > 1)


def named(found):
    return found.select("kind", "mark", F.col("at").alias("name")).collect()


# toxicity


def test_toxicity_learns_and_generalises(spark):
    rnd = random.Random(4)
    stem = ["idiot", "trash", "moron"]
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [word() for _ in range(rnd.randrange(10, 60))]
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(stem)
        rows.append((i, " ".join(words), "toxic"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 0), (3, None), (4, 7)], "doc_id long, toxic int")
    out = lambda name: language.held_out(name, 4, 2)
    model = toxicity.train(docs, marks, out)
    got = toxicity.score(docs, model).filter(out("doc_id")).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 3 == 0) for r in got]) > 0.95
    odd = spark.createDataFrame([(1, "abc idi0t idiots idiott abc"), (2, "abcde fgh abc hgf abc"), (3, None), (4, ""), (5, "!!")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert score[1] > 0.3 > score[2] and score[3] == score[4] == score[5]
    none = toxicity.train(docs, marks.limit(0), out)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, none).collect())
    assert toxicity.score(odd.limit(0), none).collect() == []


def test_toxicity_of_rare_words(spark):
    """Each toxic word is in nine documents of three hundred."""
    rnd = random.Random(6)
    stem = ["".join(rnd.choice("ijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(324):
        words = [word() for _ in range(20)] + [stem[i // 3 % 12]] * (4 if i % 3 == 0 else 0)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"), lambda name: F.lit(False))
    raw = np.frombuffer(" ".join(stem).encode(), np.uint8)
    buckets = toxicity.subwords(raw, np.array([0, len(raw)]))[2]
    assert (model.effect[buckets] != 0).all()
    odd = spark.createDataFrame([(k, f"{w} {w}") for k, w in enumerate([*stem, "abcde"])], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert min(score[k] for k in range(12)) > max(0.3, score[12])


def test_toxicity_query(spark):
    rows = queries.QUERIES["op8_toxicity"](spark, SF).collect()
    assert len(rows) == 200 and all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


# language model


def spellings(pieces, word):
    """Sum over all segmentations, by plain recursion over the tables."""
    import functools

    from symloom.llm.blocks import prefix_hashes, span_hashes

    table = {int(k): i for i, k in enumerate(pieces.keys)}

    def weight(a, b, first):
        data = np.frombuffer(word, np.uint8)
        key = int(span_hashes(prefix_hashes(data), np.array([a]), np.array([b]))[0])
        return math.exp((pieces.first if first else pieces.go)[table[key]]) if key in table else 0.0

    @functools.cache
    def total(end):
        return 1.0 if end == 0 else sum(total(a) * weight(a, end, a == 0) for a in range(end))

    return total(len(word)) * math.exp(pieces.end)


def test_forward_recursion():
    pieces = lattice_lm.Pieces(queries.pieces_path(), {400: 7, 500: 3})
    words = ["the".encode(), "wörtlich".encode(), b"a", "日本".encode(), b"xqzt" * 4]
    got = pieces.log_probability(words)
    assert got == pytest.approx([math.log(spellings(pieces, w)) for w in words])
    assert np.isfinite(pieces.log_probability([b"long" * 3000])).all()


@pytest.mark.parametrize("head", [0, 3000, 64 << 20])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lattice_lm, "HEAD_BYTES", head)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(80)
    odd = spark.createDataFrame([(1000, None, None), (1001, "", "xx"), (1002, "\t", None), (1003, "Neu the NEU neu", None), (1003, "w" * 5000, None)], docs.schema)
    docs = docs.unionByName(odd)
    out = language.held_out("doc_id", 7, 2)
    rows = lattice_lm.lattice_scores(docs.withColumn("c", F.lit(1)), docs.filter(~out), queries.pieces_path(), lang_col="lang")
    got = sorted((r for r in rows.collect()), key=lambda r: (r["doc_id"], r["n_tokens"]))
    texts = docs.withColumn("out", out).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    count, ends = Counter(), 0
    for r in texts:
        if not r["out"]:
            count.update(tokens(r["text"]))
            ends += 1
    total, distinct = sum(count.values()) + ends, len(count) + 1
    texts.sort(key=lambda r: (r["doc_id"], len(tokens(r["text"]))))
    for r, t in zip(got, texts, strict=True):
        words = tokens(t["text"])
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words) + math.log10((ends + 1) / (total + distinct + 1))
        assert (r["doc_id"], r["n_tokens"], r["n_known"]) == (t["doc_id"], len(words) + 1, sum(count[w] > 0 for w in words) + 1)
        assert r["train_tokens"] == total and r["base_score"] == pytest.approx(base)
        assert math.isfinite(r["score"]) and r["score"] < 0
    # without training text, and without text
    none = lattice_lm.lattice_scores(odd, odd.limit(0), queries.pieces_path()).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)
    assert lattice_lm.lattice_scores(odd.limit(0), docs, queries.pieces_path()).collect() == []


def test_word_model_sums_to_at_most_one(spark):
    groups = np.array([[3, 20, 9], [1, 8, 6], [0, 0, 0]])
    pieces = lattice_lm.Pieces(queries.pieces_path(), {})
    scores = lattice_lm.Scores(pieces, 28 + 4, 12, 4, groups)
    words = [bytes([a]) for a in range(33, 127)] + [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)]
    logs = scores.model(words, np.zeros(len(words)), np.zeros((len(words), 3)))
    assert (10.0 ** logs).sum(axis=0).max() < 1.0
