"""Merge rounds, skip lists and token alignment against plain versions."""

import collections
import hashlib
import itertools
import json
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symloom.llm import bpe_codec, fill_middle, queries, token_alignment
from symloom.llm.token_alignment import Fragment

SF = "/root/testdata/sf0.001"
SIGNS = "abAB '  .,\n\tÀé́ΣσςİıßŒ中あ한0१Ⅷ\x1c\x85\xa0　▁͸Ᲊ😀aaaa'sre'llD<>|"
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", " ", "x", "aaaaab"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts(seed, n):
    rng = random.Random(seed)
    out = ["", None, " ", "  two", "two  ", "a\x00b", "<|endoftext|> x", "x" * 5000, "word " * 3000, "é" * 700, "▁", "a ▁b"]
    out += ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    out += ["".join(rng.choice(SPECIAL) for _ in range(7)) for _ in range(n // 8)]
    return out


def frame(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return df.withColumns({"row": F.lit(1), "ids": F.lit("x"), "decoded": F.lit(2), "uid": F.lit(3), "block": F.lit(4), "n": F.lit(None).cast("int"), "key": F.lit(5)})


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


# ---- byte-pair encoding


def plain_merge(merges, symbols):
    ranks = {tuple(m): k for k, m in enumerate(merges)}
    while True:
        found = min(((ranks[p], k) for k, p in enumerate(itertools.pairwise(symbols)) if p in ranks), default=None)
        if found is None:
            return symbols
        k = found[1]
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]


def test_merge_rounds_equal_single_merges():
    signs = bpe_codec.byte_characters()
    rng = random.Random(3)
    for _ in range(30):
        merges, tokens = [], ["a", "b", "c"]
        for _ in range(12):
            one, two = rng.choice(tokens), rng.choice(tokens)
            if [one, two] not in merges and one + two not in tokens:
                merges.append([one, two])
                tokens.append(one + two)
        names = signs + [t for t in tokens if len(t) > 1]
        number = {t: k for k, t in enumerate(names)}
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(40)] + ["a" * 33, "ab" * 20]
        ids, bounds = bpe_codec.MergeTable(number, merges).merge([w.encode() for w in words])
        for k, word in enumerate(words):
            assert [names[i] for i in ids[bounds[k] : bounds[k + 1]]] == plain_merge(merges, list(word))


def test_merges_out_of_order_are_refused():
    signs = bpe_codec.byte_characters()
    number = {t: k for k, t in enumerate([*signs, "ab", "abc"])}
    with pytest.raises(ValueError, match="ranks before"):
        bpe_codec.MergeTable(number, [["ab", "c"], ["a", "b"]])


def test_codec_refuses_other_vocabularies():
    import public_tokenizers

    with pytest.raises((ValueError, TypeError)):
        bpe_codec.Codec(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("remembered", [400_000, 50])
def test_encode_and_decode(spark, texts, remembered, monkeypatch):
    path = queries.tokenizer_path()
    all_texts = texts + odd_texts(1, 400)
    monkeypatch.setattr(bpe_codec, "REMEMBERED", remembered)
    plain = Tokenizer.from_file(path)
    codec = bpe_codec.Codec(path)
    for at in range(0, len(all_texts), 37):
        own = [t or "" for t in all_texts[at : at + 37]]
        ids, bounds = codec.encode(own)
        for k, text in enumerate(own):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    if remembered < 1000:
        return
    got = {r["doc_id"]: r for r in bpe_codec.decode(bpe_codec.encode(frame(spark, all_texts), path), path).collect()}
    for k, text in enumerate(all_texts):
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert got[k]["ids"] == want
        assert got[k]["decoded"] == plain.decode(want, skip_special_tokens=False)


def test_decode_null_empty_and_unknown(spark):
    path = queries.tokenizer_path()
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, 999999, None, 320]), (3, [320])], "doc_id long, ids array<int>")
    got = sorted((r["doc_id"], r["decoded"]) for r in bpe_codec.decode(df, path).collect())
    token = Tokenizer.from_file(path).id_to_token(320)
    assert got == [(1, ""), (2, ""), (3, token), (3, f"{token} {token}")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.decode(bpe_codec.encode(none, path), path).collect() == []


# ---- fill in the middle


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_skip_lists_reach_every_rank(unit):
    rng = random.Random(5)
    texts = ["", " ", "a", "\n\n", " lead", "x y\tz\n w  ", *("".join(rng.choice("ab \n") for _ in range(rng.randrange(900))) for _ in range(20))]
    widths, counts = fill_middle.unit_widths(texts, unit)
    each = np.ones(int(counts.sum()), np.int64) if widths is None else widths
    lists = fill_middle.SkipLists(widths, counts)
    begin = 0
    for k, text in enumerate(texts):
        own = each[begin : begin + counts[k]]
        begin += counts[k]
        assert own.sum() == len(text)
        ranks = np.arange(counts[k] + 1)
        assert lists.points_before(np.full(len(ranks), k), ranks).tolist() == [0, *np.cumsum(own).tolist()]
    assert len(lists.lanes) > 3


def test_units_of_words_and_lines():
    split = lambda text, unit: fill_middle.unit_widths([text], unit)[0].tolist()
    assert split("  ab c\n d", "word") == [2, 3, 3, 1]
    assert split("ab\n\nc", "line") == [3, 1, 1]


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_fill_in_middle(spark, texts, unit):
    all_texts = texts[:120] + odd_texts(2, 60) + ["has <S> mark", "<", "<S", "a<P", "S>"] * 8
    found = fill_middle.fill_in_middle(frame(spark, all_texts), unit=unit).withColumn("back", fill_middle.restored()).collect()
    assert len(found) == len(all_texts)
    forms = collections.Counter()
    for r in found:
        text = all_texts[r["doc_id"]] or ""
        widths, counts = fill_middle.unit_widths([text], unit)
        n = int(counts[0])
        ends = [0, *np.cumsum(np.ones(n, int) if widths is None else widths).tolist()]
        h = [int(sha(f"1:{r['doc_id']}")[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
        form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        assert (r["n"], r["form"], r["output"], r["back"]) == (n, form, out, text)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (a, b - a))
        forms[form] += 1
    assert min(forms.values()) > 5 and len(forms) == 3


def test_fill_in_middle_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "some text"), (None, "some text"), (1, "x"), (1, "x")], "doc_id long, text string")
    got = [tuple(r) for r in fill_middle.fill_in_middle(df, plain_percent=0).collect()]
    assert len(got) == 4 and len(set(got)) == 2
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "ba", "x"), ("aa", "x", "y"), ("<P>", "P", "x")):
        with pytest.raises(ValueError, match="marks"):
            fill_middle.fill_in_middle(df, marks=marks)
    with pytest.raises(ValueError, match="unit"):
        fill_middle.fill_in_middle(df, unit="page")


# ---- alignment


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), queries.pieces_path()


def brute_tokens(texts):
    """Tokens with byte ends of both kinds, of whole texts; None where there are none."""
    path_a, path_b = paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(bpe_codec.byte_characters())}
    names = {v: k for k, v in json.load(open(path_a, encoding="utf-8"))["model"]["vocab"].items()}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        sides = []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        sides.append([(i, bytes(byte[c] for c in names[i])) for i in ids])
        ids = b.encode(text, num_threads=1)
        sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids])
        if any(b"".join(p for _, p in side) != (" " + text).encode() for side in sides):
            out.append(None)
            continue
        out.append([list(zip([i for i, _ in side], itertools.accumulate(len(p) for _, p in side))) for side in sides])
    return out


def brute_alignment(texts):
    counts, rows = collections.Counter(), []
    for tokens in brute_tokens(texts):
        if tokens is None:
            rows.append(None)
            continue
        a, b = tokens
        common = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for stop in common:
            groups.append("|".join(",".join(str(i) for i, e in side if low < e <= stop) for side in (a, b)))
            low = stop
        links, start = [], 0
        spans_b = list(zip([i for i, _ in b], [0, *[e for _, e in b]], [e for _, e in b]))
        for i, end in a:
            links += [(i, j) for j, lo, hi in spans_b if lo < end and start < hi]
            start = end
        counts.update(links)
        rows.append((len(a), len(b), len(common), links, ";".join(groups)))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = row
        out.append((n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), groups))
    return out


@pytest.mark.parametrize("size", [1 << 16, 1500, 7])
def test_alignment(spark, texts, size, monkeypatch):
    own = texts if size > 10_000 else texts[:12]
    all_texts = [t[:4000] for t in own] + odd_texts(4, 150 if size > 100 else 30) + own[:3] * 2
    monkeypatch.setattr(token_alignment, "RANGE", size)
    monkeypatch.setattr(token_alignment, "FAN", 64 if size > 100 else 100)
    want = brute_alignment(all_texts)
    # ranges are set in this process only: the operator's steps are run here, on rows of its own making
    if size == 1 << 16:
        got = token_alignment.align(frame(spark, all_texts), *paths()).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(want))
        return
    aligner = token_alignment.Aligner(*paths())
    for text, expected in zip(all_texts, want, strict=True):
        raw = (text or "").encode()
        if not raw:
            continue
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], names=["uid", "text"]).append_column("id", pa.array([1]))
        rows = []
        for part in token_alignment._stretches(iter([batch])):
            at, piece = part.column("at")[0].as_py(), part.column("part")[0].as_py()
            rows += [token_alignment._fragment_row(7, 1, n, begin, f) for n, begin, f in token_alignment.range_fragments(aligner, at, piece)]
        random.Random(1).shuffle(rows)
        while len(rows) > 1:
            groups = collections.defaultdict(list)
            for r in rows:
                groups[r["range"] // token_alignment.FAN].append(r)
            rows = [token_alignment.compose_rows(g) for g in groups.values()]
        (row,) = token_alignment._long_texts(False)(iter([pa.RecordBatch.from_pylist([rows[0]])]))
        row = row.to_pylist()[0]
        assert (*row["facts"], *row["groups"]) == (*expected[:4], expected[6])


def test_long_texts_go_through_the_tree(spark, texts):
    long = [" ".join(texts[k : k + 60]) for k in (0, 60, 90)] + ["y" * 70_000, "é " * 40_000, "z" * 66_000 + " ▁ " + "q r " * 2000]
    rows = [t for t in long if len(t.encode()) > token_alignment.RANGE]
    assert len(rows) >= 4
    all_texts = rows + [r[:3000] for r in rows]
    plain = [t[:0] if len(t) > 200_000 else t for t in all_texts]
    got = token_alignment.align(frame(spark, plain), *paths(), digest=True).collect()
    for r, want in zip(sorted(got), fast_alignment(plain), strict=True):
        assert tuple(r)[1:] == want


def fast_alignment(texts):
    """As the brute version, with two pointers, for texts too long for it."""
    counts, rows = collections.Counter(), []
    for tokens in brute_tokens(texts):
        if tokens is None:
            rows.append(None)
            continue
        a, b = tokens
        i = k = 0
        links, groups, from_i, from_k = [], [], 0, 0
        while i < len(a):
            links.append((a[i][0], b[k][0]))
            one, two = a[i][1], b[k][1]
            i, k = i + (one <= two), k + (two <= one)
            if one == two:
                groups.append("|".join(",".join(str(t) for t, _ in side) for side in (a[from_i:i], b[from_k:k])))
                from_i, from_k = i, k
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, sha(";".join(groups))))
    most = collections.Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[p] == most[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), r[4])
        for r in rows
    ]


def test_fragments_compose_in_any_order():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(2, 30)
        sides = []
        for _ in range(2):
            ends = sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n)), n})
            sides.append([(rng.randrange(5), e) for e in ends])
        cuts = sorted(rng.sample(range(n + 1), min(n, 4)))
        parts = [Fragment.of(*[[t for t in side if lo < t[1] <= hi] for side in sides]) for lo, hi in zip([0, *cuts], [*cuts, n])]
        whole = Fragment.of(*sides)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].then(parts[k + 1])]
        key = lambda f: (f.cut, f.pre_a, f.pre_b, f.suf_a, f.suf_b, f.groups, f.n_a, f.n_b, f.n_groups, [x for p in f.links for x in p.tolist()])
        assert key(parts[0]) == key(whole)


def test_alignment_empty_null_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(none, *paths()).collect() == []
    df = spark.createDataFrame([(None, "one two"), (3, None), (3, "one two"), (3, "one two"), (4, "")], "doc_id long, text string")
    got = sorted(map(tuple, token_alignment.align(df, *paths()).collect()), key=str)
    full = brute_alignment(["one two"] * 3)[0]
    assert got == sorted([(None, *full), (3, *full), (3, *full), (3, 0, 0, 0, 0, 0, 0, ""), (4, 0, 0, 0, 0, 0, 0, "")], key=str)
