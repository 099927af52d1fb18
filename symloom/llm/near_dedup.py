"""Near duplicates: fast similarity sketches, banding, exact verification, components.

Sketch: every shingle is thrown into one of ``BANDS * ROWS`` bins with a random value, round after round; a bin
keeps the least value of the first round that reached it.  After as many rounds as there are bins, round j
throws everything into bin j, so each coordinate is filled whatever the size of the set.  Most texts need two or
three rounds.

Documents with equal shingle sets are one class and go on as one.  Classes that share a band are candidates.
They are never paired all with all: first each class is checked against the class it shares most bands with
among the least of its buckets, then against the least of each bucket that its component does not hold.
Classes whose buckets still hold several components are compared across components, by exact filters: two sets
that are alike share one of their rarest shingles and differ in few parities.  First come a few rounds against
random members of each group of classes with a rare shingle in common, then all pairs of a group that are still in
different components.  A pair of classes in one component needs no check, as it
could change nothing.  Links are confirmed on the full sets.

With 28 bands of 4 rows a pair at similarity 0.8 shares no band with a probability of 4 in 10 million, one at
0.85 of 1 in a billion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.blocks import U64, VISIBLE, blocks, lower_ascii, mix, prefix_hashes, span_hashes, text_bytes, windows, word_spans
from symloom.session import stage

BANDS, ROWS = 28, 4
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(raw: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by (row, hash), and their rows."""
    lowered = lower_ascii(raw)
    first, after, row = word_spans(lowered, starts, VISIBLE)
    hashed = span_hashes(prefix_hashes(lowered), first, after)
    value, at = windows(hashed, row, words)
    own = row[at]
    count = np.bincount(row, minlength=len(starts) - 1)
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        begin = np.searchsorted(row, few)
        short = np.empty(len(few), U64)
        for i, (b, n) in enumerate(zip(begin.tolist(), count[few].tolist(), strict=True)):
            sequence = np.array([n], U64)
            for k in range(b, b + n):
                sequence = mix(sequence * U64(3) + hashed[k : k + 1])
            short[i] = sequence[0]
        value, own = np.concatenate((value, short)), np.concatenate((own, few))
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
        value, own = value[new], own[new]
    return value, own


def sketches(value: np.ndarray, own: np.ndarray, rows: int, size: int) -> np.ndarray:
    """A row of ``size`` filled coordinates for each set; rows without shingles stay empty."""
    out = np.full(rows * size, _EMPTY, U64)
    table = out.reshape(rows, size)
    for turn in range(2 * size):
        if not len(value):
            break
        thrown = mix(value + U64(0xA24BAED4963EE407 * (turn + 1) & (1 << 64) - 1))
        low = (thrown & U64(0xFFFFFFFF)) | (U64(turn) << U64(32))
        if turn < size:
            place = ((thrown >> U64(32)) * U64(size)) >> U64(32)
        else:
            place = np.full(len(value), turn - size, U64)
        np.minimum.at(out, own * size + place.astype(np.int64), low)
        rest = np.zeros(rows, bool)
        active = np.unique(own)
        rest[active] = (table[active] == _EMPTY).any(axis=1)
        if not rest[active].all():
            stay = rest[own]
            value, own = value[stay], own[stay]
    return table


def _features(words: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            for row, after, raw, starts in blocks(data, ends):
                rows = after - row
                value, own = shingle_sets(raw, starts, words)
                n = np.bincount(own, minlength=rows)
                full = np.flatnonzero(n)
                first = np.concatenate(([0], np.cumsum(n[full])))[:-1].astype(np.int64)
                marks = np.zeros((2, rows), U64)
                if len(full):
                    marks[0, full] = np.add.reduceat(mix(value + U64(0x51)), first)
                    marks[1, full] = np.add.reduceat(mix(value ^ U64(0xC2B2AE3D27D4EB4F)), first)
                table = sketches(value, own, rows, BANDS * ROWS).reshape(rows, BANDS, ROWS)
                band = np.broadcast_to(np.arange(BANDS, dtype=U64), (rows, BANDS)).copy()
                for k in range(ROWS):
                    band = mix(band * U64(3) + table[:, :, k])
                flat = pa.array(band.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, rows),
                        batch.column("mark").slice(row, rows),
                        pa.array(n.astype(np.int64)),
                        pa.array(marks[0].view(np.int64)),
                        pa.array(marks[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BANDS + 1, BANDS, dtype=np.int32)), flat),
                    ],
                    names=["id", "mark", "n", "f1", "f2", "bands"],
                )

    return features


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            for row, after, raw, starts in blocks(data, ends):
                value, own = shingle_sets(raw, starts, words)
                cut = np.searchsorted(own, np.arange(after - row + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").slice(row, after - row),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(value.view(np.int64))),
                    ],
                    names=["node", "shingles"],
                )

    return sets


def renamed(frame: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``frame`` with each ``node`` replaced by its root, where it has one."""
    known = roots.select(F.col("node").alias(node), F.col("root").alias("__root"))
    return frame.join(known, node, "left").withColumn(node, F.coalesce("__root", node)).drop("__root")


def components(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(node, root): the least node of each connected component, for all nodes of ``edges`` (a, b) that are not
    themselves least; ``found`` are the components of earlier edges, which are kept.

    Contraction: every root hooks onto its least smaller neighbour, pointers are doubled until they rest, and edges
    are renamed to roots; this ends when no edge joins two roots.
    """

    def between_roots(frame: DataFrame) -> DataFrame:
        if found is not None:
            frame = renamed(renamed(frame, found, "a"), found, "b")
        ends = frame.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return stage(ends.filter("a > b").distinct(), "edges")

    edges = between_roots(edges)
    while not edges.isEmpty():
        hooks = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks")
        moved = True
        while moved:
            before = hooks.withColumn("was", F.col("root"))
            for _ in range(2):
                before = renamed(before, hooks, "root")
            jumped = stage(before.select("node", "root", (F.col("root") != F.col("was")).alias("moved")), "hooks")
            moved = not jumped.filter("moved").isEmpty()
            hooks = jumped.select("node", "root")
        found = hooks if found is None else stage(renamed(found, hooks, "root").unionByName(hooks), "roots")
        edges = between_roots(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id (smallest id reachable over links), kept, and mark (a
    64-bit hash of the text, 0 for null).

    A-Z are lower-cased; words are runs of characters other than space and \\t to \\r; a document's set holds its
    distinct runs of ``words`` words, or its whole word sequence if that is shorter.  Documents are linked when 100 *
    intersection >= ``percent`` * union.  Null and empty texts have no shingles and are linked with nothing: they are
    components of their own.  A null id counts as larger than all others.  Of rows that share the component's id one is
    kept.  Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.select("id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    feats = marked.mapInArrow(_features(words), "id long, mark long, n long, f1 long, f2 long, bands array<long>")
    feats = stage(feats.withColumn("rid", F.monotonically_increasing_id()), "near-features")
    last = F.lit(2**63 - 1)
    order = F.struct(F.coalesce("id", last).alias("k"), F.col("rid").alias("r"))
    classes = feats.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min(order).alias("head"))
    classes = stage(classes.select("f1", "f2", F.col("n"), F.col("head.r").alias("node"), F.col("head.k").alias("low")), "near-classes")
    heads = feats.select(F.col("rid").alias("node"), "id", "mark", "bands").join(classes.select("node", "n"), "node")
    heads = stage(heads, "near-heads")

    roots = _linked(marked, heads, words, percent)

    # the least identifier of each component, then of each class, then of each row
    known = classes.join(roots, "node", "left").select(
        "f1", "f2", "n", "low", "node", F.coalesce("root", "node").alias("root")
    )
    least = known.groupBy("root").agg(F.min(F.struct("low", F.col("node").alias("r"))).alias("least"))
    of_class = known.join(least, "root").select("f1", "f2", "n", F.col("least.low").alias("component"), F.col("least.r").alias("winner"))
    named = feats.select("id", "mark", "rid", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.when(F.col("component") != last, F.col("component")))
    kept = (F.col("n") == 0) | (F.col("rid") == F.col("winner"))
    return named.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "mark"
    )


def _linked(marked: DataFrame, heads: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the components of all confirmed links between classes."""
    sizes = heads.select("node", "n")
    entries = heads.select("node", "n", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    entries = stage(entries.join(buckets.select("band", "hub"), "band"), "near-entries")

    # whole sets of the classes that share a band with another
    asked = heads.join(entries.select("node").distinct(), "node", "left_semi").select("node", F.col("id").alias("i"), F.col("mark").alias("m"))
    # the few names are hashed, so the texts are shuffled but never sorted
    asked = asked.hint("shuffle_hash")
    texts = marked.join(asked, marked["id"].eqNullSafe(asked["i"]) & (marked["mark"] == asked["m"])).select("node", "text")
    sets = stage(texts.mapInArrow(_sets(words), "node long, shingles array<long>"), "near-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(left, "a").join(right, "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - shared
        return both.filter(100 * shared >= percent * union).select("a", "b")

    def close(na: str, nb: str):
        return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)

    near = (
        entries.filter("node != hub")
        .groupBy("node", "hub")
        .agg(F.first("n").alias("n"), F.count("*").alias("bands"))
        .join(sizes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n")), "hub")
        .filter(close("n", "hub_n"))
    )
    near = stage(near.select("node", "hub", "bands"), "near-pairs")
    best = near.groupBy("node").agg(F.max(F.struct("bands", (-F.col("hub")).alias("hub"))).alias("best"))
    first = best.select(F.col("node").alias("a"), (-F.col("best.hub")).alias("b"))
    roots = components(confirmed(first))

    def rooted(frame: DataFrame, node: str, name: str) -> DataFrame:
        return renamed(frame.withColumn(name, F.col(node)), roots, name)

    pairs = near.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    second = rooted(rooted(pairs, "a", "ra"), "b", "rb").filter("ra != rb").select("a", "b")
    second = stage(second.join(first, ["a", "b"], "left_anti"), "near-second")
    roots = components(confirmed(second), roots)

    # Classes in buckets that still hold several components.  Two sets that are alike share one of the rarest
    # shingles of each: the first n - ceil(n * percent / 100) + 1 in any common order.
    placed = stage(rooted(entries, "node", "root").select("band", "node", "root"), "near-placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    rest = placed.join(mixed.select("band"), "band", "left_semi").select("node", "root").distinct()
    rest = stage(rest.join(sets, "node"), "near-rest")
    shared = rest.sparkSession.sparkContext.broadcast(shingle_counts(rest))
    columns = ["shingle", "node", "root", "n", "short", *[f"p{k}" for k in range(FEW)]]
    kinds = ", ".join(f"{c} boolean" if c == "short" else f"{c} long" for c in columns)
    rare = stage(rest.mapInArrow(_rare(shared, percent), kinds), "near-rare")
    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("shingle", *[F.col(c).alias(c + name) for c in frame.columns if c != "shingle"])

    def apart(longs: int):
        """Parities differ in at most as many places as the two sets have elements of their own."""
        return sum(F.bit_count(F.col(f"p{k}x").bitwiseXOR(F.col(f"p{k}y"))) for k in range(longs))

    def across(longs: int):
        alike = apart(longs) * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
        return (F.col("rootx") != F.col("rooty")) & close("nx", "ny") & alike

    # rounds in which each class is checked against the likeliest of some random members of its groups
    tried = first.unionByName(second)
    for turn in range(HUB_ROUNDS):
        several = rare.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        rare = stage(rare.join(several.select("shingle"), "shingle", "left_semi"), "near-rare")
        chance = F.xxhash64("node", F.lit(turn))
        dealt = rare.withColumn("deal", F.pmod(chance, F.lit(SALTS)))
        hubs = dealt.groupBy("shingle", "deal").agg(F.min(F.struct(chance.alias("chance"), *columns[1:])).alias("hub"))
        hubs = hubs.select("shingle", "deal", *[F.col(f"hub.{c}").alias(c) for c in columns[1:]])
        likely = (
            side(dealt, "x")
            .withColumnRenamed("dealx", "deal")
            .join(side(hubs, "y").withColumnRenamed("dealy", "deal"), ["shingle", "deal"])
            .filter(across(FEW))
            .groupBy("nodex")
            .agg(F.min(F.struct(apart(FEW).alias("apart"), "nodey")).alias("best"))
            .select(F.greatest("nodex", "best.nodey").alias("a"), F.least("nodex", "best.nodey").alias("b"))
            .distinct()
        )
        likely = stage(likely.join(tried, ["a", "b"], "left_anti"), "near-likely")
        if likely.isEmpty():
            break
        tried = tried.unionByName(likely)
        roots = components(confirmed(likely), roots)
        rare = renamed(rare, roots, "root").select(*columns)

    # what is left: classes outside the largest component of a group against all others
    main = (
        rare.groupBy("shingle", "root")
        .count()
        .groupBy("shingle")
        .agg(F.max(F.struct("count", "root")).alias("most"), F.count("*").alias("roots"))
        .filter("roots > 1")
        .select("shingle", F.col("most.root").alias("main"))
    )
    wide = stage(rest.mapInArrow(_parities, ", ".join(["node long", *[f"p{k} long" for k in range(MANY)]])), "near-parities")
    rare = rare.select(*columns[:5]).join(main, "shingle").join(wide, "node")
    rare = stage(rare, "near-open")
    # of two sets the smaller one's share of rare shingles can be shorter still
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("nodex") < F.col("nodey")))
    crossing = (
        side(rare.filter("root != main"), "x")
        .join(side(rare, "y"), "shingle")
        .filter(across(MANY) & F.when(smaller, F.col("shortx")).otherwise(F.col("shorty")))
        .select(F.greatest("nodex", "nodey").alias("a"), F.least("nodex", "nodey").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    return components(confirmed(stage(crossing, "near-crossing")), roots)


#: rounds before the exhaustive one, and random parts of a group that each have a member to compare with
HUB_ROUNDS, SALTS = 3, 8
#: 64-bit words of parities of a set, in the rounds and at the end
FEW, MANY = 4, 16
#: counters of shingle frequencies; they only order shingles, so sharing a counter costs speed, never a link
COUNTERS = 1 << 20
_SLICE = 1 << 12


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles.view(U64) + U64(0x77)) >> U64(44)).astype(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each list begins (with the end appended)."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each counter, over all sets: 4 MB whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_slots(_flat(batch.column("shingles"))[0]), minlength=COUNTERS)
        slices = total.reshape(-1, _SLICE)
        used = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([slices[i].tobytes() for i in used], pa.binary())], names=["slice", "counts"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = sets.select("shingles").mapInArrow(count, "slice long, counts binary")
    out = np.zeros((COUNTERS // _SLICE, _SLICE), np.int64)
    for row in parts.groupBy("slice").applyInArrow(add, "slice long, counts binary").collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def parities(value: np.ndarray, own: np.ndarray, rows: int, longs: int) -> np.ndarray:
    """For each set, which of 64 * ``longs`` cells hold an odd number of its shingles, packed."""
    cells = 64 * longs
    cell = ((mix(value.view(U64) + U64(0x99)) >> U64(32)) % U64(cells)).astype(np.int64)
    odd = np.bincount(own * cells + cell, minlength=rows * cells).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, cells), axis=1).view(np.int64)


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value, cut = _flat(batch.column("shingles"))
        table = parities(value, np.repeat(np.arange(batch.num_rows), np.diff(cut)), batch.num_rows, MANY)
        columns = [pa.array(np.ascontiguousarray(table[:, k])) for k in range(MANY)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], names=["node", *[f"p{k}" for k in range(MANY)]])


def _rare(shared, percent: int):
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            value, cut = _flat(batch.column("shingles"))
            own = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            order = np.lexsort((value, counts[_slots(value)], own))
            size = np.diff(cut)
            take = size - -(-size * percent // 100) + 1
            place = np.arange(len(value)) - cut[:-1][own]
            chosen = order[place < take[own]]
            rows = pa.array(own[chosen])
            short = size - -(-size * 2 * percent // (100 + percent)) + 1
            parity = parities(value, own, batch.num_rows, FEW)[own[chosen]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(value[chosen]),
                    batch.column("node").take(rows),
                    batch.column("root").take(rows),
                    pa.array(size[own[chosen]].astype(np.int64)),
                    pa.array(place[place < take[own]] < short[own[chosen]]),
                    *(pa.array(np.ascontiguousarray(parity[:, k])) for k in range(FEW)),
                ],
                names=["shingle", "node", "root", "n", "short", *[f"p{k}" for k in range(FEW)]],
            )

    return rare


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One document of each component, all columns as they were; texts without words all stay."""
    stay = near_duplicates(docs, id_col, text_col, words, percent).filter("kept")
    stay = stage(stay.select(F.col(id_col).alias("__near_id"), F.col("mark").alias("__near_mark")), "near-kept")
    mark = "__near_text"
    marked = docs.withColumn(mark, F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0)))
    on = marked[id_col].cast("long").eqNullSafe(stay["__near_id"]) & (marked[mark] == stay["__near_mark"])
    found = marked.join(stay.hint("shuffle_hash"), on, "left_semi")
    if docs.groupBy(F.col(id_col)).count().filter("count > 1").isEmpty():
        return found.drop(mark)
    # rows that share id and text: the join keeps all of them, so one is picked
    return found.dropDuplicates([id_col, mark]).drop(mark)
