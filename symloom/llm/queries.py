"""The operators of this subpackage as queries over the given tables, one for each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import bpe_codec, decontaminate, exact_dedup, fill_middle, hilbert, language, lattice_lm, near_dedup, packing, suffix_dedup, token_alignment, toxicity, warc
from symloom.session import configure, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_exact_dedup(table):
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.exact_dedup(table("documents"), keep="largest")


ORACLES["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_packing(table):
    """All documents cut into sequences whose lengths are powers of two."""
    pieces = packing.pack_documents(table("documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op7_benchmark_decontamination(table):
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter item."""
    found = decontaminate.find_contamination(table("documents").select("doc_id", "text"), table("benchmark"), with_matches=False)
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        (F.col("__hit") > 0).alias("contaminated"),
    )


@query
def op9_language_id(table):
    """The language of every document from models of four fifths of the documents."""
    docs = table("documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select(
        "doc_id",
        language.held_out("doc_id", 5, 0).alias("held_out"),
        F.col("__best").alias("lang_pred"),
        F.col("__score").alias("score"),
    )


@query
def op10_minhash_near_dedup(table):
    """Components of documents whose sets of three-word shingles are 85 % alike."""
    found = near_dedup.near_duplicates(table("documents"), words=3, percent=85)
    return found.select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


@query
def op2_warc_normaliser(table):
    """All pages written as monolithic archives, normalised, and read back by their index."""
    pages = table("pages")
    folder = scratch_folder(pages.sparkSession, "warc")
    warc.write_monolithic(warc.records(pages), f"{folder}/monolithic")
    warc.normalise(pages.sparkSession, f"{folder}/monolithic", f"{folder}/normal")
    return warc.page_table(warc.read_archives(pages.sparkSession, f"{folder}/normal"))


ORACLES["op2_warc_normaliser"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)
"""


@query
def op3_hilbert_sharding(table):
    """All documents along a Hilbert curve through language, source and length, cut into 40 shards of equal counts."""
    docs = table("documents")
    plan = hilbert.shard_plan(docs, ["lang", "source", "n_chars"], shards=40, law="rows")
    return plan.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_toxicity(table):
    """Chance that each document is toxic, from subword vectors fitted on labels of three quarters of the ids."""
    docs = table("documents")
    out = lambda name: language.held_out(name, 4, 2)
    model = toxicity.train(docs, table("labels"), out)
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id", out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op5_lattice_lm(table):
    """Whole texts scored by a subword lattice learned from six sevenths of the ids."""
    docs = table("documents")
    out = language.held_out("doc_id", 7, 2)
    found = lattice_lm.lattice_scores(docs, docs.filter(~out), pieces_path(), lang_col="lang")
    return found.withColumn("held_out", out)


@query
def op6_suffix_array_dedup(table):
    """Bytes of all documents that lie in a 400-byte string that starts elsewhere too."""
    found = suffix_dedup.remove_repeats(table("documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op11_bpe_codec(table):
    """Token ids of every whole text, and the text that they decode to."""
    path = tokenizer_path()
    found = bpe_codec.decode(bpe_codec.encode(table("documents"), path), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_fill_in_middle(table):
    """Every whole text cut at two ranks of its code points and put into a form by its id."""
    found = fill_middle.fill_in_middle(table("documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


ORACLES["op12_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, t, n, form, least(a, b) AS one, greatest(a, b) AS two FROM k),
p AS (SELECT *, substr(t, 1, one) AS prefix, substr(t, one + 1, two - one) AS middle, substr(t, two + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN one END AS prefix_chars, CASE WHEN form <> 'plain' THEN two - one END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


@query
def op13_token_alignment(table):
    """Groups and links between the tokens of two vocabularies over the bytes of every text."""
    import public_tokenizers

    found = token_alignment.align(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), pieces_path(), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
