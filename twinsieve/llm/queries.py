"""The queries op1 to op13: each operator over its whole table, reduced to its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix at 150 % of all words, source weights 5, 2, 1."""
    from .mixing import mix_rates

    return mix_rates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by a network fitted outside the held-out fold."""
    from .toxicity import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all others."""
    from .neighbours import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents with the first line of its fuzzy class, and whether it stays."""
    from .lines import line_classes

    return line_classes(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, markup, address suffix and host."""
    from .language import identify_pages

    return identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op6_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 5-word shingles, Jaccard of 0.8 or more."""
    from .setjoin import similarity_classes

    return similarity_classes(_table(spark, sf_dir, "documents"))


def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses."""
    from .syncmers import fingerprint_pairs

    return fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op8_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded into packed files and read back."""
    from .binary import default_folder, read_packed, write_packed

    docs = _table(spark, sf_dir, "documents")
    manifest = write_packed(docs, _vocabulary("word_bpe_49k.json"), default_folder(docs), end_id=2)
    return read_packed(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted as prefix trees and read back."""
    from .chat import format_trees, read_trees

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)"
    )
    return read_trees(format_trees(turns.unionByName(extra)))


def op10_pack_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, along the Hilbert curve."""
    from .packing import pack_documents

    pieces = pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0, length=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two vocabularies: groups of ids over the same bytes, and how common their links are."""
    from .alignment import align_documents

    out = align_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"), hashed=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the 16 first whitened components, a row a component."""
    from .whitening import fit_whitening, whiten

    vectors = _table(spark, sf_dir, "embeddings")
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(vectors, components=16)
    if model is None:
        return spark.createDataFrame([], names)
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(x)) for x in model.explained]), F.col("at")) if len(model.explained) else F.lit(None).cast("double")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every whole text, as counts, places and labels."""
    from .licenses import license_digest, license_spans

    return license_digest(license_spans(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .licenses import oracle

    return {"op13_license_rules": oracle()}
