"""Re-chunking by difference: only what changed between two versions is chunked and embedded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.chunking import FIELD_KINDS, SECTION_FIELDS, Limits, chunk_results, gathered_sections
from vellum.operators.dense import embed
from vellum.operators.staging import staged

CHUNK_FIELDS = ("chunk_index", "section_ordinal", "text", "start_char", "end_char", "overlap_chars", "page_number", "heading", "heading_level", "heading_path", "failure_reason")


def digest(*parts: Column) -> Column:
    """SHA-256 of values in order; null differs from the empty string, and no two lists share a form."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{n}") for n, p in enumerate(parts)])), 256)


def with_leaves(sections: DataFrame) -> DataFrame:
    """Add ``leaf``, the digest of what decides how a section is cut: its text and how it is split."""
    have = {f: F.col(f) if f in sections.columns else F.lit(None).cast(FIELD_KINDS[f]) for f in SECTION_FIELDS if f not in ("ordinal", "text")}
    return sections.withColumns({**have, "leaf": digest(F.coalesce("text", F.lit("")), F.coalesce(have["paragraph_mode"], F.lit("blank_line")), F.coalesce(have["markdown"], F.lit(False)))})


def roots(leaves: DataFrame) -> DataFrame:
    """``document_id, root``: the digest over a document's sections in order, with their headings and pages."""
    node = F.struct("ordinal", digest(F.col("leaf"), F.col("heading"), F.col("heading_level"), F.col("page_number")).alias("node"))
    return leaves.groupBy("document_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(node))), 256).alias("root"))


def changed_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents of the later version that are new or have another root; both sides have leaves."""
    return roots(after).join(roots(before), ["document_id", "root"], "left_anti").select("document_id")


def leaf_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each document of the later version: its sections, and how many of their texts its earlier version has or lacks."""
    old = with_leaves(before).select("document_id", "leaf", F.lit(True).alias("known")).distinct()
    rows = with_leaves(after).select("document_id", "leaf").join(old, ["document_id", "leaf"], "left")
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("sections"), F.count("known").alias("reused"), F.count_if(F.col("known").isNull()).alias("changed"))


def known_cuts(chunks: DataFrame, leaves: DataFrame) -> DataFrame:
    """``document_id, leaf, spans``: how the earlier version's sections were cut; of equal sections the first counts."""
    cut = F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.col("overlap_chars").alias("shared"))
    own = chunks.groupBy("document_id", F.col("section_ordinal").alias("ordinal")).agg(F.array_sort(F.collect_list(cut)).alias("spans"))
    return own.join(leaves.select("document_id", "ordinal", "leaf"), ["document_id", "ordinal"]).groupBy("document_id", "leaf").agg(F.min_by("spans", "ordinal").alias("spans"))


def rechunk(before: DataFrame, chunks: DataFrame, after: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Chunks of the later version; the same rows as ``chunk_results`` over all its sections.

    ``chunks`` are the earlier version's, made with the same limits. A document
    whose root is the same keeps its rows without being read; in the others only
    sections with a new leaf are cut, and those that are known in the document,
    moved ones too, are sliced at their old places. Numbers and heading paths
    are made anew for a changed document. A document that is gone has no rows;
    one without chunks, or one that failed, is cut again if it changed.
    """
    old, new = (staged(with_leaves(v).select("document_id", "ordinal", "leaf", "heading", "heading_level", "page_number")) for v in (before, after))
    changed = staged(changed_documents(old, new))
    same = new.select("document_id").distinct().join(changed, "document_id", "left_anti")
    have = chunks if "failure_reason" in chunks.columns else chunks.withColumn("failure_reason", F.lit(None).cast("string"))
    kept = have.join(same, "document_id", "left_semi").select("document_id", *CHUNK_FIELDS)
    cuts = known_cuts(have.filter("failure_reason is null").join(changed, "document_id", "left_semi"), old)
    by_leaf = cuts.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "spans"))).alias("known"))
    # All meet by document, so texts are shuffled once.
    work = gathered_sections(with_leaves(after).join(changed, "document_id", "left_semi"), "leaf").join(by_leaf, "document_id", "left")
    placed = F.transform("sections", lambda s: s.withField("spans", F.col("known")[s["leaf"]]))
    return kept.unionByName(chunk_results(work.select("document_id", placed.alias("sections")), limits or Limits()))


def by_length(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows in order of length within each partition, so that a model's batches hold texts of like size."""
    return texts.withColumn("_size", F.length(text_col)).sortWithinPartitions("_size").drop("_size")


def with_outputs(rows: DataFrame, cache: DataFrame, config: str, *, dimension: int = 384, model: str = "hashing", prefix: str = "passage: ") -> tuple[DataFrame, DataFrame]:
    """Rows of ``text`` with ``text_sha256, embedding``, and the outputs that the cache lacked.

    ``cache`` has ``text_sha256, config_id, embedding``. Each distinct text
    meets the model once, if the cache doesn't hold it under this configuration;
    what was made comes back as rows to append. So vectors move with their text,
    whichever chunk or version holds it. A null text is embedded as empty.
    """
    keyed = rows.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    have = cache.filter(F.col("config_id") == config).groupBy("text_sha256").agg(F.first("embedding", ignorenulls=True).alias("embedding")).filter("embedding is not null")
    lacking = keyed.join(have.select("text_sha256"), "text_sha256", "left_anti").groupBy("text_sha256").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    made = staged(embed(by_length(lacking), prefix=prefix, dimension=dimension, model=model).select("text_sha256", F.lit(config).alias("config_id"), "embedding"))
    outputs = have.select("text_sha256", "embedding").unionByName(made.select("text_sha256", "embedding"))
    return keyed.join(outputs, "text_sha256"), made


def numbered(sections: DataFrame, order: str) -> DataFrame:
    """Sections with ordinals from 0 in each document."""
    return sections.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy(order)) - 1)
