"""The whole run: from page readings to batches and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text
from ..operators import batching, fields, match, naming, reference, reports, routing, segment, tagging
from ..operators.scale import by_slices, cut_lineage, in_slice, slices_of

DOC = ["pdf_id", "invoice_index"]

PLACE = ["folder", "pdf_ord", "invoice_index"]  # of a document, in the order of arrival

#: Rows that are exchanged at once, of a run's pages and of its documents: what is beyond goes by slices.
SLICE_PAGES = 1 << 23
SLICE_DOCUMENTS = 1 << 22


@dataclass
class References:
    """Keyed reference tables, built once by :func:`build_references`."""
    sensitive: DataFrame
    entities: DataFrame
    vn: DataFrame
    routing: DataFrame
    translations: DataFrame | None = None
    canonical: dict[str, str] | None = None


def build_references(sensitive_raw, entity_raw, vn_raw, routing_raw, translations, canonical=None) -> References:
    return References(
        reference.sensitive_reference(sensitive_raw), reference.entity_reference(entity_raw, canonical),
        reference.vn_aliases(reference.vn_suppliers(vn_raw, translations)),
        reference.routing_index(routing_raw), translations, canonical)


def documents(page_signals: DataFrame, page_fields: DataFrame, bundles: DataFrame) -> DataFrame:
    """One row per document with its pages, fields and folder, stored.

    ``bundles(pdf_id, folder, folder_ord, pdf_ord, source_file, error)``; bundles with
    an error hold no documents.
    """
    good = bundles.where(F.col("error").isNull()).drop("error")
    read = page_signals.join(good.select("pdf_id"), "pdf_id", "left_semi")

    def part(pages: DataFrame, good: DataFrame) -> DataFrame:
        roles = cut_lineage(fields.segment_stored(pages))
        merged = fields.merge_read(roles).select(*DOC, "bill_to", "po_numbers")
        docs = (segment.document_heads(roles).join(segment.page_runs(roles, stored=True), DOC)
                .join(merged, DOC, "left").join(good, "pdf_id"))
        return docs.withColumn("po_numbers", F.coalesce("po_numbers", F.array().cast("array<string>")))

    def begin():
        pages = cut_lineage(fields.beside_signals(read, page_fields))
        n = slices_of(pages, SLICE_PAGES)
        return n, lambda i: part(in_slice(pages, "pdf_id", i, n), in_slice(good, "pdf_id", i, n))

    return by_slices(bundles.sparkSession, begin)


def output_names(docs: DataFrame) -> DataFrame:
    """``folder, pdf_ord, invoice_index, output_pdf``: ``<supplier>_<number>.pdf``, unique within its folder."""
    stems = docs.select(*PLACE, text.output_stem(
        "supplier_name", "invoice_number", "invoice_index").alias("_stem"))
    return naming.unique_names(stems, "folder", "_stem", "pdf_ord", "_name", "invoice_index").select(
        *PLACE, _pdf("output_pdf"))


def _pdf(name: str):
    return F.concat("folder", F.lit("/"), "_name", F.lit(".pdf")).alias(name)


def vn_suppliers(docs: DataFrame, refs: References, entity: str = lx.VN_ENTITY) -> DataFrame:
    """Supplier match of the distinct suppliers of one entity's documents."""
    mine = docs.where(F.col("le") == entity).select("supplier_name")
    return match.match_vn_supplier(mine, "supplier_name", refs.vn, refs.translations).select(
        F.col("name").alias("supplier_name"), F.col("supplier_id").alias("vn_supplier_id"),
        F.col("translated_query").alias("vn_supplier_name"))


def vn_renames(docs: DataFrame, refs: References, entity: str = lx.VN_ENTITY, found: DataFrame | None = None) -> DataFrame:
    """Supplier match and new file name of the documents of one entity; ``found`` are the matches, where known."""
    mine = docs.where(F.col("le") == entity).select(*PLACE, "supplier_name", "invoice_number", "po_numbers")
    found = vn_suppliers(docs, refs, entity) if found is None else found
    first_po = F.try_element_at("po_numbers", F.lit(1))
    reason = text.missing_fields("vn_supplier_id", first_po, "invoice_number")
    mine = (mine.join(found, "supplier_name", "left").select(
        *PLACE, "vn_supplier_id", "vn_supplier_name", reason.alias("vn_reason"), reason.isNull().alias("vn_renamed"),
        text.renamed_stem("vn_supplier_id", first_po, "invoice_number").alias("_stem")))
    moved = naming.unique_names(mine.where(F.col("_stem").isNotNull()).select(*PLACE, "_stem"),
                                "folder", "_stem", "pdf_ord", "_name", "invoice_index").select(*PLACE, _pdf("_moved"))
    return mine.drop("_stem").join(moved, PLACE, "left")


def enrich(docs: DataFrame, messages: DataFrame, refs: References) -> DataFrame:
    """Matches, tags, mailbox, file names and review reasons of stored documents, stored."""
    return by_slices(docs.sparkSession, lambda: enriched(docs, messages, refs))


def enriched(docs: DataFrame, messages: DataFrame, refs: References,
             observed: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[int, Callable[[int], DataFrame]]:
    """:func:`enrich` for ``by_slices``: names are matched over all documents, the rest goes by slices of the folders."""
    def part(docs, s, e, routes, vn) -> DataFrame:
        both = (docs.join(s, "supplier_name", "left").join(e, "bill_to", "left")
                .fillna({"is_sensitive": False, "sensitive_score": 0, "sensitive_method": "empty",
                         "sensitive_translated": False, "le_matched": False, "le_score": 0, "le_method": "empty",
                         "le_translated": False}))
        tagged = tagging.derive_tags(both, messages, "folder")
        routed = cut_lineage(routing.route(tagged, refs.routing, found=routes))
        named = (routed.join(output_names(routed), PLACE)
                 .join(vn_renames(routed, refs, found=vn), PLACE, "left")
                 .withColumn("output_pdf", F.coalesce("_moved", "output_pdf")).drop("_moved"))
        return observed(routing.review_reasons(named))

    s = match.match_sensitive(docs, "supplier_name", refs.sensitive, refs.translations).select(
        F.col("name").alias("supplier_name"), F.col("matched").alias("is_sensitive"),
        F.col("original").alias("sensitive_name"), F.col("score").alias("sensitive_score"),
        F.col("method").alias("sensitive_method"), F.col("translated").alias("sensitive_translated"),
        F.col("translated_query").alias("sensitive_query"))
    e = match.match_entity(docs, "bill_to", refs.entities, refs.translations, canonical=refs.canonical).select(
        F.col("name").alias("bill_to"), F.col("matched").alias("le_matched"),
        F.col("original").alias("le_matched_name"), "le", "source_site", "country", F.col("score").alias("le_score"),
        F.col("method").alias("le_method"), F.col("translated").alias("le_translated"),
        F.col("translated_query").alias("le_query"))
    n = slices_of(docs, SLICE_DOCUMENTS)
    if n == 1:
        return 1, lambda _: part(docs, s, e, None, None)
    # what is by name is found once, not in every slice
    s, e = cut_lineage(s), cut_lineage(e)
    routes = cut_lineage(routing.routes_of(routing.with_site_key(e), refs.routing))
    vn = cut_lineage(vn_suppliers(docs.select("supplier_name", "bill_to").join(e.select("bill_to", "le"), "bill_to"), refs))
    return n, lambda i: part(in_slice(docs, "folder", i, n), s, e, routes, vn)


def run_flow(page_signals: DataFrame, page_fields: DataFrame, bundles: DataFrame, messages: DataFrame,
             refs: References, run_date, start=1,
             observed: Callable[[DataFrame], DataFrame] = lambda df: df,
             batched: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Every table of a run.

    ``messages(folder, subject, body, msg_path)`` describes the source mails.  Documents and batches are stored once
    because most outputs read them; ``observed`` sees the documents and ``batched`` the batches as they are stored.
    """
    spark = bundles.sparkSession
    mails = messages.select("folder", "subject", "body")
    invoices = by_slices(spark, lambda: enriched(documents(page_signals, page_fields, bundles), mails, refs, observed))
    errors = bundles.where(F.col("error").isNotNull()).select("folder", "folder_ord", "source_file", "error")
    clean, held = batching.quarantine(invoices, errors)
    folders = batching.folder_summary(invoices, errors)
    batches = by_slices(spark, lambda: (1, lambda _: batched(batching.assign_batches(clean, run_date, start))))
    stamped = batching.with_batch_id(clean, batches)
    failures = reports.failure_rows(held, errors)
    return {
        "invoices": invoices, "folders": folders, "batches": batches, "stamped": stamped,
        "invoice_report": reports.invoice_report(invoices),
        "success": reports.success_sheet(folders, batches),
        "failures": reports.failure_sheet(failures),
        "outbound": reports.outbound_manifest(batches, stamped),
        "overview": reports.overview(folders),
    }


def close_run(tables: dict[str, DataFrame], send_results: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """What follows sending: totals, failed batches and the attention manifest."""
    failed = reports.failed_batches(tables["batches"], send_results)
    return {
        "run_stats": reports.run_stats(tables["batches"], send_results, tables["folders"]),
        "failed_batches": failed,
        "attention": reports.attention_manifest(
            tables["folders"], messages.select("folder", "msg_path"), failed, tables["stamped"]),
    }
