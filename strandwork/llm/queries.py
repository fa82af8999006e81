"""The pN_ queries, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from strandwork.llm import p1_neighbours as p1, p2_near as p2, p3_foreign as p3, p4_functions as p4, p5_pieces as p5
from strandwork.llm import p6_clusters as p6, p7_tokens as p7, p8_packing as p8, p9_spans as p9


def queries() -> dict:
    return {
        "p1_found": p1.p1_found,
        "p1_lists": p1.p1_lists,
        "p2_found": p2.p2_found,
        "p2_groups": p2.p2_groups,
        "p3_found": p3.p3_found,
        "p3_signs": p3.p3_signs,
        "p4_found": p4.p4_found,
        "p4_pairs": p4.p4_pairs,
        "p5_found": p5.p5_found,
        "p5_pieces": p5.p5_pieces,
        "p6_found": p6.p6_found,
        "p6_clusters": p6.p6_clusters,
        "p7_ids": p7.p7_ids,
        "p8_containers": p8.p8_containers,
        "p8_report": p8.p8_report,
        "p9_classes": p9.p9_classes,
        "p9_found": p9.p9_found,
        "p9_fuzzy": p9.p9_fuzzy,
        "p9_passages": p9.p9_passages,
        "p9_share": p9.p9_share,
    }


def oracle_sql() -> dict:
    words = "len(regexp_extract_all({0}, '[^ \\t\\r\\n]+')) > 300"
    over = "SELECT DISTINCT '{0}' AS kind, {1} AS item_id FROM {2} WHERE {1} IS NOT NULL AND (length({3}) > 3000 OR " + words.format("{3}") + ")"
    return {"p5_found": over.format("document", "doc_id", "documents", "cleaned_text") + " UNION ALL " + over.format("chunk", "chunk_id", "chunks", "text")}
