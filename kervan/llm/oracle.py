"""SQL for those of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {
    "p4_found": """SELECT 'dosage_information' AS field, medicine_id AS row_id FROM medicines WHERE length(dosage_information) > 1200
        UNION ALL SELECT 'warnings', medicine_id FROM medicines WHERE length(warnings) > 1200
        UNION ALL SELECT 'chunk_text', chunk_id FROM document_chunks WHERE length(chunk_text) > 1200""",
}
