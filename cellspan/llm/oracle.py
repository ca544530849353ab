"""DuckDB SQL for the corpus queries that SQL can express; the others are tested against brute force in ``tests/llm``."""

from __future__ import annotations

OP5_EXACT_DEDUP = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_EXACT_DEDUP}
