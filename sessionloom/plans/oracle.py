"""DuckDB views of the entities, as common table expressions that oracle SQL starts with."""

from __future__ import annotations

from sessionloom.sources.catalog import FACT_COLUMNS

__all__ = ["FACTS", "MESSAGES", "SESSIONS", "TAGS", "TENANTS", "VECTORS", "with_"]

FACTS = "facts AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in FACT_COLUMNS.items()) + " FROM events)"
MESSAGES = "messages AS (SELECT conv_id AS session_id, turn AS position, CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'AGENT' ELSE upper(role) END AS said_by, text AS message FROM conversations)"
TENANTS = "tenants AS (SELECT CAST(r_regionkey AS BIGINT) AS tenant_id, r_name AS tenant_name, replace(lower(r_name), ' ', '_') AS tenant_slug, r_regionkey <> 3 AS is_active FROM region)"
TAGS = "tags AS (SELECT CAST(n_nationkey AS BIGINT) AS tag_id, CAST(n_regionkey AS BIGINT) AS tenant_id, lower(n_name) AS tag_name, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'about ' || lower(n_name) END AS tag_description, n_nationkey % 6 <> 5 AS is_active FROM nation)"
VECTORS = "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)"
#: Sessions folded from messages: first two messages dropped, speakers as prefixes.
SESSIONS = """ranked AS (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position, said_by) AS rn FROM messages WHERE said_by IN ('USER', 'AGENT')
), sessions AS (
    SELECT session_id, CAST(count(*) AS BIGINT) AS n_messages,
        count(*) FILTER (said_by = 'USER') AS n_user, count(*) FILTER (said_by = 'AGENT') AS n_agent,
        min(position) AS first_position, max(position) AS last_position,
        coalesce(string_agg(CASE said_by WHEN 'USER' THEN '[UTENTE] ' ELSE '[ASSISTENTE] ' END || message, ' ' ORDER BY rn) FILTER (rn > 2), '') AS full_text
    FROM ranked GROUP BY session_id
)"""


def with_(*parts: str) -> str:
    """The WITH clause of some of the views."""
    return "WITH " + ", ".join(parts) + "\n"
