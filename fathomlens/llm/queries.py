"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_bpe_encode_decode
from .chat_format import END, ESCAPES, TEXT, TURN, op10_chat_format
from .decontaminate import op3_benchmark_decontamination
from .embedding_dedup import op5_embedding_near_dedup
from .filter_audit import ORACLE as _OP13
from .filter_audit import op13_filter_interaction_audit
from .language_id import op2_language_id
from .license_scan import op7_license_scan
from .near_dedup import op4_minhash_near_dedup
from .quality import op1_quality_classifier
from .sentence_pieces import op12_sentencepiece_encode_decode
from .token_counts import op6_token_counts
from .url_filter import op8_url_filter
from .vector_codes import ORACLE as _OP11
from .vector_codes import op11_vector_code_compression

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_language_id,
        op3_benchmark_decontamination,
        op4_minhash_near_dedup,
        op5_embedding_near_dedup,
        op6_token_counts,
        op7_license_scan,
        op8_url_filter,
        op9_bpe_encode_decode,
        op10_chat_format,
        op11_vector_code_compression,
        op12_sentencepiece_encode_decode,
        op13_filter_interaction_audit,
    )
}

_REACH = """reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)"""

_OP4 = f"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))
), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY 1) c ON c.node = d.doc_id"""

_OP5 = f"""WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9
), {_REACH}
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id, v.vec_id <= coalesce(c.low, v.vec_id) AS kept, 1.0::DOUBLE AS recall
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) l ON l.a = v.vec_id LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY 1) c ON c.node = v.vec_id"""


def _escaped(column: str) -> str:
    for plain, safe in ESCAPES:
        column = f"replace({column}, '{plain}', '{safe}')"
    return column


_OP10 = f"""WITH t AS (
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), a AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        CAST(sum({len(TURN) + len(TEXT) + len(END)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
    FROM t GROUP BY 1
)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""

ORACLE_SQL: dict[str, str] = {"op4_minhash_near_dedup": _OP4, "op5_embedding_near_dedup": _OP5, "op10_chat_format": _OP10, "op11_vector_code_compression": _OP11, "op13_filter_interaction_audit": _OP13}
