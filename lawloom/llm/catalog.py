"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from lawloom.llm.encoding_repair import p4_found
from lawloom.llm.mixing import p7_mixture, p7_shares
from lawloom.llm.near_duplicates import p5_found, p5_groups
from lawloom.llm.packing import p6_fill, p6_packing
from lawloom.llm.reply_defects import p2_found
from lawloom.llm.sentences import p8_found, p8_sentences
from lawloom.llm.splitting import p3_found, p3_pieces

QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p5_found": p5_found, "p5_groups": p5_groups,
    "p6_packing": p6_packing, "p6_fill": p6_fill, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_sentences": p8_sentences,
}
_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"
#: Twins of what SQL can express: lengths and runs of problem 3, all pairs of problem 5. The other operators are tested
#: against brute force, round trips and held-out rows.
ORACLES: dict[str, str] = {
    "p3_found": """
WITH t AS (SELECT 'articles' AS source_table, id AS row_id, content_text AS x FROM articles UNION ALL SELECT 'attachment_extractions', id, text_content FROM attachment_extractions)
SELECT t.source_table, t.row_id, CASE WHEN list_max(list_transform(regexp_split_to_array(x, '[ \\t\\n\\r]'), lambda w: length(w))) > max_chars THEN 1 ELSE 0 END AS long_run
FROM t JOIN split_limits USING (source_table) WHERE length(x) > max_chars
""",
    "p5_found": f"""
WITH t AS (SELECT id, lower(regexp_replace(coalesce(title, '') || ' ' || content_text, '{_SPACE}', '', 'g')) AS x FROM articles WHERE length(content_text) >= 200),
s AS (SELECT DISTINCT id, x[i : i + 4] AS g FROM (SELECT id, x, unnest(range(1, length(x) - 3)) AS i FROM t)), n AS (SELECT id, count(*) AS c FROM s GROUP BY 1),
j AS (SELECT a.id AS p, b.id AS q, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT p AS article_id_a, q AS article_id_b FROM j JOIN n x ON x.id = p JOIN n y ON y.id = q WHERE k >= 0.7 * (x.c + y.c - k)
""",
}
