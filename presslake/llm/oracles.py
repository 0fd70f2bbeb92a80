"""The operators' results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i FROM w),
win AS (SELECT pos.doc_id, i, list_aggregate(list_slice(words, i, i + 4), 'string_agg', ' ') AS g FROM pos JOIN w USING (doc_id)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (5 * n_symbols > n_words)::INT
             + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (2 * word_chars < 3 * n_words)::INT
             + 32 * (word_chars > 40 * n_words)::INT + 64 * (n_words > 1000000)::INT AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed,
       (failures & 55) = 0 AS kept, failures, CAST(3 AS INTEGER) AS policy_version FROM f
"""



OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS g
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 33, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
flag AS (SELECT doc_id, i, word, coalesce(max(rep.i) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) > i - 35, false) AS gone
         FROM word LEFT JOIN rep USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM flag GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP4 = f"""
WITH item AS (SELECT row_number() OVER () AS r, item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_LOWER} AS w FROM benchmark) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS d, doc_id, {_LOWER} AS w FROM documents),
wanted AS (SELECT DISTINCT r, item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM item)),
own AS (SELECT DISTINCT d, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM doc, (SELECT DISTINCT k FROM item))),
total AS (SELECT r, count(*) AS n FROM wanted GROUP BY r)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS shared, CAST(any_value(n) AS BIGINT) AS item_shingles
FROM wanted JOIN own USING (k, g) JOIN total USING (r) GROUP BY r, item_id, d, doc_id HAVING count(*) >= CAST(0.8 AS DOUBLE) * any_value(n)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda c: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        (CAST('0x' || h[(c // 4) * 5 + 1:(c // 4) * 5 + 5] AS INTEGER) >> CAST(15 - 5 * (c % 4) AS INTEGER)) % 32 + 1]), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_fm_index_dedup": OP3, "op4_benchmark_decontamination": OP4, "op6_warc_writer": OP6, "op9_quality_rules": OP9}
