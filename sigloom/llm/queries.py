"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import decontaminate, language, lines, mixing, pii, scoring, sharding, simhash, substrings, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_personal_data": pii.op1_personal_data,
        "op2_repeated_windows": substrings.op2_repeated_windows,
        "op3_simhash_components": simhash.op3_simhash_components,
        "op4_hilbert_shards": sharding.op4_hilbert_shards,
        "op5_soft_mixing": mixing.op5_soft_mixing,
        "op6_cgk_matches": decontaminate.op6_cgk_matches,
        "op7_nearest_vectors": vectors.op7_nearest_vectors,
        "op8_word_crf": language.op8_word_crf,
        "op9_near_lines": lines.op9_near_lines,
        "op10_maxent_scores": scoring.op10_maxent_scores,
    }


_OP2 = f"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \\x09-\\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(ws) - {substrings.WINDOW - 1}, 0)), lambda s: {{'s': s, 'g': array_to_string(ws[s + 1 : s + {substrings.WINDOW}], ' ')}})) AS x FROM w),
judged AS (SELECT doc_id, x.s AS s, row_number() OVER (PARTITION BY x.g ORDER BY doc_id, x.s) > 1 AS gone FROM win),
cut AS (SELECT DISTINCT doc_id, s + k AS pos FROM judged, range(0, {substrings.WINDOW}) t(k) WHERE gone),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM each ANTI JOIN cut USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _op4() -> str:
    """Cells by rank, the curve bit by bit, runs of its order."""
    place, following = sharding.curve(3)
    cells = ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {1 << sharding.BITS} * (rank() OVER (ORDER BY {c} NULLS LAST) - 1) // count({c}) OVER () END AS c{k}" for k, c in enumerate(("source", "lang", "size")))
    walk = f"SELECT *, 0::BIGINT AS h, 0 AS s FROM (SELECT *, {cells} FROM described)"
    for b in reversed(range(sharding.BITS)):
        at = "s * 8 + " + " + ".join(f"((c{k} >> {b}) & 1) * {1 << k}" for k in range(3)) + " + 1"
        walk = f"SELECT * EXCLUDE (h, s), h * 8 + {place}[{at}] AS h, {following}[{at}] AS s FROM ({walk})"
    n = sharding.N_SHARDS
    return f"""WITH bytes AS (SELECT doc_id, source, lang, coalesce(strlen(text), 0)::BIGINT + 16 AS size, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
described AS (SELECT doc_id, source, lang, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1]::BIGINT)))::BIGINT AS text_crc32 FROM bytes),
ranked AS (SELECT *, row_number() OVER (ORDER BY h, doc_id, text_crc32, size) - 1 AS r, count(*) OVER () AS total FROM ({walk})),
dealt AS (SELECT *, (r * {n} // total)::INT AS shard FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (r - (shard * total + {n - 1}) // {n})::BIGINT AS slot, NULL::INT AS grown_shard, source, lang FROM dealt"""


_LEAST = lines.LEAST_WORDS
_OP9 = f"""WITH each AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no, trim(line, ' ') AS line FROM each),
d AS MATERIALIZED (SELECT line, string_split(line, ' ') AS ws, len(string_split(line, ' ')) AS n, min((doc_id, line_no)) AS first FROM l WHERE line <> '' GROUP BY line),
v AS MATERIALIZED (SELECT line, n, first, i, array_to_string(ws[1 : i - 1] || ws[i + 1 :], ' ') AS g FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= {_LEAST})),
near AS (
  SELECT line, min(first) OVER (PARTITION BY g, i, n) AS lead FROM v
  UNION ALL SELECT v.line, d.first FROM v JOIN d ON d.line = v.g AND d.n = v.n - 1
  UNION ALL SELECT d.line, v.first FROM v JOIN d ON d.line = v.g AND d.n = v.n - 1),
keep AS (SELECT d.line, least(d.first, coalesce(min(near.lead), d.first)) AS keep FROM d LEFT JOIN near ON near.line = d.line GROUP BY d.line, d.first),
gone AS (SELECT doc_id, line_no FROM l JOIN keep USING (line) WHERE (doc_id, line_no) > keep)
SELECT doc_id, count(*) AS n_lines, count(gone.line_no) AS n_removed, coalesce(string_agg(gone.line_no::VARCHAR, ',' ORDER BY gone.line_no), '') AS removed FROM l LEFT JOIN gone USING (doc_id, line_no) GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_repeated_windows": _OP2, "op4_hilbert_shards": _op4(), "op9_near_lines": _OP9}
