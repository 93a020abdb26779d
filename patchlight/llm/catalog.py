"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchlight.llm import queries as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in vars(Q).items() if name.startswith("op") and callable(query)
}

_SAID = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"
_ROLE = _ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")

# The other queries have no SQL form: tokenizers, learned models, hashes of 64 bits and repeated
# strings of all lengths are compared with the libraries and with brute force in tests/llm.
SQL: dict[str, str] = {
    "op3_chat_formatting": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID})
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(24 + length({_ROLE}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op12_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        words AS (
            SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
        kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT i) >= 10),
        found AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        groups AS (
            SELECT d.lang, d.source, coalesce(v, 0) AS v, coalesce(total, 0)::HUGEINT AS total
            FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN sizes s ON s.lang = d.lang
            LEFT JOIN (SELECT lang, source, sum(n) AS total FROM found GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
            FROM groups g JOIN kept k ON k.lang = g.lang
            LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
        overall AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS q
            FROM shares JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
            LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
            GROUP BY ALL),
        terms AS (
            SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
            FROM shares JOIN overall USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
               (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
        UNION ALL
        SELECT lang, source, 'term', item, value::BIGINT,
               (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms QUALIFY rank <= 10""",
}
