"""DuckDB SQL for the queries that SQL can express over whole tables."""

W = r"'[^\x20\x09-\x0D]+'"
LOW = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CODED = r"(length({0}) + length(regexp_replace({0}, '[^\\<#:]', '', 'g')))"

OP7 = rf"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    g AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles, count(*) AS n_turns,
      string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
      coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
      count(*) FILTER (role IN ('human', 'gpt')) AS other, sum({CODED.format('role')} + {CODED.format('text')} + 14) AS formatted_chars FROM r GROUP BY 1)
    SELECT conv_id, CASE WHEN roles = 'user,assistant' THEN 'prompt' WHEN roles = 'system,user,assistant' THEN 'instruction'
      WHEN conv_id % 2 = 0 OR other > 0 THEN 'messages' ELSE 'from_value' END AS layout, n_turns, sha256(said) AS turns_sha256,
      length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""

OP10 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, regexp_extract_all(t, {W}) AS ws FROM d),
    pos AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
    win AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS k
      FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
    rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win WHERE k IS NOT NULL) WHERE c > 1),
    rw AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(o) GROUP BY 1),
    lines AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS l FROM d),
    filled AS (SELECT rid, host, l, len(regexp_extract_all(l, {W})) AS n FROM lines WHERE regexp_matches(l, {W})),
    dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM filled GROUP BY 1),
    nl AS (SELECT rid, host, array_to_string(regexp_extract_all(regexp_replace({LOW}, '[1-9]', '0', 'g'), {W}), ' ') AS k, sum(n) AS words FROM filled GROUP BY 1, 2, 3),
    pg AS (SELECT rid, md5(string_agg(k, chr(10) ORDER BY k)) AS page FROM nl GROUP BY 1),
    b AS (SELECT host, k FROM nl JOIN pg USING (rid) GROUP BY 1, 2 HAVING count(DISTINCT page) > 20),
    hit AS (SELECT rid, count(*) AS nb, sum(words) AS bw FROM nl JOIN b ON nl.host IS NOT DISTINCT FROM b.host AND nl.k = b.k GROUP BY 1),
    o AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(dup.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(nb, 0) AS n_boilerplate, coalesce(bw, 0) AS boilerplate_words
      FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rw USING (rid) LEFT JOIN hit USING (rid)),
    v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - boilerplate_words < 0.2 * n_words AS depleted FROM o)
    SELECT CAST(doc_id AS BIGINT) AS doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boilerplate,
      CAST(boilerplate_words AS BIGINT) AS boilerplate_words, base_failed, depleted, NOT base_failed AND NOT depleted AS kept FROM v"""

#: CRC-32 of a decimal, byte by byte and bit by bit: -1 stands for one shift.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda k: [ascii(substr(c::VARCHAR, k::BIGINT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

OP12 = rf"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS i, m, w FROM (
      SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
        len(regexp_extract_all(coalesce(text, ''), {W})) AS w FROM conversations WHERE conv_id IS NOT NULL)),
    z AS MATERIALIZED (SELECT c, {CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
    heads AS (SELECT z.c, b.i + 1 AS pos, b.m, b.w FROM z JOIN t b ON b.c = z.c - z.c % 20 AND b.i < z.h),
    lent AS (SELECT c, count(*) AS n FROM heads GROUP BY 1),
    rows AS (SELECT * FROM heads UNION ALL SELECT z.c, coalesce(lent.n, 0) + t.i - z.h + 1, t.m, t.w FROM z JOIN t ON t.c = z.c AND t.i >= z.h LEFT JOIN lent ON lent.c = z.c),
    p AS MATERIALIZED (SELECT c, 0 AS pos, '' AS k, 0 AS w FROM z UNION ALL
      SELECT c, pos, string_agg(m, '') OVER (PARTITION BY c ORDER BY pos) AS k, w FROM rows),
    n AS MATERIALIZED (SELECT k, pos, min(c) AS c, count(*) AS members, max(w) AS w FROM p GROUP BY 1, 2),
    kids AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n FROM n WHERE pos > 0 GROUP BY 1),
    below AS (SELECT a.k, count(*) FILTER (kids.n IS NULL) AS leaves, sum((y.members - 1) * y.w) AS saved
      FROM n y LEFT JOIN kids ON kids.k = y.k JOIN p a ON a.c = y.c AND a.pos <= y.pos GROUP BY 1),
    ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM p JOIN (SELECT c, max(pos) AS pos FROM p GROUP BY 1) e USING (c, pos) GROUP BY 1)
    SELECT CAST(n.c AS BIGINT) AS conv_id, CAST(n.pos AS BIGINT) AS depth, CAST(u.c AS BIGINT) AS parent_conv_id, n.members AS n_convs, coalesce(kids.n, 0) AS n_children,
      below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
    FROM n JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN n u ON n.pos > 0 AND u.k = left(n.k, length(n.k) - 32)"""

ORACLES: dict[str, str] = {"op7_chat_schema": OP7, "op10_line_frequency": OP10, "op12_prefix_trie": OP12}
