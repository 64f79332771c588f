"""SQL of the newer operators, for the same tables."""

from __future__ import annotations

OP13_SOURCE_DIVERGENCE = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
    ), uses AS (
        SELECT row, lang, source,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item
        FROM docs
    ), kept AS (
        SELECT lang, item, count(*) AS all_uses FROM uses GROUP BY lang, item HAVING count(DISTINCT row) >= 10
    ), used AS (
        SELECT lang, source, item, count(*) AS uses FROM uses GROUP BY lang, source, item
    ), terms AS (
        SELECT lang, count(*) AS v, sum(all_uses) AS all_total FROM kept GROUP BY lang
    ), groups AS (
        SELECT DISTINCT lang, source FROM docs
    ), counted AS (
        SELECT g.lang, g.source, k.item, coalesce(u.uses, 0) AS uses, k.all_uses, sum(coalesce(u.uses, 0)) OVER (PARTITION BY g.lang, g.source) AS total
        FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.item = k.item
    ), shares AS (
        SELECT lang, source, item, uses,
            CAST(1 + (1000000000 * CAST(uses + 2 AS HUGEINT)) // (total + 2 * v) AS BIGINT) AS p,
            CAST(1 + (1000000000 * CAST(all_uses + 2 AS HUGEINT)) // (all_total + 2 * v) AS BIGINT) AS q
        FROM counted JOIN terms USING (lang)
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
            SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
            FROM shares x JOIN shares y ON x.lang = y.lang AND x.item = y.item AND x.source <> y.source GROUP BY ALL
        ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    ), found AS (
        SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
        UNION ALL
        SELECT lang, source, 'term', item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM shares WHERE uses > 0 AND p > q
    )
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM found QUALIFY part = 'pair' OR rank <= 10
"""

OP11_CONVERSATION_REPAIR = r"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(
                    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda crc, byte: list_reduce(
                    list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                    lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT) % 20 AS kind
        FROM conversations
    ), damaged AS (
        SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
        FROM keyed
    ), ordered AS (
        SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged
    ), faulty AS (
        SELECT *, left(role, 1) AS initial, CASE
            WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
        FROM ordered
    ), marked AS (
        SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(class) ELSE class END AS symbol,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS meeting
        FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS class FROM faulty)
    ), nexts(state, nxt) AS (
        VALUES (0, 2), (1, 2), (2, 3), (3, 2)
    ), symbols(symbol, class, more) AS (
        VALUES ('d', 'd', 0), ('s', 's', 0), ('u', 'u', 0), ('a', 'a', 0), ('o', 'o', 0), ('S', 's', 3), ('U', 'u', 3), ('A', 'a', 3), ('O', 'o', 3)
    ), edits AS (
        SELECT symbol, state, state AS to_state, 4 AS cost, 'D' AS letter FROM symbols, nexts
        UNION ALL SELECT symbol, state, nxt, 3 + more, 'R' FROM symbols, nexts WHERE class <> 'd'
        UNION ALL SELECT symbol, state, 1, more, 'K' FROM symbols, nexts WHERE class = 's' AND state = 0
        UNION ALL SELECT symbol, state, nxt, more, 'K' FROM symbols, nexts WHERE (class = 'u' AND nxt = 2) OR (class = 'a' AND nxt = 3)
    ), inserts(state, to_state, cost, letters) AS (
        VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
            (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')
    ), walk AS (
        SELECT conv_id, 0::BIGINT AS pos, to_state AS state, printf('%012d', cost) || letters AS found
        FROM (SELECT DISTINCT conv_id FROM marked), inserts WHERE state = 0
        UNION ALL
        SELECT w.conv_id, w.pos + 1, i.to_state,
            min(printf('%012d', CAST(left(w.found, 12) AS INTEGER) + e.cost + i.cost) || substr(w.found, 13) || e.letter || i.letters)
        FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1
            JOIN edits e ON e.symbol = m.symbol AND e.state = w.state JOIN inserts i ON i.state = e.to_state
        GROUP BY w.conv_id, w.pos, i.to_state
    ), ends AS (
        SELECT w.conv_id, min(w.found) AS found
        FROM walk w JOIN (SELECT conv_id, max(pos) AS pos FROM marked GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos
        WHERE w.state IN (0, 3) GROUP BY w.conv_id
    ), letters AS (
        SELECT conv_id, nth, substr(found, CAST(12 + nth AS INTEGER), 1) AS letter FROM (SELECT conv_id, found, unnest(range(1, len(found) - 11)) AS nth FROM ends)
    ), placed AS (
        SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY nth) AS pos FROM letters
    ), left_over AS (
        SELECT p.conv_id, p.nth, p.letter, m.role, m.text, CASE WHEN letter = 'K' AND m.initial = 's' THEN 1 ELSE 0 END AS opening
        FROM placed p LEFT JOIN marked m ON p.letter <> 'I' AND m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.pos = p.pos
        WHERE p.letter <> 'D'
    ), written AS (
        SELECT conv_id, nth, CASE WHEN letter = 'K' THEN role WHEN (row_number() OVER o - sum(opening) OVER o) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line
        FROM left_over WINDOW o AS (PARTITION BY conv_id ORDER BY nth)
    ), texts AS (
        SELECT conv_id, string_agg(line, chr(10) ORDER BY nth) AS text FROM written GROUP BY conv_id
    ), counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
            count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
            count(*) FILTER (WHERE meeting NOT IN ('su', 'ua', 'au')) AS illegal
        FROM marked GROUP BY conv_id
    )
    SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
        coalesce(n.illegal, 0) AS illegal, CAST(coalesce(left(e.found, 12), '0') AS BIGINT) AS cost, coalesce(substr(e.found, 13), '') AS audit,
        sha256(coalesce(t.text, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
