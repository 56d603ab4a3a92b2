"""SQL that repairs conversations, for checking results: a search from the end, row by row."""

from __future__ import annotations

_CRC_STEP = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"


def _crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {_CRC_STEP}), 4294967295)"


def _more(value: str, cost: str, letters: str) -> str:
    """A way is ten digits of cost, then its audit: the least text is the cheapest, then the ASCII-least."""
    return f"lpad(CAST(CAST(left({value}, 10) AS INTEGER) + {cost} AS VARCHAR), 10, '0') || '{letters}' || substr({value}, 11)"


def _direct(state: int) -> str:
    put = {0: 2, 1: 2, 2: 3, 3: 2}[state]
    keeps = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[state]
    keep = " ".join(f"WHEN NOT forced AND initial = '{i}' THEN {_more(f'v{to}', 'cut', 'K')}" for i, to in keeps)
    retag = f"CASE WHEN NOT forced THEN {_more(f'v{put}', '2 + cut', 'R')} END"
    return f"least({_more(f'v{state}', '3', 'D')}, {retag}, CASE {keep} END)"


def _with_inserts(state: int) -> str:
    after = {0: (2, 3), 1: (2, 3), 2: (3,), 3: (2,)}[state]
    ways = [f"d{state}", *[_more(f"d{to}", str(2 * n), "I" * n) for n, to in enumerate(after, 1)]]
    return f"least({', '.join(ways)})"


_PUT = "CASE state WHEN 2 THEN 'assistant' ELSE 'user' END"
_PUT_STATE = "CASE state WHEN 2 THEN 3 ELSE 2 END"
_KEPT = "CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END"

REPAIR = rf"""
    WITH RECURSIVE damaged AS (
        SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
               CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
               unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM (SELECT *, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
              FROM conversations)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place,
               left(role, 1) AS initial, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last_shown
        FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth,
                    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed),
    faults AS (
        SELECT *, last_shown = '' AS blank, last_shown <> '' AND nth > 1 AS duplicate,
               last_shown <> '' AND nth = 1 AND last_shown NOT IN ('.', '!', '?') AS truncated FROM seen),
    rows AS (SELECT *, blank OR duplicate AS forced, CAST(truncated AS INTEGER) AS cut FROM faults),
    counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
               count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
               count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
    ways(conv_id, place, v0, v1, v2, v3) AS (
        SELECT conv_id, n, '0000000000', '0000000004II', '0000000002I', '0000000000' FROM counts
        UNION ALL
        SELECT conv_id, place, {', '.join(_with_inserts(s) for s in range(4))}
        FROM (SELECT w.conv_id, w.place - 1 AS place, {', '.join(f'{_direct(s)} AS d{s}' for s in range(4))}
              FROM ways w JOIN rows r ON r.conv_id = w.conv_id AND r.place = w.place)),
    best AS (SELECT conv_id, CAST(left(v0, 10) AS BIGINT) AS cost, substr(v0, 11) AS audit FROM ways WHERE place = 0),
    steps(conv_id, audit, spot, place, state, lines) AS (
        SELECT conv_id, audit, 0, 0, 0, CAST([] AS VARCHAR[]) FROM best
        UNION ALL
        SELECT s.conv_id, audit, s.spot + 1, CASE WHEN letter = 'I' THEN s.place ELSE s.place + 1 END,
               CASE letter WHEN 'D' THEN state WHEN 'K' THEN {_KEPT} ELSE {_PUT_STATE} END,
               CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, r.role || ':' || r.text)
                           WHEN 'R' THEN list_append(lines, {_PUT} || ':' || r.text) ELSE list_append(lines, {_PUT} || ':') END
        FROM (SELECT *, substr(audit, spot + 1, 1) AS letter FROM steps WHERE spot < length(audit)) s
        LEFT JOIN rows r ON r.conv_id = s.conv_id AND r.place = s.place + 1),
    repaired AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM steps WHERE spot = length(audit))
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
           CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
           coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id)
    LEFT JOIN repaired USING (conv_id)"""
