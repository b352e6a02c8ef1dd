"""Check SQL of the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

OP8 = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

# Base32 of a SHA-1: the digits' bits in groups of five.
OP2 = """WITH hashed AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(40), lambda i:
    lpad(bin(CAST(strpos('0123456789abcdef', hex[i + 1]) - 1 AS bigint)), 4, '0')), '') AS b FROM hashed)
SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + list_sum(list_transform(range(5), lambda j:
      CAST(b[5 * i + j + 1] AS bigint) * CAST(pow(2, 4 - j) AS bigint))) AS bigint)]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits"""

# CRC-32 of a text: its table, and the fold of the bytes of a UTF-8 text.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8),
  lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END, i::bigint) AS v
  FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(text: str) -> str:
    digit = "strpos('0123456789ABCDEF', hex(encode({0}))[2 * i + {1}]) - 1"
    octets = f"list_transform(range(CAST(strlen({text}) AS bigint)), lambda i: 16 * ({digit.format(text, 1)}) + {digit.format(text, 2)})"
    fold = "lambda c, x: xor(c >> 8, tab[CAST(xor(c & 255, x::bigint) AS bigint) + 1])"
    return f"xor(4294967295::bigint, list_reduce({octets}, {fold}, 4294967295::bigint))"


NO_WAY = "{'c': 1000000000::bigint, 'a': '', 'r': []::varchar[]}"


def _ways(state: str, edits: list[tuple[str, str, str, str, str]]) -> str:
    """The best of several ways into a state: least cost, then letters; what was repaired follows from them."""
    ways = ", ".join(
        f"CASE WHEN {when} THEN {{'c': {source}.c + {cost}, 'a': {source}.a || '{letter}', 'r': {rows}}} ELSE {NO_WAY} END"
        for source, when, cost, letter, rows in edits
    )
    return f"list_min([{ways}]) AS {state}"


def _one_row() -> str:
    """The states after one more row: nothing yet (b), a system row (s), a user row (u), an answer (a)."""
    free, more = "fault NOT IN ('blank', 'duplicate')", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"

    def delete(state: str) -> tuple[str, str, str, str, str]:
        return state, "true", "4", "D", f"{state}.r"

    def keep(state: str, initial: str) -> tuple[str, str, str, str, str]:
        return state, f"{free} AND left(role, 1) = '{initial}'", more, "K", f"list_append({state}.r, role || ':' || text)"

    def rerole(state: str, role: str) -> tuple[str, str, str, str, str]:
        return state, free, f"3 + {more}", "R", f"list_append({state}.r, '{role}:' || text)"

    return ", ".join((
        _ways("b", [delete("b")]),
        _ways("s", [delete("s"), keep("b", "s")]),
        _ways("u", [delete("u"), *(keep(x, "u") for x in "bsa"), *(rerole(x, "user") for x in "bsa")]),
        _ways("a", [delete("a"), keep("u", "a"), rerole("u", "assistant")]),
    ))


def _inserted(states: str) -> str:
    """Rows put in: at most two at a place."""
    def put(state: str, row: str) -> str:
        return f"{{'c': {state}.c + 3, 'a': {state}.a || 'I', 'r': list_append({state}.r, '{row}:')}}"

    users, answers = ", ".join(put(x, "user") for x in "bsa"), put("u", "assistant")
    once = f"SELECT * REPLACE (list_min([u, {users}]) AS u, list_min([a, {answers}]) AS a) FROM"
    return f"({once} ({once} ({states})))"


_FIRST = f"SELECT conv_id, 0::bigint AS i, {NO_WAY.replace('1000000000', '0')} AS b, {NO_WAY} AS s, {NO_WAY} AS u, {NO_WAY} AS a FROM (SELECT DISTINCT conv_id FROM faulty)"
_NEXT = f"SELECT f.conv_id, f.i, {_one_row()} FROM steps p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1"

OP11 = f"""WITH RECURSIVE {CRC_TABLE},
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("(coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' '))")} % 20 AS code
  FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(2) t(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), nth) AS i,
  right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM numbered),
faulty AS (SELECT conv_id, turn, role, text, i, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
  WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
steps AS (SELECT conv_id, i, b, s, u, a FROM {_inserted(_FIRST)}
  UNION ALL SELECT conv_id, i, b, s, u, a FROM {_inserted(_NEXT)}),
decided AS (SELECT conv_id, list_min([b, a]) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM steps) WHERE k = 1),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM faulty GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN decided d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""

# Near words by the texts that are left when one code point goes.
OP12 = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS varchar), '') AS id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS k FROM runs GROUP BY id, run),
hashed AS (SELECT id || ':' || run AS t, run, k, tab FROM counted, crc_table),
coded AS (SELECT run, k, {_crc("t")} AS h FROM hashed),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM coded),
words AS (SELECT word, CAST(sum(k) AS bigint) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
dels AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS del FROM places),
pairs AS (SELECT x.word, y.word AS near, y.n FROM dels x JOIN dels y ON x.del = y.del AND x.p = y.p AND x.word <> y.word
  UNION ALL SELECT w.word, d.word, d.n FROM words w JOIN (SELECT DISTINCT word, n, del FROM dels) d ON d.del = w.word
  UNION ALL SELECT d.word, w.word, w.n FROM words w JOIN (SELECT DISTINCT word, n, del FROM dels) d ON d.del = w.word),
best AS (SELECT word, near, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS k,
  count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.near END AS form,
  CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND b.k = 1),
chains AS (SELECT word, word AS root, form AS following FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.following)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word AND c.following IS NULL"""
