"""The queries as DuckDB SQL, where SQL can express them.

Token ids and counts (3, 4, 9) and the trained scores (8) have no SQL; tests hold them
against the tokenizer libraries and held-out labels.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from tallymart.llm.queries import MIX_BLOCK, MIX_SEED, MIX_WEIGHTS

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
TEXT = "coalesce(text, '')"

MIX = f"""
WITH RECURSIVE
weighted(place, source, part) AS (
  VALUES {", ".join(f"({k}, '{name}', {part})" for k, (name, part) in enumerate(MIX_WEIGHTS.items()))}
),
present AS (
  SELECT source, part, n, row_number() OVER (ORDER BY place) AS s
  FROM weighted JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)
),
lists AS (
  SELECT list(part ORDER BY s) AS parts, list(n ORDER BY s) AS sizes,
    CAST(sum(part) AS BIGINT) AS period, count(*) AS k FROM present
),
run(slot, done) AS (
  SELECT CAST(0 AS BIGINT), list_transform(parts, lambda p: CAST(0 AS BIGINT)) FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda n, i: n + CAST(i = chosen AS BIGINT))
  FROM (
    SELECT slot, done, period, list_min(list_transform(range(1, k + 1), lambda i:
        CASE WHEN done[i] * period // parts[i] <= slot
             THEN ((done[i] + 1) * period + parts[i] - 1) // parts[i] * 100000 + i END)) % 100000 AS chosen
    FROM run, lists
  ) WHERE slot < period
),
period_slots AS (
  SELECT a.slot AS place, a.done AS before,
    list_position(list_transform(range(1, k + 1), lambda i: b.done[i] > a.done[i]), true) AS s
  FROM run a JOIN run b ON b.slot = a.slot + 1, lists
),
turns AS (SELECT place, before, s, before[s] AS turn FROM period_slots),
idle AS (
  SELECT min(greatest((n // {MIX_BLOCK} - turn + part - 1) // part, 0) * period + place) AS slot
  FROM turns JOIN present USING (s), lists
),
numbered AS (
  SELECT doc_id, source,
    row_number() OVER (PARTITION BY source ORDER BY md5('{MIX_SEED}:' || doc_id), doc_id) - 1 AS number
  FROM documents
),
placed AS (
  SELECT d.doc_id, d.source, number, number // {MIX_BLOCK} AS block, place, before, parts, sizes, period, k,
    number // {MIX_BLOCK} // part AS round
  FROM numbered d JOIN present p ON d.source = p.source
    JOIN turns t ON t.s = p.s AND t.turn = number // {MIX_BLOCK} % part, lists
)
SELECT doc_id, source, number, block, round * period + place AS slot,
  CAST(list_sum(list_transform(range(1, k + 1), lambda i:
    least(sizes[i], (round * parts[i] + before[i]) * {MIX_BLOCK}))) + number % {MIX_BLOCK} AS BIGINT) AS position,
  round * period + place < (SELECT slot FROM idle) AS in_mix
FROM placed
UNION ALL
SELECT doc_id, source, NULL, NULL, NULL, NULL, false FROM documents
WHERE source IS NULL OR source NOT IN (SELECT source FROM present)"""

NEAR = f"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate({TEXT}, '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w
  FROM documents
),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
  FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
  WHERE 100 * shared >= 80 * (a.n + b.n - shared)
),
sides AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, s.v FROM reached r JOIN sides s ON s.u = r.other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)"""

EXACT = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256({TEXT}) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY {TEXT})"""


def left(pattern: str) -> str:
    return f"length(regexp_replace({TEXT}, '{pattern}', '', 'g'))"


QUALITY = f"""
WITH words AS (
  SELECT doc_id, {TEXT} AS text, regexp_extract_all({TEXT}, '{WORD}') AS w,
    list_filter(string_split({TEXT}, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents
),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS place,
    unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS said
  FROM words
),
many AS (SELECT doc_id, place FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, said) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place + k) AS n FROM many, range(5) AS five(k) GROUP BY doc_id
),
measured AS (
  SELECT doc_id, len(w) AS n_words, {left(SPACE + "+")} AS word_chars,
    length(text) - {left("[#*$%&|<>]+")} AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    {left("[^" + chr(92) + "p{L}]+")} AS n_letters, {left("[^" + chr(92) + "p{Lu}]+")} AS n_capitals,
    (length(text) - length(replace(text, '!!', ''))) // 2 AS n_shouts
  FROM words LEFT JOIN covered USING (doc_id)
),
judged AS (
  SELECT *, CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT)
    + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(2 * n_dup_lines > n_lines AS BIGINT)
    + 16 * CAST(word_chars < 2 * n_words OR word_chars > 20 * n_words AS BIGINT)
    + 32 * CAST(2 * n_capitals > n_letters AS BIGINT) + 64 * CAST(5 * n_shouts > n_words AS BIGINT)
    + 128 * CAST(4 * n_letters < word_chars AS BIGINT) AS failed
  FROM measured
)
SELECT *, failed & 3 > 0 AS base_failed, failed = 0 AS kept FROM judged"""

BACKSLASH = "chr(92)"


def escaped(text: str) -> str:
    doubled = f"replace({text}, {BACKSLASH}, {BACKSLASH} || {BACKSLASH})"
    return f"replace({doubled}, '<|', '<' || {BACKSLASH} || '|')"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, {TEXT} AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
    (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
),
said AS (
  SELECT *, '<|im_start|>' || replace({escaped("role")}, chr(10), {BACKSLASH} || 'n') || chr(10)
    || {escaped("text")} || '<|im_end|>' || chr(10) AS segment,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""

WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM payloads),
typed AS (SELECT *, n >= 1000 AND page_id <> first AS again FROM grouped)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM typed"""


def registered() -> dict[str, str]:
    return {
        "op1_pfair_mix": MIX,
        "op2_minhash": NEAR,
        "op5_exact_dedup": EXACT,
        "op6_quality_rules": QUALITY,
        "op7_chat_format": CHAT,
        "op10_warc": WARC,
    }
