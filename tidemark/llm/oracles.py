"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.bag_minhash import SIMILARITY
from tidemark.llm.chat import CONTROL_STRINGS
from tidemark.llm.host_rules import CAUTION, HOST_LIMIT, RULES

_WORD = r"'[^\x20\x09-\x0D]+'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _added(column: str) -> str:
    """Characters that escaping adds to a column."""
    counts = [
        f"(length({column}) - length(replace({column}, {_text(x)}, ''))) // {len(x)}"
        for x in [*CONTROL_STRINGS, "\\"]
    ]
    return " + ".join(counts)


OP1 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, if(role = 'assistant', text, '') AS loss,
    12 + length(role) + {_added('role')}
      + 2 * (length(role) - length(replace(replace(role, '%', ''), chr(10), '')))
      + 1 + length(text) + {_added('text')} + 11 AS formatted
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _op3() -> str:
    shares, moments, lower = [], [], []
    for name, rule in RULES.items():
        shares.append(f"count(*) FILTER ({rule}) AS {name}")
        mean = f"(sum({name}) / sum(n))"
        chance = f"({mean} * (1 - {mean}))"
        room = "(sum(n) - sum(n * n) / sum(n) - (count(*) - 1))"
        inner = f"sum({name} * {name} / n) - sum({name}) * {mean} - {chance} * (count(*) - 1)"
        between = f"(({inner}) / ({chance} * {room}))"
        moments.append(f"{mean} AS {name}_mean")
        moments.append(
            f"CASE WHEN {chance} <= 0 THEN NULL WHEN {room} <= 0 THEN 0 WHEN {between} <= 0 THEN NULL"
            f" ELSE greatest(1 / least({between}, 1) - 1, 0) END AS {name}_strength"
        )
        share = (
            f"coalesce(({name} + {name}_mean * {name}_strength) / (n + {name}_strength), {name}_mean)"
        )
        weight = f"coalesce(n + {name}_strength + 1, 1e18)"
        lower.append(f"{share} - {CAUTION} * sqrt({share} * (1 - {share}) / {weight})")
    return f"""
WITH split AS (
  SELECT doc_id, source, text, row_number() OVER () AS r,
    regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), places AS (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM split
), windows AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM places
), found AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, g) AS times FROM windows
), covered AS (
  SELECT r, count(DISTINCT q) AS n FROM (
    SELECT r, p + unnest([0, 1, 2]) AS q FROM found WHERE times >= 2) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(DISTINCT l) AS d FROM (
    SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM split)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r
), measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_lines,
    coalesce(lines.n - lines.d, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
), hosts AS (
  SELECT source, count(*) AS n, {', '.join(shares)} FROM measured GROUP BY source
), prior AS (SELECT {', '.join(moments)} FROM hosts
), verdicts AS (
  SELECT source, greatest({', '.join(lower)}) > {HOST_LIMIT} AS rejected FROM hosts, prior
), judged AS (
  SELECT *, ({RULES['short']}) OR ({RULES['repetitive']}) AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


OP5 = f"""
WITH RECURSIVE texts AS (
  SELECT text, row_number() OVER () AS id, regexp_extract_all(text, {_WORD}) AS w
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
), runs AS (
  SELECT id, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM texts
), bags AS (SELECT id, x, count(*) AS n FROM runs GROUP BY ALL
), sizes AS (SELECT id, sum(n) AS n FROM bags GROUP BY ALL
), shared AS (
  SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS n
  FROM bags a JOIN bags b ON a.x = b.x AND a.id < b.id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
  WHERE shared.n / CAST(x.n + y.n - shared.n AS DOUBLE) >= {SIMILARITY}
), steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT id, id AS r FROM texts
  UNION SELECT reach.id, steps.b FROM reach JOIN steps ON reach.r = steps.a
), roots AS (SELECT id, min(r) AS root FROM reach GROUP BY ALL
), named AS (SELECT text, root FROM texts JOIN roots USING (id)
), classes AS (
  SELECT root, min(doc_id) AS class_id FROM documents JOIN named USING (text) GROUP BY ALL
)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN named USING (text) LEFT JOIN classes USING (root)
"""

OP11 = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM vectors a, vectors b WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scores WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1, "op3_host_rules": _op3(), "op5_bag_minhash": OP5, "op11_hard_negatives": OP11}
