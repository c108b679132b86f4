"""DuckDB SQL of the operators of this package that SQL can express."""

from __future__ import annotations


def crc_step(value: int) -> int:
    """The entry of CRC-32's table for a byte: eight shifts, with the reversed polynomial where a bit falls out."""
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


TABLE = "[" + ", ".join(str(crc_step(k)) for k in range(256)) + "]::BIGINT[]"
DIGIT = "strpos('0123456789ABCDEF', {h}[{i}]) - 1"
LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8: its bytes from their hex digits, folded over the table."""
    high, low = DIGIT.format(h=f"hex({text})", i="2 * i + 1"), DIGIT.format(h=f"hex({text})", i="2 * i + 2")
    values = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda i: ({high}) * 16 + {low})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda a, b: xor(a >> 8, ({TABLE})[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


WORDS = f"regexp_extract_all({LOWER.format(x='text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x{{7F}}]+')"

IMPORTANCE = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS k, {WORDS} AS words FROM documents), f AS (SELECT k, unnest(words) AS w FROM d), g AS (SELECT unnest({WORDS}) AS w FROM benchmark),
v AS (SELECT w, {crc32("w")} % 10000 AS b FROM (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM g))), s AS (SELECT b, count(*) AS n FROM f JOIN v USING (w) GROUP BY 1), t AS (SELECT b, count(*) AS n FROM g JOIN v USING (w) GROUP BY 1),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS all_s, (SELECT coalesce(sum(n), 0) FROM t) AS all_t),
gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), z),
w AS (SELECT k, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN v USING (w) JOIN gain USING (b) GROUP BY 1),
x AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (k)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS fit FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= fit * 10 // 100 THEN place END AS rank FROM r"""

VARIANTS = f"""WITH RECURSIVE u AS (SELECT doc_id, {LOWER.format(x="run")} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
c AS (SELECT doc_id, run, count(*) AS n FROM u GROUP BY 1, 2), h AS (SELECT run, n, {crc32("doc_id || ':' || run")} AS h FROM c),
p AS (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h), w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM p WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
i AS (SELECT word, unnest(range(length(word))) AS k FROM w), l AS (SELECT word, k, word[:k] || word[k + 2:] AS short FROM i),
e AS (SELECT a.word, b.word AS other FROM l a JOIN l b ON a.short = b.short AND a.k = b.k AND a.word <> b.word UNION SELECT l.word, w.word FROM l JOIN w ON l.short = w.word UNION SELECT w.word, l.word FROM l JOIN w ON l.short = w.word),
m AS (SELECT e.word, count(*) AS n_near, arg_min(e.other, (-o.n, e.other)) AS best, max(o.n) AS best_n FROM e JOIN w o ON o.word = e.other GROUP BY 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM w LEFT JOIN m USING (word)),
r AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
q AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(q.root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN q ON q.word = f.word"""
