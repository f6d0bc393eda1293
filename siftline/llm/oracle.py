"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The 256 steps of the crc32 checksum, made from its polynomial.
_CRC_STEPS = """crc_steps AS (SELECT list(v ORDER BY i) AS steps FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of `text`, beside a column `steps`."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})) + 1, 2), lambda k: ('0x' || substr(hex(encode({text})), k, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295]::BIGINT[] || {octets}, lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text}, '{_CAPITALS}', '{_SMALL}')"


def _words(table: str, key: str) -> str:
    return rf"SELECT {key}, regexp_extract_all({_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM {table}"


IMPORTANCE = f"""WITH {_CRC_STEPS},
doc_words AS ({_words('documents', 'doc_id')}),
doc_each AS (SELECT doc_id, unnest(t) AS w FROM doc_words),
target_each AS (SELECT unnest(t) AS w FROM ({_words('benchmark', 'item_id')})),
hashed AS (SELECT w, {_crc32('w')} % 10000 AS b FROM (SELECT w FROM doc_each UNION SELECT w FROM target_each), crc_steps),
s AS (SELECT b, count(*) AS s FROM doc_each JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM target_each JOIN hashed USING (w) GROUP BY b),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gains AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1e0) * (ss + 1e4) / ((coalesce(s, 0) + 1e0) * (tt + 1e4)))) AS gain
  FROM s FULL JOIN t USING (b), totals),
weighed AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM doc_each JOIN hashed USING (w) JOIN gains USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
  count(*) FILTER (WHERE n_features >= 20) OVER () AS pool FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * pool // 100 THEN place END AS "rank" FROM placed"""

_RUNS = r"unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+'))"

SPELLING = f"""WITH RECURSIVE {_CRC_STEPS},
runs AS (SELECT doc_id, {_lower(_RUNS)} AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM counted, crc_steps),
cut AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
lacking AS MATERIALIZED (SELECT word, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS k FROM words)),
pairs AS (SELECT a.word, b.word AS other FROM lacking a JOIN lacking b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM lacking WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM lacking WHERE rest IN (SELECT word FROM words)),
near AS (SELECT p.word, p.other, o.n AS other_n, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS place,
  count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN words o ON o.word = p.other),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
  CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN (SELECT * FROM near WHERE place = 1) b ON b.word = w.word),
chain AS (SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, max_by(root, steps) AS root FROM chain GROUP BY word) USING (word)"""

# Products are added up in the order of the components, as the operator adds them.
NEIGHBOURS = """WITH vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
  list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

ORACLE: dict[str, str] = {"op11_importance": IMPORTANCE, "op12_spelling": SPELLING, "op13_neighbours": NEIGHBOURS}
