"""SQL for the text similarity functions: hashed character n-grams and the partial ratio of a short text."""

from __future__ import annotations

from vexel.functions.text import BUCKETS, NGRAMS

_MASK = 0xFFFFFFFF
#: Fixed values of MurmurHash3 x86 32 bit.
_C1, _C2, _ADD, _F1, _F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
#: An n-gram has six characters of four bytes at most.
_WORDS = NGRAMS[1]


def _scrambled(word: str) -> str:
    turned = f"(({word}) * {_C1} & {_MASK})"
    return f"((({turned} * 32768 & {_MASK}) | ({turned} // 131072)) * {_C2} & {_MASK})"


def murmur_sql(source: str) -> str:
    """g and its signed hash s, for the texts g of source."""
    sql = f"SELECT g, x, length(x) // 2 AS size, length(x) // 8 AS words, 0::UBIGINT AS h FROM (SELECT g, hex(encode(g)) AS x FROM ({source}))"
    for b in range(_WORDS):
        word = "('0x' || " + " || ".join(f"substr(x, {8 * b + k}, 2)" for k in (7, 5, 3, 1)) + ")::UBIGINT"
        sql = f"SELECT *, CASE WHEN {b} < words THEN xor(h, {_scrambled(word)}) END AS a FROM ({sql})"
        sql = f"SELECT g, x, size, words, CASE WHEN a IS NULL THEN h ELSE (((a * 8192 & {_MASK}) | (a // 524288)) * 5 + {_ADD}) & {_MASK} END AS h FROM ({sql})"
    tail = "('0x' || substr(x, 8 * words + 5, 2) || substr(x, 8 * words + 3, 2) || substr(x, 8 * words + 1, 2))::UBIGINT"
    sql = f"SELECT g, size, CASE WHEN size % 4 > 0 THEN xor(h, {_scrambled(tail)}) ELSE h END AS h FROM ({sql})"
    sql = f"SELECT g, xor(h, size::UBIGINT) AS h FROM ({sql})"
    sql = f"SELECT g, (xor(h, h // 65536) * {_F1}) & {_MASK} AS h FROM ({sql})"
    sql = f"SELECT g, (xor(h, h // 8192) * {_F2}) & {_MASK} AS h FROM ({sql})"
    sql = f"SELECT g, xor(h, h // 65536)::BIGINT AS h FROM ({sql})"
    return f"SELECT g, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS s FROM ({sql})"


def features_sql(source: str) -> str:
    """Common tables ending in features (id, bucket, v, norm), one row for each bucket of every row (id, t) of source."""
    return f"""src AS (SELECT id, regexp_replace(lower(coalesce(t, '')), '\\s\\s+', ' ', 'g') AS t FROM ({source})),
lengths AS (SELECT id, t, unnest(range({NGRAMS[0]}, {NGRAMS[1] + 1})) AS n FROM src),
cuts AS (SELECT id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM lengths),
counted AS (SELECT id, substr(t, i, n) AS g, count(*) AS c FROM cuts GROUP BY ALL),
hashed AS MATERIALIZED ({murmur_sql("SELECT DISTINCT g FROM counted")}),
sums AS (SELECT id, abs(s) % {BUCKETS} AS bucket, sum(CASE WHEN s >= 0 THEN c ELSE -c END)::DOUBLE AS v FROM counted JOIN hashed USING (g) GROUP BY ALL),
every AS (SELECT id, unnest(range({BUCKETS})) AS bucket FROM src),
raw AS (SELECT e.id, e.bucket, coalesce(v, 0::DOUBLE) AS v FROM every e LEFT JOIN sums s ON s.id = e.id AND s.bucket = e.bucket),
features AS (SELECT id, bucket, v, sqrt(sum(v * v) OVER (PARTITION BY id)) AS norm FROM raw)"""


def partial_ratio_sql(query: str, source: str) -> str:
    """id and ratio of the rows (id, t) of source to a query of at most 30 characters."""
    m, quoted = len(query), "'" + query.replace("'", "''") + "'"
    steps = "SELECT id, m, n, win, places, (1::BIGINT << m) - 1 AS lim, (1::BIGINT << m) - 1 AS state FROM windows"
    for j in range(1, m + 1):
        steps = f"SELECT *, CASE WHEN {j} <= n THEN state & coalesce(places[substr(win, {j}, 1)], 0) ELSE 0 END AS hit FROM ({steps})"
        steps = f"SELECT id, m, n, win, places, lim, ((state + hit) | (state - hit)) & lim AS state FROM ({steps})"
    return f"""WITH src AS (SELECT id, t FROM ({source})),
pairs AS (SELECT id, {quoted} AS short, t AS long FROM src WHERE length(t) >= {m} UNION SELECT id, t, {quoted} FROM src WHERE length(t) BETWEEN 1 AND {m}),
letters AS (SELECT id, short, long, unnest(range(length(short))) AS k FROM pairs),
bits AS (SELECT id, short, long, substr(short, k + 1, 1) AS c, sum(1::BIGINT << k)::BIGINT AS b FROM letters GROUP BY ALL),
known AS (SELECT id, short, long, length(short) AS m, map_from_entries(list((c, b))) AS places FROM bits GROUP BY id, short, long),
windows AS (
  SELECT id, m, places, m AS n, substr(long, i + 1, m) AS win FROM (SELECT *, unnest(range(length(long) - m + 1)) AS i FROM known)
  UNION ALL SELECT id, m, places, n, left(long, n) FROM (SELECT *, unnest(range(1, m)) AS n FROM known)
  UNION ALL SELECT id, m, places, n, right(long, n) FROM (SELECT *, unnest(range(1, m)) AS n FROM known)
),
scored AS (SELECT id, max(2 * (m - bit_count(state)) / (m + n)::DOUBLE) AS best FROM ({steps}) GROUP BY id)
SELECT id, CAST(coalesce(round_even(100 * best, 0), 0) AS INT) AS ratio FROM src LEFT JOIN scored USING (id)"""
