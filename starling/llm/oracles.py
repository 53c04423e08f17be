"""DuckDB SQL for the queries that SQL can express. The others are tested against plain Python, an exact round trip, or
held-out labels."""

COVER_TREE = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS z
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.z) = len(c.z) WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

LINE_DEDUP = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM d WHERE len(l) >= 3),
k AS (
  SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS lines FROM w
  WHERE trim(l[p + 1] || l[p + 2] || l[p + 3]) <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id, p) AS r FROM k),
c AS (SELECT doc_id, list_distinct(flatten(list([p + 1, p + 2, p + 3]))) AS covered FROM f WHERE r > 1 GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN covered IS NULL THEN d.text
       ELSE array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(covered, i)], chr(10)) END AS text,
  CAST(coalesce(len(covered), 0) AS INTEGER) AS lines_removed
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
    IF x <> ''] AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_sort(CASE
    WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, chr(10))) AS own FROM s),
u AS MATERIALIZED (SELECT own, min(doc_id) AS rep, any_value(n) AS n, count(*) AS n_copies FROM n WHERE n > 0 GROUP BY own),
e AS MATERIALIZED (SELECT rep, unnest(sh) AS t FROM u JOIN s ON s.doc_id = u.rep),
f AS MATERIALIZED (SELECT * FROM e WHERE t IN (SELECT t FROM e GROUP BY t HAVING count(*) > 1)),
shared AS MATERIALIZED (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM f a JOIN f b ON a.t = b.t AND a.rep <> b.rep GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN u a ON a.rep = x JOIN u b ON b.rep = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(rep, other) AS (
  SELECT rep, rep FROM u UNION SELECT reach.rep, links.y FROM reach JOIN links ON links.x = reach.other),
comp AS (SELECT rep, min(other) AS component_id FROM reach GROUP BY rep),
l AS (SELECT x AS rep, count(*) AS n_links FROM links GROUP BY x)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(component_id, n.doc_id) AS component_id,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies
FROM n LEFT JOIN u ON n.n > 0 AND u.own = n.own LEFT JOIN comp ON comp.rep = u.rep LEFT JOIN l ON l.rep = u.rep
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS z
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.z, c.z) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.z) = len(c.z) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
  WHERE r <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

# The CRC-32 table follows from its polynomial, eight steps an entry; bytes are read from their hex digits.
RESAMPLING = r"""
WITH tab AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
w AS MATERIALIZED (
  SELECT name, id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws
  FROM (SELECT 's' AS name, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
f AS MATERIALIZED (
  SELECT name, id, unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS feature FROM w),
n AS MATERIALIZED (SELECT name, id, feature, count(*) AS c FROM f GROUP BY ALL),
h AS MATERIALIZED (SELECT DISTINCT feature, hex(encode(feature)) AS x FROM n),
b AS MATERIALIZED (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, [
      (instr('0123456789ABCDEF', x[i:i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1:i + 1]) - 1
      FOR i IN range(1, len(x), 2)]),
    lambda c, y: xor(c // 256, t[xor(c, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
k AS MATERIALIZED (SELECT name, id, bucket, sum(c) AS c FROM n JOIN b USING (feature) GROUP BY ALL),
u AS (
  SELECT i AS bucket, coalesce(sum(c) FILTER (name = 's'), 0) AS s, coalesce(sum(c) FILTER (name = 't'), 0) AS t
  FROM range(10000) r(i) LEFT JOIN k ON k.bucket = i GROUP BY i),
g AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000))
    / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM u),
m AS (
  SELECT id, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * gain) AS BIGINT) AS total
  FROM k JOIN g USING (bucket) WHERE name = 's' GROUP BY id),
d AS (
  SELECT id, len(ws) AS words, coalesce(n, 0) AS n,
    CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
    list_reduce(list_prepend(0, [instr('0123456789abcdef', y) - 1 FOR y IN
      string_split(left(sha256('7:' || id), 8), '')]), lambda c, y: c * 16 + y) AS h
  FROM w LEFT JOIN m USING (id) WHERE name = 's'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, id) AS place,
    count(*) FILTER (words >= 20) OVER () AS fit FROM e)
SELECT id AS doc_id, n AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN words >= 20 AND place <= 25 * fit // 100 THEN CAST(place AS BIGINT) END AS rank
FROM r
"""

# XXH64 with seed 42, by its published steps, in whole numbers modulo 2**64. Its five primes.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED, WHOLE = 42, "18446744073709551616::UHUGEINT"


def _times(a, b):
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % {WHOLE})"


def _plus(*parts):
    return "((" + " + ".join(f"({p})::UHUGEINT" for p in parts) + f") % {WHOLE})"


def _xor(a, b):
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)"


def _turned(x, bits):
    return (f"list_transform([({x})::UHUGEINT], lambda r: r * {2 ** bits}::UHUGEINT % {WHOLE} + r // "
            f"{2 ** (64 - bits)}::UHUGEINT)[1]")


def _folded(x, bits):
    return f"list_transform([({x})::UBIGINT], lambda r: xor(r, r >> {bits}))[1]"


def _round(lane, word):
    return _times(_turned(_plus(lane, _times(word, PRIMES[1])), 31), PRIMES[0])


def _reduced(first, rest, step):
    return f"list_reduce(list_prepend(({first})::UHUGEINT, {rest}), lambda h, w: ({step})::UHUGEINT)"


def _number(places, start):
    """The little-endian number of the bytes from a place on."""
    return " + ".join(f"bs[{start} + {i + 1}] * {256 ** i}::UHUGEINT" for i in range(places))


_LANES = [(SEED + PRIMES[0] + PRIMES[1]) % 2 ** 64, (SEED + PRIMES[1]) % 2 ** 64, SEED, (SEED - PRIMES[0]) % 2 ** 64]
_ROUNDS = ", ".join(_reduced(f"{first}::UHUGEINT", f"[ws[4 * i + {lane}] FOR i IN range(0, n // 32)]", _round("h", "w"))
                    + f" AS v{lane}" for lane, first in enumerate(_LANES, 1))
_MERGED = _reduced(_plus(*[_turned(f"v{i}", bits) for i, bits in zip((1, 2, 3, 4), (1, 7, 12, 18))]), "[v1, v2, v3, v4]",
                   _plus(_times(_xor("h", _round("0", "w")), PRIMES[0]), PRIMES[3]))
_WORDS = _reduced("h", "[ws[i + 1] FOR i IN range(n // 32 * 4, n // 8)]",
                  _plus(_times(_turned(_xor("h", _round("0", "w")), 27), PRIMES[0]), PRIMES[3]))
_FOUR = _plus(_times(_turned(_xor("h", _times("f", PRIMES[0])), 23), PRIMES[1]), PRIMES[2])
_BYTES = _reduced("h", "[bs[i + 1] FOR i IN range(n // 4 * 4, n)]",
                  _times(_turned(_xor("h", _times("w", PRIMES[4])), 11), PRIMES[0]))
_LAST = _folded(_times(_folded(_times(_folded("h", 33), PRIMES[1]), 29), PRIMES[2]), 32)

SIMHASH = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
    IF x <> ''] AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, greatest(len(ws) - 1, 2))]) AS t
  FROM d WHERE len(ws) > 0),
x0 AS (SELECT t, hex(encode(t)) AS x FROM (SELECT DISTINCT t FROM s)),
x1 AS (
  SELECT t, [(instr('0123456789ABCDEF', x[i:i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1:i + 1]) - 1
    FOR i IN range(1, len(x), 2)]::UHUGEINT[] AS bs FROM x0),
x2 AS (SELECT t, bs, len(bs) AS n, [{_number(8, "8 * i")} FOR i IN range(0, len(bs) // 8)]::UHUGEINT[] AS ws FROM x1),
x3 AS (SELECT *, {_ROUNDS} FROM x2),
x4 AS (SELECT t, bs, n, ws, {_plus("CASE WHEN n >= 32 THEN " + _MERGED + f" ELSE {SEED + PRIMES[4]}::UHUGEINT END", "n")} AS h FROM x3),
x5 AS (SELECT t, bs, n, {_WORDS} AS h FROM x4),
x6 AS (SELECT *, CASE WHEN n % 8 >= 4 THEN {_number(4, "n // 8 * 8")} END AS f FROM x5),
x7 AS (SELECT t, bs, n, CASE WHEN f IS NULL THEN h ELSE {_FOUR} END AS h FROM x6),
x8 AS (SELECT t, {_BYTES} AS h FROM x7),
x9 AS MATERIALIZED (SELECT t, ({_LAST})::UBIGINT AS h FROM x8),
b AS (
  SELECT doc_id, bit, 2 * count(*) FILTER ((h >> bit) % 2 = 1) > count(*) AS is_set
  FROM s JOIN x9 USING (t), (SELECT unnest(range(64))::UBIGINT AS bit) GROUP BY doc_id, bit),
p AS MATERIALIZED (
  SELECT d.doc_id, coalesce(v, 0)::UBIGINT AS fp FROM d LEFT JOIN (
    SELECT doc_id, bit_or(1::UBIGINT << bit) FILTER (is_set) AS v FROM b GROUP BY doc_id) USING (doc_id)),
u AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
l AS MATERIALIZED (SELECT a.fp AS x, c.fp AS y FROM u a JOIN u c ON a.fp <> c.fp AND bit_count(xor(a.fp, c.fp)::HUGEINT) <= 3),
reach(fp, other) AS (SELECT fp, fp FROM u UNION SELECT reach.fp, l.y FROM reach JOIN l ON l.x = reach.other),
g AS (SELECT reach.fp, min(u.least) AS component_id FROM reach JOIN u ON u.fp = reach.other GROUP BY reach.fp)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM p JOIN g USING (fp)
"""

ORACLES = {"op2_cover_tree": COVER_TREE, "op6_line_dedup": LINE_DEDUP, "op9_ngram_jaccard": NGRAM_JACCARD,
           "op11_hard_negatives": HARD_NEGATIVES, "op12_simhash": SIMHASH, "op13_resampling": RESAMPLING}
