"""DuckDB SQL for the queries that SQL can express.

Left out, as SQL lacks what they need: op4 (entropy ranks, Bloom filters), op5 (CRC-32 and the 64-bit hash of the draws),
op6 (HTML), op7 (places of matches, the classifier), op8 and op10 (the tokenizer), op9 (the forest) and the pipeline.
Their tests use brute force.
"""

WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_TEXT_WORDS = WORDS.format(text="coalesce(text, '')")

#: The stream of a source is cut at its target, so what the mix takes of a document follows without the slots.
OP1 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_TEXT_WORDS}) AS BIGINT) AS size FROM documents
), caps AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS cap,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM caps
  WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap
    ELSE weight * (SELECT level FROM levels WHERE cap > level * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1) END AS target
  FROM levels
), streams AS (
  SELECT z.doc_id, z.source, z.size, source_size, target, CAST(round(target) AS BIGINT) AS wanted, e AS epoch,
    e * source_size + sum(size) OVER (
      PARTITION BY z.source, e ORDER BY md5('17:' || e || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':1')
    ) AS upto
  FROM sized z JOIN shares s ON z.source IS NOT DISTINCT FROM s.source, (SELECT unnest(range(0, 3)) AS e)
)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(upto, wanted) - (upto - size))) AS BIGINT) AS taken
FROM streams GROUP BY doc_id, source, size, source_size, target
"""

OP2 = f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, {_TEXT_WORDS} AS w FROM documents
), starts AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY gram) AS n FROM starts) WHERE n > 1
), covered AS (
  SELECT DISTINCT r, i + k AS i FROM repeated, (SELECT unnest(range(0, 35)) AS k)
), gone AS (
  SELECT r, list(i) AS places FROM covered GROUP BY r
), marked AS (
  SELECT doc_id, w, coalesce(len(places), 0) AS n, places FROM words LEFT JOIN gone USING (r)
)
SELECT doc_id, len(w) AS n_words, n AS n_removed,
  sha256(CASE WHEN n = 0 THEN array_to_string(w, ' ')
    ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(places, i)), ' '), '') END) AS kept_sha256
FROM marked
"""

_LOWER_WORDS = WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP3 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_LOWER_WORDS} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), ranked AS (
  SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS p
  FROM shingles JOIN (SELECT x, count(*) AS f FROM shingles GROUP BY x) USING (x)
), prefixes AS (
  SELECT doc_id, n, x FROM ranked WHERE p <= n - ((n * 80 + 99) // 100) + 1
), candidates AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
  FROM prefixes a JOIN prefixes b ON a.x = b.x AND a.doc_id < b.doc_id
), links AS (
  SELECT c.a, c.b FROM candidates c JOIN shingles s ON s.doc_id = c.a JOIN shingles t ON t.doc_id = c.b AND t.x = s.x
  GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 80 * (c.na + c.nb - count(*))
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM sets
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id
), least AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
"""

_INTS = """
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""


def _op11() -> str:
    """Four rounds, each two steps: the nearest entry of every part, then the floored means of those that have parts."""
    steps = [f"""
WITH kept AS ({_INTS.format(scale=1024)}), parts AS (
  SELECT vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(0, 4)) AS p)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 256
), book0 AS (
  SELECT p, e, x AS c FROM parts JOIN first USING (vec_id)
)"""]
    for k in range(5):
        steps.append(f""", near{k} AS (
  SELECT vec_id, label, p, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM parts JOIN book{k} USING (p) GROUP BY vec_id, label, p, x
)""")
        if k < 4:
            steps.append(f""", mean{k} AS (
  SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, sum(x[i]) AS total, count(*) AS n FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY ALL
  ) GROUP BY p, e
), book{k + 1} AS (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e)
)""")
    steps.append(""", codes AS (
  SELECT vec_id, label, string_agg(lower(lpad(hex(best.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near4 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book4) AS codebooks_sha256
FROM codes""")
    return "".join(steps)


OP12 = f"""
WITH vectors AS ({_INTS.format(scale=64)}), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

OP13 = f"""
WITH counted AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, {_TEXT_WORDS} AS w FROM documents
), failing AS (
  SELECT part, doc_id, CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
    + 4 * CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS f
  FROM counted
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s, CAST(1 << (ascii(o[s]) - 65) AS INTEGER) AS own,
    CAST(coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))), 0) AS INTEGER) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS s)
), audit AS (
  SELECT part, o, s, own, sum(CASE WHEN f & (own | earlier) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN f & earlier = 0 AND f & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN f & earlier > 0 AND f & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN f = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN f & earlier = 0 AND f & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN f & earlier = 0 AND f & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, o, s, own
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audit
"""

ORACLES = {"op1_mix_sources": OP1, "op2_remove_repeats": OP2, "op3_near_duplicates": OP3}
ORACLES |= {"op11_vector_codes": _op11(), "op12_exact_search": OP12, "op13_filter_audit": OP13}
