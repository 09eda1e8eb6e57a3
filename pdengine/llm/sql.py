"""DuckDB SQL that gives the same rows as the queries, by plain means."""

from pdengine.llm.tables import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"

_TOKENS = f"""
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
    FROM documents
"""


def near_duplicates(size: int, percent: int) -> str:
    return f"""
WITH RECURSIVE tokens AS ({_TOKENS}),
shingles AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))
    END) AS s
    FROM tokens
),
sizes AS (SELECT doc_id, len(s) AS n FROM shingles),
each AS (SELECT doc_id, hash(sh) AS sh FROM (SELECT doc_id, unnest(s) AS sh FROM shingles)),
links AS (
    SELECT c.a, c.b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same
        FROM each x JOIN each y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL
    ) c JOIN sizes na ON na.doc_id = c.a JOIN sizes nb ON nb.doc_id = c.b
    WHERE 100 * c.same >= {percent} * (na.n + nb.n - c.same)
),
reach AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
least_reached AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(l.b, n.doc_id)) AS component_id,
       n.doc_id = least(n.doc_id, coalesce(l.b, n.doc_id)) AS kept
FROM sizes n LEFT JOIN least_reached l ON l.a = n.doc_id
"""



_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def common_lines(min_docs: int, min_points: int) -> str:
    return f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split
),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), '{UPPER}', '{LOWER}') AS k FROM lines),
common AS (
    SELECT k FROM keyed WHERE length(k) >= {min_points} GROUP BY k HAVING count(DISTINCT doc_id) >= {min_docs}
)
SELECT y.doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed y LEFT JOIN common c ON c.k = y.k GROUP BY y.doc_id
"""


def _time(share: str, knots) -> str:
    pieces = list(zip(knots, knots[1:], strict=False))
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces]
    total, done, cases = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(pieces, areas, strict=True):
        need, slope = f"({share} * {total}::DOUBLE - {done}::DOUBLE)", (w1 - w0) / (t1 - t0)
        done += area
        time = f"({t0}::DOUBLE + 2 * {need} / ({w0}::DOUBLE + sqrt({w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {need})))"
        cases.append(f"WHEN {share} * {total}::DOUBLE <= {done}::DOUBLE THEN {time}")
    last = cases.pop().split(" THEN ", 1)[1]
    out = f"(CASE {' '.join(cases)} ELSE {last} END)" if cases else last
    return f"least(greatest({out}, 0.0::DOUBLE), 1.0::DOUBLE)"


def mixing(budget: float, most: float, weights, schedules) -> str:
    def time(seen: str, words: str) -> str:
        cases = " ".join(f"WHEN kind = {k} THEN {_time(f'(({seen}) / target)', s)}" for k, s in enumerate(schedules))
        return f"CASE WHEN {words} > 0 THEN CASE {cases} END END"

    return f"""
WITH sizes AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS kind
    FROM sizes GROUP BY source
),
weighed AS (
    SELECT *, ({list(map(float, weights))}::DOUBLE[])[kind + 1] AS w, {most}::DOUBLE * source_size AS cap FROM sources
),
filling AS (
    SELECT *, sum(cap) OVER o - cap AS capped, sum(w) OVER () - (sum(w) OVER o - w) AS open, sum(source_size) OVER () AS total
    FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
),
level AS (SELECT max(({budget}::DOUBLE * total - capped) / open) AS v FROM filling WHERE total > 0),
targets AS (SELECT source, source_size, kind, coalesce(least(cap, v * w), 0.0::DOUBLE) AS target FROM weighed CROSS JOIN level),
placed AS (
    SELECT s.*, t.source_size, t.kind, t.target, CAST(floor(t.target) AS BIGINT) AS goal,
           CAST(sum(size) OVER (PARTITION BY s.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS seen
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
used AS (
    SELECT *, greatest(least(size, goal - seen), 0) AS once, greatest(least(size, goal - (seen + source_size)), 0) AS twice FROM placed
)
SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken,
       {time('seen', 'once')} AS position, {time('seen + source_size', 'twice')} AS again
FROM used
"""


_VECTORS = """
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
"""


def nearest(every: int, k: int) -> str:
    return f"""
WITH usable AS ({_VECTORS}),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {k}
"""


def near_vectors(least: float) -> str:
    return f"""
WITH RECURSIVE usable AS ({_VECTORS}),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= {least}
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_reached AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least_reached l ON l.a = e.vec_id
"""


def _checksum(value: str) -> str:
    """crc32 of a number's decimal text, bit by bit."""
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
    ))"""


def text_scores(folds: int, held: int, steps: int) -> str:
    """Trigram scores with Witten-Bell smoothing, probabilities rounded to steps of a decade."""
    rounded = lambda p: f"pow(10, -round(-log10({p}) * {steps}) / {steps})"
    return f"""
WITH tokens AS ({_TOKENS}),
each AS (
    SELECT doc_id, held_out, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
        SELECT doc_id, list_append(w, chr(10)) AS w, coalesce({_checksum("doc_id")} % {folds} = {held}, false) AS held_out FROM tokens
    )
),
grams AS (
    SELECT *, coalesce(lag(w, 1) OVER o, '') AS v, coalesce(lag(w, 2) OVER o, '') AS u
    FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
taught AS (SELECT * FROM grams WHERE NOT held_out),
one AS (SELECT w, count(*) AS c FROM taught GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM taught GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS c FROM taught GROUP BY u, v, w),
left2 AS (SELECT v, sum(c) AS c, count(*) AS t FROM two GROUP BY v),
left3 AS (SELECT u, v, sum(c) AS c, count(*) AS t FROM three GROUP BY u, v),
corpus AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS k FROM one),
found AS (
    SELECT g.doc_id, g.held_out, n, k, coalesce(one.c, 0) AS c1,
           coalesce({rounded("two.c / (left2.c + left2.t)")}, 0) AS a2, coalesce({rounded("left2.t / (left2.c + left2.t)")}, 1) AS l2,
           coalesce({rounded("three.c / (left3.c + left3.t)")}, 0) AS a3, coalesce({rounded("left3.t / (left3.c + left3.t)")}, 1) AS l3
    FROM grams g CROSS JOIN corpus
    LEFT JOIN one USING (w) LEFT JOIN two USING (v, w) LEFT JOIN three USING (u, v, w)
    LEFT JOIN left2 USING (v) LEFT JOIN left3 USING (u, v)
),
smooth AS (
    SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE
        CASE WHEN c1 > 0 THEN {rounded("c1 / (n + k)")} ELSE 0 END + {rounded("k / (n + k)")} / (k + 1) END AS a1
    FROM found
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c1 > 0) AS n_known, any_value(n) AS train_tokens,
       fsum(log10((c1 + 0.5) / (n + 0.5 * (k + 1)))) AS base_score, fsum(log10(least(1.0, a3 + l3 * (a2 + l2 * a1)))) AS score
FROM smooth GROUP BY doc_id, held_out
"""


def merkle(divisor: int) -> str:
    """Leaves, trees by language, the tree of their roots, and the roots that changed leaves fold to, level by level."""
    part = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END"
    leaf = lambda n: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", n, "text"))) + ")"
    return f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {leaf("n_chars")} AS h,
           CASE WHEN {_checksum("doc_id")} % {divisor} = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS other
    FROM documents
),
placed AS (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS k,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM leaves
),
tree AS (
    SELECT 0 AS lvl, k, pos, h, n FROM placed
    UNION ALL
    SELECT lvl + 1, k, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lvl, k, pos // 2, n
),
subroots AS (SELECT k, h FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS lvl, k - 1 AS pos, h, (SELECT count(*) FROM subroots) AS n FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n
),
within AS (
    SELECT k, pos AS leaf_pos, 0 AS lvl, pos, n, other AS now, '' AS sib FROM placed
    UNION ALL
    SELECT w.k, w.leaf_pos, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
           sha256(CASE WHEN w.pos % 2 = 1 THEN t.h || w.now ELSE w.now || coalesce(t.h, '') END), w.sib || coalesce(t.h, '')
    FROM within w LEFT JOIN tree t ON t.k = w.k AND t.lvl = w.lvl AND t.pos = xor(w.pos, 1)
    WHERE w.n > 1
),
above AS (
    SELECT k, leaf_pos, 0 AS lvl, k - 1 AS pos, (SELECT count(*) FROM subroots) AS n, now, sib FROM within WHERE n = 1
    UNION ALL
    SELECT a.k, a.leaf_pos, a.lvl + 1, a.pos // 2, (a.n + 1) // 2,
           sha256(CASE WHEN a.pos % 2 = 1 THEN t.h || a.now ELSE a.now || coalesce(t.h, '') END), a.sib || coalesce(t.h, '')
    FROM above a LEFT JOIN top t ON t.lvl = a.lvl AND t.pos = xor(a.pos, 1)
    WHERE a.n > 1
),
root AS (SELECT h FROM top WHERE n = 1)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root.h AS root, sha256(a.sib) AS proof_sha256, a.now AS folded_root, a.now = root.h AS verified
FROM placed p JOIN subroots s USING (k) JOIN above a ON a.k = p.k AND a.leaf_pos = p.pos AND a.n = 1 CROSS JOIN root
"""
