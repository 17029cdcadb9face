"""DuckDB's SQL for the queries that SQL can express: each says the result outright, without the operator's index."""

from __future__ import annotations

from spectramesh.llm import decontaminate as D
from spectramesh.llm import licenses as L
from spectramesh.llm import urlfilter as U


def neighbours(k: int = 5) -> str:
    """All rows against the query rows. The search is approximate; at its default factor it finds all of them in the given tables."""
    return f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.x, c.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(c.x, c.x))) AS score FROM v q JOIN v c ON q.id <> c.id AND len(q.x) = len(c.x) WHERE q.id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= {k}"""


def decontamination() -> str:
    """Every word of a document that equals one of an item, gathered by their distance; then the best stretch of each distance."""
    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, {split} AS w FROM documents), i AS (SELECT row_number() OVER () AS m, item_id, {split} AS w FROM benchmark),
dw AS (SELECT n, unnest(w) AS word, unnest(range(len(w))) AS p FROM d), iw AS (SELECT m, unnest(w) AS word, unnest(range(len(w))) AS q FROM i WHERE len(w) >= {D.LEAST}),
eq AS (SELECT n, m, p - q AS shift, q FROM dw JOIN iw USING (word)),
sized AS (SELECT m, item_id, len(w) AS items, least(len(w), {D.WINDOW}) AS win FROM i), wide AS (SELECT n, doc_id, len(w) AS words FROM d),
lots AS (SELECT n, m, shift, list(q) AS qs FROM eq GROUP BY ALL HAVING count(*) >= {D.LEAST}),
spot AS (SELECT doc_id, item_id, n, m, win, unnest(range(greatest(0, -shift), least(items, words - shift) - win + 1)) AS y, qs FROM lots JOIN sized USING (m) JOIN wide USING (n) WHERE len(qs) >= win - win // {D.SHARE}),
got AS (SELECT doc_id, item_id, win, len(list_filter(qs, lambda q: q >= y AND q < y + win)) AS matched FROM spot)
SELECT doc_id, item_id, max(matched)::INT AS matched, max(win)::INT AS "window" FROM got WHERE matched >= win - CASE WHEN win < {D.TOLERANT} THEN 0 ELSE win // {D.SHARE} END GROUP BY doc_id, item_id"""


def scan() -> str:
    """The shingles of each template counted in each stretch of each document as long as the template."""
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(L.TEMPLATES))
    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    shingle = "list_transform(range(len(w) - n + 1), lambda i: w[i + 1 : i + n])"
    return f"""WITH t AS (SELECT template, license, w, least(len(w), {L.WORDS}) AS n FROM (SELECT template, license, {split} AS w FROM (VALUES {values}) v(template, license, text))),
ts AS (SELECT template, license, n, len(w) - n + 1 AS size, list_distinct({shingle}) AS s FROM t), one AS (SELECT template, license, n, size, len(s) AS total, unnest(s) AS sh FROM ts),
d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents), dn AS (SELECT r, doc_id, n, unnest({shingle}) AS sh, unnest(range(len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n),
hit AS (SELECT r, doc_id, template, license, size, total, p, sh FROM dn JOIN one USING (n, sh)),
spot AS (SELECT DISTINCT r, template, size, greatest(0, p - k) AS a FROM hit, range(64) g(k) WHERE k < size),
share AS (SELECT spot.r, spot.template, a, count(DISTINCT sh) AS got FROM spot JOIN hit ON hit.r = spot.r AND hit.template = spot.template AND p >= a AND p < a + spot.size GROUP BY ALL),
best AS (SELECT r, template, max(got) AS got, arg_min(a, (-got, a)) AS a FROM share GROUP BY ALL)
SELECT any_value(doc_id) AS doc_id, any_value(license) AS license, template::INT AS template, any_value(got / total) AS containment, any_value(a) AS first_word FROM best JOIN hit USING (r, template) WHERE got / total >= 0.8 GROUP BY r, template"""


def url_filter(rules: list[tuple[str, str]], epochs: int = 200, rate: float = 1.0, decay: float = 1e-3) -> str:
    """Gradient descent as a recursive table of one row."""
    urls = ", ".join(f"('{u}', {y})" for u, y in U.made_urls())
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*', 0), '{U.UPPER}', '{U.LOWER}'), '')"
    path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"

    def grams(mark: str, text: str, n: int) -> str:
        return f"list_transform(range(1, length({text}) - {n} + 2), lambda i: ('0x' || substr(md5('{mark}' || substr({text}, i, {n})), 1, 4))::INT)"

    whole = "('^' || host || '$')"
    feats = "list_distinct(list_concat(" * 1 + ", ".join([grams("h", whole, n) for n in U.ORDERS] + [grams("p", "path", n) for n in U.ORDERS]) + "))"
    name, says = "NULL", "NULL"
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}')"
        name, says = f"CASE WHEN {fits} THEN '{rule}' ELSE {name} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"
    return f"""WITH RECURSIVE lab AS MATERIALIZED (SELECT row_number() OVER (ORDER BY url, y) AS i, y, {feats} AS f FROM (SELECT url, y::DOUBLE AS y, {host} AS host, {path} AS path FROM (VALUES {urls}) v(url, y))),
seen AS MATERIALIZED (SELECT h, row_number() OVER (ORDER BY h) AS k FROM (SELECT DISTINCT unnest(f) AS h FROM lab)), pair AS MATERIALIZED (SELECT i, k FROM (SELECT i, unnest(f) AS h FROM lab) JOIN seen USING (h)),
rws AS (SELECT list(y ORDER BY i) AS ys, list(ks ORDER BY i) AS ats, count(*)::DOUBLE AS n FROM lab JOIN (SELECT i, list(k ORDER BY k) AS ks FROM pair GROUP BY i) USING (i)), ins AS (SELECT list(xs ORDER BY k) AS inside FROM (SELECT k, list(i ORDER BY i) AS xs FROM pair GROUP BY k)),
fixed AS MATERIALIZED (SELECT * FROM rws, ins),
gd AS (SELECT 0 AS epoch, list_transform(inside, lambda x: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b FROM fixed UNION ALL
SELECT epoch + 1, list_transform(inside, lambda xs, k: w[k] * {1 - rate * decay!r} + list_sum(list_transform(xs, lambda j: r[j])) * ({rate!r} / n)), b + list_sum(r) * ({rate!r} / n)
FROM (SELECT *, list_transform(ats, lambda ks, i: ys[i] - 1 / (1 + exp(-(b + list_sum(list_transform(ks, lambda j: w[j])))))) AS r FROM gd, fixed WHERE epoch < {epochs})),
last AS MATERIALIZED (SELECT w, b FROM gd WHERE epoch = {epochs}), weight AS MATERIALIZED (SELECT h, w[k] AS v FROM seen, last),
pg AS (SELECT row_number() OVER () AS r, page_id, {host} AS host, {path} AS path FROM pages), z AS (SELECT r, sum(v) AS z FROM (SELECT r, unnest({feats}) AS h FROM pg) JOIN weight USING (h) GROUP BY r)
SELECT page_id, host, path, {name} AS rule, coalesce({says}, CASE WHEN coalesce(z, 0) + b >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM pg LEFT JOIN z USING (r), last"""


_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"


def hard_negatives(positives: int = 5, negatives: int = 10) -> str:
    """All rows against the anchors; scores are whole numbers that doubles hold."""
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINE}),
s AS MATERIALIZED (SELECT a.r AS ar, a.id AS anchor_id, c.r AS cr, c.id AS cid, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON a.r <> c.r AND len(a.x) = len(c.x) WHERE a.id % 100 = 0),
p AS (SELECT ar, anchor_id, cr AS pr, cid AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, cid, cr) <= {positives})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY ar, pr ORDER BY score DESC, cid, cr))::INT AS rank, cid AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (ar, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= {negatives}"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """A table of entries per round; whole numbers in doubles, which hold them."""
    steps = f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS r, vec_id, label, x FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS x FROM embeddings WHERE {_FINE} AND len(embedding) > 0)),
p AS MATERIALIZED (SELECT r, k, x[k * (len(x) // {parts}) + 1 : (k + 1) * (len(x) // {parts})] AS x FROM e, range({parts}) t(k)), b0 AS MATERIALIZED (SELECT k, r AS i, x AS c FROM p WHERE r < {entries})"""
    for n in range(rounds + 1):
        steps += f""",
a{n} AS MATERIALIZED (SELECT r, k, any_value(x) AS x, min({{'d': list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c), 'i': i}}) AS m FROM p JOIN b{n} USING (k) GROUP BY r, k)"""
        if n < rounds:
            steps += f""",
m{n} AS (SELECT k, i, list(f ORDER BY j) AS c FROM (SELECT k, i, j, floor(sum(y) / count(*)) AS f FROM (SELECT k, m.i AS i, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{n}) GROUP BY k, i, j) GROUP BY k, i),
b{n + 1} AS MATERIALIZED (SELECT k, i, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m USING (k, i))"""
    return f"""WITH {steps},
sha AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda y: y::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY k, i)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT vec_id, label, string_agg(printf('%02x', m.i), '' ORDER BY k) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} JOIN e USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, sha"""
