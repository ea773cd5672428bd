"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables.

The others apply tokenizers or trained models, or estimate by iteration; tests hold those against brute force, exact
round trips or held-out labels.
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _urls() -> str:
    """Rules, Witten-Bell models of up to six characters and the calibrated threshold; one step per order."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    rules = sorted((("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")), key=lambda r: -len(r[1] + r[2]))
    case = lambda f: "CASE " + " ".join(f"WHEN {fits.format(h, p)} THEN '{f(v, h, p)}'" for v, h, p in rules) + " END"
    mixed = lambda c, shorter: f"CASE WHEN n_{c} > 0 THEN (m.{c} + t_{c} * {shorter}) / (n_{c} + t_{c}) ELSE {shorter} END AS p_{c}"
    orders = [f"p1 AS (SELECT x, {mixed('a', '(1/256::DOUBLE)')}, {mixed('b', '(1/256::DOUBLE)')} FROM m WHERE length(x) = 1)"]
    orders += [f"p{k} AS (SELECT m.x, {mixed('a', 's.p_a')}, {mixed('b', 's.p_b')} FROM m JOIN p{k - 1} s ON s.x = substr(m.x, 2) WHERE length(m.x) = {k})" for k in range(2, 7)]
    return f"""WITH part AS (SELECT page_id, url, {lower.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, url, coalesce({rest}, '') AS r FROM pages)),
 ruled AS (SELECT page_id, url, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS label FROM part),
 each AS (SELECT url, label, count(*) AS n, ('0x' || substr(md5(coalesce(url, '')), 1, 7))::BIGINT % 5 = 0 AS fold,
   chr(2) || {lower.format("CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE coalesce(url, '') END")} || chr(3) AS t FROM ruled GROUP BY url, label),
 runs AS (SELECT url, label, fold, n, substr(t, greatest(1, i - 5), least(i, 6)) AS run FROM (SELECT *, unnest(range(2, length(t) + 1)) AS i FROM each)),
 counts AS (SELECT run, coalesce(sum(n) FILTER (WHERE label = 'allow' AND NOT fold), 0)::BIGINT AS a, coalesce(sum(n) FILTER (WHERE label = 'block' AND NOT fold), 0)::BIGINT AS b FROM runs GROUP BY run),
 met AS (SELECT x, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (SELECT right(run, k) AS x, a, b FROM (SELECT *, unnest(range(1, least(length(run), 6) + 1)) AS k FROM counts)) GROUP BY x),
 ctx AS (SELECT left(x, length(x) - 1) AS c, sum(a)::DOUBLE AS n_a, count(*) FILTER (WHERE a > 0)::DOUBLE AS t_a, sum(b)::DOUBLE AS n_b, count(*) FILTER (WHERE b > 0)::DOUBLE AS t_b FROM met GROUP BY 1),
 m AS (SELECT met.*, n_a, t_a, n_b, t_b FROM met JOIN ctx ON c = left(x, length(x) - 1)),
 {", ".join(orders)},
 ratio AS (SELECT x AS run, floor((ln(p_a) - ln(p_b)) * 1000000 + 0.5)::BIGINT AS ratio FROM ({" UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, 7))})),
 score AS (SELECT url, label, n, sum(ratio)::DOUBLE / count(*) AS mean FROM runs JOIN ratio USING (run) WHERE label IS NULL OR fold GROUP BY url, label, n),
 bins AS (SELECT floor(mean / 1000) AS bin, coalesce(sum(n) FILTER (WHERE label = 'allow'), 0)::DOUBLE AS g, coalesce(sum(n) FILTER (WHERE label = 'block'), 0)::DOUBLE AS h FROM score WHERE label IS NOT NULL GROUP BY 1),
 place AS (SELECT coalesce((bin + lag(bin) OVER o + 1) / 2, bin) * 1000 AS t, (sum(g) OVER o - g) * sum(h) OVER () + (sum(h) OVER () - sum(h) OVER o + h) * sum(g) OVER () AS lost, sum(g) OVER () AS gs, sum(h) OVER () AS hs FROM bins WINDOW o AS (ORDER BY bin)),
 cut AS (SELECT coalesce((SELECT t FROM place WHERE gs > 0 AND hs > 0 ORDER BY lost, abs(t), t LIMIT 1), 0) AS t)
 SELECT page_id, host, path, rule, coalesce(r.label, CASE WHEN (mean - t) / 1000000 >= 0 THEN 'allow' ELSE 'block' END) AS verdict
 FROM ruled r LEFT JOIN score s ON s.url IS NOT DISTINCT FROM r.url AND r.label IS NULL AND s.label IS NULL CROSS JOIN cut"""


def _codes(rounds: int = 4) -> str:
    """Codebooks of four parts, one step per round."""
    near = lambda k: f"""a{k} AS (SELECT p.vec_id, p.j, min((list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x))::BIGINT * 256 + c.i) AS m FROM p JOIN c{k} c ON c.j = p.j GROUP BY 1, 2)"""
    steps = []
    for k in range(rounds):
        steps.append(near(k))
        steps.append(f"""s{k} AS (SELECT j, i, pos, floor(sum(v)::HUGEINT / count(*)) AS v FROM (SELECT p.j, a.m % 256 AS i, unnest(range(len(p.x))) AS pos, unnest(p.x) AS v FROM p JOIN a{k} a ON a.vec_id = p.vec_id AND a.j = p.j) GROUP BY 1, 2, 3),
 n{k} AS (SELECT j, i, list(v::DOUBLE ORDER BY pos) AS x FROM s{k} GROUP BY 1, 2),
 c{k + 1} AS (SELECT c.j, c.i, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN n{k} n ON n.j = c.j AND n.i = c.i)""")
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT vec_id, j, e[j * (len(e) // 4) + 1:(j + 1) * (len(e) // 4)] AS x FROM (SELECT vec_id, e, unnest(range(4)) AS j FROM v)),
 c0 AS (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS i, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),
 {", ".join(steps)}, {near(rounds)},
 coded AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY j) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
 SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY j, i)) FROM c{rounds}) AS codebooks_sha256 FROM coded JOIN v USING (vec_id)"""


SQL: dict[str, str] = {
    "op11_url_models": _urls(),
    "op12_codebook_compression": _codes(),
    "op13_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
 k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
 c AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM k)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c""",
    "op4_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
 sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
   ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w)),
 n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.c + y.c - k)),
 both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
 c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
 SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.m, d.doc_id) AS kept
 FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op8_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
 later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, range(20) t(k)),
 pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
 kept AS (SELECT doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS t FROM pos LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
 SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)""",
    "op9_voronoi_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
 SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10""",
}
