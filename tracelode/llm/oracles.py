"""SQL that gives the same rows, for the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id that links reach, for edges (a, b) in both directions.
_REACHED = """r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS id, least(a, min(b)) AS component_id FROM r GROUP BY a)"""

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') AS x FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) >= 5 THEN list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS shingle FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
 {_REACHED} SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""

EMBEDDING_DEDUP = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 g AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
 e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
 k AS (SELECT a, count(*) AS n FROM e GROUP BY 1), {_REACHED}
 SELECT v.vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, coalesce(c.component_id, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN c ON c.id = v.vec_id"""


def _rejects(rule: str, cutoff: str) -> str:
    above, below, sign, _ = RULES[rule]
    return f"coalesce({above} / nullif(CAST({below} AS DOUBLE), 0) {'>' if sign > 0 else '<'} {cutoff}, false)"


#: Pairs of hexadecimal signs that are a whole character of UTF-8, or a byte that is none.
_CHARACTER = "[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9A-CEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[1-3][89AB].[89AB].[89AB].|F48.[89AB].[89AB].|.."

SUFFIX_DEDUP = f"""WITH s AS (SELECT doc_id, text, hex(coalesce(text, '')) AS x, CAST(length(hex(coalesce(text, ''))) // 2 AS BIGINT) AS n FROM documents),
 p AS (SELECT doc_id, unnest(range(0, n - 399)) AS i, x FROM s WHERE n >= 400), k AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 800)) AS k FROM p), r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
 g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r), q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
 sp AS (SELECT doc_id, span, min(i) AS lo, max(i) + 400 AS hi FROM q GROUP BY ALL), nx AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM sp),
 t AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, max(hi) AS last, string_agg(substr(s.x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head FROM nx JOIN s USING (doc_id) GROUP BY doc_id),
 f AS (SELECT s.doc_id, s.text, s.n, n_removed, n_spans, CASE WHEN t.doc_id IS NULL THEN s.x ELSE t.head || substr(s.x, 2 * t.last + 1) END AS kept FROM s LEFT JOIN t ON t.doc_id = s.doc_id)
 SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256,
  CASE WHEN text IS NULL OR n_removed IS NULL THEN text ELSE decode(unhex(array_to_string(list_filter(regexp_extract_all(kept, '{_CHARACTER}'), lambda c: length(c) > 2 OR c < '8'), ''))) END AS text FROM f"""


def quality_rules(tolerated: float = 0.05, delta: float = 0.05) -> str:
    """The counts, the cutoffs whose exact binomial tail allows them, tried from mild to sharp, and the verdict."""
    tests = [(rule, k, c) for rule, (_, _, _, grid) in RULES.items() for k, c in enumerate(reversed(grid))]
    share = tolerated / len(RULES)
    tried = " UNION ALL ".join(f"SELECT stratum, '{rule}' AS rule, {k} AS place, CAST({c} AS DOUBLE) AS cutoff, count(*) AS n, count(*) FILTER ({_rejects(rule, str(c))}) AS bad FROM good GROUP BY 1" for rule, k, c in tests)
    verdict = " OR ".join(_rejects(rule, f"(SELECT cutoff FROM taken WHERE rule = '{rule}' AND taken.stratum IS NOT DISTINCT FROM m.stratum)") for rule in RULES)
    return rf"""WITH w AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS x FROM documents),
 win AS (SELECT doc_id, unnest(range(1, len(x) - 3)) AS i, x FROM w WHERE len(x) >= 5), key AS (SELECT doc_id, i, array_to_string(x[i:i + 4], ' ') AS k FROM win),
 twice AS (SELECT doc_id, unnest(range(i, i + 5)) AS spot FROM key QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), rep AS (SELECT doc_id, count(DISTINCT spot) AS n FROM twice GROUP BY 1),
 ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w), full_ AS (SELECT doc_id, line FROM ln WHERE regexp_matches(line, '{_WORD}')),
 li AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_ GROUP BY 1),
 m AS (SELECT w.doc_id, w.stratum, w.t, CAST(len(x) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(x, lambda y: length(y))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(li.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(li.n_lines, 0) AS n_lines, CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_exclamations, CAST(len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN li USING (doc_id) LEFT JOIN rep USING (doc_id)),
 b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
 lab AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
 first_ AS (SELECT * FROM b WHERE doc_id IN (SELECT doc_id FROM lab) QUALIFY row_number() OVER (PARTITION BY stratum, t ORDER BY doc_id) = 1), strata AS (SELECT count(DISTINCT coalesce(stratum, '')) AS n FROM first_), good AS (SELECT * FROM first_ WHERE NOT base_failed),
 tried AS ({tried}),
 tail AS (SELECT *, list_sum(list_transform(range(0, bad + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) AS p FROM tried),
 ok AS (SELECT *, bool_and(p <= {delta} / ({len(RULES)} * (SELECT n FROM strata)) AND bad <= {share!r} * n) OVER (PARTITION BY stratum, rule ORDER BY place) AS passes FROM tail),
 taken AS (SELECT stratum, rule, arg_max(cutoff, place) AS cutoff FROM ok WHERE passes GROUP BY 1, 2)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({verdict}) AS kept FROM b AS m"""


FILL_IN_MIDDLE = """WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
 h AS (SELECT *, CAST(len(x) AS BIGINT) AS n, CAST('0x' || substr(g, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(g, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(g, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(g, 25, 8) AS BIGINT) AS h4 FROM u),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM h),
 p AS (SELECT doc_id, n, t, array_to_string(x[1:lo], '') AS p, array_to_string(x[lo + 1:hi], '') AS m, array_to_string(x[hi + 1:n], '') AS s, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

URL_FILTER = r"""WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
 a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
 d AS (SELECT DISTINCT host, path FROM u),
 b AS (SELECT d.host, d.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM d JOIN r ON (d.host = r.host OR suffix(d.host, '.' || r.host)) AND starts_with(d.path, r.path) GROUP BY ALL)
 SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM u LEFT JOIN b USING (host, path)"""


ORACLES: dict[str, str] = {"op1_suffix_dedup": SUFFIX_DEDUP, "op2_embedding_dedup": EMBEDDING_DEDUP, "op6_ngram_join": NGRAM_JOIN, "op8_quality_rules": quality_rules(), "op11_fill_in_middle": FILL_IN_MIDDLE, "op13_url_filter": URL_FILTER}
