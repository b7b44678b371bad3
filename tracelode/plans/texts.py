"""Queries on long texts: lines, blocks, segments, masks, quotes, copies and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.secrets import mask_secrets
from ..operators import ledger, nearest
from ..operators import records as rules
from ..operators import texts as ops
from .bindings import table
from .registry import query

#: Document lines in SQL: no line follows the last line feed.
_LINES = r"ln AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents)"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("strf01_line_split", f"WITH {_LINES} SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS longest FROM ln")
def line_split(spark, sf_dir):
    each = fn.lines(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(each).cast("bigint").alias("n_lines"), F.coalesce(F.array_max(F.transform(each, F.length)), F.lit(0)).cast("bigint").alias("longest"))


_BLOCKS = rf"""WITH {_LINES}, u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM ln), w AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM u WHERE regexp_matches(x, '\S')),
 p AS (SELECT doc_id, min(n) AS lo, max(n) AS hi FROM w GROUP BY doc_id, g), b AS (SELECT doc_id, unnest(range(lo, hi + 1, 12)) AS lo, hi FROM p)"""


@query("strf02_blocks", f"{_BLOCKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS BIGINT) AS block, CAST(lo AS BIGINT) AS lo, CAST(least(lo + 11, hi) AS BIGINT) AS hi FROM b")
def blocks(spark, sf_dir):
    cut = _documents(spark, sf_dir).select("doc_id", F.posexplode(fn.paragraphs(fn.lines(F.col("text")))).alias("k", "b"))
    return cut.select("doc_id", (F.col("k") + 1).cast("bigint").alias("block"), F.col("b.lo").cast("bigint").alias("lo"), F.col("b.hi").cast("bigint").alias("hi"))


@query("strf02_result_blocks", f"WITH {_LINES}, c AS (SELECT doc_id, len(l) AS n FROM ln) SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 6 THEN 1 ELSE 2 END AS BIGINT) AS n_blocks, CAST(CASE WHEN n > 6 THEN greatest(n - 5, 7) END AS BIGINT) AS tail_from FROM c")
def result_blocks(spark, sf_dir):
    cut = fn.head_and_tail(fn.lines(F.col("text")))
    return _documents(spark, sf_dir).select("doc_id", F.size(cut).cast("bigint").alias("n_blocks"), F.when(F.size(cut) == 2, F.get(cut, 1)["lo"]).cast("bigint").alias("tail_from"))


def _segments(most: int) -> str:
    return f"""WITH RECURSIVE s AS (SELECT doc_id, text, 0 AS a, 0 AS b, 0 AS n FROM documents WHERE text IS NOT NULL UNION ALL
 SELECT doc_id, text, b, CASE WHEN b + {most} >= length(text) THEN length(text) ELSE b + CASE WHEN contains(substr(text, b + {most // 2} + 1, {most - most // 2}), chr(10)) THEN {most} - strpos(reverse(substr(text, b + {most // 2} + 1, {most - most // 2})), chr(10)) + 1 ELSE {most} END END, n + 1 FROM s WHERE b < length(text))
 SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(a AS BIGINT) AS "start", CAST(b AS BIGINT) AS "end", sha256(substr(text, a + 1, b - a)) AS content_hash FROM s WHERE n > 0 UNION ALL SELECT doc_id, 1, 0, 0, sha256('') FROM documents WHERE text = ''"""


@query("strf03_segments", _segments(32_000))
def segments(spark, sf_dir):
    return ops.segments(_documents(spark, sf_dir), "doc_id", "text").select("doc_id", "n", "start", "end", F.sha2("content", 256).alias("content_hash"))


@query("strf03_short_segments", _segments(2_000))
def short_segments(spark, sf_dir):
    return ops.segments(_documents(spark, sf_dir), "doc_id", "text", 2_000).select("doc_id", "n", "start", "end", F.sha2("content", 256).alias("content_hash"))


@query("strf04_fragment_rejoin", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def fragment_rejoin(spark, sf_dir):
    whole = ops.joined_segments(ops.segments(_documents(spark, sf_dir), "doc_id", "text", 2_000), "doc_id")
    return whole.select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("strf05_mask_secrets", r"""SELECT doc_id, sha256(regexp_replace(text, '(token = ")[0-9a-f]{40}"', '\1[secret hidden]"', 'g')) AS masked_hash FROM documents""")
def masked_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.sha2(mask_secrets(F.col("text")), 256).alias("masked_hash"))


@query("strf06_quote_occurrences", "SELECT doc_id, CAST(len(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 4) = 'tion')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def quote_occurrences(spark, sf_dir):
    return _documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.size(fn.occurrences(F.col("text"), F.lit("tion"))).cast("bigint").alias("n"))


_PLACES = "pl AS (SELECT item_id AS quote_id, doc_id AS record_id, strpos(d.text, b.text) - 1 AS place, length(substr(d.text, 1, strpos(d.text, b.text) - 1)) - length(replace(substr(d.text, 1, strpos(d.text, b.text) - 1), chr(10), '')) + 1 AS line, (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS n_hits FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def _places(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return ops.quote_places(_documents(spark, sf_dir).select(F.col("doc_id").alias("record_id"), "text"), quotes)


@query("strf10_quote_places", f"WITH {_PLACES} SELECT quote_id, record_id, CAST(place AS BIGINT) AS place, CAST(line AS BIGINT) AS line, CAST(n_hits AS BIGINT) AS n_hits FROM pl")
def quote_places(spark, sf_dir):
    return _places(spark, sf_dir)


@query("strf11_quote_locate", f"WITH {_PLACES} SELECT quote_id, max(record_id) AS record_id, CAST(arg_max(line, record_id) AS BIGINT) AS line, count(*) AS n_records FROM pl GROUP BY quote_id")
def quote_locate(spark, sf_dir):
    return ops.latest_place(_places(spark, sf_dir))


@query("join07_fork_copies", "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), g AS (SELECT h, min(doc_id) AS first_key, count(*) AS n_copies FROM h GROUP BY h HAVING count(*) > 1) SELECT doc_id, first_key, n_copies FROM h JOIN g USING (h)")
def fork_copies(spark, sf_dir):
    return ops.exact_copies(_documents(spark, sf_dir), "doc_id", "text")


@query("agg08_language_votes", "WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) SELECT source, arg_max(lang, struct_pack(n := n, f := -f)) AS lang, max(n) AS n, CAST(sum(n) AS BIGINT) AS n_all FROM c GROUP BY source")
def language_votes(spark, sf_dir):
    return ops.votes(_documents(spark, sf_dir), "source", "lang", "doc_id")


@query("agg08_script_votes", r"SELECT 'latin' AS script, count(*) AS n FROM documents WHERE regexp_matches(text, '\p{Latin}')")
def script_votes(spark, sf_dir):
    return _documents(spark, sf_dir).select(ops.script_of(F.col("text")).alias("script")).where("script IS NOT NULL").groupBy("script").agg(F.count("*").alias("n"))


@query("agg15_limitation_groups", r"WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[^\s/]*/\S+', '<path>', 'g'), '\d+', '<n>', 'g') AS pattern FROM pages) SELECT pattern, count(*) AS n, arg_min(url, page_id) AS example FROM p GROUP BY pattern")
def limitation_groups(spark, sf_dir):
    return ops.message_groups(table(spark, sf_dir, "pages"), "url", "page_id")


@query("agg17_host_groups", r"SELECT regexp_replace(regexp_extract(url, '//([^/]+)', 1), '\d+', '<n>', 'g') AS pattern, count(*) AS n, arg_min(regexp_extract(url, '//([^/]+)', 1), page_id) AS example FROM pages GROUP BY 1")
def host_groups(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    return ops.message_groups(pages, "host", "page_id")


@query("agg11_expectation_scores", """WITH e AS (SELECT doc_id % 300 AS label, lang AS kind, source AS status FROM documents), f AS (SELECT label, count(*) AS n, min(kind) AS k, min(status) AS s FROM e GROUP BY label),
 x AS (SELECT doc_id AS label, CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END AS kind, 'src' || toxic AS status FROM labels) SELECT CASE WHEN f.n IS NULL THEN 'missing' WHEN f.n > 1 THEN 'split' WHEN x.kind = f.k AND x.status = f.s THEN 'met' ELSE 'differs' END AS result, count(*) AS n FROM x LEFT JOIN f USING (label) GROUP BY 1""")
def expectation_scores(spark, sf_dir):
    events = _documents(spark, sf_dir).select((F.col("doc_id") % 300).alias("label"), F.col("lang").alias("kind"), F.col("source").alias("status"))
    expected = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label"), F.when(F.col("quality") == 1, "en").otherwise("fr").alias("kind"), F.concat(F.lit("src"), F.col("toxic").cast("string")).alias("status"))
    return ledger.expectation_scores(expected, events)


@query("sort01_find_events", """WITH f AS (SELECT doc_id AS id, replace(lower(substr(text, 1, 60)), 'ß', 'ss') AS head, replace(lower(text), 'ß', 'ss') AS whole, lpad(CAST(n_chars AS VARCHAR), 8, '0') AS tm FROM documents WHERE text IS NOT NULL)
 SELECT id, tm AS "at", CASE WHEN contains(head, 'the') AND contains(head, 'tion') THEN 2 ELSE 1 END AS score FROM f WHERE contains(head || chr(10) || whole, 'the') AND contains(head || chr(10) || whole, 'tion') ORDER BY score DESC, tm DESC, id LIMIT 20""")
def find_events(spark, sf_dir):
    events = _documents(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.substring("text", 1, 60).alias("title"), F.lit(None).cast("string").alias("summary"), F.lpad(F.col("n_chars").cast("string"), 8, "0").alias("at"), F.col("text").alias("quotes"))
    return ops.find(events, "The TION").select("id", "at", "score")


@query("sort10_substring_search", "SELECT page_id FROM pages WHERE contains(replace(lower(html), 'ß', 'ss'), 'strasse') OR contains(lower(html), 'footer')")
def substring_search(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(fn.fold_case(F.col("html")).contains("strasse") | fn.fold_case(F.col("html")).contains("footer")).select("page_id")


@query("strf12_head_lines", f"WITH {_LINES}, u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM ln), c AS (SELECT doc_id, n, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS t FROM u) SELECT ln.doc_id, CAST(least(greatest(coalesce((SELECT count(*) FROM c WHERE c.doc_id = ln.doc_id AND t <= 2000), 0), 1), len(l)) AS BIGINT) AS n_head FROM ln")
def head_lines(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", fn.head_lines(fn.lines(F.col("text")), 2_000).cast("bigint").alias("n_head"))


@query("strf13_excerpts", "SELECT doc_id, CASE WHEN length(text) > 400 THEN sha256('…' || substr(text, 81, 250) || '…') END AS excerpt_hash FROM documents")
def excerpts(spark, sf_dir):
    focus = F.array(*[F.struct(F.lit(a).cast("bigint").alias("s"), F.lit(b).cast("bigint").alias("e")) for a, b in ((200, 205), (205, 210))])
    return _documents(spark, sf_dir).select("doc_id", F.sha2(fn.excerpt(F.col("text"), focus), 256).alias("excerpt_hash"))


@query("strf14_safe_text", r"SELECT page_id, sha256(regexp_replace(html, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')) AS safe_hash FROM pages")
def safe_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(fn.safe_text(F.col("html")), 256).alias("safe_hash"))


@query("join23_nearest_lines", f"WITH {_LINES}, u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM ln) SELECT doc_id AS record_id, n AS line, CAST(levenshtein(x, 'The quick answer is in the notes') AS BIGINT) AS distance FROM u WHERE length(x) BETWEEN 16 AND 64 ORDER BY distance, record_id, line LIMIT 3")
def nearest_lines(spark, sf_dir):
    return ops.nearest_lines(_documents(spark, sf_dir).select(F.col("doc_id").alias("record_id"), "text"), "The quick answer is in the notes")


def _quotes_of_sources(spark, sf_dir):
    """Documents as the records of their source, and the benchmark's passages as quotes that one source each is asked for."""
    records = _documents(spark, sf_dir).select(F.col("doc_id").alias("source_id"), F.col("source").alias("session_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"))
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.concat(F.lit("src"), (F.col("item_id") % 10).cast("string")).alias("session_id"), F.col("text").alias("quote"))
    return records, quotes


@query(
    "join23_alike_lines",
    f"""WITH late AS (SELECT doc_id, source, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 400),
 {_LINES.replace("SELECT doc_id, CASE", "SELECT doc_id, source, CASE").replace("FROM documents", "FROM late")},
 u AS (SELECT doc_id, source, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM ln),
 m AS (SELECT item_id, doc_id, n, 2.0::DOUBLE * list_sum([least(length(b.text) - length(replace(b.text, c, '')), length(x) - length(replace(x, c, ''))) FOR c IN list_distinct(string_split(b.text, ''))]) / (length(b.text) + length(x)) AS overlap
  FROM benchmark b JOIN u ON u.source = 'src' || (b.item_id % 10) WHERE length(b.text) > 0 AND regexp_matches(x, '\\S'))
SELECT item_id AS quote_id, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id, n) AS place, doc_id AS source_id, n AS line, CAST(floor(overlap * 1000000) AS BIGINT) AS overlap_ppm FROM m QUALIFY place <= 40""",
)
def alike_lines(spark, sf_dir):
    return nearest.alike_lines(*_quotes_of_sources(spark, sf_dir)).select("quote_id", "place", "source_id", "line", F.floor(F.col("overlap") * 1000000).alias("overlap_ppm"))


@query("join23_closest_lines")
def closest_lines(spark, sf_dir):
    return nearest.closest_lines(*_quotes_of_sources(spark, sf_dir))


@query("prj17_binary_marker", "SELECT page_id, CASE WHEN length(html) >= 2000 THEN '[binary text/html, ' || length(html) || ' chars, sha256 ' || sha256(html) || ']' ELSE sha256(html) END AS content FROM pages")
def binary_markers(spark, sf_dir):
    marked = rules.binary_mark(F.col("html"), F.lit("text/html"), 2_000)
    return table(spark, sf_dir, "pages").select("page_id", F.when(marked.startswith("[binary"), marked).otherwise(F.sha2("html", 256)).alias("content"))


@query("prj01_type_triage", "SELECT event_type AS type, CASE event_type WHEN 'view' THEN 'ignored' WHEN 'click' THEN 'known' WHEN 'error' THEN 'known' ELSE 'unknown' END AS bucket, count(*) AS n FROM events GROUP BY ALL")
def type_triage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), rules.triage(F.col("event_type"), {"view": "no record"}, ("click", "error")).alias("bucket"))
    return rows.groupBy("type", "bucket").agg(F.count("*").alias("n"))


@query("prj05_step_hints", """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 8 WHEN 0 THEN 'edit' WHEN 1 THEN 'test' WHEN 2 THEN 'commit' WHEN 3 THEN 'read' WHEN 4 THEN 'vcs' WHEN 5 THEN 'delegate' WHEN 6 THEN 'run' ELSE 'read' END AS hint FROM orders""")
def step_hints(spark, sf_dir):
    calls = ["Edit\n{\"file_path\": \"a.py\"}", "Bash\n{\"command\": \"cd x && uv run pytest -q | tail -3\"}", "Bash\n{\"command\": \"git add . && git commit -m done\"}", "Bash\n{\"command\": \"rg -n name src\"}", "Bash\n{\"command\": \"git push origin main\"}", "Task\n{\"prompt\": \"look\"}", "Bash\n{\"command\": \"python make.py > out.txt\"}", "Read\n{\"file_path\": \"a.py\"}"]
    content = F.concat(F.lit("Tool: "), F.element_at(F.array(*map(F.lit, calls)), (F.col("o_orderkey") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), rules.step_hint(content).alias("hint"))


@query("prj09_failed_checks", "SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 4 IN (1, 2) AS failed FROM orders")
def failed_checks(spark, sf_dir):
    outputs = ["12 passed\nexit code: 0", "collected\n=== 2 failed, 10 passed ===\nexit code 0", "error\nExited with code 3", "all good"]
    output = F.element_at(F.array(*map(F.lit, outputs)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), rules.check_failed(output, F.lit(False), F.lit(True)).alias("failed"))
