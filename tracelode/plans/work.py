"""Queries on shell lines, work, shown records and citations."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import citations as cites
from ..operators import evidence, model_call
from ..operators import records as rec
from ..operators import texts as ops
from ..operators import units as unit_ops
from ..operators import work
from ..sources.store import written
from .bindings import table
from .registry import query


def _choose(column, cases: dict[int, str], last: str):
    """A column by the number of a case."""
    out = F.lit(last)
    for k, text in reversed(cases.items()):
        out = F.when(column == k, F.lit(text)).otherwise(out)
    return out


def _worded(spark, sf_dir):
    """Documents with three of their words, which the lines below are made of."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0))
    word = lambda k, last: F.coalesce(F.get(found, F.lit(k)), F.lit(last))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("n"), word(0, "one").alias("a"), word(1, "two").alias("b"), word(2, "three").alias("c"))


_WORDED = """d AS (SELECT doc_id AS id, doc_id AS n, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}') AS w FROM documents),
 d3 AS (SELECT id, n, coalesce(w[1], 'one') AS a, coalesce(w[2], 'two') AS b, coalesce(w[3], 'three') AS c FROM d)"""


def _filled(template: str):
    """A template with {a}, {b}, {c} and {n} as a column."""
    parts = [x for x in re.split(r"(\{[abcn]\})", template) if x]
    return F.concat(*[F.col(x[1]).cast("string") if re.fullmatch(r"\{[abcn]\}", x) else F.lit(x) for x in parts], F.lit(""))


def _sql(template: str) -> str:
    parts = [x for x in re.split(r"(\{[abcn]\})", template) if x]
    return " || ".join([x[1] if re.fullmatch(r"\{[abcn]\}", x) else "'" + x.replace("'", "''") + "'" for x in parts] or ["''"])


def _cases(templates: list[str]):
    return F.get(F.array(*map(_filled, templates)), (F.col("n") % len(templates)).cast("int"))


def _sql_cases(values: list[str]) -> str:
    return f"CASE n % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


#: Shell lines of a document's words: the line, whether it writes, and whether inside of /proj.
_LINES = [
    ("echo {a} > /proj/{b}.txt", True, True), ("echo {a} {b} > /dev/null", False, False), ("grep -r '> {a}' src/{b}", False, False), ("S=/tmp/{a}; cp {b} $S/{c}", True, False), ("cp {a} {b}", True, True), ("sed -i 's/{a}/{b}/' /proj/{c}", True, True), ("python -c \"open('{a}').write_text('{b}')\"", False, False),
    ("ls {a} 2>&1", False, False), ("touch /tmp/{a} /proj/{b}", True, True), ("cat <<'EOF' > /tmp/{a}; rm /proj/{b}; EOF", True, False), ("git apply {a}.diff", True, True), ("rm ~/{a}", True, False), ("{a}x --to /proj/{b}; mv /proj/{c} /tmp/{n}", True, False), ("P=/proj/{a}; mkdir -p $P/{n} && ls $P", True, True),
]


@query("prj10_writes_files", f"WITH {_WORDED} SELECT id, {_sql_cases([str(x[1]) for x in _LINES])} AS writes, {_sql_cases([str(x[2]) for x in _LINES])} AS writes_inside FROM d3")
def writes_files(spark, sf_dir):
    rows = _worded(spark, sf_dir).select("id", _cases([x[0] for x in _LINES]).alias("line"))
    return rows.select("id", work.writes_files(F.col("line")).alias("writes"), work.writes_files(F.col("line"), work.below("/proj")).alias("writes_inside"))


#: Shell lines of a document's words, and the commands they are cut into.
_SPLITS = [
    ("cd src/{a} && FOO={b} uv run pytest -q tests/{c}.py", "cd src/{a}|pytest -q tests/{c}.py"), ("sudo git status | grep {a}{b}", "git status|grep {a}{b}"), ("cat > {a}{n} <<'EOF'; rm -rf {b}; EOF; ls {c}{n}", "cat > {a}{n}|ls {c}{n}"), ("timeout 5 docker compose run --rm {a} bash -c 'pytest {b}{n}", "pytest {b}{n}"), ("({a}{n} || npx jest {b}{n});  X={c} Y=1 make {a}{n}", "{a}{n}|jest {b}{n})|make {a}{n}"),
]


@query("prj06_command_split", f"WITH {_WORDED} SELECT id, {_sql_cases([_sql(x[1]) for x in _SPLITS])} AS parts FROM d3")
def command_split(spark, sf_dir):
    rows = _worded(spark, sf_dir).select("id", _cases([x[0] for x in _SPLITS]).alias("line"))
    return rows.select("id", F.array_join(rec.commands(F.col("line")), "|").alias("parts"))


#: Commands around a document's words with their kind.
_KINDS = [
    ("cargo +nightly test {a}", "test"), ("cd {a}{n}; make -j4 lint", "test"), ("./gradlew --info check -P{a}={b}", "test"), ("npm t {a}", "test"), ("node --test {a}.js", "test"), ("mvn -q verify -D{a}", "test"), ("git branch -r {a}", None), ("git branch --merged {a}", None), ("git branch {a}{n}", "vcs"), ("git tag -n5", None), ("git push --dry-run origin {a}", None),
    ("git stash list", None), ("git stash push {a}", "vcs"), ("git -C {a} commit -m '{b} {c}'", "commit"), ("git branch --sort={a}", None), ("git branch -d {a}", "vcs"), ("echo {a}-{b}", None), ("swift build -c {a}", "test"), ("pytest {a} && git add {b} && git commit -m {c}", "commit"), ("git fetch origin {a}", "vcs"), ("cat {a}.txt | wc -l", None),
]


@query("prj07_command_kinds", f"WITH {_WORDED} SELECT id, {_sql_cases(['NULL' if k is None else repr(k) for _, k in _KINDS])} AS kind FROM d3")
def command_kinds(spark, sf_dir):
    rows = _worded(spark, sf_dir).select("id", _cases([x[0] for x in _KINDS]).alias("line"))
    return rows.select("id", rec.command_kind(F.col("line")).alias("kind"))


#: Bodies of tool calls around a document's words, the files they change, and whether these are documents only.
_EDITS = [
    ('Tool: Write\n{{"file_path": "docs/{a}.md", "content": "{b}"}}', "docs/{a}.md", True), ("Tool: apply_patch\n*** Begin Patch\n*** Update File: src/{a}{n}.py\n@@\n-{b}\n+{c}\n*** Add File: docs/{c}{n}.md\n*** End Patch", "src/{a}{n}.py,docs/{c}{n}.md", False), ('Tool: NotebookEdit\n{{"notebook_path": "x/{a}.ipynb"}}', "x/{a}.ipynb", False),
    ('Tool: Bash\n{{"command": "ls {a}"}}', "", False), ("Tool: apply_patch\n*** Begin Patch\n*** Delete File: {a}/{n}.TXT\n*** Update File: {a}/{n}.TXT\n*** End Patch", "{a}/{n}.TXT", True),
]


@query("prj08_edited_files", f"WITH {_WORDED} SELECT id, {_sql_cases([_sql(x[1]) for x in _EDITS])} AS files, {_sql_cases([str(x[2]) for x in _EDITS])} AS documents_only FROM d3")
def edited(spark, sf_dir):
    rows = _worded(spark, sf_dir).select("id", _cases([x[0].replace("{{", "{").replace("}}", "}") for x in _EDITS]).alias("content"))
    return rows.select("id", F.array_join(rec.edited_files(F.col("content")), ",").alias("files"), rec.documents_only(rec.edited_files(F.col("content"))).alias("documents_only"))


#: Tool calls around a document's words, and whether each is work of the project in /proj.
_CALLS = [
    ('Tool: Edit\n{"file_path": "/proj/{a}.py"}', True), ('Tool: Edit\n{"file_path": "/tmp/{a}.py"}', False), ('Tool: Bash\n{"command": "pytest -q {a}"}', True), ('Tool: Bash\n{"command": "ls -l {b}"}', False), ('Tool: Bash\n{"command": "git fetch origin {a}"}', False),
    ('Tool: Bash\n{"command": "git fetch origin {a}:{b}"}', True), ('Tool: Bash\n{"command": "git commit -m {c}"}', True), ('Tool: Bash\n{"command": "touch /tmp/{a}{n}"}', False), ('Tool: Bash\n{"command": "git stash show {a}"}', False), ('Tool: Bash\n{"command": "echo {b} > /proj/{c}"}', True), ('Tool: Edit\n{"file_path": "{a}/{b}.py"}', True),
]


@query("prj11_unnoted_work", f"WITH {_WORDED}, s AS (SELECT n % 20 AS g, max(n) FILTER (WHERE n % 6 = 0) - 400 AS since FROM d3 GROUP BY 1) SELECT d3.id AS call_id FROM d3 JOIN s ON s.g = d3.n % 20 WHERE (since IS NULL OR n > since) AND {_sql_cases([str(x[1]) for x in _CALLS])} AND n % 7 <> 0")
def unnoted_work(spark, sf_dir):
    """Documents as calls of twenty sessions, by their number; every seventh call is a note, and a session's last reminder lies 400 numbers before its last call of six."""
    calls = written(_worded(spark, sf_dir).select((F.col("n") % 20).alias("session_id"), F.col("id").alias("call_id"), F.col("n").alias("at"), _cases([x[0] for x in _CALLS]).alias("content")), "calls")
    since = calls.groupBy("session_id").agg((F.max(F.when(F.col("at") % 6 == 0, F.col("at"))) - 400).alias("since"))
    notes = calls.where(F.col("call_id") % 7 == 0).select("session_id", "call_id")
    return work.unnoted_work(calls, notes, since, work.below("/proj")).select("call_id")


@query("prj04_question_replies", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'which?' END AS question, CASE WHEN turn % 3 = 0 THEN text END AS answer FROM conversations")
def question_replies(spark, sf_dir):
    one = F.concat(F.lit("<send_user_message_question_reply>"), F.to_json(F.array(F.struct(F.lit("which?").alias("question"), F.col("text").alias("answer")))), F.lit("</send_user_message_question_reply>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, one).otherwise(F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", F.get(rec.question_reply(F.col("t")), 0)["question"].alias("question"), F.get(rec.question_reply(F.col("t")), 0)["answer"].alias("answer"))


#: Messages around a document's words, and whether each tells of a loss.
_MESSAGES = [("audit: {a} of {b}", False), ("skipped unit {a}{n}: {b} is too large", False), ("Git history is limited to the latest {n} commits per worktree.", False), ("the file {a}.jsonl could not be read", True), ("skipped units held back: {n}. {b} waits", False), ("skipped unit {a} {b}: two words", True), ("re-analyzing an already integrated work unit: {c}", False)]


@query("prj15_incomplete_input", f"WITH {_WORDED} SELECT n // 5 AS unit, bool_or({_sql_cases([str(x[1]) for x in _MESSAGES])}) AS incomplete FROM d3 GROUP BY 1")
def incomplete_input(spark, sf_dir):
    rows = _worded(spark, sf_dir).select(F.floor(F.col("n") / 5).cast("bigint").alias("unit"), _cases([x[0] for x in _MESSAGES]).alias("message"))
    return work.incomplete_input(rows, "unit", "message")


@query("prj16_detail_predicates", """SELECT event_id AS id, event_type IN ('purchase') OR (event_type = 'error' AND event_id % 3 = 0) OR (event_type = 'click' AND event_id % 3 = 1) AS detail, event_id % 4 = 1 AS sub_agent, event_id % 4 IN (1, 2) AS called FROM events""")
def detail_predicates(spark, sf_dir):
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "action").when(F.col("event_type").isin("purchase", "error"), "outcome").otherwise("question")
    status = F.when(F.col("event_type") == "purchase", "observed_success").otherwise("observed_failure")
    rows = table(spark, sf_dir, "events").select(n.alias("id"), F.when(F.col("event_type") == "signup", "user").alias("actor"), kind.alias("kind"), status.alias("status"), F.when(n % 3 == 0, "check").when(n % 3 == 1, "doc").alias("step"), F.array(F.struct(F.when(n % 4 == 1, "subagent").when(n % 4 == 2, "unattended").otherwise("main").alias("role"), F.lit("codex exec").alias("agent"))).alias("authoring"))
    return rows.select("id", work.is_detail(F.col("actor"), F.col("kind"), F.col("status"), F.col("step")).alias("detail"), work.by_sub_agent(F.col("authoring")).alias("sub_agent"), work.by_called_tool(F.col("authoring")).alias("called"))


@query("prj18_flatten_text", "SELECT doc_id, sha256('head' || chr(10) || text || chr(10) || lang) AS text_hash FROM documents WHERE text IS NOT NULL")
def flatten_text(spark, sf_dir):
    block = lambda text, kind="text": F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block(F.lit("head")), block(F.concat(F.lit("hidden "), "doc_id"), "thinking"), block(F.col("text")), block(F.col("lang")))
    nested = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(blocks.alias("content"))).alias("body"))
    return nested.select("doc_id", work.flatten_text(F.col("body")).alias("t")).select("doc_id", F.sha2("t", 256).alias("text_hash"))


@query("prj19_record_for_model", """SELECT '{"session_id":' || conv_id || ',"pos":' || turn || CASE WHEN role <> 'user' THEN ',"role":"' || role || '"' ELSE '' END || '}' AS body FROM conversations""")
def record_for_model(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", F.lit("original").alias("derivation"), F.lit(None).cast("string").alias("call_id"))
    return rows.select(work.record_for_model(rows, ["session_id", "pos", "role", "derivation", "call_id"], {"role": "user", "derivation": "original"}).alias("body"))


@query("prj23_safe_metadata", "SELECT event_id, value, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS event_type FROM events")
def safe_metadata(spark, sf_dir):
    return work.safe_metadata(table(spark, sf_dir, "events"), "event_id", ["value"], {"event_type": "click|view"})


@query("strf17_output_tail", r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS x FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, sha256(array_to_string(list_transform(list_slice(list_concat(['start'], x), greatest(len(x) + 1 - 7, 1), len(x) + 1), lambda y: substr(y, 1, 300)), chr(10))) AS tail_hash FROM l""")
def output_tail(spark, sf_dir):
    wrapped = F.concat(F.lit("start\n  \n"), F.to_json(F.struct(F.lit(0).alias("exit_code"), F.col("text").alias("output"))))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(work.output_tail(wrapped), "\n").alias("tail"))
    return rows.select("doc_id", F.sha2("tail", 256).alias("tail_hash"))


#: Bodies around a document's words, and the test that runs after the patch.
_INLINE = [
    ('await tools.apply_patch("{a}");\nawait tools.exec_command({cmd: "pytest  -q\\n tests/{b}{n}"})', "pytest -q tests/{b}{n}"), ('await tools.exec_command({"cmd": "ls {a}"}); await tools.apply_patch("{b}")', None), ('tools.exec_command({cmd: "pytest {a}"})', None),
]


@query("strf18_inline_run", f"WITH {_WORDED} SELECT id, {_sql_cases(['NULL' if x[1] is None else _sql(x[1]) for x in _INLINE])} AS run FROM d3")
def inline_run(spark, sf_dir):
    rows = _worded(spark, sf_dir).select("id", _cases([x[0] for x in _INLINE]).alias("body"))
    return rows.select("id", work.inline_run(F.col("body")).alias("run"))


@query("strf19_delegations", f"WITH {_WORDED} SELECT id, CASE n % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE 'sub-agent' END AS agent, CASE n % 3 WHEN 0 THEN 'do ' || b || ' ' || c || ' ' || n WHEN 1 THEN a || ' on ' || c ELSE '' END AS task FROM d3")
def delegations(spark, sf_dir):
    arguments = F.when(F.col("n") % 3 == 0, F.to_json(F.struct(F.col("a").alias("subagent_type"), F.concat(F.lit("do\n "), "b", F.lit("  "), "c", F.lit("\t"), "n").alias("description")))).when(F.col("n") % 3 == 1, F.to_json(F.struct(F.concat(F.lit(" "), "b").alias("target"), F.concat("a", F.lit("  on "), "c", F.lit(" ")).alias("message")))).otherwise(F.lit("{}"))
    return _worded(spark, sf_dir).select("id", work.delegation(arguments).alias("d")).select("id", "d.agent", "d.task")


@query("strf20_path_terms", "SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_]{3,}'), lambda x: lower(x)))) AS BIGINT) AS n_terms FROM documents WHERE text IS NOT NULL")
def path_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(work.path_terms(F.col("text"))["terms"]).cast("bigint").alias("n_terms"))


@query("strf21_shown_records", r"""WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS x FROM documents WHERE text IS NOT NULL),
 h AS (SELECT doc_id, x, len(x) AS n, CAST(CASE WHEN len(x) = 0 THEN 0 ELSE greatest(1, coalesce(len(list_filter(range(1, len(x) + 1), lambda i: list_sum(list_transform(x[1:i], lambda y: length(y) + 1)) <= 600)), 0)) END AS BIGINT) AS head,
  CAST(CASE WHEN len(x) = 0 THEN 0 ELSE greatest(1, coalesce(len(list_filter(range(1, len(x) + 1), lambda i: list_sum(list_transform(x[len(x) - i + 1:], lambda y: length(y) + 1)) <= 300)), 0)) END AS BIGINT) AS tail0 FROM l), t AS (SELECT *, least(tail0, n - head) AS tail FROM h)
 SELECT doc_id, head, tail, CASE WHEN n > head + tail THEN head + 1 END AS omitted_from, CAST(CASE WHEN n > head + tail THEN length(array_to_string(x[head + 1:n - tail], chr(10))) END AS BIGINT) AS omitted_chars FROM t""")
def shown_records(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", work.shown_record(F.col("text"), 600, 300).alias("s"))
    return rows.select("doc_id", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("head", "tail", "omitted_from", "omitted_chars")])


@query("dt07_canonical_json", """SELECT '{' || '"event_id":' || event_id || ',"event_type":"' || event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE '","k":"' || json_extract_string(props, '$.k') END || '","user_id":' || user_id || '}' AS body FROM events""")
def canonical_json(spark, sf_dir):
    k = F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select(work.canonical_json({"user_id": F.col("user_id"), "k": k, "event_type": F.col("event_type"), "event_id": F.col("event_id")}).alias("body"))


_DOC_LINES = "l AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS x FROM documents WHERE text IS NOT NULL)"


@query("strf08_citations", f"""WITH {_DOC_LINES}, c AS (SELECT doc_id, len(x) AS n, x, doc_id % 5 AS way FROM l WHERE len(x) > 0)
 SELECT doc_id AS cite_id, CASE WHEN way IN (0, 4) THEN CAST(1 AS BIGINT) END AS first_line, CASE WHEN way = 0 THEN CAST(n AS BIGINT) WHEN way = 4 THEN CAST(n AS BIGINT) END AS last_line,
 CASE way WHEN 0 THEN 'exact' WHEN 1 THEN 'refused: unknown source' WHEN 2 THEN 'refused: no quote' WHEN 3 THEN 'refused: not found once' ELSE 'moved' END AS mode FROM c WHERE length(array_to_string(x, chr(10))) >= 8 AND trim(x[len(x)]) <> '' AND (way NOT IN (0, 4) OR n > 0)""")
def citations(spark, sf_dir):
    from ..functions.text import lines

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", lines(F.col("text")).alias("x"), (F.col("doc_id") % 5).alias("way")).where("size(x) > 0").withColumn("whole", F.array_join("x", "\n")).where("length(whole) >= 8 AND trim(x[size(x) - 1]) <> ''")
    way = F.col("way")
    # An exact citation of all lines; one of an unknown source, one without a quote, one of words that stand nowhere; and one that names a line that is not there.
    quote = F.when(way == 2, None).when(way == 3, "words that stand nowhere here").otherwise(F.col("whole"))
    asked = docs.select(F.col("doc_id").alias("cite_id"), F.when(way == 1, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("source_id"), F.when(way == 4, F.size("x") + 1).otherwise(1).alias("start_line"), F.when(way == 4, F.size("x") + 1).otherwise(F.size("x")).alias("end_line"), quote.alias("quote"))
    shown = docs.select(F.col("doc_id").alias("source_id"), F.lit(1).alias("lo"), F.size("x").alias("hi"))
    return cites.validated(asked, docs.select(F.col("doc_id").alias("source_id"), F.col("whole").alias("content")), shown)


@query("strf09_cut_citations", f"""WITH {_DOC_LINES}, c AS (SELECT doc_id, x, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE least(len(x), 2) END AS a, CASE WHEN doc_id % 3 = 0 THEN least(len(x), 20) ELSE least(len(x), 2) END AS b FROM l WHERE len(x) > 0), q AS (SELECT doc_id, a, b, array_to_string(x[a:b], chr(10)) AS quote FROM c)
 SELECT doc_id, CASE WHEN regexp_matches(quote, '[^ \\t\\n\\x0B\\f\\r]') THEN CAST(a AS BIGINT) END AS start_line, CASE WHEN regexp_matches(quote, '[^ \\t\\n\\x0B\\f\\r]') THEN CAST(b AS BIGINT) END AS end_line, CASE WHEN regexp_matches(quote, '[^ \\t\\n\\x0B\\f\\r]') THEN sha256(quote) END AS quote_hash FROM q""")
def cut_citations(spark, sf_dir):
    from ..functions.text import lines

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("n", F.size(lines(F.col("text")))).where("n > 0")
    start = F.when(F.col("doc_id") % 3 != 0, F.least(F.col("n"), F.lit(2)))
    cut = docs.select("doc_id", cites.cut_citation(F.col("text"), F.lit(1), F.col("n"), start, F.lit(None).cast("int")).alias("c"))
    return cut.select("doc_id", "c.start_line", "c.end_line", F.sha2("c.quote", 256).alias("quote_hash"))


@query("agg19_evidence_ids", "SELECT o_orderkey AS id, CASE WHEN o_custkey = o_orderkey % 100 THEN 'c' || o_custkey ELSE 'c' || o_custkey || ',c' || o_orderkey % 100 END || ',' || o_orderpriority AS evidence_ids FROM orders")
def evidence_ids(spark, sf_dir):
    c = lambda x: F.concat(F.lit("c"), x)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(c(F.col("o_custkey")), c(F.col("o_orderkey") % 100)).alias("a"), F.array(c(F.col("o_custkey")), F.col("o_orderpriority"), F.lit(None)).alias("b"))
    return cites.evidence_ids(rows, "id", ["a", "b"]).select("id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("agg20_quote_chars", "SELECT conv_id AS unit_id, role AS section, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL HAVING sum(length(text)) > 0")
def quote_chars(spark, sf_dir):
    item = lambda role: F.collect_list(F.when(F.col("role") == role, F.struct(F.array(F.struct(F.col("text").alias("quote"))).alias("evidence")))).alias(role)
    answers = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("unit_id")).agg(item("user"), item("assistant"))
    return cites.quote_chars(answers, "unit_id", {"user": "user", "assistant": "assistant"})


@query("udf07_rehydrated", """WITH g AS (SELECT l_orderkey AS k, l_linenumber AS i, min(CAST(l_partkey AS VARCHAR)) AS line FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY ALL), p AS (SELECT k, max(i) AS n FROM g GROUP BY 1), s AS (SELECT k, n, unnest(range(1, n + 1)) AS i FROM p)
 SELECT k AS source_id, CAST(n AS BIGINT) AS n_lines, string_agg(coalesce(line, ''), chr(10) ORDER BY i) AS content FROM s LEFT JOIN g USING (k, i) GROUP BY k, n""")
def rehydrated(spark, sf_dir):
    kept = table(spark, sf_dir, "lineitem").where("l_linenumber % 3 <> 2").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("start_line"), F.col("l_partkey").cast("string").alias("quote"))
    return cites.rehydrated(kept)


@query("win16_block_numbers", "SELECT conv_id AS session_id, turn AS pos, 'B' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations WHERE role = 'assistant'")
def block_numbers(spark, sf_dir):
    blocks = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"))
    return cites.numbered_blocks(blocks, "B")


@query("sort05_memory_selection", """WITH r AS (SELECT o_orderpriority AS section, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rank, o_orderkey FROM orders)
 SELECT section, CAST(rank AS INTEGER) AS rank, 'order ' || o_orderkey AS text FROM r WHERE (section = '1-URGENT' AND rank <= 5) OR (section = '2-HIGH' AND rank < 2)""")
def memory_selection(spark, sf_dir):
    ranked = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")))
    long = (F.col("o_orderpriority") == "2-HIGH") & (F.col("rank") == 2)
    sections = ranked.select(F.col("o_orderpriority").alias("section"), "rank", F.when(long, F.repeat(F.lit("x"), 3000)).otherwise(F.concat(F.lit("order "), "o_orderkey")).alias("text"))
    return ops.memory_selection(sections, {"1-URGENT": 5, "2-HIGH": 3})


@query("sort04_context_ranking", """WITH u AS (SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'signup'),
 m AS (SELECT u.user_id * 1000 + u.k AS unit_id, e.event_id AS id, u.user_id = e.user_id AS same FROM u JOIN events e ON CAST(json_extract_string(e.props, '$.k') AS BIGINT) = u.k AND e.event_type = 'error'),
 r AS (SELECT unit_id, id, row_number() OVER (PARTITION BY unit_id ORDER BY same DESC, id DESC) AS place FROM m) SELECT unit_id, id, place FROM r WHERE place <= 6""")
def context_ranking(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    events = table(spark, sf_dir, "events")
    none = F.array().cast("array<string>")
    units = events.where("event_type = 'signup'").select("user_id", k.alias("k")).distinct().select((F.col("user_id") * 1000 + F.col("k")).alias("unit_id"), F.col("user_id").alias("session_id"), F.array(F.concat(F.lit("f"), "k")).alias("paths"), none.alias("words"))
    known = events.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"), F.array(F.concat(F.lit("f"), k)).alias("paths"), none.alias("words"))
    return evidence.context_ranking(units, known)


@query("udf04_result_reuse", "SELECT conv_id AS unit_id, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END AS attempts FROM conversations GROUP BY 1")
def result_reuse(spark, sf_dir):
    records = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("source_id"), "conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    wanted = records.groupBy(F.col("conv_id").alias("unit_id")).agg(F.collect_list("source_id").alias("sources"))
    units = unit_ops.unit_input(wanted, records)
    kept = units.where("unit_id % 3 = 0").select(F.sha2("request", 256).alias("digest"), F.lit('{"events": []}').alias("answer"))
    return model_call.ask_changed(units, kept).select("unit_id", "attempts")


@query("udf03_unit_inputs", "SELECT conv_id AS unit_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def unit_inputs(spark, sf_dir):
    records = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("source_id"), "conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    wanted = records.groupBy(F.col("conv_id").alias("unit_id")).agg(F.collect_list("source_id").alias("sources"))
    read = F.from_json("request", "records array<struct<pos:long,source_id:string,role:string,content:string>>")["records"]
    built = unit_ops.unit_input(wanted, records).select("unit_id", read.alias("r"))
    return built.select("unit_id", F.size("r").cast("bigint").alias("n"), F.aggregate("r", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["content"])).alias("chars"))
