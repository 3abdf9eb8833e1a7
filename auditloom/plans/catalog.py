"""Queries over the test tables, one an operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.functions import ecmascript
from auditloom.functions.format import format_bytes, format_duration
from auditloom.operators import cache, classify, commits, diff, enrich, graph, patch, provider, redact, report, scan, tokens, verdict
from auditloom.sources.store import scratch
from auditloom.sources.tables import corpus, size_capped, table
from auditloom.sources.vocabulary import tokenizer_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Secrets are planted alike in both engines, from a hash of the id.
_H = "md5(CAST(doc_id AS {s}))"
_PLANT = f"""concat({{text}}, ' AKIA', upper(substr({_H}, 1, 16)), ' Authorization: Bearer ', {_H}, '==
my_password = "', {_H}, '" and postgres://u:', {_H}, '@h/db
ghp_', {_H}, 'abcd glpat-', {_H}, ' eyJ', {_H}, '.eyJ', {_H}, '.', {_H}, ' sk_live_', {_H})"""


def _planted(spark: SparkSession, d: str) -> DataFrame:
    return corpus(table(spark, d, "documents")).withColumn("content", F.expr(_PLANT.format(s="STRING", text="content")))


_CORPUS = "SELECT doc_id, source, 'src/' || source || '/' || doc_id || '.md' AS path, text AS content FROM documents"
_PLANTED_SQL = f"SELECT doc_id, source, path, {_PLANT.format(s='VARCHAR', text='content')} AS content FROM ({_CORPUS})"


def _redacted_sql(inner: str) -> str:
    out = f"SELECT doc_id, path, content, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS names FROM ({inner})"
    for name, pattern, ignore in K.SECRET_PATTERNS:
        p = pattern.removeprefix("(?<![A-Za-z0-9/+=])").removesuffix("(?![A-Za-z0-9/+=])").replace("'", "''")
        i = "i" if ignore else ""
        out = f"""SELECT doc_id, path, regexp_replace(content, '{p}', '{K.MARKER}', 'g{i}') AS content, n + c AS n, CASE WHEN c > 0 THEN list_append(names, '{name}') ELSE names END AS names
          FROM (SELECT *, len(regexp_extract_all(content, '{p}', 0, 'c{i}')) AS c FROM ({out}))""".replace("'ci'", "'i'")
    return out


_REDACTED_SQL = _redacted_sql(_PLANTED_SQL)


@query(f"SELECT doc_id, n AS redacted_count, array_to_string(names, '|') AS matched FROM ({_REDACTED_SQL})")
def redact_counts(spark: SparkSession, d: str) -> DataFrame:
    return redact.redact(_planted(spark, d)).select("doc_id", "redacted_count", F.array_join("matched_patterns", "|").alias("matched"))


@query(f"SELECT doc_id, md5(content) AS text_md5 FROM ({_REDACTED_SQL})")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    return redact.redact(_planted(spark, d)).select("doc_id", F.md5("content").alias("text_md5"))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS total_redacted, count(*) FILTER (n > 0) AS files_affected FROM ({_redacted_sql(_CORPUS)})")
def redact_report(spark: SparkSession, d: str) -> DataFrame:
    return redact.redaction_totals(redact.redact(corpus(table(spark, d, "documents"))))


@query(f"""SELECT path, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN n > 0 THEN 'Matched patterns: ' || array_to_string(names, ', ') ELSE 'AI disabled' END AS message,
  CASE WHEN n > 0 THEN 'Potential secret detected (' || n || ' redaction(s))' END AS issue FROM ({_redacted_sql(_CORPUS)})""")
def security_verdict(spark: SparkSession, d: str) -> DataFrame:
    files = redact.redact(corpus(table(spark, d, "documents")))
    results = redact.security_results(files, redact.redaction_rows(files))
    return results.select("path", "status", "message", F.get("issues", F.lit(0))["message"].alias("issue"))


_LINES = "concat(text, '\n  Please reset your PASSWORD or api_key ', doc_id, '\nAccess_Token: none\n')"


@query(f"""SELECT path, keyword, line, context FROM (SELECT path, CASE {' '.join(f"WHEN contains(lower(t), '{k}') THEN '{k}'" for k in K.KEYWORDS)} END AS keyword, CAST(i AS BIGINT) AS line,
  path || ':' || i || ' → ' || substr(trim(t, E' \\t\\n\\r'), 1, 120) AS context FROM (SELECT 'src/' || source || '/' || doc_id || '.md' AS path, unnest(string_split({_LINES}, E'\\n')) AS t, unnest(range(1, len(string_split({_LINES}, E'\\n')) + 1)) AS i FROM documents)) WHERE keyword IS NOT NULL""")
def suspicious_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("text", F.expr(_LINES))
    return scan.suspicious_lines(corpus(docs))


@query("SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS tokens, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def payload_summary(spark: SparkSession, d: str) -> DataFrame:
    return scan.payload_summary(corpus(table(spark, d, "documents")))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tokens.estimate(F.col("text")).alias("tokens"))


_PROVIDER = "CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'Gemini' WHEN 1 THEN 'openai' WHEN 2 THEN 'ANTHROPIC' ELSE 'other' END"
_SPARK_LIMIT = "CAST(substr(source, 4) AS INT) * 2000"


@query(f"""SELECT source, total, most, CASE WHEN total >= most THEN 'exceeded' WHEN total >= floor(most * 0.8) THEN 'warn' ELSE 'ok' END AS gate, CAST(floor(total / most * 100 + 0.5) AS BIGINT) AS percent FROM (
  SELECT source, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS total, CAST(CASE WHEN {_SPARK_LIMIT} > 0 AND CAST(substr(source, 4) AS INT) < 15 THEN {_SPARK_LIMIT} ELSE CASE lower({_PROVIDER}) WHEN 'gemini' THEN 1000000 WHEN 'openai' THEN 128000 WHEN 'anthropic' THEN 200000 ELSE 100000 END END AS BIGINT) AS most
  FROM documents GROUP BY source)""")
def token_gate(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "documents").groupBy("source").agg(F.sum(tokens.estimate(F.col("text"))).alias("total"))
    override = F.when(F.expr("CAST(substr(source, 4) AS INT)") < 15, F.expr(_SPARK_LIMIT)).otherwise(0)
    most = tokens.limit(F.expr(_PROVIDER), override)
    return total.withColumn("most", most).withColumn("gate", tokens.gate(F.col("total"), F.col("most"))).withColumn("percent", tokens.percent(F.col("total"), F.col("most")))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents ORDER BY tokens DESC, doc_id LIMIT 3")
def top3_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.top_files(token_estimate(spark, d), "tokens", "doc_id")


_NAMES = ("src/a.ts", "README.md", "lib/X.PY", ".env", "id_rsa", "key.pem", "yarn.lock", "notes.txt", "conf/.env.js", "package-lock.json", "web/pnpm-lock.yaml", "a.min.js", "credentials.json", "service-account-x.json", "PACKAGE-LOCK.JSON", "node_modules/x/y.js", "a/dist/b.css", "src/build.rs", "tmp/z.go", "a.b/c", "Makefile", "src/x.Java")
_PATH = "CASE doc_id % {} {} END".format(len(_NAMES), " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)))
_PATHS_SQL = f"SELECT doc_id, {_PATH} AS path FROM documents"
_GLOBS = "|".join(g.replace(".", r"\.").replace("*", ".*") for g in K.BLOCKED_PATTERNS)
_BASE = "regexp_replace(path, '^.*/', '')"
_REASON = f"""CASE WHEN lower(regexp_extract({_BASE}, '^.+\\.([^.]*)$', 1)) NOT IN ({', '.join(f"'{e}'" for e in K.ALLOWED_EXTENSIONS)}) THEN '{K.NOT_ALLOWED}' WHEN regexp_matches({_BASE}, '^(?:{_GLOBS})$', 'i') THEN '{K.BLOCKED}' END"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr(_PATH).alias("path"))


@query(f"SELECT doc_id, path, {_REASON} AS reason FROM ({_PATHS_SQL})")
def classify_paths(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify(_paths(spark, d))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM ({_PATHS_SQL})) WHERE reason IS NOT NULL GROUP BY reason")
def rejection_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return classify.rejections(classify_paths(spark, d))


@query(f"SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS rejected FROM (SELECT {_REASON} AS reason FROM ({_PATHS_SQL}))")
def classification_totals(spark: SparkSession, d: str) -> DataFrame:
    return classify.totals(classify_paths(spark, d))


_IGNORE = "# built\n*.css\n!keep.css\nnode_modules/\n/lib\n**/build.rs\n"


@query(f"""SELECT doc_id, CASE WHEN path LIKE '%.css' OR path LIKE 'node_modules/%' OR path LIKE '%/node_modules/%' OR path = 'lib' OR path LIKE 'lib/%' OR path = 'build.rs' OR path LIKE '%/build.rs' THEN '{K.IGNORED}' ELSE {_REASON} END AS reason FROM ({_PATHS_SQL})""")
def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify(_paths(spark, d), rules=classify.ignore_rules(_IGNORE)).select("doc_id", "reason")


@query("SELECT doc_id, regexp_matches(path, '(^|/)({})/') AS blocked FROM ({})".format("|".join(x.replace(".", r"\.") for x in K.BLOCKED_DIRECTORIES), _PATHS_SQL))
def blocked_dirs(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("doc_id", classify.in_blocked_directory(F.col("path")).alias("blocked"))


@query(f"SELECT doc_id, regexp_extract(path, '\\.([^.]+)$', 1) IN ({', '.join(f"'{e}'" for e in K.CODE_EXTENSIONS)}) AS code FROM ({_PATHS_SQL})")
def is_code_file(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("doc_id", classify.code_file(F.col("path")).alias("code"))


@query(f"SELECT doc_id, regexp_matches(trim(path), '\\.({'|'.join(K.GIT_EXTENSIONS)})$') AS source FROM ({_PATHS_SQL})")
def git_extension(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("doc_id", classify.git_source(F.col("path")).alias("source"))


_DIFF_SQL = """SELECT doc_id, path, 'diff --git a/' || path || ' b/' || path || E'\\n--- /dev/null\\n+++ b/' || path || E'\\n@@ -0,0 +1,' || len(l) || E' @@\\n' || array_to_string(list_transform(l, lambda x: '+' || x), E'\\n') AS patch
  FROM (SELECT doc_id, path, string_split(content, E'\\n')[1:400] AS l FROM (""" + _CORPUS + "))"


@query(f"SELECT doc_id, md5(patch) AS patch_md5 FROM ({_DIFF_SQL})")
def synthetic_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diffs(spark, d).select("doc_id", F.md5("patch").alias("patch_md5"))


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    return corpus(table(spark, d, "documents")).withColumn("patch", diff.synthetic_diff(F.col("path"), F.col("content")))


_CHANGES = "concat(patch, '\n-old ', doc_id, '\n--- x\n-- y\n+++ z\n++ w', repeat('\n-gone', CAST(doc_id % 7 AS INT)))"


@query(f"""SELECT doc_id, CAST(len(list_filter(l, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++ '))) AS BIGINT) AS additions, CAST(len(list_filter(l, lambda x: starts_with(x, '-') AND NOT starts_with(x, '--- '))) AS BIGINT) AS deletions
  FROM (SELECT doc_id, string_split({_CHANGES}, E'\\n') AS l FROM ({_DIFF_SQL}))""")
def patch_stats(spark: SparkSession, d: str) -> DataFrame:
    plus, minus = diff.line_counts(F.expr(_CHANGES))
    return _diffs(spark, d).select("doc_id", plus.alias("additions"), minus.alias("deletions"))


_PATCH = "CASE doc_id % 5 WHEN 0 THEN ' \n\t ' WHEN 1 THEN concat(text, 'Binary files a and b differ') WHEN 2 THEN concat('x GIT binary patch', text) WHEN 3 THEN concat(' ', replace(text, '\n', ' ')) ELSE concat('+', text) END"


@query(f"""SELECT doc_id, CASE WHEN length(trim(p, E' \\t\\n')) = 0 THEN '{K.NO_DIFF}' WHEN contains(p, 'Binary files ') OR contains(p, 'GIT binary patch') THEN '{K.BINARY}' WHEN p NOT LIKE '+%' THEN '{K.NO_CHANGE}' END AS reason FROM (SELECT doc_id, {_PATCH} AS p FROM documents)""")
def patch_skip_reason(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", diff.skip_reason(F.expr(_PATCH)).alias("reason"))


@query(f"SELECT doc_id, md5(CASE WHEN length(text) > 12000 THEN left(text, 12000) || '{K.TRUNCATED}' ELSE text END) AS patch_md5, length(text) > 12000 AS cut FROM documents")
def truncate_patch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(diff.truncate(F.col("text"))).alias("patch_md5"), (F.length("text") > K.MAX_CHARS_PER_FILE).alias("cut"))


@query(f"SELECT source, path, CAST(row_number() OVER (PARTITION BY source ORDER BY path) AS INT) AS position, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY path) > 15 THEN 'Skipped by maxFiles guardrail (15)' END AS reason FROM (SELECT DISTINCT source, path FROM ({_CORPUS}))")
def max_files_cap(spark: SparkSession, d: str) -> DataFrame:
    return diff.cap_files(corpus(table(spark, d, "documents")), by="source")


@query(f"SELECT path, row_number() OVER (ORDER BY path) AS position, CASE WHEN row_number() OVER (ORDER BY path) > 15 THEN 'Skipped by maxFiles guardrail (15)' END AS reason FROM (SELECT DISTINCT path FROM ({_CORPUS}))")
def max_files_of_all(spark: SparkSession, d: str) -> DataFrame:
    return diff.cap_files(corpus(table(spark, d, "documents")))


@query("""WITH RECURSIVE c AS (SELECT source, doc_id, CAST(length(text) % 500 AS BIGINT) AS changed, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
  f AS (SELECT source, doc_id, changed, i, changed <= 1200 AS kept, CASE WHEN changed <= 1200 THEN changed ELSE 0 END AS total FROM c WHERE i = 1
  UNION ALL SELECT c.source, c.doc_id, c.changed, c.i, f.total + c.changed <= 1200, CASE WHEN f.total + c.changed <= 1200 THEN f.total + c.changed ELSE f.total END FROM f JOIN c ON c.source = f.source AND c.i = f.i + 1)
  SELECT source, doc_id AS position, changed, kept, CAST(total AS BIGINT) AS total FROM f""")
def diff_budget(spark: SparkSession, d: str) -> DataFrame:
    return diff.budget(table(spark, d, "documents").select("source", "doc_id", (F.length("text") % 500).alias("changed")), "source", "doc_id", "changed")


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS t, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS i FROM documents WHERE length(text) > 2000),
  f AS (SELECT doc_id, i, t, length(t) + 1 AS size, 0 AS chunk FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.t, CASE WHEN f.size + length(l.t) + 1 > 2000 AND f.size > 0 THEN length(l.t) + 1 ELSE f.size + length(l.t) + 1 END, CASE WHEN f.size + length(l.t) + 1 > 2000 AND f.size > 0 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
  SELECT doc_id, CAST(chunk AS INT) AS chunk, md5(string_agg(t, E'\\n' ORDER BY i)) AS chunk_md5 FROM f GROUP BY doc_id, chunk UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 2000""")
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(tokens.chunk_lines(F.col("text"), 2000)).alias("chunk", "t")).select("doc_id", "chunk", F.md5("t").alias("chunk_md5"))


_MESSAGE = "CASE event_type WHEN 'click' THEN concat('feat: click ', event_id) WHEN 'error' THEN concat('FIX(', user_id, '): error') WHEN 'purchase' THEN 'chore: release' WHEN 'signup' THEN concat('Skip: signup ', event_id) ELSE concat('WIP view | ', event_id) END"
_COMMITS_SQL = f"SELECT event_id, {_MESSAGE} AS message FROM events"
_PATTERNS = (("feat", "^feat", False), ("fix", "^fix", False), ("broken", "[invalid", False), ("chore", "^chore", True))


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.expr(_MESSAGE).alias("message"))


@query(f"SELECT event_id, contains(lower(message), 'skip:') AS skipped, regexp_matches(message, '^wip', 'i') AS excluded FROM ({_COMMITS_SQL})")
def skip_commits(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("message")
    return _commits(spark, d).select("event_id", commits.skipped(m, ["skip:"]).alias("skipped"), commits.excluded(m, ["^wip", "(bad"]).alias("excluded"))


_TYPES = "list_filter(['feat', 'fix', 'chore'], lambda t: starts_with(lower(message), t))"


@query(f"SELECT event_id, len(t) > 0 AS matched, array_to_string(t, ',') AS types FROM (SELECT event_id, {_TYPES} AS t FROM ({_COMMITS_SQL}))")
def match_any(spark: SparkSession, d: str) -> DataFrame:
    m = commits.match_patterns(F.col("message"), _PATTERNS)
    return _commits(spark, d).select("event_id", m.alias("m")).select("event_id", "m.matched", F.array_join("m.matched_types", ",").alias("types"))


@query(f"SELECT event_id, list_contains(t, 'chore') AS matched, CASE WHEN list_contains(t, 'chore') THEN '' ELSE 'chore' END AS missing FROM (SELECT event_id, {_TYPES} AS t FROM ({_COMMITS_SQL}))")
def match_all(spark: SparkSession, d: str) -> DataFrame:
    m = commits.match_patterns(F.col("message"), _PATTERNS, "all")
    return _commits(spark, d).select("event_id", m.alias("m")).select("event_id", "m.matched", F.array_join("m.missing", ",").alias("missing"))


@query(f"SELECT event_id FROM ({_COMMITS_SQL}) WHERE NOT contains(lower(message), 'skip:') AND NOT regexp_matches(message, '^wip', 'i') AND regexp_matches(message, '^(feat|fix|chore)', 'i')")
def filter_commits(spark: SparkSession, d: str) -> DataFrame:
    return commits.filter_commits(_commits(spark, d), ["skip:"], ["^wip"], _PATTERNS).select("event_id")


@query(f"SELECT trim(p[1]) AS hash, trim(p[2]) AS message, trim(coalesce(p[3], '')) AS author, trim(coalesce(p[4], '')) AS date FROM (SELECT string_split(l, '|') AS p FROM (SELECT concat(CASE WHEN event_id % 9 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END, '|', message, '|u', event_id % 5) AS l FROM ({_COMMITS_SQL}))) WHERE trim(p[1]) <> ''")
def commit_log(spark: SparkSession, d: str) -> DataFrame:
    line = "concat(CASE WHEN event_id % 9 = 0 THEN '' ELSE CAST(event_id AS STRING) END, '|', message, '|u', event_id % 5)"
    return commits.parse_log(_commits(spark, d).select(F.expr(line).alias("line")))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def recent_commits(spark: SparkSession, d: str) -> DataFrame:
    return commits.recent(_commits(spark, d), 25, "ts", "event_id").select("event_id")


@query("SELECT 'f' || (event_id % 300) || '.' || event_type AS file, CAST(min(event_id * 2) AS BIGINT) AS first FROM events GROUP BY 1 UNION ALL SELECT 'g' || (user_id % 50) AS file, CAST(min(event_id * 2 + 1) AS BIGINT) FROM events GROUP BY 1")
def distinct_commit_files(spark: SparkSession, d: str) -> DataFrame:
    files = F.array(F.expr("concat('f', event_id % 300, '.', event_type)"), F.expr("concat('g', user_id % 50)"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("position"), files.alias("files"))
    return commits.distinct_files(rows).select("file", (F.col("first.position") * 2 + F.col("first.at")).alias("first"))


_VERDICTS = (
    ('{"status":"PASS"}', "PASS", None, 0),
    ('```json\n{"status":"FAIL","issues":[{"line":3,"severity":"CRITICAL","message":"m"},{"line":-5,"severity":"BLOCKER","message":"n","suggestion":"s"},{"severity":"INFO"}]}\n```', "FAIL", None, 2),
    ('Here you are: {"status":"PASS","message":"fine","issues":{}} - done', "PASS", "fine", 0),
    ("not json at all", "ERROR", K.PARSE_FAILED, 0),
    ('{"status":"INVALID"}', "ERROR", K.BAD_FORMAT, 0),
    ("null", "ERROR", K.PARSE_FAILED, 0),
    ("5", "ERROR", K.BAD_FORMAT, 0),
    ("[1]", "ERROR", K.BAD_FORMAT, 0),
    ('{"status":"PASS"} x }', "ERROR", K.PARSE_FAILED, 0),
    ('{"status":"FAIL","status":"PASS","issues":[{"line":4.5,"message":"w"},{"line":true,"severity":"INFO","message":""}]}', "PASS", None, 2),
    ("", "ERROR", K.PARSE_FAILED, 0),
)


def _cases(values: list[str]) -> str:
    return f"CASE event_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _literal(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*(F.lit(v[0]) for v in _VERDICTS)), (F.col("event_id") % len(_VERDICTS) + 1).cast("int"))
    return verdict.parse_verdicts(table(spark, d, "events").select("event_id", text.alias("text"))).select("event_id", F.concat(F.lit("f"), "event_id").alias("path"), "verdict.*")


@query(f"SELECT event_id, {_cases([_literal(v[1]) for v in _VERDICTS])} AS status, {_cases([_literal(v[2]) for v in _VERDICTS])} AS message, CAST({_cases([str(v[3]) for v in _VERDICTS])} AS INT) AS issues FROM events")
def verdict_status(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("event_id", "status", "message", F.size("issues").alias("issues"))


@query(f"SELECT event_id, trim(regexp_replace(regexp_replace(t, '```json\\s*', '', 'gi'), '```\\s*', '', 'g'), E' \\n\\t') AS text FROM (SELECT event_id, {_cases([_literal(v[0]) for v in _VERDICTS])} AS t FROM events)")
def strip_fences(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*(F.lit(v[0]) for v in _VERDICTS)), (F.col("event_id") % len(_VERDICTS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", verdict.strip_fences(text).alias("text"))


# Results with issues, from events: errors fail with two issues, purchases fail without any, views are errors, the rest pass.
_STATUS = "CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'purchase' THEN 'FAIL' WHEN 'view' THEN 'ERROR' ELSE 'PASS' END"
_SEVERITY = "CASE event_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END"


def _results(spark: SparkSession, d: str) -> DataFrame:
    issue = F.struct(F.expr("CAST(event_id % 100 + 1 AS DOUBLE)").alias("line"), F.expr(_SEVERITY).alias("severity"), F.expr("concat('issue ', event_id)").alias("message"), F.lit(None).cast("string").alias("suggestion"))
    info = F.struct(F.lit(1.0).alias("line"), F.lit("INFO").alias("severity"), F.lit("note").alias("message"), F.lit("do").alias("suggestion"))
    none = F.array().cast("array<struct<line:double,severity:string,message:string,suggestion:string>>")
    return table(spark, d, "events").select(F.expr("concat('f', event_id)").alias("path"), F.expr(_STATUS).alias("status"), F.when(F.col("event_type") == "error", F.array(issue, info)).otherwise(none).alias("issues"))


_COUNTS = {s: f"count(*) FILTER (event_type = 'error' AND {_SEVERITY} = '{s}')" for s in K.SEVERITIES}
_COUNTS["INFO"] += " + count(*) FILTER (event_type = 'error')"
_SUMMARY = f"count(*) AS audited, count(*) FILTER ({_STATUS} = 'PASS') AS passed, count(*) FILTER ({_STATUS} <> 'PASS') AS failed, " + ", ".join(f"{c} AS {s.lower()}" for s, c in _COUNTS.items())


@query("SELECT " + ", ".join(f"{c} AS {s.lower()}" for s, c in _COUNTS.items()) + " FROM events")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.severity_counts(_results(spark, d))


@query(f"SELECT 'all' AS part, {_SUMMARY}, 'ERROR' AS status, 2 AS exit_code FROM events UNION ALL SELECT 'passed', {_SUMMARY}, 'PASS', 0 FROM events WHERE {_STATUS} = 'PASS' UNION ALL SELECT 'failed', {_SUMMARY}, 'FAIL', 1 FROM events WHERE {_STATUS} = 'FAIL' UNION ALL SELECT 'none', {_SUMMARY}, 'PASS', 0 FROM events WHERE false")
def report_status(spark: SparkSession, d: str) -> DataFrame:
    results = _results(spark, d)
    parts = {"all": results, "passed": results.filter("status = 'PASS'"), "failed": results.filter("status = 'FAIL'"), "none": results.filter("false")}
    out = None
    for name, part in parts.items():
        row = report.summary(part).withColumn("part", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


_REPORT_SQL = f"SELECT *, audited + skipped AS total_files, CAST(0 AS DOUBLE) AS duration_ms FROM (SELECT {_SUMMARY}, 'ERROR' AS status, 2 AS exit_code FROM events), (SELECT CAST(sum(user_id) AS BIGINT) AS changed_lines FROM events), (SELECT count(reason) AS skipped FROM (SELECT {_REASON} AS reason FROM ({_PATHS_SQL})))"


@query(_REPORT_SQL)
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    inputs = table(spark, d, "events").select(F.col("user_id").alias("changed_lines"))
    return report.report_row(_results(spark, d), inputs, classify_paths(spark, d).filter("reason IS NOT NULL"))


_JSON = [("schemaVersion", "'\"1.0\"'"), *((n, n) for n in ("audited", "passed", "failed", "critical", "warning", "info")), ("status", "'\"' || status || '\"'"), *((n, n) for n in ("exit_code", "changed_lines", "skipped", "total_files")), ("duration_ms", "'0.0'")]


@query("SELECT concat('{', chr(10), {}, chr(10), '}') AS json FROM (%s)".replace("{}", ", ',', chr(10), ".join(f"""'  "{n}" : ', {v}""" for n, v in _JSON)) % _REPORT_SQL)
def json_report(spark: SparkSession, d: str) -> DataFrame:
    return report.json_report(report_summary(spark, d))


@query(f"SELECT *, critical_files = 0 AND system_errors = 0 AS passed FROM (SELECT count(*) FILTER ({_STATUS} = 'PASS') AS pass, count(*) FILTER ({_STATUS} = 'FAIL') AS fail, count(*) FILTER ({_STATUS} = 'ERROR') AS error, count(*) FILTER (event_type = 'error' AND {_SEVERITY} = 'CRITICAL') AS critical_files, count(*) FILTER (event_type IN ('purchase', 'view')) AS system_errors FROM events)")
def legacy_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.legacy_summary(_results(spark, d))


@query(f"SELECT 'f' || event_id AS path, CAST(0 AS BIGINT) AS position, CAST(event_id % 100 + 1 AS DOUBLE) AS line, {_SEVERITY} AS severity, 'issue ' || event_id AS message, CAST(NULL AS VARCHAR) AS suggestion FROM events WHERE event_type = 'error' UNION ALL SELECT 'f' || event_id, 1, 1.0, 'INFO', 'note', 'do' FROM events WHERE event_type = 'error'")
def issue_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.issue_rows(_results(spark, d))


@query(f"SELECT 1 AS stage, path, reason FROM (SELECT path, {_REASON} AS reason FROM ({_PATHS_SQL})) WHERE reason IS NOT NULL UNION ALL SELECT 2, path, 'Skipped by maxFiles guardrail (15)' FROM (SELECT path, row_number() OVER (PARTITION BY source ORDER BY path) AS i FROM ({_CORPUS})) WHERE i > 15")
def union_skips(spark: SparkSession, d: str) -> DataFrame:
    return report.union_skips(classify_paths(spark, d).filter("reason IS NOT NULL"), max_files_cap(spark, d).filter("reason IS NOT NULL"))


def _key_fields(prompt: str = "p1") -> list[Column]:
    return [F.lit("1"), F.lit("openai"), F.lit("m"), F.lit(prompt), F.lit(None), F.col("path"), F.lit("system"), F.col("content")]


@query(f"SELECT doc_id, sha256('1::openai::m::p1::::' || path || '::system::' || content) AS key FROM ({_CORPUS})")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return corpus(table(spark, d, "documents")).select("doc_id", cache.cache_key(_key_fields()).alias("key"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 4 THEN 'hit' ELSE 'miss' END AS cache, CASE WHEN doc_id % 6 = 0 THEN 'PASS' WHEN doc_id % 6 = 2 THEN 'ERROR' END AS status FROM documents")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    wanted = cache_key(spark, d)
    stored = wanted.filter("doc_id % 2 = 0").select("key", F.expr("""CASE doc_id % 6 WHEN 0 THEN '{"status":"PASS"}' WHEN 2 THEN '{"status":"?"}' ELSE 'torn' END""").alias("json")).dropDuplicates(["key"])
    hits, misses = cache.look_up(wanted, stored)
    return hits.select("doc_id", F.lit("hit").alias("cache"), "verdict.status").unionByName(misses.select("doc_id", F.lit("miss").alias("cache"), F.lit(None).cast("string").alias("status")))


_FAILED = "CASE doc_id % 5 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN '503 busy' WHEN 2 THEN 'read ECONNRESET' WHEN 3 THEN 'bad key' END"


@query(f"SELECT doc_id, CASE WHEN e IS NULL THEN 'first' WHEN e = 'bad key' THEN 'ERROR' WHEN doc_id % 3 = 0 THEN 'second' WHEN doc_id % 3 = 1 THEN 'third' ELSE 'ERROR' END AS answer FROM (SELECT doc_id, {_FAILED} AS e FROM documents)")
def fallback_result(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.expr(_FAILED).alias("error"))
    again = F.coalesce(provider.retryable_column(F.lit(""), F.col("error")), F.lit(False))
    first = F.when(F.col("error").isNull(), "first")
    answers = [F.when(again & (F.col("doc_id") % 3 == i), name) for i, name in enumerate(("second", "third"))]
    return docs.select("doc_id", provider.first_answer(first, *answers, F.lit("ERROR")).alias("answer"))


@query("SELECT doc_id, least(500 * pow(2, doc_id % 8) + (doc_id % 10) / 10 * 100, 10000) AS delay FROM documents")
def retry_delay(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", provider.retry_delay(F.col("doc_id") % 8 + 1, F.col("doc_id") % 10 / 10).alias("delay"))


@query("SELECT doc_id, doc_id // 5 AS batch FROM documents")
def file_batches(spark: SparkSession, d: str) -> DataFrame:
    return provider.batches(table(spark, d, "documents").select("doc_id"), 5, "doc_id")


_TOP_SQL = "SELECT *, row_number() OVER (ORDER BY relevance DESC, position) AS rank FROM (SELECT p_partkey AS position, p_name AS skill, p_brand AS category, CAST(p_size AS DOUBLE) AS relevance, left(trim(CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE repeat(p_name || ' ', 30) END), 280) AS prompt FROM part ORDER BY relevance DESC, position LIMIT 8)"


def _skills(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.expr("CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE repeat(concat(p_name, ' '), 30) END")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("position"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), prompt.alias("description"), F.col("p_size").cast("double").alias("relevance"))
    return enrich.top_skills(enrich.usable_skills(part))


@query(f"SELECT position, skill, category, relevance, prompt, CAST(rank AS INT) AS rank FROM ({_TOP_SQL})")
def skills_topk(spark: SparkSession, d: str) -> DataFrame:
    return _skills(spark, d)


@query(f"SELECT category, CAST(min(rank) AS INT) AS first, '### ' || category || coalesce(string_agg(CASE WHEN prompt <> '' THEN E'\\n- ' || prompt END, '' ORDER BY rank), '') AS text FROM ({_TOP_SQL}) GROUP BY category")
def skills_section(spark: SparkSession, d: str) -> DataFrame:
    return enrich.skills_section(_skills(spark, d))


_STACKS = (("TypeScript 5.7, Node.js 18 (ESM), tsup (esbuild)", "typescript,node.js,esm,tsup,esbuild"), ("Go 1.21, Gin, GORM, Redis", "gin,gorm,redis"), ("Java 17, Spring Boot, Hibernate, MySQL", "java,spring,boot,hibernate,mysql"), ("", ""), ("C++20, Qt6 ; Rust", "c++,qt,rust"))


@query("SELECT r_regionkey, CASE r_regionkey {} END AS tokens FROM region".format(" ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(_STACKS))))
def tech_tokens(spark: SparkSession, d: str) -> DataFrame:
    stack = F.element_at(F.array(*(F.lit(s) for s, _ in _STACKS)), F.col("r_regionkey") + 1)
    return table(spark, d, "region").select("r_regionkey", F.array_join(enrich.tech_tokens(stack), ",").alias("tokens"))


def _bytes_sql(x: str) -> str:
    out = "'0 B'"
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        out = f"CASE WHEN {x} >= {1024**i} THEN regexp_replace(regexp_replace(printf('%.2f', floor({x} / {float(1024**i)} * 100 + 0.5) / 100), '0+$', ''), '\\.$', '') || ' {unit}' ELSE {out} END"
    return out


@query(f"SELECT doc_id, {_bytes_sql('n_chars * (doc_id % 11) * (doc_id % 11) * 1000')} AS size FROM documents")
def format_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", format_bytes(F.col("n_chars") * (F.col("doc_id") % 11) * (F.col("doc_id") % 11) * 1000).alias("size"))


@query("SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ((n >> 52) // 10) || '.' || ((n >> 52) % 10) || 's' ELSE (ms // 60000) || 'm' || CASE WHEN (ms % 60000 + 500) // 1000 > 0 THEN ' ' || ((ms % 60000 + 500) // 1000) || 's' ELSE '' END END AS duration FROM (SELECT event_id, event_id * 37 AS ms, CASE WHEN event_id * 37 < 60000 THEN CAST(CAST(event_id * 37 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(4503599627370496 AS DOUBLE) AS BIGINT) * 10 + 2251799813685248 END AS n FROM events)")
def format_durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", format_duration(F.col("event_id") * 37).alias("duration"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'File not found' WHEN strlen(text) * 100 > 512000 THEN 'File too large (' || {_bytes_sql('strlen(text) * 100')} || ')' END AS skip_reason, CASE WHEN doc_id % 13 <> 0 AND strlen(text) * 100 <= 512000 THEN md5(text) END AS content_md5 FROM documents")
def size_capped_read(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("size", F.when(F.col("doc_id") % 13 != 0, F.octet_length("text") * 100))
    return size_capped(docs, F.col("text")).select("doc_id", "skip_reason", F.md5("content").alias("content_md5"))


@query("SELECT event_id, epoch_ms(TIMESTAMP '2024-01-01 12:00:00') - epoch_ms(ts) < 3600000 AS fresh FROM events")
def fresh_skills(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(1_704_110_400_000)
    return table(spark, d, "events").select("event_id", enrich.fresh(F.unix_millis(F.col("ts").cast("timestamp")), now).alias("fresh"))


@query("SELECT doc_id, CAST(length(text) + (doc_id % 3) * 2 AS BIGINT) AS units FROM documents")
def utf16_units(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.repeat(F.lit("\U0001f600"), (F.col("doc_id") % 3).cast("int")))
    return table(spark, d, "documents").select("doc_id", ecmascript.utf16_length(text).alias("units"))


@query(f"SELECT source, count(*) AS files, CAST(sum(n) AS BIGINT) AS redactions, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS tokens FROM (SELECT r.*, source FROM ({_REDACTED_SQL}) r JOIN documents USING (doc_id)) GROUP BY source")
def audit_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: accepted files, redacted, with token totals by source."""
    files = classify.classify(_planted(spark, d)).filter("reason IS NULL")
    done = redact.redact(files)
    return done.groupBy("source").agg(F.count("*").alias("files"), F.sum("redacted_count").alias("redactions"), F.sum(tokens.estimate(F.col("content"))).alias("tokens"))


# Lines of reports, over the same results and skips as the summary.
_BAD_SQL = f"SELECT 'f' || event_id AS path, {_STATUS} AS status, event_type, event_id FROM events WHERE {_STATUS} <> 'PASS'"
_SKIPS_SQL = f"SELECT path, reason FROM (SELECT path, {_REASON} AS reason FROM ({_PATHS_SQL})) WHERE reason IS NOT NULL"


def _report_sql(head: list[str], note: str, entry: str, title: str | None, name: str, issue: tuple[str, str], without: str) -> str:
    """Part, key, position and line of a report: header values come from the summary's SQL, findings from the events'."""
    line = lambda part, key, position, text, source: f"SELECT {part} AS part, {key} AS key, CAST({position} AS BIGINT) AS position, {text} AS line FROM ({source})"
    parts = [line(1, "''", i, h, _REPORT_SQL) for i, h in enumerate(head)]
    parts += [line(2, "''", 0, note, f"SELECT count(*) AS n FROM ({_SKIPS_SQL}) HAVING count(*) > 0"), line(3, "path", 0, entry, _SKIPS_SQL)]
    if title:
        parts.append(line(4, "''", 0, f"'{title}'", f"SELECT count(*) AS n FROM ({_BAD_SQL}) HAVING count(*) > 0"))
    bugs = f"SELECT * FROM ({_BAD_SQL}) WHERE event_type = 'error'"
    parts += [line(5, "path", -1, name, _BAD_SQL), line(5, "path", 0, issue[0], bugs), line(5, "path", 1, f"'{issue[1]}'", bugs), line(5, "path", 0, f"'{without}'", f"SELECT * FROM ({_BAD_SQL}) WHERE event_type <> 'error'")]
    return " UNION ALL ".join(parts)


def _skips(spark: SparkSession, d: str) -> DataFrame:
    return classify_paths(spark, d).filter("reason IS NOT NULL").select("path", "reason")


_METRICS = ("total_files", "audited", "passed", "failed", "critical", "warning", "info")


@query(_report_sql(["'# Review Report'", "'- Status: **' || status || '**'", "'- Target: `range:a..b`'", "'- AI Enabled: `true`'", "'- Generated At: `2026`'", "'## Summary'", "'| Metric | Value |'", "'| --- | --- |'", *(f"'| {t} | ' || {v} || ' |'" for t, v in zip(("Total files", "Audited files", "Passed files", "Failed files", "Critical issues", "Warning issues", "Info issues"), _METRICS, strict=True)), "'| Duration (ms) | 0 |'", "'| Diff lines | ' || changed_lines || ' |'"],
    "'## Skipped Files'", "'- `' || path || '`: ' || reason", "## Findings", "'### `' || path || '`'", (f"'- **' || {_SEVERITY} || '** (line ' || (event_id % 100 + 1) || '): issue ' || event_id", "- **INFO** (line 1): note — _do_"), "- **ERROR**: Unknown runtime error"))
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return report.markdown_lines(report_summary(spark, d), _skips(spark, d), _results(spark, d), mode="range", value="a..b", ai=True, at="2026")


@query(_report_sql(["'📊 Review Summary'", "'   Status:         💥 ' || status", "'   Target:         files'", "'   AI Enabled:     no'", *(f"'   {t}' || {v}" for t, v in zip(("Total files:    ", "Audited files:  ", "✅ Passed:       ", "❌ Failed:       ", "🚨 Critical:     ", "⚠️  Warning:      ", "ℹ️  Info:         "), _METRICS, strict=True)), "'   ⏱️  Duration:     0ms'", "'   🔢 Diff lines:   ' || changed_lines"],
    "'Skipped ' || n || ' file(s):'", "path || ': ' || reason", None, "CASE status WHEN 'ERROR' THEN '💥 ' ELSE '❌ ' END || path", (f"'[' || {_SEVERITY} || '] line ' || (event_id % 100 + 1) || ': issue ' || event_id", "[INFO] line 1: note\n💡 do"), "Unknown runtime error"))
def console_report(spark: SparkSession, d: str) -> DataFrame:
    return report.console_lines(report_summary(spark, d), _skips(spark, d), _results(spark, d))


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 2 ELSE CASE {_STATUS} WHEN 'PASS' THEN 0 WHEN 'FAIL' THEN 1 ELSE 2 END END AS code FROM events")
def run_codes(spark: SparkSession, d: str) -> DataFrame:
    code = report.run_code(F.col("event_id") % 5 == 0, F.col("event_id") % 4, F.expr(_STATUS))
    return table(spark, d, "events").select("event_id", code.alias("code"))


@query(f"SELECT 'f' || event_id AS path, {_STATUS} AS status, event_type = 'error' AS comment FROM events WHERE {_STATUS} <> 'PASS'")
def failed_results(spark: SparkSession, d: str) -> DataFrame:
    rows = report.failed(_results(spark, d))
    posted = report.commentable(rows).select("path", F.lit(True).alias("posted"))
    return rows.join(posted, "path", "left").select("path", "status", F.coalesce("posted", F.lit(False)).alias("comment"))


_RELATIVE = ("src/a.ts", "./src//b.ts", "/home/u/repo/c.py", "/home/u/d.py", "../e.py", "x/../../u2/f.py", "", "/home/u/repo")
_RELATIVE_SQL = ("src/a.ts", "src/b.ts", "c.py", "../d.py", "../e.py", "../u2/f.py", "", "")


@query("SELECT event_id, CASE event_id % {} {} END AS path FROM events".format(len(_RELATIVE), " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_RELATIVE_SQL))))
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.element_at(F.array(*(F.lit(p) for p in _RELATIVE)), (F.col("event_id") % len(_RELATIVE) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", classify.relative(path, "/home/u/repo").alias("path"))


@query(f"SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0 AND event_id % 10 <> 4 ORDER BY ts DESC, event_id")
def branch_commits(spark: SparkSession, d: str) -> DataFrame:
    refs = "array_compact(array(CASE WHEN event_id % 3 <> 0 THEN 'HEAD' END, CASE WHEN event_id % 2 = 1 THEN 'origin/main' END))"
    log = _commits(spark, d).withColumn("branches", F.expr(refs)).withColumn("parents", F.expr("CASE WHEN event_id % 10 = 4 THEN array('a', 'b') ELSE array('a') END"))
    return commits.review_commits(log, 5, compare="origin/main", date="ts", tie="event_id").select("event_id")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 3 THEN 'R' ELSE 'C' END AS status, 'src/f' || event_id || '.py' AS path FROM events WHERE event_id % 6 IN (0, 1, 3, 4) AND event_id % 5 <> 0")
def changed_paths(spark: SparkSession, d: str) -> DataFrame:
    name = "concat('src/f', event_id, CASE WHEN event_id % 5 = 0 THEN '.md' ELSE '.py' END)"
    line = f"CASE event_id % 6 WHEN 0 THEN concat('A\t', {name}) WHEN 1 THEN concat('M\t', {name}, ' ') WHEN 2 THEN concat('D\t', {name}) WHEN 3 THEN concat('R100\told.py\t', {name}) WHEN 4 THEN concat('C75\told.py\t', {name}) ELSE '' END"
    rows = commits.changed_paths(table(spark, d, "events").select(F.expr(line).alias("line")), sources=True)
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("event_id"), "status", "path")


@query(f"SELECT event_id, len(t) > 0 AS matched, coalesce(t[1], '') AS type FROM (SELECT event_id, list_filter(['feat', 'fix'], lambda t: starts_with(lower(message), t)) AS t FROM ({_COMMITS_SQL}))")
def match_named_groups(spark: SparkSession, d: str) -> DataFrame:
    m = commits.match_patterns(F.col("message"), (("feat", "^(?<type>feat)", False), ("fix", "^(?<type>fix)\\(?", False), ("python", "(?P<x>view)", False)))
    return _commits(spark, d).select("event_id", m.alias("m")).select("event_id", "m.matched", F.coalesce("m.type", F.lit("")).alias("type"))


@query("SELECT 's' || (event_id % 40) AS path, CASE WHEN max(event_id) % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM events GROUP BY event_id % 40")
def last_report_wins(spark: SparkSession, d: str) -> DataFrame:
    """Repeated paths: the last report of each counts, though earlier ones found more."""
    reports = table(spark, d, "events").select(F.expr("concat('s', event_id % 40)").alias("path"), (F.col("event_id") % 3).alias("redacted_count"), F.array(F.lit("p")).alias("matched_patterns"), "event_id")
    return redact.security_results(reports.select("path").distinct(), reports, order="event_id").select("path", "status")


@query("SELECT event_id, 'Commit Message: \"' || message || '\"' AS prompt FROM (" + _COMMITS_SQL + ")")
def commit_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _commits(spark, d).select("event_id", provider.commit_message_prompt(F.col("message")).alias("prompt"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """A counter of one's own in place of the estimate: here words between blanks."""
    return table(spark, d, "documents").select("doc_id", tokens.estimate(F.col("text"), lambda texts: [len(t.split()) for t in texts]).alias("tokens"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5('+x' || doc_id) ELSE md5(patch) END AS patch_md5 FROM (" + _DIFF_SQL + ")")
def patch_or_synthetic(spark: SparkSession, d: str) -> DataFrame:
    patch = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('+x', doc_id) WHEN doc_id % 3 = 0 THEN ' \n' END")
    return corpus(table(spark, d, "documents")).select("doc_id", F.md5(diff.patch_or_synthetic(patch, F.col("path"), F.col("content"))).alias("patch_md5"))


# A commit graph over documents, by shares of the highest id: a trunk up to a half, two sides of alternating ids up to three quarters, two merges
# of both sides (so there are two merge bases), and two sides again, whose ends are origin/main and HEAD.
_TRUNK, _SIDES = "(m // 2)", "(m * 3 // 4)"
_GRAPH_SQL = f"""SELECT doc_id, n_chars, CASE WHEN doc_id = 0 THEN CAST([] AS BIGINT[]) WHEN doc_id <= {_TRUNK} THEN [doc_id - 1] WHEN doc_id <= {_TRUNK} + 2 THEN [{_TRUNK}] WHEN doc_id <= {_SIDES} THEN [doc_id - 2]
  WHEN doc_id <= {_SIDES} + 2 THEN [{_SIDES} - 1, {_SIDES}] ELSE [doc_id - 2] END AS parents FROM documents, (SELECT max(doc_id) AS m FROM documents)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    m = docs.agg(F.max("doc_id")).first()[0] or 0
    trunk, sides, i = m // 2, m * 3 // 4, F.col("doc_id")
    parents = F.when(i == 0, F.array().cast("array<bigint>")).when(i <= trunk, F.array(i - 1)).when(i <= trunk + 2, F.array(F.lit(trunk).cast("long"))).when(i <= sides, F.array(i - 2))
    parents = parents.when(i <= sides + 2, F.array(F.lit(sides - 1).cast("long"), F.lit(sides).cast("long"))).otherwise(F.array(i - 2))
    log = docs.select(i.cast("string").alias("hash"), parents.cast("array<string>").alias("parents"), F.col("n_chars").alias("date"))
    return log, spark.createDataFrame([("HEAD", str(m)), ("origin/main", str(m - 1)), ("old", str(m // 4))], "ref string, hash string")


_REACH_SQL = f"""g AS MATERIALIZED ({_GRAPH_SQL}), e AS MATERIALIZED (SELECT * FROM (SELECT doc_id AS child, unnest(parents) AS parent FROM g) WHERE parent IN (SELECT doc_id FROM g)),
  r AS (SELECT DISTINCT name, h FROM (SELECT 'HEAD' AS name, max(doc_id) AS h FROM g UNION ALL SELECT 'main', max(doc_id) - 1 FROM g UNION ALL SELECT 'old', max(doc_id) // 4 FROM g) WHERE h IN (SELECT doc_id FROM g) UNION SELECT r.name, e.parent FROM r JOIN e ON e.child = r.h)"""


@query(f"WITH RECURSIVE {_REACH_SQL} SELECT h AS doc_id, array_to_string(list(name ORDER BY name), ',') AS branches FROM r GROUP BY h")
def commit_branches(spark: SparkSession, d: str) -> DataFrame:
    log, refs = _graph(spark, d)
    found = graph.reaches(log, refs.withColumn("ref", F.regexp_replace("ref", "origin/", "")))
    return found.filter(F.size("branches") > 0).select(F.col("hash").cast("long").alias("doc_id"), F.array_join("branches", ",").alias("branches"))


@query(f"""WITH RECURSIVE {_REACH_SQL}, common AS (SELECT h FROM r WHERE name IN ('HEAD', 'main') GROUP BY h HAVING count(*) = 2),
  base AS (SELECT doc_id FROM g WHERE doc_id IN (FROM common) AND doc_id NOT IN (SELECT parent FROM e WHERE child IN (FROM common)) ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR) LIMIT 1),
  hidden AS (SELECT doc_id AS h FROM base UNION SELECT e.parent FROM hidden JOIN e ON e.child = hidden.h)
  SELECT doc_id FROM g WHERE len(parents) < 2 AND doc_id IN (SELECT h FROM r WHERE name = 'HEAD') AND doc_id NOT IN (FROM hidden)""")
def merge_base_commits(spark: SparkSession, d: str) -> DataFrame:
    """The branch's commits from the graph alone, with two merge bases and chains of thousands of commits."""
    log, refs = _graph(spark, d)
    return graph.branch_commits(log, refs, compare="origin/main").select(F.col("hash").cast("long").alias("doc_id"))


_EDITED = "concat(CASE WHEN doc_id % 3 = 0 THEN concat('opening\n', text) ELSE text END, CASE WHEN doc_id % 5 = 0 THEN '\nclosing' WHEN doc_id % 5 = 1 THEN '\n' ELSE '' END)"
_EDITED = f"CASE WHEN doc_id % 7 = 0 THEN text ELSE replace(replace({_EDITED}, 'tor', 'TOR'), '. ', CASE WHEN doc_id % 2 = 0 THEN '.\n' ELSE '. ' END) END"


@query(f"SELECT doc_id, md5({_EDITED}) AS text_md5, text <> {_EDITED} AS changed FROM documents")
def patch_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Patches of edited documents, applied to what they were made from."""
    versions = table(spark, d, "documents").withColumn("after", F.expr(_EDITED.replace("\n", "\\n")))
    made = versions.select("doc_id", "text", patch.patch_column(F.concat(F.lit("src/"), F.col("doc_id").cast("string")), F.col("text"), F.col("after")).alias("patch"))
    return made.select("doc_id", F.md5(patch.patched_column(F.col("text"), F.col("patch"))).alias("text_md5"), (F.col("patch") != "").alias("changed"))


@query()
def exact_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of byte-pair tokens of all documents, by a public rank file."""
    import public_tokenizers

    count = tokens.RankCounter(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return table(spark, d, "documents").select("doc_id", tokens.estimate(F.col("text"), count).alias("tokens"))


@query("SELECT p_partkey, k AS key, regexp_replace(k, '[^a-z0-9]', '_', 'gi') AS file FROM (SELECT p_partkey, array_to_string(list_sort(string_split(p_type || ' ' || p_brand, ' ')), ',') AS k FROM part)")
def skills_keys(spark: SparkSession, d: str) -> DataFrame:
    key = enrich.skills_key(F.split(F.concat_ws(" ", "p_type", "p_brand"), " "))
    return table(spark, d, "part").select("p_partkey", key.alias("key"), enrich.skills_file(key).alias("file"))


@query(f"SELECT left(hash, 7) AS hash, message FROM (SELECT md5(CAST(event_id AS VARCHAR)) AS hash, {_MESSAGE} AS message, ts FROM events) ORDER BY ts DESC, hash LIMIT 3")
def commit_examples(spark: SparkSession, d: str) -> DataFrame:
    return commits.examples(_commits(spark, d).withColumn("hash", F.md5(F.col("event_id").cast("string"))), date="ts")


_TICKETS = f"SELECT doc_id, source, path, content || ' (Ticket-' || doc_id || ')' AS content FROM ({_CORPUS})"


@query(f"SELECT doc_id, n + len(regexp_extract_all(content, 'ticket-[0-9]+', 0, 'i')) AS redacted_count, md5(regexp_replace(content, 'ticket-[0-9]+', '{K.MARKER}', 'gi')) AS text_md5, array_to_string(list_append(names, 'Ticket'), '|') AS matched FROM ({_redacted_sql(_TICKETS)})")
def redact_extra(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of one's own after the built-in ones."""
    rows = corpus(table(spark, d, "documents")).withColumn("content", F.concat("content", F.lit(" (Ticket-"), F.col("doc_id").cast("string"), F.lit(")")))
    return redact.redact(rows, extra=[("Ticket", r"ticket-\d+", True)]).select("doc_id", "redacted_count", F.md5("content").alias("text_md5"), F.array_join("matched_patterns", "|").alias("matched"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 5 = 0 THEN 'second' ELSE 'first' END AS message FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 <> 0")
def cache_store(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts stored twice: errors aren't, and the later ones count."""
    path, docs = scratch(spark, "cache"), table(spark, d, "documents")
    verdicts = lambda said, status: F.struct(status.alias("status"), F.lit(said).alias("message")).alias("verdict")
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), verdicts("first", F.when(F.col("doc_id") % 3 == 0, "ERROR").otherwise("PASS")))
    cache.write(docs.filter("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("key"), verdicts("second", F.lit("FAIL"))), path, now_ms=2000)
    cache.write(rows, path, now_ms=1000)
    return cache.read(spark, path).select("key", F.get_json_object("json", "$.message").alias("message"))


@query("SELECT p_partkey, p_name AS skill FROM part WHERE p_size >= 40")
def stored_skills(spark: SparkSession, d: str) -> DataFrame:
    """Skills stored for a stack twice, and for another one: the last read of the first counts."""
    path, parts = scratch(spark, "skills"), table(spark, d, "part").select("p_partkey", F.col("p_name").alias("skill"), "p_size")
    for key, condition, now in (("go", "p_size >= 40", 2000), ("go", "p_size < 10", 1000), ("rust", "p_size = 20", 2500)):
        enrich.store_skills(parts.filter(condition).drop("p_size"), path, key, now)
    return enrich.stored_skills(spark, path, "go", 3000)


@query(f"SELECT path FROM (SELECT DISTINCT path, {_REASON} AS reason FROM ({_PATHS_SQL})) WHERE reason IS NULL")
def accepted_paths(spark: SparkSession, d: str) -> DataFrame:
    return classify.accepted(classify.classify(_paths(spark, d).select("path").distinct()))


@query(f"SELECT path, reason FROM (SELECT DISTINCT path, {_REASON} AS reason FROM ({_PATHS_SQL})) WHERE reason IS NOT NULL")
def rejected_paths(spark: SparkSession, d: str) -> DataFrame:
    return classify.rejected(classify.classify(_paths(spark, d).select("path").distinct()))


_CHAIN = "concat(source, ', Gemini ,', CASE doc_id % 4 WHEN 0 THEN 'OPENAI' WHEN 1 THEN ' anthropic,gemini' WHEN 2 THEN 'open ai' ELSE '' END)"


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_CHAIN}, ','), lambda x: lower(trim(x))), lambda x: x IN ('gemini', 'openai', 'anthropic')), '|') AS chain FROM documents")
def provider_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(provider.fallbacks_column(F.expr(_CHAIN)), "|").alias("chain"))
