"""Registered queries over the event log, experiments and texts, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import events as ev
from weftline.operators import experiments as ex
from weftline.operators import kept_state, policies, reports
from weftline.session import shared_dir
from weftline.sources import lens, logs, repository, source_lens

RESAMPLES, SEED, COST_CAP, IDLE_DAYS = 10_000, 7, 50_000, 7


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.session_rollup(lens.tool_events(spark, sf_dir))


def tool_call_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.merge_tool_calls(lens.tool_events(spark, sf_dir))


def hook_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.hook_percentiles(lens.tool_events(spark, sf_dir))


def diff_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.diffs_by_path(lens.tool_events(spark, sf_dir))


def edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pair_edits(lens.tool_events(spark, sf_dir))


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lens.tool_events(spark, sf_dir).withColumn("session", F.floor(F.col("seq") / 20))
    return ev.prune(e, f"{IDLE_DAYS} days").select("seq", "session")


def tool_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by session and tool, in rows."""
    return ev.tool_tally(lens.tool_events(spark, sf_dir)).select("session", F.explode("by_tool").alias("tool", "n"))


def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.session_report(lens.tool_events(spark, sf_dir))


def task_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.task_effects(lens.runs(spark, sf_dir))


def log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.log_ratio(lens.runs(spark, sf_dir))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.bootstrap(lens.runs(spark, sf_dir), RESAMPLES, 0.95, SEED)


def cost_cap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lens.runs(spark, sf_dir)
    return ex.within_budget(r.select("task", F.col("run").alias("block"), F.col("metric").alias("cost")), COST_CAP)


def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lens.runs(spark, sf_dir)
    return ex.remaining(r.select("task", "trial", "condition"), r)


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's ordered parts as an answer to the parts of the same customer's large orders."""
    rows = lens.table(spark, sf_dir, "lineitem").join(lens.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("key"), F.col("l_partkey").alias("item"), "o_totalprice", "l_quantity")
    return ex.precision_recall(rows.where("l_quantity >= 25").select("key", "item"), rows.where("o_totalprice >= 100000").select("key", "item"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of all redacted documents, and whether redaction changed them."""
    docs = lens.table(spark, sf_dir, "documents").select("doc_id", "text", tx.redact(F.col("text")).alias("clean"))
    return docs.select("doc_id", tx.text_hash(F.col("clean")).alias("hash"), (F.col("clean") != F.col("text")).alias("changed"))


def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lens.table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.sanitize(F.col("text"), 200).alias("text"))


def prompt_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = lens.table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", tx.text_hash(F.col("text")).alias("text_hash"), tx.preview(F.col("text")).alias("preview"))


def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one with the next id."""
    docs = lens.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return tx.line_diff(docs, docs.withColumn("key", F.col("key") - 1))


def context_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order as a list that fits 40 characters."""
    rows = lens.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return rows.select("l_orderkey", tx.fit_list(F.transform("parts", lambda p: p.cast("string")), 40).alias("parts"))


def _link_class(target: str = "specifier"):
    return F.when(F.col(target).rlike("^[a-z]+:"), "absolute").when(F.startswith(F.col(target), F.lit("/")), "rooted").when(F.startswith(F.col(target), F.lit("#")), "fragment").otherwise("relative")


def link_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per specifier and its class."""
    found = lens.links(spark, sf_dir).withColumn("kind", _link_class())
    return found.groupBy("kind", "specifier").agg(F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


def externals_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lens.links(spark, sf_dir).withColumn("kind", _link_class())
    return found.groupBy("kind").agg(F.count_distinct("specifier").alias("n_specifiers"), F.count("*").alias("n_links"))


def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.session_states(lens.session_events(spark, sf_dir))


def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest_session(ev.session_states(lens.session_events(spark, sf_dir))).select("session", "last_event_at", "n_turns")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.tool_calls(lens.session_events(spark, sf_dir))


def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.outcome_tally(ev.tool_calls(lens.session_events(spark, sf_dir)))


def edits_that_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits of the tool log that no call of the session log of the same key failed."""
    calls = ev.tool_calls(lens.session_events(spark, sf_dir))
    return ev.edits_that_count(ev.pair_edits(lens.tool_events(spark, sf_dir)).withColumn("tool_use", F.col("tool_use") % 4), calls).groupBy("session").agg(F.count("*").alias("n_edits"))


def hook_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.hook_stats(lens.hook_calls(spark, sf_dir))


def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return lens.paths(spark, sf_dir).select("path", repository.is_ignored(path).alias("ignored"), repository.is_test(path).alias("is_test"), repository.language(path).alias("lang"))


def condition_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.condition_means(lens.runs(spark, sf_dir))


def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.paired(lens.runs(spark, sf_dir))


def tool_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a tool's input: odd turns a command, even ones a pattern within the conversation's folder."""
    turns = lens.table(spark, sf_dir, "conversations")
    odd, folder = F.col("turn") % 2 == 1, F.concat(F.lit("/repo/c"), F.col("conv_id").cast("string"))
    inside = F.array(tx.repo_relative(folder, F.lit("/repo")))
    given = tx.tool_summary(F.when(odd, F.col("text")), F.when(~odd, F.col("text")), F.lit(None).cast("string"), inside, F.array(F.lit("text")))
    return turns.select("conv_id", "turn", tx.text_hash(given).alias("hash"), F.length(given).alias("n_chars"))


def _kept(spark: SparkSession, sf_dir: str, fold: kept_state.Fold) -> DataFrame:
    """The session log folded into a kept state by days of the week, one of them given twice."""
    events = lens.session_events(spark, sf_dir)
    state = kept_state.KeptState(spark, fold, f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}")
    for day in (4, 1, 2, 3, 5, 6, 7, 2):
        state.add(events.where(F.dayofweek("ts") == day), day)
    return state.current()


def kept_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, kept_state.TOOL_CALLS)


def kept_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, kept_state.SESSIONS)


def session_full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of every session; tallies as lines of text."""
    edits = ev.pair_edits(lens.tool_events(spark, sf_dir)).withColumn("tool_use", F.col("tool_use") % 4)
    n = F.col("event_id")
    hooks = lens.table(spark, sf_dir, "events").where(n % 3 == 0).select(F.col("user_id").alias("session"), (F.col("value") - 3).alias("ms"), (n % 2 == 0).alias("sync"), F.when(n % 9 == 0, n % 5).alias("context_chars"))
    out = ev.full_report(lens.session_events(spark, sf_dir), edits, hooks)
    told = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",").alias(c)
    return out.select(*(told(c) if c.startswith("by_") else F.col(c) for c in out.columns))


#: What the report compares: the metric of the runs, the percent of a recall that must not fall, and turns by task.
COMPARED = (
    reports.Comparison("tokens", "primary", "log-ratio", "less", 0.95), reports.Comparison("recall", "guard", "difference", "more", 0.95, 10.0),
    reports.Comparison("turns", "secondary", "difference", "less", 0.9, per_task=True), reports.Comparison("sixth", "secondary", "difference", "more", 0.9),
)
REPORT_RESAMPLES = 1000


def joint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four measures of the runs resampled together; one is of every sixth run only."""
    n, e = F.col("event_id"), lens.table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), "event_id", "user_id")
    more = e.select("run", (F.col("user_id") % 101).alias("recall"), (n % 13).alias("turns"), F.when(n % 6 < 2, n % 17).alias("sixth"))
    runs = lens.runs(spark, sf_dir).withColumnRenamed("metric", "tokens").join(more, "run")
    return reports.joint_report(runs, list(COMPARED), REPORT_RESAMPLES, SEED)


def folder_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.folder_hash(lens.table(spark, sf_dir, "part").select(F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("content")))


#: Rules of the two policy queries: name, pattern, what it does; and name, kind, from, to, what it does.
PATH_RULES = (("tests", "**/*.test.ts", "tell_agent"), ("early", "brand1*/src/p?.ts", "ask_human"), ("all", "**", "record_only"), ("odd", "brand[!12]*/**", "tell_agent"), ("one", "brand13/**", "block"))
EDGE_RULES = (("ones-not-twos", "forbid", "brand1?/**", "brand2?/**", "block"), ("three-alone", "allow_only", "brand3/**", "brand4/src/**", "tell_agent"), ("five", "entrypoint_only", "brand5/**", "brand5/src/p*[05].ts", "ask_human"))


def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = source_lens.modules(spark, sf_dir).select(F.concat("module", F.lit(".ts")).alias("path"))
    return policies.decide(paths, spark.createDataFrame(PATH_RULES, "rule string, pattern string, on_match string"))


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_lens.modules(spark, sf_dir).select("key", F.concat("module", F.lit(".ts")).alias("path"))
    uses = source_lens.uses(spark, sf_dir, "l_partkey", 6).join(files.toDF("src", "src_path"), "src").join(files.toDF("dst", "dst_path"), "dst")
    deps = uses.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), (F.col("form") != 2).alias("exact"))
    return policies.violations(deps, files, spark.createDataFrame(EDGE_RULES, "rule string, kind string, from_pattern string, to_pattern string, on_match string"))


QUERIES = {
    f.__name__: f
    for f in (
        joint_report, folder_digest, kept_tool_calls, kept_sessions, session_full_report, policy_decisions, rule_violations, session_states, latest_session, tool_calls, outcome_tally, edits_that_count, hook_stats, path_classes, condition_means, paired_runs, tool_summaries,
        session_rollup, tool_call_merge, hook_percentiles, diff_by_path, edit_pairs, retention_prune, tool_tally, session_report,
        task_effects, log_ratio, bootstrap_ci, cost_cap_prefix, resume_remaining, precision_recall, redact_text, sanitize_text,
        prompt_preview, line_diff, context_lists, link_externals, externals_by_kind,
    )
}

EVENTS = """e AS (
  SELECT event_id AS seq, ts, (event_id // 2) % 150 AS session, event_id // 2 AS tool_use, event_type AS tool,
         CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase, CAST(round(value) AS BIGINT) AS ms, user_id % 40 AS path,
         CAST(floor(value) AS BIGINT) AS added, event_id % 7 AS removed FROM events),
  edits AS (
    SELECT b.session, b.tool_use, b.path, CASE WHEN a.ts IS NULL THEN 0 ELSE b.removed END AS removed, coalesce(greatest(b.added - a.added, 0), 0) AS added, a.ts IS NULL AS partial
    FROM (SELECT * FROM e WHERE phase = 'end') b LEFT JOIN (SELECT * FROM e WHERE phase = 'start') a
      ON a.session = b.session AND a.tool_use = b.tool_use AND a.ts <= b.ts AND a.ts >= b.ts - INTERVAL 10 MINUTE)"""
MERGED = """calls AS (
  SELECT session, tool_use, arg_min(ts, seq) AS ts, arg_min(tool, seq) AS tool, max(ts) FILTER (phase = 'end') AS ended_at,
         arg_max(ms, seq) FILTER (phase = 'end') AS duration_ms, count_if(phase = 'start') = 0 AS partial FROM e GROUP BY ALL)"""
RUNS = """r AS (
  SELECT event_id AS run, event_type AS task, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS condition, event_id // 2 AS trial,
         CASE WHEN event_id % 29 = 0 THEN 'error' ELSE 'ok' END AS status, CAST(floor(value * 100) AS BIGINT) AS metric FROM events),
  ok AS (SELECT * FROM r WHERE status = 'ok' AND metric IS NOT NULL),
  effects AS (
    SELECT task, count(*) FILTER (condition = 'baseline') AS n_baseline, count(*) FILTER (condition = 'treatment') AS n_treatment,
           avg(metric) FILTER (condition = 'baseline') AS baseline, avg(metric) FILTER (condition = 'treatment') AS treatment FROM ok GROUP BY task)"""
LINKS = """l AS (
  SELECT page_id, specifier, CASE WHEN regexp_matches(specifier, '^[a-z]+:') THEN 'absolute' WHEN starts_with(specifier, '/') THEN 'rooted'
         WHEN starts_with(specifier, '#') THEN 'fragment' ELSE 'relative' END AS kind
  FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS specifier FROM pages))"""


def redact_sql(column: str) -> str:
    """The library's own table of formats, put into the other engine's syntax: it holds the two engines against each
    other. That the table finds what it should is tested with planted secrets (``tests/test_redaction.py``)."""
    for pattern, put in tx.rules():
        literal, flags = pattern.removeprefix("(?i)").replace("'", "''"), "gi" if pattern.startswith("(?i)") else "g"
        column = f"regexp_replace({column}, '{literal}', '{put.replace('$1', chr(92) + '1').replace(chr(39), chr(39) * 2)}', '{flags}')"
    return column


def draw_sql(seed: int, *keys: str) -> str:
    value = f"CAST({seed} AS BIGINT)"
    for key in keys:
        value = f"((({value} + {key} % 2147483647) * 48271 + 11) % 2147483647 * 69621 + 7) % 2147483647"
    return value


def hash_sql(column: str) -> str:
    return f"substr(sha256({column}), 1, 20)"


def cap_sql(column: str, most: int) -> str:
    return f"CASE WHEN length({column}) > {most} THEN substr({column}, 1, {most - 1}) || '…' ELSE {column} END"


PLAIN = "regexp_replace(regexp_replace(text, '(\\x1b\\[|\\x{9b})[0-9;?]*[ -/]*[@-~]', '', 'g'), '[\\p{Cc}\\p{Cf}\\p{Zl}\\p{Zp}\\x{E0000}-\\x{E007F}]', '', 'g')"
PREVIEW = f"trim(regexp_replace({redact_sql('text')}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"

LOG = """g AS (
  SELECT event_id AS seq, ts, user_id AS session, ['session_start', 'prompt', 'tool_call_start', 'tool_call_end', 'compaction', 'turn_end', 'session_end'][event_id % 7 + 1] AS type,
         CASE WHEN event_id % 4 <> 0 THEN 'd' || event_id % 3 END AS cwd, event_type AS source, CASE WHEN event_id % 3 <> 0 THEN 'm' || event_id % 5 END AS model,
         CASE WHEN event_id % 2 = 0 THEN 'h' || event_id % 11 END AS git_head, 'r' || event_id % 4 AS reason, (event_id // 7) % 4 AS slot, event_type AS tool,
         CASE WHEN event_id % 7 = 2 THEN 'a' || event_id % 13 END AS args, CAST(round(value) AS BIGINT) AS ms FROM events),
  h AS (SELECT *, CAST(floor((seq / 7) % 4) AS BIGINT) AS tool_use, ['ok', 'failed', 'unknown', 'denied'][slot + 1] AS outcome FROM g),
  states AS (
    SELECT session, arg_min(ts, seq) AS started_at, max(ts) AS last_event_at, arg_min(cwd, seq) AS cwd, arg_min(source, seq) FILTER (type = 'session_start') AS source,
           arg_max(model, seq) FILTER (type = 'session_start') AS model, arg_max(git_head, seq) FILTER (type = 'session_start') AS git_head,
           count_if(type = 'turn_end') AS n_turns, count_if(type = 'compaction') AS n_compactions, count_if(type = 'prompt') AS n_prompts FROM h GROUP BY session),
  borders AS (SELECT session, ts, reason FROM h WHERE type IN ('session_start', 'session_end') QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) = 1 AND type = 'session_end'),
  used AS (
    SELECT session, tool_use, arg_min(ts, seq) AS ts, arg_min(tool, seq) AS tool, arg_min(args, seq) AS args,
           coalesce(arg_max(outcome, seq) FILTER (type = 'tool_call_end' AND outcome <> 'unknown'), 'unknown') AS outcome,
           arg_max(ts, seq) FILTER (type = 'tool_call_end') AS ended_at, arg_max(ms, seq) FILTER (type = 'tool_call_end') AS duration_ms
    FROM h WHERE type IN ('tool_call_start', 'tool_call_end') GROUP BY ALL)"""


def listed_sql(rows) -> str:
    """The rows of a list as a table, numbered from 0."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
    return "VALUES " + ", ".join(f"({i}, {', '.join(map(text, r))})" for i, r in enumerate(rows))


ORACLES = {
    "session_states": f"WITH {LOG} SELECT s.*, b.ts AS ended_at, b.reason FROM states s LEFT JOIN borders b USING (session)",
    "latest_session": f"WITH {LOG} SELECT session, last_event_at, n_turns FROM states ORDER BY last_event_at DESC, session LIMIT 1",
    "tool_calls": f"WITH {LOG} SELECT * FROM used",
    "outcome_tally": f"WITH {LOG} SELECT session, outcome, count(*) AS n FROM used GROUP BY ALL",
    "edits_that_count": f"""WITH {EVENTS}, {LOG} SELECT session, count(*) AS n_edits FROM (SELECT session, tool_use % 4 AS tool_use FROM edits)
      WHERE (session, tool_use) NOT IN (SELECT (session, tool_use) FROM used WHERE outcome IN ('failed', 'denied')) GROUP BY session""",
    "hook_stats": """WITH c AS (SELECT event_type AS hook, CAST(greatest(0, round(value - 3)) AS BIGINT) AS ms, event_id AS n FROM events)
      SELECT hook, count(*) AS n, count_if(n % 2 = 0) AS n_sync, count_if(n % 3 = 0 AND n % 5 > 0) AS n_with_context, count_if(n % 29 = 0) AS n_failed,
             quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS max_ms FROM c GROUP BY hook""",
    "path_classes": f"""WITH f(i, folder, ignored, holds_tests) AS ({listed_sql(lens.FOLDERS)}), n(i, name, is_test, lang) AS ({listed_sql(lens.NAMES)})
      SELECT p_partkey || '/' || folder || '/' || name AS path, ignored, holds_tests OR is_test AS is_test, lang
      FROM part JOIN f ON f.i = p_size % {len(lens.FOLDERS)} JOIN n ON n.i = p_partkey % {len(lens.NAMES)}""",
    "condition_means": f"WITH {RUNS} SELECT condition, count(*) AS n, avg(metric) AS pooled_mean, count(DISTINCT task) AS n_tasks FROM ok GROUP BY condition",
    "paired_runs": f"""WITH {RUNS} SELECT b.task, b.trial, b.metric AS baseline, t.metric AS treatment FROM ok b JOIN ok t ON b.task = t.task AND b.trial = t.trial AND b.condition = 'baseline' AND t.condition = 'treatment'""",
    "tool_summaries": f"""WITH c AS (
        SELECT conv_id, turn, turn % 2 = 1 AS odd, CASE WHEN turn % 2 = 1 THEN string_split(text, chr(10))[1] ELSE text END AS shown, text FROM conversations),
      k AS (SELECT *, odd AND (contains(shown, '<<<') OR contains(text, chr(10))) AS cut, CASE WHEN odd AND contains(shown, '<<<') THEN substr(shown, 1, position('<<<' IN shown) + 2) ELSE shown END AS head FROM c),
      s AS (SELECT conv_id, turn, CASE WHEN odd THEN {redact_sql("CASE WHEN cut THEN rtrim(head) || ' …' ELSE head END")} ELSE {redact_sql('head')} || ' in c' || conv_id END AS line FROM k),
      t AS (SELECT conv_id, turn, {cap_sql('line', 200)} AS line FROM s)
      SELECT conv_id, turn, {hash_sql('line')} AS hash, CAST(length(line) AS INT) AS n_chars FROM t""",
    "session_rollup": f"""WITH {EVENTS} SELECT session, arg_min(ts, seq) AS started_at, max(ts) AS last_event_at, count(*) AS n_events,
      count(DISTINCT tool) AS n_tools, arg_min(tool, seq) AS first_tool, arg_max(tool, seq) AS last_tool FROM e GROUP BY session""",
    "tool_call_merge": f"WITH {EVENTS}, {MERGED} SELECT * FROM calls",
    "hook_percentiles": f"""WITH {EVENTS} SELECT tool, count(*) AS n_calls, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS max_ms
      FROM e WHERE ms IS NOT NULL GROUP BY tool""",
    "diff_by_path": f"WITH {EVENTS} SELECT session, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, count(*) AS n_edits, bool_or(partial) AS partial FROM edits GROUP BY ALL",
    "edit_pairs": f"WITH {EVENTS} SELECT * FROM edits",
    "retention_prune": f"""WITH s AS (SELECT event_id AS seq, event_id // 20 AS session, ts FROM events)
      SELECT seq, session FROM s WHERE session IN (SELECT session FROM s GROUP BY session HAVING max(ts) >= (SELECT max(ts) FROM s) - INTERVAL {IDLE_DAYS} DAY)""",
    "tool_tally": f"WITH {EVENTS} SELECT session, tool, count(*) AS n FROM e WHERE phase = 'start' GROUP BY ALL",
    "session_report": f"""WITH {EVENTS}, {MERGED},
      paths AS (SELECT session, path, sum(added) AS added FROM edits GROUP BY ALL)
      SELECT session, n_events, first_tool, last_tool, coalesce(n_calls, 0) AS n_calls, coalesce(n_partial, 0) AS n_partial, coalesce(total_ms, 0) AS total_ms, coalesce(n_paths, 0) AS n_paths, coalesce(added, 0) AS added
      FROM ((SELECT session, count(*) AS n_events, arg_min(tool, seq) AS first_tool, arg_max(tool, seq) AS last_tool FROM e GROUP BY session)
      LEFT JOIN (SELECT session, count(*) AS n_calls, count_if(partial) AS n_partial, coalesce(CAST(sum(duration_ms) AS BIGINT), 0) AS total_ms FROM calls GROUP BY session) USING (session)
      LEFT JOIN (SELECT session, count(*) AS n_paths, CAST(sum(added) AS BIGINT) AS added FROM paths GROUP BY session) USING (session))""",
    "task_effects": f"WITH {RUNS} SELECT *, treatment - baseline AS effect FROM effects WHERE n_baseline > 0 AND n_treatment > 0",
    "log_ratio": f"""WITH {RUNS} SELECT count(*) AS n_tasks, CASE WHEN count(x) = count(*) THEN avg(x) END AS effect,
      CASE WHEN count(x) = count(*) THEN (exp(avg(x)) - 1) * 100 END AS percent
      FROM (SELECT CASE WHEN baseline > 0 AND treatment > 0 THEN ln(treatment / baseline) END AS x FROM effects WHERE n_baseline > 0 AND n_treatment > 0)""",
    "bootstrap_ci": f"""WITH {RUNS},
      drawn AS (SELECT task, condition, metric, resample, {draw_sql(SEED, "resample", "run")} AS u FROM ok, range(0, {RESAMPLES}) AS t(resample)),
      weighed AS (SELECT task, condition, metric, resample, {" + ".join(f"(u >= {cut})::INT" for cut in ex.OCCURRENCES)} AS w FROM drawn),
      means AS (SELECT task, resample, sum(w * metric) FILTER (condition = 'baseline') / nullif(sum(w) FILTER (condition = 'baseline'), 0) AS b,
                       sum(w * metric) FILTER (condition = 'treatment') / nullif(sum(w) FILTER (condition = 'treatment'), 0) AS t FROM weighed GROUP BY ALL)
      SELECT task, count(*) AS n, quantile_cont(t - b, 0.025) AS low, quantile_cont(t - b, 0.975) AS high FROM means WHERE b IS NOT NULL AND t IS NOT NULL GROUP BY task""",
    "cost_cap_prefix": f"""WITH {RUNS} SELECT * FROM (SELECT task, run AS block, metric AS cost,
      CAST(sum(metric) OVER (ORDER BY run ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM r) WHERE spent - cost < {COST_CAP}""",
    "resume_remaining": f"WITH {RUNS} SELECT task, trial, condition FROM r WHERE (task, trial, condition) NOT IN (SELECT (task, trial, condition) FROM r WHERE status = 'ok')",
    "precision_recall": """WITH x AS (SELECT o_custkey AS key, l_partkey AS item, o_totalprice, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      a AS (SELECT DISTINCT key, item FROM x WHERE l_quantity >= 25), t AS (SELECT DISTINCT key, item FROM x WHERE o_totalprice >= 100000),
      b AS (SELECT key, a.item IS NOT NULL AS given, t.item IS NOT NULL AS true_ FROM a FULL JOIN t USING (key, item))
      SELECT key, coalesce(count_if(given AND true_) / nullif(count_if(given), 0), 0) AS precision, coalesce(count_if(given AND true_) / nullif(count_if(true_), 0), 0) AS recall FROM b GROUP BY key""",
    "redact_text": f"SELECT doc_id, {hash_sql('clean')} AS hash, clean <> text AS changed FROM (SELECT doc_id, text, {redact_sql('text')} AS clean FROM documents)",
    "sanitize_text": f"SELECT doc_id, {cap_sql('plain', 200)} AS text FROM (SELECT doc_id, {PLAIN} AS plain FROM documents)",
    "prompt_preview": f"SELECT conv_id, turn, {hash_sql('text')} AS text_hash, {cap_sql('flat', 120)} AS preview FROM (SELECT *, {PREVIEW} AS flat FROM conversations WHERE role = 'user')",
    "line_diff": """WITH lines AS (
        SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM documents WHERE text <> '') GROUP BY ALL)
      SELECT key, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS removed
      FROM (SELECT coalesce(x.doc_id, y.doc_id - 1) AS key, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM lines x FULL JOIN lines y ON x.doc_id = y.doc_id - 1 AND x.line = y.line) GROUP BY key""",
    "context_lists": """WITH p AS (SELECT l_orderkey, l_partkey::VARCHAR AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rn FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
      s AS (SELECT *, sum(length(item) + 2) OVER (PARTITION BY l_orderkey ORDER BY rn) - 2 AS size, count(*) OVER (PARTITION BY l_orderkey) AS n FROM p),
      t AS (SELECT l_orderkey, max(rn) AS taken FROM s WHERE size + CASE WHEN rn < n THEN 9 + length((n - rn)::VARCHAR) ELSE 0 END <= 40 GROUP BY l_orderkey)
      SELECT l_orderkey, coalesce(string_agg(item, ', ' ORDER BY rn) FILTER (rn <= taken), '') ||
             CASE WHEN coalesce(any_value(taken), 0) < any_value(n) THEN ' (+' || (any_value(n) - coalesce(any_value(taken), 0)) || ' more)' ELSE '' END AS parts
      FROM s LEFT JOIN t USING (l_orderkey) GROUP BY l_orderkey""",
    "link_externals": f"WITH {LINKS} SELECT kind, specifier, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM l GROUP BY ALL",
    "externals_by_kind": f"WITH {LINKS} SELECT kind, count(DISTINCT specifier) AS n_specifiers, count(*) AS n_links FROM l GROUP BY kind",
}

ORACLES["kept_tool_calls"], ORACLES["kept_sessions"] = ORACLES["tool_calls"], ORACLES["session_states"]
ORACLES["session_full_report"] = f"""WITH {EVENTS}, {LOG},
  counted AS (SELECT * FROM (SELECT session, tool_use % 4 AS tool_use, path, added, removed, partial FROM edits) WHERE (session, tool_use) NOT IN (SELECT (session, tool_use) FROM used WHERE outcome IN ('failed', 'denied'))),
  paths AS (SELECT session, path, sum(added) AS added, sum(removed) AS removed, count(*) AS n, bool_or(partial) AS partial FROM counted GROUP BY ALL),
  changed AS (SELECT session, count(*) AS n_paths, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, sum(n)::BIGINT AS n_edits, count_if(partial) AS n_partial_paths FROM paths GROUP BY session),
  tools AS (SELECT session, string_agg(t, ',' ORDER BY t) AS by_tool FROM (SELECT session, tool || '=' || count(*) AS t FROM used GROUP BY session, tool) GROUP BY session),
  outcomes AS (SELECT session, string_agg(t, ',' ORDER BY t) AS by_outcome FROM (SELECT session, outcome || '=' || count(*) AS t FROM used GROUP BY session, outcome) GROUP BY session),
  totals AS (SELECT session, count(*) AS n_calls FROM used GROUP BY session),
  told AS (SELECT session, list_sort(list(seq)) AS prompts FROM (SELECT session, seq FROM h WHERE type = 'prompt' QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 20) GROUP BY session),
  k AS (SELECT user_id AS session, CAST(greatest(0, round(value - 3)) AS BIGINT) AS ms, event_id % 2 = 0 AS sync, CASE WHEN event_id % 9 = 0 THEN event_id % 5 END AS chars FROM events WHERE event_id % 3 = 0),
  waited AS (SELECT session, count(*) AS n_hooks, count_if(sync) AS n_sync, count_if(chars > 0) AS n_with_context, quantile_disc(ms, 0.5) FILTER (sync) AS p50, quantile_disc(ms, 0.95) FILTER (sync) AS p95, max(ms) FILTER (sync) AS max_ms FROM k GROUP BY session)
  SELECT s.*, b.ts AS ended_at, b.reason, coalesce(n_calls, 0) AS n_calls, coalesce(by_tool, '') AS by_tool, coalesce(by_outcome, '') AS by_outcome, coalesce(prompts, []) AS prompts, coalesce(n_paths, 0) AS n_paths,
         coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(n_edits, 0) AS n_edits, coalesce(n_partial_paths, 0) AS n_partial_paths, coalesce(n_hooks, 0) AS n_hooks, coalesce(n_sync, 0) AS n_sync,
         coalesce(n_with_context, 0) AS n_with_context, p50, p95, max_ms
  FROM states s LEFT JOIN borders b USING (session) LEFT JOIN totals USING (session) LEFT JOIN tools USING (session) LEFT JOIN outcomes USING (session) LEFT JOIN told USING (session) LEFT JOIN changed USING (session) LEFT JOIN waited USING (session)"""

PARTS = """m AS (
  SELECT p_partkey AS key, lower(replace(p_brand, '#', '')) || CASE WHEN p_size % 10 = 0 THEN '/test/p' || p_partkey || '.test' ELSE '/src/p' || p_partkey END || '.ts' AS path FROM part)"""
ORACLES["policy_decisions"] = rf"""WITH {PARTS}, hit AS (
    SELECT path, 'tests' AS rule, 2 AS s FROM m WHERE path GLOB '*.test.ts' UNION ALL SELECT path, 'early', 3 FROM m WHERE regexp_matches(path, '^brand1[^/]*/src/p[^/]\.ts$') UNION ALL SELECT path, 'all', 1 FROM m
    UNION ALL SELECT path, 'odd', 2 FROM m WHERE regexp_matches(path, '^brand[^12][^/]*/') UNION ALL SELECT path, 'one', 4 FROM m WHERE path GLOB 'brand13/*')
  SELECT path, ['record_only', 'tell_agent', 'ask_human', 'block'][max(s)] AS on_match, list_sort(list(rule)) AS matched FROM hit GROUP BY path"""
ORACLES["rule_violations"] = f"""WITH {PARTS}, d AS (
    SELECT DISTINCT s.path AS src, t.path AS dst, (a.l_partkey + b.l_partkey) % 6 <> 2 AS exact FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    JOIN m s ON s.key = a.l_partkey JOIN m t ON t.key = b.l_partkey WHERE a.l_partkey <> b.l_partkey)
  SELECT 'ones-not-twos' AS rule, src, dst, CASE WHEN exact THEN 'block' ELSE 'ask_human' END AS on_match FROM d WHERE src GLOB 'brand1?/*' AND dst GLOB 'brand2?/*'
  UNION ALL SELECT 'three-alone', src, dst, 'tell_agent' FROM d WHERE src GLOB 'brand3/*' AND NOT dst GLOB 'brand3/*' AND NOT dst GLOB 'brand4/src/*'
  UNION ALL SELECT 'five', src, dst, 'ask_human' FROM d WHERE dst GLOB 'brand5/*' AND NOT src GLOB 'brand5/*' AND NOT dst GLOB 'brand5/src/p*[05].ts'"""


def report_sql() -> str:
    one = " UNION ALL ".join(f"SELECT {k} AS metric, '{c.part}' AS part, '{c.metric}' AS name, '{c.kind}' AS kind, '{c.side}' AS side, {c.margin}::DOUBLE AS margin, {(1 - c.level) / 2} AS tail, {str(c.per_task).lower()} AS per_task" for k, c in enumerate(COMPARED))
    weight = " + ".join(f"(u >= {cut})::INT" for cut in ex.OCCURRENCES)
    tails = sorted({(1 - c.level) / 2 for c in COMPARED})
    quantile = lambda side: "CASE any_value(tail) " + " ".join(f"WHEN {t} THEN quantile_cont(e.effect, {t if side == 'low' else 1 - t})" for t in tails) + " END"
    return f"""WITH {RUNS}, told AS ({one}),
  wide AS (SELECT run, task, condition, r.metric::DOUBLE AS tokens, (user_id % 101)::DOUBLE AS recall, (event_id % 13)::DOUBLE AS turns, CASE WHEN event_id % 6 < 2 THEN event_id % 17 END::DOUBLE AS sixth FROM r JOIN events ON event_id = run WHERE status = 'ok'),
  long AS (SELECT run, task, condition, unnest([0, 1, 2, 3]) AS metric, unnest([tokens, recall, turns, sixth]) AS value FROM wide),
  drawn AS (SELECT run, resample, {draw_sql(SEED, "resample", "run")} AS u FROM wide, range(0, {REPORT_RESAMPLES}) AS t(resample)),
  weighed AS (SELECT run, resample, {weight} AS w FROM drawn UNION ALL SELECT run, -1, 1 FROM wide),
  means AS (SELECT metric, task, resample, sum(w * value) FILTER (condition = 'baseline') / nullif(sum(w) FILTER (condition = 'baseline'), 0) AS b,
                   sum(w * value) FILTER (condition = 'treatment') / nullif(sum(w) FILTER (condition = 'treatment'), 0) AS t FROM long JOIN weighed USING (run) WHERE value IS NOT NULL GROUP BY ALL),
  gains AS (SELECT metric, task, resample, per_task, CASE WHEN kind = 'difference' THEN t - b WHEN b > 0 AND t > 0 THEN ln(t / b) END AS effect FROM means JOIN told USING (metric) WHERE b IS NOT NULL AND t IS NOT NULL),
  every AS (SELECT metric, NULL AS task, resample, avg(effect) AS effect, count(effect) AS n, count(*) AS n_tasks FROM gains GROUP BY ALL
            UNION ALL SELECT metric, task, resample, effect, (effect IS NOT NULL)::BIGINT, 1 FROM gains WHERE per_task),
  whole AS (SELECT metric, task, n_tasks, CASE WHEN n = n_tasks THEN effect END AS estimate FROM every WHERE resample = -1),
  spread AS (SELECT e.metric, e.task, {quantile('low')} AS low, {quantile('high')} AS high FROM every e JOIN told USING (metric) JOIN whole w ON w.metric = e.metric AND w.task IS NOT DISTINCT FROM e.task
             WHERE resample >= 0 AND e.n = w.n_tasks AND w.estimate IS NOT NULL GROUP BY ALL),
  judged AS (SELECT part, name AS metric, w.task, kind, w.n_tasks, estimate, low, high, CASE WHEN kind = 'log-ratio' THEN (exp(estimate) - 1) * 100 END AS percent,
                    CASE WHEN side = 'more' THEN low > -(CASE WHEN part = 'guard' THEN margin ELSE 0 END) ELSE high < CASE WHEN part = 'guard' THEN margin ELSE 0 END END AS holds
             FROM whole w JOIN told USING (metric) LEFT JOIN spread s ON s.metric = w.metric AND s.task IS NOT DISTINCT FROM w.task)
  SELECT * EXCLUDE (holds), CASE WHEN part = 'primary' THEN coalesce(holds, false) AND (SELECT bool_and(coalesce(holds, false)) FROM judged WHERE part = 'guard' AND task IS NULL) ELSE holds END AS supported FROM judged"""


def digest_sql(levels: int = 4) -> str:
    """Levels as long as there are more rows than a block; those after that repeat the rows."""
    parts = ["r0 AS (SELECT p_type || '/' || p_partkey AS path, sha256(p_type || '/' || p_partkey || chr(0) || sha256(p_name)) AS digest FROM part)"]
    for k in range(levels):
        parts.append(f"""b{k} AS (SELECT path, digest, (SELECT count(*) FROM r{k}) > {logs.BLOCK} AS many, coalesce(sum((('0x' || substr(digest, 1, 8))::BIGINT % {logs.BLOCK} = 0)::INT) OVER (ORDER BY path, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM r{k}),
  r{k + 1} AS (SELECT min(path) AS path, sha256(string_agg(digest, '' ORDER BY path, digest)) AS digest FROM b{k} WHERE many GROUP BY block UNION ALL SELECT path, digest FROM b{k} WHERE NOT many)""")
    return f"WITH {', '.join(parts)} SELECT sha256(string_agg(digest, '' ORDER BY path, digest)) AS hash FROM r{levels}"


ORACLES["joint_report"], ORACLES["folder_digest"] = report_sql(), digest_sql()
