"""Registered queries: webhook intake and streams, outbox, batch inference
(W1-W4, F5, P14, S10, U1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prlens.operators import findings as fd, infer, memory as mm, report, reviews as rv, size
from prlens.plans.findings import ALL_SQL, INLINE_SQL, _unified
from prlens.plans.history import MEM_SQL, REVIEWER_TEXT_SQL, REVIEWERS_SQL
from prlens.plans.intake import _size_sql
from prlens.plans.registry import register
from prlens.plans.report import COLS as REPORT_COLS, REPORT_SQL, pr_store, risk_report
from prlens.plans.reviews import SCORE_SQL, full_comments
from prlens.session import checkpoint_dir
from prlens.sources import fixtures as fx
from prlens.sources.fixtures import WEBHOOK_SECRET, hmac_pads
from prlens.sources.tables import table
from prlens.streaming import webhooks as wh

_IPAD, _OPAD = hmac_pads(WEBHOOK_SECRET)

VERIFY_SQL = f"""verified AS (
  SELECT *, reason IS NULL AS accepted FROM (
    SELECT delivery_id, ts, body, signature,
      CASE WHEN signature IS NULL OR signature = '' THEN 'Missing X-Hub-Signature-256 header'
           WHEN NOT starts_with(signature, 'sha256=') THEN 'Malformed signature header'
           WHEN substring(signature, 8) <> sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(body))))
           THEN 'Signature mismatch' END AS reason
    FROM fx_webhook) v)"""
ROUTE_SQL = """SELECT delivery_id, json_extract_string(body, '$.action') AS action,
       CAST(json_extract(body, '$.pull_request.number') AS BIGINT) AS pr_number,
       json_extract_string(body, '$.repository.full_name') AS repo_name FROM {src}
WHERE json_extract_string(body, '$.action') IN ('opened', 'synchronize')"""
REQUESTS_SQL = f"{VERIFY_SQL},\nrequests AS ({ROUTE_SQL.format(src='(SELECT * FROM verified WHERE accepted) a')})"
REQ_COLS = ["delivery_id", "action", "pr_number", "repo_name"]


@register("verify_signature", f"WITH {VERIFY_SQL}\nSELECT delivery_id, accepted, reason FROM verified")
def q_verify_signature(spark, d):
    return wh.verify_signature(fx.fx_webhook(spark, d), WEBHOOK_SECRET).select("delivery_id", "accepted", "reason")


@register("webhook_route", ROUTE_SQL.format(src="fx_webhook_body"))
def q_webhook_route(spark, d):
    return wh.webhook_route(fx.fx_webhook_body(spark, d)).select(*REQ_COLS)


@register("review_requests", f"WITH {REQUESTS_SQL}\nSELECT * FROM requests")
def q_review_requests(spark, d):
    """W2, batch twin: the same functions on the static deliveries."""
    return wh.review_requests(fx.fx_webhook(spark, d), WEBHOOK_SECRET).select(*REQ_COLS)


def _events_stream(spark, d):
    schema = table(spark, d, "events").schema
    return (spark.readStream.schema(schema).option("basePath", d)
            .parquet(f"{d.rstrip('/')}/events*.parquet"))


@register("stream_review_requests", f"WITH {REQUESTS_SQL}\nSELECT * FROM requests")
def q_stream_review_requests(spark, d):
    """W2 + S6: Structured Streaming over the delivery files (availableNow),
    written to a parquet sink in the shared checkpoint folder; returns the sink."""
    deliveries = fx.signed_of(fx.webhook_body_of(_events_stream(spark, d)))
    sink = wh.run_review_request_stream(spark, deliveries, WEBHOOK_SECRET)
    return spark.read.parquet(sink).select(*REQ_COLS)


@register("webhook_source", """
SELECT delivery_id, CAST(ts AS VARCHAR) AS ts, body, signature FROM fx_webhook""")
def q_webhook_source(spark, d):
    """Deliveries dropped as parquet files are read back as a stream with
    the fixed delivery schema and drained to a sink."""
    drop = f"{checkpoint_dir(spark)}/deliveries-{uuid.uuid4().hex}"
    fx.fx_webhook(spark, d).write.parquet(drop)
    sink = wh.run_to_parquet(spark, wh.webhook_source(spark, drop))
    return spark.read.parquet(sink).select("delivery_id", F.col("ts").cast("string").alias("ts"), "body", "signature")


@register("stream_pr_pipeline", REPORT_SQL + f""", {REQUESTS_SQL}
SELECT {', '.join(REPORT_COLS)} FROM risk
WHERE EXISTS (SELECT 1 FROM requests r WHERE r.repo_name = risk.repo_name AND r.pr_number = risk.pr_number)""")
def q_stream_pr_pipeline(spark, d):
    """Each micro-batch of review requests runs the whole risk report for
    its PRs and reads only their buckets of the tables (idempotent per batch id)."""
    deliveries = fx.signed_of(fx.webhook_body_of(_events_stream(spark, d)))
    requests = wh.review_requests(deliveries, WEBHOOK_SECRET)

    store = pr_store(spark, d, f"{checkpoint_dir(spark)}/pr-store-{uuid.uuid4().hex}")

    def run(batch):
        return risk_report(spark, d, store.reader(batch))

    schema = risk_report(spark, d).schema
    sink = f"{checkpoint_dir(spark)}/pr-reports-{uuid.uuid4().hex}"
    wh.run_pr_report_stream(spark, requests, run, sink)
    return wh.read_reports(spark, sink, schema).select(*REPORT_COLS)


@register("stream_issue_counts", f"""WITH {MEM_SQL}
SELECT type, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(issue_types) AS type FROM mem) t GROUP BY type""")
def q_stream_issue_counts(spark, d):
    """store_review appends the memory table; a stream over it keeps the
    tag counters current (complete mode)."""
    base = f"{checkpoint_dir(spark)}/memory-{uuid.uuid4().hex}"
    rows = mm.memory_rows(fx.fx_verdict(spark, d))
    mm.store_review(rows, base)
    mem_stream = spark.readStream.schema(spark.read.parquet(base).schema).parquet(base)
    return wh.latest_counts(spark, wh.run_issue_count_stream(spark, mem_stream))


@register("error_comment", f"""WITH {REQUESTS_SQL}
SELECT DISTINCT r.repo_name, r.pr_number, '⚠️ Automated review failed: PR #' || CAST(r.pr_number AS VARCHAR)
       || ' not found in ' || r.repo_name AS body
FROM requests r WHERE NOT EXISTS (SELECT 1 FROM fx_pr p WHERE p.repo_name = r.repo_name AND p.pr_number = r.pr_number)""")
def q_error_comment(spark, d):
    return errors(spark, d)


def errors(spark, d):
    req = wh.review_requests(fx.fx_webhook(spark, d), WEBHOOK_SECRET).select("repo_name", "pr_number").distinct()
    missing = req.join(fx.fx_pr(spark, d).select("repo_name", "pr_number"), ["repo_name", "pr_number"], "left_anti")
    status = missing.withColumn("error", F.concat(F.lit("PR #"), F.col("pr_number").cast("string"),
                                                  F.lit(" not found in "), F.col("repo_name")))
    return rv.error_comment(status)


_SIZE = _size_sql(False).strip()[len("WITH "):].strip()


@register("comment_outbox", ALL_SQL + ", " + INLINE_SQL + ", " + _SIZE + f""",
{REVIEWERS_SQL}, {REVIEWER_TEXT_SQL}, {SCORE_SQL}, {REQUESTS_SQL},
size_c AS (SELECT repo_name, pr_number, concat_ws(chr(10), '## ⚠️ PR Size Warning' || chr(10),
  CASE WHEN w1 IS NOT NULL THEN '- ' || w1 END, CASE WHEN w2 IS NOT NULL THEN '- ' || w2 END,
  chr(10) || '**Stats:** +' || CAST(total_additions AS VARCHAR) || ' additions, -' || CAST(total_deletions AS VARCHAR)
  || ' deletions, ' || CAST(total_files AS VARCHAR) || ' files changed',
  chr(10) || '> The full AI review will still run, but review quality decreases with PR size.') AS body
  FROM w WHERE w1 IS NOT NULL OR w2 IS NOT NULL),
summ AS (SELECT v.repo_name, v.pr_number, coalesce(v.final_review, '')
  || CASE WHEN coalesce(a.autofix, '') <> '' AND NOT contains(a.autofix, 'No Auto-Fixes Available')
          THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 🔧 Auto-Fix Suggestions' || chr(10) || chr(10) || a.autofix
          ELSE '' END
  || CASE WHEN coalesce(r.reviewer_text, '') <> '' THEN chr(10) || chr(10) || '---' || chr(10) || r.reviewer_text ELSE '' END AS body
  FROM fx_verdict v LEFT JOIN fx_autofix a USING (repo_name, pr_number) LEFT JOIN rev_text r USING (repo_name, pr_number)),
errs AS (SELECT DISTINCT r.repo_name, r.pr_number, '⚠️ Automated review failed: PR #' || CAST(r.pr_number AS VARCHAR)
       || ' not found in ' || r.repo_name AS body
  FROM requests r WHERE NOT EXISTS (SELECT 1 FROM fx_pr p WHERE p.repo_name = r.repo_name AND p.pr_number = r.pr_number))
SELECT repo_name, pr_number, 'size_warning' AS kind, NULL::VARCHAR AS path, NULL::BIGINT AS line, NULL::VARCHAR AS state,
       NULL::VARCHAR AS head_sha, body FROM size_c
UNION ALL SELECT repo_name, pr_number, 'inline', path, CAST(line AS BIGINT), NULL, NULL, body FROM inline
UNION ALL SELECT repo_name, pr_number, 'summary', NULL, NULL, NULL, NULL, body FROM summ
UNION ALL SELECT repo_name, pr_number, 'status', NULL, NULL, 'pending', head_sha, 'AI review in progress...' FROM fx_pr
UNION ALL SELECT s.repo_name, s.pr_number, 'status', NULL, NULL, CASE WHEN passed THEN 'success' ELSE 'failure' END, p.head_sha,
                 description FROM scores s JOIN fx_pr p USING (repo_name, pr_number)
UNION ALL SELECT repo_name, pr_number, 'error', NULL, NULL, NULL, NULL, body FROM errs""")
def q_comment_outbox(spark, d):
    sizes = size.pr_size_comment(size.pr_size_check(fx.fx_pr(spark, d), fx.fx_pr_file(spark, d)))
    inline = fd.inline_comments(_unified(spark, d))
    return report.comment_outbox(fx.fx_pr(spark, d), sizes, inline, full_comments(spark, d), rv.score_gate(fx.fx_verdict(spark, d)),
                                 errors(spark, d))


SCORE_PROMPT_SQL = ("'Rate this code review from 1 to 10 for concrete, actionable, correctly ranked findings and a sound "
                    "merge decision. Answer with the number only.' || chr(10) || chr(10) || final_review")


@register("batch_infer", f"""
SELECT repo_name, pr_number, CAST(least(10, 4 + 3 * (length(prompt) - length(replace(prompt, '- **', ''))) // 4) AS VARCHAR)
       AS response, 'rules' AS provider, CAST(1 AS BIGINT) AS attempts
FROM (SELECT repo_name, pr_number, {SCORE_PROMPT_SQL} AS prompt FROM fx_verdict) p""")
def q_batch_infer(spark, d):
    """Score prompts through a provider chain (no model configured, then the
    rule-based judge) in Arrow batches."""
    prompts = rv.build_score_prompt(fx.fx_verdict(spark, d))
    out = infer.batch_infer(prompts, [("model", None), ("rules", infer.rule_judge)])
    return out.select("repo_name", "pr_number", "response", "provider", "attempts")
