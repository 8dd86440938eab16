"""Queries for status changes, the outbox, policies and pages, with the SQL they are compared with.

Tables that are not given are derived from those that are, alike on both sides: the outbox, roll-ups and audit entries
from the journals, the registry from the suppliers, consumers from the customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions import text as tx
from tideloom.operators import matching, outbox, policy, transitions
from tideloom.operators.folding import canonical
from tideloom.plans import pages, read_models
from tideloom.plans.reference_queries import _BEST, _TOKENS, AS_OF, DIM, LIVE, OWN, RANGES, WITH, WS, hubs, posts
from tideloom.runtime import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LATE = "2026-04-08 00:00:00"
T, TL = f"TIMESTAMP '{AS_OF}'", f"TIMESTAMP '{LATE}'"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assignment_decision_log")


# Gate and status changes


_GATE = f"""gt AS (SELECT id, assignment_status, deleted_at, coalesce(len(entities), 0) > 0 AS ents, trim(regexp_replace(regexp_replace(coalesce(content, ''), '{RANGES}', ' ', 'g'), '{WS}+', ' ', 'g')) AS b, regexp_replace(coalesce(content, ''), '^{WS}+|{WS}+$', '', 'g') AS raw FROM posts_once),
 gw AS (SELECT *, lower(b) AS low, CASE WHEN b = '' THEN 0 ELSE len(string_split(b, ' ')) END AS n FROM gt),
 gf AS (SELECT *, ' ' || regexp_replace(low, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '  ', 'g') || ' ' AS spaced, len(regexp_extract_all(' ' || regexp_replace(low, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '  ', 'g') || ' ', ' (?:i|me|my|myself|im) ')) AS me FROM gw),
 gate AS (SELECT id, assignment_status, deleted_at, CASE WHEN raw = '' THEN 'empty_text' WHEN n < 7 THEN 'too_short'
 WHEN regexp_matches(low, '\\b(?:lol|lmao|selfie|fitcheck|feeling cute|hmu|dm me|bored af|good morning yall|gm everyone)\\b') THEN 'chatter_marker' WHEN me >= 3 AND me / n > 0.22 THEN 'personal_diary'
 WHEN ents OR regexp_matches(spaced, ' (?:{"|".join(w.replace(" ", " +") for w in tx.DEBATE + tx.MODAL if "'" not in w)}) ') OR regexp_matches(low, '#(?:breaking|news|update|alert)\\b') OR contains(b, '?') OR list_has_any(string_split(low, ' '), {tx.signal_lexicon()}) THEN 'valid_discourse' ELSE 'lacks_substance' END AS reason FROM gf)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    named = F.coalesce(F.size("entities"), F.lit(0)) > 0
    return posts(spark, d, "content", "entities", "assignment_status", "deleted_at").select("id", "assignment_status", "deleted_at", tx.gate(F.col("content"), named).alias("reason"))


@query(f"{WITH}, {_GATE} SELECT id, reason FROM gate")
def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("id", "reason")


@query(f"{WITH}, {_GATE} SELECT id, CASE WHEN deleted_at IS NULL AND assignment_status IN ('pending', 'unassigned') AND reason <> 'valid_discourse' THEN 'noise' ELSE assignment_status END AS assignment_status FROM gate")
def noise_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts after the gate's verdicts on those that wait."""
    rows = _gated(spark, d)
    changes, _, _ = transitions.noise(rows.where("reason <> 'valid_discourse'").select("id", "reason"))
    p = posts(spark, d, "assignment_status", "event_id", "assignment_confidence", "assignment_updated_at", "deleted_at")
    return transitions.with_status(p, changes, ("pending", "unassigned"), AS_OF).select("id", "assignment_status")


@query(f"{WITH}, {_GATE} SELECT 'post.noise' AS event_type, id AS post_id, reason FROM gate WHERE assignment_status = 'pending' AND deleted_at IS NULL AND reason <> 'valid_discourse'")
def noise_events(spark: SparkSession, d: str) -> DataFrame:
    rows = _gated(spark, d).where("assignment_status = 'pending' and deleted_at is null and reason <> 'valid_discourse'")
    return transitions.noise(rows)[1].select("event_type", "post_id", F.get_json_object("payload", "$.reason").alias("reason"))


@query(f"{WITH} SELECT id, (row_number() OVER (ORDER BY id) - 1) // 128 AS chunk FROM (SELECT id FROM posts_once WHERE assignment_status = 'pending' ORDER BY id LIMIT 500)")
def pending_chunks(spark: SparkSession, d: str) -> DataFrame:
    return transitions.pending(posts(spark, d, "assignment_status"))


@query(f"{WITH}, hint AS (SELECT post_id AS id FROM assignment_decision_log WHERE created_at IS NOT NULL ORDER BY created_at DESC, post_id DESC LIMIT 1000) SELECT id FROM posts_once WHERE assignment_status = 'pending' AND id NOT IN (SELECT id FROM hint) UNION ALL SELECT -id FROM posts_once WHERE assignment_status = 'pending' AND id IN (SELECT id FROM hint)")
def hinted_posts(spark: SparkSession, d: str) -> DataFrame:
    """Pending posts among the thousand newest hints (negative), and those that only the scan finds."""
    hints = transitions.newest_hints(decisions(spark, d).where("created_at is not null").select(F.col("post_id").alias("id"), F.col("created_at").alias("at")), 1000)
    p = posts(spark, d, "assignment_status").where("assignment_status = 'pending'")
    found = transitions.pending(p, 1_000_000_000, hints).select("id")
    return p.join(found, "id", "left_anti").select("id").union(found.select((-F.col("id")).alias("id")))


@query(f"""{WITH}, l AS (SELECT post_id, arg_max(status, (created_at, id)) AS st, arg_max(event_id, (created_at, id)) AS ev FROM assignment_decision_log WHERE post_id IS NOT NULL AND status IN ('assigned', 'unassigned') GROUP BY 1)
SELECT p.id, CASE WHEN l.post_id IS NOT NULL AND deleted_at IS NULL AND assignment_status IN ('pending', 'candidate') THEN st ELSE assignment_status END AS assignment_status, CASE WHEN l.post_id IS NOT NULL AND deleted_at IS NULL AND assignment_status IN ('pending', 'candidate') THEN ev ELSE p.event_id END AS event_id FROM posts_once p LEFT JOIN l ON l.post_id = p.id""")
def finalised_posts(spark: SparkSession, d: str) -> DataFrame:
    """Logged decisions applied to the posts that still wait, and to no others."""
    logged = decisions(spark, d).where("post_id is not null and status in ('assigned', 'unassigned')").groupBy("post_id").agg(F.max(F.struct("created_at", "id", "status", "event_id", "confidence")).alias("l"))
    changes = logged.select(F.col("post_id").alias("id"), "l.status", "l.event_id", "l.confidence")
    p = posts(spark, d, "assignment_status", "event_id", "assignment_confidence", "assignment_updated_at", "deleted_at")
    return transitions.with_status(p, changes, ("pending", "candidate"), AS_OF).select("id", "assignment_status", "event_id")


@query(f"{WITH} SELECT id, CASE WHEN event_id IS NULL AND deleted_at IS NULL AND assignment_status IN ('pending', 'candidate', 'unassigned') AND created_at < {T} - INTERVAL 24 HOUR THEN 'noise' ELSE assignment_status END AS assignment_status FROM posts_once")
def aged_statuses(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d, "assignment_status", "event_id", "assignment_confidence", "assignment_updated_at", "deleted_at", "created_at")
    return transitions.with_status(p, transitions.aged(p, AS_OF), ("pending", "candidate", "unassigned"), AS_OF).select("id", "assignment_status")


@query(f"{WITH} SELECT id, CASE WHEN assignment_status = 'pending' AND assignment_updated_at < {T} - INTERVAL 5 MINUTE THEN 'pending' WHEN assignment_status = 'pending' THEN 'processing' ELSE assignment_status END AS assignment_status FROM posts_once")
def released_posts(spark: SparkSession, d: str) -> DataFrame:
    """Pending posts taken as being processed; those that are stuck are released."""
    p = posts(spark, d, "assignment_status", "assignment_updated_at")
    busy = p.withColumn("assignment_status", F.when(F.col("assignment_status") == "pending", "processing").otherwise(F.col("assignment_status")))
    return transitions.released(busy, AS_OF).select("id", "assignment_status")


_IDS = f"""{_TOKENS}, mine AS (SELECT DISTINCT id, token FROM tokens), theirs AS (SELECT DISTINCT event_id, token FROM tokens WHERE {LIVE} AND event_id IS NOT NULL),
 nm AS (SELECT id, count(*) AS n FROM mine GROUP BY 1), nt AS (SELECT event_id, count(*) AS n FROM theirs GROUP BY 1),
 meet AS (SELECT DISTINCT id, event_id FROM mine JOIN theirs USING (token)),
 pair AS (SELECT b.*, m1.id IS NOT NULL AS w1, m2.id IS NOT NULL AS w2, coalesce(nm.n, 0) > 0 AS has, coalesce(t1.n, 0) > 0 AS has1, coalesce(t2.n, 0) > 0 AS has2 FROM best b LEFT JOIN nm ON nm.id = b.post_id
  LEFT JOIN meet m1 ON m1.id = b.post_id AND m1.event_id = b.event_id LEFT JOIN meet m2 ON m2.id = b.post_id AND m2.event_id = b.runner_id LEFT JOIN nt t1 ON t1.event_id = b.event_id LEFT JOIN nt t2 ON t2.event_id = b.runner_id)"""
_FIRST = "CASE WHEN sim IS NULL THEN 'unassigned' WHEN sim >= 0.62 AND (runner_sim IS NULL OR sim - runner_sim >= 0.05) THEN 'assigned' WHEN sim >= 0.45 THEN 'candidate' ELSE 'unassigned' END"


@query(f"""{WITH}, {_BEST}, {_IDS}, f AS (SELECT *, {_FIRST} AS first FROM pair), t AS (SELECT *, first = 'candidate' AND sim >= 0.5 AND runner_id IS NOT NULL AND w1 <> w2 AS tie FROM f),
 v AS (SELECT *, (first = 'assigned' OR tie) AND has AND CASE WHEN tie AND w2 THEN has2 AND NOT w2 ELSE has1 AND NOT w1 END AS veto FROM t)
SELECT post_id, CASE WHEN coalesce(veto, false) THEN 'candidate' WHEN first = 'assigned' OR tie THEN 'assigned' ELSE first END AS status, CASE WHEN (first = 'assigned' OR tie) AND NOT coalesce(veto, false) THEN CASE WHEN tie AND w2 THEN runner_id ELSE event_id END END AS event_id,
 CASE WHEN coalesce(veto, false) THEN 'entity_conflict' WHEN tie THEN 'entity_tiebreak' WHEN first = 'assigned' THEN 'confident_assign' WHEN sim IS NULL OR sim < 0.45 THEN 'below_candidate_floor' WHEN sim >= 0.62 AND runner_sim IS NOT NULL AND sim - runner_sim < 0.05 THEN 'margin_fail' ELSE 'below_threshold' END AS reason FROM v""")
def assign_with_identity(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d, "entities", "event_id", "deleted_at")
    found = matching.match_top2(posts(spark, d, "embedding"), hubs(spark, d).where("is_active"), DIM)
    return matching.assign(found, p.select(F.col("id").alias("post_id"), "entities"), matching.hub_identity(p)).select("post_id", "status", "event_id", "reason")


@query(f"""{WITH}, {_BEST}, {_IDS}, q AS (SELECT id FROM posts_once WHERE assignment_status = 'candidate' AND event_id IS NULL AND assignment_updated_at < {TL} - INTERVAL 10 MINUTE ORDER BY assignment_updated_at, id LIMIT 200),
 f AS (SELECT pair.*, {_FIRST} AS first FROM pair JOIN q ON q.id = post_id), c AS (SELECT *, coalesce(first = 'assigned' AND NOT (has AND has1 AND NOT w1), false) AS clear FROM f),
 t AS (SELECT *, coalesce((first = 'candidate' OR (first = 'assigned' AND NOT clear)) AND sim >= 0.5 AND w1 <> w2, false) AS tie FROM c)
SELECT post_id, CASE WHEN clear OR tie THEN 'assigned' ELSE 'unassigned' END AS status, CASE WHEN clear OR (tie AND w1) THEN event_id WHEN tie THEN runner_id END AS event_id, CASE WHEN clear THEN 'auto_resolve_candidate' WHEN tie THEN 'entity_tiebreak' ELSE 'auto_resolve_unassigned' END AS reason FROM t""")
def swept_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The two hundred longest waiting candidates matched once more (the limit is the sweep's batch)."""
    p = posts(spark, d, "entities", "event_id", "deleted_at", "assignment_status", "assignment_updated_at", "embedding")
    rows = transitions.sweep(p, hubs(spark, d).where("is_active"), matching.hub_identity(p), LATE, DIM)
    return rows.select("post_id", "status", "event_id", "reason")


_WAIT = f"{LIVE} AND event_id IS NULL AND assignment_status IN ('pending', 'candidate', 'unassigned')"


@query(f"{WITH}, l AS (SELECT DISTINCT post_id AS id FROM assignment_decision_log WHERE status IN ('unassigned', 'candidate', 'noise')) SELECT p.id AS post_id, p.created_at >= {T} AS recent FROM posts_once p JOIN l ON l.id = p.id WHERE {LIVE}")
def buffered_posts(spark: SparkSession, d: str) -> DataFrame:
    """The buffer of posts journalled without hub, joined to the live posts; deleted ones are purged."""
    p = posts(spark, d, "embedding", "created_at", "deleted_at", "user_id", "entities")
    ids = decisions(spark, d).where("status in ('unassigned', 'candidate', 'noise')").select(F.col("post_id").alias("id")).distinct()
    held = p.join(ids, "id", "left_semi").select(F.col("id").alias("post_id"), "embedding", "created_at")
    old, new = held.where(F.col("created_at") < F.lit(AS_OF)), held.where(F.col("created_at") >= F.lit(AS_OF))
    whole = transitions.to_buffer(old, p, new.select(F.col("post_id").alias("id")).union(old.select("post_id")), LATE)
    return transitions.buffer_rows(whole, p).select("post_id", (F.col("created_at") >= F.lit(AS_OF).cast("timestamp")).alias("recent"))


# Outbox


_BOX = """box AS (SELECT id, 'post.' || status AS event_type, post_id, event_id, CASE id % 5 WHEN 0 THEN 'delivered' WHEN 1 THEN 'leased' WHEN 2 THEN 'failed' ELSE 'pending' END AS delivery_status, CAST(id % 7 AS INTEGER) AS attempts,
 CASE WHEN id % 5 = 1 THEN 'c' || (id % 3) END AS consumer, CASE WHEN id % 5 = 1 THEN 't' || (id % 4) END AS lease_token, CASE WHEN id % 5 = 1 THEN created_at + INTERVAL 10 DAY END AS lease_until, created_at AS available_at,
 CASE WHEN id % 5 = 0 THEN created_at + INTERVAL 1 MINUTE END AS delivered_at, CASE WHEN id % 5 = 2 THEN CASE WHEN id % 2 = 0 THEN 'unconsumed_event' ELSE 'HTTP 500' END END AS last_error, created_at FROM assignment_decision_log)"""


def box(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 5
    text = lambda c: F.col(c).cast("string")
    status = F.when(k == 0, "delivered").when(k == 1, "leased").when(k == 2, "failed").otherwise("pending")
    return decisions(spark, d).select(
        "id", F.concat(F.lit("post."), "status").alias("event_type"), "post_id", "event_id", outbox.payload(F.concat(F.lit("post."), "status"), F.col("post_id"), F.col("event_id"), F.col("confidence")).alias("payload"),
        status.alias("delivery_status"), (F.col("id") % 7).cast("int").alias("attempts"), F.when(k == 1, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("consumer"), F.when(k == 1, F.concat(F.lit("t"), (F.col("id") % 4).cast("string"))).alias("lease_token"),
        F.when(k == 1, F.col("created_at") + F.expr("INTERVAL 10 DAYS")).alias("lease_until"), F.col("created_at").alias("available_at"), F.when(k == 0, F.col("created_at") + F.expr("INTERVAL 1 MINUTE")).alias("delivered_at"),
        F.when(k == 2, F.when(F.col("id") % 2 == 0, "unconsumed_event").otherwise("HTTP 500")).alias("last_error"), "created_at")


@query(f"""{WITH}, {_BOX}, s AS (SELECT * FROM box WHERE created_at < {T} OR created_at IS NULL), n AS (SELECT post_id, 'post.assigned' AS event_type, event_id AS ev FROM assignment_decision_log WHERE post_id IS NOT NULL AND id % 2 = 0)
SELECT s.post_id, s.event_type, CASE WHEN n.post_id IS NULL THEN s.event_id ELSE n.ev END AS event_id, CASE WHEN n.post_id IS NULL THEN delivery_status ELSE 'pending' END AS delivery_status, CASE WHEN n.post_id IS NULL THEN attempts ELSE 0 END AS attempts, lease_token, NULL AS post_seq FROM s LEFT JOIN n ON n.post_id = s.post_id AND n.event_type = s.event_type WHERE n.post_id IS NULL
UNION ALL SELECT s.post_id, s.event_type, n.ev, 'pending', 0, lease_token, p.post_seq + 1 FROM s JOIN n ON n.post_id = s.post_id AND n.event_type = s.event_type LEFT JOIN posts_once p ON p.id = n.post_id
UNION ALL SELECT n.post_id, n.event_type, n.ev, 'pending', 0, NULL, p.post_seq + 1 FROM n LEFT JOIN posts_once p ON p.id = n.post_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.post_id = n.post_id AND s.event_type = n.event_type)""")
def outbox_written(spark: SparkSession, d: str) -> DataFrame:
    """Assignment events of every other decision, with their sequence numbers, upserted into the outbox of the first half."""
    stored = box(spark, d).where((F.col("created_at") < F.lit(AS_OF).cast("timestamp")) | F.col("created_at").isNull())
    new = decisions(spark, d).where("post_id is not null and id % 2 = 0").select("id", "post_id", "event_id", "confidence")
    seqs = outbox.bumped(posts(spark, d, "post_seq"), new)
    kind = F.lit("post.assigned")
    events = new.join(seqs, "post_id", "left").select("id", kind.alias("event_type"), "post_id", "event_id", outbox.payload(kind, F.col("post_id"), F.col("event_id"), F.col("confidence"), F.col("post_seq")).alias("payload"))
    after = outbox.write(stored, events, AS_OF, [F.desc("id")])
    return after.select("post_id", "event_type", "event_id", "delivery_status", "attempts", "lease_token", F.get_json_object("payload", "$.post_seq").cast("long").alias("post_seq"))


@query(f"""WITH {_BOX}, a AS (SELECT id, CASE WHEN id % 2 = 0 THEN 't' || (id % 4) END AS token FROM assignment_decision_log WHERE id % 3 = 0 UNION ALL SELECT -1, NULL),
 j AS (SELECT box.id, delivery_status, a.id IS NOT NULL AS asked, delivery_status IN ('pending', 'leased') AS open, lease_until IS NULL OR lease_until <= {T} OR coalesce(lease_token = token, false) AS mine FROM box LEFT JOIN a ON a.id = box.id)
SELECT id, CASE WHEN asked AND open AND mine THEN 'delivered' ELSE delivery_status END AS delivery_status, CASE WHEN asked THEN CASE WHEN open AND mine THEN 'acked' WHEN open THEN 'conflict' ELSE 'closed' END END AS outcome FROM j UNION ALL SELECT -1, NULL, 'missing'""")
def outbox_acked(spark: SparkSession, d: str) -> DataFrame:
    rows = box(spark, d)
    acks = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), (F.col("id") % 4).cast("string"))).alias("token")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(None).cast("string")))
    after, told = outbox.ack(rows, acks, AS_OF)
    return after.select("id", "delivery_status").join(told, "id", "full_outer")


@query(f"""WITH {_BOX}, s AS (SELECT *, delivery_status = 'pending' AND available_at < {TL} - INTERVAL 7 DAY AS aged FROM box), t AS (SELECT id, CASE WHEN aged THEN 'failed' ELSE delivery_status END AS delivery_status, CASE WHEN aged THEN 'unconsumed_event' ELSE last_error END AS last_error, attempts + CASE WHEN aged THEN 1 ELSE 0 END AS attempts, created_at, delivered_at FROM s)
SELECT id, delivery_status, last_error, CAST(attempts AS INTEGER) AS attempts FROM t WHERE NOT (delivery_status = 'failed' AND coalesce(last_error = 'unconsumed_event', false) AND created_at < {TL} - INTERVAL 30 DAY) AND NOT (delivery_status = 'delivered' AND coalesce(delivered_at < {TL} - INTERVAL 7 DAY, false))""")
def outbox_pruned(spark: SparkSession, d: str) -> DataFrame:
    return outbox.prune(box(spark, d), LATE).select("id", "delivery_status", "last_error", "attempts")


@query(f"""{WITH}, {_BOX}, f AS (SELECT id AS post_id FROM posts_once WHERE repost_of_id IS NOT NULL OR id % 10 = 0), j AS (SELECT box.*, f.post_id IS NOT NULL AND event_type = 'post.assigned' AS hit FROM box LEFT JOIN f USING (post_id))
SELECT id, CASE WHEN hit THEN 'superseded' ELSE delivery_status END AS delivery_status, CASE WHEN hit THEN 'folded_repost' ELSE last_error END AS last_error FROM j""")
def outbox_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Reposts, and every tenth post taken as one, lose their assignment events."""
    folded = posts(spark, d, "repost_of_id").where("repost_of_id is not null or id % 10 = 0").select(F.col("id").alias("post_id"))
    return outbox.supersede(box(spark, d), folded).select("id", "delivery_status", "last_error")


@query(f"WITH {_BOX} SELECT id, CASE delivery_status WHEN 'failed' THEN 'pending' ELSE delivery_status END AS delivery_status, CASE delivery_status WHEN 'failed' THEN 0 ELSE attempts END AS attempts, CASE delivery_status WHEN 'failed' THEN {T} ELSE available_at END AS available_at FROM box")
def outbox_retried(spark: SparkSession, d: str) -> DataFrame:
    return outbox.retry_failed(box(spark, d), AS_OF).select("id", "delivery_status", "attempts", "available_at")


@query(f"""WITH {_BOX}, c AS (SELECT id FROM box WHERE available_at <= {T} AND (delivery_status = 'pending' OR (delivery_status = 'leased' AND lease_until < {T})) ORDER BY id LIMIT 50),
 j AS (SELECT box.id, delivery_status, attempts + CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS attempts, c.id IS NOT NULL AS told, c.id % 4 AS k FROM box LEFT JOIN c ON c.id = box.id)
SELECT id, CASE WHEN NOT told THEN delivery_status WHEN k = 0 THEN 'pending' WHEN k = 1 THEN 'delivered' WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS delivery_status, CAST(CASE WHEN told AND k = 0 THEN attempts - 1 ELSE attempts END AS INTEGER) AS attempts FROM j""")
def outbox_dispatched(spark: SparkSession, d: str) -> DataFrame:
    """A claim of fifty rows (the batch of a delivery): a quarter is not tried, a quarter delivered, the others fail."""
    claimed = cut(outbox.claim(box(spark, d), AS_OF, 50))
    before = box(spark, d).select("id", F.col("attempts").alias("was"))
    mine = claimed.join(before, "id").where("attempts > was").select("id")
    k = F.col("id") % 4
    outcomes = mine.select("id", F.when(k == 1, True).when(k > 1, False).alias("ok"), F.when(k > 1, "HTTP 500").alias("error"))
    return outbox.settle(claimed, outcomes, AS_OF).select("id", "delivery_status", "attempts")


# Policy


_HIST = "hist AS (SELECT id, CASE status WHEN 'merged' THEN 'applied' ELSE 'proposed' END AS status FROM hub_merges)"
_REG = "reg AS (SELECT s_suppkey AS id, s_name AS model_version, CASE s_nationkey % 3 WHEN 0 THEN 'promoted' WHEN 1 THEN 'candidate' ELSE 'retired' END AS status, CASE WHEN s_nationkey % 2 = 0 THEN TIMESTAMP '2026-03-01' + to_days(s_nationkey) END AS promoted_at FROM supplier)"


def registry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_nationkey")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("model_version"), F.lit("x").alias("adapter_path"), (F.col("s_acctbal") / 10_000).alias("precision"), F.lit(0.9).alias("recall"), F.lit(0.01).alias("noise"),
        F.when(k % 3 == 0, "promoted").when(k % 3 == 1, "candidate").otherwise("retired").alias("status"), F.when(k % 2 == 0, F.lit("2026-03-01").cast("timestamp") + F.make_dt_interval(days=k)).alias("promoted_at"))


@query(f"WITH {_HIST}, {_REG} SELECT 'policy-v' || (count(*) + 1) AS policy_version, (SELECT model_version FROM reg WHERE status = 'promoted' ORDER BY promoted_at DESC NULLS LAST, id DESC LIMIT 1) AS model_version FROM hist WHERE status = 'applied'")
def current_versions(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "hub_merges").select("id", F.when(F.col("status") == "merged", "applied").otherwise("proposed").alias("status"))
    return policy.current_versions(history, registry(spark, d))


@query(f"WITH {_REG} SELECT id, CASE WHEN id = 7 THEN 'promoted' WHEN status = 'promoted' THEN 'retired' ELSE status END AS status FROM reg")
def promoted_models(spark: SparkSession, d: str) -> DataFrame:
    return policy.promote(registry(spark, d), "Supplier#000000007", "y", 0.97, 0.9, 0.01, AS_OF).select("id", "status")


@query("SELECT count(*) FILTER (WHERE status = 'assigned') AS assigned_now, count(*) FILTER (WHERE status = 'assigned' AND similarity < 0.7) AS would_flip_down, count(*) FILTER (WHERE status = 'candidate' AND similarity >= 0.55) AS would_flip_up, (SELECT count(*) FILTER (WHERE status = 'candidate' AND similarity >= 0.7) FROM assignment_decision_log) AS up_at_70 FROM assignment_decision_log")
def threshold_flips(spark: SparkSession, d: str) -> DataFrame:
    """Assigned decisions that fall below 0.7, and candidates that rise above 0.55 and 0.7."""
    s, kind = F.col("similarity"), F.col("status")
    return decisions(spark, d).agg(F.count_if(kind == "assigned").alias("assigned_now"), F.count_if((kind == "assigned") & (s < 0.7)).alias("would_flip_down"), F.count_if((kind == "candidate") & (s >= 0.55)).alias("would_flip_up"), F.count_if((kind == "candidate") & (s >= 0.7)).alias("up_at_70"))


@query("SELECT threshold_used, greatest(coalesce(threshold_used, 0.62), 0.62) AS effective, count(*) AS n FROM assignment_decision_log GROUP BY 1, 2")
def effective_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).groupBy("threshold_used", policy.effective_threshold(F.col("threshold_used"), 0.62).alias("effective")).agg(F.count("*").alias("n"))


# Roll-ups and pages


_ROLL = """roll AS (SELECT date_trunc('hour', created_at) AS window_start, date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end, coalesce(policy_version, 'unknown') AS policy_version, coalesce(model_version, 'unknown') AS model_version, 'human' AS source,
  count(*) AS total, count(*) FILTER (WHERE feedback_type = 'user_confirmed') AS confirmed, count(*) FILTER (WHERE feedback_type = 'user_removed') AS removed, count(*) FILTER (WHERE feedback_type = 'user_dismissed') AS dismissed, confirmed / nullif(confirmed + removed, 0) AS precision, NULL::DOUBLE AS coverage, removed / nullif(confirmed + removed, 0) AS unlink_rate, NULL::DOUBLE AS drift FROM clustering_feedback_log GROUP BY 1, 2, 3, 4
 UNION ALL SELECT date_trunc('hour', created_at), date_trunc('hour', created_at) + INTERVAL 1 HOUR, coalesce(policy_version, 'unknown'), coalesce(model_version, 'unknown'), 'system', count(*), 0, 0, 0, NULL, count(*) FILTER (WHERE status = 'assigned') / count(*), NULL, NULL FROM assignment_decision_log GROUP BY 1, 2, 3, 4)"""


def rollups(spark: SparkSession, d: str) -> DataFrame:
    from tideloom.operators import quality

    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    end = (F.col("window_start") + F.expr("INTERVAL 1 HOUR")).alias("window_end")
    human = quality.human_rollup(table(spark, d, "clustering_feedback_log")).select("window_start", end, "policy_version", "model_version", F.lit("human").alias("source"), "total", "confirmed", "removed", "dismissed", "precision", none.alias("coverage"), "unlink_rate", none.alias("drift"))
    system = quality.system_rollup(decisions(spark, d)).select("window_start", end, "policy_version", "model_version", F.lit("system").alias("source"), "total", zero.alias("confirmed"), zero.alias("removed"), zero.alias("dismissed"), none.alias("precision"), "coverage", none.alias("unlink_rate"), none.alias("drift"))
    return human.unionByName(system)


@query(f"WITH {_ROLL} SELECT window_start, source, policy_version, model_version, CASE WHEN source = 'human' THEN total + 1 ELSE total END AS total FROM roll")
def upserted_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Human roll-ups written again with one decision more replace those of the same five keys."""
    rows = cut(rollups(spark, d))
    again = rows.where("source = 'human'").withColumn("total", F.col("total") + 1)
    return policy.upsert_rollup(rows, again).select("window_start", "source", "policy_version", "model_version", "total")


@query(f"WITH {_ROLL}, w AS (SELECT window_end, min(window_start) AS window_start FROM roll GROUP BY 1 ORDER BY 1 DESC LIMIT 14) SELECT count(*) AS rows, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(coalesce(sum(confirmed), 0) AS BIGINT) AS confirmed, CAST(coalesce(sum(removed), 0) AS BIGINT) AS removed, CAST(coalesce(sum(dismissed), 0) AS BIGINT) AS dismissed, round(avg(precision), 6) AS precision, round(avg(coverage), 6) AS coverage, round(avg(unlink_rate), 6) AS unlink_rate, avg(drift) AS drift FROM roll JOIN w USING (window_start, window_end)")
def quality_page(spark: SparkSession, d: str) -> DataFrame:
    page = pages.quality_page(rollups(spark, d))
    return page.select("rows", "total", "confirmed", "removed", "dismissed", *[F.round(c, 6).alias(c) for c in ("precision", "coverage", "unlink_rate")], "drift")


@query(f"WITH {_ROLL}, w AS (SELECT window_end, min(window_start) AS window_start FROM roll WHERE source = 'human' GROUP BY 1 ORDER BY 1 DESC LIMIT 5), r AS (SELECT roll.* FROM roll JOIN w USING (window_start, window_end) WHERE source = 'human') SELECT row_number() OVER (ORDER BY precision DESC NULLS LAST, window_end, policy_version, model_version) AS place, window_end, policy_version, model_version, precision FROM r")
def quality_rows(spark: SparkSession, d: str) -> DataFrame:
    """The human roll-ups of the five latest windows by precision, unknown last."""
    from pyspark.sql import Window

    rows = pages.latest_windows(rollups(spark, d), 5, "human")
    place = F.row_number().over(Window.orderBy(pages.ordered("precision_desc", pages.QUALITY_ORDERS, "window"), "window_end", "policy_version", "model_version"))  # five windows
    return rows.select(place.cast("long").alias("place"), "window_end", "policy_version", "model_version", "precision")


@query(f"""{WITH}, pg AS (SELECT *, row_number() OVER (ORDER BY similarity DESC NULLS LAST, id DESC) AS place FROM assignment_decision_log WHERE created_at >= {T} - INTERVAL 168 HOUR AND status = 'assigned' ORDER BY place LIMIT 100 OFFSET 20)
SELECT place - 20 AS place, pg.id, CASE WHEN length(p.content) > 0 THEN CASE WHEN length(f) <= 84 THEN f ELSE rtrim(substr(f, 1, 83)) || '…' END END AS content_preview, CASE WHEN pg.event_id IS NOT NULL THEN CASE WHEN length(coalesce(h.title, '')) = 0 THEN 'hub-' || pg.event_id WHEN length(h.title) <= 84 THEN h.title ELSE rtrim(substr(h.title, 1, 83)) || '…' END END AS label, count(*) OVER () = 100 AS has_more
FROM pg LEFT JOIN (SELECT id, content, trim(regexp_replace(content, '{WS}+', ' ', 'g')) AS f FROM posts_once) p ON p.id = pg.post_id LEFT JOIN hubs_once h ON h.id = pg.event_id""")
def decision_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a week's assigned decisions by similarity, with references (a page has a hundred rows)."""
    rows = pages.decision_filter(decisions(spark, d), AS_OF, "7d", status="assigned")
    page = pages.decision_page(rows, posts(spark, d, "content", "user_id", "platform", "assignment_status", "event_id"), hubs(spark, d), 500, 20, "sim_desc")
    return page.select("place", "id", "content_preview", "label", "has_more")


@query(f"SELECT status, count(*) AS n FROM assignment_decision_log WHERE created_at >= {T} - INTERVAL 24 HOUR GROUP BY 1")
def decision_stats(spark: SparkSession, d: str) -> DataFrame:
    return pages.decision_filter(decisions(spark, d), AS_OF, "24h", status="whatever").groupBy("status").agg(F.count("*").alias("n"))


@query(f"""{WITH}, {_BOX}, {_ROLL} SELECT (SELECT count(*) FROM box WHERE delivery_status = 'failed') AS failed, (SELECT count(*) FROM box WHERE delivery_status = 'leased' AND lease_until >= {T}) AS leased, count(*) FILTER (WHERE assignment_status = 'processing' AND assignment_updated_at < {T} - INTERVAL 5 MINUTE) AS stuck,
 count(*) FILTER (WHERE assignment_status = 'pending' AND assignment_updated_at < {T} - INTERVAL 15 MINUTE) AS stalled, (SELECT max(window_end) FROM roll WHERE source = 'human') AS last_rollup, (SELECT max(window_end) FROM roll WHERE source = 'human') >= {T} - INTERVAL 2 HOUR AS fresh FROM posts_once""")
def operations_page(spark: SparkSession, d: str) -> DataFrame:
    return pages.operations_page(box(spark, d), posts(spark, d, "assignment_status", "assignment_updated_at"), rollups(spark, d), AS_OF)


_LOG = "log AS (SELECT id, actor, CASE feedback_type WHEN 'auto_confirmed' THEN 'ops.confirm' WHEN 'user_confirmed' THEN 'hub.confirm' ELSE 'hub.remove' END AS action, CASE WHEN event_id % 2 = 0 THEN 'posts' ELSE 'hub_merges' END AS entity_type, CAST(post_id AS VARCHAR) AS entity_id, '{\"hub\": ' || coalesce(CAST(event_id AS VARCHAR), 'null') || '}' AS before_state, '{}' AS after_state, created_at FROM clustering_feedback_log)"


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("feedback_type") == "auto_confirmed", "ops.confirm").when(F.col("feedback_type") == "user_confirmed", "hub.confirm").otherwise("hub.remove")
    return table(spark, d, "clustering_feedback_log").select("id", "actor", action.alias("action"), F.when(F.col("event_id") % 2 == 0, "posts").otherwise("hub_merges").alias("entity_type"), F.col("post_id").cast("string").alias("entity_id"),
        F.concat(F.lit('{"hub": '), F.coalesce(F.col("event_id").cast("string"), F.lit("null")), F.lit("}")).alias("before_state"), F.lit("{}").alias("after_state"), "created_at")


@query(f"""WITH {_LOG}, f AS (SELECT * FROM log WHERE created_at >= {T} - INTERVAL 168 HOUR AND split_part(action, '.', 1) = 'hub' AND (action ILIKE '%desk_a%' OR actor ILIKE '%desk_a%' OR coalesce(entity_id, '') ILIKE '%desk_a%' OR before_state ILIKE '%desk_a%' OR after_state ILIKE '%desk_a%'))
SELECT id, actor, action, (SELECT count(*) FROM f) AS matches FROM f ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 2""")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a week on hubs that match a pattern with a wildcard (a page has fifty rows)."""
    rows = pages.audit_filter(audit_log(spark, d), AS_OF, domain="hub", window="nonsense", query=" desk_a ")
    return pages.audit_page(rows, 50, 2).select("id", "actor", "action", "matches")


@query(f"WITH {_LOG} SELECT count(*) AS total, count(DISTINCT actor) AS actors, count(DISTINCT entity_type) AS entities, count(*) FILTER (WHERE created_at >= {T} - INTERVAL 24 HOUR) AS recent FROM log")
def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    return pages.audit_stats(audit_log(spark, d), AS_OF)


@query(f"WITH {_LOG} SELECT DISTINCT 'actor' AS kind, actor AS value FROM log WHERE actor IS NOT NULL UNION ALL SELECT DISTINCT 'domain', split_part(action, '.', 1) FROM log UNION ALL SELECT DISTINCT 'entity', entity_type FROM log")
def audit_options(spark: SparkSession, d: str) -> DataFrame:
    return pages.audit_options(audit_log(spark, d))


# Hub views and references


_CHRONO = f"(SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at, id) AS r FROM posts_once WHERE {OWN} AND event_id IS NOT NULL"


@query(f"{WITH} SELECT event_id AS hub_id, r AS place, id AS post_id FROM {_CHRONO} AND has_media) WHERE r <= 100")
def hub_media(spark: SparkSession, d: str) -> DataFrame:
    return pages.hub_media(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at", "has_media"))


@query(f"{WITH} SELECT event_id AS hub_id, id AS post_id FROM {_CHRONO}) WHERE r = 1")
def hub_anchors(spark: SparkSession, d: str) -> DataFrame:
    return pages.hub_anchor(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at"))


_CAT = f"cat AS (SELECT h.id AS hub_id, coalesce(s.id, f.id) AS catalyst_id FROM hubs_once h LEFT JOIN posts_once s ON s.id = h.seed_post_id AND s.deleted_at IS NULL LEFT JOIN (SELECT event_id, id FROM {_CHRONO}) WHERE r = 1) f ON f.event_id = h.id)"


def _catalysts(spark: SparkSession, d: str) -> DataFrame:
    return read_models.hub_catalysts(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at"), hubs(spark, d))


@query(f"{WITH}, {_CAT}, p AS (SELECT p.event_id, p.id, row_number() OVER (PARTITION BY p.event_id ORDER BY engagement_score DESC NULLS LAST, created_at, p.id) AS r FROM posts_once p LEFT JOIN cat ON cat.hub_id = p.event_id WHERE {OWN} AND p.event_id IS NOT NULL AND (catalyst_id IS NULL OR p.id <> catalyst_id)) SELECT event_id AS hub_id, r AS rank, id AS post_id FROM p WHERE r <= 20")
def hub_perspectives(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at", "engagement_score")
    return pages.hub_perspectives(p, _catalysts(spark, d))


@query(f"""{WITH}, {_CAT}, w AS (SELECT id, id AS cur, 0 AS n FROM hubs_once UNION ALL SELECT w.id, h.merged_into_id, w.n + 1 FROM w JOIN hubs_once h ON h.id = w.cur WHERE w.n < 5 AND NOT coalesce(h.is_active, false) AND h.merged_into_id IS NOT NULL),
 c AS (SELECT id, arg_max(cur, n) AS cur FROM w GROUP BY 1), a AS (SELECT event_id, count(*) FILTER (WHERE repost_of_id IS NULL) AS posts, count(*) FILTER (WHERE repost_of_id IS NOT NULL) AS reposts, count(DISTINCT user_id) AS voices FROM posts_once WHERE {LIVE} AND event_id IS NOT NULL GROUP BY 1)
SELECT c.id AS requested_id, c.cur AS hub_id, c.cur <> c.id AS redirected, CASE WHEN length(coalesce(h.title, '')) = 0 THEN 'hub-' || h.id WHEN length(h.title) <= 84 THEN h.title ELSE rtrim(substr(h.title, 1, 83)) || '…' END AS label, coalesce(h.status, 'active') AS status, h.member_count, coalesce(posts, 0) AS total_posts, coalesce(a.reposts, 0) AS reposts,
 CASE WHEN coalesce(voices, 0) = 0 THEN least(coalesce(posts, 0), 50) ELSE voices END AS voices, catalyst_id, coalesce(posts, 0) > 50 AS has_more FROM c JOIN hubs_once h ON h.id = c.cur LEFT JOIN a ON a.event_id = c.cur LEFT JOIN cat ON cat.hub_id = c.cur""")
def hub_views(spark: SparkSession, d: str) -> DataFrame:
    """The view of every hub that may be asked for."""
    h = hubs(spark, d)
    return pages.hub_views(h.select(F.col("id").alias("hub_id")), posts(spark, d, "event_id", "deleted_at", "repost_of_id", "user_id"), h, _catalysts(spark, d))


@query(f"{WITH}, ids AS (SELECT DISTINCT post_id FROM assignment_decision_log WHERE post_id IS NOT NULL UNION SELECT -5) SELECT ids.post_id, CASE WHEN p.id IS NULL THEN 'not_found' ELSE assignment_status END AS status, platform, CASE WHEN length(content) > 0 THEN length(CASE WHEN length(f) <= 84 THEN f ELSE rtrim(substr(f, 1, 83)) || '…' END) END AS chars FROM ids LEFT JOIN (SELECT *, trim(regexp_replace(content, '{WS}+', ' ', 'g')) AS f FROM posts_once) p ON p.id = ids.post_id")
def post_references(spark: SparkSession, d: str) -> DataFrame:
    ids = decisions(spark, d).where("post_id is not null").select("post_id").union(spark.range(1).select(F.lit(-5).cast("long")))
    rows = pages.post_references(ids, posts(spark, d, "content", "user_id", "platform", "assignment_status", "event_id"))
    return rows.select("post_id", "status", "platform", F.length("content_preview").cast("long").alias("chars"))


@query(f"{WITH}, ids AS (SELECT DISTINCT event_id FROM posts_once WHERE event_id IS NOT NULL) SELECT ids.event_id, CASE WHEN h.id IS NULL THEN 'not_found' ELSE coalesce(h.status, 'active') END AS status, CASE WHEN length(coalesce(h.title, '')) = 0 THEN 'hub-' || ids.event_id WHEN length(h.title) <= 84 THEN h.title ELSE rtrim(substr(h.title, 1, 83)) || '…' END AS label, CASE WHEN h.id IS NOT NULL THEN coalesce(discourse_type, 'event') END AS discourse_type FROM ids LEFT JOIN hubs_once h ON h.id = ids.event_id")
def hub_references(spark: SparkSession, d: str) -> DataFrame:
    ids = posts(spark, d, "event_id").where("event_id is not null").select("event_id")
    return pages.hub_references(ids, hubs(spark, d)).select("event_id", "status", "label", "discourse_type")


@query(f"{WITH}, f AS (SELECT event_id, r, CASE WHEN length(content) > 0 THEN trim(regexp_replace(content, '{WS}+', ' ', 'g')) END AS f FROM {_CHRONO}) WHERE r <= 4), g AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY r) AS k, CASE WHEN length(f) <= 84 THEN f ELSE rtrim(substr(f, 1, 83)) || '…' END AS p FROM f WHERE f IS NOT NULL) SELECT event_id, count(*) AS n, string_agg(p, chr(10) ORDER BY k) AS previews FROM g WHERE k <= 3 GROUP BY 1")
def member_previews(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.member_previews(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at", "content"), 3)
    return rows.select("event_id", F.size("previews").cast("long").alias("n"), F.array_join("previews", "\n").alias("previews"))


@query(f"{WITH}, hit AS (SELECT id, event_id FROM posts_once WHERE lower(content) LIKE '%ferry%') SELECT id, title, member_count FROM hubs_once h WHERE is_active AND (lower(title) LIKE '%ferry%' OR lower(handle) LIKE '%ferry%' OR seed_post_id IN (SELECT id FROM hit) OR id IN (SELECT event_id FROM hit)) ORDER BY member_count DESC NULLS LAST, id LIMIT 20")
def hub_cards(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest active hubs about a ferry (a search shows so many)."""
    return pages.search_hub_cards(hubs(spark, d), posts(spark, d, "content", "event_id"), "Ferry")


@query(f"{WITH}, t AS (SELECT event_id, id FROM (SELECT event_id, id, row_number() OVER (PARTITION BY event_id ORDER BY created_at, id) AS r FROM posts_once WHERE {OWN} AND event_id IS NOT NULL) WHERE r = 1) SELECT h.id AS hub_id, CASE WHEN p.id IS NULL OR length(coalesce(p.content, '')) = 0 THEN 'hub' WHEN length(f) <= 84 THEN f ELSE rtrim(substr(f, 1, 83)) || '…' END AS title FROM hubs_once h LEFT JOIN (SELECT id, content, trim(regexp_replace(content, '{WS}+', ' ', 'g')) AS f FROM posts_once WHERE {LIVE}) p ON p.id = h.seed_post_id")
def seed_titles(spark: SparkSession, d: str) -> DataFrame:
    seeds = posts(spark, d, "content", "deleted_at").where("deleted_at is null").select(F.col("id").alias("seed_post_id"), "content")
    rows = hubs(spark, d).select(F.col("id").alias("hub_id"), "seed_post_id").join(seeds, "seed_post_id", "left")
    return rows.select("hub_id", F.coalesce(tx.preview(F.col("content")), F.lit("hub")).alias("title"))


# Consumers, admins, point reads


_CONS = "cons AS (SELECT c_custkey AS id, 'c' || c_custkey AS consumer_id, c_name AS name, sha256(c_name) AS token_hash, c_nationkey % 5 > 0 AS is_active, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END AS rate_limit_per_minute, CASE WHEN c_nationkey % 3 > 0 THEN TIMESTAMP '2026-03-14 23:58:00' + to_seconds(c_custkey % 200) END AS last_used_at FROM customer)"


def consumers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_nationkey")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("consumer_id"), F.col("c_name").alias("name"), pages.token_hash(F.col("c_name")).alias("token_hash"), (k % 5 > 0).alias("is_active"),
        F.when(k % 2 == 0, k).alias("rate_limit_per_minute"), F.when(k % 3 > 0, F.lit("2026-03-14 23:58:00").cast("timestamp") + F.make_dt_interval(secs=(F.col("c_custkey") % 200).cast("double"))).alias("last_used_at"))


@query(f"WITH {_CONS}, asked AS (SELECT DISTINCT sha256('Customer#' || lpad(CAST(event_id % 300 AS VARCHAR), 9, '0')) AS h FROM events) SELECT consumer_id, is_active AND h IS NOT NULL AS answered, CASE WHEN is_active AND h IS NOT NULL AND (last_used_at IS NULL OR last_used_at <= {T} - INTERVAL 60 SECOND) THEN {T} ELSE last_used_at END AS last_used_at FROM cons LEFT JOIN asked ON h = token_hash")
def authenticated_consumers(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.concat(F.lit("Customer#"), F.lpad((F.col("event_id") % 300).cast("string"), 9, "0")).alias("token"))
    found, after = pages.authenticated(consumers(spark, d), calls, AS_OF)
    return after.select("consumer_id", "last_used_at").join(found.select("consumer_id", F.lit(True).alias("answered")), "consumer_id", "left").select("consumer_id", F.coalesce("answered", F.lit(False)).alias("answered"), "last_used_at")


@query("SELECT event_id AS id, row_number() OVER (PARTITION BY user_id % 5, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def rate_limited_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("consumer"), F.col("ts").cast("timestamp").alias("ts"))
    return pages.rate_limited(calls, "consumer", "ts", F.lit(1)).select("id", "allowed")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%r#_____004_%' OR c_mktsegment ILIKE '%r#_____004_%'")
def listed_admins(spark: SparkSession, d: str) -> DataFrame:
    return pages.listed(table(spark, d, "customer"), "r#_____004_", ["c_name", "c_mktsegment"], "c_custkey").select("c_custkey", "c_name")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS active, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS enrolled FROM customer")
def admin_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("enrolled"))


@query(f"{WITH} SELECT CAST(p.id AS VARCHAR) AS event_key, p.platform, d.status, d.similarity FROM posts_once p LEFT JOIN assignment_decision_log d ON d.post_id = p.id WHERE p.source_id LIKE 'legacy%' OR p.source_id LIKE 'signal-%'")
def audited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Posts of sources with a prefix and all their decisions, keys as text."""
    rows = posts(spark, d, "platform", "source_id").where(F.col("source_id").startswith("legacy") | F.col("source_id").startswith("signal-"))
    found = rows.join(decisions(spark, d).select(F.col("post_id").alias("id"), "status", "similarity"), "id", "left")
    return found.select(F.col("id").cast("string").alias("event_key"), "platform", "status", "similarity")


@query(f"{WITH}, h AS (SELECT min(event_id) AS hub FROM posts_once WHERE event_id IN (SELECT id FROM hubs_once WHERE len(centroid) = {DIM})), c AS (SELECT centroid FROM hubs_once, h WHERE id = hub) SELECT p.id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(centroid AS DOUBLE[])), 6) AS similarity FROM posts_once p, h, c WHERE p.event_id = hub AND len(embedding) = {DIM} AND list_aggregate(embedding, 'max') > 0")
def centroid_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The posts of one hub against its centroid: a point read joined to one row."""
    from tideloom.functions import vectors as vx

    usable = hubs(spark, d).where(F.size("centroid") == DIM)
    p = posts(spark, d, "event_id", "embedding")
    least = p.join(usable.select(F.col("id").alias("event_id")), "event_id", "left_semi").agg(F.min("event_id").alias("event_id"))
    one = usable.select(F.col("id").alias("event_id"), "centroid").join(F.broadcast(least), "event_id")
    rows = p.where(F.size("embedding") == DIM).join(F.broadcast(one), "event_id")
    return rows.select("id", F.round(vx.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity")).where("similarity is not null")


@query(f"""{WITH}, l AS (SELECT id, ground_truth AS t, event_id AS f FROM posts_once) SELECT count(*) AS posts, count(f) AS assigned, (SELECT count(*) FROM hubs_once) AS hubs, round(count(*) FILTER (WHERE f IS NOT NULL AND t IS NOT NULL) / greatest(count(t), 1), 6) AS recall, round(count(*) FILTER (WHERE f IS NOT NULL AND t IS NOT NULL) / greatest(count(f), 1), 6) AS precision, count(*) FILTER (WHERE f IS NOT NULL AND t IS NULL) AS noise_assigned FROM l""")
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    t, f = F.col("ground_truth").isNotNull(), F.col("event_id").isNotNull()
    both = F.count_if(t & f)
    rows = posts(spark, d, "ground_truth", "event_id").agg(F.count("*").alias("posts"), F.count_if(f).alias("assigned"), both.alias("b"), F.count_if(t).alias("e"), F.count_if(f & ~t).alias("noise_assigned"))
    n = hubs(spark, d).agg(F.count("*").alias("hubs"))
    return rows.crossJoin(n).select("posts", "assigned", "hubs", F.round(F.col("b") / F.greatest("e", F.lit(1)), 6).alias("recall"), F.round(F.col("b") / F.greatest("assigned", F.lit(1)), 6).alias("precision"), "noise_assigned")


@query(f"{WITH}, g AS (SELECT ground_truth AS t, count(DISTINCT event_id) AS n, count(*) FILTER (WHERE event_id IS NULL) AS lost FROM posts_once WHERE ground_truth IS NOT NULL GROUP BY 1) SELECT count(*) AS labels, count(*) FILTER (WHERE n > 1) AS fragmented, CAST(sum(lost) AS BIGINT) AS unclustered, (SELECT count(DISTINCT event_id) FROM posts_once WHERE ground_truth IS NULL AND event_id IS NOT NULL) AS hubs_with_noise FROM g")
def fragmentation(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d, "ground_truth", "event_id")
    g = p.where("ground_truth is not null").groupBy("ground_truth").agg(F.count_distinct("event_id").alias("n"), F.count_if(F.col("event_id").isNull()).alias("lost"))
    noisy = p.where("ground_truth is null and event_id is not null").agg(F.count_distinct("event_id").alias("hubs_with_noise"))
    return g.agg(F.count("*").alias("labels"), F.count_if(F.col("n") > 1).alias("fragmented"), F.sum("lost").alias("unclustered")).crossJoin(noisy)


@query(f"{WITH}, t AS (SELECT event_id FROM posts_once WHERE {OWN} AND event_id IS NOT NULL AND content_sig <> 0 GROUP BY event_id, content_sig HAVING count(*) > 1 UNION SELECT event_id FROM posts_once WHERE {OWN} AND event_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1 HAVING count(*) BETWEEN 2 AND 400) SELECT event_id FROM t ORDER BY 1 LIMIT 500")
def fold_targets(spark: SparkSession, d: str) -> DataFrame:
    """The next five hundred hubs worth folding, exact or near (the limit is the pass)."""
    from tideloom.operators import folding

    p = posts(spark, d, "event_id", "deleted_at", "repost_of_id", "content_sig", "embedding")
    return folding.foldable_hubs(p).union(folding.near_duplicate_hubs(p).select("event_id")).distinct().orderBy("event_id").limit(500)


@query(f"""{WITH}, n AS (SELECT id, content_sig, sha256(trim(regexp_replace(regexp_replace(lower(coalesce(content, '')), 'https?://[^\\s\\x{{a0}}\\x{{3000}}]+|www\\.[^\\s\\x{{a0}}\\x{{3000}}]+', '', 'g'), '{WS}+', ' ', 'g'))) AS h FROM posts_once)
SELECT id, CASE WHEN content_sig = 0 THEN greatest(1, CAST((CAST('0x' || substr(h, 1, 8) AS UBIGINT) & 2147483647) * 4294967296 + CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS BIGINT)) ELSE content_sig END AS content_sig FROM n""")
def backfilled_signatures(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d, "content", "content_sig").select("id", F.when(F.col("content_sig") == 0, tx.content_signature(F.col("content"))).otherwise(F.col("content_sig")).alias("content_sig"))


@query(f"{WITH} SELECT event_id, id AS seed_id FROM (SELECT event_id, id, row_number() OVER (PARTITION BY event_id ORDER BY engagement_score DESC NULLS LAST, created_at, id) AS r FROM posts_once WHERE {OWN} AND event_id IS NOT NULL) WHERE r = 1")
def hub_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The post a hub would be born with: the most engaging, then the earliest."""
    rows = canonical(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at", "engagement_score")).where("event_id is not null")
    best = rows.groupBy("event_id").agg(F.min(F.struct((-F.coalesce(F.col("engagement_score").cast("long"), F.lit(-(1 << 40)))).alias("e"), "created_at", "id")).alias("b"))
    return best.select("event_id", F.col("b.id").alias("seed_id"))
