"""Queries for the relational, text, vector and graph operators, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions import text as tx
from tideloom.functions import vectors as vx
from tideloom.operators import birth, corrections, folding, ledger, matching, merging, quality
from tideloom.plans import read_models
from tideloom.runtime import cut, first_delivery, latest_hub, table

DIM = 384
AS_OF = "2026-03-15 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_P = "posts_once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at) AS rn FROM posts) WHERE rn = 1)"
_H = "hubs_once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_updated_at DESC) AS rn FROM event_hubs) WHERE rn = 1)"
WITH = f"WITH RECURSIVE {_P}, {_H}"
LIVE = "deleted_at IS NULL"
OWN = "deleted_at IS NULL AND repost_of_id IS NULL"
#: White space as Python splits it, for DuckDB's regular expressions.
WS = r"[\s\x1c-\x1f\x85\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{a0}\x{1680}]"
RANGES = r"[\x{1F300}-\x{1FAFF}\x{1F000}-\x{1F02F}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]+"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def posts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "posts")
    return first_delivery(rows.select(*dict.fromkeys(["id", "received_at", *columns])) if columns else rows)


def hubs(spark: SparkSession, d: str) -> DataFrame:
    return latest_hub(table(spark, d, "event_hubs"))


# Text


@query(f"""{WITH}, n AS (SELECT id, sha256(trim(regexp_replace(regexp_replace(lower(coalesce(content, '')), 'https?://[^\\s\\x{{a0}}\\x{{3000}}]+|www\\.[^\\s\\x{{a0}}\\x{{3000}}]+', '', 'g'), '{WS}+', ' ', 'g'))) AS h FROM posts_once)
SELECT id, CASE WHEN sig = 0 THEN 1 ELSE sig END AS sig FROM (SELECT id, CAST((CAST('0x' || substr(h, 1, 8) AS UBIGINT) & 2147483647) * 4294967296 + CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS BIGINT) AS sig FROM n)""")
def content_signatures(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d, "content").select("id", tx.content_signature(F.col("content")).alias("sig"))


@query(f"""{WITH} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, 'https?://[^\\s\\x{{a0}}\\x{{3000}}]+|www\\.[^\\s\\x{{a0}}\\x{{3000}}]+', '', 'g'), '@[\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\x1c-\\x1f\\x85\\x{{a0}}\\x{{3000}}\\x{{2000}}-\\x{{200a}}\\x{{200c}}\\x{{200d}}]', '', 'g'), '{WS}+', ' ', 'g')) AS clean FROM posts_once WHERE content IS NOT NULL""")
def cleansed_texts(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d, "content").where("content is not null").select("id", tx.cleanse(F.col("content")).alias("clean"))


@query(f"""{WITH}, t AS (SELECT id, trim(regexp_replace(regexp_replace(coalesce(content, ''), '{RANGES}', ' ', 'g'), '{WS}+', ' ', 'g')) AS b, regexp_replace(coalesce(content, ''), '^{WS}+|{WS}+$', '', 'g') AS raw FROM posts_once),
w AS (SELECT id, raw, lower(b) AS low, CASE WHEN b = '' THEN 0 ELSE len(string_split(b, ' ')) END AS n FROM t),
f AS (SELECT *, len(regexp_extract_all(' ' || regexp_replace(low, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '  ', 'g') || ' ', ' (?:i|me|my|myself|im) ')) AS me FROM w)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN raw = '' THEN 'empty_text' WHEN n < 7 THEN 'too_short'
 WHEN regexp_matches(low, '\\b(?:lol|lmao|selfie|fitcheck|feeling cute|hmu|dm me|bored af|good morning yall|gm everyone)\\b') THEN 'chatter_marker'
 WHEN me >= 3 AND me / n > 0.22 THEN 'personal_diary' ELSE 'passed' END AS reason FROM f) GROUP BY 1""")
def gate_prechecks(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d, "content").select(F.coalesce(tx.gate_precheck(F.col("content")), F.lit("passed")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""{WITH}, t AS (SELECT id, trim(regexp_replace(content, '{WS}+', ' ', 'g')) AS f FROM posts_once WHERE length(content) > 0)
SELECT id, CASE WHEN length(f) <= 84 THEN f ELSE rtrim(substr(f, 1, 83)) || '…' END AS preview FROM t""")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d, "content").where("length(content) > 0").select("id", tx.preview(F.col("content")).alias("preview"))


@query(f"""{WITH}, s AS (SELECT id, regexp_replace(substr(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), '-+$', '') AS s FROM hubs_once), b AS (SELECT id, CASE WHEN s = '' THEN 'hub-' || CAST(id AS VARCHAR) ELSE s END AS h FROM s),
t AS (SELECT regexp_extract(h, '^(.*)-([1-9][0-9]{{0,8}})$', 1) AS h, list(DISTINCT CAST(regexp_extract(h, '^(.*)-([1-9][0-9]{{0,8}})$', 2) AS BIGINT)) AS ks FROM b WHERE regexp_matches(h, '-[1-9][0-9]{{0,8}}$') GROUP BY 1),
r AS (SELECT id, b.h, row_number() OVER (PARTITION BY b.h ORDER BY id) AS n, coalesce(ks, []) AS ks FROM b LEFT JOIN t ON t.h = b.h)
SELECT id, CASE WHEN n = 1 THEN h ELSE h || '-' || CAST(list_filter(range(2, n + len(ks) + 2), lambda x: NOT list_contains(ks, x))[n - 1] AS VARCHAR) END AS handle FROM r""")
def hub_handles(spark: SparkSession, d: str) -> DataFrame:
    """Handles from titles, numbered from -2 within one base, distinct over all."""
    base = hubs(spark, d).select("id", tx.slug(F.col("title"), F.concat(F.lit("hub-"), F.col("id").cast("string"))).alias("base"))
    return ledger.numbered_names(base, "id", "base").select("id", "handle")


_TOKENS = f"""tokens AS (SELECT DISTINCT id, event_id, deleted_at, split_part(e, ':', 1) || ':' || v AS token FROM (SELECT id, event_id, deleted_at, e, lower(trim(substr(e, strpos(e, ':') + 1))) AS v FROM (SELECT id, event_id, deleted_at, unnest(entities) AS e FROM posts_once))
 WHERE e LIKE '%:%' AND split_part(e, ':', 1) IN ('ORG', 'PRODUCT', 'NORP', 'PERSON') AND regexp_matches(v, '\\p{{L}}')
 AND NOT list_has_any(string_split_regex(v, '\\s+'), {list(tx.GENERIC_HEADS)}))"""


@query(f"{WITH}, {_TOKENS} SELECT id, token FROM tokens")
def identity_tokens(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d, "entities").select("id", F.explode(tx.identity_tokens(F.col("entities"))).alias("token"))


@query(f"{WITH}, {_TOKENS} SELECT event_id, count(DISTINCT token) AS n_tokens, min(token) AS first_token FROM tokens WHERE {LIVE} AND event_id IS NOT NULL GROUP BY 1")
def hub_identities(spark: SparkSession, d: str) -> DataFrame:
    rows = matching.hub_identity(posts(spark, d, "entities", "event_id", "deleted_at"))
    return rows.select("event_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_min("tokens").alias("first_token"))


# Scans, filters, counts


@query(f"{WITH} SELECT assignment_status, count(*) AS n FROM posts_once GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d, "assignment_status").groupBy("assignment_status").agg(F.count("*").alias("n"))


@query(f"""{WITH} SELECT count(*) FILTER (WHERE assignment_status = 'pending') AS pending, count(*) FILTER (WHERE assignment_status = 'pending' AND received_at < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE) AS stuck,
 count(*) FILTER (WHERE deleted_at IS NOT NULL) AS deleted, count(*) FILTER (WHERE embedding IS NOT NULL) AS embedded, count(DISTINCT user_id) AS users FROM posts_once""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d, "assignment_status", "deleted_at", "embedding", "user_id")
    old = F.col("received_at") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 5 MINUTES")
    pending = F.col("assignment_status") == "pending"
    return rows.agg(F.count_if(pending).alias("pending"), F.count_if(pending & old).alias("stuck"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"), F.count_distinct("user_id").alias("users"))


@query(f"{WITH} SELECT id FROM hubs_once WHERE is_active AND centroid IS NOT NULL AND last_updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR")
def fresh_hubs(spark: SparkSession, d: str) -> DataFrame:
    return matching.fresh_hubs(hubs(spark, d).withColumn("last_updated_at", F.col("last_updated_at")), F.lit(AS_OF).cast("timestamp")).select("id")


@query(f"{WITH} SELECT id FROM posts_once WHERE assignment_status IN ('pending', 'unassigned', 'candidate') AND {LIVE} AND received_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def aged_posts(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d, "assignment_status", "deleted_at")
    return rows.where(F.col("assignment_status").isin("pending", "unassigned", "candidate") & F.col("deleted_at").isNull() & (F.col("received_at") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 24 HOURS"))).select("id")


@query(f"""SELECT source_id, external_post_id, id, engagement_score FROM (SELECT *, row_number() OVER (PARTITION BY source_id, external_post_id ORDER BY received_at DESC, id DESC, engagement_score DESC) AS rn FROM posts WHERE external_post_id IS NOT NULL) WHERE rn = 1""")
def latest_deliveries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "posts").where("external_post_id is not null").select("source_id", "external_post_id", "id", "received_at", "engagement_score")
    return ledger.latest(rows, ["source_id", "external_post_id"], [F.desc("received_at"), F.desc("id"), F.desc("engagement_score")]).drop("received_at")


@query("""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, engagement_score DESC) AS rn FROM posts) WHERE rn = 1),
 first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, engagement_score) AS rn FROM posts) WHERE rn = 1)
SELECT f.id, CASE WHEN f.deleted_at IS NULL THEN l.engagement_score ELSE f.engagement_score END AS engagement_score, CASE WHEN f.deleted_at IS NULL THEN coalesce(l.published_at, f.published_at) ELSE f.published_at END AS published_at, f.deleted_at FROM first f JOIN last l ON f.id = l.id""")
def upserted_posts(spark: SparkSession, d: str) -> DataFrame:
    """First deliveries as the stored state, all deliveries written over them, tombstones kept."""
    rows = table(spark, d, "posts").select("id", "received_at", "engagement_score", "published_at", "deleted_at")
    stored = ledger.latest(rows, ["id"], [F.col("received_at"), F.col("engagement_score")]).select("id", "engagement_score", "published_at", "deleted_at")
    return ledger.upsert(stored, rows.select("id", "engagement_score", "published_at", "received_at"), ["id"], [F.desc("received_at"), F.desc("engagement_score")], keep_old=["published_at"])


@query(f"{WITH} SELECT id FROM posts_once p WHERE NOT EXISTS (SELECT 1 FROM assignment_decision_log l WHERE l.post_id = p.id)")
def undecided_posts(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d, "user_id").join(table(spark, d, "assignment_decision_log").select(F.col("post_id").alias("id")), "id", "left_anti").select("id")


@query(f"{WITH} SELECT event_id, count(*) AS n FROM posts_once WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT id FROM hubs_once) GROUP BY 1 UNION ALL SELECT -1, count(*) FROM (SELECT id FROM hubs_once EXCEPT SELECT event_id FROM posts_once)")
def stray_references(spark: SparkSession, d: str) -> DataFrame:
    """Hub ids that posts name but that do not exist, and at -1 the number of hubs without posts."""
    p, h = posts(spark, d, "event_id").where("event_id is not null"), hubs(spark, d).select(F.col("id").alias("event_id"))
    stray = p.join(h, "event_id", "left_anti").groupBy("event_id").agg(F.count("*").alias("n"))
    return stray.union(h.join(p, "event_id", "left_anti").agg(F.lit(-1).cast("long").alias("event_id"), F.count("*").alias("n")))


# Folding and counts


@query(f"{WITH} SELECT event_id, count(*) FILTER (WHERE repost_of_id IS NULL) AS member_count, count(*) FILTER (WHERE repost_of_id IS NOT NULL) AS repost_count FROM posts_once WHERE {LIVE} AND event_id IS NOT NULL GROUP BY 1")
def hub_counts(spark: SparkSession, d: str) -> DataFrame:
    return folding.hub_counts(posts(spark, d, "event_id", "deleted_at", "repost_of_id"))


@query(f"""{WITH}, c AS (SELECT event_id, count(*) FILTER (WHERE repost_of_id IS NULL) AS m, count(*) FILTER (WHERE repost_of_id IS NOT NULL) AS r FROM posts_once WHERE {LIVE} AND event_id IS NOT NULL GROUP BY 1)
SELECT h.id AS event_id, c.m AS member_count, c.r AS repost_count FROM hubs_once h JOIN c ON h.id = c.event_id WHERE h.member_count IS DISTINCT FROM c.m OR h.repost_count IS DISTINCT FROM c.r""")
def drifted_counts(spark: SparkSession, d: str) -> DataFrame:
    return folding.drifted_counts(posts(spark, d, "event_id", "deleted_at", "repost_of_id"), hubs(spark, d)).select("event_id", "member_count", "repost_count")


@query(f"{WITH} SELECT DISTINCT event_id FROM (SELECT event_id, content_sig FROM posts_once WHERE {OWN} AND event_id IS NOT NULL AND content_sig <> 0 GROUP BY 1, 2 HAVING count(*) > 1)")
def foldable_hubs(spark: SparkSession, d: str) -> DataFrame:
    return folding.foldable_hubs(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "content_sig"))


@query(f"{WITH} SELECT event_id, count(*) AS n FROM posts_once WHERE {OWN} AND event_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1 HAVING count(*) BETWEEN 2 AND 400")
def near_duplicate_hubs(spark: SparkSession, d: str) -> DataFrame:
    return folding.near_duplicate_hubs(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "embedding"))


@query(f"""{WITH}, own AS (SELECT id, event_id, content_sig FROM posts_once WHERE {OWN} AND event_id IS NOT NULL AND content_sig <> 0),
 tgt AS (SELECT r.repost_of_id AS id, r.event_id, r.content_sig FROM posts_once r JOIN posts_once c ON c.id = r.repost_of_id AND c.event_id = r.event_id AND c.deleted_at IS NULL AND c.repost_of_id IS NULL WHERE r.deleted_at IS NULL AND r.event_id IS NOT NULL AND r.content_sig <> 0),
 keep AS (SELECT event_id, content_sig, min(id) AS keep_id FROM (SELECT * FROM own UNION SELECT * FROM (SELECT id, event_id, content_sig FROM tgt)) GROUP BY 1, 2)
SELECT own.id, keep_id FROM own JOIN keep USING (event_id, content_sig) WHERE own.id <> keep_id""")
def exact_fold(spark: SparkSession, d: str) -> DataFrame:
    return folding.exact_fold(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "content_sig"))


@query(f"""{WITH}, hop AS (SELECT id, id AS cur, 0 AS n FROM posts_once WHERE repost_of_id IS NOT NULL UNION ALL SELECT h.id, p.repost_of_id, h.n + 1 FROM hop h JOIN posts_once p ON p.id = h.cur WHERE p.repost_of_id IS NOT NULL AND h.n < 40)
SELECT id, cur AS repost_of_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS rn FROM hop) WHERE rn = 1""")
def flat_reposts(spark: SparkSession, d: str) -> DataFrame:
    return folding.flatten_reposts(posts(spark, d, "repost_of_id"))


def _usable(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return posts(spark, d, "embedding", "event_id", "deleted_at", "repost_of_id", *columns).where(F.size("embedding") == DIM)


_COS = "list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))"
_VECS = f"vecs AS (SELECT id, event_id, embedding AS v FROM posts_once WHERE {OWN} AND len(embedding) = {DIM} AND list_aggregate(embedding, 'max') > 0)"


@query(f"{WITH}, {_VECS} SELECT a.id AS src, b.id AS dst FROM vecs a JOIN vecs b ON a.event_id = b.event_id AND a.id < b.id WHERE {_COS} >= 0.98")
def near_duplicate_links(spark: SparkSession, d: str) -> DataFrame:
    return folding.near_duplicate_links(folding.canonical(_usable(spark, d)), DIM).select("src", "dst")


@query(f"""{WITH}, {_VECS}, l AS (SELECT a.id AS u, b.id AS w FROM vecs a JOIN vecs b ON a.event_id = b.event_id AND a.id <> b.id WHERE {_COS} >= 0.98),
 reach AS (SELECT DISTINCT u AS root, u AS node FROM l UNION SELECT r.root, l.w FROM reach r JOIN l ON l.u = r.node), low AS (SELECT node AS id, min(root) AS keep_id FROM reach GROUP BY 1) SELECT id, keep_id FROM low WHERE id <> keep_id""")
def near_duplicate_fold(spark: SparkSession, d: str) -> DataFrame:
    return folding.near_duplicate_fold(folding.near_duplicate_links(folding.canonical(_usable(spark, d)), DIM))


_FLAT = f"""keepers AS (SELECT own.id, keep_id FROM (SELECT id, event_id, content_sig FROM posts_once WHERE {OWN} AND event_id IS NOT NULL AND content_sig <> 0) own JOIN (SELECT event_id, content_sig, min(id) AS keep_id FROM (SELECT id, event_id, content_sig FROM posts_once WHERE {OWN} AND event_id IS NOT NULL AND content_sig <> 0
 UNION SELECT r.repost_of_id, r.event_id, r.content_sig FROM posts_once r JOIN posts_once c ON c.id = r.repost_of_id AND c.event_id = r.event_id AND c.deleted_at IS NULL AND c.repost_of_id IS NULL WHERE r.deleted_at IS NULL AND r.event_id IS NOT NULL AND r.content_sig <> 0) GROUP BY 1, 2) k USING (event_id, content_sig) WHERE own.id <> keep_id),
 folded AS (SELECT p.id, coalesce(keep_id, repost_of_id) AS o, CASE WHEN keep_id IS NULL THEN assignment_status ELSE 'repost' END AS st FROM posts_once p LEFT JOIN keepers k ON k.id = p.id),
 walk AS (SELECT id, o, 1 AS n FROM folded WHERE o IS NOT NULL UNION ALL SELECT w.id, f.o, w.n + 1 FROM walk w JOIN folded f ON f.id = w.o WHERE f.o IS NOT NULL AND w.n < 40)"""


@query(f"{WITH}, {_FLAT} SELECT f.id, st AS assignment_status, w.o AS repost_of_id FROM folded f LEFT JOIN (SELECT id, arg_max(o, n) AS o FROM walk GROUP BY 1) w ON w.id = f.id")
def folded_posts(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies folded in every hub, chains of reposts led to their last original."""
    return folding.fold_hubs(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "content_sig", "assignment_status")).select("id", "assignment_status", "repost_of_id")


@query()
def folded_near_copies(spark: SparkSession, d: str) -> DataFrame:
    """Exact and near copies folded; the near ones in hubs of 2 to 400 canonicals."""
    return folding.fold_hubs(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "content_sig", "assignment_status", "embedding"), DIM).where("repost_of_id is not null").select("id", "repost_of_id")


# Matching


_BEST = f"""hv AS (SELECT id, centroid AS v FROM hubs_once WHERE len(centroid) = {DIM} AND is_active), pv AS (SELECT id, CASE WHEN len(embedding) = {DIM} THEN embedding END AS v FROM posts_once),
 sims AS (SELECT a.id AS post_id, b.id AS hub_id, {_COS} AS s FROM pv a JOIN hv b ON a.v IS NOT NULL), good AS (SELECT * FROM sims WHERE s IS NOT NULL AND NOT isnan(s)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY round(s, 12) DESC, hub_id) AS r FROM good),
 best AS (SELECT p.id AS post_id, x.hub_id AS event_id, x.s AS sim, y.hub_id AS runner_id, y.s AS runner_sim FROM posts_once p LEFT JOIN ranked x ON x.post_id = p.id AND x.r = 1 LEFT JOIN ranked y ON y.post_id = p.id AND y.r = 2)"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    live = hubs(spark, d).where("is_active")
    return matching.match_top2(posts(spark, d, "embedding"), live, DIM)


@query(f"{WITH}, {_BEST} SELECT post_id, event_id, round(sim, 6) AS sim, runner_id, round(runner_sim, 6) AS runner_sim FROM best")
def match_top2(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("post_id", "event_id", F.round("sim", 6).alias("sim"), "runner_id", F.round("runner_sim", 6).alias("runner_sim"))


@query(f"""{WITH}, {_BEST} SELECT post_id, CASE WHEN sim IS NULL THEN 'unassigned' WHEN sim >= 0.62 AND (runner_sim IS NULL OR sim - runner_sim >= 0.05) THEN 'assigned' WHEN sim >= 0.45 THEN 'candidate' ELSE 'unassigned' END AS status, round(sim - coalesce(runner_sim, 0.62), 4) AS margin FROM best""")
def decide_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = _matches(spark, d)
    sim, runner = F.col("sim"), F.col("runner_sim")
    return rows.select("post_id", matching.decision(sim, runner).alias("status"), matching.margin(sim, runner).alias("margin"))


# Vectors


@query(f"""{WITH}, e AS (SELECT event_id, unnest(range(1, {DIM + 1})) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM posts_once WHERE {OWN} AND event_id IS NOT NULL AND len(embedding) = {DIM})
SELECT event_id, i, n, round(m, 6) + 0.0 AS mean FROM (SELECT event_id, CAST(i AS INTEGER) AS i, count(*) AS n, avg(x) AS m FROM e GROUP BY 1, 2)""")
def hub_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of every hub's mean vector."""
    rows = folding.canonical(_usable(spark, d)).where("event_id is not null")
    sums = vx.vector_sums(rows, "event_id", "embedding", DIM)
    return sums.select("event_id", "n", F.posexplode("sums").alias("p", "s")).select("event_id", (F.col("p") + 1).alias("i"), "n", (F.round(F.col("s") / F.col("n"), 6) + 0.0).alias("mean"))


@query(f"""{WITH}, {_VECS}, u AS (SELECT event_id, unnest(range(1, {DIM + 1})) AS i, unnest(list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))))) AS x FROM vecs WHERE event_id IS NOT NULL)
SELECT event_id, round(sum(s * s) / (max(n) * max(n)), 6) AS cohesion FROM (SELECT event_id, i, count(*) AS n, sum(x) AS s FROM u GROUP BY 1, 2) GROUP BY 1""")
def hub_cohesion(spark: SparkSession, d: str) -> DataFrame:
    rows = folding.canonical(_usable(spark, d)).where("event_id is not null")
    return birth.cohesion(rows, "event_id", "embedding", DIM).select("event_id", F.round("cohesion", 6).alias("cohesion"))


@query(f"""{WITH}, m AS (SELECT event_id AS id, i, count(*) AS k, sum(x) AS s FROM (SELECT event_id, unnest(range(1, {DIM + 1})) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM posts_once WHERE {OWN} AND event_id IS NOT NULL AND len(embedding) = {DIM} AND assignment_confidence >= 0.68) GROUP BY 1, 2),
 h AS (SELECT h.id, h.member_count, s.embedding AS seed, unnest(range(1, {DIM + 1})) AS i, unnest(CAST(centroid AS DOUBLE[])) AS c, unnest(CASE WHEN len(s.embedding) = {DIM} THEN CAST(s.embedding AS DOUBLE[]) ELSE list_transform(range(1, {DIM + 1}), lambda x: NULL::DOUBLE) END) AS a FROM hubs_once h LEFT JOIN posts_once s ON s.id = h.seed_post_id WHERE len(centroid) = {DIM}),
 r AS (SELECT id, i, c, k, a, (c * w + s) / (w + k) AS roll FROM (SELECT *, least(CASE WHEN coalesce(member_count, 0) = 0 THEN 1 ELSE member_count END, 150) AS w FROM h JOIN m USING (id, i))),
 n AS (SELECT id, i, c, k, CASE WHEN a IS NULL THEN roll ELSE 0.35 * a + 0.65 * roll END AS v FROM r)
SELECT id, max(k) AS added, round(sum(c * v) / (sqrt(sum(c * c)) * sqrt(sum(v * v))), 6) AS kept, round(sum(v * (i % 7)) / sqrt(sum(v * v)), 3) AS weighted FROM n GROUP BY 1""")
def moved_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Rolling centroids of the hubs after their confident members, blended with the seed post's vector: how near they
    stay to the old ones, and a weighted sum of their entries."""
    rows = _usable(spark, d, "assignment_confidence").where("event_id is not null and assignment_confidence >= 0.68 and repost_of_id is null and deleted_at is null")
    added = vx.vector_sums(rows, "event_id", "embedding", DIM).withColumnsRenamed({"event_id": "id", "n": "added"})
    seeds = _usable(spark, d).select(F.col("id").alias("seed_post_id"), F.col("embedding").alias("anchor"))
    h = hubs(spark, d).select("id", "centroid", "member_count", "seed_post_id").where(f"size(centroid) = {DIM}").join(added, "id").join(seeds, "seed_post_id", "left")
    rolled = h.withColumn("rolled", vx.rolling("centroid", "member_count", "sums", "added"))
    new = rolled.withColumn("new", F.when(F.col("anchor").isNotNull(), vx.blend("anchor", "rolled")).otherwise(vx.normalize("rolled")))
    sevens = F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda i: (i % 7).cast("double"))
    return new.select("id", "added", F.round(vx.cosine(F.col("centroid"), F.col("new")), 6).alias("kept"), F.round(vx.dot(F.col("new"), sevens), 3).alias("weighted"))


@query(f"{WITH} SELECT id, coalesce(len(embedding), 0) AS n, CASE WHEN len(embedding) > 0 THEN round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * (i % 5))), 6) END AS weighted FROM posts_once")
def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through their text and binary forms and back: sizes and a weighted sum of the entries."""
    back = posts(spark, d, "embedding").select("id", vx.from_text(vx.to_text(vx.from_binary(vx.to_binary("embedding")))).alias("v"))
    return back.select("id", F.size("v").cast("long").alias("n"), F.when(F.size("v") > 0, F.round(F.aggregate(F.transform("v", lambda x, i: x * ((i + 1) % 5)), F.lit(0.0), lambda s, x: s + x), 6)).alias("weighted"))


# Birth


def _buffer(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d, "embedding", "created_at", "deleted_at", "assignment_status", "entities")
    return rows.where(F.col("assignment_status").isin("pending", "unassigned", "candidate") & F.col("deleted_at").isNull() & (F.size("embedding") == DIM))


@query(f"""{WITH}, b AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS n FROM posts_once WHERE assignment_status IN ('pending', 'unassigned', 'candidate') AND {LIVE} AND len(embedding) = {DIM}),
 walk AS (SELECT id, created_at, n, created_at AS opened, 0 AS s FROM b WHERE n = 1 UNION ALL SELECT b.id, b.created_at, b.n, CASE WHEN b.created_at - w.opened > INTERVAL 1 HOUR THEN b.created_at ELSE w.opened END, CASE WHEN b.created_at - w.opened > INTERVAL 1 HOUR THEN w.s + 1 ELSE w.s END FROM walk w JOIN b ON b.n = w.n + 1)
SELECT id, CAST(s AS BIGINT) AS slice_id FROM walk""")
def temporal_slices(spark: SparkSession, d: str) -> DataFrame:
    return birth.temporal_slices(_buffer(spark, d)).select("id", "slice_id")


_SLICED = f"""b AS (SELECT id, created_at, embedding AS v, row_number() OVER (ORDER BY created_at, id) AS n FROM posts_once WHERE assignment_status IN ('pending', 'unassigned', 'candidate') AND {LIVE} AND len(embedding) = {DIM}),
 walk AS (SELECT id, created_at, n, created_at AS opened, 0 AS s FROM b WHERE n = 1 UNION ALL SELECT b.id, b.created_at, b.n, CASE WHEN b.created_at - w.opened > INTERVAL 24 HOUR THEN b.created_at ELSE w.opened END, CASE WHEN b.created_at - w.opened > INTERVAL 24 HOUR THEN w.s + 1 ELSE w.s END FROM walk w JOIN b ON b.n = w.n + 1),
 sl AS (SELECT b.id, b.created_at, s, v FROM b JOIN walk USING (id)), sims AS (SELECT a.id AS x, b.id AS y, {_COS} AS sim, abs(epoch_us(a.created_at) - epoch_us(b.created_at)) / 3.6e9 AS h FROM sl a JOIN sl b ON a.s = b.s AND a.id <> b.id),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(sim, 12) DESC, y) AS r FROM sims WHERE NOT isnan(sim)) WHERE r <= 4),
 edges AS (SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst, sim * exp(-ln(2) * h / 12) AS weight FROM top WHERE sim >= 0.45)"""


@query(f"{WITH}, {_SLICED} SELECT DISTINCT src, dst, round(weight, 6) AS weight FROM edges WHERE weight >= 0.45")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return birth.knn_graph(birth.temporal_slices(_buffer(spark, d), hours=24.0)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return birth.communities(birth.knn_graph(birth.temporal_slices(_buffer(spark, d), hours=24.0)), min_size=2)


@query()
def split_communities(spark: SparkSession, d: str) -> DataFrame:
    b = _buffer(spark, d)
    found = birth.communities(birth.knn_graph(birth.temporal_slices(b, hours=24.0)), min_size=2)
    extra = b.select("id", tx.identity_tokens(F.col("entities")).alias("tokens"), F.col("embedding").alias("v"))
    return birth.split_communities(found.join(extra, "id"), DIM)


@query()
def born_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Hubs that all posts with a vector would give birth to, slice by slice of an hour, with the operator's own limits."""
    p = folding.canonical(_usable(spark, d, "created_at", "entities", "user_id", "external_author_id", "engagement_score"))
    sliced = cut(birth.temporal_slices(p))
    found = birth.communities(birth.knn_graph(sliced))
    threads = birth.split_communities(found.join(p.select("id", tx.identity_tokens(F.col("entities")).alias("tokens"), F.col("embedding").alias("v")), "id"), DIM)
    author = F.coalesce("external_author_id", F.col("user_id").cast("string"))
    born, _ = birth.born_hubs(threads, p.select("id", author.alias("author"), "engagement_score", "created_at", F.col("embedding").alias("v")), DIM)
    return born.select("hub", "n", "authors", F.round("cohesion", 6).alias("cohesion"), "seed_id")


# Merging


@query(f"""{WITH}, w AS (SELECT id, id AS cur, 0 AS n FROM hubs_once UNION ALL SELECT w.id, h.merged_into_id, w.n + 1 FROM w JOIN hubs_once h ON h.id = w.cur WHERE w.n < 5 AND NOT coalesce(h.is_active, false) AND h.merged_into_id IS NOT NULL)
SELECT id, cur AS canonical_id, cur <> id AS redirected FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS rn FROM w) WHERE rn = 1""")
def canonical_hubs(spark: SparkSession, d: str) -> DataFrame:
    return merging.canonical_hub(hubs(spark, d))


_DOMINANT = f"""live AS (SELECT id, event_id, entities FROM posts_once WHERE {LIVE} AND event_id IS NOT NULL), tot AS (SELECT event_id, count(*) AS total FROM live GROUP BY 1),
 sup AS (SELECT event_id, e, count(DISTINCT id) AS n FROM (SELECT id, event_id, unnest(entities) AS e FROM live) GROUP BY 1, 2),
 strong AS (SELECT event_id, split_part(e, ':', 1) AS label, lower(trim(substr(e, strpos(e, ':') + 1))) AS v FROM sup JOIN tot USING (event_id) WHERE n >= 2 AND n / total >= 0.5 AND e LIKE '%:%'),
 dom AS (SELECT DISTINCT event_id, label, v FROM strong WHERE label IN ('ORG', 'PRODUCT', 'NORP', 'PERSON') AND regexp_matches(v, '\\p{{L}}') AND NOT list_has_any(string_split_regex(v, '\\s+'), {list(tx.GENERIC_HEADS)}))"""


@query(f"{WITH}, {_DOMINANT} SELECT event_id, count(*) FILTER (WHERE label = 'ORG') AS orgs, count(*) AS identity FROM dom GROUP BY 1")
def dominant_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = merging.dominant_tokens(posts(spark, d, "entities", "event_id", "deleted_at"))
    return rows.where("size(identity) > 0").select("event_id", F.size("orgs").cast("long").alias("orgs"), F.size("identity").cast("long").alias("identity"))


_CAND = f"""hc AS (SELECT id, coalesce(member_count, 0) AS m, last_updated_at AS t, centroid AS v FROM hubs_once WHERE is_active AND len(centroid) = {DIM} AND list_aggregate(centroid, 'max') > 0),
 cand AS (SELECT CASE WHEN a.m >= b.m THEN a.id ELSE b.id END AS a, CASE WHEN a.m >= b.m THEN b.id ELSE a.id END AS b, {_COS} AS sim FROM hc a JOIN hc b ON a.id < b.id AND abs(epoch_us(a.t) - epoch_us(b.t)) <= 604800000000 WHERE {_COS} >= 0.45)"""


@query(f"{WITH}, {_CAND} SELECT a, b, round(sim, 6) AS sim FROM cand")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return merging.merge_candidates(hubs(spark, d), DIM, gap_hours=168.0).select("a", "b", F.round("sim", 6).alias("sim"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return merging.judged_pairs(merging.merge_candidates(hubs(spark, d), DIM, gap_hours=168.0), merging.dominant_tokens(posts(spark, d, "entities", "event_id", "deleted_at")))


@query(f"""{WITH}, {_DOMINANT}, {_CAND}, o AS (SELECT event_id, list(v) FILTER (WHERE label = 'ORG') AS orgs, list(label || ':' || v) AS ids FROM dom GROUP BY 1)
SELECT a, b, CASE WHEN len(coalesce(x.orgs, [])) > 0 AND len(coalesce(y.orgs, [])) > 0 AND NOT list_has_any(x.orgs, y.orgs) THEN 'dominant_org_conflict'
 WHEN len(coalesce(x.ids, [])) > 0 AND len(coalesce(y.ids, [])) > 0 THEN CASE WHEN list_has_any(x.ids, y.ids) THEN 'shared_identity' ELSE 'identity_divergent' END
 WHEN sim >= 0.72 THEN 'high_similarity' ELSE 'no_identity_evidence' END AS verdict FROM cand LEFT JOIN o x ON x.event_id = a LEFT JOIN o y ON y.event_id = b""")
def merge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("a", "b", "verdict")


@query()
def greedy_merges(spark: SparkSession, d: str) -> DataFrame:
    return merging.greedy_merges(cut(_judged(spark, d)).where("merge"), hubs(spark, d))


@query()
def fixpoint_merges(spark: SparkSession, d: str) -> DataFrame:
    """Merge passes over hubs of the last month until one finds nothing."""
    p = posts(spark, d, "entities", "event_id", "deleted_at", "assignment_status", "repost_of_id")
    return merging.merge_to_fixpoint(p, hubs(spark, d), DIM, "2026-03-28 00:00:00", fresh_hours=720.0, gap_hours=168.0)[2]


@query(f"{WITH} SELECT m.id, CASE WHEN len(a.centroid) = {DIM} AND len(b.centroid) = {DIM} THEN round(list_cosine_similarity(CAST(a.centroid AS DOUBLE[]), CAST(b.centroid AS DOUBLE[])), 3) ELSE 0.9 END AS score FROM hub_merges m LEFT JOIN hubs_once a ON a.id = source_event_id LEFT JOIN hubs_once b ON b.id = target_event_id")
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the two hubs of every merge; 0.9 where a centroid is missing."""
    side = lambda n: hubs(spark, d).select(F.col("id").alias(f"{n}_event_id"), F.when(F.size("centroid") == DIM, F.col("centroid")).alias(n))
    rows = table(spark, d, "hub_merges").join(side("source"), "source_event_id", "left").join(side("target"), "target_event_id", "left")
    return rows.select("id", F.coalesce(F.round(vx.cosine(F.col("source"), F.col("target")), 3), F.lit(0.9)).alias("score"))


_STOPS, _TICK = tuple(merging.CODENAME_STOP.split()), "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in merging.TICKERS.items()) + "}"


@query(f"""{WITH}, w AS (SELECT id, created_at, list_filter(string_split(replace(lower(CASE WHEN length(handle) > 0 THEN handle ELSE coalesce(title, '') END), '_', '-'), '-'), lambda x: x <> '') AS ws FROM hubs_once),
 k AS (SELECT id, created_at, CASE WHEN len(list_filter(ws, lambda x: x NOT IN {_STOPS})) > 0 THEN list_filter(ws, lambda x: x NOT IN {_STOPS}) ELSE ws END AS ks FROM w),
 r AS (SELECT *, coalesce({_TICK}[ks[1]], upper(substr(ks[1], 1, 6)), 'HUB' || id) AS root, list_filter(ks[2:], lambda x: length(x) <= 7 AND NOT regexp_matches(x, '^[0-9_.-]+$'))[1] AS suffix FROM k),
 c AS (SELECT id, created_at, substr(CASE WHEN length(root) < 6 AND suffix IS NOT NULL THEN root || '-' || upper(suffix) ELSE root END, 1, 17) AS code FROM r)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY created_at, id) > 1 THEN code || '-' || id ELSE code END AS codename FROM c""")
def codenames(spark: SparkSession, d: str) -> DataFrame:
    return merging.codenames(hubs(spark, d))


@query(f"{WITH} SELECT id AS src, nxt AS dst FROM (SELECT id, lead(id) OVER (ORDER BY created_at, id) AS nxt FROM hubs_once WHERE created_at IS NOT NULL) WHERE nxt IS NOT NULL")
def birth_edges(spark: SparkSession, d: str) -> DataFrame:
    return merging.birth_edges(hubs(spark, d))


@query(f"{WITH}, uh AS (SELECT DISTINCT user_id, event_id FROM posts_once WHERE {LIVE} AND event_id IS NOT NULL AND user_id IS NOT NULL) SELECT a.event_id AS src, b.event_id AS dst, count(*) AS users FROM uh a JOIN uh b ON a.user_id = b.user_id AND a.event_id < b.event_id GROUP BY 1, 2")
def voice_edges(spark: SparkSession, d: str) -> DataFrame:
    return merging.voice_edges(posts(spark, d, "user_id", "event_id", "deleted_at"))


@query(f"""{WITH}, hc AS (SELECT id, created_at, centroid AS v FROM hubs_once WHERE is_active AND len(centroid) = {DIM} AND list_aggregate(centroid, 'max') > 0),
 uh AS (SELECT DISTINCT user_id, event_id FROM posts_once WHERE {LIVE} AND event_id IS NOT NULL AND user_id IS NOT NULL),
 e AS (SELECT least(id, nxt) AS src, greatest(id, nxt) AS dst, 0 AS p, 'birth' AS kind, 1.0 AS w FROM (SELECT id, lead(id) OVER (ORDER BY created_at, id) AS nxt FROM hc) WHERE nxt IS NOT NULL
  UNION ALL SELECT a.id, b.id, 1, 'similar', {_COS} FROM hc a JOIN hc b ON a.id < b.id WHERE {_COS} >= 0.18
  UNION ALL SELECT a.event_id, b.event_id, 2, 'voice', count(*) FROM uh a JOIN uh b ON a.user_id = b.user_id AND a.event_id < b.event_id GROUP BY 1, 2)
SELECT src, dst, kind, round(greatest(0.05, least(1.0, w)), 3) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY p) AS r FROM e) WHERE r = 1""")
def hub_graph(spark: SparkSession, d: str) -> DataFrame:
    """The network of the active hubs with a centroid; voices also join others."""
    h = hubs(spark, d).where("is_active").where(F.size("centroid") == DIM).where(F.exists("centroid", lambda x: x > 0))
    similar = merging.merge_candidates(h, DIM, floor=0.18, gap_hours=None)
    return merging.hub_graph(merging.birth_edges(h), similar, merging.voice_edges(posts(spark, d, "user_id", "event_id", "deleted_at")))


# Quality


_V = "coalesce(policy_version, 'unknown') AS policy_version, coalesce(model_version, 'unknown') AS model_version"


@query(f"""SELECT date_trunc('hour', created_at) AS window_start, {_V}, count(*) AS total, count(*) FILTER (WHERE feedback_type = 'user_confirmed') AS confirmed, count(*) FILTER (WHERE feedback_type = 'user_removed') AS removed,
 count(*) FILTER (WHERE feedback_type = 'user_dismissed') AS dismissed, confirmed / nullif(confirmed + removed, 0) AS precision, removed / nullif(confirmed + removed, 0) AS unlink_rate FROM clustering_feedback_log GROUP BY 1, 2, 3""")
def human_rollup(spark: SparkSession, d: str) -> DataFrame:
    return quality.human_rollup(table(spark, d, "clustering_feedback_log"))


@query(f"SELECT date_trunc('hour', created_at) AS window_start, {_V}, count(*) AS total, count(*) FILTER (WHERE status = 'assigned') AS assigned, assigned / total AS coverage FROM assignment_decision_log GROUP BY 1, 2, 3")
def system_rollup(spark: SparkSession, d: str) -> DataFrame:
    return quality.system_rollup(table(spark, d, "assignment_decision_log"))


_LABELS = f"""labels AS (SELECT post_id, label, {_V} FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY created_at DESC, id DESC) AS rn FROM (SELECT *, CASE WHEN feedback_type IN ('user_confirmed', 'auto_confirmed') THEN 'good' WHEN feedback_type = 'user_removed' THEN 'bad' END AS label FROM clustering_feedback_log WHERE post_id IS NOT NULL) WHERE label IS NOT NULL) WHERE rn = 1),
 judged AS (SELECT l.*, d.similarity FROM labels l JOIN assignment_decision_log d ON d.post_id = l.post_id WHERE d.status = 'assigned' AND d.similarity IS NOT NULL)"""


@query(f"WITH {_LABELS} SELECT post_id, label FROM labels")
def latest_labels(spark: SparkSession, d: str) -> DataFrame:
    return quality.latest_labels(table(spark, d, "clustering_feedback_log")).select("post_id", "label")


@query(f"WITH {_LABELS} SELECT post_id, label FROM labels WHERE policy_version = 'v2' AND model_version = 'minilm-a'")
def labels_of_version(spark: SparkSession, d: str) -> DataFrame:
    return quality.labels_of(table(spark, d, "clustering_feedback_log"), "v2", "minilm-a")


@query("SELECT coalesce(avg(CASE WHEN similarity > runner_similarity THEN 1.0 ELSE 0.0 END), 1.0) AS precision, coalesce(avg(CASE WHEN similarity >= runner_similarity THEN 1.0 ELSE 0.0 END), 1.0) AS recall FROM assignment_decision_log WHERE similarity IS NOT NULL AND runner_similarity IS NOT NULL")
def pairwise_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "assignment_decision_log").where("similarity is not null and runner_similarity is not null")
    a = quality.pairwise_accuracy(rows, "similarity", "runner_similarity")
    return a.select("precision", "recall")


@query(f"WITH {_LABELS} SELECT policy_version, model_version, round(avg(similarity) FILTER (WHERE label = 'good') - avg(similarity) FILTER (WHERE label = 'bad'), 6) AS drift FROM judged GROUP BY 1, 2")
def drift_by_version(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.drift(table(spark, d, "clustering_feedback_log"), table(spark, d, "assignment_decision_log"))
    return rows.select("policy_version", "model_version", F.round("drift", 6).alias("drift"))


_CURVE = f"""{_LABELS}, ts AS (SELECT DISTINCT round(similarity, 4) AS t FROM judged), curve AS (SELECT t AS threshold, count(*) FILTER (WHERE label = 'good' AND similarity >= t) AS tp, count(*) FILTER (WHERE label = 'bad' AND similarity >= t) AS fp,
 tp / nullif(tp + fp, 0) AS precision, tp / nullif((SELECT count(*) FROM judged WHERE label = 'good'), 0) AS coverage FROM ts, judged GROUP BY 1)"""


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return quality.threshold_curve(quality.labelled(table(spark, d, "clustering_feedback_log"), table(spark, d, "assignment_decision_log")))


@query(f"WITH {_CURVE} SELECT threshold, tp, fp, precision, coverage FROM curve")
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d)


@query(f"WITH {_CURVE} SELECT threshold, tp, fp, precision, coverage FROM curve WHERE threshold >= 0.5 AND precision >= 0.8 AND coverage >= 0.3 ORDER BY precision DESC, coverage DESC, threshold LIMIT 1")
def pick_threshold(spark: SparkSession, d: str) -> DataFrame:
    return quality.pick_threshold(_curve(spark, d), 0.5, 0.8, 0.3)


@query("SELECT count(similarity) AS decided, count(*) FILTER (WHERE similarity >= 0.62 AND similarity < 0.7) AS falling, count(*) FILTER (WHERE similarity < 0.62 AND similarity >= 0.7) AS rising FROM assignment_decision_log")
def threshold_impact(spark: SparkSession, d: str) -> DataFrame:
    return quality.threshold_impact(table(spark, d, "assignment_decision_log"), 0.62, 0.7)


@query("""WITH once AS (SELECT DISTINCT ON (id) id, ground_truth AS t, event_id AS f FROM posts WHERE ground_truth IS NOT NULL AND event_id IS NOT NULL ORDER BY id, received_at),
 c AS (SELECT t, f, count(*)::DOUBLE AS n FROM once GROUP BY 1, 2), a AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS tp, sum(n * ln(n)) AS nlogn FROM c), x AS (SELECT sum(s * (s - 1) / 2) AS pt, sum(s * ln(s)) AS tlogt FROM (SELECT sum(n) AS s FROM c GROUP BY t)), y AS (SELECT sum(s * (s - 1) / 2) AS pf, sum(s * ln(s)) AS flogf, sum(b) AS pure FROM (SELECT sum(n) AS s, max(n) AS b FROM c GROUP BY f))
SELECT round(tp / pf, 6) AS precision, round(tp / pt, 6) AS recall, round(pure / n, 6) AS purity, round(2 * tp / (pf + pt), 6) AS f1, round(2 * (ln(n) + (nlogn - tlogt - flogf) / n) / ((ln(n) - tlogt / n) + (ln(n) - flogf / n)), 6) AS nmi, round((tp - pt * pf / (n * (n - 1) / 2)) / ((pt + pf) / 2 - pt * pf / (n * (n - 1) / 2)), 6) AS ari FROM a, x, y""")
def clustering_scores(spark: SparkSession, d: str) -> DataFrame:
    """The stored hubs against the ground truth."""
    rows = table(spark, d, "posts").where("ground_truth is not null and event_id is not null").groupBy("id").agg(F.min_by("ground_truth", "received_at").alias("t"), F.min_by("event_id", "received_at").alias("f"))
    s = quality.clustering_scores(rows, "t", "f")
    return s.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "purity", "nmi", "ari")])


# Journals and ledgers


@query("SELECT post_id, id, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY created_at DESC, id DESC) AS rn FROM assignment_decision_log WHERE status <> 'noise' AND post_id IS NOT NULL) WHERE rn = 1")
def last_decisions(spark: SparkSession, d: str) -> DataFrame:
    return read_models.last_decisions(table(spark, d, "assignment_decision_log")).select("post_id", "id", "status", "event_id")


@query("SELECT id, post_id, row_number() OVER (PARTITION BY post_id ORDER BY created_at, id) AS seq FROM assignment_decision_log")
def decision_sequences(spark: SparkSession, d: str) -> DataFrame:
    return ledger.sequenced(table(spark, d, "assignment_decision_log").select("id", "post_id", "created_at"), "post_id", [F.col("created_at"), F.col("id")]).select("id", "post_id", "seq")


_MEM = """adm AS (SELECT post_id, event_id AS hub_id, created_at AS t0, id FROM assignment_decision_log WHERE status = 'assigned' AND post_id IS NOT NULL AND created_at IS NOT NULL),
 chg AS (SELECT *, lag(t0) OVER w IS NULL OR hub_id IS DISTINCT FROM lag(hub_id) OVER w AS c FROM adm WINDOW w AS (PARTITION BY post_id ORDER BY t0, hub_id NULLS FIRST)),
 iv AS (SELECT post_id, hub_id, t0 AS admitted_at, lead(t0) OVER (PARTITION BY post_id ORDER BY t0, hub_id NULLS FIRST) AS departed_at FROM chg WHERE c)"""


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "assignment_decision_log").where("status = 'assigned'").select("post_id", F.col("event_id").alias("hub_id"), F.lit("member").alias("role"), F.col("created_at").alias("admitted_at"))
    return ledger.membership_intervals(rows)


@query(f"WITH {_MEM} SELECT * FROM iv WHERE hub_id IS NOT NULL")
def membership_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d).drop("role")


@query(f"WITH {_MEM} SELECT hub_id, count(*) AS n FROM iv WHERE hub_id IS NOT NULL AND admitted_at <= TIMESTAMP '{AS_OF}' AND (departed_at IS NULL OR departed_at > TIMESTAMP '{AS_OF}') GROUP BY 1")
def members_at(spark: SparkSession, d: str) -> DataFrame:
    return ledger.members_at(_intervals(spark, d), AS_OF).groupBy("hub_id").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT id, user_id, props AS after, lag(props) OVER (PARTITION BY user_id ORDER BY ts, id) AS before FROM (SELECT event_id AS id, user_id, ts, props FROM events)),
 k AS (SELECT id, before, after, unnest(list_distinct(list_concat(coalesce(json_keys(before), []), coalesce(json_keys(after), [])))) AS field FROM s)
SELECT id, field, CASE WHEN before IS NULL OR NOT list_contains(json_keys(before), field) THEN 'added' WHEN after IS NULL OR NOT list_contains(json_keys(after), field) THEN 'removed' ELSE 'changed' END AS change FROM k WHERE json_extract_string(before, '$.' || field) IS DISTINCT FROM json_extract_string(after, '$.' || field)""")
def state_changes(spark: SparkSession, d: str) -> DataFrame:
    """What each event changed in its user's properties."""
    from pyspark.sql import Window

    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"), F.col("props").alias("after"))
    return ledger.state_diff(rows, "id", "before", "after").select("id", "field", "change")


@query("""WITH o AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'leased' ELSE 'delivered' END AS st, CAST(event_id % 7 AS INTEGER) AS att, CASE WHEN event_type = 'click' THEN ts END AS lu, ts FROM events),
 s AS (SELECT *, CASE WHEN st IN ('pending', 'leased') AND att >= 5 AND (lu IS NULL OR lu <= TIMESTAMP '2024-01-15') THEN 'failed' ELSE st END AS st2 FROM o),
 r AS (SELECT id FROM s WHERE (st2 = 'pending' OR (st2 = 'leased' AND lu <= TIMESTAMP '2024-01-15')) AND ts <= TIMESTAMP '2024-01-15' ORDER BY id LIMIT 100)
SELECT CASE WHEN r.id IS NOT NULL THEN 'leased' ELSE st2 END AS delivery_status, count(*) AS n, CAST(sum(att + CASE WHEN r.id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS attempts FROM s LEFT JOIN r USING (id) GROUP BY 1""")
def outbox_lease(spark: SparkSession, d: str) -> DataFrame:
    """A claim of 100 rows on an outbox made of the event stream."""
    ts = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "leased").otherwise("delivered")
    box = table(spark, d, "events").select(F.col("event_id").alias("id"), status.alias("delivery_status"), (F.col("event_id") % 7).cast("int").alias("attempts"), F.lit(None).cast("string").alias("consumer"), F.lit(None).cast("string").alias("lease_token"), F.when(F.col("event_type") == "click", ts).alias("lease_until"), ts.alias("available_at"))
    after = ledger.lease(box, "2024-01-15 00:00:00", "default", "t1", 100)
    return after.groupBy("delivery_status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


# Read models


@query(f"""{WITH}, f AS (SELECT event_id, arg_min(id, (created_at, id)) AS first FROM posts_once WHERE {OWN} AND event_id IS NOT NULL GROUP BY 1)
SELECT h.id AS hub_id, coalesce(s.id, f.first) AS catalyst_id FROM hubs_once h LEFT JOIN posts_once s ON s.id = h.seed_post_id AND s.deleted_at IS NULL LEFT JOIN f ON f.event_id = h.id""")
def hub_catalysts(spark: SparkSession, d: str) -> DataFrame:
    return read_models.hub_catalysts(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at"), hubs(spark, d))


@query(f"{WITH} SELECT event_id AS hub_id, r AS rank, id AS post_id, engagement_score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY engagement_score DESC NULLS LAST, created_at, id) AS r FROM posts_once WHERE {OWN} AND event_id IS NOT NULL) WHERE r <= 3")
def hub_top_posts(spark: SparkSession, d: str) -> DataFrame:
    return read_models.hub_top_posts(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at", "engagement_score"))


@query(f"""{WITH}, a AS (SELECT event_id, count(*) AS live, count(*) FILTER (WHERE repost_of_id IS NULL) AS canonicals, count(*) FILTER (WHERE repost_of_id IS NULL AND has_media) AS media, count(DISTINCT user_id) AS voices, count(DISTINCT coalesce(external_author_id, CAST(user_id AS VARCHAR))) AS authors, min(created_at) AS first_at, max(created_at) AS last_at FROM posts_once WHERE {LIVE} AND event_id IS NOT NULL GROUP BY 1)
SELECT h.id AS hub_id, title, coalesce(live, 0) AS live, coalesce(canonicals, 0) AS canonicals, coalesce(media, 0) AS media, coalesce(voices, 0) AS voices, coalesce(authors, 0) AS authors, first_at, last_at FROM hubs_once h LEFT JOIN a ON a.event_id = h.id""")
def hub_summaries(spark: SparkSession, d: str) -> DataFrame:
    return read_models.hub_summary(posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at", "has_media", "user_id", "external_author_id"), hubs(spark, d))


@query(f"{WITH}, b AS (SELECT event_id AS h FROM posts_once WHERE {OWN} AND event_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id, created_at FROM posts_once, b WHERE event_id = h AND {OWN} ORDER BY created_at, id LIMIT 50 OFFSET 10")
def hub_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the largest hub's timeline."""
    p = posts(spark, d, "event_id", "deleted_at", "repost_of_id", "created_at")
    largest = folding.canonical(p).where("event_id is not null").groupBy("event_id").count().orderBy(F.desc("count"), "event_id").first()
    return read_models.hub_timeline(p, largest[0] if largest else -1, 50, 10).select("id", "created_at")


@query(f"{WITH} SELECT id, event_id FROM posts_once WHERE lower(content) LIKE '%bridge repair%' AND {LIVE}")
def search_posts(spark: SparkSession, d: str) -> DataFrame:
    return read_models.search_posts(posts(spark, d, "content", "event_id", "deleted_at"), "Bridge repair").select("id", "event_id")


@query(f"{WITH} SELECT id, title, handle FROM hubs_once h WHERE lower(title) LIKE '%ferry%' OR lower(handle) LIKE '%ferry%' OR EXISTS (SELECT 1 FROM posts_once p WHERE p.event_id = h.id AND p.deleted_at IS NULL AND lower(p.content) LIKE '%ferry%')")
def search_hubs(spark: SparkSession, d: str) -> DataFrame:
    return read_models.search_hubs(hubs(spark, d), posts(spark, d, "content", "event_id", "deleted_at"), "ferry")


@query(f"{WITH} SELECT m.id, source_event_id, s.title AS source_title, target_event_id, t.title AS target_title, m.status, initiated_by, CAST(snapshot_member_count AS BIGINT) AS snapshot_member_count FROM hub_merges m LEFT JOIN hubs_once s ON s.id = source_event_id LEFT JOIN hubs_once t ON t.id = target_event_id")
def merge_log(spark: SparkSession, d: str) -> DataFrame:
    return read_models.merge_log(table(spark, d, "hub_merges"), hubs(spark, d))


@query("SELECT count(*) AS merges, count(*) FILTER (WHERE status = 'reopened') AS reopened, CAST(coalesce(sum(snapshot_member_count) FILTER (WHERE status = 'merged'), 0) AS BIGINT) AS moved FROM hub_merges")
def merge_headline(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "hub_merges")
    return m.agg(F.count("*").alias("merges"), F.count_if(F.col("status") == "reopened").alias("reopened"), F.coalesce(F.sum(F.when(F.col("status") == "merged", F.col("snapshot_member_count"))), F.lit(0)).alias("moved"))


@query("SELECT feedback_type, count(*) AS n, count(DISTINCT actor) AS actors, count(DISTINCT split_part(actor, ':', 1)) AS kinds FROM clustering_feedback_log GROUP BY 1")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "clustering_feedback_log")
    return f.groupBy("feedback_type").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors"), F.count_distinct(F.split_part("actor", F.lit(":"), F.lit(1))).alias("kinds"))


@query(f"""{WITH}, t AS (SELECT id, event_id, content FROM posts_once WHERE content IS NOT NULL), j AS (SELECT DISTINCT post_id, event_id, feedback_type FROM clustering_feedback_log WHERE post_id IS NOT NULL AND event_id IS NOT NULL),
 rm AS (SELECT j.event_id, t.id, t.event_id AS now FROM j JOIN t ON t.id = j.post_id WHERE feedback_type = 'user_removed')
SELECT j.post_id, j.event_id, length(t.content) AS chars, coalesce((SELECT min(s.id) FROM t s WHERE s.event_id = j.event_id AND s.id <> j.post_id), j.post_id) AS positive_id, coalesce((SELECT min(rm.id) FROM rm WHERE rm.event_id = j.event_id), (SELECT min(rm.id) FROM rm WHERE rm.now <> j.event_id)) AS negative_id
FROM j JOIN t ON t.id = j.post_id WHERE feedback_type = 'user_confirmed'""")
def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = read_models.training_pairs(table(spark, d, "clustering_feedback_log"), posts(spark, d, "event_id", "content"))
    return rows.select("post_id", "event_id", F.length("anchor").cast("long").alias("chars"), "positive_id", "negative_id")


# Corrections


def _merge_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts, hubs and the pairs of the merge log that name one live target each and do not chain."""
    h = hubs(spark, d)
    log = table(spark, d, "hub_merges").where("status = 'merged' and source_event_id <> target_event_id")
    pairs = log.groupBy(F.col("source_event_id").alias("source_id")).agg(F.min("target_event_id").alias("target_id"))
    pairs = pairs.join(pairs.select(F.col("source_id").alias("target_id")), "target_id", "left_anti").join(h.select(F.col("id").alias("target_id")), "target_id", "left_semi").join(h.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return posts(spark, d, "event_id", "deleted_at", "assignment_status", "repost_of_id"), h, pairs.select("source_id", "target_id")


_PAIRS = """mp AS (SELECT source_event_id AS s, min(target_event_id) AS t FROM hub_merges WHERE status = 'merged' AND source_event_id <> target_event_id GROUP BY 1),
 pairs AS (SELECT s, t FROM mp WHERE t NOT IN (SELECT s FROM mp) AND t IN (SELECT id FROM hubs_once) AND s IN (SELECT id FROM hubs_once))"""


@query(f"{WITH}, {_PAIRS} SELECT coalesce(t, event_id) AS event_id, count(*) AS n FROM posts_once LEFT JOIN pairs ON s = event_id GROUP BY 1")
def merged_posts(spark: SparkSession, d: str) -> DataFrame:
    p, h, pairs = _merge_tables(spark, d)
    return corrections.apply_merges(p, h, pairs, AS_OF)[0].groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"""{WITH}, {_PAIRS}, g AS (SELECT t, CAST(sum(coalesce(member_count, 0)) AS BIGINT) AS more FROM pairs JOIN hubs_once ON id = s GROUP BY 1)
SELECT id, CASE WHEN p.t IS NULL THEN is_active ELSE false END AS is_active, coalesce(p.t, merged_into_id) AS merged_into_id, CASE WHEN g.t IS NULL THEN member_count ELSE coalesce(member_count, 0) + more END AS member_count FROM hubs_once LEFT JOIN pairs p ON p.s = id LEFT JOIN g ON g.t = id""")
def merged_hubs(spark: SparkSession, d: str) -> DataFrame:
    p, h, pairs = _merge_tables(spark, d)
    return corrections.apply_merges(p, h, pairs, AS_OF)[1].select("id", "is_active", "merged_into_id", "member_count")


@query(f"""{WITH}, f AS (SELECT DISTINCT post_id, event_id FROM clustering_feedback_log WHERE feedback_type = 'user_removed')
SELECT p.id, CASE WHEN f.post_id IS NULL THEN p.event_id END AS event_id, CASE WHEN f.post_id IS NULL THEN assignment_status ELSE 'candidate' END AS assignment_status FROM posts_once p LEFT JOIN f ON f.post_id = p.id AND f.event_id = p.event_id AND p.deleted_at IS NULL AND p.repost_of_id IS NULL""")
def unlinked_posts(spark: SparkSession, d: str) -> DataFrame:
    removed = table(spark, d, "clustering_feedback_log").where("feedback_type = 'user_removed'")
    return corrections.unlink(posts(spark, d, "event_id", "assignment_status", "deleted_at", "repost_of_id"), removed).select("id", "event_id", "assignment_status")


@query(f"""{WITH}, gone AS (SELECT DISTINCT repost_of_id AS id FROM posts_once WHERE repost_of_id IS NOT NULL),
 heirs AS (SELECT repost_of_id AS o, min(id) AS heir FROM posts_once WHERE repost_of_id IS NOT NULL AND deleted_at IS NULL AND id NOT IN (SELECT id FROM gone) GROUP BY 1)
SELECT p.id, CASE WHEN heir IS NOT NULL AND NOT (g.id IS NOT NULL AND p.deleted_at IS NULL) THEN CASE WHEN heir <> p.id THEN heir END ELSE repost_of_id END AS repost_of_id, deleted_at IS NOT NULL OR g.id IS NOT NULL AS deleted FROM posts_once p LEFT JOIN gone g ON g.id = p.id LEFT JOIN heirs ON o = p.repost_of_id""")
def originals_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Every post that was reposted is deleted; copies take the originals' places."""
    p = posts(spark, d, "event_id", "deleted_at", "assignment_status", "repost_of_id")
    gone = p.where("repost_of_id is not null").select(F.col("repost_of_id").alias("id"))
    return corrections.delete(p, gone, AS_OF).select("id", "repost_of_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query(f"""{WITH}, {_PAIRS}, moved AS (SELECT p.id, coalesce(t, event_id) AS ev, event_id AS was, deleted_at, repost_of_id, assignment_status FROM posts_once p LEFT JOIN pairs ON s = event_id),
 back AS (SELECT m.id, m.was, m.ev FROM moved m JOIN pairs ON s = m.was WHERE m.deleted_at IS NULL AND assignment_status = 'assigned'),
 home AS (SELECT id, was FROM back UNION SELECT c.id, b.was FROM moved c JOIN back b ON c.repost_of_id = b.id AND c.ev = b.ev WHERE c.assignment_status = 'repost' AND c.deleted_at IS NULL),
 after AS (SELECT m.id, coalesce(h.was, m.ev) AS ev, deleted_at, repost_of_id FROM moved m LEFT JOIN home h ON h.id = m.id),
 n AS (SELECT ev, count(*) FILTER (WHERE repost_of_id IS NULL) AS m FROM after WHERE deleted_at IS NULL AND ev IS NOT NULL GROUP BY 1),
 act AS (SELECT id FROM hubs_once h WHERE is_active AND id NOT IN (SELECT s FROM pairs)), ok AS (SELECT s, t FROM pairs WHERE t IN (SELECT id FROM act)),
 g AS (SELECT t, sum(coalesce(member_count, 0)) AS more FROM pairs JOIN hubs_once ON id = s GROUP BY 1), lost AS (SELECT ev, count(*) AS l FROM back JOIN ok ON ok.s = back.was GROUP BY 1), won AS (SELECT was, count(*) AS w FROM back JOIN ok ON ok.s = back.was GROUP BY 1)
SELECT h.id, CASE WHEN ok.s IS NOT NULL THEN true WHEN p.s IS NOT NULL THEN false ELSE is_active END AS is_active, CASE WHEN ok.s IS NOT NULL THEN NULL ELSE coalesce(p.t, merged_into_id) END AS merged_into_id,
 CAST(CASE WHEN ok.s IS NOT NULL THEN coalesce(n.m, w, 0) WHEN h.id IN (SELECT t FROM ok) THEN coalesce(n.m, greatest(coalesce(member_count, 0) + coalesce(more, 0) - coalesce(l, 0), 0)) WHEN g.t IS NOT NULL THEN coalesce(member_count, 0) + more ELSE member_count END AS INTEGER) AS member_count
FROM hubs_once h LEFT JOIN pairs p ON p.s = h.id LEFT JOIN ok ON ok.s = h.id LEFT JOIN n ON n.ev = h.id LEFT JOIN g ON g.t = h.id LEFT JOIN lost ON lost.ev = h.id LEFT JOIN won ON won.was = h.id""")
def reopened_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Merges of the log made and undone: flags and counts of all hubs."""
    p, h, pairs = _merge_tables(spark, d)
    moved, after, log = corrections.apply_merges(p, h, pairs, AS_OF)
    return corrections.reopen_merges(moved, cut(after), cut(log), AS_OF)[1].select("id", "is_active", "merged_into_id", "member_count")


@query(f"""{WITH}, r AS (SELECT DISTINCT post_id, event_id FROM clustering_feedback_log WHERE feedback_type = 'user_removed' AND post_id IS NOT NULL),
 w AS (SELECT id, id AS cur, 0 AS n FROM hubs_once UNION ALL SELECT w.id, h.merged_into_id, w.n + 1 FROM w JOIN hubs_once h ON h.id = w.cur WHERE w.n < 5 AND NOT coalesce(h.is_active, false) AND h.merged_into_id IS NOT NULL), c AS (SELECT id, arg_max(cur, n) AS hub FROM w GROUP BY 1),
 hit AS (SELECT DISTINCT p.id, hub FROM r JOIN c ON c.id = r.event_id JOIN posts_once p ON p.id = r.post_id AND p.event_id = hub WHERE {OWN}), n AS (SELECT hub, count(*) AS n FROM hit GROUP BY 1)
SELECT h.id, CAST(CASE WHEN n IS NULL THEN member_count ELSE greatest(coalesce(member_count, 0) - n, 0) END AS INTEGER) AS member_count, coalesce(n, 0) AS removed FROM hubs_once h LEFT JOIN n ON n.hub = h.id""")
def unlinked_hubs(spark: SparkSession, d: str) -> DataFrame:
    removed = table(spark, d, "clustering_feedback_log").where("feedback_type = 'user_removed'")
    p = posts(spark, d, "event_id", "assignment_status", "deleted_at", "repost_of_id", "embedding")
    _, after, _, told = corrections.unlinked(p, hubs(spark, d), removed, AS_OF)
    n = told.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("removed"))
    return after.select("id", "member_count").join(n, "id", "left").fillna(0, ["removed"])


@query(f"""{WITH}, pin AS (SELECT DISTINCT post_id, event_id FROM clustering_feedback_log WHERE feedback_type <> 'user_removed' AND post_id IS NOT NULL UNION SELECT id, (SELECT min(id) FROM hubs_once WHERE is_active) FROM posts_once WHERE id % 50 = 0),
 w AS (SELECT id, id AS cur, 0 AS n FROM hubs_once UNION ALL SELECT w.id, h.merged_into_id, w.n + 1 FROM w JOIN hubs_once h ON h.id = w.cur WHERE w.n < 5 AND NOT coalesce(h.is_active, false) AND h.merged_into_id IS NOT NULL), c AS (SELECT w.id, arg_max(cur, n) AS hub FROM w GROUP BY 1),
 a AS (SELECT post_id AS id, min(hub) AS hub FROM pin JOIN c ON c.id = pin.event_id JOIN hubs_once h ON h.id = hub AND h.is_active GROUP BY 1), hit AS (SELECT p.id, hub, p.event_id AS old FROM a JOIN posts_once p ON p.id = a.id WHERE {OWN}),
 ch AS (SELECT hub AS id, 1 AS delta FROM hit WHERE old IS DISTINCT FROM hub UNION ALL SELECT old, -1 FROM hit WHERE old IS NOT NULL AND old <> hub), s AS (SELECT id, sum(delta) AS delta FROM ch GROUP BY 1)
SELECT h.id, CAST(CASE WHEN delta IS NULL THEN member_count ELSE greatest(coalesce(member_count, 0) + delta, 0) END AS INTEGER) AS member_count, (SELECT count(*) FROM hit WHERE hit.hub = h.id) AS confirmed FROM hubs_once h LEFT JOIN s ON s.id = h.id""")
def confirmed_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Confirmations of the log, and every fiftieth post pinned to the first active hub."""
    p, h = posts(spark, d, "event_id", "assignment_status", "assignment_confidence", "deleted_at", "repost_of_id"), hubs(spark, d)
    first = h.where("is_active").agg(F.min("id").alias("event_id"))
    pins = table(spark, d, "clustering_feedback_log").where("feedback_type <> 'user_removed' and post_id is not null").select("post_id", "event_id").union(p.where("id % 50 = 0").select(F.col("id").alias("post_id")).crossJoin(F.broadcast(first)))
    _, after, told = corrections.confirmed(p, h, pins, AS_OF)
    n = told.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("confirmed"))
    return after.select("id", "member_count").join(n, "id", "left").fillna(0, ["confirmed"])


@query(f"""{WITH}, tgt AS (SELECT DISTINCT repost_of_id AS id FROM posts_once WHERE repost_of_id IS NOT NULL UNION SELECT id FROM posts_once WHERE id % 40 = 0), gone AS (SELECT p.id, event_id FROM posts_once p JOIN tgt USING (id) WHERE deleted_at IS NULL),
 child AS (SELECT repost_of_id AS o, min(id) AS heir FROM posts_once WHERE repost_of_id IN (SELECT id FROM tgt) AND deleted_at IS NULL AND id NOT IN (SELECT id FROM gone) GROUP BY 1),
 after AS (SELECT p.id, p.event_id, CASE WHEN c.heir = p.id THEN NULL WHEN c.heir IS NOT NULL THEN c.heir ELSE repost_of_id END AS o FROM posts_once p LEFT JOIN child c ON c.o = p.repost_of_id WHERE deleted_at IS NULL AND p.id NOT IN (SELECT id FROM gone) AND p.event_id IS NOT NULL),
 n AS (SELECT event_id, count(*) FILTER (WHERE o IS NULL) AS m, count(*) FILTER (WHERE o IS NOT NULL) AS r FROM after GROUP BY 1), less AS (SELECT event_id, count(*) AS k FROM gone WHERE event_id IS NOT NULL GROUP BY 1), sync AS (SELECT DISTINCT event_id FROM gone WHERE id IN (SELECT o FROM child) AND event_id IS NOT NULL)
SELECT h.id, CAST(CASE WHEN sync.event_id IS NOT NULL AND m IS NOT NULL THEN m WHEN k IS NOT NULL THEN greatest(coalesce(member_count, 0) - k, 0) ELSE member_count END AS INTEGER) AS member_count FROM hubs_once h LEFT JOIN n ON n.event_id = h.id LEFT JOIN less ON less.event_id = h.id LEFT JOIN sync ON sync.event_id = h.id""")
def deleted_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Counts after every reposted post and every fortieth post is deleted."""
    p = posts(spark, d, "event_id", "deleted_at", "assignment_status", "repost_of_id")
    gone = p.where("repost_of_id is not null").select(F.col("repost_of_id").alias("id")).union(p.where("id % 40 = 0").select("id"))
    return corrections.deleted(p, hubs(spark, d), gone, AS_OF)[1].select("id", "member_count")


@query(f"""{WITH}, l AS (SELECT * FROM posts_once WHERE {LIVE}), j AS (SELECT r.event_id AS a, o.event_id AS b, o.repost_of_id AS x FROM l r JOIN l o ON o.id = r.repost_of_id),
 u AS (SELECT 'status_and_lineage' AS rule, count(*) AS n FROM l WHERE (assignment_status = 'repost') <> (repost_of_id IS NOT NULL) UNION ALL SELECT 'repost_chain', count(*) FROM j WHERE x IS NOT NULL UNION ALL SELECT 'copy_in_another_hub', count(*) FROM j WHERE a IS DISTINCT FROM b
 UNION ALL SELECT 'double_signature', count(*) FROM (SELECT 1 FROM l WHERE repost_of_id IS NULL AND event_id IS NOT NULL AND content_sig <> 0 GROUP BY event_id, content_sig HAVING count(*) > 1)) SELECT rule, n FROM u WHERE n > 0""")
def broken_invariants(spark: SparkSession, d: str) -> DataFrame:
    return corrections.broken_invariants(posts(spark, d, "event_id", "deleted_at", "assignment_status", "repost_of_id", "content_sig"))