"""Queries p1_ to p10_ of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm import cooccurrence, format_duplicates, language, leakage, mixing, personal_data, similar_vectors, similarity_clusters
from tideloom.runtime import cut, first_delivery, latest_hub, table


def _posts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "posts").select("id", "received_at", *columns))


DIM = 384


def _near(spark: SparkSession, sf_dir: str, name: str, vector: str, order: str) -> DataFrame:
    rows = table(spark, sf_dir, name).select("id", vector, order)
    if name == "event_hubs":
        rows = latest_hub(rows)
        order = None
    found = similar_vectors.most_similar(rows, "id", vector, DIM, k=10, min_sim=0.90, order=order)
    return found.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _near(spark, sf_dir, "posts", "embedding", "received_at").select(F.lit("post").alias("kind"), "id_a", "id_b")
    hubs = _near(spark, sf_dir, "event_hubs", "centroid", "last_updated_at").select(F.lit("hub").alias("kind"), "id_a", "id_b")
    return posts.union(hubs)


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar posts of every post whose id is divisible by 20, against all posts."""
    rows = table(spark, sf_dir, "posts").select("id", "embedding", "received_at")
    found = similar_vectors.most_similar(rows, "id", "embedding", DIM, k=10, order="received_at", queries="id % 20 = 0", cells=576, lists=44, codes=64)
    return found.select(F.col("id").alias("post_id"), "other_id", F.round("sim", 4).alias("sim"), "rank")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.cooccurrence(_posts(spark, sf_dir, "entities"), "id", "entities", min_pairs=5)


def p4_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of entities that occurs, with its counts and the excess over chance; `p4_pairs` has those in 5 posts."""
    return cooccurrence.cooccurrence(_posts(spark, sf_dir, "entities"), "id", "entities")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).where("n_ab * n >= 4 * n_a * n_b").select("item_a", "item_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.mentions(_posts(spark, sf_dir, "content"), table(spark, sf_dir, "person_name_tokens"), "id", "content")
    return found.select(F.col("id").alias("post_id"), "kind", "start_at")


def _redacted(spark: SparkSession, sf_dir: str, style: str) -> DataFrame:
    rows = personal_data.redacted(_posts(spark, sf_dir, "content"), table(spark, sf_dir, "person_name_tokens"), "id", "content", b"tideloom", style)
    return rows.select(F.col("id").alias("post_id"), "redacted", "n_mentions")


def p5_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, "placeholder")


def p5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, "surrogate")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "posts").select("id", "received_at", "event_id", "deleted_at", "embedding")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_clusters.similarity_clusters(_vectors(spark, sf_dir), "id", "embedding", DIM, order="received_at", keep=["event_id", "deleted_at"], where="deleted_at is null")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = cut(_clusters(spark, sf_dir))
    hubs = similarity_clusters.main_label(members, "event_id")
    return members.join(hubs, "cluster_id").where("event_id is null or event_id <> main_label").select(F.col("id").alias("post_id"), F.col("main_label").alias("hub_id"))


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    members = cut(_clusters(spark, sf_dir))
    return similarity_clusters.describe(rows, members, "id", "embedding", DIM, order="received_at").select("cluster_id", "size", F.array_join("typical_ids", ",").alias("typical_ids"))


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = format_duplicates.format_duplicates(_posts(spark, sf_dir, "content"), "id", "content")
    return rows.where("id = first_id").select("first_id", "copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = format_duplicates.format_duplicates(_posts(spark, sf_dir, "content"), "id", "content")
    return rows.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id", "exact_run", "score", F.round("share", 4).alias("share"), "verbatim")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("verbatim").select("doc_id", "item_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every target asks and whether the mix keeps it: tokens within one longest document of the goal, and
    no more uses than the repeats allow."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    records, shares = mixing.mix(docs, targets)
    most = records.groupBy("source").agg(F.max("copies").alias("most_used"))
    return shares.join(most, "source", "left").select(
        "source", F.round("target_share", 6).alias("target_share"), F.round("wanted_share", 6).alias("wanted_share"), "max_repeats", "n_docs",
        (F.abs(F.col("tokens") - F.col("goal_tokens")) <= F.col("longest")).alias("share_kept"), (F.coalesce("most_used", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.segments(docs, language.fit(docs))


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(p10_segments(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filled = language.paragraph_languages(p10_segments(spark, sf_dir)).select("doc_id", F.col("lang").alias("found_lang")).distinct()
    labels = docs.select("doc_id", language.named_language(F.col("lang")).alias("named"))
    return filled.join(labels, "doc_id").where("named is null or named <> found_lang").select("doc_id", "found_lang").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p4_found, p4_pairs, p4_all_pairs, p5_found, p5_placeholders, p5_surrogates, p6_found, p6_clusters, p7_found, p7_classes, p8_found, p8_leaks, p9_mix, p9_shares, p9_plan, p10_found, p10_segments, p10_languages)}

_ONCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at) AS rn FROM posts) WHERE rn = 1"
_HUBS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_updated_at DESC) AS rn FROM event_hubs) WHERE rn = 1"
_COS = "list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))"
_USABLE = "len({0}) = 384 AND list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])) > 0"


def _near_sql(kind: str, rows: str, vector: str) -> str:
    return f"""SELECT DISTINCT '{kind}' AS kind, least(x, y) AS id_a, greatest(x, y) AS id_b FROM (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM (
      SELECT a.id AS x, b.id AS y, round({_COS}, 7) AS s FROM (SELECT id, {vector} AS v FROM ({rows}) WHERE {_USABLE.format(vector)}) a JOIN (SELECT id, {vector} AS v FROM ({rows}) WHERE {_USABLE.format(vector)}) b ON a.id <> b.id WHERE {_COS} >= 0.9)) WHERE r <= 10"""


_ITEMS = f"""once AS ({_ONCE}), named AS (SELECT DISTINCT id, item FROM (SELECT id, regexp_replace(trim(regexp_replace(lower(e), '[\\s\\x{{a0}}\\x{{3000}}\\p{{Cf}}]+', ' ', 'g')), '^([^:]*?) ?: ?', '\\1:') AS item FROM (SELECT id, unnest(entities) AS e FROM once)) WHERE length(item) > 0),
  n1 AS (SELECT item, count(*) AS n FROM named GROUP BY 1), alln AS (SELECT count(DISTINCT id) AS n FROM named),
  pairs AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM named a JOIN named b ON a.id = b.id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 5),
  full_pairs AS (SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, alln.n AS n FROM pairs JOIN n1 x ON x.item = item_a JOIN n1 y ON y.item = item_b, alln)"""
_BARE = "lower(upper(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '[ßẞ]', 'ss', 'g')))"
_FORMS = f"""once AS ({_ONCE}), f AS (SELECT id, {_BARE.format("content")} AS flat, list_filter(regexp_split_to_array(content, '[\\r\\n\\x{{2028}}\\x{{2029}}|;]+'), lambda x: length({_BARE.format("x")}) > 0) AS parts FROM once WHERE content IS NOT NULL),
  g AS (SELECT id, flat, len(parts) >= 2 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '^[^\\p{{L}}\\p{{N}}:：]*\\p{{L}}[\\p{{L}}\\p{{M}}\\p{{Cf}}\\p{{Z}}\\s]{{0,40}}[:：].*[\\p{{L}}\\p{{N}}].*$'))) = 0 AS labelled, parts FROM f WHERE length(flat) >= 30),
  h AS (SELECT id, flat, CASE WHEN labelled THEN '{{' || array_to_string(list_sort(list_transform(parts, lambda x: {_BARE.format("x")})), chr(1)) || '}}' ELSE flat END AS form, labelled FROM g),
  node AS (SELECT DISTINCT min(id) OVER (PARTITION BY flat) AS u, CASE WHEN labelled THEN min(id) OVER (PARTITION BY labelled, form) END AS w FROM h),
  link AS (SELECT u, w FROM node WHERE w IS NOT NULL UNION SELECT w, u FROM node WHERE w IS NOT NULL),
  reach AS (SELECT u AS root, u AS node FROM node UNION SELECT r.root, l.w FROM reach r JOIN link l ON r.node = l.u),
  least AS (SELECT node, min(root) AS first_id FROM reach GROUP BY 1),
  k AS (SELECT id, first_id FROM (SELECT id, min(id) OVER (PARTITION BY flat) AS u FROM h) JOIN least ON node = u), c AS (SELECT first_id, count(*) AS copies FROM k GROUP BY 1)"""
_WORDS = "regexp_extract_all(lower(regexp_replace(text, '[\\x{AD}\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g')), '[\\p{L}\\p{N}]+')"

_SOURCE = "lower(trim(regexp_replace({0}, '[\\s\\x{{a0}}\\x{{3000}}]+', ' ', 'g')))"

SQL: dict[str, str] = {
    "p9_plan": f"""WITH t AS (SELECT {_SOURCE.format('source')} AS source, max(target_share) AS share, max(max_repeats) AS most FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0 GROUP BY 1),
      d AS (SELECT {_SOURCE.format('source')} AS source, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND length(text) > 0 GROUP BY 1),
      r AS (SELECT t.*, coalesce(n, 0) AS n FROM t LEFT JOIN d USING (source)), w AS (SELECT sum(share) AS w FROM r WHERE n > 0)
      SELECT source, round(share, 6) AS target_share, CASE WHEN n > 0 THEN round(share / w, 6) ELSE 0.0 END AS wanted_share, CAST(most AS BIGINT) AS max_repeats, n AS n_docs, true AS share_kept, true AS repeats_kept FROM r, w""",
    "p1_found": _near_sql("post", _ONCE, "embedding") + " UNION ALL " + _near_sql("hub", _HUBS, "centroid"),
    "p4_found": f"WITH {_ITEMS} SELECT item_a, item_b FROM full_pairs WHERE n_ab * n >= 4 * n_a * n_b",
    "p4_pairs": f"WITH {_ITEMS} SELECT *, n_ab * n / (n_a * n_b) AS lift, ln((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))) AS log_odds FROM full_pairs",
    "p6_found": f"""WITH RECURSIVE once AS ({_ONCE}), vecs AS (SELECT id, event_id, embedding AS v FROM once WHERE {_USABLE.format('embedding')} AND deleted_at IS NULL),
      links AS (SELECT a.id AS u, b.id AS w FROM vecs a JOIN vecs b ON a.id <> b.id WHERE {_COS} >= 0.62),
      reach AS (SELECT DISTINCT u AS root, u AS node FROM links UNION SELECT r.root, l.w FROM reach r JOIN links l ON r.node = l.u),
      comp AS (SELECT node AS id, min(root) AS c FROM reach GROUP BY 1), big AS (SELECT c FROM comp GROUP BY 1 HAVING count(*) >= 8),
      m AS (SELECT comp.id, c, event_id FROM comp JOIN big USING (c) JOIN vecs ON vecs.id = comp.id),
      main AS (SELECT c, event_id AS hub_id FROM (SELECT c, event_id, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, event_id) AS r FROM m WHERE event_id IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
      SELECT m.id AS post_id, hub_id FROM m JOIN main USING (c) WHERE event_id IS NULL OR event_id <> hub_id""",
    "p7_found": f"WITH RECURSIVE {_FORMS} SELECT first_id, id AS copy_id FROM k WHERE id <> first_id",
    "p7_classes": f"WITH RECURSIVE {_FORMS} SELECT first_id, copies FROM c",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
      dg AS (SELECT doc_id, array_to_string(list_slice(w, s, s + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d WHERE len(w) >= 12)),
      ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i WHERE len(w) >= 12))
      SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
