"""Relational queries given as graphs: ten of them at once, by several profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomap.operators import relational, shared
from loomap.plans.maps import r6
from loomap.plans.retrieval import CAMERAS, NAMED, described
from loomap.runtime import written
from loomap.sources.scene import object_images, objects, redirects, table

QUERIES, ORACLES = {}, {}
#: A model's answers to ten utterances.
ANSWERS = [
    ("g0", "the armchair near the window", '{"target_description": "armchair", "target_class": "armchair", "predicates": [{"name": "Near", "args": ["$target", "window"]}]}'),
    ("g1", "the couch above the shelf, beside the table", 'Sure:\n```json\n{"target_description": " couch ", "target_class": "couch", "predicates": [{"name": "Above", "args": ["$target", "shelf"]}, {"name": "NextTo", "args": ["$target", "table"], "kwargs": {}}]}\n```'),
    ("g2", "the shelf between the window and the couch", '{"target_description": "shelf", "target_class": "shelf", "predicates": [{"name": "Between", "args": ["$target", "window", "couch"]}]}'),
    ("g3", "the armchair closest to the table", '{"target_description": "armchair", "target_class": "armchair", "predicates": [{"name": "Near", "args": ["$target", "table"]}, {"name": "Hovers", "args": ["$target", "table"]}]}'),
    ("g4", "the second farthest window that is on the couch", '{"target_description": "window", "target_class": "null", "predicates": [{"name": "Farthest", "args": ["$target", "couch"], "kwargs": {"rank": 1}}, {"name": "On", "args": ["$target", "couch"]}]}'),
    ("g5", "the red window in room 3", '{"target_description": "window", "target_class": "window", "predicates": [{"name": "HasAttribute", "args": ["$target", "red"]}, {"name": "InRegion", "args": ["$target", "Room 3"]}]}'),
    ("g6", "the shelf in room 99", '{"target_description": "shelf", "predicates": [{"name": "IsCategory", "args": ["$target", "shelf"]}, {"name": "InRegion", "args": ["$target", "room 99"]}]}'),
    ("g7", "the couch left of the window, in the table", '{"target_description": "couch", "target_class": "couch", "predicates": [{"name": "LeftOf", "args": ["$target", "window"]}, {"name": "Inside", "args": ["$target", "table"]}]}'),
    ("g8", "window", "I can't tell."),
    ("g9", "the table near the unicorn and below the window", '{"target_description": "table", "target_class": "table", "predicates": [{"name": "Near", "args": ["$target", "unicorn"]}, {"name": "Below", "args": ["$target", "window"]}, {"name": "Near", "args": ["window", "shelf"]}]}'),
]
#: The object whose feature stands for a phrase's vector.
PHRASES = {"armchair": 0, "window": 2, "couch": 3, "shelf": 5, "table": 8}


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described objects with attributes and a room."""
    return described(spark, sf_dir).withColumns({"attributes": F.slice(F.split("caption", " "), 2, 1), "region": F.concat(F.lit("room "), "region_id")})


def vectors(o: DataFrame, known: dict[str, int], name: str) -> DataFrame:
    label = F.create_map(*[F.lit(x) for pair in known.items() for x in (pair[1], pair[0])])
    return o.where(F.col("object_idx").isin(*known.values())).select(label[F.col("object_idx").cast("int")].alias(name), F.col("feature").alias("vector"))


def answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANSWERS, "query string, utterance string, answer string")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("cam"), ((k - 12) * 0.4).alias("px"), (k % 5 * 0.5 - 6).alias("py"), ((k % 3 - 1) * 0.3).alias("pz"))


def shown(found: DataFrame) -> DataFrame:
    """The answers with what their predicates came to, as strings."""
    joined = lambda f: F.array_join(F.transform("results", f), "|")
    return found.select("query", "rank", "object_idx", r6(F.col("similarity")).alias("similarity"), r6(F.col("geo")).alias("geo"), r6(F.col("score")).alias("score"), joined(lambda r: F.concat(r["name"], F.lit(":"), F.coalesce(r["reason"], r["status"]))).alias("told"), joined(lambda r: F.array_join(r["anchors"], ",")).alias("anchors"))


def run(spark: SparkSession, sf_dir: str, method: str, **how) -> DataFrame:
    o = scene(spark, sf_dir)
    return shown(relational.answered(relational.graphs(answers(spark)), vectors(objects(spark, sf_dir), PHRASES, "phrase"), o, method, cameras=cameras(spark, sf_dir), **how))


# the same in SQL, from the graphs as they are parsed
GRAPHS_SQL = """ph(phrase, idx) AS (VALUES {phrases}), qs(query, target, klass, region) AS (VALUES ('g0', 'armchair', 'armchair', NULL), ('g1', 'couch', 'couch', NULL), ('g2', 'shelf', 'shelf', NULL), ('g3', 'armchair', 'armchair', NULL), ('g4', 'window', 'window', NULL),
  ('g5', 'window', 'window', 'room 3'), ('g6', 'shelf', 'shelf', NULL), ('g7', 'couch', 'couch', NULL), ('g8', 'window', 'window', NULL), ('g9', 'table', 'table', NULL)),
 pr(query, p, name, arg, arg2, nth) AS (VALUES ('g0', 0, 'Near', 'window', NULL, 0), ('g1', 0, 'Above', 'shelf', NULL, 0), ('g1', 1, 'NextTo', 'table', NULL, 0), ('g2', 0, 'Between', 'window', 'couch', 0), ('g3', 0, 'Closest', 'table', NULL, 0),
  ('g4', 1, 'On', 'couch', NULL, 0), ('g4', 9, 'Farthest', 'couch', NULL, 1), ('g5', 0, 'HasAttribute', 'red', NULL, 0), ('g5', 1, 'InRegion', 'Room 3', NULL, 0), ('g6', 0, 'IsCategory', 'shelf', NULL, 0), ('g6', 1, 'InRegion', 'room 99', NULL, 0),
  ('g7', 0, 'LeftOf', 'window', NULL, 0), ('g7', 1, 'Inside', 'table', NULL, 0), ('g9', 0, 'Near', 'unicorn', NULL, 0), ('g9', 1, 'Below', 'window', NULL, 0)),
 terms(klass, term) AS (VALUES ('armchair', 'armchair'), ('armchair', 'chair'), ('armchair', 'seat'), ('couch', 'couch'), ('couch', 'sofa'), ('shelf', 'shelf'), ('shelf', 'shelves'), ('shelf', 'bookcase'), ('window', 'window'), ('window', 'windows'), ('table', 'table'), ('table', 'desk'), ('table', 'countertop'), ('table', 'counter'))"""
GAUSS, SIG = "exp(-{0}*{0}/(2*{1}*{1}))", "1/(1+exp(-({0}-({1}))/{2}))"
OVER = "CASE WHEN {0} < -0.1 OR h > 2 THEN 0 ELSE (" + SIG.format("{0}", 0.2, 0.15) + ")*exp(-h*h/2) END"
BOX = "sqrt(" + "+".join(f"pow(greatest(0, abs({v}-a_{v})-(2.5*sqrt(greatest(a_v{v}, 1e-6))+0.1)), 2)" for v in "xyz") + ")"
PAIR_SQL = f"""CASE name WHEN 'Near' THEN CASE WHEN d > 5 THEN 0 ELSE {GAUSS.format('d', 0.5)} END WHEN 'On' THEN CASE WHEN h > 1 OR dz < -0.2 OR dz > 0.8 THEN 0 ELSE {GAUSS.format('h', 0.7)}*least(1, ({SIG.format('dz', 0, 0.1)})*({SIG.format('0.5-dz', 0, 0.1)})) END
  WHEN 'Above' THEN {OVER.replace('{0}', 'dz')} WHEN 'Below' THEN {OVER.replace('{0}', '(-dz)')} WHEN 'NextTo' THEN CASE WHEN h > 2 OR abs(dz) > 1 THEN 0 ELSE exp(-h*h/2) END WHEN 'Inside' THEN CASE WHEN {BOX} <= 1e-6 THEN 1 ELSE exp(-{BOX}*{BOX}/(2*0.35*0.35)) END END"""


def oracle(score: str, candidates: str = "", links: str = "", pool: str = "active", hops: str = "") -> str:
    """SQL of the ten graphs.  ``score`` composes ``sim``, ``geo`` and the list ``r`` of (name, score, status)."""
    base = """SELECT query, object_idx, greatest(s, 0) AS sim, n AS place FROM found WHERE slot = '$' AND n <= 40"""
    return f"""{NAMED}, {CAMERAS}, {GRAPHS_SQL.format(phrases=', '.join(f"('{k}', {v})" for k, v in PHRASES.items()))}{links},
 sc AS (SELECT *, 'room ' || region_id AS region, string_split(caption, ' ')[2] AS attribute FROM c), vec AS (SELECT phrase, feature AS q FROM ph JOIN o ON object_idx = idx),
 slots AS (SELECT query, '$' AS slot, target AS phrase, region FROM qs UNION ALL SELECT DISTINCT pr.query, arg, arg, region FROM pr JOIN qs USING (query) WHERE name NOT IN ('HasAttribute', 'IsCategory', 'InRegion') UNION SELECT pr.query, arg2, arg2, region FROM pr JOIN qs USING (query) WHERE arg2 IS NOT NULL),
 every AS (SELECT query, slot, object_idx, list_cosine_similarity(feature, vec.q) AS s FROM slots JOIN vec USING (phrase) JOIN sc ON slots.region IS NULL OR sc.region = slots.region WHERE {pool}),
 found AS (SELECT *, row_number() OVER (PARTITION BY query, slot ORDER BY round(s, 9) DESC, object_idx) AS n FROM every),
 cand0 AS ({candidates or base}),
 cand AS (SELECT k.*, sc.* EXCLUDE (object_idx, active, weight, class_id, feature), EXISTS (SELECT 1 FROM terms WHERE terms.klass = qs.klass AND contains(' ' || CASE WHEN category <> 'object' THEN category ELSE caption END || ' ', ' ' || term || ' ')) AS matched FROM cand0 k JOIN sc USING (object_idx) JOIN qs USING (query)),
 anc AS (SELECT query, slot AS arg, f.object_idx AS a, n AS a_n, {', '.join(f'o.{v} AS a_{v}, o.v{v} AS a_v{v}' for v in 'xyz')} FROM found f JOIN o USING (object_idx) WHERE slot <> '$' AND n <= 5),
 {hops or "usable AS (SELECT NULL AS object_idx, * FROM anc WHERE a_n <= 3), cut AS (SELECT NULL AS query, NULL AS object_idx, NULL AS p WHERE false)"},
 cp AS (SELECT cand.*, p, name, arg, arg2, nth FROM cand JOIN pr USING (query)),
 lost AS (SELECT DISTINCT query, p FROM pr WHERE name NOT IN ('HasAttribute', 'IsCategory', 'InRegion', 'Closest', 'Farthest') AND (NOT EXISTS (SELECT 1 FROM anc WHERE anc.query = pr.query AND anc.arg = pr.arg) OR (arg2 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM anc WHERE anc.query = pr.query AND anc.arg = pr.arg2)))),
 pair AS (SELECT cp.*, a, a_n AS tried, {', '.join(f'a_{v}, a_v{v}' for v in 'xyz')}, sqrt((x-a_x)*(x-a_x)+(y-a_y)*(y-a_y)+(z-a_z)*(z-a_z)) AS d, sqrt((x-a_x)*(x-a_x)+(y-a_y)*(y-a_y)) AS h, z-a_z AS dz FROM cp JOIN usable ON usable.query = cp.query AND usable.arg = cp.arg AND (usable.object_idx IS NULL OR usable.object_idx = cp.object_idx)
   WHERE cp.object_idx <> a AND name IN ('Near', 'On', 'Above', 'Below', 'NextTo', 'Inside', 'LeftOf') AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.query = cp.query AND cut.object_idx = cp.object_idx AND cut.p = cp.p)),
 v AS (SELECT query, object_idx, p, a, cam, x-px AS sx, pz-z AS sy, y-py AS sz, a_x-px AS ax, pz-a_z AS ay, a_y-py AS az FROM pair, cam WHERE name = 'LeftOf'),
 u AS (SELECT *, sx/sz AS us, sy/sz AS vs, ax/az AS ua, ay/az AS va FROM v WHERE sz > 0.3 AND az > 0.3 AND sz < 15 AND az < 15),
 vq AS (SELECT *, exp(-(us*us+ua*ua+vs*vs+va*va))/(1+least(sz, az)/4) AS q, 1/(1+exp(-(ua-us)/0.08)) AS l FROM u WHERE abs(us) < 0.85 AND abs(ua) < 0.85 AND abs(vs) < 0.7 AND abs(va) < 0.7),
 vk AS (SELECT *, row_number() OVER (PARTITION BY query, object_idx, p, a ORDER BY round(q, 9) DESC, cam) AS n FROM vq), vs AS (SELECT query, object_idx, p, a, sum(q*l)/sum(q) AS s FROM vk WHERE n <= 5 GROUP BY ALL),
 ps AS (SELECT pair.query, pair.object_idx, pair.p, pair.tried, [pair.a] AS anchors, CASE WHEN name = 'LeftOf' THEN vs.s ELSE {PAIR_SQL} END AS s FROM pair LEFT JOIN vs ON vs.query = pair.query AND vs.object_idx = pair.object_idx AND vs.p = pair.p AND vs.a = pair.a),
 bt AS (SELECT cp.query, cp.object_idx, cp.p, i.a_n*1000+j.a_n AS tried, [i.a, j.a] AS anchors, j.a_x-i.a_x AS dx, j.a_y-i.a_y AS dy, cp.x-i.a_x AS px, cp.y-i.a_y AS py FROM cp JOIN usable i ON i.query = cp.query AND i.arg = cp.arg AND (i.object_idx IS NULL OR i.object_idx = cp.object_idx) JOIN usable j ON j.query = cp.query AND j.arg = cp.arg2 AND (j.object_idx IS NULL OR j.object_idx = cp.object_idx)
   WHERE name = 'Between' AND cp.object_idx <> i.a AND cp.object_idx <> j.a AND i.a <> j.a AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.query = cp.query AND cut.object_idx = cp.object_idx AND cut.p = cp.p)),
 bs AS (SELECT query, object_idx, p, tried, anchors, CASE WHEN sqrt(dx*dx+dy*dy) < 0.01 OR (px*dx+py*dy)/(dx*dx+dy*dy) < -0.1 OR (px*dx+py*dy)/(dx*dx+dy*dy) > 1.1 THEN 0
   ELSE (1-2*abs((px*dx+py*dy)/(dx*dx+dy*dy)-0.5))*exp(-(pow(px-(px*dx+py*dy)/(dx*dx+dy*dy)*dx, 2)+pow(py-(px*dx+py*dy)/(dx*dx+dy*dy)*dy, 2))/2) END AS s FROM bt),
 best AS (SELECT *, row_number() OVER (PARTITION BY query, object_idx, p ORDER BY round(coalesce(s, 1), 9) DESC, tried) AS n FROM (SELECT * FROM ps UNION ALL SELECT * FROM bs)),
 sup AS (SELECT cp.query, cp.object_idx, cp.p, a AS aa, cp.object_idx = a AS self, nth, row_number() OVER (PARTITION BY cp.query, cp.p, cp.object_idx = a ORDER BY CASE name WHEN 'Closest' THEN 1 ELSE -1 END*sqrt((x-a_x)*(x-a_x)+(y-a_y)*(y-a_y)+(z-a_z)*(z-a_z)), place) AS n
   FROM cp JOIN anc ON anc.query = cp.query AND anc.arg = cp.arg AND a_n = 1 WHERE name IN ('Closest', 'Farthest')),
 res AS (SELECT query, object_idx, p, coalesce(s, 1) AS score, CASE WHEN s IS NULL THEN 'no_vlm_and_undecidable' ELSE 'fast_path' END AS told, s IS NULL AS dropped, anchors FROM best WHERE n = 1
   UNION ALL SELECT query, object_idx, p, CASE WHEN self THEN 0 ELSE 1/(abs(n-1-nth)+1.0::DOUBLE) END, 'fast_path', false, [aa] FROM sup
   UNION ALL SELECT query, object_idx, p, coalesce(CASE name WHEN 'HasAttribute' THEN CASE WHEN contains(caption, arg) OR attribute = arg THEN 1.0 END ELSE CASE WHEN category = arg THEN 1.0 WHEN contains(caption, arg) THEN 0.9 END END, 1), CASE WHEN (name = 'HasAttribute' AND (contains(caption, arg) OR attribute = arg)) OR (name = 'IsCategory' AND (category = arg OR contains(caption, arg))) THEN 'fast_path' ELSE 'no_vlm_and_undecidable' END,
     NOT ((name = 'HasAttribute' AND (contains(caption, arg) OR attribute = arg)) OR (name = 'IsCategory' AND (category = arg OR contains(caption, arg)))), [] FROM cp WHERE name IN ('HasAttribute', 'IsCategory')
   UNION ALL SELECT query, object_idx, p, 1, CASE arg WHEN 'Room 3' THEN 'fast_path' ELSE 'region_not_found' END, arg <> 'Room 3', [] FROM cp WHERE name = 'InRegion'
   UNION ALL SELECT cp.query, cp.object_idx, cp.p, 1, 'anchor_not_found', true, [] FROM cp JOIN lost USING (query, p)
   UNION ALL SELECT cut.query, cut.object_idx, cut.p, 0, 'covisibility_no_anchor_within_3_hops', false, [] FROM cut
   UNION ALL SELECT cp.query, cp.object_idx, cp.p, 1, 'no_valid_anchor', true, [] FROM cp WHERE name NOT IN ('HasAttribute', 'IsCategory', 'InRegion', 'Closest', 'Farthest') AND NOT EXISTS (SELECT 1 FROM lost WHERE lost.query = cp.query AND lost.p = cp.p)
     AND NOT EXISTS (SELECT 1 FROM best WHERE best.query = cp.query AND best.object_idx = cp.object_idx AND best.p = cp.p) AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.query = cp.query AND cut.object_idx = cp.object_idx AND cut.p = cp.p)),
 agg AS (SELECT query, object_idx, exp(avg(ln(greatest(score, 1e-6)))) AS geo, string_agg(name || ':' || told, '|' ORDER BY p) AS told, string_agg(array_to_string(anchors, ','), '|' ORDER BY p) AS anchors, bool_and(dropped OR score >= 0.5) AS hard, sum(CASE WHEN dropped THEN 0 ELSE ln(greatest(1e-6, least(1-1e-6, score))) END) AS logs FROM res JOIN pr USING (query, p) GROUP BY ALL),
 z AS (SELECT cand.query, cand.object_idx, place, {score} FROM cand LEFT JOIN agg USING (query, object_idx)),
 w AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, place) AS rank FROM z)
 SELECT query, rank::INT AS rank, object_idx, round(similarity, 6) AS similarity, round(geo, 6) AS geo, round(score, 6) AS score, told, anchors FROM w WHERE rank <= 20"""


PARTS = "coalesce(geo, 1) AS geo, coalesce(told, '') AS told, coalesce(anchors, '') AS anchors"
LOG = "ln(greatest(1e-6, least(1-1e-6, sim)))"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(oracle(f"sim AS similarity, {PARTS}, sim*(0.75+0.25*coalesce(geo, 1)) AS score"))
def q213_graphs_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten graphs by the plain profile."""
    return run(spark, sf_dir, "current")


@query(oracle(f"sim*CASE WHEN matched THEN 1 ELSE 0.3 END AS similarity, {PARTS}, sim*CASE WHEN matched THEN 1 ELSE 0.3 END*(0.5+0.5*coalesce(geo, 1)) AS score"))
def q213_graphs_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the class factor."""
    return run(spark, sf_dir, "unified")


@query(oracle(f"sim AS similarity, {PARTS}, CASE WHEN coalesce(hard, true) THEN sim ELSE 0 END AS score", pool="active OR EXISTS (SELECT 1 FROM o e WHERE e.active AND e.object_idx = CASE WHEN sc.object_idx % 22 = 0 THEN sc.object_idx + 12 ELSE sc.object_idx + 1 END)"))
def q213_graphs_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates as filters; the pool has the objects that were merged, too."""
    return run(spark, sf_dir, "hard", pool="active_plus_redirect", redirects=redirects(spark, sf_dir))


@query(oracle(f"sim AS similarity, {PARTS}, exp(greatest(-60, least(0, {LOG}+coalesce(logs, 0)))) AS score"))
def q213_graphs_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities, in log space."""
    return run(spark, sf_dir, "logprob")


LINKS = """, b AS (SELECT DISTINCT l_partkey AS object, l_orderkey AS image FROM lineitem), e0 AS (SELECT i.object AS i, j.object AS j FROM b i JOIN b j ON i.image = j.image AND i.object < j.object GROUP BY ALL HAVING count(*) >= 2),
 e AS (SELECT i, j FROM e0 UNION SELECT j, i FROM e0)"""
HOPS = """h0 AS (SELECT DISTINCT object_idx AS i, object_idx AS a FROM cand), h1 AS (SELECT * FROM h0 UNION SELECT h0.i, e.j FROM h0 JOIN e ON h0.a = e.i), h2 AS (SELECT * FROM h1 UNION SELECT h1.i, e.j FROM h1 JOIN e ON h1.a = e.i), h3 AS (SELECT * FROM h2 UNION SELECT h2.i, e.j FROM h2 JOIN e ON h2.a = e.i),
 linked AS (SELECT cand.object_idx, anc.* REPLACE (row_number() OVER (PARTITION BY cand.query, cand.object_idx, anc.arg ORDER BY a_n) AS a_n) FROM cand JOIN anc USING (query) JOIN h3 ON h3.i = cand.object_idx AND h3.a = anc.a), usable AS (SELECT * FROM linked WHERE a_n <= 3),
 sided AS (SELECT query, p, arg AS side FROM pr WHERE name IN ('Near', 'On', 'Above', 'Below', 'NextTo', 'Inside', 'LeftOf', 'Between') AND EXISTS (SELECT 1 FROM anc WHERE anc.query = pr.query AND anc.arg = pr.arg) UNION ALL SELECT query, p, arg2 FROM pr WHERE arg2 IS NOT NULL),
 cut AS (SELECT DISTINCT cand.query, cand.object_idx, p FROM cand JOIN sided USING (query) WHERE NOT EXISTS (SELECT 1 FROM linked WHERE linked.query = cand.query AND linked.object_idx = cand.object_idx AND linked.arg = side))"""


@query(oracle(f"sim*CASE WHEN matched THEN 1 ELSE 0.3 END AS similarity, {PARTS}, sim*CASE WHEN matched THEN 1 ELSE 0.3 END*(0.5+0.5*coalesce(geo, 1)) AS score", links=LINKS, hops=HOPS))
def q213_graphs_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors count within three hops of objects that were seen together twice."""
    both = shared.pairs(object_images(spark, sf_dir), "object", "image").groupBy("a", "b").agg(F.count("*").alias("n"))
    # every hop reads the links, so they are written once
    return run(spark, sf_dir, "covis3", links=written(both.where("n >= 2").select("a", "b")))
