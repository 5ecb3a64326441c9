"""Relational queries as tables: graphs of a target and its predicates, all answered in one plan.

A graph is a row (query, target, target_class, predicates); a predicate has a name of ``RULES``, arguments and an ordinal rank.
All graphs go through the same joins, keyed by query: the phrases against the objects, which gives each target its candidates and
each other phrase its few anchors; candidates and predicates; anchors by phrase; the best anchor (or pair) of each
candidate and predicate; one score a candidate by the profile's composition.  Only the phrases meet all objects, in blocks of bounded size, and
each keeps its first few; what follows has as many rows as candidates times predicates times the few anchors that are tried.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomap.functions import math as m
from loomap.functions import text as t
from loomap.operators import aggregates as ag
from loomap.operators import graph, pools
from loomap.operators import predicates as p
from loomap.runtime import written

S, A, B = ("x", "y", "z"), ("a_x", "a_y", "a_z"), ("b_x", "b_y", "b_z")
TARGET = "$target"
#: Best candidates of a channel that are ranked, at least; anchors of a phrase, and those tried for a candidate; rows of an answer.
CHANNEL, ANCHORS, TRIED, MOST = 60, 5, 3, 20
#: Weights of the channels in the rank fusion: the target's phrase, and the whole utterance.
WEIGHTS = {"caption_target": 1.0, "caption_raw": 0.5}
#: Bytes of phrase vectors that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
VIEWS = 5
GRAPHS = "query string, target string, target_class string, predicates array<struct<name:string,args:array<string>,rank:int>>"
_ANSWER = "struct<target_description:string,target_class:string,predicates:array<struct<name:string,args:array<string>,kwargs:struct<rank:string>>>>"


@dataclass(frozen=True)
class Rule:
    """How a predicate is scored: of an object alone (``alone``), with an anchor (``pair``), with two (``between``), by its rank among all
    candidates (``rank``), in the cameras' views (``view``), or by the region that the pool is cut to (``region``)."""

    kind: str
    score: Callable[..., Column] | None = None
    #: Whether an anchor counts only within the profile's hops of the candidate.
    local: bool = False


VARIANCE = ("a_vx", "a_vy", "a_vz")
RULES: dict[str, Rule] = {
    "Near": Rule("pair", lambda: p.near(S, A), True),
    "On": Rule("pair", lambda: p.on(S, A), True),
    "Above": Rule("pair", lambda: p.above(S, A), True),
    "Below": Rule("pair", lambda: p.below(S, A), True),
    "NextTo": Rule("pair", lambda: p.next_to(S, A), True),
    "Inside": Rule("pair", lambda: p.inside(S, A, VARIANCE), True),
    "Between": Rule("between", lambda: p.between(S, A, B), True),
    "InRegion": Rule("region"),
    "HasAttribute": Rule("alone", lambda: p.has_attribute("caption", "attributes", "arg")),
    "IsCategory": Rule("alone", lambda: p.is_category("category", "caption", "arg")),
    "Closest": Rule("rank"),
    "Farthest": Rule("rank"),
    "LeftOf": Rule("view", local=True),
    "RightOf": Rule("view", local=True),
    "InFrontOf": Rule("view", local=True),
    "Behind": Rule("view", local=True),
}


def register(name: str, rule: Rule) -> None:
    """Adds a predicate, or puts another rule in its place."""
    RULES[name] = rule


@dataclass(frozen=True)
class Profile:
    """How candidates are scored: ``composition`` current, semantic, hard or logprob; ``floor`` the factor of a similarity whose class doesn't match; ``filtered``
    whether only those that match are left (of two at least); ``source`` what the class is looked for in, ``confidence`` the category's least."""

    composition: str = "current"
    weight: float = 0.25
    floor: float | None = None
    filtered: bool = False
    source: str = "tiered"
    confidence: float | None = None
    hops: int = 0


# The profiles and what else they are called.
PROFILES = {
    "current": Profile(),
    "semantic_only": Profile("semantic"),
    "hard_predicates": Profile("hard"),
    "soft_predicates": Profile(),
    "soft_predicates_w45": Profile(weight=0.45),
    "soft_predicates_w50": Profile(weight=0.5),
    "target_class_soft_predicates_w50": Profile(weight=0.5, filtered=True),
    "calibrated_logprob": Profile("logprob"),
    "unified_soft_w50_f03": Profile(weight=0.5, floor=0.3),
    "unified_soft_w50_f05": Profile(weight=0.5, floor=0.5),
    "unified_soft_w50_f07": Profile(weight=0.5, floor=0.7),
    "unified_soft_w50": Profile(weight=0.5, floor=0.3),
    "unified_soft_w50_yoloe": Profile(weight=0.5, floor=0.3, source="category"),
    "unified_soft_w50_caption": Profile(weight=0.5, floor=0.3, source="caption"),
    "unified_soft_w50_both": Profile(weight=0.5, floor=0.3, source="both"),
    "unified_soft_w50_conf030": Profile(weight=0.5, floor=0.3, confidence=0.30),
    "unified_soft_w50_conf045": Profile(weight=0.5, floor=0.3, confidence=0.45),
    "unified_soft_w50_conf060": Profile(weight=0.5, floor=0.3, confidence=0.60),
    "unified_soft_w50_covis3": Profile(weight=0.5, floor=0.3, hops=3),
}
ALIASES = {
    "default": "current", "spatial": "current", "soft": "soft_predicates", "soft_w45": "soft_predicates_w45", "soft45": "soft_predicates_w45", "w45": "soft_predicates_w45",
    "soft_w50": "soft_predicates_w50", "soft50": "soft_predicates_w50", "w50": "soft_predicates_w50", "class_soft_w50": "target_class_soft_predicates_w50",
    "class_filtered_soft_w50": "target_class_soft_predicates_w50", "target_class_w50": "target_class_soft_predicates_w50", "unified_w50_f03": "unified_soft_w50_f03",
    "unified_w50_f05": "unified_soft_w50_f05", "unified_w50_f07": "unified_soft_w50_f07", "unified": "unified_soft_w50", "unified_w50": "unified_soft_w50",
    "unified_covis3": "unified_soft_w50_covis3", "covis3": "unified_soft_w50_covis3", "target_class_soft": "target_class_soft_predicates_w50", "hard": "hard_predicates",
    "semantic": "semantic_only", "embedding": "semantic_only", "calibrated": "calibrated_logprob", "logprob": "calibrated_logprob", "csd": "soft_predicates",
    "csd_soft": "soft_predicates", "csd_hard": "hard_predicates", "csd_calibrated": "calibrated_logprob",
}


def profile(name: str | None) -> Profile:
    key = (name or "current").strip().lower().replace("-", "_")
    found = PROFILES.get(ALIASES.get(key, key))
    if found is None:
        raise ValueError(f"unknown profile {name!r}: one of {', '.join(sorted(PROFILES | ALIASES))}")
    return found


def graphs(answers: DataFrame) -> DataFrame:
    """GRAPHS of a model's answers (query, utterance, answer): the JSON in it, its known predicates of two arguments or more; no predicates where the answer can't be used.

    Where the utterance says closest or farthest, Near becomes that (and the class is forgotten, as the graph is made anew).
    """
    raw = F.from_json(t.json_block("answer"), _ANSWER)
    known = F.filter(raw["predicates"], lambda x: x["name"].isin(*RULES) & (F.size(x["args"]) >= 2))
    low = F.lower("utterance")
    says = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    closest, farthest = says("closest", "nearest"), says("farthest", "furthest")
    name = lambda x: F.when((x["name"] == "Near") & closest, "Closest").when((x["name"] == "Near") & farthest, "Farthest").otherwise(x["name"])
    rank = lambda x: F.greatest(F.lit(0), F.coalesce(x["kwargs"]["rank"].try_cast("int"), F.lit(0)))
    made = F.transform(known, lambda x: F.struct(name(x).alias("name"), F.transform(x["args"], lambda a: F.coalesce(a, F.lit(""))).alias("args"), rank(x).alias("rank")))
    target, of_class = F.trim(raw["target_description"]), F.trim(raw["target_class"])
    usable = (F.length(target) > 0) & (F.size(made) > 0)
    named = F.when(~F.lower(of_class).isin("null", "none", "unknown", "n/a", "") & ~closest & ~farthest, of_class)
    none = F.array().cast("array<struct<name:string,args:array<string>,rank:int>>")
    return answers.select("query", F.when(usable, target).otherwise(F.col("utterance")).alias("target"), F.when(usable, named).alias("target_class"), F.when(usable, made).otherwise(none).alias("predicates"))


# What a benchmark's relation is called here, and at which rank.
RELATIONS = {
    "between": ("Between", 0), "near": ("Near", 0), "close": ("Near", 0), "close_to": ("Near", 0), "above": ("Above", 0), "over": ("Above", 0), "below": ("Below", 0), "under": ("Below", 0),
    "on": ("On", 0), "on_top_of": ("On", 0), "in": ("Inside", 0), "inside": ("Inside", 0), "within": ("Inside", 0), "closest": ("Closest", 0), "second_closest": ("Closest", 1),
    "third_closest": ("Closest", 2), "farthest": ("Farthest", 0), "second_farthest": ("Farthest", 1), "third_farthest": ("Farthest", 2),
}


def statement_graphs(statements: DataFrame) -> DataFrame:
    """GRAPHS of a benchmark's statements (query, statement, target_class, relation, anchor_classes): at most one predicate each."""
    relation = F.regexp_replace(F.lower(F.trim("relation")), "-", "_")
    said = lambda k: F.create_map(*[F.lit(x) for r, v in RELATIONS.items() for x in (r, v[k])])[relation]
    anchors = F.filter(F.transform("anchor_classes", t.clean_phrase), lambda a: F.length(a) > 0)
    name = said(0)
    args = F.slice(anchors, 1, F.when(name == "Between", 2).otherwise(1))
    whole = name.isNotNull() & (F.size(args) == F.when(name == "Between", 2).otherwise(1))
    one = F.array(F.struct(name.alias("name"), F.concat(F.array(F.lit(TARGET)), args).alias("args"), said(1).alias("rank")))
    none = F.array().cast("array<struct<name:string,args:array<string>,rank:int>>")
    return statements.select("query", t.target_phrase("statement", "target_class").alias("target"), F.lit(None).cast("string").alias("target_class"), F.when(whole, one).otherwise(none).alias("predicates"))


def _asked(graphs: DataFrame) -> DataFrame:
    """The predicates about the target, a row each: query, p, name, arg, arg2, at (rank)."""
    one = graphs.select("query", F.posexplode("predicates").alias("p", "x")).where(F.col("x.args")[0] == TARGET)
    return one.select("query", "p", F.col("x.name").alias("name"), F.col("x.args")[1].alias("arg"), F.get("x.args", 2).alias("arg2"), F.coalesce("x.rank", F.lit(0)).alias("at"))


def _of_kind(asked: DataFrame, *kinds: str) -> DataFrame:
    return asked.where(F.col("name").isin(*[n for n, r in RULES.items() if r.kind in kinds]))


def _scored(kind: str) -> Column:
    """The score by name; null if undecidable."""
    rules = [(n, r) for n, r in RULES.items() if r.kind == kind]
    return reduce(lambda done, nr: done.when(F.col("name") == nr[0], nr[1].score()), rules[1:], F.when(F.col("name") == rules[0][0], rules[0][1].score()))


def _regions(asked: DataFrame, objects: DataFrame, phrases: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(query, region) that a query's pool is cut to, and (query, p, score, status, reason) of its InRegion predicates: the label itself, else the one of the most similar phrase."""
    labels = objects.where("region is not null").select("region").distinct()
    wanted = _of_kind(asked, "region").select("query", "p", "arg")
    exact = wanted.join(labels, F.lower("region") == F.lower("arg")).groupBy("query", "p").agg(F.min("region").alias("region"), F.lit(1.0).alias("sim"))
    vector = phrases.select(F.col("phrase").alias("_p"), "vector")
    by_label = labels.join(vector, F.col("region") == F.col("_p")).select("region", F.col("vector").alias("_l"))
    like = wanted.join(exact.select("query", "p"), ["query", "p"], "left_anti").join(vector, F.col("arg") == F.col("_p")).join(F.broadcast(by_label)).select("query", "p", "region", m.cosine("vector", "_l").alias("sim"))  # labels of rooms
    like = like.where(F.col("sim") >= least).groupBy("query", "p").agg(F.max_by(F.struct("region", "sim"), F.struct(F.round("sim", 9), "region")).alias("b")).select("query", "p", "b.region", "b.sim")
    found = exact.unionByName(like)
    scope = found.groupBy("query").agg(F.max_by("region", "p").alias("region"))
    some = F.broadcast(labels.agg((F.count("*") > 0).alias("_some")))  # one row
    told = wanted.join(found, ["query", "p"], "left").join(some)
    reason = F.when(F.col("sim").isNull(), F.when(F.col("_some"), "region_not_found").otherwise("no_regions_in_scene"))
    return scope, told.select("query", "p", F.coalesce("sim", F.lit(1.0)).alias("score"), F.when(F.col("sim").isNull(), "dropped").otherwise("fast_path").alias("status"), reason.alias("reason"))


def _similar(sought: DataFrame, pool: DataFrame) -> DataFrame:
    """sought: query, channel, phrase, vector, region, most.  The ``most`` objects of the pool most like each phrase (all if not positive): query, channel, phrase, object_idx, s, place."""
    some = sought.agg(F.coalesce(F.sum(8 * F.size("vector")), F.lit(0)).alias("n"), F.max("most").alias("most"), F.min("most").alias("least")).first()
    blocks = max(1, -(-some["n"] // BLOCK_BYTES))
    out = []
    for k in range(blocks):
        part = sought if blocks == 1 else sought.where(F.pmod(F.xxhash64("query", "channel", "phrase"), F.lit(blocks)) == k)
        both = pool.select("object_idx", F.col("region").alias("_r"), "feature").join(F.broadcast(part), F.col("region").isNull() | (F.col("region") == F.col("_r")))  # a block of phrases
        s = both.select("query", "channel", "phrase", "most", "object_idx", m.cosine("feature", "vector").alias("s"))
        if some["least"] is not None and some["least"] <= 0:
            # whole pools: no window holds one
            group = F.concat_ws("\x1f", "query", "channel", "phrase")
            ranked = ag.global_ranks(s.withColumn("_g", group), "_g", F.round("s", 9).desc(), F.col("object_idx")).drop("_g")
            out.append(ranked.withColumnRenamed("rank", "place").where("most <= 0 or place <= most").drop("most"))
        else:
            order = Window.partitionBy("query", "channel", "phrase").orderBy(F.round("s", 9).desc(), "object_idx")
            ranked = s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= (some["most"] or 0))
            out.append((ranked if blocks == 1 else written(ranked)).where("place <= most").drop("most"))
    return reduce(DataFrame.unionByName, out)


def _class_matches(prof: Profile, terms: Column) -> Column:
    by_category, by_caption = t.matches_class("category", terms), t.matches_class("caption", terms)
    if prof.source == "category":
        return by_category
    if prof.source == "caption":
        return by_caption
    if prof.source == "both":
        return by_category | by_caption
    told = t.informative(t.normalized("category"))
    if prof.confidence is not None:
        told &= F.coalesce(F.col("category_confidence") >= prof.confidence, F.lit(True))
    return F.when(told, by_category).otherwise(by_caption)


def _composed(prof: Profile, threshold: float, calibrations: dict[str, tuple[float, float]]) -> Column:
    """The score from ``similarity`` and ``results``."""
    sim = F.col("similarity")
    told = F.filter("results", lambda r: r["status"] != "dropped")
    if prof.composition == "semantic":
        return sim
    if prof.composition == "hard":
        return F.when(F.forall(told, lambda r: r["score"] >= threshold), sim).otherwise(0.0)
    if prof.composition == "logprob":

        def calibrated(r: Column) -> Column:
            x = m.clamp_probability(r["score"])
            for name, (intercept, coef) in calibrations.items():
                x = F.when(r["name"] == name, m.clamp_probability(m.logistic(m.clamp_probability(r["score"]), intercept, coef))).otherwise(x)
            return x

        total = F.aggregate(told, F.log(m.clamp_probability(sim)), lambda s, r: s + F.log(calibrated(r)))
        return F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(0.0), total)))
    return p.composed("similarity", F.transform("results", lambda r: r["score"]), prof.weight)


TOLD = ("query", "object_idx", "p", "name", "score", "status", "reason", "anchors")


def _outcome() -> list[Column]:
    """What becomes of a predicate's score ``s``: null is dropped, with score 1."""
    return [F.coalesce("s", F.lit(1.0)).alias("score"), F.when(F.col("s").isNull(), "dropped").otherwise("fast_path").alias("status"), F.when(F.col("s").isNull(), "no_vlm_and_undecidable").alias("reason")]


def answered(
    graphs: DataFrame, phrases: DataFrame, objects: DataFrame, method: str = "current", *, pool: str = "active", redirects: DataFrame | None = None, links: DataFrame | None = None,
    cameras: DataFrame | None = None, utterances: DataFrame | None = None, k: int = 40, anchor_k: int = ANCHORS, tried: int = TRIED, most: int = MOST, threshold: float = 0.5,
    calibrations: dict[str, tuple[float, float]] | None = None, region_least: float = 0.7,
) -> DataFrame:
    """The first ``most`` objects of every graph: query, rank, object_idx, similarity, geo, score, results (name, score, status, reason, anchors).

    objects: object_idx, x y z, vx vy vz, caption, category, attributes, region, active, feature (category_confidence where the profile asks for one);
    phrases: (phrase, vector) of every target, anchor and region; utterances: (query, vector) of the whole text, a second channel whose ranks are fused
    with the first's; links: (a, b) of objects seen together; cameras: (cam, px, py, pz).  ``k`` candidates a query, all of the pool where it isn't positive.
    A phrase without a vector has no candidates or anchors.
    """
    prof = profile(method)
    chosen = pools.candidates(objects, redirects, pool)
    # written, so that Spark knows how small these are and sends them where they are joined
    asked = written(_asked(graphs))
    scope, regions = _regions(asked, objects, phrases, region_least)
    vector = phrases.groupBy("phrase").agg(F.first("vector").alias("vector"))
    few = lambda n: n if k > 0 else 0
    channels = [graphs.select("query", F.lit("caption_target").alias("channel"), F.col("target").alias("phrase"), F.lit(k if utterances is None else few(max(CHANNEL, k))).alias("most")).join(vector, "phrase")]
    if utterances is not None:
        channels.append(utterances.select("query", F.lit("caption_raw").alias("channel"), F.lit("").alias("phrase"), F.lit(few(max(CHANNEL, k))).alias("most"), "vector"))
    sides = _of_kind(asked, "pair", "view", "rank", "between")
    named = sides.select("query", F.col("arg").alias("phrase")).union(_of_kind(asked, "between").select("query", "arg2")).where("phrase is not null").distinct()
    channels.append(named.join(vector, "phrase").select("query", F.lit("anchor").alias("channel"), "phrase", F.lit(anchor_k).alias("most"), "vector"))
    sought = reduce(DataFrame.unionByName, channels).join(scope, "query", "left")
    # the phrases' first few are read for candidates and anchors, so they are written once
    found = written(_similar(sought, chosen))

    if utterances is None:
        cand = found.where("channel = 'caption_target'").select("query", "object_idx", F.greatest(F.col("s"), F.lit(0.0)).alias("similarity"), "place")
    else:
        ranks = found.where("channel <> 'anchor'").withColumnRenamed("place", "rank")
        fused = ag.rank_fusion(ranks, ["query", "object_idx"], WEIGHTS).withColumnRenamed("score", "similarity")
        order = [F.round("similarity", 9).desc(), F.col("object_idx")]
        if k > 0:
            cand = fused.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k)
        else:
            cand = ag.global_ranks(fused, "query", *order).withColumnRenamed("rank", "place")
    about = objects.select("object_idx", *S, "vx", "vy", "vz", "caption", "category", "attributes", *(["category_confidence"] if prof.confidence is not None else []))
    cand = cand.join(about, "object_idx")
    if prof.floor is not None or prof.filtered:
        of_class = graphs.select("query", t.class_terms(F.coalesce("target_class", "target") if prof.floor is not None else "target").alias("_terms"))
        matched = (F.size("_terms") == 0) | _class_matches(prof, F.col("_terms"))
        cand = cand.join(of_class, "query").withColumn("_match", matched).drop("_terms")
        if prof.floor is not None:
            cand = cand.withColumn("similarity", F.col("similarity") * F.when(F.col("_match"), 1.0).otherwise(prof.floor)).withColumn("_semantic", F.lit(False))
        else:
            enough = cand.groupBy("query").agg((F.count(F.when(F.col("_match"), 1)) < 2).alias("_semantic"))
            cand = cand.join(enough, "query").where(F.col("_match") | F.col("_semantic"))
        cand = cand.drop("_match")
    else:
        cand = cand.withColumn("_semantic", F.lit(prof.composition == "semantic"))
    cand = written(cand)

    place = objects.select(F.col("object_idx").alias("a_object_idx"), *[F.col(c).alias(f"a_{c}") for c in (*S, "vx", "vy", "vz")])
    anchors = found.where("channel = 'anchor'").select("query", F.col("phrase").alias("arg"), F.col("object_idx").alias("a_object_idx"), F.col("place").alias("a_place")).join(place, "a_object_idx")
    anchors = written(anchors)
    evaluated = cand.where("not _semantic").select("query", "object_idx", F.col("place").alias("c_place"), *S, "caption", "category", "attributes")
    none = F.array().cast("array<long>")
    by_region = evaluated.select("query", "object_idx").join(regions, "query").select(*TOLD[:3], F.lit("InRegion").alias("name"), "score", "status", "reason", none.alias("anchors"))
    alone = evaluated.join(_of_kind(asked, "alone"), "query").withColumn("s", _scored("alone"))
    by_itself = alone.select(*TOLD[:4], *_outcome(), none.alias("anchors"))
    told = by_region.unionByName(by_itself).unionByName(_anchored(evaluated, asked, anchors, cameras, links, prof.hops, tried)).unionByName(_ranked(evaluated, asked, anchors, k))
    # a superlative comes after what is told of each object by itself
    late = F.when(F.col("name").isin(*[n for n, r in RULES.items() if r.kind == "rank"]), 1).otherwise(0)
    told = told.groupBy("query", "object_idx").agg(F.array_sort(F.collect_list(F.struct(late.alias("late"), "p", "name", "score", "status", "reason", "anchors"))).alias("_told"))
    results_of = F.transform(F.coalesce("_told", F.array().cast(told.schema["_told"].dataType)), lambda r: F.struct(r["name"].alias("name"), r["score"].alias("score"), r["status"].alias("status"), r["reason"].alias("reason"), r["anchors"].alias("anchors")))
    scored = cand.select("query", "object_idx", "similarity", "place").join(told, ["query", "object_idx"], "left").withColumn("results", results_of)
    scored = scored.withColumn("geo", p.geometric(F.transform("results", lambda r: r["score"]))).withColumn("score", _composed(prof, threshold, calibrations or {}))
    first = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "place")
    return scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).select("query", "rank", "object_idx", "similarity", "geo", "score", "results")


def _anchored(cand: DataFrame, asked: DataFrame, anchors: DataFrame, cameras: DataFrame | None, links: DataFrame | None, hops: int, tried: int) -> DataFrame:
    """Results of the predicates with one anchor or two: of those that are tried the best, the first of equals."""
    key = ["query", "object_idx", "p"]
    two = F.col("name").isin(*[n for n, r in RULES.items() if r.kind == "between"])
    known = anchors.select("query", "arg").distinct()
    sided = _of_kind(asked, "pair", "view", "between").join(known.withColumn("_1", F.lit(True)), ["query", "arg"], "left").join(known.select("query", F.col("arg").alias("arg2"), F.lit(True).alias("_2")), ["query", "arg2"], "left")
    lost = F.when(F.col("_1").isNull() | (two & F.col("_2").isNull()), "anchor_not_found")
    # read by each kind of predicate below, so written once
    rows = written(cand.join(sided.select("query", "p", "name", "arg", F.when(two, F.col("arg2")).alias("arg2"), lost.alias("lost")), "query"))
    live = rows.where("lost is null")
    usable, on = anchors, ["query", "arg"]
    if hops > 0 and links is not None:
        near = graph.reachable(links, cand.select(F.col("object_idx").alias("node")).distinct(), hops, broadcast=False).select(F.col("source").alias("object_idx"), F.col("node").alias("a_object_idx"))
        sides = live.select(*key, F.explode(F.array("arg", "arg2")).alias("arg")).where("arg is not null")
        pairs = sides.select("query", "object_idx", "arg").distinct().join(anchors, ["query", "arg"]).join(near, ["object_idx", "a_object_idx"])
        order = Window.partitionBy("query", "object_idx", "arg").orderBy("a_place")  # of a phrase's few anchors
        usable, on = written(pairs.withColumn("a_place", F.row_number().over(order))), ["query", "object_idx", "arg"]
        apart = sides.join(usable.select(*on).distinct(), on, "left_anti").select(*key).distinct().withColumn("apart", F.lit(True))
        live = live.join(apart, key, "left_anti")
        rows = rows.join(apart, key, "left")
    else:
        rows = rows.withColumn("apart", F.lit(False))
    usable = usable.where(F.col("a_place") <= tried)
    others = F.col("object_idx") != F.col("a_object_idx")
    pair = _of_kind(live, "pair").join(usable, on).where(others).withColumns({"s": _scored("pair"), "place": F.col("a_place"), "anchors": F.array("a_object_idx")})
    view = _viewed(_of_kind(live, "view").join(usable, on).where(others), cameras).withColumns({"place": F.col("a_place"), "anchors": F.array("a_object_idx")})
    second = usable.select(*[F.col(c).alias(c.replace("a_", "b_", 1) if c.startswith("a_") else c) for c in usable.columns]).withColumnRenamed("arg", "arg2")
    pairs2 = _of_kind(live, "between").join(usable, on).where(others).join(second, ["arg2" if c == "arg" else c for c in on]).where((F.col("object_idx") != F.col("b_object_idx")) & (F.col("a_object_idx") != F.col("b_object_idx")))
    pairs2 = pairs2.withColumns({"s": _scored("between"), "place": F.col("a_place") * tried + F.col("b_place"), "anchors": F.array("a_object_idx", "b_object_idx")})
    scored = reduce(DataFrame.unionByName, [x.select(*key, "s", "place", "anchors") for x in (pair, view, pairs2)])
    first = F.struct(F.round(F.coalesce("s", F.lit(1.0)), 9), -F.col("place"))
    best = scored.groupBy(*key).agg(F.max_by(F.struct("s", "anchors"), first).alias("b")).select(*key, "b.*")
    done = rows.select(*key, "name", "lost", "apart").join(best, key, "left").withColumn("_none", F.col("anchors").isNull())
    score, status, reason = _outcome()
    fails = F.when(F.col("lost").isNotNull(), F.col("lost")).when(F.col("apart"), f"covisibility_no_anchor_within_{hops}_hops").when(F.col("_none"), "no_valid_anchor")
    return done.select(
        *TOLD[:4],
        F.when(F.col("lost").isNull() & F.col("apart"), 0.0).when(fails.isNotNull(), 1.0).otherwise(score).alias("score"),
        F.when(F.col("lost").isNull() & F.col("apart"), "fast_path").when(fails.isNotNull(), "dropped").otherwise(status).alias("status"),
        F.coalesce(fails, reason).alias("reason"),
        F.coalesce("anchors", F.array().cast("array<long>")).alias("anchors"),
    )


def _viewed(rows: DataFrame, cameras: DataFrame | None) -> DataFrame:
    """``s`` of the view-dependent relations: the mean of the best views, weighed by quality; null if no camera sees both."""
    names = [n for n, r in RULES.items() if r.kind == "view"]
    if cameras is None:
        return rows.withColumn("s", F.lit(None).cast("double"))
    seen = lambda x, y, z: (F.col(x) - F.col("px"), F.col("pz") - F.col(z), F.col(y) - F.col("py"))
    views = {n: m.frustum_view(seen(*S), seen(*A), n) for n in names}
    pick = lambda k: reduce(lambda done, n: done.when(F.col("name") == n, views[n][k]), names[1:], F.when(F.col("name") == names[0], views[names[0]][k]))
    key = ["query", "object_idx", "p", "a_object_idx"]
    v = rows.join(F.broadcast(cameras)).select(*key, "cam", pick(0).alias("_s"), pick(1).alias("_q")).where("_q > 0")  # a scene's cameras
    best = v.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.round("_q", 9).desc(), "cam"))).where(F.col("_n") <= VIEWS)
    return rows.join(best.groupBy(*key).agg((F.sum(F.col("_q") * F.col("_s")) / F.sum("_q")).alias("s")), key, "left")


def _ranked(cand: DataFrame, asked: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Superlatives: by the rank of the distance to the first anchor, which itself gets 0; 1 where there is none."""
    once = _of_kind(asked, "rank").groupBy("query", "name", "arg", "at").agg(F.min("p").alias("p"))
    first = anchors.where("a_place = 1").select("query", "arg", "a_object_idx", *A)
    rows = cand.select("query", "object_idx", "c_place", *S).join(once, "query").join(first, ["query", "arg"], "left")
    d = m.distance(S, A)
    ranked = rows.where("object_idx <> a_object_idx").withColumn("_d", F.when(F.col("name") == "Closest", d).otherwise(-d))
    if k > 0:
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query", "p").orderBy("_d", "c_place")))  # of k rows
    else:
        ranked = ag.global_ranks(ranked.withColumn("_g", F.concat_ws("\x1f", "query", "p")), "_g", F.col("_d"), F.col("c_place")).drop("_g")
    score = 1 / (F.abs(F.col("rank") - 1 - F.col("at")) + 1)
    told = ranked.select(*TOLD[:4], score.alias("score"), F.array("a_object_idx").alias("anchors"))
    itself = rows.where("object_idx = a_object_idx").select(*TOLD[:4], F.lit(0.0).alias("score"), F.array("a_object_idx").alias("anchors"))
    nothing = rows.where("a_object_idx is null").select(*TOLD[:4], F.lit(1.0).alias("score"), F.array().cast("array<long>").alias("anchors"))
    return told.unionByName(itself).unionByName(nothing).withColumns({"status": F.lit("fast_path"), "reason": F.lit(None).cast("string")})
