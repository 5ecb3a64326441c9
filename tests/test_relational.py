"""Relational queries: a plain version over small scenes, for every profile and option; how graphs are read."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomap.operators import relational as rel

CATEGORIES = ["chair", "table", "lamp", "object", "window"]


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def scene(seed, n=60):
    rng = random.Random(seed)
    return {
        i: {
            "at": [rng.uniform(-2, 2) for _ in range(3)], "var": [rng.uniform(0.001, 0.2) for _ in range(3)], "category": (c := rng.choice(CATEGORIES)), "caption": f"a {rng.choice(['red', 'blue'])} {c if c != 'object' else rng.choice(CATEGORIES)}",
            "attributes": [rng.choice(["soft", "hard"])], "region": rng.choice(["kitchen", "hall"]), "active": rng.random() < 0.9, "feature": [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)],
        }
        for i in range(n)
    }


def d3(a, b):
    return math.dist(a, b)


def gauss(d, s):
    return math.exp(-d * d / (2 * s * s))


def sig(v, c, t):
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, (v - c) / t))))


def pair_score(name, s, a):
    h, dz = math.hypot(s["at"][0] - a["at"][0], s["at"][1] - a["at"][1]), s["at"][2] - a["at"][2]
    if name == "Near":
        d = d3(s["at"], a["at"])
        return 0.0 if d > 5 else gauss(d, 0.5)
    if name == "On":
        return 0.0 if h > 1 or dz < -0.2 or dz > 0.8 else gauss(h, 0.7) * min(1.0, sig(dz, 0, 0.1) * sig(0.5 - dz, 0, 0.1))
    if name in ("Above", "Below"):
        dz = dz if name == "Above" else -dz
        return 0.0 if dz < -0.1 or h > 2 else sig(dz, 0.2, 0.15) * gauss(h, 1.0)
    if name == "NextTo":
        return 0.0 if h > 2 or abs(dz) > 1 else gauss(h, 1.0)
    out = math.sqrt(sum(max(0.0, abs(p - q) - (2.5 * math.sqrt(max(v, 1e-6)) + 0.1)) ** 2 for p, q, v in zip(s["at"], a["at"], a["var"], strict=True)))
    return 1.0 if out <= 1e-6 else gauss(out, 0.35)


def between(s, a, b):
    dx, dy, px, py = b["at"][0] - a["at"][0], b["at"][1] - a["at"][1], s["at"][0] - a["at"][0], s["at"][1] - a["at"][1]
    t = (px * dx + py * dy) / (dx * dx + dy * dy)
    return 0.0 if t < -0.1 or t > 1.1 else (1 - 2 * abs(t - 0.5)) * gauss(math.hypot(px - t * dx, py - t * dy), 1.0)


def plain(graph, vectors, objects, prof, k, pool, utterance=None, near=None, threshold=0.5, calibrations=None):
    scope, region = None, {}
    labels = sorted({o["region"] for o in objects.values()})
    for p, x in enumerate(graph["predicates"]):
        if x["name"] == "InRegion" and x["args"][0] == "$target":
            best = 1.0, next((r for r in labels if r.lower() == x["args"][1].lower()), None)
            if best[1] is None and x["args"][1] in vectors:
                best = max(((round(cosine(vectors[x["args"][1]], vectors[r]), 9), r) for r in labels if r in vectors), default=(0, None))
                best = best if best[0] >= 0.7 else (0, None)
            region[p] = (best[0], "fast_path", None) if best[1] else (1.0, "dropped", "region_not_found")
            scope = best[1] or scope

    def ranked(vector, most):
        found = [(round(cosine(vector, objects[i]["feature"]), 9), i) for i in pool if scope is None or objects[i]["region"] == scope]
        return sorted(found, key=lambda x: (-x[0], x[1]))[: most if most > 0 else None]

    if graph["target"] not in vectors and utterance is None:
        return []
    if utterance is None:
        cand = [(i, max(0.0, s)) for s, i in ranked(vectors[graph["target"]], k)]
    else:
        fused = {}
        for v, w in ((vectors.get(graph["target"]), 1.0), (utterance, 0.5)):
            for n, (_, i) in enumerate(ranked(v, max(60, k) if k > 0 else 0) if v else ()):
                fused[i] = fused.get(i, 0) + w / (5 + n + 1)
        cand = sorted(fused.items(), key=lambda x: (-round(x[1], 9), x[0]))[: k if k > 0 else None]
    semantic = prof.composition == "semantic"
    if prof.floor is not None or prof.filtered:
        word = (graph["target_class"] if prof.floor is not None else None) or graph["target"]
        terms = {"chair": ["chair", "armchair", "seat"], "lamp": ["lamp"], "sofa": ["sofa"]}[word]
        has = lambda text: any(f" {t} " in f" {text} " for t in terms)
        match = {}
        for i, _ in cand:
            c, t = has(objects[i]["category"]), has(objects[i]["caption"])
            match[i] = {"category": c, "caption": t, "both": c or t}.get(prof.source, c if objects[i]["category"] != "object" else t)
        if prof.floor is not None:
            cand = [(i, s * (1 if match[i] else prof.floor)) for i, s in cand]
        elif sum(match.values()) >= 2:
            cand = [(i, s) for i, s in cand if match[i]]
        else:
            semantic = True
    anchors = {}
    for x in graph["predicates"]:
        for a in x["args"][1:]:
            anchors[a] = [i for _, i in ranked(vectors[a], 5)] if a in vectors else []
    preds = [(p, x) for p, x in enumerate(graph["predicates"]) if x["args"][0] == "$target"]
    late = [(p, x) for p, x in preds if x["name"] in ("Closest", "Farthest")]
    late = [(p, x) for n, (p, x) in enumerate(late) if (x["name"], x["args"][1], x["rank"]) not in [(y["name"], y["args"][1], y["rank"]) for _, y in late[:n]]]
    ranks = {}
    for p, x in late:
        a = anchors[x["args"][1]]
        if a:
            order = sorted((i for i, _ in cand if i != a[0]), key=lambda i: d3(objects[i]["at"], objects[a[0]]["at"]) * (1 if x["name"] == "Closest" else -1))
            ranks[p] = {i: 1 / (abs(n - x["rank"]) + 1) for n, i in enumerate(order)} | {a[0]: 0.0}
    out = []
    for place, (i, sim) in enumerate(cand):
        o, results = objects[i], []
        for p, x in [] if semantic else preds:
            name, args = x["name"], x["args"]
            if p in region:
                results.append((name, *region[p], []))
            elif name == "HasAttribute":
                results.append((name, 1.0, "fast_path", None, []) if args[1] in o["caption"] or args[1] in o["attributes"] else (name, 1.0, "dropped", "no_vlm_and_undecidable", []))
            elif name == "IsCategory":
                s = 1.0 if o["category"] == args[1] else 0.9 if args[1] in o["caption"] else None
                results.append((name, s, "fast_path", None, []) if s else (name, 1.0, "dropped", "no_vlm_and_undecidable", []))
            elif name in ("Closest", "Farthest"):
                continue
            else:
                sides = [anchors[a] for a in args[1 : 3 if name == "Between" else 2]]
                if not all(sides):
                    results.append((name, 1.0, "dropped", "anchor_not_found", []))
                    continue
                if near is not None:
                    sides = [[a for a in side if a in near[i]] for side in sides]
                    if not all(sides):
                        results.append((name, 0.0, "fast_path", f"covisibility_no_anchor_within_{prof.hops}_hops", []))
                        continue
                tries = [[a] for a in sides[0][:3] if a != i] if name != "Between" else [[a, b] for a in sides[0][:3] for b in sides[1][:3] if i not in (a, b) and a != b]
                score = lambda t: None if name == "LeftOf" else pair_score(name, o, objects[t[0]]) if len(t) == 1 else between(o, objects[t[0]], objects[t[1]])  # noqa: B023, E731
                best = max(tries, key=lambda t: round(1.0 if score(t) is None else score(t), 9), default=None)  # noqa: B023
                s = score(best) if best else None
                results.append((name, 1.0, "dropped", "no_valid_anchor", []) if best is None else (name, 1.0, "dropped", "no_vlm_and_undecidable", best) if s is None else (name, s, "fast_path", None, best))
        for p, x in [] if semantic else late:
            a = anchors[x["args"][1]]
            results.append((x["name"], ranks[p][i] if a else 1.0, "fast_path", None, a[:1]))
        geo = math.exp(sum(math.log(max(1e-6, r[1])) for r in results) / len(results)) if results else 1.0
        told = [r for r in results if r[2] != "dropped"]
        clamp = lambda v: max(1e-6, min(1 - 1e-6, v))
        if prof.composition == "hard":
            total = sim if all(r[1] >= threshold for r in told) else 0.0
        elif prof.composition == "logprob":
            cal = lambda r: clamp(sig((calibrations or {}).get(r[0], (0, 0))[0] + calibrations[r[0]][1] * clamp(r[1]), 0, 1)) if r[0] in (calibrations or {}) else clamp(r[1])
            total = math.exp(max(-60, min(0.0, math.log(clamp(sim)) + sum(math.log(cal(r)) for r in told))))
        elif prof.composition == "semantic":
            total = sim
        else:
            total = sim * ((1 - prof.weight) + prof.weight * geo)
        out.append((-round(total, 9), place, i, sim, geo, total, results))
    return [(i, round(s, 6), round(g, 6), round(t, 6), [(r[0], round(r[1], 6), *r[2:]) for r in rs]) for _, _, i, s, g, t, rs in sorted(out)[:20]]


def P(name, *args, rank=0):
    return {"name": name, "args": ["$target", *args], "rank": rank}


GRAPHS = {
    "a": {"target": "chair", "target_class": "chair", "predicates": [P("Near", "table"), P("On", "lamp"), P("Between", "table", "lamp")]},
    "b": {"target": "lamp", "target_class": None, "predicates": [P("Closest", "table", rank=1), P("Above", "chair"), P("Below", "nothing"), P("Closest", "table", rank=1), P("Farthest", "nothing")]},
    "c": {"target": "chair", "target_class": "lamp", "predicates": [P("InRegion", "KITCHEN"), P("HasAttribute", "red"), P("IsCategory", "window"), P("NextTo", "table"), P("Inside", "lamp")]},
    "d": {"target": "lamp", "target_class": "chair", "predicates": [P("InRegion", "lobby"), P("InRegion", "attic"), P("Farthest", "chair"), P("HasAttribute", "soft"), P("LeftOf", "table")]},
    "e": {"target": "sofa", "target_class": None, "predicates": []},
    "f": {"target": "chair", "target_class": "chair", "predicates": [{"name": "Near", "args": ["table", "lamp"], "rank": 0}]},
}


def tables(spark, objects, vectors):
    o = spark.createDataFrame([(i, *x["at"], *x["var"], x["caption"], x["category"], x["attributes"], x["region"], x["active"], x["feature"]) for i, x in objects.items()], "object_idx long, x double, y double, z double, vx double, vy double, vz double, caption string, category string, attributes array<string>, region string, active boolean, feature array<double>")
    g = spark.createDataFrame([(q, x["target"], x["target_class"], [(p["name"], p["args"], p["rank"]) for p in x["predicates"]]) for q, x in GRAPHS.items()], rel.GRAPHS)
    return g, spark.createDataFrame(list(vectors.items()), "phrase string, vector array<double>"), o


def got(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r.object_idx, round(r.similarity, 6), round(r.geo, 6), round(r.score, 6), [(x["name"], round(x.score, 6), x.status, x.reason, list(x.anchors)) for x in r.results]))
    return out


VECTORS = {"chair": [1.0, 2.0, 0.5, -1.0], "table": [0.3, -1.0, 2.0, 0.1], "lamp": [2.0, 0.1, 0.1, 1.0], "kitchen": [1.0, 0.0, 0.0, 0.0], "hall": [0.0, 1.0, 0.0, 0.0], "lobby": [0.1, 1.0, 0.1, 0.0], "attic": [0.0, 0.0, 1.0, 1.0], "sofa": [1.0, 1.0, 1.0, 1.0]}


@pytest.mark.parametrize("method", ["semantic", "hard", "class_soft_w50", "logprob", "unified", "unified_soft_w50_both"])
def test_profiles(spark, method):
    objects = scene(len(method))
    pool = [i for i, o in objects.items() if o["active"]]
    calibrations = {"Near": (-1.0, 3.0)} if method == "logprob" else None
    found = got(rel.answered(*tables(spark, objects, VECTORS), method, k=25, calibrations=calibrations))
    for q, g in GRAPHS.items():
        assert found.get(q, []) == plain(g, VECTORS, objects, rel.profile(method), 25, pool, calibrations=calibrations), q


def test_whole_pools_channels_and_hops(spark):
    objects = scene(77, 40)
    args = tables(spark, objects, VECTORS)
    everything = list(objects)
    prof = rel.profile("current")
    found = got(rel.answered(*args, "current", k=0, pool="all"))
    assert all(found.get(q, []) == plain(g, VECTORS, objects, prof, 0, everything) for q, g in GRAPHS.items())
    said = {q: [1.0, -1.0, len(q) + 0.5, ord(q) % 3 + 0.0] for q in GRAPHS}
    utterances = spark.createDataFrame(list(said.items()), "query string, vector array<double>")
    for k in (10, 0):
        found = got(rel.answered(*args, "current", k=k, pool="all", utterances=utterances))
        assert all(found.get(q, []) == plain(g, VECTORS, objects, prof, k, everything, utterance=said[q]) for q, g in GRAPHS.items())
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(22)]
    near = {i: {i} for i in objects}
    for _ in range(3):
        near = {i: s | {b for a in s for e in edges if a in e for b in e} for i, s in near.items()}
    found = got(rel.answered(*args, "covis3", k=15, pool="all", links=spark.createDataFrame(edges, "a long, b long")))
    assert all(found.get(q, []) == plain(g, VECTORS, objects, rel.profile("covis3"), 15, everything, near=near) for q, g in GRAPHS.items())


def test_blocks_of_phrases(spark, monkeypatch):
    objects = scene(5, 30)
    args = tables(spark, objects, VECTORS)
    want = got(rel.answered(*args, "current", k=10))
    monkeypatch.setattr(rel, "BLOCK_BYTES", 250)
    assert got(rel.answered(*args, "current", k=10)) == want
    assert rel.answered(args[0].where("false"), args[1], args[2]).count() == 0
    assert rel.answered(args[0], args[1], args[2].where("false")).count() == 0


def test_another_predicate(spark, monkeypatch):
    monkeypatch.setattr(rel, "RULES", dict(rel.RULES))
    rel.register("Higher", rel.Rule("pair", lambda: F.when(F.col("z") > F.col("a_z"), 1.0).otherwise(0.0)))
    objects = scene(6, 20)
    _, phrases, o = tables(spark, objects, VECTORS)
    g = spark.createDataFrame([("q", "chair", None, [("Higher", ["$target", "table"], 0)])], rel.GRAPHS)
    rows = rel.answered(g, phrases, o, "hard", tried=1, pool="all", k=20).collect()
    assert len(rows) == 20 and all(r.score == 0 or objects[r.object_idx]["at"][2] > objects[r.results[0].anchors[0]]["at"][2] for r in rows if r.results[0].status != "dropped")


def test_graphs_of_answers(spark):
    rows = [
        ("1", "the chair nearest to the door", json.dumps({"target_description": " chair ", "target_class": "chair", "predicates": [{"name": "Near", "args": ["$target", "door"]}, {"name": "On", "args": ["$target", "rug"]}]})),
        ("2", "furthest lamp", '```json\n{"target_description": "lamp", "target_class": "Unknown", "predicates": [{"name": "Near", "args": ["$target", "x"], "kwargs": {"rank": 2}}, {"name": "Odd", "args": ["$target", "x"]}, {"name": "On", "args": ["$target"]}]}\n```'),
        ("3", "what?", "no JSON here"), ("4", "a chair", '{"target_description": "", "predicates": [{"name": "On", "args": ["$target", "x"]}]}'), ("5", "a cup", '{"target_description": "cup", "target_class": "cup", "predicates": []}'), ("6", "a jar", None),
    ]
    got = {r["query"]: (r.target, r.target_class, [(p["name"], list(p.args), p["rank"]) for p in r.predicates]) for r in rel.graphs(spark.createDataFrame(rows, "query string, utterance string, answer string")).collect()}
    assert got == {
        "1": ("chair", None, [("Closest", ["$target", "door"], 0), ("On", ["$target", "rug"], 0)]), "2": ("lamp", None, [("Farthest", ["$target", "x"], 2)]),
        "3": ("what?", None, []), "4": ("a chair", None, []), "5": ("a cup", None, []), "6": ("a jar", None, []),
    }


def test_graphs_of_statements(spark):
    rows = [("1", "the chair that is second closest to the door", "chair", "second-closest", ["the door"]), ("2", "the cup between the jar and the pan", "cup", "between", ["jar", "pan"]), ("3", "the cup between the jar", "cup", "between", ["jar"]), ("4", "a lamp", "lamp", "hovers", ["x"]), ("5", "the lamp under the shelf", "lamp", "under", ["a shelf", "y"])]
    got = {r["query"]: (r.target, [(p["name"], list(p.args), p["rank"]) for p in r.predicates]) for r in rel.statement_graphs(spark.createDataFrame(rows, "query string, statement string, target_class string, relation string, anchor_classes array<string>")).collect()}
    assert got["1"] == ("chair", [("Closest", ["$target", "door"], 1)]) and got["2"] == ("cup", [("Between", ["$target", "jar", "pan"], 0)]) and got["3"][1] == [] and got["4"][1] == []
    assert got["5"][1] == [("Below", ["$target", "shelf"], 0)]


def test_profile_names():
    assert rel.profile("UNIFIED-soft-w50") == rel.profile("unified") and rel.profile(None) == rel.profile("default")
    with pytest.raises(ValueError, match="unknown profile"):
        rel.profile("nope")
