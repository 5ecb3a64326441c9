"""String and JSON expressions on class names, captions and model answers."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomap.functions.math import Col, c

#: Categories that tell nothing.
UNINFORMATIVE = ("none", "object", "other", "target", "thing", "unknown")


def normalized(x: Col) -> Column:
    return F.trim(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", " "))


def singular(x: Col) -> Column:
    """Longer than three: -ies to -y, else a last s dropped."""
    x = c(x)
    return F.when((F.length(x) > 3) & x.endswith("ies"), F.regexp_replace(x, "ies$", "y")).when((F.length(x) > 3) & x.endswith("s"), F.regexp_replace(x, "s$", "")).otherwise(x)


def phrase_match(text: Col, term: Col) -> Column:
    """The normalised term as whole words of the normalised text."""
    pad = lambda s: F.concat(F.lit(" "), s, F.lit(" "))
    return pad(normalized(text)).contains(pad(normalized(term)))


def informative(category: Col) -> Column:
    return ~F.lower(F.trim(c(category))).isin(*UNINFORMATIVE) & (F.length(F.trim(c(category))) > 0)


def any_token_in(text: Col, tokens: Col) -> Column:
    return F.exists(c(tokens), lambda t: F.lower(c(text)).contains(t))


def overlap_score(a: Col, b: Col) -> Column:
    """Shared words over the root of the product of both counts."""
    both = F.size(F.array_intersect(c(a), c(b)))
    n = F.size(F.array_distinct(c(a))) * F.size(F.array_distinct(c(b)))
    return F.when(n > 0, both / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))


def json_block(answer: Col) -> Column:
    """The JSON object in a model's answer: a fenced block, else from the first to the last brace."""
    fenced = F.regexp_extract(c(answer), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    greedy = F.regexp_extract(c(answer), r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(greedy != "", greedy)


def answer_score(answer: Col) -> Column:
    """A score of 0..1: the JSON's, else after "score", else the first number of one to three digits up to 100."""
    number = F.coalesce(
        F.get_json_object(json_block(answer), "$.score").try_cast("double"),
        F.regexp_extract(c(answer), r'"score"\s*:\s*(\d+(?:\.\d+)?)', 1).try_cast("double"),
        F.regexp_extract(c(answer), r"\b(\d{1,2}|100)\b", 1).try_cast("double"),
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number / 100))


def without_article(phrase: Col) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c(phrase)), r"(?i)^(the|a|an)\s+", ""), r"(?i)\s+(that|which)\s+(is|are)$", "")


def safe_token(x: Col, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(c(x), "[^A-Za-z0-9_.-]+", "_"), 1, most)


#: Words that say nothing of a class.
STOPWORDS = (
    "a", "an", "and", "are", "at", "back", "black", "blue", "brown", "choose", "dark", "front", "glass", "gray", "green", "is", "large", "left", "light", "near",
    "nearest", "next", "object", "of", "on", "one", "pink", "right", "silver", "small", "target", "the", "to", "white", "with", "wood", "wooden", "yellow",
)
#: What else a class is called.
SYNONYMS = {
    "armchair": ("armchair", "arm chair", "chair"),
    "backpack": ("backpack", "bag"),
    "briefcase": ("briefcase", "case", "bag"),
    "cabinet": ("cabinet", "cabinets", "drawer", "cupboard"),
    "cabinets": ("cabinet", "cabinets", "drawer", "cupboard"),
    "chair": ("chair", "armchair", "arm chair", "seat"),
    "conference table": ("conference table", "table"),
    "couch": ("couch", "sofa"),
    "desk": ("desk", "table"),
    "dining table": ("dining table", "table"),
    "door": ("door", "doors", "double door", "glass door", "front door"),
    "doors": ("door", "doors", "double door", "glass door", "front door"),
    "kitchen cabinets": ("kitchen cabinet", "kitchen cabinets", "cabinet", "cabinets"),
    "laptop": ("laptop", "computer"),
    "ottoman": ("ottoman", "footstool"),
    "painting": ("painting", "picture", "picture frame", "photo", "artwork", "wall art"),
    "picture": ("picture", "painting", "picture frame", "photo", "artwork", "wall art"),
    "picture frame": ("picture", "painting", "picture frame", "photo", "artwork", "wall art"),
    "refrigerator": ("refrigerator", "fridge"),
    "shelf": ("shelf", "shelves", "bookcase"),
    "table": ("table", "desk", "countertop", "counter"),
    "trash can": ("trash can", "trashcan", "garbage can", "bin"),
    "trashcan": ("trash can", "trashcan", "garbage can", "bin"),
    "window": ("window", "windows"),
}
#: What a room holds.
ROOM_WORDS = {
    "kitchen": ("oven", "stove", "microwave", "refrigerator", "fridge", "sink", "toaster", "dishwasher"),
    "bathroom": ("toilet", "shower", "bathtub", "towel rack", "soap"),
    "bedroom": ("bed", "pillow", "nightstand", "dresser", "wardrobe", "mattress"),
    "living room": ("sofa", "couch", "tv", "television", "coffee table", "armchair"),
    "office": ("desk", "monitor", "keyboard", "computer", "office chair", "printer"),
    "dining room": ("dining table", "dining chair", "plates", "cutlery"),
    "laundry room": ("washer", "dryer", "washing machine", "laundry"),
}
#: What stands before a room that is meant.
ROOM_PREPOSITIONS = ("in the ", "from the ", "inside the ", "within the ", "of the ", "in a ", "from a ", "inside a ")
#: Where a statement's target ends and its relation begins; the first pattern that is found counts.
RELATION_PATTERNS = (
    r"\bsecond\s+closest\s+to\b", r"\bthird\s+closest\s+to\b", r"\bclosest\s+to\b", r"\bsecond\s+farthest\s+from\b", r"\bthird\s+farthest\s+from\b", r"\bfarthest\s+from\b",
    r"\bbetween\b", r"\babove\b", r"\bover\b", r"\bbelow\b", r"\bunder\b", r"\bnear\b", r"\bnext\s+to\b", r"\bon\b", r"\bin\b",
)
#: The frames of a prompt ensemble.
PROMPTS = ("{}", "a photo of {}", "a picture of {}", "{}, product photo", "{} on a table", "close-up of {}", "{}, blurry low-resolution photo")
#: Categories that a structured caption may not have.
VAGUE_CATEGORIES = ("", "unknown", "object", "item", "thing", "part")
VAGUE_DESCRIPTIONS = ("", "unknown", "unclear object", "object")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def spaced(x: Col) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(c(x), r"\s+", " "))


def class_terms(phrase: Col) -> Column:
    """The terms by which a target's class is looked for: the phrase, its words (singular, without stopwords), these joined, and synonyms."""
    whole = normalized(phrase)
    words = F.transform(F.filter(F.split(whole, " "), lambda t: (t != "") & ~t.isin(*STOPWORDS)), singular)
    found = [F.when((whole == key) | F.array_contains(strings(values), whole) | F.arrays_overlap(words, strings(values)), strings(values)).otherwise(strings(())) for key, values in SYNONYMS.items()]
    terms = F.concat(F.array(whole), words, F.array(F.array_join(words, " ")), *found)
    terms = F.array_distinct(F.filter(F.transform(terms, normalized), lambda t: (t != "") & ~t.isin(*STOPWORDS)))
    return F.when(whole.isin("", "target", "object", "one") | (F.size(words) == 0), strings(())).otherwise(terms)


def matches_class(text: Col, terms: Col) -> Column:
    """Whether a text has some term as whole words, or all of a term's words that aren't stopwords."""
    padded = F.concat(F.lit(" "), normalized(text), F.lit(" "))
    word = lambda t: padded.contains(F.concat(F.lit(" "), t, F.lit(" ")))

    def by_words(term: Column) -> Column:
        parts = F.filter(F.split(term, " "), lambda t: (t != "") & ~t.isin(*STOPWORDS))
        return (F.size(parts) > 0) & F.forall(parts, word)

    return F.coalesce(F.exists(c(terms), lambda t: word(t) | by_words(t)), F.lit(False))


def head_noun_keys(phrase: str) -> list[str]:
    """What a phrase's head noun is looked for by: its last word, its long words, and all words as one; of words of three letters at least."""
    words = [w for w in re.findall(r"[a-z]+", phrase.lower()) if len(w) >= 3]
    if not words:
        return []
    joined = "".join(words)
    return sorted({words[-1], *(w for w in words if len(w) >= 6), *([joined] if len(joined) >= 6 else [])})


def has_head_noun(caption: Col, category: Col, keys: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", c(caption), c(category)))
    return text.rlike("|".join(rf"\b{k}" for k in keys)) if keys else F.lit(None).cast("boolean")


def mentioned_room(query: Col, labels: list[str]) -> Column:
    """The index of the longest label that a preposition stands before, the first of equally long ones; null if there is none."""
    low = F.lower(c(query))
    order = sorted(range(len(labels)), key=lambda i: (-len(labels[i]), i))
    said = [(i, functools.reduce(lambda a, b: a | b, [low.contains(p + labels[i].lower()) for p in ROOM_PREPOSITIONS])) for i in order if labels[i]]
    return F.coalesce(*[F.when(hit, F.lit(i)) for i, hit in said]) if said else F.lit(None).cast("int")


def room_hits(text: Col) -> list[Column]:
    """For each room and each of its words whether the text has it."""
    low = F.lower(c(text))
    return [low.contains(w).alias(f"{room}/{w}") for room, words in ROOM_WORDS.items() for w in words]


def prompts(query: Col) -> Column:
    """The prompt ensemble of a query: eight forms, the last with an article, without repetitions."""
    q = spaced(query)
    vowel = F.lower(F.substring(q, 1, 1)).isin("a", "e", "i", "o", "u")
    article = F.when(F.lower(q).rlike("^(a|an|the) "), q).otherwise(F.concat(F.when(vowel, "an ").otherwise("a "), q))
    forms = [F.concat(*[x for part in f.split("{}") for x in (F.lit(part), q)][:-1]) for f in PROMPTS]
    every = F.array(*forms, article)
    first = F.filter(every, lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1)
    return F.when(q == "", strings(())).otherwise(first)


def joined_caption(new: Col, old: Col) -> Column:
    """A new caption before the old ones, unless it is among them already (in whatever case)."""
    n, o = F.trim(F.coalesce(c(new), F.lit(""))), F.trim(F.coalesce(c(old), F.lit("")))
    parts = F.transform(F.split(o, " OR "), lambda p: F.lower(F.trim(p)))
    return F.when(n == "", o).when(o == "", n).when(F.array_contains(parts, F.lower(n)), o).otherwise(F.concat(n, F.lit(" OR "), o))


def has_keyword(caption: Col, keywords: list[str], case_sensitive: bool = False) -> Column:
    """Whether a caption holds some keyword, as a part of a word too."""
    text = F.trim(F.coalesce(c(caption), F.lit("")))
    text = text if case_sensitive else F.lower(text)
    words = keywords if case_sensitive else [k.strip().lower() for k in keywords if k.strip()]
    return functools.reduce(lambda a, b: a | b, [text.contains(k) for k in words], F.lit(False)) & (text != "")


def clean_phrase(x: Col) -> Column:
    """Without an article before it and "that is", "which" and punctuation after it."""
    out = F.regexp_replace(spaced(x), r"(?i)^(the|a|an)\s+", "")
    out = F.regexp_replace(out, r"(?i)\s+(that|which)\s+(is|are)?\s*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)\s+(that|which)\s*$", ""), r"^[ ,.;:]+|[ ,.;:]+$", "")


def target_phrase(statement: Col, target_class: Col) -> Column:
    """What stands before the statement's relation; the class itself if that is empty or doesn't name the class."""
    text, cls = F.trim(c(statement)), clean_phrase(target_class)
    at = [F.regexp_instr(text, F.lit(f"(?i){p}")) for p in RELATION_PATTERNS]
    cut = F.coalesce(*[F.when(i > 0, i) for i in at], F.length(text) + 1)
    phrase = clean_phrase(F.substring(text, F.lit(1), cut - 1))
    return F.when(phrase == "", cls).when((cls != "") & ~F.lower(phrase).contains(F.lower(cls)), cls).otherwise(phrase)


def capped(x: Col, most: int) -> Column:
    return spaced(x) if most <= 0 else F.substring(spaced(x), 1, most)


def rerank_query(query: Col, prefix: str = "") -> Column:
    head = " ".join(prefix.split())
    return F.concat(F.lit(f"{head}\nTarget: " if head else "Target: "), spaced(query))


def task_prompt(template: str, query: Col) -> Column:
    """The query in the template's place for it, else after it."""
    q, t = spaced(query), template.strip()
    if "{query}" in t:
        filled = F.concat(*[x for part in t.split("{query}") for x in (F.lit(part), q)][:-1])
    else:
        filled = F.concat(F.lit(f"{t}\n" if "Task:" in t else f"{t}\n\nTask: "), q)
    return F.when(q == "", F.lit(t)).otherwise(filled)


CAPTION = "category string, supercategory string, attributes array<string>, description string, decision string, IsClearObject string"


def structured_caption(answer: Col) -> Column:
    """A model's caption as (decision, category, supercategory, attributes, description); decision is null where the answer isn't valid.

    All five keys are needed, the last of them decision or IsClearObject.  A dropped one has nothing else; attributes are up to five
    different ones; what is vague isn't valid.
    """
    raw = json_block(answer)
    v = F.from_json(raw, CAPTION)
    keys = F.json_object_keys(raw)
    has = lambda last: F.size(F.array_except(strings(("category", "supercategory", "attributes", "description", last)), keys)) == 0
    legacy = F.lower(F.trim(v["IsClearObject"]))
    said = F.lower(F.trim(v["decision"]))
    decision = F.coalesce(F.when(said.isin("keep", "drop"), said), F.when(legacy == "true", "keep").when(legacy == "false", "drop"))
    decision = F.when(has("decision") | has("IsClearObject"), decision)
    tidy = lambda x: F.regexp_replace(spaced(F.coalesce(x, F.lit(""))), r"^[ \t\r\n\"']+|[ \t\r\n\"']+$", "")
    category, description = F.lower(tidy(v["category"])), tidy(v["description"])
    attributes = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(v["attributes"], strings(())), lambda a: F.lower(tidy(a))), lambda a: a != "")), 1, 5)
    clear = (decision == "keep") & ~category.isin(*VAGUE_CATEGORIES) & ~F.lower(description).isin(*VAGUE_DESCRIPTIONS)
    above = F.lower(tidy(v["supercategory"]))
    return F.struct(
        F.when(clear | (decision == "drop"), decision).alias("decision"),
        F.when(clear, category).alias("category"),
        F.when(clear, F.when(above == "", "other").otherwise(above)).alias("supercategory"),
        F.when(clear, attributes).otherwise(strings(())).alias("attributes"),
        F.when(clear, description).otherwise(F.lit("")).alias("description"),
    )
