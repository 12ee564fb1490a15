"""News text, names and raw pages, as column
expressions. Texts are lower-cased whole; nulls count as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weighted words.
POSITIVE = {
    "victory": 0.8, "wins": 0.7, "win": 0.6, "triumph": 0.8, "dominant": 0.7, "brilliant": 0.8, "excellent": 0.7, "impressive": 0.6, "outstanding": 0.8, "superb": 0.7,
    "confident": 0.5, "optimistic": 0.5, "boost": 0.5, "returns": 0.4, "fit": 0.4, "recovered": 0.5, "unbeaten": 0.6, "streak": 0.3, "form": 0.3, "signing": 0.4,
    "deal": 0.3, "strengthen": 0.5, "clean sheet": 0.5, "shutout": 0.5, "positive": 0.3, "good": 0.2, "strong": 0.3, "improved": 0.3, "progress": 0.3, "momentum": 0.4,
}
NEGATIVE = {
    "injury": -0.7, "injured": -0.7, "sidelined": -0.8, "ruled out": -0.9, "surgery": -0.9, "torn": -0.8, "sacked": -0.8, "fired": -0.8, "dismissed": -0.7, "defeat": -0.6,
    "loss": -0.5, "lost": -0.5, "crisis": -0.8, "disaster": -0.8, "suspended": -0.6, "ban": -0.6, "red card": -0.6, "doubt": -0.4, "doubtful": -0.5, "concern": -0.4,
    "struggling": -0.5, "slump": -0.6, "poor": -0.4, "relegation": -0.5, "drop": -0.3, "hamstring": -0.6, "knee": -0.5, "ankle": -0.5, "muscle": -0.5, "fracture": -0.8,
    "concussion": -0.7, "miss": -0.3, "missing": -0.4, "absence": -0.4, "fatigue": -0.3, "tired": -0.3, "rotation": -0.2, "criticism": -0.3, "pressure": -0.2,
}
# Aspect patterns; the first ten of morale are the good ones.
ASPECTS = {
    "injury": ["injur(?:y|ed|ies)", "sidelined", "ruled out", "hamstring", "knee", "ankle", "muscle", "torn", "fracture", "surgery", "concussion", "fitness (?:doubt|concern|test)"],
    "manager": ["sacked", "fired", "dismissed", "new manager", "managerial change", "interim", "appointment", "steps down", "resigned", "leaves"],
    "transfer": ["sign(?:s|ed|ing)", "transfer", "loan", "deal", "bid", "offer", "target", "acquire"],
    "morale": ["confident", "belief", "togeth", "spirit", "determination", "delight", "thrilled", "motivated", "focused", "ready", "under pressure", "tensions?", "conflict", "unhappy", "frustrated", "worried", "concern"],
    "tactical": ["new formation", "tactical", "system change", "switch", "playing style", "press(?:ing)?", "counter.attack", "defensive", "attacking"],
    "key_player": ["captain", "star player", "key player", "top scorer", "playmaker", "goalkeeper", "centre.back"],
}
# Whole-word terms and their modifiers.
TERMS_FOR = [
    "win", "victory", "dominant", "impressive", "excellent", "superb", "brilliant", "outstanding", "confident", "strong", "unbeaten", "streak", "form", "scoring", "clean sheet", "top", "title",
    "champions", "promoted", "boost", "return", "fit", "signing", "transfer", "new signing", "momentum", "crucial", "comeback", "clinical", "world-class", "lethal", "unstoppable", "perfect",
]
TERMS_AGAINST = [
    "loss", "defeat", "poor", "terrible", "dreadful", "struggling", "crisis", "sacked", "fired", "injured", "injury", "suspended", "banned", "red card", "relegated", "bottom", "worst", "collapse",
    "nightmare", "dismal", "woeful", "dire", "slump", "concern", "doubt", "uncertain", "setback", "blow", "miss", "absent", "hamstring", "knee", "ligament", "fracture", "ruled out",
]
AMPLIFIERS = ["very", "extremely", "highly", "absolutely", "completely"]
NEGATORS = ["not", "no", "never", "hardly", "barely", "without"]
_SUFFIXES = (" FC", " AFC", " F.C.", " A.F.C.")


def lower(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def lexicon_score(text: str, lexicon: dict[str, float]) -> Column:
    """Weights of all occurrences, as substrings, over their number; within -1 and 1."""
    t = lower(text)
    count = {w: (F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / F.lit(len(w)) for w in lexicon}
    hits = sum(count.values(), F.lit(0.0))
    weighed = sum((c * F.lit(float(lexicon[w])) for w, c in count.items()), F.lit(0.0))
    return F.when(hits > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(weighed, hits)))).otherwise(0.0)


def aspect(text: str, patterns: list[str]) -> Column:
    """How many of the patterns occur at all."""
    return sum((lower(text).rlike(p).cast("int") for p in patterns), F.lit(0))


def morale(text: str, patterns: list[str] | None = None, good: int = 10) -> Column:
    """T3."""
    p = patterns or ASPECTS["morale"]
    up, down = aspect(text, p[:good]), aspect(text, p[good:])
    return (up - down) / F.greatest(up + down, F.lit(1))


def recency(published: str, as_of: str) -> Column:
    """Weight of an article at an explicit time, 0.3 at least, after five days."""
    hours = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.col(published))) / 3600
    return F.greatest(F.lit(0.3), 1 - hours / 120)


def token_sentiment(text: str, for_: list[str] = TERMS_FOR, against: list[str] = TERMS_AGAINST, negators: list[str] = NEGATORS, amplifiers: list[str] = AMPLIFIERS) -> Column:
    """T9 as struct (sentiment, positive, negative, subjectivity): each word looks back at
    one modifier and forward for a phrase of two. The words are zipped with their
    neighbours, since a lookup by index inside the lambda would split the text once a word;
    one lookup a word leaves only those that are terms or begin a phrase."""
    words = F.filter(F.split(lower(text), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    within = lambda w, terms: w.isin(*terms)
    marked = sorted({t.split(" ")[0] for t in [*for_, *against]})

    none = F.array(F.lit(""))
    zipped = F.arrays_zip(words.alias("w"), F.slice(F.concat(none, words), 1, F.size(words)).alias("p"), F.concat(F.slice(words, 2, F.size(words)), none).alias("n"))

    def per_word(x: Column) -> Column:
        w, before = x["w"], x["p"]
        turned, times = within(before, negators), F.when(within(before, amplifiers), 1.5).otherwise(1.0)
        phrase = F.concat(w, F.lit(" "), x["n"])
        up = F.when(within(w, for_), F.when(turned, 0.0).otherwise(times)).when(within(w, against), F.when(turned, times * 0.5).otherwise(0.0)).otherwise(0.0)
        down = F.when(within(w, for_), F.when(turned, times).otherwise(0.0)).when(within(w, against), F.when(turned, 0.0).otherwise(times)).otherwise(0.0)
        up += F.when(within(phrase, for_), F.when(turned, 0.0).otherwise(1.5)).when(within(phrase, against), F.when(turned, 0.5).otherwise(0.0)).otherwise(0.0)
        down += F.when(within(phrase, for_), F.when(turned, 1.5).otherwise(0.0)).when(within(phrase, against), F.when(turned, 0.0).otherwise(1.5)).otherwise(0.0)
        return F.struct(up.alias("up"), down.alias("down"))

    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    total = F.aggregate(F.transform(F.filter(zipped, lambda x: x["w"].isin(*marked)), per_word), zero, lambda s, x: F.struct((s["up"] + x["up"]).alias("up"), (s["down"] + x["down"]).alias("down")))
    n, both = F.size(words), total["up"] + total["down"]
    part = lambda c: F.when(both > 0, F.round(c, 4)).otherwise(0.0)
    return F.struct(
        part((total["up"] - total["down"]) / F.greatest(both, F.lit(1.0))).alias("sentiment"), part(F.try_divide(total["up"], n)).alias("positive"),
        part(F.try_divide(total["down"], n)).alias("negative"), part(F.least(F.try_divide(both, n * 0.1), F.lit(1.0))).alias("subjectivity"),
    )


def amplified(score: Column, injuries: Column) -> tuple[Column, Column]:
    """Each injury pattern in an article takes 0.12 off its score; where there is one, the
    score counts as having content."""
    return F.when(score.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score - 0.12 * injuries))), F.when(injuries > 0, 1).otherwise(0)


def team_news(articles: DataFrame, team: str = "team") -> DataFrame:
    """One row a team from its articles (score, has_content 0 or 1, injury, manager,
    transfer, morale, tactical, key_player): means, consensus 1 - deviation (0.5 alone, 0 without
    content), and rates an article of at most 1. A null score has no content."""
    content = F.when((F.col("has_content") == 1) & F.col("score").isNotNull(), F.col("score"))
    n, seen = F.count("*"), F.count(content)
    rate = lambda c: F.least(F.lit(1.0), F.coalesce(F.sum(c), F.lit(0)) / n)
    known = lambda x: F.when(seen > 0, x).otherwise(0.0)
    return articles.groupBy(team).agg(
        known(F.avg(content)).alias("sentiment"), F.least(F.lit(1.0), seen / 10).alias("confidence"), n.alias("volume"),
        known(rate("injury")).alias("injury_risk"), known(rate("manager")).alias("manager_instability"), known(rate("transfer")).alias("transfer_activity"),
        known(F.when(seen > 1, 1 - F.stddev_pop(content)).otherwise(0.5)).alias("consensus"), known(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg("morale")))).alias("morale"),
        known(rate("tactical")).alias("tactical_disruption"), known(rate("key_player")).alias("key_player_concern"),
    )


def by_team(articles: DataFrame, team: str = "team") -> DataFrame:
    """Mean of each part, volume, and consensus 1 - sample deviation, 0.5 alone."""
    alone = F.count("*") == 1
    return articles.groupBy(team).agg(
        *[F.avg(c).alias(c) for c in ("sentiment", "positive", "negative", "subjectivity")], F.count("*").alias("volume"),
        F.when(alone, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_samp("sentiment"))).alias("consensus"),
    )


def normalised_team(name: str, known: dict[str, str]) -> Column:
    """Trimmed name, mapped as it is, without a club suffix, or with & written out; else
    as it is. known is a small fixed map, so it is a literal."""
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    bare = F.trim(F.col(name))
    cut = bare
    for s in reversed(_SUFFIXES):
        cut = F.when(bare.endswith(s), F.trim(F.substring(bare, F.lit(1), F.length(bare) - len(s)))).otherwise(cut)
    spelt = F.replace(F.replace(bare, F.lit("&"), F.lit("and")), F.lit("  "), F.lit(" "))
    spelt_cut = spelt
    for s in reversed(_SUFFIXES):
        spelt_cut = F.when(spelt.endswith(s), F.trim(F.substring(spelt, F.lit(1), F.length(spelt) - len(s)))).otherwise(spelt_cut)
    return F.coalesce(*[F.try_element_at(lookup, c) for c in (bare, cut, spelt, spelt_cut)], bare)


def feed_titles(html: str, skip: int = 2, most: int = 30) -> Column:
    """Titles of a feed after its own first ones, tags stripped."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("(?s)<title>(.*?)</title>"), F.lit(1))
    return F.transform(F.slice(found, skip + 1, most), lambda t: F.regexp_replace(t, "<[^>]+>", ""))


def embedded_json(script: str, schema: str) -> Column:
    """The JSON inside JSON.parse('...') with its escaped characters."""
    raw = F.regexp_extract(F.col(script), r"JSON\.parse\('((?:[^'\\]|\\.)*)'\)", 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\\x22", '"'), r"\\x5B", "["), r"\\x5D", "]")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\\x7B", "{"), r"\\x7D", "}"), r"\\x3A", ":")
    return F.from_json(plain, schema)


def short_hash(text: str) -> Column:
    """T14."""
    return F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 16)
