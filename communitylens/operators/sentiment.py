"""Lexicon- and rule-based sentiment after Hutto & Gilbert, "VADER" (ICWSM 2014).

The lexicon is a ``(term, valence)`` table. A word's valence passes the published rules in
their order: "no" before a lexicon word, capitals, then for each of the three words before, nearest
first, its degree modifier and after that its negation, then idioms, "least", and the contrast
around "but". Exclamation and question marks count for the whole text. Words before that are in the
lexicon themselves neither modify nor negate. The built-in lexicon is a small part of the published
one, whose MIT licence asks for this notice: Copyright (c) 2016 C.J. Hutto.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import labels
from communitylens.session import literal_table

# ---------------------------------------------------------------- fixed values
NEGATORS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't",
    "can't", "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt",
    "mightnt", "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't",
    "mustn't", "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't", "shouldn't",
    "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom",
    "despite",
)
BOOSTERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously", "fully",
    "greatly", "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most",
    "particularly", "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly",
    "totally", "tremendously", "unbelievably", "unusually", "utterly", "very",
)
DAMPENERS = (
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat", "sorta",
)
CONTRAST = "but"
#: Modifiers of several words, and phrases with a valence of their own.
PHRASES = ("just enough", "kind of", "sort of")
IDIOMS = (
    ("the shit", 3.0), ("the bomb", 3.0), ("bad ass", 1.5), ("bus stop", 0.0), ("yeah right", -2.0), ("kiss of death", -1.5),
    ("to die for", 3.0), ("beating heart", 3.1), ("broken heart", -2.9),
)

# A small general-purpose lexicon on the published -4..4 scale; pass a larger one
# as a table where coverage matters.
LEXICON = (
    ("amazing", 2.8), ("awesome", 3.1), ("beautiful", 2.9), ("benefit", 2.0), ("best", 3.2),
    ("better", 1.9), ("brilliant", 2.8), ("celebrate", 2.7), ("clever", 2.0), ("cool", 1.3),
    ("creative", 1.9), ("easy", 1.9), ("efficient", 1.8), ("enjoy", 2.2), ("excellent", 2.7),
    ("exciting", 2.2), ("fair", 1.3), ("fantastic", 2.6), ("free", 2.3), ("fun", 2.3),
    ("glad", 2.0), ("good", 1.9), ("great", 3.1), ("happy", 2.7), ("help", 1.7),
    ("helpful", 1.8), ("hope", 1.9), ("impressive", 2.3), ("improve", 1.9), ("interesting", 1.7),
    ("kind", 2.4), ("like", 1.5), ("love", 3.2), ("lovely", 2.8), ("nice", 1.8),
    ("perfect", 2.7), ("positive", 2.6), ("progress", 1.8), ("safe", 1.9), ("smart", 1.7),
    ("strong", 2.3), ("success", 2.7), ("support", 1.7), ("thanks", 1.9), ("trust", 2.3),
    ("useful", 1.9), ("win", 2.8), ("wonderful", 2.7),
    ("abuse", -3.2), ("afraid", -2.0), ("angry", -2.3), ("annoying", -1.7), ("attack", -2.1),
    ("awful", -2.0), ("bad", -2.5), ("boring", -1.3), ("broken", -2.1), ("crash", -1.7),
    ("crime", -2.5), ("danger", -2.4), ("dead", -3.3), ("disappointed", -1.9), ("disaster", -3.1),
    ("dumb", -2.3), ("error", -1.7), ("evil", -3.4), ("fail", -2.5), ("fake", -2.1),
    ("fear", -2.2), ("fraud", -2.8), ("hate", -2.7), ("horrible", -2.5), ("hurt", -2.4),
    ("kill", -3.7), ("lie", -1.6), ("lose", -1.7), ("mad", -2.2), ("no", -1.2),
    ("poor", -2.1), ("problem", -1.7), ("risk", -1.1), ("sad", -2.1), ("scam", -2.7),
    ("scary", -2.2), ("sick", -2.3), ("stupid", -2.4), ("terrible", -2.1), ("threat", -2.4),
    ("ugly", -2.3), ("useless", -1.8), ("war", -2.9), ("waste", -1.8), ("weak", -1.9),
    ("worse", -2.1), ("worst", -3.1), ("worthless", -1.9), ("wrong", -2.1),
)
# ------------------------------------------------------------ end fixed values

@dataclass(frozen=True)
class Rules:
    """Words that change the valence of the words after them."""

    negators: tuple[str, ...] = NEGATORS
    boosters: tuple[str, ...] = BOOSTERS
    dampeners: tuple[str, ...] = DAMPENERS
    contrast: str = CONTRAST
    phrases: tuple[str, ...] = PHRASES
    idioms: tuple[tuple[str, float], ...] = IDIOMS


def default_lexicon(spark: SparkSession) -> DataFrame:
    return literal_table(spark, LEXICON, "term string, valence double")


def _word(raw: Column, bare: Column) -> Column:
    """Outer punctuation off, unless that leaves two characters or fewer (emoticons)."""
    return F.when(F.length(bare) <= 2, raw).otherwise(bare)


def _shouted(word: Column) -> Column:
    return (word != F.lower(word)) & (word == F.upper(word))


def _emphasis(text: Column) -> Column:
    """Added strength from exclamation and question marks."""
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    asks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    asked = F.when(asks <= 1, 0.0).when(asks <= 3, asks * K.QUESTION_STEP).otherwise(K.QUESTION_MANY)
    return F.least(marks, F.lit(K.EXCLAMATION_MAX)) * K.EXCLAMATION_STEP + asked


def _modifier(step: Column, shouts: Column, valence: Column) -> Column:
    """What a word before adds to a valence: away from zero when boosting, towards it when dampening."""
    shout = F.when(shouts, F.when(valence > 0, K.CAPS_STEP).otherwise(-K.CAPS_STEP)).otherwise(0.0)
    return F.coalesce(F.when(valence < 0, -step).otherwise(step) + shout, F.lit(0.0))


def _negation(n: int, low: list[Column], rules: Rules) -> Column:
    """The factor for the n-th word before; ``low`` are the three words before, in lower case, nearest first."""
    emphatic, plain = [word.isin("so", "this") for word in low], F.contains(low[n - 1], F.lit("n't")) | low[n - 1].isin(*rules.negators)
    factor = F.when(plain, K.NEGATION_FACTOR).otherwise(1.0)
    if n == 1:
        return factor
    never = (low[n - 1] == "never") & emphatic[n - 2]
    doubt = (low[n - 1] == "without") & (low[n - 2] == "doubt")
    if n == 3:
        never, doubt = never | emphatic[0], doubt | (low[0] == "doubt")
    return F.when(never, K.NEVER_SO_FACTOR).when(doubt, 1.0).otherwise(factor)


def _places(word: Column, low: list[Column], after: list[Column]) -> list[Column]:
    """The phrases around a word that may be idioms or modifiers: five that end before or at it, two that start with it."""
    one, two, three = low
    before = [F.concat_ws(" ", *words) for words in ((one, word), (two, one, word), (two, one), (three, two, one), (three, two))]
    return [*before, F.concat_ws(" ", word, after[0], after[1]), F.concat_ws(" ", word, after[0])]


def _idiom(places: list[Column], rules: Rules) -> tuple[Column, Column]:
    """The valence of an idiom among the places, else null; what phrases of modifiers add."""
    idiom, phrase = F.lit(None).cast("double"), F.lit(0.0)
    if rules.idioms:
        values = dict(reversed(rules.idioms))  # of a repeated idiom the first value counts
        names, known = F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values()))
        idiom = F.coalesce(*[F.get(known, (F.array_position(names, place) - 1).cast("int")) for place in (*places[5:], *places[:5])])
    for place in (places[3], places[4], places[2]):
        phrase = phrase + F.when(place.isin(*rules.phrases), -K.BOOSTER_STEP).otherwise(0.0)
    return idiom, phrase


def compound(total: Column, emphasis: Column) -> Column:
    """A sum of valences squeezed into [-1, 1]."""
    total = total + F.signum(total) * emphasis
    score = total / F.sqrt(total * total + K.VALENCE_NORMALISER)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


#: Terms that a lexicon may have: they are tested inside the row, as one set in the plan.
MOST_TERMS = 200_000


def _terms(lexicon: DataFrame) -> list[str]:
    """The lexicon's terms; a lexicon is a word list, and one beyond the bound is refused, not cut."""
    rows = lexicon.select("term").where("term is not null").distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a lexicon has at most {MOST_TERMS} terms")
    return sorted(r[0] for r in rows)


def score_sentiment(df: DataFrame, text: str, keys: Sequence[str], lexicon: DataFrame | None = None,
                    alias: str = "sentiment_score", copies: str | None = None, rules: Rules = Rules()) -> DataFrame:
    """(keys..., sentiment_score) per text; texts without lexicon words, and missing texts, score 0.0.

    A text is split, stripped and lower-cased once. Only positions of lexicon words leave its row, each with the
    three words before and the two behind, so the rules need no window and no join but the one with the words'
    valences; one row per text remains to be shuffled.

    Rows equal in all keys and in text are one document; ``copies`` names a column
    for how many there were. With a unique key the result has one row per input row.
    """
    lexicon = default_lexicon(df.sparkSession) if lexicon is None else lexicon
    valences = lexicon.groupBy(F.col("term").alias("_term")).agg(F.max("valence").alias("_valence"))
    terms = _terms(lexicon)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    contrast_at = F.when(
        F.contains(F.lower("_body"), F.lit(rules.contrast)), F.array_position("_low", rules.contrast) - 1,
    ).otherwise(-1)
    capitals = F.exists("_raw", _shouted) & F.exists("_raw", lambda w: (w != "") & ~_shouted(w))

    # Two independent hashes stand for the text from here on.
    document = [*keys, "_hash1", "_hash2"]
    places = F.sequence(F.lit(0), F.size("_low") - 1)

    def near(words: str, shift: int) -> Column:
        return F.coalesce(F.get(words, F.col("_at") + shift), F.lit(""))

    def in_lexicon(word: Column) -> Column:
        return word.isin(terms) if terms else F.lit(False)

    rows = (
        df.select(*keys, F.xxhash64(body).alias("_hash1"), F.hash(body).alias("_hash2"), body.alias("_body"))
        .withColumn("_raw", F.split(F.trim("_body"), r"\s+"))
        .withColumn("_words", F.zip_with("_raw", F.transform("_raw", lambda w: F.btrim(w, F.lit(string.punctuation))), _word))
        .withColumn("_low", F.transform("_words", F.lower))
        .select(
            *document, _emphasis(F.col("_body")).alias("_emphasis"), capitals.alias("_capitals"), contrast_at.alias("_contrast"),
            "_words", "_low", F.filter(places, lambda i: in_lexicon(F.get("_low", i))).alias("_hits"),
        )
        .select(*document, "_emphasis", "_capitals", "_contrast", "_words", "_low", F.posexplode_outer("_hits").alias("_nth", "_at"))
        .select(
            *document, "_emphasis", "_contrast", "_at", (F.coalesce("_nth", F.lit(0)) == 0).alias("_first"), near("_low", 0).alias("_word"),
            *[near("_low", -n).alias(f"_before{n}") for n in (1, 2, 3)], *[near("_low", n).alias(f"_after{n}") for n in (1, 2)],
            *[(F.col("_capitals") & _shouted(near("_words", -n))).alias(f"_shout{n}") for n in (0, 1, 2, 3)],
        )
    )
    found = rows.join(valences, F.col("_at").isNotNull() & (F.col("_word") == F.col("_term")), "left")

    word, at, low, after = F.col("_word"), F.col("_at"), [F.col(f"_before{n}") for n in (1, 2, 3)], [F.col("_after1"), F.col("_after2")]
    heard = [(at >= n) & ~in_lexicon(low[n - 1]) for n in (1, 2, 3)]
    denied = (low[0] == "no") | (low[1] == "no") | ((low[2] == "no") & low[0].isin("or", "nor"))
    start = F.when(denied, F.col("_valence") * K.NEGATION_FACTOR).when((word == "no") & in_lexicon(after[0]), 0.0 * F.col("_valence")).otherwise(F.col("_valence"))
    found = found.withColumn("_value", start)
    loud = F.when(F.col("_shout0"), F.when(F.col("_value") > 0, K.CAPS_STEP).otherwise(-K.CAPS_STEP)).otherwise(0.0)

    # The three words before are one array that is folded: laid out one after the other, the rules become
    # a method of generated code that is too long to be compiled.
    steps = F.array(*[F.when(heard[n - 1], F.struct(
        F.when(low[n - 1].isin(*rules.boosters), K.BOOSTER_STEP).when(low[n - 1].isin(*rules.dampeners), -K.BOOSTER_STEP).alias("step"),
        F.col(f"_shout{n}").alias("shouts"), F.lit(K.BOOSTER_DAMPING[n - 1]).alias("damping"), _negation(n, low, rules).alias("factor"),
    )) for n in (1, 2, 3)])
    value = F.aggregate(steps, F.col("_value") + loud, lambda v, w: F.when(
        w.isNotNull(), (v + _modifier(w["step"], w["shouts"], v) * w["damping"]) * w["factor"]).otherwise(v))
    idiom, phrase = _idiom(_places(word, low, after), rules)
    value = F.coalesce(F.when(heard[2], idiom), value) + F.when(heard[2], phrase).otherwise(0.0)
    least = (low[0] == "least") & ~in_lexicon(low[0]) & ((at == 1) | ~low[1].isin("at", "very"))
    silent = word.isin(*rules.boosters, *rules.dampeners) | ((word == "kind") & (after[0] == "of"))
    contrast = F.col("_contrast")
    value = F.when(silent, F.lit(0.0)).otherwise(value * F.when(least, K.NEGATION_FACTOR).otherwise(1.0)) * (
        F.when((contrast < 0) | (at == contrast), 1.0).when(at < contrast, K.CONTRAST_BEFORE)
        .otherwise(K.CONTRAST_AFTER)
    )

    scored = found.groupBy(*document).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("_total"),
        F.first("_emphasis").alias("_emphasis"),
        F.count_if("_first").alias("_copies"),
    )
    # Equal rows were summed together; dividing by their number gives the score of one.
    result = [*keys, compound(F.col("_total") / F.col("_copies"), F.col("_emphasis")).alias(alias)]
    if copies:
        result.append(F.col("_copies").alias(copies))
    return scored.select(*result)


def with_class(df: DataFrame, score: str = "sentiment_score", alias: str = "sentiment_category") -> DataFrame:
    return df.withColumn(alias, labels.sentiment_class(score))
