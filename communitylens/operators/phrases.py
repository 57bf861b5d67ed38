"""Phrases of one or several words, found in the row by walking an automaton, leftmost and longest first.

A state is the words read so far; a word leads on where the longer run begins a phrase, and a state accepts
where its run is a phrase. Both are looked up in hashed sets in the plan, so a walk costs what it reads, however
many phrases there are. One scan finds the phrases of all texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that a lexicon may have; they are part of the plan.
MOST_PHRASES = 200_000


class Phrases:
    """The automaton of a list of phrases (words separated by single blanks)."""

    def __init__(self, phrases: Sequence[str]):
        self.accepting = sorted(set(phrases))
        runs = [p.split(" ") for p in self.accepting]
        if any("" in run for run in runs):
            raise ValueError("a phrase is words separated by single blanks")
        self.longest = max(map(len, runs), default=0)
        self.states = sorted({" ".join(run[:n]) for run in runs for n in range(1, len(run) + 1)})
        self.first = sorted({run[0] for run in runs})

    def found(self, words: Column | str) -> Column:
        """An array of (at, size, phrase): the phrases in an array of words; ``at`` counts from 0.

        From each place not yet covered the longest phrase is taken. Null words are in no phrase; a null array gives null.
        """
        words = F.col(words) if isinstance(words, str) else words
        empty = F.array().cast("array<struct<at:int,size:int,phrase:string>>")
        if not self.accepting:
            return F.when(words.isNotNull(), empty)

        def walk(at: Column) -> Column:
            """The longest phrase from a place, as its number of words; 0 where there is none."""
            start = F.struct(F.get(words, at).alias("run"), F.when(F.get(words, at).isin(self.accepting), 1).otherwise(0).alias("best"))

            def step(state: Column, more: Column) -> Column:
                run = F.concat(state["run"], F.lit(" "), F.get(words, at + more))  # null behind the end, and from then on
                run = F.when(run.isin(self.states), run)
                return F.struct(run.alias("run"), F.when(run.isin(self.accepting), more + 1).otherwise(state["best"]).alias("best"))

            if self.longest == 1:
                return start["best"]
            return F.aggregate(F.sequence(F.lit(1), F.lit(self.longest - 1)), start, step, lambda state: state["best"])

        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda at: F.get(words, at).isin(self.first))
        walked = F.filter(
            F.transform(places, lambda at: F.struct(at.cast("int").alias("at"), walk(at).cast("int").alias("size"))), lambda m: m["size"] > 0)

        def keep(taken: Column, match: Column) -> Column:
            free = F.coalesce(F.try_element_at(taken, F.lit(-1))["at"] + F.try_element_at(taken, F.lit(-1))["size"], F.lit(0))
            phrase = F.array_join(F.slice(words, match["at"] + 1, match["size"]), " ")
            more = F.struct(match["at"].alias("at"), match["size"].alias("size"), phrase.alias("phrase"))
            return F.when(match["at"] >= free, F.concat(taken, F.array(more))).otherwise(taken)

        return F.when(words.isNotNull(), F.aggregate(walked, empty, keep))


def from_table(lexicon: DataFrame, phrase: str = "term") -> Phrases:
    """The automaton of a table's phrases; a list beyond MOST_PHRASES is refused, not cut."""
    rows = lexicon.select(phrase).where(F.col(phrase).isNotNull()).distinct().limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"a lexicon has at most {MOST_PHRASES} phrases")
    return Phrases([r[0] for r in rows])


def phrase_score(df: DataFrame, words: str, keys: Sequence[str], lexicon: DataFrame, automaton: Phrases | None = None) -> DataFrame:
    """(keys..., phrases, valence): phrases found in each row and the sum of their valences.

    ``lexicon`` has term and valence; of repeated terms the largest valence counts. Rows with equal keys are one.
    """
    automaton = automaton or from_table(lexicon)
    valences = lexicon.where("term is not null").groupBy(F.col("term").alias("_term")).agg(F.max("valence").alias("_valence"))
    rows = df.select(*keys, F.explode_outer(automaton.found(words)["phrase"]).alias("_phrase"))
    joined = rows.join(valences, F.col("_phrase") == F.col("_term"), "left")
    return joined.groupBy(*keys).agg(
        F.count("_phrase").alias("phrases"), F.coalesce(F.sum("_valence"), F.lit(0.0)).alias("valence"))
