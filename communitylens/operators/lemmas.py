"""Lemmas by detachment rules: endings come off, a vocabulary decides which of the results is a word.

All of it works on distinct terms: rules give candidates in the row, one semi-join keeps those that the
vocabulary knows, and the first rule that gave a word wins. A table of exceptions goes before the rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
#: (ending, replacement) of English nouns, verbs and adjectives in the published order of morphological detachment.
RULES = (
    ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", ""),
    ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""), ("er", ""), ("est", ""), ("er", "e"), ("est", "e"),
)
# ------------------------------------------------------------ end fixed values


def candidates(term: Column, rules: Sequence[tuple[str, str]] = RULES, shortest: int = 2) -> Column:
    """An array of (rule, candidate): the term itself first, then what each rule that fits leaves of at least ``shortest`` characters."""
    made = [F.struct(F.lit(0).alias("rule"), term.alias("candidate"))]
    for k, (ending, replacement) in enumerate(rules, 1):
        left = F.concat(F.substring(term, F.lit(1), F.length(term) - len(ending)), F.lit(replacement))
        fits = term.endswith(ending) & (F.length(term) - len(ending) + len(replacement) >= shortest)
        made.append(F.when(fits, F.struct(F.lit(k).alias("rule"), left.alias("candidate"))))
    return F.filter(F.array(*made), lambda c: c.isNotNull())


def lemma_table(terms: DataFrame, vocabulary: DataFrame, exceptions: DataFrame | None = None,
                rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(term, lemma) of every distinct term: its exception, else the first candidate in the vocabulary, else the term.

    ``terms`` has a column term, ``vocabulary`` word, ``exceptions`` (term, lemma), of which the least lemma counts where a
    term repeats. A term that is a word itself stays; a null term is left out.
    """
    distinct = terms.select("term").where("term is not null").distinct()
    laid = distinct.select("term", F.inline(candidates(F.col("term"), rules)))
    known = laid.join(vocabulary.select(F.col("word").alias("candidate")).distinct(), "candidate", "left_semi")
    ruled = known.groupBy("term").agg(F.min(F.struct("rule", "candidate"))["candidate"].alias("_ruled"))
    made = distinct.join(ruled, "term", "left")
    if exceptions is None:
        return made.select("term", F.coalesce("_ruled", "term").alias("lemma"))
    named = exceptions.groupBy("term").agg(F.min("lemma").alias("_named"))
    return made.join(named, "term", "left").select("term", F.coalesce("_named", "_ruled", "term").alias("lemma"))
