"""Text cleaning and tokenising as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
import re
from string import ascii_letters, ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
URL = r"http\S+|www\.\S+"
URL_LOOSE = r"http\S+|www\S+"
MARKDOWN = r"[\*_~`#]"
POST_PREFIX = "^t3_"
# ------------------------------------------------------------ end fixed values


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_urls(c: Column | str, replacement: str = " ", pattern: str = URL) -> Column:
    """URLs replaced. Most texts hold none: a plain substring test spares them the regular expression."""
    c = _col(c)
    possible = c.contains("http") | c.contains("www")
    return F.when(possible, F.regexp_replace(c, pattern, replacement)).otherwise(c)


def remove_markdown(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), MARKDOWN, " ")


def letters_only(c: Column | str, replacement: str = " ", keep_case: bool = False) -> Column:
    """Anything but letters and white space replaced, character by character.

    The class lists every character: of ranges and ``\\s`` Java makes a chain of tests that takes many times as long.
    """
    letters = ascii_letters if keep_case else ascii_lowercase
    return F.regexp_replace(_col(c), rf"[^{letters} \t\n\x0B\f\r]", replacement)


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\s+", " ")


def strip_post_prefix(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), POST_PREFIX, "")


def has_url(c: Column | str) -> Column:
    return _col(c).rlike("http").cast("int")


def title_and_text(title: Column | str, text: Column | str) -> Column:
    """Title and text joined by one space; a missing part is skipped."""
    return F.concat_ws(" ", _col(title), _col(text))


def title_and_text_padded(title: Column | str, text: Column | str) -> Column:
    """As above, but a missing part counts as empty (and leaves its space)."""
    return F.concat_ws(" ", F.coalesce(_col(title), F.lit("")), F.coalesce(_col(text), F.lit("")))


def topic_text(c: Column | str) -> Column:
    """Lower case, no URLs, single-spaced words of a-z.

    Runs of anything but letters become one space, which is what dropping
    non-letters and then collapsing white space amounts to.
    """
    return F.trim(F.regexp_replace(remove_urls(F.lower(_col(c))), "[^a-z]+", " "))


def sentiment_text(c: Column | str) -> Column:
    """No URLs or markdown marks, single-spaced; case and punctuation stay."""
    return F.regexp_replace(remove_urls(c), r"[\s\*_~`#]+", " ")


def cluster_text(c: Column | str) -> Column:
    return letters_only(c, replacement="", keep_case=True)


def tokens(c: Column | str, drop_empty: bool = True) -> Column:
    """Lower-case words split at each white-space character.

    With ``drop_empty=False`` leading and repeated spaces yield empty tokens and
    trailing ones do not, as in ``pyspark.ml.feature.Tokenizer``.
    """
    if drop_empty:
        return F.filter(F.split(F.lower(_col(c)), r"\s+"), lambda w: w != "")
    lowered = F.lower(_col(c))
    body = F.regexp_replace(lowered, r"\s+$", "")
    return F.when((body == "") & (lowered != ""), F.array().cast("array<string>")).otherwise(F.split(body, r"\s"))


def drop_words(words: Column | str, unwanted: Iterable[str], min_length: int = 0) -> Column:
    unwanted = list(unwanted)
    def wanted(w: Column) -> Column:
        long_enough = F.length(w) >= min_length
        return long_enough & ~w.isin(unwanted) if unwanted else long_enough
    return F.filter(_col(words), wanted)


def cloud_tokens(c: Column | str, unwanted: Iterable[str], min_length: int = 3) -> Column:
    """Words kept for discussion typing: letters only, no stop words, no short words."""
    cleaned = F.regexp_replace(remove_urls(F.lower(_col(c)), "", URL_LOOSE), "[^a-z]+", " ")
    return drop_words(F.split(F.trim(cleaned), " "), unwanted, max(min_length, 1))


def suffix_stem(word: Column | str) -> Column:
    """Drop the first suffix that fits: ing, ed, es, or s from longer words."""
    word = _col(word)
    def cut(n: int) -> Column:
        return F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when(word.endswith("ing"), cut(3))
        .when(word.endswith("ed"), cut(2))
        .when(word.endswith("es"), cut(2))
        .when(word.endswith("s") & (F.length(word) > 3), cut(1))
        .otherwise(word)
    )


def any_of(keywords: Iterable[str]) -> str:
    """A regular expression matching any of the words as a substring."""
    return "|".join(re.escape(k) for k in keywords)


def keyword_class(c: Column | str, classes: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """The first class one of whose keywords occurs in the text."""
    c = _col(c)
    result = None
    for name, keywords in classes.items():
        hit = c.rlike(any_of(keywords))
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return F.lit(other) if result is None else result.otherwise(other)
