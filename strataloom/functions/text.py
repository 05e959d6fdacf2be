"""Identifier, keyword and token functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without a meaning of their own, in alphabetical order.
STOP_WORDS = tuple(sorted("all an and any as at be by can do for from get has in is new not of on or per set the to via vs with".split()))


_LOW, _UP = "[a-z0-9]", "[A-Z]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_identifier(name: Column | str) -> Column:
    """Lower-case words of two letters and more from camel, Pascal, snake and screaming case."""
    parted = F.regexp_replace(_col(name), f"({_LOW})({_UP})", "$1 $2")
    parted = F.regexp_replace(parted, f"({_UP}+)({_UP}[a-z])", "$1 $2")
    return F.transform(F.filter(F.split(parted, "[^a-zA-Z0-9]+"), lambda t: F.length(t) >= 2), F.lower)


def noun_tokens(names: Column | str, remove_stop_words: bool = False) -> Column:
    """Distinct words of an array of identifiers, in first-seen order."""
    words = F.array_distinct(F.flatten(F.transform(_col(names), split_identifier)))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS)) if remove_stop_words else words


def query_keywords(query: Column | str) -> Column:
    """Words of a question, stop words left out, repeats kept."""
    return F.filter(F.split(F.lower(_col(query)), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def token_count(text: Column | str) -> Column:
    """Estimated tokens of a text: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4)).cast("int")


def overlap_tail(text: Column | str, tokens: int) -> Column:
    """The last `tokens` estimated tokens of a text."""
    return F.right(_col(text), F.lit(4 * tokens)) if tokens > 0 else F.lit("")


def span_tokens(start: Column, end: Column, per_line: float = 15.0) -> Column:
    """Estimated tokens of a span of source lines."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), end - start + 1) * F.lit(per_line))).cast("long")


def word_count(text: Column | str) -> Column:
    """Words between white space; 0 for a blank text."""
    trimmed = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def unwrap_type(annotation: Column | str) -> Column:
    """The class that a Python annotation names: container and optional wrappers and union alternatives dropped, null unless it begins in upper case."""
    wrapper = r"^(?:typing\.)?(?:Optional|List|Dict|Set|Tuple|Union|ClassVar|Final)\[\s*([^,\]\[]+).*$"
    left = F.trim(F.regexp_extract(F.regexp_replace(_col(annotation), wrapper, "$1"), r"^([^|\[]+)", 1))
    return F.when(left.rlike("^[A-Z]"), left)


def unfenced(text: Column | str) -> Column:
    """A JSON answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_col(text)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def embedding_text(language: Column, kind: Column, path: Column, name: Column, content: Column) -> Column:
    """A header of language, kind and place, then the content."""
    header = F.concat(F.lit("["), language, F.lit("] ["), kind, F.lit("] "), path, F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(" :: "), name)).otherwise(F.lit("")))
    return F.concat_ws("\n", header, content)


def success_rate(done: Column, failed: Column, when_none: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(done.cast("double"), (done + failed).cast("double")), F.lit(when_none))
