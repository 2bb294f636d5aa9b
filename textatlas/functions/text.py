"""Text functions on columns. All but NFKC are native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that a broken font encoding swaps, and what they stand for.
FONT_ARTIFACTS = ("ŸŠšã", "üäöß")
# Hyphen-minus, hyphen, non-breaking hyphen, figure dash, en dash, em dash, horizontal bar, minus, soft hyphen.
DASHES = "-‐‑‒–—―−­"
# The letters that cleaned German text keeps.
LETTERS = "a-zA-ZäöüÄÖÜßéèêëçñ"
# Tokens of topic models.
TOPIC_TOKEN = r"(?U)\b[^\W\d_]{3,}\b"
WORD_TOKEN = r"(?U)\b\w\w+\b"

# Unicode blanks as Python's \s has them; Java's has no information separators.
_S = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x bound to value, evaluated once even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _regexp(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, "(?U)" + pattern, to)


def remap_font_artifacts(text: Column) -> Column:
    return F.translate(text, *FONT_ARTIFACTS)


def unify_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


#: Characters that NFKC leaves alone, as long as no other one is in the text: ASCII, precomposed Latin letters, quotation marks.
NFKC_STABLE = "\x00-\x7f\u00c0-\u0131\u2018-\u201e"
#: Of these, the ones that no step of normalize_text() changes: all but the artefact \u00e3. The other artefacts and the dashes lie outside.
_PLAIN = "\x00-\x7f\u00c0-\u00e2\u00e4-\u0131\u2018-\u201e"
# The plain characters one by one: those that clean_text() deletes, and the blanks.
_PLAIN_LIST = [chr(c) for c in range(0x2100) if re.match(f"[{_PLAIN}]", chr(c))]
_PLAIN_BLANKS = "".join(c for c in _PLAIN_LIST if re.match(r"\s", c))
_PLAIN_DELETED = "".join(c for c in _PLAIN_LIST if not re.match(rf"[{LETTERS}\s,.;:/-]", c))


def nfkc_changed(text: Column) -> Column:
    """The NFKC form of a text that it may change; null for others, which Python doesn't see."""
    return _nfkc(F.when(~text.rlike(rf"^[{NFKC_STABLE}]*\z"), text))


def is_plain(text: Column) -> Column:
    """Whether no step of normalize_text() changes the text, and clean_words() can go by a list of characters."""
    return text.rlike(rf"^[{_PLAIN}]*\z")


def normalize_text(text: Column, nfkc: bool = True) -> Column:
    """Font artefacts, then dashes, then NFKC, for which there is no native function: only texts that it may change go to
    Python. nfkc=False leaves it out. A text of plain characters only is passed on after one look."""
    plain = is_plain(text)
    out = F.when(plain, text).otherwise(unify_dashes(remap_font_artifacts(text)))
    if not nfkc:
        return out
    changed = nfkc_changed(F.when(plain, F.lit(None)).otherwise(out))
    return F.when(plain, text).otherwise(F.coalesce(changed, out))


def drop_numbering(text: Column) -> Column:
    """Joins words split at line ends, removes stand-alone numbers and dot leaders."""
    out = _regexp(text, rf"-{_S}*\n{_S}*")
    out = _regexp(out, rf"(?=\d)\b\d+(\.\d+)*\.?(?={_S}|\z)")  # the digit is looked for first: that is quicker than a word's bound
    return _regexp(out, rf"\.({_S}*\.){{3,}}")


def clean_text(text: Column) -> Column:
    """Running text of the expected alphabet with single blanks, as keyword search wants it."""
    out = _regexp(drop_numbering(text), rf"[^{LETTERS}\s\x1c-\x1f,.;:/-]+")
    # a run of blanks with a line end among them becomes one blank like any other run; a single blank stays as it is
    return F.trim(_regexp(out, rf"{_S}{{2,}}|[^\S ]|[\x1c-\x1f]", " "))


def clean_words(text: Column, plain: Column) -> Column:
    """The words of clean_text(text). `plain`: where is_plain(text) holds, or a condition that implies it.

    A plain text's characters are few: one translation takes the place of the two last expressions of clean_text()."""
    kept = drop_numbering(text)
    translated = F.translate(kept, _PLAIN_BLANKS + _PLAIN_DELETED, " " * len(_PLAIN_BLANKS))
    replaced = _regexp(_regexp(kept, rf"[^{LETTERS}\s\x1c-\x1f,.;:/-]+"), rf"{_S}+", " ")
    return F.array_remove(F.split(F.when(plain, translated).otherwise(replaced), " "), "")


def stripped_letters(text: Column) -> Column:
    """Sorted distinct letters that clean_text() would delete: a sign of a font-encoding fault."""
    letters = F.regexp_extract_all(drop_numbering(text), F.lit(rf"[\p{{L}}&&[^{LETTERS}]]"), F.lit(0))
    return F.array_sort(F.array_distinct(letters))


def words(text: Column) -> Column:
    """Words between Unicode blanks."""
    return F.array_remove(F.split(text, f"(?U){_S}+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("int")  # a split is quicker than a count of matches


def word_context(text: Column, start: Column, size: int) -> Column:
    """`size` words on both sides of the word at character offset `start` (from 0), with it; null if there is none.

    As in a text whose words are joined by single blanks: a word's stretch includes the blank that follows it."""

    def of(array: Column) -> Column:
        return let(F.array_join(array, " "), lambda joined: F.when((start >= 0) & (start < F.length(joined)), context_of(array, blanks(F.substring(joined, F.lit(1), start.cast("int"))), size)))

    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    return let(words(text), of)


def context_of(array: Column, at: Column, size: int) -> Column:
    """Elements at - size to at + size of an array of words, joined; `at` counts from 0."""
    first = F.greatest(at - size, F.lit(0))
    return F.array_join(F.slice(array, first + 1, F.least(at + size + 1, F.size(array)) - first), " ")


def without(tokens: Column, stopwords: list[str] | Column | None) -> Column:
    if stopwords is None:
        return tokens
    stop = stopwords if isinstance(stopwords, Column) else F.array(*[F.lit(w) for w in stopwords]).cast("array<string>")
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def topic_tokens(text: Column, stopwords: list[str] | Column | None = None) -> Column:
    """Lower-case words of at least three letters, without stopwords."""
    return without(F.regexp_extract_all(F.lower(text), F.lit(TOPIC_TOKEN), F.lit(0)), stopwords)


def with_bigrams(tokens: Column) -> Column:
    """Tokens, then pairs of neighbours; stopwords have to be gone before."""
    return let(
        tokens,
        lambda t: F.concat(
            t,
            F.zip_with(
                F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
                F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                lambda a, b: F.concat_ws(" ", a, b),
            ),
        ),
    )


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two word characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKEN), F.lit(0))


def lda_words(text: Column, stopwords: list[str] | Column | None = None, lemmas: dict[str, str] | None = None) -> Column:
    """Lower-case lemmas for LDA: words of over two letters that aren't stopwords, nor is their lemma. Null text: none.

    lemmas: lower-case word -> lemma; a word that isn't in it is its own lemma."""
    kept = _regexp(F.coalesce(text, F.lit("")), rf"[^{LETTERS}\s\x1c-\x1f]")
    surface = F.filter(words(kept), lambda w: F.length(w) > 2)
    surface = without(F.transform(surface, F.lower), stopwords)
    if lemmas:
        table = F.create_map(*[F.lit(x) for pair in sorted(lemmas.items()) for x in pair])
        surface = F.transform(surface, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return without(surface, stopwords)


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first and small letters after, as Python's str.title()."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))), "")


def strip_diacritics(text: Column) -> Column:
    """Latin letters without their marks: those that decompose into one base letter and marks, by a rule over code points."""
    import unicodedata

    pairs = {}
    for c in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFKD", chr(c))
        if len(parts) > 1 and not any(map(unicodedata.combining, parts[0])) and all(map(unicodedata.combining, parts[1:])):
            pairs[chr(c)] = parts[0]
    loose = F.regexp_replace(text, r"\p{Mn}+", "")
    return F.translate(loose, "".join(pairs), "".join(pairs.values()))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_-]+", "_")


def csv_cell(text: Column) -> Column:
    """Quoted only where it holds a quote, comma or newline; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def html_text(text: Column) -> Column:
    """Escapes & < > " ' for HTML."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def content_focused(text: Column, strip_terms: list[str]) -> Column:
    """The text without the given terms (whole words, any case), blanks collapsed."""
    terms = "|".join(sorted(("\\Q" + t + "\\E" for t in strip_terms), key=len, reverse=True))
    gone = F.regexp_replace(text, rf"(?iU)\b({terms})\b", " ")
    return F.trim(_regexp(gone, rf"{_S}+", " "))
