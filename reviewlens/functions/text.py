"""Text cleaning as Spark column expressions.

Everything runs inside the JVM except Unicode normalisation, which Spark has no
function for. That step ships only those texts to Arrow that hold a character
normalisation could change.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import patterns as pt
from reviewlens.functions.rules import apply_dictionary

# Above this many rules one expression per rule makes a method too long for the JIT compiler.
_NESTED_RULE_LIMIT = 100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.arrow_udf(T.StringType())
def _normalize_nfc(texts: pa.Array) -> pa.Array:
    normal = [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()]
    return pa.array(normal, pa.string())


def nfc(c: Column | str, origin: Column | str | None = None) -> Column:
    """Unicode NFC.

    ``origin`` is the stored column ``c`` was made from by lower-casing or deleting; the test for
    characters that need work then reads the stored text and ``c`` is evaluated once per row.
    """
    c = _col(c)
    unstable = _col(origin if origin is not None else c).rlike(pt.NFC_UNSTABLE)
    return F.coalesce(_normalize_nfc(F.when(unstable, c)), c)


def lower(c: Column | str) -> Column:
    return F.lower(_col(c))


def remove_emoji(c: Column | str) -> Column:
    """Texts without a character that only emoji hold are not searched."""
    def without(text: Column) -> Column:
        return F.when(text.rlike(pt.EMOJI_HINT), F.regexp_replace(text, pt.emoji_pattern(guarded=True), "")).otherwise(text)

    return bound(_col(c), without)


def mask_hashtags(c: Column | str, token: str = "HASTAG") -> Column:
    return F.regexp_replace(_col(c), pt.HASHTAG, token)


def mask_prices(c: Column | str, token: str = "PRICE") -> Column:
    return F.regexp_replace(_col(c), pt.PRICE_JAVA, token)


def strip_special(c: Column | str, chars: str = pt.SPECIAL_TRAINING, to: str = " ") -> Column:
    """Replace every special character by ``to``; an empty ``to`` deletes it."""
    return F.regexp_replace(_col(c), pt.escape_class(chars), to)


def apply_rules(c: Column | str, rules: Iterable[tuple[str, str]]) -> Column:
    """Plain substring replacements ``(written, wanted)``, one after the other.

    Lists of up to 100 become one expression per rule; longer ones go to ``functions.rules``, with the same result.
    """
    c, rules = _col(c), [(written, wanted) for written, wanted in rules if written]
    if len(rules) > _NESTED_RULE_LIMIT:
        return apply_dictionary(c, rules)
    for written, wanted in rules:
        c = F.replace(c, F.lit(written), F.lit(wanted))
    return c


def merge_rules(acronyms: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Acronyms first, then the spelling rules; a spelling rule whose result equals an acronym's
    expansion takes that acronym's place."""
    spelling = {wanted: written for written, wanted in pt.SPELLING_RULES}
    merged = {wanted: written for written, wanted in acronyms}
    merged.update(spelling)
    return [(written, wanted) for wanted, written in merged.items()]


def spelling_rules(c: Column | str, acronyms: Sequence[tuple[str, str]] = ()) -> Column:
    return F.replace(apply_rules(c, merge_rules(acronyms)), *map(F.lit, pt.DOUBLED_H))


def clean_text(
    c: Column | str,
    mode: str = "advanced",
    acronyms: Sequence[tuple[str, str]] = (),
    phrases: Sequence[tuple[str, str]] | None = None,
    missing_text: str = "",
) -> Column:
    """The training cleaner. ``basic`` leaves hashtags, prices and spelling alone.

    ``phrases`` (see ``operators.phrases``) turns on word joining in advanced mode.
    """
    if mode not in ("basic", "advanced"):
        raise ValueError("mode must be 'basic' or 'advanced'")
    text = remove_emoji(lower(nfc(c)))
    if mode == "advanced":
        text = spelling_rules(mask_prices(mask_hashtags(text)), acronyms)
    text = strip_special(text)
    if mode == "advanced" and phrases is not None:
        text = join_phrases(text, phrases)
    return F.coalesce(text, F.lit(missing_text))


def tokens(c: Column | str) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(_col(c), r"\s+"), lambda t: t != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it reads more than once and that is to be worked out once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def join_words(words: Column, hits: Column) -> Column:
    """Join ``words`` with ``_`` where ``hits`` (one '0' or '1' per neighbouring pair) says so.

    Of overlapping pairs the left one wins, so ``11`` counts as ``10``. ``words`` is read several times, see ``bound``.
    """
    joined = F.split(F.regexp_replace(hits, "11", "10"), "")
    glue = F.transform(joined, lambda hit: F.when(hit == "1", F.lit("_")).otherwise(F.lit(" ")))
    parts = F.zip_with(words, glue, lambda w, g: F.concat(w, F.coalesce(g, F.lit(""))))
    # The word array is the longer by one unless it is empty or a single word.
    return F.when(F.size(words) > 1, F.array_join(parts, "")).otherwise(F.array_join(words, ""))


def join_phrases(c: Column | str, phrases: Sequence[tuple[str, str]]) -> Column:
    """Collapse white space and write each neighbouring pair found in ``phrases`` as one word.

    For lists of thousands use ``operators.phrases.apply_phrases``, which plans them faster.
    """
    if not phrases:
        return F.array_join(tokens(c), " ")
    known = [f"{a} {b}" for a, b in phrases]

    def join(words: Column) -> Column:
        count = F.greatest(F.size(words) - 1, F.lit(0))
        # isin over literals is a hash-set probe.
        flags = F.zip_with(
            F.slice(words, 1, count), F.slice(words, 2, count),
            lambda a, b: F.when(F.concat_ws(" ", a, b).isin(known), F.lit("1")).otherwise(F.lit("0")),
        )
        return join_words(words, F.array_join(flags, ""))

    return bound(tokens(c), join)


def autocorrect(
    c: Column | str,
    keywords: Sequence[tuple[str, str]] = pt.KEYWORDS,
    boundary: str = "ascii",
    lowercased: bool = False,
) -> Column:
    """Replace whole keywords in one pass.

    ``boundary='ascii'`` lets only ASCII letters, digits and ``_`` belong to a word, so a keyword
    also ends before an accented letter; ``'unicode'`` takes all letters and digits.
    """
    c = _col(c)
    word = {"ascii": "[0-9A-Za-z_]", "unicode": r"[\p{L}\p{N}_]"}[boundary]
    first = pt.escape_class("".join(sorted({written[0] for written, _ in keywords})))
    choices = "|".join(sorted((written for written, _ in keywords), key=len, reverse=True))
    flags = "" if lowercased else "(?iu)"
    pattern = rf"{flags}(?={first})(?<!{word})(?:{choices})(?!{word})"
    table = F.create_map(*[F.lit(x) for pair in keywords for x in pair])

    def replaced(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.array_join(
            F.zip_with(
                F.split(text, pattern), found,
                lambda b, f: F.concat(b, F.coalesce(F.try_element_at(table, F.lower(f)), F.lit(""))),
            ),
            "",
        )

    return bound(c, replaced)


def clean_base(c: Column | str) -> Column:
    """Lower-case, drop emoji, then normalise."""
    return nfc(remove_emoji(lower(c)), origin=c)


def clean_annotation(c: Column | str, boundary: str = "ascii") -> Column:
    """The annotation cleaner. Keywords are replaced before prices are looked for."""
    text = autocorrect(clean_base(c), boundary=boundary, lowercased=True)
    text = mask_hashtags(mask_prices(text, "giá_tiền"), "hashtag")
    return strip_special(text, pt.SPECIAL_ANNOTATION, "")
