"""Text expressions: cleaning, language hint, titles, locations, snippets, evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode import lexicon

# Unicode whitespace as one explicit class: regex engines differ on what \s covers.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACES = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

WHITESPACE = "".join(char for char in map(chr, range(0x3001)) if char.isspace())

# Word characters and boundaries spelled out, so the result does not depend on the JDK. On ASCII text
# \\w and \\b mean the same everywhere and are several times cheaper; see by_alphabet().
WORD = r"[\p{L}\p{N}_]"
WORD_EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, however often the body mentions it.

    Plain reuse of a column object copies its whole expression tree; nested reuse then grows the plan
    exponentially and breaks code generation. Binding keeps the plan linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_present(*values: Column) -> Column:
    """First non-empty value."""
    return F.coalesce(*(blank_to_null(value) for value in values))


def by_alphabet(text: Column, ascii_form: Column, other_form: Column) -> Column:
    """The cheap form of an expression where the text is plain ASCII, the Unicode form elsewhere."""
    return F.when(F.octet_length(text) == F.length(text), ascii_form).otherwise(other_form)


def clean(text: Column) -> Column:
    """Collapse whitespace runs, trim, empty becomes NULL. Tidy ASCII text costs one cheap scan and no
    rewriting; single blanks are never replaced."""
    untidy = f"(?=[^!-~])(?:[{SPACES}]{{2,}}|[{ODD_SPACES}])"
    rewritten = F.regexp_replace(text, untidy, " ")
    tidy = by_alphabet(text, F.when(text.rlike(r"  |[\x00-\x1f]"), rewritten).otherwise(text), rewritten)
    return blank_to_null(F.trim(tidy))


def join_present(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *(blank_to_null(part) for part in parts))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def language(title: Column, letters: str = lexicon.TURKISH_LETTERS) -> Column:
    present = by_alphabet(title, F.lit(False), title.rlike(f"[{letters}]"))
    return F.when(present, "tr").otherwise("en")


def snippet(cleaned: Column, size: int = lexicon.SNIPPET_LENGTH) -> Column:
    """`cleaned` must have gone through clean()."""
    cut = F.concat(F.rtrim(F.substring(cleaned, 1, size - 3)), F.lit("..."))
    return F.when(F.length(cleaned) <= size, cleaned).otherwise(cut)


def noise_passes(words: list[str]) -> list[list[str]]:
    """The list cut around entries that end in an optional character."""
    passes: list[list[str]] = [[]]
    for word in words:
        if word.endswith("?"):
            passes += [[word], []]
        else:
            passes[-1].append(word)
    return [group for group in passes if group]


def title_core(
    cleaned: Column,
    bracket_words: list[str] = lexicon.TITLE_BRACKET_WORDS,
    noise_words: list[str] = lexicon.TITLE_NOISE_WORDS,
) -> Column:
    """Title without bracketed metadata, separators and noise words; may come out empty.

    The noise words go one after the other. Neighbours in the list share a pass, but an entry whose last
    character is optional gets one of its own: it can only take that character while its neighbour stands.
    """

    def strip(flags: str, edge: str) -> Column:
        bracket = rf"{flags}[(\[{{][^)\]}}]*{edge}(?:{'|'.join(bracket_words)}){edge}[^)\]}}]*[)\]}}]"
        core = F.regexp_replace(cleaned, bracket, " ")
        core = F.regexp_replace(core, r" *\| *", " ")
        core = F.regexp_replace(core, " [-/] ", " ")
        for words in noise_passes(noise_words):
            core = F.regexp_replace(core, rf"{flags}{edge}(?:{'|'.join(words)}){edge}", " ")
        return F.regexp_replace(core, r" *[()\[\]{},;:][()\[\]{},;: ]*| {2,}", " ")

    return F.trim(by_alphabet(cleaned, strip("(?i)", r"\b"), strip("(?iu)", WORD_EDGE)), F.lit(" -_/"))


def title_case(
    title: Column,
    acronyms: dict[str, str] = lexicon.TITLE_ACRONYMS,
    small_words: list[str] = lexicon.TITLE_SMALL_WORDS,
) -> Column:
    table = F.create_map(*(F.lit(item) for pair in acronyms.items() for item in pair))

    def styled(word: Column, index: Column) -> Column:
        low = F.lower(word)
        plain = (low == word) | (F.upper(word) == word)
        capital = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))
        return (
            F.when(low.isin(*acronyms), F.try_element_at(table, low))
            .when((index > 0) & low.isin(*small_words), low)
            .when(plain, capital)
            .otherwise(word)
        )

    return F.array_join(F.transform(F.split(title, " "), styled), " ")


def city_and_country(cleaned: Column, placeless: list[str] = lexicon.PLACELESS_WORDS) -> tuple[Column, Column]:
    """First and last comma part; nothing for placeless locations."""
    low = F.lower(cleaned)
    trimmed = F.transform(F.split(cleaned, ","), lambda part: F.trim(part))
    parts = F.filter(trimmed, lambda part: part != "")
    placed = ~any_of([low.contains(word) for word in placeless])
    city = F.when(placed, F.try_element_at(parts, F.lit(1)))
    country = F.when(placed & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(-1)))
    return city, country


def combined_location(city: Column, country: Column) -> Column:
    return blank_to_null(join_present(", ", city, country))
