"""Whole-word lexicon lookups.

A text is cut into words once; the words are filtered by the whole vocabulary, and every label test
then looks at the handful of hits. Only phrases with a separator inside still need a regex, and
those run behind a plain substring test. The work per row does not grow with the number of lexicon
entries the way one regex per entry would.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode import lexicon
from joblode.functions.text import WORD, WORD_EDGE, any_of, by_alphabet, clean

Lexicon = dict[str, list[str]]

_SINGLE_WORD = re.compile(r"\w+")
_JOINER = re.compile(r"\[[^\]]*\]\??")


def fold(text: Column) -> Column:
    """Lower case plus the two letters that case-insensitive matching equates with ASCII ones."""
    return F.replace(F.replace(F.lower(text), F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s"))


def words(folded: Column) -> Column:
    def found(pattern: str) -> Column:
        return F.regexp_extract_all(folded, F.lit(pattern), F.lit(0))

    return by_alphabet(folded, found(r"\w+"), found(f"{WORD}+"))


def single_words(*lexicons: Lexicon) -> list[str]:
    """Every one-word entry, the vocabulary that vocabulary_hits() looks for."""
    entries = (entry for table in lexicons for spellings in table.values() for entry in spellings)
    return sorted({entry for entry in entries if _SINGLE_WORD.fullmatch(entry)})


def vocabulary_hits(folded: Column, vocabulary: list[str]) -> Column:
    """Words of the text that the vocabulary knows, repeats included."""
    return F.filter(words(folded), lambda word: word.isin(vocabulary))


def entry_possible(folded: Column, entry: str) -> Column:
    """Whether a text holds every fixed piece of an entry: no match can do without."""
    return reduce(and_, (folded.contains(piece) for piece in _JOINER.sub("\n", entry).split("\n") if piece))


def phrase_present(folded: Column, phrase: str) -> Column:
    """Whole-word phrase test; the substring guards keep the regex off almost every row."""
    body = phrase if _JOINER.search(phrase) else re.escape(phrase)

    def pattern(edge: str) -> str:
        return (edge if phrase[0].isalnum() else "") + body + (edge if phrase[-1].isalnum() else "")

    return entry_possible(folded, phrase) & by_alphabet(folded, folded.rlike(pattern(r"\b")), folded.rlike(pattern(WORD_EDGE)))


def label_present(folded: Column, hits: Column, entries: list[str]) -> Column:
    """True when any entry occurs; `hits` must come from a vocabulary that holds the one-word entries."""
    singles = [entry for entry in entries if _SINGLE_WORD.fullmatch(entry)]
    phrases = [entry for entry in entries if entry not in singles]
    tests = []
    if len(singles) == 1:
        tests.append(F.array_contains(hits, singles[0]))
    elif singles:
        tests.append(F.arrays_overlap(hits, F.array(*(F.lit(word) for word in singles))))
    tests += [phrase_present(folded, phrase) for phrase in phrases]
    return any_of(tests)


def first_label(folded: Column, hits: Column, labels: Lexicon) -> Column:
    """Label of the first table row with a hit, NULL without one."""
    return F.coalesce(
        *(F.when(label_present(folded, hits, entries), F.lit(label)) for label, entries in labels.items())
    )


def skill_lexicon(skills: Lexicon, aliases: dict[str, str]) -> Lexicon:
    """Canonical name -> every spelling that stands for it in running text."""
    merged = {name: list(spellings) for name, spellings in skills.items()}
    for alias, name in aliases.items():
        if alias not in merged.setdefault(name, []):
            merged[name].append(alias)
    return merged


def text_skills(
    folded: Column,
    hits: Column,
    skills: Lexicon = lexicon.SKILLS,
    aliases: dict[str, str] = lexicon.SKILL_ALIASES,
) -> Column:
    """Canonical skills named in a text (unsorted, may repeat)."""
    merged = skill_lexicon(skills, aliases)
    renamed = {
        word: name
        for name, spellings in merged.items()
        for word in spellings
        if word != name and _SINGLE_WORD.fullmatch(word)
    }
    own = [name for name in merged if name in merged[name] and _SINGLE_WORD.fullmatch(name)]
    table = F.create_map(*(F.lit(item) for pair in renamed.items() for item in pair))
    from_words = F.filter(
        F.transform(hits, lambda word: F.when(word.isin(own), word).otherwise(F.try_element_at(table, word))),
        lambda name: name.isNotNull(),
    )
    phrases = [
        F.when(any_of([phrase_present(folded, phrase) for phrase in spellings]), F.lit(name))
        for name, spellings in (
            (name, [phrase for phrase in spellings if not _implied(phrase, name, merged)])
            for name, spellings in merged.items()
        )
        if spellings
    ]
    if not phrases:
        return from_words
    return F.concat(from_words, F.array_compact(F.array(*phrases)))


def _implied(phrase: str, name: str, merged: Lexicon) -> bool:
    """One-word spellings are found through the hits, and so is a phrase that holds one as a word."""
    if _SINGLE_WORD.fullmatch(phrase):
        return True
    return any(
        _SINGLE_WORD.fullmatch(word) and re.search(rf"(?<!\w){re.escape(word)}(?!\w)", phrase)
        for word in merged[name]
    )


def tag_skill(
    tag: Column,
    skills: Lexicon = lexicon.SKILLS,
    aliases: dict[str, str] = lexicon.SKILL_ALIASES,
    ignored: list[str] = lexicon.IGNORED_TAGS,
) -> Column:
    """Skill behind one source tag: ignored tags vanish, known spellings are renamed, others stay."""
    renamed = {
        spelling: name for name, spellings in skills.items() for spelling in spellings if spelling not in skills
    }
    renamed |= aliases
    table = F.create_map(*(F.lit(item) for pair in renamed.items() for item in pair))
    low = F.lower(clean(tag))
    return F.when(~low.isin(*ignored), F.coalesce(F.try_element_at(table, low), low))


def tag_skills(tags: Column, **lexicons) -> Column:
    return F.array_compact(F.transform(tags, lambda tag: tag_skill(tag, **lexicons)))


def merged_skills(
    tags: Column,
    folded: Column,
    hits: Column,
    skills: Lexicon = lexicon.SKILLS,
    aliases: dict[str, str] = lexicon.SKILL_ALIASES,
    ignored: list[str] = lexicon.IGNORED_TAGS,
) -> Column:
    """Sorted union of the skills from tags and from text."""
    present = F.coalesce(tags, F.array().cast("array<string>"))
    from_tags = tag_skills(present, skills=skills, aliases=aliases, ignored=ignored)
    return F.sort_array(F.array_distinct(F.concat(from_tags, text_skills(folded, hits, skills, aliases))))
