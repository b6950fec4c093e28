"""Names, keys and transliteration."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH_SEPARATOR = " | "

# Latin letters and punctuation that do not decompose into an ASCII base letter.
SPECIAL_LETTERS = {
    "Æ": "AE", "Ð": "D", "Ø": "O", "Þ": "Th", "ß": "ss", "æ": "ae", "ð": "d", "ø": "o", "þ": "th",
    "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "ĸ": "k", "Ł": "L", "ł": "l", "ŉ": "'n",
    "Ŋ": "NG", "ŋ": "ng", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t", "ƒ": "f", "Ə": "@", "ə": "@",
    "‘": "'", "’": "'", "‚": ",", "“": "\"", "”": "\"", "–": "-", "—": "--", "…": "...",
    "ʻ": "'", "ʼ": "'", "ʿ": "`", "ʾ": "'", "«": "<<", "»": ">>", "¡": "!", "¿": "?",
    " ": " ", "°": "deg", "ª": "a", "º": "o", "·": "*",
}

# Small letters of other scripts and their Latin spelling, in alphabetical order. Capital letters
# follow by rule.
GREEK = ("α a β b γ g δ d ε e ζ z η e θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r ς s σ s τ t υ u φ ph χ kh ψ ps ω o")
CYRILLIC = ("а a б b в v г g д d е e ж zh з z и i й i к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh "
            "щ shch ъ \" ы y ь ' э e ю iu я ia ё io ђ dj ѓ gj є ie ѕ ds і i ї yi ј j љ lj њ nj ћ tsh ќ kj ў u џ dzh ґ g")
GEORGIAN = ("ა a ბ b გ g დ d ე e ვ v ზ z თ t' ი i კ k ლ l მ m ნ n ო o პ p' ჟ zh რ r ს s ტ t უ u ფ p' ქ k' ღ gh ყ q "
            "შ sh ჩ ch' ც ts' ძ dz წ ts ჭ ch ხ kh ჯ j ჰ h")
ARMENIAN = ("ա a բ b գ g դ d ե e զ z է e ը e թ t' ժ zh ի i լ l խ kh ծ ts կ k հ h ձ dz ղ gh ճ ch մ m յ y ն n շ sh ո o "
            "չ ch' պ p ջ j ռ rr ս s վ v տ t ր r ց ts' ւ w փ p' ք k' օ o ֆ f")

# Letters with marks: Latin-1, Extended-A, Extended-B, Greek, Cyrillic, Latin and Greek additions.
_LATIN_RANGES = ((0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000))


@functools.lru_cache(maxsize=1)
def ascii_table() -> dict[str, str]:
    """Replacement for every covered letter, made by rule: decompose, then drop the marks."""
    table = dict(SPECIAL_LETTERS)
    for script in (GREEK, CYRILLIC, GEORGIAN, ARMENIAN):
        parts = script.split()
        for letter, value in zip(parts[::2], parts[1::2]):
            table[letter] = value
            if letter.upper() != letter and len(letter.upper()) == 1:
                table[letter.upper()] = value.capitalize()
    for low, high in _LATIN_RANGES:
        for code in range(low, high):
            letter = chr(code)
            if letter in table:
                continue
            base = "".join(table.get(c, c) for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
            if base and base.isascii():
                table[letter] = base
    for mark in range(0x0300, 0x0370):
        table[chr(mark)] = ""
    return table


def to_ascii(text: Column) -> Column:
    """ASCII form of Latin, Greek, Cyrillic, Georgian and Armenian text, with built-in functions only.

    One-letter replacements and dropped marks go through a single ``translate``; the few
    longer ones are looked up letter by letter. Letters of other scripts stay as they are.
    """
    table = ascii_table()
    single = {k: v for k, v in table.items() if len(v) == 1}
    dropped = [k for k, v in table.items() if v == ""]
    longer = {k: v for k, v in table.items() if len(v) > 1}
    out = F.translate(text, "".join([*single, *dropped]), "".join(single.values()))
    # one pass over the letters, and only where one with a longer spelling occurs
    spellings = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(spellings, c), c)), "")
    out = F.when(out.rlike("[" + re.escape("".join(longer)) + "]"), spelt).otherwise(out)
    # text that is ASCII already needs none of it
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text)


def path_name(own_to_top: list[Column]) -> Column:
    """Names of an area and its parents, most specific first; null where the own name is empty."""
    own = own_to_top[0]
    parts = [F.coalesce(c, F.lit("")) for c in own_to_top]
    return F.when(own != "", F.concat_ws(PATH_SEPARATOR, *parts))


def joined_key(*parts: Column) -> Column:
    """`a_b` key; null parts are skipped."""
    return F.concat_ws("_", *parts)


def path_part(text: Column, separator: str, n: int) -> Column:
    """n-th part (from 1) of a separated text; empty where there is none."""
    return F.split_part(text, F.lit(separator), F.lit(n))


def not_available(text: Column) -> Column:
    """Whether a name is missing or marked `n.a.`"""
    return text.isNull() | text.contains("n.a.")


def fixed_decimals(number: Column, decimals: int = 3) -> Column:
    """Text of a number rounded to exactly `decimals` digits."""
    return F.round(number.cast("decimal(38,9)"), decimals).cast(f"decimal(38,{decimals})").cast("string")
