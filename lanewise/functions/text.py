"""Text keys. Three accent foldings differ on purpose: search, match keys and names each fold their own letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded by the search, and by match keys.
SEARCH_FROM, SEARCH_TO = "áàäâãéèëêíìïîóòöôõúùüûñ", "aaaaaeeeeiiiiooooouuuun"
MATCH_FROM, MATCH_TO = "áéíóúüñ", "aeiouun"
#: Base letters and what NFKD takes off them, over Latin-1 and Latin Extended-A.
_NFKD = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņň",
    "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}


def blank_to_null(c: Column) -> Column:
    """Trims any white space; nothing left is null."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def number_in(c: Column, form: str, kind: str = "int") -> Column:
    """The number that form's first group finds, null where it finds none (which a cast would find out by raising, row by row)."""
    found = F.regexp_extract(c, form, 1)
    return F.when(found != "", found.try_cast(kind))


def lower_canon(c: Column) -> Column:
    return F.lower(blank_to_null(c))


def search_fold(c: Column) -> Column:
    return F.translate(F.lower(c), SEARCH_FROM, SEARCH_TO)


def search_tokens(text: str | None) -> list[str]:
    folded = (text or "").lower().translate(str.maketrans(SEARCH_FROM, SEARCH_TO))
    return folded.split()


def token_search(expressions: list[Column], tokens: list[str]) -> Column:
    """Every token is in one of the expressions, accents and case aside; no tokens: true. % and _ are plain characters."""
    each = [reduce(lambda a, b: a | b, [F.contains(search_fold(e), F.lit(t)) for e in expressions]) for t in tokens]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def match_key(c: Column) -> Column:
    """Small letters and digits with single spaces; null if none."""
    folded = F.translate(F.lower(F.trim(c)), MATCH_FROM, MATCH_TO)
    return F.nullif(F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " ")), F.lit(""))


def accent_count(c: Column) -> Column:
    """How many letters of a name carry an accent that match keys drop: spellings with more are better."""
    low = F.lower(F.trim(c))
    return F.length(low) - F.length(F.translate(low, MATCH_FROM, ""))


def strip_accents(c: Column) -> Column:
    """NFKD without combining marks, over Latin-1 and Latin Extended-A, small and capital."""
    source = "".join(_NFKD.values())
    target = "".join(k * len(v) for k, v in _NFKD.items())
    pairs = [(a, b) for a, b in zip(source + source.upper(), target + target.upper()) if len(a) == 1]
    return F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def collapse(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def name_key(c: Column) -> Column:
    """A person's key: folded tokens in order of the alphabet."""
    plain = F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))
    return F.array_join(F.array_sort(F.split(plain, " ")), " ")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def shape(c: Column) -> Column:
    """A text's words as one character each: l for a letter alone, w for anything else."""
    return F.array_join(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.when((F.length(w) == 1) & (F.upper(w) != F.lower(w)), "l").otherwise("w")), "")


def last_year(c: Column) -> Column:
    """The last run of four digits that starts with 19 or 20."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2})\b"), 1), F.lit(-1)).cast("int")


def signature(c: Column) -> Column:
    """What survives misread vowels: of each token the first letter, the consonants between, and the last letter."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z]+", " ")), " ")
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))), "[aeiou]", ""), F.when(F.length(t) > 1, F.right(t, F.lit(1))).otherwise(""))), " ")


def token_signature(token: Column) -> Column:
    """first|consonants|last of a word of small plain letters, runs of one vowel being one; without consonants, the word."""
    once = token
    for vowel in "aeiou":
        once = F.regexp_replace(once, f"{vowel}+", vowel)
    consonants = F.nullif(F.regexp_replace(once, "[aeiou]", ""), F.lit(""))
    return F.concat(F.substring(once, 1, 1), F.lit("|"), F.coalesce(consonants, once), F.lit("|"), F.right(once, F.lit(1)))


def id_number_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^0-9K]", "")


def id_number_valid(c: Column) -> Column:
    """Modulo-11 check digit, weights 2 to 7 from the right; 11 stands for 0 and 10 for K."""
    key = id_number_key(c)
    digits = F.split(F.reverse(F.substring(key, F.lit(1), F.greatest(F.length(key) - 1, F.lit(0)))), "")
    total = F.aggregate(F.transform(digits, lambda d, k: F.coalesce(d.try_cast("int"), F.lit(0)) * (F.lit(2) + k % 6)), F.lit(0), lambda a, x: a + x)
    rest = F.lit(11) - total % 11
    check = F.when(rest == 11, "0").when(rest == 10, "K").otherwise(rest.cast("string"))
    return key.rlike("^[0-9]{7,8}[0-9K]$") & (F.right(key, F.lit(1)) == check)
