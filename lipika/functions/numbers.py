"""Numbers inside text to spoken Marathi words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lipika.functions import chars as C
from lipika.functions.text import let, rewrite

# The words for 0 to 99 and the words of number composition; spellings are part of the results.
ONES = (
    "शून्य एक दोन तीन चार पाच सहा सात आठ नऊ "
    "दहा अकरा बारा तेरा चौदा पंधरा सोळा सतरा अठरा एकोणीस "
    "वीस एकवीस बावीस तेवीस चोवीस पंचवीस सव्वीस सत्तावीस अठ्ठावीस एकोणतीस "
    "तीस एकतीस बत्तीस तेहतीस चौतीस पस्तीस छत्तीस सदतीस अडतीस एकोणचाळीस "
    "चाळीस एक्केचाळीस बेचाळीस त्रेचाळीस चव्वेचाळीस पंचेचाळीस सेहेचाळीस सत्तेचाळीस अठ्ठेचाळीस एकोणपन्नास "
    "पन्नास एक्कावन्न बावन्न त्रेपन्न चोपन्न पंचावन्न छप्पन्न सत्तावन्न अठ्ठावन्न एकोणसाठ "
    "साठ एकसष्ट बासष्ट त्रेसष्ट चौसष्ट पासष्ट सहासष्ट सदुसष्ट अडुसष्ट एकोणसत्तर "
    "सत्तर एक्काहत्तर बाहत्तर त्र्याहत्तर चौऱ्याहत्तर पंच्याहत्तर शहात्तर सत्याहत्तर अठ्ठ्याहत्तर एकोणऐंशी "
    "ऐंशी एक्क्याऐंशी ब्याऐंशी त्र्याऐंशी चौऱ्याऐंशी पंच्याऐंशी शहाऐंशी सत्त्याऐंशी अठ्ठ्याऐंशी एकोणनव्वद "
    "नव्वद एक्क्याण्णव ब्याण्णव त्र्याण्णव चौऱ्याण्णव पंच्याण्णव शहाण्णव सत्त्याण्णव अठ्ठ्याण्णव नव्व्याण्णव"
).split()
THOUSAND, HUNDRED, HUNDREDS, POINT, HALF = "हजार", "शंभर", "शे", "पूर्णांक", "साडे"
HALVES = ("अर्धा", "दीड", "अडीच")

LIMIT = 100_000  # the first number without words
COMMA_INT = rf"(?<![.{C.DIGIT}]){C.DIGIT2}{{1,3}}(?:,{C.DIGIT2}{{3}})+(?!\.[0-9])"
DECIMAL = rf"(?<![₹$]){C.NOT_AFTER_WORD}{C.DIGIT}+\.{C.DIGIT}+{C.NOT_BEFORE_WORD}"
CURRENCY_GAP = rf"([₹$]){C.SPACE}+(?={C.DIGIT})"


def _ones(i: Column) -> Column:
    return F.get(F.array(*map(F.lit, ONES)), i.cast("int"))


def _below_thousand(n: int) -> str:
    hundreds, last = divmod(n, 100)
    hundred = [HUNDRED] if n == 100 else [ONES[hundreds] + HUNDREDS] if hundreds else []
    return " ".join(hundred + [ONES[last]] * (last > 0 or n == 0))


#: Words of 0..999, made by the rule, so that an expression looks a number up instead of composing it.
BELOW_THOUSAND = tuple(map(_below_thousand, range(1000)))


def int_words(n: Column) -> Column:
    """Words for 0..99,999; null beyond."""
    thousands, rest = F.floor(n / 1000).cast("int"), (n % 1000).cast("int")
    words = lambda i: F.get(F.array(*map(F.lit, BELOW_THOUSAND)), i)
    more = F.when(rest > 0, F.concat(F.lit(" "), words(rest))).otherwise("")
    return F.when(n < 1000, words(rest)).when(n < LIMIT, F.concat(_ones(thousands), F.lit(f" {THOUSAND}"), more))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, C.ANY_DIGITS, C.ANY_DIGITS_ASCII)


def _number(digits: Column) -> Column:
    """The value of ASCII digits, or LIMIT for any that reach it (however long)."""
    bare = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(F.length(bare) > 5, F.lit(LIMIT).cast("bigint")).otherwise(bare.try_cast("bigint"))


def _or_token(found: Column, token: Column, on_overflow: str) -> Column:
    if on_overflow == "error":
        return F.coalesce(found, F.raise_error(F.concat(F.lit("number out of range: "), token)).cast("string"))
    if on_overflow != "keep":
        raise ValueError("on_overflow is 'keep' or 'error'")
    return F.coalesce(found, token)


def expand_comma_integers(c: Column, on_overflow: str = "keep") -> Column:
    """``62,000`` to words; numbers without words keep their digits, or raise."""
    value = lambda m: _number(F.replace(ascii_digits(m), F.lit(","), F.lit("")))
    return rewrite(c, COMMA_INT, lambda m: let(value(m), lambda n: _or_token(int_words(n), m, on_overflow)))


def collapse_currency_space(c: Column) -> Column:
    return F.regexp_replace(c, CURRENCY_GAP, "$1")


def expand_decimals(c: Column, on_overflow: str = "keep") -> Column:
    """``18.5`` to words: half idioms for a fraction of exactly 5, digit by digit otherwise; money is left alone."""

    def spoken(m: Column) -> Column:
        return let(_number(ascii_digits(F.substring_index(m, ".", 1))), lambda n: said_of(m, n))

    def said_of(m: Column, n: Column) -> Column:
        frac = F.substring_index(m, ".", -1)
        half = F.translate(frac, C.DEVANAGARI_DIGITS, "0123456789") == "5"
        digits = F.transform(F.regexp_extract_all(ascii_digits(frac), F.lit("[0-9]"), F.lit(0)), _ones)
        generic = F.concat(int_words(n), F.lit(f" {POINT} "), F.array_join(digits, " "))
        idiom = F.get(F.array(*map(F.lit, HALVES)), n.cast("int"))
        said = F.when(half & (n < 3), idiom).when(half & (n < 100), F.concat(F.lit(HALF), _ones(n))).otherwise(generic)
        return _or_token(said, m, on_overflow)

    return rewrite(collapse_currency_space(c), DECIMAL, spoken)


def preprocess(c: Column, on_overflow: str = "keep") -> Column:
    """Decimals first, comma integers second."""
    return expand_comma_integers(expand_decimals(c, on_overflow), on_overflow)


def has_overflow(c: Column) -> Column:
    """Whether a comma integer of the text has no words."""
    hits = F.regexp_extract_all(c, F.lit(COMMA_INT), F.lit(0))
    return F.exists(hits, lambda m: _number(F.replace(ascii_digits(m), F.lit(","), F.lit(""))) >= LIMIT)
