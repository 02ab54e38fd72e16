"""Unicode-safe text columns: trim, words, counts, and rewriting of every match by an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lipika.functions.chars import DIGIT, SPACE

PAUSE = r"\[pause\]"
#: A character that no script uses.
MARK = "\uffff"


def trim(c: Column) -> Column:
    """Strip white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def words(c: Column) -> Column:
    """Split on runs of white space; no empty words."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def char_count(c: Column) -> Column:
    """Code points."""
    return F.length(c)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def pause_count(c: Column) -> Column:
    return count_matches(c, PAUSE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in a lambda's body, where Catalyst would repeat the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rewrite(c: Column, pattern: str, to: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern``, each of which holds a digit, by an expression of it, without a UDF.

    One pass puts MARK around the matches; between marks, every second part is a match. A text without a digit stays as
    it is, and one that has a MARK of its own is cut and searched apart: its gaps, one more than matches, are zipped
    with the rewritten matches.
    """
    parts = F.split(F.regexp_replace(c, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    marked = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, to(x)).otherwise(x)), "")
    hits = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), to)
    apart = F.array_join(F.zip_with(F.split(c, pattern, -1), hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")
    return F.when(~c.rlike(DIGIT), c).when(c.contains(MARK), apart).otherwise(marked)


def sentence_type(c: Column) -> Column:
    """By the last character: question, exclamation, else statement."""
    t = trim(c)
    return F.when(t.endswith("?"), "question").when(t.endswith("!"), "exclamation").otherwise("statement")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def without_pauses(c: Column) -> Column:
    return F.regexp_replace(c, PAUSE, "")


def audio_name(c: Column, ext: str = "mp3") -> Column:
    """Content-addressed file name: 16 hex digits of SHA-256 and the extension."""
    return F.concat(F.substring(F.sha2(c.cast("binary"), 256), 1, 16), F.lit(f".{ext}"))


def percent(c: Column, digits: int = 1) -> Column:
    """A share as text, as ``12.3%``."""
    return F.format_string(f"%.{digits}f%%", c * 100)


def fixed(c: Column, digits: int = 4) -> Column:
    """A number as text with so many digits."""
    return F.format_string(f"%.{digits}f", c)


def data_url(payload: Column, mime: Column) -> Column:
    """``data:`` URL; base64() breaks lines, which a URL must not."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(payload), "[\r\n]", ""))
