"""Word error rate as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lipika.functions.text import let, without_pauses, words

# Spellings of the word "pause" that recognisers hear in silence, and the marks stripped before comparing.
HEARD_PAUSES = ("पाउज", "पाज", "पॉज", "पौज")
MARKS = ".,।!?"

#: Words are coded as single characters from here on; so many code points follow before the surrogates.
FIRST_CODE, CODES = 0x4E00, 0xD7FF - 0x4E00


def _coded(of: Column, vocabulary: Column) -> Column:
    """One character per word, so that the built-in edit distance counts words."""
    code = F.transform(of, lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + (FIRST_CODE - 1)), 4, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def _by_rows(ref: Column, hyp: Column) -> Column:
    """The same distance by dynamic programming, for vocabularies beyond the codes."""

    def row(prev: Column, w: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.least(F.get(prev, j - 1) + F.when(F.get(hyp, j - 1) == w, 0).otherwise(1), F.get(prev, j) + 1, F.element_at(acc, -1) + 1)
            return F.array_append(acc, best.cast("int"))

        return F.aggregate(F.sequence(F.lit(1), F.size(hyp)), F.array((F.get(prev, F.lit(0)) + 1).cast("int")), cell)

    start = F.transform(F.sequence(F.lit(0), F.size(hyp)), lambda i: i.cast("int"))
    return F.when(F.size(hyp) == 0, F.size(ref)).otherwise(F.element_at(F.aggregate(ref, start, row), -1))


def _distance(ref: Column, hyp: Column) -> Column:
    def by_codes(vocabulary: Column) -> Column:
        quick = F.levenshtein(_coded(ref, vocabulary), _coded(hyp, vocabulary))
        return F.when(F.size(vocabulary) <= CODES, quick).otherwise(_by_rows(ref, hyp))

    return let(F.array_union(ref, hyp), by_codes)


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance between two arrays of words."""
    return let(ref, lambda r: let(hyp, lambda h: _distance(r, h)))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Distance over reference words; an empty reference gives 0 or 1."""

    def rate(r: Column, h: Column) -> Column:
        empty = F.when(F.size(h) == 0, 0.0).otherwise(1.0)
        return F.when(F.size(r) == 0, empty).otherwise(_distance(r, h) / F.size(r))

    both = reference.isNotNull() & hypothesis.isNotNull()
    return F.when(both, let(words(reference), lambda r: let(words(hypothesis), lambda h: rate(r, h))))


def strip_heard_pauses(hypothesis: Column) -> Column:
    """Drop words that are only a heard pause; single spaces between the rest."""
    kept = F.filter(words(hypothesis), lambda w: ~F.btrim(w, F.lit(MARKS)).isin(*HEARD_PAUSES))
    return F.array_join(kept, " ")


def round_trip_wer(reference: Column, transcribed: Column) -> Column:
    return word_error_rate(without_pauses(reference), strip_heard_pauses(transcribed))
