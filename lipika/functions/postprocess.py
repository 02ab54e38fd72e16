"""Prompting and clean-up around a text model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lipika.functions.chars import SPACE, SPACE_IN
from lipika.functions.text import PAUSE, count_matches, let, trim, words

# The instruction and the prompt's headings, which a trained model expects to the letter.
INSTRUCTION = (
    "Convert the raw Marathi text into phonetically normalized, speech-ready "
    "Devanagari text with pause annotations for TTS."
)
HEADINGS = ("### Instruction:", "### Input:", "### Response:")

SENTENCE_END = rf"[.!?](?={SPACE}|\z)"
PREFIX_WORDS = 3


def prompt(text: Column, instruction: str = INSTRUCTION) -> Column:
    first, second, third = HEADINGS
    return F.concat(F.lit(f"{first}\n{instruction}\n\n{second}\n"), text, F.lit(f"\n\n{third}\n"))


def cut_stop_markers(text: Column) -> Column:
    """Everything before the earliest heading."""
    for marker in HEADINGS:
        text = F.substring_index(text, marker, 1)
    return text


def sentence_ends(text: Column) -> Column:
    return count_matches(text, SENTENCE_END)


def cut_runaway(raw: Column, generated: Column) -> Column:
    """Keep as many sentences as the raw text has ends, if it has any and there are more."""
    k = sentence_ends(raw)
    sentences = F.split(generated, rf"(?<=[.!?])(?={SPACE}|\z)", -1)
    kept = F.array_join(F.slice(sentences, F.lit(1), F.greatest(k, F.lit(1))), "")
    return F.when((k > 0) & (sentence_ends(generated) > k), kept).otherwise(generated)


def _opening(text: Column) -> Column:
    """The first three words; null where the text has not twice as many words."""
    return let(words(text), lambda w: F.when(F.size(w) >= 2 * PREFIX_WORDS, F.array_join(F.slice(w, 1, PREFIX_WORDS), " ")))


def _again(text: Column, opening: Column, nth: Column) -> Column:
    """Where ``opening`` begins again for the nth time (from 0) in the text; 0 where it does not."""
    next_ = lambda at: F.call_function("locate", opening, text, at + 1)
    return F.aggregate(F.sequence(F.lit(0), nth), F.length(opening), lambda at, i: F.when((at > 0) | (i == 0), next_(at)).otherwise(0))


def _repeats(text: Column) -> Column:
    """How often the text's first three words begin again."""

    def count(o: Column) -> Column:
        literal = F.concat(F.lit("(?=\\Q"), F.replace(o, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
        rest = F.substring(text, F.length(o) + 1, F.length(text))
        return F.when(F.contains(rest, o), F.regexp_count(rest, literal)).otherwise(0)

    return let(_opening(text), count)


def cut_restart(generated: Column, allowed: Column | None = None) -> Column:
    """Cut where the first three words begin again (more often than ``allowed``), and the separators before that."""
    nth = F.lit(0) if allowed is None else F.coalesce(allowed, F.lit(0))
    tail = rf"[{SPACE_IN}.,!?]*(?:{PAUSE}[{SPACE_IN}.,!?]*)*\z"
    cut = lambda g, at: F.when(at > 0, F.regexp_replace(F.substring(g, F.lit(1), at - 1), tail, "")).otherwise(g)
    return let(generated, lambda g: let(_opening(g), lambda o: let(_again(g, o, nth), lambda at: cut(g, at))))


def cut_more_restarts(raw: Column, generated: Column) -> Column:
    """Cut as ``cut_restart``, but an answer may say its opening words again as often as the raw text does its own."""
    return let(_repeats(raw), lambda n: cut_restart(generated, n))


def postprocess(raw: Column, generated: Column) -> Column:
    return trim(cut_more_restarts(raw, cut_runaway(raw, cut_stop_markers(generated))))


def apply_pauses(text: Column) -> Column:
    """``[pause]`` to a comma; a comma after other punctuation goes."""
    commas = F.regexp_replace(text, f"{SPACE}*{PAUSE}{SPACE}*", ", ")
    return trim(F.regexp_replace(commas, f"([,.!?]){SPACE}*,", "$1"))
