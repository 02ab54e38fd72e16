"""Character classes for Java regular expressions that select the same characters as Python's str methods.

Java's ``\\s``, ``\\d`` and ``\\b`` are ASCII-minded or disagree on combining marks, so patterns are built from these.
"""

import unicodedata

#: White space as str.isspace() sees it (members of a class, without brackets).
SPACE_IN = r"\s\x{85}\x{A0}\x{1C}-\x{1F}\p{Z}"
SPACE = f"[{SPACE_IN}]"
#: A decimal digit of any script, and the digits of the two scripts that corpora use.
DIGIT = r"\p{Nd}"
DIGIT2 = "[0-9०-९]"
#: A word character; a combining mark is none.
WORD_IN = r"\p{L}\p{N}_"
NOT_AFTER_WORD = f"(?<![{WORD_IN}])"
NOT_BEFORE_WORD = f"(?![{WORD_IN}])"

DEVANAGARI_DIGITS = "०१२३४५६७८९"
_ALL = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Nd"]
#: Every decimal digit of the basic plane and its ASCII counterpart, for translate().
ANY_DIGITS = "".join(_ALL)
ANY_DIGITS_ASCII = "".join(str(unicodedata.decimal(c)) for c in _ALL)
