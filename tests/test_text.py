"""Column expressions against stated vectors and against small Python versions on random mixed-script strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lipika.functions import numbers as N
from lipika.functions import postprocess as P
from lipika.functions import text as X
from lipika.functions import wer as E


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, " + schema).select("i", *columns).orderBy("i").drop("i").collect()]


def ones(spark, texts, f):
    return [r[0] for r in values(spark, [(t,) for t in texts], "t STRING", f(F.col("t")).alias("o"))]


def spoken(n):
    """Number words from their parts, for comparison."""
    if n < 100:
        return N.ONES[n]
    parts = []
    if n >= 1000:
        parts += [N.ONES[n // 1000], N.THOUSAND]
    h = n % 1000 // 100
    if h:
        parts.append(N.HUNDRED if n % 1000 == 100 else N.ONES[h] + N.HUNDREDS)
    if n % 100:
        parts.append(N.ONES[n % 100])
    return " ".join(parts)


def test_int_words(spark):
    ns = [0, 18, 42, 99, 100, 101, 105, 199, 200, 999, 1000, 1100, 1105, 62000, 45999, 99999]
    got = [r[0] for r in values(spark, [(n,) for n in ns], "n BIGINT", N.int_words(F.col("n")))]
    assert got == [spoken(n) for n in ns]
    assert got[1:3] == ["अठरा", "बेचाळीस"] and got[6] == "एकशे पाच" and got[4] == "शंभर"
    assert values(spark, [(100000,)], "n BIGINT", N.int_words(F.col("n"))) == [(None,)]


DECIMALS = {
    "साधारण 18.5 km/l इतका आहे": "साधारण साडेअठरा km/l इतका आहे",
    "₹105.50 प्रति लीटर": "₹105.50 प्रति लीटर",
    "1.5 kg बटाटे": "दीड kg बटाटे",
    "2.5% वाढ": "अडीच% वाढ",
    "92.4% score": "ब्याण्णव पूर्णांक चार% score",
    "४२.५°C पर्यंत": "साडेबेचाळीस°C पर्यंत",
    "भाव ₹ १०.५० ने वाढले": "भाव ₹१०.५० ने वाढले",
    "1.5kg": "1.5kg",
    "0.5": "अर्धा",
    "100.5": "शंभर पूर्णांक पाच",
    "3.5.2": "साडेतीन.2",
    "10.50": "दहा पूर्णांक पाच शून्य",
    "007.2": "सात पूर्णांक दोन",
    "৫.৫": "पाच पूर्णांक पाच",
    "18.5क": "18.5क",
    "5.5ा": "साडेपाचा",
    "123456.7": "123456.7",
    "": "",
}


def test_decimals(spark):
    assert dict(zip(DECIMALS, ones(spark, list(DECIMALS), N.expand_decimals))) == DECIMALS


COMMAS = {
    "₹62,000 आहे": "₹बासष्ट हजार आहे",
    "₹६२,००० आहे": "₹बासष्ट हजार आहे",
    "₹45,999 आहे": "₹पंचेचाळीस हजार नऊशे नव्व्याण्णव आहे",
    "₹105.50 प्रति लीटर": "₹105.50 प्रति लीटर",
    "1,00,000": "1,शून्य",
    "1234,567": "1234,567",
    "12,3456": "बारा हजार तीनशे पंचेचाळीस6",
    "1,000,000": "1,000,000",
}


def test_comma_integers(spark):
    assert dict(zip(COMMAS, ones(spark, list(COMMAS), N.expand_comma_integers))) == COMMAS
    assert ones(spark, ["1,234.5"], N.preprocess) == ["1,दोनशे चौतीस पूर्णांक पाच"]
    assert ones(spark, ["1,000,000", "1,000"], N.has_overflow) == [True, False]
    with pytest.raises(Exception, match="out of range"):
        ones(spark, ["1,000,000"], lambda c: N.expand_comma_integers(c, "error"))


def test_numbers_on_random_strings(spark):
    rng = random.Random(1)
    alphabet = list("0159") + list("०५९") + [",", ".", "₹", "$", " ", " ", "क", "ा", "k", ",", "."]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(800)]
    digits = str.maketrans("०१२३४५६७८९", "0123456789")

    def decimal(m):
        w, f = int(m[1]), m[2].translate(digits)
        if w >= 100000:
            return m[0]
        if f == "5" and w < 100:
            return N.HALVES[w] if w < 3 else N.HALF + N.ONES[w]
        return f"{spoken(w)} {N.POINT} " + " ".join(N.ONES[int(d)] for d in f)

    def comma(m):
        n = int(m[0].translate(digits).replace(",", ""))
        return spoken(n) if n < 100000 else m[0]

    def both(t):
        t = re.sub(r"([₹$])\s+(?=\d)", r"\1", t)
        t = re.sub(r"(?<![₹$])\b(\d+)\.(\d+)\b", decimal, t)
        return re.sub(r"(?<![.\d])[0-9०-९]{1,3}(?:,[0-9०-९]{3})+(?!\.[0-9])", comma, t)

    assert ones(spark, texts, N.preprocess) == [both(t) for t in texts]


def test_text_functions(spark):
    texts = ["", "  ", " a　b\x1c c\x85", "x?", "x! ", "x", "x।", "a  b\tc"]
    assert ones(spark, texts, X.trim) == [t.strip() for t in texts]
    assert ones(spark, texts, X.words) == [t.split() for t in texts]
    assert ones(spark, texts[3:7], X.sentence_type) == ["question", "exclamation", "statement", "statement"]
    assert ones(spark, ["[pause] a [pause]", ""], X.pause_count) == [2, 0]
    assert ones(spark, ["कa", "क"], X.has_latin) == [True, False]
    assert ones(spark, ["a" * 100], lambda c: X.data_url(c.cast("binary"), F.lit("audio/wav")))[0].startswith("data:audio/wav;base64,YWFh")
    assert "\n" not in ones(spark, ["a" * 100], lambda c: X.data_url(c.cast("binary"), F.lit("x")))[0]


def test_apply_pauses(spark):
    got = ones(spark, ["अरे यार, [pause] काय झालं?", "हा प्रोजेक्ट [pause] पूर्ण होईल.", "a, [pause] [pause] b"], P.apply_pauses)
    assert got == ["अरे यार, काय झालं?", "हा प्रोजेक्ट, पूर्ण होईल.", "a, , b"]


def test_cuts(spark):
    raw_generated = [("x.", "a. b! c. d"), ("x. y!", "a. b! c. d"), ("x", "a. b"), ("3.5 x.", "a."), ("x. ", "a.b c. d.")]
    got = values(spark, raw_generated, "r STRING, g STRING", P.cut_runaway(F.col("r"), F.col("g")))
    assert got == [("a.",), ("a. b!",), ("a. b",), ("a.",), ("a.b c.",)]
    s = "एक दोन तीन चार"
    assert ones(spark, [f"{s} [pause] {s}", s, "a b c a b c", "a b a b c"], P.cut_restart) == [s, s, "a b c", "a b a b c"]
    assert ones(spark, ["abc ### Response: d ### Input: e", "### Instruction:x", "plain"], P.cut_stop_markers) == ["abc ", "", "plain"]
    assert ones(spark, ["x"], P.prompt)[0].endswith("### Input:\nx\n\n### Response:\n")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_word_error_rate(spark):
    rng = random.Random(2)
    pairs = [("a b c", "a b c"), ("a b c", "a b"), ("a b c", ""), ("", ""), ("", "x"), ("a", "b c d")]
    pairs += [tuple(" ".join(rng.choices("abcdeक", k=rng.randint(0, 9))) for _ in range(2)) for _ in range(200)]
    want = [(distance(r.split(), h.split()) / len(r.split()) if r.split() else float(bool(h.split())),) for r, h in pairs]
    assert values(spark, pairs, "r STRING, h STRING", E.word_error_rate(F.col("r"), F.col("h"))) == want
    rows = values(spark, pairs, "r STRING, h STRING", E._by_rows(X.words(F.col("r")), X.words(F.col("h"))))
    assert rows == [(distance(r.split(), h.split()),) for r, h in pairs]
    got = values(spark, [("रमेश, [pause] तुझा प्रोजेक्ट", "रमेश, पॉज, तुझा प्रोजेक्ट"), (None, "a")], "r STRING, h STRING", E.round_trip_wer(F.col("r"), F.col("h")), E.strip_heard_pauses(F.col("h")))
    assert got == [(0.0, "रमेश, तुझा प्रोजेक्ट"), (None, "a")]


def test_a_text_that_repeats_its_own_opening_is_no_restart(spark):
    t = "x.y \\E b c d. And x.y \\E b again."
    cases = [
        (t, t, t), (t, t + " x.y \\E b once more", t[:-1]), (t, "x.y \\E b, and more", "x.y \\E b, and more"),
        ("a b c d e f", "a b c d e f, [pause] a b c d e f", "a b c d e f"), ("a a a a a a a", "a a a a a a a", "a a a a a a a"),
    ]
    df = spark.createDataFrame([(r, g) for r, g, _ in cases], "r string, g string").coalesce(1)
    assert [x[0] for x in df.select(P.cut_more_restarts(F.col("r"), F.col("g"))).collect()] == [w for *_, w in cases]
    assert [x[0] for x in df.select(P.postprocess(F.col("r"), F.col("g"))).collect()][0] == t
