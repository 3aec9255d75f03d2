"""Answer extraction and comparison for number, math and code completions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from posttrain_spark.functions.text import find_all, first_of, last_of, let, strip

# Patterns and phrases that decide what an answer is.
NUMBER = r"[-+]?\p{Nd}*\.\p{Nd}+|\p{Nd}+"
GROUPED_DIGITS = r"(\p{Nd}),(\p{Nd})"
CODE_BLOCK = r"(?s)```(?:python)?(.*?)```"
FINAL_PHRASE = r"(?d)Final Answer: The final answer is(.*?). I hope it is correct."
CLOSING_PHRASE = "I hope it is correct."

# Replacements and removals of the published answer normaliser, in order.
ANSWER_REPLACEMENTS = (
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
)
ANSWER_REMOVALS = (
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km",
    "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees",
    "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets",
    "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3",
    "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", "\\!",
    "{,}", '"', "\\dots",
)
ANSWER_PATTERNS = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
)


def last_number(text: Column) -> Column:
    """The last number after joining digit groups; the whole text when it holds none."""
    joined = F.regexp_replace(text, GROUPED_DIGITS, "$1$2")
    return F.coalesce(last_of(find_all(joined, NUMBER)), joined)


def check_gsm8k(prediction: Column, label: Column) -> Column:
    same = F.lower(last_number(prediction)) == F.lower(label)
    return F.coalesce(same, F.lit(False)).cast("double")


def last_boxed(text: Column) -> Column:
    r"""Content of the last ``\boxed{...}`` with balanced braces of any depth, else NULL.

    ``\boxed 42$`` without braces gives what follows up to the next dollar sign.
    """
    tail = F.substring_index(text, "\\boxed", -1)
    pieces = find_all(tail, r"[^{}]+|[{}]")

    def scan(state: Column, piece: Column) -> Column:
        depth = (
            state["depth"]
            + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        )
        return F.when(state["closed"], state).otherwise(
            F.struct(
                depth.alias("depth"),
                (state["size"] + F.length(piece)).alias("size"),
                (depth == 0).alias("closed"),
            )
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed")
    )
    end = F.aggregate(pieces, start, scan)
    usable = (
        F.contains(text, F.lit("\\boxed")) & F.startswith(tail, F.lit("{")) & end["closed"]
    )
    plain = F.contains(text, F.lit("\\boxed")) & F.startswith(tail, F.lit(" "))
    bare = F.substr(F.substring_index(tail, "$", 1), F.lit(2))
    return F.when(plain, bare).when(usable, F.substr(tail, F.lit(2), end["size"] - 2))


def normalize_answer(text: Column) -> Column:
    """Published answer normaliser: keep the last side of an equation, drop units and wrappers."""
    out = F.substring_index(text, "=", -1)
    for old, new in ANSWER_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for word in ANSWER_REMOVALS:
        out = F.replace(out, F.lit(word), F.lit(""))
    for pattern, replacement in ANSWER_PATTERNS:
        out = F.regexp_replace(out, "(?d)" + pattern, replacement)
    out = F.replace(out, F.lit("$"), F.lit(""))

    def join_digits(x: Column) -> Column:
        plain = F.replace(x, F.lit(","), F.lit(""))
        return F.when(plain.rlike(r"^\p{Nd}+$"), plain).otherwise(x)

    return let(out, join_digits)


# The forms of a number. Groups: sign; whole, numerator and denominator of a LaTeX fraction (with a
# whole number before it, a mixed number); numerator and denominator with a slash; plain; percent sign.
NUMBER_FORM = (
    r"^([-+]?)(?:(\d*)\\[dt]?frac\{([-+]?\d+(?:\.\d+)?)\}\{([-+]?\d+(?:\.\d+)?)\}|(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)"
    r"|(\d+(?:\.\d*)?|\.\d+))(\\?%)?$"
)
# Digits of all parts of a number together, so that products of two numbers' parts are exact in 38 digits.
MOST_DIGITS = 18


def _digits(text: Column) -> Column:
    """A decimal without its point, as an integer."""
    return F.replace(text, F.lit("."), F.lit("")).try_cast("long")


def _tens(text: Column) -> Column:
    """The power of ten that a decimal's digits are to be divided by."""
    places = F.when(F.contains(text, F.lit(".")), F.length(F.substring_index(text, ".", -1))).otherwise(0)
    return F.pow(F.lit(10.0), places).cast("long")


def rational(text: Column) -> Column:
    r"""``n`` and ``d`` of an integer, decimal, ``a/b``, ``\frac{a}{b}`` or mixed number, and whether it is a
    ``percent``; NULL for anything else, for a denominator of 0 and for more than MOST_DIGITS digits."""

    def group(*at: int) -> Column:
        return F.coalesce(*(F.nullif(F.regexp_extract(text, NUMBER_FORM, i), F.lit("")) for i in at))

    def value(parts: Column) -> Column:
        top, bottom, whole = parts["top"], parts["bottom"], parts["whole"]
        above, below = _digits(top) * _tens(bottom), _digits(bottom) * _tens(top)
        # A mixed number is its whole part and the fraction.
        n = _digits(whole) * below + above
        sign = F.when(parts["sign"] == "-", -1).otherwise(1) * F.when(below < 0, -1).otherwise(1)
        fits = F.length(F.concat(whole, top, bottom)) <= MOST_DIGITS
        found = F.struct((sign * n).alias("n"), F.abs(below).alias("d"), parts["percent"].alias("percent"))
        return F.when(text.rlike(NUMBER_FORM) & fits & (below != 0), found)

    parts = F.struct(
        F.regexp_extract(text, NUMBER_FORM, 1).alias("sign"),
        F.coalesce(group(2), F.lit("0")).alias("whole"),
        group(3, 5, 7).alias("top"),
        F.coalesce(group(4, 6), F.lit("1")).alias("bottom"),
        (F.regexp_extract(text, NUMBER_FORM, 8) != "").alias("percent"),
    )
    return let(parts, value)


def plain_decimal(text: Column) -> Column:
    """A decimal of any length without a plus sign and zeros that do not count; NULL for anything else."""

    def trimmed(t: Column) -> Column:
        whole = F.regexp_replace(F.substring_index(t, ".", 1), r"^([-+]?)0+(?=\d)|^([-+]?)(?=$)", "$1$2")
        places = F.when(F.contains(t, F.lit(".")), F.substring_index(t, ".", -1)).otherwise("")
        digits = F.regexp_replace(whole, r"^[-+]", "")
        places = F.regexp_replace(places, "0+$", "")
        value = F.concat(F.when(digits == "", "0").otherwise(digits), F.lit("."), places)
        minus = t.startswith("-") & value.rlike("[1-9]")
        return F.concat(F.when(minus, "-").otherwise(""), value)

    return F.when(text.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)$"), trimmed(text))


def same_number(a: Column, b: Column) -> Column:
    """Equal as rationals, by products of numerators and denominators, or as decimals of any length.

    Without floats: 1/3 is not 0.3333333333333333.  A percent sign may mean a hundredth or, as published
    graders read it, nothing.
    """
    wide = "decimal(19,0)"

    def equal(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        left, right = x["n"].cast(wide) * y["d"].cast(wide), y["n"].cast(wide) * x["d"].cast(wide)
        hundred = F.lit(100).cast("decimal(3,0)")
        as_hundredth = F.when(x["percent"] & ~y["percent"], left == right * hundred).when(
            y["percent"] & ~x["percent"], left * hundred == right
        )
        return F.coalesce(left == right, F.lit(False)) | F.coalesce(as_hundredth, F.lit(False))

    exact = let(F.struct(rational(a).alias("x"), rational(b).alias("y")), equal)
    return exact | F.coalesce(plain_decimal(a) == plain_decimal(b), F.lit(False))


def same_answer(answer: Column, label: Column) -> Column:
    """Equal after normalisation, or equal as numbers."""

    def equal(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.coalesce((a == b) | same_number(a, b), F.lit(False))

    pair = F.struct(normalize_answer(answer).alias("a"), normalize_answer(label).alias("b"))
    return let(pair, equal)


def final_phrase(text: Column) -> Column:
    """Answer between the two fixed closing phrases, trimmed and normalised, else NULL."""
    found = first_of(find_all(F.concat(text, F.lit(CLOSING_PHRASE)), FINAL_PHRASE, 1))
    return normalize_answer(strip(found))


def between_last_dollars(text: Column) -> Column:
    """Text between the last two dollar signs, else NULL."""
    pieces = F.split(text, r"\$")
    return F.when(F.size(pieces) > 2, F.get(pieces, F.size(pieces) - 2))


def math_candidates(prediction: Column) -> Column:
    """Candidate answers in order of trust: boxed and phrased, else dollar-quoted, else the text."""
    stated = F.array_compact(F.array(last_boxed(prediction), final_phrase(prediction)))
    quoted = F.array_compact(F.array(normalize_answer(between_last_dollars(prediction))))
    whole = F.array(normalize_answer(prediction), prediction)

    def first_filled(found: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(
            let(quoted, lambda q: F.when(F.size(q) > 0, q).otherwise(whole))
        )

    return let(stated, first_filled)


def any_candidate_equals(candidates: Column, label: Column) -> Column:
    hit = F.exists(candidates, lambda c: same_answer(c, label))
    return F.coalesce(hit, F.lit(False)).cast("double")


def check_math(prediction: Column, label: Column) -> Column:
    """1.0 when a boxed, phrased, dollar-quoted or whole-text candidate equals the label."""
    return any_candidate_equals(math_candidates(prediction), label)


def check_math_strict(prediction: Column, label: Column) -> Column:
    """1.0 when the phrased answer (or else the whole text) equals the label."""
    candidate = F.coalesce(final_phrase(prediction), normalize_answer(prediction))
    return same_answer(candidate, label).cast("double")


def last_code_block(text: Column) -> Column:
    """Stripped content of the last fenced block; the whole text when there is none."""
    return F.coalesce(strip(last_of(find_all(text, CODE_BLOCK, 1))), text)

