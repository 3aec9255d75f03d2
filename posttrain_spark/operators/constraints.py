"""Constraint checks as Column builders (F6), both families.

A builder takes the answer text and the constraint's arguments and returns a three-valued verdict:
true, false, or NULL where the check cannot be carried out (a missing argument, an unknown
relation).  NULL makes the whole sample score 0, see :mod:`posttrain_spark.operators.reward`.

Builders are plain expressions, so they run unchanged in projections, in higher-order functions
over constraint arrays, and on streams.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from posttrain_spark.functions.text import (
    SPACE_CLASS,
    WHITESPACE,
    chunks,
    count_matches,
    drop_prefix,
    drop_suffix,
    find_all,
    first_of,
    ignoring_case,
    is_json,
    last_of,
    let,
    sentences,
    split_literal,
    strip,
    word_count,
    words,
)

Verdict = Callable[[Column, "Args"], Column]

# Fixed values.
CHOICES = ("My answer is yes.", "My answer is no.", "My answer is maybe.")
FENCE_OPENINGS = ("```json", "```Json", "```JSON", "```")
DIVIDER = SPACE_CLASS + r"?\*\*\*" + SPACE_CLASS + "?"
OLD_DIVIDER = "* * *"
RESPONSE_DIVIDER = "******"
EDGE_PUNCTUATION = ".,?!'\""
# Edge of a word of letters, digits and underscore; the JVM's own \b is ASCII.
WORD_EDGE = (
    r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
)


@dataclass(frozen=True)
class Args:
    """Typed access to a ``map<string,string>`` argument column; a missing argument is NULL."""

    values: Column

    def text(self, name: str) -> Column:
        return F.try_element_at(self.values, F.lit(name))

    def number(self, name: str) -> Column:
        return self.text(name).try_cast("double")

    def index(self, name: str) -> Column:
        return self.number(name).cast("int")

    def items(self, name: str) -> Column:
        return F.from_json(self.text(name), "array<string>")


NEW_CHECKS: dict[str, Verdict] = {}
OLD_CHECKS: dict[str, Verdict] = {}


def register_check(name: str, family: str = "new") -> Callable[[Verdict], Verdict]:
    """Add a builder to a family; also the way for users to plug in checks of their own."""
    target = {"new": NEW_CHECKS, "old": OLD_CHECKS}[family]

    def add(builder: Verdict) -> Verdict:
        target[name] = builder
        return builder

    return add


def dispatch(
    name: Column, text: Column, args: Args, checks: dict[str, Verdict] | None = None
) -> Column:
    """Verdict of the check called ``name``; NULL for a name that is not registered."""
    branches = None
    for check_name, builder in (checks or NEW_CHECKS).items():
        chain = F if branches is None else branches
        branches = chain.when(name == check_name, builder(text, args))
    return branches


def compare(count: Column, relation: Column, bound: Column) -> Column:
    """``less than`` or ``at least``; any other relation is NULL."""
    return F.when(relation == "less than", count < bound).when(
        relation == "at least", count >= bound
    )


def compare_loosely(count: Column, quantifier: Column, bound: Column, slack: Column) -> Column:
    """Quantifiers of the old family: ``at least``, ``at most``, ``around``."""
    return (
        F.when(quantifier == "at least", count >= bound)
        .when(quantifier == "at most", count <= bound)
        .when(quantifier == "around", F.abs(count - bound) <= slack)
    )


def folded(text: Column) -> Column:
    return F.lower(strip(text))


def filled_parts(parts: Column) -> Column:
    """Non-blank parts; NULL when a part other than the first or the last is blank."""
    trimmed = F.transform(parts, strip)

    def pick(p: Column) -> Column:
        inner = F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
        broken = F.exists(inner, lambda s: F.length(s) == 0)
        return F.when(~broken, F.filter(p, lambda s: F.length(s) > 0))

    return let(trimmed, pick)


def divided(text: Column) -> Column:
    """Paragraphs between ``***`` dividers; most texts have none and are not searched by pattern."""
    return F.when(F.contains(text, F.lit("***")), F.split(text, DIVIDER)).otherwise(F.array(text))


def count_is(parts: Column, n: Column) -> Column:
    return F.when(n.isNotNull(), F.coalesce(F.size(parts).cast("double") == n, F.lit(False)))


def keyword_matches(text: Column, keyword: Column) -> Column:
    return count_matches(text, ignoring_case(keyword))


def letter_uses(text: Column, letter: Column) -> Column:
    """Occurrences of one ASCII letter, ignoring case; NULL for anything but one letter."""
    low, mark = F.lower(text), F.lower(letter)
    uses = F.length(low) - F.length(F.replace(low, mark, F.lit("")))
    return F.when(letter.rlike("^[A-Za-z]$"), uses)


# --- letter case -----------------------------------------------------------------------------


@register_check("change_case:english_lowercase")
def _lowercase(text, args):
    return ~text.rlike(r"[\p{Lu}\p{Lt}]") & text.rlike(r"\p{Ll}")


@register_check("change_case:english_capital")
def _uppercase(text, args):
    return ~text.rlike(r"[\p{Ll}\p{Lt}]") & text.rlike(r"\p{Lu}")


@register_check("change_case:capital_word_frequency")
def _capital_words(text, args):
    capital = F.filter(words(text), lambda w: (F.upper(w) == w) & w.rlike(r"\p{Lu}"))
    return compare(F.size(capital), args.text("capital_relation"), args.number("capital_frequency"))


# --- keywords and letters --------------------------------------------------------------------


@register_check("keywords:existence")
def _keywords_present(text, args):
    return F.forall(args.items("keywords"), lambda k: F.rlike(text, ignoring_case(k)))


@register_check("keywords:frequency")
def _keyword_frequency(text, args):
    found = keyword_matches(text, strip(args.text("keyword")))
    return compare(found, args.text("relation"), args.number("frequency"))


@register_check("keywords:letter_frequency")
def _letter_frequency(text, args):
    uses = letter_uses(text, args.text("letter"))
    return compare(uses, args.text("let_relation"), args.number("let_frequency"))


@register_check("keywords:forbidden_words")
def _forbidden_words(text, args):
    def used(w: Column) -> Column:
        bounded = F.concat(F.lit(WORD_EDGE), w, F.lit(WORD_EDGE))
        return F.rlike(text, ignoring_case(bounded))

    return ~F.exists(args.items("forbidden_words"), used)


# --- lengths ---------------------------------------------------------------------------------


@register_check("length_constraints:number_words")
def _number_words(text, args):
    return compare(word_count(text), args.text("relation"), args.number("num_words"))


@register_check("length_constraints:number_sentences")
def _number_sentences(text, args):
    return compare(F.size(sentences(text)), args.text("relation"), args.number("num_sentences"))


@register_check("length_constraints:number_paragraphs")
def _number_paragraphs(text, args):
    return count_is(filled_parts(divided(text)), args.number("num_paragraphs"))


@register_check("length_constraints:nth_paragraph_first_word")
def _nth_paragraph_first_word(text, args):
    nth, wanted = args.index("nth_paragraph"), F.lower(args.text("first_word"))

    def holds(parts: Column) -> Column:
        filled = F.size(F.filter(parts, lambda p: F.length(strip(p)) > 0))
        opening = F.ltrim(F.ltrim(first_of(chunks(F.get(parts, nth - 1))), F.lit("'")), F.lit('"'))
        word = F.lower(F.regexp_extract(opening, f"^[^{EDGE_PUNCTUATION}]*", 0))
        return (nth <= filled) & (filled == args.number("num_paragraphs")) & F.coalesce(
            word == wanted, F.lit(False)
        )

    verdict = let(split_literal(text, "\n\n"), holds)
    return F.when(wanted.isNotNull(), verdict)


# --- formats ---------------------------------------------------------------------------------


@register_check("detectable_format:json_format")
def _json_format(text, args):
    body = strip(text)
    for opening in FENCE_OPENINGS:
        body = drop_prefix(body, opening)
    return is_json(strip(drop_suffix(body, "```")))


@register_check("detectable_format:title")
def _title(text, args):
    def named(title: Column) -> Column:
        return F.length(strip(F.rtrim(F.ltrim(title, F.lit("<")), F.lit(">")))) > 0

    return F.exists(find_all(text, r"<<[^\n]+>>"), named)


@register_check("detectable_format:multiple_sections")
def _multiple_sections(text, args):
    gap = SPACE_CLASS + "?"
    heading = F.concat(
        F.lit(gap), strip(args.text("section_spliter")), F.lit(gap + r"\p{Nd}+" + gap)
    )
    return count_matches(text, heading) >= args.number("num_sections")


@register_check("detectable_format:number_highlighted_sections")
def _highlights(text, args):
    def shown(mark: Column) -> Column:
        return F.length(strip(F.btrim(mark, F.lit("*")))) > 0

    single = F.filter(find_all(text, r"\*[^\n*]*\*"), shown)
    double = F.filter(
        find_all(text, r"\*\*([^\n*]*)\*\*", 1), lambda inside: F.length(strip(inside)) > 0
    )
    return F.size(single) + F.size(double) >= args.number("num_highlights")


@register_check("detectable_format:number_bullet_lists")
def _bullets(text, args):
    stars = count_matches(text, r"(?dm)^" + SPACE_CLASS + r"*\*[^\*].*$")
    dashes = count_matches(text, r"(?dm)^" + SPACE_CLASS + r"*-.*$")
    return (stars + dashes).cast("double") == args.number("num_bullets")


@register_check("detectable_format:constrained_response")
def _constrained_response(text, args):
    options = F.array(*[F.lit(c) for c in CHOICES])
    return F.exists(options, lambda o: F.contains(strip(text), o))


@register_check("detectable_format:bigram_wrapping")
def _bigram_wrapping(text, args):
    def wrapped(pieces: Column) -> Column:
        def fits(piece: Column, i: Column) -> Column:
            opens, closes = F.startswith(piece, F.lit("<<")), F.endswith(piece, F.lit(">>"))
            first_of_pair = i % 2 == 0
            lonely = first_of_pair & (i == F.size(pieces) - 1)
            return F.when(lonely, True).when(first_of_pair, opens).otherwise(closes)

        return F.forall(F.transform(pieces, fits), lambda ok: ok)

    return let(chunks(text), wrapped)


@register_check("detectable_format:sentence_hyphens")
def _sentence_hyphens(text, args):
    parts = split_literal(strip(text), "-")
    return F.forall(parts, lambda p: (p == strip(p)) & (F.size(sentences(p)) <= 1))


@register_check("detectable_format:square_brackets")
def _square_brackets(text, args):
    return F.forall(
        chunks(text), lambda w: F.startswith(w, F.lit("[")) & F.endswith(w, F.lit("]"))
    )


# --- content ---------------------------------------------------------------------------------


@register_check("detectable_content:number_placeholders")
def _placeholders(text, args):
    return count_matches(text, r"(?d)\[.*?\]") >= args.number("num_placeholders")


@register_check("detectable_content:postscript")
def _postscript(text, args):
    marker = strip(args.text("postscript_marker"))
    pattern = (
        F.when(marker == "P.P.S", F.lit(r"p\.\s?p\.\s?s"))
        .when(marker == "P.S.", F.lit(r"p\.\s?s\."))
        .otherwise(F.lower(marker))
    )
    return F.rlike(F.lower(text), F.concat(F.lit("(?im)"), pattern))


# --- punctuation, start and end --------------------------------------------------------------


@register_check("punctuation:no_comma")
def _no_comma(text, args):
    return ~F.contains(text, F.lit(","))


@register_check("punctuation:punctuation_dot")
def _no_dot(text, args):
    return ~F.contains(text, F.lit("."))


@register_check("punctuation:punctuation_exclamation")
def _no_exclamation(text, args):
    return ~F.contains(text, F.lit("!"))


@register_check("startend:end_checker")
def _end(text, args):
    body = F.lower(F.btrim(strip(text), F.lit('"')))
    return F.endswith(body, folded(args.text("end_phrase")))


@register_check("startend:quotation")
def _quotation(text, args):
    body = strip(text)
    quote = F.lit('"')
    return (F.length(body) > 1) & F.startswith(body, quote) & F.endswith(body, quote)


# --- combinations and copies -----------------------------------------------------------------


@register_check("combination:two_responses")
def _two_responses(text, args):
    def differ(parts: Column) -> Column:
        return (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != F.get(parts, F.lit(1)))

    found = let(filled_parts(split_literal(text, RESPONSE_DIVIDER)), differ)
    return F.when(text.isNotNull(), F.coalesce(found, F.lit(False)))


@register_check("combination:repeat_prompt")
def _repeat_prompt(text, args):
    return F.startswith(folded(text), folded(args.text("prompt_to_repeat")))


@register_check("copy:copy")
@register_check("copy:copying_simple")
def _copy(text, args):
    return folded(text) == folded(args.text("prompt_to_repeat"))


@register_check("copy:copying_multiple")
def _copies(text, args):
    original = folded(args.text("prompt_to_repeat"))

    def all_equal(parts: Column) -> Column:
        return (F.size(parts).cast("double") == args.number("N")) & F.forall(
            parts, lambda p: folded(p) == original
        )

    return let(split_literal(text, RESPONSE_DIVIDER), all_equal)


@register_check("copy:repeat_phrase")
def _repeat_phrase(text, args):
    def holds(wanted: Column) -> Column:
        inner = F.slice(wanted, F.lit(2), F.greatest(F.size(wanted) - 2, F.lit(0)))
        pattern = F.concat(
            F.lit("(?d)" + WORD_EDGE + r"\Q"), first_of(wanted),
            F.lit(r"\E" + WORD_EDGE + "(.*?)" + WORD_EDGE + r"\Q"), last_of(wanted),
            F.lit(r"\E" + WORD_EDGE),
        )
        found = find_all(text, pattern, 1)

        def close(span: Column) -> Column:
            def near(got: Column) -> Column:
                changed = F.size(
                    F.filter(F.zip_with(got, inner, lambda a, b: a != b), lambda d: d)
                )
                return (F.size(got) == F.size(inner)) & (changed <= 1)

            return let(chunks(span), near)

        return (F.size(found).cast("double") == args.number("small_n")) & F.forall(found, close)

    return let(chunks(args.text("phrase")), holds)


@register_check("new:copy_span_idx")
def _copy_span(text, args):
    start, end = args.index("n_start"), args.index("n_end")
    span = F.substr(args.text("prompt_to_repeat"), start + 1, end - start)
    return folded(text) == folded(span)


# --- counts ----------------------------------------------------------------------------------


@register_check("count:count_increment_word")
def _increment_word(text, args):
    once = keyword_matches(text, args.text("keyword1")) == 1
    return once & (keyword_matches(text, args.text("keyword2")) == 2)


@register_check("count:count_unique")
def _unique_words(text, args):
    return let(words(text), lambda w: F.size(w) == F.size(F.array_distinct(w)))


@register_check("count:counting_composition")
def _composition(text, args):
    n_sentences, n_words = args.number("n_sent"), args.number("n_words")

    def sentence_ok(s: Column) -> Column:
        return word_count(s).cast("double") == n_words

    def paragraph_ok(p: Column) -> Column:
        return let(
            sentences(p),
            lambda ss: (F.size(ss).cast("double") == n_sentences) & F.forall(ss, sentence_ok),
        )

    held = let(
        filled_parts(divided(text)),
        lambda parts: (F.size(parts) == 3) & F.forall(parts, paragraph_ok),
    )
    return F.when(n_sentences.isNotNull() & n_words.isNotNull(), F.coalesce(held, F.lit(False)))


@register_check("count:lowercase_counting")
def _lowercase_words(text, args):
    lower = F.filter(words(text), lambda w: w == F.lower(w))
    return F.size(lower) <= args.number("N")


@register_check("letters:letter_counting")
def _letters(text, args):
    return compare(count_matches(text, r"\p{L}"), args.text("relation"), args.number("N"))


@register_check("letters:letter_counting2")
def _letters_of_one(text, args):
    return _letter_frequency(text, args)


# --- paragraphs, first and last words --------------------------------------------------------


@register_check("paragraphs:paragraphs")
def _two_divided(text, args):
    return F.size(divided(text)) == 2


@register_check("paragraphs:paragraphs2")
def _two_spaced(text, args):
    return F.size(split_literal(text, "\n\n")) == 2


def _every_sentence(text: Column, pick: Callable[[Column], Column], word: Column) -> Column:
    held = F.forall(
        sentences(text), lambda s: F.coalesce(F.lower(pick(words(s))) == word, F.lit(False))
    )
    return F.when(word.isNotNull(), held)


@register_check("first_word:first_word_sent")
def _first_in_sentences(text, args):
    return _every_sentence(text, first_of, F.lower(args.text("first_word")))


@register_check("first_word:first_word_answer")
def _first_in_answer(text, args):
    word = F.lower(args.text("first_word"))
    return F.when(word.isNotNull(), F.coalesce(F.lower(first_of(words(text))) == word, F.lit(False)))


@register_check("last_word:last_word_sent")
def _last_in_sentences(text, args):
    return _every_sentence(text, last_of, F.lower(args.text("last_word")))


@register_check("last_word:last_word_answer")
def _last_in_answer(text, args):
    word = F.lower(args.text("last_word"))
    return F.when(word.isNotNull(), F.coalesce(F.lower(last_of(words(text))) == word, F.lit(False)))


# --- more keywords ---------------------------------------------------------------------------


@register_check("keywords:exclude_word_harder")
def _exclude_word(text, args):
    return ~F.contains(text, args.text("keyword"))


@register_check("keywords:keyword_specific_position")
def _keyword_position(text, args):
    keyword, n, m = args.text("keyword"), args.index("n"), args.index("m")
    word = F.get(words(F.get(sentences(text), n - 1)), m - 1)
    complete = keyword.isNotNull() & n.isNotNull() & m.isNotNull()
    return F.when(complete, F.coalesce(word == keyword, F.lit(False)))


@register_check("keywords:no_adjacent_consecutive")
def _no_adjacent(text, args):
    def apart(initials: Column) -> Column:
        rest = F.slice(initials, F.lit(2), F.greatest(F.size(initials) - 1, F.lit(0)))
        head = F.slice(initials, F.lit(1), F.greatest(F.size(initials) - 1, F.lit(0)))
        return ~F.exists(F.zip_with(head, rest, lambda a, b: b - a == 1), lambda step: step)

    return let(F.transform(words(text), lambda w: F.ascii(F.lower(F.left(w, F.lit(1))))), apart)


@register_check("keywords:palindrome")
def _palindrome(text, args):
    return F.exists(
        F.transform(words(text), F.lower), lambda w: (F.length(w) > 1) & (F.reverse(w) == w)
    )


@register_check("keywords:start_end")
def _start_end(text, args):
    same = let(words(text), lambda w: F.lower(first_of(w)) == F.lower(last_of(w)))
    return F.when(text.isNotNull(), F.coalesce(same, F.lit(False)))


@register_check("keywords:word_count_different_numbers")
def _keyword_count(text, args):
    return _keyword_frequency(text, args)


@register_check("keywords:word_once")
def _word_once(text, args):
    return keyword_matches(text, args.text("keyword")) >= 1


# --- language --------------------------------------------------------------------------------

# Frequent function words per language code.
LANGUAGE_PROFILES = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "are", "it", "by"),
    "de": ("der", "die", "das", "und", "nicht", "ist", "mit", "ein", "eine", "zu", "von", "sie"),
    "fr": ("le", "la", "les", "des", "et", "que", "une", "est", "pour", "dans", "qui", "du"),
    "es": ("el", "los", "las", "que", "y", "por", "con", "una", "es", "del", "para", "en"),
}
# Scripts that settle the language by themselves.
LANGUAGE_SCRIPTS = {
    "ko": r"[\x{AC00}-\x{D7AF}]",
    "ja": r"[\x{3040}-\x{30FF}]",
    "zh": r"[\x{4E00}-\x{9FFF}]",
    "ru": r"[\x{0400}-\x{04FF}]",
    "ar": r"[\x{0600}-\x{06FF}]",
    "hi": r"[\x{0900}-\x{097F}]",
    "th": r"[\x{0E00}-\x{0E7F}]",
}
# One range around all of them, cheap to test first.
ANY_SCRIPT = r"[\x{0400}-\x{D7AF}]"


def language_scores(text: Column) -> Column:
    """``array<struct<hits, language>>``: profile words and script letters found per language.

    The text is scanned twice, for profile words and for letters of the listed scripts; the counts
    per language are taken from what these scans leave.
    """
    all_words = sorted({w for profile in LANGUAGE_PROFILES.values() for w in profile})
    all_scripts = "".join(p.strip("[]") for p in LANGUAGE_SCRIPTS.values())
    lowered = F.transform(words(text), F.lower)
    scanned = F.struct(
        F.filter(lowered, lambda w: w.isin(*all_words)).alias("words"),
        F.when(text.rlike(ANY_SCRIPT), F.regexp_replace(text, f"[^{all_scripts}]+", ""))
        .otherwise("")
        .alias("letters"),
    )

    def known(found: Column, profile: tuple[str, ...]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*profile)))

    def score(found: Column) -> Column:
        by_word = [
            F.struct(known(found["words"], profile).alias("hits"), F.lit(code).alias("language"))
            for code, profile in LANGUAGE_PROFILES.items()
        ]
        by_script = [
            F.struct(
                count_matches(found["letters"], script).alias("hits"), F.lit(code).alias("language")
            )
            for code, script in LANGUAGE_SCRIPTS.items()
        ]
        return F.array(*by_word, *by_script)

    return let(scanned, score)


def detect_language(text: Column) -> Column:
    """Code with the most hits, the last in code order on a tie; NULL without any hit."""
    best = F.array_max(language_scores(text))
    return let(best, lambda b: F.when(b["hits"] > 0, b["language"]))


@register_check("language:response_language")
def _response_language(text, args):
    wanted = args.text("language")
    # Text without any evidence passes, as it does when a detector gives up.  A language without a
    # profile has no verdict: its texts would be taken for a neighbour's.
    return F.when(
        wanted.isin(*LANGUAGE_PROFILES, *LANGUAGE_SCRIPTS),
        F.coalesce(detect_language(text) == wanted, F.lit(True)),
    )


# --- old family ------------------------------------------------------------------------------


@register_check("paragraph_count", "old")
def _old_paragraphs(text, args):
    return F.size(split_literal(text, OLD_DIVIDER)).cast("double") == args.number("N")


@register_check("keyword_frequency", "old")
def _old_keyword(text, args):
    keyword = args.text("word")
    exact = F.filter(words(text), lambda w: w == keyword)
    return F.when(keyword.isNotNull(), F.size(exact).cast("double") == args.number("N"))


@register_check("letter_frequency", "old")
def _old_letter(text, args):
    letter = args.text("letter")
    uses = (F.length(text) - F.length(F.replace(text, letter, F.lit("")))) / F.length(letter)
    return uses == args.number("N")


@register_check("word_constraint", "old")
def _old_words(text, args):
    n = args.number("N")
    count = count_matches(text, f"[^{WHITESPACE}]+")
    return compare_loosely(count, args.text("quantifier"), n, n * 0.1)


@register_check("sentence_constraint", "old")
def _old_sentences(text, args):
    count = F.size(F.split(text, r"(?<=\.|\?)" + SPACE_CLASS))
    return compare_loosely(count, args.text("quantifier"), args.number("N"), F.lit(1))


@register_check("validate_choice", "old")
def _old_choice(text, args):
    return F.exists(args.items("options"), lambda o: F.contains(o, text))


@register_check("verify_keywords", "old")
def _old_keywords(text, args):
    low = F.lower(text)
    return F.forall(args.items("keyword_list"), lambda k: F.contains(low, F.lower(k)))


# Checks that behave alike in both families.
for _old_name, _new_name in {
    "validate_lowercase": "change_case:english_lowercase",
    "validate_uppercase": "change_case:english_capital",
    "validate_no_commas": "punctuation:no_comma",
    "validate_quotation": "startend:quotation",
    "validate_json_format": "detectable_format:json_format",
    "validate_title": "detectable_format:title",
    "validate_two_responses": "combination:two_responses",
}.items():
    OLD_CHECKS[_old_name] = NEW_CHECKS[_new_name]

# Old checks that have a counterpart with different rules in the new family, with the names of
# the arguments on either side (for the comparison report F14).
COUNTERPARTS = {
    "paragraph_count": "length_constraints:number_paragraphs",
    "keyword_frequency": "keywords:frequency",
    "letter_frequency": "keywords:letter_frequency",
    "word_constraint": "length_constraints:number_words",
    "sentence_constraint": "length_constraints:number_sentences",
    "validate_choice": "detectable_format:constrained_response",
    "validate_lowercase": "change_case:english_lowercase",
    "validate_uppercase": "change_case:english_capital",
    "validate_no_commas": "punctuation:no_comma",
    "validate_quotation": "startend:quotation",
    "validate_json_format": "detectable_format:json_format",
    "validate_title": "detectable_format:title",
    "validate_two_responses": "combination:two_responses",
}
