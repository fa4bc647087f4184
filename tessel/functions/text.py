"""Texts as columns. Every function takes and returns a Column and stays inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as X

_ENDS = r"(?U)^\s+|\s+$"
_ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Alternatives of a pattern, none of them the last of its group, that no text of ASCII has.
_BEYOND = re.compile(r"(?:(?<=\|)|(?<=\(\?:))(?:[A-Za-z]*[°℃Ω·㐀-鿿]+[A-Za-z]*)\|")


def let(value: Column, f) -> Column:
    """f(value), with value worked out once for each row even where f uses it inside a lambda over other elements."""
    return F.transform(F.array(value), f)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are worked out once a row; filters above them are not pushed below with their expressions."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select("*", made).select("*", "_once.*").drop("_once")


def ascii_classes(pattern: str) -> str:
    """The pattern with digits, white space and borders of words of ASCII, as RE2 and so the queries' SQL have them; cases still fold in all scripts."""
    word = "[0-9A-Za-z_]"
    border = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return pattern.replace("(?iU)", "(?iu)").replace("(?U)", "").replace(r"\b", border).replace(r"\s", r"[\t\n\f\r ]").replace(r"\d", "[0-9]")


#: A list of units that must follow white space: without a look at the first character, each digit that a number gives back tries all of them.
_UNITS_FOLLOW = re.compile(r"\\s\*(?=\((?:\?:)?(?:°C\|)?(?:K\||%\|)[^()]*(?:\([^()]*\)[^()]*)*\)(?!\?))")


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def of_ascii(pattern: str) -> str:
    """The pattern for texts of ASCII alone: what it finds in these is the same, and classes and cases of all scripts cost much."""
    short = _BEYOND.sub("", pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace(r"\u00a0", ""))
    return _UNITS_FOLLOW.sub(lambda m: r"\s*(?=[A-Za-z%])", short)


def by_script(c: Column, f) -> Column:
    """f(c, of) with patterns of ASCII where c is of ASCII alone, else with the patterns as they are."""
    return let(c, lambda x: F.when(is_ascii(x), f(x, of_ascii)).otherwise(f(x, str)))


def stripped(c: Column) -> Column:
    return let(c, lambda x: F.when(is_ascii(x), F.btrim(x, F.lit(_ASCII_SPACE))).otherwise(F.regexp_replace(x, _ENDS, "")))


def compact(c: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    spaced = lambda x, p: F.trim(F.regexp_replace(x, p, " "))
    return let(c, lambda x: F.when(is_ascii(x), F.when(x.rlike(r"[\t-\r]|  "), spaced(x, r"\s+")).otherwise(F.trim(x))).otherwise(spaced(x, r"(?U)\s+")))


def normalized(c: Column) -> Column:
    return F.lower(compact(c))


def excerpt(c: Column, limit: int = 1400) -> Column:
    short = compact(c)
    return F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit), F.lit("..."))).otherwise(short)


def quote(c: Column) -> Column:
    return excerpt(c, 320)


def lines(c: Column) -> Column:
    """Lines as str.splitlines gives them: an end of line at the end makes no empty line."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(let(F.split(c, X.LINE_BREAK), whole))


def clean_lines(c: Column) -> Column:
    """Lines without white space at their ends, blank ones left out, joined again."""
    return F.array_join(F.filter(F.transform(lines(c), stripped), lambda x: x != ""), "\n")


def is_toc(line: Column) -> Column:
    """A line of a table of contents: leader dots before a page number, or mostly dots."""
    def test(x: Column) -> Column:
        rest = F.length(F.regexp_replace(x, r"(?U)[.…\s\d]", ""))
        return (x != "") & (x.rlike(X.LEADER) | ((dots(x) >= 8) & (rest < 40)))

    return F.when(dots(line) >= 5, let(stripped(line), test)).otherwise(line.isNull() & F.lit(None).cast("boolean"))  # fewer dots are none of either


def dots(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, ".…", ""))


def any_of(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def without_toc(c: Column) -> Column:
    """The lines that aren't a table of contents, with line feeds between them; c has no end of line at its end, or that may stay."""
    # a text with few dots has no such line, and one with line feeds only needs no other line ends brought together
    as_is = (dots(c) < 5) & ~c.rlike(X.LINE_BREAK.replace("\n", ""))
    return F.when(as_is, c).otherwise(F.array_join(F.filter(lines(c), lambda x: ~is_toc(x)), "\n"))


def requirement_numbers(c: Column) -> Column:
    """Distinct numbers with units, and numbers behind words of limits, of lines that aren't a table of contents; unsorted."""
    text = without_toc(c)

    def numbers(t: Column, of) -> Column:
        technical = F.transform(F.regexp_extract_all(t, F.lit(of(X.TECHNICAL_NUMBER)), 0), stripped)
        limits = F.transform(F.regexp_extract_all(t, F.lit(of(X.BARE_LIMIT)), 0), lambda m: stripped(F.regexp_extract(m, of(X.NUMBER), 0)))
        return F.filter(F.array_union(technical, limits), lambda v: F.length(v) > 1)

    return F.when(c.rlike("[0-9]") | c.rlike(r"(?U)\d"), by_script(text, numbers)).when(c.isNotNull(), F.array().cast("array<string>"))


def references(c: Column) -> Column:
    """Distinct standards that are referred to, as written."""
    return F.array_distinct(by_script(c, lambda x, of: F.regexp_extract_all(x, F.lit(of(X.REFERENCE)), 0)))


def has_answer_number(c: Column, of=str) -> Column:
    """Whether the text has a quantity; of: what becomes of the patterns first (ascii_classes)."""
    return c.rlike(of(r"(?U)\d")) & reduce(lambda a, b: a | b, [c.rlike(of(p)) for p in X.ANSWER_NUMBERS])


def answer_numbers(c: Column) -> Column:
    """Distinct quantities in the order of the three patterns."""
    def found(x: Column, of) -> Column:
        each = [F.transform(F.regexp_extract_all(x, F.lit(of(p)), 0), stripped) for p in X.ANSWER_NUMBERS]
        if of is str:
            return F.concat(*each)
        # the first and the third want a degree or a kelvin, which few texts have
        none = F.array().cast("array<string>")
        return F.concat(F.when(x.rlike(r"(?i)\d\s*(?:K|degree)"), each[0]).otherwise(none), each[1], F.when(x.rlike("(?i)degree"), each[2]).otherwise(none))

    return F.when(c.rlike("[0-9]") | c.rlike(r"(?U)\d"), F.array_distinct(by_script(c, found))).when(c.isNotNull(), F.array().cast("array<string>"))


def regulation_codes(c: Column) -> Column:
    """Distinct canonical codes (FMVSS123, UNR13, GB12676), sorted."""
    up = F.upper(c)
    named = lambda prefix: lambda n: F.concat(F.lit(prefix), n.cast("int").cast("string"))
    found = [F.transform(F.regexp_extract_all(up, F.lit("(?U)" + p), 1), named(k)) for p, k in X.CODES]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def expanded(c: Column) -> Column:
    """The text with the words that its terms stand for; only texts with CJK characters are looked at term by term."""
    more = F.concat(*[F.when(F.contains(c, F.lit(t)), F.lit(" " + a)).otherwise("") for t, a in X.EXPANSIONS.items()])
    return F.when(c.rlike(r"[一-鿿]"), F.concat(c, more)).otherwise(c)


def tokens(c: Column) -> Column:
    """Words of the lower-cased, expanded text in order, then pairs of all its CJK characters, which may straddle gaps."""
    text = expanded(F.lower(c))
    cjk = F.regexp_replace(text, r"[^一-鿿]+", "")
    none = F.array().cast("array<string>")
    grams = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    pairs = F.when(F.length(cjk) > 1, let(cjk, grams)).otherwise(none)
    return F.concat(F.regexp_extract_all(text, F.lit(X.TOKEN), 0), pairs)


def sentences(c: Column) -> Column:
    """Sentences of 20 characters and more, then each two neighbours joined."""
    parts = by_script(compact(c), lambda x, of: F.split(x, of(X.SENTENCE_BREAK)))
    single = F.filter(F.transform(parts, stripped), lambda s: F.length(s) >= 20)
    joined = lambda s: F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.size(s)), lambda a, b: F.concat_ws(" ", a, b))
    return let(single, lambda s: F.concat(s, joined(s)))


def normalized_unit(unit: Column) -> Column:
    u = stripped(unit)
    low = F.lower(u)
    return F.when(low == "degrees", "degree").when(low == "percent", "%").when(u == "℃", "°C").otherwise(u)


def label_of(sentence: Column, unit: Column) -> Column:
    """What a quantity measures: by its unit, or by words of its sentence where the unit says too little."""
    low, u = F.lower(sentence), F.lower(unit)
    out = None
    for units, label in X.UNIT_LABELS:
        out = F.when(u.isin(*units), label) if out is None else out.when(u.isin(*units), label)
    out = out.when(u.isin(*X.LENGTHS), F.when(any_of(low, X.DISTANCE_WORDS), "距离").otherwise("尺寸/距离"))
    for words, label in X.WORD_LABELS:
        out = out.when(any_of(low, words), label)
    return out.otherwise(X.OTHER_LABEL)


def ranked(c: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def intent_of(question: Column) -> Column:
    low = F.lower(question)
    out = None
    for intent, terms in X.INTENT_TERMS:
        out = F.when(any_of(low, terms), intent) if out is None else out.when(any_of(low, terms), intent)
    return out.otherwise("")


def _by_intent(intent: Column, of: dict, what) -> Column:
    out = None
    for k, v in of.items():
        out = F.when(intent == k, what(v)) if out is None else out.when(intent == k, what(v))
    return out


def fits_intent(number: Column, intent: Column) -> Column:
    low = F.lower(number)
    return F.when(intent == "", True).otherwise(F.coalesce(_by_intent(intent, X.INTENT_UNITS, lambda units: any_of(low, units)), F.lit(False)))


def sentence_fits_intent(sentence: Column, intent: Column) -> Column:
    low = F.lower(sentence)
    return F.coalesce(_by_intent(intent, X.INTENT_SENTENCES, lambda terms: any_of(low, terms)), F.lit(False))


def unit_bonus(numbers: Column, intent: Column) -> Column:
    each = F.aggregate(numbers, F.lit(0.0), lambda a, n: a + F.when(fits_intent(n, intent), 5.0).otherwise(0.2))
    return F.when(intent == "", F.size(numbers) * 1.5).otherwise(each)


def name_from_filename(c: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(c, r"(?i)\.pdf$", ""), F.lit("_"), F.lit(" ")))


def truncated_json(c: Column, limit: int = 12000) -> Column:
    """A JSON text, or where it is too long an object with its beginning."""
    cut = F.to_json(F.struct(F.lit(True).alias("truncated"), F.substring(c, 1, limit).alias("preview")))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def normalized_email(c: Column) -> Column:
    return F.lower(stripped(c))


def clean_path(c: Column) -> Column:
    """The path with / between its parts, without empty and . parts, and with .. parts taken back; what leads out of the top stays there."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda s, p: F.when(p != "..", F.concat(s, F.array(p))).when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s))
    return F.concat(F.when(F.startswith(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


def is_under(path: Column, parent: Column) -> Column:
    """Whether a path is this folder or lies in it, part by part."""
    a, b = clean_path(path), F.rtrim(clean_path(parent), F.lit("/"))
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/")))


def shown_path(path: Column, root: Column) -> Column:
    """The path below root, with / between its parts; one from elsewhere as it is but for that."""
    a, b = clean_path(path), F.rtrim(clean_path(root), F.lit("/"))
    below = F.regexp_replace(F.substr(a, F.length(b) + 2), "^$", ".")
    return F.when(is_under(path, root), below).otherwise(F.replace(path, F.lit("\\"), F.lit("/")))
