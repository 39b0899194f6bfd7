"""Dynamic script values: coercions and operators as column expressions; and value normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_to_boolean(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def string_to_boolean(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def string_to_number(c: Column) -> Column:
    """A string's number; NaN if it isn't one."""
    return F.coalesce(F.expr("1").cast("double") * c.try_cast("double"), F.lit(float("nan")))


def array_to_string(c: Column) -> Column:
    """The first item, "" if there is none."""
    return F.coalesce(F.try_element_at(c, F.lit(1)).cast("string"), F.lit(""))


def map_to_number(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)).cast("double")


def put(m: Column, key: Column, value: Column, overwrite: bool = True) -> Column:
    """m with key set; without overwrite, a present key keeps its value."""
    without = F.map_filter(m, lambda k, v: k != key)
    return F.map_concat(without, F.map_from_arrays(F.array(key), F.array(value))) if overwrite else F.when(F.map_contains_key(m, key), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(key), F.array(value))))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null is less than anything else."""
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def compare_arrays(a: Column, b: Column) -> Column:
    """Arrays compare by their lengths."""
    return compare(F.size(a), F.size(b))


#: Blanks, invisible blanks and lone diacritical marks.
WIDE = "\\u00A0\\u2000-\\u2008"
THIN = "\\u2009-\\u200F"
MARKS = "\\u00A8\\u00B0\\u00B4\\u00B8\\u02C7\\u02D8-\\u02DB"


def normal_spaces(c: Column) -> Column:
    """Blanks normalised: one after , ; . and :, none before them and inside brackets, none double, no invisible ones and lone marks."""
    plain = F.regexp_replace(F.regexp_replace(c, f"[{WIDE}]", " "), f"[{THIN}]", "")
    spaced = F.regexp_replace(F.regexp_replace(plain, "[,;.:]", "$0 "), "\\s{2,}", " ")
    closed = F.regexp_replace(F.regexp_replace(spaced, "([(\\[])\\s+", "$1"), "\\s+([)\\],;.:])", "$1")
    return F.regexp_replace(closed, f"[{MARKS}]", "")  # marks last, so blanks around one stay


def pattern_replace(c: Column, pattern: str, replacement: str) -> Column:
    """Replaces a value's first match and trims. The match must be the whole value, unless "$_" before the replacement leaves its start open and "_$" after it its end; "$_$" leaves both."""
    if replacement == "$_$":
        replacement, head, tail = "", "", ""
    else:
        head, tail = ("" if replacement.startswith("$_") else "^"), ("" if replacement.endswith("_$") else "$")
        replacement = replacement.removeprefix("$_").removesuffix("_$")
    whole = f"{head}(?:{pattern}){tail}"
    return F.when(c.rlike(whole), F.trim(F.concat(F.split(c, whole, 2)[0], F.lit(replacement), F.split(c, whole, 2)[1]))).otherwise(c)


def let(c: Column, f) -> Column:
    """f of a column that is computed once; without it, an expression that f uses twice doubles at each step."""
    return F.transform(F.array(c), f)[0]


#: Passes over the patterns of a field, after which a value that still changes is an error.
PASSES = 64


def normalise(key: Column, name: str, value: Column, by_key: dict[str, dict[str, str]], by_value: dict[str, dict[str, str]], characters: list[tuple[str, str]], patterns: list[tuple[str, str]], passes: int = PASSES) -> Column:
    """A field's value by precedence: a replacement for the key, one for the value, else characters, blanks, and patterns, the first that matches in each pass, until nothing changes or a value comes back. More than PASSES changes are an error."""
    out = value
    for pattern, replacement in characters:
        out = F.regexp_replace(out, pattern, replacement)
    out = normal_spaces(out)

    def first_match(x: Column) -> Column:
        step = x
        for pattern, replacement in reversed(patterns):
            step = F.when(pattern_replace(x, pattern, replacement) != x, pattern_replace(x, pattern, replacement)).otherwise(step)
        return step

    def step(seen: Column, _: Column) -> Column:  # the values so far, the last one twice when it is done
        last = F.element_at(seen, -1)
        done = (F.size(seen) > 1) & (F.array_position(seen, last) < F.size(seen))
        return F.when(done, seen).otherwise(F.concat(seen, F.array(first_match(last))))

    if patterns:
        seen = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.array(out), step)
        out = let(seen, lambda x: F.when(F.element_at(x, -1).isNull() | (F.array_position(x, F.element_at(x, -1)) < F.size(x)), F.element_at(x, -1)).otherwise(F.raise_error(F.lit("patterns change a value without end")).cast("string")))
    out = normal_spaces(out)
    for known, replacement in by_value.get(name, {}).items():
        out = F.when(value == known, replacement).otherwise(out)
    for known, fields in by_key.items():
        if name in fields:
            out = F.when(key == known, fields[name]).otherwise(out)
    return out


def repair_mojibake(c: Column) -> Column:
    """Text whose UTF-8 was read as Latin-1."""
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")


#: Letters that count as one in fuzzy keys, p as b, g and k as c, t as d, j and y as i, z as s.
ALIKE = ("pgktjyz", "bccdiis")


def fuzzy_key(c: Column) -> Column:
    """Letters only, similar sounding ones as one, runs collapsed."""
    from ..operators.tokens import fold_accents

    letters = F.regexp_replace(F.lower(fold_accents(c)), "[^a-z]", "")
    return F.regexp_replace(F.translate(letters, *ALIKE), "(.)\\1+", "$1")
