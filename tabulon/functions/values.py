"""Cell values: cleaning, typing, dates, normalised keys, typed equality. All are Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.config import DATE_FORMATS, LINK_MARK, NULL_TOKENS, STYLE_MARK

#: A float as text, without the suffixes that Java also takes.
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+(_\d+)*$"
#: Texts that no cleaning step changes and that are numbers.
PLAIN_INTEGER, PLAIN_FLOAT = r"\A-?[0-9]+\z", r"\A-?[0-9]+\.[0-9]+\z"


def spark_format(strptime: str, printed: bool) -> str:
    """Spark's pattern for a strptime format: single letters to parse, padded ones to print."""
    parts = {"%d": "dd" if printed else "d", "%m": "MM" if printed else "M", "%Y": "yyyy", "%b": "MMM", "%B": "MMMM"}
    for a, b in parts.items():
        strptime = strptime.replace(a, b)
    return strptime


MONTHS = "January February March April May June July August September October November December".split()


def shape(strptime: str) -> str:
    """What a text of the format looks like. Months and days are in range, so that a text has one format only.

    What fits a shape and is no date (31 February) fits no later format either.
    """
    parts = {"%d": "(0?[1-9]|[12][0-9]|3[01])", "%m": "(0?[1-9]|1[0-2])", "%Y": "[0-9]{4}", "%b": f"({'|'.join(m[:3] for m in MONTHS)})", "%B": f"({'|'.join(MONTHS)})"}
    for a, b in parts.items():
        strptime = strptime.replace(a, b)
    return f"(?i)^{strptime}$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, and outside generated code."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _each(c: Column, formats: tuple[str, ...], make) -> Column:
    """The first of ``make(format, timestamp)`` whose format's shape fits. Formats are literals, so that Spark keeps their parsers.

    One pattern of all shapes is tried first, so that a text that is no date costs one match.
    """
    def first(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for f in reversed(formats):
            out = F.when(s.rlike(shape(f)), make(f, F.try_to_timestamp(s, F.lit(spark_format(f, False))))).otherwise(out)
        return out

    s = F.regexp_replace(c, r"\s+", " ")
    any_shape = "(?i)" + "|".join(shape(f).removeprefix("(?i)") for f in formats)
    return F.when(s.rlike(any_shape), let(s, first))


def date_format_of(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first strptime format that fits, or null."""
    return _each(c, formats, lambda f, t: F.when(t.isNotNull(), F.lit(f)))


def canonical_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date printed again, padded, in the first format that fits, or null."""
    return _each(c, formats, lambda f, t: F.date_format(t, spark_format(f, True)))


def tidy(c: Column) -> Column:
    """Plain spaces for no-break ones, style marks removed, spaces and link marks cut off both ends."""
    return F.btrim(F.translate(c, " " + STYLE_MARK, " "), F.lit(" " + LINK_MARK))


def plain_number(c: Column, otherwise: Column) -> Column:
    """The struct of a text of digits alone, which is what most cells are, without the other steps; else ``otherwise``."""
    make = lambda kind: F.struct(F.lit(kind).alias("kind"), c.try_cast("double").alias("num"), F.lit(None).cast("string").alias("txt"))
    return F.when(c.rlike(PLAIN_INTEGER), make("int")).when(c.rlike(PLAIN_FLOAT), make("float")).otherwise(otherwise)


def typed(c: Column, null_tokens: tuple[str, ...] = NULL_TOKENS, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """struct<kind, num, txt> of a text: kind is int, float, date or str; null for a null or a null token.

    Null tokens are tested before anything is trimmed. Numbers may hold commas and spaces. Only texts with
    a space, slash or dash and without a colon can be dates; a date is kept as canonical text.
    """
    num, txt = F.lit(None).cast("double"), F.lit(None).cast("string")
    make = lambda k, n=num, t=txt: F.struct(k.alias("kind"), n.alias("num"), t.alias("txt"))

    def of(s: Column, d: Column) -> Column:
        date = F.when(s.rlike(r"[ /-]") & ~s.contains(":"), canonical_date(s, formats))
        number = F.regexp_replace(d, "_", "").try_cast("double")
        endless = F.lower(F.regexp_replace(d, r"^[+-]", "")).isin("inf", "infinity")
        return (
            F.when(F.lower(d) == "nan", F.lit(None))
            .when(d.rlike(INTEGER), make(F.lit("int"), number))
            .when(d.rlike(FLOAT), make(F.lit("float"), number))
            .when(endless, make(F.lit("float"), F.when(d.startswith("-"), float("-inf")).otherwise(float("inf"))))
            .otherwise(let(date, lambda x: make(F.when(x.isNull(), "str").otherwise("date"), num, F.coalesce(x, s))))
        )

    # each step is a value of its own: written out in one another they would be worked out many times over
    plain = F.btrim(F.trim(F.regexp_replace(F.translate(c, "−–—", "---"), '"', "")), F.lit(" \t\n\r\x0b\x0c"))
    full = let(plain, lambda s: let(F.regexp_replace(s, "[, ]", ""), lambda d: of(s, d)))
    return F.when(c.isNull() | c.isin(*null_tokens), F.lit(None)).otherwise(plain_number(c, full))


def number(c: Column, kind: str = "float") -> Column:
    """The same struct for a numeric column; null and NaN are null."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.struct(F.lit(kind).alias("kind"), x.alias("num"), F.lit(None).cast("string").alias("txt")))


def same(a: Column, b: Column) -> Column:
    """Typed equality: numbers by value, texts exactly, a number never equals a text, null equals null."""
    both = F.when(a["num"].isNotNull() & b["num"].isNotNull(), a["num"] == b["num"]).otherwise(F.coalesce(a["txt"] == b["txt"], F.lit(False)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)


def within(reference: Column, fetched: Column, absolute: bool = False) -> Column:
    """Numbers that differ by less than a thousandth of the reference. Without ``absolute`` never true for zero or negative ones."""
    if absolute:
        return F.abs(fetched - reference) < F.abs(reference) * 0.001
    return (reference * 0.999 < fetched) & (fetched < reference * 1.001)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.when(p.isNotNull() & r.isNotNull(), 0.0))


@lru_cache(1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Accented letters below U+0250 and their plain ones, and letters that become two, by decomposition."""
    many = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}
    single = {"ø": "o", "đ": "d", "ł": "l", "ð": "d", "ı": "i", "ħ": "h", "ŧ": "t"}
    for i in range(0xC0, 0x250):
        ch = chr(i)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if ch not in many and ch.islower() and len(plain) == 1 and plain.isascii():
            single[ch] = plain
    return "".join(single), "".join(single.values()), many


def plain_letters(c: Column) -> Column:
    """Lower-case Latin letters without their accents."""
    a, b, many = _folds()
    c = F.translate(c, a, b)
    for x, y in many.items():
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


KEY_NULLS = ("none", "n/a", "nan", "-", "--", "unknown")
VALUE_NULLS = ("none", "n/a", "nan", "-")


def _normalised(c: Column, nulls: tuple[str, ...]) -> Column:
    s = F.replace(F.lower(F.btrim(c, F.lit(" \t\n\r\x0b\x0c "))), F.lit("&"), F.lit("and"))
    kept = F.regexp_replace(plain_letters(s), r"[^\p{L}\p{N}]", "")
    return F.when(c.isNull() | s.isin(*nulls), "").when(s == "united states", "usa").when(s == "united kingdom", "uk").otherwise(kept)


def normalize_key(c: Column) -> Column:
    """Keys as they are aligned: lower case, plain letters and digits only; null words become empty."""
    return _normalised(c, KEY_NULLS)


def normalize_value(c: Column) -> Column:
    """struct<num, txt>: texts that look like numbers as numbers, others normalised as keys are."""
    d = F.regexp_replace(c, ",", "")
    numeric = F.when(d.rlike(r"^-?\d+$") | d.rlike(r"^-?\d*\.\d+$|^-?\d+\.$"), d.try_cast("double"))
    return F.struct(numeric.alias("num"), F.when(numeric.isNull(), _normalised(c, VALUE_NULLS)).alias("txt"))


def year_key(c: Column) -> Column:
    return c.try_cast("double").cast("bigint").cast("string")


def is_ascii(c: Column, null_tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """ASCII, but for style marks; null, a null token and a lone mark pass."""
    return c.isNull() | c.isin(*null_tokens, STYLE_MARK, LINK_MARK) | c.rlike(rf"^[\x00-\x7F{STYLE_MARK}]*$")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def quoted_key(reply: Column) -> Column:
    """What stands between the first and the last single quote of a reply; null without them."""
    return F.nullif(F.regexp_extract(reply, "'(.+)'", 1), F.lit(""))


def revision_url(edit_url: Column, revid: Column) -> Column:
    return F.concat(F.replace(edit_url, F.lit("&action=edit"), F.lit("")), F.lit("&oldid="), revid.cast("string"))


def title_of(edit_url: Column) -> Column:
    return F.regexp_extract(edit_url, "title=(.+)&", 1)
