"""String rules of the document formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.rounding import half_up

ELLIPSIS = "…"
#: Width of a character, in thousandths of the font size, where a font has no entry for it.
EM = 500


def text_width(text: Column, size: Column, bold: Column | None = None, em: int = EM) -> Column:
    """Width under a constant metric; bold text is 5 percent wider."""
    wide = F.length(text) * size * (em / 1000.0)
    return wide if bold is None else wide * F.when(bold, 1.05).otherwise(1.0)


def truncate(text: Column, size: Column, most: Column, em: int = EM) -> Column:
    """The text itself if it fits, else its longest prefix that fits with an ellipsis, and that."""
    one = size * (em / 1000.0)
    room = F.greatest(F.floor((most - one) / one), F.lit(0)).cast("int")
    return F.when(text_width(text, size, em=em) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), room), F.lit(ELLIPSIS)))


def decode_entities(text: Column) -> Column:
    """The five named entities and numeric ones (UTF-16 units); an ampersand that was escaped isn't read again."""
    mark = "\ufdd0"
    out = text
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))

    def one(acc: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, "([0-9A-Fa-f]+);", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code % 65536), 4, "0")), "UTF-16BE")
        return F.replace(acc, ref, F.when(char == "&", F.lit(mark)).otherwise(char))

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(0)))
    out = F.aggregate(refs, out, one)
    out = F.replace(out, F.lit("&amp;"), F.lit(mark))
    return F.replace(out, F.lit(mark), F.lit("&"))


def detect_delimiter(text: Column) -> Column:
    """The most frequent of comma, tab, semicolon and bar in the first line; the earlier wins ties; comma if none is there."""
    at = F.locate("\n", text)
    line = F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    count = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    options = F.array(*(F.struct(count(d).alias("n"), F.lit(-i).alias("prio"), F.lit(d).alias("d")) for i, d in enumerate((",", "\t", ";", "|"))))
    best = F.array_max(options)
    return F.when(best["n"] > 0, best["d"]).otherwise(F.lit(","))


def column_of(ref: Column) -> Column:
    """Zero-based column of a cell reference: its leading capitals in base 26."""
    letters = F.split(F.regexp_extract(ref, "^([A-Z]*)", 1), "")
    return (F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1).cast("int")


def row_of(ref: Column) -> Column:
    """Zero-based row of a cell reference: all of its digits."""
    return F.regexp_replace(ref, "[^0-9]", "").cast("int") - 1


def cell_ref(col: Column, row: Column) -> Column:
    """Reference of a zero-based column and row."""
    n = col.cast("int")
    letters = F.lit("")
    start = [0, 26, 26 + 26**2]
    for width in (1, 2, 3):
        k = n - start[width - 1]
        digits = [F.chr(F.lit(65) + F.floor(k / 26**i) % 26) for i in reversed(range(width))]
        letters = F.when((k >= 0) & (k < 26**width), F.concat(*digits)).otherwise(letters)
    return F.concat(letters, (row + 1).cast("string"))


def fixed(x: Column, digits: int) -> Column:
    """Decimal text of so many places; halves go up in magnitude."""
    return F.format_string(f"%.{digits}f", F.round(x.cast("decimal(38,12)"), digits).cast("double"))


def format_number(value: Column, number_format: Column, code: Column) -> Column:
    """Displayed text of a numeric cell under a format id or a custom code; text that is no number stays."""
    x = F.expr("double(null)") if value is None else value.try_cast("double")
    whole = x == F.floor(x)
    plain = F.when(whole, x.cast("long").cast("string")).otherwise(fixed(x, 2))
    general = F.when(whole, x.cast("long").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(fixed(x, 8), "0+$", ""), "\\.$", ""))
    percent = F.concat(half_up(x * 100).cast("string"), F.lit("%"))
    grouped = F.regexp_replace(F.regexp_replace(F.format_number(F.round(x.cast("decimal(38,12)"), 2).cast("double"), 2), "0+$", ""), "\\.$", "")
    custom = (
        F.when(code.contains("$"), F.concat(F.lit("$"), fixed(x, 2)))
        .when(code.contains("%"), percent)
        .when(code.contains(","), grouped)
        .when(code.contains("0.00"), fixed(x, 2))
        .otherwise(plain)
    )
    return (
        F.when(x.isNull(), value)
        .when(number_format <= 1, general)
        .when(number_format == 2, fixed(x, 2))
        .when(number_format == 3, fixed(x, 3))
        .when(number_format == 4, fixed(x, 4))
        .when(number_format.between(5, 8), F.concat(F.lit("$"), fixed(x, 2)))
        .when(number_format == 9, percent)
        .when(number_format == 10, F.concat(fixed(x * 100, 2), F.lit("%")))
        .when(number_format.between(14, 22), value)
        .when(number_format.between(37, 40), grouped)
        .otherwise(custom)
    )


def normalize_path(path: Column) -> Column:
    """Absolute paths lose their slash; others lose `.` parts, and `..` removes the part before."""
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.startswith(path, F.lit("/")), F.substring(path, F.lit(2), F.length(path))).otherwise(F.array_join(parts, "/"))


#: Points in a unit.
UNITS = {"cm": 72 / 2.54, "mm": 72 / 25.4, "in": 72.0, "pt": 1.0, "pc": 12.0, "px": 0.75}


def to_points(text: Column) -> Column:
    """Points of a length with a unit; null where there is no number, 1:1 where there is no unit."""
    number = F.regexp_extract(text, "^\\s*(-?[0-9]*\\.?[0-9]+)", 1).try_cast("double")
    unit = F.regexp_extract(text, "([a-z]+)\\s*$", 1)
    scale = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), F.nullif(unit, F.lit(""))), F.lit(1.0))
    return number * scale


def wrap(words: Column, width: Column, space: Column) -> Column:
    """Greedy lines of an array of words whose widths are their lengths: a word that doesn't fit starts a line, however long it is.

    Result: array<array<string>>, the words of each line. An ordered fold, since each break depends on those before it;
    it keeps the places where lines start only, and the lines are cut from the words once.
    """
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("used"))

    def put(state: Column, word: Column) -> Column:
        more = state["used"] + space + F.length(word)
        fits = (state["at"] > 0) & ((state["used"] == 0) | (more <= width))
        used = F.when(fits & (state["used"] > 0), more).otherwise(F.length(word))
        starts = F.when(fits, state["starts"]).otherwise(F.array_append(state["starts"], state["at"]))
        return F.struct(starts.alias("starts"), (state["at"] + 1).alias("at"), used.cast("int").alias("used"))

    def cut(starts: Column) -> Column:
        end = lambda j: F.when(j + 1 < F.size(starts), F.get(starts, j + 1)).otherwise(F.size(words))
        return F.transform(starts, lambda s, j: F.slice(words, s + 1, end(j) - s))

    found = F.aggregate(words, start, put, lambda s: s["starts"])
    return F.element_at(F.transform(F.array(found), cut), 1)


def base64_line(content: Column) -> Column:
    """Base64 without the line breaks that Spark's own may have."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")
