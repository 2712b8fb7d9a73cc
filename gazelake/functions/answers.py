"""Columns that read points and reasoning out of model answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .geometry import col

# fixed values: answer patterns
THINK = r"<think>(.*?)</think>"
ANSWER = r"<answer>(.*?)</answer>"
STRICT_POINT = r"\[(\d+) \s*(\d+)\]"
LOOSE_POINT = r"\[(\d+)\s*[\s,]\s*(\d+)\]"
FORMAT = r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z"


def stripped(text) -> Column:
    return F.regexp_replace(col(text), r"(?U)\A\s+|\s+\z", "")


def tagged(text, pattern) -> Column:
    """Text inside the tag, or the whole text when there is none.

    A tag that spans lines is not found, as ``.`` stops at a line break.
    """
    text = col(text)
    # (?d): only \n ends a line, so that \r and the Unicode separators match "."
    found = F.regexp_extract(text, "(?d)" + pattern, 1)
    return stripped(F.when(text.rlike("(?d)" + pattern), found).otherwise(text))


def reasoning(text) -> Column:
    return tagged(text, THINK)


def answer(text) -> Column:
    return tagged(text, ANSWER)


def normalized(text) -> Column:
    """Tidy brackets and turn commas and hyphens into blanks, in this order."""
    out = col(text)
    for old, new in (("[ ", "["), (" ]", "]"), (",", " "), ("-", " ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def points(text, pattern=STRICT_POINT) -> Column:
    """``array<struct<x,y>>`` of all point matches in the text."""
    text = col(text)
    xs = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    ys = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    largest = F.lit(2**63 - 1).cast("bigint")

    def number(digits):
        return F.coalesce(digits.try_cast("bigint"), largest)

    return F.zip_with(xs, ys, lambda a, b: F.struct(number(a).alias("x"), number(b).alias("y")))


def answer_points(text) -> Column:
    return points(normalized(answer(text)))


def structured_points(text) -> Column:
    """Points of ``[{'Position': [x, y]}, ...]``; entries without two numbers are dropped."""
    schema = T.ArrayType(T.StructType([T.StructField("Position", T.ArrayType(T.DoubleType()))]))
    parsed = F.from_json(col(text), schema, {"allowSingleQuotes": "true"})
    positions = F.transform(parsed, lambda e: e["Position"])
    usable = F.filter(positions, lambda p: p.isNotNull() & (F.size(p) >= 2)
                      & p[0].isNotNull() & p[1].isNotNull())
    return F.transform(usable, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def repaired(prediction, width, height) -> Column:
    """Drop malformed points; a list emptied by that becomes the image centre.

    All malformed points are dropped, also neighbours of dropped ones. A list
    that was empty before stays empty.
    """
    prediction = col(prediction)
    good = F.filter(prediction, lambda p: F.size(p) == 2)
    centre = F.array(F.array(F.floor(col(width) / 2).cast("int"), F.floor(col(height) / 2).cast("int")))
    return F.when((F.size(good) == 0) & (F.size(prediction) > 0), centre).otherwise(good)


def well_formed(prediction) -> Column:
    return ~F.exists(col(prediction), lambda p: F.size(p) != 2)


def checked(prediction) -> Column:
    """The prediction, or an error when a point is malformed."""
    prediction = col(prediction)
    return F.when(well_formed(prediction), prediction).otherwise(
        F.raise_error(F.lit("prediction with a point that has not two coordinates")).cast(
            T.ArrayType(T.ArrayType(T.IntegerType()))))


def format_reward(text) -> Column:
    """1.0 when the whole text is one reasoning and one answer block."""
    return F.when(col(text).rlike(FORMAT), F.lit(1.0)).otherwise(F.lit(0.0))
