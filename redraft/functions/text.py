"""String functions of the normaliser, as column expressions; only Unicode forms need Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed ligatures U+FB00 to U+FB06 and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Horizontal white space.
BLANKS = r"[ \t   -   　]+"
#: Code points of Chinese, Japanese and Korean scripts.
CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]"
NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"


def expand_ligatures(c: Column) -> Column:
    """Ligature characters as their letters."""
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def collapse_blanks(c: Column) -> Column:
    """Runs of horizontal white space as one blank."""
    return F.regexp_replace(c, BLANKS, " ")


def canonical(c: Column) -> Column:
    """Ligatures, then white space; line breaks are settled where lines are joined, composition by ``nfc``."""
    return collapse_blanks(expand_ligatures(c))


def mask_numbers(c: Column) -> Column:
    """Numbers as <NUM>."""
    return F.regexp_replace(c, NUMBER, "<NUM>")


def matching(c: Column, share: float) -> Column:
    """Masked text if at most ``share`` of its characters are masks, else the text itself."""
    masked = mask_numbers(c)
    masks = F.length(masked) - F.length(F.replace(masked, F.lit("<NUM>"), F.lit("")))
    return F.when(masks <= share * F.length(masked), masked).otherwise(c)


def fold_width(c: Column) -> Column:
    """Full-width ASCII forms and the ideographic blank as their narrow ones."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(c, wide, "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)) + " ")


def tokens(c: Column) -> Column:
    """Code points of a text; an empty text has none."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def is_label(c: Column, low: int, high: int) -> Column:
    """Structural label: so many code points, something alphanumeric, a colon at the end."""
    return F.length(c).between(low, high) & c.rlike(r"[\p{L}\p{N}]") & c.rlike("[:：]$")


def has_cjk(c: Column) -> Column:
    """Whether a text has a character of the CJK scripts."""
    return c.rlike(CJK)


def escape(c: Column) -> Column:
    """Control and bidirectional characters made visible, so that no terminal obeys them."""
    marks = [*range(0x00, 0x20), 0x7F, *range(0x80, 0xA0), 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)]
    pieces = F.regexp_extract_all(c, F.lit(r"[\x{0}-\x{1f}\x{7f}-\x{9f}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]|[^\x{0}-\x{1f}\x{7f}-\x{9f}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when((F.length(x) == 1) & F.ascii(x).isin(*marks), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(x))), F.lit("}"))).otherwise(x)), "")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, for matching texts only."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def break_case(before: Column, after: Column) -> Column:
    """Which of the ordered cases settles the break between two lines; 6 keeps it and is an issue.

    1 soft hyphen goes, 2 hyphen stays and the break goes, 3 blank between digits, 4 the break goes beside white space
    or between CJK characters, 5 blank between words, 6 the break stays.
    """
    word, cjk = r"[\p{IsLatin}0-9]", CJK
    return (
        F.when(before.rlike("­$") & (F.length(after) > 0), 1)
        .when(before.rlike(rf"(?:{word}|{cjk})[-‐]$") & after.rlike(rf"^(?:{word}|{cjk})"), 2)
        .when(before.rlike("[0-9]$") & after.rlike("^[0-9]"), 3)
        .when(before.rlike(r"\s$") | after.rlike(r"^\s") | (before.rlike(f"{cjk}$") & after.rlike(f"^(?:{cjk}|{word})")) | (before.rlike(f"{word}$") & after.rlike(f"^{cjk}")), 4)
        .when(before.rlike(rf"(?:{word}|“\w+”)$") & after.rlike(f"^{word}"), 5)
        .otherwise(6)
    )


def joined_lines(before: Column, after: Column) -> Column:
    """Two lines as one text, by the case of their break."""
    case = break_case(before, after)
    return (
        F.when(case == 1, F.concat(F.regexp_replace(before, "­$", ""), after))
        .when(case.isin(2, 4), F.concat(before, after))
        .when(case.isin(3, 5), F.concat(before, F.lit(" "), after))
        .otherwise(F.concat(before, F.lit("\n"), after))
    )
