"""String functions by their T-SQL and PL/SQL names, as Column expressions.

Lengths and positions count characters; DATALENGTH counts bytes. LEN ignores trailing blanks, and
SUBSTRING from a start below 1 is empty. SOUNDEX of text without a letter is 0000, and vowels, H, W and Y all separate equal codes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_c = lambda x: x if isinstance(x, Column) else F.lit(x)

#: Longest result that REPLICATE and SPACE give.
MAX_REPEAT = 1_000_000


def concat(*xs) -> Column:
    """Nulls count as empty."""
    return F.concat(*[F.coalesce(_c(x).cast("string"), F.lit("")) for x in xs])


def difference(a, b) -> Column:
    """How many of the four places of both SOUNDEX codes agree."""
    x, y = soundex(a), soundex(b)
    return sum(((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(2, 5)), (F.substring(x, 1, 1) == F.substring(y, 1, 1)).cast("int"))


def soundex(s) -> Column:
    """The first letter and the codes of those after it, without repeats and uncoded letters, as four places."""
    letters = F.regexp_replace(F.upper(_c(s)), F.lit("[^A-Z]"), F.lit(""))
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    rest = F.regexp_replace(F.substring(F.regexp_replace(codes, F.lit(r"(\d)\1+"), F.lit("$1")), 2, 1 << 30), F.lit("0"), F.lit(""))
    return F.when(letters == "", F.lit("0000")).otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), rest), 4, "0"))


def patindex(pattern: str, s) -> Column:
    """1-based place where a LIKE pattern first matches, 0 if nowhere. Without a leading % it must match at the start."""
    regex = "".join({"%": ".*?", "_": "."}.get(ch, "\\" + ch if ch in r"\.^$|?*+()[]{}" else ch) for ch in pattern.strip("%"))
    regex = ("" if pattern.startswith("%") else "^") + regex + ("" if pattern.endswith("%") else "$")
    return F.when(F.regexp_like(_c(s), F.lit(f"(?s){regex}")), F.regexp_instr(_c(s), F.lit(f"(?s){regex}"))).otherwise(0)


def quotename(s, quote: str = "[") -> Column:
    left, right = {"[": "[]", "]": "[]", "(": "()", "<": "<>", "{": "{}"}.get(quote, quote * 2)
    return F.concat(F.lit(left), F.replace(_c(s), F.lit(right), F.lit(right * 2)), F.lit(right))


def str_(number, length: int = 10, decimals: int = 0) -> Column:
    """A number right-aligned; stars where it doesn't fit."""
    text = F.format_string(f"%.{decimals}f", _c(number).cast("double"))
    return F.when(F.length(text) > length, F.lit("*" * length)).otherwise(F.lpad(text, length, " "))


def stuff(s, start, length, new) -> Column:
    """Replace so many characters from a place; null if the place is outside the string."""
    s, a, n = _c(s), _c(start), _c(length)
    out = F.concat(F.substring(s, F.lit(1), a - 1), _c(new), F.substring(s, a + n, F.length(s)))
    return F.when((a >= 1) & (a <= F.length(s)) & (n >= 0), out)


def substring(s, start, length) -> Column:
    return F.when(_c(start) < 1, F.lit("")).otherwise(F.substring(_c(s), _c(start), _c(length)))


def repeat(s, n) -> Column:
    return F.repeat(_c(s), F.least(F.greatest(_c(n), F.lit(0)), F.lit(MAX_REPEAT)).cast("int"))


def stem(word) -> Column:
    """Suffix stemmer: -ing of words over 5 characters, -ed over 4, -s over 3 unless -ss."""
    w = _c(word)
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(F.endswith(w, F.lit("ing")) & (F.length(w) > 5), cut(3))
        .when(F.endswith(w, F.lit("ed")) & (F.length(w) > 4), cut(2))
        .when(F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")) & (F.length(w) > 3), cut(1))
        .otherwise(w)
    )


#: Name -> function of columns or plain values.
STRING_FUNCTIONS = {
    "ASCII": lambda s: F.ascii(_c(s)),
    "CHAR": lambda n: F.char(_c(n)),
    "NCHAR": lambda n: F.decode(F.unhex(F.lpad(F.hex(_c(n).cast("long")), 8, "0")), "UTF-32"),
    "CHARINDEX": lambda sub, s, start=1: F.locate(sub, _c(s), start) if isinstance(sub, str) else F.position(_c(sub), _c(s), _c(start)),
    "CONCAT": concat,
    "CONCAT_WS": lambda sep, *xs: F.concat_ws(sep, *[_c(x).cast("string") for x in xs]),
    "DATALENGTH": lambda s: F.octet_length(_c(s)),
    "DIFFERENCE": difference,
    "FORMAT": lambda n, decimals=2: F.format_number(_c(n), decimals),
    "LEFT": lambda s, n: F.left(_c(s), _c(n)),
    "LEN": lambda s: F.length(F.rtrim(_c(s))),
    "LENGTH": lambda s: F.length(_c(s)),
    "LOWER": lambda s: F.lower(_c(s)),
    "LTRIM": lambda s: F.ltrim(_c(s)),
    "PATINDEX": patindex,
    "QUOTENAME": quotename,
    "REPLACE": lambda s, a, b: F.replace(_c(s), _c(a), _c(b)),
    "REPLICATE": repeat,
    "REVERSE": lambda s: F.reverse(_c(s)),
    "RIGHT": lambda s, n: F.right(_c(s), _c(n)),
    "RTRIM": lambda s: F.rtrim(_c(s)),
    "SOUNDEX": soundex,
    "SPACE": lambda n: repeat(" ", n),
    "STR": str_,
    "STUFF": stuff,
    "SUBSTRING": substring,
    "SUBSTR": substring,
    "TRANSLATE": lambda s, a, b: F.translate(_c(s), a, b),
    "TRIM": lambda s, chars=None: F.trim(_c(s)) if chars is None else F.btrim(_c(s), _c(chars)),
    "UNICODE": lambda s: F.ascii(_c(s)),
    "UPPER": lambda s: F.upper(_c(s)),
    "INSTR": lambda s, sub: F.instr(_c(s), sub),
    "LEVENSHTEIN": lambda a, b: F.levenshtein(_c(a), _c(b)),
    "XXHASH64": lambda *xs: F.xxhash64(*[_c(x) for x in xs]),
}


def call(name: str, *args) -> Column:
    """A string function by name."""
    try:
        return STRING_FUNCTIONS[name.upper()](*args)
    except KeyError:
        raise ValueError(f"no string function {name}") from None
