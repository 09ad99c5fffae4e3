"""One form for texts that look the same: confusables skeletons, and the values that deviate from their usual form (5).

The skeleton of a text is its compatibility decomposition with every look-alike character replaced by its prototype and
decomposed again, without invisible characters and with plain spaces; texts that look the same share it. Prototypes are
those of Unicode's whole table of confusable characters (Unicode Technical Standard 39, Unicode licence), which Spark
brings along in its ICU library, and those of the letters below. The canonical form is for reading and comparing: it
composes letters, and resolves look-alikes only inside words that mix scripts. A text deviates where it and its canonical
form share a skeleton and differ: it looks as the usual form does and is made of other characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that look like a Latin letter, by script (after Unicode's table of confusable characters).
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H",
    "а": "a", "в": "b", "е": "e", "з": "3", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "һ": "h", "ӏ": "l", "ѵ": "v",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "ω": "w", "ϲ": "c", "ϳ": "j",
}
ARMENIAN = {
    "Լ": "L", "Օ": "O", "Ս": "U", "Տ": "S",
    "ց": "g", "զ": "q", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ք": "p",
}
CHEROKEE = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g"}
PROTOTYPES = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE, **LATIN}

#: Thai and Lao vowels are single letters of their script, though a compatibility decomposition exists.
NATIVE_COMPAT = "ำຳ"
MARKS = "̀-ͯ"
SCRIPTS = ("A-Za-zªºÀ-ÖØ-öø-ɏɐ-ʯḀ-ỿ", "Ͱ-ͳͶ-ͽͿ-Ͽἀ-῿", "Ѐ-҂Ҋ-ԯ", "Ա-֏", "Ꭰ-Ᏽᏸ-ᏽꭰ-ꮿ")


@cache
def _tables() -> dict:
    """Character sets by rule from the Unicode data, made once a process."""
    compat: dict[int, str] = {}
    singles: list[str] = []
    excluded: dict[int, str] = {}
    invisible: list[str] = []
    spaces: list[str] = []
    apart: dict[int, str] = {}
    for cp in [*range(0x80, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xF900:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cf" or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            invisible.append(c)
        elif kind == "Zs":
            spaces.append(c)
        elif unicodedata.decomposition(c).startswith("<"):
            flat = unicodedata.normalize("NFKC", c)
            if c not in NATIVE_COMPAT and (any(x.isalnum() for x in flat) or c in "ﾞﾟ"):
                compat[cp] = flat
        elif (flat := unicodedata.normalize("NFC", c)) != c:
            if len(flat) == 1:
                singles.append(c)
            else:
                excluded[cp] = flat
        if cp < 0x3400 and kind[0] in "PSZC" and kind != "Cf" and c not in "ำ":
            apart[cp] = " "
    for cp in [*range(0xFE10, 0xFE70), *range(0xFF00, 0xFFF0), *range(0x1F000, 0x20000)]:
        if unicodedata.category(chr(cp))[0] in "PSZC":
            apart[cp] = " "
    for cp in range(0x80):
        if not chr(cp).isalnum():
            apart[cp] = " "
    return {"compat": compat, "singles": "".join(singles), "excluded": excluded, "invisible": "".join(invisible), "spaces": "".join(spaces), "apart": apart}


def _class(chars: str) -> str:
    """A regex class body out of single characters, as ranges."""
    cps, out = sorted(set(map(ord, chars))), []
    for cp in cps:
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in out)


@cache
def _patterns() -> dict[str, re.Pattern]:
    t = _tables()
    # one range for what lies above 0xFFFF: a class of many would be searched range by range
    odd = "".join(c for c in [*map(chr, t["compat"]), *map(chr, t["excluded"]), *t["singles"], *t["invisible"], *t["spaces"]] if c <= "\uffff")
    mixed = "|".join(f"[{a}][{MARKS}]*[{b}]" for a in SCRIPTS for b in SCRIPTS if a != b)
    every = "".join(SCRIPTS)
    return {
        "invisible": re.compile(f"[{_class(t['invisible'])}]"),
        "space": re.compile(f"[{_class(t['spaces'])}]"),
        "compat": re.compile(f"[{_class(''.join(chr(c) for c in t['compat']))}]"),
        "single": re.compile(f"[{_class(t['singles'])}]"),
        "mixed": re.compile(mixed),
        "word": re.compile(f"[{every}{MARKS}]+"),
        "unit": re.compile(f"[^{_class(''.join(map(chr, t['apart'])))}]+"),
        # characters that can be part of a deviation at all; letters of scripts that mix are looked at apart
        "odd": re.compile(f"[{_class(odd)}{MARKS}゙゚\U00010000-\U0010ffff]"),
        "other": re.compile(f"[{''.join(SCRIPTS[1:])}]"),
        **{f"script{i}": re.compile(f"[{s}]") for i, s in enumerate(SCRIPTS)},
    }


@cache
def _to_script() -> list[dict[str, str]]:
    """For each script, letters of the others that have a look-alike in it."""
    latin = dict(PROTOTYPES)
    out = [latin]
    for own in (GREEK, CYRILLIC, ARMENIAN, CHEROKEE):
        back: dict[str, str] = {}
        for c, p in own.items():
            back.setdefault(p, c)
        whole = dict(back)
        for c, p in PROTOTYPES.items():
            if c not in own and p in back:
                whole[c] = back[p]
        out.append(whole)
    return out


def _resolve(word: str) -> str:
    """A word of mixed scripts in the one script that explains it best: fewest letters without a look-alike, then most letters."""
    p = _patterns()
    by = [len(p[f"script{i}"].findall(word)) for i in range(len(SCRIPTS))]
    if sum(n > 0 for n in by) < 2:
        return word
    base = unicodedata.normalize("NFD", word)

    def left(i: int) -> int:
        return sum(1 for c in base if not p[f"script{i}"].match(c) and not unicodedata.combining(c) and c not in _to_script()[i])

    best = min((i for i in range(len(SCRIPTS)) if by[i]), key=lambda i: (left(i), -by[i], i))
    table = _to_script()[best]
    return unicodedata.normalize("NFC", "".join(c if p[f"script{best}"].match(c) else table.get(c, c) for c in base))


def canonical(text: str) -> str:
    """The usual form: composed letters, no compatibility letters or invisible characters, plain spaces, one script a word."""
    if text.isascii():
        return text
    p, t = _patterns(), _tables()
    if p["odd"].search(text):
        text = p["invisible"].sub("", text)
        text = unicodedata.normalize("NFC", p["space"].sub(" ", text).translate(t["compat"]))
    if p["other"].search(text) and p["mixed"].search(text):
        text = p["word"].sub(lambda m: _resolve(m[0]), text)
    return text


def skeleton(text: str, table: dict[int, str] | None = None) -> str:
    """Decompose, replace each character by its prototype, decompose again; invisible characters go, spaces are plain.

    ``table``: prototypes by code point, as :func:`confusables` gives them; those of the letters above if not given.
    """
    p = _patterns()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", p["space"].sub(" ", p["invisible"].sub("", text)))
    text = text.translate(_prototypes() if table is None else table)
    return text if text.isascii() else unicodedata.normalize("NFKD", text)


@cache
def _prototypes() -> dict[int, str]:
    return {ord(k): v for k, v in PROTOTYPES.items()}


#: Code points of the table of confusables: the planes in which letters and signs of living scripts are.
TABLE_END = 0x20000


def confusables(spark: SparkSession) -> dict[int, str]:
    """Prototypes by code point: Unicode's table as Spark's ICU library holds it, asked once for all characters, and the
    letters above with the same prototypes as what they look like. Of fixed size, whatever the data."""
    chars = [chr(c) for c in range(0x20, TABLE_END) if not 0xD800 <= c < 0xE000]
    asked = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(chars)).split("\n")
    if len(asked) != len(chars):
        raise ValueError("the table of confusables can't be read")
    # decompositions aren't told apart by it: they are made before and after
    table = {ord(c): x for c, x in zip(chars, asked) if c == unicodedata.normalize("NFKD", c) and x != c and c != " "}
    for c, x in PROTOTYPES.items():
        for own in {c, unicodedata.normalize("NFKD", c)}:
            if len(own) == 1:
                table[ord(own)] = "".join(table.get(ord(y), y) for y in x)
    return table


def reasons(text: str) -> list[str]:
    """Why a text deviates from its usual form, in a fixed order; empty if it doesn't."""
    if text.isascii():
        return []
    p, t = _patterns(), _tables()
    out = []
    if p["odd"].search(text):
        if p["compat"].search(text):
            out.append("compatibility")
        # letters that Unicode itself never composes are in their standard form apart
        usual = text.translate(t["excluded"])
        if unicodedata.normalize("NFC", usual) != usual:
            out.append("decomposed")
        if p["invisible"].search(text):
            out.append("invisible")
        if p["space"].search(text):
            out.append("space")
    if p["other"].search(text) and p["mixed"].search(p["invisible"].sub("", unicodedata.normalize("NFKC", text))):
        out.append("script")
    elif "compatibility" in out and p["mixed"].search(p["invisible"].sub("", text.translate(t["compat"]))):
        out.append("script")
    return out


def words_of(text: str) -> list[str]:
    """Words of the canonical form, case folded: what punctuation, symbols and spaces part."""
    return _patterns()["unit"].findall(canonical(text).casefold())


def letters_of(text: str) -> str:
    """Letters, marks and digits of the canonical form, case folded."""
    return "".join(words_of(text))


def deviations(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``skeleton``, ``canonical``, ``deviates`` and ``reasons`` of each text, found in one pass.

    ``deviates``: the text isn't its canonical form, which has the same skeleton. Null texts give nulls, no reasons and
    don't deviate; empty and plain texts are their own forms. Any length is taken whole. ``df``'s columns named so are
    replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(confusables(df.sparkSession))
    out = "struct<skeleton:string,canonical:string,deviates:boolean,reasons:array<string>>"

    @F.arrow_udf(out)
    def forms(a: pa.Array) -> pa.Array:
        table = shared.value
        x = a.to_pylist()
        skeletons = [None if t is None else skeleton(t, table) for t in x]
        usual = [None if t is None else canonical(t) for t in x]
        other = [t is not None and u != t and skeleton(u, table) == s for t, u, s in zip(x, usual, skeletons)]
        return pa.StructArray.from_arrays(
            [pa.array(skeletons, pa.string()), pa.array(usual, pa.string()), pa.array(other, pa.bool_()), pa.array([reasons(t) if o else [] for t, o in zip(x, other)], pa.list_(pa.string()))],
            names=["skeleton", "canonical", "deviates", "reasons"],
        )

    y = df.withColumn("__forms", forms(F.col(text)))
    for c in ("skeleton", "canonical", "deviates", "reasons"):
        y = y.withColumn(c, F.col(f"__forms.{c}"))
    return y.drop("__forms")


def same_looking(df: DataFrame, text: str = "text") -> DataFrame:
    """Skeletons under which several different texts appear: ``skeleton, n_forms, n_values, deviating``.

    Texts are counted by form before they meet at their skeleton, so a text that a third of all rows repeat is one row
    for each task.
    """
    x = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("form")).agg(F.count("*").alias("n"))
    x = deviations(x, "form").select("skeleton", "form", "n", F.col("deviates").alias("odd"))
    x = x.groupBy("skeleton").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_values"), F.sum(F.col("odd").cast("int")).alias("deviating"))
    return x.where("n_forms > 1")
