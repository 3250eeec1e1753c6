"""Text columns: white space, words, 13a tokens, tags, special tokens.

Everything is a built-in expression, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that Python's str.split() and str.strip() treat
# as white space, written as a class that Java and RE2 read alike.
SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same, one by one.
SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# The 13a tokeniser's literal replacements, in order.
LITERALS_13A = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)

# The 13a tokeniser's patterns, in order, with the groups to
# separate by blanks. The blank itself, in its first class, needs no blanks around it.
PATTERNS_13A = (
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)

# Special tokens dropped when decoding.
SPECIAL_TOKENS = ("<s>", "</s>", "<unk>", "<pad>", "<mask>")
PAD = "<pad>"
END = "</s>"

# Two-letter language to language-and-script code.
LANGUAGE_CODES = {
    "de": "deu_Latn",
    "en": "eng_Latn",
    "es": "spa_Latn",
    "fr": "fra_Latn",
    "nb": "nob_Latn",
}

# Codes that the tagged inputs may carry, whatever languages are mapped to them.
SUPPORTED_CODES = (
    "dan_Latn",
    "deu_Latn",
    "eng_Latn",
    "fin_Latn",
    "fra_Latn",
    "ita_Latn",
    "nld_Latn",
    "nno_Latn",
    "nob_Latn",
    "spa_Latn",
    "swe_Latn",
)

# Fixed value: training and prediction inputs end after this many tokens.
MAX_TOKENS = 128


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def words(c: Column) -> Column:
    """White-space words; null and blank text give an empty array."""
    return F.array_remove(F.split(text_or_empty(c), f"{SPACE}+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens_13a(c: Column) -> Column:
    out = text_or_empty(c)
    for found, put in LITERALS_13A:
        out = F.replace(out, F.lit(found), F.lit(put))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, put in PATTERNS_13A:
        out = F.regexp_replace(out, pattern, put)
    return words(out)


def without_space(c: Column) -> Column:
    """The text with all white space removed."""
    return F.regexp_replace(text_or_empty(c), SPACE, "")


def language_code(lang: Column) -> Column:
    """Code of a two-letter language, null when unknown."""
    entries = [F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), lang)


def is_truncated(tokens: Column, limit: int = MAX_TOKENS) -> Column:
    return F.size(tokens) > limit - 2


def encode(tokens: Column, code: Column, limit: int = MAX_TOKENS) -> Column:
    """Model input: language code, tokens, end mark, at most ``limit`` entries."""
    return F.concat(
        F.array(code), F.slice(tokens, 1, limit - 2), F.array(F.lit(END))
    )


def drop_special(tokens: Column) -> Column:
    specials = (*SPECIAL_TOKENS, *LANGUAGE_CODES.values())
    return F.filter(tokens, lambda t: ~t.isin(*specials))


def decode(tokens: Column) -> Column:
    """Text of an encoded sequence without special tokens."""
    return F.array_join(drop_special(tokens), " ")
