"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Only DataFrame functions are used. A pattern's matches and the gaps between them
(``regexp_extract_all`` and ``split``) give every match its place by adding up lengths; the
patterns are written so that no text, however long, makes them look back. All offsets count code
points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

CONTEXT_CHARS = 40
BLOCK_CHARS = 64  # the text is cut into such blocks, two of which hold any context
CONTEXT_BONUS = 0.3
LEAST_SCORE = 0.6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda value: F.length(_digits(value)).between(low, high)


def _small_parts(value: Column) -> Column:
    """Every number of a dotted address is at most 255, whatever its leading zeros."""
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(
        bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255")))
    )


def _luhn(value: Column) -> Column:
    return _digit_count(13, 19)(value) & F.call_function("luhn_check", _digits(value))


def _mod97(value: Column) -> Column:
    """The account number check: country and check digits to the end, letters as 10 to 35."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    code = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: (acc * F.when(c <= "9", 10).otherwise(100) + code(c)) % 97,
    )
    return F.length(bare).between(15, 34) & (rest == 1)


def _area_group_serial(value: Column) -> Column:
    """A social security number that can have been issued."""
    area = F.substr(value, F.lit(1), F.lit(3))
    return (
        ~area.isin("000", "666")
        & (area < "900")
        & (F.substr(value, F.lit(5), F.lit(2)) != "00")
        & (F.substr(value, F.lit(8), F.lit(4)) != "0000")
    )


PHONE_WORDS = "(?:tele|cell|smart)?phones?|tel|call(?:s|ed|ing)?|mobiles?|fax(?:es|ed)?"


class Kind(NamedTuple):
    """A kind of personal data. ``base`` kinds keep every confirmed match whatever its score."""

    name: str
    pattern: str
    needs: str
    confirm: Callable[[Column], Column] | None
    score: float
    context: str
    base: bool


# The base patterns match what the plain ones match: quantifiers that need not give back are
# possessive, and an address starts where its run of letters starts (or the last match ended).
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        None,
        0.9,
        "e-?mail(?:s|ed)?|mail(?:s|ed)?|contacts?|write",
        True,
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        ".",
        _small_parts,
        0.6,
        "ips?|address(?:es)?|hosts?|servers?",
        True,
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", "", _luhn, 0.8, "cards?|visa|credit|pay(?:s|ing|ments?)?", True),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+",
        _digit_count(9, 15),
        0.7,
        PHONE_WORDS,
        True,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
        "",
        _mod97,
        0.8,
        "ibans?|accounts?|bank(?:s|ing)?|konto|cuentas?|comptes?",
        False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "-",
        _area_group_serial,
        0.4,
        "ssns?|social security",
        False,
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+)-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        "",
        None,
        0.3,
        PHONE_WORDS,
        False,
    ),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each place, all earlier values merged (0 at first).

    Merged within blocks of about the square root of the length and over the blocks, so a text
    with very many matches costs n * sqrt(n) steps and not n squared.
    """
    fold = lambda part: F.aggregate(part, F.lit(0), merge)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def over(v: Column) -> Column:
        wide = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))

        def with_blocks(blocks: Column) -> Column:
            sums = F.transform(upto(F.size(blocks)), lambda j: fold(F.slice(blocks, F.lit(1), j)))
            return _let(
                sums,
                lambda done: F.transform(
                    upto(F.size(v)),
                    lambda i: merge(
                        F.get(done, F.floor(i / wide).cast("int")),
                        fold(F.slice(v, i - i % wide + 1, i % wide)),
                    ),
                ),
            )

        starts = upto(F.ceil(F.size(v) / wide).cast("int"))
        return _let(F.transform(starts, lambda j: fold(F.slice(v, j * wide + 1, wide))), with_blocks)

    return _let(values, over)


def _added(a: Column, b: Column) -> Column:
    return a + b


def _piece(blocks: Column, start: Column, n: Column | int) -> Column:
    """``n`` (at most BLOCK_CHARS) code points of the text from ``start``, whatever its length."""
    first = F.floor(start / BLOCK_CHARS).cast("int")
    two = F.concat(*[F.coalesce(F.get(blocks, first + i), F.lit("")) for i in (0, 1)])
    return F.substr(two, start % BLOCK_CHARS + 1, F.lit(n) if isinstance(n, int) else n)


def _matches(docs: DataFrame, kind: Kind, text: str, blocks: str) -> DataFrame:
    """Adds column ``kind.name``: the confirmed spans of one kind, in order.

    Context is what stands in the whole text just before and just after the match.
    """
    found, gaps, at, name = f"_{kind.name}_found", f"_{kind.name}_gaps", f"_{kind.name}_at", kind.name
    may = F.contains(F.col(text), F.lit(kind.needs)) if kind.needs else F.lit(True)
    docs = docs.withColumn(
        found, F.when(may, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))
    )
    any_found = F.size(found) > 0
    docs = docs.withColumn(gaps, F.when(any_found, F.split(text, kind.pattern, -1)))
    lengths = F.transform(
        F.arrays_zip(F.col(gaps).alias("g"), F.col(found).alias("v")),
        lambda x: F.length(x["g"]) + F.coalesce(F.length(x["v"]), F.lit(0)),
    )
    docs = docs.withColumn(at, F.when(any_found, _running(lengths, _added)))
    zipped = F.arrays_zip(
        F.col(found).alias("value"), F.col(gaps).alias("gap"), F.col(at).alias("at")
    )

    def span(match: Column) -> Column:
        value, gap = match["value"], match["gap"]
        begin = match["at"] + F.length(gap)
        reach = F.least(begin, F.lit(CONTEXT_CHARS))
        before = _piece(F.col(blocks), begin - reach, reach)
        after = _piece(F.col(blocks), begin + F.length(value), CONTEXT_CHARS)
        near = F.lower(F.concat(before, F.lit("\n"), after))
        bonus = F.when(F.rlike(near, F.lit(rf"\b(?:{kind.context})\b")), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            F.lit(name).alias("kind"),
            begin.alias("start"),
            (begin + F.length(value)).alias("end"),
            F.least(F.lit(kind.score) + bonus, F.lit(1.0)).alias("score"),
            (kind.confirm(value) if kind.confirm else F.lit(True)).alias("ok"),
        )

    matches = F.filter(zipped, lambda m: m["value"].isNotNull())
    spans = F.filter(F.transform(matches, span), lambda s: s["ok"])
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    spans = F.transform(spans, lambda s: s.dropFields("ok"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return docs.withColumn(name, F.coalesce(F.when(any_found, spans), none)).drop(
        found, gaps, at
    )


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Per document: the columns ``keep``, base (array of spans), spans (base and added spans).

    Spans are those of column text. A span is struct<kind, start, end, score>. Kinds come in the order of KINDS, spans of a kind
    by start. An added span that overlaps a base span, or an added one of an earlier kind, is
    left out. A null text counts as empty and stays null; ids are not looked at, so null and
    repeated ids keep their rows; other columns are left out.
    """
    out = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    block = rf"(?s).{{1,{BLOCK_CHARS}}}"
    out = out.withColumn("_blocks", F.regexp_extract_all("_text", F.lit(block), F.lit(0)))
    for kind in KINDS:
        out = _matches(out, kind, "_text", "_blocks")
    out = out.withColumn("base", F.concat(*[k.name for k in KINDS if k.base]))
    out = out.withColumn("spans", F.col("base"))
    for kind in KINDS:
        if not kind.base:
            free = F.filter(
                F.col(kind.name),
                lambda s: ~F.exists(
                    F.col("spans"), lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])
                ),
            )
            out = out.withColumn(
                "spans",
                F.when(F.size(kind.name) > 0, F.concat("spans", free)).otherwise(F.col("spans")),
            )
    return out.select(*keep, "base", "spans")


def shown(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets.

    Overlapping spans are replaced together: what lies before a span is kept from the furthest
    end of all spans before it. The text is cut as an array of code points, so the cost is that
    of its length, however many spans there are.
    """
    span = F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))

    def cut(chars: Column) -> Column:
        def join(ordered: Column) -> Column:
            ends = F.transform(ordered, lambda s: s["end"])
            covered = _running(ends, lambda a, b: F.greatest(a, b))
            pieces = F.transform(
                F.arrays_zip(ordered.alias("s"), covered.alias("c")),
                lambda x: F.when(
                    x["s"]["start"] >= x["c"],
                    F.concat(
                        F.array_join(F.slice(chars, x["c"] + 1, x["s"]["start"] - x["c"]), ""),
                        F.concat(F.lit("["), F.upper(x["s"]["kind"]), F.lit("]")),
                    ),
                ).otherwise(F.lit("")),
            )
            tail = F.slice(chars, F.array_max(ends) + 1, F.size(chars))
            return F.concat(F.array_join(pieces, ""), F.array_join(tail, ""))

        return _let(F.sort_array(span), join)

    return F.when(F.size(spans) > 0, _let(F.split(text, ""), cut)).otherwise(text)
