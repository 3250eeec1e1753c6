"""Token counts of whole texts by the whole-token shortcut.

Before the job, on the driver, every string of the vocabulary is put to the tokenizer's own
pre-tokenizer and merge model; those that form one pre-token and merge to one token are the
proven whole tokens. The table of them is bounded by the vocabulary file and goes to the tasks
as a broadcast. In a task a text is cut at added special strings, its parts into pre-tokens; a
proven pre-token counts one, and only the rest is merged by the model, with a bounded memory of
earlier results. Nothing is shuffled.

Texts with characters that the pattern's engines may class differently (those new in recent
versions of Unicode) are encoded by the library itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

# The pattern of byte-level pre-tokenizers with use_regex: a fixed value of that tokenizer kind.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Ranges in which every code point has the same class in both pattern engines (tests prove it).
SAME_CLASS = "".join(
    f"{chr(a)}-{chr(b)}"
    for a, b in ((0, 0x557), (0x2000, 0x208E), (0x20A0, 0xA7CD), (0xAC00, 0xD7A3))
)
REMEMBERED = 600_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    rest = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [letters[b] for b in range(256)]


def plain_specials(tokenizer: Tokenizer) -> list[str]:
    """Added strings that are cut out of a text before pre-tokenizing."""
    added = list(tokenizer.get_added_tokens_decoder().values())
    if any(t.single_word or t.lstrip or t.rstrip for t in added):
        raise ValueError("added tokens that take neighbouring text are not supported")
    if tokenizer.normalizer is not None:
        raise ValueError("only tokenizers without a normalizer are supported")
    return sorted((t.content for t in added if t.content), key=len, reverse=True)


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """Vocabulary strings proven to be one pre-token and to merge to exactly one token."""
    value = {c: b for b, c in enumerate(byte_letters())}
    find = regex.compile(PRE_TOKENS).findall
    proven = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if not all(c in value for c in token):
            continue
        try:
            text = bytes(value[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if find(text) == [text] and len(tokenizer.model.tokenize(token)) == 1:
            proven.append(text)
    return proven


class Counter:
    """Counts the tokens of texts in one task."""

    def __init__(self, path: str, proven: list[str]):
        self.tokenizer = Tokenizer.from_file(path)
        specials = plain_specials(self.tokenizer)
        self.cut = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.find = regex.compile(PRE_TOKENS).findall
        self.doubtful = regex.compile(f"[^{SAME_CLASS}]").search
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.cost = dict.fromkeys(proven, 1)
        self.proven = proven

    def merge(self, piece: str) -> int:
        shown = piece.encode().decode("latin-1").translate(self.letters)
        return len(self.tokenizer.model.tokenize(shown))

    def count_part(self, part: str) -> int:
        if self.doubtful(part):
            return len(self.tokenizer.encode(part, add_special_tokens=False).ids)
        pieces = self.find(part)
        rest = set(pieces).difference(self.cost)
        if len(self.cost) + len(rest) > len(self.proven) + REMEMBERED:
            self.cost = dict.fromkeys(self.proven, 1)
            rest = set(pieces).difference(self.cost)
        self.cost.update((p, self.merge(p)) for p in rest)
        return sum(map(self.cost.__getitem__, pieces))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None:
            return self.count_part(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self.count_part(p) for p in parts if p)


def count_tokens(
    docs: DataFrame, tokenizer_file: str, limit: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    ``tokenizer_file`` is a byte-level BPE file that every worker can read at that path.
    Special strings inside a text count as their one token, as the library's default has it.
    A null or empty text has 0 tokens; a null id stays; repeated rows give repeated rows; an
    empty table gives an empty one. Other columns, whatever their names, are left out. Texts are
    read whole; memory is that of one Arrow batch.
    """
    spark = docs.sparkSession
    tokenizer = Tokenizer.from_file(tokenizer_file)
    plain_specials(tokenizer)
    proven = spark.sparkContext.broadcast(whole_tokens(tokenizer))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_file, proven.value)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    kept = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    kind = kept.schema["doc_id"].dataType.simpleString()
    out = kept.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
