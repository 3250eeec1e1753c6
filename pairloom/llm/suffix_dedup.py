"""Exact substring deduplication by suffix arrays.

Every byte is removed that a string of LENGTH bytes covers which also starts in a document with
a smaller id. All strings are judged, but only those that can repeat are sorted:

1. A window of LENGTH bytes is named by the least hash among the grams inside it, so equal
   windows have equal names wherever they lie. Chunks of texts ask the buckets of names which
   of theirs occur in more than one document.
2. Neighbouring windows of one shared name form one string. A chunk sends its different strings,
   with the smallest id of each, to the bucket of the name; a passage that many documents share
   is sent once a chunk. A bucket cuts its strings into shards of bounded size, sorts each
   shard's suffixes by Larsson-Sadakane refinement (only groups that are still equal are sorted
   again, by the rank of the suffix that many bytes further), takes the common prefixes of
   neighbours in Kasai's text order, and merges the shards' sorted windows by binary search. It answers
   with the smallest id of each window.
3. The chunk marks the windows whose smallest id is below the document's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import kernels
from pairloom.llm.chunks import (
    bucket_count,
    bucket_ends,
    by_chunk,
    chunk_bytes,
    pack,
    pack_sorted,
    spare_bits,
    text_chunks,
    unpack,
    unpack_sorted,
    without_bits,
)
from pairloom.session import materialize

LENGTH = 50
GRAM = 32
GRAMS = LENGTH - GRAM + 1
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 3 << 20
SHARD_BYTES = 1 << 20
# A bucket is judged in so many ranges of names, one after the other.
RANGES = 8
# A null id is larger than any other: its text keeps nothing from others.
NO_ID = np.iinfo(np.int64).max


def window_names(data: np.ndarray) -> np.ndarray:
    """The least gram hash inside the window that starts at each byte."""
    h = kernels.byte_codes(False)[data]
    factor, width = np.uint64(0xD6E8FEB86659FD93), 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            grams = h[:-width] * factor
            grams += h[width:]
            h, factor, width = grams, factor * factor, width * 2
    least, width = kernels.mix(h), 1
    while width * 2 <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = GRAMS - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def named_runs(
    data: np.ndarray, at: np.ndarray, drop_bits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one name: name, first window, number of windows, text."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), none, none, none
    names = without_bits(window_names(data), drop_bits)
    marks = np.zeros(len(data) + 1, np.int32)
    np.add.at(marks, np.maximum(at[1:] - LENGTH + 1, at[:-1]), 1)
    np.add.at(marks, at[1:], -1)
    inside = np.cumsum(marks)[: len(names)] == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (names[1:] != names[:-1]) | edge[1 : len(names)]
    first = np.flatnonzero(begins)
    end_of_run = np.concatenate([begins[1:] | ~inside[1:], [True]]) & inside
    count = np.flatnonzero(end_of_run) - first + 1
    return names[first], first, count, np.searchsorted(at, first, "right") - 1


def _ids(row: dict) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in row["doc_ids"]], np.int64)


def _name_requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, names, several: a chunk's names, and whether two of its documents have it."""
    drop = spare_bits(buckets)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, at = chunk_bytes(row["data"], row["sizes"])
                names, _, _, text = named_runs(data, at, drop)
                ids = _ids(row)[text] if len(text) else np.zeros(0, np.int64)
                order = np.lexsort((ids, names))
                names, ids = names[order], ids[order]
                first = np.ones(len(names), bool)
                first[1:] = names[1:] != names[:-1]
                starts = np.flatnonzero(first)
                ends = np.append(starts[1:], len(names)) - 1
                distinct = names[starts]
                several = (ids[starts] != ids[ends]).astype(np.uint64)
                begin, cells = 0, [[], [], [], []]
                for bucket, end in enumerate(bucket_ends(distinct, buckets)):
                    if end > begin:
                        part = pack_sorted(distinct[begin:end]), pack(several[begin:end])
                        for cell, value in zip(cells, (bucket, row["chunk"], *part), strict=True):
                            cell.append(value)
                    begin = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64()),
                     pa.array(cells[2], pa.binary()), pa.array(cells[3], pa.binary())],
                    ["bucket", "chunk", "names", "several"],
                )

    return chunks.select("chunk", "doc_ids", "sizes", "data").mapInArrow(
        asked, "bucket int, chunk long, names binary, several binary"
    )


def _shared_names(asked: DataFrame) -> DataFrame:
    """bucket, chunk, shared: for each name of a chunk whether another document has it."""

    def counted(group: pa.Table) -> pa.Table:
        rows = group.select(["bucket", "chunk", "names", "several"]).to_pylist()
        names = [unpack_sorted(r["names"]) for r in rows]
        several = np.concatenate([unpack(r["several"]) for r in rows])
        _, which = np.unique(np.concatenate(names), return_inverse=True)
        shared = (np.bincount(which) > 1) | (np.bincount(which, weights=several) > 0)
        parts = np.split(shared[which], np.cumsum([len(n) for n in names])[:-1])
        return pa.table(
            {
                "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
                "shared": pa.array([pack(p.astype(np.uint64)) for p in parts], pa.binary()),
            }
        )

    return asked.groupBy("bucket").applyInArrow(counted, "bucket int, chunk long, shared binary")


def shared_strings(row: dict, drop: int):
    """What a chunk compares with others.

    The names, texts (bytes) and smallest ids of its different strings, by name; and per run of
    shared windows its first window, number of windows, text and string.
    """
    data, at = chunk_bytes(row["data"], row["sizes"])
    names, first, count, text = named_runs(data, at, drop)
    found = sorted(row["answers"] or [], key=lambda a: a["bucket"])
    shared = np.concatenate([unpack(a["shared"]) for a in found]) if found else np.zeros(0, np.uint64)
    distinct, which = np.unique(names, return_inverse=True)
    keep = np.flatnonzero(shared[which] > 0) if len(distinct) else np.zeros(0, np.int64)
    names, first, count, text = names[keep], first[keep], count[keep], text[keep]
    raw = data.tobytes()
    ends = (first + count + (LENGTH - 1)).tolist()
    every = [raw[begin:end] for begin, end in zip(first.tolist(), ends, strict=True)]
    different = {t: i for i, t in enumerate(dict.fromkeys(every))}
    string = np.fromiter(map(different.__getitem__, every), np.int64, len(every))
    least = np.full(len(different), NO_ID)
    np.minimum.at(least, string, _ids(row)[text])
    named = np.zeros(len(different), np.uint64)
    named[string] = names
    # Equal strings have equal names, and a chunk meets its strings in the same order each time.
    order = np.argsort(named, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    texts = list(different)
    texts = [texts[i] for i in order.tolist()]
    return data, at, named[order], texts, least[order], first, count, text, rank[string]


def _string_requests(chunks: DataFrame, buckets: int) -> DataFrame:
    drop = spare_bits(buckets)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, names, strings, least, *_ = shared_strings(row, drop)
                ends = bucket_ends(names, buckets * RANGES).reshape(buckets, RANGES)
                begin, cells = 0, [[], [], [], [], [], []]
                for bucket in range(buckets):
                    end = int(ends[bucket, -1])
                    if end > begin:
                        own = strings[begin:end]
                        sizes = np.array([len(s) for s in own], np.uint64)
                        ids = least[begin:end].view(np.uint64)
                        ranges = np.diff(ends[bucket], prepend=begin).astype(np.uint64)
                        values = (
                            bucket, row["chunk"], zstandard.compress(b"".join(own), 1),
                            pack(sizes), pack(ids), pack(ranges),
                        )
                        for cell, value in zip(cells, values, strict=True):
                            cell.append(value)
                    begin = end
                if cells[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64()),
                         *[pa.array(c, pa.binary()) for c in cells[2:]]],
                        ["bucket", "chunk", "strings", "sizes", "ids", "ranges"],
                    )

    return chunks.select("chunk", "doc_ids", "sizes", "data", "answers").mapInArrow(
        asked,
        "bucket int, chunk long, strings binary, sizes binary, ids binary, ranges binary",
    )


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number in byte order; zeros past the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n, np.uint64)
    for i in range(min(8, n)):  # places 8 bytes apart are one number after the other
        out[i::8] = np.frombuffer(padded, ">u8", (n - i + 7) // 8, i)
    return out


def suffix_order(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes, and the rank of each.

    Larsson-Sadakane refinement: groups of equal rank are sorted by the rank of the suffix as
    many bytes further as the ranks already cover; a suffix alone in its group is never moved
    again. Equal ranks mean equal first ``depth`` bytes. Ranks near the end of the data, where
    fewer bytes are left, treat the missing ones as zeros.
    """
    n = len(data)
    keys = eight_bytes(data)
    order = np.argsort(keys)  # equal keys get one rank, so their order is free
    fresh = np.ones(n, bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    starts = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    covered = 8
    while covered < depth:
        step = min(covered, depth - covered)
        size = np.diff(np.append(starts, n))
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(slots):
            break
        at = order[slots]
        ahead = at + step
        further = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = (rank[at].astype(np.uint64) << np.uint64(32)) | further.astype(np.uint64)
        moved = np.argsort(pair)
        order[slots], pair = at[moved], pair[moved]
        differs = np.ones(len(slots), bool)
        differs[1:] = pair[1:] != pair[:-1]
        fresh[slots] = differs
        starts = np.flatnonzero(fresh)
        ranks = np.repeat(starts, np.diff(np.append(starts, n)))
        rank[order[slots]] = ranks[slots]
        covered += step
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it in order, at most ``most``.

    Kasai's array, in text order: place i and its predecessor share at least one byte less than
    place i - 1 and its own. With a bound of a few words the lengths are found by comparing
    eight bytes at a time, for all places at once, instead of walking on from that length.
    Bytes past the end count as zeros.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    words = np.concatenate([eight_bytes(data), np.zeros(most, np.uint64)])
    length = np.zeros(n, np.int64)
    open_at = np.flatnonzero(before >= 0)
    for done in range(0, most, 8):
        differ = words[open_at + done] ^ words[before[open_at] + done]
        same = differ == 0
        equal = np.where(same, 8, 0)
        unlike, at = differ[~same], np.flatnonzero(~same)
        for width in (4, 2, 1):  # leading bytes that are zero, by halves
            clear = unlike >> np.uint64(64 - 8 * width) == 0
            equal[at] += clear * width
            unlike = np.where(clear, unlike << np.uint64(8 * width), unlike)
        length[open_at] = np.minimum(done + equal, most)
        open_at = open_at[same]
    return length[order]


def shard_groups(
    strings: list[bytes], ids: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's bytes, a place of each different window in order, its smallest id, and each window's number.

    Windows are taken string by string; those across a border of two strings are not windows.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    begins = np.cumsum(sizes) - sizes
    windows = sizes - LENGTH + 1
    first = np.cumsum(windows) - windows
    at = np.arange(int(windows.sum())) + np.repeat(begins - first, windows)
    owner = np.repeat(ids, windows)
    order, _ = suffix_order(data)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(common_prefixes(data, order) < LENGTH)
    group = group[at]
    present = np.zeros(len(data) + 1, bool)
    present[group] = True
    place = (np.cumsum(present) - 1)[group]
    distinct = int(np.count_nonzero(present))
    least = np.full(distinct, NO_ID)
    np.minimum.at(least, place, owner)
    shown = np.zeros(distinct, np.int64)
    shown[place] = at
    return data, shown, least, place


def shard_windows(strings: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different windows of a shard in order, the smallest id of each, and each window's place."""
    data, shown, least, place = shard_groups(strings, ids)
    texts = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[shown]
    return np.ascontiguousarray(texts).view(f"V{LENGTH}").ravel(), least, place


def _sortable(texts: np.ndarray) -> np.ndarray:
    """Windows as byte strings of one more byte, so that closing zeros count in comparisons."""
    wide = np.full((len(texts), LENGTH + 1), 1, np.uint8)
    wide[:, :LENGTH] = texts.view(np.uint8).reshape(-1, LENGTH)
    return wide.view(f"S{LENGTH + 1}").ravel()


def smallest_ids(strings: list[bytes], ids: list[int]) -> list[np.ndarray]:
    """For each string the smallest id of each of its windows, over all the strings."""
    shards: list[tuple[int, int]] = []
    begin, size = 0, 0
    for i, string in enumerate(strings):
        if size and size + len(string) > SHARD_BYTES:
            shards.append((begin, i))
            begin, size = i, 0
        size += len(string)
    shards.append((begin, len(strings)))
    if len(shards) == 1:  # nothing to merge, so no window is written out
        _, _, own, place = shard_groups(strings, np.array(ids, np.int64))
        return np.split(own[place], np.cumsum([len(s) - LENGTH + 1 for s in strings])[:-1])
    merged, least = np.zeros(0, f"S{LENGTH + 1}"), np.zeros(0, np.int64)
    parts = []
    for begin, end in shards:
        texts, own, place = shard_windows(strings[begin:end], np.array(ids[begin:end], np.int64))
        texts = _sortable(texts)
        at = np.searchsorted(merged, texts)
        known = np.zeros(len(texts), bool)
        if len(merged):
            known = merged[np.minimum(at, len(merged) - 1)] == texts
        np.minimum.at(least, at[known], own[known])
        merged = np.insert(merged, at[~known], texts[~known])
        least = np.insert(least, at[~known], own[~known])
        parts.append((begin, end, texts, place))
    out: list[np.ndarray] = []
    for begin, end, texts, place in parts:
        values = least[np.searchsorted(merged, texts)][place]
        windows = [len(s) - LENGTH + 1 for s in strings[begin:end]]
        out += np.split(values, np.cumsum(windows)[:-1])
    return out


def _string_answers(asked: DataFrame) -> DataFrame:
    """bucket, chunk, least: the smallest ids of all windows of the chunk's strings, in order."""

    def judged(group: pa.Table) -> pa.Table:
        askers = []
        for row in group.to_pylist():
            sizes, ids = unpack(row["sizes"]).astype(np.int64), unpack(row["ids"]).view(np.int64)
            ends = np.cumsum(unpack(row["ranges"]).astype(np.int64))
            row["strings"] = zstandard.decompress(row["strings"])
            askers.append((row, np.cumsum(sizes) - sizes, sizes, ids, ends, []))
        for part in range(RANGES):
            place: dict[bytes, int] = {}
            least: list[int] = []
            asked_for = []
            for row, begins, sizes, ids, ends, _ in askers:
                own = slice(ends[part - 1] if part else 0, ends[part])
                mine = []
                for begin, size, doc in zip(
                    begins[own].tolist(), sizes[own].tolist(), ids[own].tolist(), strict=True
                ):
                    i = place.setdefault(row["strings"][begin : begin + size], len(least))
                    if i == len(least):
                        least.append(doc)
                    elif doc < least[i]:
                        least[i] = doc
                    mine.append(i)
                asked_for.append(mine)
            if least:
                found = smallest_ids(list(place), least)
                for (*_, out), mine in zip(askers, asked_for, strict=True):
                    out += [found[i] for i in mine]
        return pa.table(
            {
                "bucket": pa.array([a[0]["bucket"] for a in askers], pa.int32()),
                "chunk": pa.array([a[0]["chunk"] for a in askers], pa.int64()),
                "least": pa.array(
                    [pack_sorted(np.concatenate(a[-1]).view(np.uint64)) for a in askers], pa.binary()
                ),
            }
        )

    return asked.groupBy("bucket").applyInArrow(judged, "bucket int, chunk long, least binary")


def removed_bytes(row: dict, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's bytes, the offsets of its texts, and which bytes go."""
    data, at, _, strings, _, first, count, text, string = shared_strings(row, drop)
    marks = np.zeros(len(data) + 1, np.int64)
    if len(first):
        found = sorted(row["judged"], key=lambda a: a["bucket"])
        least = np.concatenate([unpack_sorted(a["least"]) for a in found]).view(np.int64)
        windows = np.array([len(s) - LENGTH + 1 for s in strings])
        begins = np.cumsum(windows) - windows
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(first, count) + nth
        below = least[np.repeat(begins[string], count) + nth] < np.repeat(_ids(row)[text], count)
        np.add.at(marks, place[below], 1)
        np.add.at(marks, place[below] + LENGTH, -1)
    return data, at, np.cumsum(marks)[:-1] > 0


def _removals(chunks: DataFrame, drop: int, texts: bool) -> DataFrame:
    """Per document what goes; with ``texts`` also the bytes that stay."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, at, gone = removed_bytes(row, drop)
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                edges = at[:-1][np.diff(at) > 0]
                starts[edges] = gone[edges]
                n_gone = np.concatenate([[0], np.cumsum(gone)])
                n_spans = np.concatenate([[0], np.cumsum(starts)])
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(np.diff(at)),
                    pa.array(n_gone[at[1:]] - n_gone[at[:-1]]),
                    pa.array(n_spans[at[1:]] - n_spans[at[:-1]]),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    return chunks.select("doc_ids", "sizes", "data", "answers", "judged").mapInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + (", kept binary" if texts else ""),
    )


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are whole UTF-8 bytes, null counts as empty. ``n_spans`` counts maximal removed runs,
    ``kept_sha256`` is of the remaining bytes; with ``texts`` these follow as column kept (bytes,
    as a cut may fall inside a character). Strings do not cross texts and are judged on the
    input. Rows of one id take nothing from each other; a null id counts as larger than all.
    Texts shorter than LENGTH bytes stay whole. Other columns are left out; an empty table gives
    an empty result.
    """
    chunks = text_chunks(docs, CHUNK_BYTES, F.lit(False))
    buckets = bucket_count(chunks, BUCKET_BYTES)
    shared = materialize(_shared_names(_name_requests(chunks, buckets)), "names")
    named = chunks.join(by_chunk(shared, ["shared"]), "chunk", "left")
    judged = materialize(_string_answers(_string_requests(named, buckets)), "judged")
    answered = named.join(
        by_chunk(judged, ["least"]).withColumnRenamed("answers", "judged"), "chunk", "left"
    )
    return _removals(answered, spare_bits(buckets), texts)
