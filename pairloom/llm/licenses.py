"""License scan by an exact set-similarity join of text blocks with license templates.

A template is the set of its words. For templates of up to s words (s a power of two) a text is cut
into blocks of 2 s words that begin every s words, so every run of s words lies whole in one block.
A template is found where a block holds at least ``least`` of its words.

The words of all templates are put in one order, rarest in the whole corpus first, and a block
counts only by those words. Template and block then share one of their first (size - needed + 1)
words; the places of that word bound what they can still share, and a block with fewer words than
needed is out before any look-up. What is left is counted exactly. Templates are a list given as a
parameter, so their index may be sent to every task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import kernels

LEAST = 0.8
_SLACK = 1e-9

# Phrases that name a license, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices by which texts are put under a license.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)


def scan_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of digits, letters and bytes from 0x80 on, A-Z folded)."""
    shown = np.full(256, 32, np.uint8)
    shown[48:58] = np.arange(48, 58)
    shown[97:123] = np.arange(97, 123)
    shown[65:91] = np.arange(97, 123)
    shown[128:] = np.arange(128, 256)
    return kernels.word_hashes(shown[data], at, fold_case=False)


def text_words(text: str) -> np.ndarray:
    return scan_words(*kernels.text_bytes(pa.array([text])))[0]


def size_class(n_words: int) -> int:
    """The power of two that a template of so many words fits in."""
    return 1 << max(0, n_words - 1).bit_length()


def word_counts(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """How often each of the sorted hashes ``words`` occurs in all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(words), np.int64)
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                found = scan_words(*kernels.text_bytes(part.column("text")))[0]
                at = np.minimum(np.searchsorted(words, found), len(words) - 1)
                seen += np.bincount(at[words[at] == found], minlength=len(words))
        word = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(seen[word])], ["word", "n"])

    sums = docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(words), np.int64)
    for row in sums.collect():  # at most one row for each word of the templates
        out[row["word"]] = row["n"]
    return out


def build_index(templates: Sequence[tuple[str, str]], words: np.ndarray, order: np.ndarray, least: float) -> dict:
    """Per size class: word ranks of the templates, what each needs, and postings of the prefixes.

    ``order`` gives the rank of each of ``words``, rarest first. Templates without words are left out.
    """
    by_class: dict[int, list[tuple[str, np.ndarray]]] = defaultdict(list)
    for label, text in templates:
        own = text_words(text)
        if len(own):
            ranks = np.sort(order[np.searchsorted(words, np.unique(own))])
            by_class[size_class(len(own))].append((label, ranks))
    index = {}
    for size, members in by_class.items():
        sizes = np.array([len(r) for _, r in members])
        needed = np.array([max(1, math.ceil(len(r) * least - _SLACK)) for _, r in members])
        has = np.zeros((len(members), len(words)), bool)
        posted: list[tuple[int, int, int]] = []
        for t, (_, ranks) in enumerate(members):
            has[t, ranks] = True
            posted += [(int(r), t, i) for i, r in enumerate(ranks[: sizes[t] - needed[t] + 1])]
        posted.sort()
        index[size] = {
            "labels": [label for label, _ in members],
            "sizes": sizes,
            "needed": needed,
            "has": has,
            "rank": np.array([p[0] for p in posted]),
            "template": np.array([p[1] for p in posted]),
            "place": np.array([p[2] for p in posted]),
        }
    return index


def _blocks(word_at: np.ndarray, rank: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Different ranks of each block in order, the block of each, and the text of each block.

    ``word_at`` is the place in its text, ``rank`` the word's, ``text`` the text's number.
    """
    block = word_at // size
    owner = np.concatenate([text, text[block > 0]])
    block = np.concatenate([block, block[block > 0] - 1])
    rank = np.concatenate([rank, rank[word_at // size > 0]])
    order = np.lexsort((rank, block, owner))
    owner, block, rank = owner[order], block[order], rank[order]
    new = np.ones(len(rank), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
    first = new.copy()
    first[1:] |= rank[1:] != rank[:-1]
    number = np.cumsum(new) - 1
    return rank[first], number[first], owner[new]


def block_matches(
    index: dict, word_at: np.ndarray, rank: np.ndarray, text: np.ndarray, size: int
) -> Iterator[tuple[int, str, float]]:
    """(text, label, containment) of all blocks that hold enough of a template of this class."""
    own = index[size]
    ranks, block, owner = _blocks(word_at, rank, text, size)
    if not len(ranks):
        return
    held = np.bincount(block)
    begin = np.cumsum(held) - held
    place = np.arange(len(ranks)) - begin[block]
    fewest = int(own["needed"].min())
    probe = np.flatnonzero((held[block] >= fewest) & (place <= held[block] - fewest))
    low = np.searchsorted(own["rank"], ranks[probe], "left")
    n = np.searchsorted(own["rank"], ranks[probe], "right") - low
    asked = np.repeat(probe, n)
    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    template = own["template"][at]
    left = np.minimum(own["sizes"][template] - own["place"][at], held[block[asked]] - place[asked])
    near = left >= own["needed"][template]
    pair = np.unique(block[asked[near]] * len(own["sizes"]) + template[near])
    found, template = pair // len(own["sizes"]), pair % len(own["sizes"])
    if not len(pair):
        return
    sizes = held[found]
    which = np.repeat(np.arange(len(pair)), sizes)
    words = ranks[np.repeat(begin[found] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
    shared = np.bincount(which, weights=own["has"][template[which], words], minlength=len(pair)).astype(np.int64)
    for i in np.flatnonzero(shared >= own["needed"][template]):
        t = template[i]
        yield int(owner[found[i]]), own["labels"][t], float(shared[i] / own["sizes"][t])


def phrase_places(hashes: np.ndarray, text: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word numbers where the words of a phrase stand in a row within one text."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0 or not len(phrase):
        return np.zeros(0, np.int64)
    hit = text[:n] == text[len(phrase) - 1 :]
    for j, word in enumerate(phrase):
        hit &= hashes[j : j + n] == word
    return np.flatnonzero(hit)


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    least: float = LEAST,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): words, places of phrases, labels and a score.

    Returns doc_id, n_words, n_base (places of all phrases), first_word and last_word (least and
    greatest start, null without a place), base_labels, labels (those and the templates' found),
    score: 1 where a phrase stands, else the best containment found, 0 without any. Words are
    runs of digits, letters and characters from U+0080 on, A-Z folded; null texts are empty.
    Null and repeated ids keep their rows; other columns are left out.
    """
    every = [text_words(t) for _, t in templates]
    words = np.unique(np.concatenate([*every, np.zeros(0, np.uint64)]))
    index: dict = {}
    order = np.zeros(0, np.int64)
    if len(words):
        counts = word_counts(docs, words)
        order = np.empty(len(words), np.int64)
        order[np.lexsort((words, counts))] = np.arange(len(words))
        index = build_index(templates, words, order, least)
    sought = [(text_words(p), label) for p, label in phrases]
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    )

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                n = part.num_rows
                hashes, of_text = scan_words(*kernels.text_bytes(part.column("text")))
                text = np.repeat(np.arange(n), np.diff(of_text))
                word_at = np.arange(len(hashes)) - of_text[:-1][text]
                n_base = np.zeros(n, np.int64)
                first = np.full(n, len(hashes) + 1, np.int64)
                last = np.full(n, -1, np.int64)
                base, best = defaultdict(set), np.zeros(n)
                for phrase, label in sought:
                    place = phrase_places(hashes, text, phrase)
                    owner, start = text[place], word_at[place]
                    n_base += np.bincount(owner, minlength=n)
                    np.minimum.at(first, owner, start)
                    np.maximum.at(last, owner, start)
                    for i in np.unique(owner).tolist():
                        base[i].add(label)
                        best[i] = 1.0
                found = {i: set(labels) for i, labels in base.items()}
                if index:
                    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                    known = np.flatnonzero(words[at] == hashes)
                    rank = order[at[known]]
                    for size in index:
                        for i, label, share in block_matches(index, word_at[known], rank, text[known], size):
                            found.setdefault(i, set()).add(label)
                            best[i] = max(best[i], share)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(of_text)),
                        pa.array(n_base),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([",".join(sorted(base[i])) if i in base else "" for i in range(n)]),
                        pa.array([",".join(sorted(found[i])) if i in found else "" for i in range(n)]),
                        pa.array(best),
                    ],
                    schema=schema,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scanned,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )
