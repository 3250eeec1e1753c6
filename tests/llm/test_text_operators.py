"""Operators on texts against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pairloom.llm import decontaminate, kernels, language_model, minhash, suffix_dedup, token_counts
from pairloom.llm.decontaminate import contamination
from pairloom.llm.language_model import score_texts
from pairloom.llm.minhash import near_duplicates, one_of_each
from pairloom.llm.pii import find_pii, pii_digest, redacted
from pairloom.llm.suffix_dedup import remove_repeats
from pairloom.llm.token_counts import count_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def bag(text):
    w = words(text)
    runs = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    return collections.Counter(runs)


def jaccard(a, b):
    both = set(a) | set(b)
    high = sum(max(a[k], b[k]) for k in both)
    return sum(min(a[k], b[k]) for k in both) / high if high else 0.0


@pytest.fixture(scope="module")
def corpus():
    """Random texts with near copies, exact copies, shared passages and repeated lines."""
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    passage = " ".join(pick.choices(vocabulary, k=40))
    for i in range(60):
        text = pick.choices(vocabulary, k=pick.randint(1, 120))
        rows.append((i, " ".join(text)))
        if i % 4 == 0:
            for change in (0, 1, 3, 12):
                copy = list(text)
                for _ in range(change):
                    copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
                rows.append((100 + 10 * i + change, " ".join(copy)))
        if i % 7 == 0:
            rows.append((1000 + i, f"{' '.join(text[:9])} {passage} é {' '.join(text[9:20])}"))
        if i % 9 == 0:
            rows.append((2000 + i, "same line again\n" * pick.randint(2, 40) + " ".join(text[:15])))
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "one"), (3004, "One"), (None, rows[5][1])]
    rows += [rows[7], rows[7], (3005, "x" * 5000), (3006, "ab " * 4000)]
    pick.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


def test_characters_of_fast_path_have_one_class():
    pre = Tokenizer.from_file(VOCABULARY).pre_tokenizer
    find = token_counts.regex.compile(token_counts.PRE_TOKENS).findall
    ranges = ((0, 0x557), (0x2000, 0x208E), (0x20A0, 0xA7CD), (0xAC00, 0xD7A3))
    for low, high in ranges:
        for c in range(low, high + 1, 1 if high < 0x3000 else 7):
            text = f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)} "
            assert [x[1][1] - x[1][0] for x in pre.pre_tokenize_str(text)] == [len(p) for p in find(text)]


def test_token_counts_equal_the_library(spark, corpus):
    library = Tokenizer.from_file(VOCABULARY)
    pick = random.Random(3)
    pieces = ["<|endoftext|>", "<|endof", "  ", "\n\n", "don't", "'LL", "naïve", "🙂", "1234", "中文", " ", "א", "՘", "x"]
    odd = [(5000 + i, "".join(pick.choices(pieces, k=pick.randint(1, 30)))) for i in range(200)]
    rows = corpus + odd
    got = count_tokens(spark.createDataFrame(rows, SCHEMA), VOCABULARY, 50).collect()
    want = []
    for doc, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 50))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_whole_tokens_are_proven():
    library = Tokenizer.from_file(VOCABULARY)
    for text in random.Random(1).sample(token_counts.whole_tokens(library), 500):
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_signatures_estimate_weighted_similarity():
    pick = random.Random(2)
    base = [str(pick.random()) for _ in range(300)]
    for share in (0.5, 0.9):
        other = [w if pick.random() < share else str(pick.random()) for w in base]
        texts = [" ".join(base + base[:40] * 3), " ".join(other)]
        hashes, at = kernels.shingles(*kernels.word_hashes(*kernels.text_bytes(pa.array(texts))))
        signature, weight = minhash.signatures(hashes, at)
        true = jaccard(*map(bag, texts))
        assert abs((signature[0] == signature[1]).mean() - true) < 0.12
        assert weight[0] == pytest.approx(sum(bag(texts[0]).values()))


def test_darts_arrive_at_unit_rate():
    units = kernels.mix(np.arange(4000, dtype=np.uint64))
    for limit in (0.1, 5.0, 100.0):
        at, _, rank = minhash.throw_darts(units, np.full(len(units), limit))
        assert len(at) == pytest.approx(4000 * limit, rel=0.1)
        assert rank.max() < limit


def _classes(rows, least):
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= least:
                top[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for doc, text in rows:
        if doc is not None:
            ids[find(texts.index(text or ""))].append(doc)
    return {(d, t or ""): min(ids[find(texts.index(t or ""))], default=None) for d, t in rows}


@pytest.mark.parametrize("small", [8, 1])
def test_near_duplicates_equal_brute_force(docs, corpus, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "PIECE_ROWS", 2)
    want = _classes(corpus, 0.8)
    found = near_duplicates(docs).collect()
    assert len(found) == len(corpus)
    got = {(r.doc_id, bytes(r.node)): r.class_id for r in found}
    assert got == {(d, hashlib.md5(t.encode()).digest()): c for (d, t), c in want.items()}
    kept = one_of_each(docs, columns=("doc_id", "text")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_null_ids_only_keep_one(spark):
    text = " ".join(f"v{i}" for i in range(50))
    rows = [(None, text), (None, text + " more"), (None, text)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert one_of_each(frame, columns=("doc_id", "text")).count() == 1


def test_suffix_order_and_common_prefixes():
    pick = random.Random(4)
    for alphabet in (b"a", b"ab", bytes(range(256))):
        data = bytes(pick.choices(alphabet, k=700))
        array = np.frombuffer(data, np.uint8)
        order, rank = suffix_dedup.suffix_order(array)
        cut = [data[i : i + 50].ljust(50, b"\0") for i in range(len(data))]
        shown = [cut[i] for i in order]
        assert shown == sorted(cut)
        full = range(len(data) - 50)
        assert all((rank[i] == rank[i + 1]) == (cut[i] == cut[i + 1]) for i in full)
        prefixes = suffix_dedup.common_prefixes(array, order)
        for k in range(1, len(data)):
            a, b = cut[order[k - 1]], cut[order[k]]
            assert prefixes[k] == next((i for i in range(50) if a[i] != b[i]), 50)


def _removed(rows):
    owner = {}
    least = lambda d: math.inf if d is None else d
    for doc, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            owner[w] = min(owner.get(w, math.inf), least(doc))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if owner[b[p : p + 50]] < least(doc):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("chunk", "bucket", "shard"), [(2 << 20, 8 << 20, 1 << 20), (20_000, 30_000, 1000)])
def test_repeats_equal_brute_force(docs, corpus, monkeypatch, chunk, bucket, shard):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    got = sorted(map(tuple, remove_repeats(docs).collect()), key=str)
    assert got == sorted(_removed(corpus), key=str)


def test_windows_with_zero_bytes(spark):
    a, b = "\0" * 60 + "q" * 49, "q" * 49 + "\0" * 50
    rows = [(1, a), (2, b), (3, "q" * 49 + "\0" * 49 + "z")]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA), texts=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(_removed(rows))


def _contaminated(rows, items, least):
    out = []
    for doc, text in rows:
        w, hit = words(text), set()
        for item, body in items:
            n, own = len(words(body)), bag(body)
            if not n or not w:
                continue
            for p in range(max(1, len(w) - n + 1)):
                part = w[p : p + n]
                if jaccard(bag(" ".join(part)), own) >= least and (n >= 5 or len(part) == n):
                    hit.add(item)
        out.append((doc, bool(hit), len(hit), sorted(hit)))
    return out


@pytest.mark.parametrize("a_pass", [400, 2])
def test_contamination_equals_brute_force(spark, docs, corpus, monkeypatch, a_pass):
    monkeypatch.setattr(decontaminate, "ITEMS_A_PASS", a_pass)
    pick = random.Random(6)
    items = []
    for i, (_, text) in enumerate(corpus[:30:3]):
        w = words(text)
        if len(w) > 25:
            part = w[3:23]
            part[pick.randrange(20)] = "changed"
            items.append((i, " ".join(part)))
    items += [(90, None), (91, " "), (92, "one"), (93, "w1 w2 w3"), (94, "same line again " * 9), items[0]]
    got = contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    shown = sorted(((r.doc_id, r.contaminated, r.n_items, list(r["items"])) for r in got), key=str)
    assert shown == sorted(_contaminated(corpus, items, 0.8), key=str)


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _base_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) < 256 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and _luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    return [
        (k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0])
    ]


PII = [
    "mail a.b@c.de_x@y.zz or bob@x, q@w.e.r. 😀 é@é.é x@1.2.3.4",
    "1.2.3.4.5.6.7.8 256.1.1.1 010.0.0.0255 1.1.1.1.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111114111 5",
    "+1 (555) 010-9999, +49 30 123456) +12 +1((((((23456789 call (555) 123-4567",
    "iban DE89 3704 0044 0532 0130 00 and DE89370400440532013001, ssn 123-45-6789, 987-65-4321",
    None,
    "",
    "+4111111111111111 4111111111111111@a.b",
]


def test_base_spans_equal_plain_patterns(spark):
    pick = random.Random(8)
    parts = ["@", ".", "a", "4111111111111111", "+1 ", "(", "-", " ", "9", "255", "_", "é", "😀", "x.y", "12"]
    rows = list(enumerate(PII + ["".join(pick.choices(parts, k=40)) for _ in range(300)]))
    found = find_pii(spark.createDataFrame(rows, SCHEMA))
    texts = dict(rows)
    for r in pii_digest(found).collect():
        want = _base_spans(texts[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), texts[r.doc_id]
        assert r.spans == shown or r.spans.startswith(shown)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(k == n for k, _, _ in want) for n in ("email", "ip", "card", "phone")
        ]
    added = {r.doc_id: r.spans for r in pii_digest(found).collect()}
    assert "local_phone:" in added[3] and added[4].count("iban:") == 1 and added[4].count("ssn:") == 1
    for r in found.select("doc_id", "text", "spans", redacted(found.text, found.spans).alias("clean")).collect():
        covered = set()
        for s in r.spans:
            covered |= set(range(s.start, s.end))
        rest = "".join(c for i, c in enumerate(r.text or "") if i not in covered)
        assert re.sub(r"\[(EMAIL|IP|CARD|PHONE|IBAN|SSN|LOCAL_PHONE)\]", "", r.clean or "") == rest


def test_context_is_read_from_the_whole_text(spark):
    texts = [
        "call 555-123-4567 or 555-123-4568",
        "555-123-4567 (phone)",
        "our telephones: 555-123-4567",
        "ssn 123-45-6789, 123-45-6788, 123-45-6787",
        "😀" * 63 + " 555-123-4567 é phone",
        "phone " + "x" * 40 + " 555-123-4567 " + "y" * 40 + " phone",
        "555-123-4567",
    ]
    found = find_pii(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in found}
    number = "555-123-4567"
    assert got == {
        0: [number, "555-123-4568"], 1: [number], 2: [number],
        3: ["123-45-6789", "123-45-6788", "123-45-6787"], 4: [number], 5: [], 6: [],
    }


def test_pii_of_very_long_texts(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "1." * 100_000, "+1" + "(" * 200_000, "a@b.c " * 3000]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in pii_digest(find_pii(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [got[i].n_email for i in range(6)] == [0, 0, 0, 0, 0, 3000]
    assert got[3].n_ip == 25_000


def _model(rows):
    counts, pairs, triples, n_texts = *(collections.Counter() for _ in range(3)), 0
    for doc, text in rows:
        if doc is None or zlib.crc32(str(doc).encode()) % 7 != 2:
            t = [*words(text), "</s>"]
            counts.update(t)
            pairs.update(zip(["<s>", *t[:-1]], t, strict=True))
            triples.update(zip(["<s>", *t[:-2]], t[:-1], t[1:], strict=True) if len(t) > 1 else ())
            n_texts += 1
    return counts, pairs, triples, n_texts


def test_scores_equal_brute_force(docs, corpus, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 4000)
    counts, pairs, triples, n_texts = _model(corpus)
    total, distinct = sum(counts.values()), len(counts)
    once, twice = (sum(c == n for c in counts.values()) for n in (1, 2))
    discount = once / (once + 2 * twice) if once else 0.5
    sums = [sum(c**b for c in counts.values()) for b in language_model.BETAS]
    beta = float(np.interp(len(pairs), sums, language_model.BETAS))
    histories = {p: c for p, c in pairs.items() if p[1] != "</s>"}
    sums = [sum(c**b for c in histories.values()) for b in language_model.BETAS]
    second = float(np.interp(len(triples), sums, language_model.BETAS))

    def root(w):
        return (counts[w] - discount if counts[w] else discount * distinct) / total

    def step(u, w):
        history = n_texts if u == "<s>" else counts[u]
        expected = history**beta
        return (pairs[u, w] + expected * root(w)) / (history + expected) if history else root(w)

    def two_steps(t, u, w):
        history = pairs[t, u]
        expected = history**second
        if not history:
            return step(u, w)
        return (triples[t, u, w] + expected * step(u, w)) / (history + expected)

    def log_probability(t):
        whole = math.log10(step("<s>", t[0]))
        if len(t) > 1:
            for gram in zip(["<s>", *t[:-2]], t[:-1], t[1:], strict=True):
                whole += math.log10(two_steps(*gram))
        return whole

    known = [*counts, "never seen"]
    assert sum(map(root, known)) == pytest.approx(1)
    for u in ["<s>", *list(counts)[:5]]:
        if u != "</s>":
            assert sum(step(u, w) for w in known) == pytest.approx(1)
    for t, u in list(histories)[:5]:
        assert sum(two_steps(t, u, w) for w in known) == pytest.approx(1)
    want = []
    for doc, text in corpus:
        t = [*words(text), "</s>"]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)
        score = log_probability(t)
        held = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2
        row = (doc, held, len(t), sum(counts[w] > 0 for w in t), total)
        want.append((*row, pytest.approx(base), pytest.approx(score)))
    got = score_texts(docs).collect()
    key = lambda r: str(r[:5])
    for mine, theirs in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert mine == theirs


def test_words_that_occur_once_are_possible(spark):
    rows = score_texts(spark.createDataFrame([(0, "a b c"), (2, "c b a")], SCHEMA), folds=1, held=1)
    for rows in (rows.collect(), score_texts(spark.createDataFrame([(0, "a b c")], SCHEMA), 1, 1).collect()):
        assert all(math.isfinite(r.score) for r in rows)
    betas = language_model.BETAS
    once = language_model.Smoothing(np.array([3.0, 3.0, 3.0, 0.0, 1.0, 3.0, 3.0, *betas, *betas]))
    assert once.discount < 1
    zero, one = np.zeros(1), np.ones(1)
    assert np.isfinite(language_model.traverse(once, one, one, zero, zero, zero)).all()


def test_failure_arcs_one_after_the_other():
    """From a state of two words: its own arc, one failure, two failures, an unknown word."""
    betas = language_model.BETAS
    model = language_model.Smoothing(np.array([20.0, 5, 2, 1, 2, 6, 7, *betas, *betas]))
    word, history = np.array([4.0, 4, 4, 0]), np.full(4, 3.0)
    pair, context, triple = np.array([2.0, 2, 0, 0]), np.full(4, 2.0), np.array([1.0, 0, 0, 0])
    root = model.root(word)
    k1, k2 = 3 ** model.betas[0], 2 ** model.betas[1]
    fail1, fail2 = k1 / (3 + k1), k2 / (2 + k2)
    one = (2 + k1 * root[0]) / (3 + k1)
    want = [(1 + k2 * one) / (2 + k2), fail2 * one, fail2 * fail1 * root[2], fail2 * fail1 * root[3]]
    got = language_model.traverse(model, word, history, pair, context, triple)
    assert 10**got == pytest.approx(want)


def test_no_learning_text(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = score_texts(spark.createDataFrame([(i, "a b") for i in held], SCHEMA)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}


def test_one_shard_is_not_merged(monkeypatch):
    """A single shard writes no window out; its ids are those of merged shards and of brute force."""
    rng = random.Random(3)
    texts = list({"".join(rng.choices("ab", k=3)) * 20 + "x" * rng.randint(0, 9) for _ in range(60)})
    strings, ids = [t.encode() for t in texts], [rng.randint(0, 40) for _ in texts]
    least = {}
    for s, i in zip(strings, ids):
        for at in range(len(s) - 49):
            least[s[at : at + 50]] = min(i, least.get(s[at : at + 50], i))
    want = [[least[s[at : at + 50]] for at in range(len(s) - 49)] for s in strings]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 200)
    assert [x.tolist() for x in suffix_dedup.smallest_ids(strings, ids)] == want
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1 << 20)
    monkeypatch.setattr(suffix_dedup, "_sortable", None)
    assert [x.tolist() for x in suffix_dedup.smallest_ids(strings, ids)] == want
