"""Every operator against a plain version on rows with all the odd cases."""

import base64
import hashlib
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sectionflow.llm import decontaminate, langid, mixing, pii, quality, shingles, simhash, substrings, token_counts, topk, warc
from sectionflow.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def bag(rows):
    return Counter(map(tuple, rows))


# ---- 1: personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_matches(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE):
        if re.search(r"[a0-9]{60}", text) and kind in ("email", "ip"):
            continue  # the plain patterns take quadratic time there; none matches
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, kind, m.end()))
    return sorted(found)


def test_pii_base_spans(docs, corpus_rows):
    expected = []
    for doc_id, text, *_ in corpus_rows:
        spans = base_matches(text or "")
        n = Counter(s[2] for s in spans)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        expected.append((doc_id, *(n[k] for k, _ in BASE), sha(joined), joined))
    assert bag(pii.report(docs).collect()) == bag(expected)


def test_pii_disclosing_terms(spark):
    rng = np.random.default_rng(0)
    fill = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    secret = [(i, f"{fill(9)} Zanzibarov writes {fill(1)} from z@example.org {fill(9)}") for i in range(4)]
    copies = [(10 + i, f"{fill(9)} some copied passage of spam@example.org to read {fill(9)}") for i in range(4)]
    copies += [(20 + i, copies[0][1]) for i in range(4)]
    rest = [(100 + i, f"{fill(30)} writes") for i in range(400)]
    table = spark.createDataFrame(secret + copies + rest, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(table).collect()}
    for i, text in secret:
        at = text.index("Zanzibarov")
        assert f"term:{at}:{at + 10}" in got[i].split(",")
    assert not any("term" in got[i] for i, _ in rest)
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert "<TERM> writes" in clean[0] and "<EMAIL>" in clean[0] and "@" not in clean[0]
    assert all(clean[i] == t for i, t in rest)


def test_pii_disclosing_terms_in_fixed_lines(spark):
    """A fixed line discloses, whatever the length of its words, the number of texts and the share with the entity."""
    rng = np.random.default_rng(1)
    fill = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    line = "you may always write to Ann 李 at ann@example.org on any of these days"
    signed = [(i, f"{fill(9)} {line} {fill(9)}") for i in range(12)]
    copies = [(20 + i, f"{fill(5)} once Zed zed@example.org {fill(5)}") for i in range(2)]
    copies += [(30 + i, copies[0][1]) for i in range(5)]
    rest = [(100 + i, f"{fill(30)} you may write to any of these on days at always") for i in range(20)]
    table = spark.createDataFrame(signed + copies + rest, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    for i, text in signed:
        assert clean[i] == text.replace("Ann 李", "<TERM> <TERM>").replace("ann@example.org", "<EMAIL>")
    assert all(clean[i] == t.replace("zed@example.org", "<EMAIL>") for i, t in copies)  # two distinct texts
    assert all(clean[i] == t for i, t in rest)
    everywhere = pii.sanitise(spark.createDataFrame(signed, "doc_id long, text string"))
    assert not any("<TERM>" in r.text for r in everywhere.collect())  # the entity is no information there


def test_pii_sanitise_keeps_columns_and_other_texts(docs, corpus_rows):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(corpus_rows)
    plain = bag((r[0], r[1]) for r in corpus_rows if not base_matches(r[1] or ""))
    assert not plain - bag(out.select("doc_id", "text").collect())
    card = out.where("text like 'card %'").first()
    assert card.text == "card <CARD> and 4111-1111-1111-1112, phone <PHONE> +12 <PHONE> é +1" and card.n_chars == len(card.text)


# ---- 2: token counts


def test_token_counts(docs, corpus_rows):
    library = Tokenizer.from_file(VOCABULARY)
    expected = []
    for doc_id, text, *_ in corpus_rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 1024))
    assert bag(token_counts.count_tokens(docs, VOCABULARY, 1024).collect()) == bag(expected)


def test_merges_on_any_characters():
    import random

    library, rng = Tokenizer.from_file(VOCABULARY), random.Random(1)
    count = token_counts.Counter(token_counts.read_merges(VOCABULARY))
    letters = [chr(i) for i in [*range(400), 0x660, 0x2028, 0x3000, 0x4E2D, 0x1F600]] + [" ", "\n", "'s", "'LL", "<|endoftext|>"] * 20
    for i in range(3000):
        text = "".join(rng.choice(letters) for _ in range(12))
        text = text if i % 2 else "".join(c for c in text if ord(c) < 0x180)
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


# ---- 3: SimHash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius):
    label = list(range(len(fps)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            a, b = top(i), top(int(j))
            label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_near_duplicates(docs, corpus_rows):
    fps = [fingerprint(r[1]) for r in corpus_rows]
    label = groups(fps, 4)
    smallest = {g: min((r[0] for r, x in zip(corpus_rows, label) if x == g and r[0] is not None), default=None) for g in label}
    expected = [(r[0], f"{fp:016x}", smallest[g]) for r, fp, g in zip(corpus_rows, fps, label)]
    assert bag(simhash.near_duplicates(docs).collect()) == bag(expected)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    found = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(found) == Counter(smallest.values())


@pytest.mark.parametrize("spread", [3, 8, 64])
def test_links_of_crowded_shards(spark, spread):
    """Many fingerprints around few centres, as large groups of near copies have."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(spread, min(spread, rng.integers(1, 7)), replace=False)) for _ in range(1500)]
    fps = sorted({int(rng.choice(centres)) ^ f for f in flips})
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 4)
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    label = groups(fps, 4)
    parts = lambda names: Counter(frozenset(i for i, n in enumerate(names) if n == x) for x in set(names))
    assert parts([roots.get(s[0], s[0]) for s in signed]) == parts(label)


def jaccard_groups(texts):
    """Labels of the groups linked by five-word similarity of 0.8 or more, from all pairs."""
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if (5 * common >= 4 * (len(a) + len(b) - common)) and label[i] != label[j]:
                high, low = max(label[i], label[j]), min(label[i], label[j])
                label = [low if x == high else x for x in label]
    return label


def test_one_of_each_group_by_similarity(spark, docs, no_docs, corpus_rows):
    assert shingles.one_of_each_group(no_docs).count() == 0
    assert not list(shingles.text_shingles([]))
    label = jaccard_groups([r[1] for r in corpus_rows])
    smallest = {g: min((r[0] for r, x in zip(corpus_rows, label) if x == g and r[0] is not None), default=None) for g in label}
    kept = shingles.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(smallest.values())

    rng = np.random.default_rng(8)
    fill = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]
    line, texts = fill(14), []
    for length in (6, 9, 25, 60, 300, 900):  # edits that leave similarities on both sides of 0.8
        for _ in range(4):
            base = fill(length)
            texts.append(" ".join(base))
            for edits in range(1, 9):
                copy = list(base)
                for at in rng.integers(0, length, max(1, edits * length // 160)):
                    copy[at] = fill(1)[0]
                texts.append(" ".join(copy))
    texts += [" ".join(fill(20) + line + fill(20)) for _ in range(40)]  # unlike texts with a common line
    texts += [" ".join(fill(int(n)) + line) for n in rng.integers(0, 8, 40)]  # the line is most of the text
    bits = [fingerprint(t) for t in texts]
    label = jaccard_groups(texts)
    assert groups(bits, 4) != label  # four bits are another rule
    rows = [(i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in shingles.one_of_each_group(table).collect())
    assert got == sorted(min(i for i, x in enumerate(label) if x == g) for g in set(label))


def test_families_in_blocks(spark, monkeypatch):
    """Keys and families of many blocks give the groups that one block gives, and the exact ones."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = []
    for i in range(150):  # one large family, of which some are linked and some are not
        copy = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 12))):
            copy[at] = f"x{rng.integers(0, 5000)}"
        texts.append(" ".join(copy))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    label = jaccard_groups(texts)
    got = sorted(r.doc_id for r in shingles.one_of_each_group(table).collect())
    assert got == sorted(min(i for i, x in enumerate(label) if x == g) for g in set(label))
    assert 1 < len(got) < 150
    sets = shingles.described(table).dropDuplicates(["set"])
    assert shingles.key_links(sets).count() <= sets.count() * shingles.LOWEST


def test_candidates_come_from_simhash_and_vantage_points():
    rng = np.random.default_rng(31)
    runs = np.unique(rng.integers(0, 2**63, 700).astype(np.uint64))
    rng.shuffle(runs)
    one, two, alone = (shingles.fingerprint(r).view(np.uint8) for r in (runs[:560], runs, runs[600:]))
    assert 10 < np.unpackbits(one ^ two).sum() < shingles.MOST_BITS < np.unpackbits(one ^ alone).sum()
    assert (shingles.fingerprint(runs) == shingles.fingerprint(runs[::-1])).all()
    assert not shingles.fingerprint(runs[:0]).any()

    rows = []  # families of several sizes, with members at all distances, and rows alone
    for members, size in ((300, 100), (40, 60), (7, 90), (1, 100), (1, 40)):
        base = rng.integers(0, 2, shingles.BITS)
        for i in range(members):
            bits = base.copy()
            bits[rng.integers(0, shingles.BITS, int(rng.integers(0, 100)))] ^= 1
            rows.append([size + i % 40, *np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")])
    rows = np.array(rows, np.int64)[rng.permutation(len(rows))]
    label = list(range(len(rows)))
    for i, r in enumerate(rows):
        for j in np.flatnonzero(shingles.alike(r, rows)):
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    assert shingles.vantage_families(rows).tolist() == label


# ---- 4: substrings


def test_substring_dedup_of_repeated_ids(spark):
    rng = np.random.default_rng(13)
    one, two = (" ".join(f"w{i}" for i in rng.integers(0, 9000, 30)) for _ in range(2))
    rows = [(1, f"a b c {one}"), (2, f"{two} x"), (5, f"long start {one} middle words of it {two} end"), (5, "short text here")]
    rows += [(5, f"other {two}"), (5, f"other {two}"), (6, f"{one}"), (None, one), (None, one)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = bag((r.doc_id, r.n_words, r.n_removed) for r in substrings.without_repeats(table).collect())
    assert got == bag([(1, 33, 0), (2, 31, 0), (5, 67, 60), (5, 3, 0), (5, 31, 30), (5, 31, 30), (6, 30, 30), (None, 30, 0), (None, 30, 0)])


def test_substring_dedup(docs, corpus_rows):
    every = [(r[0], (r[1] or "").encode().split()) for r in corpus_rows]
    first = {}
    for doc_id, w in every:
        for k in range(len(w) - 12):
            if doc_id is not None:
                first[tuple(w[k : k + 13])] = min(doc_id, first.get(tuple(w[k : k + 13]), doc_id))
    expected = []
    for doc_id, w in every:
        gone = set()
        for k in range(len(w) - 12):
            if doc_id is not None and first[tuple(w[k : k + 13])] < doc_id:
                gone.update(range(k, k + 13))
        expected.append((doc_id, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = substrings.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert bag(got) == bag(expected)
    assert sum(r.n_removed for r in got) > 60


def test_substrings_around_a_common_phrase(spark, monkeypatch):
    """No group grows with the contexts of one phrase, and results stay those of all windows."""
    rng = np.random.default_rng(11)
    fill = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    phrase, shared = fill(4), fill(12)
    words = [fill(12) + phrase + fill(12) + (phrase + fill(12) if i % 3 else []) for i in range(60)]
    words += [fill(2) + shared[:6] + phrase + shared[6:] + fill(i % 4) for i in range(30)]
    words += [words[5], words[70], words[5][3:]]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    expected = []
    for i, w in enumerate(words):
        gone = {x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        expected.append((i, len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substrings, "ANCHOR_SEGMENTS", 20)
    got = substrings.without_repeats(table).select("doc_id", "n_removed", "kept_sha256").collect()
    assert bag(got) == bag(expected)
    anchors = substrings.shared_anchors(table)
    segments = substrings.segment_rows(table, anchors, substrings.busy_anchors(anchors, 20))
    groups = segments.where("words is not null").groupBy("anchor").agg(F.countDistinct("words").alias("n"))
    assert groups.agg(F.max("n")).first()[0] <= 20


def test_fm_index_counts_every_run():
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(1, 4, 500), 0]
    starts = np.arange(480)
    for length in (1, 2, 5, 13):
        low, high = substrings.FMIndex(text).backward(text, starts, length)
        runs = [tuple(text[i : i + length]) for i in range(len(text) - length + 1)]
        assert (high - low).tolist() == [runs.count(tuple(text[i : i + length])) for i in starts]


# ---- 5: quality


def test_quality_learns_and_ignores_the_held_out_fold(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        pool = ["fine", "prose", "reads", "well", "here"] if good else ["spam", "buy", "now", "$$$", "cheap"]
        rows.append((i, " ".join(rng.choice(pool, 30))))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels + [(5000, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, table)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(got[i].predicted == q for i, q, _ in labels)
    assert got[1000].score == got[1001].score and 0 <= got[1000].score <= 1
    flipped = table.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, flipped).vectors, model.vectors)


def test_quality_reads_long_words_whole(spark):
    rng = np.random.default_rng(5)
    letters = lambda pool, n: "".join(rng.choice(list(pool), n))
    ends = "abcdefgh", "stuvwxyz"
    rows = [(i, ends[0] + letters("好文章" if i % 2 else "买便宜", 60) + ends[1]) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i, _ in rows)

    model = quality.Model()
    for n in (41, 4093, 4094, 4095, 4096, 4097, 8190, 8191, 8192, 8193, 20_001):  # pieces against the whole
        word = letters("abc é好", n).replace(" ", "x")
        points = np.array([ord(c) for c in f"<{word}>"], np.uint64)
        powers = np.cumprod(np.full(len(points), 0xC2B2AE3D27D4EB4F, np.uint64), dtype=np.uint64)
        hashes = [(points * powers).sum(keepdims=True, dtype=np.uint64)]
        for size in quality.GRAMS:
            h = np.full(len(points) - size + 1, size, np.uint64)
            for k in range(size):
                h = h * quality._BASE + points[k : len(h) + k]
            hashes.append(h)
        plain = np.bincount((np.concatenate(hashes) * quality._SPREAD >> np.uint64(48)).astype(int), minlength=quality.BUCKETS)
        ids, counts = quality.long_word_features(word)
        assert np.array_equal(np.bincount(ids, counts, quality.BUCKETS), plain)
        found, weight = quality.document_features(f"{word} one")
        vector = (plain @ model.vectors / plain.sum() + model.word_vectors(["one"])[0]) / 2
        assert weight @ model.vectors[found] == pytest.approx(vector, abs=1e-5)
        assert model.long_words(Counter([word])) == pytest.approx(plain @ model.vectors / plain.sum(), abs=1e-5)


# ---- 6: top-k


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(7)] + [vectors[50]]
    odd = [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, vectors[1][1]), (450, [1.0, 2.0])]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, 5).collect()
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors}
    expected = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert bag(got) == bag(expected)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("scale", [1, 1000, 10**6])
def test_bounds_never_lose_a_member(scale):
    rng = np.random.default_rng(scale)
    ids, vectors = np.arange(500), rng.integers(-scale, scale + 1, (500, 6))
    queries = rng.integers(-scale, scale + 1, (20, 6))
    q, member, score = topk.ImpactIndex(ids, vectors).search(queries, np.arange(20), 5)
    for i in range(20):
        best = sorted((-int(s), j) for j, s in enumerate(vectors @ queries[i]) if j != i)[:5]
        assert list(zip((-score[q == i]).tolist(), member[q == i].tolist())) == best


# ---- 7: language


def test_language(spark, docs, corpus_rows):
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert langid.predict(docs, model).count() == len(corpus_rows)
    for doc_id, text, *_ in corpus_rows:
        und = not re.search(r"[^\W\d_]", text or "")
        assert (got[doc_id].lang_pred == "und") == und or doc_id in (None, 2)
        assert 0 <= got[doc_id].score <= 1
    kept = langid.in_one_language(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.where("text is null or text = '###'").count() == 0


def test_language_spans_and_scripts(spark):
    pools = {"aa": "alpha banana cabana data".split(), "zz": "uzzo wuzz zippo muzzy".split(), "ru": "привет мир дом".split()}
    rows = [(i, " ".join(np.random.default_rng(i).choice(pools[k], 40)), k) for i, k in enumerate(list(pools) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert all(r.lang_pred == r.lang for r in langid.predict(docs, model).join(docs, "doc_id").collect())
    mixed = " ".join(["alpha data"] * 20 + ["wuzz zippo"] * 20 + ["мир дом"] * 20)
    spans = langid.label_spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model)
    assert [tuple(r)[1:] for r in spans.orderBy("first_word").collect()] == [(0, 40, "aa"), (40, 80, "zz"), (80, 120, "ru")]


def test_viterbi_equals_plain_search():
    import itertools

    rng = np.random.default_rng(1)
    lengths = np.array([5, 0, 1, 6])
    scores = rng.normal(size=(12, 3)).astype(np.float32)
    path = langid.best_paths(scores, lengths, 0.7)
    for begin, n in zip(np.cumsum(lengths) - lengths, lengths):
        value = lambda p: sum(scores[begin + t, x] for t, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        assert value(path[begin : begin + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))), abs=1e-4)


# ---- 8: mixing


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), s, 1) for s, n in (("big", 3000), ("mid", 600), (None, 150)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())

    def shares(a):
        raw = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    entropy = lambda w: -sum(x * np.log(x) for x in w.values()) / np.log(3)
    sources = mixing.source_tokens(mixing.narrow(docs, 1))
    exponent = mixing.fit_exponent(sources, 0.9, 100.0, total)
    assert entropy(shares(exponent)) == pytest.approx(0.9, abs=1e-6)
    limited = mixing.fit_exponent(sources, 0.99, 2.0, total)
    assert max(w * total / tokens[s] for s, w in shares(limited).items()) == pytest.approx(2.0, abs=1e-5)
    mixed = mixing.mix(docs, entropy=0.9, passes=100.0, block_tokens=1000)
    assert mixed.columns == ["doc_id", "text", "source", "pass_no", "block", "slot", "weight"]
    got = mixed.select("source", F.size(F.split(F.trim("text"), " ")).alias("n"), "weight", "pass_no", "doc_id", "block").collect()
    drawn = Counter()
    for r in got:
        drawn[r.source] += r.n
        assert r.weight == pytest.approx(shares(exponent)[r.source], abs=1e-6)
    for s, w in shares(exponent).items():
        assert 0 <= w * total - drawn[s] <= 7
    assert max(Counter((r.source, r.doc_id, r.pass_no) for r in got).values()) == 1
    blocks = Counter()
    for r in got:
        blocks[r.block] += r.n
    assert len(blocks) == round(total / 1000) and max(blocks.values()) < 1300


@pytest.mark.parametrize("entropy, passes", [(0.9999, 4.0), (0.95, 1.5), (0.5, 2.0)])
def test_mixing_is_the_plain_one(spark, entropy, passes):
    """Weights from a plain bisection, draws from a plain permutation of each source."""
    rng = np.random.default_rng(14)
    rows = [(i, "w " * int(rng.integers(0, 30)), ["a", "a", "a", "b", "b", None][int(rng.integers(6))] if i % 9 else "c") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    own = [(r.source, r.doc_id, r.h, r.n) for r in docs.select("source", "doc_id", mixing.order_hash(1).alias("h"), mixing.n_tokens().alias("n")).collect()]
    tokens = Counter()
    for s, _, _, n in own:
        tokens[s] += n
    total = sum(tokens.values())

    def weights(a):
        raw = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def bisect(holds_below):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds_below(mid) else (low, mid)
        return low

    flat = bisect(lambda a: -sum(w * np.log(w) for w in weights(a).values()) >= entropy * np.log(len(tokens)))
    few = bisect(lambda a: max(w * total / tokens[s] for s, w in weights(a).items()) > passes)
    exponent = max(flat, few)
    assert mixing.fit_exponent(mixing.source_tokens(mixing.narrow(docs, 1)), entropy, passes, total) == pytest.approx(exponent, abs=1e-6)
    want = Counter()
    for s, w in weights(exponent).items():
        share = round(min(w * total / tokens[s], passes), 9)
        left = (share - int(share)) * tokens[s]
        for h, docs_of in sorted((h, [(i, n) for t, i, g, n in own if (t, g) == (s, h)]) for h in {g for t, _, g, _ in own if t == s}):
            left -= sum(n for _, n in docs_of)
            for i, _ in docs_of:
                want[s, i] = int(share) + (left >= -1e-3)
    got = Counter((r.source, r.doc_id) for r in mixing.mix(docs, entropy=entropy, passes=passes, block_tokens=500).select("source", "doc_id").collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    assert exponent < 1 or entropy == 0.5


# ---- 9: WARC


def test_warc_round_trip(spark):
    pages = [(i, f"http://x/{i}", f"<p>{i % 40}</p>" * (i % 9)) for i in range(300)]
    pages += [(400, None, None), (401, "http://a b\r\nX: y", "é\r\n\r\nWARC/1.1"), (402, "u", "x" * 300_000), (403, "u", ""), pages[7], (None, "n", "only"), (None, "m", "<p>1</p>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("shard", F.lit(3)).repartition(4)
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    expected, used = [], set()
    for i, _, h in sorted(pages, key=lambda p: (p[0] is not None, p[0])):
        payload = (h or "").encode()
        named = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        top = best[h or ""]
        response = (i == top or (i is None and top == -1)) and (h or "") not in used
        used |= {h or ""} if response else set()
        expected.append((i, len(payload), named, "response" if response else "revisit", None if response else top))
    folders = [scratch_path(spark, "warc") for _ in range(2)]
    for folder, shuffled in zip(folders, (table, table.repartition(3))):
        files = warc.write(shuffled, folder, shard_bytes=60_000, file_bytes=4_000)
        got = warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert bag(got) == bag(expected)
        assert files.count() > 5
    assert bag(warc.manifest(spark, folders[0]).collect()) == bag(warc.manifest(spark, folders[1]).collect())
    small = scratch_path(spark, "warc")
    warc.write(table, small, least_bytes=1000)
    assert warc.read(spark, small).where("record_type = 'revisit'").count() == 0
    empty = scratch_path(spark, "warc")
    warc.write(table.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


# ---- 10: decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_contamination(docs, corpus_rows, benchmark):
    windows = {}
    for item in benchmark.collect():
        w = WORDS.findall((item.text or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item.item_id)
    expected = []
    for doc_id, text, *_ in corpus_rows:
        w = WORDS.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    items |= ids - {None}
        expected.append((doc_id, len(w), len(hit), ",".join(sorted(map(str, items))), len(hit) > 0))
    found = decontaminate.contamination(docs, benchmark)
    got = found.select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated").collect()
    assert bag(got) == bag(expected) and sum(e[4] for e in expected) == 2
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(corpus_rows) - 2
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    rows = [(1, "x one two y three z"), (2, "three two one"), (3, "one two x x x x three"), (4, "one two")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    _, exact = decontaminate.find_windows(table, items, size=3)
    _, near = decontaminate.find_windows(table, items, size=3, slop=1)
    assert exact.count() == 0
    assert sorted(r.doc_id for r in near.select("doc_id").distinct().collect()) == [1, 2]


# ---- all


def test_empty_tables(no_docs, spark, benchmark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [
        pii.report(no_docs),
        pii.sanitise(no_docs),
        token_counts.count_tokens(no_docs, VOCABULARY, 1),
        simhash.near_duplicates(no_docs),
        simhash.one_of_each_group(no_docs),
        substrings.without_repeats(no_docs),
        quality.score(no_docs, quality.fit(no_docs, labels)),
        langid.predict(no_docs, langid.fit(no_docs, F.lit(True))),
        mixing.mix(no_docs),
        decontaminate.contamination(no_docs, benchmark),
        decontaminate.clean_documents(no_docs, benchmark),
    ]
    assert [r.count() for r in results] == [0] * len(results)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="given tables not present")
def test_bounds_leave_few_vectors_to_score(spark):
    rows = topk.integer_components(F.col("embedding")).alias("v")
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", rows).toPandas()
    vectors, ids = np.stack(table["v"].to_numpy()).astype(np.int64), table["vec_id"].to_numpy()
    index = topk.ImpactIndex(ids, vectors)
    asked = ids % 50 == 0
    possible = index.possible(vectors[asked], ids[asked], 5)
    assert possible.mean() < 0.1
    scores = vectors[asked] @ index.vectors.T
    scores[ids[asked][:, None] == index.ids[None]] = np.iinfo(np.int64).min
    fifth = np.sort(scores, axis=1)[:, -5, None]
    assert possible[scores >= fifth].all()
