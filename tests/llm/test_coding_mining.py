"""Word BPE, collocations and hard negatives against the library and plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import re
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sectionflow.llm import collocations, hard_negatives, lexicon

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return lexicon.read_vocabulary(PATH)


def coded(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("words", [0, 3, 5000])
def test_round_trip_is_the_library_s(spark, docs, corpus_rows, library, words):
    got = sorted((r.doc_id or -1, bytes(r.ids), r.decoded) for r in lexicon.round_trip(docs, PATH, words).collect())
    assert got == sorted((r[0] or -1, *coded(library, r[1])) for r in corpus_rows)


def test_long_texts_are_cut_at_spaces(spark, docs, corpus_rows, library, monkeypatch):
    monkeypatch.setattr(lexicon, "LONG_TEXT", 50)
    got = sorted((r.doc_id or -1, bytes(r.ids)) for r in lexicon.encode(docs, PATH, 100).collect())
    assert got == sorted((r[0] or -1, coded(library, r[1])[0]) for r in corpus_rows)


def test_decode_takes_what_encode_gives(spark, docs, library):
    ids = lexicon.encode(docs, PATH, 1000)
    want = {(r.doc_id, bytes(r.ids)): library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) for r in ids.collect()}
    got = lexicon.decode(ids, PATH).collect()
    assert sorted(r.decoded for r in got) == sorted(t for (d, x), t in want.items() for _ in range(Counter((r.doc_id, bytes(r.ids)) for r in ids.collect())[d, x]))


def test_pieces_and_merges(library, vocabulary):
    rng = random.Random(4)
    letters = "abcdeéßÀ'stvemlrd019 \t\n\x1c\x85\xa0,.-_Σσςİſǅ北京ﬁ́😀²½ª"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>B<|startoftext|><|endoftext|>  'LL ", "ΣΑΣ ΣΑΣ", "aaaa aaaaa", "ab" * 4000]
    split = lexicon.Splitter(vocabulary.special)
    for text in texts:
        ids = [i for p in split(text) for i in ([vocabulary.special[p]] if p in vocabulary.special else lexicon.merged(p.encode(), vocabulary))]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_automaton_is_minimal_and_numbers_words_in_order(tmp_path):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))).encode() for _ in range(900)})
    states, start = lexicon.minimal_automaton(words)
    assert len({s for s in states}) == len(states)  # no two states are equal, so none can be merged

    def language(state):
        final, arcs = states[state]
        return [b""] * final + [bytes([b]) + rest for b, target in arcs for rest in language(target)]

    assert language(start) == words
    (tmp_path / "file").write_bytes(lexicon.compiled({w: [i, len(w)] for i, w in enumerate(words)}))
    held = lexicon.Lexicon(str(tmp_path / "file"))
    asked = [*words, b"d", b"abcabcabc", b"x" * 500]
    places = held.places(asked)
    assert places.tolist() == [*range(len(words)), -1, -1, -1]
    assert [np.frombuffer(x, "<u4").tolist() for x in held.coded(places[:-3])] == [[i, len(w)] for i, w in enumerate(words)]


def test_suffixes_are_shared():
    states, _ = lexicon.minimal_automaton(sorted(s.encode() + b"ing" for s in ("walk", "talk", "rest", "sing")))
    assert sum(arcs == ((ord("g"), 0),) for _, arcs in states) == 1


def test_lexicon_holds_the_most_frequent_words(spark, vocabulary):
    docs = spark.createDataFrame([("b b b a a c <|endoftext|>",), ("B, a",), (None,)], "text string")
    counts = {r.word: r.n for r in lexicon.word_counts(docs, vocabulary).collect()}
    assert counts == {"b": 4, "a": 3, "c": 1, ",": 1}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        lexicon.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_coding_of_no_documents(spark, no_docs):
    assert lexicon.round_trip(no_docs, PATH).count() == 0


def plain_collocations(rows, least, longest, top, covered):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= covered * a for b in longer):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def spoken(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "été", "x", "ÉTÉ", "日本", "a\x0bb", "end."]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("new york\tcity  new york, city!new york city " * 30, "en"), (" .,;", "fr"), (rows[0])]


@pytest.mark.parametrize("least, longest, top, covered", [(10, 3, 2000, 50), (2, 4, 7, 90), (3, 2, 5, 50), (1, 3, 10**6, 0)])
def test_collocations_are_the_plain_ones(spark, least, longest, top, covered):
    rows = spoken(least, 120)
    docs = spark.createDataFrame([(t, x, 1, 2.0) for t, x in rows], "text string, lang string, rank int, score double").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, longest, top, covered).collect())
    assert got == plain_collocations(rows, least, longest, top, covered)


def test_collocations_over_many_partitions_and_hand_overs(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART_MASS", 200)
    monkeypatch.setattr(collocations, "HELD_KEYS", 50)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 300)
    monkeypatch.setattr(collocations, "TABLE_BYTES", 300)  # most bits are set, results must not depend on it
    rows = spoken(9, 200)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(docs, 10, 3, 2000, 50).collect())
    assert got == plain_collocations(rows, 10, 3, 2000, 50)


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 40)
    rows = [("new york city. the  new york\tcity of the " * 60 + "x" * 500, "en"), *spoken(7, 60)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    got = sorted(tuple(r) for r in collocations.collocations(docs, 3, 3, 2000, 50).collect())
    assert got == plain_collocations(rows, 3, 3, 2000, 50)


def test_collocations_of_no_documents(spark, no_docs):
    assert collocations.collocations(no_docs, 10, 3, 2000, 50).count() == 0


@pytest.mark.parametrize("capacity", [3, 10, 40, 1000])
def test_summary_keeps_what_is_frequent(capacity):
    rng = np.random.default_rng(capacity)
    stream = (rng.zipf(1.3, 6000) % 500).astype(np.uint64)
    truth = Counter(stream.tolist())
    one, two = collocations.Summary(capacity), collocations.Summary(capacity)
    for i, part in enumerate(np.array_split(stream, 40)):
        (one if i % 2 else two).merge(*np.unique(part, return_counts=True))
    one.merge(two.keys, two.counts, two.taken)
    assert len(one.keys) <= capacity and one.taken <= len(stream) // (capacity + 1)
    for key, count in zip(one.keys.tolist(), one.counts.tolist()):
        assert truth[key] - one.taken <= count <= truth[key]
    threshold = len(stream) // (capacity + 1) + 1  # the capacity exceeds mass by threshold
    assert {k for k, n in truth.items() if n >= threshold} <= set(one.possible(threshold).tolist())


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 65, 40), (70, 64, 300), (129, 70, 257), (2, 0, 3), (0, 5, 4)])
@pytest.mark.parametrize("size", [10, 2**28])
def test_strassen_is_the_plain_product(shape, size):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-size, size, shape[:2]), rng.integers(-size, size, shape[1:])
    want = np.array([[sum(int(x) * int(y) for x, y in zip(row, col)) for col in b.T] for row in a]).reshape(shape[0], shape[2])
    assert (hard_negatives.strassen(a, b) == want).all()


def plain_negatives(rows, step, positives, negatives, low, high):
    seen = sorted({(i, y, tuple(int(np.floor(256.0 * x)) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, y, v in seen:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in seen if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, p, r, j, -s, -t) for r, (t, j, _) in enumerate(inside, 1)]
    return sorted(out)


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=5)], int(rng.integers(3))) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 3) for i in range(40)]  # ties
    rows += [rows[0], rows[0], (10, [1.0, 2.0, 3.0, 4.0, 5.0], 0), (20, [0.0] * 5, 1), (30, [-1.0] * 5, 2)]
    rows += [(1, None, 1), (2, [1.0, None, 1.0, 1.0, 1.0], 1), (3, [float("nan")] * 5, 1), (4, [float("inf")] * 5, 1), (5, [1.0] * 5, None)]
    rows += [(None, [1.0] * 5, 1), (40, [1.0, 2.0], 1), (41, [2.0, 2.0], 1), (42, [1.0, 1.5], 0), (50, [], 1), (51, [], 1)]
    return rows


@pytest.mark.parametrize("tile, shard, block", [((512, 4096), 8192, 4096), ((3, 16), 30, 4)])
@pytest.mark.parametrize("kinds", [(5, 3, 50, 95), (2, 4, -100, 100)])
def test_hard_negatives_are_the_plain_ones(spark, monkeypatch, tile, shard, block, kinds):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = vectors(150, 2)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, rank int, score int")
    got = hard_negatives.mine(table.repartition(3), F.col("vec_id") % 10 == 0, *kinds)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, 10, *kinds)


def test_hard_negatives_of_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(table, F.col("vec_id") % 10 == 0).count() == 0


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 6, (4, 60)), np.arange(60)
    parts = [slice(a, a + 7) for a in range(0, 60, 7)]
    results = []
    for order in (parts, parts[::-1]):
        heaps = hard_negatives.Heaps(4, 5)
        for p in order:
            heaps.push(slice(0, 4), scores[:, p], ids[p], scores[:, p] > 1)
        results.append([x.tolist() for x in heaps.rows()])
    want = [sorted((-s, i) for i, s in enumerate(row) if s > 1)[:5] for row in scores.tolist()]
    assert results[0] == results[1]
    assert sorted(zip(*results[0])) == sorted((r, i, -s) for r, row in enumerate(want) for s, i in row)
