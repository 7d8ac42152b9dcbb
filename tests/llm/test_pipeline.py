"""The pipeline, the registered queries and their SQL on the smallest given tables."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sectionflow.llm import langid
from sectionflow.session import materialize
from tests.llm.conftest import ITEM
from tests.llm.test_operators import LOWER, WORDS, base_matches, jaccard_groups

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not present")


def test_stages_take_odd_rows(spark, docs, no_docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            before, table = table, materialize(stage(spark, table, str(tmp_path)), name)
            if name != "mixing":
                assert table.columns == before.columns
                assert table.dtypes == before.dtypes
    assert table.count() == 0


def test_decisions_take_effect(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    table, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        table = materialize(stage(spark, table, str(tmp_path)), name)
        left[name] = [r.text for r in table.collect()]
    assert None not in left["language_id"] and "###" not in left["language_id"]
    assert len(set(left["near_dedup"])) == len(left["near_dedup"]) < len(left["language_id"])
    assert any(ITEM.upper() in t for t in left["near_dedup"]) and not any(ITEM.upper() in t for t in left["decontamination"])
    assert any("@x-y.example" in t for t in left["decontamination"]) and not any("@x-y.example" in t for t in left["pii"])
    assert set(left["mixing"]) <= set(left["pii"]) and left["mixing"]


@given
@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k.startswith("op") or k == "pipeline"))
def test_registered_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    assert got
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for table in "documents embeddings pages benchmark labels conversations".split():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        cursor = con.execute(sql)
        names = sorted(df.columns)
        assert sorted(d[0] for d in cursor.description) == names
        order = [[d[0] for d in cursor.description].index(n) for n in names]
        assert sorted(str([r[n] for n in names]) for r in got) == sorted(str([r[i] for i in order]) for r in cursor.fetchall())


def plain_language(model, text):
    """Best path by a loop over words and languages, and the share of letters of the first language."""
    words = langid.words_of(text)
    if not words:
        return "und", 0.0
    scores = np.concatenate([model.scores(words[i : i + 1]) for i in range(len(words))]).astype(float)
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        best = value.max() - langid.SWITCH
        back.append([i if value[i] >= best else int(value.argmax()) for i in range(len(value))])
        value = np.maximum(value, best) + row
    path = [int(value.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    letters = Counter()
    for word, i in zip(words, reversed(path)):
        letters[i] += len(word)
    most = min((-n, i) for i, n in letters.items())
    return model.languages[most[1]], -most[0] / sum(letters.values())


def test_language_is_the_plain_one(spark, docs, corpus_rows):
    model = langid.fit(docs, F.lit(True))
    want = [(r[0], *plain_language(model, r[1])) for r in corpus_rows if len(r[1] or "") < 20_000]
    rows = docs.where("length(coalesce(text, '')) < 20000")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(rows, model).collect()]
    by = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert [r[:2] for r in sorted(got, key=by)] == [r[:2] for r in sorted(want, key=by)]
    assert np.allclose([r[2] for r in sorted(got, key=by)], [r[2] for r in sorted(want, key=by)])


def replaced(text):
    """Base spans named, overlapping ones as the first of them."""
    out, at = [], 0
    for start, _, kind, end in base_matches(text):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages_are_the_plain_ones(spark, docs, benchmark, tmp_path):
    """What each stage returns for what the one before it kept, from loops over its rows."""
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = set()
    for item in benchmark.collect():
        w = WORDS.findall((item.text or "").translate(LOWER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()

    def language(rows):
        model = langid.fit(docs, F.lit(True))
        kept = []
        for r in rows:
            lang, share = plain_language(model, r[1])
            kept += [r] if lang != "und" and share >= corpus_pipeline.LEAST_SHARE else []
        return kept

    def near(rows):
        label = jaccard_groups([t for _, t in rows])
        return [min((r for r, x in zip(rows, label) if x == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in set(label)]

    def clean(rows):
        def holds(text):
            w = WORDS.findall((text or "").translate(LOWER))
            return any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w) - len(x) + 1))

        return [r for r in rows if not holds(r[1])]

    plain = {"language_id": language, "near_dedup": near, "decontamination": clean, "pii": lambda rows: [(i, replaced(t)) for i, t in rows]}
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in table.collect()]
        table = materialize(stage(spark, table, str(tmp_path)), name)
        got = Counter((r.doc_id, r.text) for r in table.collect())
        if name in plain:
            want = Counter(plain[name](rows))
            if name == "near_dedup":  # of equal smallest ids any row may stay
                got, want = Counter(i for i, _ in got.elements()), Counter(i for i, _ in want.elements())
            assert got == want, name
        else:
            assert set(got) <= set(rows)
