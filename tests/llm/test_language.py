import collections

import numpy as np

from samplemill.llm import language

SF = "/root/testdata/sf0.01"


def best_path(scores, penalty):
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        top = value.argmax()
        moved = value[top] - penalty > value
        back.append(np.where(moved, top, np.arange(len(value))))
        value = np.where(moved, value[top] - penalty, value) + row
    path = [int(value.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_paths_of_many_texts_at_once():
    rng = np.random.default_rng(0)
    sure = 0
    for _ in range(100):
        sizes = rng.integers(1, 40, 6)
        scores = -rng.random((sizes.sum(), 3)) * rng.choice([1, 4])
        scores -= scores.max(axis=1, keepdims=True)
        firsts = np.cumsum(sizes) - sizes
        best = np.add.reduceat(scores, firsts, axis=0).argmax(axis=1)
        got, alike = language.paths(scores, sizes, 3.0), language.steady(scores, sizes, best, 3.0)
        for j, (a, n) in enumerate(zip(firsts, sizes)):
            want = best_path(scores[a : a + n], 3.0)
            assert got[a : a + n].tolist() == want
            if alike[j]:
                sure += 1
                assert set(want) == {best[j]}
    assert sure > 100


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language.identify(docs).collect() if r.held_out]
    assert len(rows) > 250
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_texts_have_spans(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IN ('en', 'de')")
    texts = collections.defaultdict(list)
    for r in docs.orderBy("doc_id").collect():
        words = r.text.split()
        if len(words) > 120:
            texts[r.lang].append(" ".join(words[:100]))
    mixed = f"{texts['en'][0]} {texts['de'][0]}"
    model = language.train(docs)
    (row,) = language.with_language(docs_of([(1, mixed)]), model).collect()
    (a, _, _), (b, start, _) = (s.split(":") for s in row.spans.split(","))
    assert (a, b) == ("en", "de") and abs(int(start) - len(texts["en"][0])) < 30
    assert 0.3 < row.score < 0.8 or row.score >= 0.5


def test_scripts_narrow_the_candidates(spark, docs_of):
    rows = [(1, "мир труд май город улица " * 8, "ru"), (2, "κόσμος πόλη δρόμος " * 8, "el"), (3, "world town street road " * 8, "en")]
    model = language.train(docs_of(rows))
    new = docs_of([(1, "неизвестное слово"), (2, "άγνωστη λέξη"), (3, "unknown words"), (4, "слово unknown"), (5, "שלום")])
    got = [r.lang_pred for r in language.with_language(new, model).orderBy("doc_id").collect()]
    assert got[:3] == ["ru", "el", "en"] and got[3] in ("ru", "en") and got[4] in ("ru", "el", "en")


def test_nothing_learnt(docs_of):
    rows = language.identify(docs_of([(1, "some words", None)])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
