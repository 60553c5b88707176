"""Every operator on NULLs, empty and very long texts, ties, repeated rows, clashing columns and an empty table."""

import pytest

import corpus_pipeline
from samplemill.llm import exact, language, packing, passages, pieces, quality, secrets, similar, simhash, templates, token_counts

ONE_ROW_PER_ROW = {
    "simhash": simhash.simhash_groups,
    "language": language.identify,
    "token counts": token_counts.document_counts,
    "quality": quality.judge,
    "exact": exact.dedup_exact,
    "pieces": pieces.digests,
    "decoded pieces": pieces.encode_decode,
    "templates": templates.drop_recurring_lines,
    "secrets": secrets.scan,
    "redaction": secrets.redact,
}
OTHERS = {"passages": passages.duplicate_passages, "packing": packing.pack, "near": similar.near_duplicates}


@pytest.mark.parametrize("name", ONE_ROW_PER_ROW)
def test_one_row_per_row(messy, name):
    got = ONE_ROW_PER_ROW[name](messy).collect()
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in got)
    assert ids == [-1, -1, 1, 2, 4, 5, 6, 7, 8, 9, 9, 11]


@pytest.mark.parametrize("name", [*ONE_ROW_PER_ROW, *OTHERS])
def test_empty_table(messy, name):
    assert (ONE_ROW_PER_ROW | OTHERS)[name](messy.limit(0)).collect() == []


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_defined_values(messy):
    lang = by_id(language.identify(messy))
    assert [lang[i].lang_pred for i in (4, 5, 6, 11)] == ["und"] * 4 and lang[1].lang_pred == "en"
    assert not lang[None].held_out
    groups = by_id(simhash.simhash_groups(messy))
    assert [groups[i].component_id for i in (1, 2, 4, 5, 6)] == [1, 1, 4, 4, 4] and groups[4].fingerprint == "0" * 16
    assert [by_id(token_counts.document_counts(messy))[i].n_tokens for i in (4, 5)] == [0, 0]
    judged = by_id(quality.judge(messy))
    assert judged[4].n_words == 0 and judged[4].base_failed and judged[6].host_rate is None
    assert [by_id(pieces.digests(messy))[i].n_tokens for i in (4, 5)] == [2, 2]
    lines = by_id(templates.drop_recurring_lines(messy))
    assert lines[4].text is None and lines[4].n_lines == 0 and lines[5].n_lines == 1 and lines[6].n_lines == 3
    assert by_id(secrets.scan(messy))[4].spans == ""


def test_exact_ties(messy):
    rows = exact.dedup_exact(messy).collect()
    assert sorted(r.doc_id for r in rows if r.kept and r.doc_id is not None) == [1, 6, 7, 8, 9, 11]
    blank = {r.doc_id: r for r in rows if r.doc_id in (4, 5, 6)}
    assert {r.keep_id for r in blank.values()} == {6} and blank[6].group_size == 4
    assert [r.kept for r in rows if r.doc_id == 9].count(True) == 1
    stays = exact.drop_exact(messy).collect()
    assert sorted(r.doc_id for r in stays) == [1, 6, 7, 8, 9, 11] and set(stays[0].asDict()) == set(messy.columns)


def test_near_and_passages(messy):
    assert {(r.doc_id, r.keep_id) for r in similar.near_duplicates(messy).collect()} == {(2, 1), (None, 1)}
    got = passages.duplicate_passages(messy).collect()
    assert {r.doc_id for r in got if r.rep_id == 1} == {1, 2, 7}


def test_packing_covers_all(messy):
    rows = packing.pack(messy, length=64, window=2).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert [r.doc_tokens for r in rows if r.doc_id in (4, 5, 6)] == [1, 1, 1]


def test_pipeline_stages(spark, messy):
    docs, columns = messy, messy.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns, name
        others = docs.select("_text_hash", "_language", "_language_share", "_i", "_k", "n", "kept").distinct().collect()
        assert [tuple(r) for r in others] == [("h", "MINE", "half", 5, 6, 4, "no")], name
    assert sorted(r.doc_id for r in docs.collect()) == [1, 7, 8, 9]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy.limit(0), "").collect() == []
