"""The pipeline's stages on a small corpus with planted cases, one after the other."""

import random

import pytest

import corpus_pipeline
from lexistore.llm import common, line_dedup
from lexistore.llm.quality import held_out

from .test_operators import brute_components, frame, prose


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    assert corpus_pipeline.ORACLE_SQL is None and held_out is not None


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    at = tmp_path_factory.mktemp("corpus")
    clean = [prose(rnd, 80, 5000) for _ in range(150)]
    junk = [" ".join(f"{w}$$$" for w in prose(rnd, 60, 5000).split()) for _ in range(60)]
    lines = "\n".join(prose(rnd, 8, 5000) for _ in range(30))
    test_item = prose(rnd, 40, 5000)
    texts = clean + junk
    texts += [clean[0], clean[1] + " more", f"{clean[2]} {test_item}"]
    texts += [prose(rnd, 40, 5000) + "\n" + lines for _ in range(2)] + [None, ""]
    frame(spark, texts).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, test_item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    rows = [(i, 1, 0) for i in range(150)] + [(i, 0, 0) for i in range(150, 210)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return texts, str(at)


def test_each_stage(spark, corpus, tmp_path):
    texts, at = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append({r.doc_id: r for r in docs.collect()})
    kept, lines, near, decontaminated, tokens = seen
    assert (set(range(150)) - set(kept), set(range(150, 210)) & set(kept)) == (set(), set())
    before, gone = set(), {}
    for i in sorted(kept):
        drop = set()
        for first, end, _, body in line_dedup.pieces(kept[i].text or ""):
            if body in before:
                drop |= set(range(first, end))
            before.add(body)
        text = kept[i].text
        gone[i] = text if not drop else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop)
    assert {i: r.text for i, r in lines.items()} == gone and gone[214] != kept[214].text
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.values())
    ids = sorted(lines)
    component = {i: c for i, _, c in brute_components([lines[i].text for i in ids], ids, 5, 80)}
    assert set(near) == {i for i in ids if component[i] == i} and 0 in near and 210 not in near and 211 not in near
    assert set(near) - set(decontaminated) == {212}
    assert set(tokens) == set(decontaminated)
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, at).collect()} == {i: r.ids_sha256 for i, r in tokens.items()}


def test_a_document_that_loses_all_its_lines_goes(spark):
    rnd = random.Random(6)
    lines = [prose(rnd, 6) for _ in range(6)]
    texts = ["\n".join(lines), "\n".join(lines), "\n".join(lines[:3]), "\n".join([*lines[3:], "own"]), "one line", "one line", "", None, ""]
    out = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, frame(spark, texts), "").collect()}
    assert out == {0: texts[0], 3: "own", 4: "one line", 5: "one line", 6: "", 7: None, 8: ""}


def test_a_run_leaves_only_its_last_table(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    corpus_pipeline.run(spark, corpus[1]).count()
    (left,) = [x for x in tmp_path.iterdir() if any(x.iterdir())]
    assert left.name.startswith("corpus-pipeline") and [x.name for x in left.iterdir()] == ["stage-4"]


def test_one_row_of_a_component_stays(spark):
    rnd = random.Random(5)
    near, ids_null, same, lone, other = [prose(rnd, 80, 5000) for _ in range(5)]
    rows = [(7, near), (7, near + " more"), (9, near), (None, near)]  # near duplicates that share the least id
    rows += [(None, ids_null)] * 2 + [(None, ids_null + " more")]  # no id at all
    rows += [(3, same)] * 3 + [(4, same)]  # rows equal in id and text
    rows += [(7, lone), (7, other), (None, other + " x"), (5, None), (5, None), (5, "")]  # one id, different components; no words
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    groups = [[r for r in out if r[1] and r[1].startswith(t)] for t in (near, ids_null, same, lone, other)]
    assert [[i for i, _ in g] for g in groups] == [[7], [None], [3], [7], [7]]
    assert sorted(out, key=repr) == sorted([*sum(groups, []), (5, None), (5, None), (5, "")], key=repr)
    again = corpus_pipeline.drop_near_duplicates(spark, docs.orderBy("text"), "")
    assert sorted(((r.doc_id, r.text) for r in again.collect()), key=repr) == sorted(out, key=repr)
