"""The pipeline's stages against brute force, each on its own input, and run() against their chain."""

import re

import corpus_pipeline
import numpy as np
import pytest
from lodestar.llm import decontaminate, weak_labels
from tests.llm.test_operators import components, lines_expected, prose

SF = "/root/testdata/sf0.001"


def rows_of(where):
    rng = np.random.default_rng(4)
    item = prose(40, 300).split()
    rows = [(i, prose(60 + 5 * i, 400 + i)) for i in range(12)]
    rows += [(20 + i, rows[3][1]) for i in range(4)]  # exact copies
    for i in range(8):  # near copies: i changed words of 200
        words = prose(200, 500).split()
        for j in range(i):
            words[(37 * j + 11 * i) % 200] = f"changed{i}x{j}"
        rows.append((30 + i, " ".join(words)))
    leak = list(item)
    leak[4] = leak[20] = "other"
    rows += [(40, prose(30, 600) + " " + " ".join(item[5:30]) + " " + prose(30, 601)), (41, prose(50, 602) + " " + " ".join(leak)), (42, prose(30, 603) + " " + " ".join(item[:10]))]
    rows += [(50 + i, prose(40, 610 + i) + "\nOne line that many documents hold\n" + prose(20, 620 + i)) for i in range(4)]
    rows += [(60, "One line that many documents hold"), (61, " one line that many documents hold \nshort"), (62, prose(70, 630) + "\n" + prose(70, 630))]
    rows += [(70, "!!! $$$ ### %%% " * 30), (71, "WORD " * 200), (72, None), (73, ""), (74, " \n "), (None, prose(60, 640)), (None, prose(60, 640)), (80, prose(50, 641)), (80, prose(50, 641)), (81, prose(6000, 642))]
    rng.shuffle(rows)
    return [(int(k) if k is not None else None, t) for k, t in rows], [(1, " ".join(item)), (2, None), (3, ""), (None, prose(30, 400)), (4, "two words")]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("pipeline"))
    rows, items = rows_of(where)
    docs = spark.createDataFrame([(k, t, f"src{i % 3}", "mine", -1, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, source string, kept string, n_dropped int, n_lines long")
    docs = docs.selectExpr("*", "cast(char_length(text) as long) AS n_chars")
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    labels = [(k, 0 if k in (70, 71) else 1, 0) for k, _ in rows if k is not None and k % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, docs, items


def of(df):
    return sorted(((r.n_lines, r.doc_id, r.text) for r in df.collect()), key=str)  # n_lines: a number of the row, here


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_quality_stage_keeps_what_the_classifier_keeps(spark, place):
    where, docs, _ = place
    labels = spark.read.parquet(f"{where}/labels.parquet")
    model = weak_labels.fit(docs, labels)
    keep = {(r.n, r.keep) for r in weak_labels.classify(docs.selectExpr("n_lines AS doc_id", "text"), model=model).selectExpr("doc_id AS n", "keep").collect()}
    out = stage("quality classifier")(spark, docs, where)
    assert out.columns == docs.columns
    kept = {r.n_lines for r in out.collect()}
    assert kept == {n for n, k in keep if k}
    names = {r.n_lines: r.doc_id for r in docs.collect()}
    gone = {names[n] for n in set(names) - kept}
    assert {70, 71, 72, 73, 74} <= gone and not gone & set(range(60))


def test_line_stage(spark, place):
    where, docs, _ = place
    rows = [r for r in docs.collect()]
    want, known = [], lines_expected([(r.doc_id, r.text) for r in rows if r.doc_id is not None and r.doc_id != 80])
    for r in rows:
        _, dropped, left = known.get(r.doc_id, (0, 0, r.text))
        if dropped and not re.search(r"[^\x20\x09-\x0D]", left):
            continue
        want.append((r.n_lines, r.doc_id, left if dropped else r.text))
    out = stage("line dedup")(spark, docs, where)
    assert of(out) == sorted(want, key=str) and out.columns == docs.columns
    assert {(r.kept, r.n_dropped) for r in out.collect()} == {("mine", -1)}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_near_duplicate_stage_is_exact(spark, place):
    where, docs, _ = place
    rows = docs.collect()
    parts = components([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 5, 80)
    want = [(r.n_lines, r.doc_id, r.text) for r in rows if r.doc_id is None or parts[r.doc_id][1] == r.doc_id]
    assert of(stage("n-gram jaccard join")(spark, docs, where)) == sorted(want, key=str)
    assert sum(parts[k][1] < k for k in range(31, 38)) >= 3  # near copies are caught


def leaks(text, items):
    """Whether some window of the text agrees with an item as contaminated() says, tried at every alignment."""
    a = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    for _, item in items:
        b = [w for w in re.split(r"[\W_]+", (item or "").lower()) if w]
        width = min(len(b), decontaminate.WINDOW)
        least = decontaminate.AGREE if width == decontaminate.WINDOW else width
        for i in range(len(b) - width + 1):
            for j in range(-width, len(a)):
                if b and sum(0 <= j + x < len(a) and a[j + x] == b[i + x] for x in range(width)) >= least:
                    return True
    return False


def test_benchmark_stage(spark, place):
    where, docs, items = place
    items = [x for x in items if x[0] is not None]
    rows = docs.collect()
    bad = {r.doc_id for r in rows if r.doc_id is not None and r.doc_id != 81 and leaks(r.text, items)}
    assert bad == {40, 41}
    want = [(r.n_lines, r.doc_id, r.text) for r in rows if r.doc_id not in bad]
    assert of(stage("benchmark decontamination")(spark, docs, where)) == sorted(want, key=str)


def test_packing_stage(spark, place):
    from lodestar.llm.queries import WORD_TOKENIZER
    from tokenizers import Tokenizer

    where, docs, _ = place
    tok, want = Tokenizer.from_file(WORD_TOKENIZER), {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1)
    got, bins = {}, {}
    for r in stage("best-fit packing")(spark, docs, where).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault(r.bin, []).append((r.offset, r.offset + r.n_tokens, r.capacity))
    assert got == {k: sum(v) for k, v in want.items()}
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][1] <= own[0][2]


def test_run_is_the_chain_of_stages(spark, place):
    where, docs, _ = place
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, where)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(corpus_pipeline.run(spark, where).collect(), key=str) == sorted(docs.collect(), key=str)


def test_empty_tables(spark, place, tmp_path):
    where, docs, _ = place
    none = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, none, where)
        assert out.count() == 0, name
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{where}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF).persist()
        assert out.columns == names and 0 < out.count() <= docs.count(), name
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
