import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_near_dedup import brute as near_brute
from tidewatt.llm import quality
from tidewatt.session import staged

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    made = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), name)
        made.append((name, docs))
    return made


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(results):
    documents = results[0][1].columns
    assert [name for name, _ in results[1:]] == ["quality", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    assert all(df.columns == documents for _, df in results[:-1])
    assert results[-1][1].columns == [*documents, "n_tokens", "token_ids"]


def test_quality_keeps_what_scores_high(spark, results):
    scores = quality.quality_scores(results[0][1], spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    assert set(rows(results[1][1])) == {r.doc_id for r in scores if r.predicted == 1}


def test_one_of_each_group_stays(results):
    before = [(r.doc_id, r.text) for r in results[1][1].collect()]
    assert set(rows(results[2][1])) == {d for d, _, _, kept in near_brute(before) if kept}


def test_no_repeated_or_benchmark_passage_is_left(spark, results):
    texts, n = rows(results[3][1]), corpus_pipeline.REPEATED_WORDS
    assert set(texts) == set(rows(results[2][1]))
    before = rows(results[2][1])
    seen = {}
    for doc in sorted(before):
        words = (before[doc].text or "").split()
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        gone = {j for i, w in enumerate(windows) if seen.get(w, doc) < doc for j in range(i, i + n)}
        for w in windows:
            seen.setdefault(w, doc)
        assert texts[doc].text.split() == [w for j, w in enumerate(words) if j not in gone]
    assert all(r.n_chars == len(r.text or "") for r in rows(results[4][1]).values())


def test_tokens_as_the_library(results):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for r in results[-1][1].collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)


def test_run_applies_the_stages(spark, results):
    assert np.array_equal(sorted(corpus_pipeline.run(spark, SF_DIR).toPandas().doc_id), sorted(rows(results[-1][1])))


def test_entry_point_without_this_part(tmp_path):
    """The entry point still imports when the operators and the pipeline are deleted."""
    import os
    import shutil
    import subprocess

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/tidewatt", tmp_path / "tidewatt", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
