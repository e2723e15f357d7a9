"""The pipeline's stages, each against brute force over what the stage before kept."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_pipeline import STAGES
from docmill.llm import common, toxicity
from tests.llm.conftest import ROWS
from tests.llm.test_near_operators import brute_components, brute_spans
from tests.llm.test_text_operators import lower


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept, tables = [before], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, tables, sf)
        assert set(out.columns) == set(docs.columns)
        out.write.parquet(str(tmp_path / str(k)))
        tables = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in tables.collect()})
    clean, exact, near, cut = kept[1:]
    params = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = toxicity.Scorer(params).scores([r.text for r in before.values()])
    assert {i for i, s in zip(before, scores) if s < 0.5} == set(clean) and 0 < len(clean) < len(before)
    groups = defaultdict(list)
    for i, r in clean.items():
        groups[lower(r.text)].append(i)
    assert {max(g) for g in groups.values()} == set(exact) and len(exact) < len(clean)
    comp = brute_components([(i, r.text) for i, r in exact.items()])
    assert {i for i, _, c in comp if c == i} == set(near) and len(near) < len(exact)
    spans = {i: t for i, _, _, t in brute_spans(sorted((i, r.text) for i, r in near.items()))}
    assert {i: r.text for i, r in cut.items()} == spans
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source) for i, r in cut.items())
    library, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for p in corpus_pipeline.STAGES[-1][1](spark, tables, sf).collect():
        ids[p.doc_id].append((p.start, np.frombuffer(p.ids, np.uint32).tolist()))
    assert {i: [x for _, own in sorted(v) for x in own] for i, v in ids.items()} == {i: [*library.encode(r.text, add_special_tokens=False).ids, 2] for i, r in cut.items()}


def test_stages_on_edge_cases(spark, docs, empty, sf):
    """Nulls, ties, repeated rows, clashing columns and empty tables through every stage."""
    named = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in STAGES[:-1]:
        out = stage(spark, named, sf)
        assert out.columns == named.columns and 0 < out.count() <= len(ROWS)
        assert stage(spark, named.where("false"), sf).count() == 0
        ids = Counter(r.doc_id for r in out.collect())
        gone = {"exact_dedup": {1, 3}, "near_dedup": {2}}.get(name, set())
        assert not gone & set(ids) and (None in ids or name == "toxicity")
    packed = STAGES[-1][1](spark, named, sf)
    assert sum(r.length for r in packed.collect()) > 30_000 and STAGES[-1][1](spark, named.where("false"), sf).count() == 0


def test_two_runs_do_not_delete_each_others_tables(spark, sf):
    one = corpus_pipeline.run(spark, sf)
    two = corpus_pipeline.run(spark, sf)
    assert one.count() == two.count() > 0 and one.exceptAll(two).isEmpty()


def test_scratch(spark):
    with common.scratch() as keep:
        a, b = (common.saved(spark.range(3), n) for n in "ab")
        keep(b)
    files = lambda df: common._file_system(spark, df._scratch)
    assert [f.exists(w) for w, f in map(files, (a, b))] == [False, True] and b.count() == 3


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        applicationId = "x"

    class Session:
        sparkContext, conf = Context(), {}

    Context.master = "yarn"
    with pytest.raises(ValueError):
        common.shared_dir(Session())
    Context.master = "local[4]"
    assert common.shared_dir(Session()).startswith("file:")


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]


def test_columns_named_like_those_inside(spark):
    """Operators that keep all columns keep those whose names they use themselves."""
    from pyspark.sql import functions as F

    from docmill.llm import exact_dedup, jaccard, substring_dedup, url_filter

    passage = " ".join(f"word{i}" for i in range(60))
    names = ["__gone", "__gone_key", "__key", "__k", "__sha", "__n_sentences", "__n_removed", "key", "text_", "node"]
    docs = spark.createDataFrame([(i, f"start{i} {passage} end{i}") for i in range(4)] + [(9, "alone")] * 2, "doc_id long, text string").withColumns({n: F.lit(5) for n in names})
    for f in (substring_dedup.drop_repeated_spans, exact_dedup.drop_exact_copies, jaccard.drop_near_copies):
        out = f(docs)
        assert out.columns == docs.columns and all(r[n] == 5 for r in out.collect() for n in names)
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string").withColumns({n: F.lit(5) for n in ("__rule", "__ruled", "__url", "h", "p", "hits")})
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert rows[1].verdict == "block" and rows[2].verdict == "allow" and rows[1]["__rule"] == 5 and rows[2]["__url"] == 5
