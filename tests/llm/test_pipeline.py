import hashlib
import struct

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_line_dedup import brute as kept_lines
from tests.llm.test_near_documents import brute as near_classes
from weekcast.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    """Every stage's rows from the stage before it, by brute force; then the run as a whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "byte_bpe":
            break
        assert out.columns == columns
        got = {r.doc_id: r for r in out.collect()}
        assert got and set(got) <= set(rows)
        texts = [(i, r.text) for i, r in sorted(rows.items())]
        if name == "quality_classifier":
            want = {i: t for i, t in texts if model.score(t) >= quality.KEEP}
        elif name == "line_dedup":
            want = {i: t for (i, old), t in zip(texts, kept_lines(texts)) if t == old or (t and t.strip())}
        elif name == "near_dedup":
            classes = near_classes(texts)
            want = {i: t for i, t in texts if classes[i] == i}
        else:
            want = {i: t for i, t in texts if not any(b[:40] in (t or "") and contaminated(t, b) for b in bench)}
        assert {i: r.text for i, r in got.items()} == want, name
        assert all(r.n_chars == len(r.text) or r.text == rows[i].text for i, r in got.items())
        rows, docs = got, out
    own = bpe.Bpe(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
    want = {i: hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest() for i, r in rows.items() for x in [library.encode_ordinary(r.text or "")]}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_take_extra_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).selectExpr("*", "1 AS node", "'x' AS row", "2 AS n_lines")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 30


def test_documents_that_lose_all_lines_go(spark):
    rows = [(1, "one line of text here\nand another line", "en", "s", 40), (2, "one line of text here", "en", "s", 21), (3, "", "en", "s", 0), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, docs, SF).collect()}
    assert got == {1: (rows[0][1], 40), 3: ("", 0), 4: (None, 0)}
