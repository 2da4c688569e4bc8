import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from aerolattice.llm import decontaminate, suffix_dedup
from aerolattice.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_follow_from_each_other(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        kept.append(docs.count())
        if name != cp.STAGES[-1][0]:
            assert tuple(docs.columns) == cp.COLUMNS
            last = docs
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[1] > 0
    tok = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    counts = {r.doc_id: r.n_tokens for r in docs.collect()}
    assert counts == {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in last.collect()}
    items = [decontaminate.shingles(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in last.collect():
        there = decontaminate.shingles(decontaminate.words_of(r.text))
        assert all(len(s & there) < 0.8 * len(s) for s in items)
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_and_empty_tables(spark, docs):
    odd = docs.select(*cp.COLUMNS)
    for df in (odd, odd.where("false")):
        for _, stage in cp.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= df.count()


def test_only_parted_characters_go_at_cuts(spark):
    raw = ("a\ufffdb é😀漢" * 3).encode()
    for begin in range(len(raw) + 1):
        for end in range(begin, len(raw) + 1):
            assert suffix_dedup.whole_run(raw[begin:end]) == raw[begin:end].decode(errors="ignore")
    docs = [(1, "p" * 10 + "é" * 30, "en", "s", 40), (2, "q\ufffd" + "é" * 30 + "\ufffdz", "en", "s", 34)]
    left = cp.repeated_passages(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()}[2] == ("q\ufffd\ufffdz", 4)


def rows_of(plan, name):
    """Rows that the Python nodes called ``name`` of an executed plan have made."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return rows_of(plan.executedPlan(), name)
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return rows_of(plan.plan(), name)
    own = plan.metrics().get("pythonNumRowsReceived").get().value() if plan.simpleString(100).startswith(f"MapInPandas {name}(") else 0
    kids = plan.children()
    return own + sum(rows_of(kids.apply(k), name) for k in range(kids.size()))


def test_periodic_texts_make_few_rows_of_repeats(spark):
    """Texts that repeat one line over and over come to more than a hash holds; their repeats are runs, not a row for each place."""
    docs = [(i, chr(65 + i) + "é-one. " * (7000 - 50 * i) + chr(65 + i), "en", "s", 0) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    left = cp.repeated_passages(spark, df, SF).select("doc_id", "text")
    got = {r.doc_id: r.text for r in left.collect()}
    assert got == {0: docs[0][1]} | {i: 2 * chr(65 + i) for i in range(1, 40)}
    plan = left._jdf.queryExecution().executedPlan()
    assert 0 < rows_of(plan, "sort") <= rows_of(plan, "_fetch") < 5000
