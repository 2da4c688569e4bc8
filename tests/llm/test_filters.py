import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from aerolattice.llm import decontaminate, importance, quality_rules, queries, severity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def base_counts(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check_rules(docs, got):
    wanted = sorted(repr((r.doc_id, base_counts(r.text or ""))) for r in docs.collect())
    assert wanted == sorted(repr((r.doc_id, tuple(r[k] for k in quality_rules.BASE))) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_of_odd_rows(docs, none):
    check_rules(docs, quality_rules.judge(docs).collect())
    assert quality_rules.judge(none).count() == 0


def test_rules_of_documents(spark, prose):
    check_rules(prose["documents"], queries.op6_quality_rules(spark, SF).collect())


def test_rules_keep_the_good_and_no_python_runs(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_quality_rules(spark, d)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    shares = dict(got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert shares[1] > 0.97 and shares[0] < 0.4


def test_jensen_shannon(spark):
    p, q, r = (F.array(*map(F.lit, x)) for x in ((0.5, 0.5, 0.0), (0.0, 0.0, 1.0), (0.5, 0.5, 0.0)))
    row = spark.range(1).select(quality_rules.jensen_shannon(p, q).alias("far"), quality_rules.jensen_shannon(p, r).alias("same")).first()
    assert abs(row.far - 1) < 1e-9 and row.same == 0


def test_resampling(spark, docs, none, prose):
    got = importance.resample(docs, prose["labels"])
    assert got.count() == docs.count() and {r.columns for r in got.collect()} == {"mine"}
    assert {r.log_weight for r in got.where("text is null or text = ''").collect()} == {0.0}
    twice = [r.resampling_key for r in got.where("doc_id = 5 and text like 'The%'").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert importance.resample(none, prose["labels"]).count() == 0
    assert importance.resample(docs, prose["labels"].where("false")).where("not kept").count() == 0


def plain_buckets(text):
    """Trigrams and word pairs of one text by whole numbers of Python."""
    mask = 2**64 - 1
    raw = bytes(32 if 9 <= c <= 13 else 48 if 48 <= c <= 57 else c for c in text.encode() + b" ")
    first = [(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % 2**32 >> 16 for i in range(len(raw) - 2) if raw[i : i + 2] != b"  "]
    words = []
    for w in raw.split(b" "):
        if w:
            h = sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, c in enumerate(w)) & mask
            words.append(h ^ h >> 29)
    second = []
    for a, b in zip(words, words[1:], strict=False):
        h = (a * 0xD6E8FEB86659FD93 + b) & mask
        second.append((((h ^ h >> 32) * 0x9E3779B97F4A7C15) & mask) >> 48)
    return [*first, *(x + importance.BUCKETS for x in second)]


def test_resampling_against_plain_python(spark, prose):
    """Weights, Gumbel keys and the draw, each counted anew row by row."""
    rows = [(r.doc_id, r.text or "") for r in prose["documents"].collect()] + [(900, ""), (901, "one"), (902, "a  1\t\n2 b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = {r.doc_id for r in prose["labels"].where("quality = 1").collect()}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    of_long = lambda x, seed: xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed)
    of_int = lambda x, seed: xxhash.xxh64_intdigest(int(x).to_bytes(4, "little", signed=True), seed)
    held = {i for i in good if signed(of_int(8, of_long(i, 42))) % 4 == 0}
    counts = [Counter(), Counter()]
    for i, t in rows:
        found = Counter(plain_buckets(t))
        counts[1] += found
        if i in good - held:
            counts[0] += found
    size = [[importance.BUCKETS + sum(n for b, n in c.items() if b // importance.BUCKETS == kind) for kind in (0, 1)] for c in counts]
    ratio = lambda b: math.log((counts[0][b] + 1) / size[0][b // importance.BUCKETS]) - math.log((counts[1][b] + 1) / size[1][b // importance.BUCKETS])
    weights, keys = {}, {}
    for i, t in rows:
        found = plain_buckets(t)
        weights[i] = 100 * sum(map(ratio, found)) / max(len(found), 1)
        h = signed(xxhash.xxh64_intdigest(t.encode(), of_long(i, of_int(7, 42))))
        keys[i] = weights[i] - math.log(-math.log((h % 2**52 + 0.5) / 2**52))
    level = np.percentile([weights[i] for i, _ in rows if i in held], 100 * importance.SLACK)
    kept = sorted(keys.values(), reverse=True)[sum(w >= level - 1e-9 for w in weights.values()) - 1]
    for got in (importance.scores(docs, prose["labels"]), importance.resample(docs, prose["labels"])):
        assert got.count() == len(rows)
        for r in got.collect():
            assert abs(r.log_weight - weights[r.doc_id]) < 1e-6 and abs(r.resampling_key - keys[r.doc_id]) < 1e-6
            assert r.kept == (keys[r.doc_id] >= kept - 1e-9)


def test_resampling_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels, all_docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    got = importance.resample(all_docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").join(got, "doc_id")
    shares = dict(held.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert shares[1] > 0.95 and shares[0] < 0.2


def test_threshold(spark):
    keys = spark.createDataFrame([(float(k % 50) / 7,) for k in range(500)], "key double")
    ordered = sorted((r.key for r in keys.collect()), reverse=True)
    for k in (1, 10, 11, 250, 499, 500):
        t = importance.threshold(keys, k)
        assert keys.where(F.col("key") >= t).count() == sum(x >= ordered[k - 1] for x in ordered)
    assert importance.threshold(keys, 0) == float("inf") and importance.threshold(keys.where("false"), 5) == float("inf")


def test_severity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels, all_docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    model = severity.train(all_docs, labels.where("doc_id % 2 = 0"))
    assert list(model.bounds) == sorted(model.bounds)
    held = severity.with_severity(all_docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id")
    shares = dict(held.groupBy("truth").agg(F.avg(F.col("toxic").cast("int"))).collect())
    assert shares[0] < 0.02 and shares[1] > 0.9


def test_cumulative_link_is_the_likeliest():
    """fit() against Newton's method on the same likelihood, with gradients by differences."""
    rnd = np.random.default_rng(2)
    n, v = 400, 3
    x = rnd.integers(0, 3, (n, v)).astype(float)
    score = x @ np.array([1.5, -0.7, 0.4])
    grade = (score[:, None] + rnd.logistic(size=(n, 1)) > np.array([[0.5, 2.5, 4.0]])).sum(axis=1)

    def loss(theta):
        bounds = np.concatenate([[-np.inf], theta[v] + np.concatenate([[0], np.cumsum(np.exp(theta[v + 1 :]))]), [np.inf]])
        below = lambda b, s: 1 / (1 + np.exp(np.clip(s - b, -700, 700)))
        p = [below(bounds[g + 1], s) - below(bounds[g], s) for g, s in zip(grade, x @ theta[:v], strict=True)]
        return -np.mean(np.log(p)) + severity.L2 / 2 * (theta[:v] ** 2).sum() / v

    theta, e = np.zeros(v + 3), 1e-4
    step = np.eye(len(theta)) * e
    for _ in range(12):
        slope = np.array([(loss(theta + d) - loss(theta - d)) / (2 * e) for d in step])
        curve = np.array([[(loss(theta + a + b) - loss(theta + a - b) - loss(theta - a + b) + loss(theta - a - b)) / (4 * e * e) for b in step] for a in step])
        theta = theta - np.linalg.solve(curve + 1e-6 * np.eye(len(theta)), slope)
    row, col = np.nonzero(x)
    model = severity.CumulativeLink.fit(list("abc"), row, col, x[row, col], grade, 4)
    bounds = theta[v] + np.concatenate([[0], np.cumsum(np.exp(theta[v + 1 :]))])
    assert np.abs(model.weights - theta[:v]).max() < 0.02 and np.abs(model.bounds - bounds).max() < 0.02
    texts = ["", "a", "b b", "a a a a c"]
    counts = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0], [severity.MAX_COUNT, 0, 1]])
    wanted = [[1 / (1 + math.exp(b - s)) for b in model.bounds] for s in counts @ model.weights]
    assert np.allclose(model.beyond(texts), wanted)


def test_grades_of_the_labels_are_kept(spark):
    rnd = np.random.default_rng(4)
    rows, marks = [], []
    for k in range(300):
        grade = k % 4
        words = [f"w{x}" for x in rnd.integers(0, 200, 40)] + ["bad"] * (grade > 0) + ["worse"] * (grade > 1) + ["worst"] * (grade > 2)
        rows.append((k, " ".join(words)))
        marks.append((k, grade))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = severity.with_severity(docs, severity.train(docs, labels))
    assert got.join(labels.withColumnRenamed("toxic", "truth"), "doc_id").where("grade = truth").count() == 300


def test_severity_of_odd_rows(spark, docs, none, prose):
    model = severity.train(prose["documents"], prose["labels"])
    got = severity.with_severity(docs.withColumn("toxic", F.lit("old")), model)
    assert got.count() == docs.count() and got.schema["toxic"].dataType.typeName() == "boolean"
    assert severity.with_severity(none, model).count() == 0
    flat = severity.train(none, prose["labels"])
    assert severity.with_severity(docs, flat).where("toxic").count() == 0


def held_items(text, items):
    there = decontaminate.shingles(decontaminate.words_of(text or ""))
    return {i for i, s in items.items() if s and len(s & there) / len(s) >= 0.8}


def test_leaks_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    items = {r.item_id: decontaminate.shingles(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    wanted = {(r.doc_id, i) for r in spark.read.parquet(f"{d}/documents.parquet").collect() for i in held_items(r.text, items)}
    assert {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, d).collect()} == wanted


def test_question_and_answer_apart(spark):
    question, answer = "What does the patient say about the long winter nights in town?", "Nothing at all, it seems, but then again who knows such things."
    far, other = " ".join(f"filler{k}" for k in range(400)), "A quite different answer that no item of the benchmark has."
    rows = [(1, f"{question} {far} {answer}"), (2, f"{answer} {far} {question}"), (3, f"{question} {far} {other}"), (4, f"{question} {other}"), (5, f"{far} {answer}"), (6, f"{far} {question} {answer}")]
    items = spark.createDataFrame([(7, f"{question}\n{answer}"), (8, f"Is it?\n{answer}")], "item_id long, text string")
    found = decontaminate.with_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {r.doc_id: sorted(x.item_id for x in r.leaks) for r in found} == {1: [7, 8], 2: [7, 8], 3: [], 4: [], 5: [8], 6: [7, 8]}
    assert all(x.question_overlap == x.answer_overlap == 1.0 for r in found for x in r.leaks if x.item_id == 7)


def test_small_tables_and_searched_ones_find_the_same(spark, prose, monkeypatch):
    items = [(r.item_id, r.text) for r in prose["benchmark"].collect()]
    texts = [r.text or "" for r in prose["documents"].collect()] + [f"{items[0][1]} x {items[1][1]}"]
    full = decontaminate.ItemIndex(items).matches(texts)
    monkeypatch.setattr(decontaminate, "FULL_CELLS", 0)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 500)
    assert decontaminate.ItemIndex(items).matches(texts) == full and len(full[-1]) >= 2


def test_leaks_of_odd_rows(spark, docs, none, prose):
    question = "What does the patient say about the long winter nights in town?\nNothing at all, it seems."
    other = " ".join(f"filler{k}" for k in range(500))
    rows = [(1, f"{other} {question.upper()} {other}"), (2, question.replace("winter", "summer")), (3, "say about"), (4, None), (5, f"{other} what does the patient")]
    items = spark.createDataFrame([(7, question), (8, None), (9, "..."), (10, "say about")], "item_id long, text string")
    got = {r.doc_id: sorted(x.item_id for x in r.leaks) for r in decontaminate.with_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {1: [7, 10], 2: [10], 3: [10], 4: [], 5: []}
    small = {r.doc_id: sorted(x.item_id for x in r.leaks) for r in decontaminate.with_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items, max_bytes=20).collect()}
    assert small == got
    assert decontaminate.with_leaks(docs, items).count() == docs.count() and decontaminate.with_leaks(none, items).count() == 0
    assert decontaminate.with_leaks(docs, items.where("false")).where("size(leaks) > 0").count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark, prose):
    odd = ["http://A.Example.COM/en/7?x=1", "https://example.net/de/8/a#b", "example.com/en/1", None, "", "x://", "ftp://org/es/", "http://notcom/en/", "http://com/en", "a://b://c/en/", "http://É.com/en/x"]
    pages = spark.createDataFrame(list(enumerate(odd)), "page_id long, url string").unionByName(prose["pages"].select((F.col("page_id") + 100).alias("page_id"), "url"))
    rules = {"com/en/": ("com", "/en/", "block"), "example.com/en/7": ("example.com", "/en/7", "allow"), "net/de/": ("net", "/de/", "allow"), "example.net/de/8": ("example.net", "/de/8", "block"), "org/es/": ("org", "/es/", "block")}
    got = url_filter.judge(pages.withColumn("host", F.lit("clash")))
    for r in got.collect():
        host, path = brute_url(r.url)
        assert (r.host, r.path) == (host, path)
        fits = [n for n, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=len, default=None)
        assert r.rule == best and (best is None or r.verdict == rules[best][2]) and r.verdict in ("allow", "block")
    assert url_filter.judge(pages.where("false")).count() == 0


def test_trees_judge_hosts_that_they_have_not_met(spark):
    """Labelled hosts whose blocked ones have long names of digits and hyphens; tested on other hosts."""
    rnd = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda n: "".join(rnd.choice(letters, n))
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        name = f"{word(5)}-{rnd.integers(1000, 99999)}-{word(7)}" if bad else word(rnd.integers(4, 12))
        for _ in range(3):
            path = f"/{word(4)}/{word(8)}" + (f"?{word(2)}={rnd.integers(10**6)}&{word(2)}={word(9)}&r={word(3)}" if bad and rnd.random() < 0.7 else "")
            rows.append((len(rows), f"http://{name}.{rnd.choice(['info', 'biz'] if bad and rnd.random() < 0.5 else ['info', 'eu', 'edu'])}{path}", int(bad), k % 2))
    df = spark.createDataFrame(rows, "page_id long, url string, label int, part int")
    got = url_filter.judge(df.where("part = 1"), df.where("part = 0").select("url", "label")).join(df.select("page_id", "label"), "page_id")
    shares = dict(got.groupBy("label").agg(F.avg((F.col("verdict") == "block").cast("int"))).collect())
    assert shares[1] > 0.9 and shares[0] < 0.05


def test_repeated_and_null_urls(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, None), (None, "http://a.com/x")], "page_id long, url string")
    got = url_filter.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == 4 and len({tuple(r)[1:] for r in got if r.host}) == 1


def test_trees_learn_from_labels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = url_filter.judge(pages)
    truth = url_filter.seed_labels(got).cast("boolean") == (F.col("block_probability") > 0.5)
    assert got.select(F.avg(truth.cast("int"))).first()[0] > 0.98
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
