import re
from collections import Counter

from pyspark.sql import functions as F

from llm_helpers import documents, empty, odd_texts, prose
from watchspan.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_plain_counting(spark):
    texts = odd_texts() | {20: "a b c d e a b c d e", 21: "x\nx\n \nx", 22: "a a a a a a", 23: "l\r\nl\r\nl"}
    got = quality.text_stats(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected(texts[r.doc_id]), r.doc_id


def test_learns_a_readable_rule_and_keeps_good_rows(spark):
    rows = [(k, float(k % 50), float(k % 7), k % 50 >= 40) for k in range(600)]
    learned = quality.learn(spark.createDataFrame(rows, "key long, a double, b double, bad boolean"), ["a", "b"])
    assert [str(c) for c in learned.rules[0].conditions] == ["a >= 40"]
    of = {"a": F.col("a"), "b": F.col("b")}
    got = spark.createDataFrame(rows, "key long, a double, b double, bad boolean").select("bad", learned.rejects(of).alias("out")).collect()
    assert all(r.bad == r.out for r in got)


def test_without_labels_nothing_is_rejected(spark):
    none = spark.createDataFrame([], "key long, a double, bad boolean")
    assert quality.learn(none, ["a"]).rules == ()
    good = spark.createDataFrame([(1, 1.0, False)], "key long, a double, bad boolean")
    assert quality.learn(good, ["a"]).rules == ()


def test_stage_keeps_columns_and_repeated_rows(spark):
    texts = [(k, prose(k, 50)) for k in range(60)] + [(5, prose(5, 50)), (None, prose(99, 40)), (70, ""), (71, None)]
    texts += [(100 + k, "# $ % ".join(prose(k, 40).split(" "))) for k in range(60)]
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(60)] + [(100, 0), (3, None)], "doc_id long, quality int")
    docs = documents(spark, texts)
    got = quality.keep_good(docs, labels)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted([(False, k) for k in range(60)] + [(False, 5), (True, 0)])
    assert quality.keep_good(empty(spark), labels).count() == 0
