import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tagweave.llm import quality_rules as Q
from tests.llm.conftest import ODD


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


TEXTS = [
    "a b c d e f g h " * 3, "a " * 30, "x y z\nx y z\n \n \nx y z", "# $ % |<> a\x0bb", "one two three four five six seven eight nine "
    "one two three four five six seven eight ten", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "w " * 20_000,
    " ".join(map(str, range(20_000))), "a b c d e f g X a b c d Y e f g",
]


def test_measures(spark, documents):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(TEXTS))]
    got = Q.measures(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for i, t in rows if i == r["doc_id"]]
        assert brute(texts[0]) == {k: r[k] for k in brute("")}, r["doc_id"]


def test_binomial_tail(spark):
    rows = [(10, 0), (10, 3), (1000, 4), (100_000, 900), (5, 5), (0, 0)]
    df = spark.createDataFrame(rows, "n BIGINT, k BIGINT")
    for r in df.select("n", "k", Q.tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        n, k = r["n"], r["k"]
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        want = sum(math.exp(log(i) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))
        assert r["p"] is None if k > n * 0.01 else abs(r["p"] - want) < 1e-9 * want + 1e-15


def test_cutoffs_need_proof_and_spare_good_documents(spark, documents, labels):
    good = lambda i: " ".join(f"w{i * 31 + j}" for j in range(25))
    bad = lambda i: " ".join(f"w{i * 31 + j}%" for j in range(25))
    rows = [(i, bad(i) if i % 10 == 0 else good(i)) for i in range(1500)]
    marks = [(i, int(i % 10 != 0), 0) for i in range(1500)]
    out = Q.judged(documents(rows), labels(marks))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] == (i % 10 != 0) for i in range(1500))
    few = Q.judged(documents(rows[:300]), labels(marks[:300]))
    assert all(r["kept"] for r in few.collect())  # too few labels prove nothing
    rows_kept = Q.kept_rows(documents(rows), labels(marks))
    assert rows_kept.count() == 1350 and rows_kept.columns == documents([]).columns


def test_odd_rows_and_no_labels(spark, documents, labels):
    out = Q.judged(documents(ODD), labels([(4, None, 1), (None, 1, 0)])).collect()
    assert len(out) == len(ODD) and not any(r["kept"] for r in out)  # all short or repeating themselves
    assert Q.judged(documents([]), labels([])).collect() == []
