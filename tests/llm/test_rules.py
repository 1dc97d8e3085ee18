import re
from collections import Counter

from huegraph.llm.quality_rules import document_rules, host_rates, quality_rules

from .texts import ODD

SCHEMA = "doc_id long, text string, source string, n_words string, kept string, host string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, h, "clash", "clash", "clash") for i, t, h in rows], SCHEMA)


def test_counts_equal_brute_force(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    more = ["a b c d e " * 40, "x\nx\n x\nx", "a b c d e f a b c d e", "w " * 5000, "a b c d e a b c d", "### | <b> $5 %"]
    texts = ODD + more + real
    for r in document_rules(frame(spark, [(i, t, "h") for i, t in enumerate(texts)])).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_hosts_are_shrunk_and_rejected(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "short"
    rows = [(i, good, "clean") for i in range(60)] + [(100 + i, bad, "junk") for i in range(40)] + [(200, good, "junk")]
    rows += [(300, bad, "lone"), (301, good, None), (302, None, None), (303, good, "clean"), (303, good, "clean")]
    docs = frame(spark, rows)
    rates = {r.host: (r.n, r.failed, r.rate) for r in host_rates(document_rules(docs)).collect()}
    assert set(rates) == {"clean", "junk", "lone"} and rates["lone"][:2] == (1, 1) and rates["lone"][2] < 1
    got = {r.doc_id: (r.base_failed, r.host_rejected, r.kept) for r in quality_rules(docs).collect()}
    assert got[200] == (False, True, False) and got[0] == (False, False, True)
    assert got[301] == (False, False, True) and got[302] == (True, False, False)
    assert quality_rules(docs).count() == len(rows)


def test_plan_is_native_and_empty_table_is_empty(spark):
    empty = frame(spark, [])
    assert quality_rules(empty).collect() == []
    plan = document_rules(frame(spark, [(1, "a", "h")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
