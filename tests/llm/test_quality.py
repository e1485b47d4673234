import re
from collections import Counter

from srcatlas.llm import quality
from tests.oracle import same

SCHEMA = "doc_id long, text string, source string, kept string, n_words int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


def test_query_equals_sql(spark, sf_dir):
    same(quality.query(spark, sf_dir), quality.SQL, sf_dir)


def test_counts_equal_brute_force(spark):
    texts = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "a b c d e x a b c d e y a b c d", "q " * 3000, "l1\nl1\n\n l1\nl2", "#é$ <b>|&", "x y z\x0bw", "one\ntwo\none\ntwo\n", " ".join(f"w{k % 600}" for k in range(20000))]
    df = spark.createDataFrame([(k, t, "h", "?", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(k, good, "good") for k in range(200)] + [(1000 + k, "bad", "spam") for k in range(95)] + [(2000 + k, good, "spam") for k in range(5)] + [(3000, "bad", "new"), (3001, good, "new"), (3002, good, None)]
    rows += [(5000 + 10 * h + k, good, f"h{h}") for h in range(20) for k in range(10)]
    df = spark.createDataFrame([(i, t, h, "?", 1) for i, t, h in rows], SCHEMA)
    out = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(out) == len(rows)
    assert all(out[k].kept for k in range(200)) and not any(out[2000 + k].kept for k in range(5))
    assert out[2000].base_failed is False and out[2000].host_rate > 0.5
    assert out[3001].kept and out[3001].host_rate < 0.5 and out[3002].kept  # one failure of two is shrunk
    assert quality.judge(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = quality.query(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
