import random
import re

import pytest

from srcatlas.llm import licenses as L

SCHEMA = "doc_id long, text string, labels string, score int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_matches(words, template, least):
    """Common runs that can't be extended at either end, word by word."""
    out = []
    for i in range(len(words)):
        for j in range(len(template)):
            if i and j and words[i - 1] == template[j - 1]:
                continue
            n = 0
            while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                n += 1
            if n >= min(least, len(template)):
                out.append((i + n, j + n, n))
    return sorted(out)


def brute_score(words, template, least, gap):
    """The best covered share, over all chains, by plain dynamic programming."""
    found = brute_matches(words, template, least)
    best = []
    for end, at, n in found:
        own = n
        for (e, t, _), covered in zip(found, best):
            new = n - max(0, e - (end - n), t - (at - n))
            if e < end and t < at and new > 0 and end - n - e <= gap:
                own = max(own, covered + new)
        best.append(own)
    return max(best, default=0) / len(template)


def brute(doc_id, text, templates=L.TEMPLATES, phrases=L.PHRASES):
    words = split(text)
    places = [(i, label) for label, p in phrases for i in range(len(words)) if words[i : i + len(split(p))] == split(p)]
    scores = [(brute_score(words, split(t), L.LEAST, L.GAP), label) for label, t in templates]
    base = sorted({label for _, label in places})
    every = sorted({*base, *(label for x, label in scores if x >= L.COVER)})
    at = [i for i, _ in places]
    score = max([float(bool(places)), *(x for x, _ in scores if x >= L.COVER)])
    return doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every), round(min(score, 1.0), 9)


def found(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in L.scan(df).collect()), key=repr)


def made(seed):
    """Texts with whole, damaged and cut licences between words that licences use too."""
    rng = random.Random(seed)
    common = [w for _, t in L.TEMPLATES for w in split(t)] + ["neuland", "Ähre", "naïve", "x9"]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choice(common) for _ in range(rng.randint(0, 30))))
            words = rng.choice(L.TEMPLATES + L.PHRASES)[1].split(" ")
            kind = rng.randrange(4)
            if kind == 1:
                words = [w for w in words if rng.random() > 0.1]
            elif kind == 2:
                lo = rng.randrange(len(words))
                words = words[lo : lo + rng.randint(1, 40)]
            elif kind == 3:
                words = [x for w in words for x in ([w, "zwischen"] if rng.random() < 0.1 else [w])]
            parts.append(rng.choice([" ", "\n", " -- ", "  /* "]).join(words).swapcase())
        docs.append((i, rng.choice([" ", "\n", "_"]).join(parts)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs = made(seed)
    assert found(spark, docs) == sorted((brute(*d) for d in docs), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in L.query(spark, sf_dir).collect()}
    assert got == {d[0]: brute(*d) for d in docs}
    assert any(r[6] for r in got.values())


def test_odd_rows(spark):
    docs = [(None, "cc by"), (1, None), (2, ""), (3, "..."), (4, "CC-BY; cc_by"), (4, "CC-BY; cc_by"), (5, "cc by"), (6, "ALL RIGHTS\nreserved"), (7, "all rights reserved " * 3000), (8, "licensed under the apache license version " * 2000), (9, "cc cc by by")]
    got = found(spark, docs)
    want = sorted((brute(*d) for d in docs if d[0] not in (7, 8)), key=repr)
    assert [r for r in got if r[0] not in (7, 8)] == want
    by = {r[0]: r for r in got}
    assert by[7][:7] == (7, 9000, 3000, 0, 8997, "reserved", "reserved")
    assert by[8][:7] == (8, 12000, 0, None, None, "", "apache-2.0") and 0.6 <= by[8][7] < 1
    assert found(spark, []) == []


def test_matching_statistics():
    """The state's length is that of the longest run up to each word that any sequence holds."""
    rng = random.Random(5)
    for _ in range(60):
        sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))]
        a = L.Automaton(sequences)
        assert len(a.next) <= 2 * sum(map(len, sequences)) + 1
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        holds = lambda run: sorted((k, i + len(run)) for k, s in enumerate(sequences) for i in range(len(s) - len(run) + 1) if s[i : i + len(run)] == run)  # noqa: B023, E731
        for i, (state, length) in enumerate(a.stream(text)):
            want = max(n for n in range(i + 2) if not n or holds(text[i + 1 - n : i + 1]))
            assert length == want
            if length:
                assert a.ends[state] == holds(text[i + 1 - length : i + 1])
            whole = sorted(k for k, s in enumerate(sequences) if len(s) <= length and text[i + 1 - len(s) : i + 1] == s)
            assert sorted(k for k in a.whole[state] if a.sizes[k] <= length) == whole


def test_spans(spark):
    """Damaged text is one span; two copies are two; words between are left out."""
    mit = L.TEMPLATES[12][1]
    damaged = mit.replace("Permission is hereby", "Permission was hereby").replace("to deal in", "to really deal in")
    text = f"alpha beta\n{damaged}\ngamma {' delta' * 40}\n{mit}"
    (row,) = L.scan(spark.createDataFrame([(1, text, "x", 1)], SCHEMA)).collect()
    spans = [s for s in row.spans if s.template == 12]
    n = len(split(mit))
    assert [(s.label, s.end - s.start) for s in spans] == [("mit", n - 1), ("mit", n)]
    assert spans[0].start >= 2 and spans[0].end <= 3 + n + 2 and spans[1].end == row.n_words and spans[1].score == 1.0 > spans[0].score > 0.9
    assert row.labels == "mit" and row.base_labels == ""


def test_no_shuffle(spark, sf_dir):
    plan = L.query(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
