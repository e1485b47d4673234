import hashlib
import json
import random
from collections import defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from srcatlas.llm import align as A

SCHEMA = "doc_id long, text string, n_a string, pair int"
PATHS = A.default_paths()


@pytest.fixture(scope="module")
def plain():
    """Whole texts by both libraries, and the tokens' bytes, apart from the module."""
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[chr(b)] = b
        else:
            letters[chr(256 + n)] = b
            n += 1
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def a_tokens(text):
        return [(i, bytes(letters[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def b_tokens(text):
        out = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            out.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return out

    return a_tokens, b_tokens


def ranges(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(docs, plain):
    found, seen = [], defaultdict(int)
    for _, text in docs:
        a, b = ([], []) if not text else (plain[0](text), plain[1](text))
        if text and any(b"".join(raw for _, raw in t) != (" " + text).encode() for t in (a, b)):
            a, b = [], []
        a, b = ranges(a), ranges(b)
        links = [(x, y) for x, lo, hi in a for y, lo2, hi2 in b if lo < hi2 and lo2 < hi]
        for p in set(links):
            seen[p] += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, lo, hi in t if start <= lo and hi <= c) for t in (a, b)))
            start = c
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    return sorted(((i, na, nb, ng, len(links), sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links), text) for (i, _), (na, nb, ng, links, text) in zip(docs, found, strict=True)), key=repr)


def got(spark, docs, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    return sorted(map(tuple, A.align(df, *PATHS, **options).collect()), key=repr)


ODD = ["", None, " ", "  ", "a", " a", "a ", "  a   b  ", "a\n b", "a\n  b", "a \n b", "x  y", "x  y", "a\x1c b", "▁ a▁b", "<s> x </s> <|endoftext|> <unk> <0x41>", "日本語 テキスト", "👩‍👩‍👧 flags 🇩🇪", "naïve é cafe", "ﬁ ① ½", "don't we'll 12345 3.14", "\t\ttabs\tand\r\nlines", "Z" * 500, "a" + " " * 40 + "b", "Ǆ ß İ", "\x00 null \x00", "ab" * 3000 + " tail"]


def test_equals_brute_force(spark, plain):
    rng = random.Random(3)
    alphabet = [" ", " ", " ", "\n", "\t", "a", "b", "the", "ing", "é", "日", "▁", "'s", "12", ".", " ", "👍", "Ünï", "́"]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(i + 100, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(5, "a"), (5, "a"), (None, "the end of it"), (None, None)]
    assert got(spark, docs) == brute(docs, plain)


def test_small_batches_and_chunks(spark, plain, monkeypatch):
    monkeypatch.setattr(A, "BATCH_BYTES", 50)
    monkeypatch.setattr(A, "CHUNK_BYTES", 120)
    docs = [(i, f"the end of the {i} lines, naïve {'word ' * (i % 7)}") for i in range(60)] + [(99, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    chunks = A.aligned(df, *PATHS, groups="text").count()
    assert chunks >= 4
    assert got(spark, docs) == brute(docs, plain)


def test_query_equals_brute_force(spark, sf_dir, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_by_range(docs, plain)
    rows = A.query(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, rows.collect()), key=repr) == want


def brute_by_range(docs, plain):
    """As brute, with links found by walking both lists; the quadratic form takes too long on whole tables."""
    seen, kept = defaultdict(int), []
    for i, text in docs:
        a, b = (ranges(plain[0](text)), ranges(plain[1](text))) if text else ([], [])
        links, j = [], 0
        for x, lo, hi in a:
            while j and b[j - 1][2] > lo:
                j -= 1
            while b[j][2] <= lo:
                j += 1
            while j < len(b) and b[j][1] < hi:
                links.append((x, b[j][0]))
                j += 1
        groups, own_a, own_b, k = [], [], [], 0
        ends = {e for *_, e in b}
        for x, _, hi in a:
            own_a.append(str(x))
            if hi in ends:
                while k < len(b) and b[k][2] <= hi:
                    own_b.append(str(b[k][0]))
                    k += 1
                groups.append(f"{','.join(own_a)}|{','.join(own_b)}")
                own_a, own_b = [], []
        for p in set(links):
            seen[p] += 1
        kept.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    return sorted(((i, na, nb, ng, len(links), sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links), g) for i, na, nb, ng, links, g in kept), key=repr)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.fixture(scope="module")
def tokens():
    with open(PATHS[0], encoding="utf-8") as f, open(PATHS[1], "rb") as g:
        return A.ByteTokens(f.read()), A.PieceTokens(g.read())


def test_cuts_change_nothing(tokens):
    """Texts cut as often as they can be are encoded as whole ones."""
    rng = random.Random(4)
    alphabet = [" ", " ", " ", "\n", "\t", "a", "b", "the", "ing", "é", "日", "▁", "'s", "12", ".", "\u00a0", "\x1c", "\u2028", "\u200b", "👍", "Ünï", "\u0301"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for t in ODD]
    fine, whole = A.Pair(*tokens, part=1), A.Pair(*tokens)
    assert fine.encode(texts) == whole.encode(texts)
    assert max(len(A.parts_of(t, 1)) for t in texts) > 5
    for t in texts:
        assert " ".join(A.parts_of(t, 3)) == t


def test_both_libraries_agree(tokens, plain):
    """Ids by rank are those of the vocabulary's own library; long runs too."""
    a, _ = tokens
    rng = random.Random(6)
    texts = [t for t in ODD if t] + ["".join(chr(rng.choice([*range(32, 127), *range(0xA0, 0x250), 0x2028, 0x3042, 0x1F600])) for _ in range(80)) for _ in range(400)]
    texts += ["Z" * 30_000, " " * 30_000 + "x", "ab1'll" * 5000, "\n" * 20_000]
    assert a.fast is not None
    assert a.encode(texts) == [a.slow(f" {t}") for t in texts]
