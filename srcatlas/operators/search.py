"""Ranked full-text search over files, symbols and texts, all in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import glob
from srcatlas.functions import query as Q
from srcatlas.functions.text import let, tokens
from srcatlas.operators.lookup import page
from srcatlas.plans.schema import Index, max_level

LIMIT = 10
WEIGHTS = {"name": 3, "file": 2, "content": 1}
K1, B = 1.2, 0.75
BOOST = 1000.0  # of an exact name
RESULT = ["type", "project", "file", "name", "kind", "line_start", "line_end", "parent", "text", "score"]


def search_docs(ix: Index) -> DataFrame:
    """One searchable row for each file, symbol and text: UNION ALL of three projections."""
    none = F.lit(None)
    files = ix.files.select(F.lit("file").alias("type"), "project", F.col("path").alias("file"), F.coalesce("title", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("content"), F.col("lang").alias("kind"), F.lit(0).alias("visibility_level"), none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), none.cast("string").alias("parent"), none.cast("string").alias("text"))
    symbols = ix.symbols.select(F.lit("symbol").alias("type"), "project", "file", "name", F.concat(F.col("kind"), F.lit(" "), F.coalesce("tokens", F.lit(""))).alias("content"), "kind", "visibility_level", "line_start", "line_end", "parent", none.cast("string").alias("text"))
    texts = ix.texts.select(F.lit("text").alias("type"), "project", "file", F.lit("").alias("name"), F.coalesce("text", F.lit("")).alias("content"), "kind", F.lit(0).alias("visibility_level"), "line_start", "line_end", "parent", "text")
    return files.unionByName(symbols).unionByName(texts)


def tokenized(docs: DataFrame) -> DataFrame:
    """Adds a token array for each searched column, and their total length."""
    out = docs.withColumns({f"{c}_t": tokens(F.col(c)) for c in Q.COLUMNS})
    return out.withColumn("n_tokens", F.size("name_t") + F.size("file_t") + F.size("content_t"))


def _hits(p: Q.Phrase, column: str) -> Column:
    """Positions at which a phrase begins in a column."""
    k, none = len(p.tokens), F.array().cast("array<int>")
    column_t = F.col(f"{column}_t")

    def test(word: Column, j: int) -> Column:
        return F.startswith(word, F.lit(p.tokens[j])) if p.prefix and j == k - 1 else word == p.tokens[j]

    def stands(t: Column, i: Column) -> Column:
        out = test(F.get(t, i), 0)
        for j in range(1, k):
            out = out & test(F.get(t, i + j), j)
        return out

    if not k or column not in p.columns:
        return none
    if p.initial:
        return F.when(F.coalesce(stands(column_t, F.lit(0)), F.lit(False)), F.array(F.lit(0))).otherwise(none)
    first = F.filter(F.transform(column_t, lambda w, i: F.when(test(w, 0), i)), lambda i: i.isNotNull())
    # Only places of the first token are looked at further.
    return first if k == 1 else let(column_t, lambda t: F.filter(first, lambda i: stands(t, i)))


def _near_hits(near: Q.Near, hits: list[Column]) -> list[Column]:
    """Each phrase's positions (of all its `hits`) inside some neighbourhood that holds all phrases."""

    def inside(i: int, m: Column):
        back = len(near.phrases[i].tokens) + near.distance
        return lambda p: (p <= m) & (p >= m - back)

    def full(m: Column) -> Column:
        out = F.lit(True)
        for i, h in enumerate(hits):
            out = out & F.exists(h, inside(i, m))
        return out

    def held(i: int, ends: Column):
        back = len(near.phrases[i].tokens) + near.distance
        return lambda p: F.exists(ends, lambda m: (p <= m) & (p >= m - back))

    ends = F.filter(F.flatten(F.array(*hits)), full)
    return [F.filter(h, held(i, ends)) for i, h in enumerate(hits)]


def weight(n: Column, having: Column) -> Column:
    """The inverse document frequency, which stays above 0."""
    idf = F.log((n - having + 0.5) / (having + 0.5))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)


def saturation(f: Column, n_tokens: Column, mean: Column) -> Column:
    """What a frequency counts for in a row of some tokens: more for a greater frequency, less for a longer row."""
    return (f * (K1 + 1)) / (f + K1 * (1 - B + B * n_tokens / mean))


class Compiled:
    """A query as Column expressions: does a row match, and each phrase's weighted frequency under its guard.

    `hits` gives the positions of a phrase in a column: by default from token arrays, or from position lists.
    """

    def __init__(self, query: str, hits: Callable[[Q.Phrase, str], Column] = _hits) -> None:
        self.tree, self.hits = Q.parse(query), hits
        self.phrases: list[Q.Phrase] = []
        self.raw: list[Column] = []  # frequency of each phrase, neighbourhoods aside, for its document frequency
        self.scored: list[tuple[int, Column, Column]] = []  # (phrase, guard, frequency)
        self.columns: dict[str, Column] = {}
        self.matches = self._compile(self.tree, F.lit(True), True)

    def score(self, n: Column, mean: Column, having: list[Column]) -> Column:
        """BM25 of a row, the best lowest: of n rows with `mean` tokens, in which each phrase stands in `having` rows."""
        total = F.lit(0.0)
        for i, guard, f in self.scored:
            part = weight(n, having[i]) * saturation(f, F.col("n_tokens"), mean)
            total = total - F.when(guard, part).otherwise(0.0)
        return total

    def _keep(self, expression: Column) -> Column:
        name = f"__e{len(self.columns)}"
        self.columns[name] = expression
        return F.col(name)

    def _weighted(self, sizes: dict[str, Column]) -> Column:
        out = F.lit(0)
        for c, n in sizes.items():
            out = out + n * WEIGHTS[c]
        return out

    def _frequency(self, p: Q.Phrase) -> Column:
        return self._keep(self._weighted({c: F.size(self.hits(p, c)) for c in p.columns}))

    def _compile(self, node, guard: Column, scored: bool) -> Column:
        """The row's match of a node; phrases count only if every expression around them matches, and never right of NOT."""
        todo: list[tuple[object, Column]] = []

        def match(n) -> Column:
            if isinstance(n, Q.Phrase):
                if not n.tokens:
                    return F.lit(False)
                f = self._frequency(n)
                leaf[id(n)] = [(n, f, f)]
                return f > 0
            if isinstance(n, Q.Near):
                raw = [self._frequency(p) for p in n.phrases]
                inside = {c: _near_hits(n, [self.hits(p, c) for p in n.phrases]) for c in Q.COLUMNS if all(c in p.columns for p in n.phrases)}
                own = [self._keep(self._weighted({c: F.size(h[i]) for c, h in inside.items()})) for i in range(len(raw))]
                leaf[id(n)] = list(zip(n.phrases, raw, own, strict=True))
                return own[0] > 0
            if isinstance(n, Q.Not):
                keep, drop = match(n.keep), match(n.drop)
                done[id(n)] = keep & ~drop
                return done[id(n)]
            out = None
            for p in n.parts:
                m = match(p)
                done[id(p)] = m
                out = m if out is None else (out & m if isinstance(n, Q.And) else out | m)
            done[id(n)] = out
            return out

        leaf: dict[int, list[tuple[Q.Phrase, Column, Column]]] = {}
        done: dict[int, Column] = {}
        whole = match(node)
        done[id(node)] = whole
        todo.append((node, whole))
        while todo:
            n, g = todo.pop(0)
            if isinstance(n, (Q.Phrase, Q.Near)):
                for phrase, raw, own in leaf.get(id(n), []):
                    self.phrases.append(phrase)
                    self.raw.append(raw)
                    self.scored.append((len(self.raw) - 1, g, own))
            elif isinstance(n, Q.Not):
                todo.append((n.keep, g))
            else:
                todo += [(p, g & done[id(p)]) for p in n.parts]
        return whole


def exact_word(query: str) -> str:
    """The word that a name may equal."""
    return (query.split() or [""])[0].lower()


def tie_order() -> list[Column]:
    """The order of rows with the same score."""
    return [F.length("name"), *map(F.col, ("type", "project", "file", "line_start", "line_end", "kind", "name", "content", "parent"))]


def _kinds(values: list[str] | None) -> list[str]:
    return [v for v in values or [] if v]


def search(ix: Index, query: str, scope: list[str] | None = None, kind: list[str] | None = None, path: str | None = None, project: str | None = None, visibility: str | None = "public", limit: int | None = LIMIT, offset: int = 0, docs: DataFrame | None = None) -> DataFrame:
    """The best rows for a query, by BM25 with column weights, then shorter names.

    An exact name match (of the query's first word) comes first. The statistics (rows,
    mean length, rows with a phrase) are those of the whole index: filters come after
    them. `docs` may be a tokenized table that the caller keeps. This reads and tokenizes the
    whole corpus; operators.postings answers from stored lists.
    """
    compiled = Compiled(query)
    rows = (docs if docs is not None else tokenized(search_docs(ix))).withColumns(compiled.columns)
    counts = [F.sum(F.when(f > 0, 1).otherwise(0)).alias(f"n{i}") for i, f in enumerate(compiled.raw)]
    stats = rows.agg(*counts, F.count(F.lit(1)).alias("__n"), F.avg("n_tokens").alias("__avg"))  # one row
    found = rows.filter(compiled.matches)
    if _kinds(scope):
        found = found.filter(F.col("type").isin(_kinds(scope)))
    if _kinds(kind):
        found = found.filter(F.col("kind").isin(_kinds(kind)))
    if path:
        found = found.filter(glob.matches(F.col("file"), path) if "*" in path else F.col("file") == path)
    if project is not None:
        found = found.filter(F.col("project") == project)
    level = max_level(visibility, "public")
    if level is not None:
        found = found.filter(F.col("visibility_level") <= level)
    found = found.join(F.broadcast(stats))
    total = compiled.score(F.col("__n"), F.col("__avg"), [F.col(f"n{i}") for i in range(len(compiled.raw))])
    score = F.round(total + F.when(F.lower("name") == exact_word(query), -BOOST).otherwise(0.0), 6)
    ranked = found.withColumn("score", score).orderBy("score", *tie_order())
    return page(ranked.select(*RESULT), limit, offset)


def token_stats(ix: Index) -> DataFrame:
    """Rows with each token, and how often it occurs."""
    docs = tokenized(search_docs(ix))
    spread = docs.select(F.explode(F.array_distinct(F.concat("name_t", "file_t", "content_t"))).alias("token"))
    return spread.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def index_stats(ix: Index) -> DataFrame:
    docs = tokenized(search_docs(ix))
    return docs.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").cast("long").alias("n_tokens"))
