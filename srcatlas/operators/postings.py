"""Full-text search over stored postings, which change with the index.

Terms stand in blocks of rows: for each term and block of 2**`block_bits` rows one posting,
with the positions of the term in each column of each of its rows, and with what is the most
and the least in the block, so that a block that can't reach the best k is never opened. A
posting also serves as a filter: names, projects, kinds and files are terms of their own, which
begin with a mark that no token holds. Postings lie sorted by term, in ranges; a word or a prefix
reads the ranges it falls into. A dictionary has the number of rows of each term, so that most
queries know their statistics before they open a list.

A query goes from block bounds to row scores to rows: the bounds of all blocks come from the
postings' small columns; the blocks with the greatest bounds give a score that the best k reach
at least; those blocks that can reach it are scored exactly, by positions alone; and the rows of
the best k are read, no others. Scores equal those of a scan.

Rows come in segments. Each maintenance step adds one segment of new rows and marks the old rows
of the same files as deleted; statistics are sums over segments, less what was deleted. Rows are
numbered in the order of ties, so the best of a segment are known without their columns.
Segments of like size are merged when there are too many of them.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcatlas.functions import glob
from srcatlas.functions import query as Q
from srcatlas.functions.text import folded
from srcatlas.operators import inverted
from srcatlas.operators import search as S
from srcatlas.operators.lookup import page
from srcatlas.plans.schema import Index, max_level

BLOCK_BITS = 10
#: Blocks that are opened first, for a score to prune by.
FIRST = 32
#: A best-k list up to so many rows goes through the driver as row numbers; a longer one is joined.
LISTED = 2000
#: Segments of one size class that may stand side by side, and the classes' powers.
TIER = 8
#: What a rounded score may differ from its bound by.
SLACK = 1e-5
#: MB of stored rows that one task sorts and makes lists of, about: the rows with the longest names stand in the last range.
RANGE_MB = 4
SPLITS = "spark.sql.files.minPartitionNum"
NAME, PROJECT, KIND, FILE = "\x01n", "\x01p", "\x01k", "\x01f"
TYPES = ["file", "symbol", "text"]
MASKS = range(1, 1 << len(Q.COLUMNS))
RESULT = "type string, project string, file string, name string, kind string, line_start int, line_end int, parent string, text string, score double"
ROWS = "row long, type string, project string, file string, name string, content string, kind string, visibility_level int, line_start int, line_end int, parent string, text string, segment int"
ENTRY = "segment int, block long, term string, off int, n_tokens int, type int, level int, name array<int>, file array<int>, content array<int>"
POSTINGS = "term string, block long, name_n int, file_n int, content_n int, least int, entries binary, segment int, part int"
TERMS = ", ".join(["term string", *(f"m{m} long" for m in MASKS), "step int", "segment int"])
SEGMENTS = "step int, segment int, n long, n_tokens long, replaces array<int>"
DELETES = "step int, segment int, row long"
RANGES = "low string, high string, part int, segment int"


class _Slots:
    """The terms that a query asks for, and the positions of its phrases in the lists of these terms."""

    def __init__(self) -> None:
        self.terms: dict[tuple[str, bool], int] = {}

    def of(self, p: Q.Phrase) -> list[int]:
        return [self.terms.setdefault((t, p.prefix and j == len(p.tokens) - 1), len(self.terms)) for j, t in enumerate(p.tokens)]

    def hits(self, p: Q.Phrase, column: str) -> Column:
        """Positions at which a phrase begins: its tokens' lists, each moved to the first one's place, have them in common."""
        if not p.tokens or column not in p.columns:
            return F.array().cast("array<int>")
        lists = [F.col(f"s{k}_{column}") for k in self.of(p)]
        out = lists[0]
        for j, x in enumerate(lists[1:], 1):
            out = F.array_intersect(out, F.transform(x, lambda at: at - j))  # noqa: B023
        return F.filter(out, lambda at: at == 0) if p.initial else out

    def test(self, k: int) -> Column:
        (term, prefix) = next(t for t, i in self.terms.items() if i == k)
        return F.col("term").startswith(term) if prefix else F.col("term") == term

    def most(self, p: Q.Phrase) -> Column:
        """No row of a block has a greater weighted frequency of a phrase."""
        slots = self.of(p)
        out = F.lit(0)
        for c in p.columns:
            each = [F.col(f"b{k}_{c}") for k in slots]
            least = each[0] if len(each) == 1 else F.least(*each)
            out = out + S.WEIGHTS[c] * (F.least(least, F.lit(1)) if p.initial else least)
        return out

    def possible(self, node) -> Column:
        """May a row of a block match?"""
        if isinstance(node, Q.Phrase):
            return self.most(node) > 0 if node.tokens else F.lit(False)
        if isinstance(node, Q.Not):
            return self.possible(node.keep)
        parts = [self.possible(p) for p in (node.phrases if isinstance(node, Q.Near) else node.parts)]
        out = parts[0]
        for p in parts[1:]:
            out = out | p if isinstance(node, Q.Or) else out & p
        return out


class _Filters:
    """Conditions on rows: some as terms with lists of their own, some on what postings carry."""

    def __init__(self, scope, kind, path, project, visibility) -> None:
        self.lists: dict[str, Column] = {}
        if kind:
            self.lists["kind"] = F.col("term").isin([KIND + k for k in kind])
        if project is not None:
            self.lists["project"] = F.col("term") == PROJECT + project
        if path:
            whole = F.col("term") == FILE + path
            self.lists["path"] = F.col("term").startswith(FILE + path.split("*")[0].split("?")[0].split("[")[0]) & glob.matches(F.substring("term", 3, 1 << 30), path) if "*" in path else whole
        self.ranges = [KIND + k for k in kind or []] + ([PROJECT + project] if project is not None else [])
        self.prefixes = [FILE + path.split("*")[0].split("?")[0].split("[")[0]] if path and "*" in path else []
        self.ranges += [FILE + path] if path and "*" not in path else []
        self.scope, self.level = [TYPES.index(t) for t in scope or [] if t in TYPES] if scope else None, max_level(visibility, "public")

    def passes(self) -> Column:
        out = F.lit(True)
        for name in self.lists:
            out = out & F.col(f"has_{name}")
        if self.scope is not None:
            out = out & F.col("type").isin(self.scope)
        return out & (F.col("level") <= self.level) if self.level is not None else out


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str, block_bits: int = BLOCK_BITS, first: int = FIRST) -> None:
        self.spark, self.path, self.block_bits, self.first = spark, path.rstrip("/"), block_bits, first

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    # Segments.
    def _live(self) -> tuple[int, dict[int, tuple[int, int]]]:
        """The last step, and rows and tokens of each segment that counts. One row for each change of a segment."""
        rows = self._read("segments", SEGMENTS).collect()
        gone = {s for r in rows for s in r.replaces}
        sizes: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for r in rows:
            if r.segment not in gone:
                sizes[r.segment][0] += r.n
                sizes[r.segment][1] += r.n_tokens
        return max((r.step for r in rows), default=0), {s: (n, t) for s, (n, t) in sizes.items()}

    def _publish(self, rows: list[tuple]) -> None:
        """From here on a step counts."""
        self.spark.createDataFrame(rows, SEGMENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def _deletes(self, step: int, segments: list[int]) -> DataFrame:
        return self._read("deletes", DELETES).filter((F.col("step") <= step) & F.col("segment").isin(segments)).select("segment", "row")

    def rows(self) -> DataFrame:
        """All rows that count."""
        step, live = self._live()
        rows = self._read("rows", ROWS).filter(F.col("segment").isin(list(live)))
        return rows.join(self._deletes(step, list(live)), ["segment", "row"], "left_anti")

    def build(self, ix: Index) -> None:
        """One segment of all rows of an index, instead of what there was."""
        step, live = self._live()
        self._add(step + 1, S.search_docs(ix), sorted(live))

    def upsert(self, new: Index) -> None:
        """Replace all rows of the files in `new`."""
        self.apply(new.files.select("project", "path"), new)

    def delete(self, files: DataFrame) -> None:
        """Drop all rows of the files (project, path)."""
        self.apply(files, None)

    def apply(self, gone: DataFrame, new: Index | None) -> None:
        """One step: rows of the files `gone` (project, path) are marked, and the rows of `new` become a segment."""
        step, live = self._live()
        keys = gone.select("project", F.col("path").alias("file")).distinct()
        marked = self.rows().join(keys, ["project", "file"], "left_semi")
        path = f"{self.path}/tmp-{uuid.uuid4().hex}"
        marked.write.parquet(path)
        marked = self.spark.read.schema(ROWS).parquet(path)
        marked.select(F.lit(step + 1).alias("step"), "segment", "row").write.mode("append").parquet(f"{self.path}/deletes")
        counts = ", ".join(["term string", *(f"m{m} long" for m in MASKS), "segment int"])
        self._texts(marked, ["segment"]).mapInArrow(inverted.sized_counts, counts).write.option("compression", "zstd").parquet(f"{path}-held")
        held = self.spark.read.schema(counts).parquet(f"{path}-held")
        less = held.filter(F.col("term") == inverted.SIZE).groupBy("segment").agg(F.sum("m1").alias("n"), F.sum("m2").alias("t")).collect()
        if less:
            counted = held.filter(F.col("term") != inverted.SIZE).groupBy("term", "segment").agg(*((-F.sum(f"m{m}")).alias(f"m{m}") for m in MASKS))
            counted.withColumn("step", F.lit(step + 1)).select(*TERMS_ORDER, "segment").write.mode("append").partitionBy("segment").parquet(f"{self.path}/terms")
        changes = [(step + 1, r.segment, -r.n, -r.t, []) for r in less]
        if new is not None:
            self._add(step + 1, S.search_docs(new), [], changes)
        elif changes:
            self._publish(changes)
        self._drop(path)
        self._drop(f"{path}-held")

    def compact(self, most: int = TIER) -> bool:
        """Merge the segments of a size class (of like powers of TIER) that holds more than `most` of them; whether there was one."""
        step, live = self._live()
        classes: dict[int, list[int]] = defaultdict(list)
        for segment, (n, _) in live.items():
            size = 0
            while n >= TIER ** (size + 1):
                size += 1
            classes[size].append(segment)
        full = [s for segments in classes.values() if len(segments) > most for s in segments]
        if not full:
            return False
        self._add(step + 1, self.rows().filter(F.col("segment").isin(full)).drop("segment", "row"), full)
        return True

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _drop(self, path: str) -> None:
        folder, fs = self._folder(path)
        fs.delete(folder, True)

    # Writing a segment.
    def _texts(self, rows: DataFrame, keep: list[str | Column]) -> DataFrame:
        """The folded text of each column, and an array of the terms by which rows are filtered."""
        fields = [F.concat(F.lit(mark), value) for mark, value in ((NAME, F.lower("name")), (PROJECT, F.col("project")), (KIND, F.col("kind")), (FILE, F.col("file")))]
        return rows.select(*keep, F.array_compact(F.array(*fields)).alias(inverted.MARKS), *(folded(F.col(c)).alias(f"{c}_t") for c in Q.COLUMNS))

    def _add(self, step: int, docs: DataFrame, replaces: list[int], changes: list[tuple] = ()) -> None:
        """Write rows as a segment and let it count, instead of those that it replaces."""
        segment = max((r.segment for r in self._read("segments", SEGMENTS).select("segment").distinct().collect()), default=0) + 1
        at = f"segment={segment}"
        names = [x.split()[0] for x in ROWS.split(", ")][:-1]
        unsorted = f"{self.path}/tmp-{uuid.uuid4().hex}"  # else the ranges' sample would make it all twice
        docs.select(*names[1:]).write.option("compression", "zstd").parquet(unsorted)
        folder, fs = self._folder(unsorted)
        mb = fs.getContentSummary(folder).getLength() >> 20
        ranges = 1 + max(mb // RANGE_MB, min(mb, 3 * self.spark.sparkContext.defaultParallelism))
        docs = self.spark.read.schema(docs.select(*names[1:]).schema).parquet(unsorted)
        sorted_docs = docs.repartitionByRange(ranges, *S.tie_order()).sortWithinPartitions(*S.tie_order())
        kept = sorted_docs.withColumn("row", F.monotonically_increasing_id())
        kept.select(*names).write.option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/rows/{at}")  # from here on the numbers stand
        self._drop(unsorted)
        rows = self.spark.read.schema(ROWS.rsplit(", ", 1)[0]).parquet(f"{self.path}/rows/{at}")
        kind = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")).cast("int") - 1
        batches = self._texts(rows, ["row", kind.alias("type"), F.col("visibility_level").alias("level")])
        # A task reads rows by their numbers and so whole blocks: their lists are made there.
        blocks = batches.mapInArrow(inverted.sized(self.block_bits), f"{POSTINGS.rsplit(', ', 2)[0]}, {', '.join(f'm{m} long' for m in MASKS)}")
        scratch = f"{self.path}/tmp-{uuid.uuid4().hex}"  # else the range's sample would make it all twice
        least = self.spark.conf.get(SPLITS, None)
        self.spark.conf.set(SPLITS, str(ranges))  # a range a task: rows with long names, which stand last, would meet in one
        try:
            blocks.write.option("compression", "zstd").parquet(scratch)
        finally:
            self.spark.conf.set(SPLITS, least) if least is not None else self.spark.conf.unset(SPLITS)
        made = self.spark.read.schema(blocks.schema).parquet(scratch)
        size = made.filter(F.col("term") == inverted.SIZE).agg(F.sum("m1").alias("n"), F.sum("m2").alias("t")).first()
        blocks = made.filter(F.col("term") != inverted.SIZE)
        ranged = blocks.drop(*(f"m{m}" for m in MASKS)).repartitionByRange("term", "block").withColumn("part", F.spark_partition_id())
        ranged.sortWithinPartitions("part", "term", "block").write.option("compression", "zstd").mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/{at}")
        terms = blocks.groupBy("term").agg(*(F.sum(f"m{m}").alias(f"m{m}") for m in MASKS)).withColumn("step", F.lit(step))
        terms.repartitionByRange("term").sortWithinPartitions("term").select(*TERMS_ORDER).write.mode("overwrite").parquet(f"{self.path}/terms/{at}")
        parts = self.spark.read.schema(POSTINGS.replace(", segment int", "")).parquet(f"{self.path}/postings/{at}").groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high"))
        parts.select("low", "high", "part").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ranges/{at}")
        self._drop(scratch)
        self._publish([(step, segment, size.n or 0, size.t or 0, replaces), *changes])

    # Reading.
    def lists(self, terms: list[str], prefixes: list[str], test: Column, live: list[int]) -> DataFrame:
        """Postings of some terms: their ranges' folders, and of those the terms' row groups."""
        def held(r) -> bool:
            return any(r.low <= t <= r.high for t in terms) or any(r.low[: len(p)] <= p <= r.high[: len(p)] for p in prefixes)

        folders = [(r.segment, r.part) for r in self._read("ranges", RANGES).filter(F.col("segment").isin(live)).collect() if held(r)]
        parts: dict[int, list[int]] = defaultdict(list)
        for segment, part in folders:
            parts[segment].append(part)
        where = F.lit(False)
        for segment, own in sorted(parts.items()):
            where = where | ((F.col("segment") == segment) & F.col("part").isin(sorted(own)))
        return self._read("postings", POSTINGS).filter(where & test)

    def having(self, terms: list[str], live: list[int], step: int) -> dict[str, dict[int, int]]:
        """For each term the rows that hold it, by the columns they hold it in."""
        found = self._read("terms", TERMS).filter(F.col("segment").isin(live) & (F.col("step") <= step) & F.col("term").isin(terms))
        sums = found.groupBy("term").agg(*(F.sum(f"m{m}").alias(f"m{m}") for m in MASKS)).collect()
        return {r.term: {m: r[f"m{m}"] for m in MASKS} for r in sums}

    def token_stats(self) -> DataFrame:
        """Rows with each token, from the dictionary: sums over segments, less what was deleted."""
        step, live = self._live()
        found = self._read("terms", TERMS).filter(F.col("segment").isin(sorted(live)) & (F.col("step") <= step))
        total = F.lit(0)
        for m in MASKS:
            total = total + F.col(f"m{m}")
        return found.groupBy(F.col("term").alias("token")).agg(F.sum(total).alias("df")).filter("df > 0")

    def search(self, query: str, scope: list[str] | None = None, kind: list[str] | None = None, path: str | None = None, project: str | None = None, visibility: str | None = "public", limit: int | None = S.LIMIT, offset: int = 0) -> DataFrame:
        """As operators.search.search over all rows that count, and equal to it. An empty index gives no rows."""
        slots = _Slots()
        compiled = S.Compiled(query, slots.hits)
        page(self.spark.range(0), limit, offset)  # checks both
        filters = _Filters(S._kinds(scope), S._kinds(kind), path, project, visibility)
        step, live = self._live()
        n, n_tokens = (sum(x[i] for x in live.values()) for i in (0, 1))
        if not n or not slots.terms:
            return self.spark.createDataFrame([], RESULT)
        segments, mean = sorted(live), n_tokens / n
        exact = NAME + S.exact_word(query)
        tests = {k: slots.test(k) for k in slots.terms.values()}
        wanted = F.col("term") == exact
        for t in [*tests.values(), *filters.lists.values()]:
            wanted = wanted | t
        words = [t for t, prefix in slots.terms if not prefix]
        lists = self.lists([*words, exact, *filters.ranges], [t for t, prefix in slots.terms if prefix] + filters.prefixes, wanted, segments)
        counts = self._having(compiled, slots, words, lists, tests, segments, step)
        scored = compiled.score(F.lit(n), F.lit(mean), [F.lit(float(c)) for c in counts])
        score = F.round(scored + F.when(F.col("exact"), -S.BOOST).otherwise(0.0), 6)

        def best(blocks: DataFrame) -> DataFrame:
            """Rows of some blocks that match and pass, scored."""
            rows = self._rows(lists.join(blocks, ["segment", "block"], "left_semi"), tests, filters, exact).withColumns(compiled.columns)
            found = rows.filter(compiled.matches & filters.passes()).join(self._deletes(step, segments), ["segment", "row"], "left_anti")
            return found.select("segment", "row", score.alias("score"))

        blocks = self._blocks(lists, tests, filters, exact).filter(slots.possible(compiled.tree) & self._passable(filters))
        bound = F.when(F.col("exact"), S.BOOST).otherwise(0.0)
        for i, p in enumerate(compiled.phrases):
            bound = bound + S.weight(F.lit(n), F.lit(float(counts[i]))) * S.saturation(slots.most(p), F.col("least"), F.lit(mean))
        blocks = blocks.select("segment", "block", bound.alias("bound"))
        k = None if limit is None else limit + offset
        if k is not None and k <= LISTED:
            first = blocks.orderBy(F.desc("bound"), "segment", "block").limit(self.first).select("segment", "block")
            some = best(first).orderBy("score").limit(k).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("worst")).first()
            if k and some.n == k:
                blocks = blocks.filter(-F.col("bound") <= some.worst + SLACK)
        found = best(blocks)
        rows = self._read("rows", ROWS)
        if k is not None and k <= LISTED:
            # The best k of each segment, by their numbers, which follow the order of ties.
            order = F.row_number().over(Window.partitionBy("segment").orderBy("score", "row"))
            listed = found.withColumn("__k", order).filter(F.col("__k") <= k).drop("__k").collect()
            chosen: dict[int, list[int]] = defaultdict(list)
            for r in listed:
                chosen[r.segment].append(r.row)
            where = F.lit(False)
            for segment, own in chosen.items():
                where = where | ((F.col("segment") == segment) & F.col("row").isin(own))
            rows, found = rows.filter(where), F.broadcast(self.spark.createDataFrame(listed, "segment int, row long, score double"))
        ranked = rows.join(found, ["segment", "row"]).orderBy("score", *S.tie_order())
        return page(ranked.select(*S.RESULT), limit, offset)

    def _having(self, compiled: S.Compiled, slots: _Slots, words: list[str], lists: DataFrame, tests: dict[int, Column], live: list[int], step: int) -> list[int]:
        """How many rows hold each phrase: single words from the dictionary, the others from their positions."""
        simple = [len(p.tokens) == 1 and not p.prefix and not p.initial for p in compiled.phrases]
        known = self.having(words, live, step) if any(simple) else {}
        bits = [sum(1 << Q.COLUMNS.index(c) for c in p.columns) for p in compiled.phrases]
        out = [sum(c for m, c in known.get(p.tokens[0], {}).items() if m & b) if s else 0 for p, s, b in zip(compiled.phrases, simple, bits, strict=True)]
        rest = [i for i, s in enumerate(simple) if not s and compiled.phrases[i].tokens]
        if rest:
            used = sorted({k for i in rest for k in slots.of(compiled.phrases[i])})
            own = {k: tests[k] for k in used}
            where, maybe = F.lit(False), F.lit(False)
            for k in used:
                where = where | tests[k]
            for i in rest:
                maybe = maybe | (slots.most(compiled.phrases[i]) > 0)
            part = lists.filter(where)
            blocks = self._blocks(part, own, None, None).filter(maybe).select("segment", "block")
            rows = self._rows(part.join(blocks, ["segment", "block"], "left_semi"), own, None, None).join(self._deletes(step, live), ["segment", "row"], "left_anti")
            sizes = [F.coalesce(F.sum((self._size(slots, compiled.phrases[i]) > 0).cast("long")), F.lit(0)).alias(f"n{i}") for i in rest]
            for i, c in zip(rest, rows.agg(*sizes).first(), strict=True):
                out[i] = c
        return out

    def _size(self, slots: _Slots, p: Q.Phrase) -> Column:
        out = F.lit(0)
        for c in p.columns:
            out = out + F.size(slots.hits(p, c))
        return out

    def _flags(self, filters: _Filters | None, exact: str | None) -> list[Column]:
        flags = {f"has_{name}": test for name, test in filters.lists.items()} if filters else {}
        if exact is not None:
            flags["exact"] = F.col("term") == exact
        return [F.max(test).alias(name) for name, test in flags.items()]

    def _blocks(self, lists: DataFrame, tests: dict[int, Column], filters: _Filters | None, exact: str | None) -> DataFrame:
        """For each block the most that each term has in a row, from the small columns alone."""
        most = [F.sum(F.when(test, F.col(f"{c}_n")).otherwise(0)).alias(f"b{k}_{c}") for k, test in tests.items() for c in Q.COLUMNS]
        return lists.groupBy("segment", "block").agg(*most, F.min("least").alias("least"), *self._flags(filters, exact))

    def _passable(self, filters: _Filters) -> Column:
        out = F.lit(True)
        for name in filters.lists:
            out = out & F.col(f"has_{name}")
        return out

    def _rows(self, lists: DataFrame, tests: dict[int, Column], filters: _Filters | None, exact: str | None) -> DataFrame:
        """For each row of some blocks the positions of each term in each column."""
        # A word's lists lie side by side in one file, so they are dealt out before they are opened.
        dealt = lists.select("segment", "block", "term", "entries").repartition("segment", "block")
        spread = dealt.mapInArrow(inverted.opened, ENTRY)
        row = F.shiftleft(F.col("block"), self.block_bits) + F.col("off")
        merged = [F.flatten(F.collect_list(F.when(test, F.col(c)))).alias(f"s{k}_{c}") for k, test in tests.items() for c in Q.COLUMNS]
        out = spread.withColumn("row", row).groupBy("segment", "row").agg(F.max("n_tokens").alias("n_tokens"), F.max("type").alias("type"), F.max("level").alias("level"), *merged, *self._flags(filters, exact))
        return out


TERMS_ORDER = ["term", *(f"m{m}" for m in MASKS), "step"]
