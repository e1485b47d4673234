"""Registered queries over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions import text as T
from srcatlas.extract import run as extraction
from srcatlas.extract import sfc
from srcatlas.operators import explore as X
from srcatlas.operators import lookup as L
from srcatlas.operators import maintain as M
from srcatlas.operators import render as R
from srcatlas.operators import search as S
from srcatlas.operators import snippets, texts
from srcatlas.operators.postings import PostingIndex
from srcatlas.operators.suffixes import SuffixIndex
from srcatlas.plans import code, schema, varied
from srcatlas.plans.schema import Index
from srcatlas.sources import bridge, languages
from srcatlas.sources.bridge import duck_ctes, index, table, view
from srcatlas.sources.store import shared_folder
from srcatlas.streaming import events as E
from srcatlas.streaming import state as FS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PROJECT, FILE, GLOB, PARENT = "src0", "en/d4/f14.md", "en/d[0-3]/f1?.*", "Brand_4"
SYMBOL = "project, file, name, kind, line_start, line_end, parent, tokens, alias, visibility"
REF = "project, file, name, kind, line_start, line_end, caller"
SYMBOL_ORDER = "file, line_start, project, name, kind, line_end, parent NULLS FIRST, tokens NULLS FIRST, alias, visibility NULLS FIRST"
REF_ORDER = "file, line_start, project, name, kind, line_end, caller NULLS FIRST"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None, *views: str) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = (duck_ctes(*views) + "\n" if views and not sql.lstrip().startswith(",") else duck_ctes(*views) if views else "") + sql


def over(f: Callable[[Index], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(index(spark, d))


# Structural lookups. All symbols of one file have the same visibility in these tables.
for level, test, file in (("public", "visibility_level <= 1", "de/d2/f112.py"), ("internal", "visibility_level <= 2", "de/d1/f26.md"), ("private", "true", FILE)):
    add(f"file_symbols_{level}", over(lambda ix, v=level, f=file: L.file_symbols(ix, f, v)), f"SELECT {SYMBOL} FROM ix_symbols WHERE file = '{file}' AND {test} ORDER BY {SYMBOL_ORDER} LIMIT 100", "ix_symbols")
add("file_symbols_glob", over(lambda ix: L.file_symbols(ix, GLOB)), rf"SELECT {SYMBOL} FROM ix_symbols WHERE regexp_full_match(file, 'en/d[0-3]/f1.\..*') AND visibility_level <= 1 ORDER BY {SYMBOL_ORDER} LIMIT 100", "ix_symbols")
add("file_symbols_page2", over(lambda ix: L.file_symbols(ix, "en/*", "private", 20, 20)), f"SELECT {SYMBOL} FROM ix_symbols WHERE starts_with(file, 'en/') ORDER BY {SYMBOL_ORDER} LIMIT 20 OFFSET 20", "ix_symbols")
for level, test, file, parent in (("public", "visibility_level <= 1", "en/d2/f157.rs", "Brand_24"), ("private", "true", FILE, "Brand_14")):
    add(f"children_{level}", over(lambda ix, v=level, f=file, p=parent: L.children(ix, f, p, v)), f"SELECT {SYMBOL} FROM ix_symbols WHERE file = '{file}' AND parent = '{parent}' AND {test}", "ix_symbols")
_TAILS: dict[tuple[str, str, str], SuffixIndex] = {}


def _tails(spark: SparkSession, d: str, column: str) -> Callable[[str], DataFrame]:
    """The stored suffixes of a folder's references, written once in a session."""
    key = (spark.sparkContext.applicationId, d, column)
    if key not in _TAILS:
        _TAILS[key] = SuffixIndex(spark, f"{shared_folder(spark)}/suffixes-{uuid.uuid4().hex}", column)
        _TAILS[key].build(index(spark, d).refs)
    return _TAILS[key].find


def add_refs(name: str, ask: Callable, column: str, sql: str, *views: str) -> None:
    """A query over stored suffixes, and the same rows from a scan of all references."""
    add(name, lambda s, d: ask(index(s, d), _tails(s, d, column)), sql, *views)
    add(f"{name}_scan", lambda s, d: ask(index(s, d), None), None)
    ORACLE[f"{name}_scan"] = ORACLE[name]


add_refs("callers_base_name", lambda ix, find: L.callers(ix, "red_plate", limit=None, find=find), "name", f"SELECT {REF} FROM ix_refs WHERE name = 'red_plate' OR name ILIKE '%.red_plate'", "ix_refs")
add_refs("callers_kind_project", lambda ix, find: L.callers(ix, "red_plate", "call", PROJECT, find=find), "name", f"SELECT {REF} FROM ix_refs WHERE (name = 'red_plate' OR name ILIKE '%.red_plate') AND kind = 'call' AND project = '{PROJECT}' ORDER BY {REF_ORDER} LIMIT 100", "ix_refs")
_VISIBLE = """SELECT DISTINCT {r} FROM ix_refs r JOIN ix_symbols s ON (s.name = r.name OR s.name ILIKE '%.' || r.name) AND s.project = r.project
WHERE {c} AND s.visibility_level <= {n}"""
_R = ", ".join(f"r.{c.strip()}" for c in REF.split(","))
add_refs("callers_visibility_public", lambda ix, find: L.callers(ix, "red_plate", visibility="public", limit=None, find=find), "name", _VISIBLE.format(r=_R, c="(r.name = 'red_plate' OR r.name ILIKE '%.red_plate')", n=1), "ix_refs", "ix_symbols")
add_refs("callees_base_name", lambda ix, find: L.callees(ix, "run_f", find=find), "caller", f"SELECT {REF} FROM ix_refs WHERE caller = 'run_f' OR caller ILIKE '%.run_f' ORDER BY {REF_ORDER} LIMIT 100", "ix_refs")
add_refs("callees_visibility_internal", lambda ix, find: L.callees(ix, "S4.run_o", visibility="internal", limit=None, find=find), "caller", _VISIBLE.format(r=_R, c="(r.caller = 'S4.run_o' OR r.caller ILIKE '%.S4.run_o')", n=2), "ix_refs", "ix_symbols")
add("list_projects", over(L.list_projects), "SELECT DISTINCT project FROM ix_files", "ix_files")
add("dir_files", over(lambda ix: L.dir_files(ix, PROJECT, "en/d0")), f"SELECT string_split(path, '/')[-1] AS filename, lang FROM ix_files WHERE project = '{PROJECT}' AND parent_path = 'en/d0' AND NOT regexp_matches(path, '(^|/)\\.')", "ix_files")
add("file_hash", over(lambda ix: L.file_hash(ix, PROJECT, "fr/d0/f0.py")), f"SELECT hash FROM ix_files WHERE project = '{PROJECT}' AND path = 'fr/d0/f0.py'", "ix_files")

# Exploration. src9 holds dot paths.
_LEVELS = """, lev AS (SELECT f.parent_path, f.path, f.lang, coalesce(min(s.visibility_level), 3) AS min_vis FROM ix_files f
LEFT JOIN ix_symbols s ON s.project = f.project AND s.file = f.path WHERE f.project = '{p}' AND {w} GROUP BY ALL),
ov AS (SELECT parent_path, lang, min_vis, count(*) AS n_files FROM lev WHERE NOT regexp_matches(path, '(^|/)\\.') GROUP BY ALL),
cf AS (SELECT *, row_number() OVER (PARTITION BY parent_path, lang ORDER BY path) AS rn FROM lev WHERE lang IS NOT NULL AND min_vis <= {n})
"""


def _lev(tail: str, p: str = "src9", w: str = "true", n: int = 3) -> str:
    return _LEVELS.format(p=p, w=w, n=n) + tail


_IX = ("ix_files", "ix_symbols")
add("dir_overview", over(lambda ix: X.overview(ix, "src9")), _lev("SELECT * FROM ov"), *_IX)
add("dir_overview_prefix", over(lambda ix: X.overview(ix, "src9", "en/")), _lev("SELECT * FROM ov", w="f.path LIKE 'en/%'"), *_IX)
_CAPPED = "SELECT parent_path, string_split(path, '/')[-1] AS filename, lang, path FROM cf WHERE rn <= 2"
for vis, n, p in (("public", 1, "src18"), ("private", 3, "src9")):  # src18 holds files with public symbols
    add(f"files_capped_{vis}", over(lambda ix, v=vis, p=p: X.capped_files(ix, p, 2, None, v)), _lev(_CAPPED, n=n, p=p), *_IX)
    add(f"files_capped_{vis}_prefix", over(lambda ix, v=vis, p=p: X.capped_files(ix, p, 2, "en", v)), _lev(_CAPPED, w="f.path LIKE 'en/%'", n=n, p=p), *_IX)
_TOTAL = "SELECT CAST(coalesce(sum(n_files) FILTER (WHERE min_vis <= {n} AND lang IS NOT NULL), 0) AS BIGINT) AS total_visible_files, count(*) FILTER (WHERE min_vis <= {n} AND lang IS NOT NULL) AS num_visible_groups FROM ov"
add("explore_totals", over(lambda ix: X.totals(ix, "src9")), _lev(_TOTAL.format(n=1)), *_IX)
add("explore_cap", over(lambda ix: X.cap_row(ix, "src9", None, "private", 5)), _lev(f", t AS ({_TOTAL.format(n=3)}) SELECT *, CASE WHEN total_visible_files > 5 THEN CAST(greatest(1, 5 // greatest(num_visible_groups, 1)) AS BIGINT) END AS cap FROM t"), *_IX)
_REST = """, tt AS (SELECT parent_path, lang, CAST(sum(n_files) AS BIGINT) AS total FROM ov GROUP BY ALL),
ff AS (SELECT parent_path, lang, count(*) AS fetched FROM cf WHERE rn <= 1 GROUP BY ALL),
rm AS (SELECT tt.parent_path, coalesce(tt.lang, 'other') AS lang, greatest(total - coalesce(fetched, 0), 0) AS remaining FROM tt LEFT JOIN ff ON ff.parent_path = tt.parent_path AND ff.lang IS NOT DISTINCT FROM tt.lang)
"""
add("explore_remainders", over(lambda ix: X.remainders(ix, "src9", 1)), _lev(_REST + "SELECT * FROM rm WHERE remaining > 0", n=1), *_IX)
add(
    "explore_dirs_map",
    over(lambda ix: X.directories(ix, "src9", 1, None, "private").select("parent_path", F.array_join("files", ",").alias("files"), F.array_join("more", ";").alias("more"))),
    _lev(_REST + """SELECT d.parent_path, coalesce((SELECT string_agg(string_split(path, '/')[-1], ',' ORDER BY path) FROM cf WHERE rn <= 1 AND cf.parent_path = d.parent_path), '') AS files,
coalesce((SELECT string_agg('+' || remaining || ' ' || lang || ' files', ';' ORDER BY '+' || remaining || ' ' || lang || ' files') FROM rm WHERE remaining > 0 AND rm.parent_path = d.parent_path), '') AS more
FROM (SELECT DISTINCT parent_path FROM ov) d"""),
    *_IX,
)
add("subprojects_of", lambda s, d: X.subprojects(index(s, d).with_(files=view(s, d, "ix_files").withColumn("project", F.concat_ws("/", "lang", "project").alias("project"))), "python"), "SELECT DISTINCT concat('python/', project) AS project FROM ix_files WHERE lang = 'python'", "ix_files")
add(
    "longest_prefix_mount",
    lambda s, d: X.longest_prefix(view(s, d, "ix_files").select("path"), s.createDataFrame([("",), ("en",), ("en/d1",), (".ci/en",), ("fr/d",)], "root string")),
    """, r(root) AS (VALUES (''), ('en'), ('en/d1'), ('.ci/en'), ('fr/d'))
SELECT path, arg_max(root, length(root)) AS root FROM (SELECT DISTINCT path FROM ix_files) f JOIN r ON r.root = '' OR f.path = r.root OR starts_with(f.path, r.root || '/') GROUP BY path""",
    "ix_files",
)


# Snippets: documents are the source files.
def _with_source(spark: SparkSession, d: str, limit: int | None) -> DataFrame:
    ix = index(spark, d)
    sources = view(spark, d, "ix_files").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id").select("project", "path", "content")
    rows = L.file_symbols(ix, "en/d0/*", "private", 200).withColumns({"line_start": F.col("line_start") % 7, "line_end": F.col("line_start") % 7 + 3})
    return snippets.with_snippets(rows, sources, limit).select("project", "file", "name", "line_start", "line_end", "snippet")


_SNIP = """, p AS (SELECT * FROM ix_symbols WHERE starts_with(file, 'en/d0/') ORDER BY {o} LIMIT 200),
q AS (SELECT p.project, p.file, p.name, p.line_start % 7 AS line_start, p.line_start % 7 + 3 AS line_end, string_split(d.text, chr(10)) AS l
  FROM p JOIN ix_files f ON f.project = p.project AND f.path = p.file JOIN documents d ON d.doc_id = f.doc_id),
k AS (SELECT *, list_filter(l[greatest(line_start, 1):line_end], lambda x: trim(x) <> '') AS kept FROM q)
SELECT project, file, name, line_start, line_end, CASE WHEN len(kept) > 0 THEN {e} END AS snippet FROM k"""
add("snippet_n", lambda s, d: _with_source(s, d, 2), _SNIP.format(o=SYMBOL_ORDER, e="array_to_string(kept[:2], chr(10)) || CASE WHEN len(kept) > 2 THEN chr(10) || '...' ELSE '' END"), "ix_symbols")
add("snippet_full", lambda s, d: _with_source(s, d, None), _SNIP.format(o=SYMBOL_ORDER, e="array_to_string(kept, chr(10))"), "ix_symbols")

# Maintenance.
_F = "project, path, parent_path, lang, hash, lines, title, description"


def _files(df: DataFrame) -> DataFrame:
    return df.select(*(c.strip() for c in _F.split(",")))


def _edited(ix: Index) -> Index:
    """New versions of every seventh file, some unchanged, and their symbols moved down by a line."""
    files = ix.files.filter("doc_id % 7 = 0").withColumn("hash", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x"), F.col("hash"))).otherwise(F.col("hash")))
    move = lambda df: df.join(files.select("project", F.col("path").alias("file")), ["project", "file"], "left_semi").withColumns({"line_start": F.col("line_start") + 1, "line_end": F.col("line_end") + 1})
    return Index(files, move(ix.symbols), move(ix.texts), move(ix.refs))


add("changed_files", over(lambda ix: M.changed_files(ix.files, _edited(ix).files).select("project", "path", "hash")), "SELECT project, path, 'x' || hash AS hash FROM ix_files WHERE doc_id % 14 = 0", "ix_files")
add(
    "upsert_files",
    over(lambda ix: M.upsert(ix, _edited(ix)).symbols.groupBy("project", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("line_start").cast("long").alias("lines"))),
    "SELECT s.project, s.file, count(*) AS n, CAST(sum(s.line_start + CASE WHEN f.doc_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM ix_symbols s JOIN ix_files f ON f.project = s.project AND f.path = s.file GROUP BY ALL",
    *_IX,
)
add("delete_file", over(lambda ix: M.without_files(ix, ix.files.filter("path = 'en/d4/f14.md'")).symbols.groupBy("file").agg(F.count(F.lit(1)).alias("n"))), f"SELECT file, count(*) AS n FROM ix_symbols WHERE NOT (file = '{FILE}' AND project IN (SELECT project FROM ix_files WHERE path = '{FILE}')) GROUP BY file", *_IX)
add("delete_project", over(lambda ix: M.project_totals(M.without_project(ix, PROJECT))), f"""SELECT project, CAST(sum(f) AS BIGINT) AS n_files, CAST(sum(s) AS BIGINT) AS n_symbols, CAST(sum(t) AS BIGINT) AS n_texts, CAST(sum(r) AS BIGINT) AS n_refs FROM (
SELECT project, 1 AS f, 0 AS s, 0 AS t, 0 AS r FROM ix_files UNION ALL SELECT project, 0, 1, 0, 0 FROM ix_symbols UNION ALL SELECT project, 0, 0, 1, 0 FROM ix_texts UNION ALL SELECT project, 0, 0, 0, 1 FROM ix_refs) WHERE project <> '{PROJECT}' GROUP BY project""", "ix_symbols", "ix_texts", "ix_refs")
add("export_project", over(lambda ix: _files(M.export(ix, PROJECT).files)), f"SELECT {_F} FROM ix_files WHERE project = '{PROJECT}'", "ix_files")
add("export_all", over(lambda ix: M.export(ix).texts.select("project", "file", "kind", "line_start", "line_end", "text", "parent")), "SELECT project, file, kind, line_start, line_end, text, parent FROM ix_texts", "ix_texts")
add("languages", over(lambda ix: M.languages(ix).select("project", F.array_join("languages", ",").alias("languages"))), "SELECT project, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS languages FROM ix_files GROUP BY project", "ix_files")
add("manifest_row", over(lambda ix: M.manifest(ix, PROJECT, "demo").withColumn("languages", F.array_join("languages", ","))), f"SELECT '1.0' AS version, 'demo' AS name, '.' AS root, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM ix_files WHERE project = '{PROJECT}'", "ix_files")
_GAP = """, b AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS o FROM ix_events WINDOW w AS (PARTITION BY path ORDER BY ts, seq)),
c AS (SELECT *, sum(o) OVER (PARTITION BY path ORDER BY ts, seq) AS g FROM b),
deb AS (SELECT path, arg_max(kind, (ts, seq)) AS kind, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM c GROUP BY path, g)
"""
add("debounced_events", lambda s, d: E.debounce_batch(view(s, d, "ix_events"), "3 hours"), _GAP + "SELECT * FROM deb", "ix_events")
add("debounced_sessions", lambda s, d: E.debounce_sessions(view(s, d, "ix_events").withColumn("ts", F.col("ts").cast("timestamp")), "3 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")}), _GAP + "SELECT * FROM deb", "ix_events")


def _event_apply(spark: SparkSession, d: str) -> DataFrame:
    """Files f<n>.py of one project; events create or rewrite even ones, or remove them."""
    last = E.debounce_batch(view(spark, d, "ix_events"), "3 hours").groupBy("path").agg(F.max_by("kind", "last_ts").alias("kind")).withColumn("project", F.lit("p"))
    n = F.regexp_extract("path", r"(\d+)", 1).cast("int")
    old = spark.range(0, 50, 2).select(F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("old").alias("hash"))
    new = last.select("project", "path", F.concat(F.lit("new"), n.cast("string")).alias("hash"))
    none = spark.createDataFrame([], "project string, file string")
    return M.apply_events(Index(old, none, none, none), last, Index(new, none, none, none)).files


add("event_apply", _event_apply, _GAP + """, l AS (SELECT path, arg_max(kind, last_ts) AS kind FROM deb GROUP BY path),
o AS (SELECT 'f' || i || '.py' AS path FROM (SELECT unnest(range(0, 50, 2)) AS i))
SELECT 'p' AS project, path, 'old' AS hash FROM o WHERE path NOT IN (SELECT path FROM l)
UNION ALL SELECT 'p', path, 'new' || regexp_extract(path, '(\\d+)', 1) FROM l WHERE kind <> 'remove'""", "ix_events")


def _event_state(spark: SparkSession, d: str) -> DataFrame:
    """The changes that the same events make to the same files, from a stream with a state for each file."""
    folder = f"{shared_folder(spark)}/event-state-{uuid.uuid4().hex}"
    n = F.regexp_extract("path", r"(\d+)", 1)
    events = view(spark, d, "ix_events").select(F.lit("p").alias("project"), "path", "kind", F.concat(F.lit("new"), n).alias("hash"), F.col("ts").cast("timestamp").alias("ts"), "seq")
    # One event long after all others moves the watermark past them.
    clock = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit("").alias("project"), F.lit("clock").alias("path"), F.lit("modify").alias("kind"), F.lit("x").alias("hash"), "ts", F.lit(-1).cast("long").alias("seq"))
    events.unionByName(clock).write.parquet(f"{folder}/in")
    stored = spark.range(0, 50, 2).select(F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("old").alias("hash"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, FS.PROVIDER)
    try:
        out = FS.changes(spark.readStream.schema(FS.EVENT).parquet(f"{folder}/in"), stored, 3 * 3600 * 1000)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before) if before is not None else spark.conf.unset(provider)
    changed = spark.read.schema(FS.CHANGE).parquet(f"{folder}/out").filter("path <> 'clock'")
    return changed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


def _event_state_files(spark: SparkSession, d: str) -> DataFrame:
    """The files that are there after these changes."""
    changed = _event_state(spark, d)
    last = changed.groupBy("project", "path").agg(F.max_by(F.struct("kind", "hash"), "first_ts").alias("c"))
    old = spark.range(0, 50, 2).select(F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("old").alias("hash"))
    return old.join(last, ["project", "path"], "left_anti").unionByName(last.filter("c.kind <> 'remove'").select("project", "path", F.col("c.hash").alias("hash")))


add("event_state_files", _event_state_files, ORACLE["event_apply"])
add("event_state_changes", lambda s, d: _event_state(s, d).drop("project"), _GAP + """, n AS (SELECT *, CAST(regexp_extract(path, '(\\d+)', 1) AS INT) AS i FROM deb),
a AS (SELECT *, CASE WHEN kind <> 'remove' THEN 'new' || i END AS after FROM n),
b2 AS (SELECT *, CASE WHEN row_number() OVER w > 1 THEN lag(after) OVER w WHEN i % 2 = 0 AND i < 50 THEN 'old' END AS before FROM a WINDOW w AS (PARTITION BY path ORDER BY first_ts))
SELECT path, CASE WHEN after IS NULL THEN 'remove' WHEN before IS NULL THEN 'create' ELSE 'modify' END AS kind, after AS hash, first_ts, last_ts, n_events FROM b2 WHERE after IS DISTINCT FROM before""", "ix_events")


# Full text.
_DOCS = r""", docs AS (
SELECT 'file' AS type, project, path AS file, coalesce(title, '') AS name, coalesce(description, '') AS content, lang AS kind, 0 AS visibility_level, CAST(NULL AS INT) AS line_start, CAST(NULL AS INT) AS line_end, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS text FROM ix_files
UNION ALL SELECT 'symbol', project, file, name, kind || ' ' || coalesce(tokens, ''), kind, visibility_level, line_start, line_end, parent, NULL FROM ix_symbols
UNION ALL SELECT 'text', project, file, '', coalesce(text, ''), kind, 0, line_start, line_end, parent, text FROM ix_texts),
tok0 AS (SELECT *, regexp_extract_all(strip_accents(lower(name)), '[\p{L}\p{N}]+') AS name_t, regexp_extract_all(strip_accents(lower(file)), '[\p{L}\p{N}]+') AS file_t, regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+') AS content_t FROM docs),
tok AS (SELECT *, len(name_t) + len(file_t) + len(content_t) AS n_tokens FROM tok0)
"""
_SEARCHED = ("ix_symbols", "ix_texts")


def hits(words: str, prefix: bool = False, initial: bool = False, columns: tuple[str, ...] = ("name", "file", "content")) -> str:
    """DuckDB: the weighted number of places where a phrase stands."""
    w = words.split()
    parts = []
    for c in columns:
        t = f"{c}_t"
        if initial:
            n = f"CASE WHEN {t}[1:{len(w)}] = {w} THEN 1 ELSE 0 END"
        elif len(w) == 1:
            n = f"len(list_filter({t}, lambda t: {f'starts_with(t, {w[0]!r})' if prefix else f't = {w[0]!r}'}))"
        else:
            n = f"len(list_filter(range(1, greatest(len({t}) - {len(w)} + 2, 1)), lambda i: {t}[i:i + {len(w) - 1}] = {w}))"
        parts.append(f"{S.WEIGHTS[c]} * {n}")
    return " + ".join(parts)


def near(a: str, b: str, distance: int) -> str:
    one = "len(list_filter(range(1, len({t}) + 1), lambda i: {t}[i] = '{a}' AND list_contains({t}[greatest(i - {n}, 1):i + {n}], '{b}')))"
    return " + ".join(f"{S.WEIGHTS[c]} * " + one.format(t=f"{c}_t", a=a, b=b, n=distance + 1) for c in S.WEIGHTS)


def ranked(phrases: list[str], match: str, where: str = "visibility_level <= 1", guards: dict[int, str] | None = None, raw: dict[int, str] | None = None, exact: str = "", limit: int | None = 10, offset: int = 0) -> str:
    """DuckDB: BM25 over phrase frequencies f0, f1, ...; raw gives the frequency that counts for a phrase's document frequency, where it differs."""
    n = range(len(phrases))
    score = " ".join(f"- CASE WHEN {(guards or {}).get(i, 'true')} THEN (CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * n_tokens / av)) ELSE 0 END" for i in n)
    return _DOCS + f""", sc AS (SELECT *, {', '.join(f'{p} AS f{i}' for i, p in enumerate(phrases))}, {', '.join(f'{(raw or {}).get(i, p)} AS r{i}' for i, p in enumerate(phrases))} FROM tok),
st AS (SELECT count(*)::DOUBLE AS n, avg(n_tokens) AS av, {', '.join(f'count(*) FILTER (WHERE r{i} > 0)::DOUBLE AS d{i}' for i in n)} FROM sc)
SELECT type, project, file, name, kind, line_start, line_end, parent, text, round(0.0 {score} + CASE WHEN lower(name) = '{exact}' THEN -1000.0 ELSE 0.0 END, 6) AS score, content AS __content
FROM sc, st WHERE {match} AND {where}
ORDER BY score, length(name), type, project, file, line_start NULLS FIRST, line_end NULLS FIRST, kind NULLS FIRST, name, content, parent NULLS FIRST {'' if limit is None else f'LIMIT {limit} OFFSET {offset}'}"""


_STORED: dict[tuple[str, str, str], PostingIndex] = {}


def _stored(spark: SparkSession, d: str, name: str = "as it is", change: Callable[[PostingIndex, Index], None] | None = None) -> PostingIndex:
    """The stored posting lists of a folder's index, written once in a session, and again for each way to change it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        lists = PostingIndex(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
        lists.build(index(spark, d))
        if change is not None:
            change(lists, index(spark, d))
        _STORED[key] = lists
    return _STORED[key]


def add_search(name: str, query: str, sql: str, **options) -> None:
    add(name, lambda s, d: _stored(s, d).search(query, **options), sql.replace(", content AS __content", ""), *_SEARCHED)


def add_scan(name: str, query: str) -> None:
    """The same rows from a scan of the whole corpus."""
    add(f"{name}_scan", over(lambda ix: S.search(ix, query)), None)
    ORACLE[f"{name}_scan"] = ORACLE[name]


RED, BOLT, WIDGET = hits("red"), hits("bolt"), hits("widget")
add_search("search_term", "widget", ranked([WIDGET], "f0 > 0", exact="widget"))
add_search("search_accent", "ÉAN", ranked([hits("ean")], "f0 > 0", exact="éan"))
add_search("search_implicit_and", "red bolt", ranked([RED, BOLT], "f0 > 0 AND f1 > 0", exact="red"))
add_search("search_or_pipe", "red|bolt", ranked([RED, BOLT], "(f0 > 0 OR f1 > 0)", exact="red|bolt", guards={0: "f0 > 0", 1: "f1 > 0"}))
add_search("search_pipe_with_term", "red|bolt economy", ranked([RED, BOLT, hits("economy")], "(f0 > 0 OR f1 > 0) AND f2 > 0", exact="red|bolt", guards={0: "f0 > 0", 1: "f1 > 0"}))
add_search("search_not", "widget NOT red", ranked([WIDGET], f"f0 > 0 AND NOT ({RED}) > 0", exact="widget"))
add_search("search_precedence", "red OR widget NOT small economy", ranked([RED, WIDGET], f"(f0 > 0 OR (f1 > 0 AND NOT (({hits('small')}) > 0 AND ({hits('economy')}) > 0)))", guards={0: "f0 > 0", 1: f"f1 > 0 AND NOT (({hits('small')}) > 0 AND ({hits('economy')}) > 0)"}, exact="red"))
add_search("search_prefix", "wid*", ranked([hits("wid", prefix=True)], "f0 > 0", exact="wid*"))
add_search("search_phrase", "red_widget", ranked([hits("red widget")], "f0 > 0", exact="red_widget"))
add_search("search_quoted", '"small gizmo"', ranked([hits("small gizmo")], "f0 > 0", exact='"small'))
add_search("search_initial", "^function", ranked([hits("function", initial=True)], "f0 > 0", exact="^function"))
add_search("search_near", "NEAR(red economy, 1)", ranked([near("red", "economy", 1), near("economy", "red", 1)], "f0 > 0", raw={0: RED, 1: hits("economy")}, exact="near(red"))
add_search("search_column_filter", "name: red", ranked([hits("red", columns=("name",))], "f0 > 0", exact="name:"))
add_search("search_column_excluded", "- {name file} : red", ranked([hits("red", columns=("content",))], "f0 > 0", exact="-"))


def _titled(ix: Index) -> Index:
    """Some files are named exactly as the word that is looked for."""
    return ix.with_(files=ix.files.withColumn("title", F.when(F.col("doc_id") % 300 == 1, F.lit("Widget")).otherwise(F.col("title"))))


add("search_exact_boost", over(lambda ix: S.search(_titled(ix), "widget OR en")), ranked([WIDGET, hits("en")], "(f0 > 0 OR f1 > 0)", guards={0: "f0 > 0", 1: "f1 > 0"}, exact="widget").replace("coalesce(title, '')", "CASE WHEN doc_id % 300 = 1 THEN 'Widget' ELSE coalesce(title, '') END").replace(", content AS __content", ""), *_SEARCHED)
add_search("search_scope_symbol", "red", ranked([RED], "f0 > 0", "visibility_level <= 1 AND type = 'symbol'", exact="red"), scope=["symbol"])
add_search("search_scope_file", "python OR en", ranked([hits("python"), hits("en")], "(f0 > 0 OR f1 > 0)", "type = 'file'", guards={0: "f0 > 0", 1: "f1 > 0"}, exact="python"), scope=["file"])
add_search("search_scope_text", "und", ranked([hits("und")], "f0 > 0", "type = 'text'", exact="und"), scope=["text"])
add_search("search_kind_in", "red", ranked([RED], "f0 > 0", "visibility_level <= 1 AND kind IN ('class', 'method')", exact="red"), kind=["class", "method"])
add_search("search_path_eq", "red", ranked([RED], "f0 > 0", "file = 'en/d1/f1.rs'", exact="red"), path="en/d1/f1.rs", visibility="private")
add_search("search_path_glob", "red", ranked([RED], "f0 > 0", "starts_with(file, 'en/d1/')", exact="red"), path="en/d1/*", visibility="private")
add_search("search_project", "red", ranked([RED], "f0 > 0", "project = 'src1'", exact="red"), project="src1", visibility="private")
add_search("search_visibility", "red", ranked([RED], "f0 > 0", "visibility_level <= 2", exact="red"), visibility="internal")
add_search("search_page2", "red", ranked([RED], "f0 > 0", exact="red", offset=10), offset=10)
for _name, _query in (("search_term", "widget"), ("search_not", "widget NOT red"), ("search_prefix", "wid*"), ("search_phrase", "red_widget")):
    QUERIES[f"{_name}_stored"] = QUERIES[_name]
    ORACLE[f"{_name}_stored"] = ORACLE[_name]
for _name, _query in (("search_term", "widget"), ("search_or_pipe", "red|bolt"), ("search_phrase", "red_widget"), ("search_near", "NEAR(red economy, 1)"), ("search_prefix", "wid*")):
    add_scan(_name, _query)


# Posting lists after some files were edited and others deleted, as if they had been written then.
def _changed(lists: PostingIndex, ix: Index) -> None:
    lists.upsert(_edited(ix))
    lists.delete(ix.files.filter("doc_id % 7 = 3").select("project", "path"))


_OF_FILE = "JOIN ix_files f ON f.project = {t}.project AND f.path = {t}.file WHERE f.doc_id % 7 <> 3"
_MOVED = "SELECT {t}.* REPLACE ({t}.line_start + CASE WHEN f.doc_id % 7 = 0 THEN 1 ELSE 0 END AS line_start, {t}.line_end + CASE WHEN f.doc_id % 7 = 0 THEN 1 ELSE 0 END AS line_end) FROM ix_{n} {t} " + _OF_FILE
_CHANGED = f""", c_files AS (SELECT * FROM ix_files WHERE doc_id % 7 <> 3),
c_symbols AS ({_MOVED.format(t="s", n="symbols")}),
c_texts AS ({_MOVED.format(t="t", n="texts")})
"""


def _after(sql: str) -> str:
    for n in ("files", "symbols", "texts"):
        sql = sql.replace(f"FROM ix_{n}", f"FROM c_{n}")
    return _CHANGED + sql


for _name, _query, _sql in (
    ("or", "red OR widget", ranked([RED, WIDGET], "(f0 > 0 OR f1 > 0)", guards={0: "f0 > 0", 1: "f1 > 0"}, exact="red")),
    ("phrase", "red_widget", ranked([hits("red widget")], "f0 > 0", exact="red_widget")),
    ("near", "NEAR(red economy, 1)", ranked([near("red", "economy", 1), near("economy", "red", 1)], "f0 > 0", raw={0: RED, 1: hits("economy")}, exact="near(red")),
):
    add(f"search_{_name}_after_changes", lambda s, d, q=_query: _stored(s, d, "changed", _changed).search(q, limit=40), _after(_sql.replace(", content AS __content", "").replace("LIMIT 10", "LIMIT 40")), *_SEARCHED)
    add(f"search_{_name}_after_merge", lambda s, d, q=_query: _stored(s, d, "merged", _merged).search(q, limit=40), None)
    ORACLE[f"search_{_name}_after_merge"] = ORACLE[f"search_{_name}_after_changes"]
_TOKENS = _DOCS + "SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(list_concat(name_t, file_t, content_t))) AS token FROM tok) GROUP BY token"
add("token_stats_stored", lambda s, d: _stored(s, d).token_stats(), _TOKENS, *_SEARCHED)
add("token_stats_after_changes", lambda s, d: _stored(s, d, "changed", _changed).token_stats(), _after(_TOKENS), *_SEARCHED)


def _merged(lists: PostingIndex, ix: Index) -> None:
    _changed(lists, ix)
    lists.compact(most=0)


add("search_docs", over(lambda ix: S.search_docs(ix)), _DOCS + "SELECT * FROM docs", *_SEARCHED)
add("token_stats", over(S.token_stats), _DOCS + "SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(list_concat(name_t, file_t, content_t))) AS token FROM tok) GROUP BY token", *_SEARCHED)
add("index_stats", over(S.index_stats), _DOCS + "SELECT count(*) AS n_rows, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM tok", *_SEARCHED)
_LINES = "file || '[' || line_start || CASE WHEN line_end <> line_start THEN '-' || line_end ELSE '' END || ']'"
add("format_search_text", over(lambda ix: S.search_docs(ix).select(R.search_line().alias("line"))), _DOCS + f"SELECT CASE type WHEN 'symbol' THEN {_LINES} || ' symbol ' || name WHEN 'text' THEN {_LINES} || ' text ' || kind || ' ' || replace(left(text, 40), chr(10), ' ') || CASE WHEN length(text) > 40 THEN '...' ELSE '' END ELSE file || ' file (' || coalesce(kind, 'unknown') || ')' END AS line FROM docs", *_SEARCHED)
add("format_refs_text", over(lambda ix: ix.refs.select(R.ref_line().alias("line"))), f"SELECT {_LINES} || ' ref ' || kind || ' ' || coalesce(caller, '(top-level)') || ' -> ' || name AS line FROM ix_refs", "ix_refs")

# Texts and scalar functions.
_TEXT_ORDER = "line_start, line_end, kind, text, parent"
add(
    "texts_merged",
    lambda s, d: texts.merge_adjacent(view(s, d, "ix_texts").withColumn("kind", F.when(F.col("kind") == "string", "comment").otherwise(F.col("kind"))), ["parent", "line_start", "kind", "text"]),
    """, t AS (SELECT project, file, CASE WHEN kind = 'string' THEN 'comment' ELSE kind END AS kind, line_start, line_end, text, parent FROM ix_texts),
l AS (SELECT *, row_number() OVER w AS pos, CASE WHEN kind IN ('docstring', 'comment') AND lag(kind) OVER w = kind AND lag(parent) OVER w IS NOT DISTINCT FROM parent AND lag(line_end) OVER w + 1 = line_start THEN 0 ELSE 1 END AS o
  FROM t WINDOW w AS (PARTITION BY project, file ORDER BY parent NULLS FIRST, line_start, kind, text)),
g AS (SELECT *, sum(o) OVER (PARTITION BY project, file ORDER BY pos) AS i FROM l)
SELECT project, file, kind, min(line_start) AS line_start, max(line_end) AS line_end, string_agg(text, chr(10) ORDER BY pos) AS text, parent FROM g GROUP BY project, file, kind, parent, i""",
    "ix_texts",
)


def _headings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("line_start"), (F.col("l_quantity").cast("int") % 6 + 1).alias("level"))
    return texts.heading_parents(rows.groupBy("doc_id", "line_start").agg(F.min("level").alias("level")))


add("headings_hierarchy", _headings, """WITH h AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS line_start, min(CAST(l_quantity AS INT) % 6 + 1) AS level FROM lineitem GROUP BY ALL)
SELECT a.doc_id, a.line_start, a.level, max(b.line_start) AS parent_line FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.line_start < a.line_start AND b.level < a.level GROUP BY ALL""")
_docs = lambda f: lambda s, d: table(s, d, "documents").select("doc_id", *f())
add("line_counts", _docs(lambda: [T.line_count(F.col("text")).alias("lines")]), "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN right(text, 1) = chr(10) THEN 1 ELSE 0 END END AS INT) AS lines FROM documents")
add("trivial_text_filter", lambda s, d: view(s, d, "ix_texts").filter(~T.trivial(F.col("text"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM ix_texts WHERE NOT (length(trim(text)) <= 1 OR (NOT contains(trim(text), ' ') AND strlen(trim(text)) <= 20)) GROUP BY kind", "ix_texts")
add("whitespace_collapse", _docs(lambda: [T.collapse_whitespace(F.col("text")).alias("text")]), r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
add("first_sentence", _docs(lambda: [T.first_sentence(F.col("text")).alias("sentence")]), r"SELECT doc_id, CASE WHEN regexp_matches(text, '\.(\s|$)') THEN regexp_extract(text, '(?s)^(.*?\.)(\s|$)', 1) ELSE text END AS sentence FROM documents")
add("docstring_split", _docs(lambda: [c.alias(n) for c, n in zip(T.split_docstring(F.col("text")), ("title", "description"), strict=True)]), r"""WITH t AS (SELECT doc_id, trim(text, ' ') AS c FROM documents), r AS (SELECT *, CASE WHEN contains(c, chr(10)) THEN regexp_replace(c, '(?s)^[^\n]*\n\s*', '') ELSE '' END AS rest FROM t),
p AS (SELECT *, regexp_replace(regexp_extract(rest, '(?s)^(.*?)(\n\s*\n|$)', 1), '\s*\n\s*', ' ', 'g') AS para FROM r)
SELECT doc_id, trim(string_split(c, chr(10))[1], ' ') AS title, nullif(trim(CASE WHEN regexp_matches(para, '\.(\s|$)') THEN regexp_extract(para, '(?s)^(.*?\.)(\s|$)', 1) ELSE para END, ' '), '') AS description FROM p""")
add("identifier_tokens", _docs(lambda: [F.array_join(T.identifiers(F.col("text"), ["the", "and", "la"]), " ").alias("tokens")]), "SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')), lambda w: length(w) >= 2 AND w NOT IN ('the', 'and', 'la'))), ' ') AS tokens FROM documents")
add("parent_paths", lambda s, d: view(s, d, "ix_files").select("path", schema.parent_path(F.col("path")).alias("parent_path"), schema.base_name(F.col("path")).alias("base")), "SELECT path, parent_path, string_split(path, '/')[-1] AS base FROM ix_files", "ix_files")
add("lang_detect", lambda s, d: view(s, d, "ix_files").select("path", languages.detect(F.col("path")).alias("lang")), "SELECT path, lang FROM ix_files", "ix_files")
add("visibility_levels", lambda s, d: view(s, d, "ix_symbols").select("symbol_id", schema.level_of(F.col("visibility")).alias("level")), "SELECT symbol_id, visibility_level AS level FROM ix_symbols", "ix_symbols")


# Extraction from pages.
def _blocks(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def task(batches):
        for batch in batches:
            made = [(i, k, b.language, b.start_line, b.source) for i, html in zip(batch["page_id"], batch["html"], strict=True) for k, b in enumerate(sfc.blocks(html or "", "html"))]
            yield pd.DataFrame(made, columns=["page_id", "block", "lang", "start_line", "source"])

    return table(spark, d, "pages").select("page_id", "html").mapInPandas(task, "page_id long, block int, lang string, start_line int, source string")


_SCRIPT = "s AS (SELECT page_id, html, regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS source FROM pages WHERE regexp_matches(html, '<script[ >]'))"
add("html_script_blocks", _blocks, f"WITH {_SCRIPT} SELECT page_id, CAST(0 AS INT) AS block, 'javascript' AS lang, CAST(len(string_split(string_split(html, '<script')[1], chr(10))) AS INT) AS start_line, source FROM s WHERE trim(source) <> ''")


def _pages_index(spark: SparkSession, d: str) -> Index:
    pages = table(spark, d, "pages").select(F.lit("web").alias("project"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return extraction.build(pages.repartition(spark.sparkContext.defaultParallelism))  # one row group would be one task


add("html_call_refs", lambda s, d: _pages_index(s, d).refs.select("file", "name", "kind", "line_start"), f"WITH {_SCRIPT} SELECT 'p' || page_id || '.html' AS file, unnest(regexp_extract_all(source, '([A-Za-z_]+)[(]', 1)) AS name, 'call' AS kind, CAST(len(string_split(string_split(html, '<script')[1], chr(10))) AS INT) AS line_start FROM s")
add("html_files", lambda s, d: _pages_index(s, d).files.select("path", "lang", "lines", "parent_path"), "SELECT 'p' || page_id || '.html' AS path, 'html' AS lang, CAST(CASE WHEN html = '' THEN 0 ELSE len(string_split(html, chr(10))) - CASE WHEN right(html, 1) = chr(10) THEN 1 ELSE 0 END END AS INT) AS lines, '.' AS parent_path FROM pages")


# Extraction, manifests, ignore rules and rendering over files made from rows.
QUERIES.update(code.QUERIES)
ORACLE.update(code.ORACLE)
QUERIES.update(varied.QUERIES)
ORACLE.update(varied.ORACLE)
