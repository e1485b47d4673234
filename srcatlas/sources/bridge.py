"""Index relations derived from the star-schema test tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcatlas.plans.schema import Index

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "ix_files": """
SELECT d.source AS project,
  concat(CASE WHEN d.doc_id % 50 = 49 THEN '.ci/' ELSE '' END, d.lang, '/d', CAST(d.doc_id % 5 AS STRING), '/f', CAST(d.doc_id AS STRING),
    CASE d.doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.md' ELSE '.cfg' END) AS path,
  concat(CASE WHEN d.doc_id % 50 = 49 THEN '.ci/' ELSE '' END, d.lang, '/d', CAST(d.doc_id % 5 AS STRING)) AS parent_path,
  CASE d.doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'markdown' END AS lang,
  substr(md5(d.text), 1, 16) AS hash,
  CAST(CASE WHEN length(d.text) = 0 THEN 0
    ELSE length(d.text) - length(replace(d.text, chr(10), '')) + CASE WHEN right(d.text, 1) = chr(10) THEN 0 ELSE 1 END END AS INT) AS lines,
  split_part(d.text, chr(10), 1) AS title,
  CASE WHEN d.doc_id % 3 = 0 THEN split_part(d.text, '. ', 1) END AS description,
  d.doc_id AS doc_id
FROM {documents} d""",
    "ix_symbols": """
SELECT f.project, f.path AS file,
  concat(replace(p.p_brand, '#', '_'), '.', replace(p.p_name, ' ', '_')) AS name,
  CASE p.p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'constant' END AS kind,
  p.p_size AS line_start, CAST(p.p_size + p.p_partkey % 20 AS INT) AS line_end,
  replace(p.p_brand, '#', '_') AS parent,
  CASE WHEN p.p_partkey % 6 <> 0 THEN concat(p.p_name, ' ', lower(p.p_type)) END AS tokens,
  CAST(NULL AS STRING) AS alias,
  CASE p.p_partkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'internal' WHEN 4 THEN NULL ELSE 'public' END AS visibility,
  CASE p.p_partkey % 5 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 3 END AS visibility_level,
  p.p_partkey AS symbol_id
FROM {part} p JOIN {ix_files} f ON f.doc_id = p.p_partkey % 200""",
    "ix_refs": """
SELECT f.project, f.path AS file,
  CASE l.l_linenumber % 3 WHEN 0 THEN concat('self.', replace(p.p_name, ' ', '_'))
    WHEN 1 THEN replace(p.p_name, ' ', '_')
    ELSE concat(replace(p.p_brand, '#', '_'), '.', replace(p.p_name, ' ', '_')) END AS name,
  CASE l.l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'import' ELSE 'type_annotation' END AS kind,
  CAST(l.l_quantity AS INT) AS line_start, CAST(CAST(l.l_quantity AS INT) + l.l_linenumber % 3 AS INT) AS line_end,
  CASE WHEN l.l_suppkey % 9 <> 0 THEN concat('S', CAST(l.l_suppkey % 20 AS STRING), '.run_', lower(l.l_linestatus)) END AS caller
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {ix_files} f ON f.doc_id = l.l_orderkey % 200""",
    "ix_texts": """
SELECT f.project, f.path AS file,
  CASE c.role WHEN 'system' THEN 'docstring' WHEN 'user' THEN 'comment' ELSE 'string' END AS kind,
  CAST(c.turn + 1 AS INT) AS line_start, CAST(c.turn + 1 AS INT) AS line_end, c.text AS text,
  CASE WHEN c.turn > 0 THEN concat('C', CAST(c.conv_id AS STRING)) END AS parent
FROM {conversations} c JOIN {ix_files} f ON f.doc_id = c.conv_id % 200""",
    "ix_events": """
SELECT concat('f', CAST(user_id % 40 AS STRING), '.py') AS path,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'modify' END AS kind, ts, event_id AS seq
FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view; the tables it names are bound to this folder."""
    sql = VIEWS[name]
    bound = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    if "{ix_files}" in sql:
        bound["ix_files"] = view(spark, sf_dir, "ix_files")
    return spark.sql(sql, **bound)


def index(spark: SparkSession, sf_dir: str) -> Index:
    return Index(*(view(spark, sf_dir, f"ix_{k}") for k in ("files", "symbols", "texts", "refs")))


def duck_ctes(*names: str) -> str:
    """The views as a WITH clause for DuckDB, those they use first."""
    wanted = dict.fromkeys(["ix_files", *names] if any("{ix_files}" in VIEWS[n] for n in names) else names)
    plain = {t: t for t in [*TABLES, *VIEWS]}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in wanted)
