"""The driver's tables seen as genomic ones. Each view is given as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BIN, BAND = 5_000, 60

VIEWS = {
    "chroms": "SELECT CAST(n_nationkey AS BIGINT) AS chrom_id, n_name AS chrom, 1000000 + 40000 * CAST(n_nationkey AS BIGINT) AS size FROM nation",
    "contacts": """SELECT chrom, size, pos1, least(size - 1, pos1 + (l_partkey * 37) % 400000) AS pos2, l_orderkey, l_linenumber
        FROM (SELECT c.chrom, c.size, l.l_partkey, l.l_orderkey, l.l_linenumber, (l.l_orderkey * 6151 + l.l_linenumber * 977) % c.size AS pos1 FROM lineitem l JOIN chroms c ON c.chrom_id = l.l_suppkey % 25) x""",
    "contacts_b": """SELECT chrom, size, pos1, least(size - 1, pos1 + (l_partkey * 41) % 400000) AS pos2
        FROM (SELECT c.chrom, c.size, l.l_partkey, (l.l_orderkey * 6151 + l.l_linenumber * 1009) % c.size AS pos1 FROM lineitem l JOIN chroms c ON c.chrom_id = l.l_suppkey % 25) x""",
    "barriers": """SELECT chrom, start, least(start + 19, size) AS "end", name, score, strand
        FROM (SELECT c.chrom, c.size, (p.p_partkey * 7919) % c.size AS start, p.p_name AS name, (p.p_size % 10) / CAST(10 AS DOUBLE) AS score, CASE p.p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand FROM part p JOIN chroms c ON c.chrom_id = p.p_partkey % 25) x""",
    "intervals": """SELECT interval_id, chrom, start, start + 200000 AS "end"
        FROM (SELECT s.s_suppkey AS interval_id, c.chrom, (s.s_suppkey * 104729) % (c.size - 200000) AS start FROM supplier s JOIN chroms c ON c.chrom_id = s.s_suppkey % 25) x""",
    "track": """SELECT chrom, start, start + 500 AS "end", value
        FROM (SELECT c.chrom, (e.event_id * 1237) % c.size AS start, e.value FROM events e JOIN chroms c ON c.chrom_id = e.user_id % 25) x WHERE value IS NOT NULL""",
    "lefs": """SELECT chrom, size, cell, lef_id, rev, least(size - 1, rev + (o_custkey * 53) % 30000) AS fwd, epoch, (lef_id * 31) % 4000 AS rev_move, (lef_id * 57) % 4000 AS fwd_move
        FROM (SELECT c.chrom, c.size, o.o_custkey % 4 AS cell, o.o_orderkey AS lef_id, o.o_custkey, (o.o_orderkey * 50021) % c.size AS rev, o.o_orderkey % 7 AS epoch FROM orders o JOIN chroms c ON c.chrom_id = o.o_custkey % 25) x""",
}
_NEEDS = {"contacts": ["chroms"], "contacts_b": ["chroms"], "barriers": ["chroms"], "intervals": ["chroms"], "track": ["chroms"], "lefs": ["chroms"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    sql = VIEWS[name].replace('"end"', "`end`")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "lineitem", "part", "supplier", "events", "orders") if f" {t}" in sql}
    frames |= {v: view(spark, sf_dir, v) for v in _NEEDS.get(name, [])}
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views before it."""
    wanted = list(dict.fromkeys(n for name in names for n in (*_NEEDS.get(name, []), name)))
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    sql = sql.strip()
    if sql.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {sql[14:].strip()}"
    return f"WITH {views}, {sql[4:].strip()}" if sql.startswith("WITH") else f"WITH {views} {sql}"
