"""The jobs as registered queries: each runs twice over a data folder into one new folder, and gives the output as it stands then; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import module_report, word_index
from loomdex.catalogue import RESOLVED
from loomdex.functions import text
from loomdex.runtime import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def job1_word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_folder(spark)}/word_index-{uuid.uuid4().hex}"
    for _ in range(2):
        found = word_index.run(spark, f"{sf_dir.rstrip('/')}/documents.parquet", out)
    return found


ORACLES["job1_word_index"] = f"""
WITH d AS (SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR) || '.txt') AS path, nullif(lang, '') AS language, min(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1, 2),
  w AS (SELECT path, unnest(regexp_extract_all(translate(text, '{text.UPPER}', '{text.LOWER}'), '[a-z0-9_]{{3,}}')) AS word FROM d),
  c AS (SELECT path, word, count(*) AS n FROM w GROUP BY 1, 2)
SELECT d.path, language, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size, word, n FROM d LEFT JOIN c ON c.path = d.path
"""


def job2_module_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/module_report-{uuid.uuid4().hex}"
    for _ in range(2):
        tables = module_report.run(spark, sf_dir, folder)
    given = {
        "module": "string", "symbol": "string", "other": "string", "other_module": "string",
        "calls": "long", "callers": "long", "callees": "long", "resolved": "long", "rank": "int", "rate": "double",
    }

    def shaped(report: str, rows: DataFrame) -> DataFrame:
        column = lambda c: F.col(c) if c in rows.columns else F.lit(None)
        return rows.select(F.lit(report).alias("report"), *[column(c).cast(kind).alias(c) for c, kind in given.items()])

    calls, names = tables["calls"], {"src": "symbol", "dst": "other", "dst_module": "other_module", "n": "calls"}
    out = shaped("calls", calls.withColumnsRenamed(names))
    for report in ("dependencies", "hottest", "rates"):
        out = out.unionByName(shaped(report, tables[report].withColumnsRenamed({"dst_module": "other_module"})))
    return out


ORACLES["job2_module_report"] = RESOLVED + """,
  home AS (SELECT qualified_name AS q, split_part(min(file), '/', 1) AS module FROM symbols GROUP BY 1),
  called AS (SELECT coalesce(h.module, '(none)') AS module, src_qname AS symbol, dst_qname AS other, t.module AS other_module, count(*) AS calls
    FROM resolved LEFT JOIN home h ON h.q = src_qname LEFT JOIN home t ON t.q = dst_qname GROUP BY 1, 2, 3, 4),
  hot AS (SELECT other_module AS module, other AS symbol, count(*) AS callers, CAST(sum(calls) AS BIGINT) AS calls FROM called WHERE other IS NOT NULL GROUP BY 1, 2),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY module ORDER BY callers DESC, symbol) AS INTEGER) AS rank FROM hot)
SELECT 'calls' AS report, module, symbol, other, other_module, calls, NULL::BIGINT AS callers, NULL::BIGINT AS callees, NULL::BIGINT AS resolved, NULL::INTEGER AS rank, NULL::DOUBLE AS rate FROM called
UNION ALL SELECT 'dependencies', module, NULL, NULL, other_module, CAST(sum(calls) AS BIGINT), count(DISTINCT symbol), count(DISTINCT other), NULL, NULL, NULL FROM called WHERE other IS NOT NULL GROUP BY module, other_module
UNION ALL SELECT 'hottest', module, symbol, NULL, NULL, calls, callers, NULL, NULL, rank, NULL FROM ranked WHERE rank <= 10
UNION ALL SELECT 'rates', module, NULL, NULL, NULL, CAST(sum(calls) AS BIGINT), NULL, NULL, CAST(coalesce(sum(calls) FILTER (other IS NOT NULL), 0) AS BIGINT), NULL,
  round(coalesce(sum(calls) FILTER (other IS NOT NULL), 0) / sum(calls), 4)::DOUBLE FROM called GROUP BY module
"""

QUERIES |= {f.__name__: f for f in (job1_word_index, job2_module_report)}
