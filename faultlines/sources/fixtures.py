"""Log, rule and request tables derived from the test tables.

The SQL texts run unchanged in Spark and in the checking engine, so both read the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import utf16_length
from faultlines.operators.sizing import fits
from faultlines.sources.logs import build_context, join_chunks, oversize_logs

# No chunk of the fixture is longer: fixed text of fewer than 200 characters and at most six numbers or names.
LONGEST_CHUNK = 400

CHUNKS_SQL = """
WITH src AS (
  SELECT l_orderkey AS log_id, l_partkey AS pk, l_suppkey AS sk, l_quantity, l_returnflag AS rf, l_linenumber, l_extendedprice,
         l_discount, l_tax, l_linestatus, l_shipdate
  FROM {lineitem}),
li AS (
  SELECT log_id, pk, sk, CAST(l_quantity AS INT) AS qty,
         CAST(row_number() OVER (PARTITION BY log_id ORDER BY l_linenumber, pk, sk, l_extendedprice, l_quantity, l_discount, l_tax, rf, l_linestatus, l_shipdate) AS INT) AS n
  FROM src),
k AS (SELECT *, CAST(log_id % 6 AS INT) AS tk, CAST(pk % 5 AS INT) AS v, chr(39) AS q, chr(34) AS dq, chr(10) AS nl FROM li)
SELECT log_id, n, tk, CASE
 WHEN tk = 0 THEN CASE v
   WHEN 0 THEN 'src/P' || CAST(sk AS STRING) || '.cs(' || CAST(qty AS STRING) || ',' || CAST(n AS STRING) || '): error CS0103: The name ' || q || 'v' || CAST(pk AS STRING) || q || ' does not exist in the current context'
   WHEN 1 THEN 'src/P' || CAST(sk AS STRING) || '.cs(' || CAST(qty AS STRING) || ',' || CAST(n AS STRING) || '): warning CS8618: Non-nullable property ' || q || 'N' || CAST(pk AS STRING) || q || ' must contain a non-null value when exiting constructor. [app' || CAST(log_id % 7 AS STRING) || '.csproj]'
   WHEN 2 THEN 'error MSB3021: Unable to copy file ' || dq || 'obj/' || CAST(pk AS STRING) || dq || ' to ' || dq || 'bin/' || CAST(sk AS STRING) || dq || '.'
   WHEN 3 THEN 'app' || CAST(log_id % 7 AS STRING) || '.csproj : error NU1101: Unable to find package ' || CAST(pk % 10 AS STRING) || CASE WHEN sk % 2 = 0 THEN nl || '  See nuget docs' ELSE '' END
   ELSE 'Build started...' END
 WHEN tk = 1 THEN CASE WHEN v < 2 THEN 'src/a' || CAST(sk AS STRING) || '.ts:' || CAST(qty AS STRING) || ':' || CAST(n AS STRING) || ' - error TS2304: Cannot find name ' || q || 'u' || CAST(pk AS STRING) || q || '.' || nl || nl || CAST(qty AS STRING) || ' let x' || nl || '    ~~~'
   WHEN v = 2 THEN 'src/a' || CAST(sk AS STRING) || '.ts(' || CAST(qty AS STRING) || ',' || CAST(n AS STRING) || '): error TS2322: Type ' || q || 'T' || CAST(pk AS STRING) || q || ' is not assignable to type ' || q || 'U' || q || '.'
   WHEN v = 3 THEN 'src/a' || CAST(sk AS STRING) || '.ts(' || CAST(qty AS STRING) || ',' || CAST(n AS STRING) || '): warning TS2307: Cannot find module ' || q || 'm' || CAST(pk AS STRING) || q || ' or its corresponding type declarations.'
   ELSE 'Found ' || CAST(n AS STRING) || ' errors.' END
 WHEN tk = 2 THEN 'Traceback (most recent call last):' || nl || '  File ' || dq || 'src/m' || CAST(sk AS STRING) || '.py' || dq || ', line ' || CAST(qty AS STRING) || ', in run' || nl || '    f()' || nl || CASE v
   WHEN 0 THEN 'NameError: name ' || q || 'n' || CAST(pk AS STRING) || q || ' is not defined'
   WHEN 1 THEN 'ModuleNotFoundError: No module named ' || q || 'mod' || CAST(pk AS STRING) || q
   WHEN 2 THEN 'KeyError: ' || q || 'k' || CAST(pk AS STRING) || q
   WHEN 3 THEN CASE WHEN sk % 2 = 0 THEN 'ValueError: bad value ' || CAST(pk AS STRING) ELSE '    if True print(1)' || nl || '            ^' || nl || 'SyntaxError: invalid syntax' END
   ELSE 'not an exception line' END
 WHEN tk = 3 THEN CASE v WHEN 0 THEN 'npm ERR! Missing script: ' || dq || 's' || CAST(pk AS STRING) || dq WHEN 1 THEN 'npm ERR! code ERESOLVE' WHEN 2 THEN 'npm ERR! path /app/' || CAST(sk AS STRING) || '/package.json' WHEN 3 THEN 'npm ERR! code ENOENT' ELSE 'npm ERR! enoent Could not read package.json: Error: ENOENT: no such file or directory, open ' || q || '/app/' || CAST(sk AS STRING) || '/package.json' || q END
 WHEN tk = 4 THEN CASE v WHEN 0 THEN '[vite]: Rollup failed to resolve import ' || dq || 'i' || CAST(pk AS STRING) || dq || ' from ' || dq || '/src/m' || CAST(sk AS STRING) || '.ts' || dq || '.' WHEN 1 THEN 'src/b.ts (' || CAST(qty AS STRING) || ':' || CAST(n AS STRING) || '): Unexpected token' WHEN 2 THEN 'src/c.ts (' || CAST(qty AS STRING) || ':' || CAST(n AS STRING) || '): ' || dq || 'S' || CAST(pk AS STRING) || dq || ' is not exported by ' || dq || 'src/d' || CAST(sk AS STRING) || '.ts' || dq || ', imported by ' || dq || 'src/c.ts' || dq || '.' WHEN 3 THEN 'vite v5.0.0 building' || nl || 'plugin ' || CAST(sk AS STRING) || ' failed' || nl || 'file: /src/x.ts:' || CAST(qty AS STRING) || ':' || CAST(n AS STRING) ELSE 'transforming...' END
 ELSE 'step ' || CAST(n AS STRING) || ' ok' END AS chunk
FROM k
"""

META_SQL = """
SELECT l.log_id, o.o_orderdate AS created_at,
       'proj' || CAST(o.o_custkey % 7 AS STRING) AS project_name,
       'repo' || o.o_orderstatus AS repository,
       CASE WHEN l.log_id % 11 = 0 THEN 'SingleDiagnostic' ELSE 'BuildLog' END AS input_type,
       CASE WHEN l.log_id % 13 = 0 THEN 'tsc' ELSE NULL END AS tool_hint
FROM {logs} l LEFT JOIN {orders} o ON o.o_orderkey = l.log_id
"""

RULES_SQL = """
SELECT * FROM (VALUES
 (1,'cs0103 guide',true,100,'DotNet','CS0103',NULL,NULL,NULL,NULL,NULL,NULL,NULL,'Fix the name',NULL,'Check spelling.',0.05,false),
 (2,'all warnings',true,50,NULL,NULL,'Warning',NULL,NULL,NULL,NULL,NULL,NULL,NULL,'Usually noise.',NULL,-0.10,false),
 (3,'dependency',true,80,NULL,NULL,NULL,'Dependency',NULL,NULL,NULL,NULL,NULL,'Missing dependency',NULL,'Restore packages.',0.0,true),
 (4,'project files',true,70,NULL,NULL,NULL,NULL,NULL,'[.]csproj$',NULL,NULL,NULL,NULL,'Look at the project file.',NULL,0.0,false),
 (5,'copy locked',true,90,'DotNet',NULL,NULL,NULL,'unable to copy',NULL,NULL,NULL,NULL,'Locked output',NULL,'Close the process.',0.02,false),
 (6,'python names',true,60,NULL,NULL,NULL,NULL,NULL,NULL,'fp_python_nameerror_not_defined',NULL,NULL,NULL,NULL,'Define the name.',0.01,true),
 (7,'project 3 only',true,40,NULL,NULL,'Error',NULL,NULL,NULL,NULL,'proj3',NULL,'Team rule',NULL,NULL,0.03,false),
 (8,'repo F',true,30,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,'repoF',NULL,NULL,'Ask the owners.',0.0,false),
 (9,'disabled',false,999,NULL,NULL,'Error',NULL,NULL,NULL,NULL,NULL,NULL,'never',NULL,NULL,0.5,true)
) AS r(rule_id,name,is_enabled,priority,tool_kind,code,severity,category,message_regex,file_path_regex,fingerprint,project_name,repository,title,explanation,suggested_fix,confidence_adjustment,mark_primary)
"""

# Rule drafts as users might submit them, one per part: some fields are missing, wrong or repeated.
DRAFTS_SQL = """
SELECT p_partkey AS rule_id,
       CASE WHEN p_partkey % 23 = 5 THEN '  ' ELSE p_name || ' ' || CAST(p_partkey % 499 AS STRING) END AS name,
       p_size % 3 <> 0 AS is_enabled,
       CAST(p_size AS INT) AS priority,
       CASE p_partkey % 6 WHEN 0 THEN 'dotnet' WHEN 1 THEN ' TSC ' WHEN 2 THEN 'cobol' ELSE NULL END AS tool_kind,
       CASE WHEN p_partkey % 7 = 3 THEN p_brand ELSE NULL END AS code,
       CASE p_partkey % 8 WHEN 0 THEN 'warning' WHEN 1 THEN 'loud' ELSE NULL END AS severity,
       CASE p_partkey % 9 WHEN 0 THEN 'missing-symbol' WHEN 1 THEN 'misc' ELSE NULL END AS category,
       CASE WHEN p_partkey % 10 = 4 THEN p_name ELSE NULL END AS message_regex,
       CASE WHEN p_partkey % 12 = 5 THEN '[.]cs$' ELSE NULL END AS file_path_regex,
       CAST(NULL AS STRING) AS fingerprint,
       CASE WHEN p_partkey % 40 = 7 THEN repeat(p_type, 40) ELSE NULL END AS project_name,
       CASE WHEN p_partkey % 15 = 8 THEN p_type ELSE NULL END AS repository,
       CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE NULL END AS title,
       CAST(NULL AS STRING) AS explanation,
       CASE WHEN p_partkey % 5 = 1 THEN 'Check ' || p_name ELSE NULL END AS suggested_fix,
       CASE WHEN p_partkey % 3 = 1 THEN 0.05 ELSE 0.0 END AS confidence_adjustment,
       p_partkey % 11 = 2 AS mark_primary,
       p_brand AS tag,
       CAST(p_partkey % 13 AS BIGINT) AS match_count
FROM {part}
"""

# One rule for every part; each third rule also tests a regex, each seventh is disabled.
MANY_RULES_SQL = """
SELECT p_partkey AS rule_id, 'part rule ' || CAST(p_partkey AS STRING) AS name, p_partkey % 7 <> 3 AS is_enabled,
       CAST(p_size AS INT) AS priority, CAST(NULL AS STRING) AS tool_kind,
       CASE p_partkey % 6 WHEN 0 THEN 'CS0103' WHEN 1 THEN 'ts2304' WHEN 2 THEN 'NameError' WHEN 3 THEN 'ERESOLVE' WHEN 4 THEN 'TS2322' ELSE NULL END AS code,
       CASE WHEN p_partkey % 4 = 1 THEN 'Error' ELSE NULL END AS severity, CAST(NULL AS STRING) AS category,
       CASE WHEN p_partkey % 3 = 2 THEN 'n' ELSE NULL END AS message_regex, CAST(NULL AS STRING) AS file_path_regex,
       CAST(NULL AS STRING) AS fingerprint, 'PROJ' || CAST(p_partkey % 9 AS STRING) AS project_name,
       CASE WHEN p_partkey % 5 = 0 THEN 'repoO' ELSE NULL END AS repository, p_name AS title, CAST(NULL AS STRING) AS explanation,
       CAST(NULL AS STRING) AS suggested_fix, 0.01 AS confidence_adjustment, false AS mark_primary
FROM {part}
"""

# Rules of nothing but regexes: with a literal in the message (two kinds) or the path, or, one in fifty, without a literal.
REGEX_RULES_SQL = """
SELECT p_partkey AS rule_id, 'regex rule ' || CAST(p_partkey AS STRING) AS name, p_partkey % 7 <> 3 AS is_enabled,
       CAST(p_size AS INT) AS priority, CAST(NULL AS STRING) AS tool_kind, CAST(NULL AS STRING) AS code, CAST(NULL AS STRING) AS severity,
       CAST(NULL AS STRING) AS category,
       CASE WHEN p_partkey % 50 = 8 THEN '(plugin|package) ' || CAST(p_partkey % 11 AS STRING) WHEN p_partkey % 3 = 0 THEN 'find +PACKAGE ' || CAST(p_partkey % 400 AS STRING) || '$'
         WHEN p_partkey % 3 = 1 THEN '(plug)?in ' || CAST(p_partkey % 400 AS STRING) || ' failed' ELSE NULL END AS message_regex,
       CASE WHEN p_partkey % 50 <> 8 AND p_partkey % 3 = 2 THEN 'SRC/[ab]?a' || CAST(p_partkey % 400 AS STRING) || '[.]ts+$' ELSE NULL END AS file_path_regex,
       CAST(NULL AS STRING) AS fingerprint, CAST(NULL AS STRING) AS project_name, CAST(NULL AS STRING) AS repository, p_name AS title,
       CAST(NULL AS STRING) AS explanation, CAST(NULL AS STRING) AS suggested_fix, 0.01 AS confidence_adjustment, false AS mark_primary
FROM {part}
"""

_OVERSIZE: dict[tuple[str, str, int], bool] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.col("l_orderkey").alias("log_id"))


def oversize(spark: SparkSession, sf_dir: str, max_chars: int = C.MAX_CONTENT_CHARS) -> DataFrame:
    """Ids of the logs with more than ``max_chars`` characters, exactly. Only logs with chunks enough to get there are
    measured."""
    lineitem = table(spark, sf_dir, "lineitem")
    possible = oversize_logs(_keyed(lineitem), F.lit(LONGEST_CHUNK), max_chars)
    suspects = lineitem.join(possible.withColumnRenamed("log_id", "l_orderkey"), "l_orderkey", "left_semi")
    return oversize_logs(spark.sql(CHUNKS_SQL, lineitem=suspects), utf16_length(F.col("chunk")), max_chars)


def chunks(spark: SparkSession, sf_dir: str, max_chars: int = C.MAX_CONTENT_CHARS) -> DataFrame:
    """Chunks of all logs within the size limit.

    Whether any log is over the limit is asked once per session, folder and limit; usually none is, and
    then no join is planned.
    """
    lineitem = table(spark, sf_dir, "lineitem")
    key = (spark.sparkContext.applicationId, sf_dir, max_chars)
    if key not in _OVERSIZE:
        _OVERSIZE[key] = not fits(oversize(spark, sf_dir, max_chars), 0)
    if _OVERSIZE[key]:
        too_long = oversize(spark, sf_dir, max_chars).withColumnRenamed("log_id", "l_orderkey")
        lineitem = lineitem.join(too_long, "l_orderkey", "left_anti")
    return spark.sql(CHUNKS_SQL, lineitem=lineitem)


def _submitted(spark: SparkSession, sf_dir: str, assembled: DataFrame) -> DataFrame:
    meta = META_SQL.replace("SELECT l.log_id,", "SELECT l.log_id, l.content,")
    return spark.sql(meta, logs=assembled, orders=table(spark, sf_dir, "orders")).withColumns(
        {
            "persist": F.col("log_id") % 5 != 0,
            "store_raw": (F.col("log_id") % 5 != 0) & (F.col("log_id") % 3 == 0),
        }
    )


def logs(spark: SparkSession, sf_dir: str, max_chars: int = C.MAX_CONTENT_CHARS) -> DataFrame:
    """Logs of at most ``max_chars`` characters; the others are those of ``oversize``, see ``oversize_requests``."""
    return _submitted(spark, sf_dir, join_chunks(chunks(spark, sf_dir, max_chars)))


def oversize_requests(spark: SparkSession, sf_dir: str, max_chars: int = C.MAX_CONTENT_CHARS) -> DataFrame:
    """Submissions of the over-long logs, without content and flagged ``too_long``; one whose content was blanked by a
    fault is blank and no longer over-long."""
    ids = oversize(spark, sf_dir, max_chars).withColumn("content", F.lit(None).cast("string"))
    return _faulty(_submitted(spark, sf_dir, ids)).withColumn("too_long", F.col("content").isNull())


def requests(spark: SparkSession, sf_dir: str, max_chars: int = C.MAX_CONTENT_CHARS) -> DataFrame:
    """Log submissions with faults: blank content, unknown tools, raw storage without persistence."""
    return _faulty(logs(spark, sf_dir, max_chars))


def with_context(submitted: DataFrame) -> DataFrame:
    """Adds the context map. Single diagnostics say nothing of their environment."""
    log = F.col("log_id")
    whole = F.col("input_type") == "BuildLog"
    return submitted.withColumn("context", build_context({
        "projectName": F.concat(F.lit(" "), F.col("project_name")),
        "repository": F.when(log % 4 == 0, F.lit("  ")).otherwise(F.col("repository")),
        "branch": F.when(log % 3 == 0, F.lit("main ")),
        "commitSha": F.when((log % 10).isin(1, 2), F.substring(F.sha2(log.cast("string"), 256), 1, 12)),
        "environment.os": F.when(whole & (log % 6 < 3), F.lit("linux")).when(whole & (log % 6 == 3), F.lit(" windows ")),
        "environment.ci": F.when(whole & (log % 5 > 1), (log % 5 == 2).cast("string")),
        "environment.machineName": F.when(whole & (log % 7 == 0), F.concat(F.lit("agent-"), (log % 9).cast("string"))),
    }))


def _faulty(submitted: DataFrame) -> DataFrame:
    return submitted.withColumns(
        {
            "content": F.when(F.col("log_id") % 19 == 4, F.lit(" \n ")).otherwise(F.col("content")),
            "tool_hint": F.when(F.col("log_id") % 17 == 3, F.lit("cobol"))
            .when(F.col("log_id") % 17 == 5, F.lit(" .NET "))
            .when(F.col("log_id") % 17 == 6, F.lit("generic"))
            .otherwise(F.col("tool_hint")),
            "store_raw": F.col("log_id") % 3 == 0,
        }
    )


def rules(spark: SparkSession) -> DataFrame:
    return rule_columns(spark.sql(RULES_SQL))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_columns(spark.sql(DRAFTS_SQL, part=table(spark, sf_dir, "part")))


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_columns(spark.sql(MANY_RULES_SQL, part=table(spark, sf_dir, "part")))


def regex_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_columns(spark.sql(REGEX_RULES_SQL, part=table(spark, sf_dir, "part")))


def rule_columns(flat: DataFrame) -> DataFrame:
    extra = {
        "suggested_fixes": F.array_compact(F.array("suggested_fix")),
        "confidence_adjustment": F.col("confidence_adjustment").cast("double"),
        "tags": F.array_compact(F.array("tag")) if "tag" in flat.columns else F.array().cast("array<string>"),
        "match_count": F.col("match_count") if "match_count" in flat.columns else F.lit(0).cast("long"),
        "last_matched_at": F.lit(None).cast("timestamp"),
        "description": F.lit(None).cast("string"),
    }
    return flat.withColumns(extra).drop("suggested_fix", "tag")
