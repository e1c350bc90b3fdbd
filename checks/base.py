"""Shared parts of the registered queries: derived inputs, one spec of output columns for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Derived inputs. The text runs in both engines; {name} is the table.
SHARED = {
    "fx_images": """
SELECT CAST(p_partkey AS BIGINT) AS image_id, CAST(64 + (p_partkey*37) % 200 AS INT) AS width,
 CAST(48 + (p_partkey*53) % 150 AS INT) AS height, CAST(p_partkey % 10 AS INT) AS exif_orientation,
 CAST((p_partkey*3 + p_size) % 10 AS INT) AS xmp_orientation, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 3 END AS ncomp,
 CAST(1 + p_partkey % 2 AS INT) AS h0, CAST(1 + CAST(floor(p_partkey / 2.0) AS BIGINT) % 2 AS INT) AS v0,
 p_partkey % 17 = 0 AS read_only, p_size % 2 = 0 AS trim_ok, CAST(p_size AS INT) AS p_size FROM {part}""",
    "fx_pixels": """
SELECT CAST(l_orderkey AS BIGINT) AS image_id, CAST(l_linenumber AS INT) AS x, CAST((l_partkey*7) % 256 AS INT) AS r,
 CAST((l_suppkey*29) % 256 AS INT) AS g, CAST((CAST(l_quantity AS BIGINT)*5) % 256 AS INT) AS b,
 CAST(l_partkey % 256 AS INT) AS k FROM {lineitem}""",
    "fx_crops": """
SELECT CAST(l_orderkey AS BIGINT) AS image_id, CAST(l_linenumber AS INT) AS line,
 CAST(64 + l_partkey % 40 AS INT) AS width, CAST(48 + l_suppkey % 30 AS INT) AS height,
 CASE WHEN l_partkey % 3 = 0 THEN 16 ELSE 8 END AS unit,
 CASE WHEN l_linenumber % 4 = 0 THEN 'wipe' WHEN l_linenumber % 4 = 1 THEN 'rot_90' ELSE 'none' END AS transform,
 concat(CAST(8 + l_partkey % 80 AS STRING), CASE WHEN l_partkey % 7 = 0 THEN 'f' ELSE '' END, 'x',
  CAST(8 + l_suppkey % 60 AS STRING), CASE WHEN l_suppkey % 5 = 0 THEN 'F' ELSE '' END, '+',
  CAST(l_partkey % 50 AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END,
  CAST(l_suppkey % 20 AS STRING), CASE WHEN l_partkey % 31 = 0 THEN '!' ELSE '' END) AS spec,
 CAST(8 + l_partkey % 80 AS BIGINT) AS sw, CAST(8 + l_suppkey % 60 AS BIGINT) AS sh,
 CAST(l_partkey % 50 AS BIGINT) AS sx, CAST(l_suppkey % 20 AS BIGINT) AS sy,
 l_partkey % 7 = 0 AS w_force, l_suppkey % 5 = 0 AS h_force, l_linenumber % 2 = 0 AS y_neg,
 l_partkey % 31 = 0 AS broken FROM {lineitem}""",
    "fx_run_log": """
SELECT CAST(user_id AS BIGINT) AS run_id, CAST(event_id AS BIGINT) AS image_id, ts,
 CASE event_type WHEN 'view' THEN 'selected' WHEN 'click' THEN 'analysed' WHEN 'signup' THEN 'to_be_rotated'
  WHEN 'purchase' THEN 'rotated' ELSE 'errored' END AS event FROM {events}""",
    "fx_status": """
SELECT CAST(o_orderkey AS BIGINT) AS run_id, CAST(o_orderkey % 4 AS BIGINT) AS selected,
 CAST(o_custkey % 4 AS BIGINT) AS analysed, CAST(CAST(floor(o_orderkey / 4.0) AS BIGINT) % 3 AS BIGINT) AS to_be_rotated,
 CAST(CAST(floor(o_custkey / 4.0) AS BIGINT) % 3 AS BIGINT) AS rotated, CAST(o_custkey % 2 AS BIGINT) AS errored
FROM {orders}""",
    "fx_scans": """
SELECT CAST(o_custkey AS BIGINT) AS image_id, CAST(o_orderkey AS BIGINT) AS seq, CAST(o_orderkey % 3 AS INT) AS ci,
 CAST((o_orderkey + 1) % 2 AS INT) AS tq,
 CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS ss, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 5 END AS se,
 CAST(o_custkey % 3 AS INT) AS ah, CAST(o_orderkey % 3 AS INT) AS al FROM {orders} WHERE o_orderkey % 2 = 1""",
    "fx_tables": """
SELECT CAST(o_custkey AS BIGINT) AS image_id, CAST(o_orderkey AS BIGINT) AS seq, CAST(o_orderkey % 4 AS INT) AS slot,
 CAST(1 + o_orderkey % 60 AS INT) AS qv FROM {orders} WHERE o_orderkey % 2 = 0""",
}

def both(text: str) -> tuple[str, str]:
    """Text for Spark and for DuckDB: ARR(..) is an array, EXPL[..] one row per value."""
    spark = re.sub(r"EXPL\[([^]]*)\]", r"explode(array(\1))", text)
    duck_text = re.sub(r"EXPL\[([^]]*)\]", r"unnest([\1])", text)
    return spark.replace("ARR(", "array("), duck_text.replace("ARR(", "list_value(")


# Derived inputs over arrays differ only in the lambda syntax: (shared head, Spark, DuckDB).
_VEC = "SELECT CAST(floor(vec_id/20.0) AS BIGINT) AS image_id, CAST(floor((vec_id % 20)/5.0) AS INT) AS by_, CAST(vec_id % 5 AS INT) AS bx, "
_MVEC = """SELECT CAST(floor(vec_id/24.0) AS BIGINT) AS image_id,
 CASE WHEN vec_id % 24 < 16 THEN 0 WHEN vec_id % 24 < 20 THEN 1 ELSE 2 END AS ci,
 CASE WHEN vec_id % 24 < 16 THEN 2 ELSE 1 END AS h, CASE WHEN vec_id % 24 < 16 THEN 2 ELSE 1 END AS v,
 CASE WHEN vec_id % 24 < 16 THEN CAST(floor((vec_id % 24)/4.0) AS INT) ELSE CAST(floor((vec_id % 4)/2.0) AS INT) END AS by_,
 CASE WHEN vec_id % 24 < 16 THEN CAST(vec_id % 4 AS INT) ELSE CAST(vec_id % 2 AS INT) END AS bx, """
_COEF_S = "transform(embedding, e -> CAST(floor(CAST(e AS DOUBLE)*100 + 0.5) AS INT)) AS coef FROM {embeddings}"
_COEF_D = "list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE)*100 + 0.5) AS INT)) AS coef FROM {embeddings}"
_SPARSE_S = "transform(embedding, e -> CAST(CAST(e AS DOUBLE)*12 AS INT)) AS coef FROM {embeddings}"
_SPARSE_D = "list_transform(embedding, lambda e: CAST(trunc(CAST(e AS DOUBLE)*12) AS INT)) AS coef FROM {embeddings}"
_SAMP_S = "transform(embedding, e -> CAST(least(255, greatest(0, floor(CAST(e AS DOUBLE)*256 + 128.5))) AS INT)) AS s FROM {embeddings}"
_SAMP_D = "list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor(CAST(e AS DOUBLE)*256 + 128.5))) AS INT)) AS s FROM {embeddings}"
SPLIT = {
    "fx_components": both("""
SELECT CAST(p_partkey AS BIGINT) AS image_id, ci, CASE WHEN ci = 0 THEN CAST(1 + p_partkey % 2 AS INT) ELSE 1 END AS h,
 CASE WHEN ci = 0 THEN CAST(1 + CAST(floor(p_partkey / 2.0) AS BIGINT) % 2 AS INT) ELSE 1 END AS v,
 CASE WHEN ci = 0 THEN 0 ELSE 1 END AS tq FROM (SELECT p_partkey, EXPL[0, 1, 2] AS ci FROM {part}) c
 WHERE ci = 0 OR p_partkey % 5 <> 0"""),
    "fx_blocks": (_VEC + "0 AS ci, 1 AS h, 1 AS v, " + _COEF_S, _VEC + "0 AS ci, 1 AS h, 1 AS v, " + _COEF_D),
    "fx_mblocks": (_MVEC + _COEF_S, _MVEC + _COEF_D),
    "fx_sparse": (_VEC + "0 AS ci, 1 AS h, 1 AS v, " + _SPARSE_S, _VEC + "0 AS ci, 1 AS h, 1 AS v, " + _SPARSE_D),
    "fx_sblocks": (_VEC + "0 AS ci, " + _SAMP_S, _VEC + "0 AS ci, " + _SAMP_D),
    "fx_samples": (
        "SELECT CAST(floor(vec_id/20.0) AS BIGINT) AS image_id, 0 AS ci, "
        "CAST(floor((vec_id % 20)/5.0) AS INT)*8 + CAST(floor(i/8.0) AS INT) AS y, "
        "CAST(vec_id % 5 AS INT)*8 + CAST(i % 8 AS INT) AS x, "
        "CAST(least(255, greatest(0, floor(CAST(e AS DOUBLE)*256 + 128.5))) AS INT) AS v "
        "FROM (SELECT vec_id, i, e FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS i, e)",
        "SELECT CAST(floor(vec_id/20.0) AS BIGINT) AS image_id, 0 AS ci, "
        "CAST(floor((vec_id % 20)/5.0) AS INT)*8 + CAST(floor(i/8.0) AS INT) AS y, "
        "CAST(vec_id % 5 AS INT)*8 + CAST(i % 8 AS INT) AS x, "
        "CAST(least(255, greatest(0, floor(CAST(e AS DOUBLE)*256 + 128.5))) AS INT) AS v "
        "FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS e FROM {embeddings})",
    ),
}


def _inline(text: str) -> str:
    """Put the text of other derived inputs in place of their names."""
    return re.sub(r"\bfx_\w+", lambda m: f"({_inline(SHARED.get(m.group(0)) or SPLIT[m.group(0)][0])})", text)


def _needed(text: str, seen: dict) -> dict:
    for n in re.findall(r"\bfx_\w+", text):
        if n not in seen and (n in SHARED or n in SPLIT):
            inner = SHARED.get(n) or SPLIT[n][1]
            _needed(inner, seen)
            seen[n] = inner
    return seen


def spark_fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame; ``by_`` is renamed to the library's ``by``."""
    text = _inline(SHARED.get(name) or SPLIT[name][0])
    filled = re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", text)
    df = spark.sql(filled)
    if name == "fx_images":
        df = df.withColumnRenamed("trim_ok", "trim").withColumn("max_h", F.col("h0")).withColumn("max_v", F.col("v0"))
    return df.withColumnRenamed("by_", "by")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str = "image_id") -> DataFrame:
    """The same rows dealt to four tasks a core: a source table may be one small file whose rows grow many-fold."""
    return df.repartition(max(16, 4 * df.sparkSession.sparkContext.defaultParallelism), key)


def duck(body: str) -> str:
    """Prefix the derived inputs that ``body`` mentions."""
    ctes = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', text)})" for n, text in _needed(body, {}).items()]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        head, rest = "WITH RECURSIVE ", body[len("WITH RECURSIVE"):]
        return head + ", ".join(ctes) + (", " if ctes else "") + rest
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + (", " if ctes else "") + body[5:]
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


SPARK_TYPES = {"i": "bigint", "s": "string", "b": "boolean"}


def _spec(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) if ":" in part else (part, "i") for part in spec.split()]


def spark_out(df: DataFrame, spec: str) -> DataFrame:
    """Select the listed columns with plain types: i integer, f number to 4 places, s text, b flag, a list, x bytes."""
    cols = []
    for name, kind in _spec(spec):
        c = F.col(name)
        if kind == "f":
            c = F.round(c.cast("double"), 4) + F.lit(0.0)
        elif kind == "a":
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind == "x":
            c = F.hex(c)
        else:
            c = c.cast(SPARK_TYPES[kind])
        cols.append(c.alias(name))
    return df.select(*cols)


def duck_out(sql: str, spec: str) -> str:
    cols = []
    for name, kind in _spec(spec):
        if kind == "f":
            c = f"round(CAST({name} AS DOUBLE), 4) + 0.0"
        elif kind == "a":
            c = f"array_to_string({name}, ',')"
        elif kind == "x":
            c = f"upper(CAST({name} AS VARCHAR))"
        else:
            c = f"CAST({name} AS {'BIGINT' if kind == 'i' else 'VARCHAR' if kind == 's' else 'BOOLEAN'})"
        cols.append(f"{c} AS {name}")
    return f"SELECT {', '.join(cols)} FROM ({sql}) AS q_"


REGISTRY: dict[str, tuple] = {}


def register(name: str, spec: str, sql: str | None = None):
    """Register a query: a function of (spark, sf_dir) giving at least the columns of ``spec``, and its SQL twin."""

    def wrap(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = (
            lambda spark, sf_dir: spark_out(fn(spark, sf_dir), spec),
            duck_out(duck(sql), spec) if sql else None,
        )
        return fn

    return wrap
