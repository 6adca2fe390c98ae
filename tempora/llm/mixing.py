"""Mixing sources to target weights by iterative proportional fitting, on SQL functions alone.

Tokens (words of the text) are summed into cells (source, language, topic).  The cells' weights
are raked: in turn for each dimension, the cells of each value are scaled to its target share, for
a fixed number of sweeps.  No cell gives more than its tokens: a weight counts up to its cap
``tokens / (budget * total)``, and the value's other cells make up for what is above it.  Targets
are the shares of tokens raised to ``temper`` and scaled to one, which lifts small sources; where a
value's tokens don't reach its target, they are its target and the others' rise in proportion.  A
cell's documents are then sampled with probability ``budget * weight * total / tokens``, by a
number in [0, 1) that their id's SHA-256 gives, so that the sample's expected tokens are the budget
and meet the targets as far as the cells allow.

The topic of a text, unless there is a column for it, is its form: tables, markup, long, short.
Null and empty texts have no tokens and are kept with probability 0; cells of no tokens take no
part.  Null sources, languages and topics are values of their own; a document with a null id is sampled as
the empty string is; rows that repeat an id are sampled alike; an empty table gives an empty
result.  Extra columns stay, whatever their names: the operator's own start with ``__mix_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.session import cut, discard, prepare, table_bytes

DIMS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
NONE = "\x00"


def topic(text, words):
    """The form of a text."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&<>", ""))
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    return F.when(F.lit(10) * bars > words, "table").when(F.lit(10) * symbols > words, "markup").when(words >= 400, "long").otherwise("short")


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with __mix_words and the three dimensions as __mix_<name>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    own = [c for c in docs.columns if c.lower() == "topic"]
    docs = docs.withColumn("__mix_words", words)
    return docs.withColumns({
        "__mix_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "__mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "__mix_topic": F.coalesce(F.col(own[0]).cast("string"), F.lit(NONE)) if own else topic(text, F.col("__mix_words")),
    })


def fitted(rows: DataFrame, by: list, goal) -> DataFrame:
    """Rows (weight, cap) with the weights of each group scaled so that, each counted up to its
    cap, they sum to ``goal``; all reach their caps where that is less.

    In order of cap over weight, the rows that reach their caps come first: the factor is the
    largest that some row gives if those before it do and it doesn't."""
    ratio = F.col("cap") / F.col("weight")
    group = Window.partitionBy(*(by or [F.lit(0)]))
    order = group.orderBy("ratio", *DIMS) if by else group.orderBy("ratio", "value")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("ratio", ratio).withColumn("factor", (goal - before) / rest)
    own = F.when(F.col("factor") <= F.col("ratio") * F.lit(1 + 1e-12), F.col("factor"))
    factor = F.coalesce(F.max(own).over(group), F.max("ratio").over(group))
    return rows.withColumn("factor", factor).withColumn("weight", F.col("weight") * F.col("factor")).drop("ratio", "factor")


def rake(cells: DataFrame, budget: float, temper: float, sweeps: int) -> DataFrame:
    """Cells (source, lang, topic, tokens) with their raked weight, at most their cap (sum 1).

    The cells are counts already: no step reads documents.  Each step scales a dimension's values
    and is cut, so that no plan grows with the sweeps.
    """
    total = cells.agg(F.sum("tokens").alias("total"))
    w = cells.join(F.broadcast(total)).withColumn("weight", F.col("tokens") / F.col("total"))  # one row
    w = w.withColumn("cap", F.col("weight") / F.lit(budget))
    for d in DIMS:
        value = w.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("weight"), F.lit(temper)).alias("weight"), F.sum("cap").alias("cap"))
        value = fitted(value, [], F.lit(1.0)).select(F.col("value").alias(d), F.least("weight", "cap").alias(f"target_{d}"))
        w = w.join(value, d)
    w = cut(w.select(*DIMS, "tokens", "total", "weight", "cap", *(f"target_{d}" for d in DIMS)), "rake")
    for _ in range(sweeps):
        for d in DIMS:
            new = cut(fitted(w, [d], F.col(f"target_{d}")).select(*w.columns), "rake")
            discard(w)
            w = new
    return w.withColumn("weight", F.least("weight", "cap"))


def probabilities(keys: DataFrame, budget: float, temper: float, sweeps: int) -> DataFrame:
    """A row for each cell: its tokens, raked weight and sampling probability."""
    cells = keys.filter("__mix_words > 0").groupBy(*(F.col(f"__mix_{d}").alias(d) for d in DIMS)).agg(F.sum("__mix_words").alias("tokens"))
    w = rake(cut(cells, "cells"), budget, temper, sweeps)
    return w.select(*DIMS, "tokens", "weight", (F.col("weight") / F.col("cap")).alias("probability"))


def chance(ident):
    """A number in [0, 1) that an id gives."""
    digest = F.sha2(F.coalesce(ident.cast("string"), F.lit("")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _cells(keys: DataFrame, budget: float, temper: float, sweeps: int, broadcast_bytes: int) -> DataFrame:
    cells = cut(probabilities(keys, budget, temper, sweeps), "probabilities")
    named = cells.select(*(F.col(d).alias(f"__mix_{d}") for d in DIMS), F.col("weight").alias("__mix_weight"), F.col("probability").alias("__mix_probability"))
    return F.broadcast(named) if table_bytes(cells) <= broadcast_bytes else named


def sampled(docs: DataFrame, *, budget: float = 0.7, temper: float = 0.7, sweeps: int = 8, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The sampled rows of documents, all columns as they were."""
    prepare(docs.sparkSession)
    names = docs.columns
    rows = keyed(docs)
    keys = cut(rows.select("__mix_words", *(f"__mix_{d}" for d in DIMS)).groupBy(*(f"__mix_{d}" for d in DIMS)).agg(F.sum("__mix_words").alias("__mix_words")), "keys")
    cells = _cells(keys, budget, temper, sweeps, broadcast_bytes)
    out = rows.filter("__mix_words > 0").join(cells, [f"__mix_{d}" for d in DIMS])
    return out.filter(chance(F.col("doc_id")) < F.col("__mix_probability")).select(*names)


def mixed(docs: DataFrame, *, budget: float = 0.7, temper: float = 0.7, sweeps: int = 8, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Every row: doc_id, its cell and tokens, the cell's raked weight and probability, and kept."""
    prepare(docs.sparkSession)
    keys = cut(keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "__mix_words", *(f"__mix_{d}" for d in DIMS)), "keys")
    cells = _cells(keys, budget, temper, sweeps, broadcast_bytes)
    out = keys.join(cells, [f"__mix_{d}" for d in DIMS], "left")
    p = F.when(F.col("__mix_words") > 0, F.col("__mix_probability")).otherwise(0.0)
    six = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    return out.select(
        "doc_id", *(F.col(f"__mix_{d}").alias(d) for d in DIMS), F.col("__mix_words").alias("n_tokens"),
        six(F.coalesce("__mix_weight", F.lit(0.0))).alias("weight"), six(p).alias("probability"), (chance(F.col("doc_id")) < p).alias("kept"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _fitted_sql(rows: str, by: str, goal: str, order: str, columns: str) -> str:
    """``fitted`` in SQL: ``columns`` and the new weight."""
    part = f"PARTITION BY {by} " if by else ""
    over = f"({part}ORDER BY ratio, {order} ROWS BETWEEN"
    step = f"SELECT *, cap / weight AS ratio FROM {rows}"
    step = f"SELECT *, ({goal} - coalesce(sum(cap) OVER {over} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER {over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM ({step})"
    step = f"SELECT *, coalesce(max(CASE WHEN f <= ratio * (1 + 1e-12::DOUBLE) THEN f END) OVER ({part}), max(ratio) OVER ({part})) AS factor FROM ({step})"
    return f"SELECT {columns}, weight * factor AS weight FROM ({step})"


def _sql(budget: float = 0.7, temper: float = 0.7, sweeps: int = 8) -> str:
    """The same raking with caps, a table for each step."""
    steps = [
        r"""k AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents)""",
        """d AS (SELECT doc_id, source, lang, n, CASE WHEN 10 * (length(t) - length(replace(t, '|', ''))) > n THEN 'table'
  WHEN 10 * (length(t) - length(translate(t, '#*$%&<>', ''))) > n THEN 'markup' WHEN n >= 400 THEN 'long' ELSE 'short' END AS topic FROM k)""",
        "c AS (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM d WHERE n > 0 GROUP BY ALL)",
        f"w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight, tokens / sum(tokens) OVER () / {budget}::DOUBLE AS cap FROM c)",
    ]
    for x in DIMS:
        steps.append(f"u_{x} AS (SELECT {x}, pow(sum(weight), {temper}) AS weight, sum(cap) AS cap FROM w0 GROUP BY {x})")
        steps.append(f"t_{x} AS (SELECT {x}, least(weight, cap) AS target_{x} FROM ({_fitted_sql(f'u_{x}', '', '1.0::DOUBLE', x, f'{x}, cap')}))")
    steps.append("r0 AS (SELECT w0.*, target_source, target_lang, target_topic FROM w0 JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    at = 0
    for _ in range(sweeps):
        for x in DIMS:
            steps.append(f"r{at + 1} AS MATERIALIZED ({_fitted_sql(f'r{at}', x, f'target_{x}', 'source, lang, topic', 'source, lang, topic, cap, target_source, target_lang, target_topic')})")
            at += 1
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, d.source, d.lang, d.topic, n AS n_tokens, floor(coalesce(weight, 0) * 1e6 + 0.5) / 1e6 AS weight,
  floor(p * 1e6 + 0.5) / 1e6 AS probability, ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p AS kept
FROM (SELECT d.*, least(weight, cap) AS weight, CASE WHEN n > 0 THEN least(weight, cap) / cap ELSE 0.0 END AS p
      FROM d LEFT JOIN r{at} r ON d.source = r.source AND d.lang = r.lang AND d.topic = r.topic) d
"""


OP2_SQL = _sql()
