"""Queries on texts, markup and arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions.sem import changed_fraction, contrast, luminance, mean_abs_diff, rms, six
from tempora.operators import text as tx

from .catalog import query


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _search(need: str) -> str:
    c = [f"(length(x) - length(replace(x, '{w}', ''))) // {len(w)}" for w in ("tion", "the ", "ing.")]
    return f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents), s AS (SELECT doc_id, {' + '.join(f'({y} > 0)::BIGINT' for y in c)} AS matched, ({' + '.join(c)})::BIGINT AS score FROM d)
SELECT * FROM s WHERE matched {need} ORDER BY matched DESC, score DESC, doc_id LIMIT 50"""


@query(_search("> 0"))
def ranked_search(spark, sf):
    return tx.ranked_search(t(spark, sf, "documents"), "doc_id", "text", ["tion", "the ", "ing."], 50)


@query(_search("= 3"))
def ranked_search_all(spark, sf):
    return tx.ranked_search(t(spark, sf, "documents"), "doc_id", "text", ["tion", "the ", "ing."], 50, every=True)


ASCII = r"regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')"
TURNS = f"c AS (SELECT conv_id, turn, {ASCII} AS a, lead({ASCII}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)"


def turns(spark, sf):
    c = t(spark, sf, "conversations").withColumn("a", F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""))
    return c.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")


@query(f"WITH {TURNS} SELECT conv_id, turn, floor(levenshtein(a, b)::DOUBLE / greatest(length(a), 1) * 1e6 + 0.5) / 1e6 AS cer FROM c WHERE b IS NOT NULL")
def cer_pairs(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", six(tx.error_rate(F.col("a"), F.col("b"))).alias("cer"))


@query(f"WITH {TURNS} SELECT conv_id, turn, levenshtein(a, b)::DOUBLE / greatest(length(a), 1) > 0.5 OR (length(a) > 0 AND (length(b)::DOUBLE / length(a) < 0.7 OR length(b)::DOUBLE / length(a) > 1.4)) AS gross FROM c WHERE b IS NOT NULL")
def gross_mismatch(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", tx.gross(F.col("a"), F.col("b")).alias("gross"))


@query(f"WITH {TURNS} SELECT conv_id, turn, length(a) = 0 OR ends_with(b, right(a, 2)) AS cleared FROM c WHERE b IS NOT NULL")
def tail_cleared(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", tx.tail_cleared(F.col("a"), F.col("b")).alias("cleared"))


@query(r"SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS normal FROM documents")
def normalize_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.normal(F.col("text")).alias("normal"))


@query(r"""SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, ' [,.;:!?]') THEN 'space before mark' END, CASE WHEN regexp_matches(text, '[!?]{2}') THEN 'repeated mark' END, CASE WHEN regexp_matches(text, '  ') THEN 'double space' END,
CASE WHEN lang = 'en' AND regexp_matches(text, '[àâçéèêëîïôûùüÿñæœäöß]') THEN 'foreign letter' END], lambda x: x IS NOT NULL) AS f, len(f) AS n, array_to_string(f, ',') AS findings FROM documents WHERE n > 0""".replace("SELECT doc_id, list_filter", "SELECT doc_id, n, findings FROM (SELECT doc_id, list_filter").replace("WHERE n > 0", ") WHERE n > 0"))
def punct_findings(spark, sf):
    x = F.col("text")
    rules = [(x.rlike(" [,.;:!?]"), "space before mark"), (x.rlike("[!?]{2}"), "repeated mark"), (x.contains("  "), "double space"), ((F.col("lang") == "en") & x.rlike("[àâçéèêëîïôûùüÿñæœäöß]"), "foreign letter")]
    found = F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in rules)))
    return t(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, ",").alias("findings")).filter("n > 0")


ENDING = r"regexp_extract(lower(text), '([a-z]+)[^a-z]*$', 1)"


@query(f"SELECT {ENDING} AS ending, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def listener_report(spark, sf):
    c = t(spark, sf, "conversations").select(F.regexp_extract(F.lower("text"), "([a-z]+)[^a-z]*$", 1).alias("ending"))
    return c.groupBy("ending").agg(F.count("*").alias("n")).filter("n > 1")


UNITS = "(list_sum(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1)))::BIGINT + len(regexp_extract_all(text, '[0-9]')))::BIGINT"


@query(f"SELECT doc_id, {UNITS} AS units FROM documents WHERE lang = 'en'")
def spoken_units(spark, sf):
    return t(spark, sf, "documents").filter("lang = 'en'").select("doc_id", tx.units(F.col("text")).alias("units"))


@query(f"""WITH u AS (SELECT conv_id, turn, coalesce({UNITS}, 0) AS units FROM conversations)
SELECT conv_id, turn, floor((units / 4.5::DOUBLE) * 1e6 + 0.5) / 1e6 AS sec, floor((0.4::DOUBLE + coalesce(sum(units / 4.5::DOUBLE + 0.7::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * 1e3 + 0.5) / 1e3 AS start FROM u""")
def estimate_length(spark, sf):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    u = t(spark, sf, "conversations").select("conv_id", "turn", (tx.units(F.col("text")) / F.lit(4.5)).alias("sec"))
    start = F.lit(0.4) + F.coalesce(F.sum(F.col("sec") + F.lit(0.7)).over(before), F.lit(0.0))
    return u.select("conv_id", "turn", six(F.col("sec")).alias("sec"), (F.floor(start * 1e3 + 0.5) / 1e3).alias("start"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS a FROM conversations), p AS (SELECT conv_id, turn, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS idx FROM w),
s AS (SELECT *, sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY idx) AS upto, sum(length(word)) OVER (PARTITION BY conv_id, turn) AS n FROM p)
SELECT conv_id, turn, idx, word, floor(10 * ((upto - length(word))::DOUBLE / n) * 1e6 + 0.5) / 1e6 AS start, floor(10 * (upto::DOUBLE / n) * 1e6 + 0.5) / 1e6 AS "end" FROM s""")
def words_proportional(spark, sf):
    d = t(spark, sf, "conversations")
    out = tx.words_in_time(d, ["conv_id", "turn"], "text", F.lit(0), F.lit(10))
    return out.select("conv_id", "turn", "idx", "word", six(F.col("start")).alias("start"), six(F.col("end")).alias("end"))


@query("SELECT page_id, tag, n, n > most AS over FROM (SELECT page_id, tag, most, len(regexp_extract_all(html, '<' || tag || '[ >]')) AS n FROM pages, (VALUES ('script', 0), ('div', 3), ('p', 5), ('a', 4)) r(tag, most)) WHERE n > 0")
def html_scan(spark, sf):
    rules = F.explode(F.array(*(F.struct(F.lit(a).alias("tag"), F.lit(b).alias("most")) for a, b in (("script", 0), ("div", 3), ("p", 5), ("a", 4)))))
    p = t(spark, sf, "pages").select("page_id", "html", rules.alias("r"))
    n = F.regexp_count("html", F.concat(F.lit("<"), F.col("r.tag"), F.lit("[ >]"))).cast("long")
    return p.select("page_id", F.col("r.tag").alias("tag"), n.alias("n"), (n > F.col("r.most")).alias("over")).filter("n > 0")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def html_calls(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))


@query("SELECT vec_id, floor(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) * 1e6 + 0.5) / 1e6 AS rms FROM embeddings")
def array_rms(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", six(rms(F.col("embedding"))).alias("rms"))


@query("SELECT vec_id, floor(20 * log10(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) * 1e6 + 0.5) / 1e6 AS db FROM embeddings")
def peak_db(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", six(20 * F.log10(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).alias("db"))


PAIR = "p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def consecutive(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"WITH {PAIR} SELECT vec_id, floor(len(list_filter(list_zip(x, y), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE) > 0.1)) / len(x)::DOUBLE * 1e6 + 0.5) / 1e6 AS changed FROM p")
def changed_share(spark, sf):
    return consecutive(spark, sf).select("vec_id", six(changed_fraction(F.col("x"), F.col("y"), 0.1)).alias("changed"))


@query(f"WITH {PAIR} SELECT vec_id, floor(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len(x) * 1e6 + 0.5) / 1e6 AS diff FROM p")
def mean_difference(spark, sf):
    return consecutive(spark, sf).select("vec_id", six(mean_abs_diff(F.col("x"), F.col("y"))).alias("diff"))


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.03928 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"


@query(f"WITH c AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS r, abs(embedding[2]::DOUBLE) AS g, abs(embedding[3]::DOUBLE) AS b FROM embeddings), k AS (SELECT vec_id, 1.05 / (0.2126::DOUBLE * {_lin('r')} + 0.7152::DOUBLE * {_lin('g')} + 0.0722::DOUBLE * {_lin('b')} + 0.05) AS ratio FROM c) SELECT vec_id, floor(ratio * 1e6 + 0.5) / 1e6 AS ratio, CASE WHEN ratio < 3 THEN 'fail' WHEN ratio < 4.5 THEN 'large only' ELSE 'pass' END AS grade FROM k")
def contrast_grade(spark, sf):
    c = [F.abs(F.col("embedding")[k].cast("double")) for k in range(3)]
    ratio = contrast(F.lit(1.0), luminance(*c))
    return t(spark, sf, "embeddings").select("vec_id", six(ratio).alias("ratio"), F.when(ratio < 3, "fail").when(ratio < 4.5, "large only").otherwise("pass").alias("grade"))
