"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Method. One pass over the texts computes integer metrics per document. A log-linear histogram of each
metric (exact below 64, then 32 buckets per power of two) is a quantile sketch that merges by adding
counts: per language and source it is an ordinary map-side-combined count, and the sketches of a
language, or of everything, are sums of those. The quartiles read from the sketches give fences
[q1 - k * s, q3 + k * s], s = max(q3 - q1, a least spread); a group with under `min_rows` documents
takes its language's fences, and a language with too few takes the fences of all documents. The
fences are then joined to the documents and a document outside one is rejected.

Defined cases: a null text counts as empty; null lang or source form groups of their own; an empty text
has no words and fails the base rule; repeated rows are judged row by row; an empty table gives an empty
result. Input columns travel inside one struct, so their names cannot clash with the metrics.
Repeated 3-word windows are recognised by 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"

#: metric: (least spread, fence below, fence above); all metrics are in thousandths.
FENCES = {
    "symbols_per_word": (33, False, True),
    "dup_line_share": (150, False, True),
    "repeat_share": (150, False, True),
    "mean_word": (1000, True, True),
}
WIDTH = 3
MIN_ROWS = 200
#: A fence table of so many rows (a few MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
FIRST_STEPS = 64


def base_metrics(docs: DataFrame, carry: Column, text: str = "text") -> DataFrame:
    """doc (the carried struct), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    long_ = lambda c: c.cast("long")
    a = docs.select(carry.alias("doc"), body.alias("t"))
    b = a.select("doc", "t", F.array_remove(F.split("t", SPACE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("lines"))
    c = b.select(
        "doc",
        F.size("w").alias("n"),
        long_(F.length(F.array_join("w", ""))).alias("word_chars"),
        long_(F.regexp_count("t", F.lit(SYMBOLS))).alias("n_symbols"),
        long_(F.size("lines")).alias("n_lines"),
        long_(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.slice("w", F.lit(1), F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    d = c.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    e = d.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(F.filter("s", lambda x, i: ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))) | same(x, i + 1)), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("p", lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get("p", F.greatest(i - 1, F.lit(0)))))), F.lit(0), lambda acc, x: acc + x)
    return e.select("doc", long_(F.col("n")).alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", long_(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"))


def _metrics() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.expr(f"(1000 * {a}) div {b}")).otherwise(F.lit(0)).cast("long")
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word": share("word_chars", "n_words"),
    }


def bucket(v: Column) -> Column:
    """Sketch bucket of a non-negative integer."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", v, shift)).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest integer of a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.when(b < FIRST_STEPS, b).otherwise(F.call_function("shiftleft", b - shift * 32 + 1, shift) - 1)


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the mergeable sketches, a few hundred rows per group at most."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), c.alias("v")) for k, c in _metrics().items()])
    return metrics.select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "metric", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """By group one struct q: rows, and per metric the fences."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    cum = merged.withColumn("c", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda p: F.min(F.when(4 * F.col("c") >= p * F.col("total"), bucket_top(F.col("bucket"))))
    q = cum.groupBy(*keys, "metric").agg(F.first("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))
    fences = []
    for k, (spread, below, above) in FENCES.items():
        s = WIDTH * F.greatest(F.col("q3") - F.col("q1"), F.lit(spread))
        pick = lambda x, k=k: F.max(F.when(F.col("metric") == k, x))
        fences += [pick(F.col("q1") - s).alias(f"{k}_low")] * below + [pick(F.col("q3") + s).alias(f"{k}_high")] * above
    return q.groupBy(*keys).agg(F.max("total").alias("total"), *fences)


def fence_table(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """lang, source and their fences, after the fallback to the language's and then to all documents' sketches."""
    names = [f"{k}_{side}" for k, (_, lo, hi) in FENCES.items() for side, on in (("low", lo), ("high", hi)) if on]
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("l2"), F.col("total").alias("t2"), *[F.col(n).alias(f"{n}2") for n in names])
    every = _quartiles(sketch.withColumn("one", F.lit(1)), ["one"]).select(*[F.col(n).alias(f"{n}3") for n in names])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l2"))).join(F.broadcast(every), F.lit(True))  # `every` is one row
    pick = lambda n: F.when(F.col("total") >= min_rows, F.col(n)).when(F.col("t2") >= min_rows, F.col(f"{n}2")).otherwise(F.col(f"{n}3")).alias(n)
    return joined.select("lang", "source", *[pick(n) for n in names])


def judge(docs: DataFrame, carry: Column, text: str = "text", lang: str = "lang", source: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """doc, the metrics, base_failed, adaptive_failed, kept: one row per input row. The metrics are computed once and kept on shared storage."""
    both = F.struct(carry.alias("carried"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    m = base_metrics(docs, both, text)
    m = materialize(m.select(F.col("doc.carried").alias("doc"), F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"), *m.columns[1:]), "quality-metrics")
    fences = materialize(fence_table(sketches(m), min_rows).withColumnsRenamed({"lang": "f_lang", "source": "f_source"}), "quality-fences")
    if fences.count() <= BROADCAST_ROWS:
        fences = F.broadcast(fences)
    j = m.join(fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")))
    values = _metrics()
    out = F.lit(False)
    for k, (_, below, above) in FENCES.items():
        if below:
            out = out | (values[k] < F.col(f"{k}_low"))
        if above:
            out = out | (values[k] > F.col(f"{k}_high"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return j.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), out.alias("adaptive_failed"), (~base & ~out).alias("kept"))


def op1_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    r = judge(docs, F.struct("doc_id"))
    return r.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    return judge(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])).filter("kept").select("doc.*")


def _sql() -> str:
    values = {k: f"CASE WHEN {b} > 0 THEN (1000 * {a}) // {b} ELSE 0 END" for k, a, b in (("symbols_per_word", "n_symbols", "n_words"), ("dup_line_share", "n_dup_lines", "n_lines"), ("repeat_share", "n_repeat_words", "n_words"), ("mean_word", "word_chars", "n_words"))}
    long_form = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS v FROM m" for k, v in values.items())

    def quart(keys: str) -> str:
        fences = ", ".join(f"max(CASE WHEN metric = '{k}' THEN {e} END) AS {k}_{side}" for k, (s, lo, hi) in FENCES.items() for side, on, e in (("low", lo, f"q1 - {WIDTH} * greatest(q3 - q1, {s})"), ("high", hi, f"q3 + {WIDTH} * greatest(q3 - q1, {s})")) if on)
        return f"""SELECT {keys}, max(total) AS total, {fences} FROM (
            SELECT {keys}, metric, max(total) AS total, min(CASE WHEN 4 * c >= total THEN top END) AS q1, min(CASE WHEN 4 * c >= 3 * total THEN top END) AS q3
            FROM (SELECT {keys}, metric, CASE WHEN bucket < 64 THEN bucket ELSE ((bucket - 32 * (bucket // 32 - 1) + 1) << CAST(bucket // 32 - 1 AS BIGINT)) - 1 END AS top,
                         sum(n) OVER (PARTITION BY {keys}, metric ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY {keys}, metric) AS total
                  FROM (SELECT {keys}, metric, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL"""

    pick = lambda n: f"CASE WHEN own.total >= {MIN_ROWS} THEN own.{n} WHEN l.total >= {MIN_ROWS} THEN l.{n} ELSE a.{n} END"
    failed = " OR ".join(f"({values[k]}) {op} ({pick(f'{k}_{side}')})" for k, (_, lo, hi) in FENCES.items() for side, on, op in (("low", lo, "<"), ("high", hi, ">")) if on)
    blank = "[\\x20\\x09-\\x0D]"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '{blank}+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    pos AS (SELECT r, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
    g AS (SELECT r, p, count(*) OVER (PARTITION BY r, ws[p], ws[p + 1], ws[p + 2]) AS k FROM pos),
    rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g WHERE k > 1) GROUP BY r),
    m AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
                 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
          FROM w LEFT JOIN rep USING (r)),
    sk AS (SELECT lang, source, metric, 32 * sh + (v >> sh) AS bucket, count(*) AS n
           FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS sh FROM ({long_form})) GROUP BY ALL),
    own AS ({quart("lang, source")}), l AS ({quart("lang")}), a AS ({quart("1 AS one").replace("PARTITION BY 1 AS one, metric", "PARTITION BY metric").replace("SELECT 1 AS one, metric, bucket", "SELECT metric, bucket").replace("SELECT 1 AS one, metric, CASE", "SELECT metric, CASE").replace("SELECT 1 AS one, metric, max", "SELECT metric, max")})
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({failed}) AS kept
    FROM m JOIN own ON m.lang IS NOT DISTINCT FROM own.lang AND m.source IS NOT DISTINCT FROM own.source
         JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""


SQL = _sql()
