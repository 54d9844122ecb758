"""Secret scans: fixed patterns, plus character Markov models of random strings and of identifiers. DataFrame functions only.

Method. Spans of three fixed kinds come from patterns. Spans where a regular expression matched are
located without positions from the engine: splitting the text by the same expression gives the gaps, and
gap and match lengths add up to offsets in code points. The fourth kind, `markov`, takes candidate
runs of 20 or more key-like characters, or what those spans leave of them, and compares two first-order character
models by log-likelihood ratio. Both are trained, once per process, on labelled samples
(`labelled_samples`: SAMPLES random strings in several alphabets; SAMPLES identifiers, words of four languages,
paths, numbers, rules and alphabets), smoothed by character class; scores are whole milli-nats, so that every
engine adds them alike.

Defined cases: null and empty texts have no spans; repeated rows are scanned row by row; texts are
scanned whole, whatever their length; an empty table gives an empty result. Input columns travel in one
struct, so their names cannot clash.
"""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds, and the order in which kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_LENGTH = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The character models' alphabet; index 0 stands for any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIDE = len(ALPHABET) + 1
SAMPLES = 8000
#: Weight of the class model in a character's transitions.
SMOOTH = 60
#: Least ratio in milli-nats: in all, and per transition.
LEAST_TOTAL, LEAST_EACH = 12_000, 700
# Ordinary words that identifiers are made of.
WORDS = "the of and to in is that it for on was with as by are this from be or an at not have has had which you all can will about more time when up other into some could them see than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much go good new write our me man too any day same right look think also around another came come work three must because does part even place well such here take why help put different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always show large often together asked house world going want school important until form food keep children feet land side without boy once animal life enough took four head above kind began almost live page got earth need far hand high year mother light country father let night picture being study second soon story since white ever paper hard near sentence better best across during today however sure knew try told young sun thing whole hear example heard several change answer room sea against top turned learn point city play toward five himself usually money seen car morning config value index buffer request response handler session user account status update delete create table column result process thread queue cache server client message error default option version module package function method class object string integer double boolean array list map key field record entry node edge graph path file folder directory stream reader writer parser builder factory manager service controller model view template layout render event listener callback promise future task worker pool schedule timer date format encode decode encrypt compress merge split join filter sort group count total average minimum maximum threshold window offset limit batch size length width height depth".split()


# Common German, French and Spanish words without accents.
FOREIGN = "und die der das nicht ein eine ist mit auf werden haben sein auch nach einer einem wurde zwischen gegen durch jahr arbeit zeit leben wasser schule strasse entwicklung gesellschaft bundesregierung wissenschaft verantwortung les des une dans pour que qui sur avec pas plus par sont cette comme mais tout faire deux bien entre aussi leur temps monde pays homme femme gouvernement developpement international aujourd organisation los las del una por con para como pero sus este entre cuando muy sin sobre tambien hasta hay donde quien desde todo nos durante todos uno contra otros ese eso ante ellos gobierno desarrollo universidad informacion trabajo empresa".split()
# Parts of addresses and file names.
PARTS = "https http www com org net html xml json css img src lib usr bin etc var tmp home opt docs news blog api static assets images page id v1 v2 test main init py js txt csv png jpg tar gz".split()


def _random_string(r: random.Random, k: int) -> str:
    digits, lower, upper = ALPHABET[52:62], ALPHABET[:26], ALPHABET[26:52]
    kinds = (ALPHABET[:62], ALPHABET[:64], lower + upper + digits + "_-", upper + digits, lower + digits, lower[:6] + digits, upper[:6] + digits)
    a = kinds[k % len(kinds)]
    return "".join(r.choice(a) for _ in range(r.randint(20, 48)))


def _ordinary_string(r: random.Random, k: int) -> str:
    """Identifiers, running words of four languages, paths, numbers, dates, rules, alphabets."""
    pick = lambda words, a, b: [r.choice(words) for _ in range(r.randint(a, b))]
    kind = k % 14
    if kind < 5:
        w = pick(WORDS, 3, 6)
        out = ("_".join(w), w[0] + "".join(x.title() for x in w[1:]), "-".join(w), "".join(w), "".join(x.title() for x in w))[kind]
        return f"{out}{r.randint(0, 99)}" if r.random() < 0.2 else out
    if kind == 5:
        return "_".join(pick(WORDS, 3, 6)).upper()
    if kind == 6:
        return "".join(pick(FOREIGN, 3, 6))
    if kind == 7:
        return r.choice("-_/").join(pick(FOREIGN, 3, 6))
    if kind in (8, 9):
        return "/" * r.randint(0, 1) + "/".join(r.choice([r.choice(PARTS), r.choice(WORDS), r.choice(WORDS) + r.choice("-_") + r.choice(FOREIGN), str(r.randint(0, 2030)), r.choice(WORDS).title()]) for _ in range(r.randint(4, 8)))
    if kind == 10:
        return "".join(r.choice(ALPHABET[52:62]) for _ in range(r.randint(20, 40)))
    if kind == 11:
        return r.choice(["-", "/", "_", "T", "Z-"]).join(f"{r.randint(0, 9999):0{r.randint(2, 6)}}" for _ in range(r.randint(5, 9)))
    if kind == 12:
        return (ALPHABET[k // 14 % len(ALPHABET)] if k % 3 else r.choice("-_=/+") + r.choice("-_=/+")) * r.randint(60, 240)
    run = r.choice([ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62] * 3, ALPHABET[:26][::-1], ALPHABET[52:62][::-1] * 3])
    return run * r.randint(1, 2)


def labelled_samples(n: int = SAMPLES) -> list[tuple[str, int]]:
    """n random strings (label 1) and n ordinary ones (label 0), the same on every run."""
    r = random.Random(20240229)
    return [(one, label) for k in range(n) for one, label in ((_random_string(r, k), 1), (_ordinary_string(r, k), 0))]


def _kind(c: str) -> int:
    """The class of a character of the alphabet: lower, upper, digit, a sign by itself, other."""
    i = ALPHABET.find(c)
    return 9 if i < 0 else 0 if i < 26 else 1 if i < 52 else 2 if i < 62 else i - 59


@functools.cache
def model(n: int = SAMPLES) -> tuple[int, ...]:
    """Milli-nats by which a transition (from * SIDE + to) is likelier in random strings.

    A transition's count is smoothed by that of its characters' classes, so that letters which no sample has side
    by side are judged as letters.
    """
    kind = [9, *map(_kind, ALPHABET)]
    members = [max(1, kind.count(k)) for k in range(10)]
    logs = []
    for label in (0, 1):
        counts, pairs = [[0] * SIDE for _ in range(SIDE)], [[1] * 10 for _ in range(10)]
        for s, y in labelled_samples(n):
            if y == label:
                ix = [ALPHABET.find(c) + 1 for c in s]
                for a, b in zip(ix, ix[1:], strict=False):
                    counts[a][b] += 1
                    pairs[kind[a]][kind[b]] += 1
        share = [[x / sum(row) / members[k] for k, x in enumerate(row)] for row in pairs]
        logs.append([math.log((counts[a][b] + SMOOTH * share[kind[a]][kind[b]]) / (sum(counts[a]) + SMOOTH)) for a in range(SIDE) for b in range(SIDE)])
    return tuple(round(1000 * (x - y)) for x, y in zip(logs[1], logs[0], strict=True))


def ratio(s: str) -> int:
    """The log-likelihood ratio of one string in milli-nats."""
    ix = [ALPHABET.find(c) + 1 for c in s]
    return sum(model()[a * SIDE + b] for a, b in zip(ix, ix[1:], strict=False))


SPAN = "array<struct<start:int,kind:int,end:int>>"
BLOCK = 256


def _matched(text: Column, pattern: str) -> Column:
    """Matches with the length of the gap before each, and the gap after the last; null without a match, which a first look finds."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(text.rlike(pattern), F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g"))))


def _located(both: Column, kind: int, keep) -> Column:
    """Spans of a kind, in order, from a column of _matched."""
    length = lambda x: x["g"] + F.coalesce(F.length(x["h"]), F.lit(0))

    def step(acc, x):
        at = acc["at"] + x["g"]
        end = acc["at"] + length(x)
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["h"].isNotNull() & keep(x["h"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # An array that grows by one is copied each time: blocks keep texts with very many matches from costing their square.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int")), lambda k: F.slice(both, k * BLOCK + 1, F.lit(BLOCK)))
    sizes = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + length(y)))
    bases = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    spans = F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda x, at: F.aggregate(x, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"]))
    return F.when(both.isNotNull(), F.flatten(spans)).otherwise(F.array().cast(SPAN))


def _random(s: Column) -> Column:
    table = F.split(F.lit(",".join(map(str, model()))), ",").cast("array<int>")
    ix = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.call_function("locate", F.substr(s, i, F.lit(1)), F.lit(ALPHABET)))
    total = F.aggregate(ix, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("sum")), lambda acc, x: F.struct(x.alias("last"), F.when(acc["last"] < 0, F.lit(0)).otherwise(acc["sum"] + F.get(table, acc["last"] * SIDE + x)).alias("sum")), lambda acc: acc["sum"])
    return (total >= LEAST_TOTAL) & (total >= LEAST_EACH * (F.length(s) - 1))


def scan(docs: DataFrame, carry: Column, text: str = "text") -> DataFrame:
    """doc (the carried struct), text, base and spans: arrays of (start, kind index, end), ordered by start, then kind."""
    a = docs.select(carry.alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    m = a.select("doc", "text", *[_matched(F.col("text"), p).alias(f"m{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))])
    b = m.select(
        "doc", "text",
        _located(F.col("m0"), 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6).alias("s0"),
        _located(F.col("m1"), 1, lambda h: F.lit(True)).alias("s1"),
        _located(F.col("m2"), 2, lambda h: F.lit(True)).alias("s2"),
        _located(F.col("m3"), 3, _random).alias("s3"),
        _located(F.col("m3"), 3, lambda h: F.lit(True)).alias("c3"),
    )
    c = b.select("doc", "text", F.sort_array(F.concat("s0", "s1", "s2")).alias("base"), "s3", "c3")
    # Candidates that are base spans go by hash, so that only others are held against every base span.
    place = lambda spans: F.transform(spans, lambda x: F.call_function("shiftleft", x["start"].cast("bigint"), F.lit(32)) + x["end"])
    meets = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    others = lambda spans: F.transform(F.array_except(place(spans), place("base")), lambda x: F.struct(F.call_function("shiftright", x, F.lit(32)).cast("int").alias("start"), F.lit(3).alias("kind"), x.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("end")))
    bare = F.when(F.size("base") == 0, F.array().cast(SPAN))
    c = c.select("doc", "text", "base", F.when(F.size("base") == 0, F.col("s3")).otherwise(others("s3")).alias("s3"), bare.otherwise(others("c3")).alias("c3"))
    c = c.select("doc", "text", "base", F.filter("s3", lambda x: ~F.exists("base", lambda y: meets(x, y))).alias("free"), F.filter("c3", lambda x: F.exists("base", lambda y: meets(x, y))).alias("torn"))

    def rests(x):
        """What base spans leave of a candidate: up to each that meets it, and after the last."""
        met = F.filter("base", lambda y: meets(x, y))
        starts = F.concat(F.array(x["start"]), F.transform(met, lambda y: y["end"]))
        ends = F.concat(F.transform(met, lambda y: y["start"]), F.array(x["end"]))
        return F.transform(ends, lambda end, i: F.struct(F.array_max(F.slice(starts, F.lit(1), i + 1)).alias("start"), F.lit(3).alias("kind"), end.alias("end")))

    long = lambda x: x["end"] - x["start"] >= LEAST_LENGTH
    c = c.select("doc", "text", "base", "free", F.filter(F.flatten(F.transform("torn", rests)), long).alias("rests"))
    left = F.filter("rests", lambda x: _random(F.substr(F.col("text"), x["start"] + 1, x["end"] - x["start"])))
    return c.select("doc", "text", "base", F.sort_array(F.concat("base", "free", left)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        add = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, add).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))).otherwise(text)


def op5_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    r = scan(docs, F.struct("doc_id"))
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return r.select("doc.doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n(3).alias("n_markov"))


def stage(docs: DataFrame) -> DataFrame:
    """docs with their secrets replaced; n_chars, where there is one, counts the new text. Null texts stay null."""
    r = scan(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    new = F.when(F.col("doc.text").isNotNull(), redacted(F.col("text"), F.col("spans")))
    kinds = dict(docs.dtypes)
    cols = [new.alias(c) if c == "text" else F.length(new).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    # Inside a struct: beside each other, a lambda would take the new `text` for the scanned one.
    return r.select(F.struct(*cols).alias("row")).select("row.*")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def spans(pattern: str, kind: int, keep: str) -> str:
        hits = f"regexp_extract_all(t, {q(pattern)})"
        return f"""SELECT r, {kind} AS kind, s, s + length(h) AS e, h FROM (
            SELECT r, h, CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
            FROM (SELECT r, gaps, hits, unnest(hits) AS h, generate_subscripts(hits, 1) AS i FROM (SELECT r, {hits} AS hits, string_split_regex(t, {q(pattern)}) AS gaps FROM d))) WHERE {keep}"""

    table = ",".join(map(str, model()))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({spans(ASSIGN, 0, f"length(regexp_extract(h, {q(ASSIGN)}, 2)) >= 6")} UNION ALL {spans(ACCESS, 1, "true")} UNION ALL {spans(HEX, 2, "true")}),
    run AS ({spans(CANDIDATE, 3, "true")}),
    torn AS (SELECT c.r, c.s AS cs, c.e AS ce, b.s, b.e FROM run c JOIN base b ON b.r = c.r AND b.s < c.e AND c.s < b.e),
    rest AS (SELECT r, greatest(cs, coalesce(max(e) OVER (PARTITION BY r, cs ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cs)) AS s, s AS e FROM torn
             UNION ALL SELECT r, max(e), any_value(ce) FROM torn GROUP BY r, cs),
    cand AS (SELECT * FROM run c WHERE NOT EXISTS (SELECT 1 FROM torn WHERE torn.r = c.r AND torn.cs = c.s)
             UNION ALL SELECT r, 3, s, e, t[s + 1 : e] FROM rest JOIN d USING (r) WHERE e - s >= {LEAST_LENGTH}),
    model AS (SELECT CAST(string_split('{table}', ',') AS INT[]) AS m),
    scored AS (SELECT r, kind, s, e, length(h) AS n, list_sum(list_transform(range(1, length(h)), lambda i: m[{SIDE} * strpos('{ALPHABET}', h[i]) + strpos('{ALPHABET}', h[i + 1]) + 1])) AS llr FROM cand, model),
    every AS (SELECT r, kind, s, e FROM base UNION ALL SELECT r, kind, s, e FROM scored WHERE llr >= {LEAST_TOTAL} AND llr >= {LEAST_EACH} * (n - 1)),
    named AS (SELECT *, {list(KINDS)}[kind + 1] || ':' || s || ':' || e AS x FROM every),
    g AS (SELECT r, string_agg(x, ',' ORDER BY s, kind) AS spans, string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
                 count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_markov FROM named GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_markov, 0) AS n_markov
    FROM d LEFT JOIN g USING (r)"""


@functools.cache
def sql() -> str:
    """DuckDB SQL for op5_query."""
    return _sql()
