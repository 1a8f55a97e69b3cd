"""Quality rules with risk-controlled thresholds, in DataFrame operations alone.

Each text gets a few measures of badness. For each stratum (language) and measure a cutoff is selected on a
labelled holdout: among the good documents of the stratum, those beyond the cutoff would be rejected falsely.
Of ``CUTOFFS`` candidates the strictest is taken whose false-rejection rate is at most ``RISK`` with
certainty: the exact binomial tail P(X <= k | n, RISK) for k falsely rejected of n must be at most
``DELTA`` divided by the number of all tests (Bonferroni over strata, measures and candidates). Where a stratum has
too few good labels to prove ``RISK``, the least rate that they can prove takes its place, by cutoffs that reject none of them; strata that
cannot prove even ``MOST_RISK`` are pooled, and the pool's cutoffs and bound hold for them together. A stratum without any good label, or a
pool that is too small, keeps what passes the base rule. A document is rejected if it fails the base rule or
any selected cutoff of its stratum; as each measure may reject up to its rate, the bound for all is their sum.

Three in sixteen labelled documents, told by a hash of their ids (``audited``), select nothing. ``audit`` measures on them how many good documents
of each stratum the selected cutoffs reject. Only counts for each (stratum, measure, candidate) are gathered, so the thresholds that are
broadcast are bounded by the number of strata.

Edge cases: a null or empty text has no words and fails the base rule. A null language is a stratum of its own, and so is an empty one.
Texts are measured whole. Of labels given twice, the lower quality counts. Empty tables give no rows; without
labels the base rule alone decides. ``judge`` leaves other columns out, ``keep`` passes them on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.llm.shared import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: False-rejection rate of one measure, the rate allowed where labels are few, total error probability, most strata whose thresholds are broadcast.
RISK, MOST_RISK, DELTA, MOST_STRATA = 0.005, 0.05, 0.05, 1000
#: So much over the least rate that can be proven, for rounding.
SLACK = 1 + 1e-9
POOL = "*"
#: Candidate cutoffs: a document is rejected if the measure is over the cutoff.
CUTOFFS = {
    "symbol_rate": (0.02, 0.05, 0.1, 0.2),
    "dup_line_rate": (0.1, 0.2, 0.3, 0.5),
    "repeat_rate": (0.1, 0.2, 0.3, 0.4),
    "bang_rate": (0.1, 0.2, 0.4),
    "shout_rate": (0.1, 0.2, 0.4),
    "bar_rate": (0.1, 0.2, 0.4),
    "word_length_gap": (2.0, 3.0, 4.0, 6.0),
}
N_TESTS = sum(map(len, CUTOFFS.values()))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though it is named often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Windows are hashed and sorted with their places. Where neighbours are equal, the places count, and the
    union of their windows is added up from the gaps between them. Texts whose windows all differ stop early.
    """

    def counted(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # neighbours in hash order: compare each with the one before and the one after
        def repeated(sorted_):
            before = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i"))), sorted_)
            flags = F.zip_with(sorted_, before, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), a["h"].eqNullSafe(b["h"]).alias("same")))
            after = F.concat(F.slice(flags, 2, F.greatest(F.size(flags) - 1, F.lit(0))), F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("i"), F.lit(False).alias("same"))))
            return F.filter(F.zip_with(flags, after, lambda a, b: F.when(a["same"] | b["same"], a["i"])), lambda i: i.isNotNull())

        places = F.array_sort(let(placed, repeated))
        union = F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(union)

    def windows_of(w: Column) -> Column:
        n = F.size(w) - 2
        return F.zip_with(
            F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            F.slice(w, 3, n),
            lambda ab, c: F.xxhash64(ab["a"], ab["b"], c),
        )

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows_of(words), counted))


def measured(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """The columns ``keep`` and the counts and measures of (text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s)))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.filter(w, lambda x: x == "|")).cast("long").alias("n_bars"), repeat_words(w).alias("n_repeat_words")))
    found = docs.select(
        *keep,
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit(r"!")).cast("long").alias("n_bangs"),
        F.regexp_count(text, F.lit(r"[A-Z][A-Z]+")).cast("long").alias("n_shouts"),
        F.regexp_count(text, F.lit("\n")).cast("long").alias("n_breaks"),
        counts.alias("counts"),
    ).select("*", "counts.*").drop("counts")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    kept = [k if isinstance(k, str) else found.columns[i] for i, k in enumerate(keep)]
    return found.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per(c("n_symbols"), c("word_chars")).alias("symbol_rate"),
        per(c("n_dup_lines"), c("n_breaks") + 1).alias("dup_line_rate"),
        per(c("n_repeat_words"), c("n_words")).alias("repeat_rate"),
        per(c("n_bangs"), c("n_words")).alias("bang_rate"),
        per(c("n_shouts"), c("n_words")).alias("shout_rate"),
        per(c("n_bars"), c("n_words")).alias("bar_rate"),
        F.abs(per(c("word_chars"), c("n_words")) - F.lit(6.0)).alias("word_length_gap"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of a binomial distribution, its terms added from their logarithms."""
    odds, none = F.log(F.lit(p / (1 - p))), n * F.log(F.lit(1 - p))
    start = F.struct(none.alias("term"), F.exp(none).alias("sum"))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step, lambda acc: acc["sum"])


def audited() -> Column:
    """Whether a label is kept for the audit."""
    return F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2")


def stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("stratum")


def good_rows(measures: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """stratum and ``columns`` of documents that are labelled good and pass the base rule."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    slim = measures.select("doc_id", "n_words", "n_repeat_words", stratum(), *columns)
    return slim.join(good, "doc_id").where(~base_failed())


def thresholds(measures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, measure, cutoff: the strictest proven cutoff of each stratum and measure, from labelled rows of ``measured``."""
    rows = good_rows(measures, labels, *CUTOFFS).where(~audited())
    candidates = [(m, cut) for m, cuts in CUTOFFS.items() for cut in cuts]
    counts = [F.sum((F.col(m) > cut).cast("long")).alias(f"{m}@{cut}") for m, cut in candidates]
    held = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    tests = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(float(cut)).alias("cutoff"), F.col(f"`{m}@{cut}`").alias("k")) for m, cut in candidates))
    held = materialize(held, "quality-counts")  # a row for each stratum
    each = delta / (N_TESTS * max(held.count(), 1))  # every stratum counts among the tests, whether or not it proves anything
    least = (1 - F.exp(F.log(F.lit(each)) / F.col("n"))) * SLACK  # what labels can prove of which none is rejected
    most = max(MOST_RISK, risk)
    pooled = held.withColumn("pool", F.when(least > most, POOL).otherwise(F.col("stratum")))
    listed = pooled.select("pool", "n", F.explode(tests).alias("t")).groupBy("pool", "t.measure", "t.cutoff").agg(F.sum("n").alias("n"), F.sum("t.k").alias("k"))
    rated = listed.withColumn("p", F.greatest(F.lit(risk), least)).where(F.col("p") <= most)
    risky = F.when(F.col("k") > F.col("p") * F.col("n"), F.lit(1.0)).otherwise(binomial_tail(F.col("k"), F.col("n"), F.col("p")))
    proven = rated.where(risky <= each).groupBy("pool", "measure").agg(F.min("cutoff").alias("cutoff"))
    return pooled.select("stratum", "pool").join(proven, "pool").select("stratum", "measure", "cutoff")


def ruled(measures: DataFrame, labels: DataFrame, risk: float = RISK) -> DataFrame:
    """The rows of ``measured`` with base_failed, kept and rejected_by, the measures over their cutoffs."""
    chosen = thresholds(measures, labels, risk)
    rules = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("cutoffs"))
    rules = materialize(rules, "quality-rules")
    small = rules.count() <= MOST_STRATA
    judged = measures.withColumn("stratum", stratum()).join(F.broadcast(rules) if small else rules, "stratum", "left")
    over = [F.when(F.col(m) > F.element_at("cutoffs", m), F.lit(m)) for m in CUTOFFS]
    named = judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_join(F.array_compact(F.array(*over)), ","))
    return named.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def measures_of(docs: DataFrame) -> DataFrame:
    return materialize(measured(docs, "doc_id", "lang"), "quality-measures")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rejected_by for (doc_id, lang, text). Texts are measured once; only measures travel."""
    named = ruled(measures_of(docs), labels, risk)
    return named.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def audit(docs: DataFrame, labels: DataFrame, risk: float = RISK) -> DataFrame:
    """lang, n, rejected, rate: good documents of each stratum whose labels selected no cutoff, and how many of them the cutoffs reject."""
    named = ruled(measures_of(docs), labels, risk)
    held = good_rows(named, labels, "lang", "kept").where(audited())
    return held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("kept")).alias("rejected")).withColumn("rate", F.col("rejected") / F.col("n"))


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns; the rows are stored beside their measures, not joined to them again."""
    measures = materialize(measured(docs, "doc_id", "lang", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "quality-measures", "zstd")
    return ruled(measures, labels, risk).where("kept").select("row.*")


def sql(risk: float = RISK) -> str:
    """``judge`` in DuckDB's SQL."""
    candidates = [(m, cut) for m, cuts in CUTOFFS.items() for cut in cuts]
    counts = ", ".join(f"count(*) FILTER ({m} > {cut}) AS k{i}" for i, (m, cut) in enumerate(candidates))
    listed = " UNION ALL ".join(f"SELECT pool, '{m}' AS measure, {cut}::DOUBLE AS cutoff, sum(n) AS n, sum(k{i}) AS k, any_value(least) AS least FROM pools GROUP BY pool" for i, (m, cut) in enumerate(candidates))
    each, most = f"({DELTA / N_TESTS!r}::DOUBLE / strata)", max(MOST_RISK, risk)
    at_most = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    log_term = "lgamma(tests.n + 1e0) - lgamma(i + 1e0) - lgamma(tests.n - i + 1e0) + i * ln(p) + (tests.n - i) * ln(1 - p)"
    over = ", ".join(f"CASE WHEN {m} > (SELECT cutoff FROM proven p WHERE p.stratum = m.stratum AND p.measure = '{m}') THEN '{m}' END" for m in CUTOFFS)
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0 END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
numbered AS (SELECT *, row_number() OVER () AS row FROM w),
windows AS (SELECT row, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM numbered)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(3) o(j) GROUP BY row),
c AS (
  SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(t, '!')) AS n_bangs, len(regexp_extract_all(t, '[A-Z][A-Z]+')) AS n_shouts,
    len(list_filter(ws, lambda x: x = '|')) AS n_bars, len(string_split(t, chr(10))) AS n_lines
  FROM numbered LEFT JOIN covered USING (row)
),
m AS (
  SELECT *, {rate('n_symbols', 'word_chars')} AS symbol_rate, {rate('n_dup_lines', 'n_lines')} AS dup_line_rate, {rate('n_repeat_words', 'n_words')} AS repeat_rate,
    {rate('n_bangs', 'n_words')} AS bang_rate, {rate('n_shouts', 'n_words')} AS shout_rate, {rate('n_bars', 'n_words')} AS bar_rate,
    abs({rate('word_chars', 'n_words')} - 6) AS word_length_gap, {at_most} AS base_failed
  FROM c
),
good AS (SELECT doc_id FROM labels WHERE md5(doc_id::VARCHAR)[1] NOT IN ('0', '1', '2') GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT stratum, count(*) AS n, count(*) OVER () AS strata, {counts} FROM m SEMI JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
pools AS (SELECT *, {each} AS least, CASE WHEN (1 - exp(ln({each}) / n)) * {SLACK!r}::DOUBLE > {most}::DOUBLE THEN '{POOL}' ELSE stratum END AS pool FROM held),
tests AS (SELECT *, greatest({risk}::DOUBLE, (1 - exp(ln(least) / n)) * {SLACK!r}::DOUBLE) AS p FROM ({listed})),
proven AS (
  SELECT stratum, measure, min(cutoff) AS cutoff FROM tests JOIN pools USING (pool)
  WHERE p <= {most}::DOUBLE AND k <= p * tests.n AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp({log_term}))) <= tests.least
  GROUP BY stratum, measure
),
j AS (SELECT *, concat_ws(',', {over}) AS rejected_by FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM j"""
