"""Operator 8. Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares one signal of a text with a cutoff. The cutoffs come from
labelled rows: within a stratum, walking a rule's candidate cutoffs from lax to
strict, the hypothesis "this cutoff rejects more than the allowed share of good
documents" is tested by the exact binomial tail of the good rows that it
rejects; the walk ends at the first cutoff that cannot be certified. The error
level is divided among all strata and rules (Bonferroni over the walks; within
a walk fixed-sequence testing needs no more), and the allowed share among the
rules of a stratum, so with probability 1 - delta no stratum loses more than
alpha of its good documents to the rules. Among the certified cutoffs that one
is taken that rejects most bad rows net of good ones; a rule with none, or with
none that helps, stays off in that stratum.

Edge cases: a null or empty text has no words and fails the base rule; labels
that are null, or whose id is null or not in documents, are not used; repeated
label rows count once, conflicting ones as bad; strata follow the null stratum
value too; with no labels at all no rule is on. Other columns are ignored or,
in apply_rules, passed through under their own names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import fresh, materialize, table

#: The characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"

#: Share of a stratum's good documents that the rules together may reject, and the error level of that promise.
ALPHA, DELTA = 0.05, 0.05

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Signals of a text, each higher where the text is worse, as functions of the base columns.
RULES: dict[str, str] = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
}
#: Candidate cutoffs of every rule, from lax to strict.
CUTOFFS = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]

def measures(text: Column) -> dict[str, Column]:
    """The counts that rules and results use, for a text column without nulls."""
    unspaced = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return {
        "word_chars": F.length(unspaced).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
    }


def with_measures(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """docs and a struct column of that name with all measures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")
    counted = F.transform(F.array(words), _measured)[0]
    rest = [c.alias(n) for n, c in measures(text).items()]
    return docs.withColumn(into, F.struct(counted["n_words"].cast("long").alias("n_words"), counted["n_repeat_words"].cast("long").alias("n_repeat_words"), *rest))


def _measured(w: Column) -> Column:
    """n_words and n_repeat_words of an array of words."""
    windows = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    hashes = F.transform(windows, lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))
    return F.struct(F.size(w).alias("n_words"), F.transform(F.array(hashes), _repeat_words)[0].alias("n_repeat_words"))


def _repeat_words(h: Column) -> Column:
    """Words inside windows whose hash stands twice or more; windows span three words."""

    def covered(p: Column) -> Column:
        gains = F.transform(p, lambda x, k: F.when(k == F.size(p) - 1, 3).otherwise(F.least(F.lit(3), F.get(p, k + 1) - x)))
        return F.aggregate(gains, F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        twins = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
        return F.transform(F.array(F.sort_array(F.transform(twins, lambda e: e["i"]))), covered)[0]

    keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.transform(F.array(keyed), repeated)[0])


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def signals(prefix: str) -> dict[str, Column]:
    names = ("n_symbols", "word_chars", "n_repeat_words", "n_words", "n_upper")

    def full(formula: str) -> str:
        for name in names:
            formula = formula.replace(name, f"{prefix}.{name}")
        return formula

    return {rule: F.expr(full(formula)) for rule, formula in RULES.items()}


def binomial_tail(n: int, x: int, p: float) -> float:
    """P(Bin(n, p) <= x), exactly summed."""
    if x >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(v - top) for v in logs))


@dataclass(frozen=True)
class Threshold:
    stratum: str | None
    rule: str
    cutoff: float
    good: int
    good_rejected: int
    bad_rejected: int
    p_value: float


def calibrate(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[Threshold]:
    """The certified cutoffs. labelled: stratum, bad (boolean) and one column for each rule; only counts come to the driver."""
    rejected = [F.sum(F.when(F.col(rule) > c, 1).otherwise(0)).alias(f"{rule}_{i}") for rule in RULES for i, c in enumerate(CUTOFFS)]
    strata: dict[str | None, dict[bool, dict]] = {}
    for row in labelled.groupBy("stratum", "bad").agg(F.count("*").alias("n"), *rejected).collect():
        strata.setdefault(row["stratum"], {})[row["bad"]] = row.asDict()
    level = delta / max(1, len(strata) * len(RULES))
    found = []
    for stratum, sides in sorted(strata.items(), key=lambda s: (s[0] is None, s[0] or "")):
        good, bad = sides.get(False), sides.get(True)
        if good is None or bad is None:
            continue
        for rule in RULES:
            best = None
            for i, cutoff in enumerate(CUTOFFS):
                lost, caught = good[f"{rule}_{i}"], bad[f"{rule}_{i}"]
                p_value = binomial_tail(good["n"], lost, alpha / len(RULES))
                if p_value > level:
                    break
                if best is None or caught - lost > best.bad_rejected - best.good_rejected:
                    best = Threshold(stratum, rule, cutoff, good["n"], lost, caught, p_value)
            if best is not None and best.bad_rejected > best.good_rejected:
                found.append(best)
    return found


def verdict(stratum: Column, prefix: str, thresholds: list[Threshold]) -> Column:
    """True where no rule that is on in the stratum rejects."""
    values, passes = signals(prefix), F.lit(True)
    for t in thresholds:
        passes = passes & ~(stratum.eqNullSafe(F.lit(t.stratum)) & (values[t.rule] > t.cutoff))
    return passes


def labelled_signals(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """measured: doc_id, stratum and the measures m. One row for each labelled document that passes the base rule."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    rows = measured.where(~base_failed(F.col("m"))).join(known, "doc_id")
    return rows.select("stratum", "bad", *(c.alias(rule) for rule, c in signals("m").items()))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> tuple[DataFrame, list[Threshold]]:
    """doc_id, stratum, measures m, base_failed and kept of every row, and the thresholds."""
    rows = with_measures(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text")), "text", "m")
    rows = materialize(rows.select("doc_id", "stratum", "m"), "quality")
    thresholds = calibrate(labelled_signals(rows, labels.select("doc_id", "quality")))
    failed = base_failed(F.col("m"))
    return rows.select("doc_id", "stratum", "m", failed.alias("base_failed"), (~failed & verdict(F.col("stratum"), "m", thresholds)).alias("kept")), thresholds


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Rows are written once with their measures, which both the cutoffs and the verdicts read."""
    own = fresh(docs, "__quality")
    judged = materialize(with_measures(docs, text_col, own), "judged")
    measured = judged.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(own).alias("m"))
    thresholds = calibrate(labelled_signals(measured, labels.select("doc_id", "quality")))
    kept = ~base_failed(F.col(own)) & verdict(F.col(stratum_col), own, thresholds)
    return judged.where(kept).drop(own)


def op8_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def oracle_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The same rows by DuckDB: measures, certified cutoffs and verdicts."""
    spaces = r"[ \t\n\x0B\f\r]+"
    formulas = " UNION ALL ".join(f"SELECT doc, stratum, bad, base_failed, '{rule}' AS rule, {formula} AS value FROM labelled" for rule, formula in RULES.items())
    judged = " UNION ALL ".join(f"SELECT doc, lang, '{rule}' AS rule, {formula} AS value FROM measured" for rule, formula in RULES.items())
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS doc, doc_id, lang, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, list_filter(regexp_split_to_array(t, '{spaces}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM numbered),
windows AS (SELECT doc, i, count(*) OVER (PARTITION BY doc, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc, w, unnest(range(1, len(w) - 1)) AS i FROM cut)),
repeats AS (SELECT doc, count(DISTINCT i + d) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY doc),
measured AS (
  SELECT c.doc, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{spaces}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')))::BIGINT AS n_upper,
    len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed
  FROM cut c LEFT JOIN repeats r ON r.doc = c.doc
),
known AS (SELECT doc_id, min(quality) = 0 AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT m.*, m.lang AS stratum, bad FROM measured m JOIN known USING (doc_id) WHERE NOT base_failed),
signal AS ({formulas}),
cutoffs AS (SELECT unnest({CUTOFFS}::DOUBLE[]) AS cutoff, unnest(range({len(CUTOFFS)})) AS step),
strata AS (SELECT count(*) AS n FROM (SELECT DISTINCT stratum FROM labelled)),
counts AS (
  SELECT stratum, rule, step, cutoff, count(*) FILTER (NOT bad) AS good, count(*) FILTER (bad) AS all_bad, count(*) FILTER (NOT bad AND value > cutoff) AS lost, count(*) FILTER (bad AND value > cutoff) AS caught
  FROM signal, cutoffs GROUP BY stratum, rule, step, cutoff
),
tested AS (
  SELECT *, CASE WHEN lost >= good THEN 1 ELSE list_sum(list_transform(range(0, lost + 1), lambda k:
    exp(lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * ln({alpha / len(RULES)!r}) + (good - k) * ln(1 - {alpha / len(RULES)!r})))) END AS p
  FROM counts WHERE good > 0 AND all_bad > 0
),
walked AS (SELECT *, max(CASE WHEN p > {delta!r} / ((SELECT n FROM strata) * {len(RULES)}) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY step) AS stopped FROM tested),
best AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - lost DESC, step) AS place, caught - lost AS gain FROM walked WHERE stopped = 0),
rejected AS (SELECT DISTINCT v.doc FROM ({judged}) v JOIN best b ON b.place = 1 AND b.gain > 0 AND b.rule = v.rule AND b.stratum IS NOT DISTINCT FROM v.lang AND v.value > b.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc NOT IN (SELECT doc FROM rejected) AS kept FROM measured
"""
