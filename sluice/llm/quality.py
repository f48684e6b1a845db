"""Quality rules as a bitmask ledger, in DataFrame expressions only.

:func:`ledger` evaluates every rule once per document and stores the measures
and one integer of failure bits.  A policy is a named version of a bit mask;
:func:`apply_policy` decides with one bitwise AND, and :func:`ablations`
answers, in one aggregation over the stored bits, how many documents each
policy keeps and how many it would keep without each of its rules.

Repeated windows of three words are found within a row: each window's hash is
joined with its position in one integer, the integers are sorted, and
neighbours with the same hash are compared word by word.  Where two of them differ,
the text's windows of shared hashes are sorted by their words instead.  That takes
n log n steps for n words, and no row leaves its task.

Null and empty texts have no words; a long text is one row's arrays, some ten
times its size; repeated rows are judged each by itself; null ids stay null; an
empty table gives no rows; other columns are ignored by :func:`ledger`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rules by name, in bit order; a rule holds where a document fails it.  Stored bits keep their
#: meaning: a rule never changes, a new threshold is a new rule at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "repeated_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "mostly_repeated_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Versions of the verdict; a version never changes once it has been used.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "repeated_lines"),
    "web-2": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "mostly_repeated_lines"),
}


def mask(policy: str) -> int:
    return sum(BITS[rule] for rule in POLICIES[policy])


def words(text: Column) -> Column:
    """All words of a text as an array; none for null."""
    inner = F.btrim(text, F.lit(SEPARATORS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures of column ``text``; adds only columns that start with ``_sl_`` or are measures."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    df = df.withColumns({"_sl_words": words(F.col(text)), "_sl_lines": lines})
    w, n = F.col("_sl_words"), F.size("_sl_words")
    # a window's place takes the low bits, its hash the others
    df = df.withColumn("_sl_bits", F.length(F.bin(n.cast("long"))))
    bits = F.col("_sl_bits")
    window = lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long"))
    df = df.withColumn("_sl_keys", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window))).otherwise(F.array().cast("array<bigint>")))
    keys = F.col("_sl_keys")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    place = lambda k: k.bitwiseAND(low).cast("int")
    high = lambda k: F.call_function("shiftright", k, bits)

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(high(x) == high(y), F.lit(False))

    df = df.withColumn("_sl_near", F.filter(keys, lambda k, j: alike(k, F.get(keys, j + 1)) | alike(k, F.get(keys, j - 1))))
    near = F.col("_sl_near")
    three = lambda k: [F.get(w, place(k) + i) for i in range(3)]

    def clash(x: Column, y: Column) -> Column:
        return alike(x, y) & (F.array(*three(x)) != F.array(*three(y)))

    def repeated(runs: Column) -> Column:
        at = lambda r, j: F.coalesce(r["w"] == F.get(runs, j)["w"], F.lit(False))
        return F.transform(F.filter(runs, lambda r, j: at(r, j + 1) | at(r, j - 1)), lambda r: r["p"])

    df = df.withColumn("_sl_clash", F.size(F.filter(near, lambda k, j: clash(k, F.get(near, j + 1)))) > 0)
    # only where different windows have one hash, by the words themselves
    runs = F.sort_array(F.transform(near, lambda k: F.struct(F.array(*three(k)).alias("w"), place(k).alias("p"))))
    df = df.withColumn("_sl_runs", F.when(F.col("_sl_clash"), runs))
    df = df.withColumn("_sl_found", F.sort_array(F.when(F.col("_sl_clash"), repeated(F.col("_sl_runs"))).otherwise(F.transform(near, place))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    # always 0; a filter isn't pushed below what isn't deterministic, where it would be evaluated again for each word
    guard = F.shiftright(F.monotonically_increasing_id(), 63)
    covered = F.aggregate("_sl_found", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long"),
            "n_lines": F.size("_sl_lines").cast("long"),
            "n_dup_lines": (F.size("_sl_lines") - F.size(F.array_distinct("_sl_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long") + guard,
        }
    )


def failures() -> Column:
    """All rules' bits in one integer."""
    out = F.lit(0).cast("long")
    for name, rule in RULES.items():
        out = out + F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long")
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and ``failed``, the bits of all rules a document fails."""
    measured = measure(docs.select("doc_id", "text")).select("doc_id", *MEASURES)
    return measured.withColumn("failed", failures())


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    return ledger.withColumn("policy", F.lit(policy)).withColumn("kept", passes(policy))


def ablations(ledger: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(policy, without, kept): documents kept by each policy, whole and without each rule, in one pass.

    The ledger is first reduced to one row per pattern of failure bits, of which
    there are 2**rules at most.
    """
    policies = policies or POLICIES
    rows = [(p, rule, sum(BITS[r] for r in rules if r != rule)) for p, rules in policies.items() for rule in (None, *rules)]
    cases = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(rule).cast("string").alias("without"), F.lit(m).cast("long").alias("mask")) for p, rule, m in rows))
    patterns = ledger.groupBy("failed").agg(F.count("*").alias("documents"))
    hit = F.when(F.col("failed").bitwiseAND(F.col("case.mask")) == 0, F.col("documents")).otherwise(F.lit(0))
    judged = patterns.withColumn("case", F.explode(cases))
    return judged.groupBy("case.policy", "case.without").agg(F.sum(hit).alias("kept"))


def keep(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """The documents that pass a policy, with their own columns."""
    own = docs.select(F.struct("*").alias("_sl_row"), F.col("text"))
    return measure(own).withColumn("_sl_failed", failures()).where(passes(policy, "_sl_failed")).select("_sl_row.*")


MEASURED_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM base),
p AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT rid, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS k FROM p),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) t(d) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM base),
dl AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT b.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
  CAST(length(b.text) - length(regexp_replace(b.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dl.n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dl USING (rid))
"""

ORACLE_SQL = MEASURED_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
       OR word_chars < 3 * n_words OR word_chars > 12 * n_words
       OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM m
"""

ABLATIONS_SQL = MEASURED_SQL + f"""
SELECT policy, without, CAST(count(*) FILTER (failed & mask = 0) AS BIGINT) AS kept
FROM (SELECT {" + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES.items())} AS failed FROM m),
  (VALUES {", ".join(str((p, rule or "", sum(BITS[r] for r in rules if r != rule))) for p, rules in POLICIES.items() for rule in (None, *rules))}) cases(policy, without, mask)
GROUP BY policy, without
"""
