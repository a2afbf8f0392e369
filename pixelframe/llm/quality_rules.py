"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one
bit for each failed rule, and is stored as Parquet. Policies are versioned masks over those
bits, so a new policy or an ablation reads the stored bits and never a text again.

Defined results: null and empty texts have no words and fail the word count; repeated rows
give repeated ledger rows; an empty table gives an empty ledger; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, kept_where, table, words, written

#: A sorted key holds the upper bits of a window's hash and its position in the lower ones.
POSITION_BITS = 24
_LOW = (1 << POSITION_BITS) - 1

#: Bit -> (name, failure condition over the measurements). Bits never change meaning.
RULES: dict[int, tuple[str, str]] = {
    0: ("few_words", "n_words < 50"),
    1: ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    2: ("symbols", "10 * n_symbols > n_words"),
    3: ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    4: ("upper_case", "2 * n_upper > word_chars"),
    5: ("exclamations", "4 * n_exclaim > n_words"),
    6: ("long_words", "word_chars > 20 * n_words"),
    7: ("duplicate_line_chars", "10 * dup_line_chars > 3 * line_chars"),
}
BASE_MASK = 0b11
#: Version -> mask of the rules that reject.
POLICIES: dict[int, int] = {1: BASE_MASK, 2: 0b1111111, 3: 0b11110111}
CURRENT = 3


def _window_key(w: Column, i: Column) -> Column:
    h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))


def measurements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All measurements of each text, in one pass and without a shuffle.

    Windows found twice: their hashes are sorted as plain longs and neighbours compared.
    Neighbours that agree in the kept hash bits but not in their words, and texts with more
    words than positions fit, take an exact sort over the words themselves.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.size("w")
    step = docs.select(F.col(key).alias("doc_id"), body.alias("t"), words(F.col(text)).alias("w"))
    step = step.select(
        "doc_id", "t", "w",
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.sort_array(F.when((n >= 3) & (n < (1 << POSITION_BITS)), F.transform(F.sequence(F.lit(0), n - 3), lambda i: _window_key(F.col("w"), i))).otherwise(F.array().cast("array<bigint>"))).alias("keys"),
    )
    high = lambda c: F.shiftright(c, POSITION_BITS)
    step = step.select(
        "doc_id", "t", "w", "lines",
        F.filter("keys", lambda x, i: (high(F.get("keys", i - 1)).eqNullSafe(high(x))) | (high(F.get("keys", i + 1)).eqNullSafe(high(x)))).alias("twins"),
    )
    at = lambda c, k: F.get("w", c.bitwiseAND(F.lit(_LOW)).cast("int") + k)

    def differs(x: Column, i: Column) -> Column:
        prev = F.get("twins", i - 1)
        return (high(prev).eqNullSafe(high(x))) & ((at(prev, 0) != at(x, 0)) | (at(prev, 1) != at(x, 1)) | (at(prev, 2) != at(x, 2)))

    collides = F.size(F.filter("twins", differs)) > 0
    fast = F.transform("twins", lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int"))
    step = step.select(
        "doc_id", "t", "w", "lines",
        F.sort_array(F.when(collides | (n >= (1 << POSITION_BITS)), _exact_positions(F.col("w"), n)).otherwise(fast)).alias("at"),
    )
    gaps = F.transform("at", lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get("at", i - 1))))
    return step.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("lines", "")).cast("long").alias("line_chars"),
        (F.length(F.array_join("lines", "")) - F.length(F.array_join(F.array_distinct("lines"), ""))).cast("long").alias("dup_line_chars"),
        F.regexp_count("t", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
    )


def _exact_positions(w: Column, n: Column) -> Column:
    """Positions of windows found twice, by sorting the windows themselves."""
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.slice(w, i + 1, 3).alias("k"), i.alias("p"))))

    def twice(all_: Column) -> Column:
        kept = F.filter(all_, lambda x, i: (F.get(all_, i - 1)["k"].eqNullSafe(x["k"])) | (F.get(all_, i + 1)["k"].eqNullSafe(x["k"])))
        return F.transform(kept, lambda x: x["p"])

    return F.get(F.transform(F.array(pairs), twice), F.lit(0))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and fail_bits (bit r set: rule r failed) of each document."""
    bits = F.lit(0)
    for r, (_, failed) in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << r)).otherwise(F.lit(0)))
    return measurements(docs, key, text).withColumn("fail_bits", bits)


def stored_ledger(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger written to path (replaced; by default a folder of its own among the shared ones) and read back. Null, empty and repeated rows have a line each; an empty table gives an empty ledger."""
    rows = ledger(docs, key, text)
    if path is None:
        return written(rows, "ledger")
    rows.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def verdict(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Adds kept: no bit of the policy's mask is set; and decided_by: the one rule that rejects, null where none or several do."""
    mine = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
    alone = F.when(F.bit_count(mine) == 1, F.expr(f"CASE {' '.join(f'WHEN fail_bits & {POLICIES[policy]} = {1 << r} THEN {r}' for r in RULES)} END"))
    return rows.withColumn("kept", mine == 0).withColumn("decided_by", alone)


def ablations(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be kept without it. An empty ledger gives no rows, repeated rows count each.

    Bits are counted first (at most 2^rules rows), then each rule is dropped from the mask in turn.
    """
    mask = POLICIES[policy]
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("bit"), F.lit(name).alias("rule")) for r, (name, _) in RULES.items() if mask >> r & 1]))
    one = F.expr("shiftleft(1, r.bit)")
    return (
        counts.select("b", "n", rules.alias("r"))
        .groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("b").bitwiseAND(one) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("b") == one, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("b").bitwiseAND(F.lit(mask).bitwiseXOR(one)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger of all documents under the current policy and the first one, and the ablation of the rule that decides a document: how many documents would be kept without it. The ablation has a row for each rule and is broadcast."""
    stored = stored_ledger(table(spark, sf_dir, "documents"))
    without = F.broadcast(ablations(stored).select(F.col("bit").alias("decided_by"), "n_kept_without"))
    rows = verdict(stored).join(without, "decided_by", "left")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"), "kept", "fail_bits",
        (F.col("fail_bits").bitwiseAND(F.lit(POLICIES[1])) == 0).alias("kept_v1"), "decided_by", "n_kept_without",
    )


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps, with the columns of documents. A text is measured where it lies: no join. Null, empty and short texts go; repeated rows stay or go alike, rows without an id like others; an empty table stays empty; other columns are dropped."""
    tagged = docs.select(F.struct("doc_id", "text", "lang", "source", "n_chars").alias("d"), "text")
    kept = verdict(ledger(tagged.select("d", "text"), key="d"))
    return kept_where(kept, F.col("kept")).select("doc_id.*")


_WORD = r"[^\x20\x09-\x0D]"
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '{SEPARATORS}'), lambda x: x <> '') w FROM d),
g AS (SELECT rid, i, w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) i FROM w WHERE len(w) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) c FROM g) WHERE c > 1),
c AS (SELECT rid, count(*) n FROM (SELECT DISTINCT rid, i + o p FROM r, (SELECT unnest([0, 1, 2]) o)) GROUP BY rid),
l AS (SELECT rid, count(*) n_lines, count(DISTINCT x) n_dist, length(string_agg(x, '')) line_chars, length(string_agg(x, '')) - length(array_to_string(list_distinct(list(x)), '')) dup_line_chars FROM (SELECT rid, unnest(string_split(t, chr(10))) x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY rid),
m AS (
  SELECT w.doc_id, len(w.w)::BIGINT n_words, length(array_to_string(w.w, ''))::BIGINT word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, coalesce(l.n_lines - l.n_dist, 0)::BIGINT n_dup_lines,
    coalesce(c.n, 0)::BIGINT n_repeat_words, coalesce(l.n_lines, 0) n_lines, coalesce(l.line_chars, 0) line_chars, coalesce(l.dup_line_chars, 0) dup_line_chars,
    len(regexp_extract_all(t, '[A-Z]')) n_upper, length(t) - length(replace(t, '!', '')) n_exclaim
  FROM w LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, (CASE WHEN {RULES[0][1]} THEN 1 ELSE 0 END) {" ".join(f"| (CASE WHEN {e} THEN {1 << r} ELSE 0 END)" for r, (_, e) in RULES.items() if r)} fail_bits FROM m),
v AS (SELECT *, fail_bits & {POLICIES[CURRENT]} mine FROM b),
a AS (SELECT r decided_by, (SELECT count(*) FROM v WHERE mine & ~(1 << r) = 0) n_kept_without FROM (SELECT unnest({list(RULES)}) r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {BASE_MASK}) <> 0 AS base_failed, mine = 0 AS kept, fail_bits::INT AS fail_bits,
  (fail_bits & {POLICIES[1]}) = 0 AS kept_v1, a.decided_by::INT AS decided_by, a.n_kept_without FROM v LEFT JOIN a ON v.mine = 1 << a.decided_by
"""
