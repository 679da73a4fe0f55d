"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document. The ledger keeps its failures as bits of one long, beside the
measurements. A policy is a versioned mask over those bits, so another policy, or what dropping one rule would
change, needs bitwise arithmetic over the ledger and no second look at a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, without_space

#: The symbols of the contract.
SYMBOLS = "#*$%&|<>"

#: Rules by bit: name and the failing condition, as SQL over the measurements. New rules go to the end.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_word_windows", "100 * n_repeat_words > 50 * n_words"),
    ("too_many_words", "n_words > 1000000"),
    ("mean_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 8 * n_lines"),
    ("no_letters", "n_letters = 0"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version: the rules that each of them enforces.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_word_windows"],
    "v1": [name for name, _ in RULES],
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more in the array.

    Windows are sorted with their positions, so that equal ones are neighbours; the positions of those with an
    equal neighbour are sorted again, and each covers three words less what the next one covers too.
    """

    def covered(at: Column) -> Column:
        following = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.lit(2**31 - 1)))
        return F.aggregate(F.zip_with(at, following, lambda a, b: F.least(b - a, F.lit(3))), F.lit(0), lambda s, x: s + x)

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        same = lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])
        pairs = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])))
        at = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        return F.when(n < 2, F.lit(0)).otherwise(let(at, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(covered(p))))

    def windows(w: Column) -> Column:
        def one(i: Column) -> Column:
            text = F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.struct(F.xxhash64(text).alias("h"), text.alias("w"), i.alias("i"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), one))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), of_sorted))


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and the measurements that rules use."""
    spaced = F.translate(text_or_empty(), "\t\n\x0b\x0c\r", "     ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    bare = docs.select("doc_id", text_or_empty().alias("t"), without_space(text_or_empty()).alias("bare"), words.alias("words"), lines.alias("lines"))
    return bare.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length("bare").cast("long").alias("word_chars"),
        (F.length("bare") - F.length(F.translate("bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.regexp_like("bare", F.lit(r"\p{L}")), 1).otherwise(0).cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """measured(docs) with `failed`: bit i is 1 if rule i of RULES fails. A null text counts as empty; repeated rows stay."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", bits)


def judged(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with `base_failed` and `kept`, the policy's verdict."""
    hit = lambda p: F.col("failed").bitwiseAND(F.lit(mask(p))) != 0
    return book.select("*", hit("base").alias("base_failed"), (~(hit("base") | hit(policy))).alias("kept"))


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that would be kept without it. One pass, partial sums."""
    under = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    counts = [F.sum((under.bitwiseAND(F.lit(BIT[r])) != 0).cast("long")).alias(f"f_{r}") for r in POLICIES[policy]]
    counts += [F.sum((under == BIT[r]).cast("long")).alias(f"o_{r}") for r in POLICIES[policy]]
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(f"f_{r}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{r}", F.lit(0)).alias("n_only")) for r in POLICIES[policy]))
    return book.agg(*counts).select(F.inline(rules))


def quality_rules(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """One row for each document: the measurements, `failed`, `base_failed` and `kept`.

    Null and empty texts have no words and fail the base rules; an empty table gives an empty result; columns
    other than doc_id and text are ignored; rows that are repeated are judged each.
    """
    return judged(ledger(docs), policy)


def op7_quality_rules(spark, sf_dir):
    from .common import table

    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines, CASE WHEN regexp_matches(t, '\p{L}') THEN 1 ELSE 0 END::BIGINT AS n_letters
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
        + CASE WHEN n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 8 * n_lines THEN 32 ELSE 0 END
        + CASE WHEN n_letters = 0 THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f
"""
