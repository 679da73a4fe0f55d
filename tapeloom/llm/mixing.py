"""Temperature mixing of sources, with DataFrame functions only.

Token shares p of the sources become weights in proportion to p ** a. The exponent a is bisected: the smallest
with which no source is repeated more than a limit, or the largest whose weights reach a share of the greatest
entropy. Weights times a token budget give each source its tokens, which are realised as whole passes over the
source and one part of a pass. Every pass walks the source's blocks in a permutation of its own; the part of a
pass takes blocks from the start of its permutation until the budget is met, and splits the block it ends in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty
from .quality_rules import let

#: Blocks of a source: prefix sums run over at most so many rows of a source, and over the rows of one block.
N_BLOCKS = 4096
MAX_REPEAT = 2.0
STEPS = 60


def hex_hash(*parts: Column) -> Column:
    """16 hex digits that order a permutation; the same in every engine that has md5."""
    return F.substring(F.md5(F.concat_ws("/", *parts)), 1, 16)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(shares: Column, budget: Column | None, max_repeat: float | None, entropy_share: float | None) -> Column:
    """Bisect the exponent over an array of struct(x: tokens / most tokens, m: sources with so many, most: tokens)."""
    total = lambda f: F.aggregate(shares, F.lit(0.0), lambda s, e: s + e["m"] * f(e["x"]))
    smallest = F.array_min(F.transform(shares, lambda e: e["x"]))
    most = F.get(shares, F.lit(0))["most"]

    def too_low(a: Column) -> Column:
        """Whether the exponent has to rise."""
        z = total(lambda x: F.pow(x, a))
        if max_repeat is not None:
            scale = F.lit(1.0) if budget is None else budget / (z * most)
            return scale * F.pow(smallest, a - 1) > max_repeat
        entropy = F.ln(z) - a * total(lambda x: F.pow(x, a) * F.ln(x)) / z
        return entropy >= entropy_share * F.ln(total(lambda x: F.lit(1.0)))

    def step(s: Column, _: Column) -> Column:
        return let((s["lo"] + s["hi"]) / 2, lambda mid: F.when(too_low(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi"))))

    span = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    return F.when(F.coalesce(smallest, F.lit(1.0)) == 1.0, F.lit(1.0)).otherwise(F.round(span["hi" if max_repeat is not None else "lo"], 12))


def source_plan(sources: DataFrame, budget: int | None, max_repeat: float | None, entropy_share: float | None) -> DataFrame:
    """sources (src, tokens) -> with exponent, weight, share (its tokens of the budget), passes, rest.

    The array that the bisection runs over has one element for each distinct number of tokens, not for each
    source; equal sources are counted. Without a budget the source with the most tokens is taken exactly once,
    so every document is used. A source without a token is passed once, with weight 0.
    """
    real = sources.filter("tokens > 0")
    sizes = real.groupBy("tokens").agg(F.count("*").alias("m"))
    packed = sizes.agg(F.collect_list(F.struct("tokens", "m")).alias("e")).select(
        F.array_max(F.transform("e", lambda e: e["tokens"])).alias("most"), "e"
    )
    shares = F.transform("e", lambda e: F.struct((e["tokens"] / F.col("most")).alias("x"), e["m"].cast("double").alias("m"), F.col("most").cast("double").alias("most")))
    cap = None if budget is None else F.lit(float(budget))
    one = packed.select("most", let(shares, lambda s: F.struct(exponent(s, cap, max_repeat, entropy_share).alias("a"), s.alias("s"))).alias("r")).select(
        "most", F.col("r.a").alias("exponent"), F.aggregate("r.s", F.lit(0.0), lambda t, e: t + e["m"] * F.pow(e["x"], F.col("r.a"))).alias("z")
    )
    x = F.pow(F.col("tokens") / F.col("most"), F.col("exponent"))
    share = F.round(F.col("most") * x if budget is None else F.lit(float(budget)) * x / F.col("z")).cast("long")
    planned = sources.join(F.broadcast(one)).select(  # one row
        "src", "tokens", "exponent",
        F.when(F.col("tokens") > 0, x / F.col("z")).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, share).otherwise(0).alias("share"),
    )
    whole = F.expr("share div nullif(tokens, 0)")
    return planned.withColumn("passes", F.coalesce(whole, F.lit(1))).withColumn("rest", F.coalesce(F.col("share") - whole * F.col("tokens"), F.lit(0)))


def mix(docs: DataFrame, budget: int | None = None, max_repeat: float | None = MAX_REPEAT, entropy_share: float | None = None, seed: int = 0) -> DataFrame:
    """The rows of docs (doc_id, text, source and any others), each once for every pass that takes it.

    Added columns: mix_tokens, mix_pass (from 0), mix_block, mix_order (sort by it to read the mixture in block
    permutations), mix_weight and mix_exponent of the source. Tokens are words. A null source is a source of its
    own; a null text has no tokens; rows that are repeated are repeated each as often as their like; an empty
    table stays empty. Columns of docs with the names of added ones are replaced, and others may have any name. Documents
    without a doc_id are told apart, and dealt to blocks, by their text.
    """
    given = docs.drop("mix_tokens", "mix_pass", "mix_block", "mix_order", "mix_weight", "mix_exponent")
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    id_ = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.md5(text_or_empty()))
    block = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), id_)), 1, 6), 16, 10).cast("long") % N_BLOCKS
    row_key = [src.alias("mix_src"), id_.alias("mix_id"), F.xxhash64(text_or_empty()).alias("mix_hash")]
    units = (
        docs.select(*row_key, block.alias("block"), n_words(text_or_empty()).alias("tokens"))
        .groupBy("mix_src", "mix_id", "mix_hash", "block")
        .agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("each"))
    )
    blocks = units.groupBy(F.col("mix_src").alias("src"), F.col("block").alias("b")).agg(F.sum("tokens").alias("block_tokens"))
    sources = blocks.groupBy("src").agg(F.sum("block_tokens").alias("tokens"))
    plan = source_plan(sources, budget, max_repeat, entropy_share).drop("tokens")
    order = lambda n, b: hex_hash(F.lit(seed), F.col("src"), n, b)
    before = F.sum("block_tokens").over(Window.partitionBy("src").orderBy(order(F.col("passes"), F.col("b")), "b")) - F.col("block_tokens")
    placed = blocks.join(plan, "src").withColumn("left", F.col("rest") - before)
    inner = Window.partitionBy("mix_src", "block").orderBy(hex_hash(F.lit(seed), F.col("passes"), F.col("mix_id")), "mix_id", "mix_hash")
    taken = (
        units.join(placed, (F.col("mix_src") == F.col("src")) & (F.col("block") == F.col("b")))
        .withColumn("upto", F.sum("tokens").over(inner))
        .select(
            "mix_src", "mix_id", "mix_hash", F.col("each").alias("mix_tokens"), F.col("block").alias("mix_block"), F.col("weight").alias("mix_weight"), F.col("exponent").alias("mix_exponent"),
            (F.col("passes") + F.when((F.col("upto") <= F.col("left")) & (F.col("left") > 0), 1).otherwise(0)).alias("mix_passes"),
        )
        .filter("mix_passes > 0")
    )
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in given.columns)).alias("mix_row"), *row_key)  # any names travel in a struct
    out = keyed.join(taken, ["mix_src", "mix_id", "mix_hash"]).withColumn("mix_pass", F.explode(F.sequence(F.lit(0), (F.col("mix_passes") - 1).cast("int"))))
    place = F.concat(hex_hash(F.lit(seed), F.col("mix_src"), F.col("mix_pass"), F.col("mix_block")), hex_hash(F.lit(seed), F.col("mix_pass"), F.col("mix_id")))
    return out.select("mix_row.*", "mix_tokens", "mix_pass", "mix_block", place.alias("mix_order"), "mix_weight", "mix_exponent")


def op10_mixing(spark, sf_dir):
    from .common import table

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_tokens", "mix_pass", "mix_block", "mix_order", F.round("mix_weight", 9).alias("mix_weight"), F.round("mix_exponent", 9).alias("mix_exponent"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS src, coalesce('=' || doc_id, '') AS id,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
u AS (SELECT *, ('0x' || substr(md5('0/' || id), 1, 6))::BIGINT % 4096 AS block FROM d),
s AS (SELECT src, sum(tokens)::BIGINT AS tokens FROM u GROUP BY src),
m AS (SELECT max(tokens) AS most, CASE WHEN min(tokens) = max(tokens) THEN 1.0 ELSE round(greatest(0, 1 - ln(2.0) / ln(max(tokens)::DOUBLE / min(tokens))), 12) END AS a FROM s WHERE tokens > 0),
z AS (SELECT sum((tokens::DOUBLE / most) ** a) AS z FROM s, m WHERE tokens > 0),
p AS (SELECT src, tokens AS all_tokens, a, CASE WHEN tokens > 0 THEN (tokens::DOUBLE / most) ** a / z ELSE 0 END AS weight,
        CASE WHEN tokens > 0 THEN round(most * (tokens::DOUBLE / most) ** a)::BIGINT ELSE 0 END AS share FROM s, m, z),
q AS (SELECT *, coalesce(share // nullif(all_tokens, 0), 1) AS passes, coalesce(share - (share // nullif(all_tokens, 0)) * all_tokens, 0) AS rest FROM p),
b AS (SELECT src, block, sum(tokens) AS block_tokens FROM u GROUP BY ALL),
l AS (SELECT b.*, a, weight, passes, rest - (sum(block_tokens) OVER (PARTITION BY b.src ORDER BY substr(md5('0/' || b.src || '/' || passes || '/' || block), 1, 16), block) - block_tokens) AS rest_left
      FROM b JOIN q ON b.src = q.src),
t AS (SELECT u.*, a, weight, passes, rest_left, sum(tokens) OVER (PARTITION BY u.src, u.block ORDER BY substr(md5('0/' || passes || '/' || id), 1, 16), id) AS upto
      FROM u JOIN l ON u.src = l.src AND u.block = l.block),
n AS (SELECT *, passes + CASE WHEN upto <= rest_left AND rest_left > 0 THEN 1 ELSE 0 END AS n_pass FROM t),
x AS (SELECT *, unnest(range(0, n_pass::BIGINT)) AS k FROM n)
SELECT doc_id, source, tokens AS mix_tokens, k::INTEGER AS mix_pass, block AS mix_block,
       substr(md5('0/' || src || '/' || k || '/' || block), 1, 16) || substr(md5('0/' || k || '/' || id), 1, 16) AS mix_order,
       round(weight, 9) AS mix_weight, round(a, 9) AS mix_exponent FROM x
"""
