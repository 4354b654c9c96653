"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Words are dealt in blocks of equal size. Each source's target gets a whole number of blocks by highest quotients, and so do
the source's wards and, within a ward, its shards (bounded parts, dealt by a seeded hash, so that no source is gathered in
one task). A shard's documents lie in a row, in seeded order, and the row is parted into bales of BALE words. The shard's
quota of blocks takes the whole row as often as it can, and the rest from bales in another seeded order. So most documents
are taken a whole number of times, and those at the ends of a bale in part (their first words).

Defined results: a null text has size 0; sources are ordered by code point, a null source is a source of its own and
comes last; null and repeated doc_ids are rows like any other; rows alike in doc_id, source and text are taken alike (each
an equal part of what they get together, rounded down); documents of size 0 are never taken; an empty table gives no rows.
`mixed_documents` keeps all columns, whatever their names (other than ones that begin with "__mix_").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SEPARATORS, by_name, cut

WEIGHTS, CAP, BLOCK, BALE, SHARD_WORDS, WARD, SALTS, SEED = (5, 2, 1), 3, 16, 1_024, 1_000_000, 1_024, 64, 42
WORDS = f"[^{SEPARATORS}]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, source_size) to the same with target: shares of all words by weight, stopped at cap times the source's size.

    What stops is shared again by weight. With sources ordered by cap * size / weight, those before some place are
    stopped; the level of the rest is what remains over their weights, and the first place whose level fits is the one.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.get(F.array(*map(F.lit, weights)), (turn - 1) % len(weights)).cast("long")
    ranked = sources.withColumn("w", w).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most").cast("double") / F.col("w"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left.cast("double") / F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    levels = ranked.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))
    return levels.withColumn("fit", F.min(fits).over(W.partitionBy())).select("source", "source_size", F.least(F.col("most").cast("double"), F.col("fit.level") * F.col("w")).alias("target"))


def apportion(parties: DataFrame, seats: str, votes: str, key: list[str], within: list[str]) -> DataFrame:
    """parties with quota: the whole number of seats that highest quotients votes / (2k + 1) give each, among those alike in `within`.

    Quotas lie near each party's exact share, by no more than its share of the parties' number and 2; only quotients in
    that reach are ranked, so rows stay in proportion to the parties however many seats there are.
    """
    group = W.partitionBy(*within)
    all_votes = F.sum(votes).over(group)
    share = F.when(all_votes > 0, F.col(votes) / all_votes).otherwise(0.0)
    reach = F.ceil(share * F.count("*").over(group)) + 2
    ideal = share * F.col(seats)
    sized = parties.withColumn("low", F.greatest(F.lit(0), F.floor(ideal) - reach).cast("long")).withColumn("high", (F.floor(ideal) + reach).cast("long")).withColumn("rest", F.col(seats) - F.sum("low").over(group))
    seat = sized.where(F.col(votes) > 0).select(*within, *key, votes, "rest", F.explode(F.sequence("low", "high")).alias("__seat"))
    best = W.partitionBy(*within).orderBy((F.col(votes) / (2 * F.col("__seat") + 1)).desc(), *(F.col(c).asc_nulls_last() for c in key))
    won = seat.withColumn("place", F.row_number().over(best)).where("place <= rest").groupBy(*within, *key).agg(F.count("*").alias("won"))
    both = [*within, *key]
    return sized.join(won, both, "left").withColumn("quota", F.col("low") + F.coalesce("won", F.lit(0))).drop("low", "high", "rest", "won")


def _named(df: DataFrame) -> DataFrame:
    """A source key that is never null and differs for null and every string."""
    return df.withColumn("__s", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))


def _long(hex32: Column, at: int) -> Column:
    return F.conv(F.substring(hex32, at, 8), 16, 10).cast("long")


def _bales() -> Column:
    """From a shard's length, and rest (words to take, fewer than it has): how many words of each bale are taken."""
    last = "length - (bales - 1) * {b}"
    text = """transform(array_sort(transform(ranked, (x, r) -> struct(x.b as b, cast(greatest(0, least(
          if(x.b = bales - 1, """ + last + """, {b}),
          rest - r * {b} + if(r > last_place, {b} - (""" + last + """), 0))) as int) as words))), x -> x.words)"""
    return F.expr(text.format(b=BALE))


def mix(sized: DataFrame) -> DataFrame:
    """From rows (doc_id, source, size, t: a hash of the text) to one row for each that differs: the same with n (how many are alike), source_size, target, and taken, the words that each of them gives."""
    alike = _named(cut(sized.groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("n"))))
    base = alike.withColumn("words", F.col("size") * F.col("n")).withColumn("o", F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "t")))
    per_source = base.groupBy("__s").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    planned = targets(per_source.select("source", "source_size"))
    planned = _named(planned).withColumn("seats", F.round(F.sum("source_size").over(W.partitionBy()) / BLOCK).cast("long")).withColumn("one", F.lit(1))
    planned = apportion(planned, "seats", "target", ["__s"], ["one"])
    planned = cut(planned.select("__s", "source_size", "target", F.col("quota").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long").alias("shards")))
    # a source may hold a third of the rows: its few plan rows are repeated, and its documents dealt over them
    salted = planned.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = base.withColumn("salt", F.pmod(_long(F.col("o"), 9), F.lit(SALTS))).join(salted, ["__s", "salt"])
    dealt = dealt.withColumn("shard", F.pmod(_long(F.col("o"), 1), F.col("shards"))).drop("salt", "shards")
    shards = cut(dealt.groupBy("__s", "shard", "blocks").agg(F.sum("words").alias("length")).withColumn("ward", F.expr(f"shard div {WARD}")))
    wards = shards.groupBy("__s", "ward", "blocks").agg(F.sum("length").alias("inside"))
    wards = apportion(wards, "blocks", "inside", ["ward"], ["__s"]).select("__s", "ward", F.col("quota").alias("seats"))
    quotas = apportion(shards.drop("blocks").join(wards, ["__s", "ward"]), "seats", "length", ["shard"], ["__s", "ward"])
    quotas = quotas.where("length > 0").withColumn("quota", F.least(F.col("quota") * BLOCK, CAP * F.col("length")))
    quotas = quotas.select("__s", "shard", "length", F.expr("quota div length").alias("whole"), F.expr("quota % length").alias("rest"), F.ceil(F.col("length") / BALE).cast("int").alias("bales"))
    # few bytes, but a sort of bales for each: dealt by number, not by size
    quotas = quotas.repartition(max(1, -(-shards.count() // 32)), "__s", "shard")
    name = F.concat(F.lit(f"{SEED}:"), "__s", F.lit(":"), F.col("shard").cast("string"), F.lit(":"))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("bales") - 1), lambda i: F.struct(F.md5(F.concat(name, i.cast("string"))).alias("h"), i.alias("b"))))
    quotas = quotas.withColumn("ranked", ranked).withColumn("last_place", F.expr("array_position(transform(ranked, x -> x.b), bales - 1) - 1"))
    quotas = cut(quotas.select("__s", "shard", "whole", _bales().alias("bale_words")))
    line = W.partitionBy("__s", "shard").orderBy("o", "doc_id", "t")
    placed = dealt.withColumn("end", F.sum("words").over(line.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("start", F.col("end") - F.col("words"))
    part = F.expr(f"""aggregate(sequence(start div {BALE}, (end - 1) div {BALE}), 0L,
      (acc, i) -> acc + greatest(0L, least(end, i * {BALE} + bale_words[cast(i as int)]) - greatest(start, i * {BALE})))""")
    taken = F.when(F.col("words") > 0, F.col("whole") * F.col("words") + part).otherwise(F.lit(0).cast("long"))
    given = placed.join(quotas, ["__s", "shard"], "left").withColumn("taken", taken)
    return given.select("doc_id", "source", "size", "t", "n", "source_size", "target", F.expr("taken div n").alias("taken"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.coalesce(F.md5("text"), F.lit("")).alias("t"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return mix(_sized(docs)).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select(*columns)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole time a document is taken, and one with its first words,
    single-spaced, where it is taken in part. The plan is made of ids and sizes; texts move once, to meet it."""
    plan = mix(_sized(docs)).where("taken > 0")
    plan = plan.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("t").alias("__mix_t"), F.expr("taken div size").alias("__mix_full"), F.expr("taken % size").cast("int").alias("__mix_part"))
    keyed = docs.select("*", F.coalesce(F.md5("text"), F.lit("")).alias("__mix_key"))
    on = (keyed["__mix_key"] == plan["__mix_t"]) & keyed["doc_id"].eqNullSafe(plan["__mix_id"]) & keyed["source"].eqNullSafe(plan["__mix_source"])
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORDS})")), F.lit(1), F.col("__mix_part")), " ")
    texts = F.concat(F.array_repeat(F.col("text"), F.col("__mix_full").cast("int")), F.when(F.col("__mix_part") > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    taken = keyed.join(plan, on).withColumn("__mix_text", F.explode(texts))
    columns = {c: by_name(c) for c in docs.columns} | {"text": F.col("__mix_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("__mix_text").cast(docs.schema["n_chars"].dataType)
    return taken.select(*(v.alias(c) for c, v in columns.items()))


ORACLE = f"""
with alike as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::bigint as size, coalesce(md5(text), '') as t, count(*) as n
  from documents group by all
), sized as (
  select *, size * n as words, md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || t) as o from alike
), src as (
  select source, sum(words)::bigint as source_size from sized group by source
), ranked as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end as w
  from src
), ratios as (
  select *, {CAP} * source_size as most, ({CAP} * source_size)::double / w as ratio from ranked
), levels as (
  select *, row_number() over (order by ratio, source nulls last) as place,
    (sum(source_size) over () - coalesce(sum(most) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(w) over (order by ratio, source nulls last rows between current row and unbounded following))::double as level
  from ratios
), fit as (
  select level from levels where level <= ratio order by place limit 1
), planned as (
  select source, coalesce('=' || source, '') as s, source_size, least(most::double, fit.level * w) as target,
         greatest(1, ceil(source_size / {SHARD_WORDS}.0))::bigint as shards
  from levels, fit
), seats as (
  select round(sum(source_size) / {BLOCK}.0)::bigint as n from src
), won as (
  select s, count(*) as blocks from (
    select s, row_number() over (order by target / (2 * k + 1) desc, s) as place
    from (select s, target, unnest(range((target / {BLOCK} + 40)::bigint)) as k from planned where target > 0)
  ), seats where place <= seats.n group by s
), dealt as (
  select z.*, p.s, p.source_size, p.target, coalesce(w.blocks, 0) as blocks, (('0x' || substr(z.o, 1, 8))::bigint) % p.shards as shard
  from sized z join planned p on coalesce('=' || z.source, '') = p.s left join won w on w.s = p.s
), shard as (
  select s, shard, shard // {WARD} as ward, blocks, sum(words)::bigint as length from dealt group by s, shard, blocks
), ward as (
  select s, ward, count(*) as seats from (
    select s, ward, blocks, row_number() over (partition by s order by inside / (2 * k + 1) desc, ward) as place
    from (select s, ward, blocks, inside, unnest(range((3 * inside / {BLOCK} + 40)::bigint)) as k
          from (select s, ward, blocks, sum(length) as inside from shard group by s, ward, blocks) where inside > 0)
  ) where place <= blocks group by s, ward
), shard_won as (
  select s, shard, count(*) as quota from (
    select h.s, shard, seats, row_number() over (partition by h.s, h.ward order by length / (2 * k + 1) desc, shard) as place
    from (select *, unnest(range((3 * length / {BLOCK} + 40)::bigint)) as k from shard where length > 0) h join ward w on w.s = h.s and w.ward = h.ward
  ) where place <= seats group by s, shard
), quota as (
  select h.s, h.shard, h.length, least(coalesce(q.quota, 0) * {BLOCK}, {CAP} * h.length)::bigint as quota
  from shard h left join shard_won q on q.s = h.s and q.shard = h.shard where h.length > 0
), bale as (
  select s, shard, b, quota % length as rest, least({BALE}, length - b * {BALE})::bigint as words, md5('{SEED}:' || s || ':' || shard || ':' || b) as h
  from (select *, unnest(range(ceil(length / {BALE}.0)::bigint)) as b from quota)
), chosen as (
  select s, shard, b, greatest(0, least(words, rest - coalesce(sum(words) over (partition by s, shard order by h, b rows between unbounded preceding and 1 preceding), 0)))::bigint as words
  from bale
), placed as (
  select *, (sum(words) over (partition by s, shard order by o, doc_id, t rows between unbounded preceding and current row) - words)::bigint as start from dealt
), part as (
  select p.s, p.shard, p.o, p.doc_id, p.t, sum(greatest(0, least(p.start + p.words, c.b * {BALE} + c.words) - greatest(p.start, c.b * {BALE})))::bigint as part
  from placed p join chosen c on c.s = p.s and c.shard = p.shard and c.b between p.start // {BALE} and (p.start + p.words - 1) // {BALE}
  where p.words > 0 group by all
)
select p.doc_id, p.size, p.source_size, p.target,
  (case when p.words > 0 then ((q.quota // q.length) * p.words + a.part) // p.n else 0 end)::bigint as taken
from (select *, unnest(range(n)) as copy from placed) p left join quota q on q.s = p.s and q.shard = p.shard
left join part a on a.s = p.s and a.shard = p.shard and a.o = p.o and a.doc_id is not distinct from p.doc_id and a.t = p.t
"""
