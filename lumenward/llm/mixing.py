"""Mixing sources to target weights by hierarchical budgeting, in DataFrame expressions only.

Leaves of a domain-language-source tree hold documents. A token budget flows from the root down: the children of
a node share its budget by weight, no child gets more than its subtree can give, and what a child cannot take
goes to its siblings. As a node's own budget is bounded by its subtree in the same way one level up, a shortage
reaches an ancestor's other children only when all siblings are full. A leaf gives whole epochs and then a
prefix of one more: its documents in an order that a seed and the epoch's number fix, up to the last token.

All amounts are integers, compared in decimals, so sums are exact and results the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenward.llm import common

LEVELS = ("domain", "lang", "source")
#: Weights by level and name; names not listed get DEFAULT_WEIGHT. A weight of 0 excludes a subtree.
WEIGHTS: Mapping[str, Mapping[str, int]] = {
    "domain": {"web": 30, "books": 10, "code": 10, "forum": 10},
    "lang": {"en": 6, "fr": 2, "de": 2, "es": 1},
    "source": {},
}
DEFAULT_WEIGHT = 1
DOMAINS = ("web", "books", "code", "forum")
#: The budget in hundredths of the corpus's own tokens.
BUDGET_PERCENT = 125
MAX_EPOCHS = 2
SEED = 17
#: Documents of a leaf that one task puts in order, about.
ROWS_PER_BUCKET = 4_000
#: Leaves (or leaf buckets) that may be broadcast, about 100 bytes each; and rows of the mixture, 24 bytes each.
BROADCAST_ROWS, BROADCAST_CHOSEN = 100_000, 500_000
_WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: sources are dealt to DOMAINS by the number at the end of their name."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(number.cast("int"), F.lit(len(DOMAINS))) + 1)))


def weight_of(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """nodes(parent..., name, w, cap, total) with alloc: total shared by weight w among the children of a parent.

    A child is full if its cap is at most its share of what is left when all children with a smaller cap per
    weight are full. The others share the rest in proportion; rounding follows the running sums, so the parts
    add up exactly. Children of weight 0 get 0.
    """
    big = lambda c: c.cast("decimal(38,0)")
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name) if parent else Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), name)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    some = nodes.where("w > 0")
    some = some.withColumn("__left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("__w", F.sum("w").over(after))
    some = some.withColumn("__fits", F.col("cap").cast("decimal(19,0)") * F.col("__w").cast("decimal(18,0)") <= F.col("w").cast("decimal(18,0)") * F.col("__left").cast("decimal(19,0)"))
    some = some.withColumn("__full", F.min("__fits").over(upto))
    some = some.withColumn("__rest", F.col("total") - F.sum(F.when(F.col("__full"), F.col("cap")).otherwise(0)).over(whole))
    some = some.withColumn("__open", F.when(F.col("__full"), 0).otherwise(F.col("w")))
    some = some.withColumn("__run", F.sum("__open").over(upto)).withColumn("__all", F.sum("__open").over(whole))
    some = some.withColumn("__rest", big(F.col("__rest"))).withColumn("__run", big(F.col("__run"))).withColumn("__all", big(F.col("__all"))).withColumn("__open", big(F.col("__open")))
    part = F.expr("cast(__rest * __run as decimal(38,0)) div __all - cast(__rest * (__run - __open) as decimal(38,0)) div __all")
    some = some.withColumn("alloc", F.when(F.col("__full"), F.col("cap")).otherwise(part).cast("long"))
    none = nodes.where("w <= 0").withColumn("alloc", F.lit(0).cast("long"))
    return some.select(*nodes.columns, "alloc").unionByName(none)


def budgets(leaves: DataFrame, budget: int, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """leaves(levels..., cap) with alloc: the budget, or as much of it as the tree can give, at its leaves."""
    most = min(budget, leaves.agg(F.sum("cap")).first()[0] or 0)
    above = None
    for depth, level in enumerate(levels):
        parent, own = list(levels[:depth]), list(levels[: depth + 1])
        nodes = leaves.groupBy(*own).agg(F.sum(F.col("cap")).alias("cap")).withColumn("w", weight_of(level, weights.get(level, {})))
        nodes = nodes.withColumn("total", F.lit(most).cast("long")) if above is None else nodes.join(above, parent)
        above = share(nodes, parent, level).select(*own, F.col("alloc").alias("total"))
    return leaves.join(above.withColumnRenamed("total", "alloc"), list(levels))


def capacities(leaves: DataFrame, max_epochs: int, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """leaves(levels..., tokens) with cap: the tokens of all epochs, 0 below a weight of 0."""
    open_ = F.lit(True)
    for level in levels:
        open_ = open_ & (weight_of(level, weights.get(level, {})) > 0)
    return leaves.withColumn("cap", F.when(open_, F.col("tokens") * max_epochs).otherwise(0).cast("long"))


def place_of(key: Column, epoch: Column, seed: int) -> Column:
    """A document's place in an epoch's order: 32 bits of the MD5 of seed, epoch and key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("long")


def mix(
    rows: DataFrame,
    key: str = "doc_id",
    tokens: str = "n_tokens",
    levels: Sequence[str] = LEVELS,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """rows(key, tokens, levels...) with epochs (whole copies), prefix_tokens (of one more) and taken_tokens.

    rows must be narrow and cheap to read again. Levels must not be null. A leaf's order is cut into buckets by
    its leading bits; a bucket's tokens before it come from a small table, so no task orders a whole leaf.
    Rows that tie in place, key and tokens are interchangeable.
    """
    levels = list(levels)
    leaves = rows.groupBy(*levels).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = common.written(leaves, "leaves")
    totals = leaves.agg(F.sum("tokens"), F.sum("docs"), F.count(F.lit(1))).first()
    total, docs, n_leaves = (x or 0 for x in totals)
    plan = budgets(capacities(leaves, max_epochs, levels, weights), total * budget_percent // 100, levels, weights)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(0).cast("int"))
    plan = common.written(plan.withColumn("rest", F.col("alloc") - F.col("epochs") * F.col("tokens")).select(*levels, "epochs", "rest"), "plan")
    buckets = max(1, -(-docs // ROWS_PER_BUCKET))
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    placed = rows.join(small(plan, n_leaves), levels).withColumn("__u", place_of(F.col(key), F.col("epochs") + 1, seed))
    placed = placed.withColumn("__b", F.shiftright(F.col("__u") * F.lit(buckets).cast("long"), 32).cast("int"))
    sums = placed.groupBy(*levels, "__b").agg(F.sum(tokens).alias("__sum"))
    earlier = Window.partitionBy(*levels).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*levels, "__b", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*levels, "__b").orderBy("__u", key, tokens).rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("__run", F.coalesce(F.sum(tokens).over(within), F.lit(0))).join(small(sums, n_leaves * buckets), [*levels, "__b"])
    left = F.col("rest") - F.col("__before") - F.col("__run")
    prefix = F.greatest(F.lit(0).cast("long"), F.least(F.col(tokens), left)).cast("long")
    out = ordered.select(*rows.columns, "epochs", prefix.alias("prefix_tokens"))
    return out.withColumn("taken_tokens", F.col("epochs") * F.col(tokens) + F.col("prefix_tokens"))


def leaf_columns(domain: Callable[[Column], Column] = domain_of) -> list[Column]:
    """domain, lang, source and n_tokens of documents: tokens are runs without ASCII white space.

    domain: the domain of a source. The default deals sources out by number, for tables whose sources are numbered.
    """
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    words = F.regexp_count(common.text_of("text"), F.lit(_WORD)).cast("long")
    return [domain(source).alias("domain"), lang.alias("lang"), source.alias("source"), words.alias("n_tokens")]


def counted(docs: DataFrame, key: str = "doc_id", domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """(key, domain, lang, source, n_tokens) of documents, written."""
    return common.written(docs.select(key, *leaf_columns(domain)), "counted")


def mixed(docs: DataFrame, key: str = "doc_id", domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """The mixture itself: a row of docs for each epoch that takes it; the last one of a leaf's prefix is cut.

    Rows are numbered where they stand, so that equal rows and null keys never meet in one task, and what the
    mixture takes is joined by that number. The cut row keeps its first words, joined by single spaces. Null and
    empty texts come in whole epochs. Empty table: no rows. Extra columns stay, whatever their names.
    """
    # The row travels as one value, so that no column of its own can clash with these.
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), F.monotonically_increasing_id().alias("id"), *leaf_columns(domain))
    own = common.written(own, "numbered")
    chosen = mix(own.select("k", "id", *LEVELS, "n_tokens"), "k").where("epochs > 0 or prefix_tokens > 0").select("id", "epochs", "prefix_tokens")
    chosen = common.written(chosen, "chosen")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_CHOSEN else chosen
    joined = own.select("id", "row", "n_tokens").join(chosen, "id")
    copies = F.sequence(F.lit(1), F.col("epochs") + F.when(F.col("prefix_tokens") > 0, 1).otherwise(0))
    rows = joined.withColumn("copy", F.explode(copies))
    cut = (F.col("copy") > F.col("epochs")) & (F.col("prefix_tokens") < F.col("n_tokens"))
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("prefix_tokens").cast("int")), " ")).otherwise(F.col("row.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document: whole epochs, and tokens of one more.

    Null source or language: a leaf of its own, named by the empty string. Null or empty text: no tokens, taken
    in whole epochs only. Null ids: one place in the order. Repeated rows: a row each. Empty table: no rows.
    Other columns of documents are not read.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(counted(docs)).select("doc_id", "domain", "lang", "source", "n_tokens", "epochs", "prefix_tokens", "taken_tokens")


def _sql() -> str:
    """DuckDB SQL for op4_mixing."""
    case = lambda level: "case " + " ".join(f"when {level} = '{n}' then {w}" for n, w in WEIGHTS[level].items()) + f" else {DEFAULT_WEIGHT} end" if WEIGHTS[level] else str(DEFAULT_WEIGHT)
    names = ", ".join(f"'{d}'" for d in DOMAINS)
    parts = [
        f"""with t as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) num,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens from documents),
        d as (select doc_id, case when num = '' then 'other' else list_extract([{names}], (num::int % {len(DOMAINS)}) + 1) end as domain, lang, source, n_tokens from t),
        leaf as (select domain, lang, source, sum(n_tokens)::hugeint tokens, (sum(n_tokens) * {MAX_EPOCHS})::hugeint cap from d group by all),
        a0 as (select least(sum(tokens) * {BUDGET_PERCENT} // 100, sum(cap)) total from leaf)"""
    ]
    for k, level in enumerate(LEVELS):
        parent, own = ", ".join(LEVELS[:k]), ", ".join(LEVELS[: k + 1])
        by = f"partition by {parent}" if k else ""
        join = f"join a{k} using ({parent})" if k else "cross join a0"
        parts.append(
            f"""n{k} as (select {own}, sum(cap)::hugeint cap, ({case(level)})::hugeint w from leaf group by {own}),
            o{k} as (select *, total - coalesce(sum(cap) over (s rows between unbounded preceding and 1 preceding), 0) lft, sum(w) over (s rows between current row and unbounded following) wr
              from n{k} {join} window s as ({by} order by cap::double / w::double, {level})),
            f{k} as (select *, bool_and(cap * wr <= w * lft) over ({by} order by cap::double / w::double, {level} rows between unbounded preceding and current row) fl from o{k}),
            r{k} as (select *, total - sum(case when fl then cap else 0 end) over ({by or ''}) rest, case when fl then 0 else w end op from f{k}),
            p{k} as (select *, sum(op) over ({by} order by cap::double / w::double, {level} rows between unbounded preceding and current row) rn, sum(op) over ({by or ''}) al from r{k}),
            a{k + 1} as (select {own}, (case when fl then cap else rest * rn // al - rest * (rn - op) // al end)::hugeint total from p{k})"""
        )
    last = len(LEVELS)
    parts.append(
        f"""e as (select domain, lang, source, case when tokens > 0 then total // tokens else 0 end epochs, tokens, total from leaf join a{last} using (domain, lang, source)),
        u as (select d.*, epochs, total - epochs * tokens rest, ('0x' || substr(md5('{SEED}|' || (epochs + 1)::varchar || '|' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint u from d join e using (domain, lang, source)),
        c as (select *, greatest(0, least(n_tokens, rest - coalesce(sum(n_tokens) over (partition by domain, lang, source order by u, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0))) pre from u)
        select doc_id, domain, lang, source, n_tokens, epochs::int epochs, pre::bigint prefix_tokens, (epochs * n_tokens + pre)::bigint taken_tokens from c"""
    )
    return ",\n".join(parts)


ORACLE = _sql()
