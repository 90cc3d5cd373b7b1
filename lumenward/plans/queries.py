"""The engine's queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward import catalog
from lumenward import rules as R
from lumenward.functions import normalize, predicates
from lumenward.operators import policy, review
from lumenward.operators import scan as S
from lumenward.plans import oracle as O
from lumenward.plans import seeds
from lumenward.plans.seeds import literal
from lumenward.sources import repos, texts
from lumenward.streaming import scan as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rules whose patterns are all plain, without their keywords: what the raw-text lane alone decides.
RAW = [replace(r, keywords=()) for r in catalog.CATALOG if r.regex and all(e.mode == "plain" for e in r.regex)]
FULL_SQL = f"with {seeds.DOCUMENTS_SQL}, {O.normalised('seeded', 'clean')}, {O.full(catalog.CATALOG, 'clean', 'doc_id, source')}"
HITS_SQL = f"with {seeds.DOCUMENTS_SQL}, {O.hits(RAW, 'seeded', 'doc_id, source, canary')}, {O.kept('doc_id')}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded documents after the raw-text rules."""
    return S.scan(seeds.documents(spark, sf_dir), RAW)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exploded(scanned(spark, sf_dir), "doc_id", "source", "canary")


# Scan and decision


@query(f"{HITS_SQL}, worst as (select doc_id, max(rank) as rank from kept group by doc_id) select source, {O.decision('rank')} as decision, count(*) as texts from seeded left join worst using (doc_id) group by 1, 2")
def decision_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each source get each decision."""
    return scanned(spark, sf_dir).groupBy("source", "decision").agg(F.count(F.lit(1)).alias("texts"))


@query(
    f"{HITS_SQL}, worst as (select doc_id, max(rank) as rank, count(*) as n from kept group by doc_id) "
    f"select doc_id, {O.decision('rank')} as decision, coalesce(n, 0) as findings, rank as worst_rank from seeded left join worst using (doc_id)"
)
def worst_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's decision, number of findings and worst rank."""
    return scanned(spark, sf_dir).select("doc_id", "decision", F.size("findings").cast("long").alias("findings"), F.array_max(F.transform("findings", lambda f: f["rank"])).alias("worst_rank"))


_ANY = [("documents", "doc_id", "text", "file"), ("pages", "page_id", "html", "web_content"), ("conversations", "conv_id", "text", "message"), ("events", "event_id", "props", "log_memory")]
_ANY_SQL = "texts as (" + " union all ".join(f"select {k}::bigint * 16 as id, '{c}' as channel, {t} || chr(10) || {seeds.picked_sql(k, list(seeds.CANARIES.values()))} as text from {n}" for n, k, t, c in _ANY) + ")"


@query(f"with {_ANY_SQL}, numbered as (select *, row_number() over () as rn from texts), {O.hits(RAW, 'numbered', 'rn, channel')} select channel, id as rule_id, count(*) as texts from hits group by 1, 2")
def channel_filter_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules match on which channel, over four tables, before suppression."""
    parts = None
    for name, key, text, channel in _ANY:
        canary = seeds.picked(F.col(key), list(seeds.CANARIES.values()))
        part = texts.spread(table(spark, sf_dir, name).select(key, text)).select(F.lit(channel).alias("channel"), F.concat(F.col(text), F.lit("\n"), canary).alias("text"))
        parts = part if parts is None else parts.unionByName(part)
    parts = parts.withColumn("lower", S.once(F.lower("text")))
    hits = [F.when(S.listens(r, F.col("channel")) & _matches(r), F.lit(r.id)) for r in RAW]
    return parts.select("channel", F.explode(F.array_compact(F.array(*hits))).alias("rule_id")).groupBy("channel", "rule_id").agg(F.count(F.lit(1)).alias("texts"))


def _matches(rule: R.Rule) -> Column:
    out = F.lit(False)
    for e in rule.regex:
        out = out | (predicates.possible(e, F.col("lower")) & F.rlike("text", F.lit(e.java)))
    return out


@query(f"{HITS_SQL} select doc_id, id as rule_id, case when kind = 'carrier' then 'carrier' else 'mechanism' end as kind, severity, (select count(*) from kept k where k.doc_id = h.doc_id and k.id = h.id) as kept from hits h")
def mechanism_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw finding, and whether it outlives the carriers of its category."""
    df = S.scan(seeds.documents(spark, sf_dir), RAW, before="found")
    kept = lambda f: F.exists("findings", lambda k: k["id"] == f["id"]).cast("long")
    rows = F.transform("found", lambda f: F.struct(f["id"].alias("rule_id"), f["kind"].alias("kind"), f["severity"].alias("severity"), kept(f).alias("kept")))
    return df.select("doc_id", F.inline(S.once(rows)))


def _downgraded(flag: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = findings(spark, sf_dir).where(F.col(flag))
        return rows.groupBy("canary", "id", "original_severity", "severity").agg(F.count(F.lit(1)).alias("texts")).withColumnRenamed("id", "rule_id")

    return run


@query(f"{HITS_SQL} select canary, id as rule_id, own as original_severity, severity, count(*) as texts from kept where neg group by all")
def negation_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a negation or a quoted example downgrades."""
    return _downgraded("negation_context")(spark, sf_dir)


@query(f"{HITS_SQL} select canary, id as rule_id, own as original_severity, severity, count(*) as texts from kept where not neg and def group by all")
def defensive_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of mechanisms in sentences about defence."""
    return _downgraded("defensive_context")(spark, sf_dir)


@query(f"{HITS_SQL} select doc_id, id as rule_id, matched as matched_text from hits where id in ('CAR-002', 'CAR-005', 'CAR-006', 'CAR-007')")
def regex_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first match of four carriers in each text."""
    return findings(spark, sf_dir).where(F.col("id").isin("CAR-002", "CAR-005", "CAR-006", "CAR-007")).select("doc_id", F.col("id").alias("rule_id"), "matched_text")


_ENCODED = (
    f"e as (select doc_id, 'file' as channel, {seeds.picked_sql('doc_id', seeds.ENCODED_NAMES)} as canary, text || chr(10) || {seeds.picked_sql('doc_id', list(seeds.ENCODED.values()))} as text from documents)"
)


@query(f"with {_ENCODED}, {O.normalised('e', 'clean')}, {O.full(catalog.CATALOG, 'clean', 'doc_id, canary')} select doc_id, canary, id as rule_id, severity, matched as matched_text from kept where lane = 3")
def corroborated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a keyword made candidates and the normalised text confirmed, over encoded canaries."""
    docs = _encoded(spark, sf_dir).withColumn("channel", F.lit("file"))
    return S.exploded(S.scan(docs, catalog.CATALOG), "doc_id", "kind_of").where("lane = 3").select("doc_id", F.col("kind_of").alias("canary"), F.col("id").alias("rule_id"), "severity", "matched_text")


@query(
    f"with {seeds.MESSAGES_SQL}, {O.normalised('talk', 'clean')}, {O.full(catalog.CATALOG, 'clean', 'conv_id, turn')}, "
    "f as (select conv_id, turn, max(rank) as r, string_agg(id || ':' || severity, ',' order by lane, first, ordinal) as found from kept group by 1, 2) "
    f"select conv_id, turn, {O.decision('r')} as decision, coalesce(found, '') as found from talk left join f using (conv_id, turn)"
)
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lanes of the whole catalog over all conversations."""
    done = S.scan(seeds.messages(spark, sf_dir), catalog.CATALOG)
    return done.select("conv_id", "turn", "decision", F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["id"], f["severity"])), ",").alias("found"))


@query(
    f"{HITS_SQL}, a as (select doc_id, list(distinct id) as ids, max(rank) as r from kept group by 1), b as (select doc_id, list(distinct id) as ids, max(rank) as r from kept where kind = 'carrier' group by 1) "
    f"select doc_id, array_to_string(list_sort(list_filter(coalesce(a.ids, []), lambda x: not list_contains(coalesce(b.ids, []), x))), ',') as only_with, array_to_string(list_sort(list_filter(coalesce(b.ids, []), lambda x: not list_contains(coalesce(a.ids, []), x))), ',') as only_without, "
    f"{O.decision('a.r')} <> {O.decision('b.r')} as decision_differs from seeded left join a using (doc_id) left join b using (doc_id)"
)
def finding_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mechanisms add to the carriers: rule ids on either side only, and whether the decision differs."""
    # Carriers never depend on mechanisms, so both verdicts come from one scan.
    df = S.scan(seeds.documents(spark, sf_dir), RAW, before="found").withColumn("carriers", F.filter("found", lambda f: f["kind"] == "carrier"))
    ids = lambda c: F.transform(c, lambda f: f["id"])
    only = lambda x, y: F.array_join(F.array_sort(F.array_except(ids(x), ids(y))), ",")
    differs = F.col("decision") != S.decision_of(F.col("carriers"))
    return df.select("doc_id", only("findings", "carriers").alias("only_with"), only("carriers", "findings").alias("only_without"), differs.alias("decision_differs"))


# Keywords

_KEYWORDS = [k for k, _ in R.keyword_index(catalog.CATALOG)] + ["the ", "tion", "que"]


@query(
    f"with {seeds.DOCUMENTS_SQL}, kw as (select unnest([{', '.join(map(literal, _KEYWORDS))}]) as keyword) "
    "select keyword, count(*) as texts, sum(strpos(lower(text), keyword) - 1)::bigint as places from seeded join kw on contains(lower(text), keyword) group by 1"
)
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many texts each keyword occurs, and the sum of its first places."""
    docs = seeds.documents(spark, sf_dir).select(F.posexplode(S.keyword_places(F.lower("text"), _KEYWORDS)).alias("k", "place")).where("place >= 0")
    words = F.array(*map(F.lit, _KEYWORDS))
    return docs.groupBy(F.get(words, F.col("k")).alias("keyword")).agg(F.count(F.lit(1)).alias("texts"), F.sum("place").cast("long").alias("places"))


@query(
    f"with {seeds.DOCUMENTS_SQL}, l as (select doc_id, lower(text) as t, strpos(lower(text), 'licen') - 1 as p from seeded where contains(lower(text), 'licen')), "
    f"w as (select *, substr(t, greatest(p - 50, 0) + 1, p - greatest(p - 50, 0)) as b from l) "
    f"select doc_id, substr(t, greatest(p - 10, 0) + 1, least(length(t), p + 25) - greatest(p - 10, 0)) as excerpt, {O.negated('b')} as negated from w"
)
def keyword_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surroundings of a keyword's first place, and whether they negate it."""
    low = seeds.documents(spark, sf_dir).select("doc_id", F.lower("text").alias("t")).where(F.contains("t", F.lit("licen")))
    at = low.withColumn("p", F.locate("licen", F.col("t")) - 1)
    return at.select("doc_id", predicates.excerpt(F.col("t"), F.col("p"), 5).alias("excerpt"), predicates.negated(S.before_keyword(F.col("t"), F.col("p"))).alias("negated"))


# Normalisation


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pick = lambda xs: seeds.picked(F.col("doc_id"), xs)
    return docs.select("doc_id", pick(seeds.ENCODED_NAMES).alias("kind_of"), F.concat("text", F.lit("\n"), pick(list(seeds.ENCODED.values()))).alias("text"))


_ENCODED_SQL = f"with e as (select doc_id, text || chr(10) || {seeds.picked_sql('doc_id', list(seeds.ENCODED.values()))} as text from documents)"


def _stage(name: str, f: Callable[[Column], Column], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _digest(_encoded(spark, sf_dir).select("doc_id", f(F.col("text")).alias("out")))

    run.__name__ = name
    query(f"{_ENCODED_SQL} select doc_id, length(o) as n, md5(o) as digest from (select doc_id, {sql} as o from e)" if sql else None)(run)


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.length("out").cast("long").alias("n"), F.md5(F.col("out").cast("binary")).alias("digest"))


def _translate(text: str, source: str, to: str) -> str:
    return f"translate({text}, {literal(source)}, {literal(to)})"


_WIDE = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
_AZ = normalize._UPPER + normalize._LOWER
_REFERENCES = ["", "&AMP;&nope;&amp", "&#73;&#0000073;&#x49;&#X49;", "&#x1F642;&#x10ffff;", "&#xD800;&#x110000;&#99999999999;&#abc;&#12ab;", "&" + ";&".join(normalize.ENTITIES) + ";"]
_stage("norm_invisible", normalize.strip_invisible, f"regexp_replace(text, '{normalize.INVISIBLE}', '', 'g')")
_stage("norm_homoglyph", normalize.replace_look_alikes, _translate("text", "".join(normalize.LOOK_ALIKES) + _WIDE, "".join(normalize.LOOK_ALIKES.values()) + _AZ))
_stage("norm_leet", normalize.decode_leet, _translate("text", *normalize.LEET))
_stage("norm_rot13", normalize.rot13, _translate("text", _AZ, normalize._ROTATED))
_stage("norm_reverse", normalize.backwards, "reverse(text)")
_stage("norm_whitespace", normalize.collapse_white, r"regexp_replace(regexp_replace(regexp_replace(text, '[\t\r\x0b\x0c]+', ' ', 'g'), ' {2,}', ' ', 'g'), '^[\t-\r \x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\t-\r \x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')")
_stage("norm_url", normalize.decode_percent, O.percent("text"))
_stage("norm_hex", normalize.decode_hex, O.hexadecimal("text"))
_stage("norm_base64", normalize.decode_base64, O.base64("text"))
_stage("norm_delimiters", normalize.join_padded, O.delimiters("text"))


@query(f"{_ENCODED_SQL} select doc_id, length(o) as n, md5(o) as digest from (select doc_id, {O.nfkc('text')} as o from e)")
def norm_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode NFKC."""
    return _digest(_encoded(spark, sf_dir).select("doc_id", normalize.nfkc("text").alias("out")))


@query(f"{_ENCODED_SQL}, {O.normalised('e', 'clean')} select doc_id, length(normal) as n, md5(normal) as digest from clean")
def norm_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole normalisation."""
    return _digest(normalize.normalized(_encoded(spark, sf_dir), "text", "out"))


@query(f"select page_id, length(o) as n, md5(o) as digest from (select page_id, {O.entities('t')} as o from (select page_id, html || {seeds.picked_sql('page_id', _REFERENCES)} as t from pages))")
def norm_html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of entity decoding over pages, with references of every form behind them."""
    html = F.concat("html", seeds.picked(F.col("page_id"), _REFERENCES))
    return _digest(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), normalize.decode_entities(html).alias("out"))).withColumnRenamed("doc_id", "page_id")


# Windows and guards


@query(
    "with t as (select doc_id, 'webhook ' || text || ' credentials' as text from documents), "
    f"w as (select doc_id, unnest(list_transform(range(case when length(text) <= {predicates.WINDOW} then 1 else ceil((length(text) - {predicates.WINDOW}) / {predicates.STRIDE}.0)::int + 1 end), "
    f"lambda i: substr(text, (i * {predicates.STRIDE} + 1)::int, {predicates.WINDOW}))) as win from t) "
    r"select doc_id, bool_or(regexp_matches(win, '(?i)\bwebhook\b') and regexp_matches(win, '(?i)\bcredentials?\b')) as hit, count(*) as windows from w group by 1"
)
def windowed_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words count together only if one window has both."""
    (regex,) = next(r for r in catalog.CATALOG if r.id == "CAR-009").regex
    docs = texts.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.lit("webhook "), "text", F.lit(" credentials")).alias("text"))
    docs = docs.withColumn("v", predicates.windows(F.col("text")))
    return docs.select("doc_id", predicates.hit(regex, F.col("text"), F.col("v")).isNotNull().alias("hit"), F.size("v").cast("long").alias("windows"))


@query(
    "with t as (select doc_id, case when doc_id % 3 = 0 then 'a security advisory ' else '' end || 'password ' || text || case when doc_id % 2 = 0 then ' upload' else '' end as text from documents), "
    f"w as (select doc_id, text, unnest(list_transform(range(case when length(text) <= {predicates.WINDOW} then 1 else ceil((length(text) - {predicates.WINDOW}) / {predicates.STRIDE}.0)::int + 1 end), "
    f"lambda i: substr(text, (i * {predicates.STRIDE} + 1)::int, {predicates.WINDOW}))) as win from t) "
    r"select doc_id, bool_or(regexp_matches(win, '(?i)\bpassword\b') and regexp_matches(win, '(?i)\bupload\b')) and not any_value(regexp_matches(text, '(?i)\bsecurity advisory\b')) as hit from w group by 1"
)
def guarded_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guard anywhere in the text defuses a window's match."""
    (regex,) = next(r for r in catalog.CATALOG if r.id == "CAR-010").regex
    guard = F.when(F.col("doc_id") % 3 == 0, "a security advisory ").otherwise("")
    tail = F.when(F.col("doc_id") % 2 == 0, " upload").otherwise("")
    docs = texts.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat(guard, F.lit("password "), "text", tail).alias("text"))
    return docs.select("doc_id", predicates.hit(regex, F.col("text")).isNotNull().alias("hit"))


# Policy

_ABLE = "tier = 'A' and severity in ('high', 'critical')"
_LADDER_SQL = (
    f"corr as (select source, doc_id, category, count(distinct id) as ids, count(distinct matched) as spans from kept where {_ABLE} group by all having ids >= 2 and spans >= 2), "
    "files as (select source, count(*) as files_scanned from documents group by 1), n as (select source, count(*) filter (tier <> 'S') as notes, count(*) filter (tier = 'S') as hits from kept group by 1), "
    "r as (select source, count(distinct doc_id) as to_review from corr group by 1), "
    "j as (select source, files_scanned, coalesce(notes, 0) as notes, coalesce(hits, 0) as hits, coalesce(to_review, 0) as to_review from files left join n using (source) left join r using (source)), "
    "o as (select *, case when hits > 0 then 'known_attack' when to_review > 0 then 'review_before_agent_ingestion' when notes > 0 then 'clean_notes' else 'clean' end as overall from j)"
)
_ROLLUP_SQL, _FULL_ROLLUP_SQL = f"{HITS_SQL}, {_LADDER_SQL}", f"{FULL_SQL}, {_LADDER_SQL}"
_ROLLED_SQL = (
    " select source, overall, files_scanned, notes, hits, to_review, case overall when 'known_attack' then 'block' when 'review_before_agent_ingestion' then 'quarantine' else 'allow' end as overall_decision, "
    "files_scanned || ' file(s) scanned · ' || notes || ' note(s)' || case when to_review > 0 then ' · ' || to_review || ' file(s) to review' else '' end || ' · recommendation: ' || "
    f"case overall {' '.join(f'when {literal(k)} then {literal(v[0])}' for k, v in policy.LADDER.items())} end as summary from o"
)


@query(_ROLLUP_SQL + _ROLLED_SQL)
def repo_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder over sources as collections."""
    sums = policy.ladder(scanned(spark, sf_dir), "source")
    told = policy.presented(*(F.col(c) for c in ("overall", "files_scanned", "notes", "to_review")))
    return sums.withColumn("p", told).select("source", "overall", "files_scanned", "notes", "hits", "to_review", "p.overall_decision", "p.summary")


@query(f"{_ROLLUP_SQL} select source, doc_id, category, ids, spans from corr")
def repo_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that two rules on two spans of one file confirm."""
    rows = scanned(spark, sf_dir).select("source", "doc_id", F.inline(S.once(policy.corroborated(F.col("findings")))))
    return rows.select("source", "doc_id", "category", F.col("ids").cast("long").alias("ids"), F.col("spans").cast("long").alias("spans"))


@query(f"{HITS_SQL} select tier, severity, tier = 'B' or severity not in ('high', 'critical') as note_only, count(*) as findings from kept group by all")
def tier_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by tier and severity, and whether they can corroborate."""
    rows = findings(spark, sf_dir).withColumn("note_only", policy.note_only(F.col("tier"), F.col("severity")))
    return rows.groupBy("tier", "severity", "note_only").agg(F.count(F.lit(1)).alias("findings"))


_FEW_SQL = f"with {seeds.MESSAGES_SQL}, few as (select conv_id, turn, 'file' as channel, text from talk qualify row_number() over (partition by conv_id order by turn) <= {texts.MAX_FILES})"
_REVIEWED = (
    f"corr as (select conv_id, turn, category from kept where {_ABLE} group by all having count(distinct id) >= 2 and count(distinct matched) >= 2), "
    "n as (select conv_id, count(*) filter (tier <> 'S') as notes, count(*) filter (tier = 'S') as hits from kept group by 1), r as (select conv_id, count(distinct turn) as to_review from corr group by 1), "
    "j as (select conv_id, count(*) as files_scanned, coalesce(any_value(notes), 0) as notes, coalesce(any_value(hits), 0) as hits, coalesce(any_value(to_review), 0) as to_review from few left join n using (conv_id) left join r using (conv_id) group by 1) "
    "select *, case when hits > 0 then 'known_attack' when to_review > 0 then 'review_before_agent_ingestion' when notes > 0 then 'clean_notes' else 'clean' end as overall from j"
)


@query(f"{_FEW_SQL}, {O.hits(RAW, 'few', 'conv_id, turn')}, {O.kept('conv_id, turn')}, {_REVIEWED}")
def repo_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from files to verdict, with conversations as collections and turns as files."""
    size = lambda c: F.size(c).cast("long")
    done = review.review(seeds.messages(spark, sf_dir), RAW, "conv_id", "turn", "turn")
    return done.select("conv_id", "files_scanned", size("notes").alias("notes"), size("signature_hits").alias("hits"), size("review").alias("to_review"), "overall")


# The whole catalog over documents and conversations: keywords, windows, guards and normalised text.
# The queries of the same names without full_ are their raw-text lane.


def full_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded documents after all lanes of the whole catalog."""
    return S.scan(seeds.documents(spark, sf_dir), catalog.CATALOG)


@query(f"{FULL_SQL}, worst as (select doc_id, max(rank) as rank from kept group by doc_id) select source, {O.decision('rank')} as decision, count(*) as texts from seeded left join worst using (doc_id) group by 1, 2")
def full_decision_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each source get each decision."""
    return full_scanned(spark, sf_dir).groupBy("source", "decision").agg(F.count(F.lit(1)).alias("texts"))


@query(
    f"{FULL_SQL}, worst as (select doc_id, max(rank) as rank, count(*) as n from kept group by doc_id) "
    f"select doc_id, {O.decision('rank')} as decision, coalesce(n, 0) as findings, rank as worst_rank from seeded left join worst using (doc_id)"
)
def full_worst_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's decision, number of findings and worst rank."""
    return full_scanned(spark, sf_dir).select("doc_id", "decision", F.size("findings").cast("long").alias("findings"), F.array_max(F.transform("findings", lambda f: f["rank"])).alias("worst_rank"))


@query(_FULL_ROLLUP_SQL + _ROLLED_SQL)
def full_repo_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder over sources as collections."""
    sums = policy.ladder(full_scanned(spark, sf_dir), "source")
    told = policy.presented(*(F.col(c) for c in ("overall", "files_scanned", "notes", "to_review")))
    return sums.withColumn("p", told).select("source", "overall", "files_scanned", "notes", "hits", "to_review", "p.overall_decision", "p.summary")


@query(f"{_FULL_ROLLUP_SQL} select source, doc_id, category, ids, spans from corr")
def full_repo_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that two rules on two spans of one file confirm."""
    rows = full_scanned(spark, sf_dir).select("source", "doc_id", F.inline(S.once(policy.corroborated(F.col("findings")))))
    return rows.select("source", "doc_id", "category", F.col("ids").cast("long").alias("ids"), F.col("spans").cast("long").alias("spans"))


@query(f"{FULL_SQL} select tier, severity, tier = 'B' or severity not in ('high', 'critical') as note_only, count(*) as findings from kept group by all")
def full_tier_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by tier and severity, and whether they can corroborate."""
    rows = S.exploded(full_scanned(spark, sf_dir), "doc_id").withColumn("note_only", policy.note_only(F.col("tier"), F.col("severity")))
    return rows.groupBy("tier", "severity", "note_only").agg(F.count(F.lit(1)).alias("findings"))


@query(f"{_FEW_SQL}, {O.normalised('few', 'clean')}, {O.full(catalog.CATALOG, 'clean', 'conv_id, turn')}, {_REVIEWED}")
def full_repo_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from files to verdict, with conversations as collections and turns as files."""
    size = lambda c: F.size(c).cast("long")
    done = review.review(seeds.messages(spark, sf_dir), catalog.CATALOG, "conv_id", "turn", "turn")
    return done.select("conv_id", "files_scanned", size("notes").alias("notes"), size("signature_hits").alias("hits"), size("review").alias("to_review"), "overall")


# Addresses, limits, requests, streams

_FORMS = ["https://github.com/Own{}/repo.git", "https://www.github.com/own{}/repo", "https://github.com/own{}/repo/blob/main/docs/a.md", "https://raw.githubusercontent.com/own{}/repo/main/x/y.md", "http://github.com/own{}/repo", "https://github.com/own{}", "https://github.com/own{}/repo/tree/main", "https://github.com/-own{}/repo", "https://example.com/own{}/repo", "nonsense {}", "https://raw.githubusercontent.com/own{}/repo/main", "https://github.com/own{}/repo/blob/main"]


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(f.replace("{}", "#")) for f in _FORMS])
    made = F.replace(F.get(forms, F.pmod(F.col("page_id"), F.lit(len(_FORMS))).cast("int")), F.lit("#"), F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages")
    return repos.parsed(pages.select("page_id", made.alias("url"))).unionByName(repos.parsed(pages.select((-F.col("page_id") - 1).alias("page_id"), "url")))


_URL_SQL = (
    f"with u as (select page_id, replace({seeds.picked_sql('page_id', [f.replace('{}', '#') for f in _FORMS])}, '#', page_id::varchar) as url from pages union all select -page_id - 1, url from pages), "
    r"s as (select *, lower(regexp_extract(url, '^([a-z]+)://', 1)) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') as p from u), "
    "f as (select *, host = 'raw.githubusercontent.com' as raw, host in ('github.com', 'www.github.com') as site, len(p) as n from s), "
    f"e as (select *, case when scheme = '' then {literal(repos.NOT_A_URL)} when scheme <> 'https' then {literal(repos.NOT_HTTPS)} when raw and n < 4 then {literal(repos.BAD_RAW)} when site and n < 2 then {literal(repos.NO_NAME)} "
    f"when (raw or site) and not coalesce(regexp_matches(p[1], {literal(repos.SEGMENT)}) and regexp_matches(p[2], {literal(repos.SEGMENT)}), false) then {literal(repos.BAD_NAME)} "
    f"when site and n <> 2 and not (n >= 5 and coalesce(p[3] = 'blob', false)) then {literal(repos.BAD_FORM)} when not raw and not site then {literal(repos.BAD_HOST)} end as error from f), "
    r"o as (select page_id, error, case when error is null then p[1] end as owner, case when error is null then case when raw then p[2] else regexp_replace(p[2], '\.git$', '') end end as repo, "
    "case when error is null then case when site and n = 2 then 'repo' else 'file' end end as form, "
    "case when error is null and not (site and n = 2) then array_to_string(case when raw then p[4:] else p[5:] end, '/') end as file_path from e)"
)


@query(f"{_URL_SQL} select * from o")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository addresses of every form, and the pages' own."""
    return _addresses(spark, sf_dir).select("page_id", "error", "owner", "repo", "form", "file_path")


@query(
    f"{_URL_SQL}, x as (select page_id, owner, repo, unnest(case when form = 'repo' then [{', '.join(map(literal, repos.SURFACES))}] else [file_path] end) as file_path, form from o where error is null) "
    "select page_id, file_path, case when form = 'repo' then 'https://raw.githubusercontent.com/' || owner || '/' || repo || '/HEAD/' || file_path end as head_url from x"
)
def surface_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files to look at behind each address."""
    rows = repos.targets(_addresses(spark, sf_dir))
    return rows.select("page_id", "file_path", F.when(F.col("raw_url").contains("/HEAD/"), F.col("raw_url")).alias("head_url"))


@query(
    "with t as (select doc_id, case when doc_id % 50 = 0 then '' when doc_id % 50 = 1 then repeat(text, (200000 // strlen(text))::int) else text end as text from documents) "
    f"select case when text = '' then 'empty' when strlen(text) > {texts.MAX_BYTES} then 'too large' else 'scanned' end as outcome, count(*) as texts, sum(strlen(text))::bigint as bytes from t group by 1"
)
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are scanned, and those that are refused and why."""
    text = F.when(F.col("doc_id") % 50 == 0, "").when(F.col("doc_id") % 50 == 1, F.expr("repeat(text, cast(200000 div octet_length(text) as int))")).otherwise(F.col("text"))
    rows = texts.guarded(table(spark, sf_dir, "documents").select(text.alias("text")))
    return rows.groupBy(F.coalesce("reject_reason", F.lit("scanned")).alias("outcome")).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query(f"select source, doc_id from documents qualify row_number() over (partition by source order by doc_id) <= {texts.MAX_FILES}")
def file_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first files of each collection."""
    return texts.limited(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query(f"select user_id, time_bucket(interval '1 hour', ts) as window_start, count(*) as requests, least(count(*), 3) as allowed, greatest(count(*) - 3, 0) as limited from events group by 1, 2")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per user and hour against a limit of three."""
    return streams.rate_windows(table(spark, sf_dir, "events"), "user_id", "ts", 3, "1 hour")


_CATALOG_SQL = ", ".join(f"({literal(r.kind)}, {len(r.keywords)}, {len(r.regex)}, {literal(r.tier) if r.tier else 'null'})" for r in catalog.CATALOG)


@query(
    f"with c(kind, keywords, regexes, tier) as (values {_CATALOG_SQL}), g as (select *, coalesce(tier, case when regexes > 0 then 'A' else 'B' end) as grade from c) "
    "select count(*) filter (kind = 'carrier') as patterns, count(*) filter (kind <> 'carrier') as mechanisms, sum(keywords)::bigint as keywords, count(*) filter (regexes > 0) as regex_patterns, "
    "count(*) filter (grade = 'S') as tier_s, count(*) filter (grade = 'B') as tier_b from g"
)
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog holds, from its table."""
    t = R.table(spark, catalog.CATALOG)
    return t.agg(
        F.count_if(F.col("kind") == "carrier").alias("patterns"), F.count_if(F.col("kind") != "carrier").alias("mechanisms"), F.sum(F.size("keywords")).cast("long").alias("keywords"),
        F.count_if(F.size("regex") > 0).alias("regex_patterns"), F.count_if(F.col("tier") == "S").alias("tier_s"), F.count_if(F.col("tier") == "B").alias("tier_b"),
    )


@query()
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests in, JSON responses out, over all conversations."""
    bodies = seeds.messages(spark, sf_dir).select(F.to_json(F.struct("text", F.lit("nowhere").alias("channel"))).alias("body"))
    done = streams.scan_requests(bodies, catalog.CATALOG)
    return texts.as_json(done.select("channel", "reject_reason", "decision", "verdict_meaning", policy.shown(F.col("findings")).alias("findings")))
