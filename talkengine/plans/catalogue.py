"""The registered queries of the core and the SQL that gives the same rows.

Every query reads its whole tables and whole texts. Searches take the rows whose id is divisible by 20 as queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrays as A, responses as R, scores as S, text as T
from ..operators import augment, budget, evaluation, labelling, metrics, mining, pipeline, prompts, relate, requests, retrieval, review, sampling
from .runtime import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- pieces of SQL


def _sq(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ +| +$', '', 'g')"


def _st(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _plain(x: str) -> str:
    return f"coalesce(lower({_sq(x)}), '')"


#: Compatibility forms that the test tables hold: full-width signs and letters, ligatures, the ellipsis, the hard blank.
_WIDE, _NARROW = "".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")


def _nfkc(x: str) -> str:
    return _sq(f"replace(replace(replace(translate({x}, '{_WIDE}' || chr(160), '{_NARROW}' || ' '), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...')")


def _canon(x: str) -> str:
    return f"coalesce(replace(lower({_nfkc(x)}), 'ß', 'ss'), '')"


def _has(x: str, term: str) -> str:
    return rf"(contains(lower({x}), lower({term})) and regexp_matches(lower({x}), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(lower({term})) || '($|[^\p{{L}}\p{{N}}_])'))"


_ANCHOR = "lower(" + _st("anchor_id") + ")"
_CATEGORY = "(values " + ", ".join(f"('{c}', '{s}')" for c, v in A.CATEGORY_SUBTYPES.items() for s in v) + ") as cat(category, label)"
_KNOWN = "(values " + ", ".join(f"('{c}')" for c in A.CATEGORY_SUBTYPES) + ") as known(category)"
_TERM = "(values " + ", ".join(f"('{t}', '{s}')" for t, s in A.TERM_SUBTYPES.items()) + ") as term(token, label)"
_SEEDS = """seeds as (select token, max_by({'tier': tier, 'category': category}, term) as s from (
    select distinct trim(unnest(list_distinct(list_concat([lower(term)], list_transform(coalesce(variants, []), lambda v: lower(v)))))) as token, tier, category, term from seed_words where term is not null)
    where token <> '' group by token),
idx as (select token, s.tier as tier, s.category as category from seeds)"""
_PAIRS = "(select distinct pair_id, anchor_id, anchor_text, source_register, variant_text, register, preservation_pct, preservation_check_passed, differs_from_anchor, llm_self_score from pairs)"
_NEG = "(select distinct neg_id, text, source_type, llm_gate_score, structural_check_passed, subtype_confidence, anchor_utt_id, anchor_seed_term, transcript_ref, transcript_subtype, human_verified, human_label, list_sort(coalesce(subtype, [])) as subtype from negatives)"


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "corpus").dropDuplicates(["utt_id"])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pairs").dropDuplicates(["pair_id"])


def _negatives(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "negatives").dropDuplicates(["neg_id"])


def _anchor() -> F.Column:
    return F.lower(T.strip("anchor_id"))


# ---------------------------------------------------------------- text, predicates, joins


@_query(f"""with c as (select distinct utt_id, {_nfkc('utterance')} as utterance, setting from corpus where utterance is not null)
select min(utt_id) as utt_id, utterance, min_by(case when setting in {T.SETTINGS!r} then setting else 'Unknown' end, utt_id) as setting from c group by utterance""")
def normalize_dedup_keep_first(spark, d):
    rows = _corpus(spark, d).where("utterance is not null").select("utt_id", T.nfkc("utterance").alias("utterance"), T.setting_of("setting").alias("setting"))
    return relate.keep_first(rows, ["utterance"], ["utt_id"]).select("utt_id", "utterance", "setting")


@_query(f"select distinct neg_id from negatives where {_canon('text')} not in (select {_canon('utterance')} from corpus)")
def canon_net_new(spark, d):
    return relate.net_new(_negatives(spark, d).select("neg_id", "text"), _corpus(spark, d), T.canon("text"), T.canon("utterance")).select("neg_id")


@_query(f"select distinct neg_id from negatives where lower({_st('text')}) in (select lower({_st('variant_text')}) from pairs where variant_text is not null)")
def leak_semi_join(spark, d):
    key = lambda c: F.lower(T.strip(c))
    return relate.already_known(_negatives(spark, d).select("neg_id", "text"), _pairs(spark, d), key("text"), key("variant_text")).select("neg_id")


@_query(f"""select distinct utt_id, len(regexp_extract_all(utterance, '[\\p{{L}}\\p{{N}}_]+'))::int as n_words,
(length({_st('utterance')}) < 20 or len(regexp_extract_all({_st('utterance')}, '[\\p{{L}}\\p{{N}}_]+')) < 5) as is_fragment from corpus""")
def fragment_filter(spark, d):
    return _corpus(spark, d).select("utt_id", T.word_count("utterance").alias("n_words"), T.is_fragment("utterance").alias("is_fragment"))


@_query(rf"""select neg_id, (case when {_st('text')} = '' then 0 else len(regexp_split_to_array({_st('text')}, '\s+')) end between 2 and 40)
and (anchor_seed_term is null or {_has('text', 'anchor_seed_term')}) as ok from {_NEG}""")
def structural_check(spark, d):
    return _negatives(spark, d).select("neg_id", T.well_formed("text", "anchor_seed_term").alias("ok"))


@_query(f"select pair_id, {_plain('variant_text')} <> '' and {_plain('variant_text')} <> {_plain('anchor_text')} as differs from {_PAIRS}")
def differs_from_anchor(spark, d):
    return _pairs(spark, d).select("pair_id", T.differs("variant_text", "anchor_text").alias("differs"))


@_query(f"""with c as (select distinct utt_id, list_distinct(list_concat(coalesce(tier2_cues, []), coalesce(tier3_cues, []))) as cues from corpus),
j as (select pair_id, cues, lower(coalesce(variant_text, '')) as v from {_PAIRS} p join c on c.utt_id = {_ANCHOR}),
k as (select pair_id, len(cues)::int as n_cues, len(list_filter(cues, lambda x: contains(v, lower(x))))::int as n_kept from j)
select pair_id, n_cues, n_kept, round(case when n_cues = 0 then 1.0 else n_kept / n_cues end, 6) as kept_share, case when n_cues = 0 then 1.0 else n_kept / n_cues end >= 0.8 as passed from k""")
def cue_preservation(spark, d):
    cues = _corpus(spark, d).select(F.col("utt_id").alias("a"), A.all_cues("tier2_cues", "tier3_cues").alias("cues"))
    j = _pairs(spark, d).select("pair_id", "variant_text", _anchor().alias("a")).join(cues, "a")
    share = A.kept_share("variant_text", F.col("cues"))
    return j.select("pair_id", F.size("cues").alias("n_cues"), F.size(A.kept_cues("variant_text", F.col("cues"))).alias("n_kept"), F.round(share, 6).alias("kept_share"), (share >= 0.8).alias("passed"))


@_query(f"""with r as (select unnest(['LARGE_GROUP', 'SMALL_GROUP', 'INFORMAL']) as register)
select r.register, count(*) as n, count(distinct pair_id) as n_pairs from {_PAIRS} p, r where source_register is null or source_register <> r.register group by r.register""")
def register_fanout(spark, d):
    rows = augment.fan_out(_pairs(spark, d).select("pair_id", "source_register"), F.col("source_register"))
    return rows.groupBy("register").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("n_pairs"))


@_query(rf"""with t as (select doc_id, posn as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as posn from documents where text is not null)),
u as (select doc_id, regexp_extract(line, '^(?:\[(\d{{1,2}}:\d{{2}}:\d{{2}})\]\s*)?([A-Z]\w{{0,7}}):\s+(.*)$', 2) as speaker from t where regexp_matches(line, '^(?:\[(\d{{1,2}}:\d{{2}}:\d{{2}})\]\s*)?([A-Z]\w{{0,7}}):\s+(.*)$'))
select speaker, count(*) as n_turns, count(distinct doc_id) as n_documents, regexp_matches(speaker, '^T\d*:?$') as is_teacher from u group by speaker""")
def transcript_turns(spark, d):
    rows = mining.turns(load(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("speaker").agg(F.count("*").alias("n_turns"), F.count_distinct("doc_id").alias("n_documents"), F.first(T.is_teacher("speaker")).alias("is_teacher"))


_SHEET = r"nullif(regexp_extract(transcript_ref, '^([^!#]+?)\s*[!#]', 1), '')"


@_query(rf"""with n as (select {_SHEET} as sheet, transcript_subtype from {_NEG} where transcript_ref is not null),
g as (select sheet, count(*) as n, count(*) filter (transcript_subtype = 'behavior_disapproving') as n_behavior, upper(regexp_extract(sheet, '([A-Za-z]+)\d*$', 1)) as suffix from n group by sheet)
select sheet, n, n_behavior, case suffix when 'LG' then 'Large Group' when 'SG' then 'Small Group' when 'C' then 'Centers' else 'Unknown' end as setting from g""")
def mined_by_sheet(spark, d):
    rows = _negatives(spark, d).where("transcript_ref is not null").select(T.sheet_of("transcript_ref").alias("sheet"), "transcript_subtype")
    by = rows.groupBy("sheet").agg(F.count("*").alias("n"), F.count_if(F.col("transcript_subtype") == "behavior_disapproving").alias("n_behavior"))
    return by.withColumn("setting", T.sheet_setting("sheet"))


@_query(f"""with v as (select list_distinct(list_transform(list(term), lambda t: lower(t))) as t from seed_words where tier = 'TIER2'), n as (select distinct neg_id, text from negatives)
select source_type, count(*) as n from {_NEG}, v where len(list_filter(v.t, lambda t: contains(lower(coalesce(text, '')), t))) = 0 group by source_type""")
def without_seed_tokens(spark, d):
    seeds = load(spark, d, "seed_words").where("tier = 'TIER2'")
    return mining.without_tokens(_negatives(spark, d), "text", seeds, "term").groupBy("source_type").agg(F.count("*").alias("n"))


@_query(f"""with a as (select pair_id as id, 'pair' as kind, {_ANCHOR} as anchor from {_PAIRS} p), b as (select neg_id, 'negative', anchor_utt_id from {_NEG} n),
c as (select * from a union all select * from b), t as (select utt_id, min(setting) as setting from corpus group by utt_id)
select kind, coalesce(t.setting, '<no anchor>') as anchor_setting, count(*) as n from c left join t on t.utt_id = c.anchor group by all""")
def union_views_with_anchor(spark, d):
    a = _pairs(spark, d).select(F.col("pair_id").alias("id"), F.lit("pair").alias("kind"), _anchor().alias("anchor"))
    b = _negatives(spark, d).select(F.col("neg_id").alias("id"), F.lit("negative").alias("kind"), F.col("anchor_utt_id").alias("anchor"))
    t = _corpus(spark, d).select(F.col("utt_id").alias("anchor"), "setting")
    rows = a.unionByName(b).join(t, "anchor", "left")
    return rows.groupBy("kind", F.coalesce("setting", F.lit("<no anchor>")).alias("anchor_setting")).agg(F.count("*").alias("n"))


@_query("""with r as (select utt_id as id from corpus union select neg_id from negatives union select pair_id from pairs), s as (select distinct id from splits)
select 'split' as part, count(*) as n from (select id from r intersect select id from s) union all select 'unsplit', count(*) from (select id from r except select id from s)
union all select 'unknown', count(*) from (select id from s except select id from r)""")
def id_set_operations(spark, d):
    r = _corpus(spark, d).select(F.col("utt_id").alias("id")).union(_negatives(spark, d).select("neg_id")).union(_pairs(spark, d).select("pair_id")).distinct()
    s = load(spark, d, "splits").select("id").distinct()
    part = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return part("split", r.intersect(s)).union(part("unsplit", r.subtract(s))).union(part("unknown", s.subtract(r)))


# ---------------------------------------------------------------- labelling

_RULE = f"""cues as (select utt_id, lower(trim(unnest(coalesce(tier2_cues, [])))) as token from c),
rule as (select utt_id, label from cues join {_TERM} using (token)
    union select utt_id, cat.label from cues left join term2 t using (token) join idx using (token) join {_CATEGORY} on cat.category = idx.category where t.token is null
    union select utt_id, 'observation' from cues left join term2 t using (token) left join idx using (token) where t.token is null and (idx.token is null or idx.category is null)
    union select utt_id, 'content' from c where len(coalesce(tier3_cues, [])) > 0)"""
_SCAN = f"""hits as (select c.utt_id, idx.* from c join idx on {_has('c.utterance', 'idx.token')}),
scan as (select utt_id, 'content' as label from hits where tier = 'TIER3' union select utt_id, t.label from hits join {_TERM.replace('as term(', 'as t(')} using (token) where tier is distinct from 'TIER3'
    union select utt_id, cat.label from hits left join term2 t using (token) join {_CATEGORY} on cat.category = hits.category where tier is distinct from 'TIER3' and t.token is null)"""
_BASE = f"with c as (select distinct utt_id, utterance, tier2_cues, tier3_cues from corpus), {_SEEDS}, term2 as (select * from {_TERM})"


@_query(f"{_BASE}, {_RULE} select utt_id, string_agg(label, '|' order by label) as labels from rule group by utt_id")
def cue_rule_subtypes(spark, d):
    index = labelling.seed_index(load(spark, d, "seed_words"))
    return labelling.cue_rules(_corpus(spark, d), "utt_id", "tier2_cues", "tier3_cues", index).select(F.col("id").alias("utt_id"), F.array_join("labels", "|").alias("labels"))


@_query(f"{_BASE}, {_SCAN} select utt_id, string_agg(label, '|' order by label) as labels from scan group by utt_id")
def keyword_scan_subtypes(spark, d):
    index = labelling.seed_index(load(spark, d, "seed_words"))
    return labelling.keyword_labels(_corpus(spark, d), "utt_id", "utterance", index).select(F.col("id").alias("utt_id"), F.array_join("labels", "|").alias("labels"))


@_query(f"""{_BASE}, {_RULE}, {_SCAN}, r as (select utt_id, list(label) as r from rule group by 1), k as (select utt_id, list(label) as k from scan group by 1),
b as (select utt_id, coalesce(r, []) as r, coalesce(k, []) as k from (select distinct utt_id from c) left join r using (utt_id) left join k using (utt_id))
select utt_id, case when len(r) + len(k) = 0 then 'observation' else array_to_string(list_sort(list_distinct(list_concat(r, k))), '|') end as subtype,
case when len(r) > 0 and len(list_filter(k, lambda x: not list_contains(r, x))) > 0 then 'rule+keyword' when len(r) > 0 then 'rule' when len(k) > 0 then 'keyword' else 'llm' end as subtype_source from b""")
def subtype_cascade(spark, d):
    index = labelling.seed_index(load(spark, d, "seed_words"))
    out = labelling.cascade(_corpus(spark, d), "utt_id", "utterance", "tier2_cues", "tier3_cues", index)
    return out.select(F.col("id").alias("utt_id"), F.array_join("subtype", "|").alias("subtype"), "subtype_source")


@_query("""with c as (select distinct utt_id, subtype from corpus), t as (select count(*) as n from c)
select label, count(*) as n, round(count(*) / max(t.n), 6) as share, count(*) / max(t.n) > 0.7 as dominant from (select unnest(subtype) as label from c), t group by label""")
def subtype_distribution(spark, d):
    return labelling.distribution(_corpus(spark, d), "subtype").withColumn("share", F.round("share", 6))


@_query("""with c as (select distinct utt_id, coalesce(subtype, []) as s from corpus) select count(*) as n, count(*) filter (len(s) = 0) as unlabelled,
count(*) filter (list_has_any(s, ['observation', 'prediction', 'causal_reasoning', 'evidence'])) as practice, count(*) filter (s = ['content']) as content_only,
count(*) filter (list_contains(s, 'not_science_shape')) as not_science from c""")
def subtype_coverage(spark, d):
    return labelling.coverage(_corpus(spark, d), "subtype")


# ---------------------------------------------------------------- scores and routing

_BAND = "case when {x} is null then 0.5 when {x} < {lo} then greatest(0.0, 1 - ({lo} - {x}) / 0.35) when {x} > {hi} then greatest(0.0, 1 - ({x} - {hi}) / 0.35) else 1.0 end"
_GEO = "exp((0.5 * ln(least(1.0, greatest(0.001, {a}))) + 0.8 * ln(least(1.0, greatest(0.001, {b}))) + 0.8 * ln(least(1.0, greatest(0.001, {c})))) / 2.1)"
_PCONF = _GEO.format(a="coalesce(llm_self_score, 0.5)", b=_BAND.format(x="preservation_pct", lo=0.55, hi=0.92), c="case when differs_from_anchor then 1.0 else 0.0 end")
_NCONF = "case when source_type in ('llm_hard_negative', 'seed_word_nonscience') then " + _GEO.format(a="coalesce(llm_gate_score, 0.5)", b="0.5", c="case when structural_check_passed then 1.0 else 0.0 end") + " end"
_ROUTE = "case when {x} >= 0.7 then 'auto' when {x} >= 0.15 then 'spot' when {x} is not null then 'review' end"


def _confidences(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select(F.col("pair_id").alias("id"), F.lit("pair").alias("kind"), S.pair_confidence(F.col("llm_self_score"), F.col("preservation_pct"), F.col("differs_from_anchor")).alias("confidence"))
    none = F.lit(None).cast("double")
    n = _negatives(spark, d).select(F.col("neg_id").alias("id"), F.lit("negative").alias("kind"), S.negative_confidence(F.col("source_type"), F.col("llm_gate_score"), none, F.col("structural_check_passed")).alias("confidence"))
    rows = p.unionByName(n).withColumn("confidence", F.round("confidence", 6))
    return rows.withColumn("routing", S.route(F.col("confidence")))


_CONF = f"""(select id, kind, confidence, {_ROUTE.format(x='confidence')} as routing from (
select pair_id as id, 'pair' as kind, round({_PCONF}, 6) as confidence from {_PAIRS} p union all select neg_id, 'negative', round({_NCONF}, 6) from {_NEG} n))"""


@_query(f"select * from {_CONF} x")
def confidence_and_routing(spark, d):
    return _confidences(spark, d)


@_query(f"select routing, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from {_CONF} x where routing is not null group by routing")
def routing_summary(spark, d):
    return metrics.shares(_confidences(spark, d), "routing").withColumn("share", F.round("share", 6))


@_query(f"""select neg_id, case when how = 'llm' and llm_gate_score is not null then case when llm_gate_score >= 0.9 then 'SCIENCE_TALK' else 'NOT_SCIENCE_TALK' end
else case when subtype_confidence >= 0.4 then 'SCIENCE_TALK' else 'NOT_SCIENCE_TALK' end end as predicted_label, case when how = 'llm' and llm_gate_score is not null then llm_gate_score else subtype_confidence end as score
from (select *, case when source_type = 'llm_hard_negative' then 'llm' else 'cosine' end as how from {_NEG} n)""")
def two_threshold_labels(spark, d):
    n = _negatives(spark, d).withColumn("by", F.when(F.col("source_type") == "llm_hard_negative", "llm").otherwise("cosine"))
    args = F.col("by"), F.col("llm_gate_score"), F.col("subtype_confidence")
    return n.select("neg_id", S.two_threshold_label(*args).alias("predicted_label"), S.two_threshold_score(*args).alias("score"))


# ---------------------------------------------------------------- splits, samples

_KEYED = "select distinct utt_id, coalesce(list_min(subtype), 'unknown') as stratify_key from corpus"


def _split_sql(rows: str, id_: str, seed: int) -> str:
    return f"""select id, stratify_key, case when k <= least(round_even(n * 0.8, 0), n - round_even(n * 0.1, 0)) then 'train' when k <= least(round_even(n * 0.8, 0), n - round_even(n * 0.1, 0)) + round_even(n * 0.1, 0) then 'val' else 'test' end as split
from (select {id_} as id, stratify_key, row_number() over (partition by stratify_key order by md5('{seed}|' || {id_})) as k, count(*) over (partition by stratify_key) as n from ({rows}))"""


_POS = _split_sql(_KEYED, "utt_id", 17)
_NEGS = _split_sql(f"select neg_id, source_type || '::' || coalesce(list_min(subtype), 'unknown') as stratify_key from {_NEG} n", "neg_id", 18)
_SPLITS = f"""with pos as ({_POS}), neg as ({_NEGS}), pr as (select pair_id as id, 'pair::' || register as stratify_key, {_ANCHOR} as anchor_id from {_PAIRS} p)
select id, 'positive' as kind, stratify_key, null::varchar as anchor_id, split from pos union all select id, 'negative', stratify_key, null, split from neg
union all select pr.id, 'pair', pr.stratify_key, pr.anchor_id, coalesce(pos.split, 'train') from pr left join pos on pos.id = pr.anchor_id"""


def _made_splits(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d).select(F.col("utt_id").alias("id"), A.first_subtype("subtype").alias("stratify_key"))
    neg = _negatives(spark, d).select(F.col("neg_id").alias("id"), F.concat_ws("::", "source_type", A.first_subtype("subtype")).alias("stratify_key"))
    pairs = _pairs(spark, d).select(F.col("pair_id").alias("id"), _anchor().alias("anchor_id"), F.concat(F.lit("pair::"), "register").alias("stratify_key"))
    return sampling.make_splits(corpus, neg, pairs)


@_query(_SPLITS)
def stratified_splits(spark, d):
    return _made_splits(spark, d)


@_query(f"select kind, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test from ({_SPLITS}) group by kind")
def split_crosstab(spark, d):
    return metrics.crosstab(_made_splits(spark, d), "kind", "split", ["train", "val", "test"])


@_query(f"""with a as (select distinct utt_id as id, setting from corpus), own as (select id from a where setting in {T.INFORMAL_SETTINGS!r}),
v as (select distinct {_ANCHOR} as id from {_PAIRS} p where register = 'INFORMAL'), o as (select id from a where setting not in {T.INFORMAL_SETTINGS!r} and id in (select id from v) order by md5('17|' || id) limit 30)
select id, 'informal_positive' as slice_reason from own union all select id, 'informal_variant_family' from o""")
def family_holdout_slice(spark, d):
    anchors = _corpus(spark, d).select(F.col("utt_id").alias("id"), "setting")
    variants = _pairs(spark, d).where("register = 'INFORMAL'").select(_anchor().alias("anchor_id"))
    return sampling.held_out_families(anchors, F.col("setting").isin(*T.INFORMAL_SETTINGS), variants)


@_query(f"""with r as (select neg_id, source_type, row_number() over (partition by source_type order by md5('42|' || neg_id)) as k, count(distinct source_type) over () as s from {_NEG} n)
select neg_id, source_type from r order by case when k <= greatest(1, floor(50 / greatest(1, s))) then 0 else 1 end, md5('42|' || neg_id) limit 50""")
def stratified_sample_topup(spark, d):
    return sampling.stratified_sample(_negatives(spark, d).select("neg_id", "source_type"), ["source_type"], "neg_id").select("neg_id", "source_type")


_QUEUE = f"""with x as (select * from {_CONF} x), sp as (select id, kind, routing, row_number() over (partition by kind order by md5('42|' || id)) as k, count(*) over (partition by kind) as n from x where routing = 'spot'),
q as (select id, kind, routing from x where routing = 'review' union all select id, kind, routing from sp where k <= greatest(1, round_even(n * 0.12, 0)))
select * from q where id not in (select id from review_decisions where id is not null)"""


@_query(_QUEUE)
def review_queue(spark, d):
    return review.queue(_confidences(spark, d).select("id", "kind", "routing"), load(spark, d, "review_decisions"))


# ---------------------------------------------------------------- review

_LATEST = """(select id, max_by({'kind': kind, 'decision': decision, 'corrected_text': corrected_text, 'reject_reason': reject_reason}, {'t': decided_at, 'a': kind, 'b': decision, 'c': coalesce(reviewer, ''), 'd': coalesce(corrected_text, ''), 'e': coalesce(reject_reason, '')}) as s from review_decisions group by id)"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "review_decisions")
    order = [F.coalesce(c, F.lit("")) for c in ("reviewer", "corrected_text", "reject_reason")]
    best = F.struct("decided_at", "kind", "decision", *order)
    return rows.groupBy("id").agg(F.max_by(F.struct("kind", "decision", "corrected_text", "reject_reason"), best).alias("s")).select("id", "s.*")


@_query(f"select id, s.kind as kind, s.decision as decision, s.corrected_text as corrected_text, s.reject_reason as reject_reason from {_LATEST} x")
def decision_upsert_last_wins(spark, d):
    return _decisions(spark, d)


@_query(f"""select pair_id, case when decision = 'edit' then corrected_text else variant_text end as text, coalesce(decision, 'none') as decision
from {_PAIRS} p join {_CONF} c on c.id = p.pair_id left join (select id, s.decision as decision, s.corrected_text as corrected_text from {_LATEST} x) l on l.id = p.pair_id
where decision in ('accept', 'edit') or (decision is null and (routing is null or routing = 'auto'))""")
def filter_verified(spark, d):
    routed = _confidences(spark, d).select(F.col("id").alias("pair_id"), "routing")
    rows = relate.updated(_pairs(spark, d).select("pair_id", "variant_text").join(routed, "pair_id"), _decisions(spark, d).withColumnRenamed("id", "pair_id"), "pair_id", ["decision", "corrected_text"])
    out = review.verified(rows, "variant_text")
    return out.select("pair_id", F.col("variant_text").alias("text"), F.coalesce("decision", F.lit("none")).alias("decision"))


@_query(f"""with x as (select kind, routing, id in (select id from review_decisions where id is not null) as done from {_CONF} x),
g as (select kind, count(*) filter (routing = 'review') as review_total, count(*) filter (routing = 'review' and done) as review_decided, count(*) filter (routing = 'spot') as spot_total, count(*) filter (routing = 'spot' and done) as spot_decided from x group by kind),
t as (select *, case when spot_total > 0 then greatest(1, round_even(spot_total * 0.12, 0))::bigint else 0 end as spot_target from g)
select *, review_total = review_decided and spot_decided >= spot_target as complete from t""")
def review_status(spark, d):
    return review.status(_confidences(spark, d), load(spark, d, "review_decisions"))


@_query(f"""with x as (select c.kind, c.routing, (l.decision = 'accept') = (c.routing = 'auto') as agree from {_CONF} c join (select id, s.decision as decision from {_LATEST} x) l using (id) where c.routing is not null)
select kind, routing, count(*) as n, round(avg(agree::int), 6) as agreement from x group by grouping sets ((), (kind), (routing))""")
def audit_agreement(spark, d):
    j = _confidences(spark, d).where("routing is not null").join(_decisions(spark, d).select("id", "decision"), "id")
    return metrics.agreement(j, (F.col("decision") == "accept") == (F.col("routing") == "auto")).withColumn("agreement", F.round("agreement", 6))


@_query("""with r as (select distinct id, kind, decision, decided_at from review_decisions) select cast(date_trunc('day', decided_at) as date) as day, kind, count(*) as n, count(*) filter (decision = 'reject') as n_rejected from r group by all""")
def decisions_by_day(spark, d):
    rows = load(spark, d, "review_decisions").select("id", "kind", "decision", "decided_at").distinct()
    return rows.groupBy(F.to_date("decided_at").alias("day"), "kind").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "reject").alias("n_rejected"))


# ---------------------------------------------------------------- metrics

_SCORED = f"(select neg_id as id, llm_gate_score as score, structural_check_passed as truth, source_type from {_NEG} n where llm_gate_score is not null)"


def _gate(spark: SparkSession, d: str) -> DataFrame:
    return _negatives(spark, d).where("llm_gate_score is not null").select(F.col("neg_id").alias("id"), F.col("llm_gate_score").alias("score"), F.col("structural_check_passed").alias("truth"), "source_type", "subtype_confidence")


@_query(f"""with c as (select source_type, count(*) filter (truth and score >= 0.5) as tp, count(*) filter (not truth and score >= 0.5) as fp, count(*) filter (truth and score < 0.5) as fn, count(*) filter (not truth and score < 0.5) as tn from {_SCORED} s group by source_type)
select *, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c""")
def confusion_metrics(spark, d):
    out = metrics.confusion(_gate(spark, d), F.col("truth"), F.col("score") >= 0.5, ["source_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@_query(f"""with r as (select truth, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as k from {_SCORED} s), t as (select count(*) filter (truth) as n_pos, count(*) filter (not truth) as n_neg, sum(k) filter (truth) as s from r)
select n_pos, n_neg, case when n_pos > 0 and n_neg > 0 then round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) end as auroc from t""")
def auroc_midrank(spark, d):
    return metrics.auroc(_gate(spark, d), F.col("truth"), F.col("score")).withColumn("auroc", F.round("auroc", 6))


@_query(f"""with r as (select rank() over (order by llm_gate_score) + (count(*) over (partition by llm_gate_score) - 1) / 2 as x, rank() over (order by subtype_confidence) + (count(*) over (partition by subtype_confidence) - 1) / 2 as y from {_NEG} n where llm_gate_score is not null and subtype_confidence is not null)
select count(*) as n, round(corr(x, y), 6) as spearman from r""")
def spearman_midrank(spark, d):
    return metrics.spearman(_gate(spark, d), "score", "subtype_confidence").withColumn("spearman", F.round("spearman", 6))


@_query(f"""with g as (select unnest([round(0.05 * k, 4)::double for k in range(1, 20)]) as t), d as (select t, count(*) filter (truth and score >= t) as tp, count(*) filter (not truth and score >= t) as fp, count(*) filter (truth) as pos from {_SCORED} s, g group by t),
s as (select t, count(*) filter (score >= t) / count(*) as slice_recall from {_SCORED} s, g where source_type = 'llm_hard_negative' group by t),
m as (select t as threshold, 2 * tp / (tp + fp + pos) as f1, tp / pos as recall, slice_recall from d join s using (t))
select threshold, round(f1, 6) as f1, round(recall, 6) as recall, round(slice_recall, 6) as slice_recall from m order by (slice_recall >= 0.8) desc, round(f1, 9) desc, round(recall, 9) desc, threshold limit 1""")
def threshold_tuning_floor(spark, d):
    rows = _gate(spark, d)
    out = metrics.tune_threshold(rows, rows.where("source_type = 'llm_hard_negative'"))
    return out.withColumns({c: F.round(c, 6) for c in ("f1", "recall", "slice_recall")})


@_query(f"select id, case when truth then 'false_negative' else 'false_positive' end as error, round(abs(score - 0.5), 6) as margin from {_SCORED} s where (score >= 0.5) <> truth order by margin desc, id limit 20")
def top_errors(spark, d):
    return metrics.largest_errors(_gate(spark, d), F.col("truth"), F.col("score"), 0.5, "id")


@_query(f"""select list_min(subtype) as subtype, count(*) as n, round(avg((llm_gate_score >= 0.5)::int), 6) as recall from {_NEG} n where llm_gate_score is not null and len(subtype) > 0 group by 1""")
def subtype_recall(spark, d):
    rows = _negatives(spark, d).where("llm_gate_score is not null and size(subtype) > 0").withColumn("s", A.first_subtype("subtype"))
    return rows.groupBy(F.col("s").alias("subtype")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("llm_gate_score") >= 0.5).cast("int")), 6).alias("recall"))


@_query(f"""with r as (select 'LARGE_GROUP' as g), p as (select {_ANCHOR} as anchor, * from {_PAIRS} p),
a as (select anchor, count(distinct case when register is distinct from source_register then register end) as registers, count(*) as n, sum(preservation_pct) as kept, count(*) filter (not differs_from_anchor) as leaks,
count(*) filter (register = 'LARGE_GROUP') as a, count(*) filter (register = 'SMALL_GROUP') as b, count(*) filter (register = 'INFORMAL') as c from p group by anchor)
select sum(n)::bigint as n_pairs, count(*) as n_anchors, count(*) filter (registers >= 2) as n_two_registers, round(sum(kept) / sum(n), 6) as mean_preservation, sum(leaks)::bigint as n_leaks, round(greatest(sum(a), sum(b), sum(c)) / sum(n), 6) as top_register_share from a""")
def pair_validation(spark, d):
    return augment.pair_checks(_pairs(spark, d).withColumn("anchor_id", _anchor()))


# ---------------------------------------------------------------- retrieval

_TOP = """with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), e as (select vec_id, label, embedding::double[] as v from embeddings),
s as (select q.vec_id as query_id, e.vec_id as id, round(list_inner_product(q.v, e.v), 6) as similarity from q, e where q.vec_id <> e.vec_id),
r as (select *, row_number() over (partition by query_id order by similarity desc, id)::int as rank from s)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bank = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return bank, bank.where("id % 20 = 0")


@_query(f"{_TOP} select query_id, id, similarity, rank from r where rank <= 20")
def retrieve_topk(spark, d):
    return retrieval.top_k(*_vectors(spark, d), 20)


@_query(f"{_TOP} select query_id, max(similarity) as score, min_by(id, rank) as best_id, count(*) as n_candidates, case when max(similarity) >= 0.5 then 'SCIENCE_TALK' else 'NOT_SCIENCE_TALK' end as label from r where rank <= 20 group by query_id")
def classify_max_cosine(spark, d):
    return retrieval.classified(retrieval.top_k(*_vectors(spark, d), 20), 0.5)


@_query(f"{_TOP} select query_id, round(avg(similarity), 6) as score, min_by(id, rank) as best_id, count(*) as n_candidates, case when round(avg(similarity), 6) >= 0.5 then 'SCIENCE_TALK' else 'NOT_SCIENCE_TALK' end as label from r where rank <= 20 group by query_id")
def classify_mean_agg(spark, d):
    return retrieval.classified(retrieval.top_k(*_vectors(spark, d), 20), 0.5, "mean")


@_query(f"""{_TOP}, m as (select r.query_id, r.rank, a.label = b.label as rel from r join embeddings a on a.vec_id = r.query_id join embeddings b on b.vec_id = r.id where rank <= 50),
p as (select query_id, min(rank) filter (rel) as f, count(*) filter (rel) as n, coalesce(sum(1 / log2(rank + 1)) filter (rel and rank <= 10), 0) as dcg from m group by query_id having count(*) filter (rel) > 0),
i as (select *, list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1 / log2(k + 1))) as ideal from p)
select count(*) as n_queries, round(avg((f = 1)::int), 6) as precision_at_1, round(avg(1 / f), 6) as mrr, round(avg(case when f <= 10 then 1 / f else 0 end), 6) as mrr_at_k, round(avg((f <= 10)::int), 6) as recall_at_k, round(avg(dcg / ideal), 6) as ndcg_at_k from i""")
def ranking_quality(spark, d):
    labels = load(spark, d, "embeddings").select("vec_id", "label")
    r = retrieval.top_k(*_vectors(spark, d), 50)
    q = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a"))
    c = labels.select(F.col("vec_id").alias("id"), F.col("label").alias("b"))
    out = metrics.ranking_metrics(r.join(q, "query_id").join(c, "id").select("query_id", "rank", (F.col("a") == F.col("b")).alias("relevant")), 10)
    return out.select("n_queries", *[F.round(c, 6).alias(c) for c in out.columns if c != "n_queries"])


@_query("""with b as (select vec_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), s as (select e.vec_id, b.vec_id as match_id, round(list_inner_product(e.embedding::double[], b.v), 6) as similarity from embeddings e, b)
select vec_id, min_by(match_id, (-similarity, match_id)) as match_id, max(similarity) as similarity from s group by vec_id""")
def best_anchor(spark, d):
    rows, bank = _vectors(spark, d)
    return retrieval.best_match(rows, bank).withColumnRenamed("id", "vec_id")


@_query("""select a.vec_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(b.embedding::double[], b.embedding::double[]))), 6) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def pairwise_cosine(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return e.join(n, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("w")), 6).alias("cosine"))


@_query(rf"""with t as (select pair_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(anchor_text, '')), '\s+'), lambda x: x <> '')) as a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(variant_text, '')), '\s+'), lambda x: x <> '')) as b from {_PAIRS} p),
u as (select pair_id, len(list_intersect(a, b)) as i, len(list_distinct(list_concat(a, b))) as n from t) select pair_id, case when n = 0 then 0.0 else round(i / n, 3) end as score from u""")
def jaccard_stub_score(spark, d):
    return _pairs(spark, d).select("pair_id", A.jaccard("anchor_text", "variant_text").alias("score"))


@_query(f"""with a as (select utt_id, row_number() over (order by md5('42|' || utt_id)) - 1 as slot, count(*) over () as n from (select distinct utt_id from corpus)),
g as (select neg_id, row_number() over (order by md5('42|' || neg_id)) - 1 as k from {_NEG} n) select neg_id, utt_id from g join a on a.slot = g.k % a.n""")
def round_robin_audit_pairs(spark, d):
    return sampling.round_robin(_negatives(spark, d).select("neg_id"), "neg_id", _corpus(spark, d).select("utt_id"), "utt_id").select("neg_id", "utt_id")


_TRIPLES = f"""with s as (select id, max(case lower({_st('split')}) when 'validation' then 'val' else lower({_st('split')}) end) as split from splits where split is not null group by id),
h as (select anchor_utt_id as anchor, text as hard_negative, row_number() over (partition by anchor_utt_id order by md5('17|' || neg_id)) as turn, count(*) over (partition by anchor_utt_id) as n
from {_NEG} n join s on s.id = n.neg_id where s.split = 'train' and source_type = 'llm_hard_negative'),
q as (select pair_id, {_ANCHOR} as anchor_id, variant_text as query, row_number() over (partition by {_ANCHOR} order by md5('17|' || pair_id)) as k from {_PAIRS} p join s on s.id = p.pair_id where s.split = 'train' and {_st("coalesce(variant_text, '')")} <> '')
select pair_id, anchor_id, query, c.utterance as positive, h.hard_negative from q join (select distinct utt_id, utterance from corpus) c on c.utt_id = q.anchor_id left join h on h.anchor = q.anchor_id and h.turn = (q.k - 1) % h.n + 1"""


@_query(_TRIPLES)
def hard_negative_triples(spark, d):
    s = F.lower(T.strip("split"))
    splits = load(spark, d, "splits").where("split is not null").groupBy("id").agg(F.max(F.when(s == "validation", "val").otherwise(s)).alias("split")).where("split = 'train'").select("id")
    hard = _negatives(spark, d).where("source_type = 'llm_hard_negative'").join(splits, F.col("neg_id") == F.col("id"), "left_semi")
    p = _pairs(spark, d).select("pair_id", _anchor().alias("anchor_id"), F.col("variant_text").alias("query")).join(splits, F.col("pair_id") == F.col("id"), "left_semi")
    p = p.where(F.coalesce(T.strip("query"), F.lit("")) != "")
    c = _corpus(spark, d).select(F.col("utt_id").alias("anchor_id"), F.col("utterance").alias("positive"))
    return evaluation.training_triples(p, c, hard.select("neg_id", F.col("anchor_utt_id").alias("anchor_id"), "text"))


# ---------------------------------------------------------------- responses, cache, budget, generators


@_query("""select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, case when try_cast(json_extract_string(props, '$.k') as double) is not null then least(1.0, greatest(0.0, try_cast(json_extract_string(props, '$.k') as double) / 100)) end as score from events""")
def parse_json_scores(spark, d):
    k = F.from_json("props", "k string")["k"].try_cast("double")
    return load(spark, d, "events").select("event_id", k.alias("k"), S.clamp01(k / 100).alias("score"))


@_query(r"""with x as (select distinct neg_id, regexp_extract(text, '(?:^|[^\w.])([01](?:\.\d+)?|0?\.\d+)(?:[^\w]|$)', 1) as s from negatives)
select neg_id, case when s <> '' then least(1.0, greatest(0.0, s::double)) end as gate from x""")
def parse_gate_numbers(spark, d):
    return _negatives(spark, d).select("neg_id", R.gate_response(F.col("text")).alias("gate"))


@_query("""select event_id, sha256('{"endpoint":"completion","model":"m","params":{"n":' || event_id || ',"t":"' || event_type || '"},"prompt_version":"v1"}') as cache_key from events""")
def cache_key_sha256(spark, d):
    key = R.cache_key(F.lit("v1"), F.lit("m"), F.lit("completion"), {"n": F.col("event_id"), "t": F.col("event_type")})
    return load(spark, d, "events").select("event_id", key.alias("cache_key"))


@_query("""with r as (select event_id, sha256(event_type || '|' || user_id) as key from events), c as (select distinct sha256(event_type || '|' || user_id) as key from events where event_type = 'view')
select count(distinct key) as n_misses, count(*) as n_requests from r where key not in (select key from c)""")
def cache_miss_anti(spark, d):
    e = load(spark, d, "events").select("event_type", F.sha2(F.concat_ws("|", "event_type", "user_id"), 256).alias("key"))
    misses = e.join(e.where("event_type = 'view'").select("key").distinct(), "key", "left_anti")
    return misses.agg(F.count_distinct("key").alias("n_misses"), F.count("*").alias("n_requests"))


@_query("""with s as (select event_id, value as s, 10 as c from events), r as (select *, coalesce(sum(c) over (order by s desc, event_id rows between unbounded preceding and 1 preceding), 0) as before from s)
select event_id, before + 10 <= 50000 as taken from r""")
def budgeted_running_sum(spark, d):
    out = budget.spend(load(spark, d, "events").select("event_id", "value"), F.col("value"), F.lit(10), "event_id", budget.max_calls(5.0, 0.0001))
    return out.select("event_id", "taken")


@_query("""with f as (select event_type as folder, round(sum(value) / 1000, 6) as spent from events group by 1), r as (select *, row_number() over (order by folder) as k, count(*) over () as n, coalesce(sum(spent) over (order by folder rows between unbounded preceding and 1 preceding), 0) as used from f)
select folder, round(least(15.0, k * 15.0 / n) - used, 6) as allowance, spent, round(least(15.0, k * 15.0 / n) - used - spent, 6) as "left" from r""")
def rolling_folder_budget(spark, d):
    f = load(spark, d, "events").groupBy(F.col("event_type").alias("folder")).agg(F.round(F.sum("value") / 1000, 6).alias("spent"))
    return budget.rolling_allowance(f, "folder", "spent", 15.0)


_EVERYDAY = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in augment.EVERYDAY) + "]"


@_query(f"""with c as (select distinct utt_id, utterance as u from corpus), g as (select unnest([1, 2]) as k)
select utt_id, k::int as n, ({_EVERYDAY})[(coalesce(list_sum(list_transform(list_filter(string_split(u, ''), lambda x: x <> ''), lambda x: unicode(x))), 0)::bigint + k - 1) % 15 + 1] as text from c, g where u is not null""")
def stub_negatives(spark, d):
    rows = _corpus(spark, d).select("utt_id", F.col("utterance").alias("u")).where("u is not null").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2))))
    return rows.select("utt_id", "n", augment.stub_negative(F.col("u"), F.col("n")).alias("text"))


_OPENER = "case r.register " + " ".join(f"when '{k}' then '{v}'" for k, v in augment.OPENERS.items()) + " end"


@_query(f"""with c as (select distinct utt_id, utterance, {_st('setting')} as s, list_distinct(list_concat(coalesce(tier2_cues, []), coalesce(tier3_cues, []))) as cues from corpus),
a as (select *, case s {" ".join(f"when '{k}' then '{v}'" for k, v in T.SETTING_REGISTER.items())} end as source_register from c), r as (select unnest({list(T.REGISTERS)!r}) as register),
v as (select a.*, r.register, list_filter(list_sort(cues), lambda x: not contains(lower(utterance), lower(x))) as lacking, {_OPENER} as opener from a, r where source_register is null or source_register <> r.register),
t as (select *, {_st("opener || ' ' || utterance || case when len(lacking) > 0 then ' (' || array_to_string(lacking, ', ') || ')' else '' end")} as variant_text from v),
k as (select *, case when len(cues) = 0 then 1.0 else len(list_filter(cues, lambda x: contains(lower(variant_text), lower(x)))) / len(cues) end as pct from t)
select utt_id as anchor_id, utterance as anchor_text, source_register, register, 1 as variant_no, variant_text, pct as preservation_pct, pct >= 0.8 as preservation_check_passed, true as differs_from_anchor
from k where {_plain('variant_text')} <> '' and {_plain('variant_text')} <> {_plain('utterance')}""")
def stub_variant_pairs(spark, d):
    """Generated variants of every anchor in its other registers."""
    return augment.variant_pairs(_corpus(spark, d), "utt_id", "utterance", "setting", "tier2_cues", "tier3_cues")


@_query()
def mapinpandas_encoder(spark, d):
    """A hashing encoder over the distinct utterances, joined back to all rows; the contract of a model encoder."""
    from ..operators.encoders import hashed_vectors

    rows = _corpus(spark, d).select("utt_id", "utterance")
    return retrieval.scored_once(rows, "utterance", lambda t: hashed_vectors(t, "_text", 16)).select("utt_id", "vector")


@_query(f"select distinct neg_id, {_nfkc('text')} as text, {_canon('text')} as canon from negatives")
def normalize_nfkc(spark, d):
    """NFKC and case-folded forms, by Arrow."""
    return _negatives(spark, d).select("neg_id", T.nfkc("text").alias("text"), T.casefolded("text").alias("canon"))


@_query()
def incremental_scoring_stream(spark, d):
    """The stream over the pairs table as a file source: each pair scored once, the budget spent in order of score."""
    from ..streaming import incremental
    from .runtime import fresh_path

    rows = _pairs(spark, d).select(F.col("pair_id").alias("id"), A.jaccard("anchor_text", "variant_text").alias("cosine_score"))
    source, out = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-out")
    rows.repartition(4).write.parquet(source)
    incremental.run(spark, source, "id string, cosine_score double", out, fresh_path(spark, "stream-at"), dollars=1.0, files_per_batch=2)
    return spark.read.parquet(out).select("id", "cosine_score", "scored_by", "score", "predicted_label")


# ---------------------------------------------------------------- query path, requests, bulk budget

_LLM = "case when (r.query_id + r.id) % 7 = 0 then null else round((r.similarity + 1) / 2 - (r.id % 5) / 10, 3) end"


@_query(f"""{_TOP}, c as (select r.*, {_LLM} as llm from r where rank <= 10 and query_id % 3 <> 0 union all select r.*, null from r where rank <= 10 and query_id % 3 = 0),
p as (select *, row_number() over (partition by query_id order by coalesce(llm, -1.0) desc, similarity desc, id) as position from c)
select query_id, coalesce(max(llm), max(similarity)) as score, case when max(llm) is null then case when max(similarity) >= 0.5 then 'SCIENCE_TALK' else 'NOT_SCIENCE_TALK' end when max(llm) >= 0.5 then 'SCIENCE_TALK' else 'NOT_SCIENCE_TALK' end as label,
max(llm) is null as degraded, min_by(id, position) as best_id, count(*) as n_candidates from p group by query_id""")
def classify_reranked(spark, d):
    """Re-ranked classification; a third of the queries gets no answers and falls back to the similarity."""
    c = retrieval.top_k(*_vectors(spark, d), 10)
    llm = F.when((F.col("query_id") % 3 == 0) | ((F.col("query_id") + F.col("id")) % 7 == 0), None).otherwise(F.round((F.col("similarity") + 1) / 2 - (F.col("id") % 5) / 10, 3))
    return pipeline.verdicts(retrieval.rerank_order(c.withColumn("llm_score", llm), "llm_score"), 0.5, 0.5)


@_query(f"""{_TOP}, c as (select r.*, {_LLM} as llm, a.label = b.label as rel from r join embeddings a on a.vec_id = r.query_id join embeddings b on b.vec_id = r.id where rank <= 20),
o as (select 'bi_encoder' as system, query_id, rank as k, rel from c union all select 'reranked', query_id, row_number() over (partition by query_id order by llm desc nulls last, id desc), rel from c),
p as (select system, query_id, min(k) filter (rel) as f, count(*) filter (rel) as n, coalesce(sum(1 / log2(k + 1)) filter (rel and k <= 10), 0) as dcg from o group by all having count(*) filter (rel) > 0),
i as (select *, list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1 / log2(k + 1))) as ideal from p)
select system, count(*) as n_queries, round(avg((f = 1)::int), 6) as precision_at_1, round(avg(case when f <= 10 then 1 / f else 0 end), 6) as mrr_at_k, round(avg(dcg / ideal), 6) as ndcg_at_k from i group by system""")
def rerank_diagnostic(spark, d):
    labels = load(spark, d, "embeddings").select("vec_id", "label")
    r = retrieval.top_k(*_vectors(spark, d), 20).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    llm = F.when((F.col("query_id") + F.col("id")) % 7 == 0, None).otherwise(F.round((F.col("similarity") + 1) / 2 - (F.col("id") % 5) / 10, 3))
    out = evaluation.rerank_comparison(r.withColumn("relevant", F.col("a") == F.col("b")), llm)
    return out.select("system", "n_queries", *[F.round(c, 6).alias(c) for c in ("precision_at_1", "mrr_at_k", "ndcg_at_k")])


@_query("""with r as (select event_type, event_type || '|' || user_id as key from events), k as (select distinct event_type || '|' || user_id as key from events where value < 50),
p as (select event_type, key, count(*) as n from r group by all)
select event_type, (sum(n) - count(*) filter (k.key is null))::bigint as hits, count(*) filter (k.key is null) as misses, sum(n)::bigint as total from p left join k using (key) group by event_type""")
def call_ledger(spark, d):
    e = load(spark, d, "events").withColumn("key", F.concat_ws("|", "event_type", "user_id"))
    return requests.ledger(e, "key", e.where("value < 50").select("key", F.lit("x").alias("response")), ["event_type"])


@_query("""with e as (select event_id, event_type as folder, value, user_id % 4 = 0 as cached from events),
d as (select folder, row_number() over (order by folder) as k, count(*) over () as n, m from (select folder, count(*) filter (not cached) as m from e group by folder)),
f as (select 1 as k, folder, m, n, floor(0.02 / n / 0.0001)::bigint as allowed from d where k = 1), x as (with recursive w as (
    select k, n, least(m, greatest(0, allowed) // 10) * 10 as spent, allowed, folder from f
    union all select d.k, d.n, w.spent + least(d.m, greatest(0, floor(least(0.02::decimal(18, 9), d.k * 0.02::decimal(18, 9) / d.n) / 0.0001)::bigint - w.spent) // 10) * 10, floor(least(0.02::decimal(18, 9), d.k * 0.02::decimal(18, 9) / d.n) / 0.0001)::bigint - w.spent, d.folder
    from w join d on d.k = w.k + 1) select folder, allowed from w),
b as (select e.*, coalesce(sum(case when cached then 0 else 10 end) over (partition by folder order by value desc, event_id rows between unbounded preceding and 1 preceding), 0) as before from e)
select event_id, b.folder, allowed, before + 10 <= allowed as taken from b join x using (folder)""")
def deploy_rolling_budget(spark, d):
    """Folder by folder: a cap of 200 calls, 10 a row, cached rows free, unused calls carried over."""
    e = load(spark, d, "events").select("event_id", F.col("event_type").alias("folder"), "value", (F.col("user_id") % 4 == 0).alias("cached"))
    return budget.spend_rolling(e, "folder", F.col("value"), F.col("cached"), "event_id", 10, 0.02, 0.0001).select("event_id", "folder", "allowed", "taken")


@_query(f"""select neg_id, 'How sure is it, from 0 to 1, that this sentence is no science talk? Answer with a number.' || chr(10) || 'Sentence: ' || coalesce(text, '') as gate,
'Write 2 classroom sentences that use the word ''' || coalesce(anchor_seed_term, '') || ''' in an everyday sense. It belongs to ' || coalesce(nullif(c.category, ''), 'none') || ': (no definition given). Answer as JSON with negatives.' as seed
from {_NEG} n left join (select lower(term) as term, max(category) as category from seed_words group by 1) c on c.term = lower(n.anchor_seed_term)""")
def prompt_texts(spark, d):
    seeds = load(spark, d, "seed_words").groupBy(F.lower("term").alias("term")).agg(F.max("category").alias("category"))
    n = _negatives(spark, d).withColumn("term", F.lower("anchor_seed_term")).join(seeds, "term", "left")
    return n.select("neg_id", prompts.gate_prompt("text").alias("gate"), prompts.seed_prompt("anchor_seed_term", "category", F.lit(None).cast("string"), 2).alias("seed"))


@_query(f"""with s as (select distinct utt_id, coalesce(nullif(array_to_string(list_sort(list_distinct(coalesce(subtype, []))), ', '), ''), 'none') as kinds, utterance, setting,
coalesce(nullif(array_to_string(list_sort(list_distinct(list_concat(coalesce(tier2_cues, []), coalesce(tier3_cues, [])))), ', '), ''), 'none') as cues from corpus)
select utt_id, 'Write 2 everyday classroom sentences that sound like the following one but are no science talk. Its kinds: ' || kinds || '. Answer as JSON with negatives.' || chr(10) || 'Sentence: ' || coalesce(utterance, '') as hard,
'Say this 1 times in the register INFORMAL instead of ' || coalesce(nullif(setting, ''), 'unknown') || '. Keep these words: ' || cues || '. Kinds: ' || kinds || '. Answer as JSON with variants of text and self_score.' || chr(10) || 'Sentence: ' || coalesce(utterance, '') as variant from s""")
def generation_prompts(spark, d):
    c = _corpus(spark, d)
    return c.select("utt_id", prompts.hard_negative_prompt("utterance", "subtype", 2).alias("hard"), prompts.register_prompt("utterance", F.lit("INFORMAL"), "setting", "subtype", "tier2_cues", "tier3_cues", 1).alias("variant"))


# ---------------------------------------------------------------- evaluation inputs, audits, checks

_S = f"(select distinct id, kind, case lower({_st('split')}) when 'validation' then 'val' else lower({_st('split')}) end as split from splits where split is not null)"
_C = "(select distinct utt_id, utterance, setting, source, transcript_ref, subtype from corpus)"
_PA = f"(select pair_id, {_ANCHOR} as anchor_id, variant_text, register from {_PAIRS} p)"


def _splits(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(T.strip("split"))
    return load(spark, d, "splits").where("split is not null").select("id", "kind", F.when(s == "validation", "val").otherwise(s).alias("split"))


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("pair_id", _anchor().alias("anchor_id"), "variant_text", "register")


@_query(f"""with s as {_S}, p as (select pair_id as id, variant_text as phrase, anchor_id as gold_anchor from {_PA} x where variant_text is not null and pair_id in (select id from s where kind = 'pair' and split = 'test') order by md5('42|' || pair_id), pair_id limit 200),
n as (select neg_id as id, text as phrase from {_NEG} x where neg_id in (select id from s where kind = 'negative' and split = 'test') order by md5('42|' || neg_id), neg_id limit 100)
select id, phrase, 1 as label, gold_anchor, coalesce(nullif(array_to_string(list_sort(coalesce(c.subtype, [])), '|'), ''), 'unknown') as subtype from p left join {_C} c on c.utt_id = p.gold_anchor
union all select id, phrase, 0, null, 'negative' from n""")
def split_queries(spark, d):
    return evaluation.split_queries(_corpus(spark, d), _anchored(spark, d), _negatives(spark, d), _splits(spark, d), "test", 200, 100)


@_query(f"""with s as {_S}, q as (select pair_id, variant_text, anchor_id from {_PA} x where variant_text is not null and pair_id in (select id from s where kind = 'pair' and split = 'val') and anchor_id in (select utt_id from corpus)),
n as (select neg_id, text from {_NEG} x where neg_id in (select id from s where kind = 'negative' and split = 'val') order by md5('17|' || neg_id), neg_id limit 1000)
select 'query' as role, pair_id as id, variant_text as text, anchor_id as relevant from q union all select 'anchor', utt_id, utterance, null from {_C} c union all select 'distractor', neg_id, text, null from n""")
def retrieval_inputs(spark, d):
    return evaluation.retrieval_inputs(_corpus(spark, d), _anchored(spark, d), _negatives(spark, d), _splits(spark, d))


@_query(f"""with s as {_S}, pos as (select pair_id as id, c.utterance as query, variant_text as candidate, anchor_id from {_PA} x join {_C} c on c.utt_id = x.anchor_id where c.utterance <> '' and variant_text is not null and pair_id in (select id from s where kind = 'pair' and split = 'val')),
a as (select query, row_number() over (order by md5('42|' || id)) - 1 as slot, count(*) over () as n from pos),
neg as (select neg_id, text, row_number() over (order by md5('42|' || neg_id)) - 1 as k from (select neg_id, text from {_NEG} x where neg_id in (select id from s where kind = 'negative' and split = 'val') order by md5('42|' || neg_id), neg_id limit 50))
select * from (select id, query, candidate, 1 as label, anchor_id from pos order by md5('42|' || id), id limit 50) union all select neg_id, a.query, text, 0, null from neg join a on a.slot = neg.k % a.n""")
def pair_audit(spark, d):
    return evaluation.pair_audit(_corpus(spark, d), _anchored(spark, d), _negatives(spark, d), _splits(spark, d))


_HELD = f"""a as (select distinct utt_id as id, setting from corpus), own as (select id from a where setting in {T.INFORMAL_SETTINGS!r}),
o as (select id from a where setting not in {T.INFORMAL_SETTINGS!r} and id in (select {_ANCHOR} from {_PAIRS} p where register = 'INFORMAL') order by md5('17|' || id) limit 30),
held as (select id, 'informal_positive' as slice_reason from own union all select id, 'informal_variant_family' from o),
fam as (select held.id, 'positive' as kind, c.utterance as text, held.id as anchor_id, null::varchar as register, slice_reason from held join {_C} c on c.utt_id = held.id
union all select pair_id, 'pair', variant_text, anchor_id, register, slice_reason from {_PA} x join held on held.id = x.anchor_id)"""


def _held(spark: SparkSession, d: str) -> DataFrame:
    held = family_holdout_slice(spark, d)
    return evaluation.slice_families(_corpus(spark, d), _anchored(spark, d), held)


@_query(f"with {_HELD} select slice_reason, kind, coalesce(register, case when kind is not null then '(none)' end) as register, count(*) as n from (select slice_reason, kind, coalesce(register, '(none)') as register from fam) group by grouping sets ((slice_reason), (slice_reason, kind, register))")
def slice_summary(spark, d):
    return evaluation.slice_summary(_held(spark, d))


@_query(f"""with {_HELD} select id, text as phrase, 1 as label, anchor_id as gold_anchor, coalesce(nullif(array_to_string(list_sort(coalesce(c.subtype, [])), '|'), ''), 'unknown') as subtype from fam join {_C} c on c.utt_id = fam.anchor_id order by md5('42|' || id), id limit 100""")
def slice_queries(spark, d):
    subtypes = _corpus(spark, d).select(F.col("utt_id").alias("anchor_id"), "subtype")
    return evaluation.slice_queries(_held(spark, d).join(subtypes, "anchor_id"), 100)


@_query(f"""with x as (select 'gate' as system, llm_gate_score as score, structural_check_passed::int as label from {_NEG} n where llm_gate_score is not null union all select 'subtype', subtype_confidence, structural_check_passed::int from {_NEG} n where subtype_confidence is not null),
c as (select system, case system when 'gate' then 0.5 else 0.8 end as threshold, score, label from x), g as (select system, threshold, count(*) as n, count(*) filter (label = 1 and score >= threshold) as tp, count(*) filter (label <> 1 and score >= threshold) as fp, count(*) filter (label = 1 and score < threshold) as fn from c group by all)
select system, threshold::double as threshold, n, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1 from g""")
def system_summary(spark, d):
    n = _negatives(spark, d).withColumn("label", F.col("structural_check_passed").cast("int"))
    rows = n.where("llm_gate_score is not null").select(F.lit("gate").alias("system"), F.col("llm_gate_score").alias("score"), "label").unionByName(n.where("subtype_confidence is not null").select(F.lit("subtype").alias("system"), F.col("subtype_confidence").alias("score"), "label"))
    return evaluation.system_summary(rows, spark.createDataFrame([("gate", 0.5), ("subtype", 0.8)], "system string, threshold double"))


@_query(f"""with n as (select * from {_NEG} x), k as (select count(*) as n, count(distinct neg_id) as ids, count(*) filter (text is null) as untexted, 3 - count(distinct source_type) filter (source_type in ('llm_hard_negative', 'seed_word_nonscience', 'transcript_clean')) as gone from n),
t as (select count(*) as missing from (select unnest(['observation', 'prediction', 'causal_reasoning', 'evidence', 'content']) as label) where label not in (select unnest(subtype) from n)), p as (select count(distinct utt_id) as n from corpus)
select 'rows' as "check", k.n as value, k.n >= 3 * p.n as ok from k, p union all select 'repeated_ids', n - ids, n = ids from k union all select 'missing_texts', untexted, untexted = 0 from k
union all select 'missing_sources', gone, gone = 0 from k union all select 'missing_subtypes', missing, missing = 0 from t""")
def negative_checks(spark, d):
    n = _corpus(spark, d).count()
    return evaluation.negative_checks(_negatives(spark, d), n, A.SUBTYPES[:5], ("llm_hard_negative", "seed_word_nonscience", "transcript_clean"))


@_query(f"select utt_id, utterance, setting, source, transcript_ref, array_to_string(subtype, ', ') as current_subtype, null::varchar as decision, null::varchar as corrected_text, null::varchar as notes from {_C} c where list_contains(subtype, 'not_science_shape')")
def not_science_review(spark, d):
    return review.not_science(_corpus(spark, d))


@_query(f"""with t as (select neg_id, {_canon('text')} as c from {_NEG} n), k as (select c, count(*) as n from t group by c), new as (select count(*) as n from k where c <> '' and c not in (select {_canon('utterance')} from corpus))
select sum(k.n)::bigint as n_raw, coalesce(sum(k.n) filter (c <> ''), 0)::bigint as n_text, count(*) filter (c <> '') as n_distinct, count(*) filter (c <> '') - max(new.n) as n_known, max(new.n) as n_new from k, new""")
def mined_totals(spark, d):
    return evaluation.mined_totals(_negatives(spark, d), T.canon("text"), _corpus(spark, d), T.canon("utterance"))


@_query(f"""with r as (select id, kind, routing, confidence, row_number() over (partition by kind, routing order by md5('42|' || id)) as k, count(distinct (kind, routing)) over () as s from {_CONF} x where routing is not null),
d as (select * from r order by case when k <= greatest(1, floor(50 / greatest(1, s))) then 0 else 1 end, md5('42|' || id) limit 50),
v as (select pair_id as id, 'pair' as kind, {_ANCHOR} as anchor_id, null as seed from {_PAIRS} p union all select neg_id, 'negative', anchor_utt_id, anchor_seed_term from {_NEG} n)
select d.id, d.kind, routing, confidence, coalesce(c.utterance, v.seed, '<no anchor>') as anchor_text from d join v using (id, kind) left join {_C} c on c.utt_id = v.anchor_id""")
def routing_audit_sample(spark, d):
    p = _pairs(spark, d).select(F.col("pair_id").alias("id"), F.lit("pair").alias("kind"), F.col("variant_text").alias("text"), _anchor().alias("anchor_id"), F.lit(None).cast("string").alias("seed_term"))
    n = _negatives(spark, d).select(F.col("neg_id").alias("id"), F.lit("negative").alias("kind"), "text", F.col("anchor_utt_id").alias("anchor_id"), F.col("anchor_seed_term").alias("seed_term"))
    rows = p.unionByName(n).join(_confidences(spark, d), ["id", "kind"])
    return review.routing_sample(rows, _corpus(spark, d)).select("id", "kind", "routing", "confidence", "anchor_text")


@_query(f"""with x as (select c.routing, case l.decision when 'accept' then 'auto' when 'edit' then 'spot' else 'review' end as human_routing from {_CONF} c join (select id, s.decision as decision from {_LATEST} x) l using (id) where c.routing is not null)
select routing, human_routing, count(*) as n from x group by all""")
def routing_disagreements(spark, d):
    j = _confidences(spark, d).join(_decisions(spark, d).select("id", "decision"), "id")
    human = F.when(F.col("decision") == "accept", "auto").when(F.col("decision") == "edit", "spot").otherwise("review")
    return review.disagreements(j.withColumn("human_routing", human))


@_query(f"""select source_type, median(subtype_confidence) as median_confidence, avg(subtype_confidence) as mean_confidence, count(distinct transcript_ref) as n_refs from {_NEG} n group by source_type""")
def confidence_summary(spark, d):
    return _negatives(spark, d).groupBy("source_type").agg(F.median("subtype_confidence").alias("median_confidence"), F.avg("subtype_confidence").alias("mean_confidence"), F.count_distinct("transcript_ref").alias("n_refs"))
