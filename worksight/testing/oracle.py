"""SQL answers for the oracle, composed from named common table expressions.

Written independently of the operators: pairs by direct comparison, evidence
by outer joins, ranks by one global window.  Weights, labels and alert words
are stated here again, so a wrong one in an operator shows; column names, the
sentences of the reasons and the stop words are shared with the operators.
"""

import re

import numpy as np

from .. import constants as K
from ..operators.alerts import ALERT_COLUMNS, DETAIL_COLUMNS, HIGH_RISK_COLUMNS
from ..operators.explain import TEXT
from .bindings import AS_OF, VIEWS

FLAGS = list(K.FLAG_COLUMN.values())
SCORES = list(K.SCORE_COLUMN.values())


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def num(x: float) -> str:
    return f"{x!r}e0"


def pts(*rules: tuple[str, int]) -> str:
    total = " + ".join(f"case when {cond} then {p} else 0 end" for cond, p in rules)
    return f"cast(least({total}, 100) as double)"


def even(x: str, digits: int) -> str:
    return f"(round_even(({x}) * {10 ** digits}e0, 0) / {10 ** digits}e0)"


def pct(part: str, whole: str) -> str:
    return "coalesce(" + even(f"cast({part} as double) / nullif(cast({whole} as double), 0) * 1e2", 1) + ", 0e0)"


def either(*conds: str) -> str:
    return " or ".join(f"coalesce({c}, false)" for c in conds)


def ladder(steps, default: str) -> str:
    return "case " + " ".join(f"when overall_risk_score >= {b} then {text(v)}" for b, v in steps) + f" else {default} end"


# --- rules -------------------------------------------------------------------

FIN = ["utilized_amount > sanctioned_amount", "released_amount > sanctioned_amount", "utilization_percentage > 95",
       "progress_mismatch_abs > 30", "utilized_amount <= 0 and completion_percentage > 0",
       "(sanctioned_amount = 0 and released_amount > 0) or released_amount / nullif(sanctioned_amount, 0) >= 0.99e0"]
LATE = "lower(coalesce(status, '')) = 'delayed'"
PROG = ["progress_mismatch > 20", "progress_mismatch > 40", "progress_mismatch_abs > 50",
        "utilization_percentage > 80 and completion_percentage < 50"]
STOP = ", ".join(text(w) for w in K.ENGLISH_STOP_WORDS)


def words_of(expr: str) -> str:
    return (rf"list_filter(regexp_extract_all(lower({expr}), '[\p{{L}}\p{{N}}_]{{2,}}'), "
            f"lambda w: w not in ({STOP}))")


TERM_LIST = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"


def vectors(prefix: str, source: str) -> dict[str, str]:
    """TF-IDF vectors of ``source(id, copies, words)``."""
    return {
        f"{prefix}_tf": f"select id, term, count(*) as tf, any_value(copies) as copies from "
                        f"(select id, copies, unnest({TERM_LIST}) as term from {source}) t group by id, term",
        f"{prefix}_df": f"select term, cast(sum(copies) as bigint) as df from {prefix}_tf group by term",
        f"{prefix}_raw": f"select id, a.term, tf, df, tf * (ln((1e0 + (select sum(copies) from {source}_all)) / "
                         f"(1e0 + df)) + 1e0) as raw from {prefix}_tf a join {prefix}_df b on a.term = b.term",
        f"{prefix}_vec": f"select id, term, tf, df, raw / sqrt(sum(raw * raw) over (partition by id)) as w "
                         f"from {prefix}_raw",
        f"{prefix}_sim": f"select a.id as id_1, b.id as id_2, sum(a.w * b.w) as s from {prefix}_vec a "
                         f"join {prefix}_vec b on a.term = b.term and a.id < b.id group by 1, 2 "
                         f"having sum(a.w * b.w) >= 0.55e0",
    }


HAVERSINE = ("2e0 * 6371e0 * asin(sqrt(least(greatest(pow(sin((radians(a.latitude) - radians(b.latitude)) / 2), 2) + "
             "cos(radians(a.latitude)) * cos(radians(b.latitude)) * "
             "pow(sin((radians(a.longitude) - radians(b.longitude)) / 2), 2), 0e0), 1e0)))")

CTES = dict(VIEWS)
CTES.update({
    "features": f"""
select *, progress_raw as progress_mismatch, abs(progress_raw) as progress_mismatch_abs,
       end_date - start_date as actual_duration_days, greatest(end_date - expected_completion_date, 0) as delay_days
from (select *, utilized_amount / nullif(sanctioned_amount, 0) * 1e2 as utilization_percentage,
             financial_progress_ratio * 1e2 as financial_progress_percentage,
             financial_progress_ratio * 1e2 - completion_percentage as progress_raw,
             expected_completion_date - start_date as planned_duration_days,
             coalesce(actual_completion_date, date '{AS_OF}') as end_date,
             actual_completion_date is null as missing_actual_completion
      from projects) t""",
    "rules": f"""
select *, {either(FIN[0], FIN[1], FIN[3], FIN[4], FIN[5])} as financial_anomaly,
       {pts(*zip(FIN, (40, 30, 15, 25, 20, 40)))} as financial_risk_score,
       {LATE} as delay_anomaly,
       {pts((LATE, 60), (f"{LATE} and delay_days > 90", 15), (f"{LATE} and delay_days > 180", 15),
            (f"{LATE} and actual_duration_days > planned_duration_days * 1.5e0", 10))} as delay_risk_score,
       {either(PROG[0], PROG[2], PROG[3])} as progress_anomaly,
       {pts(*zip(PROG, (40, 25, 20, 30)))} as progress_risk_score
from features""",
    "contractor_agg": f"""
select trim(coalesce(contractor, 'Unknown')) as contractor, count(project_id) as total_projects,
       avg(completion_percentage) as average_completion, avg(delay_days) as average_delay_days,
       coalesce(sum(utilized_amount), 0) as total_utilized_amount,
       count(*) filter ({LATE}) as delayed_projects,
       count(*) filter (progress_mismatch_abs > 30) as progress_mismatch_projects
from features group by 1""",
    "history": f"""
select *, case when contractor_risk_score >= 70 then 'HIGH' when contractor_risk_score >= 40 then 'MEDIUM'
          else 'LOW' end as risk_level
from (select *, {pts(("delayed_projects >= 2", 30), ("delayed_projects >= 5", 20),
                     ("progress_mismatch_projects >= 2", 25), ("progress_mismatch_projects >= 5", 15),
                     ("average_completion < 50", 20))} as contractor_risk_score from contractor_agg) t""",
    "contractor_map": """
select project_id, coalesce(contractor_risk_score, 0e0) as contractor_risk_score,
       coalesce(contractor_risk_score, 0e0) >= 70 as contractor_anomaly
from projects p left join history h on trim(coalesce(p.contractor, 'Unknown')) = h.contractor""",
    "document_rows": f"""
select *, amount_mismatch or contractor_mismatch or location_mismatch or missing_document as document_anomaly,
       {pts(("amount_mismatch", 40), ("contractor_mismatch", 30), ("location_mismatch", 20),
            ("missing_document", 30))} as document_risk_score
from (select p.project_id, d.document_id, d.document_id is not null as document_exists,
             coalesce(d.document_id is not null and abs(d.amount - p.utilized_amount) > 1, false) as amount_mismatch,
             d.document_id is not null and lower(trim(coalesce(p.contractor, '')))
               <> lower(trim(coalesce(d.contractor, ''))) as contractor_mismatch,
             coalesce(d.document_id is not null and trim(p.district) <> '' and trim(d.location) <> ''
               and not contains(lower(trim(d.location)), lower(trim(p.district))), false) as location_mismatch,
             d.document_id is null as missing_document
      from projects p left join evidence_documents d on d.project_id = p.project_id) t""",
    "hash_uses": "select image_hash, count(*) as uses from evidence_images where image_hash <> '' group by 1 "
                 "having count(*) > 1",
    "image_rows": f"""
select *, missing_image or reused_image or high_similarity or potentially_reused as image_anomaly,
       {pts(("missing_image", 30), ("reused_image", 50), ("high_similarity", 30),
            ("potentially_reused", 20))} as image_risk_score
from (select p.project_id, i.image_id, i.image_id is not null as image_exists,
             coalesce(i.similarity_score, 0) as similarity_score, i.image_id is null as missing_image,
             h.uses is not null as reused_image, coalesce(i.similarity_score, 0) >= 0.9e0 as high_similarity,
             contains(lower(trim(coalesce(i.status, ''))), 'reused') as potentially_reused
      from projects p left join evidence_images i on i.project_id = p.project_id
      left join hash_uses h on h.image_hash = i.image_hash) t""",
    "inspection_rows": f"""
select *, missing_inspection or failed_inspection or needs_improvement or low_inspection_score as inspection_anomaly,
       {pts(("missing_inspection", 30), ("failed_inspection", 50), ("needs_improvement", 25),
            ("low_inspection_score", 30))} as inspection_risk_score
from (select p.project_id, i.inspection_id, i.inspection_score, i.inspection_id is not null as inspection_exists,
             i.inspection_id is null as missing_inspection,
             lower(coalesce(i.inspection_status, '')) = 'failed' as failed_inspection,
             lower(coalesce(i.inspection_status, '')) = 'needs improvement' as needs_improvement,
             coalesce(i.inspection_score < 50, false) as low_inspection_score
      from projects p left join inspections i on i.project_id = p.project_id) t""",
})
for kind, names, more in (
        ("document", ["amount_mismatch", "contractor_mismatch", "location_mismatch", "missing_document"], ""),
        ("image", ["missing_image", "reused_image", "high_similarity", "potentially_reused"],
         ", max(similarity_score) as similarity_score"),
        ("inspection", ["missing_inspection", "failed_inspection", "needs_improvement", "low_inspection_score"],
         ", min(inspection_score) as inspection_score")):
    flags = ", ".join(f"bool_or({n}) as {n}" for n in [*names, f"{kind}_anomaly"])
    CTES[f"{kind}_best"] = (f"select project_id, {flags}, max({kind}_risk_score) as {kind}_risk_score{more} "
                            f"from {kind}_rows group by project_id")

CTES.update({
    "located": "select project_id, project_name, latitude, longitude from projects "
               "where latitude is not null and longitude is not null",
    # 0.3 km are 0.0027 degrees of latitude
    "near": f"""
select a.project_id as id_1, a.project_name as name_1, b.project_id as id_2, b.project_name as name_2, {HAVERSINE} as km
from located a join located b on b.latitude between a.latitude - 0.0028e0 and a.latitude + 0.0028e0
 and a.project_id < b.project_id where {HAVERSINE} <= 0.3e0""",
    "geo_stats": f"select id, min({even('km', 3)}) as nearest, count(*) as n from "
                 "(select id_1 as id, km from near union all select id_2, km from near) t group by id",
    "geo_best": f"""
select p.project_id, g.n is not null as geo_anomaly,
       case when g.n is null then 0e0 else
         {even("least(greatest((0.3e0 - nearest) / 0.3e0, 0e0) * 70 + least(n, 3) * 10, 1e2)", 2)} end
         as geo_risk_score, coalesce(g.n, 0) as geo_overlap_count, nearest as geo_nearest_km
from projects p left join geo_stats g on g.id = p.project_id""",
    "name_words": f"select project_id, {words_of("project_name || ' ' || project_type")} as words from projects",
    "name_texts_all": "select array_to_string(words, ' ') as id, any_value(words) as words, count(*) as copies "
                      "from name_words group by 1",
    "name_texts": "select * from name_texts_all where len(words) > 0",
    **vectors("name", "name_texts"),
    "name_best": f"""
select id, max({even('s', 3)}) as best from (
  select id_1 as id, s from name_sim union all select id_2, s from name_sim
  union all select id, 1e0 from name_texts where copies > 1) t group by id""",
    "dup_best": f"""
select project_id, coalesce(best, 0e0) > 0 as duplicate_anomaly,
       {even("least(coalesce(best, 0e0) * 100, 1e2)", 2)} as duplicate_risk_score,
       coalesce(best, 0e0) as duplicate_match_score
from name_words w left join name_best b on b.id = array_to_string(w.words, ' ')""",
    "doc_texts_all": f"select doc_id as id, 1 as copies, {words_of("text || ' ' || lang")} as words from documents",
    "doc_texts": "select * from doc_texts_all where len(words) > 0",
    **vectors("doc", "doc_texts"),
    "text_group": "select id, md5(array_to_string(words, ' ')) as g, words from doc_texts",
    "text_size": "select g, count(*) as copies, min(id) as first_id from text_group group by g",
    "counts": "select project_id, count(*) as citizen_report_count from citizen_reports group by 1",
    "citizen_best": "select project_id, citizen_report_count, cast(least(citizen_report_count * 25, 100) as double) "
                    "as citizen_risk_score, citizen_report_count > 0 as citizen_anomaly from counts",
    "checked": f"""
select s.*, case when p.project_id is null then 'project not found'
                 when category not in ({", ".join(text(x) for x in K.REPORT_CATEGORIES)}) then 'invalid category'
                 when description = '' then 'description required' end as reject_reason
from (select report_id, submitted_at, trim(project_id) as project_id, trim(upper(category)) as category,
             trim(description) as description from submissions) s left join projects p using (project_id)""",
})

CTES.update({
    "stream_best": "select project_id, count(*) as citizen_report_count, cast(least(count(*) * 25, 100) as double) "
                   "as citizen_risk_score, true as citizen_anomaly from checked where reject_reason is null group by project_id",
    "projects_zero": "select * replace (case when cast(substr(project_id, 2) as bigint) % 9 = 0 then 0e0 else sanctioned_amount "
                     "end as sanctioned_amount) from projects",
    "features_zero": CTES["features"].replace("from projects", "from projects_zero"),
    "rules_zero": CTES["rules"].replace("from features", "from features_zero"),
})

# --- isolation forest: 200 trees of at most 256 rows, eight levels, all drawn from MD5 ---

FOREST_TREES, FOREST_ROWS, FOREST_DEPTH, FOREST_SEED = 200, 256, 8, 42


def share_of(*parts: str) -> str:
    words = " || ' ' || ".join(f"({p})::varchar" for p in parts)
    return f"(('0x' || substr(md5({words}), 1, 13))::bigint / 4503599627370496e0)"


def expected_path(n: str) -> str:
    return (f"case when {n} > 2 then 2e0 * (ln({n} - 1e0) + {np.euler_gamma!r}e0) - 2e0 * ({n} - 1) / {n} "
            f"when {n} = 2 then 1e0 else 0e0 end")


def forest() -> dict[str, str]:
    features = list(K.OUTLIER_FEATURES)
    medians = {x: f"coalesce(cast({x} as double), (select median(cast({x} as double)) from features))" for x in features}
    slots = f"greatest(1, (select count(*) from features) // {2 * FOREST_ROWS})"
    out = {
        "forest_input": f"select project_id, row_number() over (order by project_id) as i, "
                        f"[{', '.join(medians.values())}] as x from features",
        "forest_dealt": f"select *, cast(round * {slots} + floor(share * {slots}) as bigint) as tree from "
                        f"(select *, {share_of(str(FOREST_SEED), text('row'), 'round', 'project_id')} as share from forest_input, "
                        f"(select unnest(range(cast(ceil({FOREST_TREES} / {slots}) as bigint))) as round) r) t",
        "forest_level_0": f"select tree, x, 1::bigint as node from forest_dealt where tree < {FOREST_TREES} qualify "
                          f"row_number() over (partition by tree order by share, project_id) <= {FOREST_ROWS}",
    }
    inside = ", ".join(f"{{'f': {i + 1}, 'low': min(x[{i + 1}]), 'high': max(x[{i + 1}])}}" for i in range(len(features)))
    for d in range(FOREST_DEPTH):
        out[f"forest_split_{d}"] = f"""
select tree, node, f, case when point < high then point else low end as cut from (
select tree, node, pick.f as f, pick.low as low, pick.high as high,
       pick.low + {share_of(str(FOREST_SEED), text('split'), 'tree', 'node')} * (pick.high - pick.low) as point
from (select tree, node, open[1 + cast(floor({share_of(str(FOREST_SEED), text('feature'), 'tree', 'node')} * len(open)) as bigint)] as pick
      from (select tree, node, list_filter([{inside}], lambda b: b.high > b.low) as open
            from forest_level_{d} where node >= {1 << d} group by tree, node) t where len(open) > 0) u) v"""
        out[f"forest_level_{d + 1}"] = f"""
select l.tree, x, case when s.f is null then l.node else l.node * 2 + (x[s.f] > s.cut)::int end as node
from forest_level_{d} l left join forest_split_{d} s on s.tree = l.tree and s.node = l.node"""
        before = ("(select i, tree, 1::bigint as node from forest_input, (select distinct tree from forest_level_0) t)" if d == 0
                  else f"forest_at_{d}")
        out[f"forest_at_{d + 1}"] = f"""
select a.i, a.tree, case when s.f is null then a.node else a.node * 2 + (x[s.f] > s.cut)::int end as node
from {before} a join forest_input p on p.i = a.i left join forest_split_{d} s on s.tree = a.tree and s.node = a.node"""
    out["forest_units"] = f"""
select tree, node, cast(round_even((floor(log2(node)) + {expected_path('n')}) / ({expected_path('whole')}) * 1e9, 0) as bigint) as units
from (select tree, node, count(*) as n, sum(count(*)) over (partition by tree) as whole
      from forest_level_{FOREST_DEPTH} group by tree, node) t"""
    out["forest_raw"] = f"""
select project_id, x, -pow(2e0, -(cast(sum(units) as bigint) / {FOREST_TREES}e9)) as raw
from forest_at_{FOREST_DEPTH} a join forest_input using (i) join forest_units u on u.tree = a.tree and u.node = a.node
group by project_id, x"""
    z = [f"struct_pack(z := abs(x[{i + 1}] - (select median(x[{i + 1}]) from forest_input)) / (select case when "
         f"stddev_samp(x[{i + 1}]) > 0 then stddev_samp(x[{i + 1}]) else 1e0 end from forest_input), first := {-i}, name := {text(n)})"
         for i, n in enumerate(features)]
    out["forest_best"] = f"""
select project_id, raw < (select quantile_cont(raw, 0.05) from forest_raw) as ml_anomaly,
       {even("((select max(raw) from forest_raw) - raw) / (select max(raw) - min(raw) from forest_raw) * 1e2", 2)} as ml_anomaly_score,
       top.name as ml_top_feature, {even('top.z', 2)} as ml_top_feature_z
from (select *, list_max([{', '.join(z)}]) as top from forest_raw) t"""
    return out


CTES.update(forest())

# Hundredths of each signal.
HUNDREDTHS = {"financial": 13, "delay": 13, "progress": 14, "contractor": 10, "document": 10, "image": 10,
              "inspection": 10, "ml_anomaly": 5, "duplicate": 5, "geo": 5, "citizen": 5}


def weights_without(*missing: str) -> dict[str, float]:
    """Weights when all inputs but those of ``missing`` signals are supplied."""
    there = {s: n / 100 for s, n in HUNDREDTHS.items() if s not in missing}
    return {s: there.get(s, 0.0) / sum(there.values()) for s in HUNDREDTHS}


def fused(name: str, files: dict[str, bool], model: bool = False, citizen: str = "citizen_best") -> dict[str, str]:
    """The fused table, with or without the model-based signal."""
    weights = weights_without(*([] if model else ["ml_anomaly"]),
                              *[n for n in ("document", "image", "inspection") if not files[n + "s"]])
    score = "0e0 + " + " + ".join(f"{K.SCORE_COLUMN[s]} * {num(w)}" for s, w in weights.items() if w > 0)
    off = [n for n in ("document", "image", "inspection") if not files[n + "s"]]
    nulls = {"document": "amount_mismatch contractor_mismatch location_mismatch missing_document".split(),
             "image": "missing_image reused_image high_similarity potentially_reused".split(),
             "inspection": "missing_inspection failed_inspection needs_improvement low_inspection_score".split()}
    evidence, joins = [], []
    for kind, flags in nulls.items():
        cols = [*flags, f"{kind}_anomaly"]
        if kind in off:
            evidence += [f"false as {x}" for x in cols] + [f"0e0 as {kind}_risk_score"]
        else:
            evidence += [f"{kind}_best.{x}" for x in [*cols, f"{kind}_risk_score"]]
            joins.append(f"left join {kind}_best using (project_id)")
    evidence.append("0e0 as similarity_score" if "image" in off else "image_best.similarity_score")
    evidence.append("null as inspection_score" if "inspection" in off else "inspection_best.inspection_score")
    flags = " + ".join(f"cast({f} as bigint)" for f in FLAGS)
    return {
        f"{name}_joined": f"""
select r.*, contractor_risk_score, contractor_anomaly, {", ".join(evidence)},
       {"ml_anomaly, ml_anomaly_score, ml_top_feature" if model else "false as ml_anomaly, 0e0 as ml_anomaly_score, '' as ml_top_feature"},
       duplicate_anomaly, duplicate_risk_score,
       geo_anomaly, geo_risk_score, geo_overlap_count, coalesce(citizen_report_count, 0) as citizen_report_count,
       coalesce(citizen_risk_score, 0e0) as citizen_risk_score, coalesce(citizen_anomaly, false) as citizen_anomaly
from rules r left join contractor_map using (project_id) {" ".join(joins)}
{"left join forest_best using (project_id)" if model else ""} left join dup_best using (project_id) left join geo_best using (project_id)
left join {citizen} using (project_id)""",
        name: f"""
select *, case when overall_risk_score >= 90 then 'CRITICAL' when overall_risk_score >= 70 then 'HIGH'
               when overall_risk_score >= 40 then 'MEDIUM' else 'LOW' end as risk_level,
       cast({flags} as bigint) as risk_signal_count
from (select *, {even(f"least(greatest({score}, 0e0), 1e2)", 2)} as overall_risk_score from {name}_joined) t""",
    }


ALL_FILES = {"documents": True, "images": True, "inspections": True}
CTES.update(fused("risk", ALL_FILES))
CTES.update(fused("risk_model", ALL_FILES, model=True))
CTES.update(fused("risk_stream", ALL_FILES, citizen="stream_best"))
CTES.update(fused("risk_no_documents", {**ALL_FILES, "documents": False}))


def say(key: str, *values: str) -> str:
    return f"printf({text(TEXT[key])}, {', '.join(values)})" if values else text(TEXT[key])


def whole(x: str) -> str:
    return f"round_even({x}, 0)"


# Words for the features of the model.
LABELS = {"utilization_percentage": "fund utilization", "completion_percentage": "physical completion",
          "progress_mismatch_abs": "financial-vs-physical progress mismatch", "delay_days": "schedule delay"}


def reasons(detail: bool) -> str:
    days, gap = ("delay_days", "progress_mismatch") if detail else ("0", "0e0")

    def found(n):
        return n if detail else "false"

    def when(cond, value):
        return f"case when {cond} then {value} end"

    label = f"case {' '.join(f'when ml_top_feature = {text(n)} then {text(v)}' for n, v in LABELS.items())} else ml_top_feature end"

    slots = [
        when("financial_anomaly", f"case when financial_risk_score >= 70 then "
             f"{say('financial_high', whole('financial_risk_score'))} else "
             f"{say('financial_low', whole('financial_risk_score'))} end"),
        when("delay_anomaly", f"case when {days} > 0 then {say('delay_days', days)} else {say('delay')} end"),
        when("progress_anomaly", f"case when {gap} is not null then "
             f"{say('progress_percent', even(f'abs({gap})', 1))} else {say('progress')} end"),
        *[when(f"document_anomaly and {found(n)}", say(n)) for n in
          ("amount_mismatch", "contractor_mismatch", "location_mismatch", "missing_document")],
        when("image_anomaly", f"case when {found('reused_image')} then {say('reused_image')} "
             f"when {found('high_similarity')} then {say('high_similarity', even('similarity_score', 2))} "
             f"when {found('missing_image')} then {say('missing_image')} else {say('image')} end"),
        when("inspection_anomaly", f"case when {found('failed_inspection')} then {say('failed_inspection')} "
             f"when {found('needs_improvement')} then {say('needs_improvement')} "
             f"when {found('low_inspection_score')} then {say('low_inspection_score', whole('inspection_score'))} "
             f"when {found('missing_inspection')} then {say('missing_inspection')} end"),
        when("ml_anomaly", say("ml", f"coalesce(nullif({label}, ''), {say('ml_profile')})", whole("ml_anomaly_score"))),
        when("duplicate_anomaly", say("duplicate")),
        when("citizen_anomaly", say("citizen", "citizen_report_count")),
        when("geo_anomaly", say("geo", "geo_overlap_count")),
        f"case when contractor_risk_score >= 70 then {say('contractor_high', whole('contractor_risk_score'))} "
        f"when contractor_risk_score >= 40 then {say('contractor_medium', whole('contractor_risk_score'))} end",
    ]
    return f"list_filter([{', '.join(slots)}], lambda x: x is not null)"


def alert_ctes(name: str, source: str, detail: bool) -> dict[str, str]:
    some = "risk_signal_count > 0"
    said = "lower(risk_reasons)"
    level = "when risk_level = 'CRITICAL' then 'CRITICAL RISK ALERT' when risk_level = 'HIGH' then 'HIGH RISK ALERT'"
    by_word = f"""when contains({said}, 'financial') then 'FINANCIAL ALERT'
       when contains({said}, 'delay') then 'DELAY ALERT'
       when contains({said}, 'document') then 'DOCUMENT ALERT'
       when contains({said}, 'inspection') then 'INSPECTION ALERT'
       when contains({said}, 'image') then 'IMAGE EVIDENCE ALERT'
       when contains({said}, 'ml model') or contains({said}, 'isolation forest') then 'ML ANOMALY ALERT'
       when contains({said}, 'duplicate') or contains({said}, 're-registered') then 'DUPLICATE PROJECT ALERT'
       when contains({said}, 'location overlaps') then 'GEO-SPATIAL OVERLAP ALERT'
       when contains({said}, 'citizen report') then 'CITIZEN REPORTED ALERT'"""
    by_flag = """when financial_anomaly then 'FINANCIAL ALERT' when delay_anomaly then 'DELAY ALERT'
       when document_anomaly then 'DOCUMENT ALERT' when inspection_anomaly then 'INSPECTION ALERT'
       when image_anomaly then 'IMAGE EVIDENCE ALERT' when ml_anomaly then 'ML ANOMALY ALERT'
       when duplicate_anomaly then 'DUPLICATE PROJECT ALERT' when geo_anomaly then 'GEO-SPATIAL OVERLAP ALERT'
       when citizen_anomaly then 'CITIZEN REPORTED ALERT'"""
    sharp = ("financial_anomaly or document_anomaly or image_anomaly or duplicate_anomaly or geo_anomaly "
             "or ml_anomaly or citizen_anomaly")
    priority = [(90, "P1 - IMMEDIATE"), (70, "P2 - HIGH PRIORITY"), (40, "P3 - MONITOR")]
    action = [(90, "Immediate human verification / field inspection"),
              (70, "Priority investigation by responsible authority"),
              (40, "Monitor project and review supporting evidence")]
    return {
        f"{name}_said": f"select *, case when len(rr) = 0 then {say('none')} else array_to_string(rr, ' | ') end "
                        f"as risk_reasons, cast(greatest(len(rr), 1) as bigint) as risk_reason_count "
                        f"from (select *, {reasons(detail)} as rr from {source}) t",
        name: f"""
select *, {ladder(priority, f"case when {some} then 'P4 - REVIEW' else 'P5 - NORMAL' end")} as priority,
       {ladder(action, f"case when {some} then 'Routine verification recommended' "
                       "else 'No immediate action required' end")} as recommended_action,
       case {level} {by_word} else 'GENERAL REVIEW ALERT' end as alert_type,
       case {level} {by_flag} else 'GENERAL REVIEW ALERT' end as alert_type_by_flag,
       {sharp} as sharp_signal_fired, overall_risk_score >= 40 or {sharp} as alert_required,
       {ladder([(90, "CRITICAL"), (70, "HIGH"), (40, "MEDIUM")],
               f"case when {sharp} then 'MEDIUM' else 'NONE' end")} as alert_severity
from {name}_said""",
    }


CTES.update(alert_ctes("alert_table", "risk", True))
CTES.update(alert_ctes("alert_model", "risk_model", True))
CTES.update(alert_ctes("alert_stream", "risk_stream", True))
CTES.update(alert_ctes("alert_summary", "risk", False))
WORDS = re.compile(r"[a-z_0-9]+")
BODY: dict[str, str] = {}           # composed query -> the query alone, to compose it again with others


def compose(body: str) -> str:
    """Prefix a query with every expression it refers to, in order."""
    chain: list[str] = []

    def visit(sql: str):
        for name in WORDS.findall(sql):
            if name in CTES and name not in chain and name not in path:
                path.append(name)
                visit(CTES[name])
                path.pop()
                chain.append(name)

    path: list[str] = []
    visit(body)
    parts = ", ".join(f"{n} as materialized ({CTES[n]})" for n in chain)
    whole = f"with {parts} {body}" if chain else body
    BODY[whole] = body
    return whole
