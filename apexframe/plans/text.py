"""Phrases, fact tokens, prompts, score extraction and the rewrite scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe import dims
from apexframe.functions import text as tx
from apexframe.operators import rewrites as rw
from apexframe.plans.registry import query, shared
from apexframe.plans.rules import DG, LT, SP, T, TL

c = F.col


@query("F1_tenths", f"SELECT l_orderkey, l_linenumber, l_extendedprice, {T('l_extendedprice / 977.0')} AS t FROM lineitem")
def _(x):
    return x.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", tx.tenths(c("l_extendedprice") / 977.0).alias("t"))


@query("F2_seconds_phrase", f"SELECT event_id, {SP('value / 7.0')} AS phrase FROM events")
def _(x):
    return x.events.select("event_id", tx.seconds_phrase(c("value") / 7.0).alias("phrase"))


@query("F3_lap_time", f"SELECT session_uid, car_index, lap_number, sector_number, {LT('lap_time_ms')} AS spoken FROM snap")
def _(x):
    return x.snap.select("session_uid", "car_index", "lap_number", "sector_number", tx.lap_time(c("lap_time_ms")).alias("spoken"))


@query("F4_time_left", f"SELECT session_uid, seq, {TL('(seq * 7 % 400 - 20)')} AS phrase FROM ticks")
def _(x):
    return x.ticks.select("session_uid", "seq", tx.time_left(c("seq") * 7 % 400 - 20).alias("phrase"))


@query("F5_capitalize", "SELECT doc_id, concat(upper(text[1:1]), substring(text, 2)) AS t FROM documents")
def _(x):
    return x.documents.select("doc_id", tx.capitalize(c("text")).alias("t"))


@query("F6_compound_names", """
SELECT session_uid, car_index, set_index, CASE l WHEN 'S' THEN 'soft' WHEN 'M' THEN 'medium' WHEN 'H' THEN 'hard' WHEN 'I' THEN 'intermediate' ELSE 'wet' END AS spoken,
  CASE l WHEN 'S' THEN 'softs' WHEN 'M' THEN 'mediums' WHEN 'H' THEN 'hards' WHEN 'I' THEN 'inters' ELSE 'wets' END AS plural,
  CASE l WHEN 'S' THEN 'Softs' WHEN 'M' THEN 'Mediums' WHEN 'H' THEN 'Hards' WHEN 'I' THEN 'Inters' ELSE 'Wets' END AS display, visual_compound AS code
FROM (SELECT *, CASE visual_compound WHEN 16 THEN 'S' WHEN 17 THEN 'M' WHEN 18 THEN 'H' WHEN 7 THEN 'I' ELSE 'W' END AS l FROM tyre_sets) t""")
def _(x):
    letter = tx.code_letter(c("visual_compound"))
    return x.tyre_sets.select(
        "session_uid", "car_index", "set_index", tx.spoken_tyre(letter).alias("spoken"), tx.plural_tyre(letter).alias("plural"),
        tx.display_tyre(c("visual_compound")).alias("display"), tx.letter_code(letter).cast("bigint").alias("code"),
    )


@query("F7_sentence_marks", r"SELECT doc_id, regexp_replace(text, '([.!?]) +', '\1|', 'g') AS t FROM documents")
def _(x):
    return x.documents.select("doc_id", tx.sentence_marks(c("text")).alias("t"))


def tokens(s: str) -> str:
    p = r"(?i)\bP\d+\b"
    return (
        f"list_distinct(list_concat(list_transform(regexp_extract_all({s}, '{p}'), lambda v: upper(v)), "
        rf"regexp_extract_all(regexp_replace({s}, '{p}', ' ', 'g'), '\d+(?:\.\d+)?')))"
    )


@query("F8_fact_tokens", f"SELECT message_id, list_sort({tokens('message_text')}) AS facts FROM radio")
def _(x):
    return x.radio.select("message_id", F.array_sort(tx.fact_tokens(c("message_text"))).alias("facts"))


BEFORE, AFTER = tokens("message_text"), tokens("rendered_text")


@query("F9_fact_preservation", f"""
SELECT message_id, list_sort(list_filter(b, lambda v: NOT list_contains(a, v))) AS dropped, list_sort(list_filter(a, lambda v: NOT list_contains(b, v))) AS invented
FROM (SELECT message_id, {BEFORE} AS b, {AFTER} AS a FROM radio WHERE rendered_text IS NOT NULL) t""")
def _(x):
    r = x.radio.where(c("rendered_text").isNotNull())
    return r.select(
        "message_id", tx.dropped_facts(c("message_text"), c("rendered_text")).alias("dropped"),
        tx.invented_facts(c("message_text"), c("rendered_text")).alias("invented"),
    )


@query("F10_spoken_seconds", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 2.5 AS seconds FROM documents")
def _(x):
    return x.documents.select("doc_id", tx.spoken_seconds(c("text")).alias("seconds"))


TEMPLATE = "Lap {lap_number}, P{race_position}, {tyre}: {message_text} [{rendered_text}]"


@query("F11_prompt_template", "SELECT message_id, concat('Lap ', lap_number, ', P', race_position, ', : ', message_text, ' [', coalesce(rendered_text, ''), ']') AS prompt FROM radio")
def _(x):
    return x.radio.select("message_id", tx.fill(TEMPLATE, x.radio.columns).alias("prompt"))


DIMS = ["brevity", "tone", "clarity", "faithfulness"]
ANSWER = """CASE WHEN row_id % 11 = 0 THEN 'No idea.' WHEN row_id % 13 = 0 THEN concat('{"brevity": 9, "tone": ', tone, ', "clarity": 1, "faithfulness": 2}')
  ELSE concat('Sure. {"brevity": ', coalesce(cast(brevity AS varchar(9)), 'null'), ', "tone": ', cast(tone AS varchar(9)), ', "clarity": ', cast(clarity AS varchar(9)), ', "faithfulness": ', cast(faithfulness AS varchar(9)), ', "rationale": "ok"} done') END"""


@query("F12_judge_scores", """
SELECT row_id, judge, CASE WHEN ok THEN brevity END AS brevity, CASE WHEN ok THEN tone END AS tone, CASE WHEN ok THEN clarity END AS clarity, CASE WHEN ok THEN faithfulness END AS faithfulness
FROM (SELECT *, row_id % 11 <> 0 AND row_id % 13 <> 0 AND brevity IS NOT NULL AS ok FROM judgements) j""")
def _(x):
    s = tx.judge_scores(F.expr(ANSWER), DIMS)
    return x.judgements.withColumn("s", s).select("row_id", "judge", *[c(f"s.{d}").alias(d) for d in DIMS])


@query("F13_gap_seconds", f"""
SELECT a.session_uid, a.tick, a.car, round(CASE WHEN p.lap = a.lap THEN cast({DG('(a.lap_distance - p.lap_distance)')} AS double) ELSE -1 END, 5) AS gap_s
FROM cars a JOIN cars p ON p.session_uid = a.session_uid AND p.tick = a.tick AND p.ai = 0""")
def _(x):
    me = x.cars.where(c("ai") == 0).select("session_uid", "tick", c("lap").alias("pl"), c("lap_distance").alias("pd"))
    j = x.cars.join(me, ["session_uid", "tick"])
    gap = tx.gap_seconds(c("lap"), c("lap_distance"), c("pl"), c("pd"), F.lit(5000)).cast("double")
    return j.select("session_uid", "tick", "car", F.round(gap, 5).alias("gap_s"))


@query("F14_gap_behind", f"""
SELECT a.session_uid, a.tick, a.car, round(cast(CASE WHEN a.delta_front_ms > 0 THEN cast(a.delta_front_ms / 1000.0 AS float) ELSE {DG('(p.lap_distance - a.lap_distance)')} END AS double), 5) AS gap_s
FROM cars a JOIN cars p ON p.session_uid = a.session_uid AND p.tick = a.tick AND p.ai = 0""")
def _(x):
    me = x.cars.where(c("ai") == 0).select("session_uid", "tick", c("lap_distance").alias("pd"))
    gap = tx.gap_behind_seconds(c("delta_front_ms"), c("lap_distance"), c("pd"), F.lit(5000)).cast("double")
    return x.cars.join(me, ["session_uid", "tick"]).select("session_uid", "tick", "car", F.round(gap, 5).alias("gap_s"))


@query("F23_day_and_iso", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def _(x):
    return x.orders.select("o_orderkey", F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd").alias("day"), tx.iso(c("o_orderdate")).alias("iso"))


@query("F24_session_uid", """
SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderkey * 7919 + 1 ELSE -(o_orderkey * 104729 + 1) END AS uid,
  printf('%x', CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 7919 + 1 ELSE -(o_orderkey * 104729 + 1) END) AS hex FROM orders""")
def _(x):
    raw = F.when(c("o_orderkey") % 2 == 0, c("o_orderkey") * 7919 + 1).otherwise(-(c("o_orderkey") * 104729 + 1))
    hexed = tx.hex_uid(raw)
    sent = F.when(c("o_orderkey") % 34 == 0, " ").when(c("o_orderkey") % 17 == 0, "-").otherwise(hexed)
    return x.orders.select("o_orderkey", tx.signed_uid(sent).alias("uid"), hexed.alias("hex"))


@query("F26_tick_json", """
SELECT session_uid, tick, max(lap) FILTER (WHERE pos = 1) AS current_lap, list(car ORDER BY car) AS cars, list(name ORDER BY car) AS names, list(last_lap_ms ORDER BY car) AS laps FROM cars GROUP BY 1, 2""")
def _(x):
    car = F.struct(c("car").alias("idx"), "name", c("last_lap_ms").alias("lastLapTimeMs"), "pos", "lap")
    docs = x.cars.groupBy("session_uid", "tick").agg(
        F.array_sort(F.collect_list(car)).alias("cars"), F.max(F.when(c("pos") == 1, c("lap"))).alias("currentLap")  # 22 cars at most
    ).select("session_uid", "tick", F.to_json(F.struct(F.lit("state").alias("type"), "currentLap", "cars")).alias("line"))
    back = F.from_json("line", "type string, currentLap bigint, cars array<struct<idx:bigint,name:string,lastLapTimeMs:bigint>>")
    return docs.withColumn("d", back).select(
        "session_uid", "tick", c("d.currentLap").alias("current_lap"), c("d.cars.idx").alias("cars"), c("d.cars.name").alias("names"), c("d.cars.lastLapTimeMs").alias("laps")
    )


@query("F28_part_labels", """
SELECT session_uid, tick, CASE tick % 4 WHEN 0 THEN 'Rear-left' WHEN 1 THEN 'Rear-right' WHEN 2 THEN 'Front-left' ELSE 'Front-right' END AS corner,
  CASE tick % 5 WHEN 0 THEN 'Front wing' WHEN 1 THEN 'Rear wing' WHEN 2 THEN 'Floor' WHEN 3 THEN 'Diffuser' ELSE 'Sidepod' END AS part FROM cars WHERE ai = 0""")
def _(x):
    from apexframe.streaming.latches import CORNERS, PARTS

    name = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    return x.cars.where(c("ai") == 0).select("session_uid", "tick", name(CORNERS, c("tick") % 4).alias("corner"), name(PARTS, c("tick") % 5).alias("part"))


@query("A32_percentiles", """
SELECT model, variant, round(coalesce(quantile_cont(total_ms, 0.5), 0), 4) AS p50, round(coalesce(quantile_cont(total_ms, 0.95), 0), 4) AS p95,
  coalesce(quantile_cont(total_ms, 0.5) FILTER (WHERE total_ms > 1e9), 0) AS none FROM runs GROUP BY 1, 2""")
def _(x):
    p = lambda v, q: F.round(F.coalesce(F.percentile(v, F.lit(q)), F.lit(0.0)), 4)
    return x.runs.groupBy("model", "variant").agg(
        p(c("total_ms"), 0.5).alias("p50"), p(c("total_ms"), 0.95).alias("p95"), p(F.when(c("total_ms") > 1e9, c("total_ms")), 0.5).alias("none")
    )


INV = f"len(list_filter({tokens('output')}, lambda v: NOT list_contains({tokens('prompt')}, v))) > 0"
shared("o_scorecard", f"""
SELECT r.model, r.variant, r.n_runs, round(p50_total_ms, 4) AS p50_total_ms, round(p95_total_ms, 4) AS p95_total_ms, round(p50_ttft_ms, 4) AS p50_ttft_ms, round(list_avg(list_filter([brevity, tone, clarity, faithfulness], lambda v: v IS NOT NULL)), 4) AS overall,
  fact_invented_rate, {', '.join(f'round({d}, 4) AS {d}' for d in DIMS)} FROM (
  SELECT model, variant, count(*) AS n_runs, coalesce(quantile_cont(total_ms, 0.5) FILTER (WHERE error IS NULL), 0) AS p50_total_ms,
    coalesce(quantile_cont(total_ms, 0.95) FILTER (WHERE error IS NULL), 0) AS p95_total_ms, coalesce(quantile_cont(ttft_ms, 0.5) FILTER (WHERE error IS NULL), 0) AS p50_ttft_ms,
    round(count(*) FILTER (WHERE error IS NULL AND {INV}) / count(*), 4) AS fact_invented_rate FROM (SELECT *, coalesce(prompt_user, '') AS prompt FROM runs) q GROUP BY 1, 2) r
LEFT JOIN (SELECT model, variant, {', '.join(f'avg({d}) AS {d}' for d in DIMS)} FROM (
  SELECT model, variant, row_id, {', '.join(f'avg({d}) AS {d}' for d in DIMS)} FROM judgements GROUP BY 1, 2, 3) j GROUP BY 1, 2) s USING (model, variant)""")


@query("A33_rewrite_scorecard", "SELECT * FROM o_scorecard")
def _(x):
    card = rw.scorecard(x.runs, x.judgements, DIMS)
    return card.withColumns({k: F.round(k, 4) for k in ("p50_total_ms", "p95_total_ms", "p50_ttft_ms")})


@query("J10_resume_anti", """
SELECT r.row_id, r.model, r.variant FROM runs r WHERE NOT EXISTS (SELECT 1 FROM judgements j WHERE j.row_id = r.row_id AND j.model = r.model AND j.variant = r.variant AND j.judge = 'judge-0' AND j.row_id % 3 = 0)""")
def _(x):
    done = x.judgements.where((c("judge") == "judge-0") & (c("row_id") % 3 == 0))
    return rw.remaining(x.runs.select("row_id", "model", "variant"), done, ["row_id", "model", "variant"])


@query("T6_stratified_sample", """
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT count(*) AS t FROM documents),
p AS (SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY md5(concat(d.doc_id, ':7'))) AS rn, round_even(120 * n.n / t.t, 0) AS q FROM documents d JOIN n ON n.lang IS NOT DISTINCT FROM d.lang, t),
k AS (SELECT doc_id, lang, row_number() OVER (ORDER BY lang, rn) AS k FROM p WHERE rn <= q),
f AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE k <= 120))
SELECT doc_id, lang FROM k WHERE k <= 120 UNION ALL SELECT doc_id, lang FROM f WHERE k <= 120 - (SELECT count(*) FROM k WHERE k <= 120)""")
def _(x):
    return rw.stratified_sample(x.documents.select("doc_id", "lang"), "lang", "doc_id", 120, 7)
