"""DuckDB SQL for the registered queries, on views of the driver's tables."""

from __future__ import annotations

READINGS = """readings as (
  select doc_id as region_id, doc_id % 97 as page_id, text, case when lang = 'en' then 'en' else 'ja' end as language,
    ['candidate', 'accepted', 'verified', 'rejected'][doc_id % 4 + 1] as state,
    case when doc_id % 17 <> 0 then (doc_id * 37 % 101) / 100.0::double end as confidence,
    doc_id * 13 % 70 as li, doc_id * 29 % 60 as ti, doc_id * 13 % 70 + doc_id * 7 % 31 as ri, doc_id * 29 % 60 + doc_id * 11 % 41 as bi,
    doc_id % 23 = 0 as intentional
  from documents)"""
BOXES = """boxes as (
  select l_orderkey as page_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as idx,
    (l_partkey * 37 + l_linenumber * 211) % 900 as x, (l_suppkey * 53 + l_linenumber * 131) % 1300 as y,
    20 + l_partkey % 180 as w, 20 + l_suppkey % 140 as h, l_partkey as p, l_suppkey as s
  from lineitem)"""
DETECTIONS = BOXES + """, detections as (
  select page_id, idx, x + p % 9 as x, y + s % 7 as y, case when (p + s) % 11 = 0 then w // 2 else w end as w, h
  from boxes where (p + s) % 6 <> 0)"""
PANELS = """panels as (
  select o_orderkey as page_id, o_orderkey * 17 % 300 as x, o_custkey * 13 % 400 as y, 500 as w, 700 as h,
    ['right_to_left', ' LTR ', 'vertical-rl', 'top_to_bottom'][o_orderkey % 4 + 1] as declared,
    ['right-to-left', 'left-to-right', 'right-to-left', null][o_orderkey % 4 + 1] as direction, o_orderkey % 8 as declared_total
  from orders)"""
_UPPER = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_CODE = "array_to_string(list_transform(range(1, length({0}) + 1), lambda i: chr(list_position(cs, substr({0}, i, 1))::int)), '')"
#: The SQL engine's edit distance counts bytes; so each character of the items' alphabet, of under 128, gets a code of one byte.
CANDIDATES = f"""alphabet as (
  select list(c order by c) as cs from (select distinct unnest(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1))) as c from (select text as t from benchmark union all select {_UPPER} from benchmark))),
answers as (
  select item_id as region_id, text as expected, 0 as engine, text as answer, (item_id * 31 % 50 + 50) / 100.0::double as confidence, 0.05::double as brier from benchmark
  union all select item_id, text, 1, case when item_id % 3 = 0 then text else {_UPPER} end, (item_id * 17 % 60 + 40) / 100.0::double, 0.2 from benchmark
  union all select item_id, text, 2, substr(text, 1, length(text) - item_id % 9), (item_id * 7 % 70 + 30) / 100.0::double, null from benchmark),
candidates as (select answers.*, {_CODE.format("expected")} as expected_code, {_CODE.format("answer")} as code from answers, alphabet),
scored as (select *, case when length(expected) = 0 then case when length(answer) = 0 then 0.0 else 1.0 end else levenshtein(expected_code, code)::double / length(expected) end as cer from candidates)"""
#: IoU of boxes a and b.
COMMON = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"
IOU = f"(({COMMON})::double / (a.w * a.h + b.w * b.h - {COMMON}))"
MATCHED = """, ranked as (select *, row_number() over (partition by page_id order by iou desc, truth, found) as k from pairs),
walk as (
  select page_id, k, truth, found, iou, true as taken, [truth] as ts, [found] as fs from ranked where k = 1
  union all
  select r.page_id, r.k, r.truth, r.found, r.iou, not list_contains(ts, r.truth) and not list_contains(fs, r.found),
    case when list_contains(ts, r.truth) or list_contains(fs, r.found) then ts else list_append(ts, r.truth) end,
    case when list_contains(ts, r.truth) or list_contains(fs, r.found) then fs else list_append(fs, r.found) end
  from walk join ranked r on r.page_id = walk.page_id and r.k = walk.k + 1),
matches as (select page_id, truth, found, iou from walk where taken)"""


def _pairs(least: float) -> str:
    return f", pairs as (select a.page_id, a.idx as truth, b.idx as found, {IOU} as iou from boxes a join detections b on a.page_id = b.page_id where {IOU} >= {least})"


def _report(least: float, found: str = "detections") -> str:
    pairs = f", pairs as (select a.page_id, a.idx as truth, b.idx as found, {IOU} as iou from boxes a join {found} b on a.page_id = b.page_id where {IOU} >= {least})"
    return (
        pairs + MATCHED + f""", report as (
  select page_id, coalesce(truth_count, 0) as truth_count, coalesce(found_count, 0) as found_count, coalesce(matched, 0) as matched,
    coalesce(coalesce(matched, 0)::double / nullif(coalesce(truth_count, 0), 0), 0) as recall, coalesce(coalesce(matched, 0)::double / nullif(coalesce(found_count, 0), 0), 0) as precision, coalesce(mean_iou, 0) as mean_iou
  from (select page_id, count(*) as truth_count from boxes group by 1) full join (select page_id, count(*) as found_count from {found} group by 1) using (page_id)
  left join (select page_id, count(*) as matched, avg(iou) as mean_iou from matches group by 1) using (page_id))"""
    )


# Unicode white space, spelt out as the SQL engine's \s is ASCII.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WIDE_FROM = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " "
_WIDE_TO = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
JA = f"regexp_replace(translate(replace(text, '…', '...'), '{_WIDE_FROM}', '{_WIDE_TO}'), '^{SPACE}+|{SPACE}+$', '', 'g')"


def _en(text: str) -> str:
    pairs = {"im": "I'm", "dont": "don't", "cant": "can't", "wont": "won't", "youre": "you're", "theyre": "they're", "hes": "he's", "shes": "she's", "its": "it's"}
    cases = " ".join("when '{}' then '{}'".format(k, v.replace("'", "''")) for k, v in pairs.items())
    plain = f"translate(replace(regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g'), '…', '...'), '’‘“”', '''''\"\"')"
    tight = f"regexp_replace(regexp_replace({plain}, ' +', ' ', 'g'), ' ([,.!?;:])', '\\1', 'g')"
    words = f"list_filter(regexp_split_to_array({tight}, '{SPACE}+'), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w: case lower(w) {cases} else w end), ' ')"


_SPECIALS = "('[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]')"
_PIECES = """pieces as (select unnest(range(15)) as id, unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]', 'the', '##and', 'er', '##on', 'tion', '##an', 're', '##ed', 'ha', '##ing']) as token),
ids as (select doc_id, i as pos, (doc_id * 7 + i * 5) % 18 as id from documents, unnest(range(1, doc_id % 12 + 2)) as u(i)),
tokens as (select doc_id, pos, token from ids join pieces using (id) where token not in ('[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]'))"""


def _chars(name: str) -> str:
    return f"select unnest(string_split(text, '')) as ch from {name} where regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') <> ''"



_LOGITS = "logits as (select vec_id, list_transform(embedding, lambda x: x::double) as l from embeddings)"
_BEAMS = f"""{_LOGITS}, beams as (
  select vec_id, k as beam, [2, (vec_id + k) % 50] as tokens, round(l[k + 1] * 10 - k, 4) as logprob, (vec_id + k) % 4 = 0 as finished from logits, unnest(range(4)) as u(k)),
cands as (select vec_id, k as pos, k % 5 as beam, (vec_id * 3 + k) % 6 as token, round(l[9 + k] * 5, 4) as gain from logits, unnest(range(10)) as u(k))"""
_PIXELS = """px as (
  select event_id // 4096 as page_id, event_id % 64 as x, event_id % 4096 // 64 as y,
    case when (event_id % 4096 // 1024 + event_id % 64 // 16 + event_id // 4096) % 3 = 0
      then case when (event_id % 4096 * 7 + event_id // 4096 * 13) % 97 < 30 then user_id * 3 % 60 else 215 + user_id % 40 end
      else 235 + event_id % 4096 % 3 end as v
  from events),
sizes as (select page_id, max(x) + 1 as width, max(y) + 1 as height, sum(v) // count(*) as mean from px group by 1)"""
_CELLS = _PIXELS + """, cells as (
  select page_id, x // ((width + 31) // 32) as gx, y // ((height + 31) // 32) as gy, width, height from px join sizes using (page_id)
  group by all having avg(case when v < greatest(mean - 25, 0) or v > least(mean + 60, 255) then 1.0 else 0.0 end) > 0.08)"""
_COMPONENTS = _CELLS + """, reach(page_id, gx, gy, root) as (
  select page_id, gx, gy, gy * 32 + gx from cells
  union
  select c.page_id, c.gx, c.gy, r.root from reach r join cells c on c.page_id = r.page_id and abs(c.gx - r.gx) <= 1 and abs(c.gy - r.gy) <= 1 and r.root < c.gy * 32 + c.gx),
roots as (select page_id, gx, gy, min(root) as root from reach group by all),
parts as (select r.page_id, root, min(gx) as x0, min(gy) as y0, max(gx) as x1, max(gy) as y1, any_value(width) as width, any_value(height) as height from roots r join sizes using (page_id) group by r.page_id, root)"""

_REASON = "case when {0}.w * {0}.h < 2500 then 'small' when {0}.w * {0}.h > 20000 then 'large' when {0}.w > 4 * {0}.h then 'thin' else 'kept' end"


def _judged(states: str, least: str = "0.2") -> str:
    return READINGS + f""", crops as (select *, floor(li / 100.0::double * 1000)::bigint as cx, floor(ti / 100.0::double * 1400)::bigint as cy, least(ceil(ri / 100.0::double * 1000), 1000)::bigint - floor(li / 100.0::double * 1000)::bigint as cw, least(ceil(bi / 100.0::double * 1400), 1400)::bigint - floor(ti / 100.0::double * 1400)::bigint as ch from readings),
judged as (select *, case when state = 'rejected' then 'rejected' when state not in ({states}) then 'wrong_class' when coalesce(text, '') = '' and not intentional then 'empty_label'
    when confidence is null or confidence not between 0 and 1 then 'missing_confidence' when confidence < {least} then 'low_confidence'
    when ri <= li or bi <= ti then 'no_geometry' when cw < 60 or ch < 60 then 'too_small' else 'kept' end as reason from crops)"""


_COUNTS = "count(*) filter (reason = 'kept') as pairs_written, count(*) filter (reason = 'wrong_class' and state = 'candidate') as skipped_candidate, " + ", ".join(
    f"count(*) filter (reason = '{n}') as skipped_{n}" for n in ("rejected", "too_small", "no_geometry", "low_confidence", "missing_confidence", "empty_label", "wrong_class")
)
_NUMBER = "regexp_replace(({0} / 100.0::double)::varchar, '\\.0$', '')"
_CORNERS = " || ',' || ".join("'{\"x\":' || " + _NUMBER.format(x) + " || ',\"y\":' || " + _NUMBER.format(y) + " || '}'" for x, y in (("li", "ti"), ("ri", "ti"), ("ri", "bi"), ("li", "bi")))
_RECORDS = _judged("'accepted', 'verified'") + f""", records as (select *, printf('pair_0000_%06d', region_id) as stem, '{{"crop":"crops/' || printf('pair_0000_%06d', region_id) || '.png","direction":"ttb","empty_is_intentional":' || intentional
    || ',"geometry":{{"normalized_bounds":[' || {_CORNERS} || ']}},"language":"' || language || '","provenance":{{"confidence":' || regexp_replace(confidence::varchar, '\\.0$', '')
    || ',"envelope_digest":"envelope","item_id":"item","page_digest":"page","publication_id":"publication","region_id":"' || region_id || '","reviewed_by":"reviewer","state":"' || state
    || '"}},"source":"own-corpus","text":' || to_json(coalesce(text, ''))::varchar || '}}' as record from judged where reason = 'kept')"""
_MANIFEST = """entries as (select region_id // 50 as page_id, string_agg('{"crop":"crops/' || stem || '.png","crop_digest":"sha256:' || sha256(concat_ws('|', region_id // 50, cx, cy, cw, ch)) || '","record":"' || stem || '.json","record_digest":"sha256:' || sha256(record) || '","region_id":"' || region_id || '"}', ',' order by stem) as listed from records group by 1),
counters as (select region_id // 50 as page_id, """ + _COUNTS + """ from judged group by 1),
unsigned as (select page_id, pairs_written as pairs, '{"dataset_class":"gold","envelope_digest":"envelope","item_id":"item","manifest_digest":"","page_digest":"page-' || page_id || '","policy_version":"curation-training-v1","publication_id":"publication","records":[' || coalesce(listed, '')
  || '],"report":{"pairs_written":' || pairs_written || """ + " || ".join(f"',\"skipped_{n}\":' || skipped_{n}" for n in ("candidate", "empty_label", "low_confidence", "missing_confidence", "no_geometry", "rejected", "too_small", "wrong_class")) + """
  || '},"reviewed_by":"reviewer","rights_grant_id":"grant","source":"own-corpus","split":"train","split_group":"group","version":"1.0"}' as text from counters left join entries using (page_id))"""
_SHAPE = "[[x, y], [x + w, y + h / 4.0], [x + w / 2.0, y + h], [x, y + h / 2.0]]"
_ISSUES = BOXES + """, issues as (
  select page_id, 'invalid-panel-' || idx as id, 'invalid-bounds' as issue_type, 'error' as severity from boxes where p % 40 = 0
  union all select page_id, 'missing-translation-' || idx, 'missing-translation', 'warning' from boxes where s % 9 in (0, 1))"""
_STATUS = PANELS + ", " + _ISSUES + """, status as (
  select page_id, case max(case severity when 'error' then 2 when 'warning' then 1 else 0 end) when 2 then 'invalid' when 1 then 'warning' else 'valid' end as status from panels left join issues using (page_id) group by 1)"""
_VIOLATIONS = PANELS + ", " + BOXES + """, own as (
  select b.page_id, idx, b.x, b.y + b.h / 2.0 as centre, p % 10 as ord, case when direction = 'left-to-right' then 1 when direction = 'right-to-left' then -1 end as dir from boxes b join panels using (page_id) where direction is not null),
violations as (
  select a.page_id, a.idx as first, b.idx as second, 0.98::double as confidence from own a join own b on a.page_id = b.page_id and a.idx < b.idx and abs(a.centre - b.centre) < 60
  where (a.x < b.x and ((a.dir = 1 and a.ord > b.ord) or (a.dir = -1 and a.ord < b.ord))) or (a.x > b.x and ((a.dir = 1 and a.ord < b.ord) or (a.dir = -1 and a.ord > b.ord))))"""

SQL: dict[str, str] = {
    "vocab_build": f"with n as (select ch from ({_chars('documents')}) where ch not in ('', chr(10), chr(13)) group by ch having count(*) >= 20) select unnest(range(5)) as id, unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]']) as token union all select 4 + row_number() over (order by ch collate C), ch from n",
    "vocab_report": f"with lines as (select text from documents union all select text from conversations), n as (select ch, count(*) as n from ({_chars('lines')}) where ch not in ('', chr(10), chr(13)) group by ch) select count(*) as distinct_characters, count(*) filter (n >= 20) as admitted, count(*) filter (n < 20) as dropped_rare, sum(n)::bigint as characters_scanned, (select count(*) from lines where regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') = '') as empty_lines from n",
    "char_frequency": f"select ch, count(*) as n from ({_chars('conversations')}) where ch not in ('', chr(10), chr(13)) group by ch",
    "wordpiece_decode": f"with {_PIECES}, t as (select doc_id, string_agg(regexp_replace(token, '^##', ''), '' order by pos) as text from tokens group by 1) select doc_id, coalesce(t.text, '') as text from documents d left join t using (doc_id)",
    "wordpiece_words": f"with {_PIECES}, s as (select *, case when not starts_with(token, '##') or row_number() over (partition by doc_id order by pos) = 1 then 1 else 0 end as st from tokens), w as (select *, (sum(st) over (partition by doc_id order by pos rows unbounded preceding))::bigint as word from s) select doc_id, word, string_agg(regexp_replace(token, '^##', ''), '' order by pos) as text from w group by doc_id, word",
    "special_tokens": f"with {_PIECES} select id, token, token in {_SPECIALS} as is_special from pieces",
    "tensor_layers": "select max(n_nationkey % 7)::bigint + 1 as layers from nation",
    "normalize_en": f"with x as (select conv_id, turn, '  im sure, dont  ' || text || ' “its” … ok !' as t from conversations) select conv_id, turn, {_en('t')} as out from x",
    "normalize_ja": f"select doc_id, {JA} as out from documents",
    "normalize_by_language": f"with {READINGS} select region_id, language, case when language = 'en' then {_en('text')} else {JA} end as out from readings",
    "furigana_brackets": "select doc_id, '漢字[かん' || doc_id || ']は' || case when doc_id % 3 = 0 then '字[じ]　ｘ' || case when doc_id % 5 = 0 then '］！' else '' end when doc_id % 3 = 1 then '生．．．' || case when doc_id % 5 = 0 then '読[]！' else '読(' end else 'ａｂ' || case when doc_id % 5 = 0 then '］！' else '' end end as out from documents",
    "kanji_flags": "select n_nationkey::bigint as n_nationkey, n_nationkey % 2 = 0 as kanji from nation",
    "direction_parse": f"with {PANELS} select page_id, direction, case when page_id % 2 = 0 then 'ttb' else 'ltr' end as writing from panels",
    "path_sanitise": "select page_id, 'see ' || url || '  in a reference/b ~/c' as out from pages",
    "id_formats": "select page_id, 'co-' || case when page_id < 1000 then lpad(page_id::varchar, 3, '0') else page_id::varchar end as co, 'pair_' || lpad((page_id % 50)::varchar, 4, '0') || '_' || lpad(page_id::varchar, 6, '0') as pair, 'mask-' || page_id as mask from pages",
    "visible_lengths": f"with c as (select doc_id, regexp_replace(text, '{SPACE}', '', 'g') as v from documents), u as (select doc_id, ch, min(pos) as first from (select doc_id, unnest(string_split(v, '')) as ch, generate_subscripts(string_split(v, ''), 1) as pos from c) where ch <> '' and not regexp_matches(ch, '^[a-z.,]$') group by all) select c.doc_id, length(v) as n, coalesce(a.s, '') as uncovered from c left join (select doc_id, string_agg(ch, '' order by first) as s from u group by 1) a using (doc_id)",
    "cer_per_item": f"with {CANDIDATES} select region_id, engine::bigint as engine, round(cer, 6) as cer, case when answer = expected then 'exact' when starts_with(answer, expected) then 'OVERRUN' else 'misread' end as verdict from scored",
    "cer_summary": f"with {CANDIDATES} select engine::bigint as engine, count(*) as scored, count(*) filter (answer = expected) as exact, round(avg(cer), 6) as mean_cer, round(max(cer), 6) as worst from scored group by 1",
    "gate_status": f"with {CANDIDATES}, j as (select *, region_id % 10 <> 3 and cer <= 0.05 as ok from scored) select count(*) as total, count(*) filter (ok) as passed, count(*) filter (not ok) as failed, round(avg(cer), 6) as mean_cer, bool_and(ok) as ok from j",
    "known_failures": f"with {CANDIDATES} select case when cer <= 0.05 then 'PASS' when region_id % 7 = 0 then 'KNOWN FAIL' else 'UNEXPECTED FAIL' end as kind, count(*) as n from scored group by 1",
    "divergence_review": f"with {CANDIDATES}, d as (select a.region_id, levenshtein(a.code, b.code)::double / greatest(length(a.answer), length(b.answer)) as d from candidates a join candidates b using (region_id) where a.engine = 0 and b.engine = 2) select region_id, round(d, 6) as divergence, d >= 0.02 as needs_review from d",
    "panel_decision": f"with {CANDIDATES}, r as (select *, row_number() over (partition by region_id order by confidence desc, engine) as k, exp(-coalesce(brier, 0.1)) as wt from candidates), d as (select region_id, max(answer) filter (k = 1) as a, max(answer) filter (k = 2) as b, max(code) filter (k = 1) as a_code, max(code) filter (k = 2) as b_code, max(confidence) as confidence, sum(confidence * wt) / sum(wt) as wc from r group by 1), e as (select *, levenshtein(a_code, b_code)::double / greatest(length(a), length(b)) as dv from d) select region_id, a as selected_text, confidence, round(wc, 6) as weighted_confidence, wc >= 0.7 as is_validated, round(dv, 6) as divergence, dv >= 0.2 as needs_review from e",
    "brier_weights": "select event_id, round(exp(-least(greatest((value - 20) / 50, 0), 1)), 6) as weight from events",
    "confidence_geomean": f"with {READINGS} select page_id, round(coalesce(exp(avg(ln(greatest(confidence, 1e-7))) filter (confidence is not null)), 0), 6) as confidence, count(confidence) as n from readings group by 1",
    "page_rollup": "with r as (select conv_id // 8 as page_id, conv_id as region, string_agg(text, '' order by turn) as text, avg((conv_id * 13 + turn) % 100 / 100.0::double) as c, sum((conv_id * 7 + turn) % 50 / 10.0::double) as d from conversations group by all) select page_id, count(*) as regions, string_agg(text, chr(10) order by region) as text, round(avg(c), 6) as confidence, round(sum(d), 2) as duration_ms from r group by 1",
    "box_metrics": f"with {BOXES} select page_id, idx, w * h as area, round(w::double / h, 6) as aspect, round(x / 1000.0, 6)::double as nx, round(y / 1400.0::double, 6) as ny, round(w / 1000.0, 6)::double as nw, round(h / 1400.0::double, 6) as nh from boxes",
    "dual_rect": f"with {PANELS}, s as (select *, page_id % 3 * 500 as pw, page_id % 2 * 700 as ph from panels) select page_id, coalesce(round(x::double / nullif(pw, 0), 6), 0) as nx, coalesce(round(y::double / nullif(ph, 0), 6), 0) as ny, coalesce(round(w::double / nullif(pw, 0), 6), 0) as nw, coalesce(round(h::double / nullif(ph, 0), 6), 0) as nh from s",
    "polygon_area": f"with {BOXES} select page_id, idx, round(abs(x * (y + h / 4.0) - (x + w) * y + (x + w) * (y + h) - (x + w / 2.0) * (y + h / 4.0) + (x + w / 2.0) * (y + h / 2.0) - x * (y + h) + x * y - x * (y + h / 2.0)) / 2, 4)::double as area from boxes",
    "point_in_polygon": f"with {BOXES}, q as (select page_id, idx, x + p % 200 + 0.5::double as px, y + s % 160 + 0.5::double as py, {_SHAPE}::double[][] as v from boxes), e as (select page_id, idx, px, py, v[i][1] as xi, v[i][2] as yi, v[(i + 2) % 4 + 1][1] as xj, v[(i + 2) % 4 + 1][2] as yj from q, unnest(range(1, 5)) as u(i)) select page_id, idx, count(*) filter ((yi > py) <> (yj > py) and px < (xj - xi) * (py - yi) / (yj - yi + 1e-7) + xi) % 2 = 1 as inside from e group by all",
    "enclosure_bounds": f"with {BOXES}, m as (select *, case idx % 3 when 0 then greatest(ceil(w * 0.71)::bigint - w // 2, 0) when 1 then 5 else 0 end as mx, case idx % 3 when 0 then greatest(ceil(h * 0.71)::bigint - h // 2, 0) when 1 then 5 else 0 end as my from boxes) select page_id, idx, greatest(x - mx, 0) as ex, greatest(y - my, 0) as ey, w + 2 * mx as ew, h + 2 * my as eh from m",
    "crop_box": f"with {_judged(chr(39) + 'accepted' + chr(39))} select region_id, " + ", ".join(f"case when ri > li and bi > ti then c{c} end as c{c}" for c in "xywh") + " from crops",
    "rect_corners": f"with {BOXES} select page_id, idx, k, x + case when k in (1, 2) then w else 0 end as px, y + case when k >= 2 then h else 0 end as py from boxes, unnest(range(4)) as u(k)",
    "reading_order_bands": f"with {BOXES} select page_id, idx, y // 200 as band, row_number() over (partition by page_id order by y // 200, x desc, idx) as place from boxes",
    "reading_order_rows": f"""with recursive {PANELS}, {BOXES}, o as (select b.page_id, idx, b.x, b.y, b.h, direction, row_number() over (partition by b.page_id order by b.y, idx) as k from boxes b join panels using (page_id) where direction is not null),
r as (select page_id, k, idx, x, y, direction, 1::bigint as row, 1 as n, y::double as sy, h::double as sh from o where k = 1
  union all select o.page_id, o.k, o.idx, o.x, o.y, o.direction, case when abs(o.y - sy / n) <= greatest(0.75 * sh / n, 40) then r.row else r.row + 1 end,
    case when abs(o.y - sy / n) <= greatest(0.75 * sh / n, 40) then n + 1 else 1 end, case when abs(o.y - sy / n) <= greatest(0.75 * sh / n, 40) then sy + o.y else o.y end, case when abs(o.y - sy / n) <= greatest(0.75 * sh / n, 40) then sh + o.h else o.h end
  from r join o on o.page_id = r.page_id and o.k = r.k + 1)
select page_id, idx, row, row_number() over (partition by page_id order by row, case when direction = 'right-to-left' then -x else x end, y, idx) as place from r""",
    "tile_windows": f"""with {BOXES}, s as (select page_id, idx, case when idx % 2 = 0 then w * 5 else w end as w, case when idx % 3 = 0 then h * 6 else h end as h from boxes), t as (select *, least(w, h) as sh, greatest(w, h) as lo, greatest(least(w, h) * 4 // 5, 1) as st from s),
u as (select *, lo > 3 * sh as strip, case when lo > 3 * sh then (lo - sh + st - 1) // st + 1 else 1 end as n from t), v as (select *, unnest(range(n)) as tile from u)
select page_id, idx, w, h, tile, case when strip and w > h then tile * st else 0 end as tile_x, case when strip and h > w then tile * st else 0 end as tile_y, case when strip and w > h then least(sh, lo - tile * st) else w end as tile_w, case when strip and h > w then least(sh, lo - tile * st) else h end as tile_h from v""",
    "iou_pairs": f"with {DETECTIONS} {_pairs(0.3)} select page_id, truth, found, round(iou, 6) as iou from pairs",
    "iou_pairs_grid": f"with {DETECTIONS} {_pairs(0.3)} select page_id, truth, found, round(iou, 6) as iou from pairs",
    "drop_containers": f"with {BOXES}, b as (select page_id, idx, x, y, case when idx % 4 = 0 then w * 6 else w end as w, case when idx % 4 = 0 then h * 6 else h end as h from boxes) select * from b a where not exists (select 1 from b where b.page_id = a.page_id and (b.x <> a.x or b.y <> a.y or b.w <> a.w or b.h <> a.h) and b.x >= a.x and b.y >= a.y and b.x + b.w <= a.x + a.w and b.y + b.h <= a.y + a.h)",
    "box_occupancy": f"with {DETECTIONS}, d as (select page_id, idx, x, y, w * 3 as w, h * 3 as h from detections) select a.page_id, a.idx, count(b.idx) as held from d a left join boxes b on a.page_id = b.page_id and b.x + b.w // 2 >= a.x and b.x + b.w // 2 < a.x + a.w and b.y + b.h // 2 >= a.y and b.y + b.h // 2 < a.y + a.h group by all",
    "occupancy_summary": f"with {DETECTIONS}, d as (select page_id, idx, x, y, w * 3 as w, h * 3 as h from detections), o as (select a.page_id, a.idx, count(b.idx) as held from d a left join boxes b on a.page_id = b.page_id and b.x + b.w // 2 >= a.x and b.x + b.w // 2 < a.x + a.w and b.y + b.h // 2 >= a.y and b.y + b.h // 2 < a.y + a.h group by all) select count(*) filter (held > 1) as crowded, (sum(held) filter (held > 1))::bigint as crowded_sum, max(held) as worst, count(*) filter (held = 0) as empty from o",
    "innermost_container": f"with {BOXES}, b as (select page_id, idx, x, y, w * 4 as w, h * 4 as h from boxes) select a.page_id, a.idx, arg_min(b.idx, (b.w * b.h, b.idx)) as container from b a left join b on a.page_id = b.page_id and a.idx <> b.idx and a.x + a.w // 2 >= b.x and a.x + a.w // 2 < b.x + b.w and a.y + a.h // 2 >= b.y and a.y + a.h // 2 < b.y + b.h group by all",
    "filter_cost": f"with {DETECTIONS} select {_REASON.format('a')} as reason, count(*) as dropped, count(*) filter (exists (select 1 from boxes b where b.page_id = a.page_id and {IOU} >= 0.5)) as would_match from detections a group by 1",
    "loss_by_stage": f"with recursive {DETECTIONS}, kept as (select * from detections a where {_REASON.format('a')} = 'kept') {_report(0.5, 'kept')} select sum(truth_count)::bigint as truth, sum(found_count)::bigint as filtered, sum(matched)::bigint as matched, (sum(truth_count) - sum(matched))::bigint as lost from report",
    "greedy_match": f"with recursive {DETECTIONS} {_pairs(0.3)} {MATCHED} select page_id, truth, found, round(iou, 6) as iou from matches",
    "detection_recall": f"with recursive {DETECTIONS} {_report(0.5)} select page_id, truth_count, found_count, matched, round(recall, 6) as recall, round(precision, 6) as precision, round(mean_iou, 6) as mean_iou from report",
    "recall_by_density": f"with recursive {DETECTIONS} {_report(0.5)} select truth_count, count(*) as pages, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(mean_iou), 6) as mean_iou from report group by 1",
    "false_positive_classes": f"""with recursive {DETECTIONS} {_pairs(0.8)} {MATCHED}, loose as (select * from detections d where not exists (select 1 from matches m where m.page_id = d.page_id and m.found = d.idx)),
u as (select p.page_id, p.idx, least(p.x, q.x) as x, least(p.y, q.y) as y, greatest(p.x + p.w, q.x + q.w) - least(p.x, q.x) as w, greatest(p.y + p.h, q.y + q.h) - least(p.y, q.y) as h from loose p join loose q on p.page_id = q.page_id and p.idx <> q.idx),
paired as (select distinct a.page_id, a.idx from u a join boxes b on a.page_id = b.page_id where {IOU} >= 0.5)
select case when p.idx is not null then 'paired' when w * h > 15000 then 'oversized' else 'isolated' end as kind, count(*) as n, max(w * h) as largest from loose left join paired p using (page_id, idx) group by 1""",
    "region_panel_assign": f"with {BOXES} select page_id, idx, min(k) filter (x + w // 2 >= 300 * k and x + w // 2 < 300 * k + 350) as panel from boxes, unnest(range(4)) as u(k) group by all",
    "spatial_containment": f"with {PANELS}, {BOXES}, o as (select b.page_id, idx, greatest(p.x - b.x, b.x + b.w - p.x - p.w, p.y - b.y, b.y + b.h - p.y - p.h, 0)::double as overflow from boxes b join panels p using (page_id)) select page_id, idx, overflow, 'Text region ''' || idx || ''' extends ' || overflow::bigint || '.0px outside parent panel ''' || page_id || ''' bounds (tolerance: 50.0px).' as message from o where overflow > 50",
    "panel_order_violations": f"with {_VIOLATIONS} select * from violations",
    "order_status": f"with {_VIOLATIONS} select page_id, declared, declared as inferred, case when count(first) > 0 then 'contradiction' else 'consistent' end as status, count(first) as violations from panels left join violations using (page_id) group by all",
    "cardinality_check": f"with {PANELS}, {BOXES} select page_id, declared_total as declared, count(b.idx) as actual from panels left join boxes b using (page_id) group by page_id, declared_total having declared_total <> count(b.idx)",
    "duplicate_ids": f"with {BOXES}, o as (select page_id, 'p' || p % 5 as panel_id, idx, row_number() over (partition by page_id, p % 5 order by idx) as occurrence from boxes) select * from o where occurrence > 1",
    "semantic_roles": "with v as (select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderkey % 7 end as ch, case when o_custkey % 6 <> 0 then o_custkey % 7 end as badge, case when o_orderkey % 3 <> 0 then o_orderkey % 9 end as nx from orders) select o_orderkey as page_id, coalesce(ch = badge and nx < ch, false) as conflict from v",
    "art_penalty": f"""with {PANELS}, {BOXES}, t as (select *, case when idx % 5 <> 0 then idx % 2 end as panel from boxes),
r as (select page_id, case when page_id % 3 <> 0 then page_id % 2 end as panel, case when page_id % 4 = 0 then 'hard' when page_id % 4 = 3 then 'none' else 'soft' end as protection, case when page_id % 5 <> 0 then page_id % 5 / 2.0::double end as weight, page_id % 7 = 0 as unbound, x, y, w, h from panels),
o as (select a.page_id, a.idx, protection, weight, case when unbound then 1 else {COMMON} end as common from t a left join r b on a.page_id = b.page_id and (a.panel is null or b.panel is null or a.panel = b.panel))
select page_id, idx, round(sum(case protection when 'hard' then common * 1000.0::double when 'soft' then common * coalesce(weight, 1) * 100 else 0 end), 3) as penalty, coalesce(bool_or(protection = 'hard' and common > 0), false) as hard from o group by all""",
    "cleanup_masks": f"with {BOXES} select 'mask-' || page_id || '-' || idx as id, page_id as panel_id, case when idx % 2 = 0 then 'clean-balloon' else 'erase-text' end as mask_type, 4.0::double as expansion, 1.5::double as feather from boxes",
    "scene_issues": f"with {_ISSUES} select * from issues",
    "scene_status": f"with {_STATUS} select * from status",
    "scene_counts": f"with {_STATUS} select (select count(*) from panels) as pages, count(*) as regions, count(*) filter (idx % 2 = 0) as balloon_masks, (select case when bool_or(status = 'invalid') then 'invalid' when bool_or(status = 'warning') then 'warning' else 'valid' end from status) as status from boxes",
    "speaker_attribution": f"with {BOXES}, d as (select page_id * 100 + idx as id, (p % 40)::double as da, sqrt((s % 30) ** 2 + (s % 4) ** 2) as db from boxes), q as (select id, 1 - da / nullif(da + db, 0) as pa, 1 - db / nullif(da + db, 0) as pb from d) select id, case when coalesce(pa >= pb, false) then 'a' else 'b' end as speaker, round(case when coalesce(pa >= pb, false) then pa else pb end, 6) as confidence, round(abs(pa - pb), 6) as margin, case when abs(pa - pb) < 0.15 then 'human-review-required' else 'resolved' end as status from q",
    "ambiguity_margin": f"with {CANDIDATES}, p as (select region_id, max(confidence) filter (engine = 0) as a, case when region_id % 5 <> 0 then max(confidence) filter (engine = 1) end as b from candidates group by 1) select region_id, round(abs(a - b), 6) as margin, case when abs(a - b) < 0.15 then 'human-review-required' else 'resolved' end as status from p",
    "export_reasons": f"with {_judged(chr(39) + 'accepted' + chr(39) + ', ' + chr(39) + 'verified' + chr(39))} select region_id, reason from judged",
    "export_report": f"with {_judged(chr(39) + 'accepted' + chr(39) + ', ' + chr(39) + 'verified' + chr(39))} select {_COUNTS} from judged",
    "export_report_silver": f"with {_judged(chr(39) + 'candidate' + chr(39))} select {_COUNTS} from judged",
    "export_pairs": f"with {_judged(chr(39) + 'accepted' + chr(39) + ', ' + chr(39) + 'verified' + chr(39))} select region_id, state, cx, cy, cw, ch, 'sha256:' || sha256(text) as text_digest from judged where reason = 'kept'",
    "cap_split": f"with n as (select length(regexp_replace(text, '{SPACE}', '', 'g')) as n from conversations) select sum(least(n, 120))::bigint as kept, sum(greatest(n - 120, 0))::bigint as discarded from n",
    "softmax_topk": f"with {_LOGITS}, z as (select vec_id, l, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) as z from logits), e as (select vec_id, i - 1 as token, l[i] - z as lp from z, unnest(range(1, 65)) as u(i) where i - 1 not in (0, 1, vec_id % 64)), r as (select *, row_number() over (partition by vec_id order by lp desc, token) as rank from e) select vec_id, rank, token, round(lp, 6) as logprob from r where rank <= 5",
    "token_entropy": f"with {_LOGITS}, x as (select vec_id, exp(unnest(l) * 20 - list_max(l) * 20) as e from logits), p as (select vec_id, e / sum(e) over (partition by vec_id) as p from x) select vec_id, round(-sum(p * log2(p)) filter (p > 1e-7), 6) as bits, round(max(p), 6) as top from p group by 1",
    "loop_truncation": "with w as (select event_id, avg(value) over r as mean, count(*) over r as n from events window r as (partition by user_id order by ts, event_id rows between 3 preceding and current row)) select event_id, case when n = 4 then round(mean, 6) end as mean, n = 4 and mean < 8.0 as truncate from w",
    "ngram_ban": "with t as (select doc_id, list_transform(range(doc_id % 25 + 1), lambda i: (doc_id + i * i) % 4) as t from documents), b as (select doc_id, t[i + 2] as next, min(i) as first from t, unnest(range(1, 26)) as u(i) where len(t) >= 3 and i + 2 <= len(t) and t[i:i+1] = t[len(t)-1:len(t)] group by all) select t.doc_id, coalesce(string_agg(next::varchar, ',' order by first), '') as banned from t left join b using (doc_id) group by t.doc_id",
    "beam_select": f"with {_BEAMS}, n as (select vec_id, 0 as kind, pos, list_append(tokens, token) as tokens, logprob + gain as logprob, token = 3 as finished from beams join cands using (vec_id, beam) where not finished union all select vec_id, 1, beam, tokens, logprob, finished from beams where finished), r as (select *, row_number() over (partition by vec_id order by logprob desc, kind, pos) - 1 as beam from n) select vec_id, beam, array_to_string(tokens, ',') as tokens, round(logprob, 4) as logprob, finished from r where beam < 4",
    "beam_best": f"with {_BEAMS}, s as (select vec_id, beam, logprob / pow(len(tokens), 2.0) as score from beams) select vec_id, arg_max(beam, (score, beam)) as beam, round(max(score), 6) as score from s group by 1",
    "sequence_confidence": f"with {_BEAMS} select vec_id, beam, round(least(greatest(exp(logprob / len(tokens)), 0), 1), 6) as confidence from beams",
    "delta_stats": f"with {CANDIDATES}, m as (select expected, max(confidence) as made from candidates where engine = 1 group by 1), d as (select (length(expected) % 3)::bigint as k, round(confidence - made, 6) as d from candidates join m using (expected) where engine = 0) select k, count(*) as n, round(avg(d), 6) as mean, round(list_sort(list(d))[len(list(d)) // 2 + 1], 6) as median, min(d) as least, max(d) as most from d group by 1",
    "length_buckets": "with w as (select len(string_split(text, ' ')) as label, len(string_split(text, ' ')) + turn % 3 * (conv_id % 2) as o from conversations), b as (select *, case when label between 1 and 8 then (1, 8) when label between 9 and 14 then (9, 14) when label between 15 and 22 then (15, 22) when label between 23 and 34 then (23, 34) when label between 35 and 200 then (35, 200) end as b from w) select b[1]::bigint as low, b[2]::bigint as high, count(*) as n, round(avg(o), 6) as mean_out, round(avg(o - label), 6) as mean_over, count(*) filter (o = label) as exact from b where b is not null group by b",
    "sweep_best": "with m as (select l_orderkey % 5 as density, l_linenumber::bigint as radius, round(avg(l_partkey % 11), 9) as mean from lineitem group by all) select density, arg_max(radius, (mean, -radius)) as radius, round(max(mean), 6) as mean from m group by 1",
    "sweep_pivot": "select l_orderkey % 5 as density, " + ", ".join(f"round(avg(l_partkey % 11) filter (l_linenumber = {k}), 6) as r{k}" for k in range(1, 8)) + " from lineitem group by 1",
    "arm_errors": f"with {CANDIDATES}, means as (select engine, round(avg(cer), 6) as mean_cer from scored group by 1), wrong as (select engine, region_id from scored where cer > 0.02) select engine::bigint as engine, mean_cer, region_id from means left join wrong using (engine)",
    "distinct_readings": f"with {CANDIDATES} select region_id, count(distinct answer) as readings from candidates group by 1",
    "overrun_counts": f"with {CANDIDATES} select count(*) filter (answer = expected) as exact, count(*) filter (answer <> expected and starts_with(expected, answer)) as overrun, count(*) filter (answer <> expected and not starts_with(expected, answer)) as misread from candidates",
    "chunked_labels": "with b as (select item_id, text as label from benchmark) select 1::bigint as width, item_id as chunk, label from b " + " ".join(f"union all select {w}, item_id // {w}, string_agg(label, '' order by item_id) from b group by item_id // {w}" for w in (2, 3, 4)),
    "panel_shape_stats": f"with {BOXES}, s as (select page_id, w * h as a, lpad(w::varchar, 4, '0') || 'x' || lpad(h::varchar, 4, '0') as size from boxes) select page_id, count(*) as n, count(distinct size) as shapes, min(a) as least, max(a) as most, string_agg(size, ',' order by size) as sizes from s group by 1",
    "large_thin_boxes": f"with {BOXES}, p as (select page_id, count(*) as n, count(*) filter (500 * w * h >= 1400000 and p % 100 < 10) as lt, max(w * h) as largest from boxes group by 1) select count(*) filter (lt > 0) as pages_affected, sum(lt)::bigint as total, max(largest) as largest, sum(n)::bigint as boxes from p",
    "enclosure_counts": f"with {BOXES} select ['balloon', 'caption-box', 'none'][p % 3 + 1] as enclosure, count(*) as n from boxes group by 1",
    "hypothesis_union": f"with {BOXES}, g as (select page_id, idx, x, y, w * 4 as w, h * 4 as h from boxes where idx % 2 = 0), m as (select page_id, idx from g a where not exists (select 1 from g b where b.page_id = a.page_id and (b.x <> a.x or b.y <> a.y or b.w <> a.w or b.h <> a.h) and b.x >= a.x and b.y >= a.y and b.x + b.w <= a.x + a.w and b.y + b.h <= a.y + a.h) union select page_id, idx from boxes where idx % 3 = 0) select page_id, count(*) as masks from m group by 1",
    "mean_luma": f"with {_PIXELS} select page_id, mean::bigint as mean from sizes",
    "otsu_level": f"with {_PIXELS}, h as (select page_id, v, count(*) as n from px group by all), c as (select page_id, v, sum(n) over u as w0, sum(n * v) over u as s0, sum(n) over a as w, sum(n * v) over a as s from h window u as (partition by page_id order by v rows unbounded preceding), a as (partition by page_id)), b as (select page_id, v, round(w0::double * (w - w0)::double * (s0::double / w0::double - (s - s0)::double / nullif(w - w0, 0)::double) ** 2, 3) as b from c) select page_id, arg_max(v, (coalesce(b, -1), -v)) as level from b group by 1",
    "ground_mode": f"with {_PIXELS}, h as (select page_id, v, count(*) as n from px where v >= 128 group by all) select page_id, arg_max(v, (n, v)) as ground from h group by 1",
    "ink_coverage": f"with {_PIXELS} select page_id, round(avg(case when v < 128 then 1.0 else 0.0 end), 6) as ink from px group by 1",
    "active_cells": f"with {_CELLS} select * from cells",
    "grid_components": f"with recursive {_COMPONENTS} select page_id, row_number() over (partition by page_id order by root) - 1 as component, x0, y0, x1, y1, width, height from parts",
    "grid_regions": f"with recursive {_COMPONENTS}, b as (select page_id, x0 * ((width + 31) // 32) as x, y0 * ((height + 31) // 32) as y, least((x1 + 1) * ((width + 31) // 32), width) - x0 * ((width + 31) // 32) as w, least((y1 + 1) * ((height + 31) // 32), height) - y0 * ((height + 31) // 32) as h, width * height as page from parts), found as (select page_id, x, y, w, h from b where w * h > 400 and w * h < 0.85 * page), kept as (select * from found union all select page_id, 0, 0, width, height from sizes where page_id not in (select page_id from found)) select page_id, x, y, w, h, row_number() over (partition by page_id order by y // 200, x desc, y, w, h) as place from kept",
    "rgb_luma": "with c as (select l_partkey % 256 as r, l_suppkey * 7 % 256 as g, (l_partkey + l_suppkey) % 256 as b from lineitem) select (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 as luma, count(*) as n, round(max((r / 255.0::double - 0.5) / 0.5), 6) as top from c group by 1",
    "input_discovery": "with u as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages), l as (select host, min(page_id) as first from u group by 1) select host, first, row_number() over (order by host) as place from l",
    "schema_conformance": f"with {READINGS}, f as (select region_id, array_to_string(list_filter([case when ri <= li or bi <= ti then 'bounds' end, case when confidence is null then 'confidence' end, case when state = 'rejected' then 'state' end, case when length(text) = 0 and not intentional then 'text' end], lambda x: x is not null), ',') as failed from readings) select * from f where failed <> ''",
    "ledger_defaults": "select event_id, 'fail' as status, 1.0::double as cer, coalesce((props::json->>'k')::bigint, 0) as k from events",
    "missing_names": "select 'present.' || l || '.' || p as name from unnest(range(6)) as a(l), unnest(['decoder.key', 'decoder.value', 'encoder.key', 'encoder.value']) as b(p) where 'present.' || l || '.' || p not in (select 'present.' || n_nationkey % 6 || '.' || case when n_nationkey % 2 = 0 then 'decoder.key' else 'encoder.value' end from nation)",
    "schema_choice": "select n_nationkey::bigint as n_nationkey, coalesce(a.r_name, b.r_name) as schema from nation left join region a on n_nationkey % 3 = 0 and a.r_regionkey = n_regionkey left join region b on b.r_regionkey = n_regionkey % 3",
    "expected_labels": "select doc_id, coalesce(b.text, '...') as expected from documents left join benchmark b on doc_id = item_id",
    "flatten_layers": "select conv_id, dense_rank() over (partition by conv_id order by role) - 1 as li, role, row_number() over (partition by conv_id, role order by turn, text) - 1 as ri, text from conversations",
    "beam_parents": f"with {_BEAMS}, n as (select vec_id, 0 as kind, pos, list_append(tokens, token) as tokens, logprob + gain as logprob from beams join cands using (vec_id, beam) where not finished union all select vec_id, 1, beam, tokens, logprob from beams where finished), r as (select *, row_number() over (partition by vec_id order by logprob desc, kind, pos) - 1 as beam from n qualify beam < 4) select r.vec_id, r.beam, coalesce(min(b.beam), 0)::bigint as parent from r left join beams b on b.vec_id = r.vec_id and len(r.tokens) = len(b.tokens) + 1 and r.tokens[1:len(b.tokens)] = b.tokens group by all",
    "type_sizes": f"with {BOXES}, a as (select page_id, idx, p % 40 + 1 as n, case when idx % 2 = 0 then h else w end as al, case when idx % 2 = 0 then w else h end as ac from boxes), r as (select *, greatest(round(sqrt(n * ac::double / al)), 1) as runs from a) select page_id, idx, runs::bigint as runs, round(least(greatest(al / greatest(ceil(n / runs), 1), 12.0), 64.0), 4)::double as size from r",
    "scan_defects": "select page_id, floor((22 + ('0x' || substr(md5(page_id || ':0'), 1, 8))::bigint / 4294967296.0::double * (56 - (22))))::bigint as jpeg_quality, round((-4.0 + ('0x' || substr(md5(page_id || ':1'), 1, 8))::bigint / 4294967296.0::double * (4.0 - (-4.0))), 6) as rotate_deg, round((0.8 + ('0x' || substr(md5(page_id || ':2'), 1, 8))::bigint / 4294967296.0::double * (2.2 - (0.8))), 6) as blur_sigma, round((6.0 + ('0x' || substr(md5(page_id || ':3'), 1, 8))::bigint / 4294967296.0::double * (22.0 - (6.0))), 6) as noise_sd from pages",
    "provenance_lookup": "select doc_id as region_id, p as pointer, case p when '/text' then 'r' || doc_id % 3 else 'r9' end as record, case p when '/text' then 'engine-' || doc_id % 3 end as engine from documents, unnest(['/text', '/bounds']) as u(p)",
    "nested_ledger": f"with {READINGS} select region_id // 400 as series, region_id // 200 as volume, region_id // 50 as page, region_id // 5 as panel, row_number() over (partition by region_id // 5 order by region_id) - 1 as k, region_id, state, confidence from readings",
    "label_kinds": "select count(*) filter (role = 'user') as kept, count(*) filter (role is distinct from 'user') as excluded from conversations",
    "tensor_names": "with n as (select n_nationkey::bigint as n_nationkey, n_nationkey % 6 || '.' || case when n_nationkey % 3 = 0 then 'encoder' else 'decoder' end || '.' || case when n_nationkey % 2 = 0 then 'key' else 'value' end as t from nation) select n_nationkey, 'present.' || t as output, 'past_key_values.' || t as input from n",
    "clip_fixture": "with p as (select doc_id // 150 as page_id, count(*) as n from documents group by 1) select printf('page_%05d.png', page_id) as file, printf('page_%05d.json', page_id) as truth, n as rendered_regions, least(n, 120) as expected_kept, greatest(n - 120, 0) as expected_discarded from p",
    "smallest_boxes": f"with {BOXES} select page_id, idx, x, y, w, h, w * h as area from boxes order by area, page_id, idx limit 14",
    "region_texts": f"with {READINGS} select region_id, li / 100.0::double as l, ti / 100.0::double as t, ri / 100.0::double as r, bi / 100.0::double as b, conv_id // 20 as layer_id, role as language, c.text from readings left join conversations c on region_id = conv_id * 5 + turn",
    "placeholder_scan": "with l as (select doc_id, len(string_split(coalesce(text, ''), chr(10))) + 2 as line from documents) select doc_id, line, unnest(case doc_id % 3 when 0 then ['PLACEHOLDER', '\"STUB\"'] when 2 then ['\"DUMMY\"'] else [] end) as word from l",
    "props_conformance": "select event_id, event_id % 4 in (0, 3) and coalesce((props->>'k')::bigint between 0 and 90, false) as ok from events",
    "export_records": f"with {_RECORDS} select region_id, record from records",
    "export_record_digest": f"with {_RECORDS} select region_id, 'sha256:' || sha256(record) as record_digest from records",
    "manifest_digest": f"with {_RECORDS.replace(chr(34) + 'page' + chr(34), chr(34) + chr(39) + ' || ' + chr(39) + 'page-' + chr(39) + ' || region_id // 50 || ' + chr(39) + chr(34))}, {_MANIFEST} select page_id, pairs, 'sha256:' || sha256(text) as manifest_digest from unsigned",
}
