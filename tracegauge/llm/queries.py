"""The corpus operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predictions

    return predictions(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltree import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linefreq import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents")).drop("masked")


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import language_model

    return language_model(table(spark, sf_dir, "documents"), least=2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .keyscan import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import checked

    return checked(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_harmonic_packing, op2_near_duplicates, op3_license_scan, op4_language_id, op5_html_extraction, op6_quality_classifier, op7_decontamination, op8_quality_rules, op9_personal_data, op10_brown_lm, op11_conversation_repair, op12_secret_scan, op13_merkle_manifest)
}
#: Quality rules, with texts for hashes.
RULES_SQL = r"""
with d as (select row_number() over () as row, doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text from documents),
w as (select *, [x for x in string_split_regex(text, '[\x20\x09-\x0D]+') if x <> ''] as ws from d),
g as (select row, i, array_to_string(ws[i : i + 4], ' ') as g from (select row, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
hit as (select row, i from (select row, i, count(*) over (partition by row, g) as c from g) where c > 1),
again as (select row, count(distinct k) as n from (select row, unnest(range(i, i + 5)) as k from hit) group by row),
l as (select row, host, unnest(string_split(text, chr(10))) as line from d),
dup as (select row, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by row),
norm as (select row, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as x from l),
common as (select host, x from (select distinct row, host, x from norm where x <> '') group by host, x having count(*) > 50),
lost as (select row, count(*) as n, sum(length(x) - length(replace(x, ' ', '')) + 1) as words from norm join common using (host, x) group by row),
a as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(again.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0)::bigint as n_common_lines, (len(ws) - coalesce(lost.words, 0))::bigint as n_left_words
from w left join dup using (row) left join again using (row) left join lost using (row)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from a)
select *, not base_failed and n_left_words >= 10 and 100 * n_left_words >= 50 * n_words as kept from b"""
#: Diagonal voting, with texts for hashes.
SCAN_SQL = r"""
with tpl as (select *, string_split(body, ' ') as ws, least(3, len(string_split(body, ' '))) as k from (values {templates}) as v(template, body, label, base)),
tg as (select template, label, base, k, len(ws) - k + 1 as grams, t - 1 as t, array_to_string(ws[t : t + k - 1], ' ') as g from (select *, unnest(range(1, len(ws) - k + 2)) as t from tpl)),
d as (select row_number() over () as row, doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as ws from documents),
p as (select row, ws, unnest(range(1, len(ws) + 1)) as i from d),
dg as (select row, i - 1 as p, k, array_to_string(ws[i : i + k - 1], ' ') as g from p, (values (2), (3)) as kk(k) where i + k - 1 <= len(ws)),
v as (select row, template, label, base, grams, p - t as diagonal, count(*) as votes, min(p) as first, max(p) as last from dg join tg using (k, g) group by all),
n as (select *, case when base or diagonal - lag(diagonal) over (partition by row, template order by diagonal) > 3 then 1 else 0 end as new from v),
s as (select *, sum(new) over (partition by row, template order by diagonal) as span from n),
c as (select row, label, base, grams, sum(votes) as votes, min(first) as first, max(last) as last from s group by row, template, label, base, grams, span),
h as (select *, case when base then case when votes = grams then 1.0 end when least(1.0, votes / grams) >= 0.75 and last - first < grams + 6 then least(1.0, votes / grams) end as cover from c)
select doc_id, len(ws)::bigint as n_words, count(*) filter (base and cover is not null) as n_base, min(first) filter (base and cover is not null) as first_word, max(first) filter (base and cover is not null) as last_word,
coalesce(array_to_string(list_sort(list(distinct label) filter (base and cover is not null)), ','), '') as base_labels, coalesce(array_to_string(list_sort(list(distinct label) filter (cover is not null)), ','), '') as labels,
coalesce(max(cover), 0.0)::double as score, count(*) filter (not base and cover is not null) as n_spans
from d left join h using (row) group by row, doc_id, ws"""


def scan_sql() -> str:
    from .licenses import NOTICES, PHRASES

    listed = [(p, label, "true") for p, label in PHRASES.items()] + [(n, label, "false") for label, ns in NOTICES.items() for n in ns]
    return SCAN_SQL.replace("{templates}", ", ".join(f"({i}, '{t}', '{label}', {base})" for i, (t, label, base) in enumerate(listed)))


#: Full sets, all pairs that share a shingle, and the closure of links.
NEAR_SQL = r"""
with recursive w as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents),
g as (select doc_id, unnest(list_distinct(case when len(ws) < 2 then ws else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end)) as g from w),
n as (select doc_id, count(*) as n from g group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id as a, doc_id as b from w union select reach.a, edge.b from reach join edge on edge.a = reach.b),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, w.doc_id = component_id as kept from w join c using (doc_id) left join n using (doc_id)"""
#: CRC-32 of an ASCII text, from its polynomial.
TAB_SQL = "tab as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab)"
CRC_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"
#: The least (cost, audit) by turn and state, from turn to turn; two insertions before a turn and at the end are enough.
REPAIR_SQL = r"""
with recursive {tab},
c as (select row_number() over () as row, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as chance from conversations, tab),
d as (select conv_id, turn, case when chance = 4 then 'user' else role end as role, case chance when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
from (select *, unnest(range(case when chance = 3 then 2 else 1 end)) from c where chance <> 0)),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault, left(role, 1) as ini, lead(left(role, 1)) over (partition by conv_id order by i) as next from n),
k as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
count(*) filter (next is not null and ini || next not in ('su', 'ua', 'au')) as illegal, count(*) as rows from f group by conv_id),
want as (select * from (values ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) v(state, want)),
ins as (select *, case when j = 0 then state when j = 1 then want else case want when 'u' then 'a' else 'u' end end as now from want, range(3) r(j)),
lines as (select *, case j when 0 then [] when 1 then [case now when 'u' then 'user:' else 'assistant:' end] else [case now when 'u' then 'assistant:' else 'user:' end, case now when 'u' then 'user:' else 'assistant:' end] end as added from ins),
moves as (select f.*, l.state as before, l.j, l.added, l.now, w.want, unnest(['D', 'K', 'R']) as letter from f, lines l join want w on w.state = l.now),
ways as (select *, case letter when 'D' then now when 'K' then ini else want end as after, 2 * j + case letter when 'D' then 3 when 'K' then 0 else 2 end + case when letter <> 'D' and fault = 'truncated' then 1 else 0 end as price,
added || case letter when 'D' then [] when 'K' then [role || ':' || text] else [case want when 'u' then 'user:' else 'assistant:' end || text] end as said from moves
where letter = 'D' or (fault not in ('blank', 'duplicate') and (letter = 'R' or ini = want or (ini = 's' and now = '')))),
best as (select conv_id, 0::bigint as i, '' as state, 0::bigint as cost, '' as audit, []::varchar[] as said from k
union all select b.conv_id, w.i, w.after, b.cost + w.price, b.audit || repeat('I', w.j) || w.letter, b.said || w.said from best b join ways w on w.conv_id is not distinct from b.conv_id and w.i = b.i + 1 and w.before = b.state
qualify row_number() over (partition by b.conv_id, w.after order by b.cost + w.price, b.audit || repeat('I', w.j) || w.letter) = 1),
ended as (select b.conv_id, b.cost + 2 * l.j as cost, b.audit || repeat('I', l.j) as audit, b.said || l.added as said from best b join k on k.conv_id is not distinct from b.conv_id and k.rows = b.i join lines l on l.state = b.state where l.now in ('', 'a')
qualify row_number() over (partition by b.conv_id order by b.cost + 2 * l.j, b.audit || repeat('I', l.j)) = 1)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit,
sha256(coalesce(array_to_string(said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from c) o left join k on k.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id"""


def with_crc(sql: str, text: str) -> str:
    return sql.replace("{tab}", TAB_SQL).replace("{crc}", CRC_SQL.replace("{text}", text))


#: Both trees level by level; siblings by windows over a parent's children.
MERKLE_SQL = r"""
with recursive {tab},
crc as (select row_number() over () as row, *, {crc} as crc from documents, tab),
low as (select row, doc_id, source, lang, n_chars, text, case when crc % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as changed from crc),
head as (select *, concat({fields}) as head from low),
hashed as (select row, doc_id, source, sha256(head || {text}) as leaf, sha256(head || {changed}) as tampered from head),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, row) - 1 as pos, count(*) over (partition by source) as width from hashed),
nodes as (select 0 as level, source, pos, width, leaf as node from leaves
union all select level + 1, source, pos // 16, (any_value(width) + 15) // 16, sha256(string_agg(node, '' order by pos)) from nodes where width > 1 group by level, source, pos // 16),
subroots as (select source, node, row_number() over (order by encode(source) nulls first) - 1 as pos, count(*) over () as width from nodes where width = 1),
above as (select 0 as level, pos, width, node from subroots union all select level + 1, pos // 16, (any_value(width) + 15) // 16, sha256(string_agg(node, '' order by pos)) from above where width > 1 group by level, pos // 16),
beside as (select level, source, pos, coalesce(string_agg(node, '') over (partition by level, source, pos // 16 order by pos rows between unbounded preceding and 1 preceding), '') as l,
coalesce(string_agg(node, '') over (partition by level, source, pos // 16 order by pos rows between 1 following and unbounded following), '') as r from nodes where width > 1),
over_ as (select level, pos, coalesce(string_agg(node, '') over (partition by level, pos // 16 order by pos rows between unbounded preceding and 1 preceding), '') as l,
coalesce(string_agg(node, '') over (partition by level, pos // 16 order by pos rows between 1 following and unbounded following), '') as r from above where width > 1),
fold as (select row, source, 0 as level, pos, tampered as h, '' as proof from leaves
union all select row, fold.source, fold.level + 1, fold.pos // 16, sha256(l || h || r), proof || l || r from fold join beside b on fold.level = b.level and fold.pos = b.pos and fold.source is not distinct from b.source),
upper_ as (select row, 0 as level, s.pos, s.node as subroot, h, proof from (select * from fold qualify row_number() over (partition by row order by level desc) = 1) f join subroots s on f.source is not distinct from s.source
union all select row, upper_.level + 1, upper_.pos // 16, subroot, sha256(l || h || r), proof || l || r from upper_ join over_ using (level, pos)),
done as (select * from upper_ qualify row_number() over (partition by row order by level desc) = 1)
select doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, h as folded_root, h = node as verified from done join leaves using (row), (select node from above where width = 1)"""


def merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    return with_crc(MERKLE_SQL, "coalesce(doc_id::varchar, '')").replace("{fields}", ", ".join(map(field, ("doc_id", "source", "lang", "n_chars")))).replace("{text}", field("text")).replace("{changed}", field("changed"))


ORACLES: dict[str, str] = {"op11_conversation_repair": with_crc(REPAIR_SQL, "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"), "op13_merkle_manifest": merkle_sql(), "op2_near_duplicates": NEAR_SQL, "op3_license_scan": scan_sql(), "op8_quality_rules": RULES_SQL}
